"""Physical recipes: chunked scans along an order and trailing windows."""
