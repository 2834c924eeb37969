"""Sources and parsers."""
