"""Messages enriched by URL from a table of captured responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lookups import lookup_join


def enrich_by_url(
    df: DataFrame, url: str, responses: DataFrame, shape: str = "body",
    response_url: str = "url", body: str = "body", order: str | None = None,
) -> DataFrame:
    """``df`` with the response to each message's URL (S8); messages without one are dropped.

    ``shape="body"`` adds the variant ``response``: the JSON body, or ``{"data": body}`` when the
    body is no JSON. ``shape="envelope"`` adds the struct ``response`` of ``body`` (JSON, else the
    text), ``headers`` and ``status`` as the response table has them. If a URL was captured more than
    once, the last by ``order`` counts; without ``order`` that is an error when the query runs.

    The response table shrinks to one row per URL first, and a URL that very many messages share is
    split on the message side.
    """
    if shape not in ("body", "envelope"):
        raise ValueError("shape is 'body' or 'envelope'")
    extras = [c for c in ("headers", "status") if c in responses.columns]
    parts = F.struct(body, *extras)
    repeated = F.raise_error("a URL has several responses: give order").cast(responses.select(parts).schema[0].dataType)
    chosen = F.max_by(parts, order) if order else F.when(F.count("*") == 1, F.first(parts)).otherwise(repeated)
    latest = responses.groupBy(F.col(response_url).alias("_url")).agg(chosen.alias("_r"))
    text = F.col(f"_r.{body}")
    parsed = F.try_parse_json(text)
    if shape == "body":
        made = F.coalesce(parsed, F.parse_json(F.to_json(F.struct(text.alias("data")))))
    else:
        as_text = F.to_variant_object(F.struct(text.alias("t")))
        as_text = F.variant_get(as_text, "$.t", "variant")
        made = F.struct(
            F.coalesce(parsed, as_text).alias("body"), *[F.col(f"_r.{c}").alias(c) for c in extras]
        )
    # Decoded once per URL, not once per message.
    decoded = latest.select("_url", made.alias("response"))
    return lookup_join(df, decoded, [url], ["_url"], "inner").select(*df.columns, "response")
