"""Reading and decoding messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decode_messages(
    df: DataFrame, payload: str, on_error: str = "data",
    schema: str | T.StructType | None = None, keep: list[str] | None = None,
) -> DataFrame:
    """Decode a JSON payload column (S4); ``keep`` names further columns to pass on.

    Without a schema the result column ``message`` is a variant. With ``on_error="data"`` a payload
    that is no JSON becomes ``{"data": payload}``; with ``"drop"`` the row is dropped. With a schema
    the result has its columns and, unless dropping, ``data``: the payload if it is no JSON object or
    if a field is not of the schema's type.
    """
    if on_error not in ("data", "drop"):
        raise ValueError("on_error is 'data' or 'drop'")
    keep = list(keep or [])
    text = F.col(payload).cast("string")
    parsed = F.try_parse_json(text)
    rows = df.where(text.isNotNull())
    if on_error == "drop":
        rows = rows.where(parsed.isNotNull())
    if schema is None:
        wrapped = F.parse_json(F.to_json(F.struct(text.alias("data"))))
        return rows.select(*keep, F.coalesce(parsed, wrapped).alias("message"))
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    out = rows.select(
        *keep, text.alias("_text"), F.from_json(text, wide, {"columnNameOfCorruptRecord": "_bad"}).alias("_m")
    )
    bad = F.coalesce(F.col("_m._bad"), F.when(F.col("_m").isNull(), F.col("_text")))
    data = [bad.alias("data")] if on_error == "data" else []
    return out.select(*keep, *[F.col("_m").getField(f.name).alias(f.name) for f in schema.fields], *data)


def read_messages(
    spark: SparkSession, path: str, schema: str | T.StructType | None = None,
    streaming: bool = False,
) -> DataFrame:
    """One message per line of the files at ``path`` (S1), decoded as in ``decode_messages``.

    A last line without newline is read; reading ends at the end of the files. ``streaming`` picks
    up new files as they arrive.
    """
    reader = spark.readStream if streaming else spark.read
    return decode_messages(reader.text(path), "value", "data", schema)


#: White space that is trimmed before a field; line ends are not part of it.
CSV_SPACE = r"[ \t\x0B\f\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]*+"
#: The inside of a quoted field, in which a quote is doubled.
CSV_QUOTED = r'[^"]*+(?:""[^"]*+)*+'
CSV_FIELD = rf'{CSV_SPACE}(?:"{CSV_QUOTED}"(?=[,\n]|\z)|(?!")[^",\n]*+(?!"))'
CSV_GOOD = rf"{CSV_FIELD}(?:,{CSV_FIELD})*+(?:\n|\z)"
#: A record whose next field has a quote inside an unquoted one, text behind its closing quote, or no closing quote. It
#: ends with the line in which that shows.
CSV_BAD = rf'(?:{CSV_FIELD},)*+{CSV_SPACE}(?:(?!")[^",\n]*+"[^\n]*+|"{CSV_QUOTED}"[^,\n][^\n]*+|"{CSV_QUOTED}\z)(?:\n|\z)'


def csv_records(text: str | Column) -> Column:
    """The records of a CSV text as an array of ``{fields, malformed}``: the fields, or the text of a malformed record.

    The text is read from its start without a gap, each record beginning where the one before ended. Quoted fields may hold
    commas, doubled quotes and newlines; white space before a field is trimmed; empty lines are skipped; records may differ
    in length; ``\\r\\n`` counts as a newline everywhere. A record is malformed if a quote stands inside an unquoted field, if
    anything but a comma or line end follows a closing quote, or if a quote is never closed; reading goes on with the next line.
    """
    whole = F.col(text) if isinstance(text, str) else text
    whole = F.regexp_replace(whole, r"\r(?=\n|\z)", "")
    records = F.filter(
        F.regexp_extract_all(whole, F.lit(rf"\G(?:{CSV_GOOD}|{CSV_BAD})"), F.lit(0)), lambda r: ~r.isin("", "\n"))
    field = rf'\G{CSV_SPACE}("{CSV_QUOTED}"|[^",]*+),'
    quoted = lambda f: F.replace(F.substr(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))

    def fields(record: Column) -> Column:
        line = F.regexp_replace(record, r"\n\z", "")
        return F.transform(
            F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(field), F.lit(1)),
            lambda f: F.when(F.startswith(f, F.lit('"')), quoted(f)).otherwise(f))

    good = lambda r: r.rlike(rf"\A{CSV_GOOD}\z")
    return F.transform(records, lambda r: F.struct(
        F.when(good(r), fields(r)).alias("fields"), F.when(~good(r), r).alias("malformed")))


def parse_csv(
    df: DataFrame, col: str, headers: list[str], keep: list[str] | None = None, on_error: str = "drop",
) -> DataFrame:
    """One row per record of the CSV texts in ``col`` (S2): ``record`` number, the ``headers`` as
    text columns (null where a record is short) and ``extra``, the further fields in a map keyed by
    their index (``"3"``), null if there are none. ``keep`` columns are passed on.

    Malformed records (see ``csv_records``) are dropped, but count in ``record``; with ``on_error="keep"`` they come with null
    columns and their text in the further column ``malformed``.
    """
    if on_error not in ("drop", "keep"):
        raise ValueError("on_error is 'drop' or 'keep'")
    n = len(headers)
    fields = F.col("_record.fields")
    rest = F.slice(fields, n + 1, F.greatest(F.size(fields) - n, F.lit(0)))
    names = F.transform(rest, lambda _, i: (i + n).cast("string"))
    extra = F.when(F.size(fields) > n, F.map_from_arrays(names, rest))
    rows = df.select(*(keep or []), F.posexplode(csv_records(col)).alias("record", "_record"))
    if on_error == "drop":
        rows = rows.where("_record.malformed IS NULL")
    return rows.select(
        *(keep or []), "record",
        *[F.get(fields, F.lit(i)).alias(h) for i, h in enumerate(headers)],
        extra.alias("extra"), *([F.col("_record.malformed").alias("malformed")] if on_error == "keep" else []),
    )


def parse_xml(
    df: DataFrame, col: str, root: str, schema: str | T.StructType | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Parse the XML texts in ``col`` into a struct column named like the ``root`` element (S3).

    Attributes and child elements share one namespace without a prefix; repeated elements are
    arrays where the schema says so. Without a schema the column is a variant, in which attribute
    names begin with ``_``.
    """
    if schema is None:
        tree = F.from_xml(F.col(col), "variant")
    else:
        tree = F.from_xml(F.col(col), schema, {"attributePrefix": ""})
    return df.select(*(keep or []), tree.alias(root))


def split_frames(
    df: DataFrame, chunk: str, seq: str, connection: str, rows_per_chunk: int | None = None
) -> DataFrame:
    """Messages of long-lived byte streams (S5): ``connection``, ``frame``, ``piece``, ``payload``.

    The chunks of a connection, ordered by ``seq``, are collected until one ends in ``}`` and a
    newline, or in CR LF; the collected text is split at newlines and empty pieces are skipped. What
    follows the last such chunk is not yet complete and stays out.
    """
    from ..plans.ordering import CHUNK, ordered

    ends = F.endswith(F.col(chunk), F.lit("}\n")) | F.endswith(F.col(chunk), F.lit("\r\n"))
    rows = df.select(
        connection, seq, F.col(chunk).alias("_text"), ends.cast("int").alias("_end")
    ).where(F.col(chunk).isNotNull() & F.col(connection).isNotNull())
    numbered = ordered(rows, [seq], [connection], rows_per_chunk).scan(
        exclusive=True, frame=("sum", F.col("_end"))
    ).df
    texts = numbered.groupBy(connection, "frame").agg(
        F.sort_array(F.collect_list(F.struct(seq, "_text"))).alias("_parts"),
        F.max("_end").alias("_complete"),
    ).where(F.col("_complete") == 1)
    whole = F.array_join(F.transform("_parts", lambda p: p["_text"]), "")
    lines = F.transform(F.split(whole, "\n"), lambda x: F.rtrim(x, F.lit("\r")))
    return texts.select(
        connection, "frame",
        F.posexplode(F.filter(lines, lambda x: x != "")).alias("piece", "payload"),
    )


__all__ = [
    "csv_records", "decode_messages", "parse_csv", "parse_xml", "read_messages",
    "split_frames",
]
