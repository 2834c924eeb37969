"""Column expressions shared by the operators. All of them stay on the JVM."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Option of ``to_json``: its default drops microseconds.
MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def as_col(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def micros(ts: str | Column) -> Column:
    """A timestamp as epoch microseconds (exact, bigint)."""
    return F.unix_micros(as_col(ts))


def path(col: str | Column, expr: str, as_type: str = "string") -> Column:
    """Member of a variant column by JSON path, e.g. ``$.a.b[0]`` or ``$['b/c.d'][1]``.

    ``$`` is the whole message. A missing member or one of another type gives null.
    """
    return F.try_variant_get(as_col(col), expr, as_type)


def entries(col: str | Column) -> Column:
    """A variant object as a map of its members, which are variants; null for other values."""
    return F.try_variant_get(as_col(col), "$", "map<string,variant>")


def elements(col: str | Column) -> Column:
    """A variant array as an array of variants; null for other values."""
    return F.try_variant_get(as_col(col), "$", "array<variant>")


def num(col: str | Column) -> Column:
    """Text to number; null where the text is no number."""
    return as_col(col).try_cast("double")


def exists_key(col: str | Column, key: str, kind: str = "json") -> Column:
    """Whether an object has ``key``; a key that is present with a null value counts.

    ``kind`` says how the object is held: ``json`` text, ``variant``, ``map`` or ``struct``
    (a struct has no absent keys, so there a null field counts as absent).
    """
    c = as_col(col)
    if kind == "map":
        return F.coalesce(F.map_contains_key(c, key), F.lit(False))
    if kind == "struct":
        return c.getField(key).isNotNull()
    text = F.to_json(c) if kind == "variant" else c
    return F.coalesce(F.array_contains(F.json_object_keys(text), key), F.lit(False))


def label_text(col: str | Column, data_type: str) -> Column:
    """Histogram label of a value: text as is, ``true``/``false``, integers, and floats in
    their shortest form. Floats use an exponent of at least two digits when the decimal
    exponent is below -4 or at least 6: ``1``, ``0.0001``, ``123456``, ``1e+06``, ``1e-05``.

    ``data_type`` is the Spark type name of ``col``; other types give null (such values are
    skipped by the histogram). A variant's value decides for itself; all of its numbers are floats.
    """
    c = as_col(col)
    if data_type == "variant":
        kind = F.schema_of_variant(c)
        number = label_text(F.try_variant_get(c, "$", "double"), "double")
        return F.when(kind.isin("STRING", "BOOLEAN"), F.try_variant_get(c, "$", "string")).when(
            kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), number)
    if data_type in ("string", "boolean", "tinyint", "smallint", "int", "bigint"):
        return c.cast("string")
    if data_type not in ("float", "double"):
        return F.lit(None).cast("string")
    return _let(c, lambda x: _let(_float_parts(x), lambda p: _let(_float_digits(x, p), _float_label)))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once for each row however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _float_parts(c: Column) -> Column:
    # A float prints the digits of its own width, so the text is taken before widening.
    text = F.abs(c).cast("string")
    part = r"^([0-9]+)\.([0-9]+)(?:E(-?[0-9]+))?$"
    return F.struct(
        text.alias("text"), (text != c.cast("string")).alias("negative"), F.regexp_extract(text, part, 1).alias("whole"),
        F.regexp_extract(text, part, 2).alias("frac"),
        F.coalesce(F.regexp_extract(text, part, 3).try_cast("int"), F.lit(0)).alias("shift"),
    )


def _float_digits(c: Column, p: Column) -> Column:
    all_digits = F.concat(p["whole"], p["frac"])
    lead = F.length(all_digits) - F.length(F.ltrim(all_digits, F.lit("0")))
    return F.struct(
        F.when(F.isnan(c), "NaN").when(p["text"] == "Infinity", F.when(p["negative"], "-Inf").otherwise("+Inf"))
        .when(c == 0, F.when(p["negative"], "-0").otherwise("0")).alias("special"),
        p["negative"].alias("negative"), F.trim(all_digits, F.lit("0")).alias("digits"),
        (F.length(p["whole"]) + p["shift"] - lead).alias("point"), c.isNull().alias("none"),
    )


def _float_label(d: Column) -> Column:
    digits, point = d["digits"], d["point"]
    exponent = point - 1
    tail = F.substr(digits, F.lit(2))
    scientific = F.concat(
        F.substr(digits, F.lit(1), F.lit(1)),
        F.when(F.length(tail) > 0, F.concat(F.lit("."), tail)).otherwise(""),
        F.when(exponent < 0, "e-").otherwise("e+"),
        F.when(F.abs(exponent) < 10, "0").otherwise(""),
        F.abs(exponent).cast("string"),
    )
    plain = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(
            F.length(digits) <= point,
            F.concat(digits, F.repeat(F.lit("0"), point - F.length(digits))),
        )
        .otherwise(
            F.concat(
                F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1)
            )
        )
    )
    body = F.when((exponent < -4) | (exponent >= 6), scientific).otherwise(plain)
    signed = F.when(d["negative"], F.concat(F.lit("-"), body)).otherwise(body)
    return F.when(~d["none"], F.coalesce(d["special"], signed))


def array_literal(values: list, ddl: str) -> Column:
    """A constant array of the given type; folded once by the optimizer, so the plan holds
    one literal instead of one expression per element."""
    return F.from_json(F.lit(json.dumps(values)), ddl)


def with_count_le(
    df: DataFrame, name: str, bounds: Column, size: int, key: Column
) -> DataFrame:
    """``df`` with the column ``name``: how many of the ascending ``bounds`` (a constant array of
    ``size`` numbers) are <= ``key``.

    A binary search in about log2(size) plain column steps, so it runs in generated code and needs
    no join.
    """
    df = df.withColumn(name, F.lit(0))
    for i in reversed(range(size.bit_length())):
        further = F.col(name) + (1 << i)
        fits = (further <= size) & (F.get(bounds, further - 1) <= key)
        df = df.withColumn(name, F.when(fits, further).otherwise(F.col(name)))
    return df


def count_le(bounds: Column, size: int, key: Column) -> Column:
    """The same as one expression, for keys that are structs: their comparison is too much code to
    repeat in every step. The key travels in the accumulator, so that the lambda refers to no column;
    the optimizer can lose track of columns that a lambda captures."""
    further = lambda acc, step: acc["at"] + step
    fits = lambda acc, step: (
        (further(acc, step) <= size) & (F.get(bounds, further(acc, step) - 1) <= acc["key"])
    )
    return F.aggregate(
        F.array(*[F.lit(1 << i) for i in reversed(range(size.bit_length()))]),
        F.struct(F.lit(0).alias("at"), key.alias("key")),
        lambda acc, step: F.struct(
            F.when(fits(acc, step), further(acc, step)).otherwise(acc["at"]).alias("at"),
            acc["key"].alias("key"),
        ),
        lambda acc: acc["at"],
    )


def hashed_uniform(seed: int, salt: int, id_col: str | Column) -> Column:
    """A uniform number in [0, 1) that depends only on ``seed``, ``salt`` and the row's id, so
    the draw is the same however the rows are partitioned or retried."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(salt), as_col(id_col)), 11)
    return bits.cast("double") / F.lit(float(1 << 53))
