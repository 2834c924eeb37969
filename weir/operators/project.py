"""Filtering, mapping, masking and unpacking of single messages. None of these shuffles."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.expressions import MICROS, as_col, elements, entries


def filter_messages(df: DataFrame, cond: str | Column | None = None) -> DataFrame:
    """The unchanged messages for which ``cond`` is true (P5). Null counts as not true; without a
    condition, messages that are null in every column are dropped."""
    if cond is None:
        return df.dropna("all")
    return df.where(cond)


def _value(rule) -> Column:
    if isinstance(rule, dict):
        return F.struct(*[_value(v).alias(k) for k, v in rule.items() if _is_rule(v)])
    return F.expr(rule) if isinstance(rule, str) else rule


def _is_rule(rule) -> bool:
    return isinstance(rule, (dict, str, Column))


def map_messages(df: DataFrame, mapping: dict, additive: bool = True) -> DataFrame:
    """Build columns from expressions.

    Values are SQL expressions or Columns; a nested dict makes a struct; values of other kinds
    are ignored. ``additive`` keeps the input columns and overwrites those named in the mapping.
    All expressions see the original row.
    """
    cols = {k: _value(v) for k, v in mapping.items() if _is_rule(v)}
    if additive:
        return df.withColumns(cols)
    return df.select(*[c.alias(k) for k, c in cols.items()])


def mask(df: DataFrame, keys: dict, message: str | None = None) -> DataFrame:
    """Keep the named columns only, recursively into structs, maps with text keys and variants.

    ``{}`` keeps everything below; unknown keys are skipped; a value without members is kept
    as it is. Of structs only the kept leaves are read by the scan. ``message`` names a column with whole messages as variants:
    then the keys are those of the messages, the other columns stay, and a message that is no object is dropped.
    """
    if message is not None:
        rows = df.where(entries(message).isNotNull())
        return rows.withColumn(message, masked_variant(F.col(message), keys))
    if not keys:
        return df
    cols = _masked(df.schema, keys, F.col)
    return df.select(*cols)


def masked_variant(value: Column, keys: dict) -> Column:
    """A variant object with the named members only; null for a variant that is no object, unless all is kept."""
    if not keys:
        return value
    members = entries(value)
    kept = F.map_filter(members, lambda k, _: k.isin(*keys))
    nested = _nested(keys)
    if nested:
        kept = F.transform_values(kept, lambda k, v: _by_key(k, v, nested, lambda x, below: F.coalesce(masked_variant(x, below), x)))
    return F.when(members.isNotNull(), F.to_variant_object(kept))


def _nested(keys: dict) -> dict[str, dict]:
    return {k: below for k, below in keys.items() if isinstance(below, dict) and below}


def _by_key(key: Column, value: Column, nested: dict[str, dict], change: Callable[[Column, dict], Column]) -> Column:
    out = value
    for name, below in nested.items():
        out = F.when(key == name, change(value, below)).otherwise(out)
    return out


def _masked_map(kind: T.MapType, col: Column, keys: dict) -> Column:
    kept, nested = F.map_filter(col, lambda k, _: k.isin(*keys)), _nested(keys)
    if nested and isinstance(kind.valueType, T.VariantType):
        change = lambda x, below: F.coalesce(masked_variant(x, below), x)
    elif nested and isinstance(kind.valueType, T.MapType):
        change = lambda x, below: _masked_map(kind.valueType, x, below)
    else:
        return kept  # structs of one map have one type, whatever the key
    return F.transform_values(kept, lambda k, v: _by_key(k, v, nested, change))


def _masked(schema: T.StructType, keys: dict, get: Callable[[str], Column]) -> list[Column]:
    out = []
    for field in schema.fields:
        if field.name not in keys:
            continue
        col, below = get(_quoted(field.name)), keys[field.name]
        if isinstance(below, dict) and below:
            if isinstance(field.dataType, T.StructType):
                inner = _masked(field.dataType, below, lambda n, c=col: c.getField(n.strip("`")))
                if inner:
                    col = F.when(col.isNotNull(), F.struct(*inner))
                else:
                    col = F.when(col.isNotNull(), F.from_json(F.lit("{}"), "struct<>"))
            elif isinstance(field.dataType, T.VariantType):
                col = F.coalesce(masked_variant(col, below), col)
            elif isinstance(field.dataType, T.MapType) and isinstance(field.dataType.keyType, T.StringType):
                col = _masked_map(field.dataType, col, below)
        out.append(col.alias(field.name))
    return out


def _quoted(name: str) -> str:
    return f"`{name}`" if "." in name else name


def unpack(df: DataFrame, array_col: str, label: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """One message per array element (P8); a null array gives none.

    Struct elements become the message's columns, others the column ``Value``. With ``label`` the
    messages are ``Value`` and ``Label``, the label taken from the parent. The elements of a variant are variants: without a
    label they are the messages, in the column ``message``. A variant that is no array gives none. ``keep`` names columns of
    the parent to pass on.
    """
    kind = df.select(array_col).schema[0].dataType
    variant = isinstance(kind, T.VariantType)
    values = elements(array_col) if variant else F.col(array_col)
    keep = list(keep or [])
    if label is not None:
        if label == array_col:
            raise ValueError("the label must not be the array itself")
        return df.select(*keep, F.explode(values).alias("Value"), F.col(label).alias("Label"))
    if variant:
        return df.select(*keep, F.explode(values).alias("message"))
    if not isinstance(kind, T.ArrayType):
        raise ValueError(f"{array_col!r} is not an array")
    if isinstance(kind.elementType, T.StructType):
        return df.select(*keep, F.explode(array_col).alias("_e")).select(*keep, "_e.*")
    return df.select(*keep, F.explode(array_col).alias("Value"))


def to_messages(df: DataFrame) -> DataFrame:
    """Every row as one JSON object in the column ``message`` (P12). Null fields are absent; times
    keep their microseconds."""
    return df.select(F.to_json(F.struct("*"), MICROS).alias("message"))


def script(
    df: DataFrame,
    fn: dict[str, str | Column] | Callable[[dict], dict],
    schema: str | T.StructType | None = None,
) -> DataFrame:
    """A user's script per message.

    Preferred is a dict of SQL expressions, which makes the output message inside Spark. A Python
    function from dict to dict is run over Arrow batches and needs the output ``schema``; a
    message for which it raises is dropped, and nothing is shared between messages.
    """
    if isinstance(fn, dict):
        return map_messages(df, fn, additive=False)
    if schema is None:
        raise ValueError("a Python script needs the output schema")
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    arrow_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for message in batch.to_pylist():
                try:
                    made = fn(message)
                    out.append({f.name: made.get(f.name) for f in arrow_schema})
                except Exception:  # noqa: BLE001 - any error means: no output for this message
                    continue
            yield pa.RecordBatch.from_pylist(out, schema=arrow_schema)

    return df.mapInArrow(run, schema)


def fft(df: DataFrame, series: str, out: str = "fft") -> DataFrame:
    """``df`` with the complex spectrum ``[[re, im], …]`` of an array of ``{timestamp, value}``
    (P11). The timestamps are not used; a missing value counts as 0.

    A message's array is transformed within its row, in two steps over n1 and n2 points where n = n1 * n2 with n1 as
    near to the root of n as it divides: n * (n1 + n2) terms. Series of many points belong in rows: see ``dft_by_key``.
    """
    at = lambda cells, i: F.get(cells, i.cast("int"))
    zero = lambda: F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))

    def rotated(c: Column, turns: Column, of: Column) -> Column:
        """c times e to the -2 pi i turns / of."""
        a = F.lit(-2 * math.pi) * F.pmod(turns, of) / of
        return F.struct((c["re"] * F.cos(a) - c["im"] * F.sin(a)).alias("re"), (c["re"] * F.sin(a) + c["im"] * F.cos(a)).alias("im"))

    def total(n: Column, term: Callable[[Column], Column]) -> Column:
        plus = lambda s, t: F.struct((s["re"] + t["re"]).alias("re"), (s["im"] + t["im"]).alias("im"))
        return F.aggregate(upto(n), zero(), lambda s, i: plus(s, term(i)))

    upto = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)

    def inner(s: Column) -> Column:
        """For each t2 and k1 the sum over t1 of x[n2 t1 + t2], turned."""
        point = lambda t2, t1: F.struct(at(s["x"], s["n2"] * t1 + t2).alias("re"), F.lit(0.0).alias("im"))
        return F.transform(upto(s["n2"]), lambda t2: F.transform(upto(s["n1"]), lambda k1: total(
            s["n1"], lambda t1: rotated(point(t2, t1), t1 * k1, s["n1"]))))

    def outer(s: Column) -> Column:
        return F.transform(upto(s["n1"] * s["n2"]), lambda k: total(s["n2"], lambda t2: rotated(
            at(at(s["y"], t2), F.pmod(k, s["n1"])), t2 * k, s["n1"] * s["n2"])))

    numbers = F.transform(series, lambda p: F.coalesce(p["value"].cast("double"), F.lit(0.0)))
    size = F.size(numbers).cast("bigint")
    divisors = F.filter(F.sequence(F.lit(1).cast("bigint"), F.floor(F.sqrt(size))), lambda d: size % d == 0)
    n1 = F.element_at(divisors, -1)
    split = F.struct(numbers.alias("x"), n1.alias("n1"), F.floor(size / n1).alias("n2"))
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    cells = let(let(split, lambda s: F.struct(inner(s).alias("y"), s["n1"].alias("n1"), s["n2"].alias("n2"))), outer)
    pairs = F.transform(cells, lambda c: F.array(c["re"], c["im"]))
    empty = F.array().cast("array<array<double>>")
    return df.withColumn(out, F.when(F.size(F.col(series)) > 0, pairs).when(F.col(series).isNotNull(), empty))


#: Points that one step of a transform adds up in columns, and in rows; a larger prime factor takes the chirp form.
RADIX, ROW_RADIX = 8, 64


def radices(n: int) -> list[int]:
    """Factors whose product is n, prime ones gathered to at most RADIX, small ones last."""
    primes, m, p = [], n, 2
    while m > 1:
        while m % p == 0:
            primes.append(p)
            m //= p
        p = p + 1 if p * p <= m else m
    out: list[int] = []
    for q in sorted(primes, reverse=True):
        fit = next((i for i, f in enumerate(out) if f * q <= RADIX), None)
        if fit is None:
            out.append(q)
        else:
            out[fit] *= q
    return out


def _turned(re: Column, im: Column, turns: Column, of: int) -> tuple[Column, Column]:
    """re + i im times e to the -2 pi i turns / of; whole turns are taken off first, which keeps the angle exact."""
    a = F.lit(-2 * math.pi / of) * F.pmod(turns, F.lit(of))
    return re * F.cos(a) - im * F.sin(a), re * F.sin(a) + im * F.cos(a)


def _transformed(rows: DataFrame, key: str, n: int) -> DataFrame:
    """key, k, re, im: the spectrum of rows with key, t, re and im, in one step for each factor of n.

    Before a step there are points t < r for each of q frequencies k, with q * r = n. A step of radix f takes the points
    t = t1 * (r / f) + t2 of one t2 and k together and gives f frequencies k + q * k1. So a step shuffles n rows.
    """
    r, q = n, 1
    rows = rows.select(key, F.col("t").cast("bigint").alias("t"), F.lit(0).cast("bigint").alias("k"), "re", "im")
    for f in radices(n):
        step = r // f
        t1, t2 = F.floor(F.col("t") / step), F.pmod("t", F.lit(step))
        parts = rows.select(key, t1.alias("t1"), t2.alias("t2"), "k", "re", "im")
        if f <= RADIX:
            cell = lambda c, j: F.coalesce(F.sum(F.when(F.col("t1") == j, F.col(c))), F.lit(0.0))
            parts = parts.groupBy(key, "t2", "k").agg(*[cell(c, j).alias(f"{c}{j}") for j in range(f) for c in ("re", "im")])
            cells = []
            for k1 in range(f):
                re, im = F.col("re0"), F.col("im0")
                for j in range(1, f):
                    a = 2 * math.pi * (j * k1 % f) / f
                    c, s = round(math.cos(a), 16), round(-math.sin(a), 16)
                    for factor, x, y in ((c, F.col(f"re{j}"), F.col(f"im{j}")), (s, -F.col(f"im{j}"), F.col(f"re{j}"))):
                        if abs(factor) > 1e-15:
                            re, im = (re + x, im + y) if factor == 1 else (re + x * factor, im + y * factor)
                cells.append(F.struct(F.lit(k1).alias("k1"), re.alias("re"), im.alias("im")))
            parts = parts.select(key, "t2", "k", F.inline(F.array(*cells)))
        else:
            each = parts.select("*", F.explode(F.sequence(F.lit(0), F.lit(f - 1))).alias("k1"))
            re, im = _turned(F.col("re"), F.col("im"), F.col("t1") * F.col("k1"), f)
            parts = each.groupBy(key, "t2", "k", "k1").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))
        re, im = _turned(F.col("re"), F.col("im"), F.col("t2") * F.col("k1"), r)
        rows = parts.select(key, F.col("t2").alias("t"), (F.col("k") + q * F.col("k1")).alias("k"), re.alias("re"), im.alias("im"))
        r, q = step, q * f
    return rows.select(key, "k", "re", "im")


def _chirped(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The spectrum for any n: t k = (t^2 + k^2 - (k - t)^2) / 2, so it is a convolution with a chirp, done by three
    transforms of a power of two of at least 2 n - 1 points. The chirp's own is shared by all keys."""
    m = 1 << (2 * n - 2).bit_length()
    square = lambda c: F.pmod(F.col(c) * F.col(c), F.lit(2 * n))
    re, im = _turned(F.col("re"), F.col("im"), square("t"), 2 * n)
    signal = _transformed(rows.select(key, "t", re.alias("re"), im.alias("im")), key, m)
    grid = rows.sparkSession.range(m).select(F.lit(0).alias("_one"), F.col("id").alias("t"), F.least("id", m - F.col("id")).alias("d"))
    a = F.lit(math.pi / n) * square("d")
    chirp = grid.where(F.col("d") < n).select("_one", "t", F.cos(a).alias("re"), F.sin(a).alias("im"))
    chirp = _transformed(chirp, "_one", m).select(F.col("k").alias("_k"), F.col("re").alias("_re"), F.col("im").alias("_im"))
    # conjugated before and after, a transform is its own inverse times m
    product = signal.join(chirp, F.col("k") == F.col("_k")).select(
        key, F.col("k").alias("t"), (F.col("re") * F.col("_re") - F.col("im") * F.col("_im")).alias("re"),
        (-(F.col("re") * F.col("_im") + F.col("im") * F.col("_re"))).alias("im"))
    back = _transformed(product, key, m).where(F.col("k") < n)
    re, im = _turned(F.col("re") / m, -F.col("im") / m, square("k"), 2 * n)
    return back.select(key, "k", re.alias("re"), im.alias("im"))


def dft_by_key(df: DataFrame, key: str, idx: str, value: str, n: int) -> DataFrame:
    """Spectrum of a series in long form: ``key``, ``k``, ``re``, ``im``.

    Each key has up to ``n`` points numbered 0…n-1 in ``idx``; points that lack, or have no number, count as 0, and points of
    one number are added. The transform goes factor by factor of n, with n rows to shuffle for each, whatever the length.
    A prime factor beyond ROW_RADIX takes the chirp form. No key's series is brought together in one task.
    """
    if n < 1:
        raise ValueError("the number of points must be positive")
    points = df.where(F.col(idx).between(0, n - 1)).groupBy(key, F.col(idx).cast("bigint").alias("t")).agg(
        F.coalesce(F.sum(F.col(value).try_cast("double")), F.lit(0.0)).alias("re")).withColumn("im", F.lit(0.0))
    if n == 1:
        return points.select(key, F.col("t").alias("k"), "re", "im")
    return (_chirped if max(radices(n)) > ROW_RADIX else _transformed)(points, key, n)


def render_mail(
    df: DataFrame, from_col: str, to_col: str, subject_col: str, message_col: str
) -> DataFrame:
    """Mail text in the column ``mail`` (K5); rows that lack one of the four parts are skipped."""
    parts = [from_col, to_col, subject_col, message_col]
    whole = F.format_string("From:%s\nTo:%s\nSubject:%s\n\n%s", *[as_col(p) for p in parts])
    return df.dropna("any", subset=parts).select("*", whole.alias("mail"))
