"""Personal data in texts: patterns propose spans, checksums confirm them, nearby context words adjust the score.

Only SQL functions are used. A pattern's matches and the texts between them come from two regular expression calls, and
their running lengths give the places; only texts with a match pay for that. Patterns use possessive repeats and start
only where a run starts, so long runs cost linear time.

Base kinds (email, ip, card, phone) are kept whatever their score. The method adds, from a score of 0.6:
iban (mod 97), cards of 13 to 15 digits (Luhn) and numbers like 123-45-6789 or 555-123-4567 beside a context word,
and phone numbers that a base match swallowed together with other digits. Added spans never overlap base spans.

Null texts count as empty; they have no spans. Every row is judged alone, so repeated rows give equal results; an empty
table gives none; other columns are ignored. Places are code points from 0, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, pick

SPAN = "array<struct<start:int,end:int,value:string>>"
PART = 256
CONTEXT = 40

#: Words near a span that speak for a kind.
WORDS_NEAR = {
    "card": "card|credit|debit|visa|mastercard|amex|karte|carte|tarjeta",
    "phone": "phone|tel|telephone|call|fax|mobile|cell|telefon|téléphone|teléfono",
    "ssn": "ssn|social|security|taxpayer",
    "iban": "iban|account|bank|konto|compte|cuenta",
}

#: Patterns of the base kinds, written so that they find the same spans in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
LONG_NUMBER = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Patterns of what the method adds.
SHORT_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,14}+(?![\x20-]?[0-9])"
#: Characters of an account number by country code; other codes take the longest run.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = r"(?<![A-Za-z0-9])(?:" + "|".join(
    rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items()
) + rf"|(?!{'|'.join(IBAN_LENGTHS.values()).replace(' ', '|')})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}+)(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL_PHONE = r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"
FULL_PHONE = r"\+[0-9]{1,3}[\x20.-]\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{4}(?![0-9-])"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
ADD_FROM = 0.6


def spans(text: Column, pattern: str, possible: Column | None = None) -> Column:
    """All matches of a pattern: start, end, value."""
    none = F.array().cast(SPAN)

    def place(matches: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        pairs = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("value")))
        start = F.struct(F.lit(0).alias("at"), none.alias("part"), F.array().cast(f"array<{SPAN}>").alias("full"))

        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + F.length(x["gap"])
            end = begin + F.length(x["value"])
            span = F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value"))
            over = F.size(acc["part"]) >= PART
            return F.struct(
                end.alias("at"),
                F.when(over, F.array(span)).otherwise(F.array_append(acc["part"], span)).cast(SPAN).alias("part"),
                F.when(over, F.array_append(acc["full"], acc["part"])).otherwise(acc["full"]).cast(f"array<{SPAN}>").alias("full"),
            )

        return F.aggregate(pairs, start, step, lambda acc: F.concat(F.flatten(acc["full"]), acc["part"]))

    def looked(matches: Column) -> Column:
        return F.when(F.size(matches) == 0, none).otherwise(place(matches))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), looked)
    return found if possible is None else F.when(possible, found).otherwise(none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    def total(reversed_digits: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            d = F.substr(reversed_digits, i, F.lit(1)).cast("int")
            return acc + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

        return F.aggregate(F.sequence(F.lit(1), F.length(reversed_digits)), F.lit(0), add) % 10 == 0

    return let(F.reverse(number), total)


def mod_97(iban: Column) -> Column:
    """Whether the account number (without spaces) leaves 1 by mod 97."""
    def rest(turned: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            c = F.ascii(F.substr(turned, i, F.lit(1)))
            return F.when(c < 65, acc * 10 + c - 48).otherwise(acc * 100 + c - 55) % 97

        return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1

    return let(F.concat(F.substring(iban, 5, 60), F.substring(iban, 1, 4)), rest)


def near(text: Column, span: Column, kind: str) -> Column:
    """Whether a word for the kind stands in the CONTEXT characters before or after the span, earlier matches included."""
    word = rf"(?<![\p{{L}}])(?:{WORDS_NEAR[kind]})s?(?![\p{{L}}])"
    begin = F.greatest(span["start"] - CONTEXT, F.lit(0))
    before = F.substr(text, begin + 1, span["start"] - begin)
    return F.lower(before).rlike(word) | F.lower(F.substr(text, span["end"] + 1, F.lit(CONTEXT))).rlike(word)


def score(text: Column, span: Column, base: float, kind: str, confirmed: Column | None = None) -> Column:
    """A pattern's own weight, more by 0.3 with a passed checksum and by 0.4 with a context word; 0 if a checksum fails."""
    s = F.lit(base) + F.when(near(text, span, kind), 0.4).otherwise(0.0)
    return s if confirmed is None else F.when(confirmed, s + 0.3).otherwise(0.0)


def kinds(text: Column) -> dict[str, tuple[Column, Column]]:
    """Base and added spans of each kind."""
    number = text.rlike("[0-9]")
    email = spans(text, EMAIL, F.contains(text, F.lit("@")))
    ip = F.filter(spans(text, IP, number), lambda s: s["value"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
    card = F.filter(spans(text, LONG_NUMBER, number), lambda s: let(
        digits(s["value"]), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False)))
    phone = F.filter(spans(text, PHONE, F.contains(text, F.lit("+"))), lambda s: F.length(digits(s["value"])).between(8, 15))
    short_card = F.filter(spans(text, SHORT_CARD, number), lambda s: score(text, s, 0.1, "card", luhn(digits(s["value"]))) >= ADD_FROM)
    more_phone = F.concat(
        F.filter(spans(text, LOCAL_PHONE, number), lambda s: score(text, s, 0.3, "phone") >= ADD_FROM),
        F.filter(spans(text, FULL_PHONE, F.contains(text, F.lit("+"))), lambda s: F.length(digits(s["value"])).between(8, 15)),
    )
    iban = F.filter(spans(text, IBAN, number), lambda s: score(text, s, 0.4, "iban", mod_97(F.replace(s["value"], F.lit(" "), F.lit("")))) >= ADD_FROM)
    ssn = F.filter(spans(text, SSN, number), lambda s: score(text, s, 0.3, "ssn") >= ADD_FROM)
    none = F.array().cast(SPAN)
    return {"email": (email, none), "ip": (ip, none), "card": (card, short_card), "phone": (phone, more_phone),
            "iban": (none, iban), "ssn": (none, ssn)}


def personal_spans(docs: DataFrame) -> DataFrame:
    """doc_id, and for each row ``base`` and ``all``: arrays of kind, start, end."""
    rows = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    found = kinds(F.col("text"))
    base_names, added_names = [f"base_{k}" for k in found], [f"added_{k}" for k in found]
    wide = rows.select("doc_id", *[c.alias(n) for pair, b, a in zip(found.values(), base_names, added_names)
                                   for c, n in zip(pair, (b, a))])

    def named(kind: str, list_: Column) -> Column:
        return F.transform(list_, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    base = F.concat(*[named(k, F.col(n)) for k, n in zip(found, base_names)])
    rows = wide.select("doc_id", base.alias("base"), *added_names)

    def apart(list_: Column) -> Column:
        return F.filter(list_, lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))

    def of(kind: str) -> Column:
        mine = F.filter("base", lambda b: b["kind"] == kind)
        return F.when(F.size(f"added_{kind}") == 0, mine).otherwise(
            F.array_sort(F.array_distinct(F.concat(mine, named(kind, apart(F.col(f"added_{kind}")))))))

    return rows.select("doc_id", "base", F.concat(*[of(k) for k in found]).alias("all"))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    def text_of(list_: str) -> Column:
        return F.array_join(F.transform(list_, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return personal_spans(docs).select(
        "doc_id", *[count(k) for k in ("email", "ip", "card", "phone")], F.sha2(text_of("base"), 256).alias("base_sha256"),
        text_of("all").alias("spans"), (F.size("all") - F.size("base")).cast("long").alias("n_added"),
    )
