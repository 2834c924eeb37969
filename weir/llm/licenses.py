"""License scan: Dice coefficient of word bigrams between parts of a text and license templates.

Parts of a text are its lines, its paragraphs (between blank lines) and the whole text, each different one once. Words
are runs of letters and digits in lower case. Dice is twice the shared different bigrams by the sum of both counts;
a part matches from THRESHOLD on. Size bounds come first: with t = THRESHOLD, only templates whose bigram count lies
between t/(2-t) and (2-t)/t of the part's can match, and parts outside the bounds of all templates are not hashed.
Bigrams are looked up in a fixed-size bitmap of the templates' bigrams; a part with fewer hits than the least template
needs leaves, and the few others are joined by bigram, counted and compared exactly. Only SQL functions are used.

Null and empty texts and parts of fewer than two words match nothing. Each row is judged alone by its doc_id and text;
equal rows each get a row. An empty table gives none. Other columns are ignored. Templates are a constant list.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, pick
from .decontaminate import bitmap, marked

THRESHOLD = 0.8

#: Customary notices of well-known licenses.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]


def template_bigrams(text: str) -> list[str]:
    words = re.findall(r"[^\W_]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def words_of(part: Column) -> Column:
    return F.array_remove(F.split(F.lower(part), r"[^\p{L}\p{N}]+"), "")


def matches(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, tag (hash of the text), copies, and found: sorted array of license, dice (best of all parts).

    Documents without a match are in it with an empty array.
    """
    spark = docs.sparkSession
    templates = [(i, name, template_bigrams(text)) for i, (name, text) in enumerate(TEMPLATES)]
    sizes = [len(b) for _, _, b in templates]
    ratio = threshold / (2 - threshold)
    least, most = ratio * min(sizes), max(sizes) / ratio
    table = spark.createDataFrame(
        [(i, name, len(bigrams), b) for i, name, bigrams in templates for b in bigrams],
        "template int, license string, size int, bigram string",
    )
    bits = bitmap(table.select(F.xxhash64("bigram").alias("mark")).distinct())
    needed = min(sizes) * ratio

    def pairs(words: Column) -> Column:
        return F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1))))

    def hits(bigrams: Column) -> Column:
        known = F.filter(bigrams, lambda b: marked(bits, F.xxhash64(b)))
        return F.struct(F.size(bigrams).alias("n"), known.alias("bigrams"))

    def scanned(part: Column) -> Column:
        none = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("bigrams"))
        return let(words_of(part), lambda w: F.when(F.size(w) < 2, none).when(
            # repeated bigrams may make a long part small, so only its shortness bounds it before they are counted
            F.size(w) - 1 < least, none).otherwise(let(pairs(w), lambda b: F.when(F.size(b) > most, none).otherwise(let(b, hits)))))

    text = F.coalesce("text", F.lit(""))
    parts = F.array_distinct(F.concat(F.array(text), F.split(text, "\n", -1), F.split(text, r"\n[\x20\x09-\x0D]*\n", -1)))
    tried = F.filter(F.transform(parts, scanned), lambda x: F.size(x["bigrams"]) >= needed)
    rows = docs.select("doc_id", F.xxhash64("text").alias("tag"), F.array_distinct(tried).alias("tried"))
    numbered = F.concat(F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).alias("n"), F.array(F.lit("")).alias("bigrams"))),
                        F.transform("tried", lambda x, i: F.struct(i.alias("part"), x["n"].alias("n"), x["bigrams"].alias("bigrams"))))
    parts_of = rows.select("doc_id", "tag", F.inline(numbered)).select("doc_id", "tag", "part", "n", F.explode("bigrams").alias("bigram"))
    # the template table is constant, so small by itself
    joined = parts_of.join(F.broadcast(table), "bigram", "left").where("part < 0 or template is not null")
    dice = joined.groupBy("doc_id", "tag", "part", "n", "template", "license", "size").agg(F.count("*").alias("k")).withColumn(
        "dice", 2 * F.col("k") / (F.col("n") + F.col("size")))
    good = (F.col("part") >= 0) & (F.col("dice") >= threshold)
    best = dice.where(good | (F.col("part") < 0)).groupBy("doc_id", "tag", "license").agg(
        F.max("dice").alias("dice"), F.max(F.when(F.col("part") < 0, F.col("k"))).alias("copies"))
    found = F.collect_list(F.when(F.col("license").isNotNull(), F.struct("license", "dice")))
    return best.groupBy("doc_id", "tag").agg(F.max("copies").alias("copies"), F.array_sort(found).alias("found"))


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_licenses, licenses (sorted, comma-joined), best_dice (rounded to 6 places; null without a match)."""
    rows = matches(pick(docs, "doc_id", "text"))
    return rows.select(
        "doc_id", F.size("found").cast("long").alias("n_licenses"),
        F.array_join(F.transform("found", lambda x: x["license"]), ",").alias("licenses"),
        F.round(F.array_max(F.transform("found", lambda x: x["dice"])), 6).alias("best_dice"),
        F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")


def license_sql() -> str:
    """The same by SQL, every part against every template."""
    rows = ", ".join(f"({i}, '{name}', [{', '.join(repr(b) for b in template_bigrams(text))}])" for i, (name, text) in enumerate(TEMPLATES))
    return rf"""
WITH t(template, license, b) AS (VALUES {rows}),
p AS (SELECT DISTINCT doc_id, part FROM (SELECT doc_id, unnest(list_concat([coalesce(text, '')],
  string_split(coalesce(text, ''), chr(10)), regexp_split_to_array(coalesce(text, ''), '\n[\x20\x09-\x0D]*\n'))) AS part FROM documents)),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(part), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT doc_id, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 1),
d AS (SELECT doc_id, license, max(2.0 * len(list_intersect(g, b)) / (len(g) + len(b))) AS dice FROM g, t
  WHERE len(g) <= 2 * len(b) GROUP BY doc_id, license),
m AS (SELECT doc_id, count(*) AS n, string_agg(license, ',' ORDER BY license) AS licenses, max(dice) AS best FROM d WHERE dice >= {THRESHOLD} GROUP BY doc_id)
SELECT documents.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_licenses, coalesce(licenses, '') AS licenses, round(best, 6) AS best_dice
FROM documents LEFT JOIN m ON documents.doc_id = m.doc_id
"""
