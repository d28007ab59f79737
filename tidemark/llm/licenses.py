"""License scans with DataFrame functions only: MinHash bands over overlapping text windows, then exact containment.

Words are runs of a-z and 0-9 after lower-casing A-Z; shingles are five words. For a template of s shingles, windows of
s + step - 1 shingles begin at every multiple of step = max(1, s // 4), so every occurrence lies whole in one. Each of
``BANDS`` bands is one minimum hash. A window that holds the share 0.8 of a template has a Jaccard similarity of at
least 0.8 s / (1.2 s + step - 1) >= 0.55, and misses all bands with a probability below 0.45^16 = 3e-6; one that holds
all of it, below 0.2^16. Windows without a single template shingle cannot match and make no bands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import fence
from tidemark.llm.common import lower_az, own_columns

SHINGLE, BANDS, CONTAINMENT = 5, 16, 0.8

# Wordings of public license notices, as (template, license, text).
TEMPLATES = (
    ("apache-2.0-line", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("mit-line", "MIT", "Released under the MIT License."),
    ("gpl-3.0-line", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0-line", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0-line", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0-line", "CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("mpl-2.0-notice", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("apache-2.0-notice", "Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-3.0-notice", "GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mit-grant", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("isc-grant", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd-grant", "BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("unlicense-grant", "Unlicense", "This is free and unencumbered software released into the public domain."),
)


def shingled(texts: DataFrame, text: str) -> DataFrame:
    """``texts`` with the array ``shingles`` of their shingles' hashes in order; fewer than five words give none."""
    words = fence(texts.withColumn("word_hashes", F.transform(F.regexp_extract_all(lower_az(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.xxhash64(w))))
    at = lambda i: [F.get("word_hashes", i + k) for k in range(SHINGLE)]
    starts = F.when(F.size("word_hashes") >= SHINGLE, F.sequence(F.lit(0), F.size("word_hashes") - SHINGLE)).otherwise(F.array().cast("array<int>"))
    return fence(words.withColumn("shingles", F.transform(starts, lambda i: F.xxhash64(*at(i)))).drop("word_hashes", text))


def min_hashes(shingles: Column, bands: int = BANDS) -> Column:
    """One minimum hash per band, with the band's number: the keys under which windows and templates meet."""
    return F.array(*[F.struct(F.lit(b).alias("band"), F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, F.lit(b)))).alias("least")) for b in range(bands)])


def template_table(spark, templates=TEMPLATES) -> DataFrame:
    """template, license, distinct shingles, size in shingles and step of the windows. Below five words: left out."""
    rows = [F.struct(*[F.lit(x).alias(n) for n, x in zip(("template", "license", "body"), t)]) for t in templates]
    base = spark.range(1).select(F.inline(F.array(*rows)))
    return shingled(base, "body").where(F.size("shingles") > 0).select("template", "license", F.size("shingles").alias("length"), F.greatest(F.lit(1), F.floor(F.size("shingles") / 4).cast("int")).alias("step"), F.array_distinct("shingles").alias("marks"))


def scan(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT, bands: int = BANDS) -> DataFrame:
    """One row per document row and template found: doc_id, template, license, containment, first_word.

    ``containment`` is the highest share of the template's distinct shingles in one window, ``first_word`` the place
    (from 0) of the first such shingle in the first matching window. Null, empty and short texts match nothing;
    repeated rows are reported each; null doc_ids are kept; other columns are not read; an empty table gives no rows.
    The templates are the caller's fixed list. Their shingles are written into the plan and their bands are broadcast
    (BANDS rows per template), so that list bounds what every task holds.
    """
    spark = docs.sparkSession
    table = template_table(spark, templates) if templates else None
    known = table.select("length", "step", "marks").collect() if templates else []
    if not known:
        return spark.createDataFrame([], "doc_id long, template string, license string, containment double, first_word int")
    marks, sizes = sorted({m for r in known for m in r.marks}), sorted({(r.length, r.step) for r in known})
    base = own_columns(docs, doc_id="long", text="string").withColumn("row", F.monotonically_increasing_id())
    held = fence(shingled(base, "text").withColumn("hits", F.filter(F.transform("shingles", lambda s, i: F.when(s.isin(*marks), i)), lambda i: i.isNotNull()))).where(F.size("hits") > 0)
    # the windows, per size, that hold a hit: those that begin at the multiples of step from hit - (window - 1) to hit
    starts = lambda n, step: F.array_distinct(F.flatten(F.transform("hits", lambda i: F.transform(F.sequence(F.ceil(F.greatest(F.lit(0), i - (n + step - 2)) / step).cast("int"), F.floor(i / step).cast("int")), lambda k: k * step))))
    spots = F.flatten(F.array(*[F.transform(starts(n, step), lambda at: F.struct(F.lit(n).alias("length"), F.lit(n + step - 1).alias("window"), at.alias("at"))) for n, step in sizes]))
    windows = fence(held.select("row", "doc_id", "shingles", F.explode(spots).alias("w")).select("row", "doc_id", F.col("w.length").alias("length"), F.col("w.at").alias("at"), F.slice("shingles", F.col("w.at") + 1, F.col("w.window")).alias("inside")))
    keyed = windows.select("row", "doc_id", "length", "at", "inside", F.explode(min_hashes(F.col("inside"), bands)).alias("b")).select("*", "b.band", "b.least").drop("b")
    theirs = table.select("template", "license", "length", "marks", F.explode(min_hashes(F.col("marks"), bands)).alias("b")).select("template", "license", "length", "marks", "b.band", "b.least")
    share = F.size(F.array_intersect("inside", "marks")) / F.size("marks")
    met = keyed.join(F.broadcast(theirs), ["length", "band", "least"]).withColumn("containment", share).where(F.col("containment") >= containment)
    first = F.col("at") + F.array_position(F.transform("inside", lambda s: F.array_contains("marks", s)), True).cast("int") - 1
    return met.groupBy("row", "template", "license").agg(F.any_value("doc_id").alias("doc_id"), F.max("containment").alias("containment"), F.min(first).alias("first_word")).select("doc_id", "template", "license", "containment", "first_word")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("containment", F.round("containment", 6))


def _values() -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    return ", ".join(f"({', '.join(map(quoted, t))})" for t in TEMPLATES)


OP4_SQL = f"""
with texts as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') as w from documents),
listed(template, license, body) as (values {_values()}),
templates as (select template, license, regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') as w from listed),
marks as (select distinct template, license, s, n, greatest(1, n // 4) as step from (select template, license, len(w) - 4 as n, array_to_string(w[i : i + 4], ' ') as s from (select *, unnest(range(1, len(w) - 3)) as i from templates))),
totals as (select template, count(*) as total from marks group by template),
places as (select r, doc_id, i - 1 as p, array_to_string(w[i : i + 4], ' ') as s from (select *, unnest(range(1, len(w) - 3)) as i from texts)),
hits as (select r, doc_id, p, s, template, license, n, step from places join marks using (s)),
inside as (select *, unnest(range(cast(ceil(greatest(0, p - (n + step - 2)) / step) as bigint), p // step + 1)) * step as spot from hits),
met as (select r, doc_id, template, license, spot, count(distinct s) as k, min(p) as p from inside group by all)
select doc_id, template, license, round(max(k / total), 6) as containment, cast(min(p) as integer) as first_word
from met join totals using (template) where k >= {CONTAINMENT} * total group by r, doc_id, template, license
"""
