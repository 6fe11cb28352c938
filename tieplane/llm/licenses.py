"""License scans: MinHash bands over overlapping text windows, exact containment; DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

WORDS = 5
#: Bands of one MinHash value each. A window of twice a template's length that holds CONTAINED of it has a
#: Jaccard similarity of 0.8 / 2.2 at least, so one band meets with a chance of 1 - (1 - 0.36)**24 > 0.9999.
BANDS = 24
#: Share, in percent, of a template's shingles that a window must hold.
CONTAINED = 80
#: Templates that one pass over the texts takes; what is broadcast, and what stands in the plan, is bounded by
#: TEMPLATES * BANDS values. With more, there are more passes.
TEMPLATES = 500

#: Notices of public licenses (name, text).
NOTICES = [
    ("mit-notice", "Released under the MIT License."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2.0-header", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd-conditions", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
]
#: Notices of fewer than WORDS words.
SHORT_NOTICES = [("all-rights-reserved", "All rights reserved.")]


def notices(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(n).alias("template"), F.lit(t).alias("text")) for n, t in NOTICES + SHORT_NOTICES]
    return spark.range(1).select(F.inline(F.array(*rows)))


def split(text: Column) -> Column:
    """The words of a text; a word is letters and digits, lower-cased."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def runs(words: Column, n: int) -> Column:
    """Hashes of the runs of n words, in order. Fewer words have none."""
    each = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(*(F.get(w, i + (k - 1)) for k in range(n))))
    return F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) >= n, each(w)).otherwise(F.array().cast("array<long>"))), F.lit(0))


def shingles(text: Column) -> Column:
    """Hashes of the runs of WORDS words, in order. Shorter texts have none."""
    return runs(split(text), WORDS)


def short_held(docs: DataFrame, short: list, id_col: str, text_col: str) -> DataFrame:
    """Where templates of fewer than WORDS words stand, each one run of its own length: doc_id, template, t, at,
    containment. As for any template of one shingle, windows are two runs long and start at every run."""
    out = None
    for n in sorted({len(r.words) for r in short}):
        known = F.array(*map(F.lit, sorted({r.h for r in short if len(r.words) == n})))
        s = docs.select(F.col(id_col).alias("doc_id"), runs(split(F.col(text_col).cast("string")), n).alias("s")).filter(F.arrays_overlap("s", known))
        told = docs.sparkSession.range(1).select(F.inline(F.array(*(F.struct(F.lit(r.template).alias("template"), F.lit(r.h).alias("h")) for r in short if len(r.words) == n))))
        met = s.select("doc_id", F.posexplode("s").alias("at", "h")).join(F.broadcast(told), "h")
        starts = F.filter(F.array(F.col("at") - 1, F.col("at")), lambda x: x >= 0)
        held = met.select("doc_id", "template", F.lit(1).alias("t"), F.explode(starts).alias("at"), F.lit(1.0).alias("containment"))
        out = held if out is None else out.unionByName(held)
    return out.distinct()


def best_windows(held: DataFrame) -> DataFrame:
    best = F.max(F.struct("containment", (-F.col("at")).alias("at")))
    return held.groupBy("doc_id", "template").agg(best.alias("best"), F.countDistinct("at").alias("windows")).select("doc_id", "template", F.col("best.containment").alias("containment"), (-F.col("best.at")).cast("int").alias("window"), "windows")


def scan_licenses(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS) -> DataFrame:
    """Finds the templates that documents hold, wherever in the text.

    Returns doc_id, template, containment (share of the template's shingles in the best window), window (the
    first shingle of the first such window), windows (how many hold enough). For each template length t a
    text is cut into windows of 2t shingles, a new one every t, so each stretch of length t is whole in one.
    Windows and templates of a length meet when a MinHash value is equal; exact containment of CONTAINED
    percent decides. A band can only meet at a shingle that is a template's own minimum, so texts and windows
    without any such shingle are passed over before values are computed, which changes no result.

    Null and empty texts hold nothing; repeated rows count as one document with their windows added once;
    a template shorter than WORDS words is one shingle, met by runs of its own length, one without words is
    ignored; of equal names each counts; very long texts are scanned whole; an empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    told = templates.select(F.col("template").cast("string").alias("template"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    passes = -(-templates.count() // TEMPLATES)
    if passes > 1:
        told = Scratch(docs.sparkSession, "templates").keep(told, "told")
    each = [windows_held(docs, told.filter(F.pmod(F.xxhash64("row"), F.lit(passes)) == k) if passes > 1 else told, id_col, text_col, bands) for k in range(max(1, passes))]
    return best_windows(reduce(DataFrame.unionByName, each))


def windows_held(docs: DataFrame, templates: DataFrame, id_col: str, text_col: str, bands: int) -> DataFrame:
    """The windows that hold enough of a template: doc_id, template, t, at, containment."""
    told = templates.select("template", split(F.col("text")).alias("words")).dropna().filter(F.size("words") > 0)
    whole = F.coalesce(*(F.when(F.size("words") == n, F.get(runs(F.col("words"), n), F.lit(0))) for n in range(1, WORDS)))
    short = told.filter(F.size("words") < WORDS).withColumn("h", whole).collect()
    told = told.filter(F.size("words") >= WORDS).select("template", F.array_distinct(runs(F.col("words"), WORDS)).alias("own"))
    value = lambda s, k: F.array_min(F.transform(s, lambda h: F.struct(F.xxhash64(h, k).alias("v"), h.alias("h"))))
    numbers = F.array(*map(F.lit, range(bands)))
    known = told.select("template", "own", F.size("own").alias("t"), F.transform(numbers, lambda k: value(F.col("own"), k)).alias("least"))
    rows = known.collect()
    none = docs.select(F.col(id_col).alias("doc_id")).filter(F.lit(False)).select("doc_id", F.lit("").alias("template"), F.lit(0).alias("t"), F.lit(0).alias("at"), F.lit(0.0).alias("containment"))
    few = short_held(docs, short, id_col, text_col) if short else none
    if not rows:
        return few
    anchors = F.array(*map(F.lit, sorted({x.h for r in rows for x in r.least})))
    lengths = F.array(*map(F.lit, sorted({r.t for r in rows})))
    banded = known.select("template", "own", "t", F.posexplode("least").alias("band", "x")).select("template", "own", "t", "band", F.col("x.v").alias("v"))
    found = docs.select(F.col(id_col).alias("doc_id"), shingles(F.col(text_col).cast("string")).alias("s")).filter(F.arrays_overlap("s", anchors))
    places = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: F.array_contains(anchors, F.get("s", i)))
    # a shingle at p lies in the windows that start at the last two multiples of t up to p
    around = lambda p: F.flatten(F.transform(lengths, lambda t: F.array(*(F.struct(t.alias("t"), (p - F.pmod(p, t) - k * t).alias("at")) for k in (0, 1)))))
    starts = F.array_distinct(F.filter(F.flatten(F.transform(places, around)), lambda w: w["at"] >= 0))
    parts = F.transform(starts, lambda w: F.struct(w["t"].alias("t"), w["at"].alias("at"), F.slice("s", w["at"] + 1, 2 * w["t"]).alias("part")))
    cut = found.select("doc_id", F.explode(parts).alias("w")).select("doc_id", "w.t", "w.at", "w.part")
    values = cut.select("doc_id", "t", "at", "part", F.posexplode(F.transform(numbers, lambda k: value(F.col("part"), k)["v"])).alias("band", "v"))
    met = values.join(F.broadcast(banded), ["t", "band", "v"])
    share = F.size(F.array_intersect("part", "own")) / F.col("t")
    held = met.select("doc_id", "template", "t", "at", share.alias("containment")).filter(F.col("containment") * 100 >= CONTAINED).distinct()
    return held.unionByName(few)


_values = lambda notices: ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in notices)
_SHINGLES = "CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) ELSE [] END"
_SPLIT = r"list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
ORACLE = f"""
WITH n(template, text) AS (VALUES {_values(NOTICES)}),
nt AS (SELECT template, list_distinct({_SHINGLES}) AS own FROM (SELECT template, {_SPLIT.format('text')} AS w FROM n)),
d AS (SELECT doc_id, {_SHINGLES} AS s FROM (SELECT doc_id, {_SPLIT.format('text')} AS w FROM documents)),
c AS (SELECT doc_id, template, own, len(own) AS t, s FROM d JOIN nt ON list_has_any(s, own)),
v AS (SELECT doc_id, template, own, t, pos, list_slice(s, pos + 1, pos + 2 * t) AS part FROM c, LATERAL (SELECT unnest(range(0, len(s), t)) AS pos)),
h AS (SELECT doc_id, template, pos, len(list_intersect(part, own)) / t AS containment FROM v),
k AS (SELECT * FROM h WHERE containment * 100 >= {CONTAINED})
SELECT doc_id, template, max(containment) AS containment, min(pos) FILTER (WHERE containment = m)::INT AS window, count(DISTINCT pos) AS windows
FROM (SELECT *, max(containment) OVER (PARTITION BY doc_id, template) AS m FROM k) GROUP BY doc_id, template
UNION ALL SELECT doc_id, template, 1.0::DOUBLE, min(pos)::INT, count(DISTINCT pos) FROM (
  SELECT doc_id, template, unnest([p - 1, p]) AS pos FROM (
    SELECT doc_id, template, w, o, unnest(range(0, len(w) - len(o) + 1)) AS p FROM (SELECT doc_id, {_SPLIT.format('text')} AS w FROM documents), (SELECT template, {_SPLIT.format('text')} AS o FROM (VALUES {_values(SHORT_NOTICES)}) z(template, text)))
  WHERE list_slice(w, p + 1, p + len(o)) = o) WHERE pos >= 0 GROUP BY doc_id, template
"""
