"""License scans with native expressions only: MinHash bands over text windows, then exact containment.

Texts and templates are cut into lower-case words at ASCII punctuation, and into shingles
of five words.  For templates of m shingles a text is covered by windows of 1.5 m shingles
at a stride of m / 2, so that every run of m shingles lies within one window.  A window
retrieves the templates of its size with which it shares one of 24 MinHash values (bands
of one value); a retrieved template matches if at least ``percent`` in 100 of its shingles
are in the window.  A match has a Jaccard similarity of 0.8 m / 1.7 m = 0.47 at least, so
it is missed with a probability of 0.53 ** 24 = 2.5e-7.  Windows without a single shingle
of any template cannot match; they are dropped before their MinHash values are computed.

Scale: one pass over the texts without a shuffle gives the few texts that hold a template
shingle; only their shingles, written to scratch, are windowed.  Templates are parameters
of at most ``MAX_TEMPLATES``; ids and counts alone are joined back to all documents.  No
Python runs on the executors.

Templates are parameters, one branch of the plan for each distinct number of their shingles:
sets of some dozens of templates are meant, not whole collections of license texts.

Defined cases: null and empty texts, and texts under five words, match nothing; very long
texts are windowed whole; of equally good windows the first counts; templates under five
words are refused; equal rows get equal results; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motifmill.llm import common

SHINGLE, BANDS, PERCENT, MAX_TEMPLATES = 5, 24, 80, 5000

TEMPLATES = (
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("mit-notice", "Released under the MIT License."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    (
        "mit-permission",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software",
    ),
    (
        "bsd-redistribution",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    (
        "gpl-program",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation",
    ),
    ("cc-by-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
)

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates a value once for all its uses inside an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles(text: Column) -> Column:
    """64-bit hashes of a text's shingles in order (none for under five words)."""
    words = F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_WORD), F.lit(0)), lambda w: F.xxhash64(w))

    def rolled(h: Column) -> Column:
        starts = F.when(F.size(h) >= SHINGLE, F.sequence(F.lit(0), F.size(h) - SHINGLE)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda p: F.xxhash64(*[F.get(h, p + k) for k in range(SHINGLE)]))

    return _let(words, rolled)


def _longs(values: Sequence[int]) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in values])


def min_hashes(window: Column, bands: int = BANDS) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.array_min(F.transform(window, lambda x: F.xxhash64(x, b))))


def template_table(spark: SparkSession, templates: Sequence[tuple[str, str]]) -> list[dict]:
    """Distinct shingles and MinHash values of the templates (a bounded parameter)."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    rows = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("text")) for n, t in templates])).alias("x"))
    rows = rows.select("x.name", F.array_distinct(shingles(F.col("x.text"))).alias("s")).select("name", "s", min_hashes(F.col("s")).alias("bands"))
    out = [r.asDict() for r in rows.collect()]
    if short := [r["name"] for r in out if not r["s"]]:
        raise ValueError(f"templates of under {SHINGLE} words: {short}")
    return out


def window_sizes(m: int) -> tuple[int, int]:
    """Shingles of a window and its stride, for templates of m shingles."""
    return m + (m + 1) // 2, (m + 1) // 2


def license_matches(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", screen: bool = True) -> tuple[DataFrame, common.Scratch]:
    """Row keys (k1, k2) with each matching template: best containment and the words of the window.

    Without ``screen`` all windows of all texts are retrieved by their MinHash values alone.
    """
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "license_scan")
    known = template_table(spark, templates)
    every = _longs(sorted({s for r in known for s in r["s"]}))
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = docs.where(t.isNotNull()).select(F.xxhash64(i, t).alias("k1"), F.xxhash64(t, i, F.lit(7)).alias("k2"), shingles(t).alias("s"))
    held = scratch.write(rows.where(F.arrays_overlap("s", every) if screen else F.size("s") > 0), "held").dropDuplicates(["k1", "k2"])
    found = None
    for m in sorted({len(r["s"]) for r in known}):
        own = [r for r in known if len(r["s"]) == m]
        size, stride = window_sizes(m)
        starts = F.sequence(F.lit(0), F.size("s") - 1, F.lit(stride))
        windows = F.transform(starts, lambda p: F.struct(p.alias("first"), F.array_distinct(F.slice(F.col("s"), p + 1, size)).alias("w")))
        hit = F.filter(windows, lambda x: F.arrays_overlap(x["w"], _longs(sorted({s for r in own for s in r["s"]})))) if screen else windows
        banded = held.select("k1", "k2", F.explode(hit).alias("x")).select("k1", "k2", "x.first", "x.w", F.posexplode(min_hashes(F.col("x.w"))).alias("band", "value"))
        struct = [F.struct(F.lit(r["name"]).alias("name"), _longs(r["s"]).alias("ts"), _longs(r["bands"]).alias("values")) for r in own]
        known_bands = spark.range(1).select(F.inline(F.array(*struct))).select("name", "ts", F.posexplode("values").alias("band", "value"))
        retrieved = banded.join(known_bands, ["band", "value"]).dropDuplicates(["k1", "k2", "first", "name"])
        common_ = F.size(F.array_intersect("w", "ts"))
        matches = retrieved.where(100 * common_ >= percent * m).select(
            "k1", "k2", "name", (common_ / m).alias("containment"), F.col("first").alias("first_word"), (F.col("first") + F.size("w") + SHINGLE - 1).alias("past_word")
        )
        found = matches if found is None else found.unionByName(matches)
    best = found.groupBy("k1", "k2", "name").agg(F.max(F.struct("containment", (-F.col("first_word")).alias("f"), "past_word")).alias("x"))
    return best.select("k1", "k2", "name", "x.containment", (-F.col("x.f")).alias("first_word"), "x.past_word"), scratch


def license_scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", screen: bool = True) -> DataFrame:
    """Each row's matching templates: their sorted names, and a record of each."""
    matches, scratch = license_matches(docs, templates, percent, id_col, text_col, screen)
    record = F.struct("name", "containment", "first_word", "past_word")
    by_row = scratch.write(matches.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(record)).alias("matches")), "matches")
    scratch.drop("held")
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = docs.select(i.alias(id_col), F.xxhash64(i, t).alias("k1"), F.xxhash64(t, i, F.lit(7)).alias("k2"))
    empty = F.array().cast(by_row.schema["matches"].dataType)
    return rows.join(by_row, ["k1", "k2"], "left").select(id_col, F.coalesce("matches", empty).alias("matches"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("matches").cast("bigint").alias("n_licenses"), F.array_join(F.col("matches.name"), ",").alias("licenses"))


def _sql() -> str:
    """All windows of all texts against all templates, without MinHash."""
    words = lambda c: f"regexp_extract_all(lower(coalesce({c}, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    values = ", ".join(f"('{n}', '{t}')" for n, t in TEMPLATES)
    return f"""
WITH t AS (SELECT name, {words("text")} AS w FROM (VALUES {values}) AS v(name, text)),
ts AS (SELECT DISTINCT name, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT name, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
m AS (SELECT name, count(*) AS m FROM ts GROUP BY 1),
d AS (SELECT doc_id, {words("text")} AS w FROM documents),
s AS (SELECT doc_id, i - 1 AS p, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
h AS (SELECT DISTINCT doc_id, name, m, p, g, (m + 1) // 2 AS stride, m + (m + 1) // 2 AS size FROM s JOIN ts USING (g) JOIN m USING (name)),
x AS (SELECT doc_id, name, m, g, first FROM (SELECT *, unnest(range(greatest(0, p - size + 1), p + 1)) AS first FROM h) WHERE first % stride = 0),
y AS (SELECT DISTINCT doc_id, name FROM (SELECT doc_id, name, m, first, count(DISTINCT g) AS c FROM x GROUP BY ALL) WHERE 100 * c >= 80 * m),
z AS (SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM y GROUP BY 1)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_licenses, coalesce(names, '') AS licenses FROM documents LEFT JOIN z USING (doc_id)
"""


SQL = _sql()
