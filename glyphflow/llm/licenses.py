"""License scans by diagonal voting, in DataFrame operations only.

Texts are split into words once.  Every rolling pair of words whose words stand in some template is hashed and
joined with the pairs of the license templates, whole licenses among them.  A template that stands in the text
at word d gives votes on the diagonal d = word position - template position; votes are counted by row,
template and diagonal.  A diagonal that has all the template's pairs is a place of it, exactly: a pair joins
only where both words are equal, not their hash alone.  Diagonals of few votes for a long template are chance;
neighbouring ones of the others (words put in, left out or changed) are merged, and a merged span counts if it
covers enough of the template within a length that fits.  Long documents and common pairs stay rows; nothing is
gathered in one task.

Defined cases: null text counts as empty, and a text without words has none of anything, empty label lists and
score 0; rows that repeat an id or have none are rows of their own; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import read
from .workspace import Workspace

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: (label, phrase) of the base, and of the method.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
OWN = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    # Whole notices, as words; fixed by their licenses.
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the "
        "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages "
        "or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source "
        "code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright "
        "notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http "
        "www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "gpl-3.0",
        "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version "
        "3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied "
        "warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ),
    # Their openings, which often stand alone.
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
)
#: Diagonals this near are merged; a span must cover this share of the template's pairs, within this many times its length.
NEAR, COVER, STRETCH = 2, 0.75, 1.5
#: Templates of more pairs than LONG need this many votes on a diagonal, by chance rarely met.
LONG, VOTES = 20, 3


def template_rows(base: tuple = BASE, own: tuple = OWN) -> list[tuple[int, str, bool, int, int, str, str]]:
    """(template, label, base, pairs, position, word, next word) for every pair of every template."""
    out = []
    for t, (label, phrase, is_base) in enumerate([(*b, True) for b in base] + [(*o, False) for o in own]):
        ws = phrase.split()
        out += [(t, label, is_base, len(ws) - 1, i, a, b) for i, (a, b) in enumerate(zip(ws, ws[1:]))]
    return out


def _values(rows: list[tuple]) -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else str(v).lower()
    return "VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


NAMES = "template, label, base, pairs, tpos, a, b"


def lower_ascii(text: Column) -> Column:
    """Lower case in which no letter but A-Z becomes one of a-z: the Kelvin sign is put out of the way first."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0137")))


def word_array(text: Column) -> Column:
    """The words of a text; gaps become single spaces first, since splitting at one character is fast."""
    spaced = F.trim(F.regexp_replace(lower_ascii(text), GAP, " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def scan_licenses(docs: DataFrame, base: tuple = BASE, own: tuple = OWN) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    with Workspace(spark, "licenses") as ws:
        table = template_rows(base, own)
        words = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), word_array(F.col("text").cast("string")).alias("w"))
        pair = lambda a, b: F.when(a.isin(sorted({r[5] for r in table})) & b.isin(sorted({r[6] for r in table})), F.struct(a.alias("x"), b.alias("y")))
        all_but = lambda first: F.slice("w", first, F.greatest(F.size("w") - 1, F.lit(0)))
        placed = F.transform(F.zip_with(all_but(1), all_but(2), pair), lambda p, i: F.struct(i.alias("pos"), p["x"].alias("x"), p["y"].alias("y")))
        # Words are counted and pairs kept in one pass; rows are numbered in this table for good.
        grams = ws.keep(words.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.filter(placed, lambda p: p["x"].isNotNull()).alias("grams")), "grams")
        templates = spark.sql(f"SELECT *, xxhash64(a, b) AS h FROM ({_values(table)}) AS t({NAMES})")
        pairs = grams.select("row", F.explode("grams").alias("p"))
        hashed = pairs.select("row", F.col("p.pos").alias("pos"), F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.xxhash64("p.x", "p.y").alias("h"))
        # The templates: a fixed table of some hundred rows.
        met = hashed.join(F.broadcast(templates), "h").where((F.col("x") == F.col("a")) & (F.col("y") == F.col("b")))
        # One vote for each position of the text and of the template, so each diagonal counts a pair once.
        diagonals = met.groupBy("row", "template", "label", "base", "pairs", (F.col("pos") - F.col("tpos")).alias("d")).agg(
            F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_list("tpos").alias("covered")
        )
        diagonals = diagonals.where((F.col("pairs") <= LONG) | (F.col("n") >= VOTES))
        by_diagonal = Window.partitionBy("row", "template").orderBy("d")
        run = F.sum(F.when(F.col("d") - F.lag("d").over(by_diagonal) <= NEAR, 0).otherwise(1)).over(by_diagonal)
        merged = diagonals.withColumn("run", run).groupBy("row", "template", "label", "base", "pairs", "run").agg(
            F.max("n").alias("straight"),
            F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("together"),
            (F.max("last") - F.min("first") + 2).alias("span"),
            F.sum(F.when(F.col("n") == F.col("pairs"), 1).otherwise(0)).alias("places"),
            F.min(F.when(F.col("n") == F.col("pairs"), F.col("d"))).alias("first_place"),
            F.max(F.when(F.col("n") == F.col("pairs"), F.col("d"))).alias("last_place"),
        )
        fits = F.col("span") <= (F.col("pairs") + 1) * STRETCH
        share = F.greatest("straight", F.when(fits, F.col("together").cast("long")).otherwise(0)).cast("double") / F.col("pairs")
        is_base = F.col("base") & (F.col("places") > 0)
        labelled = merged.withColumn("share", share).groupBy("row").agg(
            F.sum(F.when(is_base, F.col("places"))).alias("n_base"),
            F.min(F.when(is_base, F.col("first_place"))).alias("first_word"),
            F.max(F.when(is_base, F.col("last_place"))).alias("last_word"),
            F.collect_set(F.when(is_base, F.col("label"))).alias("base_labels"),
            F.collect_set(F.when(is_base | (~F.col("base") & (F.col("share") >= COVER)), F.col("label"))).alias("labels"),
            F.max("share").alias("score"),
        )
        joined = lambda c: F.coalesce(F.array_join(F.sort_array(c), ","), F.lit("")).alias(c)
        found = grams.select("row", "doc_id", "n_words").join(labelled, "row", "left").select(
            "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long"), F.col("last_word").cast("long"),
            joined("base_labels"), joined("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
        )
        return ws.result(found)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


#: The base labels by looking for the phrases themselves; the method's own labels by its definition.
ORACLE = rf"""
WITH t AS (SELECT * FROM ({_values(template_rows())}) AS v({NAMES})),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
b AS (
  SELECT r, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(p)] = p)) AS place
  FROM d, (SELECT label, string_split(phrase, ' ') AS p FROM (VALUES {", ".join(f"('{x}', '{y}')" for x, y in BASE)}) AS v(label, phrase))),
f AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word FROM b GROUP BY r),
g AS (SELECT r, unnest(w[:-2]) AS x, unnest(w[2:]) AS y, unnest(range(len(w) - 1)) AS pos FROM d WHERE len(w) > 1),
q AS (SELECT r, template, label, base, pairs, pos - tpos AS d, count(*) AS n, min(pos) AS first, max(pos) AS last, list(tpos) AS covered FROM g JOIN t ON x = a AND y = b GROUP BY ALL HAVING pairs <= {LONG} OR count(*) >= {VOTES}),
s AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY r, template ORDER BY d) <= {NEAR} THEN 0 ELSE 1 END AS fresh FROM q),
m AS (
  SELECT r, template, label, base, pairs, run, max(n) AS straight, len(list_distinct(flatten(list(covered)))) AS together, max(last) - min(first) + 2 AS span
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY r, template ORDER BY d) AS run FROM s) GROUP BY ALL),
h AS (SELECT *, CAST(greatest(straight, CASE WHEN span <= (pairs + 1) * {STRETCH} THEN together ELSE 0 END) AS DOUBLE) / pairs AS share FROM m),
z AS (SELECT r, max(share) AS score FROM h GROUP BY r),
l AS (SELECT r, string_agg(label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT DISTINCT r, label, true AS base FROM b UNION ALL SELECT DISTINCT r, label, false FROM h WHERE NOT base AND share >= {COVER}) GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN f ON d.r = f.r LEFT JOIN z ON d.r = z.r LEFT JOIN l ON d.r = l.r
"""
