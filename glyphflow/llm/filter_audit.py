"""How filters interact: what each removes in every order of application, in DataFrame operations only.

1.  Every document gets a mask with a bit for each filter that it fails.  Copies are found by the SHA-256 of whole
    texts: groups are counted map-side first, and only groups of two or more meet the documents again, in a join of
    two written tables whose hot keys Spark splits.
2.  Documents are counted by part and mask: at most 2**filters cells a part, however many documents it has.
3.  Cells are unpivoted against the steps of all orders.  In each cell and order a running bit-or over the steps
    before says whether an earlier filter removed it; conditional sums give the counts of a step, and a window over
    all orders of one filter gives its Shapley total.  All of it is clustered by part once.

Defined cases: null and empty texts have no words (A fails, B, C and D do not) and are copies of each other; null
and empty sources are one part, the empty string; a null doc_id is no copy of another and no document is a copy of
it, and it has no labels; rows of one id are documents of their own, none a copy of the other; labels repeated for one
id count if any row has them; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import read
from .workspace import Workspace, partitions

GAP = r"[\x20\x09-\x0D]+"
#: Fewest words, least percent of distinct words, most percent of capitals, and characters that must not occur.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, MARKS = 50, 65, 5, r"[#$%&*|]"
#: The filter that compares texts with each other; the rest look at one text.
COPIES = "E"


def conditions(text: Column) -> dict[str, Column]:
    """What makes a text fail, by the filter's letter; text must not be null."""
    words = F.array_remove(F.split(text, GAP), "")
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": F.size(F.array_distinct(words)) * F.lit(100) < F.size(words) * F.lit(MIN_DISTINCT),
        "C": F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") * 100 > F.length(text).cast("long") * MAX_CAPITALS,
        "D": F.regexp_like(text, F.lit(MARKS)),
    }


def masks(ws: Workspace, docs: DataFrame, letters: str) -> DataFrame:
    """doc_id, part, mask: bit i is set where the document fails filter i of ``letters``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.lit(0)
    failed = conditions(text)
    for letter in letters:
        if letter != COPIES:
            own = own + F.when(failed[letter], 1 << letters.index(letter)).otherwise(0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), own.alias("own"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    if COPIES not in letters:
        return rows.select("doc_id", "part", F.col("own").alias("mask"))
    rows = ws.keep(rows, "rows")
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("smallest"), F.max("doc_id").alias("largest")).where("largest > smallest")
    copies = ws.keep(groups.select("digest", "smallest"), "copies")
    copy = F.when(F.col("doc_id") > F.col("smallest"), 1 << letters.index(COPIES)).otherwise(0)
    return rows.join(copies, "digest", "left").select("doc_id", "part", (F.col("own") + copy).alias("mask"))


def cells(ws: Workspace, docs: DataFrame, labels: DataFrame, letters: str) -> DataFrame:
    """part, mask, n, n_good, n_toxic."""
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("bad"))
    marked = ws.keep(marked.where("good = 1 or bad = 1"), "labels")
    found = masks(ws, docs, letters).join(marked, "doc_id", "left")
    return found.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("n_good"), F.coalesce(F.sum("bad"), F.lit(0)).alias("n_toxic"))


def audit(docs: DataFrame, labels: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """A row for each part, order of the filters and step: what the step keeps and removes, alone and with others.

    part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley
    """
    with Workspace(docs.sparkSession, "audit") as ws:
        counted = cells(ws, docs, labels, letters).repartition(partitions(ws.spark), "part")
        orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
        long = counted.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
        letter = F.substring("filter_order", F.col("step"), F.lit(1))
        long = long.withColumn("letter", letter)
        bit = F.element_at(F.create_map(*[x for i, c in enumerate(letters) for x in (F.lit(c), F.lit(1 << i))]), F.col("letter"))
        long = long.withColumn("bit", bit).withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
        before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
        long = long.withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))
        here, gone = (F.col("fails") > 0) & (F.col("earlier") == 0), F.col("earlier") > 0

        def total(of: str, where: Column) -> Column:
            return F.sum(F.when(where, F.col(of)).otherwise(0)).cast("long")

        steps = long.groupBy("part", "filter_order", "step", "letter").agg(
            total("n", (F.col("fails") == 0) & ~gone).alias("kept"),
            total("n", here).alias("removed"),
            total("n", (F.col("fails") > 0) & gone).alias("redundant"),
            total("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
            total("n_good", here).alias("good_lost"),
            total("n_toxic", here).alias("toxic_lost"),
        )
        shapley = F.sum("removed").over(Window.partitionBy("part", "letter"))
        return ws.result(steps.withColumn("shapley", shapley.cast("long")).drop("letter"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad, {
    'A': len(words) < 50,
    'B': 100 * len(list_distinct(words)) < 65 * len(words),
    'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'),
    'E': coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)} AS x
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (
  SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda k: CASE k WHEN 'A' THEN x.A WHEN 'B' THEN x.B WHEN 'C' THEN x.C WHEN 'D' THEN x.D ELSE x.E END) AS failed,
    count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (bad) AS n_bad
  FROM f GROUP BY ALL),
k(k) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM k a, k b, k c, k d, k e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS k FROM o, range(1, 6) AS r(step)),
t AS (
  SELECT part, filter_order, step, k, failed, n, n_good, n_bad, list_contains(failed, k) AS fails,
    len(list_filter(failed, lambda z: instr(filter_order, z) < step)) > 0 AS gone
  FROM c, s),
r AS (
  SELECT part, filter_order, step, k,
    CAST(coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (fails AND gone), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (failed = [k]), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n_good) FILTER (fails AND NOT gone), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(n_bad) FILTER (fails AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM t GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley
FROM r
"""
