"""Mixing sources to target weights, in DataFrame operations only.

1.  Every row gets its size in words and a hash-random key, the MD5 of seed and doc_id.
2.  Targets: weighted shares of the mix, none above its source's cap; the excess is shared again by weight.
    This has a closed form over sources in order of cap / weight, so it needs no loop.
3.  The key's first three hex digits cut each source into 4096 key ranges.  Range totals give the words
    before each range, a window inside a range gives the rest: prefix sums without a task per source.
4.  A source's budget is its target in whole words.  Whole epochs come first; what remains is cut off the
    random order exactly, the row at the cut being taken in part.

Defined cases: null text has size 0; null source is a source, ranked last; a row without a doc_id has its
key from its text; rows tied in key, id and size follow their row, where one is given, else they are interchangeable; sources without words have target 0;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import read
from .workspace import Workspace

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Share of all words in the mix, and how often a source may be repeated.
SHARE, EPOCHS = 1.5, 2
SEED = "mix-1"
#: Hex digits of the key that name its range: 16**3 ranges for each source.
DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """sizes (source, source_size), a row for each source: adds number (rank by code point) and target."""
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "number")
    ranked = sizes.withColumn("number", F.row_number().over(by_name))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("number") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumns({"weight": weight.cast("long"), "cap": F.col("source_size") * epochs})
    ranked = ranked.withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn(
        "level",
        (F.sum("source_size").over(everything).cast("double") * share - F.coalesce(F.sum("cap").over(before), F.lit(0)).cast("double"))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double"),
    )
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "number", "level"))).over(everything)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight").cast("double"))
    return ranked.select("source", "source_size", "number", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, row: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted) for each row.

    row: a column of docs that tells its rows apart; the result carries it, and it settles ties.
    """
    carried = [row] if row else []
    with Workspace(docs.sparkSession, "mix") as ws:
        nameless = F.concat(F.lit("null:"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
        key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), nameless)).cast("binary"))
        rows = ws.keep(docs.select("doc_id", *carried, F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), key.alias("key")), "rows")
        sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
        sources = ws.keep(sources, "sources")
        ranged = rows.withColumn("range", F.substring("key", 1, DIGITS))
        earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        starts = ranged.groupBy("source", "range").agg(F.sum("size").alias("words")).select("source", "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
        starts = starts.join(sources, starts["source"].eqNullSafe(sources["source"])).select(starts["source"], "range", "start", "source_size", "target")
        inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", *carried).rowsBetween(Window.unboundedPreceding, -1)
        placed = ranged.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        placed = placed.join(starts, placed["source"].eqNullSafe(starts["source"]) & (placed["range"] == starts["range"])).drop(starts["source"], starts["range"])
        budget = F.floor("target").cast("long")
        whole = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0)
        rest = budget - whole * F.col("source_size") - F.col("start") - F.col("inside")
        taken = F.col("size") * whole + F.greatest(F.lit(0), F.least(F.col("size"), rest))
        return ws.result(placed.select("doc_id", *carried, "size", "source_size", "target", taken.cast("long").alias("taken")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))) AS key
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS number FROM d GROUP BY source),
w AS (SELECT *, CASE (number - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, source_size * 2 AS cap FROM s),
l AS (
  SELECT *, CAST(cap AS DOUBLE) / weight AS ratio,
    (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM w),
t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce((SELECT level FROM l WHERE level <= ratio ORDER BY ratio, number LIMIT 1), 0.0::DOUBLE) * CAST(weight AS DOUBLE)) AS target FROM l),
p AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
    CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size > 0 THEN CAST(size * (budget // source_size) + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) AS BIGINT) ELSE 0 END AS taken
FROM p
"""
