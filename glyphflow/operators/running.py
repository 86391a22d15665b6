"""Sums over all rows that come before, in an order, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir


def running_sums(rows: DataFrame, groups: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """rows with the sum, by new name in ``sums``, of a column over the rows of their group before them.

    order must tell the rows of a group apart.  Rows are range-partitioned by group and order, so a large group is in
    many ranges; sums of ranges give what comes before a range, a window inside each range gives the rest.  Pass
    light rows: they are written once, as ranges are drawn from a sample and must stay as they are.  Null values
    count as 0, null groups are a group, nulls in the order come first.
    """
    spark = rows.sparkSession
    shared_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *groups, *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    keys = [F.col(c) for c in groups]
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    of_ranges = ranged.groupBy("_range", *groups).agg(*[F.sum(c).alias(new) for new, c in sums.items()])
    starts = of_ranges.select(F.col("_range").alias("_of"), *[c.alias(f"_g{i}") for i, c in enumerate(keys)], *[F.coalesce(F.sum(new).over(before), F.lit(0)).alias(f"_{new}") for new in sums])
    inside = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumns({new: F.coalesce(F.sum(c).over(inside), F.lit(0)) for new, c in sums.items()})
    same = F.col("_range") == F.col("_of")
    for i, c in enumerate(keys):
        same &= c.eqNullSafe(F.col(f"_g{i}"))
    joined = summed.join(starts, same)
    return joined.select(*rows.columns, *[(F.col(new) + F.col(f"_{new}")).alias(new) for new in sums])
