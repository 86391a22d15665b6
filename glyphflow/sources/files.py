"""Usage files in, rendered documents and thresholded images out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

USAGE = "map<string,map<string,struct<characters:bigint,last_updated:string>>>"


def usage_of_json(documents: DataFrame) -> DataFrame:
    """service, month, characters, last_updated of usage documents (json); a corrupt one is empty."""
    parsed = documents.select(F.from_json("json", USAGE, {"mode": "PERMISSIVE"}).alias("u"))
    services = parsed.select(F.explode("u").alias("service", "months"))
    return services.select("service", F.explode("months").alias("month", "m")).select("service", "month", "m.characters", F.col("m.last_updated").cast("timestamp").alias("last_updated"))


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    return usage_of_json(spark.read.text(path, wholetext=True).select(F.col("value").alias("json")))


def usage_json(usage: DataFrame) -> DataFrame:
    """One usage document of the rows service, month, characters, last_updated."""
    month = F.struct("month", F.struct("characters", F.date_format("last_updated", "yyyy-MM-dd'T'HH:mm:ss").alias("last_updated")).alias("v"))
    months = usage.groupBy("service").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("month", month.getField("v").alias("v"))))).alias("months"))
    whole = F.map_from_entries(F.array_sort(F.collect_list(F.struct("service", F.to_json("months").alias("m")))))
    return months.agg(F.to_json(F.transform_values(whole, lambda _, m: F.from_json(m, "map<string,struct<characters:bigint,last_updated:string>>"))).alias("json"))


def write_texts(rendered: DataFrame, path: str, column: str = "rendered") -> None:
    """One text row for each document; Spark's commit makes the folder appear whole or not at all."""
    rendered.select(column).write.mode("overwrite").text(path, lineSep="\n\x1e")


def write_documents(rendered: DataFrame, path: str) -> None:
    """doc_id and rendered as Parquet, which keeps every character."""
    rendered.write.mode("overwrite").parquet(path)


def write_each(rendered: DataFrame, path: str) -> None:
    """A text file of its own for each document (name, rendered), in a folder of its name."""
    rendered.select("name", "rendered").repartition("name").write.mode("overwrite").partitionBy("name").text(path)


#: The grey value above which a pixel is white.
OVER = 180


def threshold(pixels: Column, over: int = OVER) -> Column:
    """Grey values to black and white."""
    return F.transform(pixels, lambda p: F.when(p > over, 255).otherwise(0))
