"""Parquet tables, dealt out where a few small files would leave most cores idle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes for each core, and in all, below which a table of few splits is dealt out.
SMALL, MOST = 64 << 20, 8 << 30
#: Bytes of a table from which dealing it out pays.
LEAST = 1 << 20


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """A file of one row group is one task, however many cores there are.  Small tables of fewer files and splits than
    half the cores are dealt out by rows; others have splits enough, or are too large to be worth a shuffle."""
    spark = df.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, df.inputFiles()
    if not 0 < len(files) < cores or (len(files) > 1 and 2 * df.rdd.getNumPartitions() >= cores):
        return df
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    size = 0
    for f in files:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI.create(f))
        size += path.getFileSystem(conf).getFileStatus(path).getLen()
    return df.repartition(cores) if LEAST < size < min(MOST, cores * SMALL) else df
