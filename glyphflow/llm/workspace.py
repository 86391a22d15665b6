"""Where an operator keeps what more than one of its jobs reads.

Everything goes to the folder named by ``spark.checkpoint.dir``, which all executors share; a folder of
our own is chosen only where that setting is missing on a local master (tests, notebooks); elsewhere its
absence is an error, since executors would write to their own disks.  Intermediate tables are Parquet
files written and read by Spark, so any store Spark can write to will do, and a lost executor loses nothing.
The result of an operator is a reliable checkpoint: Spark's cleaner removes it once no plan refers to it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare


def checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="glyphflow-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


class Workspace:
    """A folder of intermediate tables, removed on leaving the ``with`` block.

    Inside the block Arrow batches hold at most ``batch_rows`` rows, so that a Python worker never holds
    more than a few megabytes of text at a time; the session's own setting is put back afterwards.
    """

    def __init__(self, spark: SparkSession, name: str, batch_rows: int = 512) -> None:
        self.spark = prepare(spark)
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/glyphflow-{name}-{uuid.uuid4().hex}"
        self.settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch_rows)}
        self.before: dict[str, str | None] = {}

    def __enter__(self) -> Workspace:
        for key, value in self.settings.items():
            self.before[key] = self.spark.conf.get(key, None)
            self.spark.conf.set(key, value)
        return self

    def __exit__(self, *exc) -> None:
        for key, value in self.before.items():
            if value is None:
                self.spark.conf.unset(key)
            else:
                self.spark.conf.set(key, value)
        self.remove()

    def remove(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes a table and returns it as read from its files."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame) -> DataFrame:
        """Cuts the lineage, so that the intermediate tables can go."""
        return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    """How many owner tasks an exchange of packed records gets: the session's shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of input that one owner task should answer for, the most owners there are, and a size that is no estimate any more.
OWNER_BYTES, MOST_OWNERS, UNKNOWN = 128 << 20, 1 << 14, 1 << 50


def owners_of(docs: DataFrame) -> int:
    """Owner tasks by the size that the optimizer knows of the input, no fewer than the session's partitions."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(partitions(docs.sparkSession), min(MOST_OWNERS, size // OWNER_BYTES) if size < UNKNOWN else 0)


def numbered(ws: Workspace, docs: DataFrame, key: str, content: str, row: str, name: str = "numbered") -> tuple[DataFrame, bool]:
    """docs with a column ``row``, unique and in the order of the keys; and whether it is the key itself.

    It is where no key is null or repeated.  Otherwise rows are numbered by key (nulls last), then by a hash of the
    content, and written once, so that every later job sees the same numbers.
    """
    if docs.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).where((F.col("n_rows") > 1) | F.col(key).isNull()).isEmpty():
        return docs.withColumn(row, F.col(key).cast("long")), True
    met = f"{row}_met"
    order = docs.withColumn(met, F.monotonically_increasing_id()).orderBy(F.col(key).asc_nulls_last(), F.xxhash64(content), met)
    return ws.keep(order.drop(met).withColumn(row, F.monotonically_increasing_id()), name), False


def keyed(ws: Workspace, docs: DataFrame, key: str, content: str) -> tuple[DataFrame, bool]:
    """(row, key, content) of every row of docs, numbered."""
    rows, own = numbered(ws, docs.select(F.col(key).cast("long").alias(key), content), key, content, "row")
    return rows.select("row", key, content), own


def renamed(found: DataFrame, rows: DataFrame, own: bool, key: str, *columns: str) -> DataFrame:
    """found with rows in ``columns`` replaced by their keys, which join by unique numbers."""
    if own:
        return found
    for i, c in enumerate(columns):
        names = rows.select(F.col("row").alias(f"row_{i}"), F.col(key).alias(f"key_{i}"))
        found = found.join(names, F.col(c) == F.col(f"row_{i}"), "left").select(*[F.col(f"key_{i}").alias(c) if x == c else F.col(x) for x in found.columns])
    return found
