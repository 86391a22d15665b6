"""Sessions, and what Python workers need to find this package."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver does; on a cluster, ship it with py-files."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def local(name: str = "glyphflow", cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the operators assume: UTC, adaptive plans, few partitions."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name).config("spark.driver.memory", memory)
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return prepare(builder.config(map=settings).getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one of our own only where a local master has none."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    named = sc.getConf().get("spark.checkpoint.dir") or (current.get() if current.isDefined() else None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    named = named or tempfile.mkdtemp(prefix="glyphflow-")
    if current.isEmpty():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder below the shared one, removed at the end."""
    path = f"{shared_dir(spark)}/glyphflow-{name}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
