"""Sessions as the last state of their events, which requests may start, and what their progress says."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def store(operations: DataFrame) -> DataFrame:
    """session_id, created_at, result of the sessions that are there after all operations.

    operations: session_id, at, kind (create, set_result, delete), result.  A session begins with its last create,
    holds the last result set since, and is gone if it was deleted since.  Each is an aggregate that combines
    before the shuffle; at must tell the operations of a session apart.
    """
    last = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("at")))
    of = operations.groupBy("session_id").agg(
        last("create").alias("created_at"), last("delete").alias("deleted_at"), F.max(F.when(F.col("kind") == "set_result", F.struct("at", "result"))).alias("set")
    )
    there = of.where("created_at IS NOT NULL AND (deleted_at IS NULL OR deleted_at < created_at)")
    return there.select("session_id", "created_at", F.when(F.col("set.at") > F.col("created_at"), F.col("set.result")).alias("result"))


def look_up(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Adds status to requests (session_id): 200, or 404 where there is no such session."""
    found = sessions.select("session_id", F.lit(200).alias("status"))
    return requests.join(found, "session_id", "left").withColumn("status", F.coalesce("status", F.lit(404)))


def single_flight(requests: DataFrame) -> DataFrame:
    """Adds status to requests (session_id, at, kind: start or finish): 409 for a start while another one runs.

    A refused start changes nothing, so a session is busy after any start and free after any finish.
    """
    before = F.lag("kind").over(Window.partitionBy("session_id").orderBy("at"))
    return requests.withColumn("status", F.when((F.col("kind") == "start") & F.coalesce(before == "start", F.lit(False)), 409).otherwise(200))


def progress(done: DataFrame) -> DataFrame:
    """doc_id, n, percent, frame: what is reported when the n-th of a document's blocks is done, as an event stream has it.

    done: doc_id, n (from 1), total.
    """
    percent = F.lit(40) + F.floor(F.lit(40) * F.col("n") / F.greatest(F.col("total"), F.lit(1))).cast("int")
    told = done.withColumn("percent", percent)
    body = F.to_json(F.struct(F.lit("translating").alias("status"), F.col("percent"), F.lit("translate").alias("step"), F.concat_ws("/", F.col("n").cast("string"), F.col("total").cast("string")).alias("message")))
    return told.select("doc_id", "n", "percent", F.concat(F.lit("data: "), body, F.lit("\n\n")).alias("frame"))
