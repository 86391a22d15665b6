"""Streams of uses: sums by window with late data, sessions by inactivity, and progress to a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, glob: str = "events.parquet", files_a_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def usage_by_window(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """service, start, characters, uses: sums of each window; rows later than ``late`` are left out."""
    uses = events.select(F.col("event_type").alias("service"), F.round(F.coalesce("value", F.lit(0.0)) * 100).cast("long").alias("characters"), "ts")
    summed = uses.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "service").agg(F.sum("characters").alias("characters"), F.count(F.lit(1)).alias("uses"))
    return summed.select("service", F.col("w.start").alias("start"), "characters", "uses")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, end, events: runs of a user's events with less than ``gap`` between them; they expire after it."""
    met = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return met.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Writes what there is and ends.  In complete mode each batch replaces the table, so a repeated batch does no harm."""
    if mode == "complete":
        return stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).trigger(availableNow=True).start()
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_rows(query: StreamingQuery) -> list[dict]:
    """Percent-free progress of a query: batch, rows in, rows a second."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "rate": p.get("processedRowsPerSecond")} for p in query.recentProgress]


def progress_events(total: int, report: Callable[[dict], None]) -> Callable[[int], None]:
    """Reports 40 to 80 percent while blocks are done, as the translation step does."""

    def done(n: int) -> None:
        report({"status": "translating", "percent": 40 + 40 * n // max(total, 1), "step": "translate", "message": f"{n}/{total}"})

    return done
