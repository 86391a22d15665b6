"""Characters used by service and month, limits, and sessions that expire."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .running import running_sums
from .translate import FREE_TIER

#: Seconds after which an idle session goes.
SESSION_TTL = 1800


def monthly_usage(events: DataFrame) -> DataFrame:
    """service, month, characters, last_updated."""
    return events.groupBy("service", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.sum("characters").alias("characters"), F.max("ts").alias("last_updated"))


def current_usage(events: DataFrame) -> DataFrame:
    """The latest month of each service: a new month begins at nothing."""
    latest = Window.partitionBy("service")
    return monthly_usage(events).withColumn("latest", F.max("month").over(latest)).where("month = latest").drop("latest")


def limit_report(usage: DataFrame, limit: int = FREE_TIER) -> DataFrame:
    """Adds percent_used and remaining."""
    return usage.withColumns({"percent_used": F.col("characters") / F.lit(float(limit)) * 100.0, "remaining": F.greatest(F.lit(0), F.lit(limit) - F.col("characters")).cast("long")})


def check_limit(requests: DataFrame, usage: DataFrame, limit: int = FREE_TIER) -> DataFrame:
    """Adds used and exceeds to requests (service, month, n); the limit itself may be reached."""
    used = requests.join(usage.select("service", "month", F.col("characters").alias("used")), ["service", "month"], "left").withColumn("used", F.coalesce("used", F.lit(0)).cast("long"))
    return used.withColumn("exceeds", F.col("used") + F.col("n") > limit)


def budget_cut(requests: DataFrame, used: DataFrame, limit: int = FREE_TIER) -> DataFrame:
    """Adds before (characters of the month when its turn comes) and allowed to requests (service, month, at, id, n).

    In the order of at and id, requests are allowed as long as the month's characters with theirs stay within the
    limit; the first that does not fit ends the month.  used: service, month, characters so far.  A null or negative n
    counts as 0.
    """
    sized = requests.withColumn("n", F.greatest(F.coalesce("n", F.lit(0)), F.lit(0)).cast("long"))
    summed = running_sums(sized, ["service", "month"], ["at", "id"], {"earlier": "n"})
    known = used.select(F.col("service").alias("_service"), F.col("month").alias("_month"), F.col("characters").alias("_used"))
    same = F.col("service").eqNullSafe(F.col("_service")) & F.col("month").eqNullSafe(F.col("_month"))
    before = F.col("earlier") + F.coalesce("_used", F.lit(0))
    placed = summed.join(known, same, "left").withColumn("before", before.cast("long"))
    return placed.withColumn("allowed", F.col("before") + F.col("n") <= limit).drop("earlier", "_service", "_month", "_used")


def expired_sessions(sessions: DataFrame, now: str, ttl: int = SESSION_TTL) -> DataFrame:
    """Sessions (session_id, created_at, processing) older than ttl at ``now`` that nothing works on."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("created_at")
    return sessions.where((age > ttl) & ~F.col("processing"))


def valid_uploads(files: DataFrame, most: int = 50_000_000) -> DataFrame:
    """Adds status to files (name, length): 200, 400 for no PDF or an empty one, 413 for too large a one."""
    pdf = F.lower("name").endswith(".pdf")
    return files.withColumn("status", F.when(~pdf | (F.col("length") == 0), 400).when(F.col("length") > most, 413).otherwise(200))
