"""Sessions as a state machine over a stream of operations: created, worked on, answered, deleted, expired.

Sessions are dealt to buckets, and one keyed state holds a bucket's; operations wait in it until the watermark has passed
them, so they take effect in their own order whatever batches they came in.  A session expires ``ttl`` after its creation,
or when the work on it ends if that is later: nothing expires while it is worked on.  A bucket has one timer, for what
happens in it next.

Calls of the state store take far longer than operations, and a batch has a few for each bucket, however many sessions
and operations there are.  Columns of a bucket travel as arrays, and what it tells leaves in frames of ``FRAME`` rows.

Operations: create (begins a session, or begins it anew), start (404 without a session, 409 while another start is at
work, else 200), set_result (ends the work), delete, and get.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import astuple, dataclass
from itertools import batched

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: at: microseconds; status: that of a web service, 410 for an expiry; result: what the session holds afterwards.
TOLD = "session_id long, at long, seq long, kind string, status int, result string"
#: An operation while it waits: its place in the order of its bucket, then what it is.
WAITING = ["session_id", "at", "unnumbered", "seq", "kind", "result"]
#: The bucket of operations without a session's id.
NOBODY = -1
FRAME = 10_000


@dataclass
class Session:
    created: int
    busy: bool = False
    done: int = 0
    result: str | None = None

    def end(self, ttl: int) -> int | None:
        """The moment after which it is gone, if nothing happens to it any more."""
        return None if self.busy else max(self.created + ttl, self.done)


def step(session: Session | None, at: int, kind: str, result: str | None, ttl: int) -> tuple[Session | None, int, int | None]:
    """The session after an operation, the status, and when the one before had expired, if it had."""
    end = session.end(ttl) if session else None
    expired = end if end is not None and at - session.created > ttl else None
    if expired is not None:
        session = None
    if kind == "create":
        return Session(at), 200, expired
    if session is None:
        return None, 404, expired
    if kind == "delete":
        return None, 200, expired
    if kind == "start":
        if session.busy:
            return session, 409, expired
        session.busy = True
    elif kind == "set_result":
        session.busy, session.done, session.result = False, at, result
    return session, 200, expired


class Sessions(StatefulProcessor):
    """Rows of TOLD for operations (bucket, WAITING), at in microseconds."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getValueState("live", "session_id array<long>, created array<long>, busy array<boolean>, done array<long>, result array<string>")
        self.waiting = handle.getListState("waiting", "session_id array<long>, at array<long>, unnumbered array<boolean>, seq array<long>, kind array<string>, result array<string>")
        self.next = handle.getValueState("next", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            self.waiting.appendValue(tuple(_values(part[c]) for c in WAITING))
            at = int(part["at"].min())
            first = at if first is None else min(first, at)
        before = self.next.get()[0] if self.next.exists() else None
        if before is None or first // 1000 + 1 < before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = [x for part in self.waiting.get() for x in zip(*part, strict=True)] if self.waiting.exists() else []
        live = {i: Session(*of) for i, *of in zip(*self.live.get(), strict=True)} if self.live.exists() else {}
        due, told = sorted((x for x in held if x[1] <= passed), key=_order), []
        for i, at, unnumbered, seq, kind, result in due:
            session, status, expired = step(live.get(i), at, kind, result, self.ttl)
            if expired is not None:
                told.append((i, expired, -1, "expire", 410, None))
            told.append((i, at, None if unnumbered else seq, kind, status, session.result if session else None))
            if session is None:
                live.pop(i, None)
            else:
                live[i] = session
        ends = {i: end for i, session in live.items() if (end := session.end(self.ttl)) is not None}
        for i, end in ends.items():
            if end < passed:
                told.append((i, end, -1, "expire", 410, None))
                del live[i]
        left = [x for x in held if x[1] > passed]
        if due:
            self.waiting.put([tuple(map(list, zip(*some, strict=True))) for some in batched(left, FRAME)]) if left else self.waiting.clear()
        if live:
            self.live.update(tuple(map(list, zip(*((i, *astuple(session)) for i, session in live.items()), strict=True))))
        else:
            self.live.clear()
        self.wake(min([x[1] for x in left] + [end for i, end in ends.items() if i in live], default=None))
        for some in batched(told, FRAME):
            frame = pd.DataFrame(some, columns=["session_id", "at", "seq", "kind", "status", "result"], dtype=object)
            yield frame.assign(session_id=None) if key[0] == NOBODY else frame

    def wake(self, at: int | None) -> None:
        """Sets the bucket's timer, of which there is none now."""
        if at is None:
            self.next.clear()
        else:
            self.handle.registerTimer(at // 1000 + 1)
            self.next.update((at // 1000 + 1,))

    def close(self) -> None:
        pass


def _values(column: pd.Series) -> list:
    return [None if x is None or x != x else x for x in column.tolist()]


def _order(x: tuple) -> tuple:
    return *x[:4], x[4] or "", x[5] or ""


def session_states(operations: DataFrame, ttl: int = 1800, late: str = "1 hour", buckets: int = 4096) -> DataFrame:
    """What operations (session_id, ts, seq, kind, result), a stream, did to their sessions, in seconds of ttl.

    A row for each operation and each expiry, once the watermark has passed it; ``late`` is how much earlier than
    others a row may be and still count.  The watermark ends with 2261, as the times that pandas knows end soon after;
    operations that are not numbered come after others of their moment.  A task holds one of the ``buckets`` at a time,
    whose number stays the same as long as the stream's state is kept.
    """
    number = lambda name: F.coalesce(F.col(name).cast("long"), F.lit(0)).alias(name)
    ts = F.col("ts").cast("timestamp")
    bucket = F.when(F.col("session_id").isNull(), NOBODY).otherwise(F.pmod(F.xxhash64(F.col("session_id").cast("long")), F.lit(buckets)))
    seen = F.least(ts, F.lit("2262-01-01 00:00:00").cast("timestamp")).alias("seen")
    of = operations.where(ts.isNotNull()).select(bucket.cast("int").alias("bucket"), seen, number("session_id"), F.unix_micros(ts).alias("at"), F.col("seq").isNull().alias("unnumbered"), number("seq"), "kind", "result")
    return of.withWatermark("seen", late).groupBy("bucket").transformWithStateInPandas(Sessions(ttl * 1_000_000), TOLD, "append", "eventTime")


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The state store that such processors need, for streams started inside."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
