"""Translation as a pluggable edge: chunks out, translated chunks back.

Equal chunks are translated once: distinct chunks by content hash, joined back.  The mock backend is a column
expression; network backends are Arrow functions over chunks with bounded concurrency in each partition.
"""

from __future__ import annotations

import math
import random
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shaping import CHUNK, chunks, slices
from ..functions.text import is_blank
from .running import running_sums

# The mock's prefix, and the free characters of a month.
MOCK_PREFIX = "[TRANSLATED] "
FREE_TIER = 500_000


class TranslationError(Exception):
    """A chunk could not be translated; its source text is kept."""


class UsageLimitExceeded(TranslationError):
    """The month's characters would pass the limit."""


@dataclass
class Backend:
    """Translates one text at a time; call may raise TranslationError.

    pace: delays of each task; rate: requests a second of the whole job, retries included.
    """

    name: str
    call: Callable[[str, str, str], str]
    concurrency: int = 3
    pace: Pace | None = None
    rate: float | None = None
    retries: int = 3
    backoff: float = 0.0
    sleep: Callable[[float], None] = field(default=time.sleep, repr=False)


#: Factor of the delay from this request on: longer after five, and again after ten.
STEPS = ((1, 1.0), (6, 1.5), (11, 2.25))
#: Least and most share of the delay that chance leaves.
JITTER = (0.5, 2.0)


@dataclass
class Pace:
    """Delays between requests, for those of one sender."""

    base: float = 2.0
    sent: int = 0
    sleep: Callable[[float], None] = field(default=time.sleep, repr=False)

    def delay(self) -> float:
        self.sent += 1
        factor = max(f for n, f in STEPS if self.sent >= n)
        return self.base * random.uniform(*JITTER) * factor

    def wait(self) -> None:
        self.sleep(self.delay())


@dataclass
class Slots:
    """Moments at which one of several lanes may send, so that all together keep ``rate`` requests a second.

    Time is cut into slots of 1 / rate seconds and slot s belongs to lane s modulo lanes, so no slot has two
    requests, whichever lanes run and whenever they began.
    """

    rate: float
    lane: int
    lanes: int
    sleep: Callable[[float], None] = field(default=time.sleep, repr=False)
    clock: Callable[[], float] = field(default=time.time, repr=False)
    last: int = -1

    def take(self, turn: threading.Lock) -> float:
        """Waits for the lane's next free slot; the moment it begins.  Threads take slots in turn and wait together."""
        with turn:
            now = max(math.ceil(self.clock() * self.rate), self.last + 1)
            slot = self.last = now + (self.lane - now) % self.lanes
        while (left := slot / self.rate - self.clock()) > 0:
            self.sleep(left)
        return slot / self.rate


#: Seconds that a program may take, and the most after growing from attempt to attempt.
FIRST_TIMEOUT, GROWTH, LAST_TIMEOUT = 60.0, 1.5, 180.0


def timeout_of(attempt: int) -> float:
    """Seconds for an attempt, counted from 0."""
    return min(LAST_TIMEOUT, FIRST_TIMEOUT * GROWTH**attempt)


def _factor(n: Column) -> Column:
    return F.greatest(*[F.when(n >= first, f) for first, f in STEPS])


def send_times(requests: DataFrame, order: list[str], groups: list[str], base: float = 2.0) -> DataFrame:
    """Adds n (from 1) and at_us: microseconds after the first request of its group at which each one is sent.

    order tells the requests of a group apart.  Delays are those of Pace; chance is the hash of a request's place in
    the order, so that reruns agree.  Numbers and times are sums over all requests before, however many tasks hold
    them.
    """
    numbered = running_sums(requests.withColumn("one", F.lit(1)), groups, order, {"earlier": "one"}).withColumn("n", (F.col("earlier") + 1).cast("long")).drop("one", "earlier")
    share = F.conv(F.substring(F.md5(F.concat_ws("/", *order).cast("binary")), 1, 8), 16, 10).cast("long") % 1501 + 500
    delay = F.when(F.col("n") > 1, (F.lit(int(base * 1000)) * share * _factor(F.col("n"))).cast("long")).otherwise(0)
    timed = running_sums(numbered.withColumn("delay_us", delay), groups, order, {"before_us": "delay_us"})
    return timed.withColumn("at_us", F.col("before_us") + F.col("delay_us")).drop("before_us", "delay_us")


def schedule(requests: DataFrame, base: float = 2.0, backoff: float = 3.0) -> DataFrame:
    """Of requests (n, from 1; attempt, from 0): the delay's bounds by Pace, the back-off and the time allowed."""
    factor = _factor(F.col("n"))
    allowed = F.least(F.lit(LAST_TIMEOUT), F.lit(FIRST_TIMEOUT) * F.lit(GROWTH) ** F.col("attempt"))
    return requests.withColumns({"least": factor * (base * JITTER[0]), "most": factor * (base * JITTER[1]), "backoff": F.lit(2.0) ** F.col("attempt") * backoff, "allowed": allowed})


def mock(text: Column, prefix: str = MOCK_PREFIX) -> Column:
    return F.concat(F.lit(prefix), text)


def _edge(backend: Backend, source: str, target: str, lanes: int = 1) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks translated with bounded concurrency.  All threads of a task keep one pace; with a rate, the chunks have a
    lane, a task has the slots of the lanes it holds, and the job keeps the rate however many tasks run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = threading.Lock()
        slots: dict[int, Slots] = {}

        def wait(lane: int | None) -> None:
            if backend.rate:
                with turn:
                    own = slots.setdefault(lane, Slots(backend.rate, lane, lanes, backend.sleep))
                own.take(turn)
            elif backend.pace:
                with turn:
                    backend.pace.wait()

        def one(text: str, lane: int | None) -> tuple[str, str | None]:
            error = None
            for attempt in range(max(1, backend.retries)):
                if attempt and backend.backoff:
                    backend.sleep(2 ** (attempt - 1) * backend.backoff + random.random())
                try:
                    wait(lane)
                    told = backend.call(text, source, target)
                    return text if told is None else told, None
                except UsageLimitExceeded:
                    raise  # no further call may be made
                except TranslationError as e:
                    error = str(e)
            return text, error

        with ThreadPoolExecutor(backend.concurrency) as pool:
            for b in batches:
                lane = b.column("lane").to_pylist() if "lane" in b.schema.names else [None] * len(b)
                got = list(pool.map(one, b.column("chunk").to_pylist(), lane))
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([t for t, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], names=["key", "translated", "error"])

    return run


def translate_texts(texts: DataFrame, backend: Backend | None = None, source: str = "mr", target: str = "en", size: int = CHUNK) -> DataFrame:
    """doc_id, translated_text, chunk_count, warnings for texts (doc_id, source_text); None: the mock backend.

    Blank texts pass through.  A failed chunk keeps its source and gives a warning.  Chunks are joined by an
    empty line.
    """
    cut = texts.select("doc_id", "source_text", F.when(is_blank(F.col("source_text")), F.array(F.coalesce("source_text", F.lit("")))).otherwise(chunks(F.col("source_text"), size)).alias("parts"))
    blank = is_blank(F.col("source_text"))
    if backend is None:
        done = F.when(blank, F.col("parts")).otherwise(F.transform("parts", lambda x: mock(x)))
        return cut.select("doc_id", F.array_join(done, "\n\n").alias("translated_text"), F.size("parts").alias("chunk_count"), F.array().cast("array<string>").alias("warnings"))
    # No array is empty.  The inner form would have its size and nullness asked below, by cutting each text thrice.
    rows = cut.select("doc_id", blank.alias("blank"), F.posexplode_outer("parts").alias("ord", "chunk")).withColumn("key", F.sha2("chunk", 256))
    once = rows.where(~F.col("blank")).groupBy("key").agg(F.min("chunk").alias("chunk"))
    lanes = texts.sparkSession.sparkContext.defaultParallelism if backend.rate else 1
    if backend.rate:
        numbers = running_sums(once.select("key", F.lit(1).alias("one")), [], ["key"], {"n": "one"}).select("key", (F.col("n") % lanes).cast("int").alias("lane"))
        once = once.join(numbers, "key").repartition(lanes, "lane")
    else:
        once = once.withColumn("lane", F.lit(None).cast("int"))
    translated = once.mapInArrow(_edge(backend, source, target, lanes), "key string, translated string, error string")
    # The edge gives every chunk back, a failed one as it was: only blank texts travel with their rows.
    light = rows.select("doc_id", "ord", "key", F.when(F.col("blank"), F.col("chunk")).alias("kept"))
    back = light.join(translated, "key", "left")
    place = F.col("ord")
    warning = F.concat(F.lit("Chunk "), (place + 1).cast("string"), F.lit(" translation failed: "), F.col("error"))
    listed = lambda value, given: F.transform(F.array_sort(F.collect_list(F.when(given, F.struct(place.alias("ord"), value.alias("x"))))), lambda r: r["x"])
    # Three aggregates, so that what a query does not ask for is not collected.
    return back.groupBy("doc_id").agg(
        F.array_join(listed(F.coalesce("translated", "kept"), place.isNotNull()), "\n\n").alias("translated_text"),
        F.count(F.lit(1)).cast("int").alias("chunk_count"),
        listed(warning, F.col("error").isNotNull()).alias("warnings"),
    )


def translate_blocks(blocks: DataFrame, backend: Backend | None = None, **options) -> DataFrame:
    """Adds translated_text to blocks with text; blank blocks keep null.  Long blocks are chunked too."""
    key = F.to_json(F.struct("doc_id", "page_number", "block_idx"), {"ignoreNullFields": "false"})
    text = F.coalesce(F.col("unicode_text") if "unicode_text" in blocks.columns else F.lit(None).cast("string"), F.col("raw_text"))
    rows = blocks.withColumns({"block_key": key, "block_text": text})
    done = translate_texts(rows.where(~is_blank(F.col("block_text"))).select(F.col("block_key").alias("doc_id"), F.col("block_text").alias("source_text")), backend, **options)
    return rows.join(done.select(F.col("doc_id").alias("block_key"), "translated_text"), "block_key", "left").drop("block_key", "block_text")


def all_failed(done: DataFrame) -> DataFrame:
    """Adds n_failed and failed to translations: whether no chunk of the text was translated."""
    return done.withColumn("n_failed", F.size("warnings")).withColumn("failed", F.col("n_failed") >= F.col("chunk_count"))


def characters_sent(texts: DataFrame, done: DataFrame) -> DataFrame:
    """doc_id and characters of texts that were translated without a warning: what counts as used, after success."""
    counted = texts.where(~is_blank(F.col("source_text"))).select("doc_id", F.length("source_text").cast("long").alias("n"))
    return counted.join(done.select("doc_id", (F.size("warnings") == 0).alias("ok")), "doc_id").select("doc_id", F.when(F.col("ok"), F.col("n")).otherwise(0).alias("characters"))


def within_limit(requests: DataFrame, used: DataFrame, limit: int = FREE_TIER) -> DataFrame:
    """service, n (characters to send), used, allowed: judged for each service as a whole, before any call."""
    sums = requests.groupBy("service").agg(F.coalesce(F.sum(F.length("source_text")), F.lit(0)).cast("long").alias("n"))
    found = sums.join(used.select("service", F.col("characters").alias("used")), "service", "left").withColumn("used", F.coalesce("used", F.lit(0)).cast("long"))
    return found.withColumn("allowed", F.col("used") + F.col("n") <= limit)


def page_marked(pages: DataFrame) -> DataFrame:
    """doc_id and one text with a marker before each page."""
    block = F.concat(F.lit("--- Page "), F.col("page_number").cast("string"), F.lit(" ---\n\n"), F.col("page_text"))
    rows = F.array_sort(F.collect_list(F.struct("page_number", block.alias("t"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n\n").alias("marked"))


def guard(texts: DataFrame, used: int, limit: int = FREE_TIER) -> int:
    """The characters about to be sent; raises before any call if they pass what is left of the month."""
    n = texts.agg(F.coalesce(F.sum(F.length("source_text")), F.lit(0))).first()[0]
    if used + n > limit:
        raise UsageLimitExceeded(f"{used} used and {n} to send are more than {limit}")
    return n


def instruction(source: str, target: str) -> str:
    """What a language model is told to do with a text in one language, by the languages' names."""
    return f"Translate the following text from {source} to {target}. Give only the translation."


def prompt(text: Column, source: str, target: str) -> Column:
    """What a language model is asked for."""
    return F.concat(F.lit(f"{instruction(source, target)}\n\n"), text)


__all__ = ["Backend", "Pace", "Slots", "TranslationError", "UsageLimitExceeded", "guard", "instruction", "mock", "page_marked", "prompt", "slices", "translate_blocks", "translate_texts"]
