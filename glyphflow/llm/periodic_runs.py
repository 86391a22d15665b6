"""Runs of periodic words by Main and Lorentz's divide and conquer, for each document by itself.

1.  Words are interned: a task numbers the distinct words of its documents, exactly, a piece of a text at a time.
2.  A stretch of words is halved at its midpoint m.  A repetition of period p that crosses m holds the pair of places
    (m, m + p) or (m - p, m) and, as it crosses, the pair before it too.  How far such a pair goes on to the right
    and to the left is what the Z-functions of the halves say; here only places where both words of the pair
    agree are asked, all of a level of the recursion at once, and a value is found by bisection on prefix hashes.
3.  A crossing repetition is extended to both sides by these values.  One that could go on beyond its stretch is a
    part of a run that an earlier midpoint has found, and goes.  Equal intervals are one run, of the smallest period.
4.  Every run found is compared word for word.  A document where that fails is done again with Z-values that are
    compared word for word as well, so that hashes save time and decide nothing.

Documents are independent, so nothing is shuffled; a task holds the words of some documents, or of one long one.

Defined cases: null and empty texts have no words and no runs, and keep the empty text; a null doc_id is never
altered; rows repeated or with one id are rows of their own; ties in exponent go to the smaller start, then period;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read
from .textbytes import as_bytes, tidy
from .workspace import Workspace

#: Fewest words of a run, and how often its period goes into it at least.
LEAST, TIMES = 24, 3
#: Bytes of text whose documents a task works on at once, and bytes of one text that are split into words at once.
BATCH, PIECE = 2 << 20, 1 << 20
#: Places that are looked at in one step.
STEP = 1 << 20

OUT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_OUT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
_WHITE = re.compile(rb"[\x20\x09-\x0D]")


class Vocabulary(dict):
    """A number for each word, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def intern(text: bytes, vocabulary: Vocabulary, piece: int = PIECE) -> np.ndarray:
    """The numbers of a text's words."""
    found, at = [], 0
    while at < len(text):
        white = _WHITE.search(text, at + piece)
        end = white.start() if white else len(text)
        found.append(np.fromiter(map(vocabulary.__getitem__, text[at:end].split()), np.int64))  # bytes split at the six white-space bytes
        at = end + 1
    return np.concatenate(found) if found else np.zeros(0, np.int64)


class Prefixes:
    """Which spans of the words are equal, by hashes modulo two primes; how far two places agree."""

    PRIMES = (2147483647, 2147483629)
    BASES = (1331739023, 1920371941)

    def __init__(self, words: np.ndarray) -> None:
        rng = np.random.default_rng(20240611)
        n, kinds = len(words), int(words.max(initial=0)) + 1
        self.parts = []
        for prime, base in zip(self.PRIMES, self.BASES, strict=True):
            power = np.ones(n + 1, np.int64)
            done = 1
            while done <= n:
                more = min(done, n + 1 - done)
                power[done : done + more] = power[:more] * (int(power[done - 1]) * base % prime) % prime
                done += more
            total = np.zeros(n + 1, np.int64)
            np.cumsum(rng.integers(1, prime, kinds)[words] * power[:n] % prime, out=total[1:])
            self.parts.append((prime, power, total % prime))

    def equal(self, x: np.ndarray, y: np.ndarray, k: np.ndarray | int) -> np.ndarray:
        """Whether the k words from x and from y on are the same; x <= y."""
        same = np.ones(len(x), bool)
        for prime, power, total in self.parts:
            same &= ((total[x + k] - total[x]) % prime * power[y - x] - (total[y + k] - total[y])) % prime == 0
        return same

    def forward(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from x and from y on agree, at most ``most``."""
        got = np.zeros(len(x), np.int64)
        k = 1 << int(most.max(initial=0)).bit_length()
        while k := k >> 1:
            can = np.flatnonzero(got + k <= most)
            got[can[self.equal(x[can] + got[can], y[can] + got[can], k)]] += k
        return got

    def backward(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words before x and before y agree, at most ``most``."""
        got = np.zeros(len(x), np.int64)
        k = 1 << int(most.max(initial=0)).bit_length()
        while k := k >> 1:
            can = np.flatnonzero(got + k <= most)
            got[can[self.equal(x[can] - got[can] - k, y[can] - got[can] - k, k)]] += k
        return got


class Compared:
    """The same answers from the words themselves, for what hashes got wrong."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    def _agree(self, x: int, y: int, most: int, step: int) -> int:
        got, k = 0, 16
        while got < most:
            k = min(2 * k, most - got)
            a, b = (self.words[p + got : p + got + k] if step > 0 else self.words[p - got - k : p - got][::-1] for p in (x, y))
            if len(other := np.flatnonzero(a != b)):
                return got + int(other[0])
            got += k
        return got

    def forward(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        return np.array([self._agree(*p, 1) for p in zip(x.tolist(), y.tolist(), most.tolist(), strict=True)], np.int64)

    def backward(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        return np.array([self._agree(*p, -1) for p in zip(x.tolist(), y.tolist(), most.tolist(), strict=True)], np.int64)


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Of equal intervals (start, end, period) the one with the smallest period, in order of start and period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _pieces(reach: np.ndarray, step: int) -> Iterator[tuple[int, int, int, int]]:
    """(first node, last node, from, to): nodes whose places are looked at together, large ones in several steps."""
    node, nodes = 0, len(reach)
    ends = np.cumsum(reach)
    while node < nodes:
        if reach[node] > step:
            for at in range(0, int(reach[node]), step):
                yield node, node + 1, at, min(at + step, int(reach[node]))
            node += 1
            continue
        last = int(np.searchsorted(ends, (ends[node - 1] if node else 0) + step, "right"))
        yield node, max(last, node + 1), 0, -1
        node = max(last, node + 1)


def crossing(words: np.ndarray, first: np.ndarray, last: np.ndarray, z: Prefixes | Compared, least: int, times: int, step: int = STEP) -> np.ndarray:
    """(start, end, period) of every run; documents are words[first:last], one after the other."""
    kinds = int(words.max(initial=0)) + 1
    pair = words.copy()
    pair[1:] += words[:-1] * kinds  # the word at a place and the one before it
    found = [np.zeros((0, 3), np.int64)]
    lo, hi, begin, end = first, last, first, last
    while True:
        long = hi - lo >= least
        lo, hi, begin, end = lo[long], hi[long], begin[long], end[long]
        if not len(lo):
            break
        mid = (lo + hi) // 2
        most = (hi - lo) // times  # no longer period fits so often
        left, right = np.minimum(most, mid - lo - 1), np.minimum(most, hi - mid - 1)
        reach = left + right + 1
        for a, b, at, to in _pieces(reach, step):
            if to < 0:
                node = np.repeat(np.arange(a, b), reach[a:b])
                place = np.arange(len(node)) - np.repeat(np.cumsum(reach[a:b]) - reach[a:b], reach[a:b]) + (mid - left)[node]
            else:
                place = np.arange(mid[a] - left[a] + at, mid[a] - left[a] + to)
                node = np.full(len(place), a)
            hit = (pair[place] == pair[mid[node]]) & (place != mid[node])
            place, node = place[hit], node[hit]
            x, y = np.minimum(place, mid[node]), np.maximum(place, mid[node])
            p = y - x
            e = y + z.forward(x, y, hi[node] - y)
            s = x - z.backward(x, y, x - lo[node])
            keep = e - s >= np.maximum(least, times * p)
            s, e, p, node = s[keep], e[keep], p[keep], node[keep]
            before, after = np.maximum(s - 1, 0), np.minimum(e, len(words) - 1)
            whole = ((s > lo[node]) | (s == begin[node]) | (words[before] != words[before + p])) & ((e < hi[node]) | (e == end[node]) | (words[after] != words[after - p]))
            found.append(_smallest(np.stack([s, e, p], axis=1)[whole]))
        lo, hi, begin, end = np.concatenate([lo, mid]), np.concatenate([mid, hi]), np.tile(begin, 2), np.tile(end, 2)
    return _smallest(np.concatenate(found))


def find_runs(words: np.ndarray, bounds: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """(start, end, period), in order, of the runs of documents words[bounds[i]:bounds[i + 1]]; times is 3 or more, so that
    both words of a pair that crosses agree."""
    first, last = bounds[:-1], bounds[1:]
    runs = crossing(words, first, last, Prefixes(words), least, times)
    wrong = [s for s, e, p in runs.tolist() if not np.array_equal(words[s : e - p], words[s + p : e])]
    if not wrong:
        return runs
    again = np.unique(np.searchsorted(bounds, wrong, "right") - 1)
    others = runs[~np.isin(np.searchsorted(bounds, runs[:, 0], "right") - 1, again)]
    return _smallest(np.concatenate([others, crossing(words, first[again], last[again], Compared(words), least, times)]))


def altered(words: np.ndarray, doc_id: int | None) -> np.ndarray:
    """Every tenth document by the checksum of its id goes on periodically from some word."""
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    return np.concatenate([words[:a], words[a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))]])


def greatest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """(start, length, period) of the greatest exact exponent; runs are in order, so the first of equal ones."""
    best = None
    for s, e, p in runs.tolist():
        if best is None or (e - s) * best[2] > best[1] * p:
            best = (s, e - s, p)
    return best


def _digest(words: list[bytes], numbers: np.ndarray) -> str:
    """SHA-256 of the words joined by spaces, a piece at a time."""
    made = hashlib.sha256()
    for at in range(0, len(numbers), 1 << 16):
        made.update((b" " if at else b"") + b" ".join([words[i] for i in numbers[at : at + (1 << 16)].tolist()]))
    return made.hexdigest()


def _rows(held: list[tuple[int | None, np.ndarray]], vocabulary: Vocabulary, least: int, times: int) -> pa.RecordBatch:
    bounds = np.concatenate([[0], np.cumsum([len(w) for _, w in held])]).astype(np.int64)
    words = np.concatenate([w for _, w in held])
    runs = find_runs(words, bounds, least, times)
    own = np.searchsorted(runs[:, 0], bounds)
    names, out = list(vocabulary), []
    for i, (doc_id, numbers) in enumerate(held):
        mine = runs[own[i] : own[i + 1]] - np.array([bounds[i], bounds[i], 0])
        best = greatest(mine)
        covered = np.zeros(len(numbers) + 1, np.int64)
        np.add.at(covered, mine[:, 0] + mine[:, 2], 1)
        np.add.at(covered, mine[:, 1], -1)
        kept = numbers[np.cumsum(covered[:-1]) == 0] if len(mine) else numbers
        listed = "".join(f"{s},{e - s},{p}\n" for s, e, p in mine.tolist())
        out.append((doc_id, len(mine), *(best or (None, None, None)), best and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), _digest(names, kept)))
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _OUT, strict=True)], schema=_OUT)


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, alter: bool = False) -> DataFrame:
    """A row for each row of docs (doc_id, text): its runs, the greatest of them, and the text without repetitions.

    alter: the texts are first made periodic as ``altered`` says, for trying the operator out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, np.ndarray]] = []
        vocabulary, size = Vocabulary(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                if held and size + len(text) > BATCH:
                    yield _rows(held, vocabulary, least, times)
                    held, vocabulary, size = [], Vocabulary(), 0
                words = intern(text, vocabulary)
                held.append((doc_id, altered(words, doc_id) if alter else words))
                size += len(text) + 64
        if held:
            yield _rows(held, vocabulary, least, times)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), OUT)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Workspace(spark, "runs") as ws:
        return ws.result(periodic_runs(read(spark, sf_dir, "documents"), alter=True))
