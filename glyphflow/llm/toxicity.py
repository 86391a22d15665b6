"""Toxicity by class-conditional Kneser-Ney models over the characters of words.

*   Two models, toxic and ordinary, give each character of a word its probability after up to five
    characters before it, word start and word end being characters too.  Each discounts its own counts and
    hands the mass to one shared backoff distribution, so an expression that a class has not seen is judged
    by the shared counts and says little; where neither has seen it, only the backoff weights remain.
*   The shared backoff discounts the counts of the strings and contexts in every document, labelled or not: the
    words of all documents are counted in a distributed table, and their strings and contexts in two more, of
    which those that the classes have seen are joined to the class counts.
*   The shared backoff hands its own mass to a Kneser-Ney continuation model over three character classes.  The
    counts of that, in how many different surroundings a triple occurs, come from every document too: each
    task marks the four-character strings it meets in a bitmap of 64**4 bits, and bitmaps are united by range.
*   The class counts come from labelled rows outside the held-out third, at most FIT_ROWS of them and FIT_BYTES
    of text in the order of a hash, in two folds.  Each fold, scored with the counts of the other, calibrates
    the score: a logistic function of the length-normalised log-likelihood ratios of all words, and of the
    words that are strong evidence alone.
*   Scoring needs two sorted arrays (strings and contexts the classes have seen, with their log ratios), of
    MOST_STRINGS at most, and looks every distinct word of a batch up once.  Where the classes have more strings
    (texts that are letters at random) nothing is sent: the same ratios are joined to the characters of all distinct
    words, and the words' sums to the documents, as tables.

Defined cases: null and empty texts have ratio 0 and get the score of that; labels that are null do not
count, the larger of repeated ones does; the fit reads equal rows of one id once; without labels of both classes every score is 0.5; null ids are not
held out and are kept; ties need no rule; an empty table gives an empty result; no other column is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import read
from .textbytes import SpanHashes, chunks, span_hashes, tidy, words
from .workspace import Workspace, partitions

#: Labelled rows that the fit may read, and the bytes of their texts.
FIT_ROWS, FIT_BYTES = 40_000, 192 << 20
#: Strings of the classes, about 76 bytes each on the driver, up to which scoring goes by arrays and not by joins; where
#: ``class_counts`` is asked for a table of so many, a string that is met so often is always in it.
MOST_STRINGS, OFTEN = 2_000_000, 128
#: Characters of context, and the discount of all counts.
CONTEXT, DISCOUNT = 5, 0.75
#: Log ratios from which words are summed: all of them, the whole likelihood ratio; and those that are strong evidence.
EVIDENCE = (-np.inf, 3.0, 6.0)
THRESHOLD = 0.7
#: Bytes of text taken at once.
TEXT_BYTES = 1 << 20


def _classes() -> np.ndarray:
    """64 classes of bytes: word border, letters, digits, punctuation, UTF-8 lead and continuation bytes."""
    out = np.zeros(256, np.int64)
    for b in range(33, 256):
        if 97 <= b <= 122:
            out[b] = b - 96
        elif 48 <= b <= 57:
            out[b] = b - 48 + 27
        elif b >= 0xC0:
            out[b] = 37
        elif b >= 0x80:
            out[b] = 38 + b % 16
        else:
            out[b] = 54 + b % 10
    return out


CLASS = _classes()
_EMPTY = np.zeros(0, np.uint64)


class Words:
    """The distinct words of some texts, and where they occur."""

    def __init__(self, texts: list[bytes]) -> None:
        self.joined, start, end, self.doc = words(texts)
        self.value, first, self.which = np.unique(span_hashes(self.joined, start, end), return_index=True, return_inverse=True)
        self.n, self.start, self.end = len(self.value), start[first], end[first]


class Spelling:
    """The characters of some distinct words, each word bordered by spaces."""

    def __init__(self, words: Words, of: np.ndarray) -> None:
        start, size = words.start[of], words.end[of] - words.start[of] + 1
        self.n = len(of)
        border = np.cumsum(np.concatenate([[0], size]))
        self.data = np.full(int(border[-1]) + 1, 32, np.uint8)
        offset = np.arange(int(border[-1])) - np.repeat(border[:-1], size)
        inside = offset < np.repeat(size, size) - 1
        self.data[1:][inside] = words.joined[(np.repeat(start, size) + offset)[inside]]
        #: Each character to predict (word end included), its word, where that begins, and where its context does.
        self.at = np.arange(1, len(self.data))
        self.of = np.repeat(np.arange(self.n), size)
        self.begin = border[self.of]
        self.since = np.maximum(self.begin, self.at - CONTEXT)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each character: its string with the context, and the context alone."""
        spans = SpanHashes(self.data)
        return spans.of(self.since, self.at + 1), spans.of(self.since, self.at)

    def triples(self) -> np.ndarray:
        """The index of (two classes before, class) in the shared model; a word's start counts once."""
        c = CLASS[self.data]
        before = np.where(self.at - 2 >= self.begin, c[np.maximum(self.at - 2, 0)], 0)
        return (before * 64 + c[self.at - 1]) * 64 + c[self.at]

    def quads(self) -> np.ndarray:
        c = CLASS[self.data]
        before = np.where(self.at - 3 >= self.begin, c[np.maximum(self.at - 3, 0)], 0)
        return before * 64**3 + self.triples()


class Known:
    """Values of words met before, by word hash; begun anew when full, so that memory stays bounded."""

    def __init__(self, most: int = 300_000) -> None:
        self.most, self.keys, self.values = most, _EMPTY, np.zeros(0, np.float32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these keys are new, and the values of the others (0 for new ones)."""
        if not len(self.keys):
            return np.ones(len(keys), bool), np.zeros(len(keys), np.float32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        new = self.keys[at] != keys
        return new, np.where(new, np.float32(0), self.values[at])

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        if len(self.keys) + len(keys) > self.most:
            self.keys, self.values = _EMPTY, np.zeros(0, np.float32)
        merged = np.concatenate([self.keys, keys])
        order = np.argsort(merged, kind="stable")
        self.keys, self.values = merged[order], np.concatenate([self.values, values])[order]


# -- shared backoff -----------------------------------------------------------------------------------------

RANGE = 64**4 // 64 // 8


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(64**4, bool)
    known = Known()
    for _, texts in chunks(batches, "doc_id", most=TEXT_BYTES):
        w = Words(texts)
        new = np.flatnonzero(known.find(w.value)[0])
        seen[Spelling(w, new).quads()] = True
        known.add(w.value[new], np.zeros(len(new), np.float32))
    bits = np.packbits(seen).reshape(64, RANGE)
    for k in np.flatnonzero(bits.any(axis=1)):
        yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([bits[k].tobytes()], pa.binary())], names=["part", "bits"])


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, b in zip(batch.column("part").to_pylist(), batch.column("bits").to_pylist(), strict=True):
            bits = np.frombuffer(b, np.uint8)
            found[k] = found[k] | bits if k in found else bits
    for k, b in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([b.tobytes()], pa.binary())], names=["part", "bits"])


def shared_model(docs: DataFrame) -> np.ndarray:
    """Probabilities of the last class of each triple, by continuation counts over every document (2 MB)."""
    spark = docs.sparkSession
    marked = docs.mapInArrow(tidy(_mark), "part int, bits binary")
    united = marked.repartition(min(64, partitions(spark)), "part").mapInArrow(_unite, "part int, bits binary")
    bits = np.zeros((64, RANGE), np.uint8)
    for row in united.collect():  # 64 rows at most
        bits[row[0]] = np.frombuffer(row[1], np.uint8)
    quad = np.unpackbits(bits.reshape(-1)).reshape(64, 64, 64, 64)
    three = quad.sum(axis=0, dtype=np.float64)
    two = (three > 0).sum(axis=0, dtype=np.float64)
    one = (two > 0).sum(axis=0, dtype=np.float64) + 0.5
    p = np.broadcast_to(one / one.sum(), (64, 64))
    for counts in (two, three):
        total = counts.sum(axis=-1, keepdims=True)
        left = np.where(total > 0, DISCOUNT * (counts > 0).sum(axis=-1, keepdims=True) / np.maximum(total, 1), 1.0)
        p = np.maximum(counts - DISCOUNT, 0) / np.maximum(total, 1) + left * p
    return p.reshape(-1)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in chunks(batches, "doc_id", most=TEXT_BYTES):
        w = Words(texts)
        if w.n:
            data = w.joined.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([data[a:b] for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)], pa.binary()), pa.array(np.bincount(w.which, minlength=w.n).astype(np.int64))], names=["word", "n"])


def _count_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for n, found in chunks(batches, "n", "word", most=TEXT_BYTES):
        w = Words(found)  # each row is one word, and no two are the same
        spelt = Spelling(w, np.arange(w.n))
        string, context = spelt.hashes()
        value, first, which = np.unique(string, return_index=True, return_inverse=True)
        times = np.zeros(w.n, np.int64)
        np.add.at(times, w.which, n[w.doc])
        sums = np.zeros(len(value), np.int64)
        np.add.at(sums, which, times[spelt.of])
        yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(context[first].view(np.int64)), pa.array(sums)], names=["string", "context", "n"])


def shared_counts(docs: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """How often each string (shared_n) and each context (shared_total) occurs in all documents, and with how many strings (shared_kinds)."""
    words = docs.mapInArrow(tidy(_count_words), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    strings = words.mapInArrow(tidy(_count_strings), "string long, context long, n long").groupBy("string", "context").agg(F.sum("n").alias("shared_n"))
    strings = ws.keep(strings, "strings")
    return strings.select("string", "shared_n"), strings.groupBy("context").agg(F.sum("shared_n").alias("shared_total"), F.count("*").alias("shared_kinds"))


# -- class counts -------------------------------------------------------------------------------------------

#: Counts by class and fold.
SUMS = ("toxic_0", "ordinary_0", "toxic_1", "ordinary_1")
COUNTS = "string long, context long, triple int, " + ", ".join(f"{c} long" for c in SUMS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group, texts in chunks(batches, "group", most=TEXT_BYTES):
        w = Words(texts)
        spelt = Spelling(w, np.arange(w.n))
        string, context = spelt.hashes()
        value, first, which = np.unique(string, return_index=True, return_inverse=True)
        sums = [np.bincount(which, np.bincount(w.which, group[w.doc] == k, w.n)[spelt.of], len(value)).astype(np.int64) for k in range(4)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(value.view(np.int64)), pa.array(context[first].view(np.int64)), pa.array(spelt.triples()[first].astype(np.int32)), *map(pa.array, sums)],
            names=["string", "context", "triple", *SUMS],
        )


def strings_of(fit: DataFrame, ws: Workspace) -> DataFrame:
    """Counts by class and fold of all strings of fit (group, text)."""
    return ws.keep(fit.mapInArrow(tidy(_count), COUNTS).groupBy("string", "context", "triple").agg(*[F.sum(c).alias(c) for c in SUMS]), "class")


def class_counts(fit: DataFrame, strings: DataFrame, contexts: DataFrame, ws: Workspace, most: int = MOST_STRINGS, counts: DataFrame | None = None) -> pa.Table:
    """Counts by class and fold of the strings of fit (group, text), with the shared counts.

    All strings that the fit has, or where these are more than ``most`` those that it has often enough: for arrays that
    have a bound.  ``score_toxicity`` asks for it only where all are within the bound.  counts: of ``strings_of``.
    """
    counts = strings_of(fit, ws) if counts is None else counts
    times = sum((F.col(c) for c in SUMS[1:]), F.col(SUMS[0]))
    having = dict(map(tuple, counts.groupBy(F.least(times, F.lit(OFTEN)).alias("times")).count().collect()))  # OFTEN rows
    least, kept = OFTEN, having.get(OFTEN, 0)
    while least > 1 and kept + having.get(least - 1, 0) <= most:
        least -= 1
        kept += having.get(least, 0)
    return counts.where(times >= least).join(strings, "string").join(contexts, "context").toArrow()  # its texts are documents


class Ratios:
    """Log ratios, toxic to ordinary, of the strings and contexts that the classes have seen."""

    def __init__(self, counts: pa.Table, shared: np.ndarray, folds: tuple[int, ...] = (0, 1)) -> None:
        n = np.stack([sum(counts.column(f"{k}_{f}").to_numpy() for f in folds) for k in ("toxic", "ordinary")]).astype(np.float64)
        met = n.sum(axis=0) > 0
        n = n[:, met]
        string, context = (counts.column(c).to_numpy().view(np.uint64)[met] for c in ("string", "context"))
        times, total, kinds = (counts.column(c).to_numpy()[met] for c in ("shared_n", "shared_total", "shared_kinds"))
        self.contexts, which = np.unique(context, return_inverse=True)

        def discounted(x: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Probability of each string, and the mass that each context hands down."""
            total, kinds = np.bincount(which, x, len(self.contexts)), np.bincount(which, x > 0, len(self.contexts))
            left = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            return np.maximum(x - DISCOUNT, 0) / np.maximum(total, 1)[which] + left[which] * below, left

        both = (times - DISCOUNT + DISCOUNT * kinds * shared[counts.column("triple").to_numpy()[met]]) / total
        (p, p_left), (q, q_left) = discounted(n[0], both), discounted(n[1], both)
        self.known = Known()
        order = np.argsort(string)
        self.strings = string[order]
        self.of_string = np.log(p / q)[order].astype(np.float32)
        self.of_context = np.log(p_left / q_left).astype(np.float32)

    def ratios(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: the sums of its words' log ratios from each bound of EVIDENCE on, and its words."""
        w = Words(texts)
        n = np.bincount(w.doc, minlength=len(texts))
        if not len(self.strings) or not w.n:
            return np.zeros((len(EVIDENCE), len(texts))), n
        new, of_word = self.known.find(w.value)
        fresh = np.flatnonzero(new)
        spelt = Spelling(w, fresh)
        string, context = spelt.hashes()
        i, j = (np.minimum(np.searchsorted(a, x), len(a) - 1) for a, x in ((self.strings, string), (self.contexts, context)))
        value = np.where(self.strings[i] == string, self.of_string[i], np.where(self.contexts[j] == context, self.of_context[j], 0))
        of_word[fresh] = np.bincount(spelt.of, value, spelt.n)
        self.known.add(w.value[fresh], of_word[fresh])
        return np.stack([np.bincount(w.doc, np.where(of_word >= e, of_word, 0)[w.which], len(texts)) for e in EVIDENCE]), n


def features(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Evidence over the length and over its root, which says how far it stands out of chance."""
    n = np.maximum(n, 1)
    return np.stack([np.ones(len(n)), *(total / n), *(total / np.sqrt(n))], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of least penalised loss; zeros where one class is missing.

    The first column is the intercept, which is not penalised; the others are brought to one scale first, so that the
    penalty treats them alike.  Newton's steps are halved until the loss, which is convex, falls: however well the
    classes part, no step can overshoot.
    """
    if not len(y) or y.min() == y.max():
        return np.zeros(x.shape[1])
    scale = x.std(axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    z, penalty = x / scale, np.full(x.shape[1], ridge)
    penalty[0] = 0.0

    def loss(w: np.ndarray) -> float:
        value = z @ w
        return float((np.logaddexp(0, value) - y * value).sum() + 0.5 * (penalty * w * w).sum())

    w = np.zeros(x.shape[1])
    w[0] = np.log(y.mean() / (1 - y.mean()))
    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        gradient = z.T @ (y - p) - penalty * w
        curve = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        for _ in range(60):
            after = loss(w + step)
            if after <= now:
                break
            step = step / 2
        else:
            break
        w, gain, now = w + step, now - after, after
        if gain < 1e-9 * max(1.0, now):
            break
    return w / scale


# -- any number of strings ----------------------------------------------------------------------------------

#: Folds whose counts score: the first fold's rows, the second's, and all others.
FOLDS = ((1,), (0,), (0, 1))


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, found in chunks(batches, "n", "word", most=TEXT_BYTES):
        w = Words(found)
        spelt = Spelling(w, np.arange(w.n))
        string, context = spelt.hashes()
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (w.value[spelt.of], string, context)], names=["word", "string", "context"])


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's distinct words and how often it has them; one without a word for every row."""
    for at, texts in chunks(batches, "at", most=TEXT_BYTES):
        w = Words(texts)
        pair, n = np.unique(w.doc * max(w.n, 1) + w.which, return_counts=True)
        doc, which = np.divmod(pair, max(w.n, 1))
        word = pa.concat_arrays([pa.array(w.value[which].view(np.int64)), pa.nulls(len(at), pa.int64())])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at[doc], at])), word, pa.array(np.concatenate([n, np.zeros(len(at), np.int64)]))], names=["at", "word", "n"])


def word_ratios(texts: DataFrame, counts: DataFrame, strings: DataFrame, contexts: DataFrame, shared: np.ndarray) -> DataFrame:
    """word (its hash) and its log ratio by each of FOLDS (r0, r1, r2): those of ``Ratios``, for any number of strings."""
    spark = texts.sparkSession
    sides, one, zero = range(len(FOLDS)), F.lit(1.0), F.lit(0.0)
    of = lambda k, i: sum((F.col(f"{k}_{f}") for f in FOLDS[i][1:]), F.col(f"{k}_{FOLDS[i][0]}"))
    both = [("toxic", i) for i in sides] + [("ordinary", i) for i in sides]
    sums = counts.groupBy("context").agg(*[F.sum(of(k, i)).alias(f"{k}_total{i}") for k, i in both], *[F.count_if(of(k, i) > 0).alias(f"{k}_kinds{i}") for k, i in both])
    total = lambda k, i: F.col(f"{k}_total{i}")
    left = lambda k, i: F.when(total(k, i) > 0, DISCOUNT * F.col(f"{k}_kinds{i}") / total(k, i)).otherwise(one)
    p = lambda k, i: F.greatest(of(k, i) - DISCOUNT, zero) / F.greatest(total(k, i), one) + left(k, i) * F.col("below")
    model = spark.createDataFrame(pa.table({"triple": pa.array(np.arange(len(shared), dtype=np.int32)), "p": pa.array(shared)}))  # 64**3 rows
    known = counts.join(strings, "string").join(contexts, "context").join(sums, "context").join(F.broadcast(model), "triple")
    known = known.withColumn("below", (F.col("shared_n") - DISCOUNT + DISCOUNT * F.col("shared_kinds") * F.col("p")) / F.col("shared_total"))
    of_string = known.select("string", *[F.when(of("toxic", i) + of("ordinary", i) > 0, F.log(p("toxic", i) / p("ordinary", i))).cast("float").alias(f"s{i}") for i in sides])
    of_context = sums.select("context", *[F.when(total("toxic", i) + total("ordinary", i) > 0, F.log(left("toxic", i) / left("ordinary", i))).cast("float").alias(f"c{i}") for i in sides])
    words = texts.mapInArrow(tidy(_count_words), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    spelt = words.mapInArrow(tidy(_spell), "word long, string long, context long")
    met = spelt.join(of_string, "string", "left").join(of_context, "context", "left")
    return met.groupBy("word").agg(*[F.sum(F.coalesce(f"s{i}", f"c{i}", F.lit(0).cast("float"))).cast("float").alias(f"r{i}") for i in sides])


def _evidence(texts: DataFrame, ratios: DataFrame, by: dict[str, Column]) -> DataFrame:
    """at, n (words) and the sums from each bound of EVIDENCE on, by the ratio of every name in ``by``."""
    words = texts.select("at", "text").mapInArrow(tidy(_words_of), "at long, word long, n long").join(ratios, "word", "left")
    sums = [F.coalesce(F.sum(F.when(r >= float(e), r * F.col("n"))), F.lit(0.0)).alias(f"{name}_{i}") for name, r in by.items() for i, e in enumerate(EVIDENCE)]
    return words.groupBy("at").agg(F.sum("n").alias("n"), *sums)


def score_by_joins(texts: DataFrame, fit: DataFrame, counts: DataFrame, strings: DataFrame, contexts: DataFrame, shared: np.ndarray, ws: Workspace) -> DataFrame:
    """doc_id, row and score of texts, with all strings of the classes however many they are."""
    ratio = ws.keep(word_ratios(texts, counts, strings, contexts, shared), "words")
    turned = ws.keep(fit.withColumn("at", F.monotonically_increasing_id()), "turned")
    found = _evidence(turned, ratio, {"a": F.col("r0"), "b": F.col("r1")}).join(turned.select("at", "group"), "at")
    own = [F.when(F.col("group") < 2, F.col(f"a_{i}")).otherwise(F.col(f"b_{i}")).alias(f"t{i}") for i in range(len(EVIDENCE))]
    measured = found.select("group", "n", *own).toArrow()  # FIT_ROWS rows
    group, n, *total = (measured.column(c).to_numpy() for c in ("group", "n", *(f"t{i}" for i in range(len(EVIDENCE)))))
    first, *weights = map(float, fit_logistic(features(np.stack(total), n), (group % 2 == 0).astype(np.float64)))
    rows = ws.keep(texts.withColumn("at", F.monotonically_increasing_id()), "rows")
    length = F.greatest(F.col("n"), F.lit(1)).cast("double")
    parts = [F.col(f"t_{i}") / by for by in (length, F.sqrt(length)) for i in range(len(EVIDENCE))]
    value = sum((x * w for x, w in zip(parts, weights, strict=True)), F.lit(first))
    scored = _evidence(rows, ratio, {"t": F.col("r2")}).select("at", (1 / (1 + F.exp(-F.least(F.greatest(value, F.lit(-30.0)), F.lit(30.0))))).alias("score"))
    return rows.drop("text").join(scored, "at").select("doc_id", "row", "score")


# -- the operator -------------------------------------------------------------------------------------------


def third(doc_id: Column) -> Column:
    """The third of the documents that this one is in; 1 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def fit_rows_of(texts: DataFrame, labels: DataFrame, ws: Workspace, fit_rows: int, fit_bytes: int) -> DataFrame:
    """(group, text) of the rows that the fit reads: class 0 (toxic) or 1, and 2 more for the second fold."""
    labelled = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    fold = (third(F.col("doc_id")) / 2).cast("long")
    sample = labelled.where(third(F.col("doc_id")) != 1).orderBy(F.xxhash64("doc_id")).limit(fit_rows)
    sample = sample.select("doc_id", (F.when(F.col("toxic") == 1, 0).otherwise(1) + 2 * fold).cast("long").alias("group"))
    # fit_rows rows of 16 bytes, whatever the input.
    drawn = F.xxhash64("doc_id", "text").alias("turn")
    fit = texts.join(F.broadcast(sample), "doc_id").select("group", "text", drawn, F.octet_length("text").alias("size"))
    # An id may have many rows, the same ones too, which have one turn, and a row a long text: what is read, equal rows
    # of one id once, ends where either bound is reached.
    fit = ws.keep(fit.dropDuplicates(["turn"]).repartition(partitions(texts.sparkSession), "turn"), "fit")
    in_turn = Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = fit.select("turn", "size").orderBy("turn").limit(fit_rows).withColumn("so_far", F.sum("size").over(in_turn))  # fit_rows rows of 16 bytes
    last = sizes.where(F.coalesce("so_far", F.lit(0)) <= fit_bytes).agg(F.max("turn")).first()[0]
    return fit.where(F.col("turn") <= F.lit(last).cast("long")).select("group", "text")


def score_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, row: str | None = None, fit_bytes: int = FIT_BYTES, most: int = MOST_STRINGS) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.7) for each row of docs (doc_id, text).

    row: a column of docs (long) that the result carries too.  most: strings of the classes up to which scoring goes by
    arrays; the scores are the same.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(row or "doc_id").cast("long").alias("row"))
    with Workspace(spark, "toxicity") as ws:
        fit = fit_rows_of(texts, labels, ws, fit_rows, fit_bytes)
        shared = shared_model(texts)
        strings, contexts = shared_counts(texts, ws)
        held = F.coalesce(third(F.col("doc_id")) == 1, F.lit(False))
        result = lambda scored: ws.result(scored.select("doc_id", *([F.col("row").alias(row)] if row else []), held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))
        every = strings_of(fit, ws)
        if every.count() > most:
            return result(score_by_joins(texts, fit, every, strings, contexts, shared, ws))
        counts = class_counts(fit, strings, contexts, ws, most, every)
        other = spark.sparkContext.broadcast((Ratios(counts, shared, (1,)), Ratios(counts, shared, (0,))))

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group, chunk in chunks(batches, "group", most=TEXT_BYTES):
                (a, n), (b, _) = (r.ratios(chunk) for r in other.value)
                total = np.where(group < 2, a, b)
                yield pa.RecordBatch.from_arrays([pa.array(group), *map(pa.array, total), pa.array(n)], names=["group", "all", "some", "strong", "n"])

        measured = fit.mapInArrow(tidy(measure), "group long, all double, some double, strong double, n long").toArrow()
        group, *total, n = (measured.column(c).to_numpy() for c in ("group", "all", "some", "strong", "n"))
        weights = fit_logistic(features(np.stack(total), n), (group % 2 == 0).astype(np.float64))
        model = spark.sparkContext.broadcast(Ratios(counts, shared))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids: dict[int, tuple] = {}  # of rows that wait for their score
            met = 0

            def numbered() -> Iterator[pa.RecordBatch]:
                nonlocal met
                for b in batches:
                    rows = np.arange(met, met + b.num_rows)
                    ids.update(zip(rows.tolist(), zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), strict=True), strict=True))
                    met += b.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array(rows), b.column("text")], names=["row", "text"])

            for rows, chunk in chunks(numbered(), "row", most=TEXT_BYTES):
                value = features(*model.value.ratios(chunk)) @ weights
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*(ids.pop(r) for r in rows.tolist()), strict=True)), pa.array(1 / (1 + np.exp(-np.clip(value, -30, 30))))], names=["doc_id", "row", "score"])

        scored = texts.mapInArrow(tidy(score), "doc_id long, row long, score double")
        found = result(scored)
        other.unpersist()
        model.unpersist()
        return found


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
