"""BPE encoding and decoding of whole texts by forced-boundary splitting.

A merge can only join two symbols if the bytes that meet there are neighbours inside some vocabulary token.
Byte pairs that occur inside no token therefore mark certain cuts: no merge ever crosses them.  Every word
(pre-token) is cut there, the fragments are encoded independently by merge rank, and their ids are
concatenated; only a word's last fragment carries the end-of-word suffix.  Results of words are
remembered in two generations of bounded size, so memory stays bounded whatever the corpus.

The vocabulary file (a few megabytes) is read once on the driver and broadcast as it is.

Defined cases: null counts as empty, an empty text has no ids and decodes to the empty text; the strings of
the special tokens become those tokens, as in the library; rows repeated or tied need no rule, since each row
is encoded by itself; rows with a null id are kept; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import operator
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read
from .textbytes import tidy
from .workspace import Workspace

#: Words that each of a worker's two generations remembers; the older one goes when the younger is full.
REMEMBERED = 150_000
#: Symbols of a fragment from which its next merge is found by a heap instead of a scan.
LONG = 48
#: Code points up to here are normalised and split by Python as by the library; texts with others go through its own code.
PLAIN = 0x24F


def byte_alphabet() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


class ForcedBoundaryBPE:
    """Encodes and decodes with one vocabulary file (JSON of the tokenizers library, BPE over bytes)."""

    def __init__(self, source: bytes) -> None:
        spec = json.loads(source)
        model = spec["model"]
        self.source = source
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.ids.items()}
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ", 1)): r for r, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.alphabet = byte_alphabet()
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
        self.joint = self._joints()
        self.packed = {t: i.to_bytes(4, "little") for t, i in self.ids.items()}
        self.young: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}
        self.library = None

    def _joints(self) -> set[str]:
        """Every pair of neighbouring bytes inside a vocabulary token, in the byte alphabet."""
        out: set[str] = set()
        for token in self.ids:
            body = token.removesuffix(self.suffix) if self.suffix else token
            out.update(body[i : i + 2] for i in range(len(body) - 1))
        return out

    def pieces(self, word: str) -> list[str]:
        """The word, in the byte alphabet, cut wherever a byte pair occurs inside no token."""
        pairs = list(map(operator.add, word, word[1:]))
        if self.joint.issuperset(pairs):
            return [word]
        cuts = [0, *(i for i, p in enumerate(pairs, 1) if p not in self.joint), len(word)]
        return [word[i:j] for i, j in zip(cuts, cuts[1:])]

    def merge(self, fragment: str, last: bool) -> list[str]:
        """Merges the neighbours of lowest rank, leftmost first, until no neighbouring pair has one."""
        symbols = list(fragment)
        if last and self.suffix:
            symbols[-1] += self.suffix
        if len(symbols) > LONG:
            return self.merge_long(symbols)
        rank, none = self.rank.get, 1 << 30
        ranks = [rank(p, none) for p in zip(symbols, symbols[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((symbols[i - 1], symbols[i]), none)
            if i < len(ranks):
                ranks[i] = rank((symbols[i], symbols[i + 1]), none)
        return symbols

    def merge_long(self, symbols: list[str | None]) -> list[str]:
        """The same for n symbols in n log n steps: pairs wait in a heap by rank and place, symbols are a linked list."""
        n, rank = len(symbols), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p], i, p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in rank]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or (symbols[i], symbols[j]) != pair:  # one of them has been merged since
                continue
            symbols[i], symbols[j] = pair[0] + pair[1], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := (symbols[i], symbols[k])) in rank:
                    heapq.heappush(heap, (rank[p], i, p))
            if (h := before[i]) >= 0 and (p := (symbols[h], symbols[i])) in rank:
                heapq.heappush(heap, (rank[p], h, p))
        return [s for s in symbols if s is not None]

    def word(self, word: str) -> tuple[bytes, str]:
        """Little-endian 32-bit ids, and the tokens as the decoder writes them, of one pre-token."""
        if word[0] == " ":
            word = word[1:]
        elif not (word.isascii() and word.isprintable()):
            word = "".join([self.alphabet[b] for b in word.encode()])
        parts = self.pieces(word)
        tokens = self.merge(parts[-1], True)
        if len(parts) > 1:
            tokens = [t for p in parts[:-1] for t in self.merge(p, False)] + tokens
        tokens = [t for t in tokens if t in self.packed]
        return b"".join([self.packed[t] for t in tokens]), " ".join(tokens)

    def look_up(self, word: str) -> tuple[bytes, str]:
        got = self.old.get(word) or self.word(word)
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}
        if len(word) <= 64:
            self.young[word] = got
        return got

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text, those of unusual characters in the byte alphabet and marked by a space, which no pre-token has."""
        if text.isascii():
            return self.pattern.findall(text.lower())
        if ord(max(text)) <= PLAIN and "\u0130" not in text:
            return self.pattern.findall(unicodedata.normalize("NFC", text).lower())
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.source.decode())
        normal = self.library.normalizer.normalize_str(text)
        return [" " + w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and the text they decode to."""
        ids: list[bytes] = []
        shown: list[str] = []
        for part in self.cut.split(text) if self.special and "<" in text else (text,):
            if part in self.special:
                ids.append(self.special[part].to_bytes(4, "little"))
                shown.append(part)
                continue
            for w in self.words(part):
                got = self.young.get(w) or self.look_up(w)
                if got[0]:
                    ids.append(got[0])
                    shown.append(got[1])
        return b"".join(ids), " ".join(shown)

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included."""
        return " ".join(self.tokens[int.from_bytes(ids[i : i + 4], "little")] for i in range(0, len(ids), 4))


_LOADED: dict[str, ForcedBoundaryBPE] = {}


def _model(source: bytes) -> ForcedBoundaryBPE:
    """One model for each worker process; workers serve many tasks."""
    key = hashlib.sha256(source).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ForcedBoundaryBPE(source)
    return _LOADED[key]


def encode_texts(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row; with_ids adds ids (array) and decoded."""
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    if with_ids:
        fields += [("ids", pa.list_(pa.int64())), ("decoded", pa.string())]
    schema = pa.schema(fields)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        model = _model(shared.value)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids, decoded = model.encode(text or "")
                row = (doc, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                rows.append((*row, np.frombuffer(ids, "<u4").astype(np.int64).tolist(), decoded) if with_ids else row)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        model.young, model.old = {}, {}

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded string" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(encode), ddl)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Workspace(spark, "bpe", batch_rows=256) as ws:
        return ws.result(encode_texts(read(spark, sf_dir, "documents"), vocabulary_path()))
