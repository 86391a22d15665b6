"""Removal of long repeated passages with a run-length compressed Burrows-Wheeler index.

A byte goes if some LENGTH-byte string over it also starts earlier: in a smaller doc_id, or earlier in the
same document.

1.  Anchors.  The LENGTH-byte window at every start has one anchor, its leftmost least k-mer by hash, so equal
    windows have equal anchors.  All windows of one anchor form a piece of at most 2 * LENGTH - GRAM bytes.
2.  Owner tasks get the pieces by anchor hash, 20 bytes each, and keep a dictionary of those that differ: of
    equal pieces all but the earliest lose their windows at once.  Anchors with one piece have no other repeats.
3.  The texts of the others, distinct but repetitive, are indexed in shards by anchor.  The index is the
    Burrows-Wheeler transform of the pieces cut into runs, with the suffixes at the run ends and what neighbours
    share there; nothing of the size of the text is kept.  Matching statistics are streamed from those samples:
    between two of them every next position shares one symbol less with the next position of the same
    neighbour.  Matches of LENGTH bytes and more chain equal windows together; the earliest of a chain stays.
4.  Removed ranges join their document, once, and what is left is hashed.

An anchor with very many pieces (a passage in a large share of all documents) is cut into bands of windows, whose
anchor is what all windows of the band share, and bands with very many contents into single windows.  Each
task folds equal ones before they are sent, so no value gathers more than HOT contents, or one for each task.
Equal pieces are recognised by 96 bits of hash, everything else by its bytes.

Defined cases: null text counts as empty, texts shorter than LENGTH keep all their bytes; null ids come after
all others; rows that share an id, or have none, are documents of their own, in the order of a hash of their
texts, so of two equal rows one loses all; an empty table gives an empty result; no column but doc_id and text
is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read
from .jaccard_join import _zipped
from .textbytes import BASE, BYTE_VALUE, chunks, mix, tidy
from .workspace import Workspace, keyed, owners_of, renamed

LENGTH, GRAM = 100, 32
#: Pieces that a task folds and packs together, and documents; slices of an owner's pieces, which it takes one by one.
PACK_PIECES, PACK_DOCS, SLICES = 1_500_000, 40_000, 4
#: Different pieces of one anchor from which it is cut into bands of BAND windows; bytes of a shard.
HOT, BAND, SHARD = 4096, 8, 1 << 20
#: Pieces of hot anchors that a task remembers for folding equal ones.
FOLD = 100_000
#: Bits of a position in a shard that is sorted in packed numbers.
_BITS = 21


def _doubled(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of 2 * size bytes from those of size bytes."""
    return h[:-size] * np.uint64(pow(int(BASE), size, 1 << 64)) + h[size:]


def anchored_pieces(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of each piece: anchor hash and content hash (48 bits each), index of its text, start there, and bytes."""
    size = np.array([len(t) for t in texts], np.int64)
    none = np.zeros(0, np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    if n < LENGTH or not (size >= LENGTH).any():
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    h = BYTE_VALUE[data]
    for k in (1, 2, 4, 8, 16):
        h = _doubled(h, k)
    gram = mix(h)
    h64 = _doubled(h, 32)
    bits = np.uint64(max(22, int(n).bit_length()))  # the same for all but very long texts
    mask = (np.uint64(1) << bits) - np.uint64(1)
    least = (gram & ~mask) | np.arange(len(gram), dtype=np.uint64)
    width, reach = 1, LENGTH - GRAM + 1
    while width * 2 <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
    anchor = (least & mask).astype(np.int64)
    border = np.concatenate([[0], np.cumsum(size)])
    doc = np.repeat(np.arange(len(texts)), size)[: len(anchor)]
    valid = np.arange(len(anchor)) + LENGTH <= border[1:][doc]
    first = valid.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    last = valid.copy()
    last[:-1] &= (anchor[1:] != anchor[:-1]) | ~valid[1:]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    p, end = anchor[lo], hi + LENGTH
    content = mix(h64[lo] * np.uint64(3) + mix(h64[(lo + end - 64) // 2]) + (p - lo).astype(np.uint64))
    content = mix(content + h64[end - 64] * np.uint64(5) + (end - lo).astype(np.uint64))
    of = doc[lo]
    return gram[p] >> np.uint64(16), content >> np.uint64(16), of, lo - border[of], end - lo


def later_ones(key: list[np.ndarray], doc: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key and place; in that order, which rows begin a key, and which start after their key's first."""
    order = np.lexsort((lo, doc, *key[::-1]))
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in key], axis=0)
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    d, s = doc[order], lo[order]
    return order, new, (d != d[head]) | (s != s[head])


def merge_ranges(doc: np.ndarray, lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of ranges of each document."""
    order = np.lexsort((lo, doc))
    doc, lo, end = doc[order], lo[order], end[order]
    if not len(doc):
        return doc, lo, end
    group = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    top = np.maximum.accumulate(end + group * (1 << 40)) - group * (1 << 40)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] > top[:-1])
    start = np.flatnonzero(new)
    return doc[start], lo[start], np.maximum.reduceat(end, start)


# -- anchors to owners --------------------------------------------------------------------------------------

_PACKED = ["owner", "kind", "blob"]


def _anchor(owners: int):
    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, ...]] = []
        count = docs_held = 0

        def pack() -> Iterator[pa.RecordBatch]:
            gram, content, doc, lo, size = (np.concatenate(x) for x in zip(*held, strict=True))
            order, new, later = later_ones([gram, content], doc, lo)
            gone = order[later]
            out = []
            if len(gone):
                ranges = np.stack(merge_ranges(doc[gone], lo[gone], lo[gone] + size[gone]))
                out.append((task % owners, 0, zstandard.ZstdCompressor(level=1).compress(ranges.tobytes())))
            order = order[new]
            gram, content, doc, lo, size = (x[order] for x in (gram, content, doc, lo, size))
            owner = (gram % np.uint64(owners * SLICES)).astype(np.int64)
            by = np.argsort(owner, kind="stable")
            cut = np.searchsorted(owner[by], np.arange(owners * SLICES + 1))
            for o in np.flatnonzero(np.diff(cut)):
                at = by[cut[o] : cut[o + 1]]
                table, local = np.unique(doc[at], return_inverse=True)
                g, c = gram[at], content[at]
                parts = [np.array([len(at), len(table)], np.int64), table, (g & np.uint64(0xFFFFFFFF)).astype(np.uint32), (c & np.uint64(0xFFFFFFFF)).astype(np.uint32), lo[at].astype(np.uint32)]
                parts += [(g >> np.uint64(32)).astype(np.uint16), (c >> np.uint64(32)).astype(np.uint16), local.astype(np.uint16), size[at].astype(np.uint8)]
                out.append((int(o) // SLICES, 1 + int(o) % SLICES, b"".join(x.tobytes() for x in parts)))
            for i in range(0, len(out), 64):
                o, kind, blob = zip(*out[i : i + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(o, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], names=_PACKED)
            held.clear()

        for ids, texts in chunks(batches, "doc_id"):
            gram, content, of, lo, size = anchored_pieces(texts)
            held.append((gram, content, ids[of], lo, size))
            count += len(gram)
            docs_held += len(ids)
            if count > PACK_PIECES or docs_held > PACK_DOCS:
                yield from pack()
                count = docs_held = 0
        if count:
            yield from pack()

    return anchor


OWNED = "kind int, doc_id long, lo long, size long, gram long"


def _own(hot: int):
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ranges to remove (0), and pieces to compare (1; 2 if band by band)."""
        at: tuple[int, int] | None = None
        held: list[bytes] = []
        names = ["kind", "doc_id", "lo", "size", "gram"]

        def rows(kind: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(kind), 1 << 16):
                s = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(kind[s].astype(np.int32)), *(pa.array(c[s].astype(np.int64)) for c in columns)], names=names)

        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            columns = []
            for blob in held:
                n, m = np.frombuffer(blob, np.int64, 2)
                at_, parts = 16, []
                for kind, c in ((np.int64, m), (np.uint32, n), (np.uint32, n), (np.uint32, n), (np.uint16, n), (np.uint16, n), (np.uint16, n), (np.uint8, n)):
                    parts.append(np.frombuffer(blob, kind, int(c), at_))
                    at_ += int(c) * np.dtype(kind).itemsize
                table, g, c, lo, g2, c2, local, size = parts
                columns.append((g.astype(np.uint64) | g2.astype(np.uint64) << np.uint64(32), c.astype(np.uint64) | c2.astype(np.uint64) << np.uint64(32), table[local], lo.astype(np.int64), size.astype(np.int64)))
            held.clear()
            gram, content, doc, lo, size = (np.concatenate(x) for x in zip(*columns, strict=True))
            columns.clear()
            order, new, later = later_ones([gram, content], doc, lo)
            gone = order[later]
            if len(gone):
                d, s, e = merge_ranges(doc[gone], lo[gone], lo[gone] + size[gone])
                yield from rows(np.zeros(len(d)), d, s, e - s, np.zeros(len(d)))
            one = order[new]
            g = gram[one]
            start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            pieces = np.diff(np.concatenate([start, [len(g)]]))
            many = np.repeat(pieces, pieces)
            keep = one[many > 1]
            yield from rows(np.where(many[many > 1] > hot, 2, 1), doc[keep], lo[keep], size[keep], gram[keep])

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for owner, kind, blob in zip(*(batch.column(c).to_pylist() for c in _PACKED), strict=True):
                if kind == 0:
                    doc, lo, end = np.frombuffer(unpack.decompress(blob), np.int64).reshape(3, -1)
                    yield from rows(np.zeros(len(doc)), doc, lo, end - lo, np.zeros(len(doc)))
                    continue
                if (owner, kind) != at:
                    yield from close()
                    at = owner, kind
                held.append(blob)
        yield from close()

    return own


# -- the index ----------------------------------------------------------------------------------------------


def suffix_array(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffixes of a text of pieces, each ended by 0, in order; left: symbols to the piece's end, it included.

    Prefix doubling from seven symbols of nine bits; what is equal up to its end stays in text order.
    """
    n = len(symbols)
    key = symbols.astype(np.uint64)
    for j in range(1, 7):
        nxt = np.zeros(n, np.uint64)
        nxt[:-j] = symbols[j:]
        key = (key << np.uint64(9)) | np.where(left > j, nxt, 0)
    order = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    width, most, at = 7, int(left.max(initial=0)), np.arange(n, dtype=np.uint64)
    while not new.all():
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new).astype(np.uint64)
        beyond = np.zeros(n, np.uint64)
        if width < n:
            beyond[:-width] = rank[width:]
        beyond[left <= width] = 0
        if n < 1 << _BITS:  # rank, rank beyond and position in one number: sorting it is all
            packed = (rank << np.uint64(2 * _BITS)) | (beyond << np.uint64(_BITS)) | at
            packed.sort()
            order, key = (packed & np.uint64((1 << _BITS) - 1)).astype(np.int64), packed >> np.uint64(_BITS)
        else:
            key = (rank << np.uint64(32)) | beyond
            order = np.argsort(key, kind="stable")
            key = key[order]
        new[1:] = key[1:] != key[:-1]
        width *= 2
        if width >= most:
            break
    return order


class RunLengthIndex:
    """The runs of the Burrows-Wheeler transform of some pieces, sampled at their ends.

    What is kept grows with the runs, not with the text: each run's symbol and length, and for its first suffix,
    in text order, where that stands, the suffix before it in order (the last of the run before), and how many
    symbols the two share.
    """

    def __init__(self, pieces: list[bytes]) -> None:
        size = np.array([len(p) for p in pieces], np.int64) + 1
        end = np.cumsum(size)
        data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.uint16) + 1
        data[end - 1] = 0
        self.n = len(data)
        order = suffix_array(data, np.repeat(end, size) - np.arange(self.n))
        before = data[order - 1]
        before[order == 0] = 0
        head = np.ones(self.n, bool)
        head[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)  # every piece's end is a run of its own
        start = np.flatnonzero(head)
        self.symbol, self.length = before[start], np.diff(np.concatenate([start, [self.n]]))
        first, last = order[start], order[start - 1]
        by = np.argsort(first)
        self.at, self.up = first[by], last[by]
        self.shared = self._match(data, self.at, self.up)
        self.shared[self.at == order[0]] = 0  # the first suffix has none before it

    @property
    def runs(self) -> int:
        return len(self.symbol)

    @staticmethod
    def _match(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at a and b share, up to their pieces' ends."""
        out, live = np.zeros(len(a), np.int64), np.arange(len(a))
        while len(live):
            x, y = data[a[live] + out[live]], data[b[live] + out[live]]
            live = live[(x == y) & (x > 0)]
            out[live] += 1
        return out

    def matching_statistics(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of text positions: the symbols shared with the suffix before it in order, and where that stands.

        Inside a run the neighbour's predecessor is the predecessor's neighbour, so both follow from the last sample
        at or before the position.
        """
        sample = np.searchsorted(self.at, at, "right") - 1
        beyond = at - self.at[sample]
        return np.maximum(self.shared[sample] - beyond, 0), self.up[sample] + beyond

    def long_matches(self, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
        """Text positions that share ``length`` symbols and more with the suffix before them, and where that stands."""
        gap = np.diff(np.concatenate([self.at, [self.n]]))
        many = np.clip(self.shared - length + 1, 0, gap)
        at = np.repeat(self.at - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        return at, self.matching_statistics(at)[1]

    def repeated(self, length: int = LENGTH) -> np.ndarray:
        """Positions whose next ``length`` symbols also stand at an earlier one, in text order.

        Long matches lead from each suffix to the one before it, so equal strings are chains; a chain's end is found
        by doubling steps, and its least position stays.
        """
        at, before = self.long_matches(length)
        node, which = np.unique(np.concatenate([at, before]), return_inverse=True)
        step = np.arange(len(node))
        step[which[: len(at)]] = which[len(at) :]
        while True:
            further = step[step]
            if (further == step).all():
                break
            step = further
        least = np.full(len(node), self.n)
        np.minimum.at(least, step, node)
        return node[node > least[step]]


#: Pieces by shard and value, or, where piece is null, ranges that equal ones have lost.
PIECES = "shard int, gram long, doc_id long, lo long, size long, piece binary"
_PIECES = pa.schema([("shard", pa.int32()), ("gram", pa.int64()), ("doc_id", pa.int64()), ("lo", pa.int64()), ("size", pa.int64()), ("piece", pa.binary())])


class Folded:
    """Pieces to send, without those that this task has met at an earlier place."""

    def __init__(self, shards: int) -> None:
        self.shards, self.rows = shards, []
        self.met: dict[tuple[int, bytes], tuple[int, int]] = {}
        self.gone: list[tuple[int, int, int]] = []

    def add(self, gram: int, doc: int, lo: int, piece: bytes) -> None:
        place = self.met.get((gram, piece))
        if place is not None and place < (doc, lo):
            self.gone.append((doc, lo, lo + len(piece)))
            return
        if len(self.met) >= FOLD:
            self.met.clear()
        self.met[gram, piece] = doc, lo
        self.rows.append((gram % self.shards, gram, doc, lo, len(piece), piece))

    def close_document(self) -> None:
        if self.gone:
            for d, lo, end in zip(*(x.tolist() for x in merge_ranges(*np.array(self.gone, np.int64).T)), strict=True):
                self.rows.append((d % self.shards, 0, d, lo, end - lo, None))
            self.gone.clear()

    def batches(self, least: int = 8192) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*self.rows, strict=True), _PIECES, strict=True)], schema=_PIECES)
            self.rows.clear()


def anchor_in(text: bytes, lo: int, size: int, gram: int) -> int:
    """Where the anchor of the windows of a piece stands: the leftmost k-mer of that hash that all of them hold."""
    first, last = lo + size - LENGTH, lo + LENGTH - GRAM
    h = BYTE_VALUE[np.frombuffer(text, np.uint8, last + GRAM - first, first)]
    for k in (1, 2, 4, 8, 16):
        h = _doubled(h, k)
    return first + int(np.flatnonzero(mix(h) >> np.uint64(16) == np.uint64(gram))[0])


def bands(lo: int, size: int, anchor: int, width: int = BAND) -> Iterator[tuple[int, int, int, int]]:
    """(start, end) of the windows of each band, and of what they share: bands begin at fixed places before the anchor."""
    first, last = lo, lo + size - LENGTH
    for j in range((anchor - last) // width, (anchor - first) // width + 1):
        top, low = anchor - width * j, anchor - width * j - width + 1
        yield max(first, low), min(last, top) + LENGTH, top, low + LENGTH


def _cut_pieces(shards: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces as they are, or band by band where their anchor is hot; the value of a band is a hash of what its windows share."""
        unpack = zstandard.ZstdDecompressor()
        out = Folded(shards)
        for b in batches:
            for doc, blob, wanted in zip(*(b.column(c).to_pylist() for c in ("doc_id", "blob", "wanted")), strict=True):
                text = unpack.decompress(blob)
                for w in wanted:
                    lo, size, gram = w["lo"], w["size"], w["gram"]
                    if w["kind"] == 1:
                        out.rows.append((gram % shards, gram, doc, lo, size, text[lo : lo + size]))
                        continue
                    for start, end, x, y in bands(lo, size, anchor_in(text, lo, size, gram)):
                        # Values of bands are negative, so they meet no anchor's.
                        out.add(-1 - (xxhash.xxh64_intdigest(text[x:y]) >> 1), doc, start, text[start:end])
                out.close_document()
                yield from out.batches()
        yield from out.batches(1)

    return cut


def _cut_windows(shards: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Single windows of bands with very many contents."""
        out = Folded(shards)
        for b in batches:
            for doc, lo, piece in zip(*(b.column(c).to_pylist() for c in ("doc_id", "lo", "piece")), strict=True):
                for s in range(len(piece) - LENGTH + 1):
                    window = piece[s : s + LENGTH]
                    out.add(-1 - (xxhash.xxh64_intdigest(window) >> 1), doc, lo + s, window)
                out.close_document()
            yield from out.batches()
        yield from out.batches(1)

    return cut


RANGES = "doc_id long, lo long, size long"


def repeated_ranges(doc: list[int], lo: list[int], pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (document, start, end) that hold repeated windows of these pieces."""
    order = np.lexsort((np.array(lo, np.int64), np.array(doc, np.int64)))
    earliest: dict[bytes, int] = {}
    gone = [i for i in order if earliest.setdefault(pieces[i], i) != i]
    first = np.array(list(earliest.values()), np.int64)
    d, s = np.array(doc, np.int64), np.array(lo, np.int64)
    size = np.array([len(p) for p in pieces], np.int64)
    hit = RunLengthIndex(list(earliest)).repeated()
    start = np.cumsum(size[first] + 1) - size[first] - 1
    of = np.searchsorted(start, hit, "right") - 1
    begin = s[first[of]] + hit - start[of]
    gone = np.array(gone, np.int64)
    return merge_ranges(np.concatenate([d[first[of]], d[gone]]), np.concatenate([begin, s[gone]]), np.concatenate([begin + LENGTH, s[gone] + size[gone]]))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in the order of their values in; shards of SHARD bytes and more, whole values each."""
    held: list[tuple[int, int, bytes]] = []
    lost: list[tuple[int, int, int]] = []
    size, at = 0, None

    def rows(d: list, s: list, n: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (d, s, n)], names=["doc_id", "lo", "size"])

    def close() -> pa.RecordBatch:
        d, s, e = repeated_ranges(*map(list, zip(*held, strict=True)))
        held.clear()
        return rows(d, s, e - s)

    for b in batches:
        for gram, doc, lo, n, piece in zip(*(b.column(c).to_pylist() for c in ("gram", "doc_id", "lo", "size", "piece")), strict=True):
            if piece is None:
                lost.append((doc, lo, n))
                continue
            if size > SHARD and gram != at:
                yield close()
                size = 0
            at = gram
            held.append((doc, lo, piece))
            size += len(piece) + 1
        if lost:
            yield rows(*zip(*lost, strict=True))
            lost.clear()
    if held:
        yield close()


# -- the operator -------------------------------------------------------------------------------------------

KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _keep(with_text: bool):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for doc, blob, gone in zip(*(b.column(c).to_pylist() for c in ("doc_id", "blob", "gone")), strict=True):
                text = unpack.decompress(blob)
                packed = np.array(gone or [], np.int64)
                lo, size = packed >> 32, packed & 0xFFFFFFFF
                _, lo, end = merge_ranges(np.zeros(len(lo), np.int64), lo, lo + size)
                cuts = [0, *np.stack([lo, end], axis=1).reshape(-1).tolist(), len(text)]
                kept = b"".join(text[i:j] for i, j in zip(cuts[::2], cuts[1::2]))
                row = (doc, len(text), len(text) - len(kept), len(lo), hashlib.sha256(kept).hexdigest())
                rows.append((*row, kept) if with_text else row)
            if rows:
                types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)

    return keep


def remove_repeats(docs: DataFrame, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row; with_text adds kept (bytes)."""
    spark = docs.sparkSession
    owners = owners_of(docs)
    with Workspace(spark, "repeats") as ws:
        rows, own = keyed(ws, docs.withColumn("text", F.col("text").cast("string")), "doc_id", "text")
        texts = rows.select(F.col("row").alias("doc_id"), "text")
        zipped = texts.mapInArrow(_zipped, "doc_id long, blob binary")
        anchored = texts.mapInArrow(tidy(_anchor(owners)), "owner int, kind int, blob binary")
        owned = ws.keep(anchored.repartition(owners, "owner").sortWithinPartitions("owner", "kind").mapInArrow(tidy(_own(hot)), OWNED), "owned")
        wanted = lambda kind: owned.where(F.col("kind") == kind).groupBy("doc_id").agg(F.collect_list(F.struct("kind", "lo", "size", "gram")).alias("wanted"))
        cut = lambda kind: zipped.join(wanted(kind), "doc_id").select("doc_id", "blob", "wanted").mapInArrow(_cut_pieces(owners), PIECES)
        pieces = cut(1)
        if not owned.where("kind = 2").isEmpty():
            banded = ws.keep(cut(2), "bands")
            full = ws.keep(banded.where("piece is not null").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("gram"), "full")
            windows = banded.join(full, "gram", "left_semi").where("piece is not null").select("doc_id", "lo", "piece").mapInArrow(_cut_windows(owners), PIECES)
            pieces = pieces.union(banded.join(full, "gram", "left_anti")).union(windows)
        ordered = pieces.repartition(owners, "shard").sortWithinPartitions("shard", "gram")
        compared = ws.keep(ordered.select("gram", "doc_id", "lo", "size", "piece").mapInArrow(tidy(_compare), RANGES), "compared")
        ranges = owned.where("kind = 0").select("doc_id", "lo", "size").union(compared)
        gone = ranges.groupBy("doc_id").agg(F.collect_list(F.shiftleft("lo", 32) + F.col("size")).alias("gone"))
        found = zipped.join(gone, "doc_id", "left").select("doc_id", "blob", "gone").mapInArrow(_keep(with_text), KEPT + ", kept binary" * with_text)
        return ws.result(renamed(found, rows, own, "doc_id", "doc_id"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))
