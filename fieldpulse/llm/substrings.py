r"""Repeated passages through difference-cover anchors.

A window of ``size`` consecutive words ``[^\x20\x09-\x0D]+`` is old when the same words also start in a
document with a smaller id; every word that an old window covers is removed.

Anchors are shorter windows that are hashed only where their position, modulo ``PERIOD``, lies in a
difference cover {0, 1, 3} of 7: whatever two positions a passage has, some shift of 0 to 6 words
puts both on cover positions, so two equal windows of 13 words always share an anchor of 7.  Only
windows around anchors that occur in two documents are then hashed in full (96 bits, grown from the
anchor to the whole window) and compared.

Plan: documents are dealt once into chunks by a hash.  Each chunk sends its distinct anchors, one
packed row per hash range; a range tells every chunk which of them occur elsewhere; chunks do the same
with the windows around shared anchors and the smallest id that holds each; the answer
tells which are older elsewhere.  A passage in a third of all documents is thus sent once
per chunk.  Chunks and ranges have bounded size: their numbers follow the bytes of text.

Edge cases: null and empty texts have no words; a document without an id neither loses words nor makes
others lose any; equal ids are not smaller than each other, so repeated rows lose nothing to
each other; a document of fewer words than a window is kept; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan

PERIOD, COVER = 7, (0, 1, 3)
WINDOW = 13
#: Bytes of text of a chunk and of a hash range, on average.
CHUNK_BYTES = 2 << 20
RANGE_BYTES = 32 << 20

_LANES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_ANCHORS = "range int, chunk bigint, a binary, b binary, ids binary, shared binary"
_ANSWERS = "range int, chunk bigint, shared binary, older binary"


def _fits(words: scan.Words, size: int) -> np.ndarray:
    """Whether ``size`` words from each word on belong to one text (for all starts of ``scan.windows``)."""
    text = words.text_of()
    n = max(0, len(text) - size + 1)
    return text[:n] == text[size - 1: size - 1 + n]


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    """Range of each hash; ascending with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _flags(h: np.ndarray, packed: dict[int, bytes], ranges: int) -> np.ndarray:
    """Answers of all ranges put in the order of the sorted hashes."""
    out = np.zeros(len(h), bool)
    of, here = _range_of(h, ranges), np.array(list(packed), np.int64)
    firsts, ends = np.searchsorted(of, here), np.searchsorted(of, here, side="right")
    for first, end, bits in zip(firsts, ends, packed.values()):
        out[first:end] = np.unpackbits(np.frombuffer(bits, np.uint8), count=end - first).astype(bool)
    return out


class _Chunk:
    """The documents of one chunk, their anchors and windows; the same whatever the order of rows."""

    def __init__(self, docs: pa.Table, size: int):
        self.size = size
        self.words = scan.words(scan.column(docs, "text"), scan.SPACE)
        ids = scan.column(docs, "id")
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.hashes = self.words.hashes()
        text = self.words.text_of()
        step = size - PERIOD + 1
        place = np.arange(len(text)) - self.words.first[text]
        fits = _fits(self.words, step)
        on_cover = np.isin(place % PERIOD, COVER)[: len(fits)] & fits & self.known[text][: len(fits)]
        self.at = np.flatnonzero(on_cover)  # positions of anchors
        h = scan.windows(self.hashes, step)[self.at]
        self.anchor, self.of_anchor = np.unique(h, return_inverse=True)
        owner = text[self.at]
        low, high = np.full(len(self.anchor), len(self.ids)), np.full(len(self.anchor), -1)
        np.minimum.at(low, self.of_anchor, owner)
        np.maximum.at(high, self.of_anchor, owner)
        self.several = low < high  # anchors of two documents of this chunk

    def windows(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and two hashes of the windows that hold a shared anchor."""
        marks = np.zeros(len(self.hashes) + 1, np.int64)
        marks[self.at[shared[self.of_anchor]] + 1] = 1
        marks = np.cumsum(marks)
        fits = _fits(self.words, self.size)
        n = len(fits)
        start = np.flatnonzero(fits & (marks[PERIOD: PERIOD + n] > marks[:n])) if n else np.zeros(0, np.int64)
        lanes = [scan.windows(self.hashes, self.size, base)[start] for base in _LANES]
        return start, lanes[0], lanes[1].astype(np.uint32)

    def grouped(self, shared: np.ndarray) -> tuple[np.ndarray, ...]:
        """Distinct windows in order, their smallest id, and for every window its start, owner and group."""
        start, a, b = self.windows(shared)
        owner = self.ids[self.words.text_of()[start]]
        order = np.lexsort((owner, b, a))
        a, b, owner, start = a[order], b[order], owner[order], start[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return a[new], b[new], owner[new], start, owner, np.cumsum(new) - 1


def _rows(chunk: int, h: np.ndarray, ranges: int, **columns: np.ndarray) -> pa.Table:
    """One packed row per hash range in which ``h`` (ascending) has something.

    The work grows with the hashes, not with the number of ranges.
    """
    own, cuts = np.unique(_range_of(h, ranges), return_index=True)
    cuts = np.append(cuts, len(h))
    data = {"range": pa.array(own, pa.int32()), "chunk": pa.array([chunk] * len(own), pa.int64())}
    for name in ("a", "b", "ids", "shared"):
        if name in columns:
            cells = [columns[name][a:b] for a, b in zip(cuts, cuts[1:])]
            data[name] = pa.array([(np.packbits(c) if c.dtype == bool else c).tobytes() for c in cells], pa.binary())
        else:
            data[name] = pa.nulls(len(own), pa.binary())
    return pa.table(data)


def _joined(table: pa.Table, name: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """A packed column of all rows as one array, and where each row begins (one more at the end)."""
    cells = [np.frombuffer(c.as_py(), kind) for c in table.column(name)]
    return np.concatenate(cells), np.cumsum([0, *map(len, cells)])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW,
                   chunk_bytes: int = CHUNK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(key, n_words, n_removed, kept)``; ``kept`` has the words that stay, joined by one space."""
    if size < PERIOD:
        raise ValueError(f"windows have at least {PERIOD} words")
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text) + 16)).first()[0] or 0
    chunks, ranges = max(1, math.ceil(total / chunk_bytes)), max(1, math.ceil(total / range_bytes))
    dealt = docs.select(
        docs[key].cast("bigint").alias("id"), docs[text].alias("text"),
        F.pmod(F.xxhash64(docs[key], docs[text]), F.lit(chunks)).alias("chunk"))

    def send_anchors(table: pa.Table) -> pa.Table:
        own = _Chunk(table, size)
        return _rows(table.column("chunk")[0].as_py(), own.anchor, ranges, a=own.anchor, shared=own.several)

    def find_shared(table: pa.Table) -> pa.Table:
        h, cuts = _joined(table, "a", "<u8")
        order = np.argsort(h, kind="stable")
        same = np.zeros(len(h) + 1, bool)
        same[1:-1] = h[order][1:] == h[order][:-1]
        twice = np.empty(len(h), bool)
        twice[order] = same[1:] | same[:-1]
        out = []
        for i, bits in enumerate(table.column("shared")):
            n = cuts[i + 1] - cuts[i]
            several = np.unpackbits(np.frombuffer(bits.as_py(), np.uint8), count=n).astype(bool)
            out.append(np.packbits(twice[cuts[i]: cuts[i + 1]] | several).tobytes())
        # an anchor of one chunk is sent once, so equal ones come from two chunks
        return pa.table({"range": table.column("range"), "chunk": table.column("chunk"),
                         "shared": pa.array(out, pa.binary()), "older": pa.nulls(len(out), pa.binary())})

    def packed(answers: pa.Table, name: str) -> dict[int, bytes]:
        return {r.as_py(): c.as_py() for r, c in zip(answers.column("range"), answers.column(name)) if c.is_valid}

    def send_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows(0, np.zeros(0, np.uint64), ranges)
        chunk, own, shared = table.column("chunk")[0].as_py(), _Chunk(table, size), packed(answers, "shared")
        a, b, ids, *_ = own.grouped(_flags(own.anchor, shared, ranges))
        rows = _rows(chunk, a, ranges, a=a, b=b, ids=ids)
        # the answers on anchors travel on with the windows: the last step needs both
        here = rows.column("range").to_pylist()
        rows = rows.set_column(5, "shared", pa.array([shared.pop(r, None) for r in here], pa.binary()))
        left = [(r, c) for r, c in sorted(shared.items())]
        if not left:
            return rows
        return pa.concat_tables([rows, pa.table({
            "range": pa.array([r for r, _ in left], pa.int32()), "chunk": pa.array([chunk] * len(left), pa.int64()),
            **{name: pa.array([b""] * len(left), pa.binary()) for name in ("a", "b", "ids")},
            "shared": pa.array([c for _, c in left], pa.binary())})])

    def find_older(table: pa.Table) -> pa.Table:
        (a, cuts), (b, _), (ids, _) = (_joined(table, n, k) for n, k in (("a", "<u8"), ("b", "<u4"), ("ids", "<i8")))
        order = np.lexsort((ids, b, a))
        new = np.ones(len(a), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        least = ids[order][new][np.cumsum(new) - 1] if len(a) else ids
        older = np.empty(len(a), bool)
        older[order] = least < ids[order]
        out = [np.packbits(older[cuts[i]: cuts[i + 1]]).tobytes() for i in range(table.num_rows)]
        return pa.table({"range": table.column("range"), "chunk": table.column("chunk"),
                         "shared": table.column("shared"), "older": pa.array(out, pa.binary())})

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        own = _Chunk(table, size)
        words, gone = own.words, np.zeros(len(own.hashes) + 1, np.int64)
        if table.num_rows:
            a, _, ids, start, owner, group = own.grouped(_flags(own.anchor, packed(answers, "shared"), ranges))
            old = start[_flags(a, packed(answers, "older"), ranges)[group] | (owner > ids[group])]
            np.add.at(gone, old, 1)
            np.add.at(gone, old + size, -1)
        gone = np.cumsum(gone)[:-1] > 0
        kept, removed = [], []
        data = words.data.tobytes()
        for i in range(table.num_rows):
            lost = gone[words.first[i]: words.first[i + 1]]
            own_words = data[words.offsets[i]: words.offsets[i + 1]].split()
            kept.append(b" ".join(compress(own_words, ~lost) if lost.any() else own_words))
            removed.append(int(lost.sum()))
        return pa.table({
            "id": scan.column(table, "id"), "n_words": pa.array(np.diff(words.first).astype(np.int64)),
            "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    anchors = dealt.groupBy("chunk").applyInArrow(send_anchors, _ANCHORS)
    shared = anchors.groupBy("range").applyInArrow(find_shared, _ANSWERS)
    windows = dealt.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(send_windows, _ANCHORS)
    older = windows.groupBy("range").applyInArrow(find_older, _ANSWERS)
    out = dealt.groupBy("chunk").cogroup(older.groupBy("chunk")).applyInArrow(
        cut, "id bigint, n_words bigint, n_removed bigint, kept string")
    return out.withColumnRenamed("id", key)
