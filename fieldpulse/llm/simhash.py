r"""SimHash near-duplicates through anchor points.

Fingerprint: A-Z lower-cased, words ``[^\x20\x09-\x0D]+``, shingles of three words (all words of a
shorter text), XXH64 of each shingle with seed 42; a bit is set when it is set in over half
of them.  Two fingerprints link when at most two bits differ.

Links: anchors are the words of a covering code.  The code is the product of two perfect Golay
codes [23, 12] over bits 0-22 and 23-45: each 23-bit block lies within 3 bits of exactly
one code word, so every fingerprint has one home anchor within the covering radius of 6.  A
fingerprint that differs from it in two bits at most lies within 6 + 2 bits of that anchor; so each
fingerprint is also sent to every anchor within reach of two changed bits (about 62 of 2**24),
and per anchor those at home are compared with those sent.  No link can be lost, and only distinct
fingerprints take part: copies of a text never meet each other.

Edge cases: a null, empty or blank text has fingerprint zero and links like any other; a null
``doc_id`` gets a fingerprint and the component of that fingerprint, whose id is the
smallest ``doc_id`` that is not null; repeated rows are kept and share their component; an empty table
gives an empty result; other columns are ignored.  Long texts are hashed in slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .components import components
from .near import copy_of, first_rows

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: Shingles whose bits are counted at once.
SLICE = 1 << 14

BLOCK = 23
BLOCKS = 2
#: Generator polynomial of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101


# -- fingerprints ----------------------------------------------------------------------------------

def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of one text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, SLICE):
        part = words[at: min(n, at + SLICE) + SHINGLE - 1]
        if len(words) < SHINGLE:
            hashes = [digest(join(part), SEED)]
        else:
            hashes = [digest(join(s), SEED) for s in zip(part, part[1:], part[2:])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, fp)`` of every row; ``fp`` is the fingerprint as a signed 64-bit integer."""
    kind = docs.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["key", "fp"])

    return (
        docs.select(docs[key].alias("key"), docs[text].alias("text"))
        .mapInArrow(scan, f"key {kind}, fp bigint").withColumnRenamed("key", key))


# -- anchors ---------------------------------------------------------------------------------------

def _syndrome(v: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit polynomials modulo the generator: 11 bits."""
    v = v.copy()
    for bit in range(BLOCK - 1, 10, -1):
        v ^= np.where(v >> bit & 1, GOLAY << (bit - 11), 0)
    return v


def _flips(weight: int) -> np.ndarray:
    """All 23-bit words with that many ones (up to three)."""
    one = [1 << i for i in range(BLOCK)]
    if weight == 0:
        return np.array([0])
    if weight == 1:
        return np.array(one)
    lower = _flips(weight - 1)
    return np.unique([a | b for a in lower for b in one if not a & b])


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, list[list[np.ndarray]]]:
    """Of each syndrome: the error, its weight, and the steps to anchors at home to words with 0, 1, 2
    changed bits (without those reached by fewer).

    The code is perfect, so the number of steps depends on the weight alone: ``steps[w][weight]`` has one
    row per syndrome; rows of other weights are not filled.
    """
    errors = np.zeros(1 << 11, np.int64)
    weights = np.zeros(1 << 11, np.int64)
    for weight in range(4):
        words = _flips(weight)
        errors[_syndrome(words)] = words
        weights[_syndrome(words)] = weight
    flips = [_flips(w) for w in range(MAX_BITS + 1)]
    marks = [_syndrome(f) for f in flips]
    steps: list[list[np.ndarray]] = [[None] * 4 for _ in flips]
    for s in range(1 << 11):
        seen = np.zeros(0, np.int64)
        for w, (f, m) in enumerate(zip(flips, marks)):
            reached = np.setdiff1d(f ^ errors[s ^ m], seen)
            if steps[w][weights[s]] is None:
                steps[w][weights[s]] = np.zeros((1 << 11, len(reached)), np.int64)
            steps[w][weights[s]][s] = reached
            seen = np.union1d(seen, reached)
    return errors, weights, steps


def _blocks(fps: np.ndarray) -> list[np.ndarray]:
    return [(fps >> np.uint64(BLOCK * i)).astype(np.int64) & ((1 << BLOCK) - 1) for i in range(BLOCKS)]


def home_anchors(fps: np.ndarray) -> np.ndarray:
    """The anchor that covers each fingerprint."""
    errors = _tables()[0]
    low, high = (b ^ errors[_syndrome(b)] for b in _blocks(fps))
    return high << BLOCK | low


def near_anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, anchor)``: the home anchors of all fingerprints within ``MAX_BITS`` of each."""
    _, weights, steps = _tables()
    low, high = _blocks(fps)
    of_low, of_high = _syndrome(low), _syndrome(high)
    rows, anchors = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(4):
        for j in range(4):
            at = np.flatnonzero((weights[of_low] == i) & (weights[of_high] == j))
            for v in range(MAX_BITS + 1):
                lows = low[at, None] ^ steps[v][i][of_low[at]]
                for w in range(MAX_BITS + 1 - v):
                    highs = high[at, None] ^ steps[w][j][of_high[at]]
                    pairs = highs[:, :, None] << BLOCK | lows[:, None, :]
                    anchors.append(pairs.ravel())
                    rows.append(np.repeat(at, pairs.shape[1] * pairs.shape[2]))
    return np.concatenate(rows), np.concatenate(anchors)


def near_links(distinct: DataFrame) -> DataFrame:
    """``(a, b)``, ``a < b``: all pairs of the distinct fingerprints ``fp`` with at most two different bits."""

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(home_anchors(fps)), batch.column(0)], ["anchor", "a"])

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fps), SLICE):
                rows, anchors = near_anchors(fps[at: at + SLICE])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors), pa.array(fps[at + rows].view(np.int64))], ["anchor", "b"])

    at_home = distinct.select("fp").mapInArrow(homes, "anchor bigint, a bigint")
    sent = distinct.select("fp").mapInArrow(copies, "anchor bigint, b bigint")
    differing = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    # Spark sizes the copies like the fingerprints they come from, some sixty times too low, and would send them to the driver.
    return at_home.join(sent.hint("merge"), "anchor").where((F.col("a") < F.col("b")) & (differing <= MAX_BITS)).select("a", "b")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, copy, fp, root)`` of every row; ``copy`` is a hash of the text."""
    hashed = docs.select(F.struct(F.col(key).alias("key"), copy_of(F.col(text)).alias("copy")).alias("row"), F.col(text).alias("text"))
    own = materialise(fingerprints(hashed, "row", "text").select("row.key", "row.copy", "fp"))
    links = components(near_links(own.select("fp").distinct()))
    return own.join(links, own["fp"] == links["node"], "left").select(
        "key", "copy", "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, fp, component_id)``: the smallest key that can be reached over links."""
    own = materialise(fingerprints(docs, key, text))
    distinct = materialise(own.groupBy("fp").agg(F.min(key).alias("least")))
    rooted = (
        distinct.join(components(near_links(distinct)), distinct["fp"] == F.col("node"), "left")
        .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(least, "root").select("fp", "component_id")
    return own.join(of_fp, "fp").select(key, "fp", "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group: that of the smallest key, then text hash.

    Rows of one key with different texts are judged one by one; of rows that repeat key and text one stays;
    rows without a key all stay.
    """
    return first_rows(docs, materialise(groups(docs, key, text)), key, text)
