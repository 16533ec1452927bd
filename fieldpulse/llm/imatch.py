"""I-Match fingerprints over several randomised lexicon subsets.

Terms are runs of letters, lower-cased.  The lexicon keeps terms whose share of documents lies within
``BAND`` (a band of inverse document frequency): very common terms say nothing, very rare ones change with every edit.
A signature takes the distinct lexicon terms of a text that fall in one random subset of the lexicon,
in sorted order, and hashes them; an edit that touches no term of the subset leaves it as it is.

Subsets come in scales: at scale ``k`` each of ``SUBSETS`` subsets holds a share of ``2**-k`` of the lexicon, chosen by a
seeded hash.  A text with about ``2**k`` lexicon terms uses the scales ``k - 1`` to ``k + 1``, so that a
subset holds about one of its terms; texts whose numbers of terms differ by less than a factor of four
share a scale.  Likeness compares the signatures at the finest shared scale: the share of
equal ones among subsets that are not empty on both sides, turned into an estimate of the shared terms.

Document frequencies of all documents are counted in a table of ``BUCKETS`` counters, indexed by the hash of the
term.  Its size does not grow with the corpus, and neither does its relative error: terms that
share a counter add about (terms per document) / ``BUCKETS`` to a share.

Edge cases: a text without any lexicon term uses all its terms; one without terms uses its
characters, so equal texts always have equal fingerprints, null counts as empty and empty texts are
alike; ids may be null or repeated (order then goes by a hash of the text); an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan

BUCKETS = 1 << 20
BAND = (0.002, 0.05)
SUBSETS = 64
MAX_SCALE = 30
#: Counters that travel in one packed row.
SLOTS = 1 << 14
#: Tasks whose counters are summed together, before the sums are.
FAN_IN = 1 << 10

_SEEDS = scan.mix(np.arange(1, SUBSETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms and the first term of each text."""
    words = scan.words(pc.utf8_lower(pc.fill_null(texts, "")), scan.NO_LETTER)
    return words.hashes(), words.first


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - 20)).astype(np.int64)


def document_frequencies(docs: DataFrame, text: str = "text", fan_in: int = FAN_IN) -> tuple[np.ndarray, int]:
    """Counters of documents by hash of the term (``BUCKETS`` of them), and the number of documents.

    Every task sends one packed row per slot. They are summed in two steps, ``fan_in`` tasks at a time
    first, so that no group holds a row of every task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs_seen = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            texts = batch.column(0)
            docs_seen += len(texts)
            for lo, hi in scan.pieces(texts):
                h, first = _terms(texts.slice(lo, hi - lo))
                text_of = np.repeat(np.arange(hi - lo), np.diff(first))
                pairs = np.unique((text_of.astype(np.int64) << 20) | _bucket(h))
                counts += np.bincount(pairs & (BUCKETS - 1), minlength=BUCKETS)
        cells = [counts[i: i + SLOTS].astype("<i8") for i in range(0, BUCKETS, SLOTS)]
        if docs_seen:
            part = TaskContext.get().partitionId() // fan_in
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(cells), pa.int32()), pa.array(range(len(cells)), pa.int32()),
                 pa.array([_pack(c) for c in cells], pa.binary()), pa.array([docs_seen] * len(cells), pa.int64())],
                ["part", "slot", "counts", "docs"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(_unpack(c.as_py()) for c in table.column("counts"))
        return pa.table({"part": table.column("part")[:1], "slot": table.column("slot")[:1], "counts": pa.array([_pack(total)], pa.binary()),
                         "docs": pa.array([pc.sum(table.column("docs")).as_py()], pa.int64())})

    schema = "part int, slot int, counts binary, docs bigint"
    few = docs.select(text).mapInArrow(count, schema).groupBy("part", "slot").applyInArrow(add, schema)
    rows = few.groupBy("slot").applyInArrow(add, schema).collect()
    counts = np.zeros(BUCKETS, np.int64)
    for r in rows:  # bounded: BUCKETS counters
        counts[r["slot"] * SLOTS: (r["slot"] + 1) * SLOTS] = _unpack(r["counts"])
    return counts, rows[0]["docs"] if rows else 0


def _pack(counts: np.ndarray) -> bytes:
    """Counters in as few bytes as the largest needs; the first byte tells the width."""
    width = next(w for w in (1, 2, 4, 8) if counts.max(initial=0) < 1 << (8 * w - 1))
    return bytes([width]) + counts.astype(f"<i{width}").tobytes()


def _unpack(cell: bytes) -> np.ndarray:
    return np.frombuffer(cell, f"<i{cell[0]}", offset=1).astype(np.int64)


class Lexicon:
    """Terms within the band, by counter."""

    def __init__(self, counts: np.ndarray, docs: int, band: tuple[float, float] = BAND):
        share = counts / max(docs, 1)
        self.inside = (share >= band[0]) & (share <= band[1])

    def fingerprints(self, texts: pa.Array) -> list[str]:
        """One fingerprint per text: ``scale:signatures.signatures.signatures`` in hexadecimal."""
        out: list[str] = []
        for lo, hi in scan.pieces(texts):
            part = texts.slice(lo, hi - lo)
            h, first = _terms(part)
            for i in range(hi - lo):
                own = np.unique(h[first[i]: first[i + 1]])
                kept = own[self.inside[_bucket(own)]]
                if not len(kept):
                    kept = own
                if not len(kept):
                    kept = np.array([xxhash.xxh64_intdigest(part[i].as_py() or "")], np.uint64)
                out.append(signatures(kept))
        return out


def _scales(scale: int) -> range:
    return range(max(0, scale - 1), scale + 2)


def signatures(terms: np.ndarray) -> str:
    """The fingerprint of sorted distinct term hashes."""
    scale = min(MAX_SCALE, int(len(terms)).bit_length() - 1)
    draws = scan.mix(terms[:, None] ^ _SEEDS[None, :])  # each subset orders the lexicon in its own way
    sets = []
    for k in _scales(scale):
        inside = draws < np.uint64(min((1 << 64) - 1, 1 << (64 - k)))
        # the terms are distinct and sorted, so a sum of their mixed hashes stands for the sequence
        total = np.where(inside, scan.mix(draws ^ np.uint64(0x5851F42D4C957F2D)), np.uint64(0)).sum(axis=0, dtype=np.uint64)
        some = inside.any(axis=0)
        sets.append(np.where(some, 1 + (scan.mix(total) >> np.uint64(56)) % np.uint64(255), 0).astype(np.uint8))
    return f"{scale:02x}:" + ".".join(s.tobytes().hex() for s in sets)


def likeness(a: str, b: str) -> float:
    """Estimated share of lexicon terms that two texts have in common, 0 to 1; equal fingerprints: 1."""
    if a == b:
        return 1.0
    (ka, sa), (kb, sb) = ((int(x[:2], 16), x[3:].split(".")) for x in (a, b))
    k = min(ka, kb) + 1  # the finest scale both have, if any
    if k not in _scales(max(ka, kb)):
        return 0.0
    x, y = (np.frombuffer(bytes.fromhex(s[_scales(own).index(k)]), np.uint8) for s, own in ((sa, ka), (sb, kb)))
    some = (x > 0) | (y > 0)
    if not some.any():
        return 0.0
    # with r terms of the union per subset, a share J in common: empty exp(-r), equal exp(-r (1 - J))
    empty, same = np.mean(~some), np.mean(x == y)
    rate = -np.log(max(empty, 0.5 / len(x)))
    return float(min(1.0, max(0.0, 1.0 + np.log(max(same, 1e-9)) / max(rate, 1e-9))))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 band: tuple[float, float] = BAND) -> DataFrame:
    """``(key, fingerprint)`` of every row."""
    lexicon = Lexicon(*document_frequencies(docs, text), band)
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(lexicon.inside))  # BUCKETS bits
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = restored(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(own.fingerprints(batch.column(1)), pa.string())], ["key", "fingerprint"])

    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(
        run, f"key {kind}, fingerprint string").withColumnRenamed("key", key)


def restored(bits: np.ndarray) -> Lexicon:
    out = Lexicon.__new__(Lexicon)
    out.inside = np.unpackbits(bits, count=BUCKETS).astype(bool)
    return out


# -- comparison with edited and following texts ----------------------------------------------------

def _in_order(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """``(slice, id, text, head)``: rows in slices that ascend with the key, each slice closed by the
    first row of the next one that holds any (``head``), the last by the very first row.

    Borders are approximate percentiles of the key, one per shuffle partition; they only balance
    the work. Rows without a key come first, by the hash of their text, in as many slices of equal width.
    """
    spark = docs.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs[key].cast("bigint").alias("id"), docs[text].alias("text"))
    cuts = rows.agg(F.percentile_approx("id", [i / slices for i in range(1, slices)] or [0.5], 10_000)).first()[0]
    cuts = sorted(set(cuts or []))
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("id"))) if cuts else F.lit(0)
    share = F.xxhash64("text").cast("double") / F.lit(2.0 ** 64) + F.lit(0.5)
    nameless = F.least(F.floor(share * slices), F.lit(slices - 1)).cast("int") - slices  # below all others
    rows = rows.withColumn("slice", F.when(F.col("id").isNull(), nameless).otherwise(place))
    least = F.min(F.struct("id", F.xxhash64("text").alias("x")))
    firsts = rows.groupBy("slice").agg(least.alias("first")).orderBy("slice").collect()  # one row per slice
    heads = [(now["slice"], *after["first"]) for now, after in zip(firsts, firsts[1:] + firsts[:1])]
    if not heads:
        return rows.withColumn("head", F.lit(False)), slices
    ends = F.broadcast(spark.createDataFrame(heads, "to int, first bigint, x bigint"))
    borrowed = (
        rows.join(ends, rows["id"].eqNullSafe(F.col("first")) & (F.xxhash64("text") == F.col("x")))
        .select("id", "text", F.col("to").alias("slice"))
        .dropDuplicates(["slice"]).select("id", "text", "slice", F.lit(True).alias("head")))
    return rows.withColumn("head", F.lit(False)).unionByName(borrowed), slices


def compare_edits(docs: DataFrame, key: str = "doc_id", text: str = "text",
                  band: tuple[float, float] = BAND) -> DataFrame:
    """``(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.

    The edited text has its last quarter of code points replaced by as many (or all) first ones of the
    next document, ascending key; after the last comes the first.  Rows stream through a task in order, a
    bounded number of characters at a time.
    """
    lexicon = Lexicon(*document_frequencies(docs, text), band)
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(lexicon.inside))
    rows, slices = _in_order(docs, key, text)
    own_task = F.pmod(F.col("slice"), F.lit(slices))  # slice i and, of rows without a key, slice i - slices
    ordered = rows.repartitionById(slices, own_task.cast("int")).sortWithinPartitions("slice", "head", "id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = restored(shared.value)

        def compared(held: list[tuple], first: list[str]) -> tuple[pa.RecordBatch, list[str]]:
            """All rows but the last with their successors; and the fingerprint of the last."""
            prints = first + own.fingerprints(pa.array([t for _, t, _ in held[len(first):]], pa.string()))
            kept, edited = [], []
            for k, (now, after) in enumerate(zip(held, held[1:])):
                if now[2] == after[2]:
                    cut = len(now[1]) // 4
                    kept.append(k)
                    edited.append(now[1][: len(now[1]) - cut] + after[1][:cut])
            changed = own.fingerprints(pa.array(edited, pa.string()))
            return pa.RecordBatch.from_arrays([
                pa.array([held[k][0] for k in kept], pa.int64()),
                pa.array([len(held[k][1]) for k in kept], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                pa.array([prints[k] for k in kept], pa.string()), pa.array(changed, pa.string()),
                pa.array([likeness(prints[k], c) for k, c in zip(kept, changed)], pa.float64()),
                pa.array([likeness(prints[k], prints[k + 1]) for k in kept], pa.float64()),
            ], _COMPARED_NAMES), prints[-1:]

        held, first, size = [], [], 0
        for batch in batches:
            for i, t, s in zip(batch.column("id"), batch.column("text"), batch.column("slice")):
                held.append((i.as_py(), t.as_py() or "", s.as_py()))
                size += len(held[-1][1])
                if size > scan.PIECE_BYTES and len(held) > 1:
                    out, first = compared(held, first)
                    held, size = held[-1:], 0
                    yield out
        if held:
            yield compared(held, first)[0]

    return ordered.mapInArrow(run, _COMPARED).withColumnRenamed("id", key)


_COMPARED = ("id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")
_COMPARED_NAMES = [c.split()[0] for c in _COMPARED.split(", ")]
