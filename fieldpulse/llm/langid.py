"""Language of a text: averaged hashed subword embeddings and a linear softmax.

Subwords are 2, 3 and 4 bytes of the lower-cased UTF-8 text in which everything that is no letter has become one
blank, so that beginnings and ends of words show.  Each is hashed to one of ``BUCKETS`` vectors of ``SIZE``
numbers; a text is the mean of its vectors, and a linear softmax over it gives the languages.  Both layers are
trained by stochastic gradient descent in numpy.  A temperature, fitted on documents that the descent
did not see, makes the probabilities honest; below ``reject`` (the lowest score at which those
documents were right in ``PRECISION`` of the cases) a prediction is marked as not accepted.

Training takes at most ``MAX_ROWS`` documents and ``PER_LANG`` of every language, chosen by a hash of the id, with at
most ``MAX_BYTES`` of text in all, and runs in one task.  An id of many rows gives one text.  Prediction reads every text in full; both
layers fold into one table of languages per bucket.

Edge cases: a text that is null or has no letter is ``und`` with score 0 and not accepted; rows with
a null language are not trained on; rows without an id are predicted and not trained on; without any
training row every language is ``und``; repeated rows are predicted one by one; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import top_rows
from ..session import materialise
from . import scan
from .sample import MAX_BYTES, within

MAX_ROWS = 6_000
#: So many documents of every language are in the sample, however rare it is.
PER_LANG = 300
#: Partitions whose first ids of a language are ranked together, before all are.
FAN_IN = 1 << 10
BUCKETS = 1 << 16
SIZE = 16
LENGTHS = (2, 3, 4)
EPOCHS = 3
#: One in so many training rows only serves the temperature and the limit of rejection.
CALIBRATION = 5
PRECISION = 0.99
UNKNOWN = "und"

_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[scan.NO_LETTER] = 32


def _subwords(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords and the text of each."""
    data, offsets = scan.text_bytes(pc.utf8_lower(pc.fill_null(texts, "")))
    # a blank before every text keeps neighbours apart
    text = np.repeat(np.arange(len(texts)), np.diff(offsets) + 1)
    padded = np.full(len(data) + len(texts), 32, np.uint8)
    padded[np.arange(len(data)) + np.repeat(np.arange(1, len(texts) + 1), np.diff(offsets))] = _BLANK[data]
    double = np.zeros(len(padded), bool)
    double[1:] = (padded[1:] == 32) & (padded[:-1] == 32) & (text[1:] == text[:-1])
    padded, text = padded[~double].astype(np.uint32), text[~double]
    found, owner = [], []
    for k in LENGTHS:
        n = max(0, len(padded) - k + 1)
        value = np.full(n, k, np.uint32)
        for j in range(k):
            value = value * np.uint32(257) + padded[j: j + n]
        value = (value ^ (value >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        value = (value ^ (value >> np.uint32(12))) * np.uint32(0x297A2D39)
        inside = text[:n] == text[k - 1: k - 1 + n] if n else np.zeros(0, bool)
        found.append(((value ^ (value >> np.uint32(15))) & np.uint32(BUCKETS - 1))[inside])
        owner.append(text[:n][inside])
    return np.concatenate(found).astype(np.int64), np.concatenate(owner)


class Model:
    """One row of language scores per bucket, the temperature and the limit of rejection."""

    def __init__(self, langs: list[str], table: np.ndarray, offset: np.ndarray, scale: float = 1.0,
                 reject: float = 0.0):
        self.langs, self.table, self.offset, self.scale, self.reject = langs, table, offset, scale, reject

    def logits(self, texts: pa.Array) -> np.ndarray:
        """Scores of all languages before the softmax."""
        out = np.zeros((len(texts), len(self.langs)))
        for lo, hi in scan.pieces(texts):
            at, owner = _subwords(texts.slice(lo, hi - lo))
            n = np.maximum(np.bincount(owner, minlength=hi - lo), 1)
            for k in range(len(self.langs)):
                out[lo:hi, k] = np.bincount(owner, self.table[k][at], minlength=hi - lo) / n
        return out + self.offset

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        some = pc.match_substring_regex(pc.fill_null(texts, ""), r"\p{L}").to_numpy(zero_copy_only=False)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        p = _softmax(self.logits(texts) * self.scale)
        best = p.argmax(axis=1)
        return ([self.langs[b] if s else UNKNOWN for b, s in zip(best, some)],
                np.where(some, p[np.arange(len(p)), best], 0.0))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: pa.Array, langs: list[str], held: np.ndarray) -> Model:
    """Train on whole texts; rows marked in ``held`` only calibrate."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((0, BUCKETS)), np.zeros(0))
    y = np.searchsorted(names, langs)
    docs = []  # distinct buckets of each text with their shares
    for lo, hi in scan.pieces(texts):
        at, owner = _subwords(texts.slice(lo, hi - lo))
        key, counts = np.unique(owner * BUCKETS + at, return_counts=True)
        cut = np.searchsorted(key, np.arange(hi - lo + 1) * BUCKETS)
        for a, b in zip(cut, cut[1:]):
            docs.append((key[a:b] % BUCKETS, counts[a:b] / max(counts[a:b].sum(), 1)))
    rng = np.random.default_rng(0)
    vectors = rng.normal(0, 0.1, (BUCKETS, SIZE))
    weights, offset = rng.normal(0, 0.1, (SIZE, len(names))), np.zeros(len(names))
    train = np.flatnonzero(~held) if (~held).any() else np.arange(len(y))
    steps = EPOCHS * len(train)
    step = 0
    for _ in range(EPOCHS):
        for i in rng.permutation(train):
            rate = 1.0 * (1 - step / steps)
            step += 1
            at, share = docs[i]
            mean = share @ vectors[at]
            g = _softmax((mean @ weights + offset)[None, :])[0]
            g[y[i]] -= 1.0
            back = weights @ g
            weights -= rate * np.outer(mean, g)
            offset -= 0.1 * rate * g
            # a text has hundreds of subwords, each with a small share: their steps are scaled up
            vectors[at] -= rate * np.minimum(share * 100.0, 1.0)[:, None] * back[None, :]
    model = Model(names, np.ascontiguousarray((vectors @ weights).T), offset)
    rows = np.flatnonzero(held) if held.any() else train
    logits = model.logits(texts.take(pa.array(rows)))
    scales = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(_softmax(logits * s)[np.arange(len(rows)), y[rows]], 1e-12)).mean() for s in scales]
    model.scale = float(scales[int(np.argmin(loss))])
    p = _softmax(logits * model.scale)
    order = np.argsort(-p.max(axis=1), kind="stable")
    right = np.cumsum(p.argmax(axis=1)[order] == y[rows][order]) / np.arange(1, len(rows) + 1)
    good = np.flatnonzero(right >= PRECISION)
    model.reject = float(p.max(axis=1)[order][good[-1]]) if len(good) else 1.0
    return model


def train(docs: DataFrame, use: Column | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang",
          max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, per_lang: int = PER_LANG) -> Model:
    """Fit on a bounded sample; ``use`` is a condition on the key column.

    The sample has the first ``max_rows`` ids in the order of a hash, and the first ``per_lang`` of every language, which come
    first where ``max_bytes`` is short, so a rare language is learned however large the rest is.  Both lists are
    exact, and no task ranks more than the first ids of ``FAN_IN`` others: languages are ranked among neighbouring
    partitions first.
    """
    eligible = docs.where(F.col(key).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull())
    if use is not None:
        eligible = eligible.where(use)
    order = F.xxhash64(F.col(key).cast("string"))
    known = eligible.select(F.col(key), F.col(lang).alias("_lang"), order.alias("_order")).distinct()
    known = materialise(known)
    least = known.withColumn("_part", F.floor(F.spark_partition_id() / FAN_IN))
    for groups in (["_lang", "_part"], ["_lang"]):
        place = F.row_number().over(Window.partitionBy(*groups).orderBy("_order", key))
        least = least.withColumn("_place", place).where(F.col("_place") <= per_lang).drop("_place")
    least = least.select(key, "_lang", "_order", F.lit(0).alias("_late"))
    first = top_rows(known, [F.asc("_order"), F.asc(key), F.asc("_lang")], max_rows).withColumn("_late", F.lit(1))
    ids = materialise(least.union(first).groupBy(key, "_lang", "_order").agg(F.min("_late").alias("_late")))
    rows = docs.select(F.col(key), F.col(text).alias("_text"), F.col(lang).alias("_lang")).join(ids, [key, "_lang"])
    single = materialise(rows.where(F.col("_text").isNotNull()).groupBy(F.col("_order").alias("order")).agg(
        F.min(F.struct("_lang", "_text", "_late")).alias("one")))
    sample = within(single.select("order", F.col("one._late").alias("late"), F.col("one._text").alias("text"),
                                  F.col("one._lang").alias("lang")), ["late", "order"], max_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [pa.Table.from_batches([b]) for b in batches]
        if not tables:
            return
        table = pa.concat_tables(tables).sort_by([("order", "ascending")])
        held = (np.arange(table.num_rows) % CALIBRATION) == 0
        if table.num_rows < 5 * CALIBRATION:
            held[:] = False
        model = fit(scan.column(table, "text"), table.column("lang").to_pylist(), held)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    found = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else Model([], np.zeros((0, BUCKETS)), np.zeros(0))


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, lang_pred, score, accepted)`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # BUCKETS numbers per language
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shared.value)
        for batch in batches:
            langs, scores = own.predict(batch.column(1))
            accepted = [s >= own.reject and lang != UNKNOWN for lang, s in zip(langs, scores)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores), pa.array(accepted, pa.bool_())],
                ["key", "lang_pred", "score", "accepted"])

    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(
        run, f"key {kind}, lang_pred string, score double, accepted boolean").withColumnRenamed("key", key)
