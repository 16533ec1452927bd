"""Toxic documents by multiple-instance learning over sentences.

A sentence ends at ``. ! ?`` or a line break.  Its score is a logistic function of the sum of weights of
its words' features; a document is toxic when any sentence is, so its score is the noisy-or
``1 - prod(1 - p_sentence)``.  Only document labels are known: the weights are trained through the
noisy-or, and afterwards the sentence scores tell where the offence is.

Features of a word (letters, lower-cased): the word and its first 5, 6 and 7 bytes, each counted once per
sentence.  Candidates are features that are more frequent in toxic documents than chance allows among so many
features; their weights start from the log odds and are refined by stochastic gradient descent on
the document likelihood.

Training takes at most ``MAX_POSITIVE`` toxic and ``MAX_NEGATIVE`` other labelled documents, chosen by a hash of
the id, with at most ``MAX_BYTES`` of text in all, and runs in one task.  An id of many rows gives one text.
Scoring covers all documents in full.

Edge cases: a null or empty text has no sentence and score 0; rows without an id are scored and not
trained on; labels that are null are ignored; of repeated labels for an id the largest counts; without
labels of both kinds every score is 0; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import scan
from .sample import MAX_BYTES, within

MAX_POSITIVE = 3_000
MAX_NEGATIVE = 6_000
PREFIXES = (5, 6, 7)
THRESHOLD = 0.7
#: Log odds from which a feature counts as a candidate, and the counts added to both sides of the odds.
MIN_ODDS = 1.0
SMOOTH = 0.5
EPOCHS = 6
RATE = 0.5
#: Pull of a weight back to its log odds.
DECAY = 1e-4
#: Documents of one gradient step.
STEP_DOCS = 64
#: Start of the sentence score: a sentence without any known word is hardly ever toxic.
BIAS = -9.0

_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[list(b".!?\n")] = True


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, scan.Words]:
    """``(feature, sentence, text of each sentence, words)``; the features of word ``i`` stand at ``i``,
    ``i + n``, ...; 0 where a prefix would be the whole word."""
    lowered = pc.utf8_lower(pc.fill_null(texts, ""))
    words = scan.words(lowered, scan.NO_LETTER)
    sums = words.sums()
    feats = [words.ranges(sums, words.start, words.end)]
    for k in PREFIXES:
        longer = words.end - words.start > k
        own = words.ranges(sums, words.start, np.minimum(words.start + k, words.end))
        feats.append(np.where(longer, own ^ np.uint64(k), np.uint64(0)))
    # sentences are numbered by the breaks before them; a text begins a sentence of its own
    breaks = np.cumsum(_SENTENCE_END[words.data]) if len(words.data) else np.zeros(0, np.int64)
    text = words.text_of()
    mark = breaks[words.start] + text if len(words.start) else np.zeros(0, np.int64)
    new = np.ones(len(mark), bool)
    new[1:] = (mark[1:] != mark[:-1]) | (text[1:] != text[:-1])
    sentence = np.cumsum(new) - 1
    return np.concatenate(feats), sentence, text[new], words


class Model:
    """Weights of known features, found by search; a table of slots by the low bits of the hash sorts out most others."""

    SLOT_BITS = 20

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(-np.abs(weights), kind="stable")
        self.features, self.weights, self.bias = features[order], weights[order], bias
        self._index()

    def _index(self) -> None:
        self.slots = np.zeros(1 << self.SLOT_BITS, bool)
        self.slots[(self.features & np.uint64((1 << self.SLOT_BITS) - 1)).astype(np.int64)] = True
        self.order = np.argsort(self.features, kind="stable")
        self.sorted = self.features[self.order]

    def __getstate__(self):
        return {"features": self.features, "weights": self.weights, "bias": self.bias}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._index()

    def find(self, feats: np.ndarray) -> np.ndarray:
        """Number of each feature, -1 for unknown ones."""
        out = np.full(len(feats), -1, np.int64)
        may = np.flatnonzero(self.slots[(feats & np.uint64((1 << self.SLOT_BITS) - 1)).astype(np.int64)])
        if not len(may):
            return out
        at = np.minimum(np.searchsorted(self.sorted, feats[may]), len(self.sorted) - 1)
        out[may] = np.where(self.sorted[at] == feats[may], self.order[at], -1)
        return out

    def sentence_scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, scan.Words]:
        """``(score, text, sentence of each word, words)``."""
        feats, sentence, text, words = _features(texts)
        at = self.find(feats)
        known = np.flatnonzero(at >= 0)
        # a feature counts once per sentence
        pairs = np.unique(sentence[known % max(len(sentence), 1)] * len(self.features) + at[known])
        total = np.bincount(pairs // max(len(self.features), 1), self.weights[pairs % max(len(self.features), 1)],
                            minlength=len(text))
        return _logistic(total + self.bias), text, sentence, words

    def document_scores(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        if not len(self.features):
            return out
        for lo, hi in scan.pieces(texts):
            score, text, *_ = self.sentence_scores(texts.slice(lo, hi - lo))
            clean = np.bincount(text, np.log1p(-np.minimum(score, 1 - 1e-12)), minlength=hi - lo)
            out[lo:hi] = -np.expm1(clean)
        return out


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _distinct(keys: np.ndarray, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(key, feature)`` pairs."""
    names, number = np.unique(feats, return_inverse=True)
    pairs = np.unique(keys * max(len(names), 1) + number)
    return pairs // max(len(names), 1), names[pairs % max(len(names), 1)]


def _candidates(texts: pa.Array, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features that speak for toxic documents, in order, and their log odds.

    The unit is the distinct sentence, so that copies of a document count once; a sentence that a
    clean document has is clean.
    """
    marks, labels = [], []
    for lo, hi in scan.pieces(texts):
        feats, sentence, text, words = _features(texts.slice(lo, hi - lo))
        first = np.searchsorted(sentence, np.arange(len(text)))
        whole = feats[: len(words.start)]
        marks.append(np.add.reduceat(whole, first) if len(whole) else whole)
        labels.append(toxic[lo + text])
    mark, label = np.concatenate(marks), np.concatenate(labels)
    order = np.argsort(label, kind="stable")  # clean ones first
    once = np.zeros(len(mark), bool)
    once[order[np.unique(mark[order], return_index=True)[1]]] = True
    seen: dict[int, list[np.ndarray]] = {0: [], 1: []}
    at = 0
    for lo, hi in scan.pieces(texts):
        feats, sentence, text, _ = _features(texts.slice(lo, hi - lo))
        use = once[at: at + len(text)]
        of = np.tile(sentence, 1 + len(PREFIXES))
        own = np.flatnonzero((feats > 0) & use[of]) if len(of) else of
        sent, feat = _distinct(of[own], feats[own])
        y = label[at: at + len(text)][sent]
        for v in seen:
            seen[v].append(feat[y == v])
        at += len(text)
    pos, neg = (np.unique(np.concatenate(v), return_counts=True) for v in (seen[1], seen[0]))
    other = np.zeros(len(pos[0]), np.int64)
    _, mine, theirs = np.intersect1d(pos[0], neg[0], assume_unique=True, return_indices=True)
    other[mine] = neg[1][theirs]
    n_pos, n_neg = int((once & (label == 1)).sum()), int((once & (label == 0)).sum())
    odds = np.log((pos[1] + SMOOTH) / (n_pos + 2 * SMOOTH)) - np.log((other + SMOOTH) / (n_neg + 2 * SMOOTH))
    # Chernoff's bound on the chance of such a share among as many sentences: under one in all features
    n, rate = pos[1] + other, min(max(n_pos / max(n_pos + n_neg, 1), 1e-9), 1 - 1e-9)
    share = pos[1] / n
    far = n * (share * np.log(share / rate) + (1 - share) * np.log(np.maximum(1 - share, 1e-12) / (1 - rate)))
    kept = (odds >= MIN_ODDS) & (far >= np.log(max(len(pos[0]) + len(neg[0]), 2)))
    return pos[0][kept], odds[kept]


def fit(texts: pa.Array, toxic: np.ndarray) -> Model:
    """Train on whole texts; ``toxic`` is 0 or 1 per text."""
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), BIAS)
    if not len(toxic) or toxic.min() == toxic.max():
        return empty
    names, odds = _candidates(texts, toxic)
    if not len(names):
        return empty
    parts, sentences = [], 0
    for lo, hi in scan.pieces(texts):
        feats, sentence, text, _ = _features(texts.slice(lo, hi - lo))
        at = np.minimum(np.searchsorted(names, feats), len(names) - 1)
        own = np.flatnonzero(names[at] == feats)
        pairs = np.unique(sentence[own % max(len(sentence), 1)] * len(names) + at[own])
        sent = pairs // len(names)
        parts.append((lo + text[sent], sentences + sent, pairs % len(names)))
        sentences += len(text)
    doc, sent, feat = (np.concatenate([p[i] for p in parts]) for i in range(3))
    begin = np.searchsorted(doc, np.arange(len(toxic) + 1))  # rows are in the order of texts
    weights, bias, rng = odds.copy(), BIAS, np.random.default_rng(0)
    squares, bias_square = np.full(len(weights), 1e-6), 1e-6
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch)
        shuffled = rng.permutation(len(toxic))
        for step in range(0, len(shuffled), STEP_DOCS):
            chosen = [d for d in shuffled[step: step + STEP_DOCS] if begin[d] < begin[d + 1]]
            if not chosen:
                continue
            rows = np.concatenate([np.arange(begin[d], begin[d + 1]) for d in chosen])
            own, of_row = np.unique(sent[rows], return_inverse=True)
            which = np.zeros(len(own), np.int64)
            which[of_row] = np.repeat(np.arange(len(chosen)), [begin[d + 1] - begin[d] for d in chosen])
            p = _logistic(np.bincount(of_row, weights[feat[rows]], minlength=len(own)) + bias)
            total = -np.expm1(np.bincount(which, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(chosen)))
            y = toxic[chosen]
            # of the loss, by sentence score: p for a clean document, -p (1 - P) / P for a toxic one
            pull = np.where(y == 1, -(1 - total) / np.maximum(total, 1e-6), 1.0)
            slope = np.clip(pull[which] * p, -1.0, 1.0)
            touched, of_feat = np.unique(feat[rows], return_inverse=True)
            g = np.bincount(of_feat, slope[of_row]) / len(chosen) + DECAY * (weights[touched] - odds[touched])
            squares[touched] += g * g
            weights[touched] -= rate * g / np.sqrt(squares[touched])
            gb = slope.sum() / len(chosen)
            bias_square += gb * gb
            bias = min(BIAS / 2, bias - 0.1 * rate * gb / np.sqrt(bias_square))
    return Model(names, weights, float(bias))


def train(docs: DataFrame, labels: DataFrame, use: Column | None = None, key: str = "doc_id", text: str = "text",
          label: str = "toxic", max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE,
          max_bytes: int = MAX_BYTES) -> Model:
    """Fit on a bounded sample of labelled documents; ``use`` is a condition on the key column."""
    known = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(key).agg(F.max(label).cast("int").alias("_y")))
    if use is not None:
        known = known.where(use)
    order = F.xxhash64(F.col(key).cast("string"))
    ids = known.where("_y = 1").orderBy(order, key).limit(max_positive).union(
        known.where("_y = 0").orderBy(order, key).limit(max_negative))
    rows = docs.select(F.col(key), F.col(text).alias("_text")).join(F.broadcast(ids), key)
    single = materialise(rows.groupBy(F.col(key).alias("id")).agg(F.max("_y").alias("y"), F.min("_text").alias("text")))
    placed = single.withColumn("order", F.xxhash64(F.col("id").cast("string")))
    sample = within(placed, ["order", "id"], max_bytes).select("id", "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [pa.Table.from_batches([b]) for b in batches]
        if not tables:
            return
        table = pa.concat_tables(tables).sort_by([("id", "ascending")])
        model = fit(scan.column(table, "text"), scan.column(table, "y").to_numpy().astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    found = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else Model(np.zeros(0, np.uint64), np.zeros(0), BIAS)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, score)`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # bounded by the training sample
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(own.document_scores(batch.column(1)))], ["key", "score"])

    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(
        run, f"key {kind}, score double").withColumnRenamed("key", key)


def clean_rows(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score stays below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shared.value)
        for batch in batches:
            scores = own.document_scores(batch.column(batch.schema.get_field_index(text)))
            yield batch.filter(pa.array(scores < threshold))

    return docs.mapInArrow(run, docs.schema)


def offending(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text",
              threshold: float = THRESHOLD) -> DataFrame:
    """``(key, sentence, score)``: the sentences that score at least ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shared.value)
        for batch in batches:
            texts = batch.column(1)
            keys, found, scores = [], [], []
            for lo, hi in scan.pieces(texts):
                value, of_text, sentence, words = own.sentence_scores(texts.slice(lo, hi - lo))
                data = words.data.tobytes()
                for s in np.flatnonzero(value >= threshold):
                    first, after = np.searchsorted(sentence, [s, s + 1])
                    keys.append(lo + of_text[s])
                    found.append(data[words.start[first]: words.end[after - 1]].decode("utf-8", "replace"))
                    scores.append(value[s])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keys, pa.int64())), pa.array(found, pa.string()),
                 pa.array(scores, pa.float64())], ["key", "sentence", "score"])

    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(
        run, f"key {kind}, sentence string, score double").withColumnRenamed("key", key)


def crc(key: Column) -> Column:
    """CRC-32 of an id as text."""
    return F.crc32(key.cast("string").cast("binary"))
