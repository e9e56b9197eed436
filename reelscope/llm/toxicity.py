"""Toxicity by bags of subwords: averaged embeddings into a linear softmax, trained jointly in numpy.

A word stands for itself and for its runs of 3 to 6 bytes, marked at its ends, hashed into ``1 << BITS`` vectors. A passage
of ``PASSAGE`` words is the mean of its vectors, and a softmax over two classes reads it. A document is as toxic as its
most toxic passage: passages overlap by half, and a logistic curve, fitted on documents left out of training, turns the
largest margin into a probability. Of a word that is repeated over and over, two in a row are read: a passage of one word
only would be judged by a handful of vectors.

Labels are given to documents, not passages. So training goes in rounds: passages of clean documents are all clean; of a
toxic document those count as toxic that the model of the last round finds most so (in the first round, any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelscope.llm import hashing as H
from reelscope.llm.shared import small_batches

BITS = 18
PASSAGE = 16
#: Words part at ASCII other than digits and letters.
_SEP = H.separators(lambda b: b >= 128 or chr(b).isalnum())
_FOLD = np.where(_SEP, 32, H.LOWER).astype(np.uint8)
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _buckets(x: np.ndarray, kind: int) -> np.ndarray:
    return ((x.astype(np.uint64) * np.uint64(8) + np.uint64(kind)) * _MUL >> np.uint64(64 - BITS)).astype(np.int64)


def features(buf: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(first byte of each word, [(place, bucket) of each kind of subword], hash of each word) of a byte buffer."""
    start, _, h = H.words(buf, _SEP, H.LOWER)
    b = np.concatenate([np.full(1, 32, np.uint8), _FOLD[buf], np.full(8, 32, np.uint8)])  # b[i + 1] is byte i
    gap = (b == 32).astype(np.int32)
    total = np.concatenate([[0], np.cumsum(gap, dtype=np.int32)])
    two = b[:-1].astype(np.uint32) | b[1:].astype(np.uint32) << np.uint32(8)
    four = (two[:-2] | two[2:] << np.uint32(16)).astype(np.uint64)
    kinds = []
    n = len(buf)
    for size in (3, 4, 5, 6):
        x = four[:n] & np.uint64(0xFFFFFF) if size == 3 else four[:n] if size == 4 else four[:n] | b[4 : n + 4].astype(np.uint64) << np.uint64(32)
        if size == 6:
            x = x | b[5 : n + 5].astype(np.uint64) << np.uint64(40)
        inner = total[size - 1 : size - 1 + n] - total[1 : n + 1]  # gaps strictly inside the run
        at = np.flatnonzero((inner == 0) & (gap[:n] + gap[size - 1 : size - 1 + n] < 2))
        kinds.append((at - (gap[at] == 0), _buckets(x[at], size - 2)))  # a run that opens with a gap belongs to the word after it
    kinds.append((start, (h >> np.uint64(64 - BITS)).astype(np.int64)))
    return start, kinds, h


def _read(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which words are read: all but those that repeat both words before them in their row."""
    read = np.ones(len(h), dtype=bool)
    read[2:] = (h[2:] != h[1:-1]) | (h[2:] != h[:-2])
    first = row[:-1][np.diff(row) > 0]
    read[np.minimum(np.concatenate([first, first + 1]), len(h) - 1)] = True
    return read


def _passages(row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, past the last word, index of the first passage of each row) of overlapping passages."""
    n = np.diff(row)
    half = PASSAGE // 2
    count = np.where(n > 0, np.maximum(1, -(-(n - PASSAGE) // half) + 1), 0)
    first = np.cumsum(count) - count
    of = np.repeat(np.arange(len(n)), count)
    s = row[:-1][of] + (np.arange(count.sum()) - first[of]) * half
    return s, np.minimum(s + PASSAGE, row[1:][of]), np.append(first, count.sum())


@dataclass
class Model:
    """``margin`` of each bucket (its vector times the difference of the class weights), and the curve."""

    margin: np.ndarray
    bias: float
    slope: float
    shift: float

    def largest(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(margin of the most toxic passage of each row, or -inf; its first word)."""
        start, kinds, h = features(buf)
        total = np.zeros(len(start), dtype=np.float64)
        count = np.zeros(len(start), dtype=np.float64)
        for at, bucket in kinds:
            word = np.maximum(np.searchsorted(start, at, side="right") - 1, 0) if at is not start else np.arange(len(start))
            total += np.bincount(word, weights=self.margin[bucket], minlength=len(start))
            count += np.bincount(word, minlength=len(start))
        begin = H.by_row(start, offsets)
        read = _read(h, begin)
        of, row = np.flatnonzero(read), H.by_row(start[read], offsets)
        s, e, first = _passages(row)
        sums, counts = (np.concatenate([[0.0], np.cumsum(x[read])]) for x in (total, count))
        z = (sums[e] - sums[s]) / np.maximum(counts[e] - counts[s], 1) + self.bias
        out, place = np.full(len(row) - 1, -np.inf), np.zeros(len(row) - 1, dtype=np.int64)
        for i in np.flatnonzero(np.diff(first)):
            j = first[i] + int(np.argmax(z[first[i] : first[i + 1]]))
            out[i], place[i] = z[j], of[s[j]] - begin[i]
        return out, place

    def probability(self, z: np.ndarray) -> np.ndarray:
        return np.where(np.isneginf(z), 0.0, 1 / (1 + np.exp(-np.clip(self.slope * np.where(np.isneginf(z), 0, z) + self.shift, -500, 500))))


@dataclass
class Bags:
    """The passages of one text: passage ``i`` holds the subwords ``bucket[first[i] : past[i]]``. Passages overlap, buckets do not repeat."""

    bucket: np.ndarray
    first: np.ndarray
    past: np.ndarray

    def __len__(self) -> int:
        return len(self.first)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.bucket[self.first[i] : self.past[i]]

    def margins(self, margin: np.ndarray) -> np.ndarray:
        """Mean margin of each passage, 0 for one without subwords."""
        total = np.concatenate([[0.0], np.cumsum(margin[self.bucket], dtype=np.float64)])
        return (total[self.past] - total[self.first]) / np.maximum(self.past - self.first, 1)


def bags(text: str | None) -> Bags:
    buf, offsets = H.texts(pa.array([text], pa.string()))
    start, kinds, h = features(buf)
    at, bucket = np.concatenate([k[0] for k in kinds]).astype(np.int32), np.concatenate([k[1] for k in kinds]).astype(np.int32)
    word = np.maximum(np.searchsorted(start, at, side="right") - 1, 0).astype(np.int32) if len(start) else at
    read = _read(h, H.by_row(start, offsets))
    of = np.cumsum(read) - 1  # index of each word among those read
    word, bucket = (of[word][read[word]], bucket[read[word]]) if len(start) else (word, bucket)
    order = np.argsort(word, kind="stable")
    s, e, _ = _passages(H.by_row(start[read], offsets))
    cut = np.searchsorted(word[order], np.concatenate([s, e])).astype(np.int32)
    return Bags(bucket[order], cut[: len(s)], cut[len(s) :])


def loss(vectors: np.ndarray, weights: np.ndarray, bias: np.ndarray, passages: list[np.ndarray], labels: np.ndarray, each: np.ndarray):
    """Weighted cross-entropy of a batch, and its gradients: to each subword in turn (row by row), to ``weights`` and ``bias``.

    A passage is the mean of its vectors. The gradient to a subword counts once for each time it stands in a passage.
    """
    size = np.array([len(p) for p in passages])
    index = np.concatenate(passages)
    mean = np.add.reduceat(vectors[index], np.cumsum(size) - size, axis=0) / size[:, None]
    z = mean @ weights + bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    here = np.arange(len(passages))
    value = -(each * np.log(np.maximum(p[here, labels], 1e-30))).sum()
    p[here, labels] -= 1
    p *= each[:, None]
    grad = (p @ weights.T) / size[:, None]
    return value, index, np.repeat(grad, size, axis=0), mean.T @ p, p.sum(axis=0)


def train(texts: list[str], toxic: list[int], dim: int = 8, rounds: int = 6, seed: int = 7) -> Model:
    """Fit on whole labelled texts. With one class only, every text gets that class's share as its score."""
    y = np.array(toxic, dtype=np.int64)
    flat = Model(np.zeros(1 << BITS, dtype=np.float32), 0.0, 0.0, 0.0)
    if len(y) == 0 or y.min() == y.max():
        flat.shift = 8.0 if len(y) and y[0] else -8.0
        return flat
    rng = np.random.default_rng(seed)
    held = rng.random(len(y)) < 0.2
    for c in (0, 1):  # either side needs both classes
        of = np.flatnonzero(y == c)
        if len(of) > 1:
            held[of[0]], held[of[-1]] = True, False
        else:
            held[of] = False
    # Held-out texts are only scored, at the end: their passages are never kept.
    found = {i: bags(texts[i]) for i in np.flatnonzero(~held)}
    used = [i for i, x in found.items() if len(x)]
    vectors = (rng.random((1 << BITS, dim), dtype=np.float32) - 0.5) / dim
    weights, bias = np.zeros((dim, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    speed = np.full(1 << BITS, 1e-6, dtype=np.float32)
    seen = np.zeros(1 << BITS, dtype=np.float32)  # training documents that hold the subword
    for i in used:
        seen[np.unique(found[i].bucket)] += 1
    trust = (seen / (seen + 5)).astype(np.float32)  # a subword of few documents says little
    speed_w = 1e-6
    for turn in range(rounds):
        margin = trust * (vectors @ (weights[:, 1] - weights[:, 0]))
        chosen: list[np.ndarray] = []
        labels: list[int] = []
        for i in used:
            z = found[i].margins(margin)
            top = np.argsort(-z, kind="stable") if turn else rng.permutation(len(z))
            if y[i]:
                take = top[:4] if turn == 0 else top[:1]
            else:
                take = np.unique(np.concatenate([top[:3], rng.integers(0, len(z), 2)]))
            taken = [p for p in (found[i][j] for j in take) if len(p)]
            chosen += taken
            labels += [int(y[i])] * len(taken)
        labels_ = np.array(labels)
        share = labels_.mean()
        each = np.where(labels_ == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)).astype(np.float32)
        for _ in range(min(20, max(2, 200 * 64 // max(1, len(chosen))))):
            order = rng.permutation(len(chosen))
            for at in range(0, len(order), 64):
                batch = order[at : at + 64]
                _, index, grad, grad_w, grad_b = loss(vectors, weights, bias, [chosen[j] for j in batch], labels_[batch], each[batch])
                speed_w += float((grad_w**2).mean())
                # Adagrad, one rate for each vector
                distinct, where = np.unique(index, return_inverse=True)
                step = np.stack([np.bincount(where, weights=grad[:, k], minlength=len(distinct)) for k in range(dim)], axis=1).astype(np.float32)
                speed[distinct] += (step**2).mean(axis=1)
                vectors[distinct] -= 0.3 * step / np.sqrt(speed[distinct])[:, None]
                weights -= (0.3 * grad_w / np.sqrt(speed_w)).astype(np.float32)
                bias -= 0.05 * grad_b / len(batch)
    model = Model((trust * (vectors @ (weights[:, 1] - weights[:, 0]))).astype(np.float32), float(bias[1] - bias[0]), 1.0, 0.0)
    z = np.array([model.largest(*H.texts(pa.array([texts[i]], pa.string())))[0][0] for i in np.flatnonzero(held)])
    model.slope, model.shift = _curve(z[np.isfinite(z)], y[held][np.isfinite(z)])
    return model


def _curve(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through scored labels, with Platt's smoothed targets."""
    if len(z) == 0 or y.min() == y.max():
        return 1.0, 0.0
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    mean, scale = z.mean(), max(z.std(), 1e-9)
    x = np.stack([(z - mean) / scale, np.ones(len(z))], axis=1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w -= np.clip(np.linalg.solve(hess, x.T @ (p - t) + 1e-3 * w), -2, 2)
    return float(w[0] / scale), float(w[1] - w[0] * mean / scale)


def sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """doc_id, toxic, text of up to ``most`` labelled documents of each class, those with the smallest hashes of their ids.

    It is drawn from the documents that have a text and a label; of several texts of a doc_id the smallest counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and doc_id is not null")
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    have = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    one, zero = (have.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for c in (1, 0))
    # At most 2 * most rows of two numbers.
    return texts.join(F.broadcast(one.unionByName(zero)), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, most: int = 3000) -> Model:
    """Train on up to ``most`` labelled documents of each class (``sample``), whose texts are read whole.

    ``labels`` needs doc_id and toxic (0, 1, or null for unknown); of several labels of a document the largest counts.
    One task trains on the sample; the driver receives the finished model, 4 bytes for each bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(zip(*(sum((b.column(i).to_pylist() for b in found), []) for i in range(3)), strict=True)) if (found := list(batches)) else []
        m = train([r[2] for r in rows], [r[1] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([m.margin.astype("<f4").tobytes()], pa.binary()), *[pa.array([float(x)]) for x in (m.bias, m.slope, m.shift)]], names=["margin", "bias", "slope", "shift"])

    small_batches(docs.sparkSession)
    rows = sample(docs, labels, most).select("doc_id", "toxic", "text").repartition(1)
    made = [r for r in rows.mapInArrow(run, "margin binary, bias double, slope double, shift double").collect() if r.margin]
    if not made:  # no partition at all
        return train([], [])
    return Model(np.frombuffer(made[0].margin, dtype="<f4"), made[0].bias, made[0].slope, made[0].shift)


def scored(docs: DataFrame, model: Model, score: str = "score", first_word: str = "first_word", text: str = "text") -> DataFrame:
    """``docs`` with two more columns: the score (0 to 1) and where the most toxic passage begins, counted in words.

    Rows stay where they are: nothing is shuffled. Whole texts are scored. Texts that are null or have no word get 0.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in H.blocks(whole, text):
                z, place = shared.value.largest(*H.texts(batch.column(at)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.probability(z)), pa.array(place)], names=[*batch.schema.names, score, first_word])

    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(first_word, T.LongType())])
    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and first_word of each row of doc_id and text; null and repeated doc_ids come back as they are."""
    return scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model).drop("text")
