"""Quality: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader, scored by sparse products.

A text's words are its runs of letters and digits and its runs of other signs. Two streams are taken of them: the words
themselves (1 and 2 of them, A-Z lower-cased) and their shapes (1 to 3; a word's shape is which kinds of letters it has
and how long it is, a run of signs is its own shape), so that words that were never seen still tell something. Each n-gram
falls into one of 2**BITS slots; a slot's value is its share of the text's n-grams. The score is the logistic function of
one sparse product with the weights.

The classifier is fitted on at most ``SAMPLE`` labelled rows of each class, those of least hash; what the training needs
of them (slots and values) is made on the executors. Rows weigh so that the classes stand as they do among all labels that
may be used. Whole texts are scored, in one pass without a shuffle.

Defined cases: null, empty and blank texts score the bias alone; a row whose label is null is no training row; an id
labelled more than once counts once, as 0 if any of its labels is; repeated documents of an id count each; without labels
of both classes every score is 0.5. Very long texts are taken alone; a table without rows gives none; other columns are never
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .toxicity import held_out

SAMPLE, BITS, EPOCHS = 6_000, 18, 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
SCALE = 8.0  # of a text's values, which add up to it
THRESHOLD = 0.5
LENGTHS = (1, 2, 4, 7, 11, 16, 25)  # a word's length counts by these steps
_SIGN, _UPPER, _DIGIT, _HIGH, _LOWER = 1, 2, 4, 8, 16
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
for _lo, _hi, _as in (("0", "9", _DIGIT), ("A", "Z", _UPPER), ("a", "z", _LOWER), ("\x80", "\xff", _HIGH)):
    _KIND[ord(_lo) : ord(_hi) + 1] = _as
_STREAMS = ((0, 1), (0, 2), (1, 1), (1, 2), (1, 3))  # (words or shapes, how many)


def slots(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the n-grams of the texts buf[offsets[i]:offsets[i + 1]], and the text of each."""
    kind = _KIND[buf]
    group = np.where(kind > _SIGN, np.uint8(2), kind)  # blank, sign or word
    begins = np.ones(len(buf) + 1, bool)
    begins[1:-1] = group[1:] != group[:-1]
    begins[offsets[offsets < len(buf)]] = True
    at = np.flatnonzero(begins)
    start, end = at[:-1], at[1:]
    some = group[start] > 0
    start, end = start[some], end[some]
    n = len(start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.searchsorted(offsets, start, "right") - 1
    word = C._range_hash(C._BYTE[C._LOWER[buf]], start, end)
    flags = np.bitwise_or.reduceat(np.append(kind, np.uint8(0)), np.stack([start, end], 1).ravel())[::2]
    first = (kind[start] == _UPPER).astype(np.uint64)
    shape = flags.astype(np.uint64) | first << np.uint64(8) | np.searchsorted(LENGTHS, end - start).astype(np.uint64) << np.uint64(9)
    shape = np.where(kind[start] == _SIGN, word, C.mixed(shape, 1))
    out, where = [], []
    for stream, k in _STREAMS:
        h = (word, shape)[stream]
        if n < k:
            continue
        g = h[: n - k + 1].copy()
        for j in range(1, k):
            g = g * np.uint64(0x9FB21C651E98DF25) + h[j : n - k + 1 + j]
        whole = text[: n - k + 1] == text[k - 1 :]
        out.append((C.mixed(g[whole], 10 * stream + k) >> np.uint64(64 - BITS)).astype(np.int64))
        where.append(text[: n - k + 1][whole])
    return np.concatenate(out), np.concatenate(where)


class Model:
    """Weights of the slots and the bias; without weights every score is 0.5."""

    def __init__(self, weights: np.ndarray | None = None, bias: float = 0.0):
        self.weights, self.bias = weights, bias

    def scores(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if self.weights is None:
            return np.full(n, 0.5)
        at, text = slots(buf, offsets)
        total = np.bincount(text, self.weights[at], n)
        z = self.bias + SCALE * total / np.maximum(np.bincount(text, minlength=n), 1)
        return 1 / (1 + np.exp(-z))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], weight: tuple[float, float] = (1.0, 1.0)) -> Model:
    """FTRL-proximal over rows (slots, values, label), in the given order; ``weight`` of each class."""
    if len({y for _, _, y in rows}) < 2:
        return Model()
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last slot is the bias, not penalised
    l1, l2 = np.full(size + 1, L1), np.full(size + 1, L2)
    l1[-1] = l2[-1] = 0

    def weights(at):
        zz, pen = z[at], l1[at]
        return np.where(np.abs(zz) <= pen, 0.0, -(zz - np.sign(zz) * pen) / ((BETA + np.sqrt(n[at])) / ALPHA + l2[at]))

    for _ in range(EPOCHS):
        for at, value, y in rows:
            at, x = np.append(at, size), np.append(value * SCALE, 1.0)
            w = weights(at)
            g = x * (weight[y] * (1 / (1 + np.exp(-(x @ w))) - y))
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    return Model(w[:-1], float(w[-1]))


def fit(documents: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", use: Column | None = None) -> Model:
    """Train on at most ``sample`` rows of each class; ``use`` says which labelled ids (column id) may be learned from, by
    default those that aren't held out."""
    ids = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id is not null and y in (0, 1)")
    ids = ids.where(~held_out(F.col("id")) if use is None else use).groupBy("id").agg(F.min("y").alias("y"))
    have = {r.y: r["count"] for r in ids.groupBy("y").count().collect()}  # two rows
    if len(have) < 2:
        return Model()
    order = F.xxhash64("id")
    chosen = ids.where("y = 1").orderBy(order, "id").limit(sample).unionByName(ids.where("y = 0").orderBy(order, "id").limit(sample))
    texts = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    rows = texts.join(F.broadcast(chosen), "id").select("text", "y", F.xxhash64("id", F.lit(7)).alias("h"), F.xxhash64("text").alias("t"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in C.slices(batch.column(0)):
                at, text = slots(buf, offsets)
                key, count = np.unique(text << BITS | at, return_counts=True)
                per, size = key >> BITS, np.bincount(text, minlength=b - a)
                part = batch.slice(a, b - a)
                lengths = np.bincount(per, minlength=b - a)
                yield pa.RecordBatch.from_arrays([C.lists(key & ((1 << BITS) - 1), lengths, pa.int32()), C.lists(count / size[per], lengths, pa.float32()), *[part.column(k) for k in (1, 2, 3)]], names=["at", "value", "y", "h", "t"])

    got = rows.mapInArrow(extract, "at array<int>, value array<float>, y int, h long, t long").toArrow()
    got = got.sort_by([("h", "ascending"), ("t", "ascending")])  # an order that does not follow the ids
    y = got["y"].to_numpy()
    weight = [have[k] / max(int((y == k).sum()), 1) for k in (0, 1)]
    rows = [(at.values.to_numpy(), value.values.to_numpy(), int(k)) for at, value, k in zip(got["at"], got["value"], y, strict=True)]
    return train(rows, tuple(w / max(weight) for w in weight))


def score(documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every document, in one pass."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in C.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(model.scores(buf, offsets), pa.float64())], names=["doc_id", "score"])

    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return docs.mapInArrow(scan, "doc_id long, score double")


def digest(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
