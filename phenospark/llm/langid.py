"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader with elastic-net penalties (L1 leaves most weights at zero), then calibrated by
one temperature on rows that the training did not see. The classifier (inverse document frequencies included) is fitted
on at most ``SAMPLE`` training rows, whose features are made on the executors: of every language the rows of least hash, as
many of each as there are until the sample is full, so that rare languages are learned, too. Held-out rows give nothing to
it. Whole texts are predicted, in one pass. Of an id that is repeated each row is read, but the sample takes it once.

Defined cases: null texts and texts without a letter give ``und`` with score 0; without training rows all texts do; rows
repeated under one id and language are sampled together; ties of probability go to the language that sorts first. Very
long texts are taken alone; a table without rows gives none; other columns are never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .toxicity import held_out

SAMPLE, BITS, ORDERS, EPOCHS = 3_000, 15, (1, 2, 3), 3
ALPHA, BETA, L1, L2 = 0.6, 1.0, 0.3, 0.5
CALIBRATION = 5  # one sampled row in so many calibrates
_TABLE = np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])
_FACTORS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed n-grams and 1 + log of their counts; None without a letter. All that isn't a letter is one blank."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _TABLE[codes]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # a blank after each word
    c = np.where(letter, codes, np.uint32(32))[keep]
    c = np.concatenate([np.array([32], np.uint32), c])
    slots = []
    for n in ORDERS:
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, n, np.uint32)
        for k in range(n):
            h = (h ^ c[k : len(c) - n + 1 + k]) * _FACTORS[k]
            h ^= h >> np.uint32(15)
        slots.append(h >> np.uint32(32 - BITS))
    count = np.bincount(np.concatenate(slots), minlength=1 << BITS)
    at = np.flatnonzero(count)
    return at.astype(np.int32), (1 + np.log(count[at])).astype(np.float32)


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0):
        self.langs, self.idf, self.weights, self.bias, self.temperature = langs, idf, weights, bias, temperature

    def logits(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        x = tf * self.idf[at]
        x = x / (np.linalg.norm(x) or 1)
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        got = features(text)
        if got is None or not self.langs:
            return "und", 0.0
        p = _softmax(self.logits(*got) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max())
    return p / p.sum()


def train(rows: list[tuple[np.ndarray, np.ndarray, str]]) -> Model:
    """FTRL-proximal over rows (slots, term frequencies, language), in the given order."""
    langs = sorted({y for _, _, y in rows})
    size, k = 1 << BITS, len(langs)
    seen = np.zeros(size)
    for at, _, _ in rows:
        seen[at] += 1
    idf = np.where(seen > 0, np.log((1 + len(rows)) / (1 + seen)) + 1, 0).astype(np.float32)
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))  # the last slot is the bias, not penalised
    l1, l2 = np.full((size + 1, 1), L1), np.full((size + 1, 1), L2)
    l1[-1] = l2[-1] = 0

    def weights(at):
        zz, pen = z[at], l1[at]
        return np.where(np.abs(zz) <= pen, 0.0, -(zz - np.sign(zz) * pen) / ((BETA + np.sqrt(n[at])) / ALPHA + l2[at]))

    fit = [r for i, r in enumerate(rows) if i % CALIBRATION] or rows
    for _ in range(EPOCHS):
        for slots, tf, y in fit:
            x = tf * idf[slots]
            x = np.append(x / (np.linalg.norm(x) or 1), 1.0)
            at = np.append(slots, size)
            w = weights(at)
            g = x[:, None] * (_softmax(x @ w) - (np.arange(k) == langs.index(y)))[None, :]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    model = Model(langs, idf, w[:-1].astype(np.float32), w[-1])
    held = rows[::CALIBRATION]
    logits = [(model.logits(at, tf), langs.index(y)) for at, tf, y in held]
    grid = np.geomspace(0.1, 10, 81)
    model.temperature = float(min(grid, key=lambda t: -sum(np.log(_softmax(v / t)[y] + 1e-12) for v, y in logits)))
    return model


def fit(documents: DataFrame, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", use: Column | None = None) -> Model:
    """Train on at most ``sample`` rows with a language; by default those that aren't held out."""
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    docs = docs.where("lang is not null and text is not null").where(~held_out(F.col("id")) if use is None else use)
    # A bound on the hash leaves some twice the sample of each language, however many rows it has; only these are ranked.
    ids = docs.select("id", "lang", F.xxhash64("id", "lang").alias("h"))
    many = docs.groupBy("lang").agg(F.approx_count_distinct("id").alias("many"))
    share = F.expr("shiftrightunsigned(h, 1)") / F.lit(float(1 << 63))
    # A row for each language, of which the classifier itself holds 2**BITS weights each.
    low = ids.join(F.broadcast(many), "lang").where(share * F.col("many") <= 2 * sample + 200).select("id", "lang", "h").distinct()
    ranked = low.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).where(F.col("r") <= sample)
    chosen = ranked.orderBy("r", "h", "id").limit(sample).select("id", "lang")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(features(t), y, i) for t, y, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            got = [x for x in got if x[0]]
            yield pa.RecordBatch.from_arrays([pa.array([x[0][0] for x in got], pa.list_(pa.int32())), pa.array([x[0][1] for x in got], pa.list_(pa.float32())), pa.array([x[1] for x in got], pa.string()), pa.array([x[2] for x in got], pa.int64())], names=["at", "tf", "lang", "id"])

    rows = docs.join(F.broadcast(chosen), ["id", "lang"]).select("text", "lang", "id").mapInArrow(extract, "at array<int>, tf array<float>, lang string, id long").toPandas()
    rows["h"] = (rows.id.fillna(0).astype("int64") * 2654435761) % 2**32  # an order that does not follow the ids
    rows = rows.sort_values(["h", "id", "lang"]).head(2 * sample)
    return train(list(zip(rows["at"], rows["tf"], rows["lang"], strict=True))) if len(rows) else Model([], np.zeros(1), np.zeros((1, 0)), np.zeros(0))


def predict(documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _, _ in C.slices(batch.column(1)):
                got = [model.predict(t) for t in batch.column(1).slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return docs.mapInArrow(scan, "doc_id long, lang_pred string, score double")


def digest(predicted: DataFrame) -> DataFrame:
    return predicted.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
