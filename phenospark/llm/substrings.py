"""Substring deduplication by level-wise doubling.

A passage of ``window`` words that occurs twice also occurs twice in each of its parts. The shortest level comes first: of
each run of consecutive short windows the one of least hash stands for it, so that every whole window holds one, at the
same place wherever it occurs. Short windows that occur in one document alone are dropped with all that contains them.
Each survivor is extended to twice its length, once to the right and once to the left (a whole window holds one of the
two), and what is again in several documents goes on, level by level, until no candidate survives or the whole length is
reached. There all windows around the survivors are hashed, and those that start in an earlier document, too, remove the
words they cover. Levels end there, as a passage longer than a window repeats only where its windows do.

Whole windows are compared by two independent 64-bit hashes. Documents that are copies word for word are settled before:
all words of a later copy that has a window go. An id filter of bounded size keeps texts without candidates from being
shuffled. Hashes that repeat are written before the join with their places, so that a hash that very many documents share
is split like any other skewed join.

Defined cases: null texts have no words; texts shorter than a window keep all; rows under one id are no earlier than one
another (repeated rows stay alike); rows without an id keep all and are no source. Very long texts are taken alone; a
table without rows gives none; other columns are never read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .decontaminate import _winnow

WINDOW = 50
#: Words of the shortest level at least.
LEAST = 12
_EMPTY = hashlib.sha256(b"").hexdigest()


def levels(window: int, least: int = LEAST) -> list[int]:
    """Lengths from the shortest level to the whole window, each at most twice the one before."""
    out = [window]
    while out[0] >= 2 * least or len(out) == 1:
        out.insert(0, -(-out[0] // 2))
    return out


def _anchors(size: int, run: int):
    """Each document's words and digest, and the chosen windows of the shortest level."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in C.slices(batch.column(1)):
                words = C.Words(buf, off, C.NOT_SPACE, lower=False)
                grams = words.grams(size)
                shas, hashes, places = [], [], []
                for i in range(b - a):
                    at, n = words.first[i], words.first[i + 1] - words.first[i]
                    shas.append(hashlib.sha256(words.joined(i)).hexdigest())
                    own = grams[at : at + n - size + 1] if n >= size + run - 1 else grams[:0]
                    chosen = _winnow(own, run)
                    hashes.append(own[chosen])
                    places.append(chosen.astype(np.int32))
                sizes = [len(x) for x in hashes]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(np.diff(words.first), pa.int64()), pa.array(shas, pa.string()), C.lists(C.signed(np.concatenate(hashes)), sizes, pa.int64()), C.lists(np.concatenate(places), sizes, pa.int32())],
                    names=["doc_id", "key", "n", "sha", "hashes", "places"],
                )

    return scan


def _grown(places: np.ndarray, size: int, to: int, n: int) -> np.ndarray:
    """Starts of the windows of ``to`` words that grow from windows of ``size`` words, to the right and to the left, in a
    text of n words."""
    out = np.concatenate([places, places - (to - size)])
    return np.unique(out[(out >= 0) & (out + to <= n)])


def _around(places: np.ndarray, size: int, to: int, n: int) -> np.ndarray:
    """Starts of all windows of ``to`` words that hold one of the windows of ``size`` words."""
    near = np.zeros(max(0, n - to + 1) + 1, np.int32)
    np.add.at(near, np.maximum(np.minimum(places - (to - size), len(near) - 1), 0), 1)
    np.add.at(near, np.minimum(places + 1, len(near) - 1), -1)
    return np.flatnonzero(np.cumsum(near[:-1]) > 0)


def _windows(size: int, to: int, whole: bool):
    """Hashes (at the last level two) of the windows of ``to`` words that come from surviving ones of ``size`` words."""
    pick = _around if whole else _grown

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(3)
            for a, b, buf, off in C.slices(batch.column(2)):
                words = C.Words(buf, off, C.NOT_SPACE, lower=False)
                grams = words.grams(to)
                hashes, checks, starts = [], [], []
                for i in range(b - a):
                    at, n = words.first[i], words.first[i + 1] - words.first[i]
                    s = pick(np.array(held[a + i].as_py(), np.int64), size, to, int(n))
                    hashes.append(grams[at + s])
                    checks.append(words.check(at + s, to) if whole else grams[:0])
                    starts.append(s.astype(np.int32))
                sizes = [len(x) for x in hashes]
                second = C.lists(C.signed(np.concatenate(checks)), sizes, pa.int64()) if whole else pa.nulls(b - a, pa.list_(pa.int64()))
                lists = [C.lists(C.signed(np.concatenate(hashes)), sizes, pa.int64()), second, C.lists(np.concatenate(starts), sizes, pa.int32())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *lists], names=["doc_id", "key", "hashes", "checks", "starts"])

    return scan


def _cut(window: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = batch.column(3)
            for a, b, buf, off in C.slices(batch.column(2)):
                words = C.Words(buf, off, C.NOT_SPACE, lower=False)
                gone, kept = [], []
                for i in range(b - a):
                    keep = np.ones(words.first[i + 1] - words.first[i], bool)
                    for s in starts[a + i].as_py():
                        keep[s : s + window] = False
                    gone.append(int((~keep).sum()))
                    kept.append(words.joined(i, keep).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "key", "gone", "kept"])

    return scan


def _places(rows: DataFrame, places: str, checks: str | None = None) -> DataFrame:
    """doc_id, key, h, g (a second hash, where there is one), p (place) of the lists of hashes and places."""
    lists = rows.select("doc_id", "key", F.col("hashes").alias("h"), F.col(places).alias("p"), *([F.col(checks).alias("g")] if checks else []))
    one = lists.select("doc_id", "key", F.explode(F.arrays_zip("h", "p", *(["g"] if checks else []))).alias("x"))
    return one.select("doc_id", "key", "x.h", (F.col("x.g") if checks else F.lit(0).cast("long")).alias("g"), "x.p")


def _repeated(places: DataFrame) -> DataFrame:
    """h, g, lo (the first document) of the windows that more than one document holds. Written, so that the join that
    follows has plain shuffles on both sides and a hot hash can be split."""
    return C.materialize(places.groupBy("h", "g").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h", "g", "lo"))


def dedup(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if keep_text, kept: the words that stay, joined by one space
    (null where nothing is removed: the text's own words)."""
    sizes = levels(window)
    run = window - sizes[0] + 1
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    base = C.materialize(docs.select("doc_id", "text", "key").mapInArrow(_anchors(sizes[0], run), "doc_id long, key long, n long, sha string, hashes array<long>, places array<int>"))
    rows = base.select("doc_id", "key", "n", "sha")
    alone = F.when((F.col("n") >= window) & F.col("doc_id").isNotNull(), F.col("doc_id"))
    earliest = C.materialize(rows.where(alone.isNotNull()).groupBy("sha").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("sha", F.col("lo").alias("first_id")))
    rows = C.materialize(rows.join(earliest, "sha", "left").withColumn("first_id", F.when(alone.isNotNull(), F.coalesce("first_id", "doc_id"))))
    # Windows of the shortest level that more than one document holds; copies are left out.
    first = rows.where("doc_id = first_id").select("doc_id", "key").distinct()
    own = base.join(first, ["doc_id", "key"], "left_semi")
    spots = _survivors(_places(own, "places"))
    C.drop(base)
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "key", "text")
    cuts, near = None, texts
    for size, to in zip(sizes, sizes[1:], strict=False):
        few = C.only(near.select("doc_id", "key", "text"), "key", C.id_filter(F.col("key"), spots)).join(spots.hint("shuffle_hash"), ["doc_id", "key"])
        if near is texts:
            near = few = C.materialize(few.dropDuplicates(["doc_id", "key"]))
        held = C.materialize(few.select("doc_id", "key", "text", "places").mapInArrow(_windows(size, to, to == window), "doc_id long, key long, hashes array<long>, checks array<long>, starts array<int>"))
        found = _places(held, "starts", "checks" if to == window else None)
        if to == window:
            cuts = found.join(_repeated(found), ["h", "g"]).where("doc_id > lo").groupBy("doc_id", "key").agg(F.collect_set("p").alias("starts"))
            break
        spots = _survivors(found)
        if spots.isEmpty():
            break
    if cuts is not None:
        cut = near.select("doc_id", "key", "text").join(cuts, ["doc_id", "key"]).select("doc_id", "key", "text", "starts").mapInArrow(_cut(window), "doc_id long, key long, gone long, kept string")
        cut = cut.select("doc_id", "key", "gone", F.sha2("kept", 256).alias("cut_sha"), *(["kept"] if keep_text else []))
        out = rows.join(cut, ["doc_id", "key"], "left")
    else:
        out = rows.withColumn("gone", F.lit(None).cast("long")).withColumn("cut_sha", F.lit(None).cast("string")).withColumn("kept", F.lit(None).cast("string"))
    copy = F.col("doc_id") > F.col("first_id")
    return out.select(
        "doc_id",
        F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(_EMPTY)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        *([F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept")] if keep_text else []),
    )


def _survivors(places: DataFrame) -> DataFrame:
    """doc_id, key, places of the documents with windows that others hold, too."""
    held = _repeated(places)
    out = C.materialize(places.join(held.select("h", "g"), ["h", "g"]).groupBy("doc_id", "key").agg(F.collect_set("p").alias("places")))
    C.drop(held)
    return out


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")
