"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are rotated and projected to a few coordinates, several times with other rotations and shifts; each projection
is walked by a Hilbert curve. Every ordering is range-partitioned and cut into blocks of ``BLOCK`` rows; a query's window
is its block and the two beside it. The windows of all orderings merge and are reranked by exact inner products.

Windows alone reach little recall on vectors without structure, as all low-dimensional orderings do. With
``complete=True`` an exact check follows: the queries, ``CHUNK`` at a time in the first ordering, go to a scan of all
blocks, and a block is scored unless its centre and radius and those of the chunk prove that it can't hold anything above
the least score found. Nothing is shuffled for it but each task's best.

Candidates are chosen by matrix products with room for rounding, then scored by one sum in a fixed order, so that equal
vectors have equal scores wherever they lie. Of equal vectors in a block only the k + 1 of smallest id can be among the
nearest; the others are left out before scoring, so that a vector that very many rows share costs no more than another.

Defined cases: vectors that are null, zero, or hold a null or a non-finite component take no part, on either side, nor
do vectors of another length than the most frequent one; equal vectors differ by id, so that the curve's blocks stay
bounded; ties go to the smaller id; rows repeated under one id count once, by the vector that sorts first. A table without
rows gives none; other columns are never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

ORDERINGS, DIMS, BITS, BLOCK, CHUNK, SEED = 4, 8, 7, 2048, 8192, 11
_OUT = "query_id long, vec_id long, score double"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells (integers of ``bits`` bits), for dims * bits <= 63."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(on, q - 1, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def _keys(vectors: np.ndarray, ordering: int, dims: int, bits: int) -> np.ndarray:
    """Keys of unit-length directions: a projection by a seeded rotation, shifted by a part of a cell's width."""
    rng = np.random.default_rng([SEED, ordering])
    basis = np.linalg.qr(rng.standard_normal((vectors.shape[1], min(dims, vectors.shape[1]))))[0]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    low = unit @ basis * np.sqrt(vectors.shape[1])  # spread of about one
    cells = ((low + 3.5 + rng.random(low.shape[1])) / 8.0 * (1 << bits)).astype(np.int64)
    return hilbert_keys(np.clip(cells, 0, (1 << bits) - 1), bits)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 1))


#: Relative room for the rounding of a matrix product, and pairs that are scored anew at once.
ROOM, PAIRS = 1e-12, 1 << 15


def _thin(data: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of ids, of equal vectors the k + 1 first."""
    order = np.argsort(ids, kind="stable")
    data, ids = np.ascontiguousarray(data[order] + 0.0), ids[order]
    if len(ids) <= k + 1:
        return data, ids
    raw = data.view(np.dtype((np.void, data.itemsize * data.shape[1]))).ravel()
    _, kind, count = np.unique(raw, return_inverse=True, return_counts=True)
    if count.max() <= k + 1:
        return data, ids
    by = np.argsort(kind, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[by] = np.arange(len(ids)) - np.repeat(np.cumsum(count) - count, count)
    keep = place <= k
    return data[keep], ids[keep]


def _best(queries: np.ndarray, qids: np.ndarray, least: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """Up to k best of the data for each query, no worse than ``least``, not the query's own row."""
    out = []
    data, ids = _thin(data, ids, k)
    reach = float(np.linalg.norm(data, axis=1).max()) if len(data) else 0.0
    for a in range(0, len(queries), 512):
        asked = queries[a : a + 512]
        room = ROOM * reach * np.linalg.norm(asked, axis=1)
        scores = asked @ data.T
        scores[qids[a : a + 512, None] == ids[None, :]] = -np.inf
        floor = least[a : a + 512]
        if len(ids) > k:
            floor = np.maximum(-np.partition(-scores, k - 1, axis=1)[:, k - 1], floor)
        q, d = np.nonzero((scores >= (floor - 2 * room)[:, None]) & np.isfinite(scores))
        s = np.empty(len(q))
        for b in range(0, len(q), PAIRS):
            s[b : b + PAIRS] = (asked[q[b : b + PAIRS]] * data[d[b : b + PAIRS]]).sum(axis=1)
        order = np.lexsort((ids[d], -s, q))
        q, d, s = q[order], d[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < k
        out.append(pd.DataFrame({"query_id": qids[a + q[keep]], "vec_id": ids[d[keep]], "score": s[keep]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def valid_vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vector (array<double>) of the rows that take part, once for each id."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("vector")).where("id is not null and vector is not null and size(vector) > 0")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(fine)
    size = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("vector") == (size[0].n if size else 0)).groupBy("id").agg(F.min("vector").alias("vector"))


def search(table: DataFrame, queries: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, orderings: int = ORDERINGS, dims: int = DIMS, bits: int = BITS, block: int = BLOCK, complete: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score: the k best found of every other row, for the rows where ``queries`` (over ``id``) holds."""
    spark = table.sparkSession
    rows = C.materialize(valid_vectors(table, id_col, vec_col).withColumn("asks", F.coalesce(queries, F.lit(False))))
    n = rows.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return empty
    ordered = C.materialize(_ordered(rows, n, orderings, dims, bits, block))
    # Windows: a block's rows meet the queries of it and of the blocks beside it.
    asks = ordered.where("asks").select("ordering", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block"), F.col("id").alias("query_id"), "vector")

    def window(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        return _best(_matrix(left["vector"]), left["query_id"].to_numpy(), np.full(len(left), -np.inf), _matrix(right["vector"]), right["id"].to_numpy(), k)

    found = asks.groupBy("ordering", "block").cogroup(ordered.select("ordering", "block", "id", "vector").groupBy("ordering", "block")).applyInPandas(window, _OUT)
    found = C.materialize(_top(found, k))
    if complete:
        found = _top(found.select("query_id", "vec_id", "score").unionByName(_complete(ordered.where("ordering = 0"), found, n, k)), k)
    return found.select("query_id", "rank", "vec_id", "score")


def _top(found: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def _ordered(rows: DataFrame, n: int, orderings: int, dims: int, bits: int, block: int) -> DataFrame:
    """ordering, block, id, vector, asks: rows of each ordering along its curve, in blocks of consecutive numbers."""
    schema = T.StructType([T.StructField("ordering", T.IntegerType()), T.StructField("key", T.LongType()), *rows.schema.fields])

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            m = _matrix(f["vector"])
            for g in range(orderings):
                if len(f):
                    out = f.copy()
                    out.insert(0, "key", _keys(m, g, dims, bits))
                    out.insert(0, "ordering", np.int32(g))
                    yield out

    placed = T.StructType([*schema.fields, T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType())])

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        for f in frames:
            for g, own in f.groupby("ordering", sort=True):
                at = seen.get(g, 0) + np.arange(len(own))
                seen[g] = seen.get(g, 0) + len(own)
                yield own.assign(part=np.int32(part), at=at)

    parts = max(1, min(orderings * n // block, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ranged = rows.mapInPandas(keyed, schema).repartitionByRange(parts, "ordering", "key", "id").sortWithinPartitions("ordering", "key", "id")
    ranged = C.materialize(ranged.mapInPandas(place, placed))
    # Where each part's rows begin in their ordering: one row for each part and ordering.
    sizes = ranged.groupBy("ordering", "part").agg(F.count("*").alias("size")).orderBy("ordering", "part").collect()
    starts, total = [], {}
    for r in sizes:
        starts.append((r.ordering, r.part, total.get(r.ordering, 0)))
        total[r.ordering] = total.get(r.ordering, 0) + r.size
    begin = rows.sparkSession.createDataFrame(starts, "ordering int, part int, begin long")
    return ranged.join(F.broadcast(begin), ["ordering", "part"]).select("ordering", F.floor((F.col("begin") + F.col("at")) / block).cast("long").alias("block"), "id", "vector", "asks")


def _complete(base: DataFrame, found: DataFrame, n: int, k: int) -> DataFrame:
    """Rows at least as good as the k-th found, from all blocks that the bound leaves."""
    least = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    asks = base.where("asks").join(least, "id", "left").select("block", "id", "vector", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    per = max(1, asks.count() // max(1, n // BLOCK))  # queries of a block
    span = max(1, CHUNK // per)
    asks = C.materialize(asks.withColumn("chunk", F.floor(F.col("block") / span).cast("long")))
    rows = base.select("id", "vector")
    parts = None
    for c in [r.chunk for r in asks.select("chunk").distinct().orderBy("chunk").collect()]:
        chunk = asks.where(F.col("chunk") == c).toPandas()  # at most span blocks' queries
        one = C.materialize(rows.mapInPandas(_scan(_matrix(chunk["vector"]), chunk["id"].to_numpy(), chunk["least"].to_numpy(), k), _OUT))
        parts = one if parts is None else parts.unionByName(one)
    return parts if parts is not None else found.select("query_id", "vec_id", "score").limit(0)


def _scan(queries: np.ndarray, qids: np.ndarray, least: np.ndarray, k: int):
    """Each task's k best of its rows for each query of a chunk."""
    centre = queries.mean(axis=0)
    spread = float(np.linalg.norm(queries - centre, axis=1).max())

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, floor = None, least.copy()
        place = pd.Series(np.arange(len(qids)), index=qids)
        for f in frames:
            for a in range(0, len(f), BLOCK):
                m, ids = _matrix(f["vector"].iloc[a : a + BLOCK]), f["id"].to_numpy()[a : a + BLOCK]
                c = m.mean(axis=0)
                r = float(np.linalg.norm(m - c, axis=1).max())
                bound = centre @ c + r * np.linalg.norm(centre) + spread * np.linalg.norm(c) + spread * r
                if bound * (1 + 1e-12) + 1e-12 < floor.min():
                    continue
                got = _best(queries, qids, floor, m, ids, k)
                got = got if best is None else pd.concat([best, got])
                got = got.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).drop_duplicates(["query_id", "vec_id"])
                best = got[got.groupby("query_id").cumcount() < k]
                full = best.groupby("query_id")["score"].agg(["size", "min"])
                full = full[full["size"] >= k]
                at = place[full.index].to_numpy()
                floor[at] = np.maximum(floor[at], full["min"].to_numpy())
        if best is not None:
            yield best

    return scan
