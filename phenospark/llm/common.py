"""Shared pieces of the training-data operators: tables in the shared folder, word hashing, id filters, components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the numpy kernels take at once; a longer text is taken alone.
CHUNK_BYTES = 1 << 20
#: Bits of an id filter: sixteen for each id, from the first to the second of these (128 KB to 16 MB).
FILTER_BITS = (1 << 20, 1 << 27)
#: Bits of a filter that a task packs in one row.
BLOCK_BITS = 1 << 19
#: Share of the largest heap from which on the driver's garbage is collected.
FULL = 0.4
#: Shuffle files of a write go when it ends, since its readers read the table.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or one of our own where it is unset and all runs in this
    process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        import tempfile

        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")

        found = f"file://{tempfile.mkdtemp(prefix='phenospark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settle(spark: SparkSession) -> None:
    """Collect the driver's garbage where its heap has grown: what a driver of many short jobs keeps is small, but Java takes
    the heap up to its limit before it looks for what is over."""
    jvm = spark.sparkContext._jvm
    heap = jvm.Runtime.getRuntime()
    if heap.totalMemory() > FULL * heap.maxMemory():
        gc.collect()  # Python's names of tables, too
        jvm.System.gc()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors. drop() deletes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/phenospark-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    if before is not None:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is not None:
            spark.conf.set(_CLEANUP, before)
    settle(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Only the needed columns, under private names, so that extra columns can't clash."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(n) for n, (c, t) in ((n, x.rsplit(":", 1)) for n, x in cols.items())])


# --- hashing -------------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 (in place)."""
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = int(_RNG.integers(1, 2**62)) * 8 + 5
_RINV = pow(_R, -1, 2**64)
_OTHER = np.random.Generator(np.random.PCG64(8142057)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i modulo 2**64 for i < n, kept between calls."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_R, _RINV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def _range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each values[start:end]; equal ranges hash alike wherever they lie."""
    up, down = _powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    out = (total[end] - total[start]) * down[start]
    out += (end - start).astype(np.uint64) * np.uint64(0x9E6C63D0876A9A35)
    return _mix(out)


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """Another hash of 64-bit hashes, for another order of the same tokens."""
    return _mix(x ^ np.uint64((seed * 0xD1B54A32D192ED03 + 0x8CB92BA72F3D8DD7) % 2**64))


def byte_class(ranges: str) -> np.ndarray:
    """Table of the bytes that belong to words; all bytes from 0x80 on do (UTF-8)."""
    table = np.zeros(256, bool)
    table[128:] = True
    for part in ranges.split():
        lo, hi = (int(x, 16) for x in part.split("-"))
        table[lo : hi + 1] = True
    return table


#: Words [^\x20\x09-\x0D]+ and words of ASCII letters, digits and all beyond ASCII.
NOT_SPACE = byte_class("00-08 0E-1F 21-7F")
ALNUM = byte_class("30-39 61-7A")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Words of the texts of a slice of an Arrow column: bytes, spans and hashes.

    ``first[i]:first[i+1]`` are the words of text i; nulls have none."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool):
        buf = _LOWER[buf] if lower else buf
        inside = table[buf] if len(buf) else np.zeros(0, bool)
        before = np.zeros(len(buf), bool)
        after = np.zeros(len(buf), bool)
        if len(buf):
            before[1:] = inside[:-1]
            before[offsets[offsets < len(buf)]] = False
            after[:-1] = inside[1:]
            after[offsets[offsets > 0] - 1] = False
        self.buf, self.offsets = buf, offsets
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.other: np.ndarray | None = None
        self.hash = _range_hash(_BYTE[buf], self.start, self.end) if len(self.start) else np.zeros(0, np.uint64)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; only those that end in the same text mean something."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.uint64)
        at = np.arange(n - k + 1)
        return _range_hash(self.hash, at, at + k)

    def check(self, at: np.ndarray, k: int) -> np.ndarray:
        """A second hash of the k words from each of these words on, from other values of their bytes: where the first one
        agrees by chance this one does not."""
        if not len(at):
            return np.zeros(0, np.uint64)
        if self.other is None:
            self.other = _range_hash(_OTHER[self.buf], self.start, self.end)
        return _range_hash(self.other, at, at + k)

    def whole(self, i: int) -> np.uint64:
        """Hash of all words of text i."""
        a, b = self.first[i], self.first[i + 1]
        return _range_hash(self.hash[a:b], np.array([0]), np.array([b - a]))[0]

    def joined(self, i: int, keep: np.ndarray | None = None) -> bytes:
        """The words of text i (those of the mask ``keep``) joined by one space."""
        a, b = self.first[i], self.first[i + 1]
        start, end = self.start[a:b], self.end[a:b]
        if keep is not None:
            start, end = start[keep], end[keep]
        raw = self.buf.tobytes() if len(self.buf) < 4096 else memoryview(self.buf)
        return b" ".join([bytes(raw[s:e]) for s, e in zip(start.tolist(), end.tolist(), strict=True)])


def slices(column: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets from 0) for runs of about ``size`` bytes of a string column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        b = min(b, n)
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, lengths: list[int] | np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column of consecutive runs of ``values``."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


# --- filters and components ----------------------------------------------------------------------


def id_filter(ids: Column, df: DataFrame) -> np.ndarray:
    """A Bloom filter of one hash over ids (long), sized by their number up to a bound.

    It only spares moving rows; callers join with the exact ids after it."""
    n = df.count()
    size = min(max(FILTER_BITS[0], 1 << (16 * n).bit_length()), FILTER_BITS[1])
    slots = df.select(F.pmod(F.xxhash64(ids), F.lit(size)).cast("int").alias("slot"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = np.sort(batch.column(0).to_numpy())
            edges = np.flatnonzero(np.diff(slot // BLOCK_BITS, prepend=-1))
            for part in np.split(slot, edges[1:]):
                if len(part):
                    bits = np.zeros(BLOCK_BITS, bool)
                    bits[part % BLOCK_BITS] = True
                    packed = np.packbits(bits, bitorder="little")
                    at = int(part[0]) // BLOCK_BITS
                    blocks[at] = blocks[at] | packed if at in blocks else packed
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([x.tobytes() for x in blocks.values()], pa.binary())], names=["block", "bits"])

    # Packed in the tasks: the driver gets the filter's own bytes, not a row for each of its words.
    out = np.zeros((size // BLOCK_BITS, BLOCK_BITS // 8), np.uint8)
    for row in slots.repartition(F.floor(F.col("slot") / BLOCK_BITS)).mapInArrow(pack, "block int, bits binary").collect():  # 16 MB at most
        out[row.block] |= np.frombuffer(row.bits, np.uint8)
    return out.reshape(-1).view("<u4")


def slot_of(ids: Column, bits: np.ndarray) -> Column:
    """The bit of id_filter() to test, for passes()."""
    return F.pmod(F.xxhash64(ids), F.lit(32 * len(bits))).cast("int")


def passes(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bits[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1 == 1


def only(df: DataFrame, id_col: str, bits: np.ndarray, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, schema: str | None = None) -> DataFrame:
    """The rows of df whose id may be among those of the filter; ``then`` makes others (``schema``) of them in the same
    worker."""
    names = df.columns
    numbered = df.withColumn("__slot", slot_of(F.col(id_col), bits))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(passes(bits, batch.column(len(names)).to_numpy(zero_copy_only=False)), pa.bool_())
            yield batch.filter(keep).select(list(range(len(names))))

    if then is None:
        return numbered.mapInArrow(kept, df.schema)
    return numbered.mapInArrow(lambda batches: then(kept(batches)), schema)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component): component is the smallest id reachable over edges (u, v).

    Large-star and small-star contraction: each round is a min per node and a join back, so that no
    node's neighbours are gathered; rounds are written to the shared folder. Ends when nothing changes."""
    e = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
        past, e = e, materialize(small.select("p.*").where("u <> v").distinct())
        drop(past)
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("count(distinct u)")).first()
        if now == seen or now[0] == now[2] and not e.join(e.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count():
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    out = e.toDF("node", "component")
    out.kept_at = e.kept_at
    return out
