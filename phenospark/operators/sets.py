"""Sets of k-mers and word shingles as 64-bit hashes, in time linear in the text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import SKETCH
from .lineage import spread

#: Tokens of a set that lie in one row, about; larger sets are cut by ranges of hashes.
PART_TOKENS = 1 << 16
#: Pairs of one set that a task compares, and the slots of ids that are broadcast at most.
SPLIT, SLOTS = 1024, 1 << 19
_STEP = 0xA24BAED4963EE407
_SCHEMA = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("sketch", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64()))])


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value with its bits spread."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def windows(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k values from each place on: hashes of 1, 2, 4, ... values are put together as k's bits ask, so that
    the work is in proportion to the values and the number of bits."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    block, size, out, done = values, 1, None, 0
    while size <= k:
        if k & size:
            piece = block[done : done + n]
            out = piece if out is None else out * np.uint64(pow(_STEP, size, 1 << 64)) + piece
            done += size
        if 2 * size <= k:
            block = block[:-size] * np.uint64(pow(_STEP, size, 1 << 64)) + block[size:]
        size *= 2
    return mixed(out)


def letters(text: str | None) -> np.ndarray:
    """A value for each letter of a sequence."""
    raw = text or ""
    codes = np.frombuffer(raw.encode(), np.uint8) if raw.isascii() else np.frombuffer(raw.encode("utf-32-le", "replace"), np.uint32)
    return mixed(codes.astype(np.uint64) + np.uint64(1))


@dataclass(frozen=True)
class Source:
    """What sets are made of: rows (id, x), x brought to a list of values in the JVM, then in the tasks."""

    rows: DataFrame
    k: int
    listed: Callable[[Column], Column]
    values: Callable[[pa.Array], Iterator[np.ndarray]]

    def tokens(self) -> Callable[[pa.Array], Iterator[np.ndarray]]:
        """What gives the distinct windows of each x, sorted."""
        k, values = self.k, self.values  # tasks take these, not the rows

        def of_column(column: pa.Array) -> Iterator[np.ndarray]:
            for x in values(column):
                found = np.sort(windows(x, k).view(np.int64))
                yield found[np.concatenate([found[:1] == found[:1], found[1:] != found[:-1]])]

        return of_column


def _marks(tokens: np.ndarray) -> tuple[np.int64, np.int64]:
    """Two values that tell sets apart."""
    raw = tokens.view(np.uint64)
    return raw.sum().astype(np.uint64).view(np.int64), np.bitwise_xor.reduce(mixed(raw)).view(np.int64) if len(raw) else np.int64(0)


def of(source: Source) -> DataFrame:
    """(id, part, n, f1, f2, sketch, tokens) of all sets: the distinct windows of k values of each x, n of them. f1 and
    f2 tell sets apart; sketch, the least SKETCH tokens, stands in a set's first part. Nothing is made before it is read: tokens
    are eight times a text, so heads() and shared() don't take them from here but from the ``source`` kept with the table."""

    tokens_of = source.tokens()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, held = [], {name: [] for name in _SCHEMA.names}, 0
            for row, tokens in enumerate(tokens_of(batch.column(1))):
                bits = (len(tokens) // PART_TOKENS).bit_length()
                edges = np.searchsorted(tokens, [(p << (64 - bits)) - (1 << 63) for p in range(1, 1 << bits)]) if bits else []
                mark, sketch = _marks(tokens), tokens[:SKETCH]
                for p, piece in enumerate(np.split(tokens, edges)):
                    if len(piece) or p == 0 and not len(tokens):
                        ids.append(row)
                        for name, value in zip(_SCHEMA.names, (p, len(tokens), *mark, sketch, piece), strict=True):
                            out[name].append(value)
                        sketch = None
                held += len(tokens)
                if held > 16 * PART_TOKENS:
                    yield _batch(batch, ids, out)
                    ids, out, held = [], {name: [] for name in _SCHEMA.names}, 0
            yield _batch(batch, ids, out)

    out = spread(source.rows).select("id", source.listed(F.col("x")).alias("x")).mapInArrow(make, f"id {_kind(source)}, part int, n long, f1 long, f2 long, sketch array<long>, tokens array<long>")
    out.source = source
    return out


def _kind(source: Source) -> str:
    return dict(source.rows.dtypes)["id"]


def _batch(batch: pa.RecordBatch, ids: list[int], out: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *[pa.array(out[f.name], f.type) for f in _SCHEMA]], names=["id", *_SCHEMA.names])


def heads(table: DataFrame, size: int = SKETCH) -> DataFrame:
    """One row (id, n, f1, f2, sketch) for each set of a table of of() that isn't empty; sketch has its ``size`` least tokens."""
    source = table.source
    tokens_of = source.tokens()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, kept = [], [], []
            for row, tokens in enumerate(tokens_of(batch.column(1))):
                if len(tokens):
                    ids.append(row)
                    rows.append((len(tokens), *_marks(tokens)))
                    kept.append(tokens[:size].copy())
            n = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *(pa.array(n[:, i]) for i in range(3)), pa.array(kept, pa.list_(pa.int64()))], names=["id", "n", "f1", "f2", "sketch"])

    return spread(source.rows).select("id", source.listed(F.col("x")).alias("x")).mapInArrow(make, f"id {_kind(source)}, n long, f1 long, f2 long, sketch array<long>")


def shared(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, i) of pairs (a, b), each once: how many tokens both sets have, exactly.

    What sets are made of is brought to the pairs, not the tokens: once for a and the part of its pairs, and once for each b.
    Pairs of an a that has very many are dealt over parts. A filter by a bounded number of slots of ids spares moving most
    rows that no pair has."""
    source = table.source
    slot = F.pmod(F.xxhash64("id"), F.lit(SLOTS)).cast("int")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).select(slot.alias("slot")).distinct()
    rows = source.rows.where("id is not null").withColumn("slot", slot).join(F.broadcast(wanted), "slot", "left_semi").select("id", "x")
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / SPLIT).alias("parts"))
    dealt = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    asked = dealt.unionByName(dealt.select("a", "part", F.lit(None).cast(_kind(source)).alias("b")).distinct()).withColumn("id", F.coalesce("b", "a"))
    placed = asked.join(rows, "id").repartition("a", "part").sortWithinPartitions("a", "part", "b")  # a's own row has no b: first

    tokens_of = source.tokens()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            first, at, found = batch.column(1).is_null().to_pylist(), [], []
            for row, tokens in enumerate(tokens_of(batch.column(2))):
                if first[row]:
                    own = tokens
                else:
                    at.append(row)
                    found.append(len(np.intersect1d(own, tokens, assume_unique=True)))
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(found, pa.int64())], names=["a", "b", "i"])

    return placed.select("a", "b", source.listed(F.col("x")).alias("x")).mapInArrow(match, f"a {_kind(source)}, b {_kind(source)}, i long")


def kmers(sequences: DataFrame, k: int) -> DataFrame:
    """The sets of k-mers of (id, sequence), those across contig borders included; see of()."""
    return of(Source(sequences.select("id", F.col("sequence").alias("x")), k, lambda x: x, lambda x: map(letters, x.to_pylist())))


def _words(column: pa.Array) -> Iterator[np.ndarray]:
    for x in column:
        yield mixed(x.values.to_numpy().view(np.uint64)) if x.is_valid else np.zeros(0, np.uint64)


def shingles(docs: DataFrame, k: int) -> DataFrame:
    """The sets of k consecutive words of (id, text); see of()."""
    return of(Source(docs.select("id", F.col("text").alias("x")), k, lambda x: F.transform(F.filter(F.split(x, r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w)), _words))
