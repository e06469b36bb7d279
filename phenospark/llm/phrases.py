"""Phrase collocations: count-min sketches choose what may be frequent, a second pass counts that exactly.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``; everything is
counted by language. Each task keeps a sketch of two rows of cells; the sketches are merged block by block, and a
phrase can only be frequent if both its cells reach the support, since cells never count too little. Words are sketched
first, then pairs of words that passed, then longer phrases all of whose pairs passed. Only phrases that pass together with
all their parts are counted exactly, by their text, so that nothing frequent is lost and nothing that a sketch let through by
chance stays. Cells count no further than the support, which is all that is asked of them.

A sketch grows with the corpus, up to 2**MAX_BITS cells a row. Where the corpus asks for more (some 4 * 10**9 occurrences at
a support of 100, in proportion to the support), more phrases pass by chance and the exact count shuffles more; the result is
the same.

A phrase's score is floor(1000 * a * n / (l * r)) of its lowest-scoring cut, in exact decimals. A candidate inside a longer one
that is nearly as frequent goes: since a phrase one word longer inside that one is as frequent at least, only those are looked
at.

Defined cases: null and empty texts have no words; a null language is ``und``; repeated rows count each; ties are told in
best(). A language without a candidate has no rows. Very long texts are taken alone; a table without rows gives none;
other columns are never read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SUPPORT, MOST_WORDS, BEST = 100, 5, 2000
MIN_BITS, MAX_BITS, BLOCK = 16, 26, 1 << 16
FLUSH = 1 << 21  # cells that are kept before they are added up
TOP_BUCKETS = 256
WORD = C.byte_class("00-08 0E-1F 22-2B 2D-2D 2F-39 3C-3E 40-7F")
_BREAK = np.zeros(256, bool)
_BREAK[[10, 11, 12, 13, *b".,;:!?"]] = True
_STEP = np.uint64(0xE7037ED1A0B428DB)


class Pieces:
    """Words of some texts (bytes and offsets) and, for phrases of 1 and more words, which places have one, and hashes."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, langs: list[str]):
        self.words = w = C.Words(buf, offsets, WORD, lower=True)
        self.text = np.repeat(np.arange(len(langs)), np.diff(w.first))
        self.piece = np.cumsum(_BREAK[w.buf])[w.start] + self.text if len(w.start) else w.start
        salt = {x: np.frombuffer(hashlib.blake2b(x.encode(), digest_size=8).digest(), np.uint64)[0] for x in set(langs)}
        self.salt = np.array([salt[x] for x in langs], np.uint64)[self.text] if len(w.start) else np.zeros(0, np.uint64)

    def levels(self, most: int, values: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, places where k words lie in one piece, their hashes)."""
        values = self.words.hash if values is None else values
        h, at = values ^ self.salt, np.arange(len(values))
        yield 1, at, h
        for k in range(2, most + 1):
            inside = np.flatnonzero(at[:] + k - 1 < len(values))
            at, h = at[inside], h[inside]
            same = self.piece[at] == self.piece[at + k - 1]
            at = at[same]
            h = h[same] * _STEP + values[at + k - 1]
            yield k, at, h


def cells(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A phrase's cell in each of the two rows."""
    m = C.mixed(h, bits)
    return (m >> np.uint64(64 - bits)).astype(np.uint32), (m & np.uint64((1 << bits) - 1)).astype(np.uint32)


class Frequent:
    """Which cells of a merged sketch reach the support, as packed bits."""

    def __init__(self, bits: int, rows: np.ndarray):
        self.bits, self.rows = bits, rows  # rows: 2 x 2**bits / 8 bytes

    def may(self, h: np.ndarray) -> np.ndarray:
        a, b = cells(h, self.bits)
        ok = (self.rows[0][a >> 3] >> (a & 7).astype(np.uint8)) & 1 == 1
        at = np.flatnonzero(ok)
        b = b[at]
        ok[at] = (self.rows[1][b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1
        return ok


def _counter(support: int) -> np.dtype:
    return np.dtype(np.uint8 if support < 256 else np.uint16 if support < 65536 else np.uint32)


class Sketch:
    """A task's own sketch; blocks() gives its parts that aren't empty."""

    def __init__(self, bits: int, support: int):
        self.bits, self.support, self.kept, self.size = bits, support, ([], []), 0
        self.rows = [np.zeros(1 << bits, _counter(support)) for _ in range(2)]

    def add(self, h: np.ndarray) -> None:
        for kept, c in zip(self.kept, cells(h, self.bits), strict=True):
            kept.append(c)
        self.size += len(h)
        if self.size >= FLUSH:
            self.flush()

    def flush(self) -> None:
        for row, kept in zip(self.rows, self.kept, strict=True):
            at = np.sort(np.concatenate(kept)) if kept else np.zeros(0, np.uint32)
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
            n = np.diff(np.append(first, len(at)))
            at = at[first]
            row[at] = np.minimum(row[at].astype(np.int64) + n, self.support)
            kept.clear()
        self.size = 0

    def blocks(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(block, gaps, counts), compressed; without gaps the counts are those of all its cells."""
        self.flush()
        for r, row in enumerate(self.rows):
            for b in range(len(row) // BLOCK):
                part = row[b * BLOCK : (b + 1) * BLOCK]
                at = np.flatnonzero(part)
                if len(at) > BLOCK // 12:
                    yield r << 32 | b, b"", _pack(part)
                elif len(at):
                    yield r << 32 | b, _pack(gaps(at)), _pack(part[at])


def _pack(x: np.ndarray) -> bytes:
    return len(x).to_bytes(4, "little") + pa.compress(x.tobytes(), "zstd", asbytes=True)


def _unpack(raw: bytes, kind: np.dtype) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    return np.frombuffer(pa.decompress(raw[4:], n * kind.itemsize, "zstd", asbytes=True), kind)


def gaps(at: np.ndarray) -> np.ndarray:
    """Rising places as the cells left out before each, in bytes; 255 goes on."""
    gap = np.diff(at, prepend=-1) - 1
    last = np.cumsum(gap // 255 + 1) - 1
    out = np.full(last[-1] + 1, 255, np.uint8)
    out[last] = gap % 255
    return out


def places(gap: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(gap < 255)
    return np.cumsum(gap.astype(np.int64))[last] + np.arange(len(last))


def _texts(documents: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))
    return documents.select(F.col(f"`{text_col}`").cast("string").alias("text"), lang.alias("lang"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Pieces, list[str]]]:
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for a, b, buf, offsets in C.slices(batch.column(0)):
            yield Pieces(buf, offsets, langs[a:b]), langs[a:b]


def sketch(texts: DataFrame, bits: int, support: int, choose: Callable[[Pieces], Iterator[np.ndarray]]) -> Frequent:
    """The merged sketch of the hashes that ``choose`` takes from each chunk of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sketch(bits, support)
        for pieces, _ in _chunks(batches):
            for h in choose(pieces):
                own.add(h)
        got = []
        for part in own.blocks():
            got.append(part)
            if len(got) == 64:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*got, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["block", "at", "n"])
                got = []
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*got, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["block", "at", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, sums = _counter(support), {}
        for batch in batches:  # one by one: a block's parts never lie together
            for block, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block not in sums:
                    sums[block] = np.zeros(BLOCK, kind)
                where = places(_unpack(at, np.dtype(np.uint8))) if at else slice(None)
                total = sums[block][where].astype(np.int64) + _unpack(n, kind)
                sums[block][where] = np.minimum(total, support)
        for block, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(total >= support, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    parts = texts.mapInArrow(count, "block long, at binary, n binary").repartition("block")
    rows = np.zeros((2, (1 << bits) // 8), np.uint8)
    for r in parts.mapInArrow(merge, "block long, bits binary").collect():  # a bit for each cell, 16 MB at most
        at = (r.block & 0xFFFFFFFF) * BLOCK // 8
        rows[r.block >> 32][at : at + BLOCK // 8] = np.frombuffer(r.bits, np.uint8)
    return Frequent(bits, rows)


def bits_for(occurrences: int, support: int) -> int:
    """Cells for a mean of a third to two thirds of the support."""
    return min(max(int(1.5 * occurrences / support).bit_length(), MIN_BITS), MAX_BITS)


def chains(pieces: Pieces, most: int, known: list[Frequent]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(k, places, hashes, which may be frequent): those whose parts may be, and that pass the sketch of their length,
    if it is known: of words, of pairs, and of all that is longer."""
    ok = np.ones(len(pieces.text) + 1, bool)
    for k, at, h in pieces.levels(most):
        own = ok[at] & ok[at + 1] if k > 1 else ok[at]  # both phrases of one word less
        if min(k, 3) <= len(known):
            own[own] = known[min(k, 3) - 1].may(h[own])
        yield k, at, h, own
        ok = np.zeros(len(pieces.text) + 1, bool)
        ok[at] = own


def _phrases(pieces: Pieces, k: np.ndarray, at: np.ndarray) -> pa.Array:
    """The text of phrases of k words from these words on, joined by one space."""
    w = pieces.words
    size = w.end - w.start + 1
    to = np.concatenate([[0], np.cumsum(size)])
    source = np.repeat(w.start - to[:-1], size) + np.arange(to[-1])
    raw = np.append(w.buf, np.uint8(32))[source]  # each word and what follows it
    raw[to[1:] - 1] = 32
    a, b = to[at], to[at + k] - 1
    offsets = np.concatenate([[0], np.cumsum(b - a)])
    raw = raw[np.repeat(a - offsets[:-1], b - a) + np.arange(offsets[-1])]
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)).cast(pa.string())


def count(documents: DataFrame, *, support: int = SUPPORT, most: int = MOST_WORDS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, phrase, k, f of the phrases of up to ``most`` words with at least ``support`` occurrences, exactly; for each
    language a row with a null phrase and k = 0 has its number of words. drop() deletes it."""
    texts = _texts(documents, text_col, lang_col)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    some, known = size // 5, []  # words, about
    for first, last in ((1, 1), (2, 2), (3, most))[: min(most, 3)]:

        def choose(pieces: Pieces, first: int = first, last: int = last, known: tuple = tuple(known)) -> Iterator[np.ndarray]:
            return (h[own] for k, _, h, own in chains(pieces, last, known) if k >= first)

        known.append(sketch(texts, bits_for((last - first + 1) * some, support), support, choose))

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces, langs in _chunks(batches):
            per = np.bincount(pieces.text, minlength=len(langs))
            yield _rows([None] * len(langs), langs, np.zeros(len(langs), np.int32), per)
            if not len(pieces.text):
                continue
            other = C._range_hash(C._OTHER[pieces.words.buf], pieces.words.start, pieces.words.end)
            for (k, at, h, own), (_, _, check) in zip(chains(pieces, most, known), pieces.levels(most, other), strict=True):
                at, h, check = at[own], h[own], check[own]
                _, first, group = np.unique(h, return_index=True, return_inverse=True)
                odd = check != check[first][group]  # two phrases of one hash: the second one's places are told one by one
                n = np.bincount(group[~odd], minlength=len(first))
                at = np.concatenate([at[first], at[odd]])
                n = np.concatenate([n, np.ones(int(odd.sum()), np.int64)])
                yield _rows(_phrases(pieces, np.full(len(at), k), at), pa.array(langs, pa.string()).take(pa.array(pieces.text[at])), np.full(len(at), k, np.int32), n)

    exact = texts.mapInArrow(survivors, "lang string, phrase string, k int, n long").groupBy("lang", "phrase", "k").agg(F.sum("n").alias("f"))
    return C.materialize(exact.where(f"phrase is null and f > 0 or f >= {support}"))


def _rows(phrases, langs, k, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([langs if isinstance(langs, pa.Array) else pa.array(langs, pa.string()), phrases if isinstance(phrases, pa.Array) else pa.array(phrases, pa.string()), pa.array(k, pa.int32()), pa.array(n, pa.int64())], names=["lang", "phrase", "k", "n"])


def score(counts: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, n, score of the phrases of 2 words and more: their lowest-scoring cut, ties to the first."""
    total = counts.where("phrase is null").select("lang", F.col("f").alias("n"))
    parts = counts.where("phrase is not null").select("lang", F.col("phrase").alias("part"), "f")
    left, right = (parts.select("lang", F.col("part").alias(x), F.col("f").alias(y)) for x, y in (("left", "l"), ("right", "r")))
    cuts = counts.where("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', cut)")).withColumn("right", F.expr("substring_index(phrase, ' ', cut - k)"))
    known = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(total, "lang")
    value = F.expr("(1000BD * cast(a as decimal(17, 0)) * cast(n as decimal(17, 0))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))")
    least = F.min(F.struct(value.alias("score"), "cut", "a", "l", "r", "n")).alias("m")
    return known.groupBy("lang", "phrase", "k").agg(least).select("lang", "phrase", "k", "m.a", "m.l", "m.r", "m.n", "m.score")


def subsume(scored: DataFrame, percent: int = 100) -> DataFrame:
    """Without phrases that lie in a longer one of ``percent`` of their frequency or more, dropped or not."""
    inner = F.array(F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring_index(phrase, ' ', 1 - k)"))
    longer = scored.where("k > 2").select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    return scored.join(longer, ["lang", "phrase"], "left").where(F.expr(f"most is null or 100 * most < {percent} * a")).drop("most")


def best(scored: DataFrame, keep: int = BEST) -> DataFrame:
    """Each language's first phrases by score, frequency (both falling) and phrase, with their rank from 1."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(TOP_BUCKETS))  # so that no task sorts all phrases of a language
    dealt = scored.withColumn("bucket", bucket)
    dealt = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("rank") <= keep).drop("bucket", "rank")
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= keep)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(documents: DataFrame, *, support: int = SUPPORT, most: int = MOST_WORDS, percent: int = 100, keep: int = BEST, **columns: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to ``most`` words."""
    scored = C.materialize(score(count(documents, support=support, most=most, **columns)))
    return best(subsume(scored, percent), keep)
