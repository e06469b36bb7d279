"""Best-fit packing by sums of squares.

A text becomes token ids and an end id; longer than a sequence, it is cut into full pieces and a rest. A piece goes where
the sum, over residual gaps, of the squared number of open bins with that gap becomes smallest: opening a bin adds
2*N(L-s)+1, using one of gap g adds 2*(N(g-s)-N(g))+2, and one that it fills 1-2*N(g). Pieces are placed in falling
order of length, so that short ones close the gaps at the end.

Full pieces need no place. The rest are dealt by hash to packers of about ``PACKER_ROWS`` pieces, each one small task;
a packer leaves at most a few bins unfilled. Token ids come from a cache of words: a word's ids don't depend on its
neighbours. Texts with characters whose case or composition libraries treat unlike, or with special tokens, go to the
tokenizer whole.

Defined cases: null and empty texts are the end id alone; repeated rows are packed each; of equal sizes the larger id and
piece comes first, of equal costs the smaller gap is used. Very long texts are taken alone; a table without rows gives
none; other columns are never read, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTH, END_ID, PACKER_ROWS, CACHE_WORDS = 4096, 1, 16_384, 200_000
#: The tokenizer's own split pattern (fixed value), for lower-case texts of the characters below only.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ſ]+|[0-9²³¹¼-¾]|[^\sa-zªµºß-öø-ſ0-9²³¹¼-¾]+")
#: Characters that both libraries lower, compose and split alike.
_UNSAFE = re.compile(r"[^\t\n\r\x20-\x7e\xa0-įĲ-ňŊ-ž]")
_LOADED: dict[str, WordTokenizer] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Merges:
    """Byte-pair merging of many words at once: each round applies to every word its merge of least rank."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, vocab: dict[str, int], merges: list):
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        char = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in shown)}
        self.inner = np.array([vocab[char[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[f"{char[b]}</w>"] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.merged = np.array([vocab[x + y] for x, y in pairs], np.int32)
        keys = np.array([vocab[x] << 16 | vocab[y] for x, y in pairs], np.uint32)
        self.shift = np.uint32(32 - max(4, (8 * len(keys)).bit_length()))
        self.keys, self.ranks = np.zeros(1 << (32 - int(self.shift)), np.uint32), np.full(1 << (32 - int(self.shift)), self.NONE)
        self.probes = 1
        for rank, key in enumerate(keys.tolist()):
            at, k = (key * 2654435761 % 2**32) >> int(self.shift), 1
            while self.ranks[at] != self.NONE and self.keys[at] != key:
                at, k = (at + 1) % len(self.keys), k + 1
            if self.ranks[at] == self.NONE:
                self.keys[at], self.ranks[at] = key, rank
            self.probes = max(self.probes, k)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)
        at = (key * np.uint32(2654435761)) >> self.shift
        out = np.where(self.keys[at] == key, self.ranks[at], self.NONE)
        open_ = np.flatnonzero((out == self.NONE) & (self.ranks[at] != self.NONE))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + np.uint32(1)) & np.uint32(len(self.keys) - 1)
            here = at[open_]
            out[open_] = np.where(self.keys[here] == key[open_], self.ranks[here], self.NONE)
            open_ = open_[(out[open_] == self.NONE) & (self.ranks[here] != self.NONE)]
        return out

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, one after another; number of ids of each). No word is empty."""
        raw, sizes = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64)
        ids, word = self.inner[raw], np.repeat(np.arange(len(words)), sizes)
        ends = np.cumsum(sizes) - 1
        ids[ends] = self.last[raw[ends]]
        done_ids, done_words = [], []
        while len(ids):
            rank = np.full(len(ids), self.NONE)
            same = np.flatnonzero(word[:-1] == word[1:])
            rank[same] = self.rank(ids[same], ids[same + 1])
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            counts = np.diff(np.append(first, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, first), counts)
            live = least < self.NONE
            if not live.all():
                done_ids.append(ids[~live])
                done_words.append(word[~live])
                ids, word, rank, least = ids[live], word[live], rank[live], least[live]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == least)
            # of hits that overlap, every second one goes
            begin = np.concatenate(([True], np.diff(hit) != 1))
            within = np.arange(len(hit)) - np.maximum.accumulate(np.where(begin, np.arange(len(hit)), 0))
            hit = hit[within % 2 == 0]
            ids[hit] = self.merged[rank[hit]]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            ids, word = ids[keep], word[keep]
        ids, word = np.concatenate([np.zeros(0, np.int32), *done_ids]), np.concatenate([np.zeros(0, np.int64), *done_words])
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))


class WordTokenizer:
    """Ids as little-endian unsigned 32-bit bytes. The distinct words of a slice are looked up by hash among those met
    before, and new ones merged together; then the ids of all words are gathered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        model = json.loads(self.inner.to_str())["model"]
        self.merges = Merges(model["vocab"], model["merges"])
        # words met: sorted hashes, where their ids begin in ``ids``, and how many they are
        self.known, self.start, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    @classmethod
    def load(cls, path: str) -> WordTokenizer:
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def whole(self, text: str) -> bytes:
        return np.array(self.inner.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = {i: self.whole(t) for i, t in enumerate(texts) if "<|" in t or _UNSAFE.search(t)}
        raw = [b"" if i in odd else t.lower().replace("\xa0", " ").encode() for i, t in enumerate(texts)]
        offsets = np.cumsum(np.array([0, *map(len, raw)]))
        words = C.Words(np.frombuffer(b"".join(raw), np.uint8), offsets, C.NOT_SPACE, lower=False)
        kinds, first, which = np.unique(words.hash, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, kinds)
        at[at == len(self.known)] = 0
        old = self.known[at] == kinds if len(self.known) else np.zeros(len(kinds), bool)
        start, size = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
        start[old], size[old] = self.start[at[old]], self.size[at[old]]
        new = np.flatnonzero(~old)
        data = words.buf.tobytes()
        ids, size[new] = self._learn([data[x:y].decode() for x, y in zip(words.start[first[new]].tolist(), words.end[first[new]].tolist(), strict=True)])
        start[new] = len(self.ids) + np.cumsum(size[new]) - size[new]
        ids = np.concatenate([self.ids, ids])
        if len(self.known) < CACHE_WORDS and len(new):
            order = np.argsort(known := np.concatenate([self.known, kinds[new]]))
            self.known, self.start, self.size = known[order], np.concatenate([self.start, start[new]])[order], np.concatenate([self.size, size[new]])[order]
            self.ids = ids
        count = size[which]
        ends = np.cumsum(count)
        out = ids[np.repeat(start[which] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.concatenate(([0], ends))[words.first].tolist()
        return [odd[i] if i in odd else out[a:b].tobytes() for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]

    def _learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that white space bounds, one after another, and how many each has."""
        parts = [_SPLIT.findall(c) for c in chunks]
        ids, sizes = self.merges([w.encode() for ws in parts for w in ws])
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))[np.cumsum(np.array([0, *(len(ws) for ws in parts)]))]
        return ids.astype("<u4"), np.diff(ends)


def pieces(documents: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if keep_ids, ids (binary, little-endian unsigned 32-bit)."""
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = WordTokenizer.load(tokenizer)
        for batch in batches:
            for a, b, _, _ in C.slices(batch.column(1)):
                who, rows = [], []
                texts = batch.column(1).slice(a, b - a).to_pylist()
                for i, ids in enumerate(tok.encode([t or "" for t in texts])):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * length)):
                        part = ids[at : at + 4 * length]
                        who.append(a + i)
                        rows.append((k, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                arrays = [batch.column(0).take(pa.array(who, pa.int64()))] + [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays[: 5 + keep_ids], names=names[: 5 + keep_ids])

    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return docs.mapInArrow(scan, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def place(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, in falling order of size; ties in input order."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    count = np.zeros(length + 1, np.int64)  # open bins by gap
    having: list[list[int]] = [[] for _ in range(length + 1)]
    opened = 0
    for i in order.tolist():
        s = int(sizes[i])
        # change of the sum for gaps s .. length-1, and for a new bin (gap length)
        rest = count[: length - s + 1].copy()
        rest[0] = 0
        cost = 2 * (rest - count[s:]) + 2
        cost[0] -= 1  # a filled bin is no open one
        cost[:-1][count[s:-1] == 0] = np.iinfo(np.int64).max
        cost[-1] = 2 * rest[-1] + (s < length)
        g = s + int(cost.argmin())
        if g == length:
            b, opened = opened, opened + 1
        else:
            b = having[g].pop()
            count[g] -= 1
        bins[i], offsets[i] = b, length - g
        if g > s:
            having[g - s].append(b)
            count[g - s] += 1
    return bins, offsets


def pack(parts: DataFrame, *, length: int = LENGTH, packer_rows: int = PACKER_ROWS) -> DataFrame:
    """parts with sequence_id and offset. ``parts`` should be a written table: it is read twice."""
    total = parts.where(F.col("length") < length).count()
    packers = max(1, round(total / packer_rows))
    schema = parts.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema

    def put(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([c for c in ("length", "doc_id", "piece", "ids_crc32") if c in rows], ascending=False, kind="stable", ignore_index=True)
        bins, offsets = place(rows["length"].to_numpy(), length)
        return rows.assign(sequence_id=bins + (int(key[0]) << 32), offset=offsets)

    full = parts.where(F.col("length") >= length).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    # The row's place in the written table is part of the hash, so that repeated rows spread over all packers.
    dealt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "start", F.monotonically_increasing_id()), F.lit(packers))
    rest = parts.where(F.col("length") < length).groupBy(dealt.alias("packer")).applyInPandas(put, schema)
    return full.unionByName(rest)
