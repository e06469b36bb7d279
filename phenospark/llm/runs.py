"""Periodic runs: maximal stretches of words that repeat with a period, by a suffix tree of each document.

The suffix tree is kept as its leaves in order (the sorted suffixes) with the depth of the node that parts neighbouring
leaves; where a node has several children they are parted one after the other. At each parting of depth d the leaves of the
smaller side are gone through (Stoye and Gusfield): where the suffix d words further, or d words before, is a leaf of the
other side, two equal stretches of d words meet, and the next word breaks the repeat: a branching tandem repeat. A leaf lies
on a smaller side at most log2(n) times. Each repeat is rotated to the left as far as the words agree, which gives the
run that ends where the repeat does; repeats of one run (its period's multiples among them) are merged into its smallest
period. All of it is done in numpy for the documents of some text at once, each with a tree of its own.

Suffixes are sorted by doubling; only those still alike are sorted again. Ranks by the first 2**k words are kept for the
rotation, so that memory is in proportion to the words times the logarithm of the longest repeat.

Defined cases: null, empty and blank texts have no words and no runs, and collapse to an empty text; documents repeated under
one id are rows each; ties between runs are told in digest(). Very long texts are taken alone; a table without rows gives
none; other columns are never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MIN_LENGTH = 12
CHUNK_BYTES = 1 << 19  # of text whose trees are built together
PAIRS = 1 << 20  # leaves of smaller sides that are looked at together
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
RUNS_SQL = "array<struct<start:long,length:long,period:long>>"


class Tree:
    """Suffix trees of documents: word numbers ``word``, where ``begin`` and ``end`` are each word's document's bounds.

    ``order`` are the leaves, ``depth[i]`` the depth at which leaf i parts from leaf i - 1 (0: other word or document),
    ``ranks[k]`` the places of suffixes by their first 2**k words, the last of them all different."""

    def __init__(self, word: np.ndarray, begin: np.ndarray, end: np.ndarray):
        n = len(word)
        self.begin, self.end = begin, end
        key = begin.astype(np.int64) * (int(word.max(initial=0)) + 1) + word
        self.order = np.argsort(key, kind="stable").astype(np.int32)
        self.depth = np.zeros(n + 1, np.int32)
        key = key[self.order]
        at, alike = self._groups(np.arange(n, dtype=np.int32), np.concatenate([[True], key[1:] != key[:-1]]) if n else np.zeros(0, bool))
        rank = np.empty(n, np.int32)
        rank[self.order] = at
        self.ranks = [rank]
        active = np.flatnonzero(alike)
        while len(active):
            self._double(active, len(self.ranks) - 1)
            rank = self.ranks[-1]
            found = rank[self.order[active]]
            many = np.bincount(found - found[0])[found - found[0]] > 1
            active = active[many]

    @staticmethod
    def _groups(places: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place where each one's group begins, and whether the group has others."""
        number = np.cumsum(first) - 1
        return places[np.flatnonzero(first)][number] if len(places) else places, np.bincount(number)[number] > 1 if len(places) else first

    def _double(self, active: np.ndarray, k: int) -> None:
        """Sort the leaves at these places, alike in 2**k words, by twice as many."""
        rank, step = self.ranks[k], 1 << k
        p = self.order[active].astype(np.int64)
        group = rank[p].astype(np.int64)
        far = p + step
        inside = far < self.end[p]
        second = np.where(inside, rank[np.where(inside, far, 0)].astype(np.int64) + 1, 0)
        by = np.argsort(group * (len(rank) + 1) + second, kind="stable")
        p, second = p[by], second[by]  # groups stay where they are
        self.order[active] = p
        new_group = np.concatenate([[True], group[1:] != group[:-1]])
        first = new_group.copy()
        first[1:] |= second[1:] != second[:-1]
        at, _ = self._groups(active.astype(np.int32), first)
        new = rank.copy()
        new[p] = at
        self.ranks.append(new)
        split = np.flatnonzero(first & ~new_group)
        self.depth[active[split]] = self._common(p[split - 1], p[split], k)

    def _common(self, i: np.ndarray, j: np.ndarray, k: int) -> np.ndarray:
        """How many first words two suffixes share that share 2**k, but not twice as many."""
        length = np.full(len(i), 1 << k, np.int64)
        for b in range(k - 1, -1, -1):
            x, y = i + length, j + length
            ok = (x < self.end[i]) & (y < self.end[j])
            same = ok & (self.ranks[b][np.where(ok, x, 0)] == self.ranks[b][np.where(ok, y, 0)])
            # Two suffixes of the same rank share 2**b words: one that ends before is told apart by its end.
            length += same.astype(np.int64) << b
        return length

    def partings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, low, high) of each parting below a root: leaves low..place-1 are its left side, place..high-1 its right."""
        depth = self.depth
        at = np.flatnonzero(depth > 0)
        if not len(at):
            return at, at, at
        d = depth[at]
        edges = np.flatnonzero(depth == 0)
        levels = [depth]  # least depth of 2**k from each on
        for k in range(int(np.diff(edges).max()).bit_length() - 1):
            levels.append(np.minimum(levels[-1][: -(1 << k)], levels[-1][1 << k :]))
        low, high = at.copy(), at + 1
        for k in range(len(levels) - 1, -1, -1):
            least = levels[k]
            to = low - (1 << k)
            ok = to >= 0
            low = np.where(ok & (least[np.where(ok, to, 0)] >= d), to, low)
            ok = high < len(least)
            high = np.where(ok & (least[np.where(ok, high, 0)] > d), high + (1 << k), high)
        return at, low - 1, high

    def repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, period) of the branching tandem repeats."""
        at, low, high = self.partings()
        if not len(at):
            return at, at
        depth, place = self.depth[at].astype(np.int64), self.ranks[-1]
        left = at - low <= high - at
        size = np.where(left, at - low, high - at)
        small = np.where(left, low, at)
        other = np.where(left, at, low), np.where(left, high, at)
        starts, periods = [], []
        total = np.cumsum(size)
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, "right")))
            which = np.repeat(np.arange(a, b), size[a:b])
            leaf = small[which] + np.arange(len(which)) - (total[a:b] - size[a:b] - (total[a - 1] if a else 0))[which - a]
            i, d = self.order[leaf].astype(np.int64), depth[which]
            lo, hi = other[0][which], other[1][which]
            for sign in (1, -1):
                j = i + sign * d
                ok = (j < self.end[i]) & (j >= self.begin[i])
                r = place[np.where(ok, j, 0)]
                hit = np.flatnonzero(ok & (r >= lo) & (r < hi))
                starts.append(np.minimum(i, j)[hit])
                periods.append(d[hit])
            a = b
        return np.concatenate(starts), np.concatenate(periods)

    def runs(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, period) of the maximal runs of at least so many words, by start, then period."""
        start, period = self.repeats()
        end, top = start + 2 * period, start
        for k in range(len(self.ranks) - 2, -1, -1):
            to = start - (1 << k)
            ok = to >= self.begin[top]
            same = ok & (self.ranks[k][np.where(ok, to, 0)] == self.ranks[k][np.where(ok, to + period, 0)])
            start = np.where(same, to, start)
        by = np.lexsort((period, end, start))
        start, end, period = start[by], end[by], period[by]
        keep = np.ones(len(start), bool)
        keep[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])  # the smallest period of a stretch
        keep &= end - start >= least
        start, end, period = start[keep], end[keep], period[keep]
        by = np.lexsort((period, start))
        return start[by], end[by], period[by]


def number(words: C.Words) -> np.ndarray:
    """The same number for the same words, told apart by two hashes, and by their bytes should these disagree."""
    _, first, out = np.unique(words.hash, return_index=True, return_inverse=True)
    check = words.check(np.arange(len(words.hash)), 1)
    if (check[first][out] != check).any():
        seen: dict[bytes, int] = {}
        raw = words.buf.tobytes()
        out = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(words.start, words.end, strict=True)], np.int64)
    return out


def joined(words: C.Words, keep: np.ndarray) -> pa.Array:
    """Of each text the words of the mask, joined by one space."""
    start, end = words.start[keep], words.end[keep]
    per = np.concatenate([[0], np.cumsum(keep)])[words.first]  # kept words before each text
    size = end - start + 1
    to = np.concatenate([[0], np.cumsum(size)])
    source = np.repeat(start - to[:-1], size) + np.arange(to[-1])
    raw = np.append(words.buf, np.uint8(32))[np.minimum(source, len(words.buf))]
    raw[to[1:] - 1] = 32
    # The space after a text's last word goes.
    last = np.unique(per[1:][per[1:] > per[:-1]])
    gone = to[last] - 1
    raw = np.delete(raw, gone)
    offsets = to[per] - np.searchsorted(gone, to[per], "left")
    return pa.LargeStringArray.from_buffers(len(per) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)).cast(pa.string())


def find(documents: DataFrame, *, least: int = MIN_LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (word numbers from 0, by start, then period), collapsed (the text without what repeats a run's
    first period) of every document, in one pass without a shuffle."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in C.slices(batch.column(1), CHUNK_BYTES):
                words = C.Words(buf, offsets, C.NOT_SPACE, lower=False)
                first, counts = words.first, np.diff(words.first)
                tree = Tree(number(words), np.repeat(first[:-1], counts), np.repeat(first[1:], counts))
                start, end, period = tree.runs(least)
                text = np.searchsorted(first, start, "right") - 1
                inside = np.bincount(start + period, minlength=len(words.start) + 1) - np.bincount(end, minlength=len(words.start) + 1)
                keep = np.cumsum(inside)[: len(words.start)] == 0
                values = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - first[text], end - start, period)], fields=list(RUNS.value_type))
                at = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=b - a))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(at), values).cast(RUNS), joined(words, keep)], names=["doc_id", "n_words", "runs", "collapsed"])

    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return docs.mapInArrow(scan, f"doc_id long, n_words long, runs {RUNS_SQL}, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """Of the runs the number, the longest (ties: smallest start, then period) and hashes of all and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("b.length"), -F.col("b.period")
    return told.select("doc_id", "n_runs", (-F.col("b.start")).alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * b.length div -b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
