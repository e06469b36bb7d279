"""Benchmark decontamination by winnowing.

Of every run of ``window - gram + 1`` consecutive word k-grams the one of least hash is kept as a fingerprint, on both
sides; two texts that share ``window`` words share the fingerprint chosen there, so that every shared window is found.
Fingerprints of the documents that also are fingerprints of items are then extended: the windows around them are
compared whole, and the words of matching windows are hit.

The item side is taken in blocks of at most ``BLOCK_WINDOWS`` windows, a longer item in parts that overlap; a block's
sorted hashes (16 bytes a window) go to the executors, so what the driver holds and sends is bounded whatever the
benchmark's size, and each further block is one more pass whose hits are written before the next block is read. No
document row is shuffled unless there are several blocks.

Defined cases: null and wordless texts have no windows; an item of fewer words than the window is one window, its words;
repeated items count each by its own id; items with a null id hit words but are listed nowhere; repeated documents are
judged each. Very long texts are taken alone; without items no word is hit, without documents there is no row; other
columns are never read (or, in clean(), only passed on), whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW, GRAM = 10, 5
#: Windows of one block of the benchmark.
BLOCK_WINDOWS = 1 << 20
#: Words as ALNUM has them, in either case.
_WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
_SCHEMA = "row_text string, doc_id long, n_words long, hits array<int>, item_ids array<long>"


def _winnow(hashes: np.ndarray, run: int) -> np.ndarray:
    """Positions of the least hash of every ``run`` consecutive ones (the first of equals)."""
    if len(hashes) < run:
        return np.zeros(0, np.int64)
    least = np.lib.stride_tricks.sliding_window_view(hashes, run).argmin(axis=1)
    return np.unique(least + np.arange(len(least)))


def _tell(items: list[tuple[int | None, str | None]], window: int, gram: int) -> dict:
    """Sorted window hashes by length with the items that have them, and the fingerprints of whole windows."""
    by: dict[int, list[tuple[int, int | None]]] = {}
    prints: list[np.ndarray] = []
    for _, _, buf, off in C.slices(pa.array([t for _, t in items], pa.string())):
        words = C.Words(buf, off, C.ALNUM, lower=True)
        grams, wins = words.grams(gram), words.grams(window)
        for i in range(len(off) - 1):
            ident = items[i][0]
            a, n = words.first[i], words.first[i + 1] - words.first[i]
            if n >= window:
                by.setdefault(window, []).extend((int(h), ident) for h in wins[a : a + n - window + 1])
                prints.append(grams[a : a + n - gram + 1][_winnow(grams[a : a + n - gram + 1], window - gram + 1)])
            elif n:
                by.setdefault(int(n), []).append((int(words.whole(i)), ident))
        items = items[len(off) - 1 :]
    out: dict = {"prints": np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64), "by": {}}
    for n, pairs in by.items():
        hashes = np.array([h for h, _ in pairs], np.uint64)
        order = np.argsort(hashes, kind="stable")
        ids = [pairs[k][1] for k in order]
        out["by"][n] = (hashes[order], np.array([-1 if x is None else x for x in ids], np.int64), np.array([x is not None for x in ids], bool))
    return out


def _found(sorted_hashes: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_hashes, x)
    at[at == len(sorted_hashes)] = 0
    return sorted_hashes[at] == x if len(sorted_hashes) else np.zeros(len(x), bool)


def _hits(words: C.Words, told: dict, window: int, gram: int) -> list[tuple[int, int, int]]:
    """(word from, word to, window hash) of the windows of all items that occur in the slice's texts."""
    last = np.repeat(words.first[1:], np.diff(words.first))  # where each word's text ends
    found: list[tuple[int, int, int]] = []
    for n, (hashes, _, _) in told["by"].items():
        wins = words.grams(n)
        if not len(wins):
            continue
        inside = np.arange(len(wins)) + n <= last[: len(wins)]
        if n == window:
            grams = words.grams(gram)
            run = window - gram + 1
            # least gram of each run; runs across texts only add fingerprints
            chosen = _winnow(grams, run) if len(grams) >= run else np.zeros(0, np.int64)
            chosen = chosen[_found(told["prints"], grams[chosen])]
            near = np.unique((chosen[:, None] - np.arange(run)).ravel()) if len(chosen) else chosen
            at = near[(near >= 0) & (near < len(wins))]
            at = at[inside[at] & _found(hashes, wins[at])]
        else:
            at = np.flatnonzero(inside & _found(hashes, wins))
        found += [(int(p), int(p) + n, int(wins[p])) for p in at]
    return found


def _scan(told: dict, window: int, gram: int, keep_all: bool, keep_text: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b, buf, off in C.slices(texts):
                words = C.Words(buf, off, C.ALNUM, lower=True)
                spans: dict[int, list[tuple[int, int, int]]] = {}
                for s, e, h in _hits(words, told, window, gram):
                    spans.setdefault(int(np.searchsorted(words.first, s, "right")) - 1, []).append((s, e, h))
                rows = list(range(b - a)) if keep_all else sorted(spans)
                hits, items = [], []
                for i in rows:
                    mark, who = np.zeros(words.first[i + 1] - words.first[i], bool), set()
                    for s, e, h in spans.get(i, ()):
                        mark[s - words.first[i] : e - words.first[i]] = True
                    for n, h in {(e - s, h) for s, e, h in spans.get(i, ())}:
                        hashes, ident, known = told["by"][n]
                        lo, hi = np.searchsorted(hashes, np.uint64(h), "left"), np.searchsorted(hashes, np.uint64(h), "right")
                        who.update(ident[lo:hi][known[lo:hi]].tolist())
                    hits.append(np.flatnonzero(mark).astype(np.int32))
                    items.append(sorted(who))
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        texts.slice(a, b - a).take(at).cast(pa.string()) if keep_text else pa.nulls(len(rows), pa.string()),
                        ids.slice(a, b - a).take(at),
                        pa.array(np.diff(words.first)[rows].astype(np.int64) if rows else [], pa.int64()),
                        pa.array(hits, pa.list_(pa.int32())),
                        pa.array(items, pa.list_(pa.int64())),
                    ],
                    names=["row_text", "doc_id", "n_words", "hits", "item_ids"],
                )

    return scan


def _parts(text: str | None, limit: int, window: int) -> Iterator[tuple[str | None, int]]:
    """The text and its number of words, in parts of at most ``limit`` windows that overlap by a window less one word."""
    if text is None or len(text) <= limit:
        yield text, len(text) // 2 + 1 if text else 0
        return
    spans = [m.span() for m in _WORD.finditer(text)]
    step = max(1, limit)
    for a in range(0, max(1, len(spans) - window + 1), step):
        part = spans[a : a + step + window - 1]
        yield (text[part[0][0] : part[-1][1]] if part else ""), len(part)


def _blocks(benchmark: DataFrame, item_id: str, text: str, limit: int, window: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items, a block of at most about ``limit`` windows at a time; the driver holds one block (and one item)."""
    rows = benchmark.select(F.col(f"`{item_id}`").cast("long"), F.col(f"`{text}`").cast("string")).toLocalIterator()
    block: list[tuple[int | None, str | None]] = []
    size = 0
    for ident, said in rows:
        for part, n in _parts(said, limit, window):
            if block and size + n > limit:
                yield block
                block, size = [], 0
            block.append((ident, part))
            size += n
    yield block


def find(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_words, hits (positions of the hit words), item_ids (sorted)."""
    if not 0 < gram <= window:
        raise ValueError("0 < gram <= window")
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    blocks = _blocks(benchmark, item_col, item_text, block_windows, window)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        return docs.mapInArrow(_scan(_tell(block, window, gram), window, gram, True, False), _SCHEMA).drop("row_text")
    # Several blocks: each pass gives only documents with hits; rows are told apart by id and text.
    none = {"prints": np.zeros(0, np.uint64), "by": {}}
    key = F.sha2("row_text", 256).alias("sha")
    part = None
    while block is not None:
        one = C.materialize(docs.mapInArrow(_scan(_tell(block, window, gram), window, gram, False, True), _SCHEMA).select("doc_id", key, "hits", "item_ids").distinct())
        part = one if part is None else part.unionByName(one)
        block, following = following, next(blocks, None)
    part = part.groupBy("doc_id", "sha").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    base = docs.mapInArrow(_scan(none, window, gram, True, True), _SCHEMA).select("doc_id", key, "n_words")
    both = base.alias("a").join(part.alias("b"), (F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))) & (F.col("a.sha") == F.col("b.sha")), "left")
    return both.select("a.doc_id", "n_words", F.coalesce("hits", F.array().cast("array<int>")).alias("hits"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"))


def clean(documents: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The documents (all their columns) in which no window of the benchmark occurs; a pass for each block, no shuffle; between blocks what is left is written."""
    names, at = documents.columns, documents.columns.index(text_col)

    def keep(told: dict):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, buf, off in C.slices(batch.column(at)):
                    words = C.Words(buf, off, C.ALNUM, lower=True)
                    bad = {int(np.searchsorted(words.first, s, "right")) - 1 for s, _, _ in _hits(words, told, window, gram)}
                    yield batch.slice(a, b - a).filter(pa.array([i not in bad for i in range(b - a)], pa.bool_()))

        return scan

    out = documents.toDF(*[str(k) for k in range(len(names))])
    blocks = _blocks(benchmark, item_col, item_text, block_windows, window)
    block, following = next(blocks), next(blocks, None)
    while block is not None:
        out = out.mapInArrow(keep(_tell(block, window, gram)), out.schema)
        if following is not None:
            out = C.materialize(out)
        block, following = following, next(blocks, None)
    return out.toDF(*names)


def digest(found: DataFrame) -> DataFrame:
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size("hits").cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )
