"""Toxicity by a learned lexicon: a Levenshtein automaton run over its trie, with context windows.

The lexicon is learned from a bounded sample of labelled training rows (``SAMPLE`` of each class, those of least hash):
words and stems that ``MIN_SHARE`` of the toxic rows hold and that are far likelier there than in clean ones. A text's
tokens are matched against the trie of its terms: a term's own spelling, a stem's continuations, or, for terms of five
letters or more, a spelling one edit away that no clean training row holds. The words around a hit tell quotation from
abuse: inside quotation marks or beside a reporting word it counts half. score = 1 - product of (1 - weight).

The lexicon needs no cap: a term is in at least ``MIN_SHARE`` of the sampled toxic rows, so that there are at most
1 / MIN_SHARE times as many terms as a row has words and stems on average; the clean tokens that only look like one are
among those of the sampled clean rows.

Defined cases: null and empty texts score 0; a row whose label is null is no training row; of repeated label rows any
toxic one counts, repeated documents count each; without labels the lexicon is empty; of terms equally near the one that
sorts first is told. Very long texts are taken alone; a table without rows gives none; other columns are never read (or,
in clean(), only passed on), whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SAMPLE = 10_000
MIN_SHARE, MIN_SUPPORT, MIN_RATIO, MIN_PRECISION = 0.02, 5, 20.0, 0.85
STEM = (4, 10)
FUZZY_FROM, FUZZY_WEIGHT, QUOTED = 5, 0.75, 0.5
CAUTION, SURE, WEAK = 2.0, 3.5, 0.65
CONTEXT = 6
THRESHOLD = 0.7
#: Words that report what others say (fixed values).
REPORTING = frozenset("said says wrote writes quoted quote quotes quoting called term word phrase dit écrit citation dijo escribió cita sagte schrieb zitat".split())
_TOKEN = re.compile(r"\w+(?:[@$!*]\w+)*")
_OPEN, _CLOSE = "\"“«„‘", "\"”»“’"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


class Lexicon:
    """Terms with weights in a trie. stems match with any ending; known holds clean tokens that only look alike."""

    def __init__(self, terms: dict[str, tuple[float, bool]], known: frozenset[str] = frozenset()):
        self.terms, self.known, self.trie = terms, known, {}
        self.stems = {t for t, (_, stem) in terms.items() if stem}
        self.lengths = sorted({len(t) for t in self.stems})
        for term in terms:
            node = self.trie
            for ch in term:
                node = node.setdefault(ch, {})
            node[""] = term
        # One edit leaves the first or the second half of a term as it is.
        long = [t for t in terms if len(t) >= FUZZY_FROM]
        self.heads, self.tails = {t[: len(t) // 2] for t in long}, {t[len(t) // 2 :] for t in long}
        self.cuts = sorted({len(h) for h in self.heads}), sorted({len(t) for t in self.tails})
        self.seen: dict[str, tuple[float, str] | None] = {}

    def may(self, token: str) -> bool:
        return any(token[:k] in self.heads for k in self.cuts[0]) or any(token[-k:] in self.tails for k in self.cuts[1])

    def near(self, token: str, most: int = 1) -> str | None:
        """A term within ``most`` edits: the automaton's states are the live entries of an edit-distance row."""
        if most == 1 and not self.may(token):
            return None
        best: tuple[int, str] | None = None
        n = len(token)
        stack = [(self.trie, {i: i for i in range(min(most, n) + 1)})]
        while stack:
            node, row = stack.pop()
            if "" in node and row.get(n, most + 1) <= most and len(node[""]) >= FUZZY_FROM:
                best = min(best or (9, ""), (row[n], node[""])) if best else (row[n], node[""])
            for ch, child in node.items():
                if ch == "":
                    continue
                nxt: dict[int, int] = {}
                for i in range(min(row) if row else 0, n + 1):
                    d = min(row.get(i, 9) + 1, nxt.get(i - 1, 9) + 1, row.get(i - 1, 9) + (i == 0 or token[i - 1] != ch))
                    if d <= most:
                        nxt[i] = d
                    elif i > max(row) + 1:
                        break
                if nxt:
                    stack.append((child, nxt))
        return best[1] if best else None

    def match(self, token: str) -> tuple[float, str] | None:
        """(weight, term) of a lower-case token; results are kept for the next text."""
        if token in self.seen:
            return self.seen[token]
        found = None
        if token in self.terms:
            found = (self.terms[token][0], token)
        else:
            for k in self.lengths:
                if token[:k] in self.stems:
                    found = (self.terms[token[:k]][0], token[:k])
            if found is None and len(token) >= FUZZY_FROM - 1 and token not in self.known and (term := self.near(token)):
                found = (min(FUZZY_WEIGHT, self.terms[term][0]), term)
        if len(self.seen) > 300_000:
            self.seen.clear()
        self.seen[token] = found
        return found

    def score(self, text: str) -> tuple[float, list[tuple[str, int, int, float]]]:
        """The text's score and its hits (term, start, end, weight)."""
        low = text.lower()
        if len(low) != len(text):  # one letter may become two
            text = low
        tokens = set(_TOKEN.findall(low))
        if not any(self.match(t) for t in tokens):
            return 0.0, []
        hits, left = [], 1.0
        for m in _TOKEN.finditer(low):
            if got := self.match(m[0]):
                weight = got[0] * (QUOTED if _quoted(text, m.start(), m.end()) else 1.0)
                left *= 1 - weight
                hits.append((got[1], m.start(), m.end(), weight))
        return 1 - left, hits

    def __getstate__(self):
        return {"terms": self.terms, "known": self.known}

    def __setstate__(self, state):
        self.__init__(state["terms"], state["known"])


def _quoted(text: str, start: int, end: int) -> bool:
    """Whether quotation marks close around the span, or a reporting word stands before it, within CONTEXT words."""
    before = _TOKEN.findall(text[max(0, start - 12 * CONTEXT) : start].lower())[-CONTEXT:]
    if REPORTING.intersection(before):
        return True
    left = text[max(0, start - 60) : start].split("\n")[-1]
    right = text[end : end + 60].split("\n")[0]
    return any(left.count(a) % 2 == 1 and b in right for a, b in zip(_OPEN, _CLOSE, strict=True) if a == b) or any(left.rfind(a) > left.rfind(b) and b in right for a, b in zip(_OPEN, _CLOSE, strict=True) if a != b)


def fit(documents: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train: Column | None = None) -> Lexicon:
    """Learn the lexicon from at most ``sample`` rows of each class; ``train`` says which labelled ids may be used."""
    ids = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id is not null and y in (0, 1)")
    ids = ids.where(~held_out(F.col("id")) if train is None else train).groupBy("id").agg(F.max("y").alias("y"))
    order = F.xxhash64("id")
    chosen = ids.where("y = 1").orderBy(order, "id").limit(sample).unionByName(ids.where("y = 0").orderBy(order, "id").limit(sample))
    texts = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    rows = texts.join(F.broadcast(chosen), "id").select("y", "text")  # at most 2 * sample ids

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = (Counter(), Counter())
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = set(_TOKEN.findall(text.lower()))
                by[y].update(tokens)
                by[y].update({f"{t[:k]}~" for t in tokens for k in range(STEM[0], min(STEM[1], len(t) - 1) + 1)})
                by[y][" "] += 1
            if sum(map(len, by)) > 200_000:
                yield _counts(by)
                by = (Counter(), Counter())
        yield _counts(by)

    counts = C.materialize(rows.mapInArrow(count, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    n0, n1 = counts.where("term = ' '").agg(F.coalesce(F.sum("n0"), F.lit(0)), F.coalesce(F.sum("n1"), F.lit(0))).first()
    least = max(MIN_SUPPORT, MIN_SHARE * n1)
    ratio = ((F.col("n1") + 0.5) / (n1 + 1)) / ((F.col("n0") + 0.5) / (n0 + 1))
    got = counts.where(f"term <> ' ' and n1 >= {least}").where(ratio >= min(MIN_RATIO, (n0 + 1) * 0.5)).where(f"n1 + 0.5 >= {MIN_PRECISION} * (n0 + n1 + 1)").collect()
    lexicon = Lexicon(choose({r.term: (r.n0, r.n1) for r in got}))
    if not lexicon.terms:
        return lexicon

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [t for t in batch.column(0).to_pylist() if t not in lexicon.terms and lexicon.near(t)]
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.string())], names=["term"])

    clean = counts.where("n0 > 0 and term <> ' ' and not endswith(term, '~')").where(F.length("term").between(FUZZY_FROM - 1, 1 + max(map(len, lexicon.terms)))).select("term")
    known = clean.mapInArrow(alike, "term string").collect()
    return Lexicon(lexicon.terms, frozenset(r.term for r in known))


def _counts(by: tuple[Counter, Counter]) -> pa.RecordBatch:
    terms = list(by[0].keys() | by[1].keys())
    return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([by[0][t] for t in terms], pa.int64()), pa.array([by[1][t] for t in terms], pa.int64())], names=["term", "n0", "n1"])


def surely(hits: int, n: int, z: float) -> float:
    """A lower bound of a share of which ``hits`` of n are known (Wilson's, ``z`` deviations below): a term that few rows
    hold weighs less than one of the same precision that many do. Only a term that is precise ``SURE`` deviations below,
    since many terms are tried, decides alone; others weigh ``WEAK`` at most."""
    p = hits / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def choose(counts: dict[str, tuple[int, int]]) -> dict[str, tuple[float, bool]]:
    """Terms from the counts of words and stems (``abc~``): of stems that one another begin, the longest that keeps 9 of 10
    toxic rows of the shorter; a word that a stem covers is left out."""
    weight = {t: min(0.95 if surely(n1, n0 + n1, SURE) >= THRESHOLD else WEAK, surely(n1, n0 + n1, CAUTION)) for t, (n0, n1) in counts.items()}
    stems: set[str] = set()
    begun = {t[:-1]: n1 for t, (_, n1) in counts.items() if t.endswith("~")}
    for stem in sorted(begun, key=len):
        if any(stem[:k] in begun for k in range(STEM[0], len(stem))):
            continue  # reached from a shorter one
        while longer := [s for s in begun if len(s) == len(stem) + 1 and s.startswith(stem) and begun[s] >= 0.9 * begun[stem]]:
            stem = longer[0]
        stems.add(stem)
    words = {t: (weight[t], False) for t in counts if not t.endswith("~")}
    for stem in stems:
        whole = [w for w in words if w.startswith(stem) and counts[w][1] >= 0.9 * begun[stem]]
        if not whole:
            words = {w: x for w, x in words.items() if not w.startswith(stem)}
            words[stem] = (weight[f"{stem}~"], True)
    return words


def score(documents: DataFrame, lexicon: Lexicon, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, hits array<struct<term, start, end, weight>> of every document, in one pass."""
    kind = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("weight", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _, _ in C.slices(batch.column(1)):
                got = [lexicon.score(t or "") for t in batch.column(1).slice(a, b - a).to_pylist()]
                hits = [[dict(zip(("term", "start", "end", "weight"), h, strict=True)) for h in hs] for _, hs in got]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([s for s, _ in got], pa.float64()), pa.array(hits, kind)], names=["doc_id", "score", "hits"])

    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return docs.mapInArrow(scan, "doc_id long, score double, hits array<struct<term:string,start:long,end:long,weight:double>>")


def clean(documents: DataFrame, lexicon: Lexicon, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents (all their columns) that score below the threshold."""
    at, names = documents.columns.index(text_col), documents.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _, _ in C.slices(batch.column(at)):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array([lexicon.score(t or "")[0] < threshold for t in part.column(at).to_pylist()], pa.bool_()))

    numbered = documents.toDF(*[str(k) for k in range(len(names))])
    return numbered.mapInArrow(scan, numbered.schema).toDF(*names)


def digest(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
