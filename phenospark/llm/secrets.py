"""Secret scans: patterns of known kinds, and sliding-window Shannon entropy over candidate strings.

Base kinds are found leftmost and non-overlapping: assignments of 12 characters or more to a key that names a secret,
access keys, and hexadecimal runs. Beside them, candidate strings (runs of base-64 characters) are scanned, without what
a base span covers, by a window of ``WINDOW`` characters. The counts of its characters, with them the sum of c*log2(c),
and the counts of its character classes are updated by the character that comes and the one that goes. The classes that a
window holds tell its kind (16, 36 or 64 symbols), and the kind has the entropy to reach; windows that reach it make a
span, joined where they overlap, unless they read as words and numbers. Thresholds are what nine in ten or more of uniform
random windows of a kind reach. Candidates on the allow-list (UUIDs, dotted or slashed paths, words of letters alone, long
runs of digits, anything given) are left alone.

Defined cases: null texts are empty; no span gives an empty string; spans are code points, end exclusive; equal starts are
in the order of kinds; repeated rows are scanned each. Time is linear in a text's length, very long ones are taken alone;
a table without rows gives none; other columns are never read (or, in clean(), only passed on), whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Fixed patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
#: Bits a character that a window must reach, by kind.
THRESHOLDS = {"hex": 3.0, "lower": 3.5, "base64": 3.75}
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Forms that are no secrets.
ALLOWED = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[A-Za-z]+(?:[/_.-][A-Za-z]+)*|[0-9]+(?:[/_.-][0-9]+)*|[=_+/-]+|(.)\1*")
#: Runs of letters in one word, and what no word holds.
_RUN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_VOWEL, _HARD = re.compile(r"[aeiouy]", re.IGNORECASE), re.compile(r"[^aeiouy]{5}", re.IGNORECASE)
_CHANGE = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
_CLOG = [0.0, 0.0] + [c * log2(c) for c in range(2, WINDOW + 2)]


#: Class of a character: digits, a-f, A-F, other small and other capital letters, signs.
_CLASS = {c: k for k, cs in enumerate(("0123456789", "abcdef", "ABCDEF", "ghijklmnopqrstuvwxyz", "GHIJKLMNOPQRSTUVWXYZ", "+/_=-")) for c in cs}


def window_kind(classes: list[int]) -> str:
    """The kind of a window from the counts of its characters' classes."""
    small, capital = classes[1] + classes[3], classes[2] + classes[4]
    if classes[5] or small and capital:
        return "base64"
    return "lower" if classes[3] or classes[4] else "hex"


def reads_as_words(s: str) -> bool:
    """Whether four fifths of the letters are in runs that can be words and digits stand in few groups."""
    runs = _RUN.findall(s)
    good = sum(len(x) for x in runs if len(x) >= 3 and _VOWEL.search(x) and not _HARD.search(x))
    return bool(runs) and 5 * good >= 4 * sum(map(len, runs)) and 5 * len(_CHANGE.findall(s)) <= len(s)


def entropy_spans(s: str, window: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS) -> list[tuple[int, int]]:
    """Spans of ``s`` whose windows reach the entropy of their kind; counts are kept, never recounted."""
    if len(s) < window or ALLOWED.fullmatch(s):
        return []
    counts, classes, total, out = {}, [0] * 6, 0.0, []
    clog = _CLOG if window + 2 <= len(_CLOG) else [0.0, 0.0] + [c * log2(c) for c in range(2, window + 2)]
    for i, ch in enumerate(s):
        n = counts.get(ch, 0)
        counts[ch] = n + 1
        classes[_CLASS[ch]] += 1
        total += clog[n + 1] - clog[n]
        if i >= window:
            old = s[i - window]
            n = counts[old]
            counts[old] = n - 1
            classes[_CLASS[old]] -= 1
            total += clog[n - 1] - clog[n]
        if i < window - 1:
            continue
        kind = window_kind(classes)
        if log2(window) - total / window >= thresholds[kind]:
            a, b = i - window + 1, i + 1
            if kind != "hex" and reads_as_words(s[a:b]):
                continue
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def uncovered(start: int, end: int, covered: list[tuple[int, int]], at: int) -> tuple[list[tuple[int, int]], int]:
    """What sorted spans, from place ``at`` on, leave of start:end, and the place to go on from for a later range."""
    while at < len(covered) and covered[at][1] <= start:
        at += 1
    out, k = [], at
    while k < len(covered) and covered[k][0] < end:
        if covered[k][0] > start:
            out.append((start, covered[k][0]))
        start = max(start, covered[k][1])
        k += 1
    return (out + [(start, end)] if start < end else out), at


def scan_text(text: str, allow: frozenset[str] = frozenset(), window: int = WINDOW) -> list[tuple[str, int, int]]:
    """(kind, start, end), by start, then kind as listed."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    covered: list[tuple[int, int]] = []  # joined, so that starts and ends rise
    for s, e in sorted((s, e) for _, s, e in found):
        if covered and s <= covered[-1][1]:
            covered[-1] = (covered[-1][0], max(e, covered[-1][1]))
        else:
            covered.append((s, e))
    at = 0
    for m in _CANDIDATE.finditer(text):
        if m[0] in allow:
            continue
        parts, at = uncovered(m.start(), m.end(), covered, at)
        if len(parts) == 1 and parts[0] == m.span():
            found += [("entropy", m.start() + a, m.start() + b) for a, b in entropy_spans(m[0], window)]
        else:
            found += [("entropy", s + a, s + b) for s, e in parts for a, b in entropy_spans(text[s:e], window)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", allow: frozenset[str] = frozenset(), keep_text: bool = False) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>>, and redacted (the text without its secrets) if keep_text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _, _ in C.slices(batch.column(1)):
                spans, clean = [], []
                for text in batch.column(1).slice(a, b - a).to_pylist():
                    got = scan_text(text or "", allow)
                    spans.append([{"kind": k, "start": s, "end": e} for k, s, e in got])
                    if keep_text:
                        clean.append(text if not got else redact(text, got))
                cols = [batch.column(0).slice(a, b - a), pa.array(spans, _SPANS)] + ([pa.array(clean, pa.string())] if keep_text else [])
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "spans", "redacted"][: len(cols)])

    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return docs.mapInArrow(scan, "doc_id long, spans array<struct<kind:string,start:long,end:long>>" + ", redacted string" * keep_text)


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "<SECRET>") -> str:
    """The text with every run of overlapping spans replaced by one mark."""
    out, at, covered = [], 0, 0
    for _, s, e in sorted(spans, key=lambda x: x[1:]):
        if s >= covered:
            out += [text[at:s], mark]
        covered = at = max(covered, e)
    return "".join([*out, text[at:]])


def clean(documents: DataFrame, *, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The documents with their secrets replaced by a mark, all other columns kept; n_chars follows the new text."""
    schema, at = documents.schema, documents.columns.index(text_col)
    count = documents.columns.index(chars_col) if chars_col in documents.columns else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _, _ in C.slices(batch.column(at)):
                cols = [batch.column(k).slice(a, b - a) for k in range(batch.num_columns)]
                texts, change = cols[at].to_pylist(), False
                sizes = cols[count].to_pylist() if count is not None else None
                for i, t in enumerate(texts):
                    if t and (got := scan_text(t)):
                        texts[i], change = redact(t, got), True
                        if sizes is not None:
                            sizes[i] = len(texts[i])
                if change:
                    cols[at] = pa.array(texts, cols[at].type)
                    if sizes is not None:
                        cols[count] = pa.array(sizes, cols[count].type)
                yield pa.RecordBatch.from_arrays(cols, names=[str(k) for k in range(len(cols))])

    numbered = documents.toDF(*[str(k) for k in range(len(schema.fields))])
    return numbered.mapInArrow(scan, numbered.schema).toDF(*documents.columns)


def digest(found: DataFrame) -> DataFrame:
    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    def text(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(text(F.filter("spans", lambda x: x["kind"] != "entropy")), 256).alias("base_sha256"),
        text("spans").alias("spans"),
    )
