"""Phrases, quality and runs against plain versions, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phenospark.llm import common as C
from phenospark.llm import phrases, quality, queries, runs

CLASH = "doc_id long, text string, lang string, source string, n_chars long, word string, block long, phrase string, k int, id long, score double, runs string, h long"


def docs(spark, texts, langs=None, ids=None):
    rows = [(i if ids is None else ids[i], t, "en" if langs is None else langs[i], "s", 0, "w", 1, "p", 2, 3, 0.5, "r", 4) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, CLASH)


# --- runs ----------------------------------------------------------------------------------------


def runs_brute(w, least=12):
    seen = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > start and i + q - start >= max(least, 2 * q):
                seen.setdefault((start, i + q), q)
            i += i == start
    return sorted(((s, e - s, q) for (s, e), q in seen.items()), key=lambda r: (r[0], r[2]))


def collapsed_brute(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic(rng, n, vocab):
    w = [f"w{rng.randrange(vocab)}" for _ in range(n)]
    if n and rng.random() < 0.6:
        a, p = rng.randrange(n), rng.randrange(1, 7)
        w = [w[i] if i < a else w[min(n - 1, a + (i - a) % p)] for i in range(n)]
    return w


@pytest.mark.parametrize("least", [2, 12])
def test_runs(spark, least):
    rng = random.Random(least)
    texts = [" \t".join(periodic(rng, rng.randrange(0, 70), rng.choice([1, 2, 3, 9]))) for _ in range(300)] + [None, "", " \n "]
    for r in runs.find(docs(spark, texts), least=least).collect():
        w = (texts[r.doc_id] or "").split()
        want = runs_brute(w, least)
        assert [tuple(x) for x in r.runs] == want and r.n_words == len(w)
        assert r.collapsed == collapsed_brute(w, want)


def test_runs_of_long_text():
    n = 300_000
    w = ["a", "b"] * (n // 2)
    for _, _, buf, offsets in C.slices(pa.array([" ".join(w)])):
        words = C.Words(buf, offsets, C.NOT_SPACE, lower=False)
        got = runs.Tree(runs.number(words), np.zeros(n, np.int64), np.full(n, n)).runs(12)
    assert [x.tolist() for x in got] == [[0], [n], [2]]


def test_runs_fibonacci():
    a, b = ["a"], ["a", "b"]
    while len(b) < 400:
        a, b = b, b + a
    word = np.array([x == "b" for x in b], np.int64)
    got = runs.Tree(word, np.zeros(len(b), np.int64), np.full(len(b), len(b))).runs(2)
    assert [(int(s), int(e - s), int(p)) for s, e, p in zip(*got, strict=True)] == runs_brute(b, 2)


def test_runs_query(spark, tmp_path):
    rng = random.Random(5)
    texts = [" ".join(periodic(rng, rng.randrange(0, 120), 40)) for _ in range(400)] + [None, ""]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op13_runs(spark, str(tmp_path)).collect()}
    planted = 0
    for i, t in enumerate(texts):
        w = (t or "").split()
        h, n = zlib.crc32(str(i).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            planted += 1
        found = runs_brute(w)
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        r = got[i]
        assert r.n_runs == len(found)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed_brute(w, found).encode()).hexdigest()
    assert planted > 20 and len(got) == len(texts)


# --- phrases -------------------------------------------------------------------------------------


def phrases_brute(rows, support, most, percent, keep):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            counts.update((lang or "und", tuple(w[i : i + k])) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    cands = {(x, p): f for (x, p), f in counts.items() if len(p) > 1 and f >= support}
    out = {}
    for (x, p), a in cands.items():
        if any(y == x and len(q) > len(p) and 100 * f >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (y, q), f in cands.items()):
            continue
        cuts = [(1000 * a * total[x] // (counts[x, p[:k]] * counts[x, p[k:]]), k) for k in range(1, len(p))]
        s, k = min(cuts)
        out.setdefault(x, []).append((-s, -a, " ".join(p).encode(), counts[x, p[:k]], counts[x, p[k:]], total[x]))
    return sorted((x, i + 1, p.decode(), -a, left, right, n, -s) for x, got in out.items() for i, (s, a, p, left, right, n) in enumerate(sorted(got)[:keep]))


@pytest.mark.parametrize(("support", "percent", "keep"), [(3, 100, 2000), (3, 80, 5), (300, 100, 50)])
def test_phrases(spark, support, percent, keep):
    rng = random.Random(support)
    texts, langs = [], []
    for i in range(90):
        w = [rng.choice(["A", "b", "ü", "C", "d e", "f,", "g.", "h\t", "中", "x!y", "\n"]) for _ in range(rng.randrange(0, 60))]
        texts.append(" ".join(w) if i % 9 else [None, "", " ., "][i % 3])
        langs.append([None, "en", "de", "en", "und"][i % 5])
    texts += [" ".join(["z"] * 400), texts[1], texts[1]]
    langs += ["en", langs[1], langs[1]]
    got = phrases.mine(docs(spark, texts, langs), support=support, percent=percent, keep=keep).collect()
    assert sorted(map(tuple, got)) == phrases_brute(zip(texts, langs, strict=True), support, 5, percent, keep)


@pytest.mark.parametrize("support", [100, 300, 70_000])
def test_sketch_never_counts_too_little(support):
    rng = np.random.default_rng(support)
    bits = 16
    h = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    often = np.concatenate([np.full(10, support), np.full(len(h) - 10, 1)])
    parts = [phrases.Sketch(bits, support) for _ in range(3)]
    for i, x in enumerate(np.array_split(rng.permutation(np.repeat(h, often)), 3)):
        parts[i].add(x)
    sums = np.zeros((2, 1 << bits), np.int64)
    for part in parts:
        for block, at, n in part.blocks():
            n = phrases._unpack(n, phrases._counter(support)).astype(np.int64)
            sums[block >> 32, phrases.places(phrases._unpack(at, np.dtype(np.uint8))) if at else slice(None)] += n
    bitmap = np.packbits(sums >= support, axis=1, bitorder="little")
    ok = phrases.Frequent(bits, bitmap).may(h)
    assert ok[:10].all() and ok[10:].mean() < 0.01


def test_gaps():
    for at in ([0], [65535], [0, 1, 2], [254, 255, 256, 511, 2000, 65535], list(range(0, 65536, 255))):
        assert phrases.places(phrases.gaps(np.array(at))).tolist() == at


def test_phrase_scores_are_exact(spark):
    big = 10**14 + 7
    rows = [("en", None, 0, 9 * 10**15 + 1), ("en", "a", 1, big), ("en", "b", 1, big + 2), ("en", "a b", 2, big - 5)]
    (r,) = phrases.score(spark.createDataFrame(rows, "lang string, phrase string, k int, f long")).collect()
    assert r.score == 1000 * (big - 5) * (9 * 10**15 + 1) // (big * (big + 2))


# --- quality -------------------------------------------------------------------------------------


def made(rng, good):
    w = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(8, 60))]
    return " ".join(w) + "." if good else " ".join(x + rng.choice(["###", "$$$", " |"]) for x in w)


def test_quality_held_out(spark):
    rng = random.Random(2)
    truth = [i % 4 != 0 for i in range(900)]
    texts = [made(rng, y) for y in truth]
    labels = spark.createDataFrame([(i, int(y), 0) for i, y in enumerate(truth)], "doc_id long, quality int, toxic int")
    table = docs(spark, texts)
    model = quality.fit(table, labels)
    got = quality.digest(quality.score(table, model)).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got) and 0 <= min(r.score for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.99 * len(held)
    turned = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - quality else quality end as quality")
    assert np.array_equal(quality.fit(table, turned).weights, model.weights)  # held-out labels change nothing


def test_quality_against_plain_ftrl():
    rng = random.Random(3)
    rows = []
    for i in range(120):
        at = np.array(sorted(rng.sample(range(40), 6)))
        rows.append((at, np.full(6, 1 / 6, np.float32), int(sum(at) > 110 + rng.randrange(20))))
    model = quality.train(rows)
    z, n = Counter(), Counter()

    def weight(i):
        if i != "bias" and abs(z[i]) <= quality.L1:
            return 0.0
        l1, l2 = (0, 0) if i == "bias" else (quality.L1, quality.L2)
        return -(z[i] - math.copysign(l1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + l2)

    for _ in range(quality.EPOCHS):
        for at, value, y in rows:
            x = {int(i): float(v) * quality.SCALE for i, v in zip(at, value, strict=True)} | {"bias": 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = x[i] * (p - y)
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w[i]
                n[i] += g * g
    assert abs(model.bias - weight("bias")) < 1e-5
    assert all(abs(model.weights[i] - weight(i)) < 1e-4 for i in range(40))


def test_quality_slots_do_not_depend_on_neighbours():
    texts = ["Ab cd-e!", "", "Ünder 12x\n| a", "x", "?! b"]
    (_, _, buf, offsets), = C.slices(pa.array(texts))
    at, text = quality.slots(buf, offsets)
    for i, t in enumerate(texts):
        (_, _, b, o), = C.slices(pa.array([t]))
        assert sorted(quality.slots(b, o)[0]) == sorted(at[text == i])
    w = re.findall(r"\w+|[^\w\s]+", texts[0])
    assert (text == 0).sum() == 2 * len(w) + 2 * (len(w) - 1) + len(w) - 2


# --- all three -----------------------------------------------------------------------------------


def test_edges(spark):
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(900)}" for _ in range(200_000))
    texts = [None, "", " \n\t", "one", long, long, "é" * 40_000, "a a a a a a a a a a a a a"]
    table = docs(spark, texts, langs=[None, "en", "en", "de", "en", "en", "fr", None])
    assert {r.doc_id: r.n_words for r in runs.find(table).collect()}[4] == 200_000
    model = quality.fit(table, spark.createDataFrame([(4, 1, 0), (6, 0, 0), (3, None, 0), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int"), use=None)
    got = {r.doc_id: r.score for r in quality.score(table, model).collect()}
    assert got[0] == got[1] == got[2] and got[4] == got[5] and len(got) == 8
    mined = phrases.mine(table, support=100).collect()
    assert all(r.lang == "en" and r.a % 2 == 0 for r in mined)  # equal rows count each
    none = table.limit(0)
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(none, nothing).weights is None
    assert not runs.find(none).count() and not quality.score(none, quality.Model()).count() and not phrases.mine(none).count()
    assert {r.score for r in quality.score(table, quality.fit(table, nothing)).collect()} == {0.5}
    same = docs(spark, ["b b b", "b b b", None], ids=[7, 7, None])
    assert runs.digest(runs.find(same)).count() == 3 and quality.digest(quality.score(same, model)).count() == 3


def test_jaccard_moves_common_tokens_only(spark):
    """Prefix tokens of one holder are not shuffled with the others; places and holders of common ones stay."""
    from phenospark.llm import jaccard as J

    rows = [(i, [7, *range(1000 * i, 1000 * i + 100), -i % 2]) for i in range(1, 41)]
    table = spark.createDataFrame(rows, "node long, tokens array<long>")
    common = spark.createDataFrame([(7, 40), (0, 20), (1, 20)], "token long, m long")
    got = {(r.token, r.place, r.node) for r in J._held(table, common).collect()}
    asked = {(t, k, i) for i, ts in rows for k, t in enumerate(ts) if t in (0, 1, 7)}
    assert asked <= got and len(got) < len(asked) + 40


def test_id_filter_is_packed_in_tasks(spark, monkeypatch):
    """The driver gets a filter's bytes in few rows, not a row for each word of it."""
    kind, sent = type(spark.range(0)), []
    for name in ("collect", "toPandas"):

        def told(self, f=getattr(kind, name)):
            got = f(self)
            sent.append(len(got))
            return got

        monkeypatch.setattr(kind, name, told)
    bits = C.id_filter(F.col("id"), spark.range(200_000))
    assert sum(sent) <= 32 * len(bits) / C.BLOCK_BITS
    assert spark.range(200_000).select(C.slot_of(F.col("id"), bits).alias("s")).toPandas().s.map(lambda s: C.passes(bits, np.array([s]))[0]).all()
    assert sum(int(x).bit_count() for x in bits) <= 200_000


def test_materialize_collects_garbage(spark, monkeypatch):
    """The driver's garbage is collected after a table is written, but only where the heap has grown."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Young" not in b.getName() and "Concurrent" not in b.getName())
    monkeypatch.setattr(C, "FULL", 0.0, raising=False)
    before = full()
    C.materialize(spark.range(10))
    assert full() > before
    monkeypatch.setattr(C, "FULL", 2.0)
    before = full()
    C.materialize(spark.range(10))
    assert full() == before


def test_jaccard_brings_sets_to_few_pairs(spark, monkeypatch):
    """Of a group of near copies not all pairs are compared, only so many that none stands apart."""
    from phenospark.llm import jaccard as J

    words = [f"w{i}" for i in range(300)]
    texts = [" ".join([*words[:k], f"x{k}", *words[k + 1 :]]) for k in range(20, 140, 10)]
    texts += [" ".join(f"{c}{i}" for i in range(200)) for c in "yz"] + [" ".join(f"y{i}" for i in range(199))]
    edges, components = [], C.components
    monkeypatch.setattr(C, "components", lambda e, *a: (edges.append(e.count()), components(e, *a))[1])
    got = {r.doc_id: r.component_id for r in J.components(docs(spark, texts), shingle=3, percent=90).collect()}
    assert got == {i: 0 if i < 12 else 12 if i in (12, 14) else i for i in range(15)}
    assert max(edges) < 2 * 12
