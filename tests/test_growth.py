"""What is written, broadcast and kept while tables grow."""

import random
from pathlib import Path

from phenospark.operators import lineage, sets, similarity


def test_sets_are_not_written(spark):
    """Clusters write less than the sequences have letters, not eight bytes a token; shuffle files of a table's write go with it."""
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("ACGT") for _ in range(20_000))) for i in range(40)]
    rows += [(100 + i, x[:9_000] + "A" + x[9_000:]) for i, x in rows[:4]]
    seqs = spark.createDataFrame(rows, "id long, sequence string")
    folder = Path(lineage.shared(spark).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    before = size()
    got = {r.id: r.root for r in similarity.linked(sets.kmers(seqs, 21), 0.02, 21).collect()}
    assert got == {i: i - 100 if i >= 100 else i for i, _ in rows}
    assert size() - before < 20_000 * len(rows) / 2


def test_pairs_of_one_set_are_dealt(spark, monkeypatch):
    """More pairs of a set than a task compares, and ids that share their slot of the filter."""
    monkeypatch.setattr(sets, "SPLIT", 3)
    monkeypatch.setattr(sets, "SLOTS", 2)
    rng = random.Random(6)
    base = [f"w{rng.randrange(900)}" for _ in range(400)]
    texts = [(i, " ".join(base[: 400 - i])) for i in range(12)] + [(20 + i, " ".join(f"v{i}x{rng.randrange(900)}" for _ in range(50))) for i in range(5)]
    table = sets.shingles(spark.createDataFrame(texts, "id long, text string"), 3)
    pairs = spark.createDataFrame([(0, i) for i in range(1, 12)] + [(0, 20), (20, 21)], "a long, b long")
    truth = {i: {tuple(w[p : p + 3]) for p in range(len(w) - 2)} for i, w in ((i, t.split()) for i, t in texts)}
    assert {(r.a, r.b): r.i for r in sets.shared(table, pairs).collect()} == {(r.a, r.b): len(truth[r.a] & truth[r.b]) for r in pairs.collect()}


def test_sketches_write_nothing(spark):
    """A sketch needs its least tokens only, so no table is written for it."""
    rng = random.Random(7)
    seqs = spark.createDataFrame([(i, "".join(rng.choice("ACGT") for _ in range(5_000))) for i in range(8)], "id long, sequence string")
    folder = Path(lineage.shared(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    got = {r.id: r.sketch for r in similarity.sketch(sets.kmers(seqs, 21)).collect()}
    assert set(folder.iterdir()) == before
    assert got == {r.id: sorted(r.tokens)[:256] for r in sets.kmers(seqs, 21).collect()}


def test_components_write_less_than_texts(spark):
    """Links of texts write no shingles, and past rounds of the components are deleted."""
    rng = random.Random(8)
    texts = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(4_000))) for i in range(30)]
    texts += [(100 + i, x + " one more") for i, x in texts[:5]]
    folder = Path(lineage.shared(spark).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    before = size()
    got = {r.id: r.root for r in similarity.linked(sets.shingles(spark.createDataFrame(texts, "id long, text string"), 5), 0.02, 5).collect()}
    assert got == {i: i - 100 if i >= 100 else i for i, _ in texts}
    assert size() - before < sum(len(x) for _, x in texts) / 4


def test_cut_collects_garbage(spark, monkeypatch):
    """The driver's garbage is collected after a table is written, but only where the heap has grown."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Young" not in b.getName() and "Concurrent" not in b.getName())
    monkeypatch.setattr(lineage, "FULL", 0.0)
    before = full()
    table = lineage.cut(spark.range(10))
    assert full() > before and table.count() == 10
    monkeypatch.setattr(lineage, "FULL", 2.0)
    before = full()
    lineage.cut(spark.range(10))
    assert full() == before
