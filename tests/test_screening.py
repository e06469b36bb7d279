import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenospark.functions import names, scores
from phenospark.operators import contract, features, labels, metrics, models, similarity, splits
from phenospark.plans import queries as plans


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize(("name", "gene", "mutation", "family"), [("gyrA_S83L", "gyrA", "S83L", "gyrA"), ("blaTEM-30", "blaTEM-30", None, "blaTEM"), ("ampC_T-32A", "ampC", "T-32A", "ampC"), ("dfrA17", "dfrA17", None, "dfrA"), ("sul", "sul", None, "sul")])
def test_names(spark, name, gene, mutation, family):
    c = F.lit(name)
    assert (one(spark, names.parse_gene(c)), one(spark, names.parse_mutation(c)), one(spark, names.gene_family(c))) == (gene, mutation, family)


def test_tokens(spark):
    null = F.lit(None).cast("string")
    assert one(spark, names.feature_token(null, F.lit("beta-lactamase => CTX-M family"))) == "CTX-M"
    assert one(spark, names.feature_token(null, F.lit("synthase @ Sul1"))) == "Sul1"
    assert one(spark, names.feature_token(F.lit("gyrA"), null)) is None
    assert one(spark, names.parse_mlst(F.lit("MLST.ecoli_achtman_4.410"))) == "ST-410"
    for name in (" trimethoprim/sulfa ", "pénicilline g", "ÉRY-thro mycine", "β-lactam", "2x o'neil", "žlutá中a", ""):
        assert one(spark, names.canonical_drug(F.lit(name))) == name.strip().title()


def test_mash(spark):
    assert one(spark, scores.mash_distance(F.lit(1.0))) == 0 and one(spark, scores.mash_distance(F.lit(0.0))) == 1
    assert one(spark, scores.mash_distance(F.lit(0.9))) < 0.05
    t = scores.mash_jaccard(0.02)
    assert math.isclose(-math.log(2 * t / (1 + t)) / 21, 0.02)


def test_gate_and_calls(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, scores.target_gate(arr("gyrA", "parC"), arr("gyrA", "parC"), arr("gyrA", "parC"))) == "present"
    assert one(spark, scores.target_gate(arr("gyrA", "parC"), arr("gyrA", "parC"), arr("gyrA"))) == "absent"
    assert one(spark, scores.target_gate(arr("gyrA"), arr("parC"), arr("parC"))) == "unknown"
    yes, no = F.lit(True), F.lit(False)
    assert one(spark, scores.calibrated_call(F.lit("not_applicable"), F.lit(0.5), no, yes)) == "not_applicable"
    for p, call in ((0.3, "no_call"), (0.7, "no_call"), (0.71, "likely_to_fail"), (0.29, "likely_to_work")):
        assert one(spark, scores.calibrated_call(F.lit("x"), F.lit(p), yes, no)) == call


def test_conflicts_and_weights(spark):
    rows = spark.createDataFrame([("g", "d", "R"), ("g", "d", "S"), ("h", "d", "R"), ("h", "d", "R"), ("i", "d", None)], "genome_id string, drug string, phenotype string")
    assert [tuple(r) for r in labels.agreed(rows).collect()] == [("h", "d", "R")]
    data = [("d", f"a{i}", 1, "A") for i in range(50)] + [("d", f"b{i}", 0, "B") for i in range(5)] + [("d", "c", 0, "C")]
    w = labels.cluster_weights(spark.createDataFrame(data, "drug string, genome_id string, y int, cluster_id string")).toPandas()
    by = w.groupby("y").weight.sum()
    assert math.isclose(by[0], by[1]) and math.isclose(w.weight.sum(), 56)


def test_contract(spark):
    rows = spark.createDataFrame([("a", "R"), ("a", None), ("b", "X")], "id string, p string")
    assert {(r.rule, r.key) for r in contract.duplicates(rows, "id").collect()} == {("unique_id", "a")}
    bad = contract.outside(rows, "id", "p", ["R", "S"], "phenotype")
    assert {r.key for r in bad.collect()} == {"a", "b"}
    with pytest.raises(contract.ContractViolation):
        contract.validate([bad])
    contract.validate([bad.limit(0)])


def test_hamming(spark):
    q = spark.createDataFrame([("q", "a"), ("q", "b"), ("e", None)], "genome_id string, feature string")
    t = spark.createDataFrame([("t", "a"), ("u", "c"), ("u", "d"), ("u", "a"), ("u", "b")], "genome_id string, feature string")
    assert {r.genome_id: r.distance for r in features.nearest_hamming(q, t).collect()} == {"q": 1, "e": 1}


def test_split(spark):
    assert splits.allocate([(4, 4)] * 20, (0.65, 0.15, 0.2)).count(0) == 13
    data = [("d", f"c{i % 40}", i % 40 % 2) for i in range(400)]
    out = splits.grouped_split(spark.createDataFrame(data, "drug string, cluster_id string, y int"), [0, 1]).toPandas()
    assert (out.groupby(["seed", "cluster_id"]).size() == 1).all() and set(out.split) == set(splits.SPLITS)
    with pytest.raises(splits.SplitError):
        splits.grouped_split(spark.createDataFrame(data, "drug string, cluster_id string, y int"), [0], 0.7, 0.5)
    with pytest.raises(splits.SplitError):
        splits.grouped_split(spark.createDataFrame([], "drug string, cluster_id string, y int"), [0])


def test_rounding_is_that_of_the_exact_value(spark):
    rng = np.random.default_rng(5)
    xs = [0.0625, 0.3125, 0.1875, 6.25, 2.675, 1.005, 0.5, 1.5, 2.5, 0.0, 1.0, -0.0625, -2.675, 0.0005, 0.00049999999999999]
    xs += [float(x) for x in rng.random(3000)] + [k / 2000 for k in range(2001)] + [k / 16 * 100 for k in range(17)] + [-k / 800 for k in range(801)]
    frame = spark.createDataFrame([(x,) for x in xs], "x double")
    for digits in (1, 3, 4):
        for r in frame.select("x", scores.rounded(F.col("x"), digits).alias("r")).collect():
            assert r.r == round(r.x, digits), r
    assert spark.range(1).select(scores.rounded(F.lit(None).cast("double"), 3).alias("r")).first().r is None
    p = spark.createDataFrame([("likely_to_fail", 0.0625), ("likely_to_work", 0.6875), ("no_call", 0.3125)], "call string, p double")
    assert [r.c for r in p.select(scores.state_confidence(F.col("call"), F.col("p")).alias("c")).collect()] == [0.062, 0.312, 0.312]
    v = spark.createDataFrame([("d", s, x) for s, x in (("random", 0.0625), ("grouped", 0.0))], "drug string, split string, value double")
    assert metrics.leakage(v, "drug").first().random == 0.062


def test_models(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (200, 3))
    y = (x[:, 0] + rng.random(200) > 0.9).astype(int)
    rows = [("d", f"g{i}", int(y[i]), 1.0, [f"f{j}" for j in range(3) if x[i, j]]) for i in range(200)]
    df = spark.createDataFrame(rows, "drug string, genome_id string, y int, weight double, features array<string>")
    m = models.fit(df, ["drug"])
    coef = {r.feature: r.coef for r in m.collect()}
    z = x @ [coef["f0"], coef["f1"], coef["f2"]] + coef[None]
    grad = 0.1 * np.column_stack([x, np.ones(200)]).T @ (1 / (1 + np.exp(-z)) - y) + [coef["f0"], coef["f1"], coef["f2"], coef[None]]
    assert np.abs(grad).max() < 1e-6
    s = models.score(df, m, ["drug"]).toPandas()
    assert np.allclose(np.sort(s.p), np.sort(1 / (1 + np.exp(-z))))
    assert models.fit(df.where("y = 1"), ["drug"]).count() == 0
    assert models.platt(df.where("y = 1").selectExpr("drug", "y", "0.5D as p"), ["drug"]).first().a is None


def test_rank_metrics_of_piled_scores(spark):
    """Scores near 0 and 1 spread over the ranges, and the metrics are those of a plain sort."""
    rng = np.random.default_rng(9)
    p = np.round(np.concatenate([rng.random(4000) ** 4 * 1e-5, 1 - rng.random(1500) * 1e-9, np.full(300, 0.5)]), 11)
    y = (rng.random(len(p)) < 0.2 + 0.5 * (p > 0.4)).astype(int)
    rows = spark.createDataFrame([("d", int(b), float(a)) for a, b in zip(p, y, strict=True)], "drug string, y int, p double")
    per = [r["count"] for r in metrics.by_score(rows, "drug").groupBy("_b").count().collect()]
    assert len(per) > 100 and max(per) < 0.05 * sum(per)
    order = np.argsort(p, kind="stable")
    ranks = np.empty(len(p))
    for v in np.unique(p):
        at = np.searchsorted(p[order], v), np.searchsorted(p[order], v, "right")
        ranks[p == v] = (at[0] + at[1] + 1) / 2
    n1 = y.sum()
    want = (ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))
    assert abs(metrics.auroc(rows, "drug").first().auroc - want) < 1e-12
    ap = 0.0
    for v in np.unique(p):
        ap += y[p == v].sum() / n1 * y[p >= v].sum() / (p >= v).sum()
    assert abs(metrics.average_precision(rows, "drug").first().pr_auc - ap) < 1e-9


def test_metrics_undefined(spark):
    df = spark.createDataFrame([("d", 1, 0.4, "likely_to_work"), ("d", 1, 0.9, "likely_to_fail")], "drug string, y int, p double, call string")
    assert metrics.auroc(df, "drug").first().auroc is None and metrics.decisions(df, "drug").first().bal_acc is None


def test_components(spark):
    nodes = spark.range(1, 8)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (6, 7)], "a long, b long")
    roots = similarity.connected(nodes, edges)
    assert {r.id: r.root for r in roots.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 6}
    assert {r.cluster_id for r in similarity.cluster_labels(roots).collect()} == {"CL-0000", "CL-0001", "CL-0002"}


def test_queries_have_sql():
    assert set(plans.SQL) <= set(plans.QUERIES) and len(plans.QUERIES) > 45
