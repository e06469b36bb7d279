"""Builds, predictions, calibration, evaluation and reports on small fixtures."""

import json
import math
import random
import time
import zipfile
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from phenospark.functions import constants as K
from phenospark.functions import scores
from phenospark.operators import build, contract, features, labels, metrics, models, predict, report, sets, similarity, splits
from phenospark.plans import evaluation, jobs, panel
from phenospark.sources import dataset, readers
from synthetic import synthetic


@pytest.fixture(scope="module")
def data(spark):
    return synthetic(spark)


@pytest.fixture(scope="module")
def fitted(data):
    return panel.fit(data, [0])


def test_bridge(spark):
    words = "CTX-M TEM OXA-1 OXA-10 OXA-2 AAC-Ib-cr AAC-II,III,IV,VI,VIII,IX,X dhfrI Quinolone BlaEC mine CatA1/CatA4 APH-Ic/APH-Id".split()
    vocabulary = spark.createDataFrame([(w,) for w in words], "feature string")
    symbols = {"blaCTX-M-15": "CTX-M", "blaOXA-10": "OXA-10", "blaOXA-2": "OXA-2", "blaOXA-232": "OXA-1", "aac(6')-Ib-cr5": "AAC-Ib-cr", "aac(3)-IId": "AAC-II,III,IV,VI,VIII,IX,X", "dfrA17": "dhfrI", "gyrA_S83L": "Quinolone", "Mine": "mine", "blaKPC-2": None, "catA1": "CatA1/CatA4", "aph(3'')-Ib": "APH-Ic/APH-Id", "other": None}
    hits = spark.createDataFrame([(str(i), s) for i, s in enumerate(symbols)], "genome_id string, symbol string")
    got = {}
    for r in features.bridge(hits, vocabulary).collect():
        got.setdefault(r.genome_id, set()).add(r.feature)
    assert got == {str(i): {"BlaEC"} | ({f} if f else set()) for i, f in enumerate(symbols.values())}


def test_build_from_api(spark):
    said = [("562.10", "ampicillin", "Resistant", "Laboratory Method", "x"), ("562.10", "ampicillin", "Resistant", "Laboratory Method", None), ("562.10", "ciprofloxacin", "Resistant", "Laboratory Method", ""), ("562.10", "ciprofloxacin", "Susceptible", "Laboratory Method", ""), ("2", "Trimethoprim", "Intermediate", "Laboratory Method", ""), ("2", "ampicillin", "Susceptible", "Computational Method", ""), ("3", "ampicillin", "Susceptible", "Laboratory Method", ""), ("4", "ampicillin", "Susceptible", "Laboratory Method", ""), ("3", "colistin", "Resistant", "Laboratory Method", "")]
    label_rows = spark.createDataFrame(said, "genome_id string, antibiotic string, resistant_phenotype string, evidence string, laboratory_typing_method string")
    genes = [("562.10", None, "beta-lactamase => CTX-M family", "", 0), ("562.10", "ftsI", None, "B", 1), ("2", "sul1", None, "S", 2), ("562.10", None, "beta-lactamase => CTX-M family", "late", 3), ("562.10", None, "DNA gyrase subunit A", "q", 4), ("562.10", None, "x @ Sul1 (old) family", None, 5)]
    gene_rows = spark.createDataFrame(genes, "genome_id string, gene string, product string, antibiotics_class string, pos int")
    genome_rows = spark.createDataFrame([("562.10", "MLST.e.410", 0), ("562.10", "MLST.e.9", 1), ("2", "MLST.e.1", 2), ("3", "MLST.e.7", 3), ("4", "MLST.e.-", 4), ("5", None, 5)], "genome_id string, mlst string, pos int")
    made, about = build.from_api(label_rows, gene_rows, genome_rows, "pos")
    assert {tuple(r) for r in made.labels.select("genome_id", "drug", "phenotype").collect()} == {("562.10", "Ampicillin", "R"), ("3", "Ampicillin", "S")}
    assert {tuple(r) for r in made.genomes.collect()} == {("562.10", K.SPECIES, "ST-410"), ("3", K.SPECIES, "ST-7")}
    assert {tuple(r) for r in made.features.collect()} == {("562.10", "CTX-M"), ("562.10", "Sul1")}
    assert {r.feature_name: r.amr_class for r in about.collect()} == {"CTX-M": "late", "Sul1": ""}
    assert [tuple(r) for r in made.targets.collect()] == [("Ampicillin", ["ftsI"])]
    assert build.report(made)[2].startswith("only 2 clusters")
    with pytest.raises(build.BuildError):
        build.from_api(label_rows, gene_rows, genome_rows.limit(0), "pos")


def test_dataset_round_trip(spark, tmp_path):
    path = str(tmp_path)
    (tmp_path / "features.csv").write_text("genome_id,a b,\"c,d\"\n562.10,1,0\n2,0,0\n")
    (tmp_path / "labels.csv").write_text("genome_id,drug,phenotype\n562.10,Ampicillin,R\n2,Ampicillin,S\n")
    (tmp_path / "genomes.csv").write_text("genome_id,species,cluster_id\n562.10,E,x\n2,E,y\n")
    got = dataset.load(spark, path)
    assert [tuple(r) for r in got.features.collect()] == [("562.10", "a b")] and got.targets.count() == 0
    assert {r.feature for r in got.vocabulary.collect()} == {"a b", "c,d"}
    (tmp_path / "drug_targets.json").write_text('{"Ampicillin": {"target_genes": ["ftsI"], "note": "n"}}')
    got = dataset.load(spark, path)
    dataset.write(got, f"{path}/out", spark.createDataFrame([("a b", "x")], "feature_name string, amr_class string"))
    again = dataset.load(spark, f"{path}/out")
    for name in ("features", "labels", "genomes", "vocabulary"):
        assert sorted(map(tuple, getattr(again, name).collect())) == sorted(map(tuple, getattr(got, name).collect()))
    assert [tuple(r)[:2] for r in again.targets.collect()] == [("Ampicillin", ["ftsI"])]
    for broken in ("genome_id,a\n562.10,1\n562.10,1\n2,0\n", "genome_id,a\n562.10,\n2,0\n", "genome_id,a\n562.10,2\n2,0\n", "genome_id,a\n562.10,1\n"):
        (tmp_path / "features.csv").write_text(broken)
        with pytest.raises(contract.ContractViolation):
            dataset.load(spark, path)


def test_annotations(spark, tmp_path):
    (tmp_path / "562.10.amrfinder.tsv").write_text("Name\tElement symbol\tType\tSubtype\tClass\tSubclass\nx\tgyrA_S83L\tamr\tPOINT\tQ\tQ1\nx\tsul1\tAMR\tAMR\tS\tS1\nx\tstx\tVIRULENCE\tV\t\t\n")
    (tmp_path / "562.7.amrfinder.tsv").write_text("")
    (tmp_path / "562.8.amrfinder.tsv").write_text("Name\tGene symbol\tElement type\tElement subtype\r\nx\tompC\tAMR\tPOINT_DISRUPT\r\n")
    (tmp_path / "562.9.amrfinder.tsv").write_text("Name\tElement symbol\tType\tSubtype\tClass\tSubclass\nx\tsul1\tAMR\tPOINT\tS\tS2\n")
    genomes, hits = readers.annotations(spark, str(tmp_path))
    assert [r.genome_id for r in genomes.collect()] == ["562.10", "562.7", "562.8", "562.9"]
    found = features.presence(hits)
    assert {tuple(r) for r in features.matrix(genomes, found, ["gyrA_S83L", "ompC", "sul1"]).collect()} == {("562.10", 1, 0, 1), ("562.7", 0, 0, 0), ("562.8", 0, 1, 0), ("562.9", 0, 0, 1)}
    about = {r.feature: tuple(r)[1:] for r in features.annotate(hits, "pos").collect()}
    assert about == {"gyrA_S83L": ("gyrA", "point_mutation", "Q", "Q1"), "ompC": ("ompC", "disrupted_gene", "", ""), "sul1": ("sul1", "point_mutation", "S", "S2")}
    with pytest.raises(readers.GenomeReaderError):
        readers.files(spark, str(tmp_path), ["*.fna"])
    (tmp_path / "1.amrfinder.tsv").write_text("Name\tWrong\nx\ty\n")
    with pytest.raises(Exception, match="none of"):
        readers.annotations(spark, str(tmp_path))[1].collect()


def test_fasta(spark, tmp_path):
    (tmp_path / "g.fasta").write_text(">c1 x\nACgt\r\nAC\n>c2\nG\n")
    (tmp_path / "h.fna").write_text("")
    (tmp_path / "i.fa").write_text(">c\n" + "A" * 1_000_000 + "\n")
    qc = {r.genome_id: r for r in readers.fasta_qc(spark, str(tmp_path)).collect()}
    assert (qc["g"].total_bp, qc["g"].n_contigs, qc["g"].plausible_genome) == (7, 2, False) and "only 7 bp across 2 record(s)" in qc["g"].message
    assert qc["h"].message.startswith("No FASTA") and (qc["i"].plausible_genome, qc["i"].message) == (True, "")
    assert {r.id: r.sequence for r in readers.sequences(spark, str(tmp_path)).where("id <> 'i'").collect()} == {"g": "ACGTACG", "h": ""}


def test_clusters_of_sequences(spark):
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("ACGT"), 3000)) for _ in range(3)]
    rows = []
    for i, b in enumerate(base):
        for j in range(3):
            s = list(b)
            for p in rng.choice(3000, 4 * j, replace=False):
                s[p] = "A"
            rows.append((f"{i}{j}", "".join(s)))
    seqs = spark.createDataFrame(rows, "id string, sequence string")
    got = {r.id: r.cluster_id for r in similarity.cluster(seqs).collect()}
    assert got == {f"{i}{j}": f"CL-000{i}" for i in range(3) for j in range(3)}
    truth = {k: {s[p : p + 21] for p in range(len(s) - 20)} for k, s in rows}
    assert {r.id: r.n for r in similarity.heads(sets.kmers(seqs, 21)).collect()} == {k: len(v) for k, v in truth.items()}
    sk = similarity.sketch(sets.kmers(seqs, 21))
    a, b = sk.where("id = '00'").select(F.col("sketch").alias("x")), sk.where("id = '02'").select(F.col("sketch").alias("y"))
    j = a.join(b).select(similarity.sketch_jaccard(F.col("x"), F.col("y")).alias("j")).first().j
    assert abs(j - len(truth["00"] & truth["02"]) / len(truth["00"] | truth["02"])) < 0.12


def jaccard_truth(texts, k, threshold):
    shingles = {i: {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} for i, w in ((i, t.split()) for i, t in texts)}
    out = {}
    for a, x in shingles.items():
        for b, y in shingles.items():
            if a < b and x & y:
                j = len(x & y) / len(x | y)
                d = -math.log(2 * j / (1 + j)) / k
                if d < threshold:
                    out[a, b] = j
    return out


def test_similar_pairs_and_links(spark):
    """Near copies in a chain, equal sets, short ones, and a common line that all have."""
    rng = random.Random(4)
    line, texts = " ".join(f"c{i}" for i in range(12)), []
    for g in range(12):
        words = [f"g{g}w{rng.randrange(500)}" for _ in range(rng.choice([3, 6, 30, 200, 600]))]
        for _ in range(rng.randrange(1, 9)):
            texts.append((len(texts), " ".join(words) + (" " + line if len(words) > 6 else "")))
            if rng.random() < 0.7 and len(words) > 5:
                words = list(words)
                words[rng.randrange(len(words))] = f"x{rng.random()}"
    texts += [(len(texts), ""), (len(texts) + 1, "one two")]
    table = sets.shingles(spark.createDataFrame(texts, "id long, text string"), 3)
    for threshold in (0.02, 0.2):
        want = jaccard_truth(texts, 3, threshold)
        got = {(r.a, r.b): r.jaccard for r in similarity.similar_pairs(table, threshold, 3).collect()}
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want) and want
        root = {i: i for i, _ in texts}
        for _ in texts:
            for a, b in want:
                root[a] = root[b] = min(root[a], root[b])
        assert {r.id: r.root for r in similarity.linked(table, threshold, 3).collect()} == {i: root[i] for i, t in texts if len(t.split()) >= 3}


def test_kmers_are_linear_and_exact(spark, monkeypatch):
    rng = np.random.default_rng(1)
    genome = "".join(rng.choice(list("ACGT"), 5_000_000))
    began = time.perf_counter()
    tokens = np.unique(sets.windows(sets.letters(genome), 21))
    assert time.perf_counter() - began < 20 and 4_900_000 < len(tokens) <= len(genome) - 20
    short = genome[:3000] + "é中" + genome[:300]
    assert len(np.unique(sets.windows(sets.letters(short), 7))) == len({short[i : i + 7] for i in range(len(short) - 6)})
    for k in (1, 2, 5, 21, 32):
        w = sets.windows(sets.letters(short), k)
        assert (w[0] == w[3002]) and len(w) == len(short) - k + 1
    assert not len(sets.windows(sets.letters("ACG"), 4)) and not len(sets.letters(None))


def test_sets_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sets, "PART_TOKENS", 100)
    rng = random.Random(2)
    base = "".join(rng.choice("ACGT") for _ in range(3000))
    rows = [("a", base), ("b", base[:1500] + "A" + base[1500:]), ("c", base[::-1]), ("d", base[:2000]), ("e", "AC"), ("f", None)]
    table = sets.kmers(spark.createDataFrame(rows, "id string, sequence string"), 21)
    assert table.groupBy("id").count().where("count > 8").count() == 4
    assert table.selectExpr("max(size(tokens))").first()[0] < 1000
    truth = {i: {s[p : p + 21] for p in range(len(s) - 20)} for i, s in rows if s and len(s) > 20}
    assert {r.id: r.n for r in similarity.heads(table).collect()} == {i: len(x) for i, x in truth.items()}
    got = {(r.a, r.b): r.jaccard for r in similarity.similar_pairs(table, 0.02, 21).collect()}
    want = {(a, b): len(truth[a] & truth[b]) / len(truth[a] | truth[b]) for a, b in (("a", "b"), ("a", "d"), ("b", "d"))}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)


def test_adapt_and_clusters(spark, tmp_path):
    """A zip of CSV tables, sampled labels and clusters become contract files; FASTA files become clusters."""
    with zipfile.ZipFile(tmp_path / "files.zip", "w") as z:
        z.writestr("x/feature_matrix_real.csv", "\ufeffgenome_id,blaTEM-1,dfrA\n1.10,1,0\n2.1,,1\n3.1,0,0\n")
        z.writestr("y/other.csv", 'a,b\n"x, y",\n')
    tables = readers.zip_csvs(spark, f"{tmp_path}/files.zip")
    assert set(tables) == {"feature_matrix_real", "other"} and [tuple(r) for r in tables["other"].collect()] == [("x, y", None)]
    (tmp_path / "labels.csv").write_text("genome_id,antibiotic,phenotype,lab_method\n1.10,ampicillin,Resistant,Broth\n1.10,ampicillin,Susceptible,Disk\n2.1,ampicillin,Susceptible,Disk\n3.1,ampicillin,Resistant,\n9.9,ampicillin,Resistant,Disk\n")
    (tmp_path / "shipped.csv").write_text("genome_id,cluster_id\n1.10,a\n2.1,b\n3.1,b\n8.8,c\n")
    jobs.adapt(spark, f"{tmp_path}/files.zip", f"{tmp_path}/labels.csv", [f"{tmp_path}/mash.csv", f"{tmp_path}/shipped.csv"], f"{tmp_path}/out")
    again = dataset.load(spark, f"{tmp_path}/out")
    assert {tuple(r) for r in again.features.collect()} == {("1.10", "blaTEM-1"), ("2.1", "dfrA")}
    assert {(r.genome_id, r.drug, r.phenotype) for r in again.labels.collect()} == {("1.10", "Ampicillin", "R"), ("2.1", "Ampicillin", "S")}
    rng = random.Random(6)
    (tmp_path / "fasta").mkdir()
    for name in ("a", "b", "c"):
        base = "".join(rng.choice("ACGT") for _ in range(2000)) if name != "b" else base
        (tmp_path / "fasta" / f"{name}.fna").write_text(f">one\n{base[:1000].lower()}\n>two\n{base[1000:]}\n")
    jobs.main(["clusters", "--fasta", f"{tmp_path}/fasta", "--out", f"{tmp_path}/clusters"])
    got = {r.genome_id: r.cluster_id for r in readers.csv(spark, f"{tmp_path}/clusters").collect()}
    assert got == {"a": "CL-0000", "b": "CL-0000", "c": "CL-0001"}


def test_labels_without_a_genome_are_refused(spark, data):
    lonely = data.labels.limit(1).withColumn("genome_id", F.lit("nobody"))
    with pytest.raises(contract.ContractViolation):
        panel.labelled(replace(data, labels=data.labels.unionByName(lonely)), spark.createDataFrame([], "drug string, feature string"))


def test_connected_chain(spark):
    edges = [(i, i + 1) for i in range(60) if i % 20 != 19] + [(59, 3), (7, 7)]
    nodes = spark.range(70).toDF("id")
    got = {r.id: r.root for r in similarity.connected(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 if i < 20 or 40 <= i < 60 else 20 if i < 40 else i for i in range(70)} | {60: 60}


def test_requests_and_answers(spark, tmp_path):
    ids = spark.createDataFrame([(i, f"562.{i}0") for i in range(250)], "n long, genome_id string")
    asked = readers.requests(ids, "genome", ["genome_id", "mlst"], "eq(x,y)")
    rows = asked.orderBy("batch").collect()
    assert len(rows) == 3 and rows[2].query.startswith("and(in(genome_id,(562.2000,") and rows[2].query.endswith(",eq(x,y))&select(genome_id,mlst)&limit(25000)")
    with pytest.raises(Exception):
        readers.answers(asked, str(tmp_path), "genome_id string").collect()

    def get(endpoint, query):
        inside = query.split("(genome_id,(")[1].split("))")[0].split(",")
        return json.dumps([{"genome_id": i, "mlst": f"m{i}"} for i in inside])

    readers.fetch(asked, get, str(tmp_path))
    got = readers.answers(asked, str(tmp_path), "genome_id string, mlst string")
    assert sorted(r.genome_id for r in got.collect()) == sorted(f"562.{i}0" for i in range(250))
    with pytest.raises(Exception, match="fewer ids"):
        readers.answers(asked, str(tmp_path), "genome_id string", limit=100).collect()

    def broken(endpoint, query):
        raise OSError("down")

    with pytest.raises(Exception, match="2 tries"):
        readers.fetch(readers.requests(ids, "other", ["a"]), broken, str(tmp_path), 2, 0)
    results = spark.createDataFrame([(str(i), "bad" if i < 2 else None) for i in range(20)], "genome_id string, error string")
    assert readers.gate_failures(results, 0.1).count() == 18
    with pytest.raises(readers.GenomeReaderError):
        readers.gate_failures(results)


def test_sources_in_place_of_others(spark, tmp_path):
    (tmp_path / "b.csv").write_text("﻿genome_id\n562.10\n562.2\n")
    path = readers.first_of(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert [r.genome_id for r in readers.id_list(spark, path, 1).collect()] == ["562.10"]
    with pytest.raises(readers.GenomeReaderError):
        readers.first_of(spark, [str(tmp_path / "a.csv")])


def _brute_near(q, t):
    return {i: min(len(x ^ y) for y in t.values()) for i, x in q.items()}


def test_nearest_profiles(spark):
    rng = np.random.default_rng(5)
    for most, n in ((6, 5), (12, 9), (40, 25)):
        draw = lambda k: {f"g{i}": frozenset(f"f{x}" for x in rng.choice(most, int(rng.integers(0, n)), replace=False)) for i in range(k)}
        q, t = draw(60), draw(25)
        frame = lambda d: spark.createDataFrame([(i, f) for i, x in d.items() for f in (x or [None])], "genome_id string, feature string")
        assert {r.genome_id: r.distance for r in features.nearest_hamming(frame(q), frame(t)).collect()} == _brute_near(q, t)


def test_nearest_of_a_hot_feature(spark, monkeypatch):
    """Every profile holds one feature, most are far from any other, and a token's rows are dealt in threes: all radii and parts
    are met, and no task of the join has a token whole."""
    monkeypatch.setattr(features, "SPLIT", 3)
    rng = np.random.default_rng(11)
    for most, low, high in ((60, 2, 8), (60, 5, 40), (200, 20, 60)):
        draw = lambda k: {f"g{i}": frozenset(["hot", *(f"f{x}" for x in rng.choice(most, int(rng.integers(low, high)), replace=False))]) for i in range(k)}
        q, t = draw(40), draw(30)
        frame = lambda d: spark.createDataFrame([(i, f) for i, x in d.items() for f in x], "genome_id string, feature string")
        assert {r.genome_id: r.distance for r in features.nearest_hamming(frame(q), frame(t)).collect()} == _brute_near(q, t)


def test_random_split(spark):
    rows = spark.range(1000).select(F.lit("d").alias("drug"), (F.col("id") % 2).cast("int").alias("seed"), F.col("id").cast("string").alias("genome_id"))
    sizes = spark.createDataFrame([("d", 0, 300, 100), ("d", 1, 250, 125)], "drug string, seed int, train long, calibration long")
    got = splits.random_split(rows, sizes, ["drug", "seed"]).groupBy("seed", "split").count().collect()
    assert {(r.seed, r.split): r["count"] for r in got} == {(0, "train"): 300, (0, "calibration"): 100, (0, "test"): 100, (1, "train"): 250, (1, "calibration"): 125, (1, "test"): 125}


def test_grouped_split_brute(spark):
    rng = np.random.default_rng(1)
    rows = [("d", f"c{rng.integers(30)}", int(rng.integers(2))) for _ in range(500)]
    got = splits.grouped_split(spark.createDataFrame(rows, "drug string, cluster_id string, y int"), [3]).collect()
    by = {}
    for _, c, y in rows:
        by.setdefault(c, [0, 0])[y] += 1
    ties = {r.c: r.h for r in spark.createDataFrame([(c,) for c in by], "c string").select("c", F.xxhash64(F.lit(3), "c").alias("h")).collect()}
    order = sorted(by, key=lambda c: (-sum(by[c]), ties[c]))
    share = {"train": 0.65, "calibration": 0.15, "test": 0.2}
    total, have, want = [sum(v[k] for v in by.values()) for k in (0, 1)], {s: [0, 0] for s in share}, {}
    for c in order:
        def need(s, c=c):
            return sum(by[c][k] / sum(by[c]) * (share[s] * total[k] - have[s][k]) / max(share[s] * total[k], 1) for k in (0, 1))
        want[c] = max(share, key=need)
        for k in (0, 1):
            have[want[c]][k] += by[c][k]
    assert {r.cluster_id: r.split for r in got} == want
    faults = contract.split_faults(spark.createDataFrame([("d", 0, "c", "train", 1), ("d", 1, "c", "test", 0)], "drug string, seed int, cluster_id string, split string, y int"))
    assert {r.rule for r in faults.collect()} == {"empty_split", "one_class_split"}


def test_models_brute(spark):
    """Newton's models, Platt scaling and out-of-fold rows against plain gradient conditions on every row."""
    rng = np.random.default_rng(2)
    rows = [("d", f"g{i}", int(rng.random() < 0.3 + 0.4 * (i % 3 == 0)), f"c{i % 12}", [f"f{j}" for j in range(4) if (i >> j) & 1], float(bin(i & 3).count("1"))) for i in range(160)]
    frame = spark.createDataFrame(rows, "drug string, genome_id string, y int, cluster_id string, features array<string>, count double")
    weighted = labels.cluster_weights(frame)
    fitted = models.fit(weighted, ["drug"])
    coef = {r.feature: r.coef for r in fitted.collect()}
    assert set(coef) == {None, "f0", "f1", "f2", "f3", K.CURATED_COUNT}
    w = {r.genome_id: r.weight for r in weighted.collect()}
    x = np.array([[float(f"f{j}" in r[4]) for j in range(4)] + [r[5], 1.0] for r in rows])
    beta = np.array([coef[f"f{j}"] for j in range(4)] + [coef[K.CURATED_COUNT], coef[None]])
    y, ww = np.array([r[2] for r in rows]), np.array([w[r[1]] for r in rows])
    p = 1 / (1 + np.exp(-x @ beta))
    assert np.abs(0.1 * x.T @ (ww * (p - y)) + beta).max() < 1e-7
    got = {r.genome_id: r.p for r in models.score(frame, fitted, ["drug"]).collect()}
    assert np.allclose([got[r[1]] for r in rows], p)
    scored = spark.createDataFrame([("d", int(a), float(round(b, 2))) for a, b in zip(y, p, strict=True)], "drug string, y int, p double")
    ab = models.platt(scored, ["drug"]).first()
    z = np.log(np.round(p, 2) / (1 - np.round(p, 2)))
    q = 1 / (1 + np.exp(-(ab.a * z + ab.b)))
    assert abs(np.sum(q - y)) < 1e-6 and abs(np.sum((q - y) * z) + ab.a) < 1e-6 and (ab.n, ab.n_r) == (160, int(y.sum()))
    out = models.out_of_fold(weighted, balance=True).collect()
    assert len(out) == 160
    folds = {r.genome_id: r.fold for r in out}
    one = [r for r in rows if folds[r[1]] != 0]
    again = {r.feature: r.coef for r in models.fit(labels.cluster_weights(spark.createDataFrame(one, frame.schema)), ["drug"]).collect()}
    for r in out:
        if r.fold == 0:
            fs, count = next((x[4], x[5]) for x in rows if x[1] == r.genome_id)
            assert abs(r.p - 1 / (1 + np.exp(-(sum(again.get(f, 0) for f in fs) + again[K.CURATED_COUNT] * count + again[None])))) < 1e-9


def test_panel(spark, data, fitted):
    """What is planted in the synthetic data is found, and the records keep their contract."""
    out = panel.predict_all(fitted, data.genomes, data.features)
    assert contract.prediction_faults(out).isEmpty()
    rows = test = evaluation.test_rows(data, fitted).collect()
    assert len(test) > 60
    right = [r for r in rows if r.call in ("likely_to_fail", "likely_to_work")]
    assert np.mean([(r.call == "likely_to_fail") == bool(r.y) for r in right]) > 0.7
    got = out.where("drug = 'Ampicillin'").collect()
    have = {}
    for r in data.features.collect():
        have.setdefault(r.genome_id, set()).add(r.feature)
    curated = {r.feature for r in fitted.columns.where("drug = 'Ampicillin'").collect()}
    assert curated == {"blaTEM-1", "blaCTX-M-15"}
    for r in got:
        known = sorted(curated & have.get(r.sample_id, set()))
        assert (r.evidence_category == "known_gene_or_mutation") == bool(known)
        if known:
            assert [f.gene for f in r.supporting_features] == known and r.supporting_features[0].note == K.CURATED_NOTE
        assert (r.target_gate_status == "absent") == ("ftsI" not in have.get(r.sample_id, set())) == (r.call == "not_applicable")
    cipro = out.where("drug = 'Ciprofloxacin'").collect()
    assert {r.target_gate_status for r in cipro} == {"unknown"} and all("_curated" not in f.gene for r in cipro for f in r.supporting_features)
    assert all(r.no_call_reason for r in cipro if r.call == "no_call")


def test_panel_is_kept(spark, data, fitted, tmp_path):
    fitted.save(str(tmp_path))
    again = panel.engine(spark, str(tmp_path))
    assert again is panel.engine(spark, str(tmp_path))
    one = data.genomes.limit(5)
    a, b = (sorted(panel.predict_all(p, one, data.features).select("sample_id", "drug", "call", "confidence").collect()) for p in (fitted, again))
    assert a == b
    up = panel.uploaded(data, spark.createDataFrame([Row(genome_id="u", species="E")]), data.features.limit(0))
    assert up.genomes.first().cluster_id == "UPLOAD" and up.labels.count() == 0
    hits = spark.createDataFrame([("u", "blaTEM-1", "AMR"), ("u", "stx", "VIRULENCE")], "genome_id string, symbol string, type string")
    assert {r.drug for r in panel.analyze(fitted, up.genomes, hits).collect()} == {"Ampicillin", "Ciprofloxacin"}


def test_few_calibration_rows_are_pooled(spark, data):
    none = panel.fit(data, [0], least=0).platt.select("drug", "n").collect()
    all_ = panel.fit(data, [0], least=10_000).platt.select("drug", "n").collect()
    n = {r.drug: r["count"] for r in panel.labelled(data, panel.fit(data, [0]).columns).join(panel.fit(data, [0]).splits.where("split = 'train'"), ["drug", "cluster_id"]).groupBy("drug").count().collect()}
    assert {r.drug: r.n for r in all_} == {r.drug: r.n + n[r.drug] for r in none}


def test_evaluation(spark, data, tmp_path):
    made = evaluation.evaluate(data, str(tmp_path), [0, 1])
    assert {r.drug for r in spark.read.option("header", True).csv(f"{tmp_path}/metrics").collect()} == {"Ampicillin", "Ciprofloxacin"}
    one = made["metrics"].first()
    assert one.seeds == 2 and "±" in one.brier_cal
    gap = made["leakage_comparison"].collect()
    assert all(r.random is not None and abs(r.gap - round(r.random - r.grouped, 3)) < 1e-9 for r in gap)
    assert evaluation.banner("/x/Synthetic/").startswith("SYNTHETIC") and evaluation.banner("/synthetic/real").startswith("REAL")
    assert made["calibration"].count() == 4 and made["per_cluster"].columns == ["drug", "cluster", "n_answered", "accuracy", "bal_acc"]


def test_upgrade_and_warnings(spark):
    base = {"genome_id": "g", "drug": "Ampicillin", "call": "likely_to_fail", "evidence_category": "statistical_association", "features": ["TEM", "CTX-M", "x"], "supporting_features": [("x", None, "n")]}
    schema = f"genome_id string, drug string, call string, evidence_category string, features array<string>, supporting_features {predict.FEATURE}"
    rows = [tuple(base.values()), tuple((base | {"genome_id": "h", "call": "no_call"}).values()), tuple((base | {"genome_id": "i", "features": ["BlaEC"]}).values()), tuple((base | {"genome_id": "j", "drug": "Other"}).values())]
    got = {r.genome_id: ([f.gene for f in r.supporting_features], r.evidence_category) for r in predict.upgrade(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"g": (["CTX-M", "TEM"], "known_gene_or_mutation"), **{k: (["x"], "statistical_association") for k in "hij"}}
    vocabulary = spark.createDataFrame([("blaTEM-1",), ("dfrA17",)], "feature string")
    assert [r.drug for r in predict.unavailable_evidence(predict.curated_table(spark), vocabulary).collect()] == ["Ciprofloxacin"]


def test_reports(spark):
    schema = f"sample_id string, species string, drug string, call string, confidence double, evidence_category string, supporting_features {predict.FEATURE}, no_call_reason string"
    s83 = [("gyrA", "S83L", "known")]
    rows = [
        ("a", "E. coli", "Ciprofloxacin", "likely_to_fail", 0.9999, "known_gene_or_mutation", s83, None),
        ("a", "E. coli", "Ampicillin", "likely_to_work", 0.0581, "no_known_signal", [], None),
        ("a", "E. coli", "Unheard", "no_call", 0.5, "no_known_signal", [], None),
        ("a", "E. coli", "Trimethoprim", "not_applicable", 0.2, "no_known_signal", [], None),
    ]
    frame = spark.createDataFrame(rows, schema)
    items = {r.drug: r for r in report.items(frame).collect()}
    assert (items["Ciprofloxacin"].confidence, items["Ampicillin"].confidence, items["Unheard"].drug_class, items["Unheard"].locus_id) == (1.0, 0.942, "Unknown", "N/A")
    assert items["Ciprofloxacin"].stat_explanation == "The calibrated model assigns 99% probability of resistance, consistent with the detected determinant."
    assert items["Ciprofloxacin"].bio_explanation == "Detected a known Fluoroquinolone resistance determinant: gyrA S83L. This is an established mechanism, so the drug is predicted to fail."
    assert items["Ampicillin"].stat_explanation.startswith("Calibrated susceptibility confidence is 94%;")
    assert items["Unheard"].stat_explanation == "A safe prediction cannot be computed for this genome. the evidence is weak or conflicting"
    told = {r.drug: r for r in report.explain(frame).collect()}
    assert told["Ciprofloxacin"].confidence_label == "99%" and "(confidence 99%)" in told["Ciprofloxacin"].explanation_text
    assert told["Unheard"].explanation_text == "Unheard: NO CONFIDENT PREDICTION for this sample. Reason: insufficient evidence."
    shown = json.loads(report.report_json(frame).first().report)
    assert [x["drug"] for x in shown] == ["Ampicillin", "Ciprofloxacin", "Trimethoprim", "Unheard"] and list(shown[0]) == ["drug", "drug_class", "underlying_state", "confidence", "target_marker", "locus_id", "bio_explanation", "stat_explanation"]
    assert tuple(report.panel_counts(frame).first()) == ("a", 1, 1, 2)
    genes = F.array(F.struct(F.lit("blaCTX-M-15").alias("gene")))
    for text, want in (("carries CTX-M-15", False), ("carries NDM-1", True), ("the GYRA locus", False), ("no gene at all", False), ("aac(6')-Ib", True)):
        assert spark.range(1).select(report.names_unlisted_gene(F.lit(text), F.lit("Ciprofloxacin"), genes).alias("x")).first().x is want, text


def test_metric_values(spark):
    """Rank metrics against every pair and every threshold."""
    rng = np.random.default_rng(4)
    y, p = rng.integers(0, 2, 400), np.round(rng.random(400), 2)
    frame = spark.createDataFrame([("d", int(a), float(b)) for a, b in zip(y, p, strict=True)], "drug string, y int, p double")
    pairs = [(a > b) + (a == b) / 2 for a in p[y == 1] for b in p[y == 0]]
    assert abs(metrics.auroc(frame, "drug").first().auroc - np.mean(pairs)) < 1e-12
    ap = sum((p[(y == 1)] == t).sum() / y.sum() * y[p >= t].mean() for t in np.unique(p))
    assert abs(metrics.average_precision(frame, "drug").first().pr_auc - ap) < 1e-12
    near = spark.createDataFrame([("d", int(x)) for x in rng.integers(0, 30, 77)], "drug string, distance long")
    want = np.percentile([r.distance for r in near.collect()], 99)
    assert abs(metrics.ood_threshold(near, ["drug"], 0.99, 1.0).first().threshold - want) < 1e-9
    assert spark.range(1).select(scores.certainty_label(F.lit(99.2)).alias("x")).first().x == ">99%"


def test_jobs(spark, fitted, tmp_path):
    (tmp_path / "u.amrfinder.tsv").write_text("Name\tElement symbol\tType\tSubtype\tClass\tSubclass\nx\tblaTEM-1\tAMR\tAMR\tB\tB1\n")
    (tmp_path / "v.amrfinder.tsv").write_text("")
    (tmp_path / "u.fna").write_text(">c\nACGT\n")
    about = jobs.read_annotations(spark, str(tmp_path), f"{tmp_path}/out")
    assert [tuple(r) for r in about.collect()] == [("blaTEM-1", "blaTEM-1", "acquired_gene", "B", "B1")]
    assert {tuple(r) for r in readers.csv(spark, f"{tmp_path}/out/features.csv").collect()} == {("u", "1"), ("v", "0")}
    qc, told = jobs.analyze(spark, fitted, str(tmp_path), str(tmp_path), ["Ampicillin"])
    assert qc.first().total_bp == 4 and {(r.sample_id, r.drug) for r in told.collect()} == {("u", "Ampicillin"), ("v", "Ampicillin")}
    assert {len(json.loads(r.report)) for r in jobs.reports(spark, fitted, str(tmp_path)).collect()} == {2}
    answers = {
        "genome_amr": [{"genome_id": g, "antibiotic": "ampicillin", "resistant_phenotype": p, "evidence": "Laboratory Method"} for g, p in (("1.10", "Resistant"), ("2.1", "Susceptible"))],
        "sp_gene": [{"genome_id": "1.10", "gene": "blaX", "antibiotics_class": "b"}],
        "genome": [{"genome_id": "1.10", "mlst": "M.e.1"}, {"genome_id": "2.1", "mlst": "M.e.2"}],
    }
    ids = spark.createDataFrame([("1.10", 0), ("2.1", 1)], "genome_id string, n long")
    jobs.build_from_cache(spark, ids, f"{tmp_path}/cache", f"{tmp_path}/built", lambda endpoint, query: json.dumps(answers[endpoint]))
    again = dataset.load(spark, f"{tmp_path}/built")
    assert {tuple(r) for r in again.features.collect()} == {("1.10", "blaX")} and again.labels.count() == 2


def test_panel_evaluation_scores_rows_once(spark):
    """Metrics read scored rows from a table; no branch of the driver's last plan goes back to the sources."""
    from phenospark.plans import panel_queries

    told = panel_queries.panel_evaluation(spark, "/root/testdata/sf0.001")
    assert told.count() == 2
    assert not [f for f in told.inputFiles() if "/root/testdata" in f]


def test_last_plan_of_predictions_is_small(spark):
    """Scores, drivers and what is looked up are tables; the last plan goes back to the sources for the genomes only."""
    from phenospark.plans import panel_queries

    told = panel_queries.panel_fit_predict(spark, "/root/testdata/sf0.001")
    assert {f.rsplit("/", 1)[-1] for f in told.inputFiles() if "/root/testdata" in f} == {"orders.parquet"}
    assert told._jdf.queryExecution().analyzed().toString().count("Join") <= 8
    assert told.count() == 3000


def test_settle_gives_native_memory_back(spark, monkeypatch):
    from phenospark.operators import lineage

    asked = []
    real = lineage.trim
    monkeypatch.setattr(lineage, "trim", lambda s: asked.append(real(s)))
    monkeypatch.setattr(lineage, "FULL", 0.0)
    lineage.settle(spark)
    assert asked == [True]


def test_last_plan_of_metrics_is_small(spark):
    """Groups of metrics are tables; the last plan only joins them."""
    from phenospark.plans import panel_queries

    told = panel_queries.metrics_table(spark, "/root/testdata/sf0.001")
    plan = told._jdf.queryExecution().analyzed().toString()
    assert told.count() == 3 and "Window" not in plan and "Aggregate" not in plan
