"""Whole jobs: read a folder of annotations, analyze genomes through a panel, report on them, build and evaluate."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import SEEDS, SPECIES
from ..operators import build, contract, features, report, similarity, splits
from ..sources import dataset, readers
from ..streaming import scoring
from . import evaluation, panel


def read_annotations(spark: SparkSession, path: str, out: str, most_failures: float = 0.05, results: DataFrame | None = None) -> DataFrame:
    """The 0/1 table of a folder of annotation tables and the metadata of its features, written as CSV below ``out``.

    ``results`` (genome_id, error), where given, must not hold more than a share of failures. Returns the metadata."""
    if results is not None:
        readers.gate_failures(results, most_failures)
    genomes, hits = readers.annotations(spark, path)
    found = features.presence(hits)
    names = [r.feature for r in found.select("feature").distinct().orderBy("feature").collect()]  # the header
    matrix = features.matrix(genomes, found, names)
    contract.validate([contract.duplicates(matrix, "genome_id")])
    about = features.annotate(hits, "pos").withColumnRenamed("feature", "feature_name")
    for df, name, key in ((matrix, "features", "genome_id"), (about, "gene_metadata", "feature_name")):
        df.orderBy(key).write.mode("overwrite").option("header", True).csv(f"{out}/{name}.csv")
    return about


def analyze(spark: SparkSession, fitted: panel.Panel, path: str, fasta: str | None = None, drugs: list[str] | None = None) -> tuple[DataFrame | None, DataFrame]:
    """(quality of the FASTA files, where a folder of them is given; prediction records) of a folder of annotations."""
    genomes, hits = readers.annotations(spark, path)
    out = panel.analyze(fitted, genomes.withColumn("species", F.lit(SPECIES)), hits)
    return (readers.fasta_qc(spark, fasta) if fasta else None), (out.where(F.col("drug").isin(drugs)) if drugs else out)


def reports(spark: SparkSession, fitted: panel.Panel, path: str) -> DataFrame:
    """sample_id, report (JSON list) and summary of each annotated genome."""
    told = analyze(spark, fitted, path)[1]
    return report.report_json(told).join(report.summary(told), "sample_id")


def build_from_cache(spark: SparkSession, ids: DataFrame, cache: str, out: str, get: Callable[[str, str], str] | None = None) -> None:
    """The contract files of a list of ids (genome_id, n) from kept API answers; ``get`` fetches those that are not kept."""
    asked = {
        "genome_amr": (readers.requests(ids, "genome_amr", ["genome_id", "antibiotic", "resistant_phenotype", "evidence", "laboratory_typing_method"]), "genome_id string, antibiotic string, resistant_phenotype string, evidence string, laboratory_typing_method string"),
        "sp_gene": (readers.requests(ids, "sp_gene", ["genome_id", "gene", "product", "antibiotics_class"], "eq(source,NDARO)"), "genome_id string, gene string, product string, antibiotics_class string"),
        "genome": (readers.requests(ids, "genome", ["genome_id", "genome_name", "mlst", "species"]), "genome_id string, genome_name string, mlst string, species string"),
    }
    for request, _ in asked.values() if get is not None else ():
        readers.fetch(request, get, cache)
    # Read after all is fetched: Spark takes two reads of a folder for the same, whatever was added between them.
    rows = [readers.answers(request, cache, schema).withColumn("pos", F.struct("batch", "pos")) for request, schema in asked.values()]
    data, about = build.from_api(*rows, "pos")
    dataset.write(data, out, about)


def adapt(spark: SparkSession, archive: str, label_file: str, clusters: list[str], out: str, matrix: str = "feature_matrix_real") -> None:
    """The contract files of a zip with a wide feature table, a file of sampled labels, and the first table of clusters that
    is there."""
    wide = readers.zip_csvs(spark, archive)[matrix]
    said = readers.csv(spark, label_file).withColumn("pos", F.monotonically_increasing_id())
    dataset.write(build.from_files(wide, said, readers.csv(spark, readers.first_of(spark, clusters)), "pos"), out)


def clusters(spark: SparkSession, fasta: str, out: str) -> None:
    """genome_id, cluster_id of a folder of FASTA files, as CSV."""
    found = similarity.cluster(readers.sequences(spark, fasta)).withColumnRenamed("id", "genome_id")
    if found.isEmpty():
        raise splits.SplitError(f"no FASTA file in {fasta}")
    found.orderBy("genome_id").write.mode("overwrite").option("header", True).csv(out)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="phenospark")
    todo = parser.add_subparsers(dest="job", required=True)
    for name, options in {"read": ("tsv", "out"), "evaluate": ("data", "out"), "fit": ("data", "panel"), "report": ("panel", "tsv", "out"), "build": ("ids", "cache", "out"), "adapt": ("archive", "labels", "clusters", "out"), "clusters": ("fasta", "out"), "follow": ("panel", "tsv", "out", "checkpoint")}.items():
        sub = todo.add_parser(name)
        for o in options:
            sub.add_argument(f"--{o}", required=True)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.job == "read":
        read_annotations(spark, args.tsv, args.out).groupBy("evidence_type").count().orderBy(F.desc("count")).show()
    elif args.job == "evaluate":
        print(evaluation.banner(args.data))
        evaluation.evaluate(dataset.load(spark, args.data), args.out, SEEDS)["metrics"].show(truncate=False)
    elif args.job == "fit":
        panel.engine(spark, args.panel, dataset.load(spark, args.data))
    elif args.job == "build":
        ids = readers.id_list(spark, args.ids).withColumn("n", F.monotonically_increasing_id())
        build_from_cache(spark, ids, args.cache, args.out)
    elif args.job == "adapt":
        adapt(spark, args.archive, args.labels, args.clusters.split(","), args.out)
    elif args.job == "clusters":
        clusters(spark, args.fasta, args.out)
    elif args.job == "follow":
        fitted = panel.engine(spark, args.panel)
        scoring.follow(spark, fitted, args.tsv, args.out, args.checkpoint).awaitTermination()
        scoring.empty(spark, fitted, args.tsv, args.out)
    else:
        reports(spark, panel.engine(spark, args.panel), args.tsv).write.mode("overwrite").json(args.out)
