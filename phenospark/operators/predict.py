"""Predictions of all genomes for all drugs at once: gate, score, evidence, call, calibration, and the upgrade of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, scores
from ..functions.constants import CAUSAL_FAMILIES, CURATED_COUNT, CURATED_NOTE, DISCLAIMER, KNOWN_GENES, MAX_DRIVERS, STATISTICAL_NOTE
from . import features as X
from . import models

FEATURE = "array<struct<gene:string,mutation:string,note:string>>"


def curated_table(spark, table: dict[str, list[str]] = KNOWN_GENES) -> DataFrame:
    return spark.createDataFrame([(d, g) for d, gs in table.items() for g in gs], "drug string, gene string")


def curated_columns(curated: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(drug, feature): the features that stand for a drug's curated genes, each once."""
    return X.resolve_curated(curated, vocabulary.select("feature")).select("drug", "feature").distinct()


def unavailable_evidence(curated: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """drug, message of drugs that have curated genes of which no feature stands for one."""
    rest = curated.select("drug").distinct().join(curated_columns(curated, vocabulary), "drug", "left_anti")
    # Fixed value: the text of the warning.
    said = ": none of its curated resistance genes match a feature column, so every prediction will report 'statistical_association' — absence of expressible evidence, NOT absence of known biology."
    return rest.select("drug", F.concat("drug", F.lit(said)).alias("message"))


def profiles(genomes: DataFrame, found: DataFrame, drugs: DataFrame, columns: DataFrame) -> DataFrame:
    """(drug, genome_id, features, count) of every genome and drug; count is the number of curated features that are
    present, null for drugs without any. ``drugs`` and ``columns`` are small tables of curated drugs."""
    sets = found.groupBy("genome_id").agg(F.collect_set("feature").alias("features"))
    rows = genomes.select("genome_id").join(sets, "genome_id", "left").select("genome_id", F.coalesce("features", F.array().cast("array<string>")).alias("features"))
    by = drugs.select("drug").distinct().join(columns.groupBy("drug").agg(F.collect_set("feature").alias("curated")), "drug", "left")
    return rows.join(F.broadcast(by)).select("drug", "genome_id", "features", F.when(F.size("curated") > 0, F.size(F.array_intersect("features", "curated"))).cast("double").alias("count"))


def gates(rows: DataFrame, targets: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """rows (drug, features, ...) with target_gate_status; only the targets' part of the vocabulary is looked at."""
    genes = targets.select(F.explode("target_genes").alias("feature")).distinct()
    known = vocabulary.join(F.broadcast(genes), "feature", "left_semi").agg(F.collect_set("feature").alias("_known"))
    by = targets.select("drug", "target_genes")
    gated = rows.join(F.broadcast(by), "drug", "left").join(F.broadcast(known))
    return gated.withColumn("target_gate_status", scores.target_gate(F.col("target_genes"), F.col("_known"), F.col("features"))).drop("target_genes", "_known")


def supporting(features: Column, note: str) -> Column:
    return F.transform(features, lambda f: F.struct(names.parse_gene(f).alias("gene"), names.parse_mutation(f).alias("mutation"), F.lit(note).alias("note"))).cast(FEATURE)


def drivers(rows: DataFrame, fitted: DataFrame, targets: DataFrame, keys: list[str], most: int = MAX_DRIVERS) -> DataFrame:
    """(keys, genome_id, drivers): the present features of largest positive weight, without the count and without what
    names a target, in full or before its first underscore."""
    named = targets.select(F.explode("target_genes").alias("_t")).distinct()
    weights = fitted.where(F.col("feature").isNotNull() & (F.col("coef") > 0) & (F.col("feature") != CURATED_COUNT))
    weights = weights.join(F.broadcast(named), (F.col("feature") == F.col("_t")) | (F.substring_index("feature", "_", 1) == F.col("_t")), "left_anti")
    present = rows.select(*keys, "genome_id", F.explode("features").alias("feature")).join(weights, [*keys, "feature"])
    ranked = present.groupBy(*keys, "genome_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("coef")).alias("c"), "feature"))).alias("r"))
    return ranked.select(*keys, "genome_id", F.transform(F.slice("r", 1, most), lambda x: x["feature"]).alias("drivers"))


def tiers(rows: DataFrame, columns: DataFrame, driven: DataFrame | None = None, keys: list[str] = ()) -> DataFrame:
    """rows with evidence_category and supporting_features: curated features that are present outrank the model's drivers,
    which are those of ``driven`` (keys, genome_id, drivers) or, without it, a column of the rows."""
    by = columns.groupBy("drug").agg(F.collect_set("feature").alias("_curated"))
    told = rows.join(F.broadcast(by), "drug", "left")
    told = told if driven is None else told.join(driven, [*keys, "genome_id"], "left")
    known = F.array_sort(F.array_intersect("features", "_curated"))
    some, found = F.coalesce(F.size(known) > 0, F.lit(False)) & F.col("_curated").isNotNull(), F.coalesce(F.size("drivers") > 0, F.lit(False)) & F.col("drivers").isNotNull()
    evidence = F.when(some, "known_gene_or_mutation").when(found, "statistical_association").otherwise("no_known_signal")
    support = F.when(some, supporting(known, CURATED_NOTE)).when(found, supporting(F.col("drivers"), STATISTICAL_NOTE)).otherwise(F.array().cast(FEATURE))
    return told.withColumn("evidence_category", evidence).withColumn("supporting_features", support).drop("_curated", "drivers")


def predict(rows: DataFrame, fitted: DataFrame, targets: DataFrame, vocabulary: DataFrame, columns: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, genome_id, features, count) with raw probability p, gate, evidence and raw call; keys without a model
    give no row."""
    driven = drivers(rows, fitted, targets, keys)
    return tell(models.score(rows, fitted, keys).join(driven, [*keys, "genome_id"], "left"), targets, vocabulary, columns)


def tell(scored: DataFrame, targets: DataFrame, vocabulary: DataFrame, columns: DataFrame) -> DataFrame:
    """scored (drug, features, p, drivers, ...) with gate, evidence and raw call."""
    out = tiers(gates(scored, targets, vocabulary), columns)
    return out.withColumn("call", scores.raw_call(F.col("target_gate_status"), F.col("p")))


def calibrate(predicted: DataFrame, platt: DataFrame, keys: list[str]) -> DataFrame:
    """predicted (p, call, ood, ...) with raw, p (calibrated where a calibration was fitted), fitted, call, no_call_reason."""
    one = F.when(F.col("n_r") == 0, "[0]").otherwise("[1]")
    # Fixed value: why a drug has no calibration.
    failure = F.concat(F.lit("calibration data holds only class "), one, F.lit(" across "), F.col("n").cast("string"), F.lit(" rows — Platt scaling needs both classes"))
    out = predicted.join(F.broadcast(platt), keys).withColumn("fitted", F.col("a").isNotNull()).withColumnRenamed("p", "raw")
    out = out.withColumn("p", F.when(F.col("fitted"), scores.sigmoid(F.col("a") * scores.logit(F.col("raw")) + F.col("b"))).otherwise(F.col("raw")))
    gate = F.col("call"), F.col("p"), F.col("fitted"), F.col("ood")
    return out.withColumn("no_call_reason", scores.no_call_reason(*gate, failure)).withColumn("call", scores.calibrated_call(*gate)).drop("a", "b", "n", "n_r")


def upgrade(predictions: DataFrame, table: dict[str, list[str]] = CAUSAL_FAMILIES) -> DataFrame:
    """predictions (drug, features, call, ...): calls of failure with a causal family present become known mechanisms that
    name these families."""
    families = F.create_map(*[x for d, fs in table.items() for x in (F.lit(d), F.array(*map(F.lit, fs)))])
    causal = F.array_sort(F.array_intersect("features", F.coalesce(F.try_element_at(families, "drug"), F.array().cast("array<string>"))))
    up = (F.col("call") == "likely_to_fail") & (F.size(causal) > 0)
    said = F.transform(causal, lambda g: F.struct(g.alias("gene"), F.lit(None).cast("string").alias("mutation"), F.lit(None).cast("string").alias("note"))).cast(FEATURE)
    return predictions.withColumn("supporting_features", F.when(up, said).otherwise(F.col("supporting_features"))).withColumn("evidence_category", F.when(up, "known_gene_or_mutation").otherwise(F.col("evidence_category")))


def records(predictions: DataFrame, genomes: DataFrame, *more: str) -> DataFrame:
    """The prediction schema: sample_id, species, drug, call, confidence, evidence_category, supporting_features,
    target_gate_status, no_call_reason, disclaimer, and ``more`` columns."""
    rows = predictions.join(genomes.select("genome_id", "species"), "genome_id")
    return rows.select(F.col("genome_id").alias("sample_id"), "species", "drug", "call", F.col("p").alias("confidence"), "evidence_category", "supporting_features", "target_gate_status", "no_call_reason", F.lit(DISCLAIMER).alias("disclaimer"), *more)
