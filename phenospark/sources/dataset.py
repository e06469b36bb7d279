"""The contract files: reading with validation, and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contract, features
from ..operators.build import Dataset, wide_features
from . import readers

TARGETS = "drug string, target_genes array<string>, note string"


def violations(matrix: DataFrame, labels: DataFrame, genomes: DataFrame) -> list[DataFrame]:
    """Every rule's table of violations, in the order in which they are told; columns must be there."""
    values = [c for c in matrix.columns if c != "genome_id"]
    out = [contract.duplicates(matrix, "genome_id")]
    if values:
        cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in values])
        odd = F.filter(cells, lambda x: x["v"].isNull() | ~F.coalesce(x["v"].cast("double").isin(0.0, 1.0), F.lit(False)))
        bad = matrix.select("genome_id", F.explode(odd).alias("x"))
        out += [bad.where("x.v is null").select(F.lit("no_nulls").alias("rule"), "genome_id", F.col("x.c").alias("detail")).toDF("rule", "key", "detail")]
        out += [bad.where("x.v is not null").select(F.lit("binary").alias("rule"), "genome_id", F.concat_ws("=", "x.c", "x.v").alias("detail")).toDF("rule", "key", "detail")]
    out += [contract.outside(labels, "genome_id", "phenotype", ["R", "S"], "phenotype")]
    out += [contract.orphans(labels, matrix, "genome_id", "labels_without_features")]
    return [*out, contract.orphans(matrix, genomes.where("cluster_id is not null"), "genome_id", "features_without_cluster")]


def validate(matrix: DataFrame, labels: DataFrame, genomes: DataFrame) -> None:
    """Raise ContractViolation at the first rule that is broken, with up to five examples."""
    missing = contract.missing_columns(labels, ["genome_id", "drug", "phenotype"], "labels") + contract.missing_columns(genomes, ["genome_id", "cluster_id"], "genomes")
    contract.validate([], missing)
    for rows in violations(matrix, labels, genomes):
        contract.validate([rows])


def load(spark: SparkSession, path: str) -> Dataset:
    """features.csv, labels.csv, genomes.csv and, if it is there, drug_targets.json below a folder, validated. Ids are
    strings always."""
    matrix, labels, genomes = (readers.csv(spark, f"{path}/{n}.csv") for n in ("features", "labels", "genomes"))
    validate(matrix, labels, genomes)
    found, vocabulary = wide_features(matrix)
    targets = readers.targets(spark, f"{path}/drug_targets.json") if readers.exists(spark, f"{path}/drug_targets.json") else spark.createDataFrame([], TARGETS)
    return Dataset(found, vocabulary, labels, genomes, targets)


def write(data: Dataset, path: str, about: DataFrame | None = None) -> None:
    """The contract files, each a folder of CSV parts by ranges of its keys, sorted, which load() reads as one (the wide table's
    vocabulary is collected: it is the header), the targets as one JSON object, and the features' metadata. A folder is
    whole once its _SUCCESS is there."""
    names = [r.feature for r in data.vocabulary.select("feature").distinct().orderBy("feature").collect()]
    wide = features.matrix(data.genomes, data.features, names)

    def put(df: DataFrame, name: str, *order: str) -> None:
        df.orderBy(*order).write.mode("overwrite").option("header", True).csv(f"{path}/{name}.csv")

    put(wide, "features", "genome_id")
    put(data.labels, "labels", "genome_id", "drug")
    put(data.genomes, "genomes", "genome_id")
    entry = F.struct(F.col("drug").alias("k"), F.struct("target_genes").alias("v"))
    whole = data.targets.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("value"))
    whole.coalesce(1).write.mode("overwrite").text(f"{path}/drug_targets.json")
    if about is not None:
        put(about, "gene_metadata", "feature_name")
