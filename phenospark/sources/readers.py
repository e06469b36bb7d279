"""Sources and sinks. Ids are strings always; schemas are stated, never inferred."""

from __future__ import annotations

import io
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import BATCH_IDS, MIN_GENOME_BP, PAGE_LIMIT, TRIES
from ..operators.lineage import shared


class GenomeReaderError(ValueError):
    """An annotation table lacks what it needs."""


def csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as strings; a byte-order mark before the first name is dropped."""
    df = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path)
    return df.toDF(*[c.lstrip("\ufeff") for c in df.columns])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads it from."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def first_of(spark: SparkSession, paths: list[str]) -> str:
    """The first path that is there: the preferred source, or one that stands in for it."""
    found = next((p for p in paths if exists(spark, p)), None)
    if found is None:
        raise GenomeReaderError(f"none of {paths}")
    return found


def files(spark: SparkSession, path: str, patterns: list[str]) -> DataFrame:
    """genome_id (the name without its ending) and length of the files of a folder that have one of the endings
    (``*.fna``), in the order of names; empty files count, which no reader of contents lists. Raises where there are none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    ends = [x.lstrip("*") for x in patterns]
    listed = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    found = []
    for f in listed:
        name = f.getPath().getName()
        end = next((e for e in ends if name.endswith(e)), None)
        if f.isFile() and end:
            found.append((name.removesuffix(end), f.getLen()))
    if not found:
        raise GenomeReaderError(f"no {patterns} in {path}")
    return spark.createDataFrame(sorted(found), "genome_id string, length long")


#: Names of an annotation table's columns, of newer and older versions (fixed values).
COLUMNS = {"symbol": ["Element symbol", "Gene symbol"], "type": ["Type", "Element type"], "subtype": ["Subtype", "Element subtype"], "class": ["Class"], "subclass": ["Subclass"]}
NEEDED = ("symbol", "type")
TSV = "*.amrfinder.tsv"


def annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Genomes (genome_id) of all ``*.amrfinder.tsv`` of a folder, empty files among them, and hits (genome_id, symbol,
    type, subtype, class, subclass, pos: the file's name and line).

    Files are read as lines, each with its own header, so that those of old and new versions may lie in one folder. A
    header without a needed column raises when the hits are read."""
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.amrfinder\.tsv$", "")
    whole = spark.read.option("pathGlobFilter", TSV).text(path, wholetext=True).select(name.alias("genome_id"), "value")
    return files(spark, path, [TSV]).select("genome_id"), annotated(whole)


def annotated(whole: DataFrame) -> DataFrame:
    """Hits of annotation files (genome_id, value: a file's whole text); see ``annotations``."""
    lines = whole.select("genome_id", F.split(F.regexp_replace("value", r"^\x{FEFF}|\r", ""), "\n").alias("lines"))
    split = lines.select("genome_id", F.split(F.get("lines", F.lit(0)), "\t").alias("head"), F.posexplode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("at", "line")).where("line <> ''")
    cells = split.withColumn("cells", F.split("line", "\t"))

    def cell(kind: str):
        place = F.coalesce(*[F.when(F.array_position("head", c) > 0, F.array_position("head", c)) for c in COLUMNS[kind]])
        if kind in NEEDED:
            place = F.coalesce(place, F.raise_error(F.concat(F.lit(f"none of {COLUMNS[kind]} in the header of "), F.col("genome_id"))).cast("long"))
        return F.get("cells", (place - 1).cast("int")).alias(kind)

    return cells.select("genome_id", *map(cell, COLUMNS), F.struct("genome_id", "at").alias("pos"))


FASTA = ["*.fna", "*.fasta", "*.fa"]


def _fasta_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    listed = files(spark, path, FASTA).select("genome_id")
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.(fna|fasta|fa)$", "")
    lines = spark.read.option("pathGlobFilter", "{" + ",".join(FASTA) + "}").text(path).select(name.alias("genome_id"), F.trim(F.regexp_replace("value", r"\s+$", "")).alias("line"))
    return listed, lines


def fasta_qc(spark: SparkSession, path: str) -> DataFrame:
    """genome_id, total_bp, n_contigs, plausible_genome, message of FASTA files: counts only, no sequence is gathered."""
    listed, lines = _fasta_lines(spark, path)
    return genome_qc(listed, lines)


def genome_qc(genomes: DataFrame, lines: DataFrame) -> DataFrame:
    """The same from lines (genome_id, line)."""
    head = F.startswith("line", F.lit(">"))
    counts = lines.groupBy("genome_id").agg(F.sum(F.when(head, 0).otherwise(F.length(F.trim("line")))).alias("bp"), F.sum(head.cast("long")).alias("contigs"))
    out = genomes.join(counts, "genome_id", "left").select("genome_id", F.coalesce("bp", F.lit(0)).cast("long").alias("total_bp"), F.coalesce("contigs", F.lit(0)).cast("long").alias("n_contigs"))
    fine = (F.col("total_bp") >= MIN_GENOME_BP) & (F.col("n_contigs") > 0)
    # What a reader of the check is told.
    none = "No FASTA sequence records were found in this file."
    small = F.concat(
        F.lit("This file is only "), F.format_number("total_bp", 0), F.lit(" bp across "), F.col("n_contigs").cast("string"),
        F.lit(" record(s) — that is a gene or partial sequence, not a whole-genome assembly (E. coli genomes are ~4.5-5.5 Mb). Any prediction below is unreliable: with no genome to scan, an absence of resistance genes is indistinguishable from a truly susceptible strain. Upload a complete E. coli assembly for a trustworthy result."),
    )
    return out.withColumn("plausible_genome", fine).withColumn("message", F.when(fine, "").when(F.col("n_contigs") == 0, none).otherwise(small))


def sequences(spark: SparkSession, path: str) -> DataFrame:
    """id, sequence: all contigs of each FASTA file joined, in capitals. A genome is one row."""
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.(fna|fasta|fa)$", "")
    whole = spark.read.option("pathGlobFilter", "{" + ",".join(FASTA) + "}").text(path, wholetext=True)
    bare = F.regexp_replace(F.regexp_replace("value", r"(?m)^>.*$", ""), r"[\r\n\t ]+", "")
    return files(spark, path, FASTA).select(F.col("genome_id").alias("id")).join(whole.select(name.alias("id"), F.upper(bare).alias("sequence")), "id", "left").select("id", F.coalesce("sequence", F.lit("")).alias("sequence"))


def id_list(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """genome_id of a list, as strings, in the order of the file; the first ``limit`` where one is asked for."""
    ids = csv(spark, path).select("genome_id")
    return ids.limit(limit) if limit else ids


def zip_csvs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of zips of CSV files, by stem. The archives are taken apart in the tasks and each file's lines are written in
    order below the checkpoint folder, from where Spark reads them as any other CSV."""
    raw = spark.read.format("binaryFile").load(path).select("content")

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if n.endswith(".csv")):
                        stem = name.rsplit("/", 1)[-1].removesuffix(".csv")
                        with z.open(name) as lines:
                            while part := [x.decode("utf-8-sig").rstrip("\r\n") for x in lines.readlines(1 << 20)]:
                                yield pd.DataFrame({"value": part, "stem": stem})

    out = f"{shared(spark)}/zip-{uuid.uuid4().hex}"
    raw.mapInPandas(unpack, "value string, stem string").write.partitionBy("stem").text(out)
    stems = [r.stem for r in spark.read.text(out).select("stem").distinct().collect()]  # one for each table
    return {stem: csv(spark, f"{out}/stem={stem}") for stem in stems}


def targets(spark: SparkSession, path: str) -> DataFrame:
    """drug, target_genes from a JSON object of drugs."""
    one = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, struct<target_genes:array<string>, note:string>>").alias("m"))
    return one.select(F.explode("m")).select(F.col("key").alias("drug"), F.col("value.target_genes").alias("target_genes"), F.col("value.note").alias("note"))


def requests(ids: DataFrame, endpoint: str, columns: list[str], extra: str = "", size: int = BATCH_IDS) -> DataFrame:
    """endpoint, query and key of the requests for ids (genome_id, n: their number from 0), ``size`` ids in each; filter and
    columns are part of the query, and the key of a kept answer is a digest of it."""
    by = ids.groupBy(F.floor(F.col("n") / size).alias("batch")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "genome_id"))), lambda x: x["genome_id"]), ",").alias("ids"))
    inside = F.concat(F.lit("in(genome_id,("), "ids", F.lit("))"))
    asked = F.concat(F.lit("and("), inside, F.lit(f",{extra})")) if extra else inside
    query = F.concat(asked, F.lit(f"&select({','.join(columns)})&limit({PAGE_LIMIT})"))
    return by.select("batch", F.lit(endpoint).alias("endpoint"), query.alias("query")).withColumn("key", F.concat(F.lit(f"{endpoint}_"), F.substring(F.sha1(F.concat(F.lit(f"{endpoint}?"), "query")), 1, 16), F.lit(".json")))


def _kept(spark: SparkSession, cache: str) -> DataFrame:
    """key, value of the kept answers: JSON files that were there before, and what fetch() has added beside them."""
    found = spark.createDataFrame([], "key string, value string")
    if exists(spark, cache):
        files = spark.read.option("pathGlobFilter", "*.json").text(cache, wholetext=True)
        found = found.unionByName(files.select(F.col("_metadata.file_name").alias("key"), "value"))
    if exists(spark, fetched(cache)):
        found = found.unionByName(spark.read.schema("key string, value string").parquet(fetched(cache)).dropDuplicates(["key"]))
    return found


def fetched(cache: str) -> str:
    """The table of answers that fetch() keeps for a folder of answers."""
    return f"{cache.rstrip('/')}.fetched"


def answers(asked: DataFrame, cache: str, schema: str, limit: int = PAGE_LIMIT) -> DataFrame:
    """Rows of the kept answers to requests(), with batch and pos. Raises (when read) for a request without an answer and
    for an answer that fills a page, which may have lost rows."""
    kept = _kept(asked.sparkSession, cache).select("key", F.from_json("value", f"array<struct<{schema}>>").alias("rows"))
    told = asked.join(kept, "key", "left")
    missing = F.raise_error(F.concat(F.lit("no answer is kept for "), F.col("key")))
    full = F.raise_error(F.concat(F.lit(f"an answer has {limit} rows or more, ask for fewer ids: "), F.col("key")))
    checked = told.withColumn("rows", F.when(F.col("rows").isNull(), missing.cast(f"array<struct<{schema}>>")).when(F.size("rows") >= limit, full.cast(f"array<struct<{schema}>>")).otherwise(F.col("rows")))
    return checked.select("batch", F.posexplode("rows").alias("pos", "r")).select("batch", "pos", "r.*")


def fetch(asked: DataFrame, get: Callable[[str, str], str], cache: str, tries: int = TRIES, wait: float = 2.0) -> None:
    """Keep answers of requests() that are not kept yet: ``get`` (endpoint, query) gives JSON text; a failure is tried again
    after ``wait`` seconds times the number of tries so far. Requests go out from the tasks, which write the answers to
    fetched(); none passes the driver, and the write is committed whole or not at all."""
    asked = asked.join(_kept(asked.sparkSession, cache).select("key"), "key", "left_anti")

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for key, endpoint, query in zip(f["key"], f["endpoint"], f["query"], strict=True):
                for n in range(1, tries + 1):
                    try:
                        yield pd.DataFrame({"key": [key], "value": [get(endpoint, query)]})
                        break
                    except Exception as e:  # any failure of the service
                        if n == tries:
                            raise RuntimeError(f"{endpoint} failed after {tries} tries: {e}") from e
                        time.sleep(wait * n)

    out = asked.select("endpoint", "query", "key").mapInPandas(ask, "key string, value string")
    out.write.mode("append").parquet(fetched(cache))


def gate_failures(results: DataFrame, most: float = 0.05) -> DataFrame:
    """results (genome_id, error: null where it went well) of a batch of annotations, without the failed; raises where more
    than a share of ``most`` failed."""
    n, bad = results.agg(F.count("*"), F.count("error")).first()
    if n and bad > most * n:
        raise GenomeReaderError(f"{bad} of {n} genomes failed, above {most:.1%}")
    return results.where("error is null").drop("error")


def write(df: DataFrame, path: str, kind: str = "parquet") -> None:
    df.write.mode("overwrite").option("header", True).format(kind).save(path)
