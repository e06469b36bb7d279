"""Predictions for annotation files as they arrive, through the same bridge and panel as in a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.constants import SPECIES
from ..plans import panel
from ..sources import readers

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, most: int = 1000) -> DataFrame:
    """genome_id, value: each new annotation file of a folder whole; at most ``most`` in a micro-batch. Spark shows no empty files."""
    files = spark.readStream.schema(FILES).format("binaryFile").option("pathGlobFilter", readers.TSV).option("maxFilesPerTrigger", most).load(path)
    name = F.regexp_extract("path", r"([^/]*)\.amrfinder\.tsv$", 1)
    return files.select(name.alias("genome_id"), F.decode("content", "UTF-8").alias("value"))


def follow(spark: SparkSession, fitted: panel.Panel, path: str, out: str, checkpoint: str, most: int = 1000, every: str | None = None) -> StreamingQuery:
    """Write the prediction records of every annotation file that comes to a folder, below ``out``; until none is left, or
    ``every`` so often (\"1 minute\") without end.

    A file is one genome, so nothing is kept between micro-batches. Each is written to a folder of its own number, which a
    repeated one (after a failure) writes anew: every genome is told once. Files must be moved in whole: one that is changed
    under its old name isn't read again. A header without a needed column ends the stream with an error. Empty files, which
    are genomes without hits, are told by ``empty``."""

    def told(batch: DataFrame, number: int) -> None:
        genomes = batch.select("genome_id", F.lit(SPECIES).alias("species"))
        panel.analyze(fitted, genomes, readers.annotated(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = arriving(spark, path, most).writeStream.foreachBatch(told).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def empty(spark: SparkSession, fitted: panel.Panel, path: str, out: str) -> None:
    """Write the prediction records of the empty files of a folder, which the stream passes over, as batch -1; all of them anew
    each time. Does nothing where there are none."""
    bare = readers.files(spark, path, [readers.TSV]).where("length = 0")
    if not bare.isEmpty():
        genomes = bare.select("genome_id", F.lit(SPECIES).alias("species"))
        nothing = readers.annotated(genomes.select("genome_id", F.lit("").alias("value")))
        panel.analyze(fitted, genomes, nothing).write.mode("overwrite").parquet(f"{out}/batch=-1")
