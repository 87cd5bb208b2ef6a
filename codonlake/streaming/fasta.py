"""A stream over a folder of FASTA files: detection needs one sequence only, so no state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna
from ..sources.fasta import RECORD_SEP, record_parts
from ..sources.results import ResultStore


def fasta_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """(seq_id, seq, file, valid) of every record of the files that arrive in ``folder``; invalid ones are marked, not dropped."""
    lines = spark.readStream.option("lineSep", RECORD_SEP).option("maxFilesPerTrigger", files_per_trigger).text(folder)
    rows = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    return record_parts(rows).select(F.col("header").alias("seq_id"), F.col("sequence").alias("seq"), "file", "valid")


def store_features(stream: DataFrame, detect: Callable[[DataFrame], DataFrame], store: ResultStore, module: str, checkpoint: str):
    """A query that writes each batch's features as analysis ``batch-<n>``; a batch run again replaces itself.

    Records whose sequence is no DNA are written as kind ``rejected``, with the reason.
    """

    def write(batch: DataFrame, number: int) -> None:
        store.replace(f"batch-{number}", module, detect(batch.filter("valid").select("seq_id", "seq")))
        bad = batch.filter("NOT valid").select("seq_id", "file", dna.dna_error(F.col("seq")).alias("reason"))
        store.replace(f"batch-{number}", "rejected", bad, kind="rejected")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
