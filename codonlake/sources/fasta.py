"""Sequence readers: FASTA files and folders, JSON requests, text tables."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna

EXTENSIONS = r"(?i)\.(fasta|fa|fna|fas|txt)$"
#: A record begins with '>' at the beginning of a line only; other ones belong to headers.
RECORD_SEP = "\n>"


def record_parts(rows: DataFrame) -> DataFrame:
    """(path, file, block, header, sequence, valid) of the records in ``rows`` (path, file, block, value), split at RECORD_SEP.

    What stands before a file's first record is left out. Rows of a file part
    come one after the other in their task, so the first is known without a shuffle.
    """

    def marked(batches):
        last = None
        for batch in batches:
            parts = list(zip(batch.column("path").to_pylist(), batch.column("block").to_pylist()))
            first = [b == 0 and (p, b) != before for (p, b), before in zip(parts, [last, *parts])]
            last = parts[-1] if parts else last
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.bool_())], [*batch.schema.names, "first"])

    rows = rows.filter(F.col("file").rlike(EXTENSIONS)).select("path", "file", "block", "value").mapInArrow(marked, "path string, file string, block long, value string, first boolean")
    begun = F.regexp_replace("value", "^\ufeff?>", "")  # a file's first record keeps its sign
    rows = rows.filter(~F.col("first") | F.col("value").rlike("^\ufeff?>")).withColumn("value", F.when(F.col("first"), begun).otherwise(F.col("value")))
    parts = F.split("value", "\n", 2)
    header = F.split(F.trim(F.regexp_replace(parts[0], r"\s", " ")), " +")[0]
    rows = rows.select("path", "file", "block", header.alias("header"), dna.clean(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("sequence"))
    return rows.withColumn("valid", dna.is_dna(F.col("sequence")))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, record, header, sequence, length) of all records of a file, glob or folder.

    Records are split by Spark's text reader, so a file of any size is read in
    parallel. ``path`` and ``record`` order the records. A path that is missing,
    or without any file of a FASTA ending, is an error; ``without_records`` and
    ``require_records`` find files that hold none.
    """
    lines = spark.read.text(path, lineSep=RECORD_SEP)
    names = lines.inputFiles()
    if not any(re.search(EXTENSIONS, n) for n in names):
        raise ValueError(f"No FASTA files found in: {path}" if names else f"No files found in: {path}")
    rows = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    rows = record_parts(rows).withColumn("row", F.monotonically_increasing_id())
    return rows.select("path", "file", F.struct("block", "row").alias("record"), "header", "sequence", F.length("sequence").alias("length"))


def without_records(spark: SparkSession, path: str) -> DataFrame:
    """(path): FASTA files that hold no record."""
    every = spark.read.format("binaryFile").load(path).select("path").filter(F.col("path").rlike(EXTENSIONS))
    return every.join(read_fasta(spark, path).select("path").distinct(), "path", "left_anti")


def require_records(spark: SparkSession, path: str) -> DataFrame:
    """The records below ``path``; a file without any is an error."""
    empty = without_records(spark, path).first()
    if empty:
        raise ValueError(f"No FASTA record found in file: {empty['path']}")
    return read_fasta(spark, path)


def in_order(fasta: DataFrame) -> DataFrame:
    """Records by file name, then as they stand in the file."""
    return fasta.orderBy("file", "path", "record")


def first_records(fasta: DataFrame) -> DataFrame:
    """The first record of every file."""
    return counted_records(fasta).select(*fasta.columns)


def counted_records(fasta: DataFrame) -> DataFrame:
    """The first record of every file, and how many ``records`` it has: files are read once.

    A task puts its records of a file together before any are shuffled.
    """
    first = F.min_by(F.struct(*fasta.columns), "record")
    return fasta.groupBy("path").agg(first.alias("r"), F.count("*").alias("records")).select("r.*", "records")


def read_joined(spark: SparkSession, path: str) -> DataFrame:
    """(file, sequence): all records of a file as one sequence; files without a valid one are left out."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value").filter(F.col("file").rlike(EXTENSIONS))
    rows = rows.select("file", dna.clean(F.regexp_replace("value", r"(?m)^>.*$", "")).alias("sequence"))
    return rows.filter(dna.is_dna(F.col("sequence")))


def read_requests(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(file, header, sequence) from JSON requests: a sequence, or files with sequences; one request a file, or one a line."""
    schema = "mode string, sequence string, min_aa int, files array<struct<name:string,sequence:string,header:string>>"
    rows = spark.read.schema(schema).json(path, multiLine=not lines)
    one = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.col("sequence"), F.lit(None).cast("string").alias("header")))
    rows = rows.select(F.explode(F.when(F.col("mode") == "folder", F.col("files")).otherwise(one)).alias("f"))
    return rows.select(F.coalesce("f.name", F.lit("unknown")).alias("file"), F.col("f.header").alias("header"), dna.clean(F.col("f.sequence")).alias("sequence"))


def as_sequences(records: DataFrame, seq_id: str = "header", sequence: str = "sequence") -> DataFrame:
    """(seq_id, seq) with validated DNA, as the operators take it; invalid input fails the query."""
    return records.select(F.col(seq_id).alias("seq_id"), dna.require_dna(dna.clean(F.col(sequence))).alias("seq"))
