"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that driver and executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Only where the
    setting is missing (tests on one machine) a temporary folder is made.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/codonlake/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``cut``, once nothing reads it any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int):
    """Jobs that run inside hand rows to Python in batches of at most ``rows``; for wide rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cell(key, bits: int = 20):
    """A number below 2**bits for a key; a set of cells is small at any size."""
    return F.pmod(F.xxhash64(key), F.lit(1 << bits)).cast("int")


def near(docs: DataFrame, wanted: DataFrame, key: str, bits: int = 20) -> DataFrame:
    """Rows of ``docs`` whose key falls in a cell of some wanted key.

    A cheap first sieve before a join by key. What is broadcast has at most
    2**bits integers, however large ``wanted`` is; it never drops a wanted row.
    """
    cells = wanted.select(cell(F.col(key), bits).alias("_cell")).distinct()
    return docs.withColumn("_cell", cell(F.col(key), bits)).join(F.broadcast(cells), "_cell", "left_semi").drop("_cell")


SMALL_ROWS = 100_000


def row_key() -> Column:
    """128-bit digest of a row's doc_id and text; tells rows apart where ids repeat or are null."""
    parts = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit(""))
    return F.unhex(F.md5(F.concat(*parts).cast("binary")))


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose row_key is not in ``rows``, a stored table with the column ``row`` alone.

    ``rows`` is counted first: up to SMALL_ROWS keys are broadcast and ``docs``
    stays where it is; more meet it in a shuffle by key.
    """
    keys = rows.select(F.col("row").alias("_row"))
    keys = F.broadcast(keys) if rows.count() <= SMALL_ROWS else keys
    return docs.join(keys, row_key() == keys["_row"], "left_anti")


BATCH_BYTES = 4 << 20


def pieces_of(batch: pa.RecordBatch, column: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose texts have about ``most`` bytes; a longer text stands alone."""
    size = np.cumsum(np.r_[0, pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)], dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, size[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def slices_of(batches, column: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in runs of about ``most`` bytes of text: short batches are put together, long ones cut."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if size >= most:
            for one in pa.Table.from_batches(held).combine_chunks().to_batches():
                yield from pieces_of(one, column, most)
            held, size = [], 0
    for one in pa.Table.from_batches(held).combine_chunks().to_batches() if held else ():
        yield from pieces_of(one, column, most)


def give_back() -> None:
    """Hand freed memory back to the system. Python workers live on between stages, so each task ends with this."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """White-space separated words: (bounds of each text, word numbers of all texts, different words).

    Separators are \\x20 and \\x09-\\x0D. Text i has the numbers from bounds[i] to
    bounds[i + 1]; each different word is handed out once, so what is costly
    for a word is done once a batch.
    """
    lists = pc.ascii_split_whitespace(texts)
    bounds = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    numbers, words = coded.indices.to_numpy(), coded.dictionary
    empty = pc.index(words, pa.scalar("", words.type)).as_py()
    if empty >= 0:  # a text begins or ends in white space
        some = numbers != empty
        bounds = np.r_[0, np.cumsum(some)][bounds]
        numbers = numbers[some]
    return bounds, numbers, words
