"""DNA derived from the text of the ``documents`` table, for tables without any.

Letters map onto bases in turn, z onto N; a promoter with a ribosome site leads
every sequence, a hairpin with a run of T ends it, and the reverse strand gets a
hairpin of its own.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.strands import letters_of, texts_of

LETTERS = "abcdefghijklmnopqrstuvwxyz"
BASES_FOR = ("ACGT" * 7)[:25] + "N"
HEAD = "TTGACA" "TTTACGGATTCGCAATA" "TATAAT" "GCGCA" "AGGAGG" "TTACATA" "ATG"
HAIRPIN = "CAAACA" "CCGCGGCAC" "TTCA" "GTGCCGCGG"
REVERSED_HAIRPIN = "CCGCGGCAC" "TGAA" "GTGCCGCGG" "TGTTTG"
#: By byte: the base of a letter, 0 for what is left out.
BASE_OF = np.zeros(256, np.uint8)
for _letter, _base in zip(LETTERS, BASES_FOR):
    BASE_OF[[ord(_letter), ord(_letter.upper())]] = ord(_base)
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this package


def _bases(batches):
    for batch in batches:
        letters, ends = letters_of(batch.column("text"))
        bases = BASE_OF[letters]
        kept = bases != 0
        upto = np.concatenate([[0], np.cumsum(kept)])
        yield pa.RecordBatch.from_arrays([batch.column("seq_id"), texts_of(bases[kept], upto[ends])], ["seq_id", "bases"])


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, seq) of all documents, from their whole texts."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("seq_id"), "text")
    rows = rows.mapInArrow(_bases, f"seq_id {rows.schema['seq_id'].dataType.simpleString()}, bases string")
    run = F.repeat(F.lit("T"), (5 + F.col("seq_id") % 4).cast("int"))
    back = F.repeat(F.lit("A"), (5 + F.col("seq_id") % 3).cast("int"))
    seq = F.concat(back, F.lit(REVERSED_HAIRPIN + HEAD), F.col("bases"), F.lit(HAIRPIN), run)
    return rows.select("seq_id", seq.alias("seq"))


SQL = f"""seqs AS (
    SELECT doc_id AS seq_id,
           repeat('A', CAST(5 + doc_id % 3 AS INT)) || '{REVERSED_HAIRPIN}{HEAD}'
           || translate(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES_FOR}')
           || '{HAIRPIN}' || repeat('T', CAST(5 + doc_id % 4 AS INT)) AS seq
    FROM documents)"""
