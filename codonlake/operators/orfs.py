"""Coding open reading frames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dna
from .strands import KEYS, TILE, ahead, scan, stored_tiles, words

BLOCK = 1 << 16
#: How many codons a scan looks for a stop that is too close.
APART = 30


def codons(sequences: DataFrame, start_codons=dna.START_CODONS, stop_codons=dna.STOP_CODONS, keys=KEYS, apart: int = 0) -> DataFrame:
    """(keys, strand, n, frame, i, codon, is_start, is_stop) of all start and stop codons.

    With ``apart``, without starts that have a stop among so many codons behind
    them, and stops that have one among so many before: they are too close to
    each other, and the next stop of the starts that are left is left, too.
    """

    def find(letters):
        start, stop = (np.any([words(letters, c) for c in codons], axis=0) for codons in (start_codons, stop_codons))
        near = lambda way: np.any([ahead(stop, way * 3 * k) for k in range(1, apart + 1)], axis=0) if apart else np.zeros_like(stop)
        return [(0, start & ~near(1) | stop & ~near(-1))]

    rows = scan(sequences, find, 0, 3, keys, 3 * apart + 3).withColumnRenamed("near", "codon")
    is_start, is_stop = F.col("codon").isin(*start_codons), F.col("codon").isin(*stop_codons)
    return rows.select(*keys, "strand", "n", (F.col("i") % 3 + 1).alias("frame"), "i", "codon", is_start.alias("is_start"), is_stop.alias("is_stop"))


def orf_positions(sequences: DataFrame, start_codons=None, stop_codons=None, longest_only_per_stop: bool = False, keys=KEYS, min_aa: int = 0) -> DataFrame:
    """(keys, strand, n, frame, i, stop, start_codon, stop_codon): start codons with the next stop codon in their frame, from ``min_aa`` codons between them on.

    The next stop is looked up inside blocks of positions, and for the last
    starts of a block among the first stops of later blocks, so that one long
    sequence is work for many tasks. Only sequences of more than one block are
    read for the latter.
    """
    stop_codons = list(stop_codons or dna.STOP_CODONS)
    find = lambda some: codons(some, start_codons or dna.START_CODONS, stop_codons, keys, max(0, min(min_aa - 1, APART))).withColumn("block", F.floor(F.col("i") / BLOCK))
    rows = find(sequences)
    frame = [*keys, "strand", "frame"]
    which = sum((F.when(F.col("codon") == c, k).otherwise(0) for k, c in enumerate(stop_codons)), F.lit(0))
    stop = F.when(F.col("is_stop"), F.col("i") * len(stop_codons) + which)  # its place and which one it is, as one number
    here = W.partitionBy(*frame, "block").orderBy("i").rowsBetween(0, W.unboundedFollowing)
    found = rows.withColumn("here", F.min(stop).over(here)).filter("is_start")
    later = W.partitionBy(*frame).orderBy("block").rowsBetween(1, W.unboundedFollowing)
    firsts = find(sequences.filter(F.octet_length("seq") > BLOCK)).groupBy(*frame, "block").agg(F.min(stop).alias("first")).withColumn("later", F.min("first").over(later)).drop("first")
    found = found.join(firsts, [*frame, "block"], "left").withColumn("_stop", F.coalesce("here", "later")).filter("_stop IS NOT NULL")
    if longest_only_per_stop:
        found = found.groupBy(*frame, "n", "_stop").agg(F.min(F.struct("i", "codon")).alias("x")).select(*frame, "n", "_stop", "x.*")
    kind = F.element_at(F.array(*map(F.lit, stop_codons)), (F.col("_stop") % len(stop_codons) + 1).cast("int"))
    stop = F.floor(F.col("_stop") / len(stop_codons))
    found = found.select(*keys, "strand", "n", "frame", "i", stop.alias("stop"), F.col("codon").alias("start_codon"), kind.alias("stop_codon"))
    return found.filter(F.floor((F.col("stop") + 3 - F.col("i")) / 3) - 1 >= min_aa)


def coding_orfs(sequences: DataFrame, min_aa: int = 30, start_codons=None, stop_codons=None, longest_only_per_stop: bool = False, keys=KEYS, tiles: DataFrame | None = None, texts: bool = True) -> DataFrame:
    """Every start codon with its stop, from ``min_aa`` amino acids on; ``tiles`` are stored tiles of the sequences, if there are any.

    Without ``texts`` there is no column ``sequence``, and no letters are read but those around codons.
    """
    found = orf_positions(sequences, start_codons, stop_codons, longest_only_per_stop, keys, min_aa)
    end = F.col("stop") + 3
    length = end - F.col("i")
    rows = found.select(
        *keys,
        "strand",
        "frame",
        dna.forward_start(F.col("strand"), F.col("i"), end, F.col("n")).alias("start"),
        dna.forward_end(F.col("strand"), F.col("i"), end, F.col("n")).alias("end"),
        length.alias("length_nt"),
        (F.floor(length / 3) - 1).alias("peptide_length_aa"),
        "start_codon",
        "stop_codon",
        F.col("i").alias("start_index_in_strand"),
        F.col("stop").alias("stop_index_in_strand"),
    )
    if not texts:
        return rows
    columns = rows.columns
    return with_texts(rows, stored_tiles(sequences, keys) if tiles is None else tiles, F.col("strand"), F.col("start"), F.col("end"), keys).select(*columns[:-2], "sequence", *columns[-2:])


def with_texts(rows: DataFrame, tiles: DataFrame, strand: Column, start: Column, end: Column, keys=KEYS) -> DataFrame:
    """``rows`` of ORFs with their letters as ``sequence``, given their strand and their places on the forward one.

    Only the letters between the first start of a stop codon and the stop leave
    their tiles, and ORFs with one stop codon share them, so that a chromosome
    is work for many tasks.
    """
    by = [*keys, "_strand", "_stop"]
    plus = F.col("_strand") == "+"
    one = F.struct(start.alias("_a"), end.alias("_b"), F.struct(*rows.columns).alias("_row"))
    spans = rows.select(*keys, strand.alias("_strand"), F.when(strand == "+", end).otherwise(start).alias("_stop"), one.alias("_one"))
    spans = spans.groupBy(*by).agg(F.collect_list("_one").alias("_all"), (F.min("_one._a") - 1).alias("_first"), F.max("_one._b").alias("_last"))
    first, last = F.col("_first"), F.col("_last")
    spans = spans.withColumn("off", F.explode(F.sequence(F.floor(first / TILE) * TILE, last - 1, F.lit(TILE).cast("long"))))
    spans = spans.withColumn("_all", F.when(F.col("off") <= first, F.col("_all")))  # in the first tile of a span only
    met = spans.join(tiles.select(*keys, "off", "t"), [*keys, "off"])
    low = F.greatest(first - F.col("off"), F.lit(0))
    letters = F.substr(F.col("t"), (low + 1).cast("int"), (F.least(last - F.col("off"), F.lit(TILE)) - low).cast("int")).cast("string")
    parts = F.sort_array(F.collect_list(F.struct("off", "_letters")))
    met = met.withColumn("_letters", letters).groupBy(*by).agg(F.first("_all", True).alias("_all"), F.first("_first").alias("_first"), F.first("_last").alias("_last"), F.array_join(F.transform(parts, lambda x: x["_letters"]), "").alias("_text"))
    text = F.when(plus, F.col("_text")).otherwise(dna.reverse_complement(F.col("_text")))
    met = met.select("_strand", "_first", "_last", text.alias("_text"), "_all")  # before the ORFs are apart: once a stop codon
    each = met.select("_strand", "_first", "_last", "_text", F.explode("_all").alias("_one"))
    before = F.when(plus, F.col("_one._a") - 1 - first).otherwise(last - F.col("_one._b"))
    length = F.col("_one._b") - F.col("_one._a") + 1
    return each.select("_one._row.*", F.substr(F.col("_text"), (before + 1).cast("int"), length.cast("int")).alias("sequence"))


def order() -> list:
    """Longest first, then better start codons, the forward strand, and position."""
    return [F.desc("peptide_length_aa"), dna.start_priority(F.col("start_codon")), F.when(F.col("strand") == "+", 0).otherwise(1), F.asc("start"), F.asc("end")]


def best_orf(orfs: DataFrame, keys=KEYS) -> DataFrame:
    """The first coding ORF of each sequence; sequences without one have no row."""
    return orfs.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order()))).filter("_r = 1").drop("_r")
