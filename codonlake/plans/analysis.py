"""Whole analyses of sequences: every kind of feature, ranking and clusters."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from ..operators import orfs, promoters, ranking, shine_dalgarno, similarity, strands, terminators

KINDS = ("all", "orfs", "promoters", "terminators", "shine_dalgarno", "coding_orfs", "ranked_coding_orfs", "orf_clusters")


class Analysis:
    """DataFrames over (seq_id, seq). Tiles, and hits before their suppression or ranking, are stored when a method is called."""

    def __init__(self, sequences: DataFrame, min_aa: int = 30):
        if not isinstance(min_aa, int) or min_aa <= 0:
            raise ValueError("min_aa must be a positive integer")
        self.sequences, self.min_aa = sequences, min_aa

    @cached_property
    def tiles(self) -> DataFrame:
        """The tiles that letters of ORFs are read from."""
        return strands.stored_tiles(self.sequences)

    def orfs(self) -> DataFrame:
        return strands.frames(self.sequences)

    def coding_orfs(self, texts: bool = True) -> DataFrame:
        return orfs.coding_orfs(self.sequences, self.min_aa, tiles=self.tiles if texts else None, texts=texts)

    def promoters(self) -> DataFrame:
        return promoters.promoters(self.sequences)

    def shine_dalgarno(self) -> DataFrame:
        return shine_dalgarno.sd_sites(self.sequences)

    def terminators(self) -> DataFrame:
        return terminators.terminators(self.sequences)

    def ranked_coding_orfs(self, texts: bool = True, most: int | None = None) -> DataFrame:
        """ORFs are ranked without their letters, which the ranked ones get with ``texts``; with ``most`` the first so many of each sequence."""
        ranked = ranking.rank_orfs(self.coding_orfs(texts=False), self.shine_dalgarno(), self.promoters(), self.terminators())
        ranked = ranked if most is None else ranked.filter(F.col("rank") <= most)
        if not texts:
            return ranked
        fields = [c for c in ranked.schema["orf"].dataType.names]
        rows = orfs.with_texts(ranked, self.tiles, F.col("orf.strand"), F.col("orf.start"), F.col("orf.end"))
        orf = F.struct(*[F.col(f"orf.{c}") for c in fields[:-2]], "sequence", *[F.col(f"orf.{c}") for c in fields[-2:]])
        return rows.withColumn("orf", orf).drop("sequence")

    def orf_clusters(self) -> DataFrame:
        return similarity.star_clusters(self.ranked_coding_orfs(most=similarity.MOST))

    def run(self, kind: str = "all") -> dict[str, DataFrame]:
        if kind not in KINDS:
            raise ValueError(f"unknown analysis: {kind}")
        names = KINDS[1:-1] if kind == "all" else (kind,)
        return {name: getattr(self, name)() for name in names}

    def summary(self) -> DataFrame:
        counted = {name: getattr(self, name)() for name in KINDS[1:-3]} | {"coding_orfs": self.coding_orfs(texts=False)}  # nothing is ranked to be counted
        return ranking.summary(self.sequences, counted)


def sequence_stats(sequences: DataFrame) -> DataFrame:
    """Length, GC and AT percent and size flags of every sequence."""
    n = F.length("seq")
    return sequences.select("seq_id", n.cast("long").alias("length"), dna.percent_of(F.col("seq"), "GC").alias("gc_percent"), dna.percent_of(F.col("seq"), "AT").alias("at_percent"), (n >= 50_000).alias("is_large"), (n >= 500_000).alias("is_huge"))
