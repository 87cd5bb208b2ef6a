"""Text reports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from .ranks import with_rank
from .strands import KEYS

CLIP = 90


def clipped(text):
    return F.when(F.length(text) > CLIP, F.concat(F.substring(text, 1, CLIP), F.lit("..."))).otherwise(text)


def feature_lines(rows: DataFrame, title: str, order: list, fields: list[str] | None = None, keys=KEYS) -> DataFrame:
    """(keys, rank, line): a line for each feature, in biological order within a sequence."""
    fields = fields or [c for c in rows.columns if c not in keys]
    shown = [F.concat(F.lit(f"{c}: "), F.coalesce(clipped(F.col(c).cast("string")), F.lit("Not found"))) for c in fields]
    return with_rank(rows, keys, order).select(*keys, "rank", F.concat(F.lit(f"{title} "), F.col("rank").cast("string"), F.lit(" | "), F.concat_ws(" | ", *shown)).alias("line"))


#: For each report: what is counted, what one is called, what stands where there is none, and its lines of
#: (label, template over columns; <column> is cut to CLIP letters). Wording is fixed output (fixed values).
REPORTS = {
    "promoters": (
        "promoter-like region(s)",
        "Promoter",
        "No sigma70-like promoter region found.",
        [
            ("Strand: ", "{strand}"),
            ("-35 box: ", "{box35_seq} at {box35_start}..{box35_end} (mismatches={box35_mismatches})"),
            ("-10 box: ", "{box10_seq} at {box10_start}..{box10_end} (mismatches={box10_mismatches})"),
            ("Spacing: ", "{spacing} nt"),
            ("Spacer sequence: ", "{spacer_seq}"),
            ("Spacer AT fraction: ", "{spacer_at_fraction}"),
            ("Score: ", "{score}"),
        ],
    ),
    "coding_orfs": (
        "coding ORF(s)",
        "Coding ORF",
        "No coding ORFs found.",
        [
            ("Strand: ", "{strand}"),
            ("Frame: ", "{frame}"),
            ("Start: ", "{start}"),
            ("End: ", "{end}"),
            ("Length: ", "{length_nt} nt"),
            ("Peptide length: ", "{peptide_length_aa} aa"),
            ("Start codon: ", "{start_codon}"),
            ("Stop codon: ", "{stop_codon}"),
            ("Sequence: ", "<sequence>"),
        ],
    ),
    "sd_sites": (
        "Shine-Dalgarno-like site(s)",
        "Site",
        "No Shine-Dalgarno-like site found.",
        [
            ("Strand: ", "{strand}"),
            ("Positions: ", "{start}..{end}"),
            ("Sequence: ", "{sequence}"),
            ("Mismatches vs consensus AGGAGG: ", "{mismatches}"),
            ("Context: ", "linked to {linked_start_codon} at position {linked_start_position} with spacing {distance_to_start} nt"),
            ("Score: ", "{score}"),
        ],
    ),
    "terminators": (
        "terminator-like region(s)",
        "Terminator",
        "No rho-independent terminator-like structure found.",
        [
            ("Strand:       ", "{strand}"),
            ("Left stem:    ", "{stem_left_seq} at {stem_left_start}..{stem_left_end}"),
            ("Loop:         ", "{loop_seq}"),
            ("Right stem:   ", "{stem_right_seq} at {stem_right_start}..{stem_right_end}"),
            ("Poly-T:       ", "{poly_t_seq} at {poly_t_start}..{poly_t_end}"),
            ("Stem length:  ", "{stem_length}"),
            ("Loop length:  ", "{loop_length}"),
            ("Mismatches:   ", "{mismatches}"),
            ("GC fraction:  ", "{gc_fraction}"),
            ("Poly-T len:   ", "{poly_t_length}"),
            ("Score:        ", "{score}"),
        ],
    ),
    "orfs": (
        "reading frame(s)",
        "Frame",
        "No reading frames found.",
        [
            ("Strand: ", "{strand}"),
            ("Frame: ", "{frame}"),
            ("Positions: ", "{start}..{end}"),
            ("Length: ", "{length_nt} nt ({peptide_length_aa} codons)"),
            ("Sequence: ", "<sequence>"),
        ],
    ),
}


def _filled(template: str):
    parts = []
    for text, column, cut in re.findall(r"([^{<]*)(?:\{(\w+)\}|<(\w+)>|$)", template):
        parts += [F.lit(text)] * bool(text) + [F.col(column).cast("string")] * bool(column) + ([clipped(F.col(cut))] if cut else [])
    return F.concat(*parts)


def report(features: DataFrame, kind: str, order: list, sequences: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, rank, line): the text report of every sequence, a line a row.

    Rank 0 is the count, or what is said where nothing was found; the n-th
    feature in ``order`` stands at rank n, its lines in one.
    """
    what, one, none, lines = REPORTS[kind]
    body = F.concat(F.lit(f"{one} "), F.col("rank").cast("string"), *[F.concat(F.lit(f"\n  {label}"), _filled(template)) for label, template in lines], F.lit("\n"))
    ranked = with_rank(features, keys, order)  # stored: the features are not looked for again to be counted
    rows = ranked.select(*keys, "rank", body.alias("line"))
    counts = sequences.select(*keys).join(ranked.groupBy(*keys).agg(F.count("*").alias("n")), list(keys), "left")
    head = F.when(F.col("n") > 0, F.concat(F.lit("Detected "), F.col("n").cast("string"), F.lit(f" {what}:\n"))).otherwise(F.lit(none))
    return rows.unionByName(counts.select(*keys, F.lit(0).alias("rank"), head.alias("line")))


def double_strand(sequences: DataFrame, width: int = 60, keys=KEYS) -> DataFrame:
    """(keys, start, top, bottom): both strands in blocks of ``width`` letters."""
    rows = sequences.filter("length(seq) > 0").withColumn("off", F.explode(F.expr(f"sequence(0, length(seq) - 1, {width})")))
    top = F.substr(F.col("seq").cast("binary"), F.col("off") + 1, F.lit(width)).cast("string")
    rows = rows.select(*keys, (F.col("off") + 1).cast("long").alias("start"), top.alias("top"))
    return rows.withColumn("bottom", dna.complement(F.col("top")))


def write_report(lines: DataFrame, path: str, keys=KEYS) -> None:
    """One text line for each row of ``lines``, in order."""
    lines.orderBy(*keys, "rank").select("line").write.mode("overwrite").text(path)
