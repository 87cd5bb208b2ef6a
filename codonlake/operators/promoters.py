"""Sigma70-like promoters: a -35 and a -10 box at a spacing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from .nms import keep_best
from .strands import KEYS, ahead, scan, words

BOX35, BOX10 = "TTGACA", "TATAAT"
BEST_SPACING = 17


def _found(sequences: DataFrame, max_mismatches_box35: int = 2, max_mismatches_box10: int = 2, spacing_min: int = 16, spacing_max: int = 19, keys=KEYS) -> DataFrame:
    """(keys, strand, n, i, spacing, near): the place of the -35 box and the letters from there on.

    Both boxes and the spacer are letters behind the place of the -35 box, so
    that no join is needed. No box has an N or lies beyond an end.
    """
    spacings = range(spacing_min, spacing_max + 1) if spacing_min >= 0 else []

    def find(letters):
        box35, box10 = words(letters, BOX35, max_mismatches_box35), words(letters, BOX10, max_mismatches_box10)
        return [(x, box35 & ahead(box10, 6 + x)) for x in spacings]

    return scan(sequences, find, 0, 12 + max(spacings, default=0), keys).withColumnRenamed("kind", "spacing")


def _rated(rows: DataFrame) -> DataFrame:
    near, spacing = F.col("near"), F.col("spacing").cast("int")
    rows = rows.withColumns({"box35_seq": F.substr(near, F.lit(1), F.lit(6)), "box10_seq": F.substr(near, spacing + 7, F.lit(6)), "spacer_seq": F.substr(near, F.lit(7), spacing)})
    rows = rows.withColumns({"box35_mismatches": dna.mismatches_with(F.col("box35_seq"), BOX35).cast("long"), "box10_mismatches": dna.mismatches_with(F.col("box10_seq"), BOX10).cast("long")})
    at = dna.count_of(F.col("spacer_seq"), "AT") / F.col("spacing")
    score = 30.0 - F.col("box35_mismatches") * 5.0 - F.col("box10_mismatches") * 6.0 - F.abs(F.col("spacing") - BEST_SPACING) * 1.5 + at * 4.0
    return rows.withColumns({"spacer_at_fraction": dna.rounded3(at), "score": dna.rounded3(score)})


def _shown(rows: DataFrame, keys) -> DataFrame:
    place = lambda f, a, b: f(F.col("strand"), a, b, F.col("n"))
    i10 = F.col("i") + 6 + F.col("spacing")
    return _rated(rows).select(
        *keys,
        "strand",
        place(dna.forward_start, F.col("i"), F.col("i") + 6).alias("box35_start"),
        place(dna.forward_end, F.col("i"), F.col("i") + 6).alias("box35_end"),
        "box35_seq",
        "box35_mismatches",
        place(dna.forward_start, i10, i10 + 6).alias("box10_start"),
        place(dna.forward_end, i10, i10 + 6).alias("box10_end"),
        "box10_seq",
        "box10_mismatches",
        "spacing",
        "spacer_seq",
        "spacer_at_fraction",
        "score",
        F.col("i").alias("i35"),
        i10.alias("i10"),
    )


def raw_promoters(sequences: DataFrame, keys=KEYS, **how) -> DataFrame:
    """All pairs of boxes within the mismatches allowed; (i35, i10) are 0-based on the strand."""
    return _shown(_found(sequences, keys=keys, **how), keys)


def promoters(sequences: DataFrame, keys=KEYS, **how) -> DataFrame:
    """Promoters without overlaps: the best of each stretch stays. Letters and numbers are worked out again for what is kept."""
    hits = _rated(_found(sequences, keys=keys, **how))
    a, b = F.col("i"), F.col("i") + 12 + F.col("spacing")
    a, b = (f(F.col("strand"), a, b, F.col("n")) for f in (dna.forward_start, dna.forward_end))
    best = [-F.col("score"), (F.col("box10_mismatches") * 8 + F.col("box35_mismatches")).cast("byte"), F.abs(F.col("spacing") - BEST_SPACING), F.col("i"), F.col("spacing")]
    narrow = hits.select(*keys, "strand", "n", "i", "spacing", "near", a.alias("_a"), b.alias("_b"), *[c.alias(f"_by{k}") for k, c in enumerate(best)])
    kept = keep_best(narrow, [*keys, "strand"], "_a", "_b", [F.col(f"_by{k}") for k in range(len(best))])
    return _shown(kept, keys).drop("i35", "i10")


def order() -> list:
    return [
        F.desc("score"),
        F.asc("box10_mismatches"),
        F.asc("box35_mismatches"),
        F.abs(F.col("spacing") - BEST_SPACING).asc(),
        F.when(F.col("strand") == "+", 0).otherwise(1),
        F.least("box35_start", "box10_start").asc(),
    ]
