"""Shine-Dalgarno sites upstream of start codons."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from .strands import KEYS, ahead, scan, words

CONSENSUS = "AGGAGG"
DISTANCES = range(4, 13)
BEST_DISTANCE = 7


def sd_sites(sequences: DataFrame, max_mismatches: int = 2, keys=KEYS) -> DataFrame:
    """The best site of every start codon, in any frame, that has one.

    Start codons are found with the letters before them, which are one
    number of three bits each: other than A, other than G, and no base. Which
    candidate is better follows from its mismatches and distance alone, so that
    the choice is the least of one number for each distance, without a shuffle.
    """
    back = 6 + max(DISTANCES)
    near = lambda start, length: F.substr(F.col("near"), start.cast("int"), F.lit(length))

    starts = dna.START_CODONS

    def find(letters):
        site = words(letters, CONSENSUS, max_mismatches)
        return [(0, np.any([words(letters, c) for c in starts], axis=0) & np.any([ahead(site, -d - 6) for d in DISTANCES], axis=0))]

    rows = scan(sequences, find, back, 3, keys).withColumn("codon", near(F.lit(back + 1), 3)).filter("n >= 13")
    number = F.coalesce(F.conv(F.translate(near(F.lit(1), back), "ACGTN.", "231377"), 8, 10).cast("long"), F.lit(0))
    rows = rows.withColumn("before", F.explode(F.array(number)))  # exploded, so that it is not worked out again for each distance
    other = int(CONSENSUS.replace("A", "1").replace("G", "2"), 8)

    def rest(d):
        """What a distance adds to 4100 a mismatch: the score first, then mismatches, then the nearness of the best distance, then the place."""
        off = abs(d - BEST_DISTANCE)
        return 10 * off + max(DISTANCES) - d - 1000 * max(0, 10 - 2 * off)

    def rated(d):
        differ = f"bit_count(shiftright(before, {3 * d}) & {other}L)"
        return F.expr(f"CASE WHEN before & {0o444444 << 3 * d}L = 0 AND {differ} <= {int(max_mismatches)} THEN 4100 * {differ} + {rest(d)} END")

    rows = rows.drop("kind").withColumn("kind", F.explode(F.array(F.least(*[rated(d) for d in DISTANCES])))).filter("kind IS NOT NULL")
    rows = rows.withColumn("d", max(DISTANCES) - F.expr("pmod(kind, 10L)"))
    off = F.abs(F.col("d") - BEST_DISTANCE)
    rows = rows.withColumn("mm", ((F.col("kind") - 10 * off - max(DISTANCES) + F.col("d") + 1000 * F.greatest(F.lit(0), 10 - 2 * off)) / 4100).cast("long"))
    bonus = F.when(F.col("codon") == "ATG", 5.0).when(F.col("codon") == "GTG", 3.0).otherwise(2.0)
    score = 20.0 - F.col("mm") * 4.0 + F.greatest(F.lit(0.0), 10.0 - off * 2.0) + bonus
    site, strand, n = F.col("i") - F.col("d") - 6, F.col("strand"), F.col("n")
    return rows.select(
        *keys,
        "strand",
        dna.forward_start(strand, site, site + 6, n).alias("start"),
        dna.forward_end(strand, site, site + 6, n).alias("end"),
        near(back - 5 - F.col("d"), 6).alias("sequence"),
        F.col("mm").alias("mismatches"),
        F.col("codon").alias("linked_start_codon"),
        dna.forward_start(strand, F.col("i"), F.col("i") + 3, n).alias("linked_start_position"),
        F.col("d").alias("distance_to_start"),
        score.alias("score"),
    )


def order() -> list:
    return [
        F.desc("score"),
        F.asc("mismatches"),
        F.abs(F.col("distance_to_start") - BEST_DISTANCE).asc(),
        dna.start_priority(F.col("linked_start_codon")).asc(),
        F.when(F.col("strand") == "+", 0).otherwise(1),
        F.asc("start"),
    ]
