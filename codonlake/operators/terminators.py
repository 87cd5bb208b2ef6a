"""Rho-independent terminators: a GC-rich hairpin before a run of T."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dna
from .nms import keep_best
from .strands import KEYS, scan, words


BLOCK = 1 << 16
#: Letters that fit a number, of two bits each, and the lower bit of each.
DIGITS, LOW_BITS = 31, 0x5555555555555555


def t_runs(sequences: DataFrame, min_poly_t: int = 5, context: int = 27, keys=KEYS, block: int = BLOCK) -> DataFrame:
    """(keys, strand, n, i, run, before): positions that begin ``min_poly_t`` or more T.

    Consecutive such positions form an island whose last one has exactly
    ``min_poly_t`` T, which gives each its run, however long. Islands are found
    in blocks of positions; one that ends with its block goes on to where the
    island at the beginning of the next block ends. ``before`` are the
    ``context`` letters ahead of the position.
    """
    here = [*keys, "strand", "_block"]

    def islands(some):
        rows = scan(some, lambda x: [(0, words(x, "T" * min_poly_t))], context, 0, keys, min_poly_t)
        rows = rows.select(*keys, "strand", "n", "i", F.col("near").alias("before"), F.floor(F.col("i") / block).alias("_block"))
        rows = rows.withColumn("_island", F.col("i") - F.row_number().over(W.partitionBy(*here).orderBy("i")))
        return rows.withColumn("_last", F.max("i").over(W.partitionBy(*here, "_island"))).drop("_island")

    rows = islands(sequences)
    long = islands(sequences.filter(F.octet_length("seq") > block))  # no others go on in a next block
    ends = _carried(long.filter(F.col("i") == F.col("_block") * block).select(*here, "_last"), keys, block)
    goes_on = F.when(F.col("_last") == (F.col("_block") + 1) * block - 1, F.col("_block") + 1)
    rows = rows.withColumn("_next", goes_on).join(ends, [*keys, "strand", "_next"], "left")
    return rows.withColumn("run", F.coalesce("_end", "_last") - F.col("i") + min_poly_t).drop("_block", "_last", "_next", "_end")


def _carried(starts: DataFrame, keys, block: int) -> DataFrame:
    """(keys, strand, _next, _end): where the island at the beginning of block _next ends, across blocks that it fills.

    ``starts`` has a row for each block that begins inside an island.
    """
    strand = [*keys, "strand"]
    rows = starts.withColumn("_chain", F.col("_block") - F.row_number().over(W.partitionBy(*strand).orderBy("_block")))
    fills = F.col("_last") == (F.col("_block") + 1) * block - 1
    after = W.partitionBy(*strand, "_chain").orderBy("_block").rowsBetween(0, W.unboundedFollowing)
    first_short = F.min(F.when(~fills, F.struct("_block", "_last"))).over(after)
    return rows.select(*strand, F.col("_block").alias("_next"), F.coalesce(first_short["_last"], F.max("_last").over(after)).alias("_end"))


def _number(letters: Column, digits: str) -> Column:
    """Letters A, C, G, T, N and '.' as a number of two bits each."""
    return F.conv(F.translate(letters, "ACGTN.", digits), 4, 10).cast("long")


def _paired(context: int) -> tuple[Column, Column]:
    """(letters of GC in the left arm, mismatches) of arms of ``k`` letters around a loop of ``l``, by the bits of ``_before`` and ``_back``.

    C and G are the digits whose two bits differ, and letters pair with equal
    digits of the other direction. Arms with an N are for the caller to leave out.
    """
    arm = lambda name, behind: f"(shiftright({name}, cast(2 * ({behind}) as int)) & (shiftleft(1L, cast(2 * k as int)) - 1))"
    left, right = arm("_before", "k + l"), arm("_back", f"{context} - k")
    return F.expr(f"bit_count(({left} ^ shiftright({left}, 1)) & {LOW_BITS}L)"), F.expr(f"bit_count((({left} ^ {right}) | shiftright({left} ^ {right}, 1)) & {LOW_BITS}L)")


def raw_terminators(
    sequences: DataFrame,
    stem_min: int = 5,
    stem_max: int = 10,
    loop_min: int = 3,
    loop_max: int = 7,
    max_stem_mismatches: int = 1,
    min_poly_t: int = 5,
    gc_threshold: float = 0.7,
    keys=KEYS,
) -> DataFrame:
    """All hairpins that end where a run of T begins."""
    context = 2 * stem_max + loop_max
    rows = t_runs(sequences, min_poly_t, context, keys).filter(F.col("n") >= 2 * stem_min + loop_min + min_poly_t)
    shapes = [F.struct(F.lit(k).cast("long").alias("k"), F.lit(x).cast("long").alias("l")) for k in range(stem_min, stem_max + 1) for x in range(loop_min, loop_max + 1)]
    numbers = context <= DIGITS
    if numbers:
        rows = rows.withColumns({"_before": _number(F.col("before"), "012300"), "_back": _number(F.reverse("before"), "321000")})
    rows = rows.withColumn("shape", F.explode(F.array(*shapes))).select("*", "shape.k", "shape.l").drop("shape")
    cut = lambda start, length: F.substr(F.col("before"), (F.lit(context) - start + 1).cast("int"), length.cast("int"))
    k, loop = F.col("k"), F.col("l")
    rows = rows.filter(F.col("i") >= 2 * k + loop)
    left, right = cut(2 * k + loop, k), cut(k, k)
    rich, mm = _paired(context) if numbers else (dna.count_of(left, "GC"), dna.hamming_up_to(left, dna.reverse_complement(right), stem_max))
    rows = rows.withColumns({"gc": rich / k, "mm": mm.cast("long")}).filter((F.col("mm") <= max_stem_mismatches) & (F.col("gc") >= gc_threshold))
    rows = rows.withColumns({"left": left, "right": right}).filter(~F.concat("left", "right").contains("N"))
    score = k * 2.5 + F.col("gc") * 12.0 + F.col("run") * 3.0 - F.col("mm") * 4.0 - F.abs(loop - 4.5) * 0.8
    place = lambda f, a, b: f(F.col("strand"), a, b, F.col("n"))
    i = F.col("i")
    spans = {"stem_left": (i - 2 * k - loop, i - k - loop), "stem_right": (i - k, i), "poly_t": (i, i + F.col("run"))}
    ends = {f"{name}_{w}": place(f, a, b) for name, (a, b) in spans.items() for w, f in (("start", dna.forward_start), ("end", dna.forward_end))}
    return rows.select(
        *keys,
        "strand",
        *[e.alias(c) for c, e in ends.items()],
        F.col("left").alias("stem_left_seq"),
        cut(k + loop, loop).alias("loop_seq"),
        F.col("right").alias("stem_right_seq"),
        F.repeat(F.lit("T"), F.col("run").cast("int")).alias("poly_t_seq"),
        k.alias("stem_length"),
        loop.alias("loop_length"),
        F.col("mm").alias("mismatches"),
        F.bround("gc", 3).alias("gc_fraction"),
        F.col("run").alias("poly_t_length"),
        F.bround(score, 3).alias("score"),
        i.alias("i_t"),
    )


def terminators(sequences: DataFrame, keys=KEYS, **how) -> DataFrame:
    """Terminators without overlaps: the best of each stretch stays."""
    hits = raw_terminators(sequences, keys=keys, **how)
    hits = hits.withColumn("_a", F.least("stem_left_start", "poly_t_start")).withColumn("_b", F.greatest("stem_left_end", "poly_t_end"))
    best = [-F.col("score"), F.col("poly_t_start"), F.col("i_t"), F.col("stem_length"), F.col("loop_length")]
    return keep_best(hits, [*keys, "strand"], "_a", "_b", best).drop("_a", "_b", "i_t")


def order() -> list:
    return [
        F.desc("score"),
        F.desc("poly_t_length"),
        F.desc("stem_length"),
        F.asc("mismatches"),
        F.asc("loop_length"),
        F.when(F.col("strand") == "+", 0).otherwise(1),
        F.least("stem_left_start", "poly_t_start").asc(),
    ]
