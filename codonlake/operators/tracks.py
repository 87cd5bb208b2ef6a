"""Features as typed intervals, and the type shown at each position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .strands import KEYS

#: Which type wins where several cover a position, first to last (fixed values).
PRIORITY = ("startCodon", "shineDalgarno", "box35", "box10", "terminatorLeft", "terminatorRight", "polyT", "orf")
SPANS = {
    "coding_orfs": {"orf": ("start", "end")},
    "promoters": {"box35": ("box35_start", "box35_end"), "box10": ("box10_start", "box10_end")},
    "sd_sites": {"shineDalgarno": ("start", "end"), "startCodon": ("linked_start_position", "linked_start_position + 2")},
    "terminators": {"terminatorLeft": ("stem_left_start", "stem_left_end"), "terminatorRight": ("stem_right_start", "stem_right_end"), "polyT": ("poly_t_start", "poly_t_end")},
}


def tracks(rows: DataFrame, module: str, keys=KEYS) -> DataFrame:
    """(keys, strand, type, start, end): one to three intervals for each feature."""
    spans = F.array(*[F.struct(F.lit(t).alias("type"), F.expr(a).cast("long").alias("start"), F.expr(b).cast("long").alias("end")) for t, (a, b) in SPANS[module].items()])
    return rows.select(*keys, "strand", F.explode(spans).alias("x")).select(*keys, "strand", "x.*").filter("start IS NOT NULL AND end IS NOT NULL")


def visible(intervals: DataFrame, start: int, end: int) -> DataFrame:
    """Intervals that overlap the range [start, end]."""
    return intervals.filter((F.col("start") <= end) & (F.col("end") >= start))


def visible_in(ranges: DataFrame, intervals: DataFrame, width: int = 1_000, keys=KEYS) -> DataFrame:
    """(keys, range_id, strand, type, start, end, shown_start, shown_end): what overlaps each visible range.

    ``ranges`` are (keys, range_id, first, last), inclusive. Both sides meet in
    bins of ``width`` places, and each pair is kept in the first bin that both
    are in. Intervals may run either way; what is shown is clipped to the range.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(b / width)))
    a = ranges.filter("first <= last").select(*keys, "range_id", "first", "last", bins(F.col("first"), F.col("last")).alias("_bin"))
    placed = intervals.filter("start IS NOT NULL AND end IS NOT NULL").withColumns({"_low": F.least("start", "end"), "_high": F.greatest("start", "end")})
    b = placed.withColumn("_bin", bins(F.col("_low"), F.col("_high")))
    met = a.join(b, [*keys, "_bin"]).filter((F.col("_low") <= F.col("last")) & (F.col("_high") >= F.col("first")))
    met = met.filter(F.col("_bin") == F.floor(F.greatest("_low", "first") / width))
    return met.select(*keys, "range_id", "strand", "type", "start", "end", F.greatest("_low", "first").alias("shown_start"), F.least("_high", "last").alias("shown_end"))


def covered_positions(intervals: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, strand, position, type): the foremost type at every covered position.

    Types are those of PRIORITY. Places are the bits of numbers, one for each
    type and 64 places, so that intervals are put together before they are shuffled.
    """
    known = F.coalesce(F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("type")), F.lit(0)) > 0
    rows = intervals.filter("start <= end").withColumn("type", F.when(known, F.col("type")).otherwise(F.raise_error(F.concat(F.lit("unknown type: "), "type"))))
    rows = rows.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / 64), F.floor(F.col("end") / 64))))
    low, high = F.greatest(F.col("start") - F.col("_bin") * 64, F.lit(0)), F.least(F.col("end") - F.col("_bin") * 64, F.lit(63))
    rows = rows.withColumns({"_low": low.cast("int"), "_high": high.cast("int")})
    bits = F.expr("shiftleft(-1L, _low) & shiftrightunsigned(-1L, 63 - _high)")
    rows = rows.groupBy(*keys, "strand", "_bin").agg(*[F.bit_or(F.when(F.col("type") == t, bits).otherwise(F.lit(0).cast("long"))).alias(f"_{t}") for t in PRIORITY])
    rows = rows.withColumn("_at", F.explode(F.array(*map(F.lit, range(64)))))
    shown = F.coalesce(*[F.when(F.expr(f"shiftrightunsigned(`_{t}`, _at) & 1L") == 1, t) for t in PRIORITY])
    return rows.select(*keys, "strand", (F.col("_bin") * 64 + F.col("_at")).alias("position"), shown.alias("type")).filter("type IS NOT NULL")


def display_range(strand, start, end):
    """(from, to) as shown: '-' features run from their higher end."""
    return F.when(strand == "-", end).otherwise(start), F.when(strand == "-", start).otherwise(end)


def display_codon_range(strand, start):
    """A start codon as shown, by its lower place: "from-to", from the higher end on '-'; null without one."""
    low, high = start.cast("string"), (start + 2).cast("string")
    return F.when(strand == "-", F.concat(high, F.lit("-"), low)).otherwise(F.concat(low, F.lit("-"), high))
