"""Greedy non-maximum suppression over intervals.

Decisions never cross a gap that no interval covers, so intervals are cut into
islands, block by block of positions: Spark deals blocks out over tasks and
sorts them, and a task reads its rows in that order, a batch at a time. The
small islands of a batch are decided together, each step keeping the best of
every island that is left; others by a look-up among the intervals kept. An
interval that reaches over a block's end is also shown to the blocks that it
reaches. Islands that reach over a block's end, or that are reached from a
block before, are read again, without blocks. Those that have very many
intervals go by rounds: what is better than all that overlaps it stays, what
overlaps something that stays goes, until nothing is left. All give what a
greedy pass gives.

A round is a join by bins as wide as the longest interval. Random preferences
take a few rounds; intervals that are each a little worse than their
predecessor take a round for every two of them.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType

from ..sources.scratch import stored

BLOCK = 1 << 16
#: Islands of so many intervals are decided by one task, of so many together with others.
ISLAND, SMALL = 100_000, 100


def keep_best(hits: DataFrame, within: list[str], start: str, end: str, order: list, block: int = BLOCK, most: int = ISLAND) -> DataFrame:
    """Rows of ``hits`` kept when taken by ``order``, each if it overlaps none kept before.

    Intervals are inclusive; ``order`` are numbers, and total within a group of
    ``within``. What is kept is stored when this is called.
    """
    names = [f"_k{i}" for i in range(len(order))]
    rows = hits.withColumns({c: o for c, o in zip(names, order)})
    held = StructType(rows.schema.fields).add("_hard", BooleanType())
    first = F.floor(F.col(start) / block)
    rows = rows.withColumn("_block", F.explode(F.sequence(first, F.floor(F.col(end) / block)))).withColumn("_own", F.col("_block") == first)
    place = [*within, "_block"]
    rows = rows.repartition(*place).sortWithinPartitions(*place, start, end)
    rows = stored(rows.mapInArrow(_decided(place, start, end, names, block, most, held.names), held), "islands")
    easy, hard = rows.filter("NOT _hard"), rows.filter("_hard")
    if hard.isEmpty():
        return easy.select(hits.columns)
    whole = hard.drop("_hard").withColumns({"_block": F.lit(0).cast("long"), "_own": F.lit(True)})
    whole = whole.repartition(*within).sortWithinPartitions(*within, start, end)
    whole = stored(whole.mapInArrow(_decided(within, start, end, names, 1 << 62, most, held.names), held), "islands")
    easy, hard = easy.unionByName(whole.filter("NOT _hard")).select(hits.columns), whole.filter("_hard").drop("_hard")
    return easy if hard.isEmpty() else easy.unionByName(_by_rounds(hard, within, start, end, names).select(hits.columns))


def _decided(place: list[str], start: str, end: str, names: list[str], block: int, most: int, out: list[str]):
    """Sorted rows to those kept, and, marked as hard, to all rows of the islands that are left to rounds."""

    def changes(column: pa.Array) -> np.ndarray:
        a, b = column[1:], column[:-1]
        return pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)

    def numbers(rows: pa.RecordBatch, name: str) -> np.ndarray:
        return rows.column(name).to_numpy(zero_copy_only=False)

    def greedy(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[int]:
        """What a greedy pass keeps of one island, best rows first."""
        out, starts, ends = [], [], []
        for row, first, last in zip(rows.tolist(), a[rows].tolist(), b[rows].tolist()):
            k = bisect_right(starts, last)
            if not k or ends[k - 1] < first:  # what is kept is in order by its starts and by its ends
                starts.insert(k, first)
                ends.insert(k, last)
                out.append(row)
        return out

    def kept(island: np.ndarray, keys: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        left, best = np.lexsort([*keys[::-1], island]), [np.zeros(0, np.int64)]
        if len(left):
            small = (np.bincount(island) <= SMALL)[island]
            large = left[~small[left]]
            left = left[small[left]]
            best += [np.array(greedy(rows, a, b)) for rows in np.split(large, np.flatnonzero(np.diff(island[large])) + 1) if len(rows)]
        while len(left):
            lead = np.append(True, island[left[1:]] != island[left[:-1]])
            best.append(left[lead])
            by = best[-1][np.cumsum(lead) - 1]
            left = left[~(lead | (a[left] <= b[by]) & (a[by] <= b[left]))]
        return np.concatenate(best)

    def decided(batches):
        open_ = None  # rows of the island that the next batch may go on with

        def emit(rows, index, hard):
            some = rows.take(pa.array(index))
            return pa.RecordBatch.from_arrays([*[some.column(c) for c in out[:-1]], pa.array(np.full(len(index), hard))], out)

        def islands(rows, last):
            nonlocal open_
            a, b, own, at = numbers(rows, start), numbers(rows, end), numbers(rows, "_own"), numbers(rows, "_block")
            group = np.append(0, np.cumsum(reduce(np.logical_or, [changes(rows.column(c)) for c in place])))
            apart = group * (int(b.max()) - int(a.min()) + 2)
            reach = np.maximum.accumulate(b + apart)
            firsts = np.flatnonzero(np.append(True, (a + apart)[1:] > reach[:-1]))
            sizes = np.diff(np.append(firsts, len(a)))
            hard = (sizes > most) | (np.maximum.reduceat(b, firsts) >= (at[firsts] + 1) * block) | ~np.logical_and.reduceat(own, firsts)
            done = len(a)
            if not last:
                begin = firsts[-1]
                if sizes[-1] <= most:
                    done, open_ = begin, rows.slice(begin)
                else:  # what is known of a long island is that it is hard and how far it reaches
                    ghost = {c: rows.column(c).slice(len(a) - 1) for c in rows.schema.names}
                    ghost |= {end: pa.array([int(b[begin:].max())], rows.schema.field(end).type), "_own": pa.array([False])}
                    open_ = pa.RecordBatch.from_arrays(list(ghost.values()), schema=rows.schema)
            island = np.repeat(np.arange(len(firsts)), sizes)[:done]
            to_rounds = hard[island] & own[:done]
            yield emit(rows, np.flatnonzero(to_rounds), True)
            easy = np.flatnonzero(~hard[island])
            yield emit(rows, easy[kept(island[easy], [numbers(rows, c)[easy] for c in names], a[easy], b[easy])], False)

        for batch in batches:
            if len(batch):
                rows = batch if open_ is None else pa.Table.from_batches([open_.cast(batch.schema), batch]).combine_chunks().to_batches()[0]
                open_ = None
                yield from islands(rows, False)
        if open_ is not None:
            yield from islands(open_, True)

    return decided


def _by_rounds(rows: DataFrame, within: list[str], start: str, end: str, names: list[str]) -> DataFrame:
    """The same decisions by rounds of local maxima; of equal intervals only the best takes part."""
    best = F.min_by(F.struct(*rows.columns), F.struct(*names))
    live = stored(rows.groupBy(*within, start, end).agg(best.alias("_r")).select("_r.*"), "live")
    width = live.agg(F.max(F.col(end) - F.col(start)) + 1).first()[0]
    kept, empty = [], live.limit(0)

    def near(a: DataFrame, b: DataFrame, better: bool, how: str) -> DataFrame:
        """Rows of ``a`` that overlap (or do not, by ``how``) a row of ``b``, a better one if so asked."""
        first, last = F.floor((F.col(start) - width + 1) / width), F.floor(F.col(end) / width)
        other = b.select(*[F.col(c).alias(f"_o{k}") for k, c in enumerate(within)], F.col(start).alias("_s"), F.col(end).alias("_e"), F.struct(*names).alias("_o"), F.explode(F.sequence(first, last)).alias("_bin"))
        on = [F.col(c).eqNullSafe(F.col(f"_o{k}")) for k, c in enumerate(within)]
        on += [F.floor(F.col(start) / width) == F.col("_bin"), F.col(start) <= F.col("_e"), F.col("_s") <= F.col(end)]
        return a.join(other, [*on, F.col("_o") < F.struct(*names)] if better else on, how)

    while not live.isEmpty():
        stay = stored(near(live, live, True, "left_anti"), "stay")
        kept.append(stay)
        live = stored(near(live, stay, False, "left_anti"), "live")
    return reduce(DataFrame.unionByName, kept, empty)
