"""Ranks within a key, also where one key has most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import stored

HOT_ROWS = 200_000


def with_rank(rows: DataFrame, keys, order: list, name: str = "rank", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` with their 1-based rank by ``order`` within ``keys``; ``order`` must be total.

    ``rows`` are stored when this is called. Keys of up to ``hot_rows`` rows are
    ranked by a window. Rows of the others are dealt out by ranges of key and
    order; a row's rank is its rank in its range plus the rows in the ranges
    before, so that one key is work for many tasks.
    """
    keys = list(keys)
    rows = stored(rows, "ranked")
    hot = rows.groupBy(*keys).count().filter(F.col("count") > hot_rows).select(*[F.col(c).alias(f"_h{k}") for k, c in enumerate(keys)])
    plain = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    if hot.isEmpty():
        return rows.withColumn(name, plain)
    same = [F.col(c).eqNullSafe(F.col(f"_h{k}")) for k, c in enumerate(keys)]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.join(hot, same, "left_semi").repartitionByRange(tasks, *keys, *order).withColumn("_range", F.spark_partition_id()), "dealt")
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sizes = dealt.groupBy(*keys, "_range").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    sizes = sizes.select(*[F.col(c).alias(f"_h{k}") for k, c in enumerate(keys)], F.col("_range").alias("_r"), "_before")
    inner = F.row_number().over(W.partitionBy(*keys, "_range").orderBy(*order))
    there = dealt.withColumn("_inner", inner).join(F.broadcast(sizes), [*same, F.col("_range") == F.col("_r")])  # a row for each range, and one more for each key
    there = there.withColumn(name, (F.col("_inner") + F.col("_before")).cast("int")).select(*rows.columns, name)
    return rows.join(hot, same, "left_anti").withColumn(name, plain).unionByName(there)
