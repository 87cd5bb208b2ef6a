"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the threads. ``nt_per_s`` is the DNA
scanned per second (one strand counted) by each detector. ``genome`` is the
complete analysis of one sequence of GENOME_NT letters made of the same DNA.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from codonlake import catalog
from codonlake.plans.analysis import Analysis
from codonlake.plans.derived import sequences
from codonlake.sources import scratch

HEADLINE = ("coding_orfs_longest", "promoter_hits", "sd_sites", "terminator_hits", "chunked_promoters", "orf_promoter_range_join", "ranked_orfs")

GENOME_NT = 5_000_000


def genome(spark: SparkSession, sf_dir: str):
    """(seq_id, seq): one sequence, the DNA of the first documents, as long as there is."""
    rows = sequences(spark, sf_dir).select("seq_id", "seq", F.sum(F.length("seq")).over(Window.orderBy("seq_id")).alias("upto"))
    some = rows.filter(F.col("upto") - F.length("seq") < GENOME_NT)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq_id", "seq"))), lambda x: x["seq"]), "")
    return some.agg(F.substring(joined, 1, GENOME_NT).alias("seq")).select(F.lit(1).cast("long").alias("seq_id"), "seq")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(4 * int(cpus)))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    nt = sequences(spark, sf_dir).agg(F.sum(F.length("seq"))).first()[0]
    took = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    path = scratch.fresh(spark, "genome")
    genome(spark, sf_dir).write.parquet(path)
    one = spark.read.parquet(path)
    length, start = one.select(F.length("seq")).first()[0], time.time()
    Analysis(one).ranked_coding_orfs().write.format("noop").mode("overwrite").save()
    whole = {"nt": length, "seconds": round(time.time() - start, 3)}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "nt": nt, "nt_per_s": {k: round(nt / v) for k, v in took.items()}, "genome": whole}))


if __name__ == "__main__":
    main()
