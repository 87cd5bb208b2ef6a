"""Sharding by fixed virtual slots, in DataFrame operations only.

Records hash into a fixed number of virtual slots. Bytes and rows are added up
per slot, and a small versioned table maps slots to shards. Rebalancing or a
change of the shard count edits that table: every shard keeps its largest slots
up to the mean load, and what it gives up goes to the lightest shard.

Cases: a null text has no bytes (size 1); a null or repeated doc_id is hashed
with the text's checksum; equal rows are counted first and dealt over as many
slots as there are copies, so a row repeated often can be split; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

N_SLOTS = 4096
BLOCK = 4096


def hash_records(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """(vslot, doc_id, size, text_crc32, n, before): one row per different record and slot.

    Copy k of a record goes k slots on from its hash, round and round; ``n``
    counts its copies in the slot, ``before`` the records of the slot ahead.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    thin = docs.select(F.col("doc_id").cast("long"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    rows = thin.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("k", F.explode(F.expr(f"sequence(0L, least(copies, {n_slots}) - 1)")))
    rows = rows.withColumn("vslot", F.pmod(F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_slots)) + F.col("k"), F.lit(n_slots)).cast("int"))
    rows = rows.select("vslot", "doc_id", "size", "text_crc32", F.expr(f"(copies - k + {n_slots - 1}) div {n_slots}").alias("n"))
    ahead = W.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))


def slot_loads(spark: SparkSession, records: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """(vslot, bytes, rows) with a row for every slot, used or not."""
    loads = records.groupBy("vslot").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("rows"))
    every = spark.range(n_slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(loads, "vslot", "left").select("vslot", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("bytes", "rows")])


def first_map(loads: DataFrame, n_shards: int) -> DataFrame:
    """Version 0: slots dealt in turn, whatever they hold."""
    return loads.select(F.lit(0).alias("version"), "vslot", F.pmod("vslot", F.lit(n_shards)).cast("int").alias("shard"), "bytes", "rows")


def rebalance(slot_map: DataFrame, n_shards: int) -> DataFrame:
    """The next version of the map, for ``n_shards`` shards of near equal bytes.

    All steps work on the slot table, whose size is fixed; the fold over the
    given-up slots runs inside one SQL expression.
    """
    heavy = W.partitionBy("shard").orderBy(F.desc("bytes"), "vslot")
    marked = slot_map.withColumn("mean", F.sum("bytes").over(W.partitionBy("version")) / n_shards)
    marked = marked.withColumn("stays", (F.sum("bytes").over(heavy) <= F.col("mean")) & (F.col("shard") < n_shards))
    kept = F.sum(F.when(F.col("stays"), F.col("bytes")).otherwise(0))
    by_shard = marked.groupBy("shard").agg(kept.alias("kept"), F.collect_list(F.when(~F.col("stays"), F.struct("bytes", "vslot"))).alias("free"))
    one = by_shard.agg(
        F.map_from_entries(F.collect_list(F.struct("shard", "kept"))).alias("kept"),
        F.sort_array(F.flatten(F.collect_list("free")), asc=False).alias("free"),
    )
    moves = one.selectExpr(
        f"""explode(aggregate(
            free,
            named_struct('loads', transform(sequence(0, {n_shards - 1}), s -> coalesce(kept[s], 0L)),
                         'moves', filter(transform(free, f -> named_struct('vslot', f.vslot, 'to', 0)), m -> false)),
            (a, f) -> named_struct(
                'loads', transform(a.loads, (x, i) -> if(i = array_position(a.loads, array_min(a.loads)) - 1, x + f.bytes, x)),
                'moves', concat(a.moves, array(named_struct('vslot', f.vslot, 'to', cast(array_position(a.loads, array_min(a.loads)) - 1 as int))))),
            a -> a.moves)) AS move"""
    ).select("move.*")
    edited = slot_map.join(moves, "vslot", "left")
    return edited.select((F.col("version") + 1).alias("version"), "vslot", F.coalesce("to", "shard").cast("int").alias("shard"), "bytes", "rows")


def save_map(slot_map: DataFrame, path: str) -> None:
    """Keep a version of the map below ``path``; a version is written once."""
    version = slot_map.agg(F.max("version")).first()[0]
    slot_map.coalesce(1).write.parquet(f"{path.rstrip('/')}/v{version:09d}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The given version of a kept map, or its last."""
    kept = spark.read.parquet(f"{path.rstrip('/')}/v*")
    version = kept.agg(F.max("version")).first()[0] if version is None else version
    return spark.read.parquet(f"{path.rstrip('/')}/v{version:09d}")


def place(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """The hashed ``records`` in the shards of a map: doc_id, size, text_crc32, vslot, shard, slot.

    ``slot`` numbers the records of a shard without gaps, by virtual slot and then by record.
    """
    rows = records.groupBy("vslot").agg(F.sum("n").alias("n_rows"))
    ahead = W.partitionBy("shard").orderBy("vslot").rowsBetween(W.unboundedPreceding, -1)
    starts = slot_map.join(rows, "vslot", "left").select("vslot", "shard", F.coalesce(F.sum("n_rows").over(ahead), F.lit(0)).alias("start"))
    placed = records.join(F.broadcast(starts), "vslot")  # n_slots rows
    placed = placed.withColumn("block", F.explode(F.expr(f"sequence(0L, (n - 1) div {BLOCK})")))
    placed = placed.withColumn("k", F.explode(F.expr(f"sequence(block * {BLOCK}, least(n, (block + 1) * {BLOCK}) - 1)")))
    return placed.select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("start") + F.col("before") + F.col("k")).alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, map_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(placed records, slot map with the versions it went through); stored.

    With ``map_path`` the map is kept there: a first run makes and keeps its
    versions 0 and 1, a later one loads the last, counts the slots of its own
    documents, and keeps the version it has edited from it. A kept map's own
    number of slots holds, whatever ``n_slots`` is.
    """
    spark = docs.sparkSession
    kept = load_map(spark, map_path).select("version", "vslot", "shard") if map_path and _kept(spark, map_path) else None
    n_slots = n_slots if kept is None else kept.count()
    records = cut(hash_records(docs, n_slots), "slot-records")
    loads = slot_loads(spark, records, n_slots)
    base = first_map(loads, n_shards) if kept is None else kept.join(loads, "vslot").select("version", "vslot", "shard", "bytes", "rows")
    base = cut(base, "slot-map-before")
    current = cut(rebalance(base, n_shards), "slot-map")
    if map_path:
        for version in (base, current) if kept is None else (current,):
            save_map(version, map_path)
    return place(records, current), base.unionByName(current)


def _kept(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
