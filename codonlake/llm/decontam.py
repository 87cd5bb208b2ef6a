"""Benchmark decontamination: short test items inside long documents.

Words are runs of letters and digits in lower case; a shingle is five words in
a row, hashed. An item is contained in a document when at least 80 % of its
different shingles are among the document's. Items are partitioned by size: a
class holds those whose number of shingles has the same bit length. Every item
keeps a bottom-k MinHash sketch just long enough for its size: an item of q
shingles that needs m of them can miss q - m, so that of its q - m + 1 smallest
hashes at least one is in every document that contains it. A document probes
each class that is not too large for it with its hashes up to the class's
largest sketched one; hits are candidates, which an exact count of shared
shingles confirms. Nothing is missed at any length. Where items are too many to
be broadcast, documents meet them over SALTS tasks a hash, as a shingle of
boilerplate can stand in a third of all documents.

Cases: null texts and items under five words have no shingles and match
nothing (``words`` below five finds short ones exactly, in a run of their own); rows of equal id count as one document or item, but ``drop_contaminated``
judges each row alone; no items or documents give no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, near, row_key, without

WORDS = 5
PERCENT = 80
BROADCAST_ROWS = 200_000
SALTS = 16


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of the word shingles of a text in order, repeats included."""
    split = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    one = F.transform(F.array(split), lambda w: F.when(F.size(w) >= words, F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(words)]))).otherwise(F.array().cast("array<bigint>")))
    return F.element_at(one, 1)


def item_shingles(items: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """(item_id, h, n, needed, size_class, sketched): the different shingles of every item."""
    rows = items.select(F.col("item_id").cast("long"), F.explode(shingle_hashes(F.col("text"), words)).alias("h")).distinct()
    by_item = W.partitionBy("item_id")
    rows = rows.withColumn("n", F.count("*").over(by_item)).withColumn("needed", F.expr(f"({percent} * n + 99) div 100"))
    rows = rows.withColumn("size_class", F.length(F.bin("n")))
    return rows.withColumn("sketched", F.row_number().over(by_item.orderBy("h")) <= F.col("n") - F.col("needed") + 1)


def _met(docs: DataFrame, key: str, items: DataFrame, on: list[str], n: int) -> DataFrame:
    """``docs`` joined with ``items``, which are broadcast up to BROADCAST_ROWS rows, else dealt over SALTS tasks a key."""
    if n <= BROADCAST_ROWS:
        return docs.join(F.broadcast(items), on)
    docs = docs.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    items = items.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return docs.join(items, [*on, "_salt"]).drop("_salt")


def _contained(texts: DataFrame, key: str, items: DataFrame, percent: int, words: int) -> DataFrame:
    """(key, item_id, n, n_shared); the rows of ``texts`` (key, text) of equal key count as one."""
    items = cut(item_shingles(items, percent, words), "item-shingles")
    classes = items.groupBy("size_class").agg(F.count("*").alias("rows"), F.min("needed").alias("least"), F.max(F.when(F.col("sketched"), F.col("h"))).alias("top")).collect()  # at most 64
    n = sum(c["rows"] for c in classes)

    hashes = texts.select(key, F.explode(F.array(shingle_hashes(F.col("text"), words))).alias("hs"))
    if key == "row":  # each text by itself: short ones don't meet large items
        enough = lambda c: F.size("hs") >= c["least"]
    else:  # texts of one id count together
        enough = lambda c: F.lit(True)
    probed = [F.when(enough(c), F.transform(F.filter("hs", lambda h: h <= F.lit(c["top"])), lambda h: F.struct(F.lit(c["size_class"]).alias("size_class"), h.alias("h")))) for c in classes]  # noqa: B023
    none = F.array().cast("array<struct<size_class:int,h:bigint>>")
    probes = hashes.select(key, F.explode(F.concat(none, *[F.coalesce(p, none) for p in probed])).alias("p")).select(key, "p.size_class", "p.h")
    sketch = items.filter("sketched").select("size_class", "h", "item_id")
    found = cut(_met(probes, key, sketch, ["size_class", "h"], n).select(key, "item_id").distinct(), "item-candidates")

    again = near(texts, found, key).select(key, F.explode(F.array_distinct(shingle_hashes(F.col("text"), words))).alias("h"))
    shared = _met(again, key, items.select("h", "item_id", "n", "needed"), ["h"], n)
    shared = shared.groupBy(key, "item_id", "n", "needed").agg(F.countDistinct("h").alias("n_shared")).filter("n_shared >= needed")
    pairs = found.select(F.col(key).alias("_key"), F.col("item_id").alias("_item"))
    held = shared.join(pairs, shared[key].eqNullSafe(pairs["_key"]) & (shared["item_id"] == pairs["_item"]), "left_semi")
    return held.select(key, "item_id", "n", "n_shared")


def contained_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment)."""
    held = _contained(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id", items, percent, words)
    return held.select("doc_id", "item_id", F.col("n").alias("n_item_shingles"), "n_shared", (F.col("n_shared") / F.col("n")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """``docs`` without the rows whose own text contains a benchmark item, whatever their ids."""
    hits = _contained(docs.select(row_key().alias("row"), "text"), "row", items, percent, words)
    return without(docs, cut(hits.select("row").distinct(), "contaminated"))
