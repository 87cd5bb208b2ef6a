"""The queries of the training-data operators and the SQL of those that have one."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import align_tokens, ann, bpe, chat, codes, decontam, jaccard, langid, packing, pii, slots, toxicity, warc
from .common import table


CONTROL = "\\### Assistant: </turn> ok"


def op1_chat_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL).alias("text"),
    )
    return chat.read_back(chat.format_windows(rows.unionByName(extra)))


def op2_pii_spans(spark, sf_dir):
    return pii.find_spans(table(spark, sf_dir, "documents"))


def op3_graph_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.filter("vec_id % 20 = 0"), 20)


def op4_virtual_slots(spark, sf_dir):
    placed, _ = slots.shard_documents(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op5_jaccard_components(spark, sf_dir):
    return jaccard.near_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op6_toxicity_chain(spark, sf_dir):
    scored = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.drop("text")


def op7_warc_revisits(spark, sf_dir):
    return warc.roundtrip(table(spark, sf_dir, "pages")).drop("url", "html")


def op8_benchmark_containment(spark, sf_dir):
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_packed_sequences(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_language_evidence(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op11_token_alignment(spark, sf_dir):
    return align_tokens.align(table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark, sf_dir):
    return codes.coded_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_chat_windows, op2_pii_spans, op3_graph_neighbours, op4_virtual_slots, op5_jaccard_components, op6_toxicity_chain, op7_warc_revisits, op8_benchmark_containment, op9_packed_sequences, op10_language_evidence, op11_token_alignment, op12_byte_bpe, op13_vector_codes)}

ORACLE_SQL = {
    "op5_jaccard_components": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS h
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM words)),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT doc_id AS a, doc_id AS r FROM documents UNION SELECT ways.b, reach.r FROM reach JOIN ways ON ways.a = reach.a)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
        FROM documents d JOIN (SELECT a, min(r) AS component_id FROM reach GROUP BY a) ON a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id""",
    "op8_benchmark_containment": """
        WITH words AS (
            SELECT kind, id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w
            FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark)),
        shingles AS (
            SELECT DISTINCT kind, id, array_to_string(w[i:i + 4], ' ') AS h
            FROM (SELECT kind, id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM words)),
        items AS (SELECT id AS item_id, h, count(*) OVER (PARTITION BY id) AS n FROM shingles WHERE kind = 'b')
        SELECT s.id AS doc_id, item_id, n AS n_item_shingles, count(*) AS n_shared, count(*) / n AS containment
        FROM shingles s JOIN items USING (h)
        WHERE kind = 'd'
        GROUP BY s.id, item_id, n
        HAVING 100 * count(*) >= 80 * n""",
    "op7_warc_revisits": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
            FROM pages),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
        FROM m""",
}
