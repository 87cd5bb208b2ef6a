"""Language identification by Bayesian fusion of evidence.

Text likelihoods come from byte-trigram counts of labelled documents, summed
over all of them. Four further kinds of evidence join them in log odds: the
language that the markup declares, the ending of the host name, a language tag
that opens the path, and the host. How far a declared language, an ending or a
tag can be trusted is counted from the text posteriors of all rows that carry
it. Host priors are smoothed by their domain and that by the whole, all by
grouped sums; a row's own text is taken out of all sums that it is judged by.

Letter groups of a text are not independent: their mean log likelihood counts
as that of at most TEXT_GRAMS of them, each with TEXT_WEIGHT. The model has the
``most_languages`` languages with most labelled documents.

Hosts with more than a ten-thousandth of all rows (at most ten thousand of
them) are broadcast, the others meet their rows in a shuffle.

Cases: missing evidence of any kind says nothing; a null or empty text leaves
the prior; rows without an id are kept; repeated rows get equal results; ties
go to the first language in alphabetical order; without labelled documents the
language is null; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_ROWS, cut

BUCKETS = 1 << 16
TEXT_GRAMS = 400
TEXT_WEIGHT = 0.25
SMOOTH = 20.0
HOT_SHARE = 10_000
MOST_LANGUAGES = 200

_TAG = re.compile(rb"<[^<>]*>")


def visible(html: bytes) -> bytes:
    """Text of a page without scripts, styles and tags; linear in its length."""
    for name in (b"script", b"style"):
        low, out, at = html.lower(), [], 0
        while (start := low.find(b"<" + name, at)) >= 0:
            out.append(html[at:start])
            end = low.find(b"</" + name, start)
            at = len(html) if end < 0 else end
        html = b" ".join([*out, html[at:]])
    return _TAG.sub(b" ", html)


def grams(text: bytes) -> np.ndarray:
    b = np.frombuffer(text.lower(), np.uint8).astype(np.uint32)
    return ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64) if len(b) > 2 else np.empty(0, np.int64)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all labelled documents; at most BUCKETS rows a language."""

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if lang not in held:
                    held[lang] = np.zeros(BUCKETS, np.int64)
                held[lang] += np.bincount(grams(text), minlength=BUCKETS)
        for lang, n in held.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some), pa.array(n[some])], ["lang", "bucket", "n"])

    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, most_languages: int = MOST_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """(languages, log probability of every bucket in each): BUCKETS x ``most_languages`` numbers at most."""
    often = docs.filter("lang IS NOT NULL AND text IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    rows = gram_counts(docs).join(F.broadcast(often.select("lang")), "lang").toArrow().to_pydict()
    langs = sorted(set(rows["lang"]))
    counts = np.full((BUCKETS, len(langs)), 0.5)
    np.add.at(counts, (np.array(rows["bucket"], np.int64), np.searchsorted(langs, rows["lang"]) if langs else []), rows["n"])
    return langs, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def page_rows(pages: DataFrame) -> DataFrame:
    host = F.nullif(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1)), F.lit(""))
    part = lambda text, pattern: F.nullif(F.lower(F.regexp_extract(text, pattern, 1)), F.lit(""))
    return pages.select(
        F.lit(None).cast("long").alias("doc_id"),
        F.col("page_id").cast("long"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("text"),
        host.alias("host"),
        part(host, r"([^.]+\.[^.]+)$").alias("domain"),
        part(host, r"\.([^.]+)$").alias("suffix"),
        part("url", r"://[^/]*/([A-Za-z]{2})(?:/|$)").alias("tag"),
        part("html", r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']?([a-z]{2,3})").alias("declared"),
    )


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents as rows of the same kind: their source stands for a host, other evidence is missing."""
    none = F.lit(None).cast("string")
    source = F.concat(F.lit("source:"), F.col("source"))
    return docs.select(
        F.col("doc_id").cast("long"),
        F.lit(None).cast("long").alias("page_id"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
        source.alias("host"),
        F.when(source.isNotNull(), F.lit("source:")).alias("domain"),
        *[none.alias(c) for c in ("suffix", "tag", "declared")],
    )


def _scored(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """``rows`` with ``t``, the weighed text log likelihoods, and ``q``, the text posterior, for text."""
    kept = [c for c in rows.columns if c != "text"]

    def over(batches):
        for batch in batches:
            t = np.zeros((batch.num_rows, weights.shape[1]))
            pages = batch.column("page_id").is_valid().to_pylist()
            for i, text in enumerate(batch.column("text").to_pylist()):
                g = grams(visible(text) if pages[i] else text)
                if len(g):
                    t[i] = weights[g].mean(axis=0, dtype=np.float64) * min(len(g), TEXT_GRAMS) * TEXT_WEIGHT
            t -= t.max(axis=1, keepdims=True)
            q = np.exp(t)
            q /= q.sum(axis=1, keepdims=True)
            lists = [pa.array(x.tolist(), pa.list_(pa.float64())) for x in (t, q)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *lists], [*kept, "t", "q"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(over, f"{schema}, t array<double>, q array<double>")


def _sums(n: int):
    return F.array(*[F.sum(F.col("q")[k]) for k in range(n)])


def _trust(rows: DataFrame, kind: str, total: list[float]) -> DataFrame:
    """(kind, s_kind, m_kind): the summed text posteriors and the number of the rows with each value of a kind of evidence."""
    by = rows.filter(F.col(kind).isNotNull()).groupBy(kind).agg(_sums(len(total)).alias(f"s_{kind}"), F.count("*").alias(f"m_{kind}"))
    return cut(by, f"trust-{kind}")


def _joined(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """Left join; a small side, counted first, is broadcast. Rows without a key, often most of them, are not shuffled by it."""
    if side.count() <= SMALL_ROWS:
        return rows.join(F.broadcast(side), key, "left")
    known = rows.filter(F.col(key).isNotNull()).join(side, key, "left")
    return known.unionByName(rows.filter(F.col(key).isNull()), allowMissingColumns=True)


def _log_ratio(kind: str, k: int, total: list[float]):
    """log P(value | language k) of a row's evidence, counted without the row; 0 where it has none."""
    own = F.col("q")[k]
    share = (F.col(f"m_{kind}") - 1) / F.lit(sum(total))
    ratio = F.log((F.greatest(F.col(f"s_{kind}")[k] - own, F.lit(0.0)) + SMOOTH * share + 1e-9) / (F.greatest(F.lit(total[k]) - own, F.lit(0.0)) + SMOOTH))
    return F.when(F.col(f"m_{kind}") > 1, ratio).otherwise(0.0)


def _with_prior(rows: DataFrame, total: list[float]) -> DataFrame:
    """``rows`` with ``prior``, the smoothed language shares of their host."""
    n, every = len(total), sum(total)
    whole = F.array(*[F.lit(x / every) for x in total])
    domains = rows.filter("host IS NOT NULL").groupBy("domain").agg(_sums(n).alias("ds"), F.count("*").alias("dm"))
    hosts = rows.filter("host IS NOT NULL").groupBy("host").agg(F.first("domain").alias("domain"), _sums(n).alias("s"), F.count("*").alias("m"))
    hosts = hosts.join(domains, hosts["domain"].eqNullSafe(domains["domain"]), "left")
    hosts = cut(hosts.select("host", "s", "m", "ds", "dm"), "hosts")
    hot = F.broadcast(hosts.filter(F.col("m") > every / HOT_SHARE))  # at most HOT_SHARE rows
    known = rows.filter("host IS NOT NULL")
    both = known.join(hot, "host").unionByName(known.join(hot, "host", "left_anti").join(hosts, "host"))
    back = [(F.col("ds")[k] - F.col("q")[k] + SMOOTH * whole[k]) / (F.col("dm") - 1 + SMOOTH) for k in range(n)]
    own = F.array(*[(F.col("s")[k] - F.col("q")[k] + SMOOTH * back[k]) / (F.col("m") - 1 + SMOOTH) for k in range(n)])
    both = both.withColumn("prior", own).drop("s", "m", "ds", "dm")
    return both.unionByName(rows.filter("host IS NULL").withColumn("prior", whole))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, page_id, lang, p, text_lang, declared, host) of every page and document.

    ``docs`` with a ``lang`` also train the text model.
    """
    langs, weights = train(docs)
    rows = page_rows(pages).unionByName(document_rows(docs))
    if not langs:
        none = F.lit(None).cast("string")
        return rows.select("doc_id", "page_id", none.alias("lang"), F.lit(None).cast("double").alias("p"), none.alias("text_lang"), "declared", "host")
    n = len(langs)
    rows = cut(_scored(rows, weights), "text-posteriors")
    total = [x if x is not None else 0.0 for x in rows.agg(_sums(n).alias("s")).first()["s"]]
    if not sum(total):
        total = [1.0] * n
    out = _with_prior(rows, total)
    kinds = ("declared", "suffix", "tag")
    for kind in kinds:
        out = _joined(out, _trust(rows, kind, total), kind)
    says = lambda k: sum((_log_ratio(kind, k, total) for kind in kinds), F.log(F.greatest(F.col("prior")[k], F.lit(1e-9))) + F.col("t")[k])
    out = out.withColumn("z", F.array(*[says(k) for k in range(n)])).withColumn("top", F.array_max("z"))
    names = F.array(*map(F.lit, langs))
    p = 1 / F.aggregate("z", F.lit(0.0), lambda a, z: a + F.exp(z - F.col("top")))
    pick = lambda x: F.element_at(names, F.array_position(x, F.array_max(x)).cast("int"))
    return out.select("doc_id", "page_id", pick(F.col("z")).alias("lang"), p.alias("p"), pick(F.col("q")).alias("text_lang"), "declared", "host")
