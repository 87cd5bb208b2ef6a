"""Registered queries against their SQL: on the small tables where those are at hand, slow ones on 20 made documents."""

import random
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from codonlake import catalog

DATA = Path("/root/testdata/sf0.001")
SLOW = {"ranked_orfs", "best_ranked_orf", "confidence_buckets", "summary_counts", "kmer_jaccard_pairs", "orf_clusters", "cluster_alignments", "orf_sd_join", "highlights", "visible_tracks", "result_document", "stored_states"}
FAST = sorted(set(catalog.ORACLE_SQL) - SLOW)


def plain(rows, columns):
    return sorted(repr([r[c] for c in columns]) for r in rows)


def compare(spark, name, folder):
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    df = catalog.QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    cur = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    want = [dict(zip(names, r)) for r in cur.fetchall()]
    assert sorted(names) == columns
    assert plain(want, columns) == plain([r.asDict() for r in df.collect()], columns)
    return len(want)


@pytest.fixture(scope="module")
def few(tmp_path_factory):
    """20 documents of common words, some of them near copies with repeated parts, so that proteins are alike; one null, one empty."""
    rng = random.Random(20)
    words = [a + b for a in "the on er in at ed".split() for b in "and ing tion ly es".split()]
    texts = [" ".join(rng.choices(words, k=rng.randrange(40, 200))) for _ in range(13)]
    texts += [t.replace("ing", "ed", 1) + " " + t[:300] for t in texts[:5]] + [None, ""]
    folder = tmp_path_factory.mktemp("few")
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)}), folder / "documents.parquet")
    return folder


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_sql(spark, name):
    compare(spark, name, DATA)


@pytest.mark.parametrize("name", sorted(SLOW))
def test_slow_query_equals_its_sql_on_few_documents(spark, name, few):
    assert compare(spark, name, few) > 0


def test_every_query_has_its_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)
