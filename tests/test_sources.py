import json
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from codonlake.operators import orfs
from codonlake.plans import stored_run
from codonlake.sources import eventlog, fasta, results
from codonlake.streaming.fasta import fasta_stream, store_features


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nACGT\nacg\n>two\nTTTT\n")
    (tmp_path / "b.FASTA").write_text(">three\nGGGG\n")
    (tmp_path / "c.csv").write_text(">no\nAAAA\n")
    rows = fasta.read_fasta(spark, str(tmp_path)).collect()
    assert sorted((r["file"], r["header"], r["sequence"]) for r in rows) == [("a.fa", "one", "ACGTACG"), ("a.fa", "two", "TTTT"), ("b.FASTA", "three", "GGGG")]
    assert sorted(r["header"] for r in fasta.first_records(fasta.read_fasta(spark, str(tmp_path))).collect()) == ["one", "three"]
    assert sorted(r["sequence"] for r in fasta.read_joined(spark, str(tmp_path)).collect()) == ["ACGTACGTTTT", "GGGG"]
    with pytest.raises(Exception, match="Invalid DNA"):
        bad = spark.createDataFrame([("x", "ACGX")], "header string, sequence string")
        fasta.as_sequences(bad).collect()


def test_fasta_records_begin_at_line_starts_only(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 length>500 a\nACGT>\n\nACGT\r\n>s2\tx\r\nTT\n>\nGG\n>s4")
    (tmp_path / "b.fna").write_text("; a note\nACGT\n>s5\nCC\n")
    (tmp_path / "c.txt").write_text("no record here\n")
    got = [(r["file"], r["header"], r["sequence"]) for r in fasta.in_order(fasta.read_fasta(spark, str(tmp_path))).collect()]
    assert got == [("a.fa", "s1", "ACGT>ACGT"), ("a.fa", "s2", "TT"), ("a.fa", "", "GG"), ("a.fa", "s4", ""), ("b.fna", "s5", "CC")]
    assert [r["path"].rpartition("/")[2] for r in fasta.without_records(spark, str(tmp_path)).collect()] == ["c.txt"]
    with pytest.raises(ValueError, match="No FASTA record found in file: .*c.txt"):
        fasta.require_records(spark, str(tmp_path))
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.csv").write_text(">a\nA\n")
    with pytest.raises(ValueError, match="No FASTA files"):
        fasta.read_fasta(spark, str(tmp_path / "d"))
    with pytest.raises(Exception, match="(?i)path.*not.*exist"):
        fasta.read_fasta(spark, str(tmp_path / "nowhere")).count()


def test_fasta_of_many_splits(spark, tmp_path):
    lines = [f">r{k} a>b >c\n" + "ACGT" * (k % 50) + "\n" + "GG\n" for k in range(3000)]
    (tmp_path / "a.fa").write_text("".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        got = fasta.in_order(fasta.read_fasta(spark, str(tmp_path))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["header"], r["sequence"]) for r in got] == [(f"r{k}", "ACGT" * (k % 50) + "GG") for k in range(3000)]


def test_chunks_of_results_and_states(spark, tmp_path):
    store = results.ResultStore(spark, str(tmp_path))
    rows = spark.range(10).withColumnRenamed("id", "start")
    for k in (0, 1):
        store.replace("a/b=c", "sd", rows, kind="chunk", chunk_index=k)
    store.replace("a/b=c", "sd", rows.limit(4), kind="chunk", chunk_index=1)
    got = store.rows("a/b=c", "sd", "chunk").groupBy("chunk_index").count().collect()
    assert sorted(map(tuple, got)) == [(0, 10), (1, 4)]
    store.replace("a/b=c", "sd", rows.limit(2), kind="chunk")
    assert [tuple(r) for r in store.rows("a/b=c", "sd", "chunk").groupBy("chunk_index").count().collect()] == [(None, 2)]
    run = store.create(500, "all", {"min_aa": "30"})
    store.set_module_status(run, "promoters", "done")
    store.append_error(run, "terminators", "one")
    store.append_error(run, "terminators", "two")
    store.set_summary(run, {"promoters": 3})
    store.set_status(run, "failed")
    store.set_status("unknown", "failed")
    state = store.get(run)
    assert (state["status"], state["modules"]["promoters"], state["modules"]["ranking"], state["summary"]) == ("failed", "done", "pending", {"promoters": 3})
    assert [e["message"] for e in state["errors"]] == ["one", "two"] and state["sequence_length"] == 500
    assert store.get("unknown") is None and store.analyses().count() == 1


def test_requests(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"mode": "folder", "files": [{"sequence": "acgt"}, {"name": "n", "sequence": "TT"}]}))
    assert sorted(tuple(r) for r in fasta.read_requests(spark, str(tmp_path / "r.json")).collect()) == [("n", None, "TT"), ("unknown", None, "ACGT")]


def test_store_and_pages(spark, tmp_path):
    store = results.ResultStore(spark, str(tmp_path / "store"))
    rows = spark.range(30).withColumnRenamed("id", "start")
    store.replace("a", "promoters", rows)
    store.replace("b", "promoters", rows.limit(3))
    store.replace("a", "promoters", rows.limit(25))
    assert store.count("a", "promoters") == 25 and store.count("b", "promoters") == 3
    page = store.page("a", "promoters", limit=5, skip=2, sort_field="start", sort_direction="desc")
    assert [r["start"] for r in page.collect()] == [22, 21, 20, 19, 18]
    store.replace("a", "promoters", rows.limit(0))
    assert store.count("a", "promoters") == 0 and store.rows("a", "promoters").columns == store.rows("b", "promoters").columns
    assert store.count("b", "promoters") == 3 and store.count("none", "promoters") == 0
    assert results.page_limit(0) == 20 and results.page_limit(999) == 200 and results.page_numbers(5, 20) == [1, None, 3, 4, 5, 6, 7, None, 20]
    with pytest.raises(ValueError):
        results.module_name("nothing")


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.fa").write_text(">s x>y\nATG" + "GCA" * 40 + "TAA\n>bad\nACGX\n")
    store = results.ResultStore(spark, str(tmp_path / "out"))
    q = store_features(fasta_stream(spark, str(folder)), lambda b: orfs.coding_orfs(b, 30), store, "coding_orfs", str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert store.rows("batch-0", "coding_orfs").first()["peptide_length_aa"] == 41
    assert [(r["seq_id"], r["file"], r["reason"]) for r in store.rows("batch-0", "rejected", "rejected").collect()] == [("bad", "a.fa", "Invalid DNA characters found: X")]


@pytest.mark.parametrize(
    ("current", "pages", "shown", "numbers"),
    [
        (1, 5, 7, [1, 2, 3, 4, 5]),
        (1, 7, 7, [1, 2, 3, 4, 5, 6, 7]),
        (1, 20, 7, [1, 2, 3, 4, 5, 6, None, 20]),
        (4, 20, 7, [1, 2, 3, 4, 5, 6, None, 20]),
        (16, 20, 7, [1, None, 14, 15, 16, 17, 18, None, 20]),
        (17, 20, 7, [1, None, 15, 16, 17, 18, 19, 20]),
        (20, 20, 7, [1, None, 15, 16, 17, 18, 19, 20]),
        (4, 8, 7, [1, 2, 3, 4, 5, 6, None, 8]),
        (10, 20, 8, [1, None, 8, 9, 10, 11, 12, None, 20]),
        (1, 20, 8, [1, 2, 3, 4, 5, 6, 7, None, 20]),
        (20, 20, 8, [1, None, 14, 15, 16, 17, 18, 19, 20]),
        (1, 0, 7, []),
    ],
)
def test_page_numbers(current, pages, shown, numbers):
    assert results.page_numbers(current, pages, shown) == numbers


def test_unwritten_modules_are_empty(spark, tmp_path):
    store = results.ResultStore(spark, str(tmp_path))
    assert store.count("a", "promoters") == 0 and store.rows("a", "promoters").collect() == [] and store.page("a", "promoters", sort_field="score").collect() == []
    assert store.analyses().collect() == [] and store.get("a") is None


def test_old_rows_stay_until_the_new_ones_are_named(spark, tmp_path, monkeypatch):
    store = results.ResultStore(spark, str(tmp_path))
    rows = spark.range(5).withColumnRenamed("id", "start")
    store.replace("a", "sd", rows, sort="start", files=2)
    before = store.rows("a", "sd")
    with monkeypatch.context() as m:
        m.setattr(eventlog.EventLog, "append", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            store.replace("a", "sd", rows.limit(1), sort="start", files=2)
    assert sorted(r["start"] for r in store.rows("a", "sd").collect()) == [0, 1, 2, 3, 4]
    with monkeypatch.context() as m:
        m.setattr(eventlog.Files, "publish", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            store.replace("a", "sd", rows.limit(2))
    store.replace("a", "sd", rows.limit(3))
    assert store.count("a", "sd") == store.rows("a", "sd").count() == 3 and before.count() == 5
    assert store.clean("a", "sd") == 0 and store.clean("a", "sd", older_than=0) == 5
    assert store.rows("a", "sd").count() == 3
    names = {p.name.split("-")[0] for p in (tmp_path / "shine_dalgarno/analysis_id=a/kind=final").iterdir()}
    assert names == {"log", "data"}


def test_parallel_changes_are_not_lost(spark, tmp_path):
    store = results.ResultStore(spark, str(tmp_path))
    run = store.create(7, "all", {"min_aa": 30})
    with ThreadPoolExecutor(20) as pool:
        list(pool.map(lambda k: store.append_error(run, f"m{k}", f"error {k}"), range(20)))
        list(pool.map(lambda m: store.set_module_status(run, m, "done"), results.PARTS))
    store.set_module_status(run, "ranking", "failed")

    def check():
        state = store.get(run)
        assert sorted(e["module"] for e in state["errors"]) == sorted(f"m{k}" for k in range(20))
        assert state["modules"] == dict.fromkeys(results.PARTS, "done") | {"ranking": "failed"} and state["parameters"] == {"min_aa": "30"}
        row = store.analyses().first().asDict(recursive=True)
        assert [e["message"] for e in row["errors"]] == [e["message"] for e in state["errors"]]
        assert (row["modules"], row["status"], row["sequence_length"], row["summary"]) == (state["modules"], "running", 7, {})

    check()
    log = store._log(run)
    assert len(log.files.names(log.path)) == 28
    store.compact(run)
    assert len(log.files.names(log.path)) == 1
    check()
    store.append_error(run, "m20", "later")
    assert len(store.get(run)["errors"]) == 21


def test_a_page_reads_few_files(spark, tmp_path):
    store = results.ResultStore(spark, str(tmp_path))
    rows = spark.range(20_000).select(((F.col("id") * 7919) % 4001).alias("score"), F.col("id").alias("start"))
    rows = rows.withColumn("score", F.when(F.col("score") >= 20, F.col("score")))
    assert store.replace("a", "promoters", rows, sort="score", files=50) == 20_000
    plain = [tuple(r) for r in rows.select("score", "start").collect()]
    assert len(store.rows("a", "promoters").inputFiles()) == 50
    for down in (False, True):
        want = sorted(plain, key=lambda r: ((r[0] is not None, r[0] or 0) if not down else (r[0] is None, -(r[0] or 0)), r[1]))
        for skip in (0, 10_000, 19_990, 30_000):
            got = store.page("a", "promoters", limit=100, skip=skip, sort_field="score", sort_direction="desc" if down else "asc", ties=["start"])
            assert [(r["score"], r["start"]) for r in got.collect()] == want[skip : skip + 100]
            assert len(got.inputFiles()) <= 2
    part = store.rows("a", "promoters", between=("score", 100, 140))
    assert sorted((r["score"], r["start"]) for r in part.collect()) == sorted(r for r in plain if r[0] is not None and 100 <= r[0] <= 140) and len(part.inputFiles()) <= 3
    other = store.page("a", "promoters", limit=5, sort_field="start")
    assert [r["start"] for r in other.collect()] == [0, 1, 2, 3, 4]
    assert store.rows("a", "promoters", between=("score", 9_000, 9_001)).collect() == []


def test_a_stored_run_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    genes = ["TTGACA" + "A" * 17 + "TATAAT" + "GGAGGTTAGGAGGTTACATA" + "ATG" + "".join(rng.choices("ACG", k=120)) + "TAA" + "".join(rng.choices("ACGT", k=200)) for _ in range(3)]
    seqs = spark.createDataFrame(list(enumerate(genes)), "seq_id long, seq string")
    store = results.ResultStore(spark, str(tmp_path))
    run = stored_run.StoredRun(store, seqs, min_aa=10, chunk_size=200, overlap=60)
    with pytest.raises(KeyError):
        run.run("nothing")
    one = run.begin("one")
    with pytest.raises(stored_run.NotReady, match="coding_orfs, promoters, shine_dalgarno, terminators"):
        run.assemble(one)
    with monkeypatch.context() as m:
        m.setattr(stored_run.chunks, "chunked_features", lambda *a: (_ for _ in ()).throw(ValueError("lost")))
        with pytest.raises(ValueError):
            run.run(one)
    state = store.get(one)
    assert state["modules"]["coding_orfs"] == "done" and state["modules"]["promoters"] == "failed" and state["modules"]["ranking"] == "pending"
    assert [(e["module"], e["message"]) for e in state["errors"]] == [("chunked_features", "lost")] and state["sequence_length"] == sum(map(len, genes))
    with pytest.raises(stored_run.NotReady, match="finished: promoters, shine_dalgarno, terminators"):
        run.assemble(one)
    again = stored_run.StoredRun(results.ResultStore(spark, str(tmp_path)), seqs, min_aa=10, chunk_size=200, overlap=60)
    assert again.run(one) == ["promoters", "shine_dalgarno", "terminators", "ranking"] and again.run(one) == []
    state = store.get(one)
    assert state["status"] == "completed" and state["summary"] == {name: store.rows(one, m).count() for name, m in stored_run.COUNTS.items()} and state["summary"]["coding_orf_count"] > 0
    ranks = [r["rank"] for r in store.page(one, "ranked_coding_orfs", sort_field="rank").collect()]
    assert ranks == sorted(ranks) and ranks[0] == 1


def test_first_records_and_their_number_come_from_one_reading(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one x\nAC\nGT\n>two\nGG\n")
    (tmp_path / "b.fa").write_text(">three\nTTT\n")
    rows = fasta.counted_records(fasta.read_fasta(spark, str(tmp_path)))
    assert sorted((r["header"], r["sequence"], r["records"]) for r in rows.collect()) == [("one", "ACGT", 2), ("three", "TTT", 1)]
    assert "Join" not in rows._jdf.queryExecution().toString()


def test_a_stored_run_leaves_its_results_only(spark, tmp_path):
    from pathlib import Path

    from codonlake.operators import ranking
    from codonlake.sources import scratch

    rng = random.Random(17)
    some = [(k, "TTGACATTTACGGATTCGCAATATATAATGCGCAAGGAGGTTACATA" + "".join(rng.choices(["ATG", "GCA", "TTC", "AAA", "TAA", "CCG"], k=150))) for k in range(4)]
    seqs = spark.createDataFrame([*some, some[1]], "seq_id long, seq string")  # one of them twice
    store = results.ResultStore(spark, str(tmp_path))
    run = stored_run.StoredRun(store, seqs, min_aa=5, chunk_size=300, overlap=60)
    folder = Path(scratch.fresh(spark, "x")).parent
    before = set(folder.iterdir()) if folder.exists() else set()
    one = run.begin("one")
    run.run(one)
    assert not folder.exists() or set(folder.iterdir()) == before
    held = [run._stored(one, m) for m in ("coding_orfs", "shine_dalgarno", "promoters", "terminators")]
    want, got = ranking.rank_orfs(*held), run._stored(one, "ranked_coding_orfs")
    # equal rows of the sequence that is there twice may change places
    shown = lambda rows: sorted(repr(tuple(r[c] for c in want.columns)) for r in rows.collect())
    assert shown(got) == shown(want) and got.schema["orf"].dataType == want.schema["orf"].dataType and got.count() == held[0].count() > 20
