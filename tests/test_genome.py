"""Detectors against plain Python written from their rules, and boundary cases."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from codonlake.functions import dna
from codonlake.functions.align import global_alignment
from codonlake.operators import chunks, orfs, promoters, ranking, reports, shine_dalgarno, similarity, strands, terminators, tracks
from codonlake.plans.analysis import Analysis

COMP = str.maketrans("ACGTN", "TGCAN")
PROMOTER = "TTGACA" + "ACGTACGATCGATCGTA" + "TATAAT"


def sequences(spark, seqs):
    return spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "seq_id long, seq string")


def strand_strings(seq):
    return {"+": seq, "-": seq.translate(COMP)[::-1]}


@pytest.fixture(scope="module")
def made():
    rng = random.Random(3)
    seqs = ["".join(rng.choices("ACGTN", [30, 20, 20, 30, 1], k=n)) for n in (1500, 1200, 700, 60, 6, 5)]
    hairpin = "CCGCGGCAC" + "TTCA" + "GTGCCGCGG"
    seqs += ["GG" + PROMOTER + "GCGCA" + "AGGAGG" + "TTACATA" + "ATG" + "GCA" * 40 + "TAA" + "CAAACA" + hairpin + "T" * k + "ACG" for k in (4, 5, 50)]
    return [*seqs, "N" * 50, ""]


def brute_orfs(seq, min_aa, longest=False):
    out = set()
    for strand, s in strand_strings(seq).items():
        for f in range(3):
            starts = []
            for i in range(f, len(s) - 2, 3):
                codon = s[i : i + 3]
                if codon in dna.START_CODONS:
                    starts.append(i)
                if codon in dna.STOP_CODONS:
                    for j in starts[:1] if longest else starts:
                        if (i + 3 - j) // 3 - 1 >= min_aa:
                            out.add((strand, f + 1, j, i))
                    starts = []
    return out


@pytest.mark.parametrize("longest", [False, True])
def test_coding_orfs(spark, made, longest, monkeypatch):
    monkeypatch.setattr(orfs, "BLOCK", 200)  # stops found in later blocks, too
    rows = orfs.coding_orfs(sequences(spark, made), 5, longest_only_per_stop=longest).collect()
    got = {(r["seq_id"], r["strand"], r["frame"], r["start_index_in_strand"], r["stop_index_in_strand"]) for r in rows}
    assert got == {(i, *o) for i, s in enumerate(made) for o in brute_orfs(s, 5, longest)} and len(rows) == len(got)
    for r in rows:
        assert r["sequence"] == strand_strings(made[r["seq_id"]])[r["strand"]][r["start_index_in_strand"] : r["stop_index_in_strand"] + 3]


def differ(a, b):
    return sum(x != y for x, y in zip(a, b))


def test_promoters(spark, made):
    want = set()
    for i, seq in enumerate(made):
        for strand, s in strand_strings(seq).items():
            for a in range(len(s) - 5):
                for sp in range(16, 20):
                    p, q = s[a : a + 6], s[a + 6 + sp : a + 12 + sp]
                    if len(q) == 6 and "N" not in p + q and differ(p, "TTGACA") <= 2 and differ(q, "TATAAT") <= 2:
                        want.add((i, strand, a, a + 6 + sp))
    raw = promoters.raw_promoters(sequences(spark, made)).collect()
    assert {(r["seq_id"], r["strand"], r["i35"], r["i10"]) for r in raw} == want
    kept = promoters.promoters(sequences(spark, made)).collect()
    top = [r for r in kept if r["seq_id"] == 7 and r["strand"] == "+" and r["box35_seq"] == "TTGACA"][0]
    assert (top["box35_start"], top["box10_start"], top["spacing"]) == (3, 26, 17)
    assert promoters.raw_promoters(sequences(spark, made), spacing_min=5, spacing_max=4).count() == 0


def test_sd_sites(spark, made):
    want = {}
    for i, seq in enumerate(made):
        for strand, s in strand_strings(seq).items():
            for p in range(len(s) - 2):
                if s[p : p + 3] not in dna.START_CODONS or len(s) < 13:
                    continue
                found = []
                for d in range(4, 13):
                    a = p - d - 6
                    w = s[a : a + 6] if a >= 0 else "N"
                    if "N" not in w and differ(w, "AGGAGG") <= 2:
                        score = 20 - 4 * differ(w, "AGGAGG") + max(0, 10 - 2 * abs(d - 7)) + {"ATG": 5, "GTG": 3, "TTG": 2}[s[p : p + 3]]
                        found.append((-score, differ(w, "AGGAGG"), abs(d - 7), a, d))
                if found:
                    best = min(found)
                    want[i, strand, p + 1 if strand == "+" else len(s) - p - 2] = (best[4], -best[0])
    got = {(r["seq_id"], r["strand"], r["linked_start_position"]): (r["distance_to_start"], r["score"]) for r in shine_dalgarno.sd_sites(sequences(spark, made)).collect()}
    assert got == want


def test_terminators(spark, made):
    want = set()
    for i, seq in enumerate(made):
        for strand, s in strand_strings(seq).items():
            for p in range(len(s)):
                run = len(s[p:]) - len(s[p:].lstrip("T"))
                for k in range(5, 11):
                    for loop in range(3, 8):
                        a = p - 2 * k - loop
                        if run >= 5 and a >= 0:
                            left, right = s[a : a + k], s[p - k : p]
                            if "N" not in left + right and sum(c in "GC" for c in left) / k >= 0.7 and differ(left, right.translate(COMP)[::-1]) <= 1:
                                want.add((i, strand, p, run, k, loop))
    rows = terminators.raw_terminators(sequences(spark, made)).collect()
    assert {(r["seq_id"], r["strand"], r["i_t"], r["poly_t_length"], r["stem_length"], r["loop_length"]) for r in rows} == want
    kept = terminators.terminators(sequences(spark, made)).collect()
    assert not [r for r in kept if r["seq_id"] == 6 and r["strand"] == "+"]
    assert max(r["poly_t_length"] for r in kept if r["seq_id"] == 8) == 50


def test_suppression_is_greedy(spark):
    from codonlake.operators.nms import keep_best

    rng = random.Random(5)
    rows = [(1, n, a := rng.randrange(2000), a + rng.randrange(1, 40), rng.randrange(30)) for n in range(500)]
    kept = []
    for r in sorted(rows, key=lambda r: (-r[4], r[1])):
        if all(r[3] < k[2] or k[3] < r[2] for k in kept):
            kept.append(r)
    df = spark.createDataFrame(rows, "g long, n long, a long, b long, score long")
    got = keep_best(df, ["g"], "a", "b", [-F.col("score"), F.col("n")]).collect()
    assert {r["n"] for r in got} == {k[1] for k in kept}


def test_range_join_is_the_plain_join(spark):
    rng = random.Random(6)
    hits = [(0, rng.choice("+-"), a := rng.randrange(1, 6000), a + 5, a + 22, a + 27, float(rng.randrange(20))) for _ in range(150)]
    genes = [(0, rng.choice("+-"), a := rng.randrange(1, 6000), a + 90) for _ in range(120)] + [(1, "+", 10, 100)]
    h = spark.createDataFrame(hits, "seq_id long, strand string, box35_start long, box35_end long, box10_start long, box10_end long, score double")
    o = spark.createDataFrame(genes, "seq_id long, strand string, start long, end long")
    for r in ranking.best_promoter(o, h).collect():
        near = []
        for s, strand, a35, _, a, b, score in hits:
            d = r["start"] - b if strand == "+" else a - r["end"]
            if (s, strand) == (r["seq_id"], r["strand"]) and 1 <= d <= 300:
                near.append((d, -score, a, a35))
        got = r["promoter"]
        assert (got and (got["box10_start"], got["box35_start"])) == (min(near)[2:] if near else None)


def test_ranking_and_clusters(spark, made):
    ranked = Analysis(sequences(spark, made), 5).ranked_coding_orfs()
    rows = ranked.orderBy("seq_id", "rank").collect()
    assert all(r["total_score"] == pytest.approx(sum(r["score_breakdown"]), abs=2e-3) for r in rows)
    assert all(r["score_breakdown"]["promoter_score"] == 0 for r in rows if r["best_promoter"] is None)
    twice = sequences(spark, [PROMOTER + ("ATG" + "GCATTAGCC" * 20 + "TAA" + "CCC") * 2])
    clusters = similarity.star_clusters(Analysis(twice, 30).ranked_coding_orfs()).collect()
    assert clusters and clusters[0]["orf_count"] >= 2
    with pytest.raises(ValueError):
        Analysis(twice, 0)


def test_clusters_equal_a_plain_greedy_pass(spark):
    import random

    rng = random.Random(5)
    gene = lambda n: "ATG" + "".join(rng.choice(["GCA", "TTC", "AAA", "CCG", "GAT", "TGG"]) for _ in range(n)) + "TAA"
    genes = [gene(60) for _ in range(3)]
    for k in range(9):
        g = list(genes[k % 3])
        for _ in range(k):
            g[3 * rng.randrange(1, 60)] = "G"
        genes.append("".join(g))
    rows = similarity.proteins(Analysis(sequences(spark, ["CC".join(genes), "C".join(genes[:6])]), 30).ranked_coding_orfs()).collect()
    got = similarity.star_clusters(Analysis(sequences(spark, ["CC".join(genes), "C".join(genes[:6])]), 30).ranked_coding_orfs()).collect()
    kmers = lambda p: {p[i : i + 3] for i in range(len(p) - 2)}
    want = []
    for s in {r["seq_id"] for r in rows}:
        own = sorted((r["rank"], r["protein"], r["score"]) for r in rows if r["seq_id"] == s)
        taken, n = set(), 0
        for i, p, score in own:
            if i in taken:
                continue
            members = [(i, p, score)]
            for j, q, other in own:
                if j <= i or j in taken or min(len(p), len(q)) / max(len(p), len(q)) < 0.8:
                    continue
                a, b = kmers(p), kmers(q)
                if len(a & b) / max(1, len(a | b)) >= 0.5 and global_alignment(p, q)[0] >= 0.9:
                    members.append((j, q, other))
                    taken.add(j)
            if len(members) > 1:
                taken.add(i)
                n += 1
                want.append((s, n, [f"ORF_{k}" for k, *_ in members], f"ORF_{max(members, key=lambda m: m[2])[0]}"))
    assert sorted((r["seq_id"], r["cluster_id"], [o["orf_uid"] for o in r["orfs"]], r["best_orf_uid"]) for r in got) == sorted(want) and want
    assert all(len(r["alignments"]) == r["orf_count"] - 1 for r in got)


def test_reports(spark):
    from codonlake.operators import reports

    gene = PROMOTER + "ATG" + "GCA" * 40 + "TAA"
    seqs = sequences(spark, [gene, "ACGT"])
    found = Analysis(seqs, 30)
    text = lambda rows, kind, by: {(r["seq_id"], r["rank"]): r["line"] for r in reports.report(rows.filter("strand = '+'"), kind, by, seqs).collect()}
    coding = text(found.coding_orfs().filter("start_codon = 'ATG'"), "coding_orfs", ["start"])
    assert coding == {
        (0, 0): "Detected 1 coding ORF(s):\n",
        (0, 1): "Coding ORF 1\n  Strand: +\n  Frame: 3\n  Start: 30\n  End: 155\n  Length: 126 nt\n  Peptide length: 41 aa\n  Start codon: ATG\n  Stop codon: TAA\n  Sequence: ATG" + "GCA" * 29 + "...\n",
        (1, 0): "No coding ORFs found.",
    }
    sites = text(found.promoters(), "promoters", ["box35_start"])
    assert sites == {
        (0, 0): "Detected 1 promoter-like region(s):\n",
        (0, 1): "Promoter 1\n  Strand: +\n  -35 box: TTGACA at 1..6 (mismatches=0)\n  -10 box: TATAAT at 24..29 (mismatches=0)\n  Spacing: 17 nt\n  Spacer sequence: ACGTACGATCGATCGTA\n  Spacer AT fraction: 0.529\n  Score: 32.118\n",
        (1, 0): "No sigma70-like promoter region found.",
    }
    none = "No rho-independent terminator-like structure found."
    assert text(found.terminators(), "terminators", ["poly_t_start"]) == {(0, 0): none, (1, 0): none}
    hit = spark.createDataFrame([(0, "+", 1, 5, 9, 13, 14, 18, "GCGCG", "AAA", "CGCGC", "TTTTT", 5, 3, 0, 1.0, 5, 38.3)], "seq_id long, strand string, stem_left_start long, stem_left_end long, stem_right_start long, stem_right_end long, poly_t_start long, poly_t_end long, stem_left_seq string, loop_seq string, stem_right_seq string, poly_t_seq string, stem_length long, loop_length long, mismatches long, gc_fraction double, poly_t_length long, score double")
    assert text(hit, "terminators", ["poly_t_start"])[0, 1] == (
        "Terminator 1\n  Strand:       +\n  Left stem:    GCGCG at 1..5\n  Loop:         AAA\n  Right stem:   CGCGC at 9..13\n  Poly-T:       TTTTT at 14..18\n"
        "  Stem length:  5\n  Loop length:  3\n  Mismatches:   0\n  GC fraction:  1.0\n  Poly-T len:   5\n  Score:        38.3\n"
    )
    site = spark.createDataFrame([(0, "+", 3, 8, "AGGAGG", 0, "ATG", 16, 7, 35.0)], "seq_id long, strand string, start long, end long, sequence string, mismatches long, linked_start_codon string, linked_start_position long, distance_to_start long, score double")
    assert text(site, "sd_sites", ["start"])[0, 1] == "Site 1\n  Strand: +\n  Positions: 3..8\n  Sequence: AGGAGG\n  Mismatches vs consensus AGGAGG: 0\n  Context: linked to ATG at position 16 with spacing 7 nt\n  Score: 35.0\n"
    frames = text(found.orfs().filter("frame = 1"), "orfs", ["frame"])
    assert frames[0, 0] == "Detected 1 reading frame(s):\n" and frames[0, 1] == f"Frame 1\n  Strand: +\n  Frame: 1\n  Positions: 1..153\n  Length: 153 nt (51 codons)\n  Sequence: {gene[:90]}...\n"
    lines = reports.feature_lines(site, "Site", ["start"], ["strand", "start"])
    assert [r["line"] for r in lines.collect()] == ["Site 1 | strand: + | start: 3"]


def test_picked_score(spark):
    orf = "struct<peptide_length_aa: long, score: double, rank_score: string>"
    rows = spark.createDataFrame([(1, 4.0, (7, 9.0, "x")), (2, None, (7, 9.0, "x")), (3, None, (7, None, None)), (4, None, (None, None, None))], f"n int, total_score double, orf {orf}")
    assert [r["s"] for r in rows.select("n", similarity.picked_score(rows).alias("s")).orderBy("n").collect()] == [4.0, 9.0, 7.0, 0.0]
    rows = spark.createDataFrame([(1, 2.0, 5.0, (7,))], "n int, final_score double, total_score double, orf struct<peptide_length_aa: long>")
    assert rows.select(similarity.picked_score(rows).alias("s")).first()["s"] == 2.0


def test_windows_and_orders(spark):
    inner = PROMOTER + "ATG" + "GCA" * 40 + "TAA"
    seqs = sequences(spark, ["C" * 50 + inner + "C" * 30])
    alone = Analysis(sequences(spark, [inner]), 30).ranked_coding_orfs().collect()
    moved = chunks.window_ranked(seqs, 51, 50 + len(inner), lambda s: Analysis(s, 30).ranked_coding_orfs()).collect()
    assert sorted((r["rank"], r["orf"]["start"] + 50, r["best_promoter"] and r["best_promoter"]["box10_start"] + 50) for r in alone) == sorted((r["rank"], r["orf"]["start"], r["best_promoter"] and r["best_promoter"]["box10_start"]) for r in moved) and alone
    hits = chunks.in_place_order(chunks.chunked_features(seqs, "sd_sites", 100, 50), "sd_sites").collect()
    assert [(r["strand"] == "-", r["start"], r["end"]) for r in hits] == sorted((r["strand"] == "-", r["start"], r["end"]) for r in hits)
    shown = spark.createDataFrame([("+", 5), ("-", 5)], "s string, a int").select(tracks.display_codon_range(F.col("s"), F.col("a"))).collect()
    assert [r[0] for r in shown] == ["5-7", "7-5"]
    n = spark.createDataFrame([(0, "CCAGGNGGCC")], "seq_id long, seq string")
    assert [r["i"] for r in strands.motif_hits(n, "AGGAGG", 1).filter("strand = '+'").collect()] == [2]


def test_chunks(spark):
    rows = chunks.chunks(sequences(spark, ["A" * 10, "A" * 11, ""]), 4, 1).collect()
    assert [(r["chunk_start"], r["chunk_end"]) for r in rows if r["seq_id"] == 0] == [(1, 4), (4, 7), (7, 10)]
    assert [(r["chunk_start"], r["chunk_end"]) for r in rows if r["seq_id"] == 1] == [(1, 4), (4, 7), (7, 10), (10, 11)]
    with pytest.raises(ValueError):
        chunks.chunks(sequences(spark, ["A"]), 4, 4)


def test_strand_symmetry(spark, made):
    both = [made[0], made[0].translate(COMP)[::-1]]
    rows = shine_dalgarno.sd_sites(sequences(spark, both)).collect()
    flip = {"+": "-", "-": "+"}
    n = len(made[0])
    a = {(r["strand"], r["start"], r["end"]) for r in rows if r["seq_id"] == 0}
    assert a == {(flip[r["strand"]], n - r["end"] + 1, n - r["start"] + 1) for r in rows if r["seq_id"] == 1}


def test_scalars(spark):
    df = spark.createDataFrame([("acg tn\nx",), ("",), (None,)], "s string")
    rows = df.select(dna.clean(F.col("s")).alias("c"), dna.dna_error(dna.clean(F.col("s"))).alias("e")).collect()
    assert rows[0]["e"] == "Invalid DNA characters found: X" and rows[1]["e"] == rows[2]["e"] == "Sequence is empty."
    one = spark.createDataFrame([("ATGGCNTAAGG", "GGCC")], "s string, t string")
    got = one.select(
        dna.protein(F.col("s")), dna.reverse_complement(F.col("s")), dna.fraction_of(F.col("t"), "GC"), dna.kmers(F.col("t")), dna.hamming(F.col("t"), F.lit("GACC")),
        dna.motif_mismatches_at(F.col("s"), F.lit(9), "ATG"), dna.fragment(F.col("s"), F.lit(-2), F.lit(3)), dna.wrapped(F.col("s"), 5), dna.stars(F.lit(12.0)), dna.preview(F.col("s"), 3),
    ).first()
    assert list(got) == ["MX", "CCTTANGCCAT", 1.0, ["GGC", "GCC"], 1, -1, "ATG", "ATGGC\nNTAAG\nG", 3, "ATG..."]
    assert global_alignment("HEAG", "HEG")[:3] == (0.75, 75.0, 4) and global_alignment("", "")[0] == 0.0


def test_tracks(spark):
    sd = spark.createDataFrame([(0, "+", 1, 6, 5)], "seq_id long, strand string, start long, end long, linked_start_position long")
    got = {r["position"]: r["type"] for r in tracks.covered_positions(tracks.tracks(sd, "sd_sites")).collect()}
    assert got == {1: "shineDalgarno", 2: "shineDalgarno", 3: "shineDalgarno", 4: "shineDalgarno", 5: "startCodon", 6: "startCodon", 7: "startCodon"}


def test_frames(spark):
    rows = strands.frames(sequences(spark, ["ACGTA", "AC"])).collect()
    assert len(rows) == 6 and all(r["length_nt"] == 3 for r in rows)


def greedy(rows):
    """Names kept of (group, name, a, b, score): best first, those that overlap none kept before."""
    kept, at = set(), {}
    for g, n, a, b, _ in sorted(rows, key=lambda r: (-r[4], r[1])):
        starts, ends = at.setdefault(g, ([], []))
        k = bisect.bisect_right(starts, b)
        if not k or ends[k - 1] < a:
            starts.insert(k, a)
            ends.insert(k, b)
            kept.add((g, n))
    return kept


@pytest.mark.parametrize(("block", "most"), [(1 << 16, 1_000), (64, 1_000), (1 << 16, 3), (50, 0)])
def test_suppression_by_blocks_and_rounds(spark, block, most):
    from codonlake.operators.nms import keep_best

    rng = random.Random(block + most)
    rows = [(g, n, a := rng.randrange(2000), a + rng.randrange(0, 90 if n % 50 else 400), rng.randrange(30)) for g in (1, 2) for n in range(300)]
    rows += [(3, n, 10 * n, 10 * n + 12, 100 - n) for n in range(20)] + [(4, n, 5, 9, 1) for n in range(40)]  # a chain, and equal ones
    df = spark.createDataFrame(rows, "g long, n long, a long, b long, score long")
    got = [(r["g"], r["n"]) for r in keep_best(df, ["g"], "a", "b", [-F.col("score"), F.col("n")], block, most).collect()]
    assert len(got) == len(set(got)) and set(got) == greedy(rows)


def test_suppression_of_one_long_island(spark):
    from codonlake.operators.nms import keep_best

    n = 60_000
    df = spark.range(n).select(F.lit("s").alias("g"), F.col("id").alias("n"), (F.col("id") * 3).alias("a"), (F.col("id") * 3 + 20 + F.col("id") % 11).alias("b"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("score"))
    rows = [tuple(r) for r in df.collect()]
    got = {(r["g"], r["n"]) for r in keep_best(df, ["g"], "a", "b", [-F.col("score"), F.col("n")]).collect()}
    assert got == greedy(rows)


def test_runs_across_blocks(spark):
    seqs = ["ACG" + "T" * 23 + "A" + "T" * 8 + "CTTTTTC" + "T" * 40, "T" * 64, "T" * 16, "A" * 16 + "T" * 16 + "A", "TTTT", "G" * 9 + "T" * 7 + "G" * 16 + "T" * 5]
    plain = {(r["seq_id"], r["strand"], r["i"]): r["run"] for r in terminators.t_runs(sequences(spark, seqs)).collect()}
    want = {(k, strand, p): len(s[p:]) - len(s[p:].lstrip("T")) for k, seq in enumerate(seqs) for strand, s in strand_strings(seq).items() for p in range(len(s)) if s[p : p + 5] == "TTTTT"}
    assert plain == want
    for block in (1, 4, 7, 16):
        rows = terminators.t_runs(sequences(spark, seqs), block=block).collect()
        assert len(rows) == len(want) and {(r["seq_id"], r["strand"], r["i"]): r["run"] for r in rows} == want


def test_rank_of_a_hot_key_is_that_of_a_window(spark):
    from codonlake.operators.ranks import with_rank

    rng = random.Random(9)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.randrange(50), n) for n in range(2_000)]
    df = spark.createDataFrame(rows, "k long, score long, n long")
    order = [F.desc("score"), F.asc("n")]
    plain = sorted(map(repr, (tuple(r) for r in with_rank(df, ["k"], order).collect())))
    hot = with_rank(df, ["k"], order, hot_rows=500)
    tasks = hot.filter("k = 1").select(F.spark_partition_id().alias("p")).distinct().count()
    assert sorted(map(repr, (tuple(r) for r in hot.collect()))) == plain and tasks > 1
    mine = sorted((-s, n) for k, s, n in rows if k == 1)
    assert {(r["n"], r["rank"]) for r in hot.filter("k = 1").collect()} == {(n, i + 1) for i, (_, n) in enumerate(mine)}


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.5, 0.9, 1.0])
def test_kmer_pairs_lose_none(spark, threshold):
    rng = random.Random(10)
    base = "".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=120))
    some = ["".join(rng.choices("ACDE", k=rng.randrange(1, 40))) for _ in range(30)] + [base[rng.randrange(20) :] for _ in range(10)] + ["A", "AC", "ACD", "ACD", "AAAAAAA", "AAAAAA", base[:100], base[:80]]
    some += ["".join(c if rng.random() > 0.05 else "W" for c in base) for _ in range(8)]
    df = spark.createDataFrame([(g, k + 1, p) for g in (0, 1) for k, p in enumerate(some if g else some[:20])], "seq_id long, rank int, protein string")
    got = {(r["seq_id"], r["i"], r["j"]): r["jaccard"] for r in similarity.kmer_pairs(df, threshold).collect()}
    want = {}
    for g in (0, 1):
        words = [{p[i : i + 3] for i in range(len(p) - 2)} for p in (some if g else some[:20])]
        for j in range(len(words)):
            for i in range(j):
                a, b = len(some[i]), len(some[j])
                value = len(words[i] & words[j]) / len(words[i] | words[j]) if words[i] | words[j] else 0.0
                if min(a, b) / max(a, b) >= 0.8 and value >= threshold:
                    want[g, i + 1, j + 1] = value
    assert got == want


def test_kmer_pairs_meet_in_blocks_without_joins(spark, monkeypatch):
    rng = random.Random(11)
    base = "".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=60))
    some = ["".join(rng.choices("AC\u00c9\U0001f9ec", k=rng.randrange(1, 30))) for _ in range(20)] + [base[rng.randrange(15) :] for _ in range(20)] + ["A", "ACD", "ACD"]
    df = spark.createDataFrame([(g, k + 1, p) for g in range(3) for k, p in enumerate(some)], "seq_id long, rank int, protein string")
    rows = similarity.kmer_pairs(df, 0.5)
    assert "Join" not in rows._jdf.queryExecution().toString()
    want = sorted(map(tuple, rows.collect()))
    monkeypatch.setattr(similarity, "BLOCK", 4)
    monkeypatch.setattr(similarity, "WORDS", 100)
    assert sorted(map(tuple, similarity.kmer_pairs(df, 0.5).collect())) == want and want


def test_proteins_are_translated_as_by_columns(spark):
    rng = random.Random(13)
    some = ["".join(rng.choices("ACGTNacgu\u00e9", k=rng.randrange(0, 90))) for _ in range(200)] + [None, "", "AT", "TAA", "ATGTAA"]
    df = spark.createDataFrame([(t,) for t in some], "t string").select(similarity.protein(F.col("t")).alias("a"), dna.protein(F.col("t")).alias("b"))
    assert all(r["a"] == r["b"] for r in df.collect())


def test_alignments_by_bits_equal_tables_in_little_memory(monkeypatch):
    import tracemalloc

    from codonlake.functions import align

    monkeypatch.setattr(align, "COLUMNS", 7)
    rng = random.Random(14)
    for k in range(600):
        letters = "ACDEFGHIKLMNPQRSTVWY"[: rng.choice([2, 3, 20])]
        a = "".join(rng.choices(letters, k=rng.randrange(40)))
        b = "".join(rng.choices(letters, k=rng.randrange(40))) if k % 2 else "".join(c if rng.random() > 0.1 else rng.choice(["", "W", c + "K"]) for c in a)
        want = align._by_tables(a, [b], 2, -1, -2)[0]
        assert align.global_alignments(a, [b]) == [want]
        found = align.global_alignments(a, [b], least=0.9)[0]
        assert found == want or found is None and want[0] < 0.9
    monkeypatch.undo()
    a = "".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=6000))
    b = "".join(c if rng.random() > 0.02 else "W" for c in a)
    tracemalloc.start()
    assert align.global_alignment(a, b)[0] > 0.95
    assert tracemalloc.get_traced_memory()[1] < 16 << 20  # a table of numbers has 144 MB
    tracemalloc.stop()


def test_visible_intervals(spark):
    rng = random.Random(12)
    ranges = [(0, n, a := rng.randrange(1, 5000), a + rng.randrange(-1, 2500)) for n in range(40)]
    spans = [(0, "+", str(n), rng.randrange(1, 5000), rng.randrange(1, 5000)) for n in range(60)] + [(0, "-", "none", None, 5), (1, "+", "other", 1, 5000)]
    got = tracks.visible_in(spark.createDataFrame(ranges, "seq_id long, range_id long, first long, last long"), spark.createDataFrame(spans, "seq_id long, strand string, type string, start long, end long"), width=300)
    want = {(n, t, max(min(s, e), a), min(max(s, e), b)) for _, n, a, b in ranges for q, _, t, s, e in spans if q == 0 and s and a <= b and min(s, e) <= b and max(s, e) >= a}
    rows = [(r["range_id"], r["type"], r["shown_start"], r["shown_end"]) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_document_ranks_a_section_once(spark):
    from codonlake.operators import document

    seqs = spark.createDataFrame([("a", "x"), ("b", "y")], "seq_id string, seq string")
    orf = spark.createDataFrame([("a", "+", 1, 4, 9, 6, 1, "ATG", "TAA", "ATGTAA")], "seq_id string, strand string, frame int, start long, end long, length_nt long, peptide_length_aa long, start_codon string, stop_codon string, sequence string")
    prom = spark.createDataFrame([("a", "-", "TTGACA", 1, 6, 0, "TATAAT", 24, 29, 1, 17, "", 0.375, 30.0)], "seq_id string, strand string, box35_seq string, box35_start long, box35_end long, box35_mismatches long, box10_seq string, box10_start long, box10_end long, box10_mismatches long, spacing long, spacer_seq string, spacer_at_fraction double, score double")
    plan = document.document(seqs, {"promoters": prom})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1  # the end of a document is known from the stored counts


def test_document(spark, tmp_path):
    from codonlake.operators import document

    seqs = spark.createDataFrame([("a", "x"), ("b", "y")], "seq_id string, seq string")
    orf = spark.createDataFrame([("a", "+", 1, 4, 9, 6, 1, "ATG", "TAA", "ATGTAA")], "seq_id string, strand string, frame int, start long, end long, length_nt long, peptide_length_aa long, start_codon string, stop_codon string, sequence string")
    prom = spark.createDataFrame([("a", "-", "TTGACA", 1, 6, 0, "TATAAT", 24, 29, 1, 17, "", 0.375, 30.0)], "seq_id string, strand string, box35_seq string, box35_start long, box35_end long, box35_mismatches long, box10_seq string, box10_start long, box10_end long, box10_mismatches long, spacing long, spacer_seq string, spacer_at_fraction double, score double")
    rows = document.document(seqs, {"coding_orfs": orf, "promoters": prom})
    document.write_documents(rows, str(tmp_path / "out"))
    text = lambda k: "".join(f.read_text().replace("\x1e", "") for f in sorted((tmp_path / "out" / f"seq_id={k}").glob("part-*")))
    stretch = "  Strand: +\n  Frame: 1\n  Start: 4\n  End: 9\n  Length: 6 nt\n  Peptide length: 1 aa\n  Start codon: ATG\n  Stop codon: TAA\n  Sequence:\n    5' ATGTAA 3'   [1-6]\n       ||||||\n    3' TACATT 5'\n\n\n"
    assert text("a") == (
        "DNA Analysis Results\n====================\n\nCoding ORFs (1)\n------------------------------\nCoding ORF 1\n"
        + stretch
        + "Best Candidate ORF (l’ORF potentiellement)\n------------------------------\n"
        + stretch
        + "Promoters (1)\n------------------------------\nPromoter 1\n  Strand: -\n  -35 box: TTGACA (1-6)\n  -35 mismatches: 0\n  -10 box: TATAAT (24-29)\n  -10 mismatches: 1\n"
        "  Spacing: 17 nt\n  Spacer sequence: N/A\n  Spacer AT fraction: 0.375\n  Score: 30"
    )
    assert text("b") == "DNA Analysis Results\n====================\n\nCoding ORFs (0)\n------------------------------\nPromoters (0)\n------------------------------"


def plan_of(rows):
    return rows._jdf.queryExecution().toString()


def test_sd_sites_and_hairpins_are_chosen_by_numbers(spark):
    seqs = sequences(spark, ["ACGTN" * 20])
    assert "lambdafunction" not in plan_of(shine_dalgarno.sd_sites(seqs))
    assert "bit_count" in plan_of(terminators.raw_terminators(seqs))


def test_long_arms_are_compared_as_strings(spark):
    text = "".join(random.Random(7).choices("ACGT", k=200)) + "CCGCGGCACTTCAGTGCCGCGGTTTTTT" + "N" * 9 + "GCGCGCTTTTGCGCGCTTTTTNTTTTT"
    few = terminators.raw_terminators(sequences(spark, [text]))
    many = terminators.raw_terminators(sequences(spark, [text]), stem_max=14).filter("stem_length <= 10")
    assert few.count() > 0 and sorted(few.collect()) == sorted(many.collect())


def test_a_report_counts_what_is_ranked(spark):
    seqs = sequences(spark, ["A" * 9 + "AGGAGGTTACATAATG", "CCC"])
    hits = shine_dalgarno.sd_sites(seqs)
    lines = reports.report(hits, "sd_sites", [*shine_dalgarno.order(), "linked_start_position"], seqs)
    assert "bit_count" not in plan_of(lines) and lines.count() == hits.count() + 2


def test_orfs_without_texts_read_no_letters_again(spark):
    seqs = sequences(spark, ["ATG" + "GCA" * 1500 + "TAA" + "C" * 70_000 + "ATGGCATAA", "CC"])
    narrow, full = orfs.coding_orfs(seqs, 30, texts=False), orfs.coding_orfs(seqs, 30)
    assert "collect_list" not in plan_of(narrow)
    assert sorted(narrow.collect()) == sorted(full.drop("sequence").collect())
    rows = full.filter("strand = '+'").select("start", "sequence").collect()
    assert ("ATG" + "GCA" * 1500 + "TAA") in [r["sequence"] for r in rows]


def test_nothing_is_ranked_to_be_counted(spark, monkeypatch):
    monkeypatch.setattr(ranking, "rank_orfs", lambda *_, **__: pytest.fail("ranked"))
    assert Analysis(sequences(spark, ["ATG" + "GCA" * 40 + "TAA"]), 5).summary().first()["coding_orfs"] > 0


def test_scans_shuffle_nothing_and_read_in_pieces(spark, made, monkeypatch):
    seqs = sequences(spark, made)
    finders = [lambda: strands.motif_hits(seqs, "AGGAGG", 1), lambda: promoters.raw_promoters(seqs), lambda: shine_dalgarno.sd_sites(seqs), lambda: orfs.codons(seqs, apart=4)]
    plans, whole = [plan_of(f()) for f in finders], [sorted(f().collect()) for f in finders]
    assert all(whole) and not any("Repartition" in p or "explode(sequence" in p for p in plans)
    monkeypatch.setattr(strands, "PIECE", 37)
    assert [sorted(f().collect()) for f in finders] == whole


def test_suppression_sends_on_what_is_kept_only(spark, made):
    rows = promoters.promoters(sequences(spark, made))
    assert "lambdafunction" not in plan_of(rows) and rows.count() > 0


def test_suppression_across_arrow_batches(spark):
    from codonlake.operators.nms import keep_best

    rng = random.Random(8)
    rows = [(n % 3, n, a := rng.randrange(3000), a + rng.randrange(0, 30), rng.randrange(9)) for n in range(900)] + [(4, n, n, n + 5, n % 7) for n in range(200)]
    df = spark.createDataFrame(rows, "g long, n long, a long, b long, score long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = [(r["g"], r["n"]) for r in keep_best(df, ["g"], "a", "b", [-F.col("score"), F.col("n")], most=20).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(set(got)) and set(got) == greedy(rows)


def test_suppression_of_chains_over_blocks_needs_no_rounds(spark, monkeypatch):
    from codonlake.operators import nms

    rows = [(1, n, 10 * n, 10 * n + 12, 5000 - n) for n in range(3000)] + [(2, n, 7 * n, 7 * n + 30, n % 13) for n in range(300)] + [(3, 0, 5, 6, 1)]
    df = spark.createDataFrame(rows, "g long, n long, a long, b long, score long")
    monkeypatch.setattr(nms, "_by_rounds", None)  # each interval is a little worse than the one before: a round for every two
    got = [(r["g"], r["n"]) for r in nms.keep_best(df, ["g"], "a", "b", [-F.col("score"), F.col("n")], block=1000).collect()]
    assert len(got) == len(set(got)) and set(got) == greedy(rows)


def test_double_strands_are_written_in_batches(spark, monkeypatch):
    from codonlake.operators import document

    monkeypatch.setattr(document, "PIECE", 500)
    some = ["".join(random.Random(n).choices("ACGTN", k=n)) for n in (1, 59, 60, 61, 300, 7)] + [None, ""]
    rows = spark.createDataFrame([(t,) for t in some], "t string").select("t", document.double_strand_text(F.col("t")).alias("x"))
    for t, x in rows.collect():
        parts = [(k, t[k : k + 60]) for k in range(0, len(t or ""), 60)]
        want = "".join(f"    5' {p} 3'   [{k + 1}-{k + len(p)}]\n       {'|' * len(p)}\n    3' {p.translate(str.maketrans('ACGTN', 'TGCAN'))} 5'\n\n" for k, p in parts)
        assert x == (want or "N/A\n")
    assert "transform(" not in plan_of(rows)  # a function that is run letter by letter, without generated code


def test_letters_are_turned_once_a_stop_codon(spark, made):
    rows = orfs.coding_orfs(sequences(spark, made), 5)
    plan = plan_of(rows)
    turned = [k for k, line in enumerate(plan.splitlines()) if "reverse(" in line]
    apart = [k for k, line in enumerate(plan.splitlines()) if "explode(_all" in line]
    assert len(turned) == len(apart) and all(a < t for a, t in zip(apart, turned)) and turned  # what is lower in a plan comes first


def test_positions_are_covered_by_bits(spark):
    spans = [(0, "+", "orf", 1, 200), (0, "+", "box10", 60, 70), (0, "+", "polyT", 64, 127), (0, "-", "orf", 128, 128), (0, "-", "orf", -3, -1)]
    rows = tracks.covered_positions(spark.createDataFrame(spans, "seq_id long, strand string, type string, start long, end long"))
    want = {}
    for s, strand, t, a, b in spans:
        for p in range(a, b + 1):
            want[s, strand, p] = min(want.get((s, strand, p), t), t, key=tracks.PRIORITY.index)
    assert {(r["seq_id"], r["strand"], r["position"]): r["type"] for r in rows.collect()} == want
    assert "bit_or" in plan_of(rows)
