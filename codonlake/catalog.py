"""Registered queries over the driver's tables, each with its SQL twin where one exists."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .functions import dna
from .operators import chunks, document, orfs, promoters, ranking, reports, shine_dalgarno, similarity, strands, terminators, tracks
from .operators.ranks import with_rank
from .plans import analysis, stored_run
from .plans.derived import SQL as SEQS
from .plans.derived import sequences
from .sources import fasta, scratch
from .sources.results import ResultStore, page

QUERIES, ORACLE_SQL = {}, {}
CHUNK, OVERLAP = 1500, 200


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def with_md5(rows, column="sequence"):
    return rows.withColumn(f"{column}_md5", F.md5(column)).drop(column)


# ---- SQL building blocks -------------------------------------------------

CODE = ", ".join(f"'{c}': '{a}'" for c, a in zip([x + y + z for x in dna.BASES for y in dna.BASES for z in dna.BASES], dna.AMINO_ACIDS))


def strands_of(source: str = "seqs", keys: str = "seq_id", name: str = "strands") -> str:
    return f"""{name} AS (
    SELECT {keys}, '+' AS strand, length(seq) AS n, seq AS s FROM {source}
    UNION ALL SELECT {keys}, '-', length(seq), reverse(translate(seq, 'ACGTN', 'TGCAN')) FROM {source})"""


BEFORE, BEHIND = 27, 32


def positions_of(keys: str = "seq_id") -> str:
    """A row a base, with the letters around it (``at``) instead of its strand; '.' beyond the ends."""
    return f"""pos AS (
    SELECT {keys}, strand, n, i, substr(p, i + 1, {BEFORE + BEHIND}) AS w
    FROM (SELECT {keys}, strand, n, repeat('.', {BEFORE}) || s || repeat('.', {BEHIND}) AS p, unnest(range(n)) AS i FROM strands))"""


def at(shift: str | int, length: str | int) -> str:
    """The letters from ``shift`` after a position on."""
    return f"substr(w, {BEFORE + 1} + {shift}, {length})"


def base(source: str = "seqs", keys: str = "seq_id") -> str:
    return f"WITH {SEQS},\n{strands_of(source, keys)},\n{positions_of(keys)}"


def fwd(start: str, end: str) -> tuple[str, str]:
    return (f"CASE WHEN strand = '+' THEN {start} + 1 ELSE n - ({end}) + 1 END", f"CASE WHEN strand = '+' THEN {end} ELSE n - ({start}) END")


def ham(text: str, motif: str) -> str:
    return f"CASE WHEN instr({text}, '.') = 0 AND instr({text}, 'N') = 0 THEN hamming({text}, '{motif}') ELSE 99 END"


def orfs_sql(longest: bool = False, min_aa: int = 30) -> str:
    start, end = fwd("i", "stop + 3")
    pick = "QUALIFY row_number() OVER (PARTITION BY seq_id, strand, i % 3, stop ORDER BY i) = 1" if longest else ""
    return f"""cod AS (
    SELECT seq_id, strand, i, {at(0, 3)} AS c FROM pos
    WHERE {at(0, 3)} IN ('ATG', 'GTG', 'TTG', 'TAA', 'TAG', 'TGA')),
nxt AS (
    SELECT *, min(CASE WHEN c IN ('TAA', 'TAG', 'TGA') THEN i END) OVER (PARTITION BY seq_id, strand, i % 3 ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop
    FROM cod),
st AS (SELECT * FROM nxt WHERE c IN ('ATG', 'GTG', 'TTG') AND stop IS NOT NULL {pick}),
orf AS (
    SELECT seq_id, strand, i % 3 + 1 AS frame, {start} AS start, {end} AS "end", stop + 3 - i AS length_nt,
           (stop + 3 - i) // 3 - 1 AS peptide_length_aa, c AS start_codon, substr(s, stop + 1, 3) AS stop_codon,
           substr(s, i + 1, stop + 3 - i) AS sequence, i AS start_index_in_strand, stop AS stop_index_in_strand
    FROM st JOIN strands USING (seq_id, strand) WHERE (stop + 3 - i) // 3 - 1 >= {min_aa})"""


ORF_OUT = 'seq_id, strand, frame, start, "end", length_nt, peptide_length_aa, start_codon, stop_codon, start_index_in_strand, stop_index_in_strand, md5(sequence) AS sequence_md5'
ORF_ORDER = "peptide_length_aa DESC, CASE start_codon WHEN 'ATG' THEN 0 WHEN 'GTG' THEN 1 WHEN 'TTG' THEN 2 ELSE 3 END, CASE strand WHEN '+' THEN 0 ELSE 1 END, start, \"end\""


def nms_sql(name: str, source: str, by: str, a: str, b: str, order: str) -> str:
    """Greedy suppression as a fold over lists, one for each island of overlaps."""
    return f"""{name}_new AS (
    SELECT *, {a} AS lo, {b} AS hi, CASE WHEN max({b}) OVER (PARTITION BY {by} ORDER BY {a}, {b}, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= {a} THEN 0 ELSE 1 END AS fresh
    FROM {source}),
{name}_isl AS (SELECT *, sum(fresh) OVER (PARTITION BY {by} ORDER BY lo, hi, {order} ROWS UNBOUNDED PRECEDING) AS isl FROM {name}_new),
{name}_grp AS (SELECT list(h ORDER BY {order}) AS hs FROM (SELECT *, x AS h FROM {name}_isl x) GROUP BY {by}, isl),
{name} AS (
    SELECT k.* FROM (
        SELECT unnest(list_reduce(list_transform(hs, lambda x: [x]), lambda acc, x:
            CASE WHEN len(list_filter(acc, lambda y: y.lo <= x[1].hi AND x[1].lo <= y.hi)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS k
        FROM {name}_grp))"""


def promoters_sql(keys: str = "seq_id") -> str:
    s35, e35 = fwd("i", "i + 6")
    s10, e10 = fwd("i + 6 + sp", "i + 12 + sp")
    return f"""b35 AS (SELECT {keys}, strand, n, w, i, {ham(at(0, 6), promoters.BOX35)} AS mm35 FROM pos),
b10 AS (
    SELECT *, {ham(at("6 + sp", 6), promoters.BOX10)} AS mm10, {at(6, "sp")} AS spacer
    FROM (SELECT *, unnest(range(16, 20)) AS sp FROM b35 WHERE mm35 <= 2)),
sc AS (SELECT *, (length(spacer) - length(translate(spacer, 'AT', ''))) / CAST(sp AS DOUBLE) AS atf FROM b10 WHERE mm10 <= 2),
praw AS (
    SELECT {keys}, strand, {s35} AS box35_start, {e35} AS box35_end, {at(0, 6)} AS box35_seq, mm35 AS box35_mismatches,
           {s10} AS box10_start, {e10} AS box10_end, {at("6 + sp", 6)} AS box10_seq, mm10 AS box10_mismatches,
           sp AS spacing, spacer AS spacer_seq, floor(atf * 1000 + 0.5) / 1000 AS spacer_at_fraction,
           floor((CAST(30 AS DOUBLE) - mm35 * CAST(5 AS DOUBLE) - mm10 * CAST(6 AS DOUBLE) - abs(sp - 17) * CAST(1.5 AS DOUBLE) + atf * CAST(4 AS DOUBLE)) * 1000 + 0.5) / 1000 AS score,
           i AS i35, i + 6 + sp AS i10
    FROM sc)"""


def promoter_nms(keys: str = "seq_id") -> str:
    order = "score DESC, box10_mismatches, box35_mismatches, abs(spacing - 17), i35, i10"
    return nms_sql("prom", "praw", f"{keys}, strand", "least(box35_start, box10_start)", "greatest(box35_end, box10_end)", order)


PROM = "strand, box35_start, box35_end, box35_seq, box35_mismatches, box10_start, box10_end, box10_seq, box10_mismatches, spacing, spacer_seq, spacer_at_fraction, score"


def sd_sql(keys: str = "seq_id") -> str:
    start, end = fwd("i - d - 6", "i - d")
    linked, _ = fwd("i", "i + 3")
    return f"""sc0 AS (SELECT {keys}, strand, n, w, i, {at(0, 3)} AS c FROM pos WHERE {at(0, 3)} IN ('ATG', 'GTG', 'TTG') AND n >= 13),
sc1 AS (SELECT * EXCLUDE (w), {at("(-d - 6)", 6)} AS w FROM (SELECT *, unnest(range(4, 13)) AS d FROM sc0) WHERE i - d - 6 >= 0),
sc2 AS (
    SELECT *, {ham("w", shine_dalgarno.CONSENSUS)} AS mm,
           CAST(20 AS DOUBLE) - ({ham("w", shine_dalgarno.CONSENSUS)}) * CAST(4 AS DOUBLE) + greatest(CAST(0 AS DOUBLE), 10 - abs(d - 7) * CAST(2 AS DOUBLE))
           + CAST(CASE c WHEN 'ATG' THEN 5 WHEN 'GTG' THEN 3 ELSE 2 END AS DOUBLE) AS score
    FROM sc1),
sd AS (
    SELECT {keys}, strand, {start} AS start, {end} AS "end", w AS sequence, mm AS mismatches, c AS linked_start_codon,
           {linked} AS linked_start_position, d AS distance_to_start, score
    FROM sc2 WHERE mm <= 2
    QUALIFY row_number() OVER (PARTITION BY {keys}, strand, i ORDER BY score DESC, mm, abs(d - 7), i - d - 6) = 1)"""


SD = 'strand, start, "end", sequence, mismatches, linked_start_codon, linked_start_position, distance_to_start, score'


def t_runs_sql(keys: str = "seq_id") -> str:
    """Positions that begin five or more T: consecutive ones form an island, whose last one has exactly five."""
    return f"""five AS (
    SELECT {keys}, strand, n, i, substr(w, 1, {BEFORE}) AS w, i - row_number() OVER (PARTITION BY {keys}, strand ORDER BY i) AS island
    FROM pos WHERE {at(0, 5)} = 'TTTTT'),
runs AS (SELECT * EXCLUDE (island), max(i) OVER (PARTITION BY {keys}, strand, island) - i + 5 AS run FROM five)"""


def terminators_sql(keys: str = "seq_id") -> str:
    ls, le = fwd("i - 2 * k - l", "i - k - l")
    rs, re_ = fwd("i - k", "i")
    ps, pe = fwd("i", "i + run")
    return f"""{t_runs_sql(keys)},
arm AS (
    SELECT *, {at("(-2 * k - l)", "k")} AS le, {at("(-k)", "k")} AS ri, {at("(-k - l)", "l")} AS loop_seq
    FROM (SELECT *, unnest(range(3, 8)) AS l FROM (SELECT *, unnest(range(5, 11)) AS k FROM runs WHERE run >= 5 AND n >= 18))
    WHERE i >= 2 * k + l),
gc AS (
    SELECT *, (length(le) - length(translate(le, 'GC', ''))) / CAST(k AS DOUBLE) AS gc, hamming(le, reverse(translate(ri, 'ACGTN', 'TGCAN'))) AS mm
    FROM arm WHERE instr(le || ri, 'N') = 0),
traw AS (
    SELECT {keys}, strand, {ls} AS stem_left_start, {le} AS stem_left_end, {rs} AS stem_right_start, {re_} AS stem_right_end,
           {ps} AS poly_t_start, {pe} AS poly_t_end, le AS stem_left_seq, loop_seq, ri AS stem_right_seq, repeat('T', CAST(run AS INT)) AS poly_t_seq,
           k AS stem_length, l AS loop_length, mm AS mismatches, round_even(gc, 3) AS gc_fraction, run AS poly_t_length,
           round_even(k * CAST(2.5 AS DOUBLE) + gc * CAST(12 AS DOUBLE) + run * CAST(3 AS DOUBLE) - mm * CAST(4 AS DOUBLE) - abs(l - CAST(4.5 AS DOUBLE)) * CAST(0.8 AS DOUBLE), 3) AS score,
           i AS i_t
    FROM gc WHERE gc >= CAST(0.7 AS DOUBLE) AND mm <= 1)"""


def terminator_nms(keys: str = "seq_id") -> str:
    order = "score DESC, poly_t_start, i_t, stem_length, loop_length"
    return nms_sql("term", "traw", f"{keys}, strand", "least(stem_left_start, poly_t_start)", "greatest(stem_left_end, poly_t_end)", order)


TERM = "strand, stem_left_start, stem_left_end, stem_right_start, stem_right_end, poly_t_start, poly_t_end, stem_left_seq, loop_seq, stem_right_seq, poly_t_seq, stem_length, loop_length, mismatches, gc_fraction, poly_t_length, score"

BEST_SD = """bsd AS (
    SELECT o.*, d.mismatches AS sd_mm, d.distance_to_start AS sd_d, d.score AS sd_score FROM orf o LEFT JOIN (
        SELECT * FROM sd QUALIFY row_number() OVER (PARTITION BY seq_id, strand, linked_start_position ORDER BY score DESC, mismatches, abs(distance_to_start - 7), start) = 1) d
    ON o.seq_id = d.seq_id AND o.strand = d.strand AND o.start = d.linked_start_position)"""


def nearest_sql(name: str, hits: str, anchor: str, low: str, order: str, columns: str) -> str:
    """The first hit in ``order`` whose anchor lies among the 300 places from ``low`` on: both meet in bins of 300 places."""
    return f"""{name} AS (
    SELECT seq_id, strand, start, "end", {columns} FROM (
        SELECT o.seq_id, o.strand, o.start, o."end", o.low, h.* EXCLUDE (seq_id, strand),
               CASE WHEN (o.strand = '+') = {"TRUE" if hits == "prom" else "FALSE"} THEN o.low + 300 - h.anchor ELSE h.anchor - o.low + 1 END AS d
        FROM (SELECT *, unnest([low // 300, low // 300 + 1]) AS bin FROM (SELECT seq_id, strand, start, "end", {low} AS low FROM orf)) o
        JOIN (SELECT *, {anchor} AS anchor, ({anchor}) // 300 AS bin FROM {hits}) h
        ON o.seq_id = h.seq_id AND o.strand = h.strand AND o.bin = h.bin AND h.anchor BETWEEN o.low AND o.low + 299)
    QUALIFY row_number() OVER (PARTITION BY seq_id, strand, start, "end" ORDER BY {order}) = 1)"""


BEST_PROM = nearest_sql("bprom", "prom", "CASE WHEN strand = '+' THEN box10_end ELSE box10_start END", "CASE WHEN strand = '+' THEN start - 300 ELSE \"end\" + 1 END", "d, score DESC, box10_start, box35_start", "box10_start, box35_start, score AS p_score, d AS p_d")
BEST_TERM = nearest_sql("bterm", "term", "CASE WHEN strand = '+' THEN stem_left_start ELSE stem_right_end END", "CASE WHEN strand = '+' THEN \"end\" + 1 ELSE start - 300 END", "d, score DESC, stem_left_start, poly_t_start", "stem_left_start, poly_t_start, score AS t_score, d AS t_d")
FEATURES = f"{base()},\n{orfs_sql()},\n{promoters_sql()},\n{promoter_nms()},\n{sd_sql()},\n{terminators_sql()},\n{terminator_nms()}"
RANKED = f"""{FEATURES},\n{BEST_SD},\n{BEST_PROM},\n{BEST_TERM},
parts AS (
    SELECT b.*, p.p_d, t.t_d, p.box10_start, t.poly_t_start,
        CAST(CASE WHEN peptide_length_aa >= 300 THEN 35 WHEN peptide_length_aa >= 200 THEN 28 WHEN peptide_length_aa >= 120 THEN 20 WHEN peptide_length_aa >= 80 THEN 14 WHEN peptide_length_aa >= 50 THEN 8 ELSE 3 END AS DOUBLE) AS length_score,
        CAST(CASE start_codon WHEN 'ATG' THEN 10 WHEN 'GTG' THEN 7 WHEN 'TTG' THEN 5 ELSE 0 END AS DOUBLE) AS start_codon_score,
        CASE WHEN sd_score IS NULL THEN CAST(0 AS DOUBLE) ELSE least(sd_score + CAST(CASE WHEN sd_d BETWEEN 6 AND 9 THEN 3 WHEN sd_d BETWEEN 4 AND 12 THEN 1 ELSE 0 END AS DOUBLE), CAST(35 AS DOUBLE)) END AS shine_dalgarno_score,
        CASE WHEN p_score IS NULL THEN CAST(0 AS DOUBLE) ELSE least(p_score + CAST(CASE WHEN p_d BETWEEN 1 AND 80 THEN 6 WHEN p_d BETWEEN 81 AND 150 THEN 3 WHEN p_d BETWEEN 151 AND 300 THEN 1 ELSE 0 END AS DOUBLE), CAST(40 AS DOUBLE)) END AS promoter_score,
        CASE WHEN t_score IS NULL THEN CAST(0 AS DOUBLE) ELSE least(t_score + CAST(CASE WHEN t_d BETWEEN 1 AND 100 THEN 5 WHEN t_d BETWEEN 101 AND 250 THEN 2 ELSE 0 END AS DOUBLE), CAST(30 AS DOUBLE)) END AS terminator_score
    FROM bsd b
    LEFT JOIN bprom p ON b.seq_id = p.seq_id AND b.strand = p.strand AND b.start = p.start AND b."end" = p."end"
    LEFT JOIN bterm t ON b.seq_id = t.seq_id AND b.strand = t.strand AND b.start = t.start AND b."end" = t."end"),
ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY seq_id ORDER BY total_score DESC, round_even(shine_dalgarno_score, 3) DESC, round_even(promoter_score, 3) DESC, round_even(terminator_score, 3) DESC, length_score DESC, CASE strand WHEN '+' THEN 0 ELSE 1 END, start, {ORF_ORDER}) AS INTEGER) AS rank
    FROM (SELECT *, round_even(length_score + start_codon_score + shine_dalgarno_score + promoter_score + terminator_score, 3) AS total_score FROM parts))"""
RANK_OUT = "seq_id, rank, strand, start, \"end\", start_codon, peptide_length_aa, total_score, round_even(length_score, 3) AS length_score, round_even(start_codon_score, 3) AS start_codon_score, round_even(shine_dalgarno_score, 3) AS shine_dalgarno_score, round_even(promoter_score, 3) AS promoter_score, round_even(terminator_score, 3) AS terminator_score, box10_start, poly_t_start, sd_d"


# ---- scalars and frames --------------------------------------------------


@query("""SELECT doc_id, CAST(length(regexp_replace(upper(text), '[^ACGTN]', '', 'g')) AS BIGINT) AS kept,
           coalesce(regexp_full_match(upper(regexp_replace(text, '\\s', '', 'g')), '[ACGTN]+'), false) AS is_dna
    FROM documents""")
def clean_validate(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", F.length(dna.keep_bases(F.col("text"))).cast("long").alias("kept"), dna.is_dna(dna.clean(F.col("text"))).alias("is_dna"))


@query(f"WITH {SEQS} SELECT seq_id, md5(reverse(translate(seq, 'ACGTN', 'TGCAN'))) AS revcomp_md5, md5(translate(seq, 'ACGTN', 'TGCAN')) AS complement_md5 FROM seqs")
def reverse_complements(spark, sf_dir):
    rows = sequences(spark, sf_dir)
    return rows.select("seq_id", F.md5(dna.reverse_complement(F.col("seq"))).alias("revcomp_md5"), F.md5(dna.complement(F.col("seq"))).alias("complement_md5"))


@query(f"""WITH {SEQS} SELECT seq_id, length(seq) AS length,
           round((length(seq) - length(translate(seq, 'GC', ''))) / CAST(length(seq) AS DOUBLE) * 100, 2) AS gc_percent,
           round((length(seq) - length(translate(seq, 'AT', ''))) / CAST(length(seq) AS DOUBLE) * 100, 2) AS at_percent,
           length(seq) >= 50000 AS is_large, length(seq) >= 500000 AS is_huge FROM seqs""")
def sequence_stats(spark, sf_dir):
    return analysis.sequence_stats(sequences(spark, sf_dir))


@query(f"""WITH {SEQS}, {strands_of()},
    f AS (SELECT *, n - o - (n - o) % 3 AS u FROM (SELECT *, unnest(range(3)) AS o FROM strands))
    SELECT seq_id, strand, o + 1 AS frame, {fwd("o", "o + u")[0]} AS start, {fwd("o", "o + u")[1]} AS "end", u AS length_nt, u // 3 AS peptide_length_aa, md5(substr(s, o + 1, u)) AS sequence_md5
    FROM f WHERE u >= 3""")
def reading_frames(spark, sf_dir):
    return with_md5(strands.frames(sequences(spark, sf_dir)))


@query(f"""{base()} SELECT seq_id, strand, i % 3 + 1 AS frame, {at(0, 3)} AS codon, count(*) AS n FROM pos
    WHERE {at(0, 3)} IN ('ATG', 'GTG', 'TTG', 'TAA', 'TAG', 'TGA') GROUP BY ALL""")
def codon_scan(spark, sf_dir):
    return orfs.codons(sequences(spark, sf_dir)).groupBy("seq_id", "strand", "frame", "codon").agg(F.count("*").alias("n"))


MOTIF_AT = f"SELECT seq_id, strand, i FROM pos WHERE i + 6 <= n AND hamming({at(0, 6)}, 'AGGAGG') <= 1"


@query(f"{base()} SELECT seq_id, strand, count(*) AS n, min(i) AS first, max(i) AS last FROM ({MOTIF_AT}) GROUP BY seq_id, strand")
def motif_scan(spark, sf_dir):
    rows = strands.motif_hits(sequences(spark, sf_dir), "AGGAGG", 1)
    return rows.groupBy("seq_id", "strand").agg(F.count("*").alias("n"), F.min("i").alias("first"), F.max("i").alias("last"))


@query(f"{base()} SELECT seq_id, strand, i FROM ({MOTIF_AT}) QUALIFY row_number() OVER (PARTITION BY seq_id, strand ORDER BY i) <= 3")
def motif_positions(spark, sf_dir):
    return strands.motif_hits(sequences(spark, sf_dir), "AGGAGG", 1, max_hits=3).select("seq_id", "strand", "i")


@query(f"WITH {SEQS} SELECT 'doc' || seq_id AS header, CAST(length(seq) AS INTEGER) AS length, md5(seq) AS sequence_md5 FROM seqs")
def fasta_records(spark, sf_dir):
    """Documents as FASTA files, whose headers hold the sign that begins a record, written and read back."""
    path = scratch.fresh(spark, "fasta")
    lines = F.concat(F.lit(">doc"), F.col("seq_id").cast("string"), F.lit(" length>"), F.length("seq").cast("string"), F.lit("\n"), F.col("seq"))
    sequences(spark, sf_dir).select(lines.alias("value")).write.text(path)
    return fasta.read_fasta(spark, path).select("header", "length", F.md5("sequence").alias("sequence_md5"))


@query(f"""{base()}, {orfs_sql(longest=True)},
    aa AS (SELECT seq_id, strand, start, "end", string_agg(coalesce(m[substr(sequence, CAST(3 * k + 1 AS BIGINT), 3)], 'X'), '' ORDER BY k) AS p
           FROM (SELECT *, unnest(range(length(sequence) // 3)) AS k FROM orf), (SELECT MAP {{{CODE}}} AS m) GROUP BY ALL)
    SELECT seq_id, strand, start, "end", split_part(p, '*', 1) AS protein FROM aa""")
def translate_protein(spark, sf_dir):
    rows = orfs.coding_orfs(sequences(spark, sf_dir), longest_only_per_stop=True)
    return rows.select("seq_id", "strand", "start", "end", dna.protein(F.col("sequence")).alias("protein"))


# ---- detectors -----------------------------------------------------------


@query(f"{base()}, {orfs_sql()} SELECT {ORF_OUT} FROM orf")
def coding_orfs(spark, sf_dir):
    return with_md5(orfs.coding_orfs(sequences(spark, sf_dir)))


@query(f"{base()}, {orfs_sql(longest=True)} SELECT {ORF_OUT} FROM orf")
def coding_orfs_longest(spark, sf_dir):
    return with_md5(orfs.coding_orfs(sequences(spark, sf_dir), longest_only_per_stop=True))


@query(f"{base()}, {orfs_sql()} SELECT {ORF_OUT} FROM orf QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY {ORF_ORDER}) = 1")
def best_coding_orf(spark, sf_dir):
    return with_md5(orfs.best_orf(orfs.coding_orfs(sequences(spark, sf_dir))))


@query(f"{base()}, {promoters_sql()} SELECT seq_id, {PROM}, i35, i10 FROM praw")
def promoters_raw(spark, sf_dir):
    return promoters.raw_promoters(sequences(spark, sf_dir))


@query(f"{base()}, {promoters_sql()}, {promoter_nms()} SELECT seq_id, {PROM} FROM prom")
def promoter_hits(spark, sf_dir):
    return promoters.promoters(sequences(spark, sf_dir))


@query(f"""{base()}, {promoters_sql()}, {promoter_nms()} SELECT seq_id, {PROM}, CAST(row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, box10_mismatches, box35_mismatches, abs(spacing - 17), CASE strand WHEN '+' THEN 0 ELSE 1 END, least(box35_start, box10_start)) AS INTEGER) AS rank
    FROM prom QUALIFY rank <= 5""")
def promoter_top(spark, sf_dir):
    hits = promoters.promoters(sequences(spark, sf_dir))
    return with_rank(hits, ["seq_id"], promoters.order()).filter("rank <= 5")


@query(f"{base()}, {sd_sql()} SELECT seq_id, {SD} FROM sd")
def sd_sites(spark, sf_dir):
    return shine_dalgarno.sd_sites(sequences(spark, sf_dir))


@query(f"{base()}, {t_runs_sql()} SELECT seq_id, strand, i, run FROM runs WHERE run >= 5")
def t_runs(spark, sf_dir):
    return terminators.t_runs(sequences(spark, sf_dir)).select("seq_id", "strand", "i", "run")


@query(f"{base()}, {terminators_sql()} SELECT seq_id, {TERM}, i_t FROM traw")
def terminators_raw(spark, sf_dir):
    return terminators.raw_terminators(sequences(spark, sf_dir))


@query(f"{base()}, {terminators_sql()}, {terminator_nms()} SELECT seq_id, {TERM} FROM term")
def terminator_hits(spark, sf_dir):
    return terminators.terminators(sequences(spark, sf_dir))


# ---- joins and ranking ---------------------------------------------------


@query(f'{base()}, {orfs_sql()}, {sd_sql()}, {BEST_SD} SELECT seq_id, strand, start, "end", sd_mm, sd_d, sd_score FROM bsd')
def orf_sd_join(spark, sf_dir):
    seqs = sequences(spark, sf_dir)
    rows = ranking.best_sd(orfs.coding_orfs(seqs, texts=False), shine_dalgarno.sd_sites(seqs))
    return rows.select("seq_id", "strand", "start", "end", F.col("sd.mismatches").alias("sd_mm"), F.col("sd.distance_to_start").alias("sd_d"), F.col("sd.score").alias("sd_score"))


@query(f'{base()}, {orfs_sql()}, {promoters_sql()}, {promoter_nms()}, {BEST_PROM} SELECT o.seq_id, o.strand, o.start, o."end", box10_start, box35_start, p_score FROM orf o LEFT JOIN bprom p ON o.seq_id = p.seq_id AND o.strand = p.strand AND o.start = p.start AND o."end" = p."end"')
def orf_promoter_range_join(spark, sf_dir):
    seqs = sequences(spark, sf_dir)
    rows = ranking.best_promoter(orfs.coding_orfs(seqs, texts=False), promoters.promoters(seqs))
    return rows.select("seq_id", "strand", "start", "end", "promoter.box10_start", "promoter.box35_start", F.col("promoter.score").alias("p_score"))


@query(f'{base()}, {orfs_sql()}, {terminators_sql()}, {terminator_nms()}, {BEST_TERM} SELECT o.seq_id, o.strand, o.start, o."end", stem_left_start, poly_t_start, t_score FROM orf o LEFT JOIN bterm p ON o.seq_id = p.seq_id AND o.strand = p.strand AND o.start = p.start AND o."end" = p."end"')
def orf_terminator_range_join(spark, sf_dir):
    seqs = sequences(spark, sf_dir)
    rows = ranking.best_terminator(orfs.coding_orfs(seqs, texts=False), terminators.terminators(seqs))
    return rows.select("seq_id", "strand", "start", "end", "terminator.stem_left_start", "terminator.poly_t_start", F.col("terminator.score").alias("t_score"))


def _flat(ranked):
    return ranked.select(
        "seq_id", "rank", "orf.strand", "orf.start", "orf.end", "orf.start_codon", "orf.peptide_length_aa", "total_score", "score_breakdown.*",
        "best_promoter.box10_start", "best_terminator.poly_t_start", F.col("best_shine_dalgarno.distance_to_start").alias("sd_d"),
    )


@query(f"{RANKED} SELECT {RANK_OUT} FROM ranked")
def ranked_orfs(spark, sf_dir):
    return _flat(analysis.Analysis(sequences(spark, sf_dir)).ranked_coding_orfs(texts=False))


@query(f"{RANKED} SELECT {RANK_OUT} FROM ranked WHERE rank = 1")
def best_ranked_orf(spark, sf_dir):
    return _flat(ranking.best_ranked(analysis.Analysis(sequences(spark, sf_dir)).ranked_coding_orfs(texts=False)))


@query(f"{RANKED} SELECT seq_id, CASE WHEN total_score >= 50 THEN 'high' WHEN total_score >= 30 THEN 'medium' ELSE 'low' END AS confidence, count(*) AS n FROM ranked WHERE total_score >= 8 GROUP BY ALL")
def confidence_buckets(spark, sf_dir):
    return ranking.confidence_counts(analysis.Analysis(sequences(spark, sf_dir)).ranked_coding_orfs(texts=False))


@query(f"""{FEATURES}
    SELECT seq_id, CAST((n - n % 3 >= 3)::INT + (n - 1 - (n - 1) % 3 >= 3)::INT + (n - 2 - (n - 2) % 3 >= 3)::INT AS BIGINT) * 2 AS orfs,
           coalesce(p, 0) AS promoters, coalesce(t, 0) AS terminators, coalesce(d, 0) AS shine_dalgarno, coalesce(c, 0) AS coding_orfs
    FROM (SELECT seq_id, length(seq) AS n FROM seqs)
    LEFT JOIN (SELECT seq_id, count(*) AS p FROM prom GROUP BY seq_id) USING (seq_id)
    LEFT JOIN (SELECT seq_id, count(*) AS t FROM term GROUP BY seq_id) USING (seq_id)
    LEFT JOIN (SELECT seq_id, count(*) AS d FROM sd GROUP BY seq_id) USING (seq_id)
    LEFT JOIN (SELECT seq_id, count(*) AS c FROM orf GROUP BY seq_id) USING (seq_id)""")
def summary_counts(spark, sf_dir):
    return analysis.Analysis(sequences(spark, sf_dir)).summary()


# ---- chunks --------------------------------------------------------------

CHUNKS = f"""chunked AS (
    SELECT seq_id, c AS chunk_id, c * {CHUNK - OVERLAP} + 1 AS chunk_start, least(c * {CHUNK - OVERLAP} + {CHUNK}, length(seq)) AS chunk_end, substr(seq, c * {CHUNK - OVERLAP} + 1, {CHUNK}) AS seq
    FROM (SELECT *, unnest(range(greatest(0, CAST(ceil((length(seq) - {CHUNK}) / {CHUNK - OVERLAP}) AS BIGINT)) + 1)) AS c FROM seqs))"""
CHUNK_KEYS = "seq_id, chunk_id, chunk_start"
CHUNK_BASE = f"WITH {SEQS},\n{CHUNKS},\n{strands_of('chunked', CHUNK_KEYS)},\n{positions_of(CHUNK_KEYS)}"


def chunk_out(source: str, columns: str, module: str) -> str:
    moved = ", ".join(f'{c} + chunk_start - 1 AS {c}' if c.strip('"') in chunks.POSITIONS[module] else c for c in columns.split(", "))
    same = ", ".join(f'"{c}"' for c in chunks.IDENTITY[module])
    return f"SELECT seq_id, {columns} FROM (SELECT seq_id, chunk_id, {moved} FROM {source}) QUALIFY row_number() OVER (PARTITION BY seq_id, {same} ORDER BY score DESC, chunk_id) = 1"


@query(f"WITH {SEQS}, {CHUNKS} SELECT seq_id, chunk_id, chunk_start, chunk_end, md5(seq) AS seq_md5 FROM chunked")
def chunk_tiles(spark, sf_dir):
    return with_md5(chunks.chunks(sequences(spark, sf_dir), CHUNK, OVERLAP), "seq")


@query(f"{CHUNK_BASE}, {promoters_sql(CHUNK_KEYS)}, {promoter_nms(CHUNK_KEYS)} {chunk_out('prom', PROM, 'promoters')}")
def chunked_promoters(spark, sf_dir):
    return chunks.chunked_features(sequences(spark, sf_dir), "promoters", CHUNK, OVERLAP)


@query(f"{CHUNK_BASE}, {sd_sql(CHUNK_KEYS)} {chunk_out('sd', SD, 'sd_sites')}")
def chunked_sd_sites(spark, sf_dir):
    return chunks.chunked_features(sequences(spark, sf_dir), "sd_sites", CHUNK, OVERLAP)


@query(f"{CHUNK_BASE}, {terminators_sql(CHUNK_KEYS)}, {terminator_nms(CHUNK_KEYS)} {chunk_out('term', TERM, 'terminators')}")
def chunked_terminators(spark, sf_dir):
    return chunks.chunked_features(sequences(spark, sf_dir), "terminators", CHUNK, OVERLAP)


@query(f"""WITH {SEQS}, win AS (SELECT seq_id, substr(seq, 101, 400) AS seq FROM seqs), {strands_of('win')},
    {positions_of()}, {sd_sql()}
    SELECT seq_id, strand, start + 100 AS start, "end" + 100 AS "end", sequence, mismatches, linked_start_codon, linked_start_position + 100 AS linked_start_position, distance_to_start, score FROM sd""")
def window_sd_sites(spark, sf_dir):
    return chunks.window_features(sequences(spark, sf_dir), 101, 500, "sd_sites")


@query(f"""WITH {SEQS}, win AS (SELECT seq_id, substr(seq, 101, 400) AS seq FROM seqs), {strands_of('win')},
    {positions_of()}, {orfs_sql()}
    SELECT seq_id, strand, frame, start + 100 AS start, "end" + 100 AS "end", md5(sequence) AS sequence_md5 FROM orf""")
def window_coding_orfs(spark, sf_dir):
    rows = chunks.window_features(sequences(spark, sf_dir), 101, 500, "coding_orfs")
    return with_md5(rows.select("seq_id", "strand", "frame", "start", "end", "sequence"))


@query(f"""{base()}, {terminators_sql()}, {terminator_nms()} SELECT seq_id, {TERM}, CAST(row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, poly_t_length DESC, stem_length DESC, mismatches, loop_length, CASE strand WHEN '+' THEN 0 ELSE 1 END, least(stem_left_start, poly_t_start), poly_t_start, stem_left_start) AS INTEGER) AS rank FROM term""")
def terminators_in_order(spark, sf_dir):
    hits = terminators.terminators(sequences(spark, sf_dir))
    return with_rank(hits, ["seq_id"], [*terminators.order(), F.asc("poly_t_start"), F.asc("stem_left_start")])


def report_sql(kind: str, source: str, order: str) -> str:
    """The lines of a report as SQL: the template's columns between its words."""
    what, one, none, lines = reports.REPORTS[kind]
    fill = lambda t: "'" + re.sub(r"[{](\w+)[}]", r"' || CAST(\1 AS VARCHAR) || '", t).replace("CAST(end AS", 'CAST("end" AS') + "'"
    body = " || ".join(f"chr(10) || '  {label}' || {fill(t)}" for label, t in lines)
    return f"""rep AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY {order}) AS rank FROM {source})
    SELECT seq_id, CAST(rank AS INTEGER) AS rank, '{one} ' || rank || {body} || chr(10) AS line FROM rep
    UNION ALL SELECT seq_id, 0, CASE WHEN n > 0 THEN 'Detected ' || n || ' {what}:' || chr(10) ELSE '{none}' END
    FROM (SELECT seqs.seq_id, (SELECT count(*) FROM {source} x WHERE x.seq_id = seqs.seq_id) AS n FROM seqs)"""


@query(f"""{base()}, {sd_sql()}, {report_sql("sd_sites", "sd", "score DESC, mismatches, abs(distance_to_start - 7), CASE linked_start_codon WHEN 'ATG' THEN 0 WHEN 'GTG' THEN 1 ELSE 2 END, CASE strand WHEN '+' THEN 0 ELSE 1 END, start, linked_start_position")}""")
def sd_text_report(spark, sf_dir):
    seqs = sequences(spark, sf_dir)
    return reports.report(shine_dalgarno.sd_sites(seqs), "sd_sites", [*shine_dalgarno.order(), F.asc("linked_start_position")], seqs)


# ---- similarity, tracks, pages, reports ----------------------------------


MET = f"""{RANKED},
    aa AS (SELECT seq_id, rank, string_agg(coalesce(m[substr(sequence, CAST(3 * k + 1 AS BIGINT), 3)], 'X'), '' ORDER BY k) AS p
           FROM (SELECT *, unnest(range(length(sequence) // 3)) AS k FROM ranked WHERE rank <= 500), (SELECT MAP {{{CODE}}} AS m) GROUP BY ALL),
    pr AS (SELECT seq_id, rank, p, list_distinct(list_transform(range(1, greatest(length(p) - 1, 1)), lambda i: substr(p, i, 3))) AS w
           FROM (SELECT seq_id, rank, split_part(p, '*', 1) AS p FROM aa) WHERE p <> ''),
    met AS (SELECT a.seq_id, a.rank AS i, b.rank AS j, a.p AS pa, b.p AS pb, len(list_intersect(a.w, b.w)) AS c, len(a.w) AS x, len(b.w) AS y
             FROM pr a JOIN pr b ON a.seq_id = b.seq_id AND a.rank < b.rank AND least(length(a.p), length(b.p)) / greatest(length(a.p), length(b.p)) >= 0.8)"""


@query(f"{MET} SELECT seq_id, i, j, c / CAST(x + y - c AS DOUBLE) AS jaccard FROM met WHERE c > 0 AND c / CAST(x + y - c AS DOUBLE) >= 0.5")
def kmer_jaccard_pairs(spark, sf_dir):
    return similarity.kmer_pairs(similarity.proteins(analysis.Analysis(sequences(spark, sf_dir)).ranked_coding_orfs(most=similarity.MOST)))


def alignment_sql(source: str) -> str:
    """Global alignments of proteins pa and pb as a fold over anti-diagonals.

    A cell is one number: its score, which way it was reached (diagonal before
    up before left), and the matches and the length on that way. A protein
    inside the other needs no table: its alignments reach the score that the
    lengths allow, which all have its matches and the other's length.
    """
    unit, way = 1 << 30, 1 << 28  # of score; of way; matches and length take 14 bits each
    diagonal = f"s.a[k] + CASE WHEN x[k] = y[d - k] THEN {2 * unit + (1 << 14)} ELSE -{unit} END + {2 * way + 1}"
    return f"""both_p AS (SELECT *, length(pa) AS n, length(pb) AS m FROM {source}),
    table_p AS (
        SELECT seq_id, i, j, list_reduce(range(1, n + m + 1), lambda s, d: {{'a': s.b, 'b': list_transform(list_transform(range(0, n + 1),
                   lambda k: CASE WHEN d - k BETWEEN 0 AND m THEN greatest({diagonal}, s.b[k] - {2 * unit - way - 1}, s.b[k + 1] - {2 * unit - 1}) END),
                   lambda v: v - ((v >> 28) & 3) * {way})}}, {{'a': NULL::BIGINT[], 'b': [CAST(0 AS BIGINT)]}}).b[n + 1] AS v
        FROM (SELECT seq_id, i, j, n, m, string_split(pa, '') AS x, string_split(pb, '') AS y FROM both_p WHERE NOT contains(pa, pb) AND NOT contains(pb, pa))),
    aligned_p AS (
        SELECT seq_id, i, j, v >> 30 AS score, (v >> 14) & 16383 AS matches, v & 16383 AS length FROM table_p
        UNION ALL SELECT seq_id, i, j, 2 * least(n, m) - 2 * abs(n - m), least(n, m), greatest(n, m) FROM both_p WHERE contains(pa, pb) OR contains(pb, pa))"""


def clusters_sql(identity: float = 0.9) -> str:
    """Greedy clusters: a fold over the seeds of a sequence, whose free partners each takes."""
    free = "list_filter(x.js, lambda j: NOT list_contains(s.taken, j))"
    return f"""close_p AS (
        SELECT * FROM met WHERE c / CAST(x + y - c AS DOUBLE) >= 0.5 AND least(length(pa), length(pb)) / greatest(length(pa), length(pb)) >= CAST({identity} AS DOUBLE)),
    {alignment_sql("close_p")},
    seeds AS (
        SELECT seq_id, i AS seed, list(CAST(j AS INTEGER) ORDER BY j) AS js FROM aligned_p WHERE matches / CAST(length AS DOUBLE) >= CAST({identity} AS DOUBLE) GROUP BY seq_id, i),
    folded AS (
        SELECT seq_id, list_reduce(list({{'seed': seed, 'js': js}} ORDER BY seed),
            lambda s, x: CASE WHEN list_contains(s.taken, x.seed) OR len({free}) = 0 THEN s
                              ELSE {{'taken': list_concat(s.taken, [x.seed], {free}), 'found': list_concat(s.found, [{{'seed': x.seed, 'js': {free}}}])}} END,
            {{'taken': []::INTEGER[], 'found': []::STRUCT(seed INTEGER, js INTEGER[])[]}}).found AS found
        FROM seeds GROUP BY seq_id),
    stars AS (SELECT seq_id, unnest(range(1, len(found) + 1)) AS cluster_id, unnest(found) AS f FROM folded)"""


@query(f"""{MET}, {clusters_sql()},
    members AS (
        SELECT seq_id, cluster_id, f.seed AS seed, unnest(list_concat([f.seed], f.js)) AS rank FROM stars),
    full_m AS (SELECT m.cluster_id, m.seed, r.* FROM members m JOIN ranked r ON m.seq_id = r.seq_id AND m.rank = r.rank)
    SELECT seq_id, cluster_id, CAST(90 AS DOUBLE) AS identity_threshold, count(*) AS orf_count, 'ORF_' || min_by(rank, (-total_score, rank)) AS best_orf_uid,
           min_by(start, (-total_score, rank)) AS best_orf_start, min_by("end", (-total_score, rank)) AS best_orf_end, min_by(strand, (-total_score, rank)) AS best_orf_strand,
           max(total_score) AS best_orf_score, string_agg('ORF_' || rank, ',' ORDER BY rank) AS members
    FROM full_m GROUP BY seq_id, cluster_id""")
def orf_clusters(spark, sf_dir):
    rows = analysis.Analysis(sequences(spark, sf_dir)).orf_clusters()
    return rows.withColumn("members", F.array_join(F.transform("orfs", lambda o: o["orf_uid"]), ",")).drop("orfs", "alignments")


@query(f"""{MET}, {clusters_sql()},
    taken AS (SELECT seq_id, cluster_id, f.seed AS i, unnest(f.js) AS j FROM stars)
    SELECT t.seq_id, cluster_id, 'ORF_' || i AS orf_uid_1, 'ORF_' || j AS orf_uid_2, CAST(score AS INTEGER) AS alignment_score, CAST(matches AS INTEGER) AS matches, CAST(length AS INTEGER) AS alignment_length
    FROM taken t JOIN aligned_p USING (seq_id, i, j)""")
def cluster_alignments(spark, sf_dir):
    """The global alignment of each cluster's seed with its other members."""
    rows = analysis.Analysis(sequences(spark, sf_dir)).orf_clusters().select("seq_id", "cluster_id", F.inline("alignments"))
    return rows.select("seq_id", "cluster_id", "orf_uid_1", "orf_uid_2", "alignment_score", "matches", "alignment_length")


@query(f"""{base()}, {promoters_sql()}, {promoter_nms()}, {terminators_sql()}, {terminator_nms()},
    iv AS (SELECT seq_id, strand, 2 AS k, 'box35' AS type, box35_start AS a, box35_end AS b FROM prom
           UNION ALL SELECT seq_id, strand, 3, 'box10', box10_start, box10_end FROM prom
           UNION ALL SELECT seq_id, strand, 4, 'terminatorLeft', stem_left_start, stem_left_end FROM term
           UNION ALL SELECT seq_id, strand, 5, 'terminatorRight', stem_right_start, stem_right_end FROM term
           UNION ALL SELECT seq_id, strand, 6, 'polyT', poly_t_start, poly_t_end FROM term)
    SELECT seq_id, strand, position, min_by(type, k) AS type FROM (SELECT *, unnest(range(a, b + 1)) AS position FROM iv) GROUP BY seq_id, strand, position""")
def highlights(spark, sf_dir):
    seqs = sequences(spark, sf_dir)
    rows = tracks.tracks(promoters.promoters(seqs), "promoters").unionByName(tracks.tracks(terminators.terminators(seqs), "terminators"))
    return tracks.covered_positions(rows)


@query("SELECT event_id, user_id, event_type, value FROM events ORDER BY value DESC, event_id LIMIT 50 OFFSET 40")
def results_page(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    return page(rows, 50, 40, "value", "desc", ["event_id"])


@query(f"""WITH {SEQS} SELECT seq_id, off + 1 AS start, substr(seq, off + 1, 60) AS top, translate(substr(seq, off + 1, 60), 'ACGTN', 'TGCAN') AS bottom
    FROM (SELECT *, unnest(range(0, length(seq), 60)) AS off FROM seqs)""")
def double_strand_blocks(spark, sf_dir):
    return reports.double_strand(sequences(spark, sf_dir))


@query(f"""{base()}, {sd_sql()}, r AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, mismatches, abs(distance_to_start - 7), CASE linked_start_codon WHEN 'ATG' THEN 0 WHEN 'GTG' THEN 1 ELSE 2 END, CASE strand WHEN '+' THEN 0 ELSE 1 END, start, linked_start_position) AS rank FROM sd)
    SELECT seq_id, CAST(rank AS INTEGER) AS rank, 'Site ' || rank || ' | strand: ' || strand || ' | start: ' || start || ' | sequence: ' || sequence AS line FROM r""")
def sd_report(spark, sf_dir):
    rows = shine_dalgarno.sd_sites(sequences(spark, sf_dir))
    return reports.feature_lines(rows, "Site", [*shine_dalgarno.order(), F.asc("linked_start_position")], ["strand", "start", "sequence"])


# ---- viewports, documents, stored runs, single values --------------------

VIEW, SHIFT = 240, 200


@query(f"""{base()}, {orfs_sql()}, {sd_sql()}, {promoters_sql()}, {promoter_nms()}, {terminators_sql()}, {terminator_nms()},
    iv AS (SELECT seq_id, strand, 'orf' AS type, start, "end" FROM orf
           UNION ALL SELECT seq_id, strand, 'shineDalgarno', start, "end" FROM sd
           UNION ALL SELECT seq_id, strand, 'startCodon', linked_start_position, linked_start_position + 2 FROM sd
           UNION ALL SELECT seq_id, strand, 'box35', box35_start, box35_end FROM prom
           UNION ALL SELECT seq_id, strand, 'box10', box10_start, box10_end FROM prom
           UNION ALL SELECT seq_id, strand, 'terminatorLeft', stem_left_start, stem_left_end FROM term
           UNION ALL SELECT seq_id, strand, 'terminatorRight', stem_right_start, stem_right_end FROM term
           UNION ALL SELECT seq_id, strand, 'polyT', poly_t_start, poly_t_end FROM term),
    views AS (SELECT seq_id, v AS range_id, v * {SHIFT} + 1 AS first, least(v * {SHIFT} + {VIEW}, n) AS last
              FROM (SELECT seq_id, length(seq) AS n, unnest(range((length(seq) - 1) // {SHIFT} + 1)) AS v FROM seqs))
    SELECT v.seq_id, range_id, strand, type, count(*) AS n, min(greatest(start, first)) AS first_shown, max(least("end", last)) AS last_shown, sum(least("end", last) - greatest(start, first) + 1)::BIGINT AS bases
    FROM views v JOIN iv ON v.seq_id = iv.seq_id AND start <= last AND "end" >= first GROUP BY ALL""")
def visible_tracks(spark, sf_dir):
    """Tracks of all four kinds of features in overlapping viewports along each sequence."""
    seqs = sequences(spark, sf_dir)
    found = {"coding_orfs": orfs.coding_orfs(seqs, texts=False), "sd_sites": shine_dalgarno.sd_sites(seqs), "promoters": promoters.promoters(seqs), "terminators": terminators.terminators(seqs)}
    rows = [tracks.tracks(features, module) for module, features in found.items()]
    n = F.length("seq").cast("long")
    views = seqs.select("seq_id", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / SHIFT))).alias("range_id"))
    views = views.select("seq_id", "range_id", (F.col("range_id") * SHIFT + 1).alias("first"), F.least(F.col("range_id") * SHIFT + VIEW, "n").alias("last"))
    seen = tracks.visible_in(views, rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]))
    bases = F.sum(F.col("shown_end") - F.col("shown_start") + 1)
    return seen.groupBy("seq_id", "range_id", "strand", "type").agg(F.count("*").alias("n"), F.min("shown_start").alias("first_shown"), F.max("shown_end").alias("last_shown"), bases.alias("bases"))


def item_sql(section: str, columns: str) -> str:
    """An item of a document as SQL: its labels, templates and double strands."""
    heading, name, lines = document.SECTIONS[section]
    known, width = columns.replace('"', "").split(", "), document.WIDTH
    size = f"least({width}, length(sequence) - o)"
    span = f"(o + 1) || '-' || (o + {size})"
    block = f"'    5'' ' || substr(sequence, o + 1, {width}) || ' 3''   [' || {span} || ']' || chr(10) || '       ' || repeat('|', CAST({size} AS INT)) || chr(10) || '    3'' ' || translate(substr(sequence, o + 1, {width}), 'ACGTN', 'TGCAN') || ' 5''' || chr(10) || chr(10)"

    def value(m):
        column = f'CAST("{m[1]}" AS VARCHAR)'
        column = f"regexp_replace({column}, '[.]0$', '')" if m[1] in ("score", "spacer_at_fraction") else column
        return f"' || coalesce(nullif({column}, ''), '{m[2] or document.NOTHING}') || '"

    text = [f"'{heading}' || chr(10) || '{document.RULE}'" if name is None else f"'{name} ' || item"]
    for label, template in lines:
        if template is None:
            text.append(f"'  {label}:' || chr(10) || array_to_string(list_transform(range(0, length(sequence), {width}), lambda o: {block}), '') ")
        elif all(c in known for c in document.columns_of(template)):
            text.append(f"'  {label}: " + re.sub(r"[{](\w+)(?:[?]([^}]*))?[}]", value, template) + "' || chr(10)")
    return text[0] + " || chr(10) || " + " || ".join(text[1:]) + " || chr(10)"


#: By section of a document: its source, its columns, and the order of its items.
DOCUMENT = {
    "orfs": ("frames6", 'strand, frame, start, "end", length_nt, peptide_length_aa, sequence', "CASE strand WHEN '+' THEN 0 ELSE 1 END, frame"),
    "coding_orfs": ("orf", 'strand, frame, start, "end", length_nt, peptide_length_aa, start_codon, stop_codon, sequence', f"{ORF_ORDER}, frame"),
    "promoters": ("prom", PROM, "score DESC, box10_mismatches, box35_mismatches, abs(spacing - 17), CASE strand WHEN '+' THEN 0 ELSE 1 END, least(box35_start, box10_start), box35_start, box10_start"),
    "terminators": ("term", TERM, "score DESC, poly_t_length DESC, stem_length DESC, mismatches, loop_length, CASE strand WHEN '+' THEN 0 ELSE 1 END, least(stem_left_start, poly_t_start), poly_t_start, stem_left_start"),
    "shine_dalgarno": ("sd", SD, "score DESC, mismatches, abs(distance_to_start - 7), CASE linked_start_codon WHEN 'ATG' THEN 0 WHEN 'GTG' THEN 1 ELSE 2 END, CASE strand WHEN '+' THEN 0 ELSE 1 END, start, linked_start_position"),
}
FRAMES6 = f"""frames6 AS (
    SELECT seq_id, strand, o + 1 AS frame, {fwd("o", "o + u")[0]} AS start, {fwd("o", "o + u")[1]} AS "end", u AS length_nt, u // 3 AS peptide_length_aa, substr(s, o + 1, u) AS sequence
    FROM (SELECT *, n - o - (n - o) % 3 AS u FROM (SELECT *, unnest(range(3)) AS o FROM strands)) WHERE u >= 3)"""


def document_sql() -> str:
    title = " || chr(10) || ".join(f"'{x}'" for x in document.TITLE)
    parts = [f"SELECT seq_id, 0 AS section, 0 AS item, {title} || chr(10) || chr(10) AS text FROM seqs"]
    for section, (source, columns, order) in DOCUMENT.items():
        k, ranked = document.ORDER[section], f"(SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY {order}) AS item FROM {source})"
        parts.append(f"SELECT seq_id, {k}, item, {item_sql(section, columns)} FROM {ranked}")
        if section == "coding_orfs":
            parts.append(f"SELECT seq_id, {document.ORDER['best']}, item, {item_sql('best', columns)} FROM {ranked} WHERE item = 1")
        parts.append(f"SELECT seqs.seq_id, {k}, 0, '{document.SECTIONS[section][0]} (' || count(x.seq_id) || ')' || chr(10) || '{document.RULE}' || chr(10) FROM seqs LEFT JOIN {source} x ON x.seq_id = seqs.seq_id GROUP BY seqs.seq_id")
    return f"""doc AS ({" UNION ALL ".join(parts)}),
    trimmed AS (SELECT *, CASE WHEN (section, item) = max((section, item)) OVER (PARTITION BY seq_id) THEN regexp_replace(text, '\\s+$', '') ELSE text END AS t FROM doc)
    SELECT seq_id, CAST(section AS INTEGER) AS section, CAST(item AS INTEGER) AS item, CAST(length(t) AS INTEGER) AS length, md5(t) AS text_md5 FROM trimmed"""


@query(f"{FEATURES}, {FRAMES6}, {document_sql()}")
def result_document(spark, sf_dir):
    """The parts of every sequence's result document, in order."""
    seqs = sequences(spark, sf_dir)
    found = {"orfs": strands.frames(seqs), "coding_orfs": orfs.coding_orfs(seqs), "promoters": promoters.promoters(seqs), "terminators": terminators.terminators(seqs), "shine_dalgarno": shine_dalgarno.sd_sites(seqs)}
    return document.document(seqs, found).select("seq_id", "section", "item", F.length("text").alias("length"), F.md5("text").alias("text_md5"))


def counted(name: str) -> str:
    return f"(SELECT count(*) FROM ({ORACLE_SQL[name]}))"


@query(f"""SELECT module, status, CAST(rows AS BIGINT) AS rows, CAST(again AS BIGINT) AS again FROM (VALUES
    ('coding_orfs', 'done', {counted("coding_orfs")}, 0), ('promoters', 'done', {counted("chunked_promoters")}, 0), ('shine_dalgarno', 'done', {counted("chunked_sd_sites")}, 0),
    ('terminators', 'done', {counted("chunked_terminators")}, 0), ('ranking', 'done', {counted("coding_orfs")}, 0), ('aligned_orfs', 'pending', 0, 0)) t(module, status, rows, again)""")
def stored_states(spark, sf_dir):
    """A stored run: the state of its modules, their rows, and which of them a second run works on."""
    store = ResultStore(spark, scratch.fresh(spark, "results"))
    run = stored_run.StoredRun(store, sequences(spark, sf_dir), chunk_size=CHUNK, overlap=OVERLAP)
    name = run.begin()
    run.run(name)
    again = run.run(name)
    held = {"ranking": "ranked_coding_orfs", "aligned_orfs": "orf_alignment"}
    rows = [(m, s, store.count(name, held.get(m, m)), int(m in again)) for m, s in store.get(name)["modules"].items()]
    return spark.createDataFrame(rows, "module string, status string, rows long, again long")


@query(f"""WITH {SEQS}, p AS (SELECT seq_id, seq, length(seq) AS n, seq_id % 50 - 5 AS k FROM seqs)
    SELECT seq_id, CAST(hamming(substr(seq, 41, 30), substr(seq, 45, 30)) AS INTEGER) AS shifted, CAST(CASE WHEN k >= 0 AND k + 6 <= n THEN hamming(substr(seq, k + 1, 6), 'TTGACA') ELSE -1 END AS INTEGER) AS motif,
           substr(seq, greatest(k, 0) + 1, greatest(least(k + 9, n) - greatest(k, 0), 0)) AS fragment, md5(regexp_replace(regexp_replace(seq, '(.{{80}})', '\\1' || chr(10), 'g'), chr(10) || '$', '')) AS wrapped_md5,
           CAST(CASE WHEN k >= 20 THEN 5 WHEN k >= 15 THEN 4 WHEN k >= 10 THEN 3 WHEN k >= 5 THEN 2 ELSE 1 END AS INTEGER) AS stars, CASE WHEN n <= 5000 THEN md5(seq) ELSE md5(substr(seq, 1, 5000) || '...') END AS preview_md5,
           CASE WHEN seq_id % 2 = 0 THEN k + 2 ELSE k END || '-' || CASE WHEN seq_id % 2 = 0 THEN k ELSE k + 2 END AS shown_codon,
           len(list_intersect(list_transform(range(41, 69), lambda i: substr(seq, i, 3)), list_transform(range(61, 89), lambda i: substr(seq, i, 3)))) / CAST(len(list_distinct(list_transform(list_concat(range(41, 69), range(61, 89)), lambda i: substr(seq, i, 3)))) AS DOUBLE) AS jaccard
    FROM p""")
def single_values(spark, sf_dir):
    """Distances, fragments, wrapping, stars, previews, shown codons and set similarity of each sequence."""
    s, k = F.col("seq"), F.col("seq_id") % 50 - 5
    some = lambda at: F.substring(s, at, 30)
    return sequences(spark, sf_dir).select(
        "seq_id",
        dna.hamming(some(41), some(45)).cast("int").alias("shifted"),
        dna.motif_mismatches_at(s, k, "TTGACA").alias("motif"),
        dna.fragment(s, k, k + 9).alias("fragment"),
        F.md5(dna.wrapped(s, 80)).alias("wrapped_md5"),
        dna.stars(k).alias("stars"),
        F.md5(dna.preview(s, 5_000)).alias("preview_md5"),
        tracks.display_codon_range(F.when(F.col("seq_id") % 2 == 0, "-").otherwise("+"), k).alias("shown_codon"),
        dna.jaccard(dna.kmers(some(41)), dna.kmers(some(61))).alias("jaccard"),
    )


# ---- sources and stores, written and read back ---------------------------


@query(f"""WITH {SEQS} SELECT CASE WHEN seq_id % 3 = 0 THEN 'unknown' ELSE 'f' || seq_id END AS file, CASE WHEN seq_id % 3 = 2 THEN 'h' || seq_id END AS header, md5(seq) AS sequence_md5, CAST(count(*) AS BIGINT) AS n FROM seqs GROUP BY ALL""")
def request_sequences(spark, sf_dir):
    """Sequences as JSON requests, single ones and folders of named files, written and read back."""
    path = scratch.fresh(spark, "requests")
    file = F.struct(F.concat(F.lit("f"), F.col("seq_id").cast("string")).alias("name"), F.lower("seq").alias("sequence"), F.when(F.col("seq_id") % 3 == 2, F.concat(F.lit("h"), F.col("seq_id").cast("string"))).alias("header"))
    alone = F.col("seq_id") % 3 == 0
    request = F.struct(F.when(alone, "single").otherwise("folder").alias("mode"), F.when(alone, F.col("seq")).alias("sequence"), F.when(~alone, F.array(file)).alias("files"))
    sequences(spark, sf_dir).select(F.to_json(request).alias("value")).write.text(path)
    return fasta.read_requests(spark, path, lines=True).groupBy("file", "header", F.md5("sequence").alias("sequence_md5")).agg(F.count("*").alias("n"))


def fasta_files(spark, sf_dir) -> str:
    """FASTA files of 25 sequences each, in folders bucket=…; gives their path."""
    path = scratch.fresh(spark, "files")
    rows = sequences(spark, sf_dir).withColumn("bucket", F.floor(F.col("seq_id") / 25))
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "seq_id")
    rows.select("bucket", F.concat(F.lit(">doc"), F.col("seq_id").cast("string"), F.lit("\n"), dna.wrapped(F.col("seq"), 80))).write.partitionBy("bucket").text(path)
    return path


@query(f"""WITH {SEQS}, b AS (SELECT *, seq_id // 25 AS bucket FROM seqs)
    SELECT CAST(bucket AS BIGINT) AS bucket, count(*) AS records, 'doc' || min(seq_id) AS first_header, md5(min_by(seq, seq_id)) AS first_md5 FROM b GROUP BY bucket""")
def fasta_first_records(spark, sf_dir):
    """The number of records and the first one of each FASTA file."""
    records = fasta.read_fasta(spark, f"{fasta_files(spark, sf_dir)}/*")
    first = fasta.counted_records(records)
    return first.select(F.regexp_extract("path", r"bucket=(\d+)", 1).cast("long").alias("bucket"), "records", F.col("header").alias("first_header"), F.md5("sequence").alias("first_md5"))


@query(f"""WITH {SEQS} SELECT md5(string_agg(seq, '' ORDER BY seq_id)) AS joined_md5, CAST(sum(length(seq)) AS BIGINT) AS length FROM seqs GROUP BY seq_id // 25""")
def fasta_joined_records(spark, sf_dir):
    """All records of each FASTA file as one sequence."""
    rows = fasta.read_joined(spark, f"{fasta_files(spark, sf_dir)}/*")
    return rows.select(F.md5("sequence").alias("joined_md5"), F.length("sequence").cast("long").alias("length"))


@query(ORACLE_SQL["results_page"])
def stored_page(spark, sf_dir):
    """The page of results_page, from a store that is clustered by its order."""
    store = ResultStore(spark, scratch.fresh(spark, "page"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    store.replace("events", "rejected", rows, sort="value")
    return store.page("events", "rejected", limit=50, skip=40, sort_field="value", sort_direction="desc", ties=["event_id"]).select("event_id", "user_id", "event_type", "value")
