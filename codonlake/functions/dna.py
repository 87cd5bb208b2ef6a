"""Column expressions over DNA and protein strings; all run inside the JVM."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

START_CODONS = ("ATG", "GTG", "TTG")
STOP_CODONS = ("TAA", "TAG", "TGA")
BASES = "TCAG"
#: Amino acids of the standard genetic code, codons in the order TTT, TTC, TTA, TTG, TCT ... GGG (fixed values).
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def clean(seq: Column) -> Column:
    """Upper case without white space."""
    return F.upper(F.regexp_replace(seq, r"\s", ""))


def keep_bases(seq: Column) -> Column:
    """Everything but A, C, G, T and N taken out."""
    return F.regexp_replace(F.upper(seq), "[^ACGTN]", "")


def is_dna(seq: Column) -> Column:
    return F.coalesce(seq.rlike("^[ACGTN]+$"), F.lit(False))


def invalid_characters(seq: Column) -> Column:
    """Sorted characters that are no DNA, as an array."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(seq, "[ACGTN]", ""), ""), lambda c: c != "")))


def dna_error(seq: Column) -> Column:
    """What is wrong with a cleaned sequence; null if nothing is."""
    bad = F.concat(F.lit("Invalid DNA characters found: "), F.array_join(invalid_characters(seq), ", "))
    return F.when(F.coalesce(F.length(seq), F.lit(0)) == 0, "Sequence is empty.").when(~is_dna(seq), bad)


def require_dna(seq: Column) -> Column:
    """The sequence itself; the query fails on an empty or invalid one."""
    return F.when(dna_error(seq).isNull(), seq).otherwise(F.raise_error(dna_error(seq)))


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGTUN", "TGCAAN")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTN", "TGCAN"))


def count_of(seq: Column, letters: str) -> Column:
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def fraction_of(seq: Column, letters: str) -> Column:
    """Share of the given letters; 0.0 for an empty sequence."""
    return F.coalesce(count_of(seq, letters) / F.nullif(F.length(seq), F.lit(0)), F.lit(0.0))


def percent_of(seq: Column, letters: str) -> Column:
    return F.round(fraction_of(seq, letters) * 100, 2)


def hamming(a: Column, b: Column) -> Column:
    """Differing positions of equally long strings; unequal lengths are an error."""
    differ = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda k: F.substr(a, k, F.lit(1)) != F.substr(b, k, F.lit(1))))
    return F.when(F.length(a) == F.length(b), differ).otherwise(F.raise_error(F.lit("Sequences must have equal length.")))


def hamming_up_to(a: Column, b: Column, longest: int) -> Column:
    """Differing positions among the first ``longest``; both strings are equally long."""
    return sum(F.when(F.substring(a, k, 1) != F.substring(b, k, 1), 1).otherwise(0) for k in range(1, longest + 1))


def mismatches_with(text: Column, motif: str) -> Column:
    return sum(F.when(F.substring(text, k + 1, 1) != base, 1).otherwise(0) for k, base in enumerate(motif))


def motif_mismatches_at(seq: Column, at: Column, motif: str) -> Column:
    """Mismatches of a motif laid at 0-based ``at``; -1 where it does not fit."""
    part = F.substr(seq, (at + 1).cast("int"), F.lit(len(motif)))
    return F.when((at >= 0) & (at + len(motif) <= F.length(seq)), mismatches_with(part, motif)).otherwise(-1)


def neighbourhood(motif: str, most: int) -> list[str]:
    """All words over A, C, G, T within ``most`` mismatches of a motif."""
    return [w for w in map("".join, product("ACGT", repeat=len(motif))) if sum(x != y for x, y in zip(w, motif)) <= most]


def start_priority(codon: Column) -> Column:
    return F.when(codon == "ATG", 0).when(codon == "GTG", 1).when(codon == "TTG", 2).otherwise(3)


def forward_start(strand: Column, start: Column, end: Column, length: Column) -> Column:
    """1-based forward start of the 0-based half-open [start, end) of a scanned strand."""
    return F.when(strand == "+", start + 1).otherwise(length - end + 1)


def forward_end(strand: Column, start: Column, end: Column, length: Column) -> Column:
    return F.when(strand == "+", end).otherwise(length - start)


def fragment(seq: Column, start: Column, end: Column) -> Column:
    """seq[start:end] with both ends clamped into the sequence."""
    low = F.greatest(start, F.lit(0))
    return F.substr(seq, (low + 1).cast("int"), F.greatest(F.least(end, F.length(seq)) - low, F.lit(0)).cast("int"))


def wrapped(seq: Column, width: int = 80) -> Column:
    """Lines of ``width`` characters."""
    return F.regexp_replace(seq, rf"(?s)(.{{{width}}})(?=.)", "$1\n")


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def protein(seq: Column) -> Column:
    """Translation up to the first stop; unknown codons are X, a partial codon is left out.

    A codon is a number in base 5, N and other letters being 4; its amino acid
    is a letter of one string.
    """
    table = "".join(AMINO_ACIDS[16 * a + 4 * b + c] if max(a, b, c) < 4 else "X" for a, b, c in product(range(5), repeat=3))

    def acids(digits):
        n = F.floor(F.length(digits) / 3).cast("int")
        number = lambda k: F.conv(F.substr(digits, 3 * k - 2, F.lit(3)), 5, 10).cast("int")
        letters = F.transform(F.sequence(F.lit(1), n), lambda k: F.substr(F.lit(table), number(k) + 1, F.lit(1)))
        return F.when(n > 0, F.split_part(F.array_join(letters, ""), F.lit("*"), F.lit(1))).otherwise("")

    bases = F.regexp_replace(F.translate(F.upper(seq), "U", "T"), f"[^{BASES}]", "4")
    return _bound(F.translate(bases, BASES, "0123"), acids)


def kmers(text: Column, k: int = 3) -> Column:
    """Different words of length k; none if the text is shorter."""

    def words(t):
        return F.when(F.length(t) >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - k + 1), lambda i: F.substr(t, i, F.lit(k))))).otherwise(F.array().cast("array<string>"))

    return _bound(text, words)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays taken as sets; 0.0 if either is empty."""
    both = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both).otherwise(0.0)


def preview(text: Column, size: int = 160) -> Column:
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.substring(text, 1, size), F.lit("...")))


def stars(score: Column) -> Column:
    """One to five stars; null for no number."""
    ladder = F.when(score >= 20, 5).when(score >= 15, 4).when(score >= 10, 3).when(score >= 5, 2).otherwise(1)
    return F.when(score.isNotNull() & ~F.isnan(score.cast("double")), ladder)


def confidence(score: Column) -> Column:
    """high, medium or low; null below 8, where a feature is left out."""
    return F.when(score >= 50, "high").when(score >= 30, "medium").when(score >= 8, "low")


def rounded3(x: Column) -> Column:
    return F.floor(x * 1000 + 0.5) / 1000
