"""Sequences as two strands, frames and tiles.

Strands are kept as bytes: a part of them costs the same anywhere, while a
string is walked from its start. Every scan marks the few places that it is for
in arrays of bytes, piece by piece with context; all that is done with them is
left to DataFrames.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dna
from ..sources.scratch import stored

TILE = 2048
#: Letters that are scanned at a time.
PIECE = 1 << 18
KEYS = ("seq_id",)
COMPLEMENT = np.arange(256, dtype=np.uint8)
COMPLEMENT[list(b"ACGTN")] = list(b"TGCAN")
IS_BASE = np.isin(np.arange(256), list(b"ACGT"))
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this package


def strands(sequences: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, strand, n, s): both strands of every sequence, read from 5' to 3'."""
    both = F.array(
        F.struct(F.lit("+").alias("strand"), F.col("seq").cast("binary").alias("s")),
        F.struct(F.lit("-").alias("strand"), dna.reverse_complement(F.col("seq")).cast("binary").alias("s")),
    )
    return sequences.select(*keys, F.length("seq").cast("long").alias("n"), F.explode(both).alias("b")).select(*keys, "b.strand", "n", "b.s")


def part(s: Column, start, length) -> Column:
    """Bytes [start, start + length) of a strand, as a string."""
    return F.substr(s, (start + 1).cast("int"), (F.lit(length) if isinstance(length, int) else length).cast("int")).cast("string")


def frames(sequences: DataFrame, keys=KEYS) -> DataFrame:
    """The six reading frames, each cut to whole codons."""
    rows = strands(sequences, keys).withColumn("off", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])))
    rows = rows.withColumn("usable", F.col("n") - F.col("off") - (F.col("n") - F.col("off")) % 3).filter("usable >= 3")
    end = F.col("off") + F.col("usable")
    return rows.select(
        *keys,
        "strand",
        (F.col("off") + 1).alias("frame"),
        dna.forward_start(F.col("strand"), F.col("off"), end, F.col("n")).alias("start"),
        dna.forward_end(F.col("strand"), F.col("off"), end, F.col("n")).alias("end"),
        F.col("usable").alias("length_nt"),
        part(F.col("s"), F.col("off"), F.col("usable")).alias("sequence"),
        F.floor(F.col("usable") / 3).alias("peptide_length_aa"),
    )


def tiles(sequences: DataFrame, keys=KEYS, tile: int = TILE) -> DataFrame:
    """(keys, off, t): the forward strand in tiles, as bytes, dealt out over tasks."""
    rows = sequences.select(*keys, F.length("seq").cast("long").alias("n"), F.col("seq").cast("binary").alias("s")).filter("n > 0")
    rows = rows.withColumn("off", F.explode(F.expr(f"sequence(0L, n - 1, {tile}L)")))
    return rows.select(*keys, "off", F.substr("s", (F.col("off") + 1).cast("int"), F.lit(tile)).alias("t")).repartition(*keys, "off")


def stored_tiles(sequences: DataFrame, keys=KEYS) -> DataFrame:
    """Tiles written once."""
    return stored(tiles(sequences, keys), "tiles")


def letters_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins, and the last ends; a null is an empty text."""
    texts = texts.fill_null("").cast(pa.large_binary())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    letters = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return letters[ends[0] : ends[-1]], ends - ends[0]


def texts_of(letters: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Texts from their bytes and ends, as ``letters_of`` gives them."""
    return pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(letters))])


def ahead(mask: np.ndarray, by: int) -> np.ndarray:
    """For every place, ``mask`` at the place ``by`` behind it (before it, if negative); false beyond the ends."""
    out = np.zeros_like(mask)
    if abs(by) < len(mask):
        out[max(0, -by) : len(mask) - max(0, by)] = mask[max(0, by) : len(mask) + min(0, by)]
    return out


def mismatches(letters: np.ndarray, word: str) -> np.ndarray:
    """For every place, in how many letters the word that begins there differs from ``word``; places too near the end have all."""
    out = np.full(len(letters), min(len(word), 255), np.uint8 if len(word) < 256 else np.int32)
    last = max(0, len(letters) - len(word) + 1)
    out[:last] = 0
    for k, base in enumerate(word):
        out[:last] += letters[k : k + last] != ord(base)
    return out


def words(letters: np.ndarray, word: str, most: int = 0) -> np.ndarray:
    """Where a word of bases begins that differs from ``word`` in at most ``most`` letters."""
    fits = mismatches(letters, word) <= most
    if most:
        other = ~IS_BASE[letters]
        for k in range(len(word)):
            fits &= ~ahead(other, k)
    return fits


def scan(sequences: DataFrame, find: Callable[[np.ndarray], list[tuple[int, np.ndarray]]], left: int, right: int, keys=KEYS, reach: int = 0) -> DataFrame:
    """(keys, strand, n, i, kind, near): 0-based places on both strands that ``find`` marks, with the letters around.

    ``find`` gets letters as bytes and gives (kind, mask) pairs; it may look
    ``reach`` letters to both sides. ``near`` are the letters from ``left``
    before the place up to ``right`` behind it (exclusive), '.' beyond the ends.
    A sequence is a row, so a task reads it as it is, in pieces; nothing is shuffled.
    """
    around = max(left, right, reach)

    def places(batch, parts, letters, ends):
        """The rows of some pieces (row, offset, length)."""
        sizes = np.array([m for _, _, m in parts])
        firsts = np.concatenate([[0], np.cumsum(sizes + 2 * around)])
        text = np.full(firsts[-1], ord("."), np.uint8)
        for (r, off, m), first in zip(parts, firsts):
            low, high = max(0, off - around), min(ends[r + 1] - ends[r], off + m + around)
            at = first + around + low - off
            text[at : at + high - low] = letters[ends[r] + low : ends[r] + high]
        rows, offs = np.array([r for r, _, _ in parts]), np.array([off for _, off, _ in parts])
        for strand in "+-":
            read = text if strand == "+" else COMPLEMENT[text[::-1]]
            window = np.lib.stride_tricks.sliding_window_view(read, left + right)
            for kind, mask in find(read):
                at = np.flatnonzero(mask)
                forward = at if strand == "+" else len(text) - 1 - at
                part = np.searchsorted(firsts, forward, "right") - 1
                j = forward - firsts[part] - around
                inner = (j >= 0) & (j < sizes[part])
                at, part, j = at[inner], part[inner], j[inner]
                row = rows[part]
                n = ends[row + 1] - ends[row]
                i = offs[part] + j if strand == "+" else n - 1 - offs[part] - j
                near = texts_of(window[at - left].reshape(-1), np.arange(len(at) + 1) * (left + right))
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(row)) for k in keys], pa.array([strand] * len(at), pa.string()), *map(pa.array, (n, i, np.full(len(at), kind))), near], names)

    def found(batches):
        for batch in batches:
            letters, ends = letters_of(batch.column("seq"))
            parts, size = [], 0
            for r in range(len(batch)):
                n = int(ends[r + 1] - ends[r])
                for off in range(0, n, PIECE):
                    parts.append((r, off, min(PIECE, n - off)))
                    size += parts[-1][2]
                    if size >= PIECE:
                        yield from places(batch, parts, letters, ends)
                        parts, size = [], 0
            if parts:
                yield from places(batch, parts, letters, ends)

    rows = sequences.select(*keys, "seq")
    names = [*keys, "strand", "n", "i", "kind", "near"]
    kinds = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys]
    return rows.mapInArrow(found, ", ".join([*kinds, "strand string, n long, i long, kind long, near string"]))


def motif_hits(sequences: DataFrame, motif: str, max_mismatches: int, max_hits: int | None = None, keys=KEYS) -> DataFrame:
    """(keys, strand, i): 0-based places where ``motif`` fits with so few mismatches; N is a mismatch like any other.

    With ``max_hits`` the first so many of every strand.
    """
    if not motif:
        return sequences.select(*keys, F.lit("+").alias("strand"), F.lit(0).cast("long").alias("i")).limit(0)
    inside = lambda x: ahead(x != ord("."), len(motif) - 1)
    rows = scan(sequences, lambda x: [(0, (mismatches(x, motif) <= max_mismatches) & inside(x))], 0, 1, keys, len(motif)).select(*keys, "strand", "i")
    if max_hits is None:
        return rows
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "strand").orderBy("i"))).filter(F.col("_r") <= max_hits).drop("_r")
