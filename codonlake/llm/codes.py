"""Vector code compression: product codes whose codebooks are moved by active-entry Lloyd rounds.

A vector becomes integers, floor(scale * x), cut into equal consecutive parts;
each part is named by the nearest entry of its position's codebook. Codebooks
begin with the parts of the vectors of smallest id and are replaced by the
floored means of what was assigned to them.

Beside its entry, each part keeps its exact squared distance. After a round, a
part whose entry has not moved is compared with the moved entries alone: among
the unmoved ones its entry is still the first of the nearest. Only parts whose
entry moved look through the whole codebook. Equal distances go to the lower
index, so that results are those of complete scans.

What the driver holds are codebooks: entries x dimension numbers. The state of
a round is a table in the shared folder, so that a lost executor repeats its
own part of one round; it goes when the next state is written.

Cases: vectors that are null, or hold null or non-finite components, take no
part, nor do those whose length is not that of the first vector (in order of
id) whose length is a positive multiple of ``parts``. Rows without an id follow
all others when codebooks begin; rows of equal id are taken by their
components, then label. Rows repeated are coded each. Fewer vectors than
entries give smaller codebooks; none give no rows. Labels that are null are one
label. Scaled components beyond 2**29 raise an error: their squares would not
fit into 64 bits. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, give_back

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
MOST = 1 << 29
#: Below this, products and their sums are exact in double precision.
EXACT = 1 << 21
BROADCAST_LABELS = 100_000
SALTS = 64


@dataclass
class Codebooks:
    """``entries`` has the shape (parts, entries, length of a part)."""

    entries: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of (n, width) integers to each of (k, width) entries."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if top < EXACT and x.shape[1] <= 256:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.zeros((len(x), len(entries)), np.int64)
    for k in range(x.shape[1]):
        out += (x[:, k, None] - entries[None, :, k]) ** 2
    return out


def assign(x: np.ndarray, entries: np.ndarray, moved: np.ndarray | None = None, codes: np.ndarray | None = None, best: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(codes, distances), both (n, parts), of integer vectors (n, parts, width).

    Without ``moved`` each part is compared with all entries. With it, (parts,
    entries) tells which entries have moved since ``codes`` and ``best`` were found.
    """
    n, parts, _ = x.shape
    new_codes, new_best = (np.empty((n, parts), np.int64) for _ in "ab")
    for p in range(parts):
        mine = x[:, p]
        if moved is None:
            stale = np.ones(n, bool)
        else:
            stale = moved[p][codes[:, p]]
            new_codes[:, p], new_best[:, p] = codes[:, p], best[:, p]
            active = np.flatnonzero(moved[p])
            fixed = np.flatnonzero(~stale)
            if len(active) and len(fixed):
                d = distances(mine[fixed], entries[p][active])
                first = d.argmin(1)
                near, which = d[np.arange(len(fixed)), first], active[first]
                won = (near < best[fixed, p]) | (near == best[fixed, p]) & (which < codes[fixed, p])
                new_codes[fixed[won], p], new_best[fixed[won], p] = which[won], near[won]
        full = np.flatnonzero(stale)
        if len(full):
            d = distances(mine[full], entries[p])
            first = d.argmin(1)
            new_codes[full, p], new_best[full, p] = first, d[np.arange(len(full)), first]
    return new_codes, new_best


def moved_entries(entries: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(new entries, which moved): floored means of what was assigned; unused entries stay."""
    new = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], entries)
    return new, (new != entries).any(-1)


def usable(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, label, v): rows whose components are all finite, as doubles."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    finite = lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)
    return rows.filter(F.col("v").isNotNull() & F.forall("v", finite))


def _numbers(column: pa.Array, n: int, parts: int, scale: int) -> np.ndarray:
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False))
    if np.abs(flat).max(initial=0) > MOST:
        raise ArithmeticError(f"a component is beyond {MOST // scale}")
    return flat.astype(np.int64).reshape(n, parts, -1)


def _first_codebooks(rows: DataFrame, parts: int, entries: int, scale: int) -> np.ndarray | None:
    fits = rows.filter((F.size("v") > 0) & (F.size("v") % parts == 0))
    by = [F.asc_nulls_last("vec_id"), F.asc("v"), F.asc("label")]
    first = fits.orderBy(*by).select("v").first()
    if first is None:
        return None
    some = [r["v"] for r in fits.filter(F.size("v") == len(first["v"])).orderBy(*by).select("v").limit(entries).collect()]
    return _numbers(pa.array(some, pa.list_(pa.float64())), len(some), parts, scale).transpose(1, 0, 2).copy()


def _state(rows: DataFrame, entries: np.ndarray, moved: np.ndarray | None, scale: int) -> DataFrame:
    """(vec_id, label, v, codes, best): each vector's entries and exact distances; ``rows`` has codes and best where ``moved`` is given."""
    parts = len(entries)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _numbers(batch.column("v"), n, parts, scale)
            old = () if moved is None else (moved, *(batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, parts) for c in ("codes", "best")))
            codes, best = assign(x, entries, *old)
            at = pa.array(np.arange(0, n * parts + 1, parts, dtype=np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(a.ravel(), t)) for a, t in ((codes, pa.int32()), (best, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "v")), *lists], ["vec_id", "label", "v", "codes", "best"])
        give_back()

    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id long, label {kind}, v array<double>, codes array<int>, best array<long>")


def _sums(state: DataFrame, shape: tuple[int, int, int], scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and component sums of what each entry was assigned: partial sums a task, added up by Spark."""
    parts, entries, width = shape

    def run(batches):
        counts, sums = np.zeros(shape[:2], np.int64), np.zeros(shape, np.int64)
        for batch in batches:
            x = _numbers(batch.column("v"), batch.num_rows, parts, scale)
            codes = batch.column("codes").flatten().to_numpy().reshape(-1, parts)
            for p in range(parts):
                np.add.at(sums[p], codes[:, p], x[:, p])
                counts[p] += np.bincount(codes[:, p], minlength=entries)
        part, entry = np.nonzero(counts)
        each = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), *[pa.array(sums[part, entry, k]) for k in range(width)]]
        yield pa.RecordBatch.from_arrays(each, ["part", "entry", "n", *[f"s{k}" for k in range(width)]])

    names = [f"s{k}" for k in range(width)]
    partial = state.select("v", "codes").mapInArrow(run, "part int, entry int, n long, " + ", ".join(f"{c} long" for c in names))
    counts, sums = np.zeros(shape[:2], np.int64), np.zeros(shape, np.int64)
    for r in partial.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).collect():
        counts[r["part"], r["entry"]] = r["n"]
        sums[r["part"], r["entry"]] = [r[c] for c in names]
    return counts, sums


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, codes array<int>, best array<long>) of all usable vectors, and the final codebooks."""
    rows = usable(vectors, vec_id, embedding, label)
    books = _first_codebooks(rows, parts, entries, scale)
    if books is None:
        kind = rows.schema["label"].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"vec_id long, label {kind}, codes array<int>, best array<long>"), Codebooks(np.zeros((parts, 0, 0), np.int64))
    state, moved = rows.filter(F.size("v") == parts * books.shape[2]), None
    for k in range(rounds + 1):
        before, state = state, cut(_state(state, books, moved, scale), f"codes-{k}")
        if k:
            discard(before)
        if k < rounds:
            books, moved = moved_entries(books, *_sums(state, books.shape, scale))
    return state.drop("v"), Codebooks(books)


def decompress(coded: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """``coded`` with the vector ``approx`` that its codes stand for: entries divided by ``scale``."""
    flat = F.array(*[F.array(*[F.array(*[F.lit(x / scale) for x in e]) for e in part]) for part in books.entries.tolist()])
    return coded.withColumn("approx", F.flatten(F.transform("codes", lambda c, p: F.element_at(F.element_at(flat, p + 1), c + 1))))


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the errors of its label added up.

    Up to BROADCAST_LABELS labels are sent to all tasks; more of them meet the
    rows by label and a salt of the id, so that a label of very many rows is
    spread over SALTS tasks.
    """
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    same = F.col("label").eqNullSafe(F.col("_label"))
    if totals.count() <= BROADCAST_LABELS:
        return coded.join(F.broadcast(totals), same).drop("_label")
    salted = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    totals = totals.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(totals, same & (F.col("_salt") == F.col("_s"))).drop("_label", "_salt", "_s")


def coded_vectors(vectors: DataFrame, **how) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256, label) of all usable vectors; ``code`` has two hex digits a part."""
    coded, books = compress(vectors, **how)
    digits = F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0")))
    rows = coded.select("vec_id", "label", F.array_join(digits, "").alias("code"), F.aggregate("best", F.lit(0).cast("long"), lambda a, b: a + b).alias("error"))
    return with_label_errors(rows).withColumn("codebooks_sha256", F.lit(books.sha256()))
