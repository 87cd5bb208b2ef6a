"""Best-fit packing by minimum bin slack.

Documents become token pieces; only those longer than a sequence are cut. The
pieces are counted by length - at most ``capacity`` numbers, whatever the
corpus - and the fill plan is made from these counts: the longest remaining
length opens a bin, a bitset subset-sum over the remaining lengths finds the
fullest combination for the rest of it, and the combination is taken out as
often as the counts allow. Each piece then finds its place from its length and
its rank among the pieces of that length; ranks are counted in two levels, so
that a length shared by most of the corpus is spread over many tasks.

Cases: a null text is an empty one and gives the end id alone; rows repeated
give pieces of their own; no documents give no pieces; other columns are
ignored.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, give_back, rows_per_batch, slices_of

CAPACITY = 4096
END_ID = 1
RANK_ROWS = 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
CACHED_WORDS = 200_000
SLICE_BYTES = 2 << 20
#: Rows that a task hands to Python at a time: it holds no more of its texts than these and a slice.
BATCH_ROWS = 500


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The one pattern whose matches are found by classes of characters (fixed value), and the contractions that it takes first.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
SPACE, LETTER, SIGN, NUMBER, ODD = range(5)
#: Characters with a class are those below COMMON and the punctuation at PUNCTUATION: they stay as they are in NFC.
COMMON, PUNCTUATION = 0x590, range(0x2010, 0x2028)


def split_pattern(tokenizer: dict) -> str | None:
    """PATTERN, if a tokenizer encodes its matches in a lower-case text one by one; None where it isn't known to work so.

    Asked for are lower case, nothing kept between matches, no special tokens
    to find in lower-case texts, and merges inside a match only.
    """
    steps = lambda part, name: part.get(name, [part]) if part else []
    before = [x["type"] for x in steps(tokenizer.get("normalizer"), "normalizers")]
    first, *rest = steps(tokenizer.get("pre_tokenizer"), "pretokenizers") or [{}]
    split = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and first.get("pattern") == {"Regex": PATTERN}
    plain = all(x["type"] == "ByteLevel" and not x.get("use_regex", True) and not x.get("add_prefix_space", True) for x in rest)
    if before[:1] != ["NFC"] or before[-1:] != ["Lowercase"] or not {*before} <= {"NFC", "Replace", "Lowercase"} or not split or not plain:
        return None
    if any(x["type"] == "Replace" and (x["pattern"].get("Regex"), x["content"]) != ("\\s+", " ") for x in steps(tokenizer["normalizer"], "normalizers")):
        return None
    odd = any(not x["special"] or x["normalized"] for x in tokenizer.get("added_tokens", []))
    return None if odd or tokenizer["model"].get("end_of_word_suffix") is None else PATTERN


def character_classes() -> tuple[np.ndarray, np.ndarray]:
    """By code point: its class, and its lower case. What follows the last of them is ODD."""
    classes, lower = np.full(PUNCTUATION.stop + 1, ODD, np.uint8), np.arange(PUNCTUATION.stop + 1, dtype=np.uint16)
    classes[[ord(c) for c in " \t\n\v\f\r"]] = SPACE
    for i in [*range(0x21, 0x7F), *range(0xA1, COMMON)]:
        small, kind = chr(i).lower(), unicodedata.category(chr(i))[0]
        if len(small) == 1 and kind in "LNPS" and unicodedata.is_normalized("NFC", chr(i)) and unicodedata.category(small)[0] == kind:
            classes[i], lower[i] = {"L": LETTER, "N": NUMBER}.get(kind, SIGN), ord(small)
    classes[PUNCTUATION] = SIGN
    return classes, lower


class WordIds:
    """Token ids of texts, by the parts that the tokenizer's pattern makes, each encoded once.

    Holds for tokenizers with a ``split_pattern``. Parts begin where the
    class of characters changes. New parts are encoded in one call, which tells
    them apart by the ends of words among the ids. Texts with a character of no
    class or a special token's string, and all texts of other tokenizers, are
    encoded whole. What is known of parts is forgotten when it has grown over
    CACHED_WORDS.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        self.path, self.of = path, Tokenizer.from_file(path)
        self.pattern = split_pattern(described)
        self.special = [x["content"] for x in described.get("added_tokens", [])]
        if self.pattern:
            suffix, vocabulary = described["model"]["end_of_word_suffix"], self.of.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for s, i in vocabulary.items() if s.endswith(suffix)]] = True
            self.classes, self.lower = character_classes()
            del vocabulary
        del described
        give_back()
        self._forget()

    def _forget(self) -> None:
        self.parts = pa.array([], pa.string())
        self.ids = np.empty(1 << 18, np.uint32)  # of every part
        self.n_ids = 0
        self.part_at = np.empty((2, 0), np.int64)  # start and length

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.of.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Where runs of ``ids`` of these sizes stand from now on."""
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        start = self.n_ids + np.cumsum(size) - size
        self.n_ids += len(ids)
        return np.stack([start, size])

    def _taken(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        ends = np.cumsum(size)
        return self.ids[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]

    def _learn(self, parts: pa.Array) -> None:
        new = []
        for at in range(0, len(parts), 10_000):
            some = parts.slice(at, 10_000).to_pylist()
            ids = self._whole([" ".join(some)])[0]
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):
                each = self._whole(some)
                ids, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
            new.append(self._keep(ids, np.diff(ends, prepend=0)))
        self.parts = pa.concat_arrays([self.parts, parts])
        self.part_at = np.concatenate([self.part_at, *new], axis=1)

    def _split(self, text: str, ends: np.ndarray) -> tuple[pa.Array, np.ndarray, list[int]]:
        """The parts of lines of text that end at ``ends``, the number of parts before each line's end, and the odd lines, left out."""
        points = np.frombuffer(text.encode("ascii"), np.uint8) if text.isascii() else np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), len(self.classes) - 1)
        kind, points = self.classes[points], self.lower[points]
        odd = np.unique(np.searchsorted(ends, np.flatnonzero(kind == ODD))).tolist()
        for i in odd:
            kind[ends[i - 1] + 1 if i else 0 : ends[i]] = SPACE
        begins = np.r_[True, kind[1:] != kind[:-1]] | (kind == NUMBER)
        quotes = np.flatnonzero((points == ord("'")) & (kind == SIGN) & begins)
        letters = np.r_[np.where(kind == LETTER, points, 0), 0, 0]
        for rest in CONTRACTIONS:  # no two of them begin alike, so each quote meets one at most
            found = quotes
            for k, c in enumerate(rest, 1):
                found = found[letters[found + k] == ord(c)]
            begins[found + 1] = False
            behind = found + 1 + len(rest)
            begins[behind[letters[behind] > 0]] = True
        kept = kind != SPACE
        begins &= kept
        points, begins_kept = points[kept], begins[kept]
        wide = (points >= 0x80).astype(np.int8) + (points >= 0x800)
        data = points.astype(np.uint8).tobytes() if not wide.any() else points.astype("<u4").tobytes().decode("utf-32-le").encode()
        at = np.flatnonzero(begins_kept)
        offsets = at if len(data) == len(points) else at + np.r_[0, np.cumsum(wide, dtype=np.int64)][at]
        offsets = np.r_[offsets, len(data)].astype(np.int32)
        parts = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data))
        return parts, np.cumsum(begins, dtype=np.int64)[ends], odd

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        lines = texts.to_pylist()
        if self.pattern is None or not lines:
            return self._whole(lines)
        size = np.fromiter(map(len, lines), np.int64, len(lines))
        parts, bounds, odd = self._split("\n".join(lines) + "\n", np.cumsum(size + 1) - 1)
        coded = parts.dictionary_encode()
        different = coded.dictionary
        if len(self.parts) > CACHED_WORDS:
            self._forget()
        place = pc.index_in(different, value_set=self.parts)
        if place.null_count:
            new, known = np.flatnonzero(place.is_null().to_numpy(zero_copy_only=False)), len(self.parts)
            self._learn(different.take(pa.array(new)))
            place = place.fill_null(0).to_numpy().copy()
            place[new] = np.arange(known, known + len(new))
        else:
            place = place.to_numpy()
        start, size = self.part_at[:, place[coded.indices.to_numpy()]]
        ids, ends = self._taken(start, size), np.cumsum(size)
        at = np.r_[0, np.r_[0, ends][bounds]]
        out = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        whole = {*odd}.union(*(np.flatnonzero(pc.match_substring(texts, token).to_numpy(zero_copy_only=False)).tolist() for token in self.special))
        for i in sorted(whole):
            out[i] = self._whole([lines[i]])[0]
        return out


def tokenize_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the pieces of every document."""
    path = tokenizer or default_tokenizer()
    end = np.array([END_ID], np.uint32)
    names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids

    def pieces(batches):
        words = WordIds(path)
        for part in slices_of(batches, most=SLICE_BYTES):
            rows = []
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), words.encode(part.column("text"))):
                data = np.r_[ids, end].astype("<u4").tobytes()
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    piece = data[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece), *[piece] * with_ids))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        del words
        give_back()

    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.mapInArrow(pieces, PIECES + ", ids binary" * with_ids)


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """The combination of the available lengths whose sum is nearest to ``room`` from below.

    ``lengths`` is the descending order in which lengths are tried; bit s of
    the set tells that the sum s can be reached.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        if length > room:
            continue
        for _ in range(min(counts[length], room // length)):
            more = reach | (reach << length & mask)
            if more == reach:
                break
            steps.append((length, reach))
            reach = more
        if reach >> room:
            break
    used: dict[int, int] = {}
    total = reach.bit_length() - 1
    for length, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + 1
            total -= length
    return used


def fill_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, low, high, sequence, per_sequence, offset) for runs of equal bins.

    Pieces of ``length`` ranked from low to high - 1 go ``per_sequence`` each
    to the sequences from ``sequence`` on, at ``offset`` and after.
    """
    counts = {k: n for k, n in counts.items() if n}
    taken = dict.fromkeys(counts, 0)
    order, plan, sequence = sorted(counts, reverse=True), [], 0
    while order:
        first = order[0]
        counts[first] -= 1
        rest = fullest(counts, order, capacity - first)
        counts[first] += 1
        rest[first] = rest.get(first, 0) + 1
        times = min(counts[k] // n for k, n in rest.items())
        offset = 0
        for k, n in sorted(rest.items(), reverse=True):
            plan.append((k, taken[k], taken[k] + n * times, sequence, n, offset))
            offset += k * n
            taken[k] += n * times
            counts[k] -= n * times
            if not counts[k]:
                order.remove(k)
                del counts[k]
        sequence += times
    return plan


def _ranked(pieces: DataFrame, rows: int) -> DataFrame:
    """``pieces`` with ``rank``, from 0 within each length."""
    salts = max(16, -(-rows // RANK_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    base = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    base = base.select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("base"))
    within = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return salted.join(base, ["length", "salt"]).withColumn("rank", F.col("base") + within).drop("salt", "base")


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset. ``pieces`` is read three times: store it first."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row a length
    plan = np.array(sorted(fill_plan(counts, capacity)), dtype=np.int64).reshape(-1, 6)
    ranked = _ranked(pieces, sum(counts.values()))
    span = sum(counts.values()) + 1
    if span * (capacity + 1) >= 1 << 62:
        raise ValueError("too many pieces for one plan")

    def placed(batches):
        keys = plan[:, 0] * span + plan[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = plan[np.searchsorted(keys, length * span + rank, "right") - 1]
            k = rank - row[:, 1]
            out = [pa.array(row[:, 3] + k // row[:, 4]), pa.array(row[:, 5] + k % row[:, 4] * length)]
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *out], [*kept, "sequence_id", "offset"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(placed, f"{kept}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    with rows_per_batch(docs.sparkSession, BATCH_ROWS):
        pieces = cut(tokenize_pieces(docs, tokenizer, capacity), "pieces")
    placed = place(pieces, capacity)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
