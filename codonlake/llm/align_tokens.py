"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

A text, led by a space, is encoded by a byte-level BPE (A) and by a piece model
(B, which adds the space itself). Byte offsets where tokens of both end cut the
tokens into groups; ``common_ends`` finds them by diagonal run skipping over
the two arrays of ends. Tokens of one group are linked. An id pair's count is
the number of documents that hold it linked.

Texts are cut before single spaces and around single line breaks, where
neither tokenizer ever joins what stands at both sides, and each different
segment is encoded and aligned once by a task; texts with other white space are
one segment, as are all texts where a vocabulary has pieces across such a cut.
All new segments of a batch are aligned as one pair of arrays.

The aligned documents are stored with their different id pairs, so that texts
are encoded once. Spark counts the pairs and joins each document's links with
the counts: those of at most HEAD_PAIRS pairs, the most frequent ones, are sent
to all tasks, and links of other pairs, each in a bounded number of documents,
meet their counts by pair. No text is shuffled.

Cases: texts that are null or empty, or whose tokens' joined bytes differ from
them (such as texts with U+2581), have no tokens: zeros and an empty digest.
Rows repeated or without an id are documents of their own; no rows give no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, pieces_of

HEAD_PAIRS = 1 << 20
CACHED_SEGMENTS = 300_000
SLICE_BYTES = 2 << 20
#: Links of one group from which they are counted by id.
LARGE = 10_000
CUT = "\x1f"
#: White space other than single spaces and single line breaks inside a text, and what marks cuts and B's spaces (fixed values).
ODD = r"  | \n|\n |\n\n|^\n|[ \n]$|[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{2581}]|^ "
SPACE = "▁"
SUMS = ("n_a", "n_b", "n_groups", "n_links")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def common_ends(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """For each offset where tokens of both end, how many tokens of A and of B end there or before.

    ``a`` and ``b`` are increasing ends with the same last one. At the current
    shift of the indexes, twice as many ends are compared each time while all
    are equal, then half as many, to the end of the run of one-to-one groups.
    Where it ends, the side that is behind goes on until both meet: that group
    gives the next shift.
    """
    out_a, out_b = [], []
    i = shift = 0
    n = len(a)
    while i < n:
        run, k = i, 1
        while run < n and a[run : run + k] == b[run + shift : run + shift + k]:
            run, k = run + k, 2 * k
        while k > 1 and run < n:
            k //= 2
            if a[run : run + k] == b[run + shift : run + shift + k]:
                run += k
        run = min(run, n)
        out_a.extend(range(i + 1, run + 1))
        out_b.extend(range(i + 1 + shift, run + 1 + shift))
        i = run
        if i < n:
            j = i + shift
            while a[i] != b[j]:
                if a[i] < b[j]:
                    i += 1
                else:
                    j += 1
            i, shift = i + 1, j - i
            out_a.append(i)
            out_b.append(i + shift)
    return out_a, out_b


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: visible Latin-1 ones for themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, with the bytes of all their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        letters, vocabulary = byte_letters(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        self.a_size = np.array(list(map(len, self.a_bytes)), np.int64)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.b_size = np.array(list(map(len, self.b_bytes)), np.int64)
        with open(a_path, encoding="utf-8") as f:
            before = json.load(f).get("pre_tokenizer") or {}
        cuts_a = (before.get("type"), before.get("use_regex"), before.get("add_prefix_space")) == ("ByteLevel", True, False)
        across = any(SPACE in p.lstrip(SPACE) or "\n" in p and len(p) > 1 for p in pieces)
        self.line = self.b.encode("\n")
        #: whether texts may be cut into segments
        self.cuts = cuts_a and not across and len(self.line) == 2 and [self.b_bytes[i] for i in self.line] == [b" ", b"\n"] and self.b.encode("a\nb")[1:2] == self.line[1:]
        if len(self.a_bytes) * len(self.b_bytes) >= 1 << 32:
            raise ValueError("the vocabularies are too large for pair numbers of 32 bits")

    def encode(self, segments: list[str], join: bool = True) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """For A and for B: (ids of all segments, how many each has).

        Segments that begin with their only space are encoded as one text, whose
        tokens end with each of them; others one by one, as all are where that
        does not hold. What does not begin with a space is encoded by B behind a
        line break.
        """
        alone = [not (join and self.cuts and s[0] == " " and len(s) > 1 and not s[1:].isspace() and s.count(" ") == 1) for s in segments]
        joined = "".join(s for s, x in zip(segments, alone) if not x)
        rest = [s for s, x in zip(segments, alone) if x]
        ends = np.cumsum([len(s.encode()) for s, x in zip(segments, alone) if not x])
        whole_a = [self.a.encode(joined, add_special_tokens=False).ids] if joined else [[]]
        whole_b = [self.b.encode(joined[1:])] if joined else [[]]
        each_a = [e.ids for e in self.a.encode_batch_fast(rest, add_special_tokens=False)]
        each_b = self.b.encode([s[1:] if s[0] == " " else "\n" + s for s in rest], num_threads=1)
        each_b = [ids if s[0] == " " else ids[2:] for s, ids in zip(rest, each_b)]
        out, alone = [], np.array(alone, bool)
        for whole, each, size in ((whole_a, each_a, self.a_size), (whole_b, each_b, self.b_size)):
            flat = np.array(whole[0], np.int64)
            reached = np.cumsum(size[flat])
            last = np.searchsorted(reached, ends) + 1  # tokens up to each segment's end
            if len(last) and (last[-1] != len(flat) or not np.array_equal(reached[last - 1], ends)):
                return self.encode(segments, join=False)
            counts = np.zeros(len(segments), np.int64)
            counts[~alone] = np.diff(last, prepend=0)
            counts[alone] = [len(x) for x in each]
            ids, of = np.empty(counts.sum(), np.int64), np.repeat(alone, counts)
            ids[~of] = flat
            ids[of] = np.fromiter((i for x in each for i in x), np.int64, int(of.sum()))
            out.append((ids, counts))
        return out[0], out[1]


class Segments:
    """What a task knows of its segments: sizes, the text of their groups, and their links by pair (CSR arrays)."""

    def __init__(self, tokenizers: Tokenizers):
        self.of = tokenizers
        self.width = len(tokenizers.b_bytes)
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.groups = pa.array([], pa.large_string())
        self.sums = np.empty((len(SUMS) + 1, 0), np.int64)  # and whether bytes differ
        self.pairs = np.empty((2, 0), np.int64)  # pair number, links
        self.start = np.zeros(1, np.int64)

    def _same_bytes(self, segments: list[str], a: tuple, b: tuple) -> np.ndarray:
        """Whether the tokens of A and of B are the segment's bytes."""
        data = [s.encode() for s in segments]
        size, good = np.array(list(map(len, data)), np.int64), np.ones(len(data), bool)
        for (ids, counts), table, width in ((a, self.of.a_bytes, self.of.a_size), (b, self.of.b_bytes, self.of.b_size)):
            ends = np.cumsum(counts)
            if np.array_equal(np.cumsum(np.r_[0, width[ids]])[ends], np.cumsum(size)) and b"".join(map(table.__getitem__, ids.tolist())) == b"".join(data):
                continue
            good &= [b"".join(map(table.__getitem__, ids[e - c : e].tolist())) == d for d, e, c in zip(data, ends.tolist(), counts.tolist())]
        return good

    def _pairs(self, flat: tuple, begin: tuple, size: tuple, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, pair, links) of groups; groups of very many links are counted by id first."""
        (a, b), (i, j), (p, q) = flat, begin, size
        large = p * q > LARGE
        n = np.where(large, 0, p * q)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(np.maximum(q, 1), n)
        keys = [np.repeat(segment, n) << 32 | a[np.repeat(i, n) + at // wide] * self.width + b[np.repeat(j, n) + at % wide]]
        links = [np.ones(len(keys[0]), np.int64)]
        for g in np.flatnonzero(large).tolist():
            us, c = np.unique(a[i[g] : i[g] + p[g]], return_counts=True)
            vs, d = np.unique(b[j[g] : j[g] + q[g]], return_counts=True)
            keys.append(segment[g] << 32 | (us[:, None] * self.width + vs).ravel())
            links.append((c[:, None] * d).ravel())
        keys, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, which, np.concatenate(links))
        return keys >> 32, keys & 0xFFFFFFFF, total

    def _learn(self, segments: list[str]) -> None:
        a, b = self.of.encode(segments)
        good = self._same_bytes(segments, a, b)
        (flat_a, n_a), (flat_b, n_b) = ((ids[np.repeat(good, counts)], np.where(good, counts, 0)) for ids, counts in (a, b))
        ends = [np.cumsum(width[flat]).tolist() for width, flat in ((self.of.a_size, flat_a), (self.of.b_size, flat_b))]
        at_a, at_b = (np.array(x, np.int64) for x in common_ends(*ends))
        last = np.searchsorted(at_a, np.cumsum(n_a), "right")  # groups up to each segment's end
        n_groups = np.diff(last, prepend=0)
        segment = np.repeat(np.arange(len(segments)), n_groups)
        size = np.diff(at_a, prepend=0), np.diff(at_b, prepend=0)
        of, pair, links = self._pairs((flat_a, flat_b), (at_a - size[0], at_b - size[1]), size, segment)
        pairs_each = np.bincount(of, minlength=len(segments))
        sums = np.zeros((len(self.sums), len(segments)), np.int64)
        per_segment = lambda x: np.diff(np.r_[0, np.cumsum(x)][np.r_[0, np.cumsum(pairs_each)]])
        sums[:] = n_a, n_b, n_groups, per_segment(links), ~good
        lists = lambda ends, values: pa.ListArray.from_arrays(np.r_[0, ends].astype(np.int32), values)
        text = lambda ids: pa.array(ids).cast(pa.large_string())
        join = lambda x, mark: pc.binary_join(x, pa.scalar(mark, pa.large_string()))
        groups = pc.binary_join_element_wise(join(lists(at_a, text(flat_a)), ","), join(lists(at_b, text(flat_b)), ","), pa.scalar("|", pa.large_string()))
        self.known = pa.concat_arrays([self.known, pa.array(segments, pa.string())])
        self.groups = pa.concat_arrays([self.groups, join(lists(last, groups), ";")])
        self.sums = np.concatenate([self.sums, sums], axis=1)
        self.start = np.r_[self.start, self.start[-1] + np.cumsum(pairs_each)]
        self.pairs = np.concatenate([self.pairs, np.stack([pair, links])], axis=1)

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which texts have tokens or may have, bounds of each among the numbers, numbers of segments)."""
        if len(self.known) > CACHED_SEGMENTS:
            self._forget()
        texts = pc.fill_null(texts, "")
        some = pc.greater(pc.binary_length(texts), 0)
        odd = pc.match_substring_regex(texts, ODD) if self.of.cuts else pa.array(np.ones(len(texts), bool))
        plain, whole = (np.flatnonzero(pc.and_(some, x).to_numpy(zero_copy_only=False)) for x in (pc.invert(odd), odd))
        led = lambda t: pc.binary_join_element_wise(pa.scalar(" "), t, pa.scalar(""))
        cuts = pc.replace_substring(pc.replace_substring(texts.take(pa.array(plain)), " ", CUT + " "), "\n", CUT + "\n" + CUT)
        lists = pc.split_pattern(led(cuts), CUT)
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        segments = pa.concat_arrays([coded.dictionary.cast(pa.string()), led(texts.take(pa.array(whole))).cast(pa.string())])
        numbers = np.r_[coded.indices.to_numpy(), np.arange(len(coded.dictionary), len(segments))].astype(np.int64)
        bounds = np.r_[bounds, bounds[-1] + 1 + np.arange(len(whole))]
        new = segments.filter(pc.invert(pc.is_in(segments, value_set=self.known)))
        if len(new):
            self._learn(list(dict.fromkeys(new.to_pylist())))
        place = pc.index_in(segments, value_set=self.known).to_numpy().astype(np.int64)
        return np.r_[plain, whole], bounds, place[numbers]

    def totals(self, bounds: np.ndarray, segments: np.ndarray) -> np.ndarray:
        """The sums of each text's segments."""
        return np.add.reduceat(self.sums[:, segments], bounds[:-1], axis=1) if len(bounds) > 1 else self.sums[:, :0]

    def links(self, bounds: np.ndarray, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, links): the different pairs of each text, by text."""
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        keys, times = np.unique(text << 32 | segments, return_counts=True)
        text, segment = keys >> 32, keys & 0xFFFFFFFF
        size = self.start[segment + 1] - self.start[segment]
        ends = np.cumsum(size)
        at = np.repeat(self.start[segment] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        keys = np.repeat(text, size) << 32 | self.pairs[0, at]
        order = np.argsort(keys, kind="stable")
        keys, links = keys[order], (self.pairs[1, at] * np.repeat(times, size))[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        return keys[first] >> 32, keys[first] & 0xFFFFFFFF, np.add.reduceat(links, first) if len(first) else links


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, text: str = "text", doc_id: str = "doc_id", with_groups: bool = False) -> DataFrame:
    """(rid, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, groups, pairs) of every document.

    ``rid`` tells rows apart; ``groups`` is the text ``a1,a2|b1;a3|b2,b3`` of
    ids by group, if asked for; ``pairs`` has (a, b, links) of its different id pairs.
    """
    paths = (a_path or default_paths()[0], b_path or default_paths()[1])
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"rid string, doc_id {kind}, " + ", ".join(f"{c} long" for c in SUMS) + ", groups_sha256 string, groups string, pairs array<struct<a: int, b: int, links: long>>"

    def run(batches):
        segments, at, task = Segments(Tokenizers(*paths)), 0, TaskContext.get().partitionId()
        for batch in batches:
            for part in pieces_of(batch, most=SLICE_BYTES):
                size = part.num_rows
                which, bounds, numbers = segments.read(part.column("text"))
                total = segments.totals(bounds, numbers)
                good = total[len(SUMS)] == 0
                sums = np.zeros((len(SUMS), size), np.int64)
                sums[:, which] = np.where(good, total[: len(SUMS)], 0)
                joined = pc.binary_join(pa.ListArray.from_arrays(bounds.astype(np.int32), segments.groups.take(pa.array(numbers))), pa.scalar(";", pa.large_string()))
                groups, digests = [""] * size if with_groups else [None] * size, [""] * size
                for k in np.flatnonzero(good).tolist():
                    data = joined[k].as_buffer()
                    digests[which[k]] = hashlib.sha256(data).hexdigest()
                    if with_groups:
                        groups[which[k]] = data.to_pybytes().decode()
                of, pair, links = segments.links(bounds, numbers)
                of, pair, links = which[of[good[of]]], pair[good[of]], links[good[of]]
                order = np.argsort(of, kind="stable")
                ends = np.r_[0, np.cumsum(np.bincount(of, minlength=size))].astype(np.int32)
                each = pa.StructArray.from_arrays([pa.array((pair[order] // segments.width).astype(np.int32)), pa.array((pair[order] % segments.width).astype(np.int32)), pa.array(links[order])], ["a", "b", "links"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{task}-{at + k}" for k in range(size)], pa.string()), part.column("doc_id"), *map(pa.array, sums), pa.array(digests, pa.string()), pa.array(groups, pa.string()), pa.ListArray.from_arrays(ends, each)],
                    ["rid", "doc_id", *SUMS, "groups_sha256", "groups", "pairs"],
                )
                at += size
        del segments
        give_back()

    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return texts.mapInArrow(run, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a, b, n, best) of stored ``aligned`` rows: how many documents link the ids, and whether no other pair of ``a`` has more.

    The highest counts are sent to all tasks: one for each id of A's vocabulary.
    """
    counts = cut(rows.select(F.inline("pairs")).groupBy("a", "b").agg(F.count("*").alias("n")), "pairs")
    top = counts.groupBy("a").agg(F.max("n").alias("_top")).withColumnRenamed("a", "_a")
    return counts.join(F.broadcast(top), F.col("a") == F.col("_a")).select("a", "b", "n", (F.col("n") == F.col("_top")).alias("best"))


def _least_count(counts: DataFrame, most: int) -> int:
    """The smallest power of two that no more than ``most`` pairs reach."""
    sizes = {r["k"]: r["m"] for r in counts.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("m")).collect()}
    least, total = 62, 0
    for k in range(61, -1, -1):
        total += sizes.get(k, 0)
        if total > most:
            break
        least = k
    return 1 << least


def with_counts(links: DataFrame, counts: DataFrame, most: int = HEAD_PAIRS) -> DataFrame:
    """``links``, which have (a, b), with their pairs' ``n`` and ``best``."""
    frequent = F.col("n") >= _least_count(counts, most)
    head, rest = F.broadcast(counts.filter(frequent)), counts.filter(~frequent)
    if rest.isEmpty():
        return links.join(head, ["a", "b"])
    rare = links.join(F.broadcast(counts.filter(frequent).select("a", "b")), ["a", "b"], "left_anti")
    return links.join(head, ["a", "b"]).unionByName(rare.join(rest, ["a", "b"]))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, text: str = "text", doc_id: str = "doc_id", with_groups: bool = False, most: int = HEAD_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups]) of every document."""
    rows = cut(aligned(docs, a_path, b_path, text, doc_id, with_groups), "aligned")
    links = with_counts(rows.select("rid", F.inline("pairs")), cut(pair_counts(rows), "pair-counts"), most)
    sums = links.groupBy("rid").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum"))
    shown = ["doc_id", *SUMS, "n_best", "count_sum", "groups_sha256", *["groups"] * with_groups]
    return rows.drop("pairs").join(sums, "rid", "left").fillna(0, ["n_best", "count_sum"]).select(*shown)
