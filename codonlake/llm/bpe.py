"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

A text is cut into words by the tokenizer's pattern. A word's bytes, each the
id of its own piece at first, are folded by ranked merges: of all neighbours
that have a join, those with the smallest rank are merged, the first of equal
ones before the others, until no neighbours have one. Joins come from a map
that is a literal of the plan, an array of buckets by CRC: from two ids to the
id, which is the rank, of the piece that they make together.

While they are merged, an id stands as the character of that number, so that
ids compare as ranks do and a word's pieces are one string; ZERO stands for id
0, which some functions would take for nothing. Private-use characters mark
keys and values in the map. Ids are stored as little-endian 32-bit numbers.

The HEAD most frequent words are folded first, and their ids are a literal like
the ranks; other words are folded where they occur. Which words are in the head
changes no result, only the work: no text is shuffled and nothing is kept that
grows with the corpus.

A step of the fold costs the length of its word, so that a word of n bytes
costs n * n: 20,000 letters without a break take some seconds.

Cases: a null text is an empty one and has no ids, as has an empty text; rows
repeated, without an id or of equal id are rows of their own; no rows give no
rows; other columns stay. Words of the pattern are found by Java's Unicode tables.
"""

from __future__ import annotations

import base64
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD = 1 << 18
BUCKETS = 1 << 15
#: Marks between pieces and values; no piece or id has them (fixed values).
OPEN, CLOSE, END = "\ue000", "\ue001", "\ue002"
#: Stands for no join; behind all ids.
NONE = "\uf8ff"
#: Stands for id 0 while words are merged; a byte's id, so that its place among ranks does not matter.
ZERO = "\ue010"
#: Stands for the ids of a word that a map does not have.
UNKNOWN = "\ue003"
#: Ids that are characters, short of the surrogates.
MOST_IDS = 0xD800


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    """The tokenizer's word pattern, with white space as Unicode has it."""
    import public_tokenizers

    return "(?U)" + public_tokenizers.PATTERN


def load_ranks(path: str | None = None) -> dict[bytes, int]:
    with open(path or default_ranks(), "rb") as f:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
    if max(ranks.values(), default=0) >= MOST_IDS or any(r == 0 and len(p) > 1 for p, r in ranks.items()) or not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError(f"ids must be below {MOST_IDS}, every byte a piece, and id 0 that of a byte")
    return ranks


class LiteralMap:
    """A map from texts to texts as one literal: buckets by CRC, each ``default OPEN key CLOSE value OPEN …``."""

    def __init__(self, items, default: str = "", buckets: int = BUCKETS):
        rows = [[default] for _ in range(buckets)]
        for key, value in items:
            rows[zlib.crc32(key.encode()) % buckets].append(f"{OPEN}{key}{CLOSE}{value}")
        self.buckets = F.split(F.lit(END.join(map("".join, rows))), END)
        self.size = buckets

    def get(self, key: Column) -> Column:
        """The value of ``key``, or the default."""
        bucket = F.element_at(self.buckets, (F.crc32(key) % self.size + 1).cast("int"))
        return up_to(up_to(bucket, F.concat(F.lit(OPEN), key, F.lit(CLOSE)), -1), F.lit(OPEN), 1)


def up_to(text: Column, mark: Column, count: int) -> Column:
    """substring_index with a mark that is a column."""
    return F.call_function("substring_index", text, mark, F.lit(count))


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def merged(word: Column, joins: LiteralMap, of_byte: str) -> Column:
    """The ids of a word, a character each; ``of_byte`` has the id of each byte.

    The state has the ids of the pieces and, for each but the last, the id of
    its join with the next one, NONE where there is none. A step puts the
    smallest join in place of its two pieces and looks up the joins at its two
    sides.
    """
    latin = "".join(map(chr, range(256)))
    first = F.translate(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), latin, of_byte)
    letter = lambda text, at: F.substring(text, at, F.lit(1))
    looked_up = lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 1), lambda k: joins.get(F.substring(p, k, F.lit(2))))
    begin = bind(first, lambda p: F.struct(p.alias("p"), F.when(F.length(p) > 1, F.array_join(looked_up(p), "")).otherwise("").alias("r")))

    def step(s, _):
        p, r = s["p"], s["r"]

        def merge(new, i):
            """Pieces i and i + 1, from 1, become ``new``."""
            before = F.when(i > 1, joins.get(F.concat(letter(p, i - 1), new))).otherwise("")
            behind = F.when(i < F.length(r), joins.get(F.concat(new, letter(p, i + 2)))).otherwise("")
            return F.struct(
                F.concat(F.substring(p, F.lit(1), i - 1), new, F.substr(p, i + 2)).alias("p"),
                F.concat(F.substring(r, F.lit(1), i - 2), before, behind, F.substr(r, i + 2)).alias("r"),
            )

        return bind(F.array_min(F.split(r, "")), lambda low: F.when((low != "") & (low < NONE), bind(F.instr(r, low), lambda i: merge(low, i))).otherwise(s))

    rounds = F.sequence(F.lit(1), F.greatest(F.octet_length(word) - 1, F.lit(1)))
    return F.aggregate(rounds, begin, step, lambda s: s["p"])


def words(text: Column, pattern: str | None = None) -> Column:
    """The words of a text, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern or default_pattern()), F.lit(0))


def letter_of(i: int) -> str:
    return chr(i) if i else ZERO


class Vocabulary:
    """What the expressions need of a rank file."""

    def __init__(self, path: str | None = None):
        ranks = load_ranks(path)
        self.of_byte = "".join(letter_of(ranks[bytes([b])]) for b in range(256))
        self.joins = LiteralMap(self._joins(ranks), NONE)

    @staticmethod
    def _joins(ranks: dict[bytes, int]):
        """(ids of two pieces, id of the piece of their bytes), for all pieces and all their cuts in two."""
        for piece, rank in ranks.items():
            for k in range(1, len(piece)):
                a, b = ranks.get(piece[:k]), ranks.get(piece[k:])
                if a is not None and b is not None:
                    yield letter_of(a) + letter_of(b), letter_of(rank)

    def merged(self, word: Column) -> Column:
        return merged(word, self.joins, self.of_byte)


def frequent(docs: DataFrame, text: str, vocabulary: Vocabulary, most: int = HEAD, pattern: str | None = None) -> LiteralMap:
    """The ids of the ``most`` most frequent words; UNKNOWN for others."""
    each = docs.select(F.explode(words(F.col(text), pattern)).alias("word")).filter(~F.col("word").rlike(f"[{OPEN}{CLOSE}{END}]"))
    head = each.groupBy("word").count().orderBy(F.desc("count"), "word").limit(most).select("word")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = head.repartition(tasks).select("word", vocabulary.merged(F.col("word")).alias("ids"))
    return LiteralMap(((r["word"], r["ids"]) for r in rows.toLocalIterator()), UNKNOWN, 2 * BUCKETS)


def encode(docs: DataFrame, text: str = "text", path: str | None = None, head: int = HEAD, pattern: str | None = None) -> DataFrame:
    """``docs`` with the column ``ids``: its text's ids as little-endian 32-bit numbers."""
    vocabulary = Vocabulary(path)
    known = frequent(docs, text, vocabulary, head, pattern)
    of = lambda w: bind(known.get(w), lambda ids: F.when(ids == UNKNOWN, vocabulary.merged(w)).otherwise(ids))
    letters = F.replace(F.array_join(F.transform(words(F.col(text), pattern), of), ""), F.lit(ZERO), F.lit("\0"))
    return docs.withColumn("ids", F.encode(F.regexp_replace(letters, "(?s)(.)", "$1\u0000"), "UTF-16LE"))


def count(ids: Column) -> Column:
    return (F.length(ids) / 4).cast("long")


def numbers(ids: Column) -> Column:
    """Binary ids as an array of integers."""
    return F.transform(_characters(ids), F.ascii)


def _characters(ids: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.decode(ids, "UTF-16LE"), "(?s)(.)\u0000", "$1"), ""), lambda c: c != "")


def decode(ids: Column, path: str | None = None) -> Column:
    """The bytes that binary ids stand for: their pieces, one after the other."""
    by_id = {rank: piece.decode("latin-1") for piece, rank in load_ranks(path).items()}
    pieces = F.split(F.lit(END.join(by_id.get(i, "") for i in range(max(by_id) + 1))), END)
    return F.encode(F.array_join(F.transform(numbers(ids), lambda i: F.element_at(pieces, i + 1)), ""), "ISO-8859-1")


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, the last from decoded ids."""
    coded = encode(docs.select(doc_id, text), text, **how)
    return coded.select(doc_id, count(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(decode(F.col("ids"), how.get("path")), 256).alias("decoded_sha256"))
