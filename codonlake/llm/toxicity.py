"""Toxicity by a classifier chain.

Categories are predicted one after the other by sparse linear models on the
words of a text, their beginnings, and its shape (shares of capitals, marks and repeats). A
later model also sees the log odds of the categories before it; it is trained
with out-of-fold values, so it learns from what earlier models say of texts
they have not seen. An L1 penalty at the noise level selects the words, a light
ridge fit then sets their weights. Near copies among the labelled texts count as
one text with their most frequent label.

Models are fitted in one task on at most ``max_rows`` labelled documents, those
whose ids come first in hash order; everything else covers all rows.

Cases: a null or empty text has no words and gets the model's base rate; labels
that are null in a category, or without a document, are not used; several
labels of a document count as their maximum; without any label probabilities
are null and nothing is toxic; a category with one label value only gets that
value's rate; other columns are kept by ``reject``.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, give_back, pieces_of, rows_per_batch, split_words

#: (name, 0/1 expression over the labels), in the order of the chain
CATEGORIES = (("low_quality", "1 - quality"), ("toxic", "toxic"))
MAX_ROWS = 10_000
BITS = 40
PREFIXES = (3, 4, 5, 6, 7)
FOLDS = 3
THRESHOLD = 0.5
UPPER, MARK, WORD = 1, 2, 4


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: what it is (UPPER, MARK, WORD bits), and its lower case where that is one character."""
    every = range(0x110000)
    kind = (c.isupper() * UPPER | (not (c.isalnum() or c == "_" or c.isspace())) * MARK | c.isalnum() * WORD for c in map(chr, every))
    lower = (ord(x) if len(x := c.lower()) == 1 else ord(c) for c in map(chr, every))
    return np.fromiter(kind, np.uint8, len(every)), np.fromiter(lower, np.uint32, len(every))


@cache
def _hashed(name: str) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(name) >> (64 - BITS)


def _word_features(words: list[str]) -> np.ndarray:
    """A row a word: the word itself and its beginnings, for inflected and compound forms; -1 where it is too short."""
    from xxhash import xxh3_64_intdigest

    out = np.full((len(words), 1 + len(PREFIXES)), -1, np.int64)
    out[:, 0] = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)) >> np.uint64(64 - BITS)
    most = max(PREFIXES)
    points = np.array(words, f"U{most}").view(np.uint32).reshape(len(words), most) if words else np.empty((0, most), np.uint32)
    h = np.zeros(len(words), np.uint64)
    for j in range(most):
        h = h * np.uint64(0x9E3779B97F4A7C15) + points[:, j] + np.uint64(1)
        if j + 1 in PREFIXES:
            mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            long_enough = points[:, j] > 0
            out[long_enough, 1 + PREFIXES.index(j + 1)] = (mixed >> np.uint64(64 - BITS))[long_enough]
    return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, word) of the different words of each text, the features of every word, and those of every text's shape.

    Words are runs of letters and digits in lower case. All is counted over whole texts, for a batch at once.
    """
    kinds, lower = _characters()
    strings = texts.to_pylist()
    n = len(strings)
    length = np.fromiter(map(len, strings), np.int64, n)
    ends = np.r_[0, np.cumsum(length)]
    points = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
    kind = kinds[points]
    share = lambda bit: np.minimum(9, 20 * np.diff(np.r_[0, np.cumsum(kind & bit > 0, dtype=np.int32)][ends]) // np.maximum(length, 1))
    caps, marks = share(UPPER), share(MARK)
    plain = np.where(kind & WORD > 0, lower[points], np.uint32(32)).tobytes().decode("utf-32-le")
    bounds, numbers, words = split_words(pa.array([plain[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.string()))
    counts = np.diff(bounds)
    pairs = np.unique(np.repeat(np.arange(n), counts) * max(1, len(words)) + numbers)
    row, word = np.divmod(pairs, max(1, len(words)))
    repeats = 10 * np.bincount(row, minlength=n) // np.maximum(counts, 1)
    shape = np.full((n, 4), -1, np.int64)
    for i, (c, m, r, k) in enumerate(zip(caps.tolist(), marks.tolist(), repeats.tolist(), counts.tolist())):
        shape[i, 2:] = _hashed(f"\0repeats{r}"), _hashed(f"\0size{k.bit_length()}")
        if length[i]:
            shape[i, :2] = _hashed(f"\0caps{c}"), _hashed(f"\0marks{m}")
    return row, word, _word_features(words.to_pylist()), shape


def bags(texts: pa.Array) -> list[np.ndarray]:
    """Sorted different feature ids of each text."""
    row, word, of_word, shape = features(texts)
    at = np.searchsorted(row, np.arange(len(texts) + 1))
    every = [np.unique(np.r_[of_word[word[a:b]].ravel(), s]) for a, b, s in zip(at[:-1], at[1:], shape)]
    return [x[np.searchsorted(x, 0) :] for x in every]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Linear:
    """A logistic model with few weights: words[k] has weights[k]; then dense inputs and the base."""

    def __init__(self, words, weights, dense, base):
        self.words, self.weights, self.dense, self.base = words, weights, dense, base

    def odds(self, rows: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        """Log odds of each row of features, numbered as ``words`` are, with its dense inputs."""
        z = self.base + dense @ self.dense
        if not rows or not len(self.words):
            return z
        ids = np.concatenate(rows)
        at = np.searchsorted(self.words, ids).clip(max=len(self.words) - 1)
        value = np.where(self.words[at] == ids, self.weights[at], 0)
        return z + np.bincount(np.repeat(np.arange(len(rows)), [len(r) for r in rows]), value, len(rows))


def chain_odds(models: list[Linear], texts: pa.Array) -> np.ndarray:
    """Log odds of every text under each model of a chain, a column a model."""
    row, word, of_word, shape = features(texts)
    n = len(texts)
    every = np.unique(np.concatenate([m.words for m in models]))
    if len(every):
        place = lambda ids: np.where(every[at := np.searchsorted(every, ids).clip(max=len(every) - 1)] == ids, at, -1)
        hits = place(of_word)
        some = (hits >= 0).any(axis=1)[word]
        found = np.r_[hits[word[some]].ravel(), place(shape).ravel()]
        pairs = (np.r_[np.repeat(row[some], hits.shape[1]), np.repeat(np.arange(n), shape.shape[1])] * len(every) + found)[found >= 0]
        row, at = np.divmod(np.unique(pairs), len(every))
    dense = np.zeros((n, 0))
    for m in models:
        z = m.base + dense @ m.dense
        if len(m.words):
            weights = np.zeros(len(every))
            weights[np.searchsorted(every, m.words)] = m.weights
            z = z + np.bincount(row, weights[at], n)
        dense = np.c_[dense, z]
    return dense


class Bags:
    """Feature numbers below ``size`` of many rows, end to end."""

    def __init__(self, flat: np.ndarray, ends: np.ndarray, size: int):
        self.flat, self.ends, self.size = flat, np.r_[0, ends], size

    def __len__(self) -> int:
        return len(self.ends) - 1

    def row(self, i: int) -> np.ndarray:
        return self.flat[self.ends[i] : self.ends[i + 1]]

    def only(self, rows: np.ndarray) -> "Bags":
        """The given rows, in this order."""
        length = np.diff(self.ends)[rows]
        return Bags(np.concatenate([self.flat[:0], *map(self.row, rows)]), np.cumsum(length), self.size)

    def sums(self, of_row: np.ndarray) -> np.ndarray:
        """For each feature the sum of ``of_row`` over the rows that have it; in blocks of rows."""
        out = np.zeros(self.size)
        for a in range(0, len(self), 512):
            ends = self.ends[a : a + 513]
            out += np.bincount(self.flat[ends[0] : ends[-1]], np.repeat(of_row[a : a + 512], np.diff(ends)), self.size)
        return out

    def entries(self, features: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among ``rows``, place among ``features``) of every such row that has such a feature."""
        pos, place = np.full(self.size, -1, np.int32), np.full(len(self), -1, np.int32)
        pos[features], place[rows] = np.arange(len(features)), np.arange(len(rows))
        at = np.flatnonzero(pos[self.flat] >= 0)
        row = place[np.searchsorted(self.ends, at, "right") - 1]
        return row[row >= 0], pos[self.flat[at]][row >= 0]


def _select(bags: Bags, rows: np.ndarray, y: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Features with a weight under an L1 penalty at the level that noise reaches.

    Fitted over the few features that need a weight; the one hundred whose
    gradient most exceeds the penalty join them, until none does.
    """
    n = len(rows)
    used = (count >= 3) & (count <= n - 3)
    p = np.where(used, count / n, 0.5)
    scale = np.sqrt(p * (1 - p))
    penalty = math.sqrt(2 * math.log(max(2, used.sum())) / n) * math.sqrt(max(1e-9, y.mean() * (1 - y.mean())))
    base = math.log(y.mean() / (1 - y.mean()))
    near, w, z = np.empty(0, np.int64), np.empty(0), np.full(n, base)
    for _ in range(20):
        e = np.zeros(len(bags))
        e[rows] = _sigmoid(z) - y
        gradient = np.where(used, np.abs(bags.sums(e) - p * e.sum()) / (n * scale), 0)
        gradient[near] = 0
        more = np.argsort(-gradient, kind="stable")[:100]
        more = more[gradient[more] > penalty]
        if not len(more):
            break
        w, near = np.r_[w, np.zeros(len(more))], np.r_[near, more]
        r, c = bags.entries(near, rows)
        mean, sd = p[near], scale[near]
        times = lambda w: np.bincount(r, (w / sd)[c], n) - (w / sd) @ mean  # noqa: B023, E731
        back = lambda e: (np.bincount(c, e[r], len(near)) - mean * e.sum()) / (n * sd)  # noqa: B023, E731
        v = np.ones(len(near))
        for _ in range(12):
            v = back(times(v / np.linalg.norm(v)))
        step = 1 / (0.25 * np.linalg.norm(v) * 1.2 + 1e-9)
        u, t = w, 1.0
        for _ in range(200):
            e = _sigmoid(base + times(u)) - y
            x = u - step * back(e)
            new = np.sign(x) * np.maximum(np.abs(x) - step * penalty, 0)
            base -= min(4.0, step) * e.mean()
            t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
            u, w = new + (before - 1) / t * (new - w), new
        near, w, z = near[w != 0], w[w != 0], base + times(w)
    return np.sort(near)


def fit_linear(bags: Bags, rows: np.ndarray, dense: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> Linear:
    """A model of the given rows of ``bags``; its words are feature numbers."""
    n = len(rows)
    none = np.empty(0)
    rate = (y.sum() + 0.5) / (n + 1)
    if not 0 < y.sum() < n:
        return Linear(none.astype(np.int64), none, np.zeros(dense.shape[1]), math.log(rate / (1 - rate)))
    among = np.zeros(len(bags))
    among[rows] = 1
    count = bags.sums(among)
    chosen = _select(bags, rows, y, count)
    if len(chosen) > n // 5:
        chosen = np.sort(chosen[np.argsort(-count[chosen], kind="stable")][: n // 5])
    x = np.zeros((n, len(chosen) + dense.shape[1] + 1), np.float32)
    x[bags.entries(chosen, rows)] = 1
    x[:, len(chosen) : -1], x[:, -1] = dense, 1
    w = np.zeros(x.shape[1])
    w[-1] = math.log(rate / (1 - rate))
    own = np.full(x.shape[1], ridge)
    own[-1] = 1e-6
    for _ in range(30):
        p = _sigmoid((x @ w.astype(np.float32)).astype(np.float64))
        curve = np.diag(own)
        for a in range(0, n, 2048):  # in blocks: no second matrix of that size
            part = x[a : a + 2048]
            curve += (part * (p * (1 - p))[a : a + 2048, None].astype(np.float32)).T @ part
        step = np.linalg.solve(curve, x.T @ (p - y).astype(np.float32) + own * w)
        w = w - step * min(1, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-3:
            break
    k = len(chosen)
    return Linear(chosen, w[:k], w[k:-1], w[-1])


def one_of_copies(rows: list[np.ndarray], similar: float = 0.6, bands: int = 16, width: int = 5) -> np.ndarray:
    """For each row the index of the first row that it nearly copies, or its own.

    MinHash bands propose earlier rows, exact Jaccard similarity decides. Copies
    share their label's error, which would pass for a rule if all of them counted.
    """
    rng = np.random.default_rng(7)
    a, b = rng.integers(1, 1 << 62, bands * width, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 62, bands * width, dtype=np.uint64)
    first, seen = np.arange(len(rows)), {}
    for i, ids in enumerate(rows):
        low = np.full(bands * width, ~np.uint64(0))
        for at in range(0, len(ids), 2048):
            x = ids[at : at + 2048].astype(np.uint64)[None, :] * a[:, None] + b[:, None]
            low = np.minimum(low, (x ^ (x >> np.uint64(32))).min(axis=1))
        keys = [(k, v.tobytes()) for k, v in enumerate(low.reshape(bands, width))]
        for j in dict.fromkeys(seen[k] for k in keys if k in seen):
            both = len(np.intersect1d(ids, rows[j], assume_unique=True))
            if both >= similar * (len(ids) + len(rows[j]) - both):
                first[i] = j
                break
        else:
            for k in keys:
                seen.setdefault(k, i)
    return first


def often_seen(ids: np.ndarray | list[np.ndarray], ends: np.ndarray, least: int = 3) -> tuple[Bags, np.ndarray]:
    """(numbers of the features of all rows, feature of each number), for features of ``least`` rows or more.

    ``ids`` are the features of all rows, each row's up to its entry in
    ``ends``; several runs of them are not put together. They are numbered a
    sixteenth at a time: most are seen once, and would fill a table of all of them.
    """
    ids = [ids] if isinstance(ids, np.ndarray) else ids
    bounds = np.r_[0, np.cumsum([len(run) for run in ids], dtype=np.int64)]
    number, size, vocabulary = np.full(bounds[-1], -1, np.int32), 0, [np.empty(0, np.int64)]
    for k in range(16):
        coded = pa.chunked_array([pa.array(run[run & 15 == k]) for run in ids], pa.int64()).combine_chunks().dictionary_encode()
        code, names = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        often = np.bincount(code, minlength=len(names)) >= least
        of_code = np.where(often, size + np.cumsum(often) - 1, -1).astype(np.int32)
        numbers, at = of_code[code], 0
        for start, run in zip(bounds[:-1].tolist(), ids):
            some = np.flatnonzero(run & 15 == k)
            number[start + some] = numbers[at : (at := at + len(some))]
        vocabulary.append(names[often])
        size += int(often.sum())
    kept = number >= 0
    ends = np.r_[0, np.cumsum(kept, dtype=np.int32 if len(kept) < 1 << 31 else np.int64)][ends]
    return Bags(number[kept], ends, size), np.concatenate(vocabulary)


def fit_chain(bags: Bags, vocabulary: np.ndarray, marks: np.ndarray, fold: np.ndarray) -> list[Linear]:
    """A model for each column of ``marks``; the k-th takes k dense inputs."""
    kept, group = np.unique(one_of_copies([np.sort(bags.row(i)) for i in range(len(bags))]), return_inverse=True)
    bags, fold = bags.only(kept), fold[kept]
    every = np.arange(len(bags))
    size = np.bincount(group)
    marks = np.stack([np.bincount(group, m) / size >= 0.5 for m in marks.T], axis=1).astype(float)
    models, dense = [], np.zeros((len(bags), 0))
    for k in range(marks.shape[1]):
        y = marks[:, k]
        models.append(fit_linear(bags, every, dense, y))
        if k + 1 < marks.shape[1]:
            unseen = np.zeros(len(bags))
            for f in np.unique(fold):
                out, others = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
                model = fit_linear(bags, others, dense[others], y[others]) if len(others) else models[-1]
                unseen[out] = model.odds([bags.row(i) for i in out], dense[out])
            dense = np.c_[dense, unseen]
    order = [np.argsort(vocabulary[m.words]) for m in models]
    return [Linear(vocabulary[m.words][o], m.weights[o], m.dense, m.base) for m, o in zip(models, order)]


def training_rows(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, max_rows: int = MAX_ROWS, folds: int = FOLDS) -> DataFrame:
    """(doc_id, fold, marks, ids) of the labelled documents used, one row for each id: of several, that of the text with the smallest hash."""
    marks = labels.select(F.col("doc_id").cast("long"), *[F.expr(e).cast("double").alias(f"y{k}") for k, (_, e) in enumerate(categories)]).dropna()
    marks = marks.groupBy("doc_id").agg(F.array(*[F.max(f"y{k}") for k in range(len(categories))]).alias("marks"))
    used = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(used), "doc_id")  # max_rows rows
    texts = texts.groupBy("doc_id", "marks").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "marks", "t.text")
    texts = texts.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(folds)).cast("int"))  # copies share a fold

    def rows(batches):
        for batch in batches:
            for part in pieces_of(batch):
                ids = pa.array(bags(part.column("text")), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("fold"), part.column("marks"), ids], ["doc_id", "fold", "marks", "ids"])
        give_back()

    return texts.mapInArrow(rows, "doc_id long, fold int, marks array<double>, ids array<long>")


def train(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, max_rows: int = MAX_ROWS, folds: int = FOLDS) -> list[Linear]:
    """The fitted chain; empty if no labelled document is there."""
    with rows_per_batch(docs.sparkSession, 500):
        rows = cut(training_rows(docs, labels, categories, max_rows, folds), "toxicity-training")

    def fit(batches):
        table = pa.Table.from_batches(batches)
        order = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
        marks, fold = np.array(table.column("marks").to_pylist())[order], table.column("fold").to_numpy()[order]
        ends = np.cumsum(pc.list_value_length(table.column("ids")).to_numpy())
        ids = [c.flatten().to_numpy() for c in table.column("ids").chunks]  # still the batches' own memory
        del table, batches
        numbers, vocabulary = often_seen(ids, ends)
        del ids
        numbers = numbers.only(order)
        give_back()  # nothing of the rows is held while models are fitted
        models = fit_chain(numbers, vocabulary, marks, fold)
        out = [(k, m.words.tolist(), m.weights.tolist(), m.dense.tolist(), float(m.base)) for k, m in enumerate(models)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["k", "words", "weights", "dense", "base"])
        del numbers
        give_back()

    types = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]
    fitted = rows.coalesce(1).mapInArrow(_none_if_empty(fit), "k int, words array<long>, weights array<double>, dense array<double>, base double")
    return [Linear(np.array(r["words"], np.int64), np.array(r["weights"]), np.array(r["dense"]), r["base"]) for r in sorted(fitted.collect(), key=lambda r: r["k"])]


def _none_if_empty(fit):
    def over(batches):
        batches = [b for b in batches if b.num_rows]
        return fit(batches) if batches else iter(())

    return over


def score(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, threshold: float = THRESHOLD, **how) -> DataFrame:
    """``docs`` with p_<category> for all, and the last category's name as 0 or 1.

    Columns of ``docs`` that have one of these names are kept under ``_<name>_``.
    """
    models = train(docs, labels, categories, **how)
    names = [f"p_{n}" for n, _ in categories] + [categories[-1][0]]
    docs = docs.withColumnsRenamed({n: f"_{n}_" for n in names if n in docs.columns})

    def over(batches):
        for batch in batches:
            for part in pieces_of(batch):
                if models:
                    p = _sigmoid(chain_odds(models, pc.fill_null(part.column("text"), "")))
                    cols, last = [pa.array(c) for c in p.T], p[:, -1] >= threshold
                else:
                    cols, last = [pa.nulls(part.num_rows, pa.float64())] * len(categories), np.zeros(part.num_rows, bool)
                yield pa.RecordBatch.from_arrays([*part.columns, *cols, pa.array(last.astype(np.int32))], [*part.schema.names, *names])
        give_back()

    added = [T.StructField(n, T.DoubleType()) for n in names[:-1]] + [T.StructField(names[-1], T.IntegerType())]
    return docs.mapInArrow(over, T.StructType([*docs.schema.fields, *added]))


def reject(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, **how) -> DataFrame:
    """``docs`` without those of the last category."""
    names = [f"p_{n}" for n, _ in categories] + [categories[-1][0]]
    kept = score(docs, labels, categories, **how).filter(F.col(names[-1]) == 0)
    return kept.select(*[F.col(f"_{c}_" if c in names else c).alias(c) for c in docs.columns])
