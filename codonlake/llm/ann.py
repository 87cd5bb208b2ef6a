"""Nearest neighbours by a robust-pruned directed graph in every shard.

Different vectors are dealt over shards by hash; equal ones are one node that
knows its smallest ids. A task builds the graph of its shard: greedy searches
from the entry point propose neighbours for a batch of new nodes, relaxed
distance pruning keeps diverse ones, and reverse edges are pruned likewise (of
the reverse edges that one batch proposes to a node, twice its degree are looked
at). The index - vectors with their edges - is stored. Queries then meet every
shard in a stream sorted so that the index comes first; a beam search answers
them in blocks, and the best of all shards are kept. A shard of no more vectors
than are asked for is returned whole; every other one is searched by its graph.

Nearness is the largest inner product. Graphs work on Euclidean distance after
one more component has made all norms equal, which orders vectors alike; scores
are inner products of the original vectors, float or double, in double precision.

Cases: vectors that are null, empty, zero or hold null, NaN or infinite
components take no part, nor do rows without an id; vectors of different length
are not compared; rows with a query's own id are never its neighbours; repeated
rows count once; ties go to the smaller id; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

DEGREE = 32
BEAM = 72
ALPHA = 1.2
SHARD_ROWS = 100_000
LEAST_SHARDS = 12
BLOCK_CELLS = 32_000_000

INDEX = "dim int, shard int, pos int, ids array<long>, vector array<{kind}>, edges array<int>"


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part; an array of doubles stays one, others become float."""
    good = "size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)"
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{_kind(embeddings)}>"))
    return rows.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").filter(good)


def _kind(embeddings: DataFrame) -> str:
    return "float" if dict(embeddings.dtypes)["embedding"] == "array<float>" else "double"


def _lift(x: np.ndarray) -> np.ndarray:
    """``x``, scaled, with a component that makes all norms equal."""
    x = x / max(np.abs(x).max(initial=0).astype(np.float64), np.finfo(np.float64).tiny)
    norms = np.einsum("ij,ij->i", x, x, dtype=np.float64)
    return np.c_[x, np.sqrt(np.maximum(norms.max(initial=0) - norms, 0))].astype(np.float32)


def _asked(q: np.ndarray) -> np.ndarray:
    """Queries among lifted vectors; their own lengths don't matter."""
    q = q / np.abs(q).max(axis=1, keepdims=True).astype(np.float64)
    return np.c_[q, np.zeros(len(q))].astype(np.float32)


def beam_search(x: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, squared distances less the query's norm), nearest first; node -1 where there are fewer."""
    b = len(queries)
    norms = np.einsum("ij,ij->i", x, x)
    seen = np.zeros((b, len(x)), bool)
    node = np.full((b, beam), -1, np.int32)
    dist = np.full((b, beam), np.inf, np.float32)
    todo = np.zeros((b, beam), bool)
    node[:, 0], todo[:, 0], seen[:, entry] = entry, True, True
    dist[:, 0] = norms[entry] - 2 * (queries @ x[entry])
    live = np.arange(b)
    while len(live):
        at = todo[live].argmax(axis=1)
        todo[live, at] = False
        new = edges[node[live, at]]
        fresh = new >= 0
        fresh &= ~seen[live[:, None], np.where(fresh, new, 0)]
        rows, cols = np.nonzero(fresh)
        ids = new[rows, cols]
        seen[live[rows], ids] = True
        far = np.full(new.shape, np.inf, np.float32)
        far[rows, cols] = norms[ids] - 2 * np.einsum("ij,ij->i", x[ids], queries[live[rows]])
        d = np.concatenate([dist[live], far], axis=1)
        best = np.argsort(d, axis=1, kind="stable")[:, :beam]
        dist[live] = np.take_along_axis(d, best, 1)
        node[live] = np.take_along_axis(np.concatenate([node[live], np.where(fresh, new, -1)], axis=1), best, 1)
        todo[live] = np.take_along_axis(np.concatenate([todo[live], fresh], axis=1), best, 1)
        live = live[todo[live].any(axis=1)]
    return node, dist


def robust_prune(x: np.ndarray, of: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node in ``of`` at most ``degree`` of its candidates (-1: none), near and diverse."""
    out = np.full((len(of), degree), -1, np.int32)
    for at in range(0, len(of), 256):
        p, c = of[at : at + 256], cand[at : at + 256]
        good = (c >= 0) & (c != p[:, None])
        v = x[np.where(good, c, 0)]
        sq = np.einsum("bcd,bcd->bc", v, v)
        d = sq + np.einsum("bd,bd->b", x[p], x[p])[:, None] - 2 * np.einsum("bcd,bd->bc", v, x[p])
        d = np.where(good, d, np.inf)
        order = np.argsort(d, axis=1, kind="stable")
        d, c, v, sq = (np.take_along_axis(y, order if y.ndim == 2 else order[:, :, None], 1) for y in (d, c, v, sq))
        between = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
        alive = np.isfinite(d)
        rows = np.arange(len(p))
        for k in range(degree):
            first = alive.argmax(axis=1)
            has = alive[rows, first]
            if not has.any():
                break
            out[at : at + 256, k][has] = c[rows, first][has]
            alive &= ~((alpha * alpha * between[rows, first] <= d) & has[:, None])
            alive[rows, first] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """(edges, entry) over the lifted vectors ``x``; edges hold -1 where a node has fewer."""
    n = len(x)
    edges = np.full((n, degree), -1, np.int32)
    mean = x.mean(axis=0)
    entry = int((np.einsum("ij,ij->i", x, x) - 2 * x @ mean).argmin())
    order = np.random.default_rng(n).permutation(n)
    order = np.r_[entry, order[order != entry]].astype(np.int32)
    start = min(n, 64)
    edges[order[:start]] = robust_prune(x, order[:start], np.tile(order[:start], (start, 1)), degree, alpha)
    at = start
    while at < n:
        size = max(32, min(at // 3, 2000, BLOCK_CELLS // n))
        new = order[at : at + size]
        found, _ = beam_search(x, edges, entry, x[new], beam)
        edges[new] = robust_prune(x, new, found, degree, alpha)
        source = np.repeat(new, degree)
        target = edges[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        o = np.argsort(target, kind="stable")
        source, target = source[o], target[o]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        wide = min(int(count.max()), 2 * degree)
        rank = np.arange(len(target)) - np.repeat(first, count)
        cand = np.full((len(nodes), degree + wide), -1, np.int32)
        cand[:, :degree] = edges[nodes]
        some = rank < wide
        cand[np.repeat(np.arange(len(nodes)), count)[some], degree + rank[some]] = source[some]
        cand = np.take_along_axis(cand, np.argsort(cand < 0, axis=1, kind="stable"), 1)
        full = (cand >= 0).sum(axis=1) > degree
        edges[nodes[~full]] = cand[~full, :degree]
        if full.any():
            edges[nodes[full]] = robust_prune(x, nodes[full].astype(np.int32), cand[full], degree, alpha)
        at += len(new)
    return edges, entry


def build_index(vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS, least_shards: int = LEAST_SHARDS) -> DataFrame:
    """The stored index of ``usable`` vectors: one row for each different vector."""
    smallest = F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))
    few = vectors.distinct().withColumn("rank", smallest).filter(F.col("rank") <= k + 1)  # more of equal vectors are never among k
    nodes = cut(few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    shards = max(least_shards, -(-nodes.count() // shard_rows))
    nodes = nodes.withColumn("dim", F.size("embedding")).withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int"))
    nodes = nodes.repartitionByRange(shards, "dim", "shard")  # a task a shard
    fields = INDEX.format(kind=_kind(vectors))

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        flat = table.column("embedding").combine_chunks()
        x = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
        edges, entry = build_graph(_lift(x)) if len(x) > k + 1 else (np.full((len(x), 1), -1, np.int32), 0)
        order = np.r_[entry, np.delete(np.arange(len(x)), entry)]  # the entry is node 0
        place = np.empty(len(x) + 1, np.int32)
        place[order], place[-1] = np.arange(len(x)), -1
        table = table.take(order)
        edges = pa.FixedSizeListArray.from_arrays(pa.array(place[edges[order]].ravel()), edges.shape[1]).cast(pa.list_(pa.int32()))
        cols = [table.column("dim"), table.column("shard"), pa.array(range(len(x)), pa.int32()), table.column("ids"), table.column("embedding"), edges]
        return pa.table(dict(zip([c.split()[0] for c in fields.split(", ")], cols)))

    return cut(nodes.select("dim", "shard", "ids", "embedding").groupBy("dim", "shard").applyInArrow(build, fields), "graph-index")


class _Shard:
    """The index of one shard, gathered row by row, then searched."""

    def __init__(self, key):
        self.key, self.parts, self.x = key, [], None

    def add(self, batch: pa.RecordBatch) -> None:
        self.parts.append(batch)

    def ready(self) -> None:
        table = pa.Table.from_batches(self.parts).sort_by("pos").combine_chunks()
        self.parts = []
        n = len(table)
        self.x = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        self.edges = table.column("edges").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        ids = table.column("ids").combine_chunks()
        self.first, self.ids = ids.offsets.to_numpy(), ids.flatten().to_numpy()
        self.lifted = _lift(self.x)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, beam: int):
        """(query_id, vec_id, score) columns with up to k rows for each query."""
        n, out = len(self.x), []
        step = max(1, min(1024, BLOCK_CELLS // max(n, 1)))
        for at in range(0, len(queries), step):
            q, own = queries[at : at + step], query_ids[at : at + step]
            if n <= k + 1:
                found = np.tile(np.arange(n), (len(q), 1))
            else:
                found, _ = beam_search(self.lifted, self.edges, 0, _asked(q), max(beam, k + 2))
            row, col = np.nonzero(found >= 0)
            node = found[row, col]
            score = np.einsum("ij,ij->i", self.x[node].astype(np.float64), q[row].astype(np.float64))
            many = self.first[node + 1] - self.first[node]
            row, score = np.repeat(row, many), np.repeat(score, many)
            vec = self.ids[np.repeat(self.first[node], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
            row, score, vec = (y[vec != own[row]] for y in (row, score, vec))
            order = np.lexsort((vec, -score, row))
            row, score, vec = row[order], score[order], vec[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            best = rank < k
            out.append((own[row[best]], vec[best], score[best]))
        return [np.concatenate(c) for c in zip(*out)]


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = 20, beam: int = BEAM, **how) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each row of ``queries``."""
    index = build_index(usable(embeddings), k, **how)
    asked = usable(queries).distinct().withColumn("dim", F.size("embedding"))
    shards = index.select("dim", "shard").distinct()
    asked = asked.join(F.broadcast(shards), "dim")  # a row a shard
    asked = asked.select("dim", "shard", F.lit(None).cast("int").alias("pos"), F.array("vec_id").alias("ids"), F.col("embedding").alias("vector"), F.lit(None).cast("array<int>").alias("edges"))
    rows = index.withColumn("kind", F.lit(0)).unionByName(asked.withColumn("kind", F.lit(1)))
    parts = max(1, shards.count())
    rows = rows.repartitionByRange(parts, "dim", "shard").sortWithinPartitions("dim", "shard", "kind")

    def search(batches):
        shard = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "shard", "kind")])
            cuts = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                part, key = batch.slice(a, b - a), tuple(keys[:2, a])
                if shard is None or shard.key != key:
                    shard = _Shard(key)
                if keys[2, a] == 0:
                    shard.add(part)
                    continue
                if shard.x is None:
                    shard.ready()
                own = part.column("ids").flatten().to_numpy()
                q = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in shard.search(own, q, k, beam)], ["query_id", "vec_id", "score"])

    found = rows.mapInArrow(search, "query_id long, vec_id long, score double").distinct()
    best = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return best.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
