"""Vector codes against complete scans."""

import hashlib

import numpy as np
import pytest

from codonlake.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code int, error string"


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], y) for i, v, y in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: [min((d(cut(v, p), e), k) for k, e in enumerate(books[p])) for p in range(parts)]
    for _ in range(rounds):
        found = [near(v) for _, v, _ in kept]
        for p in range(parts):
            old = list(books[p])
            for k in range(len(old)):
                mine = [cut(v, p) for (_, v, _), f in zip(kept, found) if f[p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [near(v) for _, v, _ in kept]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    error = [sum(x for x, _ in f) for f in found]
    total = {}
    for (_, _, y), e in zip(kept, error):
        total[y] = total.get(y, 0) + e
    return sorted((str(i), "".join(f"{k:02x}" for _, k in f), e, total[y], digest) for (i, _, y), f, e in zip(kept, found, error))


def rows_of(df):
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


def sample(seed, n=400, dims=32, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dims))
    v = (centres[rng.integers(0, 20, n)] + rng.normal(scale=0.3, size=(n, dims))) * spread
    out = [(int(i), [float(x) for x in row], int(i) % 3 if i % 7 else None) for i, row in zip(rng.permutation(n), v)]
    out += [out[0], (n + 1, out[3][1], 1), (n + 2, [0.0] * dims, 2), (None, out[5][1], None)]
    bad = [(n + 3, None, 1), (n + 4, [float("nan")] + [0.0] * (dims - 1), 1), (n + 5, [None] * dims, 1), (n + 6, [float("-inf")] * dims, None), (-5, [], 1)]
    return out, out + bad


@pytest.mark.parametrize("spread", [1.0, 0.01, 1e5])
def test_equal_to_complete_scans(spark, spread):
    good, rows = sample(7, spread=spread)
    df = spark.createDataFrame([(*r, 0, "z") for r in rows], SCHEMA)
    assert rows_of(codes.coded_vectors(df)) == brute(good)


def test_more_labels_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(codes, "BROADCAST_LABELS", 0)
    good, rows = sample(8, n=120)
    df = spark.createDataFrame([(*r, 0, "z") for r in rows], SCHEMA)
    assert rows_of(codes.coded_vectors(df)) == brute(good)


def test_small_and_empty_tables(spark):
    assert codes.coded_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    one = [(3, [0.5, -0.5] * 16, None)]
    df = spark.createDataFrame([(*r, 0, "z") for r in one], SCHEMA)
    assert rows_of(codes.coded_vectors(df)) == brute(one)
    huge = spark.createDataFrame([(1, [1e30] * 16, 1, 0, "z")], SCHEMA)
    with pytest.raises(Exception, match="beyond"):
        codes.coded_vectors(huge).collect()


def test_active_entries_give_what_a_scan_gives():
    rng = np.random.default_rng(3)
    for _ in range(30):
        x = rng.integers(-4, 5, (200, 2, 3))
        books = rng.integers(-4, 5, (2, 9, 3))
        found = codes.assign(x, books)
        moved = rng.random((2, 9)) < 0.4
        new = np.where(moved[..., None], rng.integers(-4, 5, books.shape), books)
        again = codes.assign(x, new, (new != books).any(-1), *found)
        assert all(np.array_equal(a, b) for a, b in zip(again, codes.assign(x, new)))


def test_decompress(spark):
    good, rows = sample(9, n=100)
    coded, books = codes.compress(spark.createDataFrame([(*r, 0, "z") for r in rows], SCHEMA))
    got = codes.decompress(coded, books).filter("vec_id IS NOT NULL").collect()
    vector = {i: v for i, v, _ in good}
    for r in got:
        x = np.floor(256 * np.array(vector[r["vec_id"]], np.float32).astype(float))
        assert ((x - 256 * np.array(r["approx"])) ** 2).sum() == sum(r["best"])
