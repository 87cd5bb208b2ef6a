"""Token alignment against offsets compared one by one."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from codonlake.llm import align_tokens

WORDS = "The quick, brown fox's tail don't 12345 éèêaiment ouéaieuxlepa 今日は Straße \U0001f600 naïve (x==y) &amp; <|endoftext|> <s> <0x0A> ab internationalization".split()


def sample():
    rng = random.Random(11)
    out = [" ".join(rng.choices(WORDS, k=rng.randrange(1, 60))) for _ in range(50)]
    out += ["".join(rng.choice([" ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x1f", " ", "　", *WORDS, *WORDS]) for _ in range(30)) for _ in range(60)]
    out += ["\n".join(rng.choices(WORDS, k=20)) for _ in range(10)] + ["".join(rng.choices("theionrs ", k=80)) for _ in range(20)]
    out += ["", None, " ", "\n", "a\n", "\na", "a ", "a▁b", "\0", out[0], out[0], "a" * 3_000, " ".join(WORDS * 300), "=" * 500]
    return out


def brute(texts):
    t = align_tokens.Tokenizers(*align_tokens.default_paths())
    docs, count = [], Counter()
    for text in texts:
        data = (" " + (text or "")).encode()
        a, b = t.a.encode(data.decode(), add_special_tokens=False).ids, t.b.encode(text or "")
        if not text or b"".join(t.a_bytes[i] for i in a) != data or b"".join(t.b_bytes[i] for i in b) != data:
            docs.append(None)
            continue
        ends = []
        for ids, table in ((a, t.a_bytes), (b, t.b_bytes)):
            at, e = 0, []
            for i in ids:
                at += len(table[i])
                e.append(at)
            ends.append(e)
        both, groups, i, j = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
        for e in both:
            p, q = ends[0].index(e, i) + 1, ends[1].index(e, j) + 1
            groups.append((a[i:p], b[j:q]))
            i, j = p, q
        links = Counter((x, y) for g, h in groups for x in g for y in h)
        count.update(links.keys())
        docs.append((len(a), len(b), groups, links))
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = d
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((n_a, n_b, len(groups), sum(links.values()), sum(m for k, m in links.items() if count[k] == top[k[0]]), sum(m * count[k] for k, m in links.items()), hashlib.sha256(text.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("most", [1 << 20, 40, 0])
def test_equal_to_comparing_all_ends(spark, most):
    texts = sample()
    df = spark.createDataFrame([(None if k == 3 else k // 2, t, "x", 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, groups string, n long, a int").repartition(3)
    got = align_tokens.align(df, most=most).collect()
    want = [((None if k == 3 else k // 2), *w) for k, w in enumerate(brute(texts))]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_groups_are_what_is_counted(spark):
    texts = [t for t in sample() if t]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for r in align_tokens.align(df, with_groups=True).collect():
        groups = [g.split("|") for g in r["groups"].split(";")] if r["groups"] else []
        assert (len(groups), sum(len(g[0].split(",")) for g in groups), sum(len(g[1].split(",")) for g in groups)) == (r["n_groups"], r["n_a"], r["n_b"])
        assert r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if groups else "")


def test_common_ends():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randrange(1, 60)
        a, b = ([*sorted(rng.sample(range(1, n), rng.randrange(0, n))), n] for _ in "ab")
        both = sorted(set(a) & set(b))
        assert align_tokens.common_ends(a, b) == ([a.index(e) + 1 for e in both], [b.index(e) + 1 for e in both])
    assert align_tokens.common_ends([], []) == ([], [])


def test_segments_are_what_the_whole_text_gives():
    of = align_tokens.Tokenizers(*align_tokens.default_paths())
    assert of.cuts


def test_empty_tables(spark):
    schema = "doc_id long, text string"
    assert align_tokens.align(spark.createDataFrame([], schema)).collect() == []
    got = align_tokens.align(spark.createDataFrame([(1, None), (None, "")], schema)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted([repr((1, 0, 0, 0, 0, 0, 0, "")), repr((None, 0, 0, 0, 0, 0, 0, ""))])
