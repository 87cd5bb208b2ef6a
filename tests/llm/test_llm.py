"""Training-data operators against brute force, with odd inputs."""

import hashlib
import random
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codonlake.llm import ann, chat, common, decontam, jaccard, langid, packing, pii, slots, toxicity, warc

WORDS = [a + b for a in "ka lo mi nu re so ta vi wo xu".split() for b in "ban del fir gos hum jat kel lon mur pif".split()]


def text(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def docs_of(spark, texts):
    """Ids, texts, and columns with names that operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, 2, "z") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, size int, shard int, node string")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    out = [text(rng, rng.randrange(1, 120)) for _ in range(60)]
    base = text(rng, 150).split()
    for k in range(70):  # near copies, some of copies
        w = list(base if k % 3 or k < 3 else out[-1].split())
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        out.append(" ".join(w))
    out += [out[0], out[0].upper(), None, "", " \t\n", None, "one two", "one two", text(rng, 30_000)]
    return out


def brute_components(texts, words, percent):
    sets = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        k = min(words, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    name = list(range(len(texts)))
    for _ in sets:
        before = list(name)
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                    name[i] = name[j] = min(name[i], name[j])
        if before == name:
            break
    return [(i, len(s), name[i]) for i, s in enumerate(sets)]


@pytest.mark.parametrize("percent", [85, 80])
def test_jaccard_regions_lose_no_link(spark, texts, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL_REGION", 2)
    got = sorted(map(tuple, jaccard.near_components(docs_of(spark, texts), 4, percent).collect()))
    assert got == brute_components(texts, 4, percent)


def test_jaccard_recursion_loses_no_link(spark, texts, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL_REGION", 2)
    monkeypatch.setattr(jaccard, "LEAF_PAIRS", 0)  # no region around a pivot is compared before it is cut again
    near = texts[60:75]
    got = sorted(map(tuple, jaccard.near_components(docs_of(spark, near), 4, 85).collect()))
    assert got == brute_components(near, 4, 85)


def test_jaccard_common_phrases_make_no_companions(spark):
    rng = random.Random(6)
    line = " ".join(f"common{k}" for k in range(24))
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(300)]
    texts = [f"{t} {line}" for t in texts] + [f"{t} {line} more" for t in texts[:3]]
    docs = docs_of(spark, texts)
    met = jaccard._regions(jaccard._scanned(docs, 4, 85))
    assert met.select("node").distinct().count() < 30  # 178 with hashed classes, most of them met in the line only
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_components(docs, 4, 85).collect()}
    assert got == {k: k % 300 for k in range(303)}


def test_jaccard_linked_sets_meet_under_any_counts():
    rng = np.random.default_rng(4)
    for percent in (80, 85):
        for n in (6, 7, 20, 41, 300):
            for _ in range(20):
                x = np.unique(rng.integers(0, 2**64, n, np.uint64))
                y = np.unique(np.r_[x[rng.permutation(len(x))[: len(x) - n * (100 - percent) // 200]], rng.integers(0, 2**64, n // 20, np.uint64)])
                both = len(np.intersect1d(x, y))
                counts = rng.integers(0, 5, jaccard.CELLS).astype(np.uint32)
                met = np.intersect1d(*(jaccard.signatures(s, jaccard.Rings(percent), counts) for s in (x, y))).size
                assert met or 100 * both < percent * (len(x) + len(y) - both)


def test_jaccard_sketches_keep_every_link():
    rng = np.random.default_rng(26)
    for n in (1, 3, 63, 64, 65, 700):
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        assert jaccard.may_link(n, jaccard.sketch(x), n, jaccard.sketch(x), 85)
        for lost in range(n // 3 + 1):
            for added in (0, 1, n // 8, n // 5):
                y = np.r_[x[lost:], rng.integers(0, 1 << 63, added, dtype=np.uint64)]
                if len(y) and 100 * (n - lost) >= 85 * (n + added):
                    assert jaccard.may_link(n, jaccard.sketch(x), len(y), jaccard.sketch(y), 85)
        far = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        assert n < 63 or not jaccard.may_link(n, jaccard.sketch(x), n, jaccard.sketch(far), 85)


def test_jaccard_links_the_smallest_sets(spark):
    rng = random.Random(21)
    short = []
    for n in (7, 8, 9, 12):
        a = text(rng, n).split()
        short += [" ".join(a), " ".join([*a, "added"]), " ".join(["added", *a])]
    for n, k in ((4, 5), (8, 10)):  # linked at 80 %: some region holds both
        a, b = (np.arange(m, dtype=np.uint64) * jaccard.MULT for m in (n, k))
        assert np.intersect1d(jaccard.signatures(a, jaccard.Rings(80)), jaccard.signatures(b, jaccard.Rings(80))).size
    got = sorted(map(tuple, jaccard.near_components(docs_of(spark, short), 5, 80).collect()))
    assert got == brute_components(short, 5, 80) and got[3][2] == got[4][2] == got[5][2] == 3


def test_jaccard_links_through_rows_without_id(spark):
    rng = random.Random(22)
    base, lone = text(rng, 100).split(), text(rng, 100)
    star = [" ".join([*base[:at], "changed", *base[at + 1 :]]) for at in range(10, 90, 8)]  # linked with the base only
    rows = [(None, " ".join(base)), *enumerate(star), (None, lone), (None, lone + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in jaccard.near_components(df, 4, 85).collect()]
    want = [(0 if n <= len(star) else None) for n in range(len(rows))]
    assert [c for *_, c in brute_components([t for _, t in rows], 4, 85)] == [0] * (len(star) + 1) + [len(star) + 1] * 2
    assert sorted(map(str, got)) == sorted(str((i, n, c)) for (i, _), (_, n, _), c in zip(rows, brute_components([t for _, t in rows], 4, 85), want))


def test_jaccard_keeps_one(spark, texts):
    docs = docs_of(spark, texts)
    docs = docs.unionByName(docs.filter("doc_id = 0"))
    kept = jaccard.keep_one(docs, 4, 85)
    want = [i for i, _, c in brute_components(texts, 4, 85) if i == c]
    assert sorted(r["doc_id"] for r in kept.collect()) == want and kept.columns == docs.columns
    assert jaccard.near_components(docs.limit(0)).count() == 0


def test_filters_decide_by_row(spark):
    rng = random.Random(24)
    a, b, c, d, e = (text(rng, 60) for _ in range(5))
    rows = [(1, a), (1, b), (2, b), (3, c), (3, c), (3, d), (None, e), (None, e), (None, e + " end"), (None, d), (None, text(rng, 60)), (None, ""), (None, "")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row int")
    got = [(r["doc_id"], r["text"]) for r in jaccard.keep_one(df, 5, 80).collect()]
    one = [x for x in got if x[0] is None and x[1] in (e, e + " end")]
    assert len(one) == 1
    want = [(1, a), (1, b), (3, c), (3, d), one[0], *[(None, t) for _, t in rows[10:]]]
    assert sorted(map(str, got)) == sorted(map(str, want))

    item = text(rng, 40)
    parts = [" ".join(item.split()[:22]), " ".join(item.split()[18:])]
    rows = [(1, parts[0]), (1, parts[1]), (2, item), (2, a), (None, item), (None, item), (None, parts[0]), (None, parts[1]), (None, b), (4, None)]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row int")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    assert sorted(r["row"] for r in decontam.drop_contaminated(df, bench).collect()) == [0, 1, 3, 6, 7, 8, 9]


def test_chat_round_trip(spark):
    rng = random.Random(2)
    odd = ["</turn>", "<turn>", "\\", "\\</turn> \\\\", "\n", "", None, "é" * 50]
    rows = [(1, t, ["system", "user", "assistant"][0 if t == 0 else 1 + t % 2], rng.choice(odd) or text(rng, rng.randrange(40))) for t in range(900)]
    rows += [(2, 0, None, None), (2, 0, "a\n\\b", "x"), (None, 3, "assistant", "y"), (None, None, "assistant", "<turn>z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tokens", F.lit("clash"))
    windows = chat.format_windows(df, budget=60, history=20)
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    for conv in (1, 2, None):
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest()
        learned = "".join(x for *_, r, x in turns if r == "assistant")
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    for w in windows.filter("conv_id = 1").collect():
        assert w["tokens"] <= 60 or w["n_turns"] == 1
        assert w["n_repeated"] == 0 or chat.parse(w["formatted"])[0][0] == "system"
    assert chat.read_back(chat.format_windows(df.limit(0))).count() == 0


def test_chat_long_system_turn_is_not_repeated(spark):
    rows = [(1, 0, "system", "word " * 5000)] + [(1, t, ["assistant", "user"][t % 2], f"short {t}") for t in range(1, 200)]
    rows += [(2, 0, "system", "be kind")] + [(2, t, ["assistant", "user"][t % 2], f"short {t}") for t in range(1, 400)]
    windows = chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    long = sorted((w for w in windows if w["conv_id"] == 1), key=lambda w: (w["block"], w["no"]))
    assert sum("word" in w["formatted"] for w in long) == 1 and all(w["tokens"] <= 1024 for w in long[1:])
    assert sum(len(w["formatted"]) for w in long) < 2 * sum(len(x) + 30 for *_, x in rows[:200])
    assert all("be kind" in w["formatted"] for w in windows if w["conv_id"] == 2)
    digest = hashlib.sha256("".join(f"{r}\n{x}\n" for c, _, r, x in rows if c == 1).encode()).hexdigest()
    again = chat.read_back(spark.createDataFrame(windows, chat.WINDOWS)).filter("conv_id = 1").first()
    assert again["turns_sha256"] == digest


def test_conversation_of_control_strings(spark):
    from codonlake.llm import queries

    rows = [(-7, t, r, queries.CONTROL) for t, r in enumerate(("user", "assistant"))]
    got = chat.read_back(chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert got["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in rows).encode()).hexdigest()
    assert (got["loss_chars"], got["loss_sha256"]) == (len(queries.CONTROL), hashlib.sha256(queries.CONTROL.encode()).hexdigest())


def plain_by_regex(t):
    """The plain spans by the four patterns as they are stated, with re alone."""
    luhn = lambda d: sum(sum(divmod(int(x) * (1 + k % 2), 10)) for k, x in enumerate(reversed(d))) % 10 == 0
    digits = lambda x: re.sub("[^0-9]", "", x)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 14 <= len(digits(x)) <= 19 and luhn(digits(x))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 10 <= len(digits(x)) <= 15),
    ]
    found = [(m.start(), k, m.end(), name) for k, (name, pattern, good) in enumerate(kinds) for m in re.finditer(pattern, t) if good(m[0])]
    return [sum(f[3] == name for f in found) for name, *_ in kinds], ",".join(f"{name}:{a}:{b}" for a, _, b, name in sorted(found))


def test_pii_base_equals_the_stated_patterns(spark):
    rng = random.Random(31)
    parts = ["@", ".", "-", "+", " ", "1", "12", "255", "256", "007", "a", "b.c", "é", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "10.0.0.1", "x@y.zz", "(", ")", "9", "_%", "\n"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(4000)] + [" " * 50_000, "1." * 30_000, "a" * 100_000 + "@", "+1" + " " * 60_000, "a " * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0]), (None, texts[1]), (9999, None)], "doc_id long, text string")
    got = df.withColumn("text", F.coalesce("text", F.lit(""))).select("doc_id", "text").collect()
    rows = pii.find_spans(df).collect()
    key = lambda doc, counts, sha: (str(doc), tuple(counts), sha)
    want = sorted(key(r["doc_id"], c, hashlib.sha256(s.encode()).hexdigest()) for r in got for c, s in [plain_by_regex(r["text"])])
    assert sorted(key(r["doc_id"], [r[f"n_{k}"] for k in pii.KINDS], r["base_sha256"]) for r in rows) == want
    for r, (_, base) in ((r, plain_by_regex(texts[r["doc_id"]])) for r in rows if r["doc_id"] is not None and r["doc_id"] < 4000):
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
    assert pii.find_spans(df.limit(0)).count() == 0 and pii.redact(df.limit(0)).count() == 0


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"


def test_pii(spark):
    rng = random.Random(4)
    for _ in range(3000):
        t = "".join(rng.choices("ab.@-+ ()12%\n", k=40))
        assert [(a, b) for a, k, b in pii.plain_spans(t) if k == 0] == [m.span() for m in re.finditer(EMAIL, t)]
    cases = {
        "write to ann.b (at) mail [dot] org now": "email:9:34",
        "ｊｏｅ＠ｅｘ．ｃｏｍ": "email:0:10",
        "bob at example dot com": "email:0:22",
        "plus one five five five one two three four five six seven": "phone:0:57",
        "we met at the dot on two three walls": "",
        "10.0.0.1 and 300.1.1.1": "ip:0:8",
        "4111 1111 1111 1111": "card:0:19",
    }
    df = docs_of(spark, [*cases, None, "", "1" * 200_000, "@" * 100_000, "<(" * 50_000])
    got = {r["doc_id"]: r["spans"] for r in pii.find_spans(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values()) and not any(got[i] for i in range(len(cases), len(got)))
    red = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert red[0] == "write to [EMAIL] now" and red[len(cases)] is None


def test_pii_mixed_disguises():
    cases = {
        "192 dot 168 dot 1 dot 20": "ip:0:24",
        "192 dot 168 dot one dot one": "ip:0:27",
        "port 80, 10 dot 0 dot 0 dot 1": "ip:9:29",
        "1 nine two dot one six eight dot one point 1": "ip:0:44",
        "ten one.two.three.4": "ip:4:19",
        "4 one 1 one 1 one 1 one 1 one 1 one 1 one 1 one": "card:0:47",
        "+1 five 5 five 1 two 3 four 5 six 7": "phone:0:35",
        "ann (at) mail dot org": "email:0:21",
        "ann@mail dot org": "email:0:16",
        "ann at mail [dot] org": "email:0:21",
        "ann at mail.org": "email:0:15",
        "ann at mail dot ru": "email:0:18",
        "ann at mail dot app.": "email:0:19",
        "ann (at) mail dot internal": "email:0:26",
        "ann at mail [dot] internal": "email:0:26",
        "jane dot doe at example dot com": "email:0:31",
        "jane (dot) doe at mail dot example dot co dot uk now": "email:0:48",
        "jane dot doe@example.com": "email:0:24,email:9:24",
        "look at the dot on page one, two or three": "",
        "we sat at the table. one two three": "",
        "dates 12, 13, 14, 15, 16, 17, 18": "",
    }
    for t, want in cases.items():
        plain = pii.plain_spans(t)
        assert pii.joined(plain + pii.added_spans(t, plain)) == want, t
    assert pii.redacted("jane dot doe at example dot com") == "[EMAIL]"
    n = 30_000
    for t in (" " * n, "a@" * n, "a at " * n, "a dot " * n, "a at b dot " * n, "1" * n + "a one", "one dot " * n, "one " * n, "1 dot " * n + "x"):
        pii.added_spans(t, [])


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 16)).astype(np.float32) * rng.uniform(0.5, 2, (4000, 1)).astype(np.float32)
    x[100:140] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, []), (5040, [0.0] * 16), (5060, [float("nan")] * 16), (5080, [None] * 16), (None, [1.0] * 16), (6000, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit("clash"))
    df = df.unionByName(df.filter("vec_id < 5"))
    out = ann.nearest(df, df.filter("vec_id % 20 = 0"), 20, least_shards=3).collect()
    hits = 0
    scores = x.astype(np.float64) @ x.astype(np.float64).T
    for q in range(0, 4000, 20):
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        assert [r for r, *_ in own] == list(range(1, 21))
        want = [v for v in np.lexsort((np.arange(4000), -scores[q])) if v != q][:20]
        hits += len({v for _, v, _ in own} & set(want))
        assert all(abs(scores[q, v] - s) < 1e-9 for _, v, s in own)
        assert [(-s, v) for _, v, s in own] == sorted((-s, v) for _, v, s in own)  # ties to the smaller id
    assert hits / (200 * 20) >= 0.9 and {r["query_id"] for r in out} == set(range(0, 4000, 20))
    assert ann.nearest(df.limit(0), df.limit(0), 20).count() == 0


def test_nearest_is_exact_in_doubles_and_on_few_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 8)) * 1e100
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = ann.nearest(df, df.filter("vec_id % 20 = 0"), 20).collect()
    for q in (0, 20, 40):
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        scores = x @ x[q]
        want = [v for v in np.lexsort((np.arange(60), -scores)) if v != q][:20]
        assert [v for _, v, _ in own] == want
    few = ann.nearest(df.limit(5), df.limit(1), 20).collect()
    assert len(few) == 4


def test_slots(spark, texts):
    df = docs_of(spark, texts)
    df = df.unionByName(df.limit(5)).unionByName(df.filter("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    placed, slot_map = slots.shard_documents(df, 3, 64)
    rows = placed.collect()
    want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in rows) == want
    for s in range(3):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    even = docs_of(spark, [t for t in texts if t and len(t) < 2000])
    placed, slot_map = slots.shard_documents(even, 4, 512)
    load = [r["b"] for r in placed.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert max(load) - min(load) < 0.05 * sum(load) / 4
    grown = slots.rebalance(slot_map.filter("version = 1"), 5).collect()
    assert {r["version"] for r in grown} == {2} and {r["shard"] for r in grown} == set(range(5))
    assert slots.shard_documents(df.limit(0), 3)[0].count() == 0


def test_slot_map_is_kept_and_edited(spark, tmp_path):
    rng = random.Random(33)
    docs = spark.createDataFrame([(i, text(rng, rng.randrange(5, 60))) for i in range(3000)], "doc_id long, text string")
    path = str(tmp_path / "map")
    first, _ = slots.shard_documents(docs, 4, 256, path)
    more = docs.unionByName(docs.select((F.col("doc_id") + 3000).alias("doc_id"), F.concat("text", F.lit(" more")).alias("text")))
    second, _ = slots.shard_documents(more, 5, 256, path)
    assert [slots.load_map(spark, path, v).first()["version"] for v in (0, 1, 2)] == [0, 1, 2] and slots.load_map(spark, path).first()["version"] == 2
    of = {r["vslot"]: r["shard"] for r in slots.load_map(spark, path, 1).collect()}
    assert all(of[r["vslot"]] == r["shard"] for r in first.collect())
    load = {r["shard"]: r["b"] for r in second.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    assert len(load) == 5 and max(load.values()) - min(load.values()) < 0.1 * max(load.values())
    moved = sum(of[r["vslot"]] != r["shard"] for r in slots.load_map(spark, path).collect())
    assert moved < 0.45 * 256  # an edit, not a new deal


def test_slots_split_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(slots, "BLOCK", 7)
    rows = [(None, "x" * 99)] * 3000 + [(i, "y" * 99) for i in range(3000)]
    placed, _ = slots.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8, 64)
    got = [(r["shard"], r["slot"], r["size"], r["doc_id"]) for r in placed.collect()]
    assert sorted(r[3] for r in got if r[3] is not None) == list(range(3000)) and len(got) == 6000
    load = [sum(size for s, _, size, _ in got if s == k) for k in range(8)]
    assert max(load) - min(load) < 0.2 * sum(load) / 8
    for k in range(8):
        assert sorted(slot for s, slot, *_ in got if s == k) == list(range(load[k] // 100))


def test_toxicity(spark):
    rng = random.Random(8)
    rows = []
    for i in range(500):
        t = text(rng, 40).split()
        bad = i % 5 == 0
        if bad:
            t[rng.randrange(40)] = rng.choice(["grumk", "zloty", "vexoz"]) + rng.choice(["", "en", "s"])
        rows.append((i, " ".join(t), int(bad)))
    docs = docs_of(spark, [t for _, t, _ in rows] + [None, "", "grumken " + text(rng, 20), text(rng, 4000)])
    labels = spark.createDataFrame([(i, i % 2, y) for i, _, y in rows if i < 350] + [(9999, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["toxic"] for r in toxicity.score(docs, labels).collect()}
    held = [(got[i], y) for i, _, y in rows if i >= 350]
    assert sum(a == y for a, y in held) / len(held) > 0.95
    assert (got[500], got[501], got[502], got[503]) == (0, 0, 1, 0)
    assert toxicity.reject(docs, labels).columns == docs.columns
    assert toxicity.score(docs, labels.limit(0)).filter("toxic = 0").count() == docs.count()
    assert toxicity.score(docs.limit(0), labels).count() == 0


def plain_features(t):
    """What toxicity.bags gives for one text, counted one by one."""
    words = "".join(c if c.isalnum() else " " for c in t)
    words = "".join(x if len(x := c.lower()) == 1 else c for c in words).split()
    caps, marks = sum(map(str.isupper, t)), sum(not (c.isalnum() or c == "_" or c.isspace()) for c in t)
    shape = [f"caps{min(9, 20 * caps // max(1, len(t)))}", f"marks{min(9, 20 * marks // max(1, len(t)))}"] * bool(t)
    shape += [f"repeats{10 * len(set(words)) // max(1, len(words))}", f"size{len(words).bit_length()}"]
    of_words = toxicity._word_features(sorted(set(words)))
    assert [(r >= 0).sum() for r in of_words] == [1 + sum(len(w) >= k for k in toxicity.PREFIXES) for w in sorted(set(words))]
    return sorted({*of_words[of_words >= 0].tolist(), *(toxicity._hashed(f"\0{x}") for x in shape)})


def test_toxicity_features_are_of_the_whole_text():
    rng = random.Random(23)
    odd = ["".join(rng.choices("aZ Éßж Ж9_.ΣǅΩİ\u3000\n日", k=n)) for n in (0, 1, 2, 50, 4000, 9000)]
    late, early = "a" * 20_000 + "B" * 20_000, "B" * 20_000 + "a" * 20_000
    texts = [*odd, "", "  ", late, early, "B" * 40_000, "grumken grumkes GRUMK"]
    got = toxicity.bags(pa.array(texts))
    assert [x.tolist() for x in got] == [plain_features(t) for t in texts]
    a, b = toxicity._word_features(["grumken", "grumkes"])
    assert (a == b).sum() == 4 and (a != b).sum() == 2  # beginnings of three to six letters are shared


def test_toxicity_chain_equals_its_models_one_by_one():
    rng = random.Random(25)
    texts = [text(rng, 30) + (" grumken" if i % 3 == 0 else "") + (" zlotes" if i % 4 == 0 else "") for i in range(240)] + [""]
    rows = toxicity.bags(pa.array(texts))
    # the second category follows the first exactly: its words alone can't tell, the chain's input can
    first = np.array([float("grumken" in t) for t in texts])
    marks = np.stack([first, np.where(np.array(["zlotes" in t for t in texts]), 1 - first, first)], axis=1)
    numbers, vocabulary = toxicity.often_seen(np.concatenate(rows), np.cumsum([len(r) for r in rows]))
    for k, r in enumerate(rows):
        assert sorted(vocabulary[numbers.row(k)]) == [x for x in r if sum(x in o for o in rows) >= 3]
    models = toxicity.fit_chain(numbers, vocabulary, marks, np.arange(len(rows)) % 3)
    assert len(models[1].dense) == 1 and models[1].dense[0] > 0.3
    dense = np.zeros((len(rows), 0))
    for m in models:
        weight = dict(zip(m.words.tolist(), m.weights))
        dense = np.c_[dense, [m.base + d @ m.dense + sum(weight.get(x, 0) for x in r.tolist()) for r, d in zip(rows, dense)]]
    assert np.allclose(toxicity.chain_odds(models, pa.array(texts)), dense)


def test_toxicity_trains_later_models_on_unseen_rows(monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit_linear", lambda bags, rows, dense, y, **how: seen.append((rows, dense.copy())) or toxicity.Linear(np.array([0]), np.array([0.0]), np.zeros(dense.shape[1]), float(len(seen))))
    monkeypatch.setattr(toxicity, "one_of_copies", lambda rows: np.arange(len(rows)))
    fold = np.array([0, 0, 0, 1, 1, 2, 2, 2, 2] * 4)
    bags = toxicity.Bags(np.arange(36, dtype=np.int32), np.arange(1, 37), 36)
    toxicity.fit_chain(bags, np.arange(36), np.ones((36, 2)), fold)
    first, *folds, last = seen
    assert len(first[0]) == len(last[0]) == 36 and first[1].shape[1] == 0
    for f, (rows, _) in enumerate(folds):  # the value of a row is that of the model fitted without its fold
        assert rows.tolist() == np.flatnonzero(fold != f).tolist()
        assert (last[1][fold == f, 0] == f + 2).all()


def test_toxicity_keeps_columns_of_its_own_names(spark):
    docs = spark.createDataFrame([(i, "grumken ka" if i % 4 == 0 else "lo mi", f"t{i}", i * 1.5) for i in range(40)] + [(40, None, None, None)], "doc_id long, text string, toxic string, p_toxic double")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    kept = toxicity.reject(docs, labels)
    assert kept.schema == docs.schema
    left = {r["doc_id"] for r in kept.collect()}
    assert sorted(map(tuple, kept.collect()), key=str) == sorted((tuple(r) for r in docs.collect() if r["doc_id"] in left), key=str)
    assert "_toxic_" in toxicity.score(docs, labels).columns


def test_warc(spark):
    long = "<p>é" + "x" * 1200
    rows = [(1, "http://a b/\r\nX: y", long), (2, None, long), (7, "u", long), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" + "y" * 990), (None, "u", long), (3, "u", "short")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_digest", F.lit(1))
    got = warc.roundtrip(df).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(h or "" for p, _, h in rows if p == r["page_id"])
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html.encode()), hashlib.sha1(html.encode()).hexdigest())
        again = html == long and r["page_id"] != 7
        assert (r["record_type"], r["refers_to"]) == (("revisit", 7) if again else ("response", None))
        assert r["html"] == (None if again else html)
    assert warc.resolve_revisits(warc.headers(df.limit(0))).count() == 0 and warc.roundtrip(df.limit(0)).count() == 0


def test_warc_archives_end_by_bytes(spark, tmp_path):
    import gzip

    df = spark.createDataFrame([(i, "u", f"{i}" + "z" * 3000) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, str(tmp_path / "a"), archive_bytes=20_000)
    files = [gzip.decompress(f.read_bytes()) for f in (tmp_path / "a").glob("part-*")]
    assert sum(f.count(b"WARC/1.1\r\n") for f in files) == 40 and max(map(len, files)) <= 20_000
    dates = {d.decode() for f in files for d in re.findall(rb"WARC-Date: (.*?)\r\n", f)}
    assert len(dates) == 1 and re.fullmatch(r"20[0-9]{2}-[0-9-]{5}T[0-9:]{8}Z", dates.pop())
    assert warc.read_archives(spark, str(tmp_path / "a")).count() == 40


def test_decontamination(spark, monkeypatch):
    rng = random.Random(9)
    items = [text(rng, n) for n in (12, 30, 60, 5)] + ["too short here", None, ""]
    docs = [text(rng, 300) + " " + items[0].upper() + "! " + text(rng, 200), text(rng, 50), items[1], " ".join(items[2].split()[:-8]), " ".join(items[2].split()[:30]), items[3], "too short here", None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("n", F.lit("clash"))
    df = docs_of(spark, docs)
    df = df.unionByName(df.filter("doc_id = 0"))
    sh = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"[^\W_]+", (t or "").lower())] for i in range(len(w) - 4)}
    want = {(i, j, len(sh(d) & sh(t))) for i, d in enumerate(docs) for j, t in enumerate(items) if sh(t) and 100 * len(sh(d) & sh(t)) >= 80 * len(sh(t))}
    assert {(r["doc_id"], r["item_id"], r["n_shared"]) for r in decontam.contained_items(df, bench).collect()} == want and want
    kept = decontam.drop_contaminated(df, bench)
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(docs))) - {i for i, *_ in want}
    assert decontam.contained_items(df, bench.limit(0)).count() == decontam.contained_items(df.limit(0), bench).count() == 0
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)  # documents meet the items over several tasks a hash
    assert {(r["doc_id"], r["item_id"], r["n_shared"]) for r in decontam.contained_items(df, bench).collect()} == want
    assert {r["doc_id"] for r in decontam.drop_contaminated(df, bench).collect()} == {r["doc_id"] for r in kept.collect()}
    short = decontam.contained_items(df, bench.filter("item_id = 4"), words=3).collect()
    assert {(r["doc_id"], r["item_id"]) for r in short} == {(6, 4)}


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    of = Tokenizer.from_file(packing.default_tokenizer())
    odd = ["a\u00a0b\u2003c", "x\x1cy", "don't  stop\u0301", "e\u0301 e \u0301", "ΑΣ ΟΔΟΣ", "İstanbul", "<|endoftext|> z", "日本語 テキスト"]
    df = docs_of(spark, texts + odd)
    df = df.unionByName(df.limit(4))
    rows = packing.pack(df, capacity=256).collect()
    want = []
    for r in df.collect():
        ids = [*of.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want += [(r["doc_id"], k, a, len(p := ids[a : a + 256]), zlib.crc32(np.array(p, "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 256))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    bins = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert bins.get(r["sequence_id"], 0) == r["offset"]
        bins[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(bins.values()) <= 256 and len(bins) <= -(-sum(bins.values()) // 256) + 1
    assert packing.pack(df.limit(0)).count() == 0


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_give_the_ids_of_whole_texts(file, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHED_WORDS", 50)  # forgotten again and again
    rng = random.Random(27)
    path = public_tokenizers.path(file)
    ids, of = packing.WordIds(path), Tokenizer.from_file(path)
    assert (ids.pattern is None) == file.startswith("byte")
    for _ in range(30):
        texts = ["".join(rng.choices(["a", "B", "é", "e\u0301", "İ", "ǅ", "ﬁ", " ", "\u00a0", "\n", "'s", "'S", "9", "12", "...", "_", "日", "<|endoftext|>", "\x85", "ß", "Σ", "\u0301"], k=rng.randrange(40))) for _ in range(20)]
        assert [x.tolist() for x in ids.encode(pa.array(texts, pa.string()))] == [e.ids for e in of.encode_batch(texts, add_special_tokens=False)]


def test_fullest_is_the_best_subset():
    rng = random.Random(1)
    for _ in range(200):
        lengths = [rng.randrange(1, 40) for _ in range(8)]
        counts = {x: lengths.count(x) for x in lengths}
        used = packing.fullest(counts, sorted(counts, reverse=True), 60)
        sums = {0}
        for x in lengths:
            sums |= {s + x for s in sums}
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= 60)
        assert all(n <= counts[k] for k, n in used.items())


def test_language(spark):
    rng = random.Random(3)
    make = {"en": lambda: " ".join(rng.choices("the of and with house river stone".split(), k=30)), "de": lambda: " ".join(rng.choices("der und mit haus fluss stein über".split(), k=30))}
    rows = [(i, make[k](), k, "s%d" % (i % 3), 0) for i, k in enumerate(["en", "de"] * 40)] + [(80, None, None, None, 0), (81, "", None, "s1", 0), (82, "x" * 300_000, None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    page = '<html lang="{}"><script>if(a<b){{}}</script><p>{}</p>'
    pages = [(i, f"http://h{i % 2}.site.{k}/x", page.format(k, make[k]())) for i, k in enumerate(["en", "de"] * 20)] + [(40, None, None), (41, "http://h1.site.de/", page.format("de", "")), (42, "::", "<" * 50_000)]
    pages = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("lang", F.lit("clash"))
    got = langid.identify(pages, docs).collect()
    assert len(got) == len(rows) + 43
    by_doc, by_page = ({r[c]: r for r in got if r[c] is not None} for c in ("doc_id", "page_id"))
    assert all(by_doc[i]["lang"] == k for i, _, k, *_ in rows if k)
    assert all(by_page[i]["lang"] == k for i, k in enumerate(["en", "de"] * 20)) and by_page[41]["lang"] == "de"
    assert all(0 < r["p"] <= 1 for r in got)
    assert {r["lang"] for r in langid.identify(pages, docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {None}


def test_language_fusion_equals_brute_force(spark):
    rng = random.Random(35)
    words = {"en": "the of and with house river stone".split(), "de": "der und mit haus fluss stein nicht".split()}
    mixed = lambda k: " ".join(rng.choices(words[k] + words["en"][:2], k=8))
    docs = spark.createDataFrame([(i, mixed(k), k, f"s{i % 3}") for i, k in enumerate(["en", "de"] * 12)], "doc_id long, text string, lang string, source string")
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.site.{k}/{k if i % 2 else 'x'}/", f'<html lang="{k}"><p>{mixed(k)}') for i, k in enumerate(["en", "de", "de"] * 6)], "page_id long, url string, html string")
    langs, weights = langid.train(docs)
    rows = []
    for r in [*langid.page_rows(pages).collect(), *langid.document_rows(docs).collect()]:
        g = langid.grams(langid.visible(bytes(r["text"])) if r["page_id"] is not None else bytes(r["text"]))
        t = weights[g].mean(axis=0, dtype=np.float64) * min(len(g), langid.TEXT_GRAMS) * langid.TEXT_WEIGHT
        q = np.exp(t - t.max())
        rows.append((r, t - t.max(), q / q.sum()))
    total, S = sum(q for *_, q in rows), langid.SMOOTH
    whole = total / total.sum()
    want = {}
    for r, t, q in rows:
        same = lambda key: [x for o, _, x in rows if o["host"] is not None and o[key] == r[key]]  # noqa: B023, E731
        ds, hs = same("domain"), same("host")
        back = (sum(ds) - q + S * whole) / (len(ds) - 1 + S)
        z = t + np.log(np.maximum((sum(hs) - q + S * back) / (len(hs) - 1 + S), 1e-9))
        for kind in ("declared", "suffix", "tag"):
            own = [x for o, _, x in rows if r[kind] is not None and o[kind] == r[kind]]
            if len(own) > 1:
                z = z + np.log((np.maximum(sum(own) - q, 0) + S * (len(own) - 1) / total.sum() + 1e-9) / (np.maximum(total - q, 0) + S))
        p = np.exp(z - z.max())
        want[r["doc_id"], r["page_id"]] = (langs[int(z.argmax())], float((p / p.sum()).max()))
    got = {(r["doc_id"], r["page_id"]): (r["lang"], r["p"]) for r in langid.identify(pages, docs).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-5 for k in want)
    assert langid.train(docs, most_languages=1)[0] == ["de"]


@pytest.fixture(scope="module")
def small_tables(spark, tmp_path_factory):
    """Tables with copies, near copies, toxic words, a benchmark passage and personal data."""
    rng = random.Random(36)
    path = tmp_path_factory.mktemp("tables")
    item = text(rng, 60)
    docs = [text(rng, 80) for _ in range(40)]
    docs += [docs[0], docs[1] + " end", text(rng, 40) + " " + item + " " + text(rng, 40), docs[2] + " ann@example.com", None, ""]
    docs += [text(rng, 60) + " grumk zloty " + text(rng, 20) for _ in range(20)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, int(i >= 46)) for i in range(66) if i % 5], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path), docs, item


def test_pipeline_stage_by_stage(spark, small_tables):
    import corpus_pipeline

    path, docs, item = small_tables
    now = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = now.columns, []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, path)
        if name != "packing":
            assert now.columns == columns
            now = spark.createDataFrame(now.collect(), now.schema)
            kept.append({r["doc_id"]: r["text"] for r in now.collect()})
    toxic, joined, clean, redacted = kept
    assert set(range(66)) - set(toxic) >= set(range(46, 66)) and {*range(44)} <= set(toxic)
    # 40 copies 0; 41 and 43 are near copies of 1 and 2; rows without words stay
    assert set(joined) == set(toxic) - {40, 41, 43}
    assert set(clean) == set(joined) - {42}
    assert all(redacted[i] == (None if clean[i] is None else pii.redacted(clean[i])) for i in clean)
    pieces = now.collect()
    assert {r["doc_id"] for r in pieces} == set(redacted)
    whole = corpus_pipeline.run(spark, path)
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in whole.collect()) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in pieces)


def test_pipeline_on_empty_tables_and_clashing_columns(spark, small_tables, tmp_path):
    import corpus_pipeline

    path, *_ = small_tables
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(str(tmp_path / "empty" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
    clash = spark.read.parquet(f"{path}/documents.parquet").withColumns({c: F.lit("x") for c in ("row", "node", "toxic", "p_toxic", "h", "hs", "n", "length")})
    docs = clash
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == clash.columns, name
    assert docs.filter("toxic = 'x' AND row = 'x'").count() == docs.count() > 30


def test_queries_run_over_given_tables(spark):
    from pathlib import Path

    from codonlake.llm import queries

    data = "/root/testdata/sf0.001"
    if not Path(data).exists():
        pytest.skip("no tables here")
    docs = spark.read.parquet(f"{data}/documents.parquet").count()
    for name in ("op2_pii_spans", "op4_virtual_slots", "op6_toxicity_chain"):
        assert queries.QUERIES[name](spark, data).count() == docs


def test_pii_single_figures_between_spelled_dots():
    for text in ("host 1 9 2 dot 1 6 8 dot one dot one now", "host 1 0 dot 0 dot 0 dot 2 5 now"):
        found = pii.added_spans(text, pii.plain_spans(text))
        assert [text[a:b] for a, k, b in found if pii.KINDS[k] == "ip"] == [text[5:-4]]
    text = "call 10 20 dot 30 dot 40 dot 50"
    assert [text[a:b] for a, _, b in pii.added_spans(text, pii.plain_spans(text))] == ["20 dot 30 dot 40 dot 50"]


def test_pii_spans_in_time_linear_in_their_number():
    import time

    took = []
    for n in (4_000, 16_000):
        text = " ".join(f"user{k} (at) host{k} dot org, a{k}@b{k}.com" for k in range(n))
        start = time.process_time()
        plain = pii.plain_spans(text)
        assert len(plain) == n == len(pii.added_spans(text, plain))
        took.append(time.process_time() - start)
    assert took[1] < 10 * took[0]


def test_a_kept_slot_map_keeps_its_number_of_slots(spark, tmp_path):
    docs = docs_of(spark, [f"text {k}" for k in range(300)])
    slots.shard_documents(docs, 4, n_slots=64, map_path=str(tmp_path / "map"))
    placed, versions = slots.shard_documents(docs, 4, n_slots=4096, map_path=str(tmp_path / "map"))
    assert placed.count() == 300 and versions.select("vslot").distinct().count() == 64


def test_toxicity_trains_on_one_row_of_an_id(spark):
    rows = [(i % 3, f"text {i}") for i in range(300)] + [(5, "no label"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(4)], "doc_id long, quality int, toxic int")
    used = toxicity.training_rows(docs, labels, max_rows=4).collect()
    assert sorted(r["doc_id"] for r in used) == [0, 1, 2]
    assert sorted(map(repr, used)) == sorted(map(repr, toxicity.training_rows(docs.repartition(7), labels, max_rows=4).collect()))


def test_parts_are_learned_once_whatever_stands_around_them(monkeypatch):
    ids = packing.WordIds(packing.default_tokenizer())
    learned = []
    whole = ids._whole
    monkeypatch.setattr(ids, "_whole", lambda texts: learned.extend(texts) or whole(texts))
    texts = ["Don't stop, STREET 'street", "stop; (street) don't—stop!", "δρόμος Street's 42"]
    assert [x.tolist() for x in ids.encode(pa.array(texts))] == [e.ids for e in ids.of.encode_batch(texts, add_special_tokens=False)]
    assert len(learned) == 1 and len(set(learned[0].split(" "))) == len(learned[0].split(" "))
    ids.encode(pa.array(["street, (stop) don't 2"]))
    assert len(learned) == 1  # words are new, their parts are not


def test_features_of_many_batches_are_numbered_where_they_are():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 500, 40)) for _ in range(50)]
    ends = np.cumsum([len(r) for r in rows])
    one, names = toxicity.often_seen(np.concatenate(rows), ends)
    several, same = toxicity.often_seen(rows, ends)
    assert names.tolist() == same.tolist() and one.flat.tolist() == several.flat.tolist() and one.ends.tolist() == several.ends.tolist()


def test_slices_put_short_batches_together_and_cut_long_ones():
    batches = [pa.RecordBatch.from_pydict({"text": ["x" * n] * k}) for n, k in ((3, 2), (0, 1), (4, 9), (50, 1))]
    slices = list(common.slices_of(iter(batches), most=12))
    assert [t for s in slices for t in s.column("text").to_pylist()] == [t for b in batches for t in b.column("text").to_pylist()]
    assert slices[0].num_rows == 4 and list(common.slices_of(iter([]))) == []


def test_words_are_hashed_as_arrays(monkeypatch):
    monkeypatch.setitem(sys.modules, "xxhash", None)  # no call for each word
    rng = random.Random(21)
    words = list(dict.fromkeys(["".join(rng.choices("ab\u00e9 \0", k=rng.randrange(40))) for _ in range(20_000)] + ["x" * n for n in range(1, 500, 7)]))
    got = jaccard._hashed(pa.array(words))
    assert len(set(got.tolist())) == len(words) and (jaccard._hashed(pa.array(["q", *words, ""])[1:-1]) == got).all()
    texts = [" ".join(rng.choices("abcdef", k=n)) for n in (0, 1, 3, 4, 300)]
    for t, found in zip(texts, jaccard.shingle_sets(pa.array(texts), 3)):
        w = t.split()
        assert len(found) == len({tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} - {()}) and (np.diff(found) > 0).all()
