import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from wardflow.llm import simhash as S


def brute_fingerprint(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(fps, ids, radius):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(fps))]


def test_groups_are_brute_force(spark):
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}É" if i % 7 == 0 else f"W{i}" for i in range(300)]
    texts = []
    for k in range(60):
        w = list(rng.choice(vocabulary, 400))
        texts.append(" ".join(w))
        for _ in range(k % 4):
            v = list(w)
            v[int(rng.integers(400))] = "changed"
            texts.append("\t".join(v))
    texts += [None, "", "one", "one two", "ONE two\n", texts[0], texts[0], "a b c", "a b c d"]
    ids = list(range(1000, 1000 + len(texts)))
    ids[5] = None
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(5)
    rows = S.grouped(df, 3, 1, 3).collect()
    fps = [brute_fingerprint(t) for t in texts]
    want = sorted(zip(ids, fps, brute_groups(fps, ids, 3)), key=str)
    assert sorted(((r["doc_id"], r["f0"] % 2**64, r["component_id"]) for r in rows), key=str) == want


def test_forest_with_split_blocks(monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, (12, 1), dtype=np.uint64)
    f = base[rng.integers(0, 12, 400)].copy()
    for i in range(400):
        for b in rng.integers(0, 64, int(rng.integers(0, 5))):
            f[i, 0] ^= np.uint64(1) << np.uint64(b)
    key = np.sort(rng.integers(0, 3, 400))

    def roots():
        a, b = S.forest(key, f, 3)
        r = np.arange(400)
        r[a] = b
        return r.tolist()

    whole = roots()
    monkeypatch.setattr(S, "LARGE", 30)
    assert roots() == whole
    want = []
    for k in range(3):
        own = np.flatnonzero(key == k)
        want += brute_groups([int(x) for x in f[own, 0]], own.tolist(), 3)
    assert whole == want


def test_hot_blocks_are_dealt_on(spark):
    """A third of all fingerprints lie close together; blocks of over 20 rows are spread, and no link is lost."""
    rng = np.random.default_rng(2)
    centre = rng.integers(-(2**63), 2**63, 3)
    fs = set()
    while len(fs) < 600:
        f = int(centre[int(rng.integers(0, 3))] if rng.random() < 0.7 else rng.integers(-(2**63), 2**63))
        for b in rng.integers(0, 64, int(rng.integers(0, 8))):
            f ^= (1 << int(b)) if b < 63 else -(1 << 63)
        fs.add(f)
    fs = list(fs)
    nodes = spark.createDataFrame(list(enumerate(fs)), "node long, f0 long")
    want = brute_groups([f % 2**64 for f in fs], list(range(len(fs))), 3)
    for most in (20, 1 << 16):
        got = {r["node"]: r["root"] for r in S.linked(nodes, 1, 3, False, most).collect()}
        assert [got.get(k, k) for k in range(len(fs))] == want
    blocks = nodes.select("node", "f0", F.lit(7).cast("long").alias("k"), F.lit(-1).cast("long").alias("rest"))
    parts = S.spread(blocks, len(fs), 3, 100).groupBy("k").count()
    assert parts.agg(F.max("count")).first()[0] < len(fs) / 2 and parts.count() > 10


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d", "x", 5, 6, 7, 8, 9), (2, "a b c d", "y", 5, 6, 7, 8, 9), (None, None, None, 5, 6, 7, 8, 9)], "doc_id long, text string, `a b` string, h int, least int, key int, f0 int, bands int")
    got = S.grouped(df, 3, 1, 3)
    assert {"a b", "h", "least", "key", "bands"} < set(got.columns)
    rows = sorted(got.collect(), key=lambda r: r["doc_id"] or 9)
    assert [(r["a b"], r["h"], r["least"], r["key"], r["bands"], r["component_id"]) for r in rows] == [("x", 5, 6, 7, 9, 1), ("y", 5, 6, 7, 9, 1), (None, 5, 6, 7, 9, None)]
    assert rows[0]["f0"] != 8
    assert sorted(r["doc_id"] or 0 for r in S.drop_near_duplicates(df).collect()) == [0, 1]


def test_empty(spark):
    assert S.grouped(spark.createDataFrame([], "doc_id long, text string"), 3, 1, 3).collect() == []


def test_near_duplicates_of_five_word_shingles(spark):
    rng = np.random.default_rng(1)
    docs, n = [], 0
    for k in range(40):
        w = [f"x{v}" for v in rng.integers(0, 3000, 300)]
        docs.append((n, " ".join(w), "en", 1))
        for _ in range(3):  # each is alike to 0.9 and more
            v = list(w)
            v[int(rng.integers(5, 290))] = "other"
            n += 1
            docs.append((n, " ".join(v), "en", 2))
        n += 1
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, n_chars int")
    out = S.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [4 * k for k in range(40)]


def test_pairs_are_linked_by_exact_similarity(spark):
    rng = np.random.default_rng(3)
    docs, want = [], []
    for k in range(160):
        w = [f"x{v}" for v in rng.integers(0, 10**6, 204)]  # 200 shingles
        v = list(w)
        for at in range(10, 10 + 5 * int(rng.integers(3, 8)), 5):
            v[at] = "other"  # of five shingles
        if k % 2:
            v += [f"y{x}" for x in rng.integers(0, 10**6, int(rng.integers(0, 20)))]
        sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (w, v)]
        alike = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        docs += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
        want += [2 * k] if alike >= 0.8 else [2 * k, 2 * k + 1]
        assert 0.6 < alike < 0.9
    assert 220 < len(want) < 300
    got = S.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == want


def test_equal_fingerprints_of_other_shingles(spark):
    tail = lambda k, n: " ".join(f"t{k}x{i}" for i in range(n))
    # 0 to 5: one repeated shingle decides all bits; 6: alike to 5 but for that shingle; 7: the same set as 5.
    docs = [(k, "spam " * 400 + tail(k, 20)) for k in range(5)]
    docs += [(5, "spam " * 400 + tail(5, 100)), (6, tail(5, 100)), (7, "spam " * 300 + tail(5, 100))]
    got = S.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 1, 2, 3, 4, 5]


def _similar(rng, n, length=60):
    """Word lists around a few texts: near copies, chains whose neighbours alone are alike, and others."""
    out = []
    while len(out) < n:
        w = [f"x{v}" for v in rng.integers(0, 10**6, length)]
        out.append(w)
        for k in range(int(rng.integers(0, 12))):
            v = list(out[-1] if k % 2 else w)
            v[int(rng.integers(0, length))] = f"c{rng.integers(0, 10**6)}"
            out.append(v)
    return [" ".join(w) for w in out[:n]]


def test_large_groups_of_candidates_are_dealt_to_chunks(spark):
    """Blocks of a few rows' weight count as large: the links are those of all pairs."""
    rng = np.random.default_rng(6)
    texts = _similar(rng, 220) + ["same " + " ".join(f"y{i}" for i in range(60)) + f" z{k}" for k in range(60)]
    own = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    pairs = [(i, j) for i in range(len(own)) for j in range(i) if len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j])]
    root = list(range(len(own)))
    for _ in range(len(own)):
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, uid long").repartition(5)
    got = S.grouped(docs, 5, 4, S.radius_at(0.8, 256), by_bands=True, similarity=0.8, most=5).collect()
    assert [r["component_id"] for r in sorted(got, key=lambda r: r["doc_id"])] == root


def test_blocks_beyond_a_task_meet_in_chunks(spark):
    """One block of candidates in which nothing but chains hangs together, dealt on in chunks of 4."""
    rng = np.random.default_rng(8)
    texts = _similar(rng, 90)
    own = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    want = brute_groups([0] * len(texts), list(range(len(texts))), -1)
    for _ in range(len(own)):
        for i in range(len(own)):
            for j in range(i):
                if len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j]):
                    want[i] = want[j] = min(want[i], want[j])
    nodes = spark.createDataFrame(list(enumerate(texts)), "uid long, text string")
    signed = S.signed(nodes.withColumnRenamed("uid", "node"), 5, 4, True).select("node", *(f"f{k}" for k in range(4)))
    blocks = signed.withColumn("k", F.lit(1).cast("long")).withColumn("w", F.lit(1).cast("long"))
    for most in (4, 1000):
        found = {r["node"]: r["root"] for r in S.dealt(blocks, S._linker(4, 256, 0.8, 5), len(texts), most, nodes).collect()}
        assert [found.get(k, k) for k in range(len(texts))] == want
        plan = S.large_keys(blocks, len(texts), most, F.col("w"))
        assert (plan is None) == (most == 1000)


def test_forest_begins_with_labels():
    f = np.array([[0], [1 << 40], [0], [1 << 41], [7 << 50]], np.uint64)
    a, b = S.forest(np.zeros(5, int), f, 0, label=np.array([5, 9, 6, 9, 5]))
    assert dict(zip(a.tolist(), b.tolist())) == {2: 0, 3: 1, 4: 0}


def test_a_very_long_text(spark):
    """A text of 300,000 words and its copy with one changed are linked; the fingerprint is brute force's."""
    w = [f"w{(k * 7919) % 5000}" for k in range(300_000)]
    v = list(w)
    v[1000] = "changed"
    df = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(v)), (3, "other words here")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in S.grouped(df, 3, 1, 3).collect()}
    assert got[1]["component_id"] == got[2]["component_id"] == 1 and got[3]["component_id"] == 3
    assert got[1]["f0"] % 2**64 == brute_fingerprint(" ".join(w))
