import math
import random

import duckdb
import numpy as np
import pytest

from wardflow.llm import vector_codes as V

DATA = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    """The same by loops: every part against every entry."""
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            got = [[] for _ in books[p]]
            for _, v, _ in kept:
                got[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(g) for c in zip(*g)] if g else e for e, g in zip(books[p], got)]
    out = []
    for i, v, lab in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab))
    return [(i, c, e, sum(x[2] for x in out if x[3] == lab)) for i, c, e, lab in out], books


def rows_of(df):
    return sorted((tuple(r) for r in df.select("key", "code", "error", "label_error").collect()), key=str)


def test_query_is_its_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    cur = c.execute(V.OP13_SQL)
    names = [x[0] for x in cur.description]
    got = V.op13_vector_codes(spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(cur.fetchall())


@pytest.mark.parametrize("seed", range(3))
def test_broken_rows_ties_and_repeats(spark, seed):
    rng = random.Random(seed)
    rows = [(i // 2 if i % 7 == 0 else i, [rng.randint(-40, 40) / 32 for _ in range(32)], rng.choice([None, 1, 2])) for i in range(150)]
    rows += rows[:20] + [(1, None, 1), (2, [None] * 32, 1), (3, [float("nan")] * 32, 2), (4, [float("inf")] + [0.0] * 31, 2), (None, rows[5][1], None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, KIND).repartition(5)
    got, books = V.compressed(df, "vec_id", "embedding", "label")
    want, wanted_books = brute(rows)
    assert rows_of(got) == sorted(want, key=str)
    assert [b.tolist() for b in books] == wanted_books


def test_few_rows_and_none(spark):
    rows = [(5, [0.5] * 16, 1), (3, [-0.5] * 16, 1)]
    got, books = V.compressed(spark.createDataFrame(rows, KIND), "vec_id", "embedding", "label")
    assert rows_of(got) == [(3, "00" * 16, 0, 0), (5, "01" * 16, 0, 0)]
    assert all(len(b) == 2 for b in books)
    got, books = V.compressed(spark.createDataFrame([], KIND), "vec_id", "embedding", "label")
    assert got.collect() == [] and V.digest(books) == V.digest([])


def test_other_lengths_huge_values_and_clashing_names(spark):
    rows = [(1, [1.0] * 16, 1, "a", 7), (2, [2.0] * 16, 1, "b", 8), (3, [2.0] * 8, 1, "c", 9), (4, [1e30] * 16, None, "d", 9)]
    df = spark.createDataFrame(rows, KIND + ", code string, key long")
    got, books = V.compressed(df, "vec_id", "embedding", "label")
    assert rows_of(got) == sorted([(1, "00" * 16, 0, 0), (2, "01" * 16, 0, 0), (3, None, None, 0), (4, None, None, None)], key=str)
    assert V.compressed(df.where("vec_id < 3").select("vec_id", F_slice(10), "label"), "vec_id", "embedding", "label")[0].count() == 2


def F_slice(n):
    from pyspark.sql import functions as F

    return F.slice("embedding", 1, n).alias("embedding")


def test_tree_is_exact_and_prunes():
    rng = np.random.default_rng(3)
    centres = rng.integers(-150, 150, (8, 4))
    for width, spread in ((4, 150), (1, 3), (2, 2)):
        e = (centres[rng.integers(0, 8, 64), :width] + rng.integers(-spread // 5 - 1, spread // 5 + 1, (64, width))).astype(np.int64)
        x = (centres[rng.integers(0, 8, 5000), :width] + rng.integers(-spread // 4 - 1, spread // 4 + 1, (5000, width))).astype(np.int64)
        at, d, looked = V.Tree(e).nearest(x)
        every = ((x[:, None] - e[None]) ** 2).sum(2)
        assert (d == every.min(1)).all() and (at == every.argmin(1)).all()  # argmin: the first of equals
        assert looked < 0.8 * every.size


def test_roots_are_rounded_outwards():
    x = np.r_[np.arange(2000), np.random.default_rng(1).integers(0, 1 << 54, 2000)]
    for v, low, high in zip(x.tolist(), V.root(x).tolist(), V.root_up(x).tolist()):
        v <<= V.FINE
        assert low == math.isqrt(v) and high == low + (low * low < v)
