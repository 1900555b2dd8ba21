import itertools
import zlib

import numpy as np
import pytest

from wardflow.llm import line_crf as C

DATA = "/root/testdata/sf0.01"


def test_marginals_are_brute_force():
    rng = np.random.default_rng(3)
    length = np.array([1, 3, 5])
    emit, turn = rng.normal(size=(3, 5, 2)), rng.normal(size=(2, 2))
    for d, n in enumerate(length):
        emit[d, n:] = 0
    p, seen, _ = C.marginals(emit, length, turn, True)
    turns = np.zeros((2, 2))
    for d, n in enumerate(length):
        weight = {y: np.exp(sum(emit[d, k, y[k]] for k in range(n)) + sum(turn[a, b] for a, b in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=int(n))}
        z = sum(weight.values())
        for k in range(n):
            assert p[d, k, 1] == pytest.approx(sum(v for y, v in weight.items() if y[k]) / z)
        for y, v in weight.items():
            for a, b in itertools.pairwise(y):
                turns[a, b] += v / z
    assert seen == pytest.approx(turns)


def test_held_out_accuracy(spark):
    out = C.op1_quality_classifier(spark, DATA).toPandas()
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    x = out.merge(labels, on="doc_id")
    assert len(out) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert (x.held_out == x.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    x = x[x.held_out]
    good, bad = x[x.quality == 1].score.to_numpy(), x[x.quality == 0].score.to_numpy()
    auc = (good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2
    assert auc > 0.95
    assert (x[x.quality == 1].predicted == 1).mean() > 0.95
    assert (out.predicted == (out.score >= 0.3)).all()


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, "a\n\nb"), (4, "\n" * 500), (5, "word " * 40_000), (5, "word " * 40_000), (6, "😀 café")]
    w, turn = np.random.default_rng(0).normal(size=(3 * C.N_OWN, 2)), np.zeros((2, 2))
    got = C.scored(spark.createDataFrame(rows, "doc_id long, text string"), w, turn).collect()
    assert len(got) == len(rows)
    assert all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert len(by[4]["line_labels"]) == 501 and by[1]["score"] == by[2]["score"]
    assert C.scored(spark.createDataFrame([], "doc_id long, text string"), w, turn).collect() == []


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in C.scored(docs, *C.learn(docs, none)).collect()] == [0.5, 0.5]


def test_null_labels_and_clashing_columns(spark):
    """Rows whose label or id is null teach nothing, and columns named like the result's are not read."""
    import numpy as np

    from wardflow.llm import line_crf as L

    good, bad = "A plain line of words that says something.\nAnd one more of them.", "$$$ ### 12 12 12\n$$$ ### 12 12 12"
    docs = spark.createDataFrame([(k, good if k % 2 else bad, 1.0, "x", 3) for k in range(40)] + [(None, good, 1.0, "x", 3)], "doc_id long, text string, score double, line_labels string, quality int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    more = labels.unionByName(spark.createDataFrame([(30, None), (None, 1), (31, 7)], "doc_id long, quality int"))
    w, turn = L.learn(docs.drop("quality"), more)
    again, _ = L.learn(docs.drop("quality"), labels)
    assert (w == again).all() and np.abs(w).max() > 0
    got = L.scored(docs, w, turn)
    assert got.columns == ["doc_id", "score", "line_labels"]
    by = {r["doc_id"]: r for r in got.collect()}
    assert all((by[k]["score"] > 0.5) == (k % 2 == 1) for k in range(40)) and by[None]["score"] > 0.5
    assert all(set(by[k]["line_labels"]) <= {"0", "1"} and len(by[k]["line_labels"]) == 2 for k in range(40))
    none, _ = L.learn(docs.drop("quality"), labels.where("quality = 5"))
    assert (none == 0).all()
