import math
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from wardflow.llm import language_id as L

KIND = "doc_id long, text string, lang string, source string"


def plain_grams(text):
    """N-grams by slices, as texts."""
    s = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    words = s.split()
    if not words:
        return Counter()
    s = f" {' '.join(words)} "
    return Counter(s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1))


def test_grams_are_the_plain_ones():
    for text in ("Ab, c!", "  ÉTÉ été 99 x_y", "日本語 テキスト", "a", "İI", "x" * 5000, "\ud800a"):
        want = Counter()
        for g, n in plain_grams(text).items():
            x = np.zeros(1, np.uint64)
            for k, c in enumerate(g, 1):
                x = (x ^ np.uint64(ord(c))) * L.ODD[k % 4]
                x ^= x >> np.uint64(29)
            want[int(((x * L.ODD[0]) >> np.uint64(48))[0])] += n
        assert Counter(L.grams(text).tolist()) == want
    for text in (None, "", "12 &&& _", "²³"):
        assert not len(L.grams(text))


def sample(seed=1, n=240):
    rng = random.Random(seed)
    kinds = {"en": ["the", "and", "th", "ing", "er"], "fr": ["que", "eau", "é", "les", "ou"], "de": ["sch", "ung", "ü", "der", "ei"]}
    rows = []
    for i in range(n):
        lang = ("en", "en", "fr", "de")[i % 4]
        rows.append((i, " ".join("".join(rng.choices(kinds[lang], k=2)) for _ in range(rng.randint(3, 40))), lang, "s"))
    return rows


def test_held_out_accuracy_and_nulls(spark):
    rows = sample()
    more = [(1000, None, "en", None), (None, "", None, None), (1001, "12 %%% 9", "fr", "s"), (1002, "the and ing ther", None, None), *rows[:3], (1003, "the and " * 60_000, "en", "s")]
    df = spark.createDataFrame(rows + more, KIND)
    model = L.learn(df.where("doc_id is null or doc_id < 160"))
    assert model.langs == ["de", "en", "fr"] and len(model.features) < 2000
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in L.predicted(df, model, ["doc_id", "lang"]).collect()]
    by = {i: (p, s) for i, p, s in got}
    assert len(got) == len(rows) + len(more)
    assert sum(by[i][0] == lang for i, _, lang, _ in rows[160:]) >= 0.99 * 80
    assert by[1000] == by[None] == by[1001] == ("und", 0.0)
    assert by[1002][0] == by[1003][0] == "en"
    assert all(0 <= s <= 1 for _, _, s in got)


def test_document_frequencies_cover_all_rows_and_fits_are_bounded(spark):
    rows = sample(n=400)
    df = spark.createDataFrame(rows, KIND)
    small = L.learn(df, max_docs=60)
    frequency = np.zeros(1 << L.BITS)
    for r in rows:
        frequency[np.unique(L.grams(r[1]))] += 1
    assert np.allclose(small.idf, np.log(401 / (1 + frequency)) + 1)
    again = L.learn(df.repartition(7), max_docs=60)
    assert (small.weights == again.weights).all() and (small.features == again.features).all()
    # A bound on features leaves at least a document of each language, whatever its length.
    tiny = L.learn(df.unionByName(spark.createDataFrame([(9000, "les que " * 50_000, "it", "s")], KIND)), max_features=40)
    assert tiny.langs == ["de", "en", "fr", "it"]
    top = L.learn(df, max_langs=1)
    assert top.langs == ["en"]


def test_copies_and_empty_tables(spark):
    rows = sample() + [(2000 + i, "les que eau", "fr", "s") for i in range(500)]
    model = L.learn(spark.createDataFrame(rows, KIND))
    assert L.predict(["les que eau ou"], model)[0] == ["fr"]
    none = spark.createDataFrame([], KIND)
    assert L.learn(none) is None
    assert L.predicted(none, None, ["doc_id"]).collect() == []
    assert L.predict(["abc"], None) == (["und"], [0.0])


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame(sample(n=80), KIND).selectExpr("*", "1 as lang_pred", "2 as score", "3 as _text", "4 as f", "5 as a")
    got = L.predicted(df, L.learn(df), ["doc_id"])
    assert got.columns == ["doc_id", "lang_pred", "score"] and got.count() == 80


def test_elastic_net_makes_weights_zero_and_temperature_fits():
    rng = np.random.default_rng(2)
    xs = [(np.arange(5), np.r_[y, 1 - y, rng.normal(0, 0.01, 3)]) for y in (0, 1) * 100]
    ys = np.array([0, 1] * 100)
    w, _ = L.ftrl(xs, ys, 2, 5, l1=1.0)
    assert (w[2:] == 0).all() and w[0, 1] > 0 > w[0, 0]
    assert (np.abs(L.ftrl(xs, ys, 2, 5, l2=50.0)[0]).max() < np.abs(w).max())
    # Of scores that are right in 80 of 100 cases, whatever their size, the temperature makes a probability of about 0.8.
    t = L.temperature(np.tile([[9.0, 0.0]], (1000, 1)), np.array([0] * 800 + [1] * 200))
    assert math.isclose(L.softmax(np.array([9.0, 0.0]) / t)[0], 0.8, abs_tol=0.01)


def test_query(spark):
    data = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r for r in pq.read_table(f"{data}/documents.parquet").to_pylist()}
    got = L.op11_language_id(spark, data).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert held and sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.97 * len(held)
