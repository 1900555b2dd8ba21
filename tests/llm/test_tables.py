"""Quality rules, line dedup and mixing over rows with nulls, empty and long texts, ties and repeated rows, held against SQL or a plain computation."""

import hashlib
import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardflow.llm import line_dedup, mixing, quality_rules, registry

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def rows(seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 9))) for _ in range(300)]
    out = []
    for i in range(150):
        lines = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) for _ in range(rng.randint(1, 6))]
        if i % 9 == 0:
            lines += ["  Shared LINE here\t", "shared line here"]
        if i % 12 == 0:
            lines += ["É capital É", "x###" * 40]
        if i % 14 == 0:
            lines = [lines[0]] * 7
        out.append((i, "\n".join(lines), [None, "en", "fr"][i % 3], [None, "a", "b", "B", "ü"][i % 5] if i % 2 else "hot", 1))
    out += [(200, None, "en", "a", None), (201, "", None, None, 0), (202, "\n\n", "en", "zero", 2), (203, "   \t", "en", "zero", 4), (204, "long words " * 30_000, "fr", "b", 1), (205, "\x0b\x0c a\x00b   c", "en", "a", 1)]
    return out


def duck(sql, data):
    c = duckdb.connect()
    c.register("documents", pd.DataFrame(data, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    cur = c.execute(sql)
    names = [x[0] for x in cur.description]
    return [dict(zip(names, r)) for r in cur.fetchall()]


def frame(spark, data, tmp):
    spark.createDataFrame(data, KIND).repartition(3).write.mode("overwrite").parquet(f"{tmp}/documents.parquet")
    return str(tmp)


@pytest.mark.parametrize("name", ["op2_mixing", "op3_quality_rules", "op5_line_dedup"])
def test_query_is_its_sql(spark, tmp_path, name):
    data = rows()
    got = registry.QUERIES[name](spark, frame(spark, data, tmp_path)).toPandas().to_dict("records")
    want = duck(registry.ORACLE_SQL[name], data)
    key = lambda r: r["doc_id"]
    clean = lambda r: {k: None if v is None or v != v else round(float(v), 9) if isinstance(v, float) else v for k, v in r.items()}
    assert [clean(r) for r in sorted(got, key=key)] == [clean({k: r[k] for k in got[0]}) for r in sorted(want, key=key)]


def test_line_dedup_counts_rows_whatever_their_ids(spark, tmp_path):
    """Ten rows hold a line, of which some share an id and some have none: each row is a document, for the query and for its SQL."""
    data = [(i % 4 if i % 3 else None, f"shared\nown {i}\nshared", "en", "a", 1) for i in range(10)] + [(1, "nine", "en", "a", 1)] * 9 + [(None, None, "en", "a", 1)] * 2
    got = registry.QUERIES["op5_line_dedup"](spark, frame(spark, data, tmp_path)).collect()
    want = duck(registry.ORACLE_SQL["op5_line_dedup"], data)
    key = lambda r: (r["doc_id"] is None or r["doc_id"] != r["doc_id"], r["doc_id"] if r["doc_id"] == r["doc_id"] else None, r["n_lines"], r["n_dropped"], r["kept_sha256"])
    plain = lambda rows: sorted((-1 if key(r)[0] else int(r["doc_id"]), *key(r)[2:]) for r in rows)
    assert plain(got) == plain(want)
    assert sum(r["n_dropped"] for r in got) == 20


@pytest.mark.parametrize("name", ["op2_mixing", "op3_quality_rules", "op5_line_dedup", "op9_secrets", "op4_simhash", "op7_media_columns", "op10_sentencepiece"])
def test_empty_table(spark, tmp_path, name):
    assert registry.QUERIES[name](spark, frame(spark, [], tmp_path)).collect() == []


def test_registered_sql_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in registry.QUERIES if k.startswith("op")) == list(range(1, 11))


def test_native_operators_run_no_python(spark, tmp_path):
    at = frame(spark, rows(), tmp_path)
    d = spark.read.parquet(f"{at}/documents.parquet")
    m = quality_rules.measures(d)
    plans = [m, quality_rules.sketches(m), quality_rules.cutoffs(quality_rules.sketches(m))]
    assert not any(re.search("Python|Pandas|Arrow", p._jdf.queryExecution().toString()) for p in plans)


# ---- line dedup ----


def key_of(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)}))


def plain_dedup(texts, least):
    count = {}
    for t in texts:
        for k in {key_of(x) for x in (t or "").split("\n")}:
            count[k] = count.get(k, 0) + 1
    bad = {k for k, n in count.items() if k and n >= least}
    return [[x for x in (t or "").split("\n") if key_of(x) not in bad] for t in texts]


@pytest.mark.parametrize("batches", [1, 3, 8])
def test_line_dedup_in_batches(spark, batches):
    data = rows(4) + [(None, "shared line here\nown", None, None, None)] * 2 + [(7, "KK İ kept\nshared LINE here", "en", "a", 9)] * 3
    df = spark.createDataFrame(data, KIND).withColumns({"n_lines": F.lit("clash"), "k": F.lit(1), "th": F.lit(2), "gone": F.lit(3)})
    got = line_dedup.dedup_lines(df, min_docs=10, batches=batches).collect()
    kept = plain_dedup([r[1] for r in data], 10)
    want = sorted((str(r[0]), len((r[1] or "").split("\n")), len((r[1] or "").split("\n")) - len(k), hashlib.md5("\n".join(k).encode()).hexdigest()) for r, k in zip(data, kept))
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], hashlib.md5(r["text"].encode()).hexdigest()) for r in got) == want
    assert got[0]["gone"] == 3 and got[0]["th"] == 2


def test_runs_are_compacted(spark):
    runs = line_dedup.LineRuns(spark, min_docs=3, fanout=2, buckets=4)
    total = {}
    rng = random.Random(0)
    for _ in range(7):
        own = {k: rng.randint(1, 2) for k in rng.sample(range(40), 25)}
        for k, n in own.items():
            total[k] = total.get(k, 0) + n
        runs.add(spark.createDataFrame([(k, -k, n) for k, n in own.items()], "h1 long, h2 long, n long"))
        assert all(len(level) < 2 for level in runs.levels)
    assert {r["h1"] for r in runs.repeated().collect()} == {k for k, n in total.items() if n >= 3}
    runs.close()


# ---- mixing ----


def test_mix_is_cut_once_at_the_budget_and_reruns_agree(spark):
    data = rows(5) + [(9, "tie tie", "en", "a", 1)] * 4 + [(None, "no id", "en", None, 1)] * 2
    got = []
    for df in (spark.createDataFrame(data, KIND).repartition(7), spark.createDataFrame(list(reversed(data)), KIND)):
        q = mixing.truncated(mixing.queue(df, chunk=10), chunk=10)
        got.append(q.select("key", "source", "size", "source_size", "target", "start", "taken").toPandas())
    p = got[0]
    total = int(p["size"].sum())
    # All copies in one list, and the budget taken off it.
    copies = sorted(((r.start + k * r.source_size + r.size) / r.target, r.key is None or r.key != r.key, r.key if r.key == r.key else 0, k, r.size, r.taken[k]) for r in p.itertuples() for k in (0, 1) if r.size and r.target)
    left = 3 * total // 2
    for *_, size, taken in copies:
        assert taken == max(0, min(size, left)) or taken in (0, size)  # the last: one of equal rows
        left -= size
    assert sum(x[-1] for x in copies) == 3 * total // 2
    by = p.assign(t=[sum(x) for x in p.taken]).groupby("source", dropna=False).agg(taken=("t", "sum"), target=("target", "first"), size=("source_size", "first"), most=("size", "max"))
    assert (abs(by.taken - by.target) <= by.most).all()
    assert by.target.sum() == pytest.approx(1.5 * by["size"].sum())
    assert (by.target <= 2 * by["size"]).all()
    key = lambda f: sorted(map(str, f.drop(columns="taken").assign(t=[sum(x) for x in f.taken]).itertuples(index=False)))
    assert key(got[0]) == key(got[1])


def test_the_cut_in_each_stretch(spark, monkeypatch):
    """Few stretches, of which the last one with words holds the cut, give what many give."""
    df = spark.createDataFrame(rows(8), KIND)
    want = sorted(map(str, mixing.truncated(mixing.queue(df)).select("key", "source", "start", "taken").collect()))
    monkeypatch.setattr(mixing, "STRETCHES", 1)
    assert sorted(map(str, mixing.truncated(mixing.queue(df)).select("key", "source", "start", "taken").collect())) == want
    for share, epochs in ((0.3, 1), (2.5, 3)):
        q = mixing.truncated(mixing.queue(df, share=share, epochs=epochs), share, epochs).toPandas()
        assert sum(map(sum, q.taken)) == int(q["size"].sum() * share) and all(len(x) == epochs for x in q.taken)


def test_stream_is_in_order_of_finish(spark):
    out = mixing.mix(spark.createDataFrame(rows(6), KIND)).select("finish", "taken", "size").collect()
    assert [r["finish"] for r in out] == sorted(r["finish"] for r in out)
    assert all(0 < r["taken"] <= r["size"] for r in out)


# ---- quality rules ----


def test_buckets_keep_their_leading_bits(spark):
    got = spark.range(0, 70_000, 7).select("id", quality_rules.bucket(F.col("id")).alias("b")).collect()
    for r in got:
        low = max(0, r["id"].bit_length() - quality_rules.BITS)
        assert r["b"] == r["id"] >> low << low


def test_small_groups_take_merged_sketches(spark):
    def fake(lang, source, n, rate):
        return [(lang, source, 100, 500, rate, 0, 0, 10)] * n

    kind = "lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
    m = spark.createDataFrame(fake("en", "big", 60, 30) + fake("en", "small", 3, 0) + fake("fr", "tiny", 2, 0), kind)
    cuts = {(r["lang"], r["source"]): r["symbol_rate"]["high"] for r in quality_rules.cutoffs(quality_rules.sketches(m)).collect()}
    assert cuts == {("en", "big"): 400, ("en", "small"): 400, ("fr", "tiny"): 400}
    plain = quality_rules.judged(m, broadcast_rows=20_000).groupBy("kept").count().collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, quality_rules.judged(m, broadcast_rows=0).groupBy("kept").count().collect()))


def test_cutoffs_follow_each_group(spark):
    """The same document is fine in one source and beyond the fence in the other, for every measure; no cutoff is a constant."""
    rng = random.Random(9)

    def made(source, chars, symbols, dups, repeats):
        near = lambda x, by: max(0, round(rng.gauss(x, by)))
        return [("en", source, 1000, near(chars, 100), near(symbols, symbols / 4), near(dups, dups / 4), near(repeats, repeats / 4), 1000) for _ in range(400)]

    kind = "lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
    m = spark.createDataFrame(made("prose", 5000, 10, 20, 5) + made("tables", 8000, 600, 200, 60), kind)
    cuts = {r["source"]: r.asDict(True) for r in quality_rules.cutoffs(quality_rules.sketches(m)).collect()}
    a, b = cuts["prose"], cuts["tables"]
    for k in quality_rules.RULES:
        assert b[k]["high"] > a[k]["high"] + 50
    assert b["word_length"]["low"] > a["word_length"]["high"]
    probes = {"word_length": (1000, 8000, 10, 20, 5, 1000), "symbol_rate": (1000, 5000, 600, 20, 5, 1000), "dup_line_rate": (1000, 5000, 10, 250, 5, 1000), "repeat_rate": (1000, 5000, 10, 20, 180, 1000)}
    more = spark.createDataFrame([("en", s, *x) for s in ("prose", "tables") for x in probes.values()], kind)
    got = quality_rules.judged(m.unionByName(more)).where("n_words = 1000").join(more.drop("lang"), [c for c in more.columns if c != "lang"]).collect()
    prose = [r for r in got if r["source"] == "prose"]
    assert len(prose) == 4 and not any(r["kept"] for r in prose)
    tables = {(r["word_chars"], r["n_symbols"]): r["kept"] for r in got if r["source"] == "tables"}
    assert tables[8000, 10] and not tables[5000, 600]


def test_clashing_columns(spark):
    df = spark.createDataFrame(rows(), KIND).withColumns({"n_words": F.lit("clash"), "kept": F.lit("own"), "low": F.lit(1)})
    out = quality_rules.filter_documents(df)
    assert out.columns == df.columns and out.first()["n_words"] == "clash" and 0 < out.count() < df.count()


def test_mixed_documents_keep_columns_whatever_their_names(spark):
    df = spark.createDataFrame([(i if i % 5 else None, "a b c d", "en", "x" if i % 2 else None, 1, "own", i, i, i) for i in range(60)], KIND + ", start string, size long, target long, `a b` long")
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert len(rows) >= 85 and all(r["start"] == "own" and r["size"] == r["target"] == r["a b"] for r in rows)
    q = mixing.queue(df, chunk=2)
    assert q.where("key is null").select("source", "start").distinct().count() == 12
