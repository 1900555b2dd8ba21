import hashlib
import random
import re

import duckdb

import corpus_pipeline as C
from tests.llm.test_pieces import brute as brute_ids
from wardflow.llm import mixing, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=9):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 9))) for _ in range(4000)]
    prose = lambda n: "\n".join(" ".join(rng.choices(vocabulary, k=25)) for _ in range(n // 25))
    rows, i = [], 0

    def add(text):
        nonlocal i
        rows.append((i, text, "en" if i % 3 else "fr", f"src{i % 4}" if i % 5 else "hot", len(text or "")))
        i += 1

    shared = "We use cookies on this site to improve it"
    for k in range(120):
        text = prose(100 + 25 * (k % 8))
        add(text if k % 4 else f"{text}\n{shared}")
        if k % 10 == 0:  # an exact copy and one with a word changed
            add(text)
            w = text.split(" ")
            w[len(w) // 2] = "changed"
            add(" ".join(w))
        if k % 15 == 0:
            add(" ".join(x + "###" for x in prose(100).split()))  # symbols
            add(prose(25) * 8)  # repetition
    add(None)
    add("")
    add("too short")
    return rows


def plain(rows):
    """The same pipeline over lists: DuckDB for rules, lines and mix, word sets for copies, dynamic programming for pieces."""

    def sql(text, rows):
        import pandas as pd

        c = duckdb.connect()
        documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])
        c.register("documents", documents)
        cur = c.execute(text)
        names = [x[0] for x in cur.description]
        return [dict(zip(names, r)) for r in cur.fetchall()]

    kept = {r["doc_id"] for r in sql(quality_rules.OP3_SQL, rows) if r["kept"]}
    rows = [r for r in rows if r[0] in kept]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    count = {}
    for r in rows:
        for k in {key(x) for x in (r[1] or "").split("\n")}:
            count[k] = count.get(k, 0) + 1
    bad = {k for k, n in count.items() if k and n >= 10}
    rows = [(r[0], t := "\n".join(x for x in (r[1] or "").split("\n") if key(x) not in bad), r[2], r[3], len(t)) for r in rows]
    sets = []
    for r in rows:
        w = WORD.findall(r[1].lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    gone = {b for a in range(len(rows)) for b in range(a + 1, len(rows)) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    rows = [r for i, r in enumerate(rows) if i not in gone]
    queue = sql(mixing.OP2_SQL, rows)
    copies = sorted((r["finish"] + k * r["source_size"] / r["target"], r["doc_id"], k, r["size"]) for r in queue for k in (0, 1) if r["size"])
    out, left = [], 3 * sum(r["size"] for r in queue) // 2
    for _, i, _, size in copies:
        out += [next(x for x in rows if x[0] == i)] * (left > 0)
        left -= size
    return sorted((r[0], r[1], r[4], tuple(brute_ids(r[1])), hashlib.sha256(r[1].encode()).hexdigest()) for r in out)


def test_run_is_the_plain_one(spark):
    rows = corpus()
    at = spark.conf.get("spark.checkpoint.dir") + "/corpus"
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.mode("overwrite").parquet(f"{at}/documents.parquet")
    got = sorted((r["doc_id"], r["text"], r["n_chars"], tuple(r["ids"]), r["decoded_sha256"]) for r in C.run(spark, at).collect())
    want = plain(rows)
    assert {r[0] for r in got} == {r[0] for r in want}
    assert got == want


def test_two_runs_leave_each_other_alone(spark):
    """A second run deletes nothing that the first one's result reads, and a run leaves only what its result reads."""
    at = spark.conf.get("spark.checkpoint.dir") + "/corpora"
    frames = []
    for seed in (3, 4):
        df = spark.createDataFrame(corpus(seed)[:60], "doc_id long, text string, lang string, source string, n_chars long")
        df.write.mode("overwrite").parquet(f"{at}/{seed}/documents.parquet")
        frames.append(C.run(spark, f"{at}/{seed}"))
    stage = C.STAGES[0][1](spark, spark.read.parquet(f"{at}/3/documents.parquet"), "")
    counts = [f.count() for f in frames]
    assert min(counts) > 40 and stage.count() > 30 and [f.count() for f in frames] == counts


def test_stages_keep_the_columns(spark):
    df = spark.createDataFrame([(1, None, None, None, None), (None, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, df, "").columns == df.columns
        assert stage(spark, df.limit(0), "").collect() == []
