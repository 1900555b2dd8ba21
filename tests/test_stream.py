import random

import pytest
from pyspark.sql import functions as F

from wardflow.streaming import history as H


def rows_of(chain, run, first, last, seed=0):
    rng = random.Random(1000 * chain + 10 * (run or 0) + seed)
    every = [(chain, k, 10 * k, round(rng.random(), 6), rng.random() < 0.7, rng.random() < 0.5, run) for k in range(1, last + 1)]
    return every[first - 1 :]


def plain(rows):
    """Figures row by row."""
    worse, best, at, out = [], None, None, {}
    for _, seq, iteration, total, is_worse, accepted, _ in sorted(rows, key=lambda r: r[1]):
        if is_worse:
            worse.append(accepted)
        own = worse[-H.RECENT :]
        if accepted and (best is None or total < best):
            best, at = total, iteration
        out[seq] = (sum(own) / len(own) if len(own) >= H.LEAST_SEEN else None, best, at)
    return out


def streamed(spark, tmp_path, files, stop_after=None):
    at = f"file://{tmp_path}"
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, H.ROWS).coalesce(1).write.mode("append").parquet(f"{at}/in")
        if stop_after == k:  # the query ends here and is started again on its checkpoint
            H.finished(H.start(H.figures(H.read(spark, f"{at}/in")), f"{at}/out", f"{at}/state"), 300)
    H.finished(H.start(H.figures(H.read(spark, f"{at}/in")), f"{at}/out", f"{at}/state"), 300)
    out = spark.read.schema(H.OUT).parquet(f"{at}/out").collect()
    got = {}
    for r in out:
        if r["seq"] is not None:
            assert got.setdefault((r["chain_id"], r["run"], r["seq"]), (r["rate"], r["best"], r["best_iteration"])) is not None
    late = {}
    for r in out:
        late[r["chain_id"]] = late.get(r["chain_id"], 0) + (r["late"] or 0)
    assert len(got) == sum(r["seq"] is not None for r in out)
    return got, late


def same(got, want):
    assert set(got) == set(want)
    for k, (rate, best, at) in want.items():
        assert got[k][1:] == (best, at) and (got[k][0] is None) == (rate is None) and (rate is None or got[k][0] == pytest.approx(rate))


@pytest.mark.parametrize("numbered", [True, False])
def test_a_chain_that_is_reset_in_mid_stream(spark, tmp_path, numbered):
    run = lambda k: k if numbered else None
    first, second = rows_of(0, run(0), 1, 300), rows_of(0, run(1), 1, 40, seed=5)
    other = rows_of(1, run(0), 1, 60)
    shuffled = other[:30] if not numbered else random.Random(1).sample(other[:30], 30)
    files = [first[:250] + shuffled, first[250:] + second[:15] + other[30:45], second[15:] + other[45:], other[40:50] + second[:1] + second[20:25]]
    got, late = streamed(spark, tmp_path, files, stop_after=1)
    want = {(0, 0, k): v for k, v in plain(first).items()} | {(0, 1, k): v for k, v in plain(second).items()} | {(1, 0, k): v for k, v in plain(other).items()}
    same(got, want)
    assert late == {0: 6, 1: 10}


def test_rows_of_an_earlier_run_are_late(spark, tmp_path):
    old, new = rows_of(3, 0, 1, 50), rows_of(3, 4, 1, 20, seed=2)
    got, late = streamed(spark, tmp_path, [old[:30], new[:10], old[30:] + new[5:]])
    same(got, {(3, 0, k): v for k, v in plain(old[:30]).items()} | {(3, 4, k): v for k, v in plain(new).items()})
    assert late == {3: 25}


def test_runs_without_numbers_are_told_by_their_first_rows():
    import pandas as pd

    x = pd.DataFrame({"seq": [9, 10, 1, 2, 1, 2], "total": [0.5, 0.4, 0.9, 0.8, 0.9, 0.8], "run": [None] * 6})
    assert H.numbered_runs(x, 2, 8, 0.7).tolist() == [2, 2, 3, 3, 3, 3]
    assert H.numbered_runs(x, 0, 0, None).tolist() == [0, 0, 0, 0, 0, 0]
    x["run"] = [5, 5, None, None, 6, 6]
    assert H.numbered_runs(x, 2, 8, 0.9).tolist() == [5, 5, 2, 2, 6, 6]


def test_a_chain_takes_one_read_and_one_write_of_its_state():
    """Chains are many, and each call of the state is a message to another process."""
    calls, held = [], {}

    class Value:
        def get(self):
            calls.append("get")
            return held.get("now")

        def exists(self):
            calls.append("exists")
            return "now" in held

        def update(self, v):
            calls.append("update")
            held["now"] = v

    class Handle:
        getValueState = lambda self, *a: Value()

    f = H.Follow()
    f.init(Handle())
    rows = rows_of(5, 0, 1, 450)
    got = [r for part in (rows[:20], rows[20:300], rows[290:]) for r in f.handleInputRows((5,), iter(part), None)]
    assert calls == ["get", "update"] * 3
    assert sum(r["late"] or 0 for r in got) == 10
    same({(5, 0, r["seq"]): (r["rate"], r["best"], r["best_iteration"]) for r in got if r["seq"] is not None}, {(5, 0, k): v for k, v in plain(rows).items()})


def test_empty_stream(spark, tmp_path):
    spark.createDataFrame([], H.ROWS).write.parquet(f"{tmp_path}/in")
    q = H.start(H.figures(H.read(spark, f"file://{tmp_path}/in")), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    H.finished(q, 300)
    assert spark.read.schema(H.OUT).parquet(f"file://{tmp_path}/out").count() == 0
