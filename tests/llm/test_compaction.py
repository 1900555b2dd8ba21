import datetime
import hashlib
import math
import random
import zlib

import pyarrow.dataset as ds
import pyarrow.parquet as pq
import pytest

from wardflow.llm import compaction as C

DATA = "/root/testdata/sf0.001"
DAY = 86_400_000_000


def first_fit(sizes, full):
    room, out = [], []
    for s in sizes:
        k = next((k for k, r in enumerate(room) if r >= s), None)
        if k is None:
            room.append(full)
            k = len(room) - 1
        room[k] -= s
        out.append(k)
    return out


def micros(t):
    return None if t is None else (t - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)


def brute(rows, columns):
    """Final files from lists: rows are dicts."""
    total = len(rows)
    share = lambda x: 1 + total // x
    days = {}
    for r in rows:
        m = micros(r["arrived_at"])
        days.setdefault(None if m is None else m // DAY, []).append(r)
    out = []
    for day, own in days.items():
        files = {}
        for r in own:
            h = zlib.crc32(("" if r["click_id"] is None else str(r["click_id"])).encode())
            files.setdefault(((h // 16) % (1 + len(own) // share(200)), min(h % 4, (h // 4) % 4)), []).append(r)
        low = lambda v: (v is not None, v or 0)
        for f in files.values():
            f.sort(key=lambda r: (low(micros(r["arrived_at"])), low(r["click_id"])))
        small = sorted((k for k in files if len(files[k]) < share(750)), key=lambda k: (-len(files[k]), k))
        groups = {}
        for k, g in zip(small, first_fit([len(files[k]) for k in small], share(400))):
            groups.setdefault(g, []).append(k)
        for ks in [*groups.values(), *([k] for k in files if k not in small)]:
            own_rows = [r for k in ks for r in files[k]]
            ids = [r["click_id"] for r in own_rows]
            some = [i for i in ids if i is not None]
            cents = sum(math.floor(100 * r["value"] + 0.5) for r in own_rows if r["value"] is not None)
            sha = hashlib.sha256(",".join("" if i is None else str(i) for i in ids).encode()).hexdigest()
            out.append((day, *ks[0], len(ids), min(some, default=None), max(some, default=None), cents, ",".join(f"{a}-{b}" for a, b in ks), sha, ",".join(columns), len(ks) > 1))
    return sorted(out, key=str)


def results(df):
    return df.select("day", "lot", "piece", "n_rows", "min_click_id", "max_click_id", "cents", "sources", "ids_sha256", "columns", "rewritten", "path").collect()


def same_as_brute(df, rows):
    got = results(df)
    assert sorted((tuple(r)[:-1] for r in got), key=str) == brute(rows, list(rows[0]))
    # The folder holds these files and no other, and together they hold the table.
    paths = [r["path"].removeprefix("file://") for r in got]
    top = paths[0].rpartition("/")[0]
    found = ds.dataset(top, format="parquet")
    assert sorted(found.files) == sorted(paths)
    key = lambda r: repr(sorted((k, str(v)) for k, v in r.items()))
    assert sorted(map(key, found.to_table().to_pylist())) == sorted(map(key, rows))
    return got


def test_query_is_the_brute_one(spark):
    rows = pq.read_table(f"{DATA}/clicks.parquet").to_pylist()
    got = same_as_brute(C.op12_compaction(spark, DATA), rows)
    assert any(r["rewritten"] for r in got)


KIND = "click_id long, arrived_at timestamp_ntz, value double, day string, lot int, note string"


def test_hot_day_nulls_repeats_and_clashing_names(spark):
    rng = random.Random(4)
    t = datetime.datetime(1969, 12, 31, 20)
    rows = [dict(click_id=rng.choice([None, *range(900)]), arrived_at=rng.choice([None, t + datetime.timedelta(seconds=rng.randint(0, 40_000))]) if i % 3 else t, value=rng.choice([None, -1.005, 2.5, rng.random() * 50]), day="x", lot=i % 2, note=None) for i in range(3000)]
    # Rows that the contract's order can't tell apart are alike but for their value.
    df = spark.createDataFrame([tuple(r.values()) for r in rows], KIND).repartition(6)
    got = same_as_brute(C.compacted_clicks(df), rows)
    assert {r["day"] for r in got} == {None, -1, 0}


def test_very_long_texts_and_timestamps_of_both_kinds(spark):
    rows = [(i, datetime.datetime(2024, 1, 1, i % 24), float(i), "é" * (300_000 if i == 7 else 3), datetime.datetime(2024, 1, 1)) for i in range(1500)]
    df = spark.createDataFrame(rows, "click_id long, arrived_at timestamp, value double, text string, ts timestamp_ntz")
    got = results(C.compacted_clicks(df))
    assert sum(r["n_rows"] for r in got) == 1500 and any(r["rewritten"] for r in got)
    back = spark.read.parquet(*[r["path"] for r in got])
    assert back.dtypes == df.dtypes and sorted(back.collect()) == sorted(df.collect())


def test_empty_table(spark):
    assert C.compacted_clicks(spark.createDataFrame([], KIND)).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_treap_is_first_fit(seed):
    rng = random.Random(seed)
    full = rng.choice([10, 100, 1000])
    sizes = sorted((rng.randint(0, full) for _ in range(1500)), reverse=seed % 2 == 0)
    assert C.packed(sizes, full) == first_fit(sizes, full)
    assert C.packed([full + 5, 1], full) == [0, 1]


def test_treap_stays_shallow():
    g = C.Groups()
    for _ in range(20_000):
        g.open(1)
    depth, layer = 0, [g.top]
    while layer:
        depth, layer = depth + 1, [c for k in layer for c in (g.left[k], g.right[k]) if c >= 0]
    assert depth < 60


def test_steps_can_be_run_again(spark, tmp_path):
    """A task that is tried again finds its files moved or deleted and does nothing."""
    import pyarrow as pa

    for k in range(2):
        pq.write_table(pa.table({"click_id": [2 * k, 2 * k + 1], "value": [1.0, None]}), tmp_path / f"{k}.parquet")
    at = f"file://{tmp_path}"
    b = pa.RecordBatch.from_pylist([{"sources": [{"path": f"{at}/0.parquet"}, {"path": f"{at}/1.parquet"}], "path": f"{at}/0-and-1.parquet", "rewritten": True}])
    once, twice = list(C._joined(at)([b])), list(C._joined(at)([b]))
    assert once[0]["made"] != twice[0]["made"]  # each attempt has a file of its own
    for _ in range(2):
        list(C._switched(twice))
    left = sorted(p.name for p in tmp_path.glob("*.parquet"))
    assert left == ["0-and-1.parquet"]
    assert pq.read_table(tmp_path / left[0])["click_id"].to_pylist() == [0, 1, 2, 3]
