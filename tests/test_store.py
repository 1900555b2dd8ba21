import pytest

from wardflow.sources.store import HistoryStore

KIND = "chain_id long, seq long, total double"


def rows(chain, first, last):
    return [(chain, k, k / 8) for k in range(first, last + 1)]


def thin(own, at, keep, every):
    """One chain's buffer: (seq, thinned), thinned once."""
    old = sum(t for _, t in own)
    cut = len(own) - keep
    if len(own) <= at or cut <= old:
        return own
    return own[:old] + [(s, True) for s, _ in own[old:cut:every]] + own[cut:]


def held(store):
    out = {}
    for r in sorted(store.read().collect()):
        out.setdefault(r["chain_id"], []).append((r["seq"], r["thinned"]))
    return out


def test_thinned_once_by_threshold(spark, tmp_path):
    store, want = HistoryStore(spark, f"file://{tmp_path}/h", 4), {}
    for first, last in ((1, 50), (51, 55), (56, 120), (121, 300)):
        store.append(spark.createDataFrame(rows(1, first, last) + rows(2, first, min(last, first + 9)) * (first == 1), KIND))
        want.setdefault(1, []).extend((k, False) for k in range(first, last + 1))
        want.setdefault(2, []).extend((k, False) for k in range(first, first + 10) if first == 1)
        done = store.compact(60, 30, 7)
        now = {k: thin(v, 60, 30, 7) for k, v in want.items()}
        assert done == (now != want)
        want = now
        assert held(store) == want
    assert store.compact(60, 30, 7) == 0  # 30 new rows and few old ones
    assert store.clean() > 0 and held(store) == want and store.clean() == 0


def test_a_stop_before_the_switch_loses_nothing(spark, tmp_path, monkeypatch):
    store = HistoryStore(spark, f"file://{tmp_path}/h", 4)
    store.append(spark.createDataFrame(rows(1, 1, 100), KIND))
    before = held(store)

    def stop(*a):
        raise KeyboardInterrupt

    monkeypatch.setattr(store, "_switch", stop)
    with pytest.raises(KeyboardInterrupt):
        store.compact(60, 30, 7)
    with pytest.raises(KeyboardInterrupt):
        store.append(spark.createDataFrame(rows(1, 101, 120), KIND))
    monkeypatch.undo()
    again = HistoryStore(spark, f"file://{tmp_path}/h", 4)
    assert held(again) == before
    again.append(spark.createDataFrame(rows(1, 101, 120), KIND))
    again.compact(60, 30, 7)
    assert held(again)[1] == thin([(k, False) for k in range(1, 121)], 60, 30, 7)
    assert again.clean() >= 2 and len(held(again)[1]) == 43


def test_two_writers_and_broken_rows(spark, tmp_path):
    a, b = (HistoryStore(spark, f"file://{tmp_path}/h") for _ in range(2))
    with pytest.raises(FileNotFoundError):
        a.read()
    a.append(spark.createDataFrame([], KIND))
    assert a.read().count() == 0 and a.compact() == 0
    was = b.manifest()
    a.append(spark.createDataFrame(rows(1, 1, 3), KIND))
    with pytest.raises(RuntimeError, match="another writer"):
        b._switch(was, was["schema"], {})
    with pytest.raises(Exception, match="without chain_id"):
        a.append(spark.createDataFrame([(None, 4, 0.0)], KIND))
    assert b.read().count() == 3
