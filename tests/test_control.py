"""Runs that stop and go on, table functions, crash logs, and graphs with many parts."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.micro import polygons, square
from wardflow.operators import chain, control, graph
from wardflow.plans import catalogue
from wardflow.plans.config import interactive
from wardflow.plans.fixtures import K, Lattice
from wardflow.sources.crash import write_crash_log

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lattice(spark):
    x = Lattice(spark, DATA)
    return x, catalogue.packed(x), catalogue.balanced(x)


def test_a_run_stops_goes_on_and_is_reset(spark, lattice, tmp_path):
    _, x, plan = lattice
    cfg = chain.ChainConfig(iterations=9, seed=3, score=interactive(n_districts=K))
    run = control.Run(spark, f"file://{tmp_path}/run", x, cfg, 2, plan)
    assert run.reached() == 0 and run.history().count() == 0 and run.states().count() == 0
    run.pause()
    t = threading.Thread(target=run.run, args=(4,))
    t.start()
    run.stop()
    t.join(60)
    assert run.reached() == 0
    run.resume()
    assert run.advance(4) == 4
    (tmp_path / "run" / "batch=1").mkdir()  # one that was broken off
    assert run.reached() == 4
    assert run.run(4) == 9
    key = lambda df: sorted((r["chain_id"], r["seq"], r["total"], r["accepted"]) for r in df.collect())
    assert key(run.history()) == key(chain.run(spark, x, cfg, 2, "history", plan))
    best = {r["chain_id"]: r["total"] for r in chain.run(spark, x, cfg, 2, "best", plan).collect()}
    assert {r["chain_id"]: r["best"] for r in run.states().collect()} == best
    assert run.best_plans().count() == 2 * len(plan)
    run.reset()
    assert run.reached() == 0


def test_table_functions(spark, lattice, tmp_path):
    _, x, _ = lattice
    control.save_layer(x, f"{tmp_path}/layer.json")
    back = control.load_layer(f"{tmp_path}/layer.json")
    assert (back.population == x.population).all() and (back.extrema == x.extrema).all() and (back.shared == x.shared).all()
    control.register(spark)
    got = spark.sql(f"SELECT * FROM run_chain('{tmp_path}/layer.json', 1, {K}, 10, 4)").collect()
    assert [r["seq"] for r in got] == list(range(1, len(got) + 1)) and 0 < len(got) <= 10


def test_crash_logs(tmp_path, capsys):
    from datetime import datetime

    try:
        raise ValueError("broken layer")
    except ValueError as e:
        error = e
    now = datetime(2026, 1, 2, 3, 4, 5)
    a, b = (write_crash_log(error, tmp_path / "logs", {"layer": "x.shp"}, now) for _ in range(2))
    assert (a.name, b.name) == ("20260102-030405.log", "20260102-030405-1.log")
    assert "broken layer" in a.read_text() and "context layer: x.shp" in a.read_text() and "Traceback" in a.read_text()
    (tmp_path / "file").write_text("")
    assert write_crash_log(error, tmp_path / "file" / "logs") is None
    assert "broken layer" in capsys.readouterr().err


def test_overlaps_without_a_common_side_are_edges(spark):
    p = polygons(spark, [[square(0, 0, 2)], [square(1, 1, 2)], [square(3, 1, 1)], [square(9, 9)]])
    g, edges = graph.prepared(p)
    assert {(r["u"], r["v"]): r["shared_len"] for r in edges.collect()} == {(0, 1): 0.0, (1, 2): 1.0}
    assert {r["precinct_id"]: r["ext_perimeter"] for r in g.collect()} == {0: 8.0, 1: 7.0, 2: 3.0, 3: 4.0}


def test_many_islands_become_one_component(spark, monkeypatch):
    """Islands far apart, of which each is nearest to another island and not to the mainland, against a plain tree of best links."""
    rng = np.random.default_rng(5)
    spots = [(float(x), 0.0) for x in range(3)]
    while len(spots) < 40:
        x, y = (float(v) for v in rng.integers(-300, 300, 2))
        if all(max(abs(x - a), abs(y - b)) > 2 for a, b in spots):
            spots.append((x, y))
    counties = [k // 3 % 7 for k in range(40)]
    p = polygons(spark, [[square(x, y)] for x, y in spots], population=[9] * 3 + [1] * 37, county_id=counties)
    edges = graph.shared_sides(p).withColumn("is_virtual", F.lit(False))
    got = {(r["u"], r["v"]) for r in graph.bridges(p, edges).collect()}

    def gap(a, b):
        dx, dy = (max(abs(s - t) - 1, 0) for s, t in zip(spots[a], spots[b]))
        return round((dx * dx + dy * dy) ** 0.5, 9)

    root = [0, 0, 0, *range(3, 40)]

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    want = set()
    for _, _, u, v in sorted((int(counties[u] != counties[v]), gap(u, v), u, v) for v in range(40) for u in range(v)):
        if top(u) != top(v):
            root[max(top(u), top(v))] = min(top(u), top(v))
            want.add((u, v))
    assert got == want
    monkeypatch.setattr(graph, "MOST_COMPONENTS", 5)
    with pytest.raises(ValueError, match="38 components"):
        graph.bridges(p, edges)


def test_pieces_by_plan_are_those_by_components(spark, lattice):
    lat, _, _ = lattice
    key = lambda df: sorted(tuple(r) for r in df.select("plan_id", "district", "pieces").collect())
    a = lat.assignments.where("precinct_id % 11 <> 3")
    assert key(graph.pieces(a, lat.edges)) == key(graph.pieces_by_components(a.select("plan_id", "precinct_id", "district"), lat.edges))


def test_components_that_do_not_end_are_an_error(spark):
    e = spark.range(50).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    with pytest.raises(RuntimeError):
        graph.components(spark.range(51).select(F.col("id").alias("node")), e, rounds=1)


def test_a_cluster_has_to_name_a_folder(spark):
    class Conf:
        def get(self, key, default):
            return None

    class Cluster:
        conf, sparkContext = Conf(), type("C", (), {"master": "spark://there:7077"})()

    with pytest.raises(ValueError, match="checkpoint"):
        graph.shared_dir(Cluster())


def test_folders_of_layers_have_the_same_columns(spark, tmp_path):
    from wardflow.sources import shapefile

    shapefile.write(f"{tmp_path}/a.shp", [("POP", "N", 5, 0)], [(1, [square(0, 0)])])
    shapefile.write(f"{tmp_path}/b.shp", [("NAME", "C", 5, 0)], [("x", [square(1, 0)])])
    shapefile.register(spark)
    with pytest.raises(Exception, match="differ in their columns"):
        spark.read.format("shp").load(str(tmp_path)).count()
