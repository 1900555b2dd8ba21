import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.micro import polygons, square
from wardflow.operators import graph, topology


def ring(*pts, hole=False):
    return {"is_hole": hole, "pts": [{"x": float(x), "y": float(y)} for x, y in [*pts, pts[0]]]}


def contacts_of(df):
    return {(r["u"], r["v"]): r["shared_len"] for r in graph.shared_sides(df).collect()}


def test_rounded_vertices_on_a_side_are_on_it(spark):
    """Layers of one side against two at the scale of projected coordinates, the middle vertex a rounded double."""
    rng = random.Random(5)
    rings, want = [], {}
    for k in range(100):
        x, y = 5e5 + 5000 * (k % 10) + rng.random(), 4e6 + 5000 * (k // 10) + rng.random()
        way, n, t = rng.random() * 2 * math.pi, 100 + 900 * rng.random(), 0.1 + 0.8 * rng.random()
        dx, dy = n * math.cos(way), n * math.sin(way)
        a, b, m = (x, y), (x + dx, y + dy), (x + t * dx, y + t * dy)
        over, under = (x - dy / 2, y + dx / 2), (x + dy / 2, y - dx / 2)
        shift = lambda p, o: (p[0] - (x - o[0]), p[1] - (y - o[1]))  # noqa: E731, B023
        rings += [[ring(a, b, shift(b, over), over)], [ring(a, m, shift(m, under), under)], [ring(m, b, shift(b, under), shift(m, under))]]
        want[3 * k, 3 * k + 1], want[3 * k, 3 * k + 2] = t * n, (1 - t) * n
    df = polygons(spark, rings)
    got = contacts_of(df)
    assert all(abs(got[p] - n) < 1e-3 for p, n in want.items())
    # The two small ones of a layer touch along their own common side; nothing else does.
    assert set(got) == set(want) | {(3 * k + 1, 3 * k + 2) for k in range(100)}
    assert graph.neighbours(df).where("shared_len = 0").count() == 0


def test_sides_are_dealt_out(spark):
    """A layer of one file is one task's to read, but not its sides to make."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        layer = polygons(spark, [[square(k, 0)] for k in range(200)]).coalesce(1)
        at = topology.sides(layer).groupBy(F.spark_partition_id().alias("at")).count().collect()
    finally:
        spark.conf.unset(key)
    assert sum(r["count"] for r in at) == 800 and len(at) > 1


def test_vertices_that_lie_together_are_one(spark):
    e = 1e-10
    got = contacts_of(polygons(spark, [[square(0, 0)], [ring((1 + e, -e), (2, 0), (2, 1), (1 - e, 1 + e))], [ring((0, 1 + e), (1, 1), (1 + e, 2), (0, 2))]]))
    assert set(got) == {(0, 1), (0, 2)} and all(abs(n - 1) < 1e-8 for n in got.values())


def test_long_sides_and_dense_quarters(spark):
    """A side of 1,000 against a thousand of 1, and a block of tiny cells beside large ones."""
    rings = [[square(0, 0, 1000.0)]] + [[square(k, -1)] for k in range(1000)] + [[square(1000 + k % 20 / 20, k // 20 / 20, 0.05)] for k in range(400)]
    got = contacts_of(polygons(spark, rings))
    assert all(abs(got[0, 1 + k] - 1) < 1e-6 for k in range(1000))
    side = [n for (u, v), n in got.items() if u == 0 and v > 1000]
    assert len(side) == 20 and abs(sum(side) - 1) < 1e-6


def test_empty_and_broken_layers(spark):
    kind = "precinct_id long, rings " + "array<struct<is_hole:boolean,pts:array<struct<x:double,y:double>>>>"
    assert topology.pieces(spark.createDataFrame([], kind)).collect() == []
    rows = [(0, None), (1, []), (2, [square(0, 0)]), (3, [ring((5, 5))]), (4, [{"is_hole": False, "pts": []}])]
    got = topology.pieces(spark.createDataFrame(rows, kind)).collect()
    assert {r["precinct_id"] for r in got} == {2} and len(got) == 4


def lattice(spark, districts):
    """Unit squares; districts: rows of letters from the top down, a blank is no precinct."""
    cells = [(x, len(districts) - 1 - y, c) for y, row in enumerate(districts) for x, c in enumerate(row) if c != " "]
    layer = polygons(spark, [[square(x, y)] for x, y, _ in cells])
    plan = spark.createDataFrame([(7, k, ord(c) - 97) for k, (_, _, c) in enumerate(cells)], "plan_id long, precinct_id long, district int")
    return layer, plan, cells


MAP = ["aaabbb", "acabdd", "aaab d", "bbbbdd", "ebbfff", "efbfgf", "ffbfff"]


def outlines_of(spark, districts, tol=None):
    layer, plan, cells = lattice(spark, districts)
    arcs = topology.arcs(topology.borders(topology.pieces(layer)), plan)
    return topology.outlines(arcs if tol is None else topology.simplified(arcs, tol)), cells


def test_outlines_are_rings_with_holes(spark):
    got, cells = outlines_of(spark, MAP)
    rows = got.collect()
    for d in range(7):
        own = [r for r in rows if r["district"] == d]
        mine = [(x, y) for x, y, c in cells if ord(c) - 97 == d]
        assert sum(r["area"] for r in own) == pytest.approx(len(mine))
        assert all((r["area"] < 0) == r["is_hole"] and r["pts"][0] == r["pts"][-1] for r in own)
        # A cell's middle is in its district's rings an odd number of times, and in no other's.
        for x, y, c in cells:
            inside = sum(topology.contains(np.array([tuple(p) for p in r["pts"]]), x + 0.5, y + 0.5) for r in own) % 2
            assert inside == (ord(c) - 97 == d)
    count = lambda d: (sum(r["district"] == d and not r["is_hole"] for r in rows), sum(r["district"] == d and r["is_hole"] for r in rows))
    # f: its two cells below e touch its other part in a corner and nowhere else; g lies in that part.
    assert [count(d) for d in range(7)] == [(1, 1), (1, 0), (1, 0), (1, 0), (1, 0), (2, 1), (1, 0)]
    whole = graph.stored(topology.polygons(got), "polygons")
    assert whole.count() == 7


def test_an_owner_within_an_owner_is_nested_in_the_smallest(spark):
    got, _ = outlines_of(spark, ["aaaaaaa", "abbbbba", "abaaaba", "abacaba", "abaaaba", "abbbbba", "aaaaaaa"])
    a = sorted((r["polygon"], r["ring"], r["is_hole"], r["area"]) for r in got.where("district = 0").collect())
    assert a == [(0, 0, False, 49.0), (0, 1, True, -25.0), (1, 0, False, 9.0), (1, 1, True, -1.0)]


@pytest.mark.parametrize("stripe", [7, 40])
def test_stripes_give_the_same_arcs_and_rings(spark, monkeypatch, stripe):
    """Scattered owners with rings that cross stripes, loops, holes in holes, and ends of two open chains in one junction."""
    rng = random.Random(stripe)
    nested = ["aaaaaaaaaaaa", "abbbbbbbbbba", "abaaaaaaaaba", "abacccccccba", "abacaaaacaba", "abacacdacaba", "abaccccccaba", "abaaaaaaaaba", "abbbbbbbbbba", "aaaaaaaaaaaa"]
    scattered = ["".join(rng.choice("aabc ") for _ in range(14)) for _ in range(9)]
    mixed = [a + b for a, b in zip([*nested], [*scattered, "a" * 14])]
    layer, plan, _ = lattice(spark, mixed)
    own = graph.stored(topology.borders(topology.pieces(layer)), "borders")
    points = lambda r: [tuple(p) for p in r["pts"]]
    either = lambda r: min((points(r), r["left_district"], r["right_district"]), (points(r)[::-1], r["right_district"], r["left_district"]))

    def turned(pts):
        k = pts.index(min(pts))
        return tuple(pts[k:-1] + pts[: k + 1])

    def found():
        a = graph.stored(topology.arcs(own, plan), "arcs")
        rings = topology.outlines(a).collect()
        arcs_ = a.collect()
        assert len({r["arc"] for r in arcs_}) == len(arcs_)
        return sorted(map(either, arcs_)), rings

    arcs_, rings = found()
    monkeypatch.setattr(topology, "STRIPE", stripe)
    arcs_2, rings_2 = found()
    assert arcs_2 == arcs_
    form = lambda rs: sorted((r["district"], r["is_hole"], r["area"], turned(points(r))) for r in rs)
    assert form(rings_2) == form(rings)

    def holders(rs):
        """Of each hole the outer ring that it is in."""
        outer = {(r["district"], r["polygon"]): turned(points(r)) for r in rs if not r["is_hole"]}
        return {turned(points(r)): outer[r["district"], r["polygon"]] for r in rs if r["is_hole"]}

    assert holders(rings_2) == holders(rings) and len(holders(rings)) >= 3
    assert {(r["district"], r["polygon"], r["ring"], r["area"]) for r in rings_2} == {(r["district"], r["polygon"], r["ring"], r["area"]) for r in rings}


def test_no_task_holds_a_large_layers_chains(spark, monkeypatch):
    layer, plan, _ = lattice(spark, ["abababababab", "babababababa"] * 4)
    seen = spark.sparkContext.accumulator(0)
    was = topology._chained

    def counted(t, cuts):
        if t.num_rows > 60:
            seen.add(1)
        return was(t, cuts)

    monkeypatch.setattr(topology, "_chained", counted)
    monkeypatch.setattr(topology, "STRIPE", 30)
    topology.arcs(topology.borders(topology.pieces(layer)), plan).collect()
    assert seen.value == 0


@pytest.mark.parametrize("tol", [0.0, 0.8, 1.5])
def test_simplified_neighbours_stay_flush(spark, tol):
    rng = random.Random(3)
    jagged = ["".join("ab"[x > 10 + rng.choice([-1, 0, 1])] if y > 8 else "cd"[x > 7 + rng.choice([-1, 0, 1])] for x in range(20)) for y in range(16)]
    jagged[5] = jagged[5][:3] + "e" + jagged[5][4:]  # a district of one cell
    layer, plan, cells = lattice(spark, jagged)
    arcs = topology.arcs(topology.borders(topology.pieces(layer)), plan)
    thin = graph.stored(topology.simplified(arcs, tol), "thin")
    rings = topology.outlines(thin).collect()
    assert {r["district"] for r in rings} == {0, 1, 2, 3, 4}
    # Every side of a ring is a neighbour's as well, the other way round, or the outside's: no gap and no overlap.
    side = lambda r: [(tuple(p), tuple(q)) for p, q in zip(r["pts"], r["pts"][1:])]
    every = [s for r in rings for s in side(r)]
    assert len(set(every)) == len(every)
    outer = [s for s in every if s[::-1] not in set(every)]
    ends = {}
    for p, q in outer:
        ends.setdefault(p, []).append(q)
    assert all(len(v) == 1 for v in ends.values())  # the outside's line is closed
    loop, at = [outer[0][0]], outer[0][0]
    while (at := ends[at][0]) != loop[0]:
        loop.append(at)
    assert len(loop) == len(outer)
    assert sum(r["area"] for r in rings) == pytest.approx(topology.signed_area(np.array([*loop, loop[0]])))
    if tol:
        assert sum(len(r["pts"]) for r in rings) < 0.6 * sum(len(r["pts"]) for r in topology.outlines(arcs).collect())


def test_a_closed_line_keeps_three_points():
    xy = np.array([(math.cos(a), math.sin(a)) for a in np.linspace(0, 2 * math.pi, 40)])
    xy[-1] = xy[0]
    own = topology._thinned(xy, 10.0)
    assert len(own) == 4 and abs(topology.signed_area(xy[own])) > 0.5


FORMS = {
    "u": [ring((0, 0), (9, 0), (9, 9), (7, 9), (7, 2), (2, 2), (2, 9), (0, 9))],
    "bar": [ring((0, 0), (40, 0), (40, 1), (0, 1))],
    "ring": [ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((1, 1), (1, 8), (8, 8), (8, 1), hole=True)],
    "slanted": [ring((500_000.5, 4_000_000), (500_007, 4_000_001), (500_003, 4_000_009))],
}


@pytest.mark.parametrize("name", sorted(FORMS))
def test_label_point_is_the_deepest(name):
    rings = [np.array([(p["x"], p["y"]) for p in r["pts"]]) for r in FORMS[name]]
    x, y, depth = topology.deepest(rings, 0.01)
    s = np.concatenate([np.hstack([r[:-1], r[1:]]) for r in rings])
    (x0, y0), (x1, y1) = rings[0].min(0), rings[0].max(0)
    gx, gy = (a.ravel() for a in np.meshgrid(np.linspace(x0, x1, 160), np.linspace(y0, y1, 160)))
    assert topology._depth(np.array([x]), np.array([y]), s)[0] == pytest.approx(depth) and depth > 0
    assert depth >= topology._depth(gx, gy, s).max() - 0.011


def test_label_points_and_collisions(spark):
    got, cells = outlines_of(spark, MAP)
    p = topology.label_points(got)
    for r in p.collect():
        assert any(x <= r["label_x"] <= x + 1 and y <= r["label_y"] <= y + 1 and ord(c) - 97 == r["district"] for x, y, c in cells)
    pts = [(1, 0, 0.0, 0.0, 5), (1, 1, 3.0, 0.0, 9), (1, 2, 6.0, 0.0, 1), (1, 3, 3.0, 40.0, 1), (2, 0, 0.0, 0.0, 1)]
    df = spark.createDataFrame(pts, "plan_id long, district int, label_x double, label_y double, n int")
    shown = topology.placed_labels(df, F.col("n"), F.col("district") + 1, 8.0, 14.0, 2.0).collect()
    assert {(r["plan_id"], r["district"]): r["shown"] for r in shown} == {(1, 0): False, (1, 1): True, (1, 2): False, (1, 3): True, (2, 0): True}
