"""Where precincts' boundaries run together, and districts' outlines made of them.

Layers are seldom noded exactly: a vertex that lies on a neighbour's side is a rounded number beside it. So boundaries are noded first, within a tolerance:
vertices that lie together are taken for one, and each side is cut at the vertices that lie on it. What two precincts share are then equal pieces, found by an equi-join
on their ends. All searches are joins on grid cells with an exact test; a side is looked up by cells of about its own length, so that long sides and dense quarters make no large cells.

A plan's boundary pieces are chained to arcs between junctions, once for both sides, and arcs to rings with the inside on the left. Simplified arcs leave neighbours flush, as both have the same one.

Nulls: precincts without rings have no pieces. Rings of fewer than three different points have pieces, but no area. Precincts that repeat count as one.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardflow.functions import geometry
from wardflow.operators import graph
from wardflow.operators.districts import sorted_joins

#: Of the largest coordinate: what single operations on doubles leave exact by far, and less than a layer's finest detail.
RELATIVE = 1e-9
#: Sides are looked up in parts of up to so many times their mean length.
LONG = 8
POINTS = "array<struct<x:double,y:double>>"


# ---- noding ----


def sides(layer: DataFrame) -> DataFrame:
    """(precinct_id, ring, pos, x1, y1, x2, y2): each ring's sides in order, the inside on the left. Precincts are dealt out first, as a layer's files are small and few tasks read them."""
    r = layer.select("precinct_id", "rings").repartition("precinct_id").select("precinct_id", F.posexplode("rings").alias("ring", "r")).select("precinct_id", "ring", F.col("r.is_hole").alias("hole"), F.col("r.pts").alias("pts"))
    x0, y0 = F.col("pts")[0]["x"], F.col("pts")[0]["y"]  # areas from the first point on, lest large coordinates blur them
    step = lambda p, i: (p["x"] - x0) * (F.get("pts", i + 1)["y"] - y0) - (F.get("pts", i + 1)["x"] - x0) * (p["y"] - y0)
    twice = F.aggregate(F.transform(F.slice("pts", F.lit(1), F.greatest(F.size("pts") - 1, F.lit(0))), step), F.lit(0.0), lambda a, x: a + x)
    r = r.where(F.size("pts") > 1).withColumn("pts", F.when((twice > 0) == F.col("hole"), F.reverse("pts")).otherwise(F.col("pts")))
    side = F.transform(F.slice("pts", F.lit(1), F.size("pts") - 1), lambda p, i: F.struct(p.alias("a"), F.get("pts", i + 1).alias("b")))
    s = r.select("precinct_id", "ring", F.posexplode(side).alias("pos", "s")).where("s.a <> s.b")
    zero = lambda c: (F.col(c) + 0.0)  # noqa: E731  -0.0 is 0.0
    return s.select("precinct_id", "ring", "pos", *[zero(f"s.{p}.{c}").alias(f"{c}{i}") for i, p in ((1, "a"), (2, "b")) for c in ("x", "y")])


def _snapped(s: DataFrame, tol: float) -> DataFrame:
    """Sides whose ends are one point where they lie within the tolerance: the least of those that hang together so."""
    v = s.select(F.col("x1").alias("x"), F.col("y1").alias("y")).unionByName(s.select(F.col("x2").alias("x"), F.col("y2").alias("y"))).distinct()
    cell = 1000 * tol
    around = lambda c: F.array_distinct(F.array(F.floor((F.col(c) - tol) / cell), F.floor((F.col(c) + tol) / cell)))
    far = v.select(F.col("x").alias("ox"), F.col("y").alias("oy"), F.floor(F.col("x") / cell).alias("gx"), F.floor(F.col("y") / cell).alias("gy"))
    near = v.withColumn("gx", F.explode(around("x"))).withColumn("gy", F.explode(around("y"))).join(far, ["gx", "gy"])
    near = near.where((F.struct("x", "y") < F.struct("ox", "oy")) & (F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")) <= tol))
    near = graph.stored(near.select(F.xxhash64("x", "y").alias("u"), F.xxhash64("ox", "oy").alias("v"), "x", "y", "ox", "oy"), "close")
    if near.isEmpty():
        return s
    points = near.select(F.col("u").alias("node"), "x", "y").unionByName(near.select(F.col("v").alias("node"), F.col("ox").alias("x"), F.col("oy").alias("y"))).distinct()
    points = points.join(graph.components(points.select("node"), near), "node")
    least = points.groupBy("component").agg(F.min(F.struct("x", "y")).alias("to"))
    moved = graph.stored(points.join(least, "component").select("x", "y", F.col("to.x").alias("tx"), F.col("to.y").alias("ty")), "moved")
    for i in (1, 2):
        m = moved.withColumnsRenamed({"x": f"x{i}", "y": f"y{i}"})
        s = s.join(m, [f"x{i}", f"y{i}"], "left").withColumns({f"x{i}": F.coalesce("tx", f"x{i}"), f"y{i}": F.coalesce("ty", f"y{i}")}).drop("tx", "ty")
    return s.where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def pieces(layer: DataFrame, tol: float | None = None) -> DataFrame:
    """(precinct_id, x1, y1, x2, y2): the layer's sides, noded within the tolerance (RELATIVE of its largest coordinate by default), the inside on the left."""
    s = graph.stored(sides(layer), "sides")
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    size = s.agg(F.max(F.greatest(*[F.abs(c) for c in ("x1", "y1", "x2", "y2")])).alias("most"), F.avg(length).alias("mean")).first()
    names = ["precinct_id", "x1", "y1", "x2", "y2"]
    if size["most"] is None:
        return s.select(*names)
    tol = RELATIVE * size["most"] if tol is None else tol
    moved = _snapped(s, tol)
    s = s if moved is s else graph.stored(moved, "snapped")
    part = LONG * size["mean"]
    s = s.withColumn("len", length)
    p = s.withColumn("n", F.greatest(F.ceil(F.col("len") / part), F.lit(1))).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    at = lambda c, k: F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * (k / F.col("n"))
    p = p.withColumns({f"p{c}{i}": at(c, F.col("k") + i) for c in "xy" for i in (0, 1)})
    level = F.ceil(F.log2(F.greatest(F.col("len") / F.col("n"), F.lit(4 * tol)))).cast("int")
    p = p.withColumn("level", level)
    levels = sorted(r["level"] for r in p.select("level").distinct().collect())  # at most log2 of part over tolerance
    cell = F.pow(F.lit(2.0), F.col("level"))
    span = lambda c: F.sequence(F.floor((F.least(f"p{c}0", f"p{c}1") - tol) / cell), F.floor((F.greatest(f"p{c}0", f"p{c}1") + tol) / cell))
    p = p.withColumn("gx", F.explode(span("x"))).withColumn("gy", F.explode(span("y"))).select("precinct_id", "ring", "pos", "x1", "y1", "x2", "y2", "len", "level", "gx", "gy")
    v = s.select(F.col("x1").alias("x"), F.col("y1").alias("y")).distinct().withColumn("level", F.explode(F.lit(levels).cast("array<int>")))
    v = v.select("x", "y", "level", F.floor(F.col("x") / cell).alias("gx"), F.floor(F.col("y") / cell).alias("gy"))
    dx, dy, ex, ey = F.col("x") - F.col("x1"), F.col("y") - F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    hit = p.join(v, ["level", "gx", "gy"]).withColumn("t", (dx * ex + dy * ey) / F.col("len")).where((F.abs(dx * ey - dy * ex) <= tol * F.col("len")) & (F.col("t") > 0) & (F.col("t") < F.col("len")))
    end = lambda i: (F.col("x") != F.col(f"x{i}")) | (F.col("y") != F.col(f"y{i}"))
    side = ["precinct_id", "ring", "pos"]
    cuts = hit.where(end(1) & end(2)).groupBy(*side).agg(F.sort_array(F.collect_set(F.struct("t", "x", "y"))).alias("cuts"))
    point = lambda i: F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y"))
    inner = F.coalesce(F.transform("cuts", lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))), F.array().cast(POINTS))
    s = s.join(cuts, side, "left").withColumn("pts", F.concat(F.array(point(1)), inner, F.array(point(2))))
    q = F.explode(F.transform(F.slice("pts", F.lit(1), F.size("pts") - 1), lambda p, i: F.struct(p.alias("a"), F.get("pts", i + 1).alias("b")))).alias("q")
    return s.select("precinct_id", q).where("q.a <> q.b").select("precinct_id", F.col("q.a.x").alias("x1"), F.col("q.a.y").alias("y1"), F.col("q.b.x").alias("x2"), F.col("q.b.y").alias("y2"))


def borders(pieces_: DataFrame) -> DataFrame:
    """(x1, y1, x2, y2, len, left, right): each noded piece once, its smaller end first, with the precincts on both sides as arrays. A piece that has one precinct on both sides is left out."""
    a, b = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    p = pieces_.select("precinct_id", (a < b).alias("ahead"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    own = lambda ahead: F.sort_array(F.collect_set(F.when(F.col("ahead") == ahead, F.col("precinct_id"))))
    e = p.groupBy("a", "b").agg(own(True).alias("left"), own(False).alias("right")).where("left <> right")
    length = F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y"))
    return e.select(F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2"), length.alias("len"), "left", "right")


def contacts(borders_: DataFrame) -> DataFrame:
    """(u, v, shared_len) of precincts that share pieces. More than two owners of a piece mean polygons that overlap; each two of them are neighbours."""
    e = borders_.select("len", F.sort_array(F.array_union("left", "right")).alias("ids")).where(F.size("ids") > 1)
    two = F.flatten(F.transform("ids", lambda u, i: F.transform(F.slice("ids", i + 2, F.size("ids")), lambda v: F.struct(u.alias("u"), v.alias("v")))))
    return e.select("len", F.explode(two).alias("p")).groupBy("p.u", "p.v").agg(F.sum("len").alias("shared_len"))


# ---- outlines ----

ARC = f"plan_id long, arc long, left_district int, right_district int, pts {POINTS}"
#: Points of a layer's borders, or of a district's arcs, that one task links; more are cut to stripes by x.
STRIPE = 50_000


def _cuts(df: DataFrame, x: Column, n: int) -> list[float]:
    """Where n stripes of about as many rows meet."""
    if n < 2:
        return []
    return sorted(set(df.agg(F.percentile_approx(x, [k / n for k in range(1, n)], 100 * n)).first()[0]))


def _stripe(x: Column, cuts: list[float], before: int = 0) -> Column:
    """How many cuts x has reached."""
    if not cuts:
        return F.lit(before)
    k = len(cuts) // 2
    return F.when(x < cuts[k], _stripe(x, cuts[:k], before)).otherwise(_stripe(x, cuts[k + 1 :], before + k + 1))


def _xy(pts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A column of points: where each row begins (and the last ends), and all points."""
    a = pts.combine_chunks()
    flat = a.flatten()
    return np.r_[0, np.cumsum(pc.list_value_length(a).to_numpy())].astype(np.int64), np.stack([flat.field(c).to_numpy() for c in ("x", "y")], 1)


def _points(begin: np.ndarray, xy: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.StructArray.from_arrays([pa.array(xy[:, k].astype(float)) for k in (0, 1)], ["x", "y"]))


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each stretch of n, one stretch after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def arcs(borders_: DataFrame, assignments: DataFrame) -> DataFrame:
    """(plan_id, arc, left_district, right_district, pts): chains of border pieces between junctions of each plan's districts; -1 is outside. A closed chain without a junction begins at its
    least point. assignments: plan_id, precinct_id, district. A small layer's borders are one task's by plan. A large layer is cut to stripes, which a task each chains, and only chains that cross from one to the next are
    linked by plan, by their ends; their points meet in Spark."""
    a = assignments.select("plan_id", "precinct_id", "district")
    b = graph.stored(borders_.select(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], F.get("left", F.lit(0)).alias("left"), F.get("right", F.lit(0)).alias("right")), "borders")
    cuts = _cuts(b, F.col("x1"), math.ceil(b.count() / STRIPE))
    side = lambda c: sorted_joins(a.select("plan_id", F.col("precinct_id").alias(c), F.col("district").alias(f"d_{c}")), bool(cuts))
    both = b.where("left is not null and right is not null").join(side("left"), "left").join(side("right"), ["plan_id", "right"]).where("d_left <> d_right")
    outer = [b.where(f"{o} is null and {c} is not null").join(side(c), c).withColumn(f"d_{o}", F.lit(None).cast("int")) for c, o in (("left", "right"), ("right", "left"))]
    names = ["plan_id", "x1", "y1", "x2", "y2", "d_left", "d_right"]
    e = both.select(*names).unionByName(outer[0].select(*names)).unionByName(outer[1].select(*names))
    e = e.withColumns({c: F.coalesce(F.col(c), F.lit(-1)).cast("int") for c in ("d_left", "d_right")}).withColumn("plan_id", F.col("plan_id").cast("long"))
    part = f"{ARC}, stripe int, open boolean, note boolean"
    stripes = F.explode(F.array_distinct(F.array(_stripe(F.col("x1"), cuts), _stripe(F.col("x2"), cuts))))
    t = e.withColumn("stripe", stripes).groupBy("plan_id", "stripe").applyInArrow(lambda x: _chained(x, cuts), part)
    if not cuts:
        return t.select(*[c.split()[0] for c in ARC.split(", pts")[0].split(", ")], "pts")
    t = graph.stored(t, "chains")
    ends = t.where("open or note").select("plan_id", "arc", "note", *[F.element_at("pts", k)[c].alias(f"{c}{i}") for i, k in ((1, 1), (2, -1)) for c in ("x", "y")])
    linked = ends.groupBy("plan_id").applyInArrow(_linked, "plan_id long, arc long, chain long, pos int, turned boolean, loop boolean")
    turned = F.col("turned")
    way = lambda a, b: F.when(turned, F.col(a)).otherwise(F.col(b))
    rows = F.struct("pos", F.when(turned, F.reverse("pts")).otherwise(F.col("pts")).alias("pts"))
    c = t.where("open").join(linked, ["plan_id", "arc"]).groupBy("plan_id", F.col("chain").alias("arc")).agg(
        F.first(way("right_district", "left_district")).alias("left_district"), F.first(way("left_district", "right_district")).alias("right_district"), F.first("loop").alias("loop"), F.sort_array(F.collect_list(rows)).alias("parts"))
    c = c.withColumn("pts", _strung("parts"))
    at = F.array_position("pts", F.array_min("pts")).cast("int")
    first = F.concat(F.slice("pts", at, F.size("pts") - at), F.slice("pts", F.lit(1), at))
    c = c.withColumn("pts", F.when(F.col("loop") & (at > 1), first).otherwise(F.col("pts")))
    names = [x.split()[0] for x in ARC.split(", pts")[0].split(", ")] + ["pts"]
    return t.where("not open and not note").select(*names).unionByName(c.select(*names))


def _strung(parts: str) -> Column:
    """The points of parts that each begin where the one before ends."""
    more = F.flatten(F.transform(parts, lambda p: F.slice(p["pts"], F.lit(2), F.size(p["pts"]) - 1)))
    return F.concat(F.slice(F.col(parts)[0]["pts"], F.lit(1), F.lit(1)), more)


def _chains(start: np.ndarray, stop: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Halves in order of their chains, the first half of each one's chain, and of each whether it is of a closed chain without a stop, which begins at its least point. Half k < m runs along piece k, half k + m against it; stops: the points where chains
    end. Each chain is there once, not both ways. Other points have two pieces."""
    m = len(start) // 2
    twin = (np.arange(2 * m) + m) % max(1, 2 * m)
    order = np.argsort(start, kind="stable")
    first = order[np.searchsorted(start[order], np.arange(len(stops)))] if m else order
    last = order[np.searchsorted(start[order], np.arange(len(stops)), side="right") - 1] if m else order
    follows = lambda: np.where(stops[stop], -1, np.where(first[stop] != twin, first[stop], last[stop]))
    after = follows()

    def ranked(after):
        """Of each half the last half of its chain and the steps to it, by doubling; halves of closed chains have no last."""
        to, far = np.where(after < 0, np.arange(2 * m), after), (after >= 0).astype(np.int64)
        for _ in range(max(1, (2 * m).bit_length() + 1)):
            far, to = far + far[to], to[to]
        return to, far

    to, _ = ranked(after)
    closed = after[to] >= 0
    if closed.any():  # each loop begins at its least point
        stops = stops.copy()
        least, jump = np.where(closed, start, len(stops)), np.where(after < 0, np.arange(2 * m), after)
        for _ in range((2 * m).bit_length() + 1):
            least, jump = np.minimum(least, least[jump]), jump[jump]
        stops[np.unique(least[closed])] = True
        after = follows()
        to, _ = ranked(after)
    _, far = ranked(after)
    begins = np.flatnonzero(stops[start])
    begins = begins[begins < twin[to[begins]]]  # each arc once, not both ways
    lookup = np.full(2 * m, -1)
    lookup[to[begins]] = begins
    own = np.flatnonzero(lookup[to] >= 0)
    own = own[np.lexsort((-far[own], lookup[to[own]]))]
    return own, lookup[to[own]], closed[own]


def _chained(t: pa.Table, cuts: list[float]) -> pa.Table:
    """Chains of a stripe's pieces, which are those that begin in it; those that only end in it tell of its points. Chains end at points of other stripes, and where a piece of another one comes in, and are then open; notes tell which of their ends, and of the latter points, are junctions."""
    t = t.sort_by([(c, "ascending") for c in ("x1", "y1", "x2", "y2")])
    x1, y1, x2, y2, left, right = (t[c].to_numpy() for c in ("x1", "y1", "x2", "y2", "d_left", "d_right"))
    m, own_stripe = len(x1), t["stripe"][0].as_py()
    points, at = np.unique(np.concatenate([np.stack([x1, y1], 1), np.stack([x2, y2], 1)]), axis=0, return_inverse=True)
    at = at.ravel()
    start, stop = at, np.r_[at[m:], at[:m]]
    left, right = np.r_[left, right], np.r_[right, left]
    degree = np.bincount(start, minlength=len(points))
    low, high = np.minimum(left, right), np.maximum(left, right)
    stops = degree != 2
    order = np.argsort(start, kind="stable")
    first = order[np.searchsorted(start[order], np.arange(len(points)))]
    stops[start[(low != low[first[start]]) | (high != high[first[start]])]] = True  # where the districts on both sides change
    inside = np.searchsorted(cuts, points[:, 0], side="right") == own_stripe
    other = ~inside[at[:m]]  # another stripe's pieces
    met = np.zeros(len(points), bool)
    met[stop[:m][other]] = True
    ends = ~inside | (met & ~stops)  # chains go on from here
    own, head, _ = _chains(start, stop, stops | ends | met)
    kept = ~np.r_[other, other][own]
    own, head = own[kept], head[kept]
    begin = np.flatnonzero(np.r_[True, head[1:] != head[:-1]]) if len(own) else np.zeros(0, np.int64)
    n = np.diff(np.r_[begin, len(own)])
    # A chain's points: where its first half begins, and where each half ends.
    where = np.empty(len(own) + len(begin), np.int64)
    where[begin + np.arange(len(begin))] = start[own[begin]]
    where[np.arange(len(own)) + np.repeat(np.arange(len(begin)) + 1, n)] = stop[own]
    h = own[begin]
    last = own[begin + n - 1] if len(begin) else h
    onward = ends[start[h]] | ends[stop[last]]
    met[np.r_[start[h], stop[last]][np.r_[onward, onward]]] = True
    notes = np.flatnonzero(met & stops & inside)
    k, extra = len(begin), len(notes)
    where, size = np.r_[where, notes], np.r_[n + 1, np.ones(extra, np.int64)]
    none = np.full(extra, -1)
    return pa.table({
        "plan_id": pa.array(np.full(k + extra, t["plan_id"][0].as_py()), pa.int64()), "arc": pa.array((own_stripe << 32) + np.arange(k + extra), pa.int64()), "left_district": pa.array(np.r_[left[h], none], pa.int32()), "right_district": pa.array(np.r_[right[h], none], pa.int32()), "pts": _points(np.r_[0, np.cumsum(size)], points[where]),
        "stripe": pa.array(np.full(k + extra, own_stripe), pa.int32()), "open": pa.array(np.r_[onward, np.zeros(extra, bool)]), "note": pa.array(np.r_[np.zeros(k, bool), np.ones(extra, bool)]),
    })


def _linked(t: pa.Table) -> pa.Table:
    """Which open chains of a plan's stripes are one, by their ends."""
    t = t.sort_by("arc")
    note = t["note"].to_numpy()
    one, two = (np.stack([t[f"x{i}"].to_numpy(), t[f"y{i}"].to_numpy()], 1) for i in (1, 2))
    points, at = np.unique(np.concatenate([one, two]), axis=0, return_inverse=True)
    a, b = np.split(at.ravel(), 2)
    stops = np.zeros(len(points), bool)
    stops[a[note]] = True
    a, b, arc = a[~note], b[~note], t["arc"].to_numpy()[~note]
    m = len(arc)
    start, stop = np.r_[a, b], np.r_[b, a]
    stops |= np.bincount(start, minlength=len(points)) != 2
    own, head, loop = _chains(start, stop, stops)
    begin = np.flatnonzero(np.r_[True, head[1:] != head[:-1]]) if len(own) else np.zeros(0, np.int64)
    n = np.diff(np.r_[begin, len(own)])
    return pa.table({
        "plan_id": pa.array(np.full(len(own), t["plan_id"][0].as_py()), pa.int64()), "arc": pa.array(arc[own % max(1, m)]), "chain": pa.array(np.repeat(arc[own[begin] % max(1, m)], n)), "pos": pa.array(_spread(np.zeros(len(n), np.int64), n), pa.int32()),
        "turned": pa.array(own >= m), "loop": pa.array(loop),
    })


def _farthest(xy: np.ndarray) -> tuple[int, float]:
    """The inner point farthest from the line between the ends (from the first end, if both are one)."""
    a, b = xy[0], xy[-1]
    d = b - a
    n = math.hypot(*d)
    w = xy[1:-1] - a
    if n:
        t = np.clip((w @ d) / (n * n), 0, 1)
        far = np.hypot(*(w - t[:, None] * d).T)
    else:
        far = np.hypot(*w.T)
    k = int(np.argmax(far))
    return k + 1, float(far[k])


def _thinned(xy: np.ndarray, tol: float) -> np.ndarray:
    """Indexes of the points that stay: no other lies farther than the tolerance from the line between those beside it. A closed line keeps three different points, if it has them."""
    keep = {0, len(xy) - 1}
    todo = [(0, len(xy) - 1)]
    if len(xy) > 3 and (xy[0] == xy[-1]).all():
        k, _ = _farthest(xy)
        keep.add(k)
        todo = [(0, k), (k, len(xy) - 1)]
        far = [(_farthest(xy[a : b + 1]), a) for a, b in todo if b - a > 1]
        (j, _), a = max(far, key=lambda f: f[0][1])
        keep.add(a + j)
    while todo:
        a, b = todo.pop()
        if b - a > 1:
            k, far = _farthest(xy[a : b + 1])
            if far > tol:
                keep.add(a + k)
                todo += [(a, a + k), (a + k, b)]
    return np.array(sorted(keep))


def simplified(arcs_: DataFrame, tol: float) -> DataFrame:
    """arcs with fewer points: those that stay within the tolerance of the line are left out. Junctions stay, and of several arcs between the same two junctions all but one keep a point
    between them, so that no district of some area is lost. Lines that run closer together than the tolerance may cross."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("arc", ignore_index=True)
        straight, out = set(), []
        for pts in pdf.pts:
            xy = np.array([(p["x"], p["y"]) for p in pts])
            own = _thinned(xy, tol)
            if len(own) == 2:
                ends = frozenset((tuple(xy[0]), tuple(xy[-1])))
                if ends in straight and len(xy) > 2:
                    own = np.array([0, _farthest(xy)[0], len(xy) - 1])
                straight.add(ends)
            out.append([pts[i] for i in own.tolist()])
        return pdf.assign(pts=out)

    return arcs_.groupBy("plan_id").applyInPandas(run, ARC)


RING = f"plan_id long, district int, polygon int, ring int, is_hole boolean, area double, pts {POINTS}"


def outlines(arcs_: DataFrame) -> DataFrame:
    """(plan_id, district, polygon, ring, is_hole, area, pts): each district's closed rings, the inside on the left; polygons from the largest on, each with its outer ring (0) and the holes in it. area is
    the ring's own. Parts that touch in a point are polygons apart, holes that do are one ring. A small district's arcs are one task's. Large districts are cut to stripes, in each of which a task links arcs to paths;
    rings that cross from one to the next are linked by the paths' ends, and holes are looked up by cells among the rings about them."""
    own = lambda d, turned: arcs_.where(F.col(d) >= 0).select("plan_id", F.col(d).alias("district"), (2 * F.col("arc") + turned).alias("key"), (F.reverse("pts") if turned else F.col("pts")).alias("pts"))
    both = own("left_district", 0).unionByName(own("right_district", 1))
    most = both.groupBy("plan_id", "district").agg(F.sum(F.size("pts")).alias("n")).agg(F.max("n")).first()[0]
    cuts = _cuts(arcs_, F.col("pts")[0]["x"], math.ceil((most or 0) / STRIPE))
    if not cuts:
        return both.drop("key").groupBy("plan_id", "district").applyInPandas(_rings, RING)
    at = lambda k: _stripe(F.element_at("pts", k)["x"], cuts)
    part = f"plan_id long, district int, key long, before long, last long, open boolean, area double, pts {POINTS}"
    by = ["plan_id", "district"]
    t = both.withColumn("stripe", F.explode(F.array_distinct(F.array(at(1), at(-1))))).groupBy(*by, "stripe").applyInArrow(lambda x: _paths_of(x, cuts), part)
    t = graph.stored(t, "paths")
    linked = t.where("open").select(*by, "key", "before", "last").groupBy(*by).applyInArrow(_joined, "plan_id long, district int, key long, ring long, pos int")
    c = t.where("open").join(linked, [*by, "key"]).groupBy(*by, "ring").agg(F.sort_array(F.collect_list(F.struct("pos", "pts"))).alias("parts")).select(*by, _strung("parts").alias("pts"))
    x0, y0 = F.col("pts")[0]["x"], F.col("pts")[0]["y"]
    step = lambda p, i: (p["x"] - x0) * (F.get("pts", i + 1)["y"] - y0) - (F.get("pts", i + 1)["x"] - x0) * (p["y"] - y0)
    c = c.withColumn("area", F.aggregate(F.transform(F.slice("pts", F.lit(1), F.size("pts") - 1), step), F.lit(0.0), lambda a, x: a + x) / 2)
    return _nested(t.where("not open").select(*by, "area", "pts").unionByName(c.select(*by, "area", "pts")).where(F.size("pts") > 3))


def _nested(rings: DataFrame) -> DataFrame:
    """The rings (plan_id, district, area, pts) with their polygons: each hole in the smallest outer ring about it."""
    by = ["plan_id", "district"]
    end = lambda f, c: f(F.transform("pts", lambda p: p[c]))
    r = graph.stored(rings.withColumns({"x1": end(F.array_min, "x"), "y1": end(F.array_min, "y"), "x2": end(F.array_max, "x"), "y2": end(F.array_max, "y")}), "rings")
    number = lambda *cols: F.row_number().over(W.partitionBy(*cols).orderBy("order", "x1", "y1", "pts"))
    extent = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    outer = r.where("area > 0").withColumn("order", -F.col("area")).withColumns({"polygon": number(*by) - 1, "level": F.ceil(F.log2(extent)).cast("int")})
    names = [*by, "polygon", "ring", "is_hole", "area", "pts"]
    whole = outer.withColumns({"ring": F.lit(0), "is_hole": F.lit(False)}).select(*names)
    holes = r.where("area < 0").withColumn("order", F.col("area"))
    if holes.isEmpty():
        return whole
    outer = graph.stored(outer, "outer")
    whole = outer.withColumns({"ring": F.lit(0), "is_hole": F.lit(False)}).select(*names)
    middle = lambda c: (F.col("pts")[0][c] + F.col("pts")[1][c]) / 2
    holes = graph.stored(holes.withColumns({"hole": number(*by), "x": middle("x"), "y": middle("y")}), "holes")
    levels = sorted(v["level"] for v in outer.select("level").distinct().collect())  # sizes by powers of two
    cell = F.pow(F.lit(2.0), F.col("level"))
    cells = lambda c: F.explode(F.sequence(F.floor(F.col(f"{c}1") / cell), F.floor(F.col(f"{c}2") / cell)))
    boxes = outer.select(*by, "polygon", "level", "x1", "y1", "x2", "y2").withColumn("gx", cells("x")).withColumn("gy", cells("y"))
    asked = holes.select(*by, "hole", "x", "y").withColumn("level", F.explode(F.lit(levels).cast("array<int>"))).withColumns({f"g{c}": F.floor(F.col(c) / cell) for c in "xy"})
    asked = asked.join(boxes, [*by, "level", "gx", "gy"]).where("x between x1 and x2 and y between y1 and y2").groupBy(*by, "polygon").agg(F.collect_list(F.struct("hole", "x", "y")).alias("asked"))

    def run(batches):
        for pdf in batches:
            for plan, district, polygon, pts, holes in zip(pdf.plan_id, pdf.district, pdf.polygon, pdf.pts, pdf.asked):
                ring = np.array([(p["x"], p["y"]) for p in pts])
                found = [h["hole"] for h in holes if contains(ring, h["x"], h["y"])]
                yield pd.DataFrame({"plan_id": plan, "district": district, "polygon": polygon, "hole": found})

    held = outer.select(*by, "polygon", "pts").join(asked, [*by, "polygon"]).mapInPandas(run, "plan_id long, district int, polygon int, hole int")
    held = held.groupBy(*by, "hole").agg(F.max("polygon").alias("polygon"))  # the smallest
    inner = holes.join(held, [*by, "hole"], "left").withColumn("polygon", F.coalesce("polygon", F.lit(0))).join(outer.where("polygon = 0").select(*by), by, "left_semi")
    return whole.unionByName(inner.withColumns({"ring": number(*by, "polygon"), "is_hole": F.lit(True)}).select(*names))


def _paths(after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes in order of their paths, and where each path begins. after: the node that follows each one, -1 at an end; circles begin at their least node."""
    n = len(after)
    ids = np.arange(n)

    def ranked():
        to, far = np.where(after < 0, ids, after), (after >= 0).astype(np.int64)
        for _ in range(n.bit_length() + 1):
            far, to = far + far[to], to[to]
        return to, far

    to, far = ranked()
    closed = after[to] >= 0
    if closed.any():
        least, jump = ids, np.where(after < 0, ids, after)
        for _ in range(n.bit_length() + 1):
            least, jump = np.minimum(least, least[jump]), jump[jump]
        after = np.where(closed & (after == least), -1, after)
        to, far = ranked()
    order = np.lexsort((-far, to))
    return order, np.flatnonzero(np.r_[True, to[order][1:] != to[order][:-1]]) if n else order


def _paths_of(t: pa.Table, cuts: list[float]) -> pa.Table:
    """Paths of a district's arcs that begin in a stripe; those that only end in it tell what comes before. A path that is no ring is open; before and last: the arc before it (-1: none) and its last one."""
    stripe, key = t["stripe"][0].as_py(), t["key"].to_numpy()
    begin, xy = _xy(t["pts"])
    a, b = xy[begin[:-1]], xy[begin[1:] - 1]
    order = np.lexsort((key, xy[begin[:-1] + 1, 1], xy[begin[:-1] + 1, 0], a[:, 1], a[:, 0]))
    first, size, key, a, b = begin[:-1][order], np.diff(begin)[order], key[order], a[order], b[order]
    here = lambda p: np.searchsorted(cuts, p[:, 0], side="right") == stripe
    own, ends = here(a), here(b)
    points, at = np.unique(np.concatenate([a, b]), axis=0, return_inverse=True)
    pa_, pb = np.split(at.ravel(), 2)
    into, out = np.flatnonzero(ends), np.flatnonzero(own)
    into, out = into[np.argsort(pb[into], kind="stable")], out[np.argsort(pa_[out], kind="stable")]
    ids = np.arange(len(points))
    (i0, i1), (o0, o1) = ([np.searchsorted(p, ids, side=s) for s in ("left", "right")] for p in (pb[into], pa_[out]))
    after = np.full(len(key), -1)
    single = np.flatnonzero((i1 - i0 == 1) & (o1 - o0 == 1))
    after[into[i0[single]]] = out[o0[single]]
    for p in np.flatnonzero((i1 > i0) & (o1 > o0) & ((i1 - i0 > 1) | (o1 - o0 > 1))).tolist():
        ways = out[o0[p] : o1[p]].tolist()
        for i in into[i0[p] : i1[p]].tolist():
            if not ways:
                break
            (ux, uy) = xy[first[i] + size[i] - 1] - xy[first[i] + size[i] - 2]
            turn = lambda w: math.atan2(ux * (v := xy[first[w] + 1] - xy[first[w]])[1] - uy * v[0], ux * v[0] + uy * v[1])  # noqa: B023, E731
            after[i] = best = max(ways, key=turn)
            ways.remove(best)
    before = np.full(len(key), -1)
    before[after[after >= 0]] = np.flatnonzero(after >= 0)
    place = np.cumsum(own) - 1
    rows = np.flatnonzero(own)
    path, heads = _paths(np.where(after[rows] >= 0, place[after[rows]], -1))
    path = rows[path]
    count = np.diff(np.r_[heads, len(path)])
    head, last = path[heads], path[heads + count - 1] if len(heads) else path
    closed = after[last] == head
    # Points: where a path's first arc begins, and all but the first of each arc.
    more = size[path] - 1
    reach = np.add.reduceat(more, heads) if len(heads) else more
    places = np.empty(int(more.sum()) + len(heads), np.int64)
    starts = np.cumsum(reach + 1) - (reach + 1)
    places[starts] = first[head]
    rest = np.ones(len(places), bool)
    rest[starts] = False
    places[rest] = _spread(first[path] + 1, more)
    pts, begin = xy[places], np.r_[starts, len(places)].astype(np.int64)
    x, y = (pts - np.repeat(pts[starts], reach + 1, axis=0)).T
    cross = np.r_[x[:-1] * y[1:] - x[1:] * y[:-1], 0.0] if len(x) else x
    cross[begin[1:] - 1] = 0.0
    area = np.add.reduceat(cross, starts) / 2 if len(starts) else np.zeros(0)
    k = len(head)
    return pa.table({
        "plan_id": pa.array(np.full(k, t["plan_id"][0].as_py()), pa.int64()), "district": pa.array(np.full(k, t["district"][0].as_py()), pa.int32()), "key": pa.array(key[head], pa.int64()), "before": pa.array(np.where(before[head] >= 0, key[before[head]], -1), pa.int64()),
        "last": pa.array(key[last], pa.int64()), "open": pa.array(~closed), "area": pa.array(area, pa.float64()), "pts": _points(begin, pts),
    })


def _joined(t: pa.Table) -> pa.Table:
    """Which open paths of a district are one ring, by the arcs at their ends."""
    t = t.sort_by("key")
    key, before, last = (t[c].to_numpy() for c in ("key", "before", "last"))
    order = np.argsort(before, kind="stable")
    at = np.minimum(np.searchsorted(before[order], last), len(order) - 1)
    path, heads = _paths(np.where(before[order][at] == last, order[at], -1))
    n = np.diff(np.r_[heads, len(path)])
    return t.select(["plan_id", "district"]).append_column("key", pa.array(key[path])).append_column("ring", pa.array(np.repeat(key[path[heads]], n))).append_column("pos", pa.array(_spread(np.zeros(len(n), np.int64), n), pa.int32()))


def signed_area(xy: np.ndarray) -> float:
    x, y = (xy - xy[0]).T
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def contains(ring: np.ndarray, x: float, y: float) -> bool:
    """Whether a closed ring has the point inside, by the parity of crossings."""
    a, b = ring[:-1], ring[1:]
    up = (a[:, 1] > y) != (b[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
    return bool((up & (x < cross)).sum() % 2)


def _rings(pdf: pd.DataFrame) -> pd.DataFrame:
    lines = sorted(([(p["x"], p["y"]) for p in pts] for pts in pdf.pts))
    leaving: dict[tuple, list[int]] = {}
    for k, p in enumerate(lines):
        leaving.setdefault(p[0], []).append(k)
    turn = lambda p, q, r: math.atan2((q[0] - p[0]) * (r[1] - q[1]) - (q[1] - p[1]) * (r[0] - q[0]), (q[0] - p[0]) * (r[0] - q[0]) + (q[1] - p[1]) * (r[1] - q[1]))
    left, rings = set(range(len(lines))), []
    for k in range(len(lines)):
        if k not in left:
            continue
        ring, now = [lines[k][0]], k
        while now in left:
            left.discard(now)
            ring += lines[now][1:]
            ways = [w for w in leaving.get(ring[-1], []) if w in left]
            if ring[-1] == ring[0] and not any(turn(ring[-2], ring[-1], lines[w][1]) > turn(ring[-2], ring[-1], lines[k][1]) for w in ways):
                break
            if not ways:
                break
            now = max(ways, key=lambda w: turn(ring[-2], ring[-1], lines[w][1]))
        if len(ring) > 3:
            rings.append(np.array(ring))
    area = [signed_area(r) for r in rings]
    outer = sorted((i for i, a in enumerate(area) if a > 0), key=lambda i: (-area[i], rings[i].min(0).tolist()))
    rows, n = [], {i: 0 for i in outer}
    plan, district = pdf.plan_id.iloc[0], pdf.district.iloc[0]
    points = lambda r: [{"x": x, "y": y} for x, y in r.tolist()]
    for k, i in enumerate(outer):
        rows.append((plan, district, k, 0, False, area[i], points(rings[i])))
    for i in sorted((i for i, a in enumerate(area) if a < 0), key=lambda i: (area[i], rings[i].min(0).tolist())):
        x, y = (rings[i][0] + rings[i][1]) / 2
        around = [o for o in outer if contains(rings[o], x, y)] or outer[:1]
        if around:
            o = around[-1]  # the smallest
            n[o] += 1
            rows.append((plan, district, outer.index(o), n[o], True, area[i], points(rings[i])))
    return pd.DataFrame(rows, columns=["plan_id", "district", "polygon", "ring", "is_hole", "area", "pts"])


# ---- labels ----


def _depth(x: np.ndarray, y: np.ndarray, s: np.ndarray) -> np.ndarray:
    """How deep points lie inside: their distance from the nearest side, less than 0 outside. s: (sides, 4)."""
    d = s[:, 2:] - s[:, :2]
    w = np.stack([x, y], 1)[:, None] - s[None, :, :2]
    t = np.clip((w * d).sum(2) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
    far = np.sqrt(((w - t[:, :, None] * d) ** 2).sum(2)).min(1)
    up = (s[:, 1] > y[:, None]) != (s[:, 3] > y[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = s[:, 0] + (y[:, None] - s[:, 1]) * d[:, 0] / d[:, 1]
    return np.where((up & (x[:, None] < cross)).sum(1) % 2, far, -far)


def deepest(rings: list[np.ndarray], precision: float) -> tuple[float, float, float]:
    """(x, y, depth) of the point farthest from the outline, within the precision: quarters of squares are looked at in the order of the most depth that they can have, and left when that is no gain.
    The most is a square's middle's depth and half its diagonal."""
    s = np.concatenate([np.hstack([r[:-1], r[1:]]) for r in rings])
    (x0, y0), (x1, y1) = rings[0].min(0), rings[0].max(0)
    h = max(min(x1 - x0, y1 - y0), max(x1 - x0, y1 - y0) / 16) / 2
    gx, gy = (a.ravel() for a in np.meshgrid(np.arange(x0 + h, x1 + h, 2 * h), np.arange(y0 + h, y1 + h, 2 * h)))
    best, queue = (-math.inf, x0, y0), []

    def look(x: np.ndarray, y: np.ndarray, h: float) -> None:
        nonlocal best
        depth = _depth(x, y, s)
        k = int(np.argmax(depth))
        best = max(best, (float(depth[k]), float(x[k]), float(y[k])))
        for d, px, py in zip(depth.tolist(), x.tolist(), y.tolist()):
            heapq.heappush(queue, (-(d + h * math.sqrt(2)), px, py, h))

    look(gx, gy, h)
    while queue:
        most, x, y, h = heapq.heappop(queue)
        if -most <= max(best[0], 0.0) + precision and best[0] > 0 or h < 1e-12 * max(abs(x1), abs(y1), 1):
            break
        h /= 2
        look(np.array([x - h, x + h, x - h, x + h]), np.array([y - h, y - h, y + h, y + h]), h)
    return best[1], best[2], best[0]


def label_points(outlines_: DataFrame, precision: float = 1e-3) -> DataFrame:
    """(plan_id, district, label_x, label_y, depth): each district's point farthest from its outline, within `precision` of its extent: always inside, whatever its form. Of several polygons the one
    with the deepest point."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, own in pdf.sort_values(["polygon", "ring"]).groupby("polygon"):
            rings = [np.array([(p["x"], p["y"]) for p in pts]) for pts in own.pts]
            reach = float(np.ptp(rings[0], axis=0).max())
            x, y, depth = deepest(rings, precision * reach)
            found.append((depth, x, y))
        depth, x, y = max(found)
        return pd.DataFrame({"plan_id": [pdf.plan_id.iloc[0]], "district": [pdf.district.iloc[0]], "label_x": [x], "label_y": [y], "depth": [depth]})

    return outlines_.groupBy("plan_id", "district").applyInPandas(run, "plan_id long, district int, label_x double, label_y double, depth double")


def placed_labels(points: DataFrame, size: Column, text: Column, char_width: float, height: float, margin: float) -> DataFrame:
    """(plan_id, district, label, shown): which labels stand without covering another: districts of more precincts first (then the lower number), each shown unless its box meets one that is. points:
    plan_id, district, label_x, label_y and what size and text are made of. A plan's labels, one a district, are one task's."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "district"], ascending=[False, True], ignore_index=True)
        boxes, shown = np.empty((0, 4)), []
        for r in pdf.itertuples():
            w, h = len(r.label) * char_width / 2 + margin, height / 2 + margin
            box = np.array([r.label_x - w, r.label_y - h, r.label_x + w, r.label_y + h])
            free = ((boxes[:, 2] < box[0]) | (boxes[:, 0] > box[2]) | (boxes[:, 3] < box[1]) | (boxes[:, 1] > box[3])).all()
            shown.append(bool(free))
            if free:
                boxes = np.vstack([boxes, box])
        return pdf.assign(shown=shown)[["plan_id", "district", "label", "shown"]]

    p = points.select(F.col("plan_id").cast("long").alias("plan_id"), F.col("district").cast("int").alias("district"), "label_x", "label_y", size.alias("size"), text.cast("string").alias("label"))
    return p.groupBy("plan_id").applyInPandas(run, "plan_id long, district int, label string, shown boolean")


def polygons(rings: DataFrame) -> DataFrame:
    """(plan_id, district, rings): one row a district in the layers' own form, for a vector file."""
    part = F.struct("polygon", "ring", F.struct("is_hole", "pts").alias("r"))
    return rings.groupBy("plan_id", "district").agg(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["r"]).cast(geometry.RINGS).alias("rings"))
