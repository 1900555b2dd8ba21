"""Polygons as arrays of rings, struct<is_hole, pts: array<struct<x, y>>> (closed), and what follows from them, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RINGS = "array<struct<is_hole:boolean,pts:array<struct<x:double,y:double>>>>"
#: The 16 directions in which extreme points are taken.
DIRECTIONS = [(math.cos(2 * math.pi * i / 16), math.sin(2 * math.pi * i / 16)) for i in range(16)]


def _steps(pts: Column, f) -> Column:
    """The sum of f(point, next point)."""
    return F.aggregate(F.transform(F.slice(pts, F.lit(1), F.size(pts) - 1), lambda p, i: f(p, F.get(pts, i + 1))), F.lit(0.0), lambda a, x: a + x)


def _rings(rings: Column, each) -> Column:
    return F.aggregate(F.transform(rings, each), F.lit(0.0), lambda a, x: a + x)


def area(rings: Column) -> Column:
    """Holes subtract."""
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    return _rings(rings, lambda r: F.when(r["is_hole"], -1.0).otherwise(1.0) * F.abs(_steps(r["pts"], cross)) / 2.0)


def perimeter(rings: Column) -> Column:
    """Holes add."""
    return _rings(rings, lambda r: _steps(r["pts"], lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"])))


def centroid(rings: Column) -> Column:
    """struct<x, y>; null without area."""
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]

    def moment(axis: str) -> Column:
        def one(r: Column) -> Column:
            m = _steps(r["pts"], lambda p, q: (p[axis] + q[axis]) * cross(p, q))
            a = _steps(r["pts"], cross)
            return F.when(r["is_hole"], -1.0).otherwise(1.0) * F.signum(a) * m / 6.0

        return _rings(rings, one)

    a = area(rings)
    return F.when(a > 0, F.struct((moment("x") / a).alias("x"), (moment("y") / a).alias("y")))


def segments(layer: DataFrame) -> DataFrame:
    """(precinct_id, x1, y1, x2, y2, len): each ring's sides, smaller end first."""
    r = layer.select("precinct_id", F.explode("rings").alias("r")).select("precinct_id", F.col("r.pts").alias("pts"))
    side = F.transform(F.slice("pts", F.lit(1), F.size("pts") - 1), lambda p, i: F.struct(p.alias("a"), F.get("pts", i + 1).alias("b")))
    s = r.select("precinct_id", F.explode(side).alias("s")).where("s.a <> s.b")
    s = s.select("precinct_id", F.least("s.a", "s.b").alias("a"), F.greatest("s.a", "s.b").alias("b"))
    return s.select("precinct_id", F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2"), F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")).alias("len"))


def extrema(layer: DataFrame) -> DataFrame:
    """(precinct_id, dir, px, py, proj): the farthest vertex in each direction; ties: the least (x, y)."""
    v = layer.select("precinct_id", F.flatten(F.transform("rings", lambda r: r["pts"])).alias("pts")).repartition("precinct_id")
    reach = lambda c, s: F.array_max(F.transform("pts", lambda p: F.struct(F.round(p["x"] * F.lit(c) + p["y"] * F.lit(s), 9).alias("proj"), (-p["x"]).alias("x"), (-p["y"]).alias("y"))))
    # Vertices are compared within their row, so that what is grouped has a row for each precinct and not one for each vertex and direction;
    # and they are dealt out first, as a layer's files are small and few tasks read them.
    v = v.select("precinct_id", *[reach(c, s).alias(f"e{i}") for i, (c, s) in enumerate(DIRECTIONS)])
    e = v.groupBy("precinct_id").agg(F.array(*[F.max(f"e{i}") for i in range(len(DIRECTIONS))]).alias("e"))
    e = e.select("precinct_id", F.posexplode("e").alias("dir", "e")).where("e is not null")
    return e.select("precinct_id", "dir", (-F.col("e.x")).alias("px"), (-F.col("e.y")).alias("py"), F.col("e.proj").alias("proj"))
