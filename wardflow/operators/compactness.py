"""Compactness of districts and plans."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.operators.districts import cut_edges, is_large, sorted_joins, spine

# The bands of the two measures, where the unclipped form leaves the line, and where it lands.
PP_BAND, REOCK_BAND, DIVERGE, LANDING = (0.10, 0.50), (0.25, 0.50), 15.0, 0.65


def polsby_popper_value(area: Column, perimeter: Column) -> Column:
    """1 without a perimeter."""
    return F.when(perimeter > 0, F.least(F.lit(1.0), 4 * math.pi * area / (perimeter * perimeter))).otherwise(F.lit(1.0))


def reock_value(area: Column, points: Column) -> Column:
    """points: an array of (px, py). 0 for a degenerate district."""
    square = lambda p, q: (p["px"] - q["px"]) * (p["px"] - q["px"]) + (p["py"] - q["py"]) * (p["py"] - q["py"])
    r2 = F.array_max(F.flatten(F.transform(points, lambda p: F.transform(points, lambda q: square(p, q))))) / 4.0
    return F.when(r2 > 0, F.least(F.lit(1.0), area / (math.pi * r2))).otherwise(F.lit(0.0))


def polsby_popper(assignments: DataFrame, geometry: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(plan_id, district, area, perimeter, polsby_popper). geometry: (precinct_id, area, ext_perimeter); a district's perimeter is its precincts' outer
    sides and its cut edges' shared lengths."""
    assignments = sorted_joins(assignments, is_large(geometry))
    own = assignments.join(geometry, "precinct_id").groupBy("plan_id", "district").agg(F.sum("area").alias("area"), F.sum("ext_perimeter").alias("ext"))
    cut = cut_edges(assignments, edges).select("plan_id", F.explode(F.array("du", "dv")).alias("district"), "shared_len").groupBy("plan_id", "district").agg(F.sum("shared_len").alias("cut"))
    d = spine(assignments, k).join(own, ["plan_id", "district"], "left").join(cut, ["plan_id", "district"], "left").na.fill(0.0, ["area", "ext", "cut"])
    p = F.col("ext") + F.col("cut")
    return d.select("plan_id", "district", "area", p.alias("perimeter"), polsby_popper_value(F.col("area"), p).alias("polsby_popper"))


def farthest(assignments: DataFrame, wide: DataFrame, directions: int = 16) -> DataFrame:
    """(plan_id, district, dir, precinct_id): the precinct that reaches farthest in each direction, the lowest of equals. wide: precinct_id and its reach in each
    direction, q0 and so on. Two passes of plain maxima and minima, which plans dealt by plan_id need no shuffle for."""
    ways = range(directions)
    own = assignments.join(wide, "precinct_id")
    most = own.groupBy("plan_id", "district").agg(*[F.max(f"q{k}").alias(f"m{k}") for k in ways])
    first = own.join(most.hint("shuffle_hash"), ["plan_id", "district"]).groupBy("plan_id", "district").agg(*[F.min(F.when(F.col(f"q{k}") == F.col(f"m{k}"), F.col("precinct_id"))).alias(f"i{k}") for k in ways])
    return first.select("plan_id", "district", F.posexplode(F.array(*[f"i{k}" for k in ways])).alias("dir", "precinct_id")).where("precinct_id is not null")


def reaches(extrema: DataFrame, directions: int = 16) -> DataFrame:
    """(precinct_id, q0, q1, ...): a row for each precinct."""
    return extrema.groupBy("precinct_id").agg(*[F.max(F.when(F.col("dir") == k, F.col("proj"))).alias(f"q{k}") for k in range(directions)])


def reock(assignments: DataFrame, geometry: DataFrame, extrema: DataFrame, k: int) -> DataFrame:
    """(plan_id, district, reock): the area over that of the circle whose diameter is the largest distance among 16 extreme points; 0 for a degenerate district."""
    large = is_large(geometry)
    assignments = sorted_joins(assignments, large)
    a = assignments.join(geometry.select("precinct_id", "area"), "precinct_id").groupBy("plan_id", "district").agg(F.sum("area").alias("area"))
    far = farthest(assignments, reaches(extrema)).join(sorted_joins(extrema, large), ["precinct_id", "dir"])
    pts = far.groupBy("plan_id", "district").agg(F.collect_list(F.struct("px", "py")).alias("ps"))
    d = spine(assignments, k).join(a, ["plan_id", "district"], "left").join(pts, ["plan_id", "district"], "left").na.fill(0.0, ["area"])
    return d.select("plan_id", "district", reock_value(F.col("area"), F.col("ps")).alias("reock"))


def penalty(d: DataFrame, column: str) -> DataFrame:
    """(plan_id, column): 100 times what the districts' mean lacks to 1."""
    return d.groupBy("plan_id").agg(((1.0 - F.avg(column)) * 100.0).alias(column))


def _band(raw: Column, lo: float, hi: float, unclipped: bool) -> Column:
    line = lambda x: 100.0 - (x - lo) / (hi - lo) * 100.0
    if not unclipped:
        return line(F.greatest(F.lit(lo), F.least(F.lit(hi), raw)))
    knee = lo + (1.0 - DIVERGE / 100.0) * (hi - lo)
    power = 100.0 / (hi - lo) * (LANDING - knee) / DIVERGE
    return F.when(raw <= lo, 100.0).when(raw <= knee, line(raw)).when(raw >= LANDING, 0.0).otherwise(DIVERGE * F.pow((LANDING - raw) / (LANDING - knee), F.lit(power)))


def blend(pp_penalty: Column, reock_penalty: Column, unclipped: bool = True) -> Column:
    """Half and half of both measures' band penalties."""
    return 0.5 * _band(1.0 - reock_penalty / 100.0, *REOCK_BAND, unclipped) + 0.5 * _band(1.0 - pp_penalty / 100.0, *PP_BAND, unclipped)


def rating(pp: Column, reock_value: Column) -> Column:
    """A district's clipped rating from 0 to 100."""
    return 100.0 - 0.5 * _band(reock_value, *REOCK_BAND, False) - 0.5 * _band(pp, *PP_BAND, False)
