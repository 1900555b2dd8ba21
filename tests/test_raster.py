import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.micro import polygons, square
from tests.test_topology import ring
from wardflow.operators import raster, topology

W, H = 60, 44


def picture(df):
    out = np.full((H, W), -1)
    for r in df.collect():
        assert out[r["row"], r["col"]] == -1
        out[r["row"], r["col"]] = r["precinct_id"]
    return out


def brute(rings):
    """Each pixel's middle against each outer ring."""
    pts = [p for own in rings for r in own if not r["is_hole"] for p in r["pts"]]
    x0, x1, y0, y1 = (f(p[c] for p in pts) for c in "xy" for f in (min, max))
    scale = min(W / (x1 - x0), H / (y1 - y0)) * 0.96
    left, low = (W - (x1 - x0) * scale) / 2, (H - (y1 - y0) * scale) / 2
    out = np.full((H, W), -1)
    for k, own in enumerate(rings):
        for r in own:
            if not r["is_hole"]:
                xy = np.array([((p["x"] - x0) * scale + left, H - ((p["y"] - y0) * scale + low)) for p in r["pts"]])
                for i in range(H):
                    for j in range(W):
                        if topology.contains(xy, j + 0.5, i + 0.5):
                            out[i, j] = max(out[i, j], k)
    return out


RINGS = [
    [ring((0, 0), (4, 0.3), (5.1, 3), (2, 5.2))],
    [ring((4, 0.3), (9, 1), (8.2, 6), (5.1, 3))],
    [square(0, 6, 3), square(1, 7, 1, hole=True)],
    [square(1, 7, 1)],
    [ring((5, 6), (9, 9), (5, 9), (6.5, 7.8))],
    [ring((3, 2), (6, 2), (6, 4), (3, 4))],  # over others
]


def test_pixels_are_brute_force(spark):
    assert (picture(raster.pixels(polygons(spark, RINGS), W, H)) == brute(RINGS)).all()
    assert raster.pixels(polygons(spark, RINGS).limit(0), W, H).count() == 0


def moved(a, fill=-1):
    p = np.pad(a, 1, constant_values=fill)
    return p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]


def test_masks_are_brute_force(spark):
    want = brute(RINGS)
    v = raster.pixels(polygons(spark, RINGS), W, H).withColumnRenamed("precinct_id", "value")
    got = raster.borders(v, W, H)
    valid = want >= 0
    border = valid & np.any([(m != want) & (m >= 0) for m in moved(want)], axis=0)
    outline = valid & np.any([m == -1 for m in moved(want, fill=9)], axis=0)
    mask = {c: np.zeros((H, W), bool) for c in ("border", "outline")}
    for r in got.collect():
        for c in mask:
            mask[c][r["row"], r["col"]] = r[c]
    assert (mask["border"] == border).all() and (mask["outline"] == outline).all() and border.any() and outline.any()
    for t in (1, 3):
        thick = border
        for _ in range(t - 1):
            thick = thick | np.any(moved(thick, fill=False), axis=0)
        found = {(r["row"], r["col"]) for r in raster.thickened(got.where("border"), t, W, H).collect()}
        assert found == set(zip(*(x.tolist() for x in np.nonzero(thick))))


def test_plans_apart(spark):
    v = raster.pixels(polygons(spark, [[square(0, 0)], [square(1, 0)]]), W, H)
    both = v.withColumn("plan_id", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("value", F.when(F.col("plan_id") == 1, F.col("precinct_id")).otherwise(F.lit(0)))
    n = {r["plan_id"]: r["n"] for r in raster.borders(both, W, H, ["plan_id"]).groupBy("plan_id").agg(F.count_if("border").alias("n")).collect()}
    rows = len({r["row"] for r in v.collect()})
    assert n == {1: 2 * rows, 2: 0} and rows == pytest.approx(math.floor(W / 2 * 0.96), abs=1)
