"""Layers as pixels and the masks that a map draws: borders of precincts, counties and districts, and the outline.

A layer is fitted into the picture with a margin, its y axis up. A pixel belongs to the precinct whose outer ring has the pixel's middle inside (holes are drawn by what lies in them); of several the
highest precinct. Rings become spans by scan lines: each side crosses the middles of some rows, and a row's crossings, in order, open and close the ring. All of it are expressions, grouped by ring and row, and by pixel.

Nulls: precincts without rings have no pixels. A layer without extent is one point in the middle. An empty layer has no pixels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MARGIN = 0.96


def pixels(layer: DataFrame, width: int, height: int) -> DataFrame:
    """(row, col, precinct_id) of a picture of the layer, row 0 at the top."""
    r = layer.select("precinct_id", F.posexplode("rings").alias("ring", "r")).where(~F.col("r.is_hole")).select("precinct_id", "ring", F.col("r.pts").alias("pts"))
    p = F.explode("pts").alias("p")
    box = r.select(p).agg(F.min("p.x").alias("x0"), F.max("p.x").alias("x1"), F.min("p.y").alias("y0"), F.max("p.y").alias("y1")).first()
    if box["x0"] is None:
        return layer.sparkSession.createDataFrame([], "row long, col long, precinct_id long")
    wide, high = max(box["x1"] - box["x0"], 1e-9), max(box["y1"] - box["y0"], 1e-9)
    scale = min(width / wide, height / high) * MARGIN
    left, low = (width - wide * scale) / 2, (height - high * scale) / 2
    at = lambda q: F.struct(((q["x"] - box["x0"]) * scale + left).alias("x"), (height - ((q["y"] - box["y0"]) * scale + low)).alias("y"))
    side = F.transform(F.slice("pts", F.lit(1), F.size("pts") - 1), lambda q, i: F.struct(at(q).alias("a"), at(F.get("pts", i + 1)).alias("b")))
    s = r.where(F.size("pts") > 3).select("precinct_id", "ring", F.explode(side).alias("s")).select("precinct_id", "ring", "s.*").where("a.y <> b.y")
    first, end = F.greatest(F.ceil(F.least("a.y", "b.y") - 0.5), F.lit(0)), F.least(F.ceil(F.greatest("a.y", "b.y") - 0.5), F.lit(height)) - 1
    s = s.withColumns({"first": first, "end": end}).where("first <= end").withColumn("row", F.explode(F.sequence("first", "end")))
    cross = F.col("a.x") + (F.col("row") + 0.5 - F.col("a.y")) * (F.col("b.x") - F.col("a.x")) / (F.col("b.y") - F.col("a.y"))
    lines = s.groupBy("precinct_id", "ring", "row").agg(F.sort_array(F.collect_list(cross)).alias("xs"))
    # Crossings open and close the ring in turn.
    spans = F.transform(F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1), lambda k: F.struct(F.greatest(F.ceil(F.get("xs", 2 * k) - 0.5), F.lit(0)).alias("a"), (F.least(F.ceil(F.get("xs", 2 * k + 1) - 0.5), F.lit(width)) - 1).alias("b")))
    spans = lines.where(F.size("xs") > 1).select("precinct_id", "row", F.explode(spans).alias("s")).where("s.a <= s.b")
    return spans.select("precinct_id", "row", F.explode(F.sequence("s.a", "s.b")).alias("col")).groupBy("row", "col").agg(F.max("precinct_id").alias("precinct_id"))


def borders(values: DataFrame, width: int, height: int, by: list[str] | None = None) -> DataFrame:
    """by, row, col, border and outline: whether a pixel has a neighbour (above, below or beside) of another value, or one that is empty within the picture. values: by, row, col, value."""
    by = by or []

    def look(along: str, across: str, most: int) -> list:
        w = W.partitionBy(*by, across).orderBy(along)
        out = []
        for step, edge in ((F.lag, 0), (F.lead, most - 1)):
            near = step(along).over(w)
            there = F.coalesce(F.abs(near - F.col(along)) == 1, F.lit(False))
            out.append((there & (step("value").over(w) != F.col("value")), ~there & (F.col(along) != edge)))
        return out

    sides = look("col", "row", width) + look("row", "col", height)
    v = values.select(*by, "row", "col", "value", *[c.alias(f"{n}{k}") for k, pair in enumerate(sides) for n, c in zip("bo", pair)])
    any_ = lambda n: F.greatest(*[F.col(f"{n}{k}").cast("int") for k in range(4)]) == 1
    return v.select(*by, "row", "col", any_("b").alias("border"), any_("o").alias("outline"))


def thickened(mask: DataFrame, thickness: int, width: int, height: int, by: list[str] | None = None) -> DataFrame:
    """(by, row, col) of the mask's pixels and those within thickness - 1 steps up, down or aside, inside the picture. mask: by, row, col."""
    by, r = by or [], thickness - 1
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-r, r + 1) for b in range(abs(a) - r, r - abs(a) + 1)])).alias("s")
    m = mask.select(*by, "row", "col", steps).select(*by, (F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col"))
    return m.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)).distinct()
