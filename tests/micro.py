"""The 2 x 2 layer whose metrics were worked out by hand, and small polygon layers."""

from wardflow.functions.geometry import RINGS, area, extrema, perimeter
from wardflow.operators.score import Layer
from pyspark.sql import functions as F


def square(x, y, size=1.0, hole=False):
    pts = [(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)]
    return {"is_hole": hole, "pts": [{"x": float(a), "y": float(b)} for a, b in pts]}


def polygons(spark, rings, **columns):
    rows = [(i, r, *(columns[c][i] for c in columns)) for i, r in enumerate(rings)]
    kinds = "".join(f", {c} long" for c in columns)
    return spark.createDataFrame(rows, f"precinct_id long, rings {RINGS}{kinds}")


def micro(spark):
    p = polygons(spark, [[square(i % 2, i // 2)] for i in range(4)], population=[10, 20, 30, 40], dem_votes=[6, 2, 5, 1], rep_votes=[4, 8, 5, 9], county_id=[0, 0, 1, 1], x=[0, 1, 0, 1], y=[0, 0, 1, 1])
    p = p.withColumn("precinct_key", F.lpad(F.col("precinct_id").cast("string"), 3, "0"))
    edges = spark.createDataFrame([(0, 1, 1.0, False), (0, 2, 1.0, False), (1, 3, 1.0, False), (2, 3, 1.0, False)], "u long, v long, shared_len double, is_virtual boolean")
    geo = p.select("precinct_id", area(F.col("rings")).alias("area"), (perimeter(F.col("rings")) - 2.0).alias("ext_perimeter"))
    ref = p.select("precinct_id", F.col("y").cast("int").alias("ref_district"), (F.col("y") + 10).alias("ref_label"))
    plan = p.select(F.lit(0).cast("long").alias("plan_id"), "precinct_id", F.col("x").cast("int").alias("district"))
    return Layer(p, edges, geo, extrema(p), ref), plan
