"""How well plans keep a reference plan's districts together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reference_plan(csv: DataFrame, precincts: DataFrame, key: str, label: str) -> DataFrame:
    """(precinct_id, ref_district, ref_label) of a plan's rows (key, label): labels of any kind become 0, 1, ... in their order."""
    from pyspark.sql import Window as W

    c = csv.select(F.trim(F.col(key).cast("string")).alias("k"), F.col(label).cast("long").alias("ref_label"))
    dense = c.select("ref_label").distinct().withColumn("ref_district", F.dense_rank().over(W.orderBy("ref_label")) - 1)
    own = precincts.select("precinct_id", F.trim(F.col("precinct_key").cast("string")).alias("k"))
    return c.join(own, "k").join(dense, "ref_label").select("precinct_id", "ref_district", "ref_label")


def cohesion(assignments: DataFrame, precincts: DataFrame, reference: DataFrame, focus: str = "none", wins_only: bool = False, win_share: float = 0.535, overlap: DataFrame | None = None) -> DataFrame:
    """(plan_id, ref_district, mass, cohesion): the sum of squared parts of a reference district's people, or of a party's voters. wins_only keeps the
    reference districts in which that party has over win_share of the two-party vote. overlap: (plan_id, ref_district, district, part), where it is known already."""
    weight = F.col({"none": "population", "dem": "dem_votes", "rep": "rep_votes"}[focus])
    p = precincts.join(reference, "precinct_id").select("precinct_id", "ref_district", weight.alias("weight"), "dem_votes", "rep_votes")
    own = p.groupBy("ref_district").agg(F.sum("weight").alias("mass"), F.sum("dem_votes").alias("d"), F.sum("rep_votes").alias("r"))
    if wins_only and focus in ("dem", "rep"):
        own = own.where((F.col("d") + F.col("r") > 0) & (F.col(focus[0]) / (F.col("d") + F.col("r")) > win_share))
    if overlap is None:
        overlap = assignments.join(p.select("precinct_id", "ref_district", "weight"), "precinct_id").groupBy("plan_id", "ref_district", "district").agg(F.sum("weight").alias("part"))
    part = F.col("part") / F.col("mass")
    return overlap.join(own.where("mass > 0"), "ref_district").groupBy("plan_id", "ref_district").agg(F.first("mass").alias("mass"), F.sum(part * part).alias("cohesion"))


#: Of a plan with nothing to compare.
NOTHING = {"alignment": 0.0, "alignment_mean": 100.0, "alignment_min": 100.0}


def of_plans(c: DataFrame) -> DataFrame:
    """The same for plans of which something is compared."""
    g = c.groupBy("plan_id").agg((100.0 * F.sum(F.col("mass") * (1.0 - F.col("cohesion"))) / F.sum("mass")).alias("alignment"), (F.min("cohesion") * 100.0).alias("alignment_min"))
    return g.withColumn("alignment_mean", 100.0 - F.col("alignment"))


def alignment(assignments: DataFrame, c: DataFrame) -> DataFrame:
    """(plan_id, alignment, alignment_mean, alignment_min): the penalty, and the mean and least cohesion in percent; 0, 100, 100 if nothing is compared."""
    return assignments.select("plan_id").distinct().join(of_plans(c), "plan_id", "left").na.fill(NOTHING)
