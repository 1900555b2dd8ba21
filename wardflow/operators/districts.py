"""District aggregates that all metrics share. A district without precincts has a row of zeros, as n_districts is a setting and not a count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spine(assignments: DataFrame, k: int) -> DataFrame:
    """(plan_id, district) for every plan and 0..k-1."""
    return assignments.select("plan_id").distinct().select("plan_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("district"))


#: Rows of a layer's table that Spark may send to every task, if it chooses to.
FEW = 200_000


def is_large(layer: DataFrame) -> bool:
    return layer.select(F.lit(1)).limit(FEW + 1).count() > FEW


def sorted_joins(df: DataFrame, large: bool) -> DataFrame:
    """df, joined by sorting wherever it is joined next if its layer is large. Columns of few values take next to no room in files, by whose sizes Spark judges: it would take plans' rows, or a layer's, for
    few, and collect them on the driver to broadcast them."""
    return df.hint("merge") if large else df


def placed(assignments: DataFrame, precincts: DataFrame) -> DataFrame:
    """Precinct columns with plan and district. Plans are many and precincts few, so the join keeps the plans where they are if precincts are small."""
    return assignments.join(precincts, "precinct_id")


def totals(assignments: DataFrame, precincts: DataFrame, k: int) -> DataFrame:
    """(plan_id, district) with population, dem_votes, rep_votes, precincts, share (0.5 without votes) and ideal."""
    sums = placed(assignments, precincts).groupBy("plan_id", "district").agg(F.sum("population").alias("population"), F.sum("dem_votes").alias("dem_votes"), F.sum("rep_votes").alias("rep_votes"), F.count("*").alias("precincts"))
    d = spine(assignments, k).join(sums, ["plan_id", "district"], "left").na.fill(0, ["population", "dem_votes", "rep_votes", "precincts"])
    votes = F.col("dem_votes") + F.col("rep_votes")
    ideal = precincts.agg((F.sum("population") / k).alias("ideal"))
    return d.withColumn("votes", votes).withColumn("share", F.when(votes > 0, F.col("dem_votes") / votes).otherwise(F.lit(0.5))).join(F.broadcast(ideal))


def vote_arrays() -> Column:
    """An aggregate over a plan's districts: (district, share, votes) in order."""
    return F.sort_array(F.collect_list(F.struct("district", "share", "votes")))


def arrays(d: DataFrame) -> DataFrame:
    """A row for each plan: shares and votes by district, so that metrics over districts are expressions of one row."""
    g = d.groupBy("plan_id").agg(vote_arrays().alias("a"))
    return g.select("plan_id", F.transform("a", lambda x: x["share"]).alias("s"), F.transform("a", lambda x: x["votes"].cast("double")).alias("t"))


def cut_edges(assignments: DataFrame, edges: DataFrame) -> DataFrame:
    """(plan_id, edge columns, du, dv) of edges whose ends lie in different districts, virtual ones included."""
    u = assignments.select("plan_id", F.col("precinct_id").alias("u"), F.col("district").alias("du"))
    v = assignments.select("plan_id", F.col("precinct_id").alias("v"), F.col("district").alias("dv"))
    return edges.join(u, "u").join(v, ["plan_id", "v"]).where("du <> dv")


def incidence(assignments: DataFrame, edges: DataFrame) -> DataFrame:
    """(plan_id, district, cut_edges): each cut edge counts for both districts; virtual ones count too."""
    return cut_edges(assignments, edges).select("plan_id", F.explode(F.array("du", "dv")).alias("district")).groupBy("plan_id", "district").agg(F.count("*").alias("cut_edges"))


def counties_touched(assignments: DataFrame, precincts: DataFrame) -> DataFrame:
    """(plan_id, district, counties) by presence of a precinct, whatever its population."""
    return placed(assignments, precincts.select("precinct_id", "county_id")).groupBy("plan_id", "district").agg(F.count_distinct("county_id").alias("counties"))


def clean_counties(assignments: DataFrame, precincts: DataFrame) -> DataFrame:
    """(plan_id, county_id, districts, is_clean): a clean county lies in one district."""
    g = placed(assignments, precincts.select("precinct_id", "county_id")).groupBy("plan_id", "county_id").agg(F.count_distinct("district").alias("districts"))
    return g.withColumn("is_clean", F.col("districts") <= 1)
