"""County splits and congruence of counties and districts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardflow.operators.districts import placed

# The scale of split scores, and the bounds of the congruence penalty.
SPLIT_SCALE, SLOPE, LEAST, MOST, WORST, CLIPPED_SCALE = 10.0, 45.0, 1.00, 1.20, 1.33, 0.2


def matrix(assignments: DataFrame, precincts: DataFrame) -> DataFrame:
    """(plan_id, county_id, district, population), for pairs that share population."""
    return placed(assignments, precincts.select("precinct_id", "county_id", "population")).groupBy("plan_id", "county_id", "district").agg(F.sum("population").alias("population")).where("population > 0")


def constants(precincts: DataFrame, k: int, tolerance: float) -> DataFrame:
    """(county_id, population, allowance, max_clean): districts it may reach without penalty, and districts that fit inside."""
    ideal = F.broadcast(precincts.agg((F.sum("population") / k).alias("ideal")))
    c = precincts.groupBy("county_id").agg(F.sum("population").alias("population")).join(ideal)
    least = F.greatest(F.col("ideal") * (1.0 - tolerance), F.lit(1.0))
    return c.select("county_id", "population", F.ceil(F.col("population") / F.col("ideal")).alias("allowance"), F.floor(F.col("population") / least).alias("max_clean"))


def splits(m: DataFrame, counties: DataFrame) -> DataFrame:
    """plan_id, excess splits and unified districts with their scores. No floor holds the unified term above 0."""
    by_county = m.groupBy("plan_id", "county_id").agg(F.count("*").alias("parts")).join(counties, "county_id")
    excess = by_county.groupBy("plan_id").agg(F.sum(F.greatest(F.lit(0), F.col("parts") - F.col("allowance"))).alias("excess_splits"))
    unified = m.groupBy("plan_id", "district").agg(F.count("*").alias("n")).groupBy("plan_id").agg(F.count_if(F.col("n") == 1).alias("unified_districts"))
    most = F.broadcast(counties.agg(F.sum("max_clean").alias("max_unified")))
    out = excess.join(unified, "plan_id").join(most)
    return out.select("plan_id", "excess_splits", (F.col("excess_splits") * SPLIT_SCALE).alias("county_excess"), "unified_districts", "max_unified", ((F.col("max_unified") - F.col("unified_districts")) * SPLIT_SCALE).alias("county_unified"))


def _direction(m: DataFrame, by: str, size: Column, other: Column, name: str) -> DataFrame:
    """For each plan the population-weighted sum over `by` of its parts' square roots; parts that are the whole other unit are folded into one."""
    whole = F.col("population") == other
    one = m.groupBy("plan_id", by, size.alias("size"), "state").agg(F.sum(F.when(~whole, F.sqrt(F.col("population") / size)).otherwise(0.0)).alias("split"), F.sum(F.when(whole, F.col("population")).otherwise(0)).alias("whole"))
    return one.groupBy("plan_id").agg(F.sum(F.col("size") / F.col("state") * (F.col("split") + F.sqrt(F.col("whole") / F.col("size")))).alias(name))


def congruence(m: DataFrame, precincts: DataFrame, k: int, unclipped: bool = True) -> DataFrame:
    """plan_id, raw_county, raw_district and the congruence penalty."""
    county = precincts.groupBy("county_id").agg(F.sum("population").alias("county_pop")).where("county_pop > 0")
    state = F.broadcast(precincts.agg(F.sum("population").alias("state"), F.count_distinct("county_id").alias("counties")))
    district = m.groupBy("plan_id", "district").agg(F.sum("population").alias("district_pop"))
    m = m.join(county, "county_id").join(district, ["plan_id", "district"]).join(state)
    a = _direction(m, "county_id", F.col("county_pop"), F.col("district_pop"), "raw_county")
    b = _direction(m, "district", F.col("district_pop"), F.col("county_pop"), "raw_district")
    out = a.join(b, "plan_id").join(state)
    return out.select("plan_id", "raw_county", "raw_district", congruence_penalty(F.col("raw_county"), F.col("raw_district"), F.col("counties"), k, unclipped).alias("congruence"))


def congruence_penalty(c: Column, d: Column, n: Column, k: int, unclipped: bool = True) -> Column:
    """From both directions' sums and the number of counties."""
    if unclipped:
        return 0.5 * SLOPE * F.greatest(F.lit(0.0), c - 1.0) + 0.5 * SLOPE * F.greatest(F.lit(0.0), d - 1.0)
    w = (F.least(n, F.lit(k)) - 1) / F.greatest(n, F.lit(k))
    best = w * MOST + (1.0 - w) * LEAST
    rise = lambda raw, at: F.when(at * WORST <= at, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (raw - at) / (at * WORST - at))) * 100.0)
    ref_c, ref_d = F.when(n > k, best).otherwise(MOST), F.when(n > k, F.lit(MOST)).otherwise(best)
    return CLIPPED_SCALE * (0.5 * rise(c, ref_c) + 0.5 * rise(d, ref_d))


def plan_terms(m: DataFrame, precincts: DataFrame, k: int, tolerance: float) -> DataFrame:
    """(plan_id, excess_splits, unified_districts, max_unified, raw_county, raw_district, counties) in one pass over a matrix that is dealt by plan_id: what a cell needs
    of its county and of its district are windows within the plan, and what counts once for a county or a district is taken from its first cell."""
    counties = constants(precincts, k, tolerance)
    most = F.broadcast(counties.agg(F.sum("max_clean").alias("max_unified")))
    state = F.broadcast(precincts.agg(F.sum("population").alias("state"), F.count_distinct("county_id").alias("counties")))
    m = m.join(counties.select("county_id", F.col("population").alias("county_pop"), "allowance"), "county_id", "left")
    of_county, of_district = W.partitionBy("plan_id", "county_id"), W.partitionBy("plan_id", "district")
    m = m.withColumns({"district_pop": F.sum("population").over(of_district), "in_district": F.count("*").over(of_district), "parts": F.count("*").over(of_county), "c1": F.row_number().over(of_county.orderBy("district")), "d1": F.row_number().over(of_district.orderBy("county_id"))})
    whole_district, whole_county = F.col("population") == F.col("district_pop"), F.col("population") == F.col("county_pop")
    kept = lambda whole: F.when(whole, F.col("population")).otherwise(0)
    m = m.withColumns({"folded_c": F.sum(kept(whole_district)).over(of_county), "folded_d": F.sum(kept(whole_county & F.col("county_id").isNotNull())).over(of_district)}).join(state)

    def raw(size: Column, whole: Column, folded: str, first: str) -> Column:
        own = F.when(F.coalesce(whole, F.lit(False)), 0.0).otherwise(F.sqrt(F.col("population") / size))
        once = F.when(F.col(first) == 1, F.sqrt(F.col(folded) / size)).otherwise(0.0)
        return F.sum(F.when(F.col("county_id").isNotNull(), size / F.col("state") * (own + once)))

    excess = F.sum(F.when((F.col("c1") == 1) & F.col("county_id").isNotNull(), F.greatest(F.lit(0), F.col("parts") - F.col("allowance"))))
    g = m.groupBy("plan_id").agg(excess.alias("excess_splits"), F.count_if(F.col("in_district") == 1).alias("unified_districts"), raw(F.col("county_pop"), whole_district, "folded_c", "c1").alias("raw_county"), raw(F.col("district_pop"), whole_county, "folded_d", "d1").alias("raw_district"), F.first("counties").alias("counties"))
    return g.join(most)
