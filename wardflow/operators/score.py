"""The weighted score of plans: only what a weight asks for is built."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.operators import alignment, compactness, county, districts, partisan, population
from wardflow.operators.graph import stored
from wardflow.plans.config import ScoreConfig


class Layer:
    """The tables that plans are scored on: precincts with population, county_id, votes; geometry (precinct_id, area, ext_perimeter); edges; extrema; a reference plan."""

    def __init__(self, precincts: DataFrame, edges: DataFrame, geometry: DataFrame | None = None, extrema: DataFrame | None = None, reference: DataFrame | None = None):
        self.precincts, self.edges, self.geometry, self.extrema, self.reference = precincts, edges, geometry, extrema, reference


def summaries(assignments: DataFrame, layer: Layer, cfg: ScoreConfig, also: tuple[str, ...] = ()) -> DataFrame:
    """All that a score takes from plans' rows, in one job, with one shuffle of the assignments (by plan_id, which every aggregate and join that follows keeps to).

    The rows are of three kinds: the sums of a plan's precincts by district, county and reference district; those of its cut edges by district; the districts' extreme points.
    They are some hundred a plan, written to the shared folder, so that what follows reads rows of plans no more. also: further columns of precincts to be summed."""
    a = assignments.select("plan_id", "precinct_id", "district").repartition("plan_id")
    p = layer.precincts.select("precinct_id", "population", "dem_votes", "rep_votes", "county_id", F.lit(1).alias("precincts"), *also)
    shapes = bool(cfg.weight_polsby_popper or cfg.weight_reock or cfg.weight_compactness)
    circles = bool(cfg.weight_reock or cfg.weight_compactness)
    if shapes:
        p = p.join(layer.geometry.select("precinct_id", "area", F.col("ext_perimeter").alias("ext")), "precinct_id", "left")
    if cfg.weight_alignment and layer.reference is not None:
        p = p.join(layer.reference.select("precinct_id", "ref_district"), "precinct_id", "left")
    keys = ["plan_id", "district", "county_id", *(["ref_district"] if "ref_district" in p.columns else [])]
    parts = [a.join(p, "precinct_id", "left").groupBy(*keys).agg(*[F.sum(c).alias(c) for c in p.columns if c not in ("precinct_id", *keys)])]
    ends = F.explode(F.array("du", "dv")).alias("district")
    parts.append(districts.cut_edges(a, layer.edges).select("plan_id", ends, "shared_len", "is_virtual").groupBy("plan_id", "district").agg(F.count_if(~F.col("is_virtual")).alias("real"), F.sum("shared_len").alias("cut")))
    if circles:
        extrema = stored(layer.extrema, "extrema")
        far = compactness.farthest(a, compactness.reaches(extrema))
        parts.append(far.join(extrema.select("precinct_id", "dir", F.struct("px", "py").alias("p")), ["precinct_id", "dir"]).select("plan_id", "district", "p"))
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [df.withColumn("kind", F.lit(k)) for k, df in enumerate(parts)])
    return stored(rows, "summaries", by="kind")


def by_district(rows: DataFrame, layer: Layer, k: int, also: tuple[str, ...] = ()) -> DataFrame:
    """A row for each plan and district 0 to k-1, with all sums and points of the summaries, share, votes and ideal."""
    sums = [c for c in ("population", "dem_votes", "rep_votes", "precincts", "area", "ext", "real", "cut", *also) if c in rows.columns]
    points = [F.collect_list("p").alias("ps")] if "p" in rows.columns else []
    g = rows.repartition("plan_id").groupBy("plan_id", "district").agg(*[F.sum(c).alias(c) for c in sums], *points)
    # Districts without precincts are put in within the plan's own row.
    held = g.groupBy("plan_id").agg(F.collect_list(F.struct("district", *sums, *(["ps"] if points else []))).alias("have"))
    d = held.select("plan_id", "have", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("district"))
    d = d.select("plan_id", "district", F.get(F.filter("have", lambda x: x["district"] == F.col("district")), F.lit(0)).alias("x"))
    d = d.select("plan_id", "district", *[F.coalesce(F.col(f"x.{c}"), F.lit(0)).alias(c) for c in sums], *([F.col("x.ps").alias("ps")] if points else []))
    total = F.col("dem_votes") + F.col("rep_votes")
    ideal = F.broadcast(layer.precincts.agg((F.sum("population") / k).alias("ideal")))
    return d.withColumn("votes", total).withColumn("share", F.when(total > 0, F.col("dem_votes") / total).otherwise(F.lit(0.5))).join(ideal)


def scores(assignments: DataFrame, layer: Layer, cfg: ScoreConfig) -> DataFrame:
    """A row for each plan: the metrics in use, and total. After the summaries every aggregate and join is within a plan."""
    k = cfg.n_districts
    rows = summaries(assignments, layer, cfg)
    d = by_district(rows, layer, k)
    terms: list[Column] = []

    def use(weight: float, value: Column) -> None:
        if weight:
            terms.append(F.lit(float(weight)) * value)

    # A cut edge counts once in each of its two districts.
    asked = [(F.sum("real") / 2).cast("long").alias("cut_edges")]
    use(cfg.weight_cut_edges, F.col("cut_edges"))
    if cfg.weight_polsby_popper or cfg.weight_compactness:
        asked.append(((1.0 - F.avg(compactness.polsby_popper_value(F.col("area"), F.col("ext") + F.col("cut")))) * 100.0).alias("polsby_popper"))
        use(cfg.weight_polsby_popper, F.col("polsby_popper"))
    if cfg.weight_reock or cfg.weight_compactness:
        asked.append(((1.0 - F.avg(compactness.reock_value(F.col("area"), F.col("ps")))) * 100.0).alias("reock"))
        use(cfg.weight_reock, F.col("reock"))
    if cfg.weight_pop_deviation:
        asked += population.deviations(k, cfg.pop_harbor)
        use(cfg.weight_pop_deviation, F.col("pop_deviation"))
    if cfg.needs_votes():
        asked.append(districts.vote_arrays().alias("a"))
    out = d.groupBy("plan_id").agg(*asked)
    if cfg.weight_county_excess or cfg.weight_county_unified or cfg.weight_congruence:
        m = rows.where("kind = 0").repartition("plan_id").groupBy("plan_id", "county_id", "district").agg(F.sum("population").alias("population")).where("population > 0")
        c = county.plan_terms(m, layer.precincts, k, cfg.tolerance)
        own = []
        if cfg.weight_county_excess or cfg.weight_county_unified:
            own += ["excess_splits", (F.col("excess_splits") * county.SPLIT_SCALE).alias("county_excess"), "unified_districts", ((F.col("max_unified") - F.col("unified_districts")) * county.SPLIT_SCALE).alias("county_unified")]
            use(cfg.weight_county_excess, F.col("county_excess"))
            use(cfg.weight_county_unified, F.col("county_unified"))
        if cfg.weight_congruence:
            own.append(county.congruence_penalty(F.col("raw_county"), F.col("raw_district"), F.col("counties"), k, cfg.congruence_unclipped).alias("congruence"))
            use(cfg.weight_congruence, F.col("congruence"))
        out = out.join(c.select("plan_id", *own), "plan_id", "left")
    if cfg.weight_alignment and layer.reference is not None:
        weight = {"none": "population", "dem": "dem_votes", "rep": "rep_votes"}[cfg.alignment_focus]
        overlap = rows.where("kind = 0 and ref_district is not null").repartition("plan_id").groupBy("plan_id", "ref_district", "district").agg(F.sum(weight).alias("part"))
        c = alignment.cohesion(assignments, layer.precincts, layer.reference, cfg.alignment_focus, cfg.alignment_wins_only, cfg.alignment_win_share, overlap)
        out = out.join(alignment.of_plans(c), "plan_id", "left").na.fill(alignment.NOTHING)
        use(cfg.weight_alignment, F.col("alignment"))
    if cfg.needs_votes():
        out = with_votes(out, cfg)
        n, quad = k, cfg.quadratic
        use(cfg.weight_mean_median, partisan.directional(F.col("mean_median"), cfg.mm_mode, cfg.mm_bound, quad))
        use(cfg.weight_efficiency_gap, partisan.directional(F.col("efficiency_gap"), cfg.eg_mode, cfg.eg_bound, quad))
        use(cfg.weight_bias, partisan.directional(F.col("partisan_bias"), cfg.bias_mode, cfg.bias_bound, quad))
        use(cfg.weight_gini, F.col("partisan_gini"))
        use(cfg.weight_seats, partisan.seats_penalty(F.col("dem_seats"), n, cfg.seats_favor_dem))
        use(cfg.weight_proportionality, F.col("proportionality"))
        use(cfg.weight_competitiveness, F.col("competitiveness"))
        use(cfg.weight_majority_dem, partisan.majority_penalty(F.col("majority_dem")))
        use(cfg.weight_majority_rep, partisan.majority_penalty(F.col("majority_rep")))
        use(cfg.weight_hinge, partisan.majority_penalty(F.col("hinge_chance")))
    if cfg.weight_compactness:
        out = out.withColumn("compactness", compactness.blend(F.col("polsby_popper"), F.col("reock"), cfg.compactness_unclipped))
        use(cfg.weight_compactness, F.col("compactness"))
    return out.withColumn("total", reduce(lambda a, b: a + b, terms, F.lit(0.0)))


def with_votes(plans: DataFrame, cfg: ScoreConfig) -> DataFrame:
    """plans with the partisan metrics in place of a, their arrays of districts; without votes bias and gini are 0."""
    n, sigma = cfg.n_districts, cfg.sigma
    a = partisan.with_counts(plans.withColumns({"s": F.transform("a", lambda x: x["share"]), "t": F.transform("a", lambda x: x["votes"].cast("double"))}), cfg)
    kept = [c for c in plans.columns if c != "a"]
    dem, rep = partisan.majority(n)
    prop = partisan.proportionality(n, cfg) if cfg.proportionality_unclipped else partisan.proportionality_clipped(n, sigma)
    out = a.select(
        *kept,
        partisan.mean_median().alias("mean_median"),
        (partisan.efficiency_gap_robust(cfg.sigma_eg) if cfg.eg_robust else partisan.efficiency_gap()).alias("efficiency_gap"),
        partisan.expected_seats(sigma).alias("dem_seats"),
        F.coalesce(partisan.bias(sigma), F.lit(0.0)).alias("partisan_bias"),
        F.coalesce(partisan.gini(sigma), F.lit(0.0)).alias("partisan_gini"),
        prop.alias("p"),
        partisan.competitiveness_penalty(partisan.competitiveness(sigma), cfg.competitiveness_unclipped).alias("competitiveness"),
        dem.alias("majority_dem"),
        rep.alias("majority_rep"),
        partisan.hinge(n, cfg.hinge_seats, cfg.hinge_dem).alias("hinge_chance"),
    )
    return out.select("*", F.col("p.penalty").alias("proportionality"), F.col("p.inversion").alias("inversion_chance")).drop("p")


def active_metrics(cfg: ScoreConfig, votes: bool, ratchet: bool = False, hinge: bool = False) -> list[str]:
    """The metrics of a run whose history holds real values. Those of votes are there wherever votes are, but for the hinge chance, which somebody has to ask for; the others need a weight, their own or of what they are part of."""
    needs = {
        "compactness": cfg.weight_compactness,
        "polsby_popper": cfg.weight_polsby_popper or cfg.weight_compactness,
        "reock": cfg.weight_reock or cfg.weight_compactness,
        "congruence": cfg.weight_congruence,
        "excess_splits": cfg.weight_county_excess or cfg.weight_county_unified,
        "pop_dev_max": cfg.weight_pop_deviation or ratchet,
        "pop_dev_mean": cfg.weight_pop_deviation or ratchet,
        **dict.fromkeys(("mean_median", "efficiency_gap", "dem_seats", "partisan_bias", "partisan_gini", "proportionality", "inversion_chance", "competitiveness", "majority_dem", "majority_rep"), votes),
        "hinge_chance": votes and hinge,
    }
    return ["total", "temperature", "cut_edges", *(k for k, on in needs.items() if on)]


#: Part of a breakdown: the weight's name, and the penalty in terms of score columns.
def _contributions(cfg: ScoreConfig) -> dict[str, tuple[float, Column]]:
    c, quad, n = F.col, cfg.quadratic, cfg.n_districts
    return {
        "Cut Edges": (cfg.weight_cut_edges, c("cut_edges")),
        "Excess Splits": (cfg.weight_county_excess, c("county_excess")),
        "Single-County Districts": (cfg.weight_county_unified, c("county_unified")),
        "County Congruence": (cfg.weight_congruence, c("congruence")),
        "Polsby-Popper": (cfg.weight_polsby_popper, c("polsby_popper")),
        "Reock": (cfg.weight_reock, c("reock")),
        "Compactness": (cfg.weight_compactness, c("compactness")),
        "Population Deviation": (cfg.weight_pop_deviation, c("pop_deviation")),
        "Alignment": (cfg.weight_alignment, c("alignment")),
        "Mean-Median": (cfg.weight_mean_median, partisan.directional(c("mean_median"), cfg.mm_mode, cfg.mm_bound, quad)),
        "Efficiency Gap": (cfg.weight_efficiency_gap, partisan.directional(c("efficiency_gap"), cfg.eg_mode, cfg.eg_bound, quad)),
        "Dem Seats": (cfg.weight_seats, partisan.seats_penalty(c("dem_seats"), n, cfg.seats_favor_dem)),
        "Partisan Bias": (cfg.weight_bias, partisan.directional(c("partisan_bias"), cfg.bias_mode, cfg.bias_bound, quad)),
        "Partisan Gini": (cfg.weight_gini, c("partisan_gini")),
        "Proportionality": (cfg.weight_proportionality, c("proportionality")),
        "Competitiveness": (cfg.weight_competitiveness, c("competitiveness")),
        "D Majority": (cfg.weight_majority_dem, partisan.majority_penalty(c("majority_dem"))),
        "R Majority": (cfg.weight_majority_rep, partisan.majority_penalty(c("majority_rep"))),
        "Hinge": (cfg.weight_hinge, partisan.majority_penalty(c("hinge_chance"))),
    }


def breakdown(scored: DataFrame, cfg: ScoreConfig) -> DataFrame:
    """(plan_id, metric, percent) of the total, for metrics that add to it."""
    parts = [F.struct(F.lit(name).alias("metric"), (F.lit(float(w)) * v / F.col("total") * 100.0).alias("percent")) for name, (w, v) in _contributions(cfg).items() if w]
    x = scored.where("total > 0").select("plan_id", F.explode(F.array(*parts)).alias("x"))
    return x.select("plan_id", "x.metric", "x.percent").where("percent > 0")
