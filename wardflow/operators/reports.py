"""Per-district reports: the metrics file, the live table, ranks, buckets and map shades."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardflow.functions.numeric import normal_cdf
from wardflow.operators import compactness, score
from wardflow.operators.score import Layer
from wardflow.plans.config import ScoreConfig

#: Lower ends of the 12 share buckets of the partisan scale.
BREAKS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.45, 0.5, 0.55, 0.6, 0.7, 0.8, 0.9)


#: Where the colours of the two continuous scales lie between 0 and 1, and the colours.
STOPS = (0.0, 0.25, 0.5, 0.75, 1.0)
COMPACT = ((190, 50, 50), (210, 130, 50), (210, 200, 70), (100, 185, 85), (40, 155, 90))
DEVIATION = ((65, 105, 225), (135, 165, 225), (185, 185, 185), (225, 155, 100), (200, 60, 60))


def interpolated(t: Column, stops: tuple, values: tuple) -> Column:
    """The piecewise linear function through (stop, value); beyond the ends their values."""
    out = F.when(t <= stops[0], float(values[0]))
    for a, b, v, w in zip(stops, stops[1:], values, values[1:]):
        out = out.when(t <= b, v + (t - a) * ((w - v) / (b - a)))
    return out.when(t.isNotNull(), float(values[-1]))


def colour(t: Column, stops: tuple, colours: tuple) -> Column:
    """Red, green and blue from 0 to 255, fractions dropped."""
    return F.array(*[F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), interpolated(t, stops, [c[k] for c in colours])))).cast("int") for k in range(3)])


def bucket(share: Column) -> Column:
    """0 to 11: the last break at or below a share."""
    return F.size(F.filter(F.array(*[F.lit(b) for b in BREAKS]), lambda b: b <= F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))) - 1


def _measured(assignments: DataFrame, layer: Layer, cfg: ScoreConfig, circles: bool = True, counties: bool = False, also: tuple[str, ...] = ()) -> DataFrame:
    """Each plan's districts with their sums, polsby_popper and, if asked for, reock and the counties that they touch: all from one shuffle of the assignments, as a score is."""
    own = replace(cfg, weight_polsby_popper=1.0, weight_reock=float(circles), weight_compactness=0.0, weight_alignment=0.0)
    rows = score.summaries(assignments, layer, own, also)
    d = score.by_district(rows, layer, cfg.n_districts, also).withColumn("polsby_popper", compactness.polsby_popper_value(F.col("area"), F.col("ext") + F.col("cut")))
    if circles:
        d = d.withColumn("reock", compactness.reock_value(F.col("area"), F.col("ps")))
    if counties:
        d = d.join(rows.where("kind = 0").repartition("plan_id").groupBy("plan_id", "district").agg(F.count_distinct("county_id").alias("counties")), ["plan_id", "district"], "left")
    return d


def metrics(assignments: DataFrame, layer: Layer, cfg: ScoreConfig) -> DataFrame:
    """The columns of the metrics file, for each plan and 1-indexed district."""
    x = _measured(assignments, layer, cfg, counties=True).withColumnsRenamed({"polsby_popper": "pp", "reock": "rk", "real": "cut_edges"})
    dev = (F.col("population") - F.col("ideal")) / F.col("ideal") * 100.0
    dem, rep = F.col("share") * 100.0, F.when(F.col("votes") > 0, F.col("rep_votes") / F.col("votes")).otherwise(F.lit(0.5)) * 100.0
    return x.select(
        "plan_id",
        (F.col("district") + 1).alias("district"),
        "population",
        F.bround(dev, 2).alias("pop_dev_pct"),
        F.bround(F.abs(dev), 2).alias("pop_dev_pct_abs"),
        F.coalesce("cut_edges", F.lit(0)).alias("cut_edges"),
        F.coalesce("counties", F.lit(0)).alias("counties_touched"),
        "dem_votes",
        "rep_votes",
        F.bround(dem, 2).alias("dem_pct"),
        F.bround(rep, 2).alias("rep_pct"),
        F.bround(dem - 50.0, 2).alias("dem_margin"),
        F.bround(normal_cdf((F.col("share") - 0.5) / cfg.sigma), 4).alias("win_prob"),
        F.bround("pp", 4).alias("polsby_popper"),
        F.bround("rk", 4).alias("reock"),
        F.bround(compactness.rating(F.col("pp"), F.col("rk")) / 100.0, 4).alias("compactness"),
    )


def live_table(assignments: DataFrame, layer: Layer, cfg: ScoreConfig, labels: DataFrame | None = None) -> DataFrame:
    """plan_id, label, population, deviation, Polsby-Popper and shares in percent, margin D - R; the shares are null without votes. labels: (plan_id, district, label)."""
    key = ["plan_id", "district"]
    d = _measured(assignments, layer, cfg, circles=False)
    d = d.join(labels, key) if labels is not None else d.withColumn("label", F.col("district") + 1)
    some = F.col("votes") > 0
    pct = lambda c: F.when(some, F.col(c) / F.col("votes") * 100.0)
    return d.select("plan_id", "label", "population", ((F.col("population") - F.col("ideal")) / F.col("ideal") * 100.0).alias("dev_pct"), (F.col("polsby_popper") * 100.0).alias("pp"), pct("dem_votes").alias("dem_pct"), pct("rep_votes").alias("rep_pct"), (pct("dem_votes") - pct("rep_votes")).alias("margin"))


def ranked(d: DataFrame, sigma: float) -> DataFrame:
    """Districts of a plan by share: rank from 1, bucket, win chance and whether it is a median district."""
    n = F.count("*").over(W.partitionBy("plan_id"))
    r = F.row_number().over(W.partitionBy("plan_id").orderBy("share", "district"))
    x = d.select("plan_id", "district", "share", r.alias("rank"), bucket(F.col("share")).alias("bucket"), normal_cdf((F.col("share") - 0.5) / sigma).alias("win_prob"), n.alias("n"))
    return x.withColumn("is_median", (F.col("rank") == F.floor((F.col("n") + 1) / 2)) | (F.col("rank") == F.floor(F.col("n") / 2) + 1)).drop("n")


def precinct_buckets(precincts: DataFrame) -> DataFrame:
    votes = F.col("dem_votes") + F.col("rep_votes")
    share = F.when(votes > 0, F.col("dem_votes") / votes).otherwise(F.lit(0.5))
    return precincts.select("precinct_id", share.alias("share"), bucket(share).alias("bucket"))


def shades(assignments: DataFrame, layer: Layer, k: int) -> DataFrame:
    """(plan_id, district, compactness shade, population shade from -1 to 1 at 10 % of the mean district), bucket, label point."""
    # Without extreme points there is no Reock, and the shade is Polsby-Popper alone.
    circles = layer.extrema is not None
    d = _measured(assignments, layer, ScoreConfig(n_districts=k), circles, also=("x", "y"))
    mean = F.avg("population").over(W.partitionBy("plan_id"))
    at = lambda c: F.when(F.col("precincts") > 0, F.col(c) / F.col("precincts") + 0.5)
    x = d.withColumns({"dev": (F.col("population") - mean) / mean, "label_x": at("x"), "label_y": at("y"), "reock": F.col("reock" if circles else "polsby_popper")})
    # The colours are those of the shades, which run from 0 to 1 and from -1 to 1.
    return x.select("plan_id", "district", (0.5 * F.col("polsby_popper") + 0.5 * F.col("reock")).alias("compact_shade"), (F.least(F.lit(0.1), F.greatest(F.lit(-0.1), F.col("dev"))) / 0.1).alias("pop_shade"), bucket(F.col("share")).alias("bucket"), "label_x", "label_y")
