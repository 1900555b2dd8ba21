"""Population metrics of plans, from district totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deviations(k: int, harbor: float = 0.0) -> list[Column]:
    """Aggregates over a plan's districts: the penalty (sum of squared excess over the harbour, times 100,000 / k), pop_dev_max and pop_dev_mean in percent."""
    dev = F.abs(F.col("population") - F.col("ideal")) / F.col("ideal")
    over = F.greatest(F.lit(0.0), dev - harbor)
    return [(F.sum(over * over) * 100_000.0 / k).alias("pop_deviation"), (F.max(dev) * 100).alias("pop_dev_max"), (F.avg(dev) * 100).alias("pop_dev_mean")]


def deviation(d: DataFrame, k: int, harbor: float = 0.0) -> DataFrame:
    """plan_id, the aggregates of deviations(), and max_deviation as a fraction."""
    dev = F.abs(F.col("population") - F.col("ideal")) / F.col("ideal")
    return d.groupBy("plan_id").agg(*deviations(k, harbor), F.max(dev).alias("max_deviation"))


def stats(d: DataFrame, cuts: DataFrame) -> DataFrame:
    """plan_id, smallest and largest population, largest deviation (a fraction) and number of cut edges. cuts: (plan_id, cut_edges)."""
    dev = F.abs(F.col("population") - F.col("ideal")) / F.col("ideal")
    g = d.groupBy("plan_id").agg(F.min("population").alias("least"), F.max("population").alias("most"), F.max(dev).alias("max_deviation"))
    return g.join(cuts, "plan_id", "left").na.fill(0, ["cut_edges"])


def cut_count(cut: DataFrame, virtual: bool = False) -> DataFrame:
    """(plan_id, cut_edges); the score leaves virtual edges out, exports count them. Plans without a cut edge have no row."""
    return (cut if virtual else cut.where(~F.col("is_virtual"))).groupBy("plan_id").agg(F.count("*").alias("cut_edges"))
