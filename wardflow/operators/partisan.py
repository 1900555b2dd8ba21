"""Partisan metrics: expressions over a plan's arrays of district shares s and votes t (see districts.arrays), so that a million plans are a
million rows and no shuffle follows the district totals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions.numeric import hermite_nodes, let, mean, median, normal_cdf, tail, total, win_counts
from wardflow.plans.config import ScoreConfig

# The seats-votes grid and its bound; the competitiveness and proportionality forms' constants.
GINI_GRID, GINI_BOUND = [0.35 + 0.02 * i for i in range(16)], 0.12
CMP_BEST, CMP_DIVERGE = 0.75, 25.0
CMP_KNEE = CMP_BEST * (1.0 - CMP_DIVERGE / 100.0)
CMP_POWER = (100.0 / CMP_BEST) * (1.0 - CMP_KNEE) / CMP_DIVERGE
SLACK, BONUS, CAP, LIGHT, FULL, BLUR = 0.02, 2.0, 0.20, 0.25, 0.42, 0.005
S, T = "s", "t"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def directional(raw: Column, mode: str, bound: float, quadratic: bool = False) -> Column:
    """The 0 to 100 penalty of a signed measure: fair, or in favour of a side."""
    d = {"fair": F.least(F.lit(1.0), F.abs(raw) / bound), "favor_dem": clamp((raw + bound) / (2.0 * bound)), "favor_rep": clamp((bound - raw) / (2.0 * bound))}[mode]
    return (d * d if quadratic else d) * 100.0


def win_chances(sigma: float, s: Column | str = S) -> Column:
    return F.transform(_c(s), lambda x: normal_cdf((x - 0.5) / sigma)) if sigma > 0 else F.transform(_c(s), lambda x: F.when(x > 0.5, 1.0).otherwise(0.0))


def statewide(s: Column | str = S, t: Column | str = T) -> Column:
    """Votes' share; null without votes."""
    s, t = _c(s), _c(t)
    return F.when(total(t) > 0, total(F.zip_with(s, t, lambda a, b: a * b)) / total(t))


def mean_median(s: Column | str = S) -> Column:
    return mean(_c(s)) - median(_c(s))


def efficiency_gap(s: Column | str = S, t: Column | str = T) -> Column:
    """Wasted votes' difference; 0.5 is a loss for D."""
    s, t = _c(s), _c(t)
    waste = F.zip_with(s, t, lambda a, b: F.when(a > 0.5, (a - 0.5) * b - (1.0 - a) * b).otherwise(a * b - (0.5 - a) * b))
    return F.when(total(t) > 0, total(waste) / total(t)).otherwise(F.lit(0.0))


def efficiency_gap_robust(sigma: float, s: Column | str = S, t: Column | str = T) -> Column:
    """Its expectation under the win chances."""
    s, t = _c(s), _c(t)
    waste = F.zip_with(s, t, lambda a, b: b * ((2.0 * a - 0.5) - normal_cdf((a - 0.5) / sigma)))
    return F.when(total(t) > 0, total(waste) / total(t)).otherwise(F.lit(0.0))


def expected_seats(sigma: float, s: Column | str = S) -> Column:
    return total(win_chances(sigma, s))


def seats_penalty(seats: Column, n: int, favor_dem: bool) -> Column:
    return clamp((n - seats) / n * 100.0 if favor_dem else seats / n * 100.0, 0.0, 100.0)


def seat_curve(delta: Column | float, sigma: float, s: Column | str = S) -> Column:
    """The expected seat share when every share moves by delta."""
    return mean(F.transform(_c(s), lambda x: normal_cdf((x + delta - 0.5) / sigma)))


def bias(sigma: float) -> Column:
    """What D's seat share lacks to a half at a tied vote; null without votes."""
    return 0.5 - seat_curve(0.5 - statewide(), sigma)


def gini(sigma: float) -> Column:
    """The area between a party's seat curve and the other's, as a penalty."""
    gap = lambda v, own: F.abs(seat_curve(v - own, sigma) - (1.0 - seat_curve(1.0 - v - own, sigma)))
    grid = F.array(*[F.lit(v) for v in GINI_GRID])
    gaps = let(statewide(), lambda own: F.when(own.isNotNull(), F.transform(grid, lambda v: gap(v, own))))
    area = let(gaps, lambda g: total(F.transform(F.sequence(F.lit(0), F.lit(len(GINI_GRID) - 2)), lambda i: (F.get(g, i) + F.get(g, i + 1)) * (F.get(grid, i + 1) - F.get(grid, i)) / 2.0)))
    return F.least(F.lit(1.0), area / GINI_BOUND) * 100.0


def node_counts(cfg: ScoreConfig, s: Column | str = S) -> Column:
    """For each of the 17 statewide swings (node, weight, counts): the chances of 0 to n D seats."""
    nodes = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(w).alias("w")) for x, w in hermite_nodes()])
    s = _c(s)
    d, move = cfg.sigma_district, cfg.swing / cfg.sigma_district

    def at(node: Column) -> Column:
        ps = F.transform(s, lambda v: normal_cdf((v - 0.5) / d + node["x"] * move))
        return F.struct(node["x"].alias("x"), node["w"].alias("w"), win_counts(ps).alias("counts"))

    return F.transform(nodes, at)


def chance(counts: Column, least: int) -> Column:
    """The chance of `least` D seats or more, over all swings."""
    return total(F.transform(counts, lambda x: x["w"] * tail(x["counts"], least))) / math.sqrt(2 * math.pi)


def with_counts(a: DataFrame, cfg: ScoreConfig) -> DataFrame:
    """The costly part once for all metrics that need it."""
    return a.withColumn("counts", node_counts(cfg))


def majority(n: int, counts: Column | None = None) -> tuple[Column, Column]:
    """Chances of a D and of an R majority; ties of an even chamber belong to neither."""
    counts = F.col("counts") if counts is None else counts
    return chance(counts, n // 2 + 1), 1.0 - chance(counts, n - n // 2)


def majority_penalty(p: Column) -> Column:
    return F.pow(1.0 - p, F.lit(1.5)) * 100.0


def hinge(n: int, seats: int, dem: bool) -> Column:
    """The chance that the party has `seats` seats or more."""
    if dem:
        return chance(F.col("counts"), min(max(seats, 1), n))
    return 1.0 - chance(F.col("counts"), max(1, n - seats + 1))


def competitiveness(sigma: float) -> Column:
    """The index from 0 to 1."""
    return mean(F.transform(win_chances(sigma), lambda p: 1.0 - 4.0 * (p - 0.5) * (p - 0.5)))


def competitiveness_penalty(index: Column, unclipped: bool = True) -> Column:
    c = clamp(index)
    if not unclipped:
        return 100.0 - F.least(F.lit(CMP_BEST), c) / CMP_BEST * 100.0
    return F.when(c <= CMP_KNEE, 100.0 - c / CMP_BEST * 100.0).otherwise(CMP_DIVERGE * F.pow((1.0 - c) / (1.0 - CMP_KNEE), F.lit(CMP_POWER)))


def proportionality_clipped(n: int, sigma: float) -> Column:
    """struct<penalty, inversion, gap>: the expected seat share against the nearest share of seats to the votes; zeros without votes."""
    won = total(F.transform(_c(S), lambda x: F.when(x > 0.5, 1.0).otherwise(0.0))) / n

    def of(x: Column) -> Column:
        v, raw = x["v"], F.rint(n * x["v"] - 1e-9) / n - x["est"]
        inverted = ((v < 0.5 - SLACK) & (won > 0.5)) | ((1.0 - v < 0.5 - SLACK) & (1.0 - won > 0.5))
        extra = F.abs(v - 0.5) * (BONUS - 1.0)
        gap = F.when((v > 0.5) & (raw < 0), F.least(raw + extra, F.lit(0.0))).when((v < 0.5) & (raw > 0), F.greatest(raw - extra, F.lit(0.0))).otherwise(raw)
        fine = F.when(F.abs(gap) >= CAP, 100.0).otherwise(100.0 * F.abs(gap) / CAP)
        return F.when(inverted, F.struct(F.lit(100.0).alias("penalty"), F.lit(1.0).alias("inversion"), raw.alias("gap"))).otherwise(F.struct(fine.alias("penalty"), F.lit(0.0).alias("inversion"), gap.alias("gap")))

    none = F.struct(F.lit(0.0).alias("penalty"), F.lit(0.0).alias("inversion"), F.lit(0.0).alias("gap"))
    return F.when(statewide().isNull(), none).otherwise(let(F.struct(statewide().alias("v"), mean(win_chances(sigma)).alias("est")), of))


def inversion(n: int, cfg: ScoreConfig) -> Column:
    """The chance that the party with fewer votes holds a majority of seats."""
    dem = lambda x: tail(x["counts"], n // 2 + 1)
    rep = lambda x: 1.0 - tail(x["counts"], n - n // 2)

    def over(v: Column) -> Column:
        behind = lambda x: normal_cdf((0.5 - (v + x["x"] * cfg.swing)) / BLUR)
        return total(F.transform("counts", lambda x: x["w"] * let(behind(x), lambda w: w * dem(x) + (1.0 - w) * rep(x)))) / math.sqrt(2 * math.pi)

    return let(statewide(), over)


def proportionality(n: int, cfg: ScoreConfig) -> Column:
    """struct<penalty, inversion, gap>; zeros without votes."""

    def of(x: Column) -> Column:
        seat, extra = x["est"] - x["v"], F.abs(x["v"] - 0.5)
        over = F.when(x["v"] >= 0.5, seat).otherwise(-seat)
        d = F.when(over <= 0, -over).when(over <= extra, LIGHT * over).otherwise(LIGHT * extra + (over - extra))
        m = 100.0 * F.least(d / FULL, F.lit(1.0))
        return F.struct((m * (1.0 - x["p"]) + 100.0 * x["p"]).alias("penalty"), x["p"].alias("inversion"), (-seat).alias("gap"))

    none = F.struct(F.lit(0.0).alias("penalty"), F.lit(0.0).alias("inversion"), F.lit(0.0).alias("gap"))
    return F.when(statewide().isNull(), none).otherwise(let(F.struct(statewide().alias("v"), mean(win_chances(cfg.sigma)).alias("est"), inversion(n, cfg).alias("p")), of))
