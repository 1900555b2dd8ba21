"""A chain's history (chain_id, seq, iteration, total, is_worse, accepted): windows for charts and bookkeeping. A window's partition is one chain,
whose length is its number of iterations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

RECENT, LEAST_SEEN, FADE, BANDS = 200, 10, 2000.0, 24


def _chain() -> WindowSpec:
    return W.partitionBy("chain_id")


def _order() -> WindowSpec:
    return _chain().orderBy("seq")


def acceptance(h: DataFrame) -> DataFrame:
    """(chain_id, seq, rate): the share accepted of the last 200 worse proposals, once there are 10; it holds until the next worse one."""
    w = h.withColumn("nth", F.sum(F.col("is_worse").cast("int")).over(_order()))
    last = W.partitionBy("chain_id", "is_worse").orderBy("seq").rowsBetween(-(RECENT - 1), 0)
    w = w.withColumn("own", F.when(F.col("is_worse") & (F.col("nth") >= LEAST_SEEN), F.avg(F.col("accepted").cast("double")).over(last)))
    return w.select("chain_id", "seq", F.last("own", ignorenulls=True).over(_order()).alias("rate")).where("rate is not null")


def best_so_far(h: DataFrame) -> DataFrame:
    """(chain_id, seq, iteration, best, best_iteration): over accepted proposals; of equal totals the first."""
    here = F.when(F.col("accepted"), F.struct("total", "iteration"))
    run = F.min(here).over(_order())
    return h.select("chain_id", "seq", "iteration", run["total"].alias("best"), run["iteration"].alias("best_iteration"))


def best_state(h: DataFrame) -> DataFrame:
    """(chain_id, best, best_iteration, best_temperature, best_length): where a chain's best accepted row lies, and how long its history was there. The temperature is null where h has none."""
    temp = F.col("temperature") if "temperature" in h.columns else F.lit(None).cast("double")
    best = F.min(F.struct("total", "seq", "iteration", temp.alias("temperature"))).alias("b")
    return h.where("accepted").groupBy("chain_id").agg(best).select("chain_id", F.col("b.total").alias("best"), F.col("b.iteration").alias("best_iteration"), F.col("b.temperature").alias("best_temperature"), F.col("b.seq").alias("best_length"))


def duration(seconds: Column) -> Column:
    """M:SS, or H:MM:SS from an hour on; below 0 as 0."""
    s = F.greatest(F.lit(0).cast("long"), seconds.cast("long"))
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%d:%02d", m, s % 60))


def readout(runs: DataFrame) -> DataFrame:
    """(chain_id, time, ips, left) of runs (chain_id, iteration, iterations, elapsed in seconds, running): iterations a second, null before the first, and the time that is left, null unless the run goes on."""
    ips = F.when(F.col("iteration") > 0, F.when(F.col("elapsed") > 0, F.col("iteration") / F.col("elapsed")).otherwise(F.lit(0.0)))
    goes = F.col("running") & (ips > 0) & (F.col("iteration") < F.col("iterations"))
    return runs.select("chain_id", duration(F.col("elapsed")).alias("time"), ips.alias("ips"), F.when(goes, duration((F.col("iterations") - F.col("iteration")) / ips)).alias("left"))


def smoothed(h: DataFrame, half: int = 3) -> DataFrame:
    """(chain_id, seq, smooth): the centred mean; ends take what there is."""
    return h.select("chain_id", "seq", F.avg("total").over(_order().rowsBetween(-half, half)).alias("smooth"))


def banded(h: DataFrame) -> DataFrame:
    """(chain_id, seq, weight, band): recency by age from the chain's end, and its band of 24."""
    age = F.max("seq").over(_chain()) - F.col("seq")
    t = F.exp(-age / FADE)
    return h.select("chain_id", "seq", t.alias("weight"), F.least(F.floor(t * BANDS), F.lit(BANDS - 1)).cast("int").alias("band"))


def thinned(h: DataFrame, head: int = 400, most: int = 1400) -> DataFrame:
    """The newest `head` rows, and older ones by the smallest power-of-two stride that keeps `most` in all."""
    n = F.count("*").over(_chain())
    older = F.greatest(n - head, F.lit(0))
    # The least power of two of which no more than most - head fit into the older rows.
    q = F.ceil((older + 1) / (most - head + 1))
    stride = F.when(q <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(q - 1))))
    return h.withColumn("stride", stride).withColumn("n", n).where((F.col("seq") > F.col("n") - head) | ((F.col("seq") - 1) % F.col("stride") == 0)).drop("stride", "n")


def compacted(h: DataFrame, most: int = 20_000, recent: int = 10_000, every: int = 50) -> DataFrame:
    """Chains of over `most` rows keep the newest `recent` and one in `every` of the older."""
    n = F.count("*").over(_chain())
    return h.withColumn("n", n).where((F.col("n") <= most) | (F.col("seq") > F.col("n") - recent) | ((F.col("seq") - 1) % every == 0)).drop("n")


def rendered(h: DataFrame, windows: int = 50) -> DataFrame:
    """(chain_id, seq, total): of each stretch of the chain its first, lowest and highest row, and the chain's last."""
    n = F.max("seq").over(_chain())
    step = F.greatest(F.lit(1), F.ceil(n / windows))
    w = h.withColumn("n", n).withColumn("part", F.floor((F.col("seq") - 1) / step))
    part = W.partitionBy("chain_id", "part")
    low, high = F.row_number().over(part.orderBy("total", "seq")), F.row_number().over(part.orderBy(F.desc("total"), "seq"))
    first = F.row_number().over(part.orderBy("seq"))
    return w.withColumns({"lo": low, "hi": high, "fi": first}).where("lo = 1 or hi = 1 or fi = 1 or seq = n").select("chain_id", "seq", "total")


def phase(value: Column, form: str) -> Column:
    """Axis forms of the phase plot: a penalty as a rating, a share in percent, a size, or as it is."""
    return {"rating": 100.0 - value, "x100": value * 100.0, "abs": F.abs(value), "raw": value}[form]


def axis(h: DataFrame, last: int = 1000, pad: float = 0.08, least: float = 0.05) -> DataFrame:
    """(chain_id, low, high) of the last rows, with a margin, at least `least` wide."""
    r = h.withColumn("n", F.max("seq").over(_chain())).where(F.col("seq") > F.col("n") - last).groupBy("chain_id").agg(F.min("total").alias("a"), F.max("total").alias("b"))
    span = F.greatest(F.col("b") - F.col("a"), F.lit(least))
    return r.select("chain_id", (F.col("a") - span * pad).alias("low"), (F.col("a") + span + span * pad).alias("high"))


def entropy(h: DataFrame) -> DataFrame:
    """(chain_id, accepted_worse, rejected_worse, entropy): the percentage of worse proposals that were accepted."""
    g = h.where("is_worse").groupBy("chain_id").agg(F.count_if("accepted").alias("accepted_worse"), F.count_if(~F.col("accepted")).alias("rejected_worse"))
    return g.withColumn("entropy", F.col("accepted_worse") / (F.col("accepted_worse") + F.col("rejected_worse")) * 100.0)


def reverted(h: DataFrame) -> DataFrame:
    """Each chain's history up to its best accepted row."""
    best = F.min(F.when(F.col("accepted"), F.struct("total", "seq"))).over(_chain())["seq"]
    return h.withColumn("upto", best).where("seq <= upto").drop("upto")


# ---- schedules ----

# The flip ramp's anchors, its midpoint and steepness; the ratchet's floor and the point at which it begins.
FLIP, MIDPOINT, STEEPNESS = (0.05, 0.50, 0.85), 0.835, 9.5
RATCHET_FLOOR, RATCHET_START = 0.0025, 0.33


def flip_rate(progress: Column, midpoint: float = MIDPOINT, steepness: float = STEEPNESS) -> Column:
    """A chain's flip probability: two halves of a logistic through the anchors at 0, midpoint and 1; a midpoint at an end leaves one half."""
    start, mid, end = FLIP
    f = lambda x: F.tanh(x * (0.5 * steepness))
    low, high = (midpoint, 1.0 - midpoint) if 0 < midpoint < 1 else (1.0, 1.0)
    at = 0.0 if midpoint <= 0 else 1.0 if midpoint >= 1 else midpoint
    rise = mid + (mid - start) * f(progress - at) / f(F.lit(low))
    fall = mid + (end - mid) * f(progress - at) / f(F.lit(high))
    middle = fall if midpoint <= 0 else rise if midpoint >= 1 else F.when(progress <= midpoint, rise).otherwise(fall)
    return F.when(progress <= 0, start).when(progress >= 1, end).otherwise(middle)


def ratchet_ceiling(progress: Column, start: float, floor: float = RATCHET_FLOOR) -> Column:
    """The tolerance that is allowed at a run's progress; never above start."""
    t = F.least((progress - RATCHET_START) / (1.0 - RATCHET_START), F.lit(1.0))
    return F.when(progress <= RATCHET_START, start).otherwise(start + (min(floor, start) - start) * t)


def cooling_rate(first: float, target: float, fraction: float, iterations: int) -> float:
    """The guided rate, at which the target is met at a fraction of the run; a target that is not colder: 0.9999."""
    return 0.9999 if max(target, 1e-9) >= first else (max(target, 1e-9) / first) ** (1.0 / max(1, int(fraction * iterations)))


def temperature(iteration: Column, first: float, rate: float) -> Column:
    return first * F.pow(F.lit(rate), iteration)


def acceptance_chance(delta: Column, temp: Column) -> Column:
    """Metropolis: improvements always, others by exp(-delta / temperature)."""
    return F.when(delta <= 0, 1.0).when(temp <= 0, 0.0).otherwise(F.exp(-delta / temp))
