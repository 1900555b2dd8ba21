"""Precincts, edges and plans built from the driver's tables: a lattice of unit squares, one for each customer."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K, PLANS = 8, 4


class Lattice:
    """Tables of one scale factor; w x w precincts."""

    def __init__(self, spark: SparkSession, sf_dir: str, plans: int = PLANS, k: int = K):
        self.spark, self.dir, self.plans, self.k = spark, sf_dir, plans, k
        self.customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
        self.w = isqrt(self.customer.count())

    @property
    def precincts(self) -> DataFrame:
        orders = self.spark.read.parquet(f"{self.dir}/orders.parquet")
        party = F.substring("o_orderpriority", 1, 1)
        votes = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(party.isin("1", "2")).alias("dem_votes"), F.count_if(party.isin("3", "4")).alias("rep_votes"))
        c = self.customer.where(F.col("c_custkey") < self.w * self.w).join(votes, "c_custkey", "left")
        x, y = F.col("c_custkey") % self.w, F.floor(F.col("c_custkey") / self.w)
        corner = lambda a, b: F.struct((x + a).cast("double").alias("x"), (y + b).cast("double").alias("y"))
        return c.select(
            F.col("c_custkey").cast("long").alias("precinct_id"),
            F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("precinct_key"),
            x.cast("long").alias("x"),
            y.cast("long").alias("y"),
            F.col("c_nationkey").alias("county_id"),
            (F.floor("c_acctbal") + 2000).cast("long").alias("population"),
            F.coalesce("dem_votes", F.lit(0)).alias("dem_votes"),
            F.coalesce("rep_votes", F.lit(0)).alias("rep_votes"),
            F.array(F.struct(F.lit(False).alias("is_hole"), F.array(*[corner(a, b) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]).alias("pts"))).alias("rings"),
        )

    @property
    def edges(self) -> DataFrame:
        p = self.precincts.select("precinct_id", "x", "y")
        to = F.explode(F.array_compact(F.array(F.when(F.col("x") < self.w - 1, F.col("precinct_id") + 1), F.when(F.col("y") < self.w - 1, F.col("precinct_id") + self.w))))
        return p.select(F.col("precinct_id").alias("u"), to.alias("v")).withColumns({"shared_len": F.lit(1.0), "is_virtual": F.lit(False)})

    def striped(self, x: Column, n: int) -> Column:
        return F.floor(x * n / self.w).cast("int")

    @property
    def assignments(self) -> DataFrame:
        """Plan 0: stripes; 1: balanced along a serpentine; 2 and on: stripes that wrap around."""
        p = self.precincts.select("precinct_id", "x", "y", "population")
        stripes = p.select(F.lit(0).cast("long").alias("plan_id"), "precinct_id", self.striped(F.col("x"), self.k).alias("district"))
        at = F.col("y") * self.w + F.when(F.col("y") % 2 == 0, F.col("x")).otherwise(self.w - 1 - F.col("x"))
        # People before a precinct: those of the rows before its own, of which there are w, and those before it in its row.
        preceding = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
        rows = p.groupBy("y").agg(F.sum("population").alias("people"))
        rows = rows.select("y", F.coalesce(F.sum("people").over(preceding(W.orderBy("y"))), F.lit(0)).alias("south"), F.sum("people").over(W.partitionBy()).alias("total"))
        own = F.coalesce(F.sum("population").over(preceding(W.partitionBy("y").orderBy(at))), F.lit(0))
        before = p.select("y", "precinct_id", own.alias("own")).join(F.broadcast(rows), "y")
        balanced = before.select(F.lit(1).cast("long"), "precinct_id", F.floor((F.col("south") + F.col("own")) * self.k / F.col("total")).cast("int"))
        more = p.withColumn("plan_id", F.explode(F.sequence(F.lit(2).cast("long"), F.lit(max(2, self.plans - 1)).cast("long"))))
        wrapped = more.select("plan_id", "precinct_id", self.striped((F.col("x") + F.col("plan_id") - 2) % self.w, self.k))
        return stripes.unionAll(balanced).unionAll(wrapped)

    @property
    def junctions(self) -> DataFrame:
        """For each precinct three polygons at the scale of projected coordinates: 3 i on one side of a line, 3 i + 1 and 3 i + 2 on the other, whose common vertex on it is a rounded number. The
        line runs from (ax, ay) to (bx, by), the vertex is (mx, my). Lines of different precincts lie far apart."""
        d = lambda c: F.col(c).cast("double")
        p = self.precincts.select("precinct_id", "county_id", (500_000.5 + d("x") * 5000).alias("ax"), (4_000_000.25 + d("y") * 5000).alias("ay"), (300 + d("population") / 10).alias("dx"), (d("county_id") * 37 - 400).alias("dy")).repartition("precinct_id")
        p = p.withColumns({"bx": F.col("ax") + F.col("dx"), "by": F.col("ay") + F.col("dy")})
        t = (d("county_id") + 3) / 31
        p = p.withColumns({"mx": F.col("ax") + F.col("dx") * t, "my": F.col("ay") + F.col("dy") * t})
        point = lambda n, s: F.struct((F.col(f"{n}x") - s * F.col("dy") / 4).alias("x"), (F.col(f"{n}y") + s * F.col("dx") / 4).alias("y"))
        own = lambda k, *pts: F.struct((F.col("precinct_id") * 3 + k).alias("precinct_id"), F.array(F.struct(F.lit(False).alias("is_hole"), F.array(*pts, pts[0]).alias("pts"))).alias("rings"))
        a, b, m = point("a", 0), point("b", 0), point("m", 0)
        three = F.array(own(0, a, b, point("b", 1), point("a", 1)), own(1, a, point("a", -1), point("m", -1), m), own(2, m, point("m", -1), point("b", -1), b))
        return p.select(F.explode(three).alias("t")).select("t.*")

    @property
    def reference(self) -> DataFrame:
        d = self.striped(F.col("y"), 6)
        return self.precincts.select("precinct_id", d.alias("ref_district"), (d + 10).cast("long").alias("ref_label"))

    @property
    def history(self) -> DataFrame:
        """A chain's history from events: (chain_id, seq, iteration, total, is_worse, accepted)."""
        e = self.spark.read.parquet(f"{self.dir}/events.parquet")
        seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
        kind = F.col("event_type")
        return e.select(F.col("user_id").cast("long").alias("chain_id"), seq.alias("seq"), seq.alias("iteration"), F.col("value").alias("total"), kind.isin("error", "click", "view").alias("is_worse"), (kind != "error").alias("accepted"))
