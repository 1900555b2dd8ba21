import math

import pytest
from pyspark.sql import functions as F

from tests.micro import micro
from wardflow.functions import numeric
from wardflow.operators import compactness, county, districts, labels, partisan, population, reports, score, validate
from wardflow.plans.config import ScoreConfig, everything

CFG = everything(n_districts=2, hinge_seats=1)

# Worked out from the formulas, by hand or by a scratch script.
EXPECTED = {
    "cut_edges": 2,
    "pop_deviation": 4000,
    "pop_dev_max": 20,
    "pop_dev_mean": 20,
    "excess_splits": 1,
    "county_excess": 10,
    "unified_districts": 0,
    "county_unified": 10,
    "congruence": 17.736303562378,
    "polsby_popper": 30.186829920227,
    "reock": 49.070418210593,
    "compactness": 1.784801544895,
    "alignment": 47.619047619048,
    "alignment_mean": 52.380952380952,
    "alignment_min": 51.020408163265,
    "mean_median": 0,
    "efficiency_gap": -0.222584998735,
    "dem_seats": 0.845169997469,
    "majority_dem": 5.7e-13,
    "majority_rep": 0.154830002531,
    "partisan_bias": 0,
    "partisan_gini": 0,
    "competitiveness": 65.104620573880,
    "proportionality": 17.282142555930,
    "inversion_chance": 6.1e-13,
}


def test_score_of_the_worked_example(spark):
    layer, plan = micro(spark)
    row = score.scores(plan, layer, CFG).first()
    for k, v in EXPECTED.items():
        assert row[k] == pytest.approx(v, abs=1e-9 if v else 1e-12), k


def test_other_worked_values(spark):
    layer, plan = micro(spark)
    d = districts.totals(plan, layer.precincts, 2)
    a = districts.arrays(d)
    assert sorted(r["share"] for r in d.collect()) == [0.15, 0.55]
    assert a.select(partisan.efficiency_gap()).first()[0] == pytest.approx(-0.3)
    assert a.select(partisan.competitiveness(CFG.sigma)).first()[0] == pytest.approx(0.261715345696, abs=1e-11)
    c = county.congruence(county.matrix(plan, layer.precincts), layer.precincts, 2).first()
    assert (c["raw_county"], c["raw_district"]) == (pytest.approx(1.405561886744), pytest.approx(1.382718271584))


def test_total_is_the_breakdown_and_unused_metrics_are_not_built(spark):
    layer, plan = micro(spark)
    s = score.scores(plan, layer, CFG)
    assert sum(r["percent"] for r in score.breakdown(s, CFG).collect()) == pytest.approx(100)
    few = score.scores(plan, layer, ScoreConfig(n_districts=2))
    assert few.columns == ["plan_id", "cut_edges", "total"]
    assert few.first()["total"] == 2


def test_empty_district(spark):
    layer, plan = micro(spark)
    d = districts.totals(plan, layer.precincts, 3).where("district = 2").first()
    assert (d["population"], d["share"]) == (0, 0.5)
    pp = compactness.polsby_popper(plan, layer.geometry, layer.edges, 3).where("district = 2").first()
    rk = compactness.reock(plan, layer.geometry, layer.extrema, 3).where("district = 2").first()
    assert (pp["polsby_popper"], rk["reock"]) == (1.0, 0.0)


def test_without_votes(spark):
    layer, plan = micro(spark)
    none = score.Layer(layer.precincts.withColumns({"dem_votes": F.lit(0).cast("long"), "rep_votes": F.lit(0).cast("long")}), layer.edges, layer.geometry, layer.extrema, layer.reference)
    row = score.scores(plan, none, CFG).first()
    assert (row["proportionality"], row["inversion_chance"], row["partisan_bias"], row["efficiency_gap"]) == (0, 0, 0, 0)
    assert reports.metrics(plan, none, ScoreConfig(n_districts=2)).first()["dem_pct"] == 50
    assert reports.live_table(plan, none, ScoreConfig(n_districts=2)).first()["dem_pct"] is None


def test_virtual_edges_count_in_exports_only(spark):
    layer, plan = micro(spark)
    edges = layer.edges.withColumn("is_virtual", F.col("u") == 0)
    cut = districts.cut_edges(plan, edges)
    assert population.cut_count(cut).first()["cut_edges"] == 1
    assert population.cut_count(cut, virtual=True).first()["cut_edges"] == 2
    assert districts.incidence(plan, edges).first()["cut_edges"] == 2


def test_counties_that_are_districts(spark):
    layer, plan = micro(spark)
    same = layer.precincts.withColumn("county_id", F.col("x"))
    c = county.congruence(county.matrix(plan, same), same, 2).first()
    assert (c["raw_county"], c["raw_district"], c["congruence"]) == (1.0, 1.0, 0.0)


def test_normal_distribution(spark):
    xs = [i / 37 for i in range(-444, 445)] + [-38.0, 38.0, 0.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", numeric.normal_cdf(F.col("x")).alias("p")).collect()
    assert max(abs(r["p"] - math.erfc(-r["x"] / math.sqrt(2)) / 2) for r in rows) < 4e-16
    numeric.register(spark)
    assert spark.sql("SELECT normal_cdf(1.0D)").first()[0] == pytest.approx(0.8413447460685429)


def test_win_counts(spark):
    ps = [0.1, 0.5, 0.9, 0.3]
    want = [0.0] * 5
    for mask in range(16):
        p = math.prod(q if mask >> i & 1 else 1 - q for i, q in enumerate(ps))
        want[bin(mask).count("1")] += p
    row = spark.createDataFrame([(ps,)], "ps array<double>").select(numeric.win_counts(F.col("ps")).alias("f")).first()
    assert row["f"] == pytest.approx(want)


def test_labels(spark):
    layer, plan = micro(spark)
    c = labels.centroids(plan, layer.precincts.select("precinct_id", (F.col("x") + 0.5).alias("cx"), (F.col("y") + 0.5).alias("cy"), "population"), 3)
    for got in (labels.geographic(c), labels.geographic(c, "n_s"), labels.proximity(c)):
        by = {r["district"]: r["label"] for r in got.collect()}
        assert sorted(by.values()) == [1, 2, 3] and by[2] == 3
    inferred = labels.inferred(labels.overlaps(plan, layer.reference, layer.precincts), layer.reference, 3)
    by = {r["district"]: r["label"] for r in inferred.collect()}  # both matchings share 50 people
    assert {by[0], by[1]} == {10, 11} and by[2] == 1
    assert {r["district"]: r["label"] for r in labels.stable(plan, plan, 2).collect()} == {0: 0, 1: 1}


def test_matching_is_the_best():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    for n, m in [(1, 1), (3, 3), (2, 5), (5, 3), (6, 6)]:
        w = rng.integers(0, 50, (n, m)).astype(float)
        pairs = labels.matching(w)
        best = max(sum(w[i, j] for i, j in zip(rows, cols)) for rows in itertools.combinations(range(n), min(n, m)) for cols in itertools.permutations(range(m), min(n, m)))
        assert len(pairs) == min(n, m) and sum(w[i, j] for i, j in pairs) == best


def test_plan_files_are_checked(spark):
    layer, plan = micro(spark)
    csv = plan.join(layer.precincts, "precinct_id").select(F.concat("precinct_key", F.lit(" ")).alias("id"), (F.col("district") + 1).cast("string").alias("district"))
    load = lambda df, k=2, tol=0.5: validate.load_plan(df, layer.precincts, layer.edges, "id", "district", k, tol)
    assert {(r["precinct_id"], r["district"]) for r in load(csv).collect()} == {(0, 0), (1, 1), (2, 0), (3, 1)}
    other = csv.withColumn("id", F.when(F.col("id") == "000 ", "zzz").otherwise(F.col("id")))
    bad = [
        (csv.limit(3), 2, "rows"),
        (other, 2, "ids extra"),
        (csv.withColumn("district", F.lit(None).cast("string")), 2, "no numbers"),
        (csv, 3, "has 2 districts"),
        (csv.withColumn("district", (F.col("district").cast("int") + 5).cast("string")), 2, "should be"),
        (csv.withColumn("district", F.when(F.col("id").startswith("000") | F.col("id").startswith("003"), "1").otherwise("2")), 2, "pieces"),
    ]
    for df, k, said in bad:
        with pytest.raises(validate.PlanError, match=said):
            load(df, k)
    with pytest.raises(validate.PlanError, match="off"):
        load(csv, tol=0.05)
