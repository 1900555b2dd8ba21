import os
import pytest
from pyspark.sql import functions as F

from tests.micro import polygons, square
from wardflow.functions import geometry
from wardflow.operators import graph, validate
from wardflow.sources import shapefile, tables


def edges_of(df):
    return {(r["u"], r["v"]): round(r["shared_len"], 6) for r in graph.shared_sides(df).collect()}


def test_hole_and_centroid(spark):
    p = polygons(spark, [[square(0, 0, 3), square(1, 1, 1, hole=True)], [square(1, 1)]])
    r = p.select(geometry.area(F.col("rings")).alias("a"), geometry.perimeter(F.col("rings")).alias("p"), geometry.centroid(F.col("rings")).alias("c")).collect()
    assert (r[0]["a"], r[0]["p"], r[0]["c"]["x"], r[0]["c"]["y"]) == (8.0, 16.0, pytest.approx(1.5), pytest.approx(1.5))
    assert edges_of(p) == {(0, 1): 4.0}
    g, _ = graph.prepared(p)
    assert {x["precinct_id"]: x["ext_perimeter"] for x in g.collect()} == {0: 12.0, 1: 0.0}


def test_corners_are_no_contact_and_partial_sides_are(spark):
    assert edges_of(polygons(spark, [[square(0, 0)], [square(1, 1)]])) == {}
    assert edges_of(polygons(spark, [[square(0, 0, 2)], [square(2, 0.5, 1)], [square(2, 1.5, 1)]])) == {(0, 1): 1.0, (0, 2): 0.5, (1, 2): 1.0}


def test_slanted_sides(spark):
    tri = lambda *p: [{"is_hole": False, "pts": [{"x": x, "y": y} for x, y in [*p, p[0]]]}]
    got = edges_of(polygons(spark, [tri((0.0, 0.0), (3.0, 1.0), (0.0, 1.0)), tri((0.0, 0.0), (3.0, 0.0), (3.0, 1.0))]))
    assert got == {(0, 1): pytest.approx(10**0.5, abs=1e-5)}


def test_overlaps(spark):
    p = polygons(spark, [[square(0, 0, 2)], [square(1, 1, 2)], [square(3, 0, 1)], [square(0.5, 0.5, 0.5)]])
    assert {(r["u"], r["v"]) for r in graph.overlapping(p).collect()} == {(0, 1), (0, 3)}


def test_components_and_bridges(spark):
    rings = [[square(x, 0)] for x in (0, 1, 2)] + [[square(x, 0)] for x in (10, 11)] + [[square(5, 3)]]
    p = polygons(spark, rings, population=[5, 5, 5, 3, 3, 1], county_id=[0, 0, 1, 1, 1, 2])
    edges = graph.shared_sides(p).withColumn("is_virtual", F.lit(False))
    c = graph.components(p.select(F.col("precinct_id").alias("node")), edges)
    assert {r["node"]: r["component"] for r in c.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}
    said = validate.connectivity_issue(c)
    assert "3 components" in said and "rows: 3, 4, 5" in said
    b = graph.bridges(p, edges)
    assert {(r["u"], r["v"]) for r in b.collect()} == {(2, 3), (2, 5)}  # the county's own island first, though it lies farther off
    whole = graph.components(p.select(F.col("precinct_id").alias("node")), edges.unionByName(b))
    assert validate.connectivity_issue(whole) is None


def test_overlaps_of_large_and_small(spark):
    """A large precinct over a quarter of small ones, which have no pairs among themselves."""
    rings = [[square(0.5, 0.5, 20)]] + [[square(x, y)] for x in range(25) for y in range(25)]
    p = polygons(spark, rings)
    want = {(0, 1 + 25 * x + y) for x in range(21) for y in range(21)}
    assert {(r["u"], r["v"]) for r in graph.overlapping(p).collect()} == want


def test_nearest_pairs_in_a_county_of_ten_thousand(spark):
    """Two banks of 5,000 precincts each, whose river is narrowest in one place, and three islands: as all pairs say."""
    import random
    import time

    rng = random.Random(2)
    at = [(x, y - 60.0) for x in range(100) for y in range(50)] + [(x, y + 1 + (0.0 if y else 0.5 * (x != 61))) for x in range(100) for y in range(50)]
    at += [(40.25, -5.0), (300.0, 400.0), (-90.0, 3.0)]
    rings = [[square(x, y, 1 - 0.2 * rng.random())] for x, y in at]
    group = [0] * 5000 + [1] * 5000 + [2, 3, 4]
    p = polygons(spark, rings, county_id=[7] * len(at), group=group)
    g = graph.stored(graph._box(p).drop("rings"), "boxes")
    began = time.time()
    found = graph.nearest_in_county(g.where("group > 0"), g)
    got = {}
    for r in found.collect():
        a, b = (rings[r[c]][0]["pts"] for c in ("precinct_id", "o_precinct_id"))
        gap = lambda k: max(b[0][k] - a[2][k], a[0][k] - b[2][k], 0)  # noqa: E731, B023
        key = (round((gap("x") ** 2 + gap("y") ** 2) ** 0.5, 9), min(r["precinct_id"], r["o_precinct_id"]), max(r["precinct_id"], r["o_precinct_id"]))
        got[r["group"]] = min(got.get(r["group"], key), key)
    assert time.time() - began < 120 and found.count() < 500
    import numpy as np

    box = np.array([[q[0][0]["pts"][0]["x"], q[0][0]["pts"][0]["y"], q[0][0]["pts"][2]["x"], q[0][0]["pts"][2]["y"]] for q in ([r] for r in rings)])
    of = np.array(group)
    for k in (1, 2, 3, 4):
        a, b = np.flatnonzero(of == k), np.flatnonzero(of != k)
        dx = np.maximum(np.maximum(box[b, 0] - box[a, 2, None], box[a, 0, None] - box[b, 2]), 0)
        dy = np.maximum(np.maximum(box[b, 1] - box[a, 3, None], box[a, 1, None] - box[b, 3]), 0)
        d = np.round(np.hypot(dx, dy), 9)
        i, j = np.nonzero(d == d.min())
        assert got[k] == min((float(d.min()), int(min(a[u], b[v])), int(max(a[u], b[v]))) for u, v in zip(i, j))


def test_long_paths_are_one_component(spark):
    n = 300
    e = spark.range(n - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    c = graph.components(spark.range(n).select(F.col("id").alias("node")), e.orderBy(F.rand(1)))
    assert c.where("component <> 0").count() == 0


FIELDS = [("GEOID20", "N", 12, 0), ("POP", "N", 10, 0), ("NAME", "C", 12, 0), ("SHARE", "N", 8, 3), ("COUNTY", "N", 4, 0)]


def test_shapefile(spark, tmp_path):
    at = f"{tmp_path}/layer.shp"
    rings = [square(0, 0, 3), square(1, 1, 1, hole=True)]
    rows = [(37001, 10, "Ä", 0.5, 1, rings), (37002, 20, None, None, 2, [square(3, 0)]), (37003, 0, "c", 0.25, 2, None)]
    shapefile.write(at, FIELDS, rows)
    shapefile.register(spark)
    got = spark.read.format("shp").load(at).orderBy("precinct_id").collect()
    assert [(r["GEOID20"], r["POP"], r["NAME"], r["SHARE"], r["precinct_id"]) for r in got] == [(37001, 10, "Ä", 0.5, 0), (37002, 20, None, None, 1), (37003, 0, "c", 0.25, 2)]
    assert got[2]["rings"] is None and [r["is_hole"] for r in got[0]["rings"]] == [False, True]
    assert spark.read.format("shp").load(str(tmp_path)).count() == 3
    seen = shapefile.inspect(spark, at)
    assert (seen["error"], seen["population"], seen["precinct"], seen["county"]) == (None, "POP", "GEOID20", "COUNTY")
    assert seen["geometry"]["null_geometry"] == 1 and seen["columns"]["POP"]["sum"] == 30
    assert validate.geometry_issues(seen["layer"]) == ["1 of 3 rows have no geometry."]
    assert shapefile.load(spark, at).columns[1] == "population"
    assert shapefile.inspect(spark, f"{tmp_path}/none.shp")["error"]


def test_shapefile_is_read_in_parts(spark, tmp_path):
    """Parts by the index read their own bytes of the three files, and wanted columns and boxes spare decoding."""
    import os

    at = f"{tmp_path}/layer.shp"
    n = 500
    rows = [(k, 10 + k, f"p{k}", k / 8, 1, [square(k % 25, k // 25)]) for k in range(n)]
    shapefile.write(at, FIELDS, rows)
    shapefile.register(spark)
    whole = spark.read.format("shp").load(at)
    parts = spark.read.format("shp").option("split", 4000).load(at)
    size = os.path.getsize(at)
    assert whole.rdd.getNumPartitions() == 1 and parts.rdd.getNumPartitions() == -(-size // 4000)
    assert sorted(parts.collect(), key=str) == sorted(whole.collect(), key=str) and [r["precinct_id"] for r in whole.collect()] == list(range(n))
    reader = shapefile.ShapefileReader(f"file://{at}", ["rings", "precinct_id", "NAME"], split=4000)
    plan = reader.partitions()
    got = list(reader.read(plan[3]))
    assert [r[1] for r in got] == list(range(plan[3].first, plan[3].end)) and [r[2] for r in got] == [f"p{r[1]}" for r in got]
    share = sum(os.path.getsize(f"{tmp_path}/layer{e}") for e in (".shp", ".shx", ".dbf")) / len(plan)
    assert reader.bytes_read < 1.3 * share + 500
    few = spark.read.format("shp").schema("precinct_id long, POP long").option("box", "3.5,2.5,4.5,2.6").load(at)
    assert few.columns == ["precinct_id", "POP"] and sorted(map(tuple, few.collect())) == [(53, 63), (54, 64)]
    want = sorted(whole.collect(), key=str)
    os.remove(f"{tmp_path}/layer.shx")
    assert sorted(spark.read.format("shp").option("split", 4000).load(at).collect(), key=str) == want


def test_shapefiles_are_written_by_tasks(spark, tmp_path):
    shapefile.register(spark)
    kind = "GEOID20 long, NAME string, SHARE double, OPEN boolean, rings " + geometry.RINGS
    rows = [(k, f"é{k}" if k % 3 else None, k / 7 if k % 5 else None, k % 2 == 0, None if k == 4 else [square(k, 0, 3), square(k + 1, 1, 1, hole=True)]) for k in range(40)]
    df = spark.createDataFrame(rows, kind).repartitionByRange(3, "GEOID20").sortWithinPartitions("GEOID20")
    at = f"file://{tmp_path}/out"
    df.write.format("shp").option("roll", 2000).mode("append").save(at)
    assert len(shapefile.files(at)) > 3
    back = spark.read.format("shp").load(at).orderBy("precinct_id")
    assert [(r["GEOID20"], r["NAME"], r["SHARE"], r["OPEN"]) for r in back.collect()] == [r[:4] for r in rows]
    area = lambda d: [r[0] for r in d.orderBy("GEOID20").select(F.round(geometry.area(F.col("rings")), 9)).collect()]
    assert area(back) == area(df)
    df.limit(2).write.format("shp").mode("overwrite").save(at)
    assert spark.read.format("shp").load(at).count() == 2
    with pytest.raises(Exception, match="longer than"):
        spark.createDataFrame([("x" * 90, None)], "NAME string, rings " + geometry.RINGS).write.format("shp").mode("append").save(f"{at}2")
    spark.createDataFrame([], kind).write.format("shp").mode("append").save(f"{at}3")
    assert shapefile.files(f"{at}3") == []


def test_column_rules(spark):
    df = spark.createDataFrame([(1, "01", "2", -1), (2, "02", "3", None)], "id long, code string, n string, bad long")
    c = validate.coerced(df)
    assert dict(c.dtypes)["code"] == "string" and dict(c.dtypes)["n"] == "double"
    said = validate.column_issues(df, "bad", [("id", "none")], "code")
    assert len(said) == 4
    assert validate.padded(df.withColumn("GEOID", F.lit(1234567890)), "GEOID", 10).first()["GEOID"] == "01234567890"
    assert validate.padded(df, "id", 4).first()["id"] == "0001"


def test_cache(spark, tmp_path):
    p = polygons(spark, [[square(0, 0)], [square(1, 0)], [square(9, 0)]], population=[1, 1, 1], county_id=[0, 0, 0])
    cache = tables.LayerCache(spark, f"file://{tmp_path}/cache")
    mark = {".shp": {"sha256": "x", "size": 1}}
    edges, _ = tables.prepare(spark, p, cache, mark)
    assert sorted((r["u"], r["v"], r["is_virtual"]) for r in edges.collect()) == [(0, 1, False), (1, 2, True)]
    assert cache.load(mark, 3) and cache.load({".shp": {}}, 3) is None and cache.load(mark, 4) is None and cache.load({}, 3) is None


def test_plan_file_round_trip(spark, tmp_path):
    from tests.micro import micro

    layer, plan = micro(spark)
    tables.write_plan(plan, layer.precincts, f"{tmp_path}/plan")
    assert tables.plan_columns(spark, f"{tmp_path}/plan") == ["precinct_key", "district"]
    back = validate.load_plan(tables.read_plan(spark, f"{tmp_path}/plan"), layer.precincts, layer.edges, "precinct_key", "district", 2, 0.5)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, plan.select("plan_id", "precinct_id", "district").collect()))


def test_extrema_group_a_row_for_each_precinct(spark, capsys):
    pts = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0), (0.0, 0.0)]
    own = lambda q: [{"is_hole": False, "pts": [{"x": x, "y": y} for x, y in q]}]
    rows = [(1, own(pts)), (2, own([(x - 9, -y) for x, y in pts])), (2, own([(20.0, 0.0), (21.0, 0.0), (20.0, 1.0), (20.0, 0.0)])), (3, None), (4, [])]
    df = spark.createDataFrame(rows, f"precinct_id long, rings {geometry.RINGS}")
    got = {(r["precinct_id"], r["dir"]): (r["px"], r["py"], r["proj"]) for r in geometry.extrema(df).collect()}
    for k in (1, 2):
        every = [(p["x"], p["y"]) for i, r in rows if i == k for ring in r for p in ring["pts"]]
        for d, (c, s) in enumerate(geometry.DIRECTIONS):
            best = min(every, key=lambda p: (-round(p[0] * c + p[1] * s, 9), p))
            assert got.pop((k, d)) == pytest.approx((*best, best[0] * c + best[1] * s), abs=1e-8)
    assert not got
    geometry.extrema(df).explain()
    plan = capsys.readouterr().out
    assert plan.index("Generate") < plan.index("Aggregate")  # the outermost step; vertices and directions are no rows beneath the grouping
    assert plan.count("Generate") == 1


def test_reock_of_a_large_layer_broadcasts_no_rows_of_plans(spark, monkeypatch, capsys):
    from wardflow.operators import compactness, districts
    from wardflow.plans import catalogue
    from wardflow.plans.fixtures import K, Lattice

    x = Lattice(spark, "/root/testdata/sf0.001")
    geo = catalogue.unit_geometry(x)[0]
    run = lambda: compactness.reock(x.assignments, geo, geometry.extrema(x.precincts), K)
    plain = sorted(tuple(r) for r in run().collect())
    monkeypatch.setattr(districts, "FEW", 5)
    assert sorted(tuple(r) for r in run().collect()) == plain
    run().explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin [precinct_id" in plan and "BroadcastHashJoin [precinct_id" not in plan


def test_a_task_reads_and_writes_a_part_at_a_time(spark, tmp_path):
    """A large layer's vertices come part by part from SQL's table function, and a file is as large as what is held for it."""
    from wardflow.operators import control

    at = f"{tmp_path}/layer"
    shapefile.register(spark)
    control.register(spark)
    df = spark.range(300).select(F.col("id").alias("POP"), F.array(F.struct(F.lit(False).alias("is_hole"), F.array(*[F.struct((F.col("id") + x).cast("double").alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (0, 1), (1, 1), (1, 0), (0, 0))]).alias("pts"))).cast(geometry.RINGS).alias("rings"))
    df.coalesce(1).write.format("shp").option("roll", 12_000).mode("append").save(at)
    own = [p for p in shapefile.files(at)]
    assert len(own) > 3 and all(os.path.getsize(p) < 12_000 for p in own)
    parts = shapefile.parts(spark, at, 4000)
    assert parts.count() > 2 * len(own) and parts.rdd.getNumPartitions() == parts.count()
    of_parts = spark.sql("SELECT v.* FROM {p} p, LATERAL shapefile_vertices(p.path, p.first, p.end, p.before) v", p=parts)
    whole = spark.sql(f"SELECT * FROM shapefile_vertices('{at}')")
    got = of_parts.collect()
    assert len(got) == 1500 and sorted(map(tuple, got)) == sorted(map(tuple, whole.collect()))
    assert max(r["n"] for r in of_parts.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()) < 300
    # A file without .shx is one part.
    os.remove(own[0][:-4] + ".shx")
    again = spark.sql("SELECT v.* FROM {p} p, LATERAL shapefile_vertices(p.path, p.first, p.end, p.before) v", p=shapefile.parts(spark, at, 4000))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))
