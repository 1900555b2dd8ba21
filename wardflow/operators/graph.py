"""Precinct graphs: adjacency from polygons, components, bridges to islands, contiguity."""

from __future__ import annotations

import math
import re
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardflow.functions import geometry
from wardflow.operators.districts import is_large, sorted_joins

DIGITS = 9
#: Edges of a layer that every task may hold; larger layers are taken in parts, or the relational way.
HELD_EDGES = 5_000_000
#: Precinct ids of a large layer, and plans, that a task takes together to count pieces.
PART, PLANS = 100_000, 8
#: Components whose labels the driver may hold while it joins them.
MOST_COMPONENTS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset, a local master gets an own one; a cluster has to name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="wardflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stored(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """df written to the shared folder, in folders by a column if asked for, and read again."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    w = df.write.partitionBy(by) if by else df.write
    w.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Deletes a table that stored() gave and that is read no more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shared_sides(layer: DataFrame, tol: float | None = None) -> DataFrame:
    """(u, v, shared_len) of precincts with a common stretch of boundary, corners excluded. Boundaries are noded within a tolerance first, so that rounded vertices on a neighbour's side count as on it."""
    from wardflow.operators import topology  # which is built on this module

    return topology.contacts(topology.borders(topology.pieces(layer, tol)))


def _box(layer: DataFrame) -> DataFrame:
    """layer's rows with the ends of their extent, x1, x2, y1 and y2."""
    pts = F.flatten(F.transform("rings", lambda r: r["pts"]))
    end = lambda f, a: f(F.transform(pts, lambda p: p[a]))
    return layer.select("*", end(F.array_min, "x").alias("x1"), end(F.array_max, "x").alias("x2"), end(F.array_min, "y").alias("y1"), end(F.array_max, "y").alias("y2"))


def overlapping(layer: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(u, v) of precincts whose insides overlap, found among those whose boxes meet by an exact test: a corner of one lies inside the other, or their sides cross. A box is looked up by cells of
    its own size, and looks up those of its size and larger, so no box takes more than a few cells and small ones don't meet because a large one is near. known: pairs (u, v) that need no test and are left out."""
    box = _box(layer).where("x1 is not null").select("precinct_id", "x1", "x2", "y1", "y2")
    extent = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    box = stored(box.where(extent > 0).withColumn("level", F.ceil(F.log2(extent)).cast("int")), "boxes")
    levels = sorted(r["level"] for r in box.select("level").distinct().collect())  # sizes by powers of two
    cells = lambda c, level: F.sequence(F.floor(F.col(f"{c}1") / F.pow(F.lit(2.0), level)), F.floor(F.col(f"{c}2") / F.pow(F.lit(2.0), level)))
    at = lambda df, level: df.withColumn("gx", F.explode(cells("x", level))).withColumn("gy", F.explode(cells("y", level)))
    small = at(box.withColumn("of", F.explode(F.lit(levels).cast("array<int>"))).where("of >= level"), F.col("of"))
    large = at(box, F.col("level")).withColumnsRenamed({c: f"o_{c}" for c in ("precinct_id", "x1", "x2", "y1", "y2")}).withColumnRenamed("level", "of")
    near = small.join(large, ["of", "gx", "gy"]).where((F.col("x1") < F.col("o_x2")) & (F.col("o_x1") < F.col("x2")) & (F.col("y1") < F.col("o_y2")) & (F.col("o_y1") < F.col("y2")) & (F.col("precinct_id") != F.col("o_precinct_id")))
    near = near.select(F.least("precinct_id", "o_precinct_id").alias("u"), F.greatest("precinct_id", "o_precinct_id").alias("v")).distinct()
    if known is not None:
        near = near.join(known.select("u", "v"), ["u", "v"], "left_anti")
    rings = layer.select("precinct_id", "rings")
    near = near.join(rings.withColumnRenamed("precinct_id", "u"), "u").join(rings.withColumnsRenamed({"precinct_id": "v", "rings": "o_rings"}), "v")

    def run(batches):
        for pdf in batches:
            hit = [interiors_meet(a, b) for a, b in zip(pdf["rings"], pdf["o_rings"])]
            yield pdf.loc[hit, ["u", "v"]]

    return near.mapInPandas(run, "u long, v long")


def _sides(rings) -> np.ndarray:
    return np.array([(p["x"], p["y"], q["x"], q["y"]) for r in rings for p, q in zip(r["pts"][:-1], r["pts"][1:])], float).reshape(-1, 4)


def _inside(x: np.ndarray, y: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Whether points lie inside by the parity of crossings; points on a side are not asked for."""
    up = (s[:, 1] > y[:, None]) != (s[:, 3] > y[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = s[:, 0] + (y[:, None] - s[:, 1]) * (s[:, 2] - s[:, 0]) / (s[:, 3] - s[:, 1])
    return ((up & (x[:, None] < cross)).sum(1) % 2).astype(bool)


def _on(x: np.ndarray, y: np.ndarray, s: np.ndarray, eps: float = 1e-9) -> np.ndarray:
    d = (s[:, 2] - s[:, 0]) * (y[:, None] - s[:, 1]) - (s[:, 3] - s[:, 1]) * (x[:, None] - s[:, 0])
    t = (x[:, None] - s[:, 0]) * (x[:, None] - s[:, 2]) + (y[:, None] - s[:, 1]) * (y[:, None] - s[:, 3])
    return ((np.abs(d) <= eps) & (t <= eps)).any(1)


def interiors_meet(a, b) -> bool:
    s, t = _sides(a), _sides(b)

    def enters(p, q) -> bool:
        x, y = np.r_[p[:, 0], (p[:, 0] + p[:, 2]) / 2], np.r_[p[:, 1], (p[:, 1] + p[:, 3]) / 2]
        return bool((_inside(x, y, q) & ~_on(x, y, q)).any())

    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    same = {tuple(np.round(x, 9)) for x in s[:, :2]} == {tuple(np.round(x, 9)) for x in t[:, :2]}
    return same or enters(s, t) or enters(t, s) or any(side(p[:2], p[2:], q[:2]) * side(p[:2], p[2:], q[2:]) < -1e-18 and side(q[:2], q[2:], p[:2]) * side(q[:2], q[2:], p[2:]) < -1e-18 for p in s for q in t)


def neighbours(layer: DataFrame) -> DataFrame:
    """(u, v, shared_len) of precincts that share a stretch of boundary or a part of their insides, which alone counts as length 0."""
    sides = stored(shared_sides(layer), "sides")
    more = overlapping(layer, sides).select("u", "v", F.lit(0.0).alias("shared_len"))
    return sides.unionByName(more)


def prepared(layer: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(precinct_id, area, perimeter, ext_perimeter) and the edges (u, v, shared_len, is_virtual)."""
    edges = neighbours(layer).withColumn("is_virtual", F.lit(False))
    both = edges.select(F.explode(F.array("u", "v")).alias("precinct_id"), "shared_len").groupBy("precinct_id").agg(F.sum("shared_len").alias("shared"))
    g = layer.select("precinct_id", geometry.area(F.col("rings")).alias("area"), geometry.perimeter(F.col("rings")).alias("perimeter")).join(both, "precinct_id", "left")
    return g.select("precinct_id", "area", "perimeter", F.greatest(F.col("perimeter") - F.coalesce("shared", F.lit(0.0)), F.lit(0.0)).alias("ext_perimeter")), edges


def numbered(edges: DataFrame, width: int = 4096) -> DataFrame:
    """edges with edge_id, in order of (u, v): rows are numbered within stretches of u, to which the sizes of the stretches before are added."""
    e = edges.withColumn("_at", F.floor(F.col("u") / width))
    before = W.orderBy("_at").rowsBetween(W.unboundedPreceding, -1)  # over stretches, not edges
    first = e.groupBy("_at").agg(F.count("*").alias("_n")).select("_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = F.row_number().over(W.partitionBy("_at").orderBy("u", "v"))
    return e.withColumn("_own", own).join(first, "_at").withColumn("edge_id", (F.col("_first") + F.col("_own") - 1).cast("long")).drop("_at", "_own", "_first")


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, component) for nodes (node) and edges (u, v): the smallest node reachable. Labels jump to their label's label in each round, so
    rounds grow with the logarithm of a component's length; each is written to the shared folder, and the one before is deleted. Labels that still change after so many rounds are an error."""
    both = stored(edges.select("u", "v").union(edges.select("v", "u")).where("u <> v").distinct(), "both")
    large = is_large(both)
    label = nodes.select("node", F.col("node").alias("c"))
    near = both.groupBy("u").agg(F.min("v").alias("m"))
    label = stored(label.join(sorted_joins(near, large), label["node"] == near["u"], "left").select("node", F.least("node", F.coalesce("m", "node")).alias("c")), "labels")
    before = None
    for _ in range(rounds):
        label = sorted_joins(label, large)
        far = both.join(label.withColumnsRenamed({"node": "v", "c": "vc"}), "v").groupBy("u").agg(F.min("vc").alias("m"))
        step = label.join(sorted_joins(far, large), label["node"] == far["u"], "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c"))
        # What a node learns is told to its label's node too, so that whole trees hook on to smaller ones.
        hook = step.join(label.select("node", F.col("c").alias("was")), "node").groupBy(F.col("was").alias("node")).agg(F.min("c").alias("h"))
        step = sorted_joins(step.join(sorted_joins(hook, large), "node", "left").select("node", F.least("c", F.coalesce("h", "c")).alias("c")), large)
        up = step.select(F.col("node").alias("k"), F.col("c").alias("cc"))
        old, label = label, stored(step.join(up, step["c"] == up["k"], "left").select("node", F.coalesce("cc", "c").alias("c")), "labels")
        remove(old)
        now = label.agg(F.bit_xor(F.xxhash64("node", "c"))).first()[0]
        if now == before:
            remove(both)
            return label.select("node", F.col("c").alias("component"))
        before = now
    raise RuntimeError(f"components are not complete after {rounds} rounds")


def connected(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes is linked to, by rounds of hooking and jumping."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        open_ = a != b
        if not open_.any():
            return root
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while (root != root[root]).any():
            root = root[root]


def pieces(assignments: DataFrame, edges: DataFrame) -> DataFrame:
    """(plan_id, district, pieces): connected parts of each district; virtual edges connect. A plan is as large as its layer, whose edges every task holds: one shuffle
    by plan. Layers with too many edges for that are taken part by part."""
    ids = assignments.select("plan_id", "precinct_id", "district")
    if edges.count() > HELD_EDGES:
        return pieces_by_parts(ids, edges)
    ends = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).toPandas()
    held = ids.sparkSession.sparkContext.broadcast((ends.u.to_numpy(), ends.v.to_numpy()))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at, district = pdf.precinct_id.to_numpy(), pdf.district.to_numpy()
        order = np.argsort(at, kind="stable")
        at, district = at[order], district[order]
        u, v = held.value
        i, j = (np.minimum(np.searchsorted(at, x), len(at) - 1) for x in (u, v))
        inner = (at[i] == u) & (at[j] == v) & (district[i] == district[j])
        root = connected(len(at), i[inner], j[inner])
        d, n = np.unique(district[np.unique(root)], return_counts=True)
        return pd.DataFrame({"plan_id": pdf.plan_id.iloc[0], "district": d, "pieces": n})

    kinds = {f.name: f.dataType.simpleString() for f in ids.schema}
    return ids.groupBy("plan_id").applyInPandas(run, f"plan_id {kinds['plan_id']}, district {kinds['district']}, pieces long")


def pieces_by_parts(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """As pieces. A part is a stretch of PART precinct ids; for some PLANS plans at a time a task finds the components within one. Those that no edge leaves are counted there; of the others
    only the precincts at such edges go on, and the edges between parts link them."""
    part = lambda c: F.floor(F.col(c) / PART).cast("long")
    kinds = {f.name: f.dataType.simpleString() for f in ids.schema}
    ends = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    lots = max(1, math.ceil(ids.select("plan_id").distinct().count() / PLANS))
    own = ids.withColumns({"part": part("precinct_id"), "lot": F.pmod(F.xxhash64("plan_id"), F.lit(lots))})
    by_part = ends.select("u", "v", F.explode(F.array_distinct(F.array(part("u"), part("v")))).alias("part"))
    by_part = by_part.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lots - 1).cast("long"))).alias("lot"))
    schema, size = f"plan_id {kinds['plan_id']}, district {kinds['district']}, n long, precinct_id long, root long", PART

    def run(key, rows: pa.Table, sides: pa.Table) -> pa.Table:
        plan, u, v = rows["plan_id"].to_numpy(), sides["u"].to_numpy(), sides["v"].to_numpy()
        ids_, districts_ = rows["precinct_id"].to_numpy(), rows["district"].to_numpy()
        order = np.lexsort((ids_, plan))
        leaves = u // size != v // size
        out = []
        for k in np.split(order, np.flatnonzero(np.diff(plan[order])) + 1) if len(order) else ():
            at, district = ids_[k], districts_[k]
            i, j = (np.minimum(np.searchsorted(at, x), len(at) - 1) for x in (u, v))
            has_u, has_v = at[i] == u, at[j] == v
            inner = has_u & has_v & (district[i] == district[j])
            root = connected(len(at), i[inner], j[inner])
            edge = np.unique(np.r_[i[has_u & leaves], j[has_v & leaves]])
            top = np.unique(root)
            d, n = np.unique(district[top[~np.isin(top, root[edge])]], return_counts=True)
            out.append(pd.DataFrame({"plan_id": plan[k[0]], "district": d, "n": n, "precinct_id": None, "root": None}))
            out.append(pd.DataFrame({"plan_id": plan[k[0]], "district": district[edge], "n": None, "precinct_id": at[edge], "root": at[root[edge]]}))
        like = pa.schema([rows.schema.field("plan_id"), rows.schema.field("district"), *[pa.field(c, pa.int64()) for c in ("n", "precinct_id", "root")]])
        return pa.concat_tables([pa.Table.from_pandas(x, like, preserve_index=False) for x in out]) if out else like.empty_table()

    found = stored(own.groupBy("part", "lot").cogroup(by_part.groupBy("part", "lot")).applyInArrow(run, schema), "parts")
    # Each plan's precincts are numbered apart.
    span = F.broadcast(ids.agg((F.max("precinct_id") + 1).cast("long").alias("span")))
    border = found.where("root is not null").join(span).select("plan_id", "district", "precinct_id", (F.col("plan_id") * F.col("span") + F.col("root")).alias("node"))
    border = stored(border, "border")
    large = is_large(border)
    side = lambda x: border.select("plan_id", F.col("district").alias(f"d{x}"), F.col("precinct_id").alias(x), F.col("node").alias(f"n{x}"))
    across = sorted_joins(ends.where(part("u") != part("v")), large).join(side("u"), "u")
    links = sorted_joins(across, large).join(side("v"), ["plan_id", "v"]).where("du = dv").select(F.col("nu").alias("u"), F.col("nv").alias("v"))
    nodes = stored(border.select("plan_id", "district", "node").distinct(), "nodes")
    linked = sorted_joins(nodes, large).join(components(nodes.select("node"), links), "node").groupBy("plan_id", "district").agg(F.count_distinct("component").alias("n"))
    return found.where("n is not null").select("plan_id", "district", "n").unionByName(linked).groupBy("plan_id", "district").agg(F.sum("n").alias("pieces"))


def pieces_by_components(ids: DataFrame, edges: DataFrame) -> DataFrame:
    span = F.broadcast(ids.agg((F.max("precinct_id") + 1).alias("span")))
    node = ids.join(span).select("plan_id", "district", "precinct_id", (F.col("plan_id") * F.col("span") + F.col("precinct_id")).alias("node"))
    u = node.select("plan_id", F.col("precinct_id").alias("u"), F.col("district").alias("du"), F.col("node").alias("nu"))
    v = node.select("plan_id", F.col("precinct_id").alias("v"), F.col("district").alias("dv"), F.col("node").alias("nv"))
    inner = edges.select("u", "v").join(u, "u").join(v, ["plan_id", "v"]).where("du = dv").select(F.col("nu").alias("u"), F.col("nv").alias("v"))
    c = components(node.select("node"), inner)
    return node.join(c, "node").groupBy("plan_id", "district").agg(F.count_distinct("component").alias("pieces"))


def segment_gap(a: np.ndarray, b: np.ndarray) -> float:
    """The least distance between two sets of sides that don't cross: from the ends of one to the sides of the other."""

    def points(p, s):
        d = s[:, 2:] - s[:, :2]
        t = np.clip(((p[:, None] - s[None, :, :2]) * d).sum(2) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
        return np.sqrt((((s[None, :, :2] + t[:, :, None] * d) - p[:, None]) ** 2).sum(2)).min()

    return float(min(points(a[:, :2], b), points(b[:, :2], a)))


def near_others(small: DataFrame, all_: DataFrame, nearest: int, cell: float, levels: int = 60) -> DataFrame:
    """Each of small's precincts with its `nearest` of another group by centroid. Precincts are joined by grid cells, of which each looks at its own and those around;
    what lies within a cell's width is surely found. Cells double until enough is, or all there is."""
    out, left = None, small
    box = all_.agg(F.min("at.x").alias("x"), F.min("at.y").alias("y"), F.greatest(F.max("at.x") - F.min("at.x"), F.max("at.y") - F.min("at.y")).alias("w")).first()
    apart = F.hypot(F.col("at.x") - F.col("o_at.x"), F.col("at.y") - F.col("o_at.y"))
    for _ in range(levels):
        last = cell > box["w"]  # the cells around hold everything
        place = lambda a, lo: F.floor((F.col(f"at.{a}") - lo) / cell)  # noqa: E731, B023
        own = left.withColumn("gx", F.explode(F.array(*[place("x", box["x"]) + k for k in (-1, 0, 1)]))).withColumn("gy", F.explode(F.array(*[place("y", box["y"]) + k for k in (-1, 0, 1)])))
        other = all_.select(place("x", box["x"]).alias("gx"), place("y", box["y"]).alias("gy"), *[F.col(c).alias(f"o_{c}") for c in all_.columns])
        found = own.join(other, ["gx", "gy"]).where("group <> o_group").withColumn("apart", apart)
        if not last:
            found = found.where(F.col("apart") <= cell)
        found = found.withColumn("r", F.row_number().over(W.partitionBy("precinct_id").orderBy("apart", "o_precinct_id"))).where(F.col("r") <= nearest).drop("r", "gx", "gy", "apart")
        found = stored(found, "near")
        done = found.groupBy("precinct_id").agg(F.count("*").alias("n")).where(F.col("n") >= (0 if last else nearest)).select("precinct_id")
        kept = found.join(done, "precinct_id", "left_semi")
        out = kept if out is None else out.unionByName(kept)
        if last:
            return out
        left = stored(left.join(done, "precinct_id", "left_anti"), "left")
        if left.isEmpty():
            return out
        cell *= 2
    raise RuntimeError("the layer is too wide for its precincts")


def _gaps(batches):
    for pdf in batches:
        pdf["gap"] = [segment_gap(_sides(a), _sides(b)) for a, b in zip(pdf["rings"], pdf["o_rings"])]
        yield pdf[["group", "o_group", "precinct_id", "o_precinct_id", "tier", "gap"]]


GAP = "group long, o_group long, precinct_id long, o_precinct_id long, tier int, gap double"


def nearest_in_county(small: DataFrame, all_: DataFrame) -> DataFrame:
    """(group, o_group, precinct_id, o_precinct_id) that hold, for each of small's groups, the nearest pair of one of its precincts and one of another group in the same county, by the distance of their sides. small, all_:
    precinct_id, group, county_id and box ends.

    Pairs of cells are refined from a county's extent on, four by four parts at a time: each has the extent of what is in it, hence a least and a most distance, and a pair whose
    least is more than the least most of its group is dropped. Rows are thus made for what lies about as near as the nearest alone."""
    size = all_.agg(F.min("x1"), F.min("y1"), F.max("x2"), F.max("y2"), F.avg(F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))).first()
    width = max(size[2] - size[0], size[3] - size[1]) or 1.0
    levels = max(1, math.ceil(math.log(max(width / (size[4] or width), 1.0), 4)))
    place = lambda a, lo: F.floor(((F.col(f"{a}1") + F.col(f"{a}2")) / 2 - lo) / width * (1 - 1e-12) * 4**levels).cast("long")
    held = lambda df: df.withColumns({"gx": place("x", size[0]), "gy": place("y", size[1])})
    ends = [F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.min("y1").alias("y1"), F.max("y2").alias("y2")]
    cell = lambda k: [F.floor(F.col(c) / 4 ** (levels - k)).cast("long").alias(c) for c in ("gx", "gy")]
    up = lambda k: [F.floor(F.col(c) / 4 ** (levels - k)).cast("long").alias(f"up_{c}") for c in ("gx", "gy")]
    small, all_ = stored(held(small), "near-small"), stored(held(all_), "near-all")
    other = lambda df: df.withColumnsRenamed({c: f"o_{c}" for c in df.columns if c != "county_id"})
    apart = lambda far: F.hypot(*[F.greatest(F.col(f"o_{a}2") - F.col(f"{a}1"), F.col(f"{a}2") - F.col(f"o_{a}1")) if far else F.greatest(F.col(f"o_{a}1") - F.col(f"{a}2"), F.col(f"{a}1") - F.col(f"o_{a}2"), F.lit(0.0)) for a in "xy"])

    def kept(pairs: DataFrame) -> DataFrame:
        pairs = pairs.withColumns({"least": apart(False), "most": apart(True)})
        most = pairs.groupBy("group").agg(F.min("most").alias("bound"))
        return pairs.join(most, "group").where(F.col("least") <= F.col("bound") * (1 + 1e-9) + 10.0**-DIGITS)

    pairs = None
    for k in range(levels + 1):
        a = small.select("county_id", "group", *up(k - 1), *cell(k), "x1", "x2", "y1", "y2").groupBy("county_id", "group", "up_gx", "up_gy", "gx", "gy").agg(*ends)
        b = all_.select("county_id", "group", *up(k - 1), *cell(k), "x1", "x2", "y1", "y2").groupBy("county_id", "up_gx", "up_gy", "gx", "gy").agg(*ends, F.min("group").alias("first"), F.max("group").alias("last"))
        b = other(b)
        if pairs is None:
            p = a.join(b, "county_id")
        else:
            p = pairs.join(a, ["county_id", "group", "up_gx", "up_gy"]).join(b, ["county_id", "o_up_gx", "o_up_gy"])
        p = stored(kept(p.where((F.col("o_first") != F.col("group")) | (F.col("o_last") != F.col("group")))), "near-cells")
        pairs = p.select("county_id", "group", *[F.col(f"{o}{c}").alias(f"{o}up_{c}") for o in ("", "o_") for c in ("gx", "gy")])
    a = small.select("county_id", "group", "precinct_id", "x1", "x2", "y1", "y2", F.col("gx").alias("up_gx"), F.col("gy").alias("up_gy"))
    b = other(all_.select("county_id", "group", "precinct_id", "x1", "x2", "y1", "y2", F.col("gx").alias("up_gx"), F.col("gy").alias("up_gy")))
    p = pairs.join(a, ["county_id", "group", "up_gx", "up_gy"]).join(b, ["county_id", "o_up_gx", "o_up_gy"]).where("group <> o_group")
    return kept(p).select("group", "o_group", "precinct_id", "o_precinct_id")


def bridges(layer: DataFrame, edges: DataFrame, nearest: int = 64) -> DataFrame:
    """Virtual edges (u, v) that join all components to one: the tree of the best links, by (same county first; distance; ids), which is the same whichever component it is
    grown from. Every round each group but the mainland's (the most populous component's) takes its best link to another, so their number halves at least. Candidates are the nearest pairs within
    a county, and each small component's precincts' `nearest` of other groups. The driver holds a group for each component."""
    spark: SparkSession = layer.sparkSession
    c = components(layer.select(F.col("precinct_id").alias("node")), edges)
    large = is_large(c)
    p = stored(layer.join(sorted_joins(c, large), layer["precinct_id"] == c["node"]).select("precinct_id", "component", "county_id", "population", "rings", geometry.centroid(F.col("rings")).alias("at")), "bridge-layer")
    rings = sorted_joins(p.select("precinct_id", "rings"), large)
    size = p.groupBy("component").agg(F.sum("population").alias("population"))
    n = size.count()
    if n > MOST_COMPONENTS:
        raise ValueError(f"the layer has {n} components, more than {MOST_COMPONENTS}")
    kind = "u long, v long, shared_len double, is_virtual boolean"
    if n < 2:
        return spark.createDataFrame([], kind)
    mainland = size.orderBy(F.desc("population"), "component").first()["component"]
    group = {r["component"]: r["component"] for r in size.collect()}
    pts = F.flatten(F.transform("rings", lambda r: r["pts"]))
    extent = F.array_max(F.transform(pts, lambda q: q["x"])) - F.array_min(F.transform(pts, lambda q: q["x"]))
    cell = float(p.agg(F.avg(extent)).first()[0] or 1.0) * 4

    def top(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    out: list[tuple] = []
    while len(out) < n - 1:
        now = spark.createDataFrame([(x, top(x)) for x in group], "component long, group long")
        g = stored(_box(p.join(now, "component").drop("component", "population")).drop("rings"), "bridge-groups")
        small = g.where(F.col("group") != top(mainland))
        same = nearest_in_county(small.where("county_id is not null"), g.where("county_id is not null")).withColumn("tier", F.lit(0))
        far = near_others(small, g, nearest, cell).select("group", "o_group", "precinct_id", "o_precinct_id").withColumn("tier", F.lit(1))
        pair = same.unionByName(far).join(rings, "precinct_id").join(rings.withColumnsRenamed({"precinct_id": "o_precinct_id", "rings": "o_rings"}), "o_precinct_id")
        found = pair.mapInPandas(_gaps, GAP)
        key = F.struct("tier", F.round("gap", DIGITS).alias("gap"), F.least("precinct_id", "o_precinct_id").alias("u"), F.greatest("precinct_id", "o_precinct_id").alias("v"), "o_group")
        links = found.groupBy("group").agg(F.min(key).alias("k")).collect()
        joined = False
        for r in sorted(links, key=lambda r: tuple(r["k"])):
            a, b = top(r["group"]), top(r["k"]["o_group"])
            if a != b:
                group[max(a, b)] = min(a, b)
                out.append((r["k"]["u"], r["k"]["v"], 0.0, True))
                joined = True
        if not joined:
            raise RuntimeError(f"{n - 1 - len(out)} components have no link to others")
    return spark.createDataFrame(sorted(out), kind)


def dissolved(layer: DataFrame, owner: DataFrame) -> DataFrame:
    """The owner's columns with x1, y1, x2, y2: the outline of each owner's precincts: noded pieces of sides that no second precinct of the owner has. owner: precinct_id, and whatever names an owner.
    topology.outlines makes rings of them."""
    from wardflow.operators import topology

    a, b = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    s = topology.pieces(layer).select("precinct_id", F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).join(owner, "precinct_id")
    own = [c for c in owner.columns if c != "precinct_id"]
    ends = [F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2")]
    return s.groupBy(*own, "a", "b").agg(F.count("*").alias("n")).where("n = 1").select(*own, *ends)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges between nodes (node)."""
    return edges.join(nodes.select(F.col("node").alias("u")), "u", "left_semi").join(nodes.select(F.col("node").alias("v")), "v", "left_semi")
