"""Plan files, metric files and the cache of prepared layers."""

from __future__ import annotations

import json
import os
import posixpath
from pathlib import Path

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.sources.shapefile import opened

VERSION = 2


def data_dir(kind: str = "", override: str = "WARDFLOW_DATA") -> str:
    """Where data go: the environment's setting, else a folder in the home directory."""
    return str(Path(os.environ.get(override) or Path.home() / "wardflow-data") / kind)


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """A plan's rows; all columns as text, so that ids keep their zeros."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def plan_columns(spark: SparkSession, path: str) -> list[str]:
    return read_plan(spark, path).columns


def write_plan(assignments: DataFrame, precincts: DataFrame, path: str, key: str | None = "precinct_key") -> None:
    """`<key>, district` with districts from 1, in the layer's order; without a key the row's index."""
    a = assignments.join(precincts.select("precinct_id", *([key] if key else [])), "precinct_id")
    named = F.col(key) if key else F.col("precinct_id").alias("index")
    a.orderBy("precinct_id").select(named, (F.col("district") + 1).alias("district")).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """The metrics of one plan, by district."""
    metrics.drop("plan_id").orderBy("district").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_history(history: DataFrame, path: str) -> None:
    """Chains' histories; metrics become columns."""
    flat = history
    if "metrics" in history.columns:
        names = sorted(r["k"] for r in history.select(F.explode(F.map_keys("metrics")).alias("k")).distinct().collect())
        flat = history.select(*[c for c in history.columns if c != "metrics"], *[F.col("metrics")[n].alias(f"metric_{n}") for n in names])
    flat.write.mode("overwrite").option("header", True).csv(path)


class LayerCache:
    """Prepared edges and geometry of a layer in Parquet, valid for one fingerprint of its files and one version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, print_: dict, edges: DataFrame, geometry: DataFrame) -> None:
        edges.where("not is_virtual").write.mode("overwrite").parquet(f"{self.path}/edges")
        edges.where("is_virtual").write.mode("overwrite").parquet(f"{self.path}/virtual")
        geometry.write.mode("overwrite").parquet(f"{self.path}/geometry")
        counts = {"precincts": geometry.count(), "edges": edges.count()}
        disk, root = opened(self.path)
        with disk.open_output_stream(posixpath.join(root, "_meta.json")) as f:
            f.write(json.dumps({"version": VERSION, "fingerprint": print_, **counts}).encode())

    def load(self, print_: dict, precincts: int | None = None) -> tuple[DataFrame, DataFrame] | None:
        """(edges, geometry), or None if there is nothing that fits."""
        disk, root = opened(self.path)
        at = posixpath.join(root, "_meta.json")
        if not print_ or disk.get_file_info(at).type == fs.FileType.NotFound:
            return None
        with disk.open_input_stream(at) as f:
            meta = json.loads(f.read())
        if meta.get("version") != VERSION or meta.get("fingerprint") != print_ or precincts is not None and meta.get("precincts") != precincts:
            return None
        edges = self.spark.read.parquet(f"{self.path}/edges").unionByName(self.spark.read.parquet(f"{self.path}/virtual"))
        geometry = self.spark.read.parquet(f"{self.path}/geometry")
        return (edges, geometry) if (geometry.count(), edges.count()) == (meta["precincts"], meta["edges"]) else None


def prepare(spark: SparkSession, layer: DataFrame, cache: LayerCache | None = None, print_: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges with bridges, geometry) of a layer, from the cache if it fits."""
    from wardflow.operators import graph

    if cache and (got := cache.load(print_ or {}, layer.count())):
        return got
    geometry, edges = graph.prepared(layer)
    edges = edges.unionByName(graph.bridges(layer, edges))
    if cache and print_:
        cache.save(print_, edges, geometry)
        return cache.load(print_) or (edges, geometry)
    return edges, geometry
