"""Runs of chains that can be stopped, gone on with and reset.

A run is a folder: its states, as JSON by chain, and its history, both by batch. A batch is one Spark job over all chains that is written to a folder of its own and counts once
that folder has been committed; so a run that ends in the middle, or loses its driver, goes on from its last whole batch with the numbers that it would have had."""

from __future__ import annotations

import json
import threading
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.operators import chain, kernel

ROW = f"{chain.HISTORY}, state string"


class Run:
    """chains of one layer and one setting in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, layer: kernel.Arrays | chain.Laid, cfg: chain.ChainConfig, chains: int, start: np.ndarray | None = None):
        self.spark, self.path, self.cfg, self.chains = spark, path.rstrip("/"), cfg, chains
        self.given = chain.held(spark, layer, start)
        self._stop, self._go = threading.Event(), threading.Event()
        self._go.set()

    def _batches(self) -> list[int]:
        """The numbers of whole batches."""
        fs = self.spark._jvm.org.apache.hadoop.fs
        at = fs.Path(self.path)
        disk = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not disk.exists(at):
            return []
        names = [x.getPath().getName() for x in disk.listStatus(at)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch=") and disk.exists(fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def _read(self, batch: int) -> DataFrame:
        return self.spark.read.schema(ROW).parquet(f"{self.path}/batch={batch}")

    def advance(self, steps: int) -> int:
        """One more batch of `steps` iterations of every chain; the iterations that the run has reached."""
        done = self._batches()
        given, cfg = self.given, self.cfg
        names = [c.split(" ")[0] for c in ROW.replace("map<string,double>", "map").split(", ")]

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x, first = given()
                for c, said in zip(pdf["chain_id"], pdf["state"]):
                    s = chain.State.load(said) if said else chain.begin(x, cfg, int(c), first)
                    if s is None:  # no first plan was found
                        continue
                    rows = pd.DataFrame(chain.advance(x, cfg, s, steps)).assign(chain_id=int(c), state=None)
                    if len(rows):
                        yield rows[names]
                    yield pd.DataFrame([{**dict.fromkeys(names), "chain_id": int(c), "iteration": s.iteration, "state": s.dump()}])[names]

        now = self._read(done[-1]).where("state is not null").select("chain_id", "state") if done else chain._chains(self.spark, self.chains).withColumn("state", F.lit(None).cast("string"))
        n = max(1, min(self.chains, 10_000))
        now.repartition(n, "chain_id").mapInPandas(each, ROW).write.mode("overwrite").parquet(f"{self.path}/batch={done[-1] + 1 if done else 0}")
        return self.reached()

    def run(self, steps: int = 100) -> int:
        """Batches until the end of the run, or until stop(); pause() holds it between two."""
        self._stop.clear()
        while not self._stop.is_set() and (not self._batches() or self.reached() < self.cfg.iterations):
            self._go.wait()
            if self._stop.is_set():
                break
            before = self.reached()
            if self.advance(steps) == before and before:
                break
        return self.reached()

    def stop(self) -> None:
        self._stop.set()
        self._go.set()

    def pause(self) -> None:
        self._go.clear()

    def resume(self) -> None:
        self._go.set()

    def reset(self) -> None:
        """The run as if it had not begun."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def reached(self) -> int:
        done = self._batches()
        return (self._read(done[-1]).where("state is not null").agg(F.max("iteration")).first()[0] or 0) if done else 0

    def states(self) -> DataFrame:
        """(chain_id, iteration, total, best, temperature, length): where each chain is, and its history's length."""
        done = self._batches()
        rows = self._read(done[-1]) if done else self.spark.createDataFrame([], ROW)
        at = lambda k, kind: F.get_json_object("state", f"$.{k}").cast(kind).alias(k)
        return rows.where("state is not null").select("chain_id", "iteration", at("total", "double"), at("best", "double"), at("temperature", "double"), at("seq", "long").alias("length"))

    def history(self) -> DataFrame:
        """All rows so far, of whole batches."""
        done = self._batches()
        rows = self.spark.read.schema(ROW).parquet(*[f"{self.path}/batch={k}" for k in done]) if done else self.spark.createDataFrame([], ROW)
        return rows.where("state is null").drop("state")

    def best_plans(self) -> DataFrame:
        """(chain_id, precinct_id, district) of each chain's best plan."""
        done = self._batches()
        plan = F.from_json(F.get_json_object("state", "$.best_plan"), "array<int>")
        rows = self._read(done[-1]) if done else self.spark.createDataFrame([], ROW)
        return rows.where("state is not null").select("chain_id", F.posexplode(plan).alias("precinct_id", "district")).withColumn("precinct_id", F.col("precinct_id").cast("long"))


# ---- the same from SQL ----


def save_layer(layer: kernel.Arrays, uri: str) -> None:
    """A layer's arrays as one JSON file, for SQL's run_chain."""
    from wardflow.sources.shapefile import opened

    disk, path = opened(uri)
    own = {k: (v.tolist() if isinstance(v, np.ndarray) else v) for k, v in layer.__dict__.items() if k != "around"}
    with disk.open_output_stream(path) as f:
        f.write(json.dumps(own).encode())


def load_layer(uri: str) -> kernel.Arrays:
    from wardflow.sources.shapefile import _bytes, opened

    disk, path = opened(uri)
    raw = _bytes(disk, path)
    if raw is None:
        raise FileNotFoundError(uri)
    own = json.loads(raw)
    return kernel.Arrays(**{k: None if v is None else np.array(v) for k, v in own.items()})


def register(spark: SparkSession) -> None:
    """SQL's table functions: run_chain(layer, chain_id, districts, iterations, seed) gives the chain's history, shapefile_vertices(path) a layer's points, and
    with (path, first, end, before) those of one part of a file, which is what a large layer's tasks take: a call's points are held together."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="seq long, iteration long, move string, proposed double, total double, is_worse boolean, accepted boolean, temperature double, tolerance double")
    class RunChain:
        def eval(self, layer: str, chain_id: int, districts: int, iterations: int, seed: int):
            from wardflow.plans.config import ScoreConfig

            x = load_layer(layer)
            cfg = chain.ChainConfig(iterations=iterations, seed=seed, score=ScoreConfig(n_districts=districts))
            s = chain.begin(x, cfg, chain_id)
            for r in chain.advance(x, cfg, s, iterations) if s else ():
                yield tuple(r[k] for k in ("seq", "iteration", "move", "proposed", "total", "is_worse", "accepted", "temperature", "tolerance"))

    @udtf(returnType="precinct_id long, ring int, is_hole boolean, vertex int, x double, y double")
    class ShapefileVertices:
        def eval(self, path: str, first: int = None, end: int = None, before: int = None):
            from wardflow.sources.shapefile import ShapefileReader, _Part, opened

            reader = ShapefileReader(path, ["rings", "precinct_id"])
            for part in reader.partitions() if before is None else [_Part(opened(path)[1], first, end, before)]:
                for rings, k in reader.read(part):
                    for i, ring in enumerate(rings or ()):
                        for j, p in enumerate(ring["pts"]):
                            yield k, i, ring["is_hole"], j, p["x"], p["y"]

    spark.udtf.register("run_chain", RunChain)
    spark.udtf.register("shapefile_vertices", ShapefileVertices)
