"""Ensembles of plans: annealed recombination chains, many at once."""

from __future__ import annotations

import json
import math
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs, parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.operators import districts, graph, kernel
from wardflow.operators.history import FLIP, MIDPOINT, RATCHET_FLOOR, RATCHET_START, STEEPNESS, cooling_rate
from wardflow.plans.config import ScoreConfig
from wardflow.sources.shapefile import opened

HISTORY = "chain_id long, seq long, iteration long, move string, proposed double, total double, is_worse boolean, accepted boolean, temperature double, tolerance double, metrics map<string,double>"
#: What of a layer the driver may hold, where it is asked to.
MOST_PRECINCTS, MOST_EDGES = 1_000_000, 5_000_000
#: Bytes of an array beyond which a task has it in a file of its own that is mapped, and not in its memory.
MAPPED = 1 << 24
#: Iterations whose rows a chain holds at once.
BLOCK = 1000
PLANS = "chain_id long, iteration long, total double, plan array<int>"


@dataclass(frozen=True)
class ChainConfig:
    """Settings of a run. `cooling`: guided (to `target` at `fraction` of the run) or static (`rate`); `anchor`: proportional to the first score, or nominal."""

    iterations: int = 100
    seed: int = 0
    score: ScoreConfig = field(default_factory=ScoreConfig)
    annealing: bool = True
    anchor: str = "proportional"
    factor: float = 0.2
    cooling: str = "guided"
    fraction: float = 0.9
    target: float = 1.0
    rate: float = 0.9995
    launch_watch: bool = True
    launch_at: int = 250
    three: float = 0.05
    flips: bool = False
    flip_midpoint: float = MIDPOINT
    only: str | None = None
    county_bias: float = 1.0
    ratchet: str | None = None

    def first_temperature(self, score: float) -> float:
        t = self.factor * score if self.anchor == "proportional" else self.factor
        return t if t > 0 else 1.0

    def cooled(self, first: float, iterations: int) -> float:
        return cooling_rate(first, self.target, self.fraction, iterations) if self.cooling == "guided" else self.rate


def relit(cfg: ChainConfig) -> ChainConfig:
    """Settings to go on from a finished plan at a low temperature."""
    return replace(cfg, anchor="nominal", factor=max(cfg.target, 1e-9), launch_watch=False)


def flip_probability(progress: float, midpoint: float) -> float:
    start, mid, end = FLIP
    if progress <= 0 or progress >= 1:
        return start if progress <= 0 else end
    f = lambda x: math.tanh(0.5 * STEEPNESS * x)
    at = min(max(midpoint, 0.0), 1.0)
    if midpoint > 0 and (midpoint >= 1 or progress <= midpoint):
        return mid + (mid - start) * f(progress - at) / f(midpoint if midpoint < 1 else 1.0)
    return mid + (end - mid) * f(progress - at) / f(1 - midpoint if midpoint > 0 else 1.0)


@dataclass
class State:
    """Where a chain is; as JSON it goes from one batch of iterations to the next."""

    plan: np.ndarray
    total: float
    metrics: dict
    temperature: float
    rate: float
    tolerance: float
    iteration: int
    seq: int
    best: float
    best_plan: np.ndarray
    rng: np.random.Generator

    def dump(self) -> str:
        own = {k: v for k, v in self.__dict__.items() if k not in ("plan", "best_plan", "rng")}
        return json.dumps(own | {"plan": self.plan.tolist(), "best_plan": self.best_plan.tolist(), "rng": self.rng.bit_generator.state})

    @classmethod
    def load(cls, text: str) -> State:
        x = json.loads(text)
        rng = np.random.default_rng()
        rng.bit_generator.state = x.pop("rng")
        return cls(**{**x, "plan": np.array(x["plan"]), "best_plan": np.array(x["best_plan"])}, rng=rng)


def begin(x: kernel.Arrays, cfg: ChainConfig, chain_id: int, start: np.ndarray | None = None) -> State | None:
    """The chain's first plan (given, or carved) and score; None if no plan could be carved."""
    rng = np.random.Generator(np.random.PCG64(np.random.SeedSequence(cfg.seed, spawn_key=(int(chain_id),))))
    plan = kernel.first_plan(x, cfg.score.n_districts, cfg.score.tolerance, rng, bias=cfg.county_bias) if start is None else np.asarray(start)
    if plan is None:
        return None
    m = kernel.score(x, plan, cfg.score)
    t = cfg.first_temperature(m["total"])
    return State(plan, m["total"], m, t, cfg.cooled(t, cfg.iterations), cfg.score.tolerance, 0, 0, m["total"], plan, rng)


def advance(x: kernel.Arrays, cfg: ChainConfig, s: State, steps: int) -> list[dict]:
    """Runs `steps` iterations; a row for each scored proposal. Invalid proposals cool the chain and leave no row; what a row says of the plan is of the
    one that the chain stands at after it."""
    rows, k = [], cfg.score.n_districts
    ideal = float(x.population.sum()) / k
    for _ in range(steps):
        if s.iteration >= cfg.iterations:
            break
        s.iteration += 1
        if cfg.annealing and cfg.launch_watch and s.iteration == cfg.launch_at + 1:
            s.temperature = cfg.first_temperature(s.total)
            if cfg.cooling == "guided":
                s.rate = cfg.cooled(s.temperature, cfg.iterations - s.iteration + 1)
        progress = s.iteration / cfg.iterations
        move = cfg.only
        if move is None:
            move = "flip" if cfg.flips and s.rng.random() < flip_probability(progress, cfg.flip_midpoint) else "three" if k >= 3 and s.rng.random() < cfg.three else "two"
        cut = x.cut(s.plan)
        step = {"flip": kernel.flip, "three": kernel.recombine_three, "two": kernel.recombine}[move]
        new = step(x, s.plan, cut, ideal, s.tolerance, s.rng, bias=cfg.county_bias)
        if new is None:
            s.temperature *= s.rate
            continue
        m = kernel.score(x, new, cfg.score)
        worse = m["total"] > s.total
        chance = 1.0 if not worse or not cfg.annealing else math.exp(-(m["total"] - s.total) / s.temperature) if s.temperature > 0 else 0.0
        accepted = not worse or s.rng.random() < chance
        s.temperature *= s.rate
        if accepted:
            s.plan, s.total, s.metrics = new, m["total"], m
        s.seq += 1
        improved = accepted and s.total < s.best
        if improved:
            s.best, s.best_plan = s.total, s.plan
        if cfg.ratchet == "strict" or cfg.ratchet == "standard" and improved:
            floor = min(RATCHET_FLOOR, cfg.score.tolerance)
            soft = cfg.score.tolerance if progress <= RATCHET_START else cfg.score.tolerance + (floor - cfg.score.tolerance) * min((progress - RATCHET_START) / (1 - RATCHET_START), 1.0)
            dev = float(np.abs(np.bincount(s.plan, weights=x.population, minlength=k) - ideal).max() / ideal)
            s.tolerance = min(s.tolerance, max(soft, dev))
        rows.append({"seq": s.seq, "iteration": s.iteration, "move": move, "proposed": m["total"], "total": s.total, "is_worse": bool(worse), "accepted": bool(accepted), "temperature": s.temperature, "tolerance": s.tolerance, "metrics": dict(s.metrics)})
    return rows


def packed(precincts: DataFrame, edges: DataFrame, geometry: DataFrame | None = None, extrema: DataFrame | None = None, reference: DataFrame | None = None) -> kernel.Arrays:
    """One layer as arrays, on the driver: its precinct ids must be 0 to n - 1. A layer is some ten thousand precincts, whatever the number of plans; one that is too large for every task to hold is an error."""
    n, m = precincts.count(), edges.count()
    if n > MOST_PRECINCTS or m > MOST_EDGES:
        raise ValueError(f"the layer has {n} precincts and {m} edges, more than {MOST_PRECINCTS} or {MOST_EDGES}")
    p = precincts.select("precinct_id", "population", "county_id", "dem_votes", "rep_votes").toPandas().sort_values("precinct_id")
    if (p.precinct_id.to_numpy() != np.arange(len(p))).any():
        raise ValueError("precinct ids must be 0 to n - 1")
    e = edges.select("u", "v", "shared_len", "is_virtual").toPandas().sort_values(["u", "v"])
    more = {}
    if geometry is not None:
        g = geometry.select("precinct_id", "area", "ext_perimeter").toPandas().sort_values("precinct_id")
        more |= {"area": g.area.to_numpy(float), "ext": g.ext_perimeter.to_numpy(float)}
    if extrema is not None:
        d = extrema.toPandas().sort_values(["precinct_id", "dir"])
        more["extrema"] = d[["px", "py", "proj"]].to_numpy(float).reshape(len(p), 16, 3)
    if reference is not None:
        more["reference"] = reference.select("precinct_id", "ref_district").toPandas().sort_values("precinct_id").ref_district.to_numpy()
    return kernel.Arrays(p.population.to_numpy(np.int64), e.u.to_numpy(np.int64), e.v.to_numpy(np.int64), np.unique(p.county_id, return_inverse=True)[1], p.dem_votes.to_numpy(float), p.rep_votes.to_numpy(float), e.is_virtual.to_numpy(bool), e.shared_len.to_numpy(float), **more)


@dataclass(frozen=True)
class Laid:
    """A layer that lies in the shared folder, as tables in any order; tasks read it for themselves, and the driver holds nothing of it."""

    path: str

    def load(self) -> tuple[kernel.Arrays, np.ndarray | None]:
        """Its arrays, and the plan to start from if there is one."""
        return _loaded(self.path)


def laid(precincts: DataFrame, edges: DataFrame, score: ScoreConfig, geometry: DataFrame | None = None, extrema: DataFrame | None = None, reference: DataFrame | None = None, start: DataFrame | None = None) -> Laid:
    """As packed, but for layers of any size; of geometry, extrema and reference only what the score weighs. start: (precinct_id, district)."""
    spark = precincts.sparkSession
    large = districts.is_large(precincts)
    path = f"{graph.shared_dir(spark)}/layer-{uuid.uuid4().hex}"
    compact = score.weight_polsby_popper or score.weight_reock or score.weight_compactness
    p = precincts.select("precinct_id", "population", "county_id", "dem_votes", "rep_votes")
    more = []
    if geometry is not None and compact:
        more.append(geometry.select("precinct_id", "area", "ext_perimeter"))
    if extrema is not None and (score.weight_reock or score.weight_compactness):
        points = F.sort_array(F.collect_list(F.struct("dir", "px", "py", "proj")))
        more.append(extrema.groupBy("precinct_id").agg(F.flatten(F.transform(points, lambda q: F.array(q["px"], q["py"], q["proj"]))).alias("extrema")))
    if reference is not None and score.weight_alignment:
        more.append(reference.select("precinct_id", "ref_district"))
    if start is not None:
        more.append(start.select("precinct_id", F.col("district").cast("long").alias("start")))
    for t in more:
        p = districts.sorted_joins(p, large).join(t, "precinct_id", "left")
    p.write.parquet(f"{path}/precincts")
    edges.select("u", "v", "shared_len", "is_virtual").write.parquet(f"{path}/edges")
    ids = spark.read.parquet(f"{path}/precincts").agg(F.count("*"), F.count_distinct("precinct_id"), F.min("precinct_id"), F.max("precinct_id")).first()
    n = ids[0]
    if n and (ids[1] != n or ids[2] != 0 or ids[3] != n - 1):
        raise ValueError("precinct ids must be 0 to n - 1")
    return Laid(path)


def _room(shape: tuple[int, ...], kind) -> np.ndarray:
    """An array to fill. A large one is mapped from a file without a name, which goes with the process: a layer's columns lie on the disk, and the system keeps of them what is in use."""
    kind = np.dtype(kind)
    if math.prod(shape) * kind.itemsize < MAPPED:
        return np.empty(shape, kind)
    with tempfile.TemporaryFile() as f:
        os.posix_fallocate(f.fileno(), 0, math.prod(shape) * kind.itemsize)  # a full disk is an error here, and not when a page is written
        return np.asarray(np.memmap(f, kind, "r+", shape=shape))


def _moved(a: np.ndarray, kind, order: np.ndarray | None = None) -> np.ndarray:
    """a, or a[order], as another type, in blocks."""
    if order is None and a.dtype == kind:
        return a
    out = _room(a.shape, kind)
    for at in range(0, len(a), kernel.BLOCK):
        own = slice(at, at + kernel.BLOCK)
        out[own] = a[own if order is None else order[own]]
    return out


def _columns(path: str, by: str | None = None) -> dict[str, np.ndarray]:
    """A table's columns, read in batches into arrays of their length; lists of one length make a row each. by: a column that gives each row's place."""
    disk, root = opened(path)
    names = sorted(x.path for x in disk.get_file_info(fs.FileSelector(root)) if x.path.endswith(".parquet"))
    out, at, n = {}, 0, 0
    for name in names:
        with disk.open_input_file(name) as f:
            n += parquet.ParquetFile(f).metadata.num_rows
    for name in names:
        with disk.open_input_file(name) as f:
            for batch in parquet.ParquetFile(f).iter_batches():
                place = slice(at, at + len(batch)) if by is None else batch.column(by).to_numpy()
                for c, v in zip(batch.schema.names, batch.columns):
                    lists = pa.types.is_list(v.type)
                    own = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) if lists else v.to_numpy(zero_copy_only=False)
                    if c not in out:
                        # A list's column is contiguous, whichever rows are taken of it.
                        out[c] = _room((*own.shape[:0:-1], n), own.dtype).T
                    elif out[c].dtype != own.dtype:  # nulls make numbers doubles
                        was, out[c] = out[c], _room(out[c].shape[::-1], np.promote_types(out[c].dtype, own.dtype)).T
                        out[c][:] = was
                    out[c][place] = own
                at += batch.num_rows
    return out


@lru_cache(maxsize=1)
def _loaded(path: str) -> tuple[kernel.Arrays, np.ndarray | None]:
    p = _columns(f"{path}/precincts", "precinct_id")
    e = _columns(f"{path}/edges")
    small = np.int32 if not p or len(p["precinct_id"]) < 2**31 else np.int64
    order = np.lexsort((e["v"], e["u"])) if e else np.zeros(0, np.int64)
    edge = lambda c, kind: _moved(e.pop(c), kind, order) if c in e else np.zeros(0, kind)
    own = lambda c, kind: _moved(p.pop(c), kind) if c in p else None
    county = np.unique(p.pop("county_id"), return_inverse=True)[1]
    if county.nbytes >= MAPPED:
        county = _moved(county, np.int64, np.arange(len(county)))
    points = own("extrema", float)
    more = {"area": own("area", float), "ext": own("ext_perimeter", float), "reference": own("ref_district", np.int64), "extrema": None if points is None else points.T.reshape(-1, 3, len(county)).transpose(2, 0, 1)}
    x = kernel.Arrays(own("population", np.int64), edge("u", small), edge("v", small), county, own("dem_votes", float), own("rep_votes", float), edge("is_virtual", bool), edge("shared_len", float), **more)
    start = own("start", np.int64)
    pa.default_memory_pool().release_unused()  # the files' batches
    return x, start


def held(spark, layer: kernel.Arrays | Laid, start: np.ndarray | None = None):
    """What gives a task the layer's arrays and the plan to start from: from the shared folder, or, for arrays that the driver has already, from a broadcast."""
    if isinstance(layer, Laid):
        return layer.load
    sent = spark.sparkContext.broadcast((layer, None if start is None else np.asarray(start)))
    return lambda: sent.value


def _chains(spark, n: int) -> DataFrame:
    return spark.range(0, n, 1, min(n, 10_000)).withColumnRenamed("id", "chain_id")


def run(spark, layer: kernel.Arrays | Laid, cfg: ChainConfig, chains: int, output: str = "history", start: np.ndarray | None = None, every: int = 1) -> DataFrame:
    """`history`: a row for each scored proposal of each chain. `plans`: the plan a chain stands at after every `every`-th iteration, its first and
    last included. `best`: each chain's best plan."""
    given = held(spark, layer, start)

    def one(chain_id: int) -> Iterator[pd.DataFrame]:
        x, first = given()
        s = begin(x, cfg, chain_id, first)
        if s is None:
            return
        here = lambda total, plan: pd.DataFrame({"chain_id": [chain_id], "iteration": [s.iteration], "total": [total], "plan": [plan.astype(np.int32)]})
        if output == "plans":
            yield here(s.total, s.plan)
        while s.iteration < cfg.iterations:
            rows = advance(x, cfg, s, every if output == "plans" else BLOCK)
            if output == "history":
                yield pd.DataFrame(rows).assign(chain_id=chain_id)
            elif output == "plans":
                yield here(s.total, s.plan)
        if output == "best":
            yield here(s.best, s.best_plan)

    schema = HISTORY if output == "history" else PLANS
    names = [c.split(" ")[0] for c in schema.replace("map<string,double>", "map").split(", ")]

    def each(batches):
        for pdf in batches:
            for c in pdf["chain_id"]:
                for got in one(int(c)):
                    if len(got):
                        yield got[names]

    return _chains(spark, chains).repartition(max(1, min(chains, 10_000)), "chain_id").mapInPandas(each, schema)


def initial_plans(spark, layer: kernel.Arrays | Laid, cfg: ChainConfig, chains: int) -> DataFrame:
    """(chain_id, precinct_id, district): a carved plan for each chain."""
    return assignments(run(spark, layer, replace(cfg, iterations=0), chains, "plans")).select("chain_id", "precinct_id", "district")


def assignments(plans: DataFrame) -> DataFrame:
    """Plans as rows (chain_id, iteration, precinct_id, district)."""
    return plans.select("chain_id", "iteration", F.posexplode("plan").alias("precinct_id", "district")).withColumn("precinct_id", F.col("precinct_id").cast("long"))
