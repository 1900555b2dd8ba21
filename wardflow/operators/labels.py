"""District numbers and colours: by place, by a tour of neighbours, from a reference plan, or stable from an initial one.

Sums are DataFrame aggregates; what is greedy or a matching runs once for each plan over k x k numbers (applyInPandas), never over precincts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardflow.operators.districts import spine

OUT = "plan_id long, district int, label int"
#: Districts that a reference plan may have: their labels are held by the driver and by each task.
MOST_LABELS = 100_000


def centroids(assignments: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """(plan_id, district, cx, cy): population-weighted; null for a district without population. points: (precinct_id, cx, cy, population)."""
    g = assignments.join(points, "precinct_id").groupBy("plan_id", "district").agg(F.sum("population").alias("w"), F.sum(F.col("population") * F.col("cx")).alias("x"), F.sum(F.col("population") * F.col("cy")).alias("y"))
    at = lambda c: F.when(F.col("w") > 0, F.col(c) / F.col("w"))
    return spine(assignments, k).join(g.select("plan_id", "district", at("x").alias("cx"), at("y").alias("cy")), ["plan_id", "district"], "left")


def geographic(c: DataFrame, rule: str = "nw_se") -> DataFrame:
    """Labels 1 to k by the north-west to south-east diagonal, or from north to south (ties: west first), then by index; empty districts last."""
    if rule not in ("nw_se", "n_s"):
        raise ValueError(f"districts can't be numbered by {rule!r}")
    plan = W.partitionBy("plan_id")

    def unit(a: str):
        lo, hi = F.min(a).over(plan), F.max(a).over(plan)
        return F.when(hi > lo, (F.col(a) - lo) / (hi - lo)).otherwise(F.when(F.col(a).isNotNull(), 0.0))

    c = c.withColumn("nx", unit("cx")).withColumn("ny", unit("cy"))
    order = [(F.col("ny") + (1.0 - F.col("nx"))).desc_nulls_last()] if rule == "nw_se" else [F.col("ny").desc_nulls_last(), F.col("nx").asc_nulls_last()]
    return c.select("plan_id", "district", F.row_number().over(plan.orderBy(*order, "district")).alias("label"))


def _tour(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("district").reset_index(drop=True)
    xy = pdf[["cx", "cy"]].to_numpy(float)
    here = np.flatnonzero(~np.isnan(xy[:, 0]))
    order = []
    if len(here):
        low, size = xy[here].min(0), np.maximum(np.ptp(xy[here], axis=0), 1e-9)
        unit = (xy[here] - low) / size
        at = int(np.argmax(unit[:, 1] + 1.0 - unit[:, 0]))
        free = np.ones(len(here), bool)
        for _ in here:
            order.append(here[at])
            free[at] = False
            d = np.where(free, ((xy[here] - xy[here[at]]) ** 2).sum(1), np.inf)
            at = int(np.argmin(d))
    order += [i for i in range(len(pdf)) if i not in set(order)]
    label = np.empty(len(pdf), int)
    label[order] = np.arange(1, len(pdf) + 1)
    return pd.DataFrame({"plan_id": pdf.plan_id, "district": pdf.district, "label": label})


def proximity(c: DataFrame) -> DataFrame:
    """Labels along a tour that starts in the north-west and goes to the nearest district not yet numbered (ties: lowest index); empty ones last."""
    return c.groupBy("plan_id").applyInPandas(_tour, OUT)


def matching(weight: np.ndarray) -> list[tuple[int, int]]:
    """A matching of rows and columns of the largest total weight (shortest augmenting paths with potentials)."""
    flip = weight.shape[0] > weight.shape[1]
    cost = -(weight.T if flip else weight).astype(float)
    n, m = cost.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for i in range(n):
        dist, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, col, base = i, -1, 0.0
        while True:
            reach = base + cost[row] - u[row] - v
            better = ~done & (reach < dist)
            dist[better], via[better] = reach[better], col
            col = int(np.argmin(np.where(done, np.inf, dist)))
            done[col], base = True, dist[col]
            if owner[col] < 0:
                break
            row = owner[col]
        u[i] += base
        for j in np.flatnonzero(done):
            if owner[j] >= 0:
                u[owner[j]] += base - dist[j]
            v[j] -= base - dist[j]
        while col >= 0:
            before = int(via[col])
            owner[col] = owner[before] if before >= 0 else i
            col = before
    pairs = [(int(owner[j]), j) for j in range(m) if owner[j] >= 0]
    return [(j, i) for i, j in pairs] if flip else pairs


def overlaps(assignments: DataFrame, reference: DataFrame, precincts: DataFrame, weight: str = "population") -> DataFrame:
    """(plan_id, ref_district, ref_label, district, weight)."""
    p = reference.join(precincts.select("precinct_id", F.col(weight).alias("weight")), "precinct_id")
    return assignments.join(p, "precinct_id").groupBy("plan_id", "ref_district", "ref_label", "district").agg(F.sum("weight").alias("weight"))


def inferred(overlap: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """Every district takes the label of the reference district that it is matched to, over all at the largest shared weight; surplus districts take the
    smallest labels that are free. labels: (ref_district, ref_label), few."""
    rows = labels.select("ref_district", "ref_label").distinct().limit(MOST_LABELS + 1).collect()
    if len(rows) > MOST_LABELS:
        raise ValueError(f"the reference plan has more than {MOST_LABELS} districts")
    known = dict((r["ref_district"], r["ref_label"]) for r in rows)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        refs = sorted(known)
        m = np.zeros((len(refs), k))
        at = {r: i for i, r in enumerate(refs)}
        np.add.at(m, (pdf.ref_district.map(at).to_numpy(), pdf.district.to_numpy()), pdf.weight.to_numpy(float))
        got = {p: int(known[refs[a]]) for a, p in matching(m)}
        used, free = set(got.values()), 1
        for p in range(k):
            if p not in got:
                while free in used:
                    free += 1
                got[p] = free
                used.add(free)
        return pd.DataFrame({"plan_id": pdf.plan_id.iloc[0], "district": range(k), "label": [got[p] for p in range(k)]})

    return overlap.groupBy("plan_id").applyInPandas(run, OUT)


def stable(assignments: DataFrame, initial: DataFrame, k: int) -> DataFrame:
    """(plan_id, district, label): colours, 0 to k-1, that follow an initial plan. Districts choose in order of confidence (most less second-most shared
    precincts; ties: higher index first) the colour they share most with (ties: higher index) of those left."""
    both = assignments.join(initial.select("precinct_id", F.col("district").alias("was")), "precinct_id").groupBy("plan_id", "district", "was").agg(F.count("*").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((k, max(k, 2)), int)
        m[pdf.district.to_numpy(), pdf.was.to_numpy()] = pdf.n.to_numpy()
        top = -np.sort(-m, axis=1)
        colour, left = np.arange(k), set(range(k))
        for d in sorted(range(k), key=lambda d: (top[d, 0] - top[d, 1], d), reverse=True):
            best = max(left, key=lambda c: (m[d, c], c))
            colour[d] = best
            left.discard(best)
        return pd.DataFrame({"plan_id": pdf.plan_id.iloc[0], "district": range(k), "label": colour})

    return both.groupBy("plan_id").applyInPandas(run, OUT)


def relabelled(assignments: DataFrame, labels: DataFrame) -> DataFrame:
    """assignments with the label in place of the district. labels: (plan_id, district, label); k rows for a plan."""
    return assignments.join(labels, ["plan_id", "district"]).select("plan_id", "precinct_id", F.col("label").alias("district"))
