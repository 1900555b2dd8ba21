"""Numeric functions that Spark lacks, as Column expressions that stay in the JVM."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Hart's rational approximation of the normal distribution function as published by West (2005), highest power first.
HART_TOP = (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_LOW = (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
HART_CUT, HART_ROOT = 7.07106781186547, 2.506628274631


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _horner(x: Column, coefficients) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_cdf(x: Column) -> Column:
    """The normal distribution function, within 3e-16; null for null."""

    def of(v: Column) -> Column:
        a = F.abs(v)
        e = F.exp(-a * a / 2.0)
        tail = a + 0.65
        for k in (4.0, 3.0, 2.0, 1.0):
            tail = a + F.lit(k) / tail
        upper = F.when(a > 37.0, F.lit(0.0)).when(a < HART_CUT, e * _horner(a, HART_TOP) / _horner(a, HART_LOW)).otherwise(e / tail / HART_ROOT)
        return F.when(v > 0, 1.0 - upper).otherwise(upper)

    return let(x.cast("double"), of)


def normal_cdf_sql(x: str, double: str = "::DOUBLE") -> str:
    """The same as SQL text. double: what marks a literal as a double."""
    n = lambda v: f"{v!r}{double}"

    def horner(cs):
        out = n(cs[0])
        for c in cs[1:]:
            out = f"({out}*abs({x})+{n(c)})"
        return out

    tail = f"(abs({x})+{n(0.65)})"
    for k in (4.0, 3.0, 2.0, 1.0):
        tail = f"(abs({x})+{n(k)}/{tail})"
    e = f"exp(-abs({x})*abs({x})/{n(2.0)})"
    upper = f"(CASE WHEN abs({x})>{n(37.0)} THEN {n(0.0)} WHEN abs({x})<{n(HART_CUT)} THEN {e}*{horner(HART_TOP)}/{horner(HART_LOW)} ELSE {e}/{tail}/{n(HART_ROOT)} END)"
    return f"(CASE WHEN {x}>0 THEN {n(1.0)}-{upper} ELSE {upper} END)"


def normal_inverse(p: float) -> float:
    return NormalDist().inv_cdf(p)


def hermite_nodes(n: int = 17) -> list[tuple[float, float]]:
    """Nodes and weights of the probabilists' Gauss-Hermite rule; the weights sum to the root of 2 pi."""
    x, w = np.polynomial.hermite_e.hermegauss(n)
    return list(zip(x.tolist(), w.tolist()))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def mean(xs: Column) -> Column:
    return total(xs) / F.size(xs)


def median(xs: Column) -> Column:
    def of(s: Column) -> Column:
        n = F.size(s)
        return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0

    return let(F.sort_array(xs), of)


def win_counts(ps: Column) -> Column:
    """Poisson-binomial: the chances of exactly 0 to n wins, of independent chances ps."""
    k = F.size(ps)
    start = F.transform(F.sequence(F.lit(0), k), lambda i: F.when(i == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return F.aggregate(ps, start, lambda a, p: F.transform(a, lambda x, i: x * (1.0 - p) + F.when(i > 0, F.get(a, i - 1) * p).otherwise(F.lit(0.0))))


def tail(counts: Column, least: Column | int) -> Column:
    """The chance of `least` wins or more."""
    least = F.lit(least) if isinstance(least, int) else least
    return total(F.filter(counts, lambda x, i: i >= least))


def register(spark: SparkSession) -> None:
    """normal_cdf as an SQL function, which Spark inlines."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION normal_cdf(x DOUBLE) RETURNS DOUBLE RETURN {normal_cdf_sql('x', 'D')}")
