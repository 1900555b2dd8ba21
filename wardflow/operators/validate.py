"""Checks of layers and plans. Spark counts; the driver reads one row of counts and words the messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.functions import geometry
from wardflow.operators.graph import pieces

# Lower-cased names by which a column's role is guessed, in order of preference.
POPULATION = ("population", "pop", "total_pop", "totpop", "pop100", "p0010001", "p001001", "pop_total")
PRECINCT = ("geoid20", "geoid", "vtdid", "vtd", "precinct_id", "id", "gid", "objectid")
COUNTY = ("cty", "county", "countyfp20", "countyfp", "county20", "cntyfp", "cntyfp20", "cty_code", "cntyvtd", "countyfips", "co_fips")
ELECTION = (("baseline_d", "baseline_r"),)
#: Names under which a layer's counties are looked for, in this order and as they are written.
COUNTY_FIRST = ("CTY", "COUNTYFP20", "COUNTYFP", "COUNTY20", "COUNTY", "county", "CNTYFP", "CNTYFP20", "CTY_CODE", "CNTYVTD", "COUNTYFIPS", "CO_FIPS")
SHOWN = 10


def numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def hint(df: DataFrame, names: tuple, numbers: bool = False) -> str | None:
    """The first column, in the file's order, whose lower-cased name is known."""
    return next((c for c in df.columns if c.lower() in names and (not numbers or numeric(df, c))), None)


def with_county_codes(df: DataFrame, column: str | None = None) -> DataFrame:
    """df with county_code, 0, 1 and so on in the order of the county column's values (its own, or the first of COUNTY_FIRST that df has); df as it is without one."""
    from pyspark.sql import Window as W

    column = column or next((c for c in COUNTY_FIRST if c in df.columns), None)
    if column is None:
        return df
    # The values are a state's counties: a window over them is small. Spark chooses how to join.
    codes = df.select(F.col(f"`{column}`").alias("_county")).distinct().withColumn("county_code", (F.row_number().over(W.orderBy("_county")) - 1).cast("int"))
    return df.drop("county_code").join(codes, F.col(f"`{column}`").eqNullSafe(F.col("_county"))).drop("_county")


def election_hint(df: DataFrame) -> tuple[str, str] | None:
    by = {c.lower(): c for c in df.columns}
    return next(((by[d], by[r]) for d, r in ELECTION if d in by and r in by and numeric(df, by[d]) and numeric(df, by[r])), None)


def coerced(df: DataFrame) -> DataFrame:
    """Text columns whose values all read as numbers become numbers, unless one begins with 0 and a digit."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    rule = [F.coalesce(F.bool_and(F.col(f"`{c}`").isNull() | F.col(f"`{c}`").try_cast("double").isNotNull()) & ~F.bool_or(F.coalesce(F.trim(F.col(f"`{c}`")).rlike(r"^0\d"), F.lit(False))) & (F.count(f"`{c}`") > 0), F.lit(False)).alias(c) for c in texts]
    row = df.agg(*rule).first()
    return df.withColumns({c: F.col(f"`{c}`").try_cast("double") for c in texts if row[c]})


def padded(df: DataFrame, column: str, width: int) -> DataFrame:
    """An integer id column as text of the field's width, where that is more than its digits and those are no standard length; else ids of a
    GEOID-like name one short of a standard length get one zero."""
    if not isinstance(df.schema[column].dataType, (T.IntegerType, T.LongType)):
        return df
    digits = df.agg(F.max(F.length(F.col(column).cast("string")))).first()[0] or 0
    standard = (5, 11, 12, 15)
    to = width if width > digits and digits not in standard else digits + 1 if "geoid" in column.lower() and digits + 1 in standard else None
    return df if to is None else df.withColumn(column, F.lpad(F.col(column).cast("string"), to, "0"))


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row for each column: type, distinct values, nulls, sum and least value (null for text), all from one aggregate."""
    columns = [f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.BinaryType, T.StructType, T.MapType))] if columns is None else columns

    def one(c: str):
        num = numeric(df, c)
        v = F.col(f"`{c}`")
        return F.struct(F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("type"), F.count_distinct(v).alias("distinct"), F.count_if(v.isNull()).alias("nulls"), (F.sum(v.cast("double")) if num else F.lit(None).cast("double")).alias("sum"), (F.min(v.cast("double")) if num else F.lit(None).cast("double")).alias("least"))

    return df.agg(F.array(*[one(c) for c in columns]).alias("x")).select(F.inline("x"))


def geometry_counts(layer: DataFrame) -> DataFrame:
    """One row: rows, valid, null, of a wrong type, without area. rings: null for no geometry, empty for a type other than polygons."""
    r = F.col("rings")
    flat = F.coalesce(geometry.area(r) <= 0, F.lit(False))
    return layer.agg(F.count("*").alias("n"), F.count_if(r.isNotNull() & (F.size(r) > 0) & ~flat).alias("valid"), F.count_if(r.isNull()).alias("null_geometry"), F.count_if(F.size(r) == 0).alias("wrong_type"), F.count_if((F.size(r) > 0) & flat).alias("zero_area"))


def geometry_issues(layer: DataFrame) -> list[str]:
    c = geometry_counts(layer).first()
    said = {"null_geometry": "rows have no geometry", "wrong_type": "rows are not polygons", "zero_area": "polygons have no area"}
    return [f"{c[k]} of {c['n']} {v}." for k, v in said.items() if c[k]]


def column_issues(df: DataFrame, population: str | None, votes: list[tuple[str, str]] = (), county: str | None = None) -> list[str]:
    """What is wrong with the chosen columns; the population must be there, and numbers must be whole, not negative, and more than 0 in sum."""
    asked = [("Population", population), *[("Vote", c) for pair in votes for c in pair if c]]
    there = [c for c in dict.fromkeys([*[c for _, c in asked], county]) if c and c in df.columns]
    rows = {r["column"]: r for r in profile(df, there).collect()} if there else {}
    out = [] if population else ["A population column is required."]
    for role, c in asked:
        if not c:
            continue
        if c not in rows:
            out.append(f"{role} column {c!r} is not in the layer.")
        elif not numeric(df, c):
            out.append(f"{role} column {c!r} is not numeric ({rows[c]['type']}).")
        else:
            r = rows[c]
            out += [f"{role} column {c!r} has {r['nulls']} empty values."] * bool(r["nulls"]) + [f"{role} column {c!r} has negative values (least {r['least']:g})."] * (r["least"] is not None and r["least"] < 0)
            out += [f"{role} column {c!r} sums to {r['sum']:g}."] * (r["sum"] is not None and r["sum"] <= 0)
    if county and county not in rows:
        out.append(f"County column {county!r} is not in the layer.")
    elif county and rows[county]["distinct"] <= 1:
        out.append(f"County column {county!r} has {rows[county]['distinct']} value.")
    return out


def first_issue(layer: DataFrame, population: str | None, precinct: str | None, votes: list[tuple[str, str]] = (), county: str | None = None) -> str | None:
    """What a user is told who wants to use a layer: the first thing that is wrong, in the order of choices, geometry and columns; None: it can be used."""
    if not population:
        return "Choose a population column."
    if not precinct:
        return "Choose a precinct id column."
    return next(iter(geometry_issues(layer) or column_issues(layer, population, list(votes), county)), None)


def connectivity_issue(components: DataFrame) -> str | None:
    """components: (node, component). The mainland is the component of most precincts; at most SHOWN rows of others are named."""
    sizes = components.groupBy("component").agg(F.count("*").alias("n"))
    top = sizes.orderBy(F.desc("n"), "component").first()
    row = sizes.agg(F.count("*").alias("parts"), F.sum("n").alias("n")).first()
    if row["parts"] <= 1:
        return None
    some = [r["node"] for r in components.where(F.col("component") != top["component"]).orderBy("node").limit(SHOWN).collect()]
    rest = row["n"] - top["n"]
    said = ", ".join(map(str, some)) + (f", ... and {rest - SHOWN} more" if rest > SHOWN else "")
    return f"The graph has {row['parts']} components: a mainland of {top['n']} precincts and {row['parts'] - 1} others of {rest} (rows: {said})."


def id_mismatch(plan: DataFrame, precincts: DataFrame, key: str) -> DataFrame:
    """(side, id): ids of the layer that the plan lacks (missing) and of the plan that the layer lacks (extra), as trimmed text."""
    a = precincts.select(F.trim(F.col("precinct_key").cast("string")).alias("id")).distinct()
    b = plan.select(F.trim(F.col(key).cast("string")).alias("id")).distinct()
    return a.join(b, "id", "left_anti").select(F.lit("missing").alias("side"), "id").unionByName(b.join(a, "id", "left_anti").select(F.lit("extra").alias("side"), "id"))


class PlanError(ValueError):
    """A plan that can't be used; its text says why."""


def load_plan(plan: DataFrame, precincts: DataFrame, edges: DataFrame, key: str, district: str, k: int, tolerance: float) -> DataFrame:
    """(plan_id 0, precinct_id, district 0 to k-1) of a plan's rows; PlanError unless rows and ids agree, the labels are 0 to k-1 or 1 to k, all districts
    are in one piece (virtual edges connect) and within the tolerance."""
    n, m = plan.count(), precincts.count()
    if n != m:
        raise PlanError(f"The plan has {n} rows, the layer {m} precincts.")
    bad = id_mismatch(plan, precincts, key)
    if counts := {r["side"]: r["n"] for r in bad.groupBy("side").agg(F.count("*").alias("n")).collect()}:
        some = {s: [r["id"] for r in bad.where(F.col("side") == s).orderBy("id").limit(3).collect()] for s in counts}
        raise PlanError("; ".join(f"{counts[s]} ids {s} (such as {some[s]})" for s in sorted(counts)))
    d = F.col(district).try_cast("long")
    row = plan.agg(F.count_if(d.isNull()).alias("none"), F.count_distinct(d).alias("n"), F.min(d).alias("lo"), F.max(d).alias("hi")).first()
    if row["none"]:
        raise PlanError(f"{row['none']} districts are empty or no numbers.")
    if row["n"] != k:
        raise PlanError(f"The plan has {row['n']} districts, the run {k}.")
    if (row["lo"], row["hi"]) not in ((1, k), (0, k - 1)):
        raise PlanError(f"Districts should be 1 to {k} or 0 to {k - 1}, not {row['lo']} to {row['hi']}.")
    out = plan.select(F.trim(F.col(key).cast("string")).alias("id"), (d - row["lo"]).cast("int").alias("district"))
    out = out.join(precincts.select("precinct_id", F.trim(F.col("precinct_key").cast("string")).alias("id")), "id").select(F.lit(0).cast("long").alias("plan_id"), "precinct_id", "district")
    check_plan(out, precincts, edges, k, tolerance)
    return out


def check_plan(assignments: DataFrame, precincts: DataFrame, edges: DataFrame, k: int, tolerance: float) -> None:
    """Contiguity and population of one plan; raises PlanError. To be run again when k or the tolerance have changed."""
    apart = pieces(assignments, edges).where("pieces > 1").orderBy("district").first()
    if apart:
        raise PlanError(f"District {apart['district'] + 1} is in {apart['pieces']} pieces.")
    from wardflow.operators.districts import totals

    worst = totals(assignments, precincts, k).withColumn("dev", F.abs(F.col("population") - F.col("ideal")) / F.col("ideal")).orderBy(F.desc("dev"), "district").first()
    if worst["dev"] is None:
        raise PlanError("The layer has no population.")
    if worst["dev"] > tolerance:
        raise PlanError(f"District {worst['district'] + 1} is {worst['dev']:.2%} off, more than {tolerance:.2%}.")


def plan_checks(assignments: DataFrame, precincts: DataFrame, edges: DataFrame, k: int, tolerance: float) -> DataFrame:
    """For each of many plans: labels_ok, districts in pieces, max_deviation, and whether it is valid."""
    from wardflow.operators.districts import totals

    labels = assignments.groupBy("plan_id").agg(F.count_distinct("district").alias("n"), F.min("district").alias("lo"), F.max("district").alias("hi"))
    broken = pieces(assignments, edges).groupBy("plan_id").agg(F.count_if(F.col("pieces") > 1).alias("broken"))
    dev = totals(assignments, precincts, k).groupBy("plan_id").agg(F.max(F.abs(F.col("population") - F.col("ideal")) / F.col("ideal")).alias("max_deviation"))
    x = labels.join(broken, "plan_id").join(dev, "plan_id")
    ok = (F.col("n") == k) & (F.col("lo") == 0) & (F.col("hi") == k - 1)
    return x.select("plan_id", ok.alias("labels_ok"), "broken", "max_deviation", (ok & (F.col("broken") == 0) & (F.col("max_deviation") <= tolerance)).alias("valid"))
