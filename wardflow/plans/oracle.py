"""The registered queries in DuckDB SQL, written apart from the Spark code: window and grouped forms where that uses arrays."""

from __future__ import annotations

import math

from wardflow.functions.geometry import DIRECTIONS
from wardflow.functions.numeric import hermite_nodes, normal_cdf_sql
from wardflow.operators.partisan import CMP_KNEE, CMP_POWER, GINI_GRID
from wardflow.operators.reports import BREAKS, COMPACT, DEVIATION, STOPS
from wardflow.plans.config import everything

K = 8
C = everything()
PI, ROOT = f"{math.pi!r}::DOUBLE", f"{math.sqrt(2 * math.pi)!r}::DOUBLE"
SIGMA, SIGMA_D, SIGMA_EG, SWING = (f"{v!r}::DOUBLE" for v in (C.sigma, C.sigma_district, C.sigma_eg, C.swing))
cdf = normal_cdf_sql

BASE = f"""
WITH RECURSIVE size AS (SELECT floor(sqrt(count(*)))::BIGINT AS w FROM customer),
votes AS (SELECT o_custkey, count(*) FILTER (WHERE left(o_orderpriority, 1) IN ('1', '2')) AS d, count(*) FILTER (WHERE left(o_orderpriority, 1) IN ('3', '4')) AS r FROM orders GROUP BY 1),
precincts AS (SELECT c_custkey AS precinct_id, lpad(c_custkey::VARCHAR, 8, '0') AS precinct_key, c_custkey % w AS x, c_custkey // w AS y, c_nationkey AS county_id,
                     floor(c_acctbal)::BIGINT + 2000 AS population, coalesce(d, 0) AS dem_votes, coalesce(r, 0) AS rep_votes, w
              FROM customer CROSS JOIN size LEFT JOIN votes ON o_custkey = c_custkey WHERE c_custkey < w * w),
edges AS (SELECT precinct_id AS u, precinct_id + 1 AS v FROM precincts WHERE x < w - 1 UNION ALL SELECT precinct_id, precinct_id + w FROM precincts WHERE y < w - 1),
snake AS (SELECT precinct_id, coalesce(sum(population) OVER (ORDER BY y * w + CASE WHEN y % 2 = 0 THEN x ELSE w - 1 - x END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(population) OVER () AS total FROM precincts),
assignments AS (SELECT 0::BIGINT AS plan_id, precinct_id, (x * {K} // w)::INT AS district FROM precincts
                UNION ALL SELECT 1, precinct_id, (before * {K} // total)::INT FROM snake
                UNION ALL SELECT p, precinct_id, (((x + p - 2) % w) * {K} // w)::INT FROM precincts, (VALUES (2), (3)) AS t(p)),
reference AS (SELECT precinct_id, (y * 6 // w)::INT AS ref_district, y * 6 // w + 10 AS ref_label FROM precincts),
placed AS (SELECT a.plan_id, a.district, p.* FROM assignments a JOIN precincts p USING (precinct_id)),
districts AS (SELECT plan_id, district, coalesce(sum(population), 0)::BIGINT AS population, coalesce(sum(dem_votes), 0)::BIGINT AS dem_votes, coalesce(sum(rep_votes), 0)::BIGINT AS rep_votes,
                     coalesce(sum(dem_votes + rep_votes), 0)::BIGINT AS votes, CASE WHEN sum(dem_votes + rep_votes) > 0 THEN sum(dem_votes) / sum(dem_votes + rep_votes) ELSE 0.5 END AS share
              FROM (SELECT DISTINCT plan_id FROM assignments) CROSS JOIN (SELECT unnest(range({K}))::INT AS district) LEFT JOIN placed USING (plan_id, district) GROUP BY 1, 2),
ideal AS (SELECT sum(population) / {K} AS ideal, sum(population) AS state, count(DISTINCT county_id) AS counties FROM precincts),
dev AS (SELECT *, abs(population - ideal) / ideal AS dev FROM districts, ideal),
cuts AS (SELECT a.plan_id, u, v, a.district AS du, b.district AS dv FROM edges JOIN assignments a ON a.precinct_id = u JOIN assignments b ON b.precinct_id = v AND b.plan_id = a.plan_id WHERE a.district <> b.district),
matrix AS (SELECT plan_id, county_id, district, sum(population)::BIGINT AS population FROM placed GROUP BY 1, 2, 3 HAVING sum(population) > 0)
"""

STATE = """
, state AS (SELECT plan_id, sum(share * votes) / sum(votes) AS v FROM districts GROUP BY 1)
"""

NODES = (
    STATE
    + f"""
, nodes AS (SELECT * FROM (VALUES {", ".join(f"({i}, {x!r}::DOUBLE, {w!r}::DOUBLE)" for i, (x, w) in enumerate(hermite_nodes()))}) AS t(node, x, wt)),
arg AS (SELECT plan_id, district, node, x, wt, (share - 0.5::DOUBLE) / {SIGMA_D} + x * ({SWING} / {SIGMA_D}) AS z FROM districts, nodes),
chance AS (SELECT *, {cdf("z")} AS p FROM arg),
dp AS (SELECT DISTINCT plan_id, node, x, wt, 0 AS d, [CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FOR i IN range({K + 1})] AS f FROM chance
       UNION ALL SELECT dp.plan_id, dp.node, dp.x, dp.wt, d + 1, [f[i + 1] * (1 - p) + CASE WHEN i > 0 THEN f[greatest(i, 1)] * p ELSE 0 END FOR i IN range({K + 1})]
       FROM dp JOIN chance c ON c.plan_id = dp.plan_id AND c.node = dp.node AND c.district = d WHERE d < {K}),
tails AS (SELECT plan_id, node, x, wt, list_sum(f[5:9]) AS t4, list_sum(f[6:9]) AS t5 FROM dp WHERE d = {K}),
inv AS (SELECT t.*, v, (0.5::DOUBLE - (v + x * {SWING})) / 0.005::DOUBLE AS z FROM tails t JOIN state USING (plan_id)),
major AS (SELECT plan_id, sum(wt * t5) / {ROOT} AS majority_dem, 1 - sum(wt * t4) / {ROOT} AS majority_rep, sum(wt * t4) / {ROOT} AS dem_4,
                 sum(wt * ({cdf("z")} * t5 + (1 - {cdf("z")}) * (1 - t4))) / {ROOT} AS inversion FROM inv GROUP BY 1)
"""
)

#: Win chances of each district at the point estimate, and what is averaged over them.
WIN = (
    STATE
    + f"""
, zs AS (SELECT *, (share - 0.5::DOUBLE) / {SIGMA} AS z, (share - 0.5::DOUBLE) / {SIGMA_EG} AS ze FROM districts),
win AS (SELECT *, {cdf("z")} AS p FROM zs),
est AS (SELECT plan_id, sum(p) AS seats, avg(p) AS est, avg(1 - 4 * (p - 0.5) * (p - 0.5)) AS index, count(*) FILTER (WHERE share > 0.5) / {K}::DOUBLE AS won,
               sum(votes * ((2 * share - 0.5) - {cdf("ze")})) / sum(votes) AS eg, avg(share) - median(share) AS mm FROM win GROUP BY 1)
"""
)

CURVE = f"""
, grid AS (SELECT * FROM (VALUES {", ".join(f"({i}, {v!r}::DOUBLE)" for i, v in enumerate(GINI_GRID))}) AS t(step, vote)),
moved AS (SELECT plan_id, step, vote, share + (vote - v) - 0.5::DOUBLE AS up, share + (1 - vote - v) - 0.5::DOUBLE AS down FROM districts JOIN state USING (plan_id), grid),
moved2 AS (SELECT *, up / {SIGMA} AS zu, down / {SIGMA} AS zd FROM moved),
curve AS (SELECT plan_id, step, vote, avg({cdf("zu")}) AS s_up, avg({cdf("zd")}) AS s_down FROM moved2 GROUP BY 1, 2, 3),
gap AS (SELECT *, abs(s_up - (1 - s_down)) AS g FROM curve),
trap AS (SELECT plan_id, (g + lead(g) OVER (PARTITION BY plan_id ORDER BY step)) * (lead(vote) OVER (PARTITION BY plan_id ORDER BY step) - vote) / 2 AS a FROM gap),
gini AS (SELECT plan_id, 100 * least(1, sum(a) / 0.12) AS partisan_gini FROM trap GROUP BY 1),
even AS (SELECT plan_id, (share + (0.5::DOUBLE - v) - 0.5::DOUBLE) / {SIGMA} AS z FROM districts JOIN state USING (plan_id)),
bias AS (SELECT plan_id, 0.5 - avg({cdf("z")}) AS partisan_bias FROM even GROUP BY 1)
"""

GEO = f"""
, degree AS (SELECT precinct_id, count(e.u) AS n FROM precincts LEFT JOIN edges e ON precinct_id IN (e.u, e.v) GROUP BY 1),
ext AS (SELECT precinct_id, 1.0::DOUBLE AS area, greatest(4.0 - n, 0)::DOUBLE AS ext_perimeter FROM degree),
touch AS (SELECT plan_id, du AS district FROM cuts UNION ALL SELECT plan_id, dv FROM cuts),
touched AS (SELECT plan_id, district, count(*) AS cut FROM touch GROUP BY 1, 2),
pp AS (SELECT d.plan_id, d.district, coalesce(sum(area), 0) AS area, coalesce(sum(ext_perimeter), 0) + coalesce(any_value(cut), 0) AS perimeter
       FROM districts d LEFT JOIN assignments a ON a.plan_id = d.plan_id AND a.district = d.district LEFT JOIN ext USING (precinct_id) LEFT JOIN touched t ON t.plan_id = d.plan_id AND t.district = d.district GROUP BY 1, 2),
pps AS (SELECT plan_id, district, area::DOUBLE AS area, perimeter::DOUBLE AS perimeter, CASE WHEN perimeter > 0 THEN least(1, 4 * {PI} * area / (perimeter * perimeter)) ELSE 1 END AS polsby_popper FROM pp),
dirs AS (SELECT * FROM (VALUES {", ".join(f"({i}, {c!r}::DOUBLE, {s!r}::DOUBLE)" for i, (c, s) in enumerate(DIRECTIONS))}) AS t(dir, c, s)),
corners AS (SELECT precinct_id, (x + a)::DOUBLE AS px, (y + b)::DOUBLE AS py FROM precincts, (VALUES (0, 0), (1, 0), (1, 1), (0, 1)) AS t(a, b)),
proj AS (SELECT precinct_id, dir, px, py, round(px * c + py * s, 9) AS proj FROM corners, dirs),
extrema AS (SELECT * FROM proj QUALIFY row_number() OVER (PARTITION BY precinct_id, dir ORDER BY proj DESC, px, py) = 1),
far AS (SELECT plan_id, district, dir, px, py FROM assignments JOIN extrema USING (precinct_id) QUALIFY row_number() OVER (PARTITION BY plan_id, district, dir ORDER BY proj DESC, precinct_id) = 1),
apart AS (SELECT a.plan_id, a.district, max((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py)) / 4 AS r2 FROM far a JOIN far b ON a.plan_id = b.plan_id AND a.district = b.district GROUP BY 1, 2),
reocks AS (SELECT plan_id, district, CASE WHEN r2 > 0 THEN least(1, area / ({PI} * r2)) ELSE 0 END AS reock FROM pps LEFT JOIN apart USING (plan_id, district)),
means AS (SELECT plan_id, (1 - avg(polsby_popper)) * 100 AS polsby_popper, (1 - avg(reock)) * 100 AS reock FROM pps JOIN reocks USING (plan_id, district) GROUP BY 1)
"""


def band(raw: str, lo: float, hi: float, unclipped: bool) -> str:
    if not unclipped:
        return f"(100 - (greatest({lo}, least({hi}, {raw})) - {lo}) / {hi - lo!r} * 100)"
    knee = lo + 0.85 * (hi - lo)
    power = 100 / (hi - lo) * (0.65 - knee) / 15
    return f"(CASE WHEN {raw} <= {lo} THEN 100 WHEN {raw} <= {knee!r} THEN 100 - ({raw} - {lo}) / {hi - lo!r} * 100 WHEN {raw} >= 0.65 THEN 0 ELSE 15 * pow((0.65 - {raw}) / {0.65 - knee!r}, {power!r}) END)"


def blend(unclipped: bool) -> str:
    return f"0.5 * {band('(1 - reock / 100)', 0.25, 0.5, unclipped)} + 0.5 * {band('(1 - polsby_popper / 100)', 0.1, 0.5, unclipped)}"


def fair(x: str, bound: float) -> str:
    return f"100 * least(1, abs({x}) / {bound})"


def favor_dem(x: str, b: float) -> str:
    return f"100 * greatest(0, least(1, ({x} + {b}) / {2 * b}))"


def favor_rep(x: str, b: float) -> str:
    return f"greatest(0, least(1, ({b} - {x}) / {2 * b}))"


SPLITS = """
, counties AS (SELECT county_id, sum(population)::BIGINT AS population, ceil(sum(population) / any_value(ideal))::BIGINT AS allowance, floor(sum(population) / greatest(any_value(ideal) * (1 - 0.05::DOUBLE), 1))::BIGINT AS max_clean FROM precincts, ideal GROUP BY 1),
parts AS (SELECT plan_id, county_id, count(*) AS n FROM matrix GROUP BY 1, 2),
excess AS (SELECT plan_id, sum(greatest(0, n - allowance))::BIGINT AS excess_splits FROM parts JOIN counties USING (county_id) GROUP BY 1),
unified AS (SELECT plan_id, count(*) FILTER (WHERE n = 1) AS unified_districts FROM (SELECT plan_id, district, count(*) AS n FROM matrix GROUP BY 1, 2) GROUP BY 1),
splits AS (SELECT plan_id, excess_splits, excess_splits * 10.0::DOUBLE AS county_excess, unified_districts, (SELECT sum(max_clean) FROM counties)::BIGINT AS max_unified,
                  ((SELECT sum(max_clean) FROM counties) - unified_districts) * 10.0::DOUBLE AS county_unified FROM excess JOIN unified USING (plan_id)),
sized AS (SELECT m.*, sum(population) OVER (PARTITION BY plan_id, county_id) AS cp, sum(population) OVER (PARTITION BY plan_id, district) AS dp FROM matrix m),
by_c AS (SELECT plan_id, any_value(cp) AS size, sum(CASE WHEN population <> dp THEN sqrt(population / cp) ELSE 0 END) AS s, sum(CASE WHEN population = dp THEN population ELSE 0 END) AS f FROM sized GROUP BY plan_id, county_id),
by_d AS (SELECT plan_id, any_value(dp) AS size, sum(CASE WHEN population <> cp THEN sqrt(population / dp) ELSE 0 END) AS s, sum(CASE WHEN population = cp THEN population ELSE 0 END) AS f FROM sized GROUP BY plan_id, district),
raw AS (SELECT plan_id, c AS raw_county, d AS raw_district, 22.5 * greatest(0, c - 1) + 22.5 * greatest(0, d - 1) AS congruence
        FROM (SELECT plan_id, sum(size / state * (s + sqrt(f / size))) AS c FROM by_c, ideal GROUP BY 1) JOIN (SELECT plan_id, sum(size / state * (s + sqrt(f / size))) AS d FROM by_d, ideal GROUP BY 1) USING (plan_id)),
best AS (SELECT counties AS n, (least(counties, 8) - 1) / greatest(counties, 8) * 1.2 + (1 - (least(counties, 8) - 1) / greatest(counties, 8)) * 1.0 AS b FROM ideal),
refs AS (SELECT CASE WHEN n > 8 THEN b ELSE 1.2 END AS rc, CASE WHEN n > 8 THEN 1.2 ELSE b END AS rd FROM best),
clip AS (SELECT plan_id, 0.2 * (50 * greatest(0, least(1, (raw_county - rc) / (rc * 1.33 - rc))) + 50 * greatest(0, least(1, (raw_district - rd) / (rd * 1.33 - rd)))) AS clipped FROM raw, refs)
"""


def aligned(weight: str, where: str = "true") -> str:
    return f"""
, own AS (SELECT ref_district, sum({weight}) AS mass FROM precincts JOIN reference USING (precinct_id) GROUP BY 1 HAVING sum({weight}) > 0 AND {where}),
over AS (SELECT plan_id, ref_district, district, sum({weight}) AS part FROM placed JOIN reference USING (precinct_id) GROUP BY 1, 2, 3),
coh AS (SELECT plan_id, ref_district, any_value(mass) AS mass, sum((part / mass) * (part / mass)) AS c FROM over JOIN own USING (ref_district) GROUP BY 1, 2),
align0 AS (SELECT plan_id, 100 * sum(mass * (1 - c)) / sum(mass) AS a, 100 * min(c) AS m FROM coh GROUP BY 1),
align AS (SELECT plan_id, coalesce(a, 0) AS alignment, coalesce(m, 100) AS alignment_min, coalesce(100 - a, 100) AS alignment_mean FROM (SELECT DISTINCT plan_id FROM assignments) LEFT JOIN align0 USING (plan_id))
"""


PROP = """
, gaps AS (SELECT plan_id, v, est, est - v AS s, abs(v - 0.5) AS extra, CASE WHEN v >= 0.5 THEN est - v ELSE v - est END AS over FROM est JOIN state USING (plan_id)),
mag AS (SELECT *, 100 * least(1, CASE WHEN over <= 0 THEN -over WHEN over <= extra THEN 0.25 * over ELSE 0.25 * extra + (over - extra) END / 0.42) AS m FROM gaps),
prop AS (SELECT plan_id, m * (1 - inversion) + 100 * inversion AS penalty, inversion, -s AS gap FROM mag JOIN major USING (plan_id))
"""
COMPETE = f"CASE WHEN index <= {CMP_KNEE!r} THEN 100 - index / 0.75 * 100 ELSE 25 * pow((1 - index) / {1 - CMP_KNEE!r}, {CMP_POWER!r}) END"
TOTAL = f"""
, cutn AS (SELECT plan_id, count(*) AS cut_edges FROM cuts GROUP BY 1),
popd AS (SELECT plan_id, sum(dev * dev) * 100000 / {K} AS pop_deviation FROM dev GROUP BY 1),
all_scores AS (SELECT plan_id, cut_edges, county_excess, county_unified, congruence, polsby_popper, reock, {blend(True)} AS compactness, pop_deviation, alignment, mm AS mean_median, eg AS efficiency_gap, seats AS dem_seats,
       partisan_bias, partisan_gini, penalty AS proportionality, prop.inversion AS inversion_chance, {COMPETE} AS competitiveness, majority_dem, majority_rep, dem_4 AS hinge_chance
       FROM cutn JOIN splits USING (plan_id) JOIN raw USING (plan_id) JOIN means USING (plan_id) JOIN popd USING (plan_id) JOIN align USING (plan_id) JOIN est USING (plan_id)
       JOIN bias USING (plan_id) JOIN gini USING (plan_id) JOIN prop USING (plan_id) JOIN major USING (plan_id)),
adds AS (SELECT *, {fair("mean_median", 0.2)} AS mm_p, {fair("efficiency_gap", 0.35)} AS eg_p, {fair("partisan_bias", 0.25)} AS bias_p, greatest(0, least(100, ({K} - dem_seats) / {K} * 100)) AS seats_p,
         100 * pow(1 - majority_dem, 1.5) AS md_p, 100 * pow(1 - majority_rep, 1.5) AS mr_p, 100 * pow(1 - hinge_chance, 1.5) AS h_p FROM all_scores),
summed AS (SELECT *, cut_edges + county_excess + county_unified + congruence + polsby_popper + reock + compactness + pop_deviation + alignment + mm_p + eg_p + bias_p + partisan_gini + seats_p + proportionality + competitiveness + md_p + mr_p + h_p AS total FROM adds)
"""
SCORED = BASE + WIN + NODES.replace(STATE, "") + CURVE + GEO + SPLITS + aligned("population") + PROP + TOTAL

HISTORY = """
WITH h AS (SELECT user_id::BIGINT AS chain_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, value AS total, event_type IN ('error', 'click', 'view') AS is_worse, event_type <> 'error' AS accepted,
                  count(*) OVER (PARTITION BY user_id) AS n FROM events)
"""


def six(select: str, *doubles: str) -> str:
    """The select with these columns rounded as the queries round them."""
    return f"SELECT * REPLACE ({', '.join(f'round({c}::DOUBLE, 6) AS {c}' for c in doubles)}) FROM ({select})"


def buckets(share: str) -> str:
    return f"(len(list_filter([{', '.join(map(str, BREAKS))}], lambda b: b <= least(greatest({share}, 0), 1))) - 1)::INT"


METRICS = f"""
, mx AS (SELECT d.*, d.votes AS vt, ideal, coalesce(cut, 0) AS cut, polsby_popper AS pp, reock AS rk, (share - 0.5::DOUBLE) / {SIGMA} AS z,
               (SELECT count(DISTINCT county_id) FROM placed p WHERE p.plan_id = d.plan_id AND p.district = d.district) AS counties
        FROM districts d JOIN pps USING (plan_id, district) JOIN reocks USING (plan_id, district) LEFT JOIN touched USING (plan_id, district), ideal)
"""
CENTRES = """
, cent AS (SELECT plan_id, district, sum(population * (x + 0.5)) / sum(population) AS cx, sum(population * (y + 0.5)) / sum(population) AS cy FROM placed GROUP BY 1, 2),
spine AS (SELECT plan_id, district, cx, cy FROM districts LEFT JOIN cent USING (plan_id, district)),
unit AS (SELECT *, CASE WHEN max(cx) OVER p > min(cx) OVER p THEN (cx - min(cx) OVER p) / (max(cx) OVER p - min(cx) OVER p) WHEN cx IS NOT NULL THEN 0 END AS nx,
                CASE WHEN max(cy) OVER p > min(cy) OVER p THEN (cy - min(cy) OVER p) / (max(cy) OVER p - min(cy) OVER p) WHEN cy IS NOT NULL THEN 0 END AS ny FROM spine WINDOW p AS (PARTITION BY plan_id))
"""
CORNER = "SELECT u, v FROM edges, size WHERE (u IN (0, 1, w, w + 1)) = (v IN (0, 1, w, w + 1))"


def tanh(x: str) -> str:
    return f"((exp(2 * ({x})) - 1) / (exp(2 * ({x})) + 1))"


def flip(p: str, midpoint: float) -> str:
    low, high = (midpoint, 1 - midpoint) if 0 < midpoint < 1 else (1.0, 1.0)
    at = min(max(midpoint, 0.0), 1.0)
    up = f"0.5 + 0.45 * {tanh(f'4.75 * ({p} - {at})')} / {math.tanh(4.75 * low)!r}"
    down = f"0.5 + 0.35 * {tanh(f'4.75 * ({p} - {at})')} / {math.tanh(4.75 * high)!r}"
    mid = down if midpoint <= 0 else up if midpoint >= 1 else f"CASE WHEN {p} <= {at} THEN {up} ELSE {down} END"
    return f"CASE WHEN {p} <= 0 THEN 0.05 WHEN {p} >= 1 THEN 0.85 ELSE {mid} END"


RATE = (1.0 / 200.0) ** (1 / 900)
SQL = {
    "district_vote_shares": BASE + six("SELECT plan_id, district, dem_votes, rep_votes, share FROM districts", "share"),
    "mean_median": BASE + ", m AS (SELECT plan_id, avg(share) - median(share) AS mean_median FROM districts GROUP BY 1) " + six(f"SELECT plan_id, mean_median, {fair('mean_median', 0.2)} AS penalty, {favor_dem('mean_median', 0.2)} AS penalty_dem, 100 * pow({favor_rep('mean_median', 0.2)}, 2) AS penalty_rep FROM m", "mean_median", "penalty", "penalty_dem", "penalty_rep"),
    "efficiency_gap_static": BASE + six("SELECT plan_id, sum(CASE WHEN share > 0.5 THEN (share - 0.5) * votes - (1 - share) * votes ELSE share * votes - (0.5 - share) * votes END) / sum(votes) AS efficiency_gap FROM districts GROUP BY 1", "efficiency_gap"),
    "efficiency_gap_robust": BASE + WIN + six(f"SELECT plan_id, eg AS efficiency_gap, {fair('eg', 0.35)} AS penalty FROM est", "efficiency_gap", "penalty"),
    "expected_dem_seats": BASE + WIN + six(f"SELECT plan_id, seats AS dem_seats, ({K} - seats) / {K} * 100 AS penalty_dem, seats / {K} * 100 AS penalty_rep FROM est", "dem_seats", "penalty_dem", "penalty_rep"),
    "majority_chance": BASE + NODES + six("SELECT plan_id, majority_dem, majority_rep, 100 * pow(1 - majority_dem, 1.5) AS penalty_dem FROM major", "majority_dem", "majority_rep", "penalty_dem"),
    "hinge_chance": BASE + NODES + six("SELECT plan_id, dem_4, majority_rep AS rep_5 FROM major", "dem_4", "rep_5"),
    "partisan_bias": BASE + STATE + CURVE + six("SELECT plan_id, partisan_bias FROM bias", "partisan_bias"),
    "seats_votes_curve": BASE + STATE + CURVE + six("SELECT plan_id, step, s_up AS seats FROM curve", "seats"),
    "partisan_gini": BASE + STATE + CURVE + six("SELECT plan_id, partisan_gini FROM gini", "partisan_gini"),
    "proportionality_clipped": BASE + WIN + f""",
r AS (SELECT plan_id, v, won, abs(v - 0.5) AS extra, round_even({K} * v - 1e-9, 0) / {K} - est AS raw FROM est JOIN state USING (plan_id)),
a AS (SELECT *, CASE WHEN v > 0.5 AND raw < 0 THEN least(raw + extra, 0) WHEN v < 0.5 AND raw > 0 THEN greatest(raw - extra, 0) ELSE raw END AS adj, (v < 0.48 AND won > 0.5) OR (1 - v < 0.48 AND 1 - won > 0.5) AS bad FROM r) """
    + six("SELECT plan_id, CASE WHEN bad OR abs(adj) >= 0.2 THEN 100 ELSE 100 * abs(adj) / 0.2 END AS penalty, CASE WHEN bad THEN 1 ELSE 0 END AS inversion, CASE WHEN bad THEN raw ELSE adj END AS gap FROM a", "penalty", "inversion", "gap"),
    "proportionality_unclipped": BASE + WIN + NODES.replace(STATE, "") + PROP + six("SELECT * FROM prop", "penalty", "inversion", "gap"),
    "competitiveness": BASE + WIN + six(f"SELECT plan_id, index, {COMPETE} AS penalty, 100 - least(0.75, index) / 0.75 * 100 AS penalty_clipped FROM est", "index", "penalty", "penalty_clipped"),
    "population_deviation": BASE + six(f"SELECT plan_id, sum(pow(greatest(0, dev - 0.01::DOUBLE), 2)) * 100000 / {K} AS pop_deviation, max(dev) * 100 AS pop_dev_max, avg(dev) * 100 AS pop_dev_mean, max(dev) AS max_deviation FROM dev GROUP BY 1", "pop_deviation", "pop_dev_max", "pop_dev_mean", "max_deviation"),
    "plan_stats": BASE + six("SELECT plan_id, min(population) AS least, max(population) AS most, max(dev) AS max_deviation, any_value(n) AS cut_edges FROM dev JOIN (SELECT plan_id, count(*) AS n FROM cuts GROUP BY 1) USING (plan_id) GROUP BY 1", "max_deviation"),
    "cut_edges": BASE + "SELECT plan_id, count(*) AS cut_edges FROM cuts GROUP BY 1",
    "cut_edge_incidence": BASE + GEO + "SELECT plan_id, district, cut AS cut_edges FROM touched",
    "county_district_matrix": BASE + "SELECT * FROM matrix",
    "county_constants": BASE + SPLITS + "SELECT * FROM counties",
    "county_splits": BASE + SPLITS + "SELECT * FROM splits",
    "county_congruence": BASE + SPLITS + six("SELECT plan_id, raw_county, raw_district, congruence, clipped FROM raw JOIN clip USING (plan_id)", "raw_county", "raw_district", "congruence", "clipped"),
    "clean_counties": BASE + "SELECT plan_id, county_id, count(DISTINCT district) AS districts, count(DISTINCT district) <= 1 AS is_clean FROM placed GROUP BY 1, 2",
    "counties_touched": BASE + "SELECT plan_id, district, count(DISTINCT county_id) AS counties FROM placed GROUP BY 1, 2",
    "precinct_area_perimeter": BASE + "SELECT precinct_id, 1.0::DOUBLE AS area, 4.0::DOUBLE AS perimeter, x + 0.5::DOUBLE AS cx, y + 0.5::DOUBLE AS cy FROM precincts",
    "adjacency_from_rings": BASE + "SELECT u, v, 1.0::DOUBLE AS shared_len FROM edges",
    "exterior_perimeter": BASE + GEO + "SELECT precinct_id, area, 4.0::DOUBLE AS perimeter, ext_perimeter FROM ext",
    "dir_extrema": BASE + GEO + six("SELECT precinct_id, dir, px, py, proj FROM extrema", "px", "py", "proj"),
    "polsby_popper": BASE + GEO + six("SELECT * FROM pps", "area", "perimeter", "polsby_popper"),
    "reock": BASE + GEO + six("SELECT * FROM reocks", "reock"),
    "compactness_blend": BASE + GEO + six(f"SELECT plan_id, polsby_popper, reock, {blend(True)} AS blend, {blend(False)} AS blend_clipped FROM means", "polsby_popper", "reock", "blend", "blend_clipped"),
    "district_boundary_segments": BASE
    + """, sides AS (SELECT plan_id, a.district AS owner, (x + dx1)::DOUBLE AS x1, (y + dy1)::DOUBLE AS y1, (x + dx2)::DOUBLE AS x2, (y + dy2)::DOUBLE AS y2
    FROM precincts JOIN assignments a USING (precinct_id), (VALUES (0, 0, 1, 0), (1, 0, 1, 1), (0, 1, 1, 1), (0, 0, 0, 1)) AS t(dx1, dy1, dx2, dy2)) SELECT plan_id, owner, x1, y1, x2, y2 FROM sides GROUP BY ALL HAVING count(*) = 1""",
    "alignment_cohesion": BASE + aligned("population") + six("SELECT plan_id, alignment, alignment_min, alignment_mean FROM align", "alignment", "alignment_min", "alignment_mean"),
    "alignment_party_wins_only": BASE + aligned("dem_votes", "sum(dem_votes) / sum(dem_votes + rep_votes) > 0.49") + six("SELECT plan_id, alignment, alignment_min, alignment_mean FROM align", "alignment", "alignment_min", "alignment_mean"),
    "plan_score_total": SCORED
    + six("SELECT plan_id, cut_edges, county_excess, county_unified, congruence, polsby_popper, reock, compactness, pop_deviation, alignment, mean_median, efficiency_gap, dem_seats, partisan_bias, partisan_gini, proportionality, inversion_chance, competitiveness, majority_dem, majority_rep, hinge_chance, total FROM summed", *"county_excess county_unified congruence polsby_popper reock compactness pop_deviation alignment mean_median efficiency_gap dem_seats partisan_bias partisan_gini proportionality inversion_chance competitiveness majority_dem majority_rep hinge_chance total".split()),
    "score_breakdown": SCORED
    + """, parts AS (SELECT plan_id, total, unnest([{'m': 'Cut Edges', 'v': cut_edges::DOUBLE}, {'m': 'Excess Splits', 'v': county_excess}, {'m': 'Single-County Districts', 'v': county_unified}, {'m': 'County Congruence', 'v': congruence},
    {'m': 'Polsby-Popper', 'v': polsby_popper}, {'m': 'Reock', 'v': reock}, {'m': 'Compactness', 'v': compactness}, {'m': 'Population Deviation', 'v': pop_deviation}, {'m': 'Alignment', 'v': alignment}, {'m': 'Mean-Median', 'v': mm_p},
    {'m': 'Efficiency Gap', 'v': eg_p}, {'m': 'Dem Seats', 'v': seats_p}, {'m': 'Partisan Bias', 'v': bias_p}, {'m': 'Partisan Gini', 'v': partisan_gini}, {'m': 'Proportionality', 'v': proportionality}, {'m': 'Competitiveness', 'v': competitiveness},
    {'m': 'D Majority', 'v': md_p}, {'m': 'R Majority', 'v': mr_p}, {'m': 'Hinge', 'v': h_p}]) AS x FROM summed) """.replace(", parts AS", ", shares AS")
    + six("SELECT plan_id, x.m AS metric, x.v / total * 100 AS percent FROM shares WHERE total > 0 AND x.v > 0", "percent"),
    "district_metrics_export": BASE + GEO + METRICS
    + f"""SELECT plan_id, district + 1 AS district, population, round((population - ideal) / ideal * 100, 2) AS pop_dev_pct, round(abs((population - ideal) / ideal * 100), 2) AS pop_dev_pct_abs, cut AS cut_edges, counties AS counties_touched,
    dem_votes, rep_votes, round(share * 100, 2) AS dem_pct, round(CASE WHEN vt > 0 THEN rep_votes / vt ELSE 0.5 END * 100, 2) AS rep_pct, round(share * 100 - 50, 2) AS dem_margin, round({cdf("z")}, 4) AS win_prob, round(pp, 4)::DOUBLE AS polsby_popper, round(rk, 4)::DOUBLE AS reock,
    round((100 - 0.5 * {band("rk", 0.25, 0.5, False)} - 0.5 * {band("pp", 0.1, 0.5, False)}) / 100, 4)::DOUBLE AS compactness FROM mx""",
    "district_info_table": BASE + GEO + METRICS + six("SELECT plan_id, district + 1 AS label, population, (population - ideal) / ideal * 100 AS dev_pct, pp * 100 AS pp, CASE WHEN vt > 0 THEN dem_votes / vt * 100 END AS dem_pct, CASE WHEN vt > 0 THEN rep_votes / vt * 100 END AS rep_pct, CASE WHEN vt > 0 THEN dem_votes / vt * 100 - rep_votes / vt * 100 END AS margin FROM mx", "dev_pct", "pp", "dem_pct", "rep_pct", "margin"),
    "partisan_buckets": BASE + ", s AS (SELECT precinct_id, CASE WHEN dem_votes + rep_votes > 0 THEN dem_votes / (dem_votes + rep_votes) ELSE 0.5 END AS share FROM precincts) " + six(f"SELECT precinct_id, share, {buckets('share')} AS bucket FROM s", "share"),
    "district_rank_bars": BASE + WIN + six(f"SELECT plan_id, district, share, row_number() OVER (PARTITION BY plan_id ORDER BY share, district) AS rank, {buckets('share')} AS bucket, p AS win_prob, row_number() OVER (PARTITION BY plan_id ORDER BY share, district) IN ({(K + 1) // 2}, {K // 2 + 1}) AS is_median FROM win", "share", "win_prob"),
    "district_shades": BASE + GEO
    + ", lab AS (SELECT plan_id, district, avg(x + 0.5) AS label_x, avg(y + 0.5) AS label_y FROM placed GROUP BY 1, 2), dv AS (SELECT *, population / (avg(population) OVER (PARTITION BY plan_id)) - 1 AS d FROM districts) "
    + six(f"SELECT plan_id, district, 0.5 * polsby_popper + 0.5 * reock AS compact_shade, least(0.1, greatest(-0.1, d)) / 0.1 AS pop_shade, {buckets('share')} AS bucket, label_x, label_y FROM dv JOIN pps USING (plan_id, district) JOIN reocks USING (plan_id, district) LEFT JOIN lab USING (plan_id, district)", "compact_shade", "pop_shade", "label_x", "label_y"),
    "connected_components": BASE + ", two AS (SELECT precinct_id AS node, precinct_id IN (0, 1, w, w + 1) AS corner FROM precincts) SELECT node, CASE WHEN corner THEN 0 ELSE 2 END::BIGINT AS component FROM two",
    "column_profile": BASE
    + "SELECT 'precinct_key' AS \"column\", count(DISTINCT precinct_key) AS \"distinct\", 0::BIGINT AS nulls, NULL::DOUBLE AS sum, NULL::DOUBLE AS least FROM precincts"
    + "".join(f" UNION ALL SELECT '{c}', count(DISTINCT {c}), count(*) - count({c}), sum({c})::DOUBLE, min({c})::DOUBLE FROM precincts" for c in ("county_id", "population", "dem_votes", "rep_votes")),
    "geometry_profile": BASE + "SELECT count(*) AS n, count(*) AS valid, 0::BIGINT AS null_geometry, 0::BIGINT AS wrong_type, 0::BIGINT AS zero_area FROM precincts",
    "plan_id_mismatch": BASE + "SELECT 'missing' AS side, precinct_key AS id FROM precincts WHERE precinct_id % 50 = 3 UNION ALL SELECT 'extra', 'other'",
    "renumber_nw_se": BASE + CENTRES + "SELECT plan_id, district, row_number() OVER (PARTITION BY plan_id ORDER BY ny + (1 - nx) DESC NULLS LAST, district) AS label FROM unit",
    "renumber_n_s": BASE + CENTRES + "SELECT plan_id, district, row_number() OVER (PARTITION BY plan_id ORDER BY ny DESC NULLS LAST, nx NULLS LAST, district) AS label FROM unit",
    "acceptance_rate": HISTORY
    + """, k AS (SELECT *, sum(is_worse::INT) OVER (PARTITION BY chain_id ORDER BY seq) AS nth FROM h),
o AS (SELECT *, CASE WHEN is_worse AND nth >= 10 THEN avg(accepted::INT) OVER (PARTITION BY chain_id, is_worse ORDER BY seq ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) END AS own FROM k),
l AS (SELECT chain_id, seq, last_value(own IGNORE NULLS) OVER (PARTITION BY chain_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rate FROM o) """
    + six("SELECT * FROM l WHERE rate IS NOT NULL", "rate"),
    "best_so_far": HISTORY
    + ", m AS (SELECT *, min(CASE WHEN accepted THEN total END) OVER (PARTITION BY chain_id ORDER BY seq) AS best FROM h), f AS (SELECT chain_id, total, min(seq) AS at FROM h WHERE accepted GROUP BY 1, 2) "
    + six("SELECT m.chain_id, seq, seq AS iteration, best, f.at AS best_iteration FROM m LEFT JOIN f ON f.chain_id = m.chain_id AND f.total = m.best", "best"),
    "history_smooth": HISTORY + six("SELECT chain_id, seq, avg(total) OVER (PARTITION BY chain_id ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS smooth FROM h", "smooth"),
    "history_stride": HISTORY + ", s AS (SELECT *, greatest(n - 20, 0) AS older FROM h), t AS (SELECT *, (SELECT min(1 << j) FROM range(40) r(j) WHERE older // (1::BIGINT << j) <= 20) AS stride FROM s) " + six("SELECT chain_id, seq, total FROM t WHERE seq > n - 20 OR (seq - 1) % stride = 0", "total"),
    "history_compact": HISTORY + six("SELECT chain_id, seq, total FROM h WHERE n <= 60 OR seq > n - 30 OR (seq - 1) % 7 = 0", "total"),
    "history_render": HISTORY + ", s AS (SELECT *, (seq - 1) // greatest(1, ceil(n / 10))::BIGINT AS part FROM h), w AS (SELECT *, row_number() OVER (PARTITION BY chain_id, part ORDER BY total, seq) AS lo, row_number() OVER (PARTITION BY chain_id, part ORDER BY total DESC, seq) AS hi, row_number() OVER (PARTITION BY chain_id, part ORDER BY seq) AS fi FROM s) " + six("SELECT chain_id, seq, total FROM w WHERE lo = 1 OR hi = 1 OR fi = 1 OR seq = n", "total"),
    "history_axis": HISTORY + ", a AS (SELECT chain_id, min(total) AS a, greatest(max(total) - min(total), 0.05) AS s FROM h WHERE seq > n - 50 GROUP BY 1) " + six("SELECT chain_id, a - s * 0.08 AS low, a + s + s * 0.08 AS high FROM a", "low", "high"),
    "history_entropy": HISTORY + six("SELECT chain_id, count(*) FILTER (WHERE accepted) AS accepted_worse, count(*) FILTER (WHERE NOT accepted) AS rejected_worse, count(*) FILTER (WHERE accepted) / count(*) * 100 AS entropy FROM h WHERE is_worse GROUP BY 1", "entropy"),
    "history_revert": HISTORY + ", b AS (SELECT chain_id, arg_min(seq, (total, seq)) AS upto FROM h WHERE accepted GROUP BY 1) " + six("SELECT h.chain_id, seq, total FROM h JOIN b USING (chain_id) WHERE seq <= upto", "total"),
    "recency_bands": HISTORY + six("SELECT chain_id, seq, exp(-(n - seq) / 2000.0::DOUBLE) AS weight, least(floor(exp(-(n - seq) / 2000.0::DOUBLE) * 24), 23)::INT AS band FROM h", "weight"),
    "flip_rate_curve": HISTORY + ", p AS (SELECT chain_id, seq, seq / n AS p FROM h) " + six(f"SELECT chain_id, seq, {flip('p', 0.835)} AS rate, {flip('p', 0.0)} AS rate_upper, {flip('p', 1.0)} AS rate_lower FROM p", "rate", "rate_upper", "rate_lower"),
    "cooling_schedule": HISTORY + f", t AS (SELECT chain_id, seq, 200 * pow({RATE!r}::DOUBLE, seq * 10) AS temperature, total - 50 AS d FROM h) " + six("SELECT chain_id, seq, temperature, CASE WHEN d <= 0 THEN 1 ELSE exp(-d / temperature) END AS chance FROM t", "temperature", "chance"),
    "ratchet_ceiling": HISTORY + ", p AS (SELECT chain_id, seq, seq / n AS p FROM h) " + six("SELECT chain_id, seq, CASE WHEN p <= 0.33 THEN 0.05 ELSE 0.05 + (0.0025 - 0.05) * least((p - 0.33) / (1 - 0.33), 1) END AS ceiling, 0.001::DOUBLE AS tight FROM p", "ceiling", "tight"),
}

#: Pieces of each district: labels walk along edges inside it, and every node keeps the least that reaches it.
WALK = """
, inside AS (SELECT a.plan_id, a.district, u, v FROM edges JOIN assignments a ON a.precinct_id = u JOIN assignments b ON b.precinct_id = v AND b.plan_id = a.plan_id AND b.district = a.district),
ways AS (SELECT plan_id, u, v FROM inside UNION ALL SELECT plan_id, v, u FROM inside),
walk(plan_id, node, label) AS (SELECT plan_id, precinct_id, precinct_id FROM assignments UNION SELECT w.plan_id, s.v, w.label FROM walk w JOIN ways s ON s.plan_id = w.plan_id AND s.u = w.node WHERE w.label < s.v),
least AS (SELECT plan_id, node, min(label) AS label FROM walk GROUP BY 1, 2),
pieces AS (SELECT l.plan_id, district, count(DISTINCT label) AS pieces FROM least l JOIN assignments a ON a.plan_id = l.plan_id AND a.precinct_id = l.node GROUP BY 1, 2)
"""
SQL["contiguity_check"] = BASE + WALK + "SELECT plan_id, district, pieces FROM pieces"
SQL["hot_start_validate"] = (
    BASE
    + WALK
    + f""", lab AS (SELECT plan_id, count(DISTINCT district) = {K} AND min(district) = 0 AND max(district) = {K - 1} AS labels_ok FROM assignments GROUP BY 1),
brk AS (SELECT plan_id, count(*) FILTER (WHERE pieces > 1) AS broken FROM pieces GROUP BY 1), mx AS (SELECT plan_id, max(dev) AS max_deviation FROM dev GROUP BY 1) """
    + six("SELECT plan_id, labels_ok, broken, max_deviation, labels_ok AND broken = 0 AND max_deviation <= 0.05 AS valid FROM lab JOIN brk USING (plan_id) JOIN mx USING (plan_id)", "max_deviation")
)
SQL["chain_stream_history"] = (
    HISTORY
    + """, k AS (SELECT *, sum(is_worse::INT) OVER (PARTITION BY chain_id ORDER BY seq) AS nth FROM h),
o AS (SELECT *, CASE WHEN is_worse AND nth >= 10 THEN avg(accepted::INT) OVER (PARTITION BY chain_id, is_worse ORDER BY seq ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) END AS own,
             min(CASE WHEN accepted THEN total END) OVER (PARTITION BY chain_id ORDER BY seq) AS best FROM k),
f AS (SELECT chain_id, total, min(seq) AS at FROM h WHERE accepted GROUP BY 1, 2),
l AS (SELECT o.chain_id, seq, seq AS iteration, last_value(own IGNORE NULLS) OVER (PARTITION BY o.chain_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rate, best, f.at AS best_iteration
      FROM o LEFT JOIN f ON f.chain_id = o.chain_id AND f.total = o.best) """
    + six("SELECT * FROM l", "rate", "best")
)

#: A tour from the north-west corner to the nearest district that it has not met, by a row for each of its stops.
SQL["renumber_proximity"] = (
    BASE
    + CENTRES
    + """, begin AS (SELECT plan_id, arg_max(district, (ny + 1 - nx, -district)) AS spot FROM unit WHERE cx IS NOT NULL GROUP BY 1),
gaps AS (SELECT a.plan_id, a.district AS a, b.district AS b, (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) AS d2 FROM unit a JOIN unit b ON a.plan_id = b.plan_id AND a.district <> b.district WHERE a.cx IS NOT NULL AND b.cx IS NOT NULL),
tour(plan_id, spot, seen, step) AS (SELECT plan_id, spot, [spot], 1 FROM begin
  UNION ALL SELECT t.plan_id, g.b, list_append(t.seen, g.b), t.step + 1 FROM tour t JOIN gaps g ON g.plan_id = t.plan_id AND g.a = t.spot AND NOT list_contains(t.seen, g.b)
  QUALIFY row_number() OVER (PARTITION BY t.plan_id ORDER BY g.d2, g.b) = 1)
SELECT s.plan_id, s.district, coalesce(step, (SELECT count(*) FROM tour u WHERE u.plan_id = s.plan_id) + row_number() OVER (PARTITION BY s.plan_id, t.step IS NULL ORDER BY s.district))::INT AS label
FROM spine s LEFT JOIN tour t ON t.plan_id = s.plan_id AND t.spot = s.district"""
)
#: Districts choose in turn; a row for each choice.
SQL["stable_colors"] = (
    BASE
    + f""", shared AS (SELECT a.plan_id, a.district, b.district AS was, count(*) AS n FROM assignments a JOIN assignments b ON b.plan_id = 0 AND b.precinct_id = a.precinct_id GROUP BY 1, 2, 3),
grid AS (SELECT p.plan_id, d.k::INT AS district, w.k::INT AS was, coalesce(n, 0) AS n FROM (SELECT DISTINCT plan_id FROM assignments) p CROSS JOIN range({K}) d(k) CROSS JOIN range({K}) w(k) LEFT JOIN shared s ON s.plan_id = p.plan_id AND s.district = d.k AND s.was = w.k),
sure AS (SELECT plan_id, district, list_sort(list(n), 'DESC') AS ns FROM grid GROUP BY 1, 2),
turns AS (SELECT plan_id, district, row_number() OVER (PARTITION BY plan_id ORDER BY ns[1] - ns[2] DESC, district DESC) AS turn FROM sure),
picks(plan_id, district, label, used, turn) AS (SELECT plan_id, NULL::INT, NULL::INT, []::INT[], 0::BIGINT FROM sure GROUP BY 1
  UNION ALL SELECT p.plan_id, g.district, g.was, list_append(p.used, g.was), t.turn FROM picks p JOIN turns t ON t.plan_id = p.plan_id AND t.turn = p.turn + 1 JOIN grid g ON g.plan_id = p.plan_id AND g.district = t.district AND NOT list_contains(p.used, g.was)
  QUALIFY row_number() OVER (PARTITION BY p.plan_id ORDER BY g.n DESC, g.was DESC) = 1)
SELECT plan_id, district, label FROM picks WHERE turn > 0"""
)
#: One island of four unit squares, moved five units away: the best of all pairs.
SQL["bridge_components"] = (
    BASE
    + """, c AS (SELECT precinct_id, county_id, x < 2 AND y < 2 AS island, (CASE WHEN x < 2 AND y < 2 THEN x - 5 ELSE x END)::DOUBLE AS x, y::DOUBLE AS y FROM precincts),
pair AS (SELECT least(a.precinct_id, b.precinct_id) AS u, greatest(a.precinct_id, b.precinct_id) AS v, (a.county_id <> b.county_id)::INT AS tier, sqrt(pow(greatest(abs(a.x - b.x) - 1, 0), 2) + pow(greatest(abs(a.y - b.y) - 1, 0), 2)) AS gap
         FROM c a JOIN c b ON a.island AND NOT b.island)
SELECT u, v, 0.0::DOUBLE AS shared_len, true AS is_virtual FROM pair ORDER BY tier, round(gap, 9), u, v LIMIT 1"""
)
SQL["edge_numbers"] = BASE + "SELECT u, v, row_number() OVER (ORDER BY u, v) - 1 AS edge_id FROM edges"
SQL["county_codes"] = BASE + "SELECT precinct_id, (dense_rank() OVER (ORDER BY county_id) - 1)::INT AS county_code FROM precincts"
SQL["best_state"] = HISTORY + ", b AS (SELECT chain_id, arg_min(seq, (total, seq)) AS at FROM h WHERE accepted GROUP BY 1) " + six("SELECT h.chain_id, total AS best, seq AS best_iteration, seq AS best_length FROM h JOIN b ON b.chain_id = h.chain_id AND b.at = h.seq", "best")
SQL["run_readout"] = (
    """WITH r AS (SELECT user_id::BIGINT AS chain_id, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000::DOUBLE AS elapsed FROM events GROUP BY 1),
s AS (SELECT *, CASE WHEN chain_id % 10 = 0 THEN 0 ELSE n END AS iteration, CASE WHEN chain_id % 3 = 0 THEN n ELSE 2 * n END AS iterations FROM r),
i AS (SELECT *, CASE WHEN iteration = 0 THEN NULL WHEN elapsed > 0 THEN iteration / elapsed ELSE 0 END AS ips FROM s),
l AS (SELECT *, floor(elapsed)::BIGINT AS a, CASE WHEN chain_id % 4 <> 0 AND ips > 0 AND iteration < iterations THEN floor((iterations - iteration) / ips)::BIGINT END AS b FROM i) """
    + six(
        "SELECT chain_id, "
        + ", ".join(f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} >= 3600 THEN printf('%d:%02d:%02d', {c} // 3600, {c} % 3600 // 60, {c} % 60) ELSE printf('%d:%02d', {c} // 60, {c} % 60) END AS {n}" for c, n in (("a", "time"), ("b", "\"left\"")))
        + ", ips FROM l",
        "ips",
    )
)


def interpolated(t: str, channel: int, colours: tuple) -> str:
    out = f"CASE WHEN {t} <= {STOPS[0]}::DOUBLE THEN {float(colours[0][channel])}::DOUBLE"
    for a, b, v, w in zip(STOPS, STOPS[1:], colours, colours[1:]):
        out += f" WHEN {t} <= {b}::DOUBLE THEN {v[channel]}::DOUBLE + ({t} - {a}::DOUBLE) * {(w[channel] - v[channel]) / (b - a)}::DOUBLE"
    return f"floor({out} ELSE {float(colours[-1][channel])}::DOUBLE END)::INT"


SQL["shade_colours"] = f"SELECT plan_id, district, {', '.join(f'{interpolated(t, k, c)} AS {n}_{name}' for t, c, n in (('compact_shade', COMPACT, 'compact'), ('(pop_shade + 1) / 2', DEVIATION, 'pop')) for k, name in enumerate(('red', 'green', 'blue')))} FROM ({SQL['district_shades']})"
_ALWAYS = ["total", "temperature", "cut_edges"]
_VOTES = ["mean_median", "efficiency_gap", "dem_seats", "partisan_bias", "partisan_gini", "proportionality", "inversion_chance", "competitiveness", "majority_dem", "majority_rep"]
_ACTIVE = {"bare": _ALWAYS, "interactive with votes": [*_ALWAYS, "compactness", "polsby_popper", "reock", *_VOTES], "ratchet": [*_ALWAYS, "pop_dev_max", "pop_dev_mean"], "all": [*_ALWAYS, "compactness", "polsby_popper", "reock", "congruence", "excess_splits", "pop_dev_max", "pop_dev_mean", *_VOTES, "hinge_chance"]}
SQL["shapefile_round_trip"] = BASE + "SELECT precinct_id, precinct_key AS key, population, 1.0::DOUBLE AS area, 5::BIGINT AS vertices, (5 * x + 2)::DOUBLE AS sum_x, (5 * y + 2)::DOUBLE AS sum_y FROM precincts"
SQL["plan_file_round_trip"] = BASE + "SELECT plan_id, precinct_id, district FROM assignments WHERE plan_id = 1"
#: What every valid plan of a chain keeps, whatever the draws: all districts, each in one piece and within the tolerance, and all precincts and people.
SQL["chain_invariants"] = BASE + f"SELECT m AS move, c.k AS chain_id, {K}::BIGINT AS districts, 1::BIGINT AS most_pieces, true AS within, (SELECT count(*) FROM precincts) AS precincts, (SELECT sum(population) FROM precincts)::BIGINT AS population FROM (VALUES ('two'), ('three'), ('flip'), ('first')) AS t(m) CROSS JOIN range(4) c(k)"
SQL["run_in_batches"] = "SELECT c.k AS chain_id, 12::BIGINT AS iteration, true AS same FROM range(3) c(k)"
#: All ways to give six reference districts one of eight districts each, and of these the one that keeps most people.
SQL["renumber_infer"] = (
    BASE
    + f""", kept AS (SELECT a.plan_id, ref_district AS r, a.district AS d, sum(population)::BIGINT AS n FROM assignments a JOIN precincts USING (precinct_id) JOIN reference USING (precinct_id) GROUP BY 1, 2, 3),
grid AS (SELECT p.plan_id, r.k::INT AS r, d.k::INT AS d, coalesce(n, 0) AS n FROM (SELECT DISTINCT plan_id FROM assignments) p CROSS JOIN range(6) r(k) CROSS JOIN range({K}) d(k) LEFT JOIN kept k ON k.plan_id = p.plan_id AND k.r = r.k AND k.d = d.k),
ways(plan_id, r, ds, total) AS (SELECT DISTINCT plan_id, 0, []::INT[], 0::BIGINT FROM assignments
  UNION ALL SELECT w.plan_id, w.r + 1, list_append(ds, g.d), (total + g.n)::BIGINT FROM ways w JOIN grid g ON g.plan_id = w.plan_id AND g.r = w.r AND NOT list_contains(ds, g.d)),
best AS (SELECT plan_id, arg_max(ds, total) AS ds FROM ways WHERE r = 6 GROUP BY 1),
own AS (SELECT plan_id, d.k::INT AS district, list_position(ds, d.k::INT) AS place FROM best CROSS JOIN range({K}) d(k))
SELECT plan_id, district, CASE WHEN place > 0 THEN 9 + place ELSE row_number() OVER (PARTITION BY plan_id, coalesce(place, 0) > 0 ORDER BY district) END::INT AS label FROM own"""
)
SQL["padded_ids"] = BASE + "SELECT precinct_id, lpad((1000000000 + precinct_id)::VARCHAR, 11, '0') AS geoid, lpad((100000 + precinct_id)::VARCHAR, 8, '0') AS code FROM precincts"

SQL["adjacency_inexact"] = (
    BASE
    + """, j AS (SELECT precinct_id AS i, 500000.5::DOUBLE + x::DOUBLE * 5000 AS ax, 4000000.25::DOUBLE + y::DOUBLE * 5000 AS ay, 300 + population::DOUBLE / 10 AS dx, county_id::DOUBLE * 37 - 400 AS dy, (county_id::DOUBLE + 3) / 31 AS t FROM precincts),
m AS (SELECT *, ax + dx AS bx, ay + dy AS "by", ax + dx * t AS mx, ay + dy * t AS my FROM j),
c AS (SELECT 3 * i AS u, 3 * i + 1 AS v, sqrt(pow(mx - ax, 2) + pow(my - ay, 2)) AS n FROM m UNION ALL SELECT 3 * i, 3 * i + 2, sqrt(pow(bx - mx, 2) + pow("by" - my, 2)) FROM m
      UNION ALL SELECT 3 * i + 1, 3 * i + 2, sqrt(pow(dx, 2) + pow(dy, 2)) / 4 FROM m) """
    + six("SELECT u, v, n AS shared_len FROM c", "shared_len")
)
def _outlined(cells: str, by: str) -> str:
    """Sums over rings from cells alone: a lattice region's outer rings less its holes are cells less pairs side by side plus full blocks of four."""
    same = " AND ".join(f"b.{c} = a.{c}" for c in by.split(", "))
    own = ", ".join(f"a.{c}" for c in by.split(", "))
    return f""", cells AS ({cells}),
pair AS (SELECT {own}, count(*) AS n FROM cells a JOIN cells b ON {same} AND (b.precinct_id = a.precinct_id + 1 AND a.x < a.w - 1 OR b.precinct_id = a.precinct_id + a.w) GROUP BY ALL),
block AS (SELECT {by}, count(*) AS n FROM (SELECT {own}, a.precinct_id FROM cells a JOIN cells b ON {same} AND b.x BETWEEN a.x AND a.x + 1 AND b.y BETWEEN a.y AND a.y + 1 GROUP BY ALL HAVING count(*) = 4) GROUP BY ALL),
cell AS (SELECT {by}, count(*) AS n FROM cells GROUP BY ALL)
SELECT {by}, cell.n::DOUBLE AS area, (4 * cell.n - 2 * coalesce(pair.n, 0))::DOUBLE AS perimeter, (cell.n - coalesce(pair.n, 0) + coalesce(block.n, 0))::BIGINT AS rings_less_holes, (4 * cell.n - 2 * coalesce(pair.n, 0))::BIGINT AS corners
FROM cell LEFT JOIN pair USING ({by}) LEFT JOIN block USING ({by})"""


SQL["district_outlines"] = BASE + _outlined("SELECT * FROM placed", "plan_id, district")
SQL["county_outlines"] = BASE + _outlined("SELECT * FROM precincts", "county_id")
SQL["district_layer_file"] = BASE + "SELECT plan_id, district::BIGINT AS district, sum(population)::BIGINT AS population, count(*)::DOUBLE AS area, min(x) = 0 AND min(y) = 0 AS at_corner FROM placed GROUP BY 1, 2"
SQL["outlines_simplified"] = BASE + "SELECT plan_id, count(*)::DOUBLE AS area, count(DISTINCT district) AS districts FROM placed GROUP BY 1"
SQL["label_points"] = (
    BASE
    + """, box AS (SELECT plan_id, district, count(*) AS n, max(x) - min(x) + 1 AS a, max(y) - min(y) + 1 AS b FROM placed GROUP BY 1, 2)
SELECT plan_id, district, true AS inside, CASE WHEN n = a * b THEN least(a, b) / 2::DOUBLE END AS depth FROM box"""
)
SQL["label_collisions"] = (
    BASE
    + """, mid AS (SELECT plan_id, district, avg(x + 0.5) AS lx, avg(y + 0.5) AS ly, row_number() OVER (PARTITION BY plan_id ORDER BY count(*) DESC, district) AS k, (district + 1)::VARCHAR AS label FROM placed GROUP BY plan_id, district),
box AS (SELECT plan_id, district, k, label, {'x1': lx - len(label) * 2.0 - 0.5, 'x2': lx + len(label) * 2.0 + 0.5, 'y1': ly - 2.0, 'y2': ly + 2.0} AS b FROM mid),
walk AS (SELECT plan_id, district, k, label, true AS shown, [b] AS boxes FROM box WHERE k = 1
  UNION ALL SELECT n.plan_id, n.district, n.k, n.label, f.free, CASE WHEN f.free THEN list_append(w.boxes, n.b) ELSE w.boxes END
  FROM walk w JOIN box n ON n.plan_id = w.plan_id AND n.k = w.k + 1, LATERAL (SELECT len(list_filter(w.boxes, lambda o: NOT (n.b.x2 < o.x1 OR n.b.x1 > o.x2 OR n.b.y2 < o.y1 OR n.b.y1 > o.y2))) = 0 AS free) f)
SELECT plan_id, district, label, shown FROM walk"""
)

SQL["chain_stream_reset"] = (
    HISTORY
    + """, g AS (SELECT chain_id, (chain_id % 3 = 0 AND seq > 20)::BIGINT AS run, CASE WHEN chain_id % 3 = 0 AND seq > 20 THEN seq - 20 ELSE seq END AS seq, seq <= 30 AS early, total, accepted FROM h),
e AS (SELECT chain_id, run, count(*) AS n, max(seq) AS last, min(CASE WHEN accepted THEN total END) AS best, arg_min(CASE WHEN accepted THEN seq END, (total, seq)) FILTER (WHERE accepted) AS best_iteration FROM g GROUP BY 1, 2),
l AS (SELECT chain_id, count(*) FILTER (WHERE early) AS late FROM g GROUP BY 1) """
    + six("SELECT chain_id, run, n, last, best, best_iteration, late FROM e JOIN l USING (chain_id)", "best")
)


def _stored_history() -> str:
    """Three files, thinned after each: of a chain of over 30 rows those before its last 10 that have not been thinned are cut to one in 4."""
    steps, before = [], "SELECT * FROM (SELECT chain_id, seq, total, false AS thinned FROM h) WHERE false"
    for k in range(3):
        steps.append(f"""a{k} AS ({before} UNION ALL SELECT chain_id, seq, total, false FROM h WHERE least((seq - 1) // 20, 2) = {k}),
n{k} AS (SELECT *, count(*) OVER c AS n, count(*) FILTER (WHERE thinned) OVER c AS old, row_number() OVER (PARTITION BY chain_id ORDER BY seq) - 1 AS i FROM a{k} WINDOW c AS (PARTITION BY chain_id)),
t{k} AS (SELECT chain_id, seq, total, thinned OR (n > 30 AND n - 10 > old AND i < n - 10) AS thinned FROM n{k} WHERE n <= 30 OR n - 10 <= old OR i < old OR i >= n - 10 OR (i - old) % 4 = 0)""")
        before = f"SELECT * FROM t{k}"
    return HISTORY + ", " + ", ".join(steps) + " " + six("SELECT * FROM t2", "total")


SQL["history_store"] = _stored_history()

BELOW = BASE + """, t AS (SELECT precinct_id AS node, CASE WHEN x > 0 THEN precinct_id - 1 WHEN y > 0 THEN precinct_id - w END AS parent, population, county_id FROM precincts),
up AS (SELECT node, node AS root, 0 AS depth FROM t UNION ALL SELECT up.node, t.parent, depth + 1 FROM up JOIN t ON t.node = up.root WHERE t.parent IS NOT NULL) """
SQL["subtree_sums"] = BELOW + "SELECT root AS node, sum(population)::BIGINT AS population FROM up JOIN t USING (node) GROUP BY 1"
SQL["subtree_members"] = BELOW + "SELECT root, count(*) AS nodes, max(depth) AS depth, sum(t.population)::BIGINT AS population FROM up JOIN t USING (node) JOIN t r ON r.node = up.root WHERE r.county_id = 0 GROUP BY 1"

#: Metrics that are there only where the layer has votes.
VOTED = "mean_median efficiency_gap dem_seats partisan_bias partisan_gini proportionality inversion_chance competitiveness majority_dem majority_rep hinge_chance".split()
_METRICS = ", ".join(f"('{k.removesuffix(' with votes')}', '{m}', {str(m in VOTED).lower()})" for k, v in _ACTIVE.items() for m in v)
SQL["active_metrics"] = BASE + f", m AS (SELECT * FROM (VALUES {_METRICS}) AS t(run, metric, voted)) SELECT run, metric FROM m WHERE NOT voted OR (SELECT sum(dem_votes + rep_votes) FROM precincts) > 0"
_ROLES = [("population", "TOTPOP", "population"), ("precinct", "VTDID", "precinct_key"), ("county", "CountyFP", "county_id"), ("dem", "baseline_d", "dem_votes"), ("rep", "BASELINE_R", "rep_votes")]
SQL["column_roles"] = BASE + " UNION ALL ".join(f"SELECT '{r}' AS role, '{n}' AS name, arg_max({c}::VARCHAR, (len({c}::VARCHAR), {c}::VARCHAR)) AS longest FROM precincts" for r, n, c in _ROLES)
_TEXTS = [("key", "precinct_key"), ("people", "population::VARCHAR"), ("mixed", "CASE WHEN precinct_id = 5 THEN 'none' ELSE '1' END"), ("empty", "NULL::VARCHAR")]
#: A text is a number if all its values read as one and none begins with 0 and a digit.
SQL["coerced_columns"] = (
    BASE
    + ", v AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS name, {c} AS v FROM precincts" for n, c in _TEXTS)
    + "), r AS (SELECT name, count(v) > 0 AND count(v) = count(TRY_CAST(v AS DOUBLE)) AND count(*) FILTER (WHERE regexp_matches(trim(v), '^0[0-9]')) = 0 AS num, sum(TRY_CAST(v AS DOUBLE)) AS total FROM v GROUP BY 1) "
    + six("SELECT name, CASE WHEN num THEN 'double' ELSE 'string' END AS type, CASE WHEN num THEN total END AS total FROM r", "total")
)
_CHOICES = [("fine", "population", "precinct_key"), ("no population", None, "precinct_key"), ("no precinct", "population", None), ("unknown column", "none", "precinct_key"), ("text", "precinct_key", "precinct_key")]
_CHOSEN = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in x) + ")" for x in _CHOICES)
#: What is said of a choice, from what the columns hold.
SQL["layer_issues"] = (
    BASE
    + f", c AS (SELECT * FROM (VALUES {_CHOSEN}) AS t(choice, pop, id)), "
    + "k AS (SELECT 'population' AS name, typeof(any_value(population)) AS kind, count(*) FILTER (WHERE population IS NULL OR population < 0) AS bad, sum(population) AS total FROM precincts UNION ALL SELECT 'precinct_key', typeof(any_value(precinct_key)), 0, 0 FROM precincts) "
    + """SELECT choice, CASE WHEN pop IS NULL THEN 'Choose a population column.' WHEN id IS NULL THEN 'Choose a precinct id column.' WHEN p.name IS NULL THEN 'Population column ''' || pop || ''' is not in the layer.'
    WHEN p.kind = 'VARCHAR' THEN 'Population column ''' || pop || ''' is not numeric (string).' WHEN p.bad > 0 OR p.total = 0 THEN 'other' END AS issue FROM c LEFT JOIN k p ON p.name = c.pop"""
)

#: Pixels of a picture of 200 by 160, whose middles never lie on the lattice's lines.
PIXELS = (
    BASE
    + """, fit AS (SELECT w, least(200 / w, 160 / w) * 0.96::DOUBLE AS scale FROM size),
px AS (SELECT r.r AS "row", c.c AS col, floor((c.c + 0.5 - (200 - w * scale) / 2) / scale)::BIGINT AS x, floor((160 - (r.r + 0.5) - (160 - w * scale) / 2) / scale)::BIGINT AS y, w FROM range(160) r(r), range(200) c(c), fit),
pix AS (SELECT "row", col, y * w + x AS precinct_id FROM px WHERE x BETWEEN 0 AND w - 1 AND y BETWEEN 0 AND w - 1) """
)
SQL["layer_pixels"] = PIXELS + 'SELECT "row", col, precinct_id FROM pix'
SQL["border_masks"] = (
    PIXELS
    + """, val AS (SELECT plan_id, "row", col, district AS value FROM pix JOIN assignments USING (precinct_id)), cval AS (SELECT "row", col, county_id AS value FROM pix JOIN precincts USING (precinct_id)),
step AS (SELECT * FROM (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) AS t(a, b)),
near AS (SELECT v.plan_id, v."row", v.col, bool_or(o.value IS NOT NULL AND o.value <> v.value) AS border, bool_or(o.value IS NULL AND v."row" + a BETWEEN 0 AND 159 AND v.col + b BETWEEN 0 AND 199) AS outline
  FROM (SELECT v.*, a, b, v."row" + a AS nr, v.col + b AS nc FROM val v, step) v LEFT JOIN val o ON o.plan_id = v.plan_id AND o."row" = nr AND o.col = nc GROUP BY 1, 2, 3),
thick AS (SELECT DISTINCT plan_id, "row" + i.a AS r, col + j.b AS c FROM near, range(-2, 3) i(a), range(-2, 3) j(b) WHERE border AND abs(i.a) + abs(j.b) <= 2 AND "row" + i.a BETWEEN 0 AND 159 AND col + j.b BETWEEN 0 AND 199),
county AS (SELECT count(*) AS counties FROM (SELECT DISTINCT v."row", v.col FROM (SELECT v.*, v."row" + a AS nr, v.col + b AS nc FROM cval v, step) v JOIN cval o ON o."row" = nr AND o.col = nc AND o.value <> v.value))
SELECT plan_id, count(*) FILTER (WHERE border) AS districts, count(*) FILTER (WHERE outline) AS outline, (SELECT count(*) FROM thick t WHERE t.plan_id = near.plan_id) AS thick, (SELECT counties FROM county) AS counties FROM near GROUP BY plan_id"""
)
