"""Recombination chains. A chain is sequential, so it runs inside one task; many chains run side by side (applyInPandas by chain). The layer's arrays
travel to the executors once, as a broadcast; they are as large as one layer, whatever the number of chains.

Random draws come from one generator for each chain, seeded by (seed, chain_id): the same chains come out however they are dealt to tasks."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from wardflow.functions.numeric import hermite_nodes
from wardflow.plans.config import ScoreConfig


#: Edges that are looked at in one go.
BLOCK = 1 << 20


class Around:
    """The nodes beside each node: two arrays, as an array for each node would take many times their room. They are made when they are first asked for, as few moves do."""

    def __init__(self, n: int, u: np.ndarray, v: np.ndarray):
        self.n, self.u, self.v, self.to, self.first = n, u, v, None, None

    def made(self) -> tuple[np.ndarray, np.ndarray]:
        if self.to is None:
            small = np.int32 if self.n < 2**31 else np.int64
            starts = [np.r_[0, np.cumsum(np.bincount(ends, minlength=self.n))] for ends in (self.u, self.v)]
            first, to = starts[0] + starts[1], np.empty(2 * len(self.u), small)
            # A node's own: those after it in an edge, then those before it, each in the edges' order.
            for ends, others, own, before in ((self.u, self.v, starts[0], starts[1][:-1]), (self.v, self.u, starts[1], starts[0][1:])):
                order = np.argsort(ends, kind="stable")
                at = np.repeat(before, np.diff(own))
                at += np.arange(len(at))
                to[at] = others[order]
            self.to, self.first = to, first
        return self.to, self.first

    def __getitem__(self, node: int) -> np.ndarray:
        to, first = self.made()
        return to[first[node] : first[node + 1]]

    def beside(self, nodes: np.ndarray) -> np.ndarray:
        """What lies beside any of the nodes, repeats included."""
        to, first = self.made()
        begin = first[nodes]
        sizes = first[nodes + 1] - begin
        return to[np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]


@dataclass
class Arrays:
    """A layer by position. Edges in order of (u, v); county codes are dense; virtual edges connect but are not scored."""

    population: np.ndarray
    u: np.ndarray
    v: np.ndarray
    county: np.ndarray | None = None
    dem: np.ndarray | None = None
    rep: np.ndarray | None = None
    virtual: np.ndarray | None = None
    shared: np.ndarray | None = None
    area: np.ndarray | None = None
    ext: np.ndarray | None = None
    extrema: np.ndarray | None = None  # (precincts, 16, 3): x, y, projection
    reference: np.ndarray | None = None
    around: Around | None = field(default=None, repr=False)

    def __post_init__(self):
        self.around = Around(len(self.population), self.u, self.v)

    def cut(self, plan: np.ndarray) -> np.ndarray:
        """Indices of edges between districts. Edges are looked at in blocks, so that a large layer's ends don't lie in memory once more."""
        found = [at + np.flatnonzero(plan[self.u[at : at + BLOCK]] != plan[self.v[at : at + BLOCK]]) for at in range(0, len(self.u), BLOCK)]
        return np.concatenate(found) if found else np.zeros(0, np.int64)


# ---- trees ----


def _ranks(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the lightest on, and each one's place among them; of equal ones the first comes first."""
    kind = np.int32 if len(weight) < 2**31 else np.int64
    order = np.argsort(weight).astype(kind, copy=False)
    blocks = (weight[order[at : at + BLOCK + 1]] for at in range(0, len(order), BLOCK))
    if any((here[1:] == here[:-1]).any() for here in blocks):
        order = np.argsort(weight, kind="stable").astype(kind, copy=False)
    rank = np.empty(len(order), kind)
    rank[order] = np.arange(len(order), dtype=kind)
    return order, rank


def spanning_tree(n: int, u: np.ndarray, v: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The edges of the lightest spanning forest, by rounds in which every tree takes its lightest edge out; weights must differ. Trees are numbered anew
    in each round, and edges within a tree are dropped, so rounds get shorter."""
    order, rank = _ranks(weight)
    del weight
    a, b, chosen = u, v, []
    while True:
        live = a != b
        if not live.all():
            a, b, rank = a[live], b[live], rank[live]
        if not len(a):
            return np.sort(np.concatenate(chosen)).astype(np.int64) if chosen else np.zeros(0, np.int64)
        best = np.full(n, len(order), rank.dtype)
        np.minimum.at(best, a, rank)
        np.minimum.at(best, b, rank)
        mine, other = best[a] == rank, best[b] == rank
        chosen.append(order[rank[mine | other]])
        to = np.arange(n, dtype=a.dtype)
        to[a[mine]] = b[mine]
        to[b[other]] = a[other]
        # Of two trees that took the same edge the lower one is the top; all others follow to theirs.
        tops = np.flatnonzero(to[to] == np.arange(n))
        tops = tops[tops <= to[tops]]
        to[tops] = tops
        while True:
            up = to[to]
            if (up == to).all():
                break
            to = up
        new = np.empty(n, a.dtype)
        new[tops] = np.arange(len(tops))
        to = new[to]
        n, a, b = len(tops), to[a], to[b]


@dataclass
class Tree:
    """Nodes from the leaves inwards by layers, of which each one's children lie in layers before; each node's parent (the root's: itself)."""

    order: np.ndarray
    ends: list[int]
    parent: np.ndarray

    def layers(self, outwards: bool = False):
        sides = list(zip([0, *self.ends], self.ends))
        return (self.order[a:b] for a, b in (reversed(sides) if outwards else sides))

    def below(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees."""
        out = values.astype(float)
        for own in self.layers():
            np.add.at(out, self.parent[own], out[own])
        return out

    def subtree(self, top: int) -> np.ndarray:
        inside = np.zeros(len(self.parent), bool)
        inside[top] = True
        for own in self.layers(outwards=True):
            inside[own] |= inside[self.parent[own]]
        return inside


def rooted(n: int, u: np.ndarray, v: np.ndarray, root: int, degree: np.ndarray, values: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The tree of n - 1 edges seen from its root, and its sums over subtrees. Leaves are taken off layer by layer: the sum of the nodes beside a leaf, less
    those taken off before it, is its parent."""
    near = (np.bincount(u, weights=v, minlength=n) + np.bincount(v, weights=u, minlength=n)).astype(np.int64)
    left = degree.astype(np.int64)
    left[root] += n  # it never is a leaf
    sums, order, ends, at = values.astype(float), np.empty(n - 1, np.int32 if n < 2**31 else np.int64), [], 0
    own = np.flatnonzero(left == 1)
    while len(own):
        order[at : at + len(own)] = own
        at += len(own)
        ends.append(at)
        up = near[own]
        np.add.at(sums, up, sums[own])
        np.subtract.at(near, up, own)
        np.subtract.at(left, up, 1)
        own = up[left[up] == 1]
        if len(own) > 1:
            own.sort()
            own = own[np.r_[True, own[1:] != own[:-1]]]
    near[root] = root
    return Tree(order, ends, near), sums


@dataclass
class Cut:
    """A carved part of a region, and the tree that it was cut from."""

    carved: np.ndarray
    rest: np.ndarray
    tree: Tree
    nodes: np.ndarray
    carved_local: np.ndarray


def balanced_cut(x: Arrays, region: np.ndarray, ideal: float, tolerance: float, rng: np.random.Generator, attempts: int = 100, one_sided: bool = False, bias: float = 1.0) -> Cut | None:
    """A part of a region that, cut off a random spanning tree, has the ideal population; both sides have, unless one_sided: then one side suffices, the
    side below the cut if both fit. The lowest node that allows a cut is taken. bias over 1 makes edges across counties rarer in the tree."""
    region = np.sort(region)
    n = len(region)
    at = np.full(len(x.population), -1, np.int32 if n < 2**31 else np.int64)
    at[region] = np.arange(n)
    within = at >= 0
    own = np.flatnonzero(within[x.u] & within[x.v])
    if not len(own):
        return None
    u, v, pop = at[x.u[own]], at[x.v[own]], x.population[region]
    lo, hi, total = ideal * (1 - tolerance), ideal * (1 + tolerance), float(pop.sum())
    across = x.county[x.u[own]] != x.county[x.v[own]] if bias != 1.0 and x.county is not None else None
    del own, at, within

    def weights() -> np.ndarray:
        weight = rng.random(len(u))
        if across is not None:
            weight[across] *= bias
        return weight

    def tried() -> Cut | None | bool:
        """A cut of one tree, None if it has none, False if the region is not connected. What a tree takes goes with it."""
        t = spanning_tree(n, u, v, weights())
        a, b = u[t], v[t]
        del t
        degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
        inner = np.flatnonzero(degree > 1)
        if not len(inner):
            return None
        root = int(rng.choice(inner))
        del inner
        if len(a) < n - 1:
            return False
        tree, sums = rooted(n, a, b, root, degree, pop)
        this, that = (sums >= lo) & (sums <= hi), (total - sums >= lo) & (total - sums <= hi)
        fits = (this | that) if one_sided else (this & that)
        fits[root] = False
        if not fits.any():
            return None
        top = int(np.argmax(fits))
        inside = tree.subtree(top)
        if not this[top]:
            inside = ~inside
        return Cut(region[inside], region[~inside], tree, region, inside)

    for _ in range(attempts):
        got = tried()
        if got is not None:
            return got or None
    return None


def second_cut(x: Arrays, first: Cut, ideal: float, tolerance: float) -> np.ndarray | None:
    """A second part from what the first cut left of the same tree, both sides balanced; None if there is none."""
    keep = ~first.carved_local
    pop = np.where(keep, x.population[first.nodes], 0)
    sums = first.tree.below(pop)
    total, lo, hi = float(pop.sum()), ideal * (1 - tolerance), ideal * (1 + tolerance)
    fits = keep & (sums >= lo) & (sums <= hi) & (total - sums >= lo) & (total - sums <= hi)
    fits[first.tree.parent == np.arange(len(keep))] = False
    for top in np.flatnonzero(fits).tolist():
        inside = first.tree.subtree(top) & keep
        if inside.any() and (~inside & keep).any():
            return first.nodes[inside]
    return None


# ---- moves ----


def recombine(x: Arrays, plan: np.ndarray, cut: np.ndarray, ideal: float, tolerance: float, rng: np.random.Generator, bias: float = 1.0) -> np.ndarray | None:
    """Two districts that a random cut edge joins, divided anew."""
    if not len(cut):
        return None
    e = rng.choice(cut)
    a, b = plan[x.u[e]], plan[x.v[e]]
    got = balanced_cut(x, np.flatnonzero((plan == a) | (plan == b)), ideal, tolerance, rng, bias=bias)
    if got is None:
        return None
    new = plan.copy()
    new[got.carved], new[got.rest] = a, b
    return new


def recombine_three(x: Arrays, plan: np.ndarray, cut: np.ndarray, ideal: float, tolerance: float, rng: np.random.Generator, bias: float = 1.0, attempts: int = 20) -> np.ndarray | None:
    """Three districts: two at a random cut edge, and one of their neighbours in proportion to the cut edges shared."""
    if not len(cut):
        return None
    e = rng.choice(cut)
    a, b = plan[x.u[e]], plan[x.v[e]]
    du, dv = plan[x.u[cut]], plan[x.v[cut]]
    in_u, in_v = np.isin(du, (a, b)), np.isin(dv, (a, b))
    to = np.where(in_u, dv, du)[in_u != in_v]
    if not len(to):
        return None
    c = rng.choice(to)
    first = balanced_cut(x, np.flatnonzero(np.isin(plan, (a, b, c))), ideal, tolerance, rng, attempts, one_sided=True, bias=bias)
    if first is None:
        return None
    second = second_cut(x, first, ideal, tolerance)
    if second is None:
        again = balanced_cut(x, first.rest, ideal, tolerance, rng, attempts, bias=bias)
        if again is None:
            return None
        second = again.carved
    new = plan.copy()
    new[first.rest], new[first.carved], new[second] = c, a, b
    return new


def stays_connected(x: Arrays, plan: np.ndarray, node: int) -> bool:
    """Whether a node's district is in one piece without it."""
    left = plan == plan[node]
    left[node] = False
    members = np.count_nonzero(left)
    if not members:
        return False
    own = np.array([np.argmax(left)])
    left[own] = False
    while len(own):
        members -= len(own)
        own = x.around.beside(own)
        own = np.unique(own[left[own]])
        left[own] = False
    return not members


def flip(x: Arrays, plan: np.ndarray, cut: np.ndarray, ideal: float, tolerance: float, rng: np.random.Generator, bias: float = 1.0, attempts: int = 100) -> np.ndarray | None:
    """One precinct at a border goes over. Edges across counties are drawn less often by the bias."""
    if not len(cut):
        return None
    weight = np.ones(len(cut))
    if bias != 1.0 and x.county is not None:
        weight[x.county[x.u[cut]] != x.county[x.v[cut]]] = 1.0 / bias
    weight /= weight.sum()
    sums, sizes = np.bincount(plan, weights=x.population), np.bincount(plan)
    lo, hi = ideal * (1 - tolerance), ideal * (1 + tolerance)
    for _ in range(attempts):
        e = rng.choice(cut, p=weight)
        s, d = (x.u[e], x.v[e]) if rng.random() < 0.5 else (x.v[e], x.u[e])
        a, b, p = plan[s], plan[d], x.population[s]
        if sizes[a] > 1 and lo <= sums[a] - p <= hi and lo <= sums[b] + p <= hi and stays_connected(x, plan, int(s)):
            new = plan.copy()
            new[s] = b
            return new
    return None


def first_plan(x: Arrays, k: int, tolerance: float, rng: np.random.Generator, restarts: int = 10, attempts: int = 200, bias: float = 1.0) -> np.ndarray | None:
    """k districts carved one after another; the tolerance grows from 0.5 % as fewer are left. A number of attempts, and no clock, ends a try."""
    ideal = float(x.population.sum()) / k
    for _ in range(restarts):
        plan, rest = np.full(len(x.population), -1), np.arange(len(x.population))
        for j in range(k - 1):
            tol = tolerance if k <= 2 else min(tolerance, 0.005) + max(0.0, tolerance - 0.005) * min(1.0, 2 * j / ((k - 2) * (k - j)))
            got = balanced_cut(x, rest, ideal, tol, rng, attempts, one_sided=j < k - 2, bias=bias)
            if got is None:
                break
            plan[got.carved], rest = j, got.rest
            got = None  # its tree goes before the next one is drawn
        else:
            plan[rest] = k - 1
            if abs(x.population[rest].sum() - ideal) <= tolerance * ideal:
                return plan
    return None


# ---- score ----


_erfc = np.vectorize(math.erfc, otypes=[float])


def ncdf(z) -> np.ndarray:
    return _erfc(-np.asarray(z, float) / math.sqrt(2)) / 2


def win_counts(ps: np.ndarray) -> np.ndarray:
    """The chances of exactly 0 to n wins."""
    f = np.zeros(len(ps) + 1)
    f[0] = 1.0
    for p in ps:
        f[1:] = f[1:] * (1 - p) + f[:-1] * p
        f[0] *= 1 - p
    return f


def _needs(what: str, *given) -> None:
    if any(g is None for g in given):
        raise ValueError(f"the layer lacks what {what} needs")


def _directional(raw: float, mode: str, bound: float, quadratic: bool) -> float:
    q = {"fair": min(1.0, abs(raw) / bound), "favor_dem": min(1.0, max(0.0, (raw + bound) / (2 * bound))), "favor_rep": min(1.0, max(0.0, (bound - raw) / (2 * bound)))}[mode]
    return (q * q if quadratic else q) * 100


def _county_metrics(x: Arrays, plan: np.ndarray, pop: np.ndarray, cfg: ScoreConfig, add) -> None:
    from wardflow.operators import county as cty

    _needs("a county metric", x.county)
    k, ideal = cfg.n_districts, x.population.sum() / cfg.n_districts
    nc = int(x.county.max()) + 1
    m = np.bincount(x.county * k + plan, weights=x.population, minlength=nc * k).reshape(nc, k)
    cp = m.sum(1)
    if cfg.weight_county_excess or cfg.weight_county_unified:
        parts = (m > 0).sum(1)
        add("county_excess", cfg.weight_county_excess, cty.SPLIT_SCALE * np.maximum(0, parts - np.ceil(cp / ideal))[cp > 0].sum())
        most = np.floor(cp / max(ideal * (1 - cfg.tolerance), 1.0)).sum()
        add("county_unified", cfg.weight_county_unified, cty.SPLIT_SCALE * (most - ((m > 0).sum(0) == 1).sum()))
    if cfg.weight_congruence:

        def direction(a: np.ndarray, other: np.ndarray) -> float:
            size = a.sum(1)
            whole = (a == other[None, :]) & (a > 0)
            ok = size > 0
            roots = np.sqrt(np.where(whole, 0, a)[ok] / size[ok, None]).sum(1) + np.sqrt(np.where(whole, a, 0)[ok].sum(1) / size[ok])
            return float((size[ok] / size.sum() * roots).sum())

        c, d = direction(m, pop), direction(m.T, cp)
        if cfg.congruence_unclipped:
            value = 0.5 * cty.SLOPE * (max(0.0, c - 1) + max(0.0, d - 1))
        else:
            w = (min(nc, k) - 1) / max(nc, k)
            best = w * cty.MOST + (1 - w) * cty.LEAST
            rise = lambda raw, at: 100 * max(0.0, min(1.0, (raw - at) / (at * cty.WORST - at)))
            value = cty.CLIPPED_SCALE * 0.5 * (rise(c, best if nc > k else cty.MOST) + rise(d, cty.MOST if nc > k else best))
        add("congruence", cfg.weight_congruence, value)


def _band(raw: float, lo: float, hi: float, unclipped: bool) -> float:
    from wardflow.operators import compactness as cmp

    line = lambda v: 100.0 - (v - lo) / (hi - lo) * 100.0
    if not unclipped:
        return line(max(lo, min(hi, raw)))
    knee = lo + (1.0 - cmp.DIVERGE / 100.0) * (hi - lo)
    if raw <= lo or raw <= knee:
        return 100.0 if raw <= lo else line(raw)
    power = 100.0 / (hi - lo) * (cmp.LANDING - knee) / cmp.DIVERGE
    return 0.0 if raw >= cmp.LANDING else cmp.DIVERGE * ((cmp.LANDING - raw) / (cmp.LANDING - knee)) ** power


def _compactness_metrics(x: Arrays, plan: np.ndarray, cut: np.ndarray, cfg: ScoreConfig, add) -> None:
    from wardflow.operators import compactness as cmp

    _needs("a compactness metric", x.area, x.ext, x.shared)
    k = cfg.n_districts
    area = np.bincount(plan, weights=x.area, minlength=k)
    pp = rk = 0.0
    if cfg.weight_polsby_popper or cfg.weight_compactness:
        per = np.bincount(plan, weights=x.ext, minlength=k) + np.bincount(np.r_[plan[x.u[cut]], plan[x.v[cut]]], weights=np.r_[x.shared[cut], x.shared[cut]], minlength=k)
        pp = (1 - np.where(per > 0, np.minimum(1.0, 4 * math.pi * area / np.maximum(per, 1e-300) ** 2), 1.0).mean()) * 100
        add("polsby_popper", cfg.weight_polsby_popper, pp)
    if cfg.weight_reock or cfg.weight_compactness:
        _needs("Reock", x.extrema)
        value = np.zeros(k)
        for d in range(k):
            own = np.flatnonzero(plan == d)
            if len(own):
                farthest = np.array([own[np.argmax(x.extrema[:, j, 2][own])] for j in range(16)])  # one direction's at a time
                p = x.extrema[farthest, np.arange(16), :2]
                r2 = ((p[:, None] - p[None]) ** 2).sum(2).max() / 4
                value[d] = min(1.0, area[d] / (math.pi * r2)) if r2 > 0 else 0.0
        rk = (1 - value.mean()) * 100
        add("reock", cfg.weight_reock, rk)
    if cfg.weight_compactness:
        add("compactness", cfg.weight_compactness, 0.5 * _band(1 - rk / 100, *cmp.REOCK_BAND, cfg.compactness_unclipped) + 0.5 * _band(1 - pp / 100, *cmp.PP_BAND, cfg.compactness_unclipped))


def _alignment(x: Arrays, plan: np.ndarray, cfg: ScoreConfig) -> float:
    """0 where nothing is compared."""
    w = {"none": x.population, "dem": x.dem, "rep": x.rep}[cfg.alignment_focus]
    _needs("alignment", w)
    k, n = cfg.n_districts, int(x.reference.max()) + 1
    o = np.bincount(x.reference * k + plan, weights=w, minlength=n * k).reshape(n, k)
    mass = o.sum(1)
    ok = mass > 0
    if cfg.alignment_wins_only and cfg.alignment_focus in ("dem", "rep"):
        d, r = np.bincount(x.reference, weights=x.dem, minlength=n), np.bincount(x.reference, weights=x.rep, minlength=n)
        ok &= (d + r > 0) & ((d if cfg.alignment_focus == "dem" else r) > cfg.alignment_win_share * (d + r))
    if not ok.any():
        return 0.0
    c = ((o[ok] / mass[ok, None]) ** 2).sum(1)
    return float(100 * (mass[ok] * (1 - c)).sum() / mass[ok].sum())


def _proportionality(s: np.ndarray, v: float | None, chances, cfg: ScoreConfig) -> float:
    """chances: the chance of so many D seats or more, at each swing, with its weight and node."""
    from wardflow.operators import partisan as par

    k = cfg.n_districts
    if v is None:
        return 0.0
    est = float(ncdf((s - 0.5) / cfg.sigma).mean())
    if not cfg.proportionality_unclipped:
        won, raw = float((s > 0.5).mean()), float(np.rint(k * v - 1e-9)) / k - est
        if (v < 0.5 - par.SLACK and won > 0.5) or (1 - v < 0.5 - par.SLACK and 1 - won > 0.5):
            return 100.0
        extra, gap = abs(v - 0.5) * (par.BONUS - 1), raw
        if v > 0.5 and raw < 0:
            gap = min(raw + extra, 0.0)
        elif v < 0.5 and raw > 0:
            gap = max(raw - extra, 0.0)
        return min(100.0, 100.0 * abs(gap) / par.CAP)
    over, extra = (est - v if v >= 0.5 else v - est), abs(v - 0.5)
    d = -over if over <= 0 else par.LIGHT * over if over <= extra else par.LIGHT * extra + (over - extra)
    p = 0.0
    for z, w, f in chances():
        behind = float(ncdf((0.5 - (v + z * cfg.swing)) / par.BLUR))
        p += w * (behind * f[k // 2 + 1 :].sum() + (1 - behind) * (1 - f[k - k // 2 :].sum()))
    p /= math.sqrt(2 * math.pi)
    return float(100 * min(d / par.FULL, 1.0) * (1 - p) + 100 * p)


def _vote_metrics(x: Arrays, plan: np.ndarray, cfg: ScoreConfig, add) -> None:
    from wardflow.operators import partisan as par

    _needs("a partisan metric", x.dem, x.rep)
    k = cfg.n_districts
    d, r = np.bincount(plan, weights=x.dem, minlength=k), np.bincount(plan, weights=x.rep, minlength=k)
    t = d + r
    s = np.where(t > 0, d / np.maximum(t, 1), 0.5)
    v = float((s * t).sum() / t.sum()) if t.sum() else None
    won = ncdf((s - 0.5) / cfg.sigma)
    seats_at = lambda delta: float(ncdf((s + delta - 0.5) / cfg.sigma).mean())
    held: list = []

    def chances() -> list:
        if not held:
            held.extend((z, w, win_counts(ncdf((s - 0.5) / cfg.sigma_district + z * cfg.swing / cfg.sigma_district))) for z, w in hermite_nodes())
        return held

    chance = lambda least: float(sum(w * f[least:].sum() for _, w, f in chances())) / math.sqrt(2 * math.pi)
    if cfg.weight_mean_median:
        raw = float(s.mean() - np.median(s))
        add("mean_median", cfg.weight_mean_median, raw, _directional(raw, cfg.mm_mode, cfg.mm_bound, cfg.quadratic))
    if cfg.weight_efficiency_gap:
        raw = float((t * ((2 * s - 0.5) - (ncdf((s - 0.5) / cfg.sigma_eg) if cfg.eg_robust else s > 0.5))).sum() / t.sum()) if t.sum() else 0.0
        add("efficiency_gap", cfg.weight_efficiency_gap, raw, _directional(raw, cfg.eg_mode, cfg.eg_bound, cfg.quadratic))
    if cfg.weight_seats:
        seats = float(won.sum())
        add("dem_seats", cfg.weight_seats, seats, min(100.0, max(0.0, ((k - seats) if cfg.seats_favor_dem else seats) / k * 100)))
    if cfg.weight_bias:
        raw = 0.0 if v is None else 0.5 - seats_at(0.5 - v)
        add("partisan_bias", cfg.weight_bias, raw, _directional(raw, cfg.bias_mode, cfg.bias_bound, cfg.quadratic))
    if cfg.weight_gini:
        grid = np.array(par.GINI_GRID)
        gaps = np.zeros(len(grid)) if v is None else np.array([abs(seats_at(g - v) - (1 - seats_at(1 - g - v))) for g in grid])
        add("partisan_gini", cfg.weight_gini, min(1.0, ((gaps[:-1] + gaps[1:]) * np.diff(grid) / 2).sum() / par.GINI_BOUND) * 100)
    if cfg.weight_proportionality:
        add("proportionality", cfg.weight_proportionality, _proportionality(s, v, chances, cfg))
    if cfg.weight_competitiveness:
        c = min(1.0, max(0.0, float((1 - 4 * (won - 0.5) ** 2).mean())))
        low = 100 - min(par.CMP_BEST, c) / par.CMP_BEST * 100
        bent = low if c <= par.CMP_KNEE else par.CMP_DIVERGE * ((1 - c) / (1 - par.CMP_KNEE)) ** par.CMP_POWER
        add("competitiveness", cfg.weight_competitiveness, bent if cfg.competitiveness_unclipped else low)
    for name, weight, p in (("majority_dem", cfg.weight_majority_dem, lambda: chance(k // 2 + 1)), ("majority_rep", cfg.weight_majority_rep, lambda: 1 - chance(k - k // 2)), ("hinge_chance", cfg.weight_hinge, lambda: chance(min(max(cfg.hinge_seats, 1), k)) if cfg.hinge_dem else 1 - chance(max(1, k - cfg.hinge_seats + 1)))):
        if weight:
            add(name, weight, value := p(), 100 * max(0.0, 1 - value) ** 1.5)


def score(x: Arrays, plan: np.ndarray, cfg: ScoreConfig) -> dict[str, float]:
    """The metrics in use and their weighted total, as operators.score has them. A weight whose metric the layer can't give is an error, except alignment's: without a reference plan it is left out there too."""
    k, out, total = cfg.n_districts, {}, 0.0
    cut = x.cut(plan)
    pop = np.bincount(plan, weights=x.population, minlength=k)
    ideal = x.population.sum() / k

    def add(name: str, weight: float, value: float, penalty: float | None = None) -> None:
        nonlocal total
        out[name] = float(value)
        total += weight * float(value if penalty is None else penalty)

    add("cut_edges", cfg.weight_cut_edges, len(cut) if x.virtual is None else np.count_nonzero(~x.virtual[cut]))
    if cfg.weight_county_excess or cfg.weight_county_unified or cfg.weight_congruence:
        _county_metrics(x, plan, pop, cfg, add)
    if cfg.weight_polsby_popper or cfg.weight_reock or cfg.weight_compactness:
        _compactness_metrics(x, plan, cut, cfg, add)
    if cfg.weight_pop_deviation:
        dev = np.abs(pop - ideal) / ideal
        add("pop_deviation", cfg.weight_pop_deviation, (np.maximum(0, dev - cfg.pop_harbor) ** 2).sum() * 100_000 / k)
    if cfg.weight_alignment and x.reference is not None:
        add("alignment", cfg.weight_alignment, _alignment(x, plan, cfg))
    if cfg.needs_votes():
        _vote_metrics(x, plan, cfg, add)
    out["total"] = total
    return out
