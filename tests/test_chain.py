import numpy as np
import pytest

from wardflow.operators import chain, kernel, score
from wardflow.plans import catalogue
from wardflow.plans.config import ScoreConfig, everything, interactive
from wardflow.plans.fixtures import K, Lattice

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lattice(spark):
    x = Lattice(spark, DATA)
    return x, catalogue.packed(x), catalogue.balanced(x)


def good(x, plan, k, tolerance):
    ideal = x.population.sum() / k
    assert set(plan.tolist()) == set(range(k))
    for d in range(k):
        own = np.flatnonzero(plan == d)
        assert abs(x.population[own].sum() - ideal) <= tolerance * ideal + 1e-9
        assert kernel.stays_connected(x, np.where(plan == d, d, -1), int(own[0])) or len(own) == 1 or pieces(x, plan, d) == 1


def pieces(x, plan, d):
    left, n = set(np.flatnonzero(plan == d).tolist()), 0
    while left:
        n, stack = n + 1, [left.pop()]
        while stack:
            for b in x.around[stack.pop()].tolist():
                if b in left:
                    left.discard(b)
                    stack.append(b)
    return n


def test_spanning_tree():
    rng = np.random.default_rng(1)
    u, v = np.array([(i, j) for i in range(30) for j in range(i) if (i * 7 + j) % 3 == 0 or i == j + 1]).T
    w = rng.random(len(u))
    t = kernel.spanning_tree(30, u, v, w)
    root, total = list(range(30)), []

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for e in np.argsort(w):
        a, b = find(u[e]), find(v[e])
        if a != b:
            root[a] = b
            total.append(e)
    assert sorted(total) == sorted(t.tolist())


@pytest.mark.parametrize("move", ["two", "three", "flip"])
def test_moves_keep_plans_valid(lattice, move):
    _, x, plan = lattice
    cfg = chain.ChainConfig(iterations=25, seed=5, only=move, score=ScoreConfig(tolerance=0.08))
    s = chain.begin(x, cfg, 3, plan)
    rows = chain.advance(x, cfg, s, 25)
    assert rows
    good(x, s.plan, K, 0.08)
    good(x, s.best_plan, K, 0.08)


def test_first_plan(lattice):
    _, x, _ = lattice
    for seed in range(3):
        plan = kernel.first_plan(x, K, 0.1, np.random.default_rng(seed))
        good(x, plan, K, 0.1)


def test_state_goes_on_as_if_not_stopped(lattice):
    _, x, plan = lattice
    cfg = chain.ChainConfig(iterations=30, seed=9, flips=True, ratchet="strict", launch_at=10, score=ScoreConfig(tolerance=0.1))
    a = chain.begin(x, cfg, 0, plan)
    whole = chain.advance(x, cfg, a, 30)
    b = chain.begin(x, cfg, 0, plan)
    first = chain.advance(x, cfg, b, 11)
    b = chain.State.load(b.dump())
    assert first + chain.advance(x, cfg, b, 19) == whole
    assert (a.plan == b.plan).all() and b.tolerance <= 0.1
    assert all(p["tolerance"] >= q["tolerance"] for p, q in zip(whole, whole[1:]))


CLIPPED = {"congruence_unclipped": False, "compactness_unclipped": False, "proportionality_unclipped": False, "competitiveness_unclipped": False, "eg_robust": False, "quadratic": True}


@pytest.mark.parametrize(
    "cfg",
    [everything(), everything(**CLIPPED), everything(alignment_focus="dem", alignment_wins_only=True, alignment_win_share=0.49, mm_mode="favor_dem", eg_mode="favor_rep", bias_mode="favor_dem", hinge_dem=False, seats_favor_dem=False), everything(alignment_focus="rep", alignment_wins_only=True, alignment_win_share=0.9), interactive(), interactive(compactness_unclipped=False)],
)
def test_kernel_score_is_the_relational_one(lattice, spark, cfg):
    lat, x, plan = lattice
    plans = chain.run(spark, x, chain.ChainConfig(iterations=6, seed=4, score=cfg), 3, "plans", plan, every=2)
    rows = plans.collect()
    a = chain.assignments(plans).selectExpr("chain_id * 1000 + iteration as plan_id", "precinct_id", "district")
    got = {r["plan_id"]: r for r in score.scores(a, catalogue.layer(lat), cfg).collect()}
    assert len(got) == len(rows) == 12
    weights = {k for k, v in cfg.__dict__.items() if k.startswith("weight_") and v}
    for r in rows:
        mine = kernel.score(x, np.array(r["plan"]), cfg)
        theirs = got[r["chain_id"] * 1000 + r["iteration"]]
        assert len(mine) >= len(weights) + 1 and mine["total"] > 0
        for k, v in mine.items():
            assert theirs[k] == pytest.approx(v, abs=1e-8), k
        assert r["total"] == pytest.approx(theirs["total"])


def test_no_metric_is_left_out_in_silence(lattice):
    """Each weight by itself changes the total, and one that the layer can't serve is an error."""
    _, x, plan = lattice
    for k in ScoreConfig.__dataclass_fields__:
        if k.startswith("weight_"):
            cfg = ScoreConfig(**{"weight_cut_edges": 0.0, "hinge_seats": 4, k: 1.0})
            got = kernel.score(x, np.random.default_rng(1).integers(0, K, len(plan)), cfg)
            assert got["total"] != 0 or k == "weight_county_unified" and got["county_unified"] == 0, k  # no county holds a district there
    bare = kernel.Arrays(x.population, x.u, x.v)
    for k in ("weight_congruence", "weight_compactness", "weight_reock", "weight_bias"):
        with pytest.raises(ValueError):
            kernel.score(bare, plan, ScoreConfig(**{k: 1.0}))


def test_chains_do_not_depend_on_dealing(lattice, spark):
    _, x, plan = lattice
    cfg = chain.ChainConfig(iterations=10, seed=6)
    key = lambda df: sorted((r["chain_id"], r["seq"], r["total"]) for r in df.collect())
    three = key(chain.run(spark, x, cfg, 3, "history", plan))
    assert [r for r in key(chain.run(spark, x, cfg, 5, "history", plan)) if r[0] < 3] == three


def test_flip_probability_is_the_column(spark):
    from pyspark.sql import functions as F

    from wardflow.operators import history

    for mid in (0.835, 0.0, 1.0, 0.3):
        rows = spark.range(0, 21).select((F.col("id") / 20.0).alias("p")).select("p", history.flip_rate(F.col("p"), mid).alias("r")).collect()
        for r in rows:
            assert chain.flip_probability(r["p"], mid) == pytest.approx(r["r"]), (mid, r["p"])


def test_a_laid_layer_is_the_packed_one(spark, lattice):
    grid, x, plan = lattice
    own, start = catalogue.laid(grid, everything()).load()
    for k, v in x.__dict__.items():
        if k != "around":
            assert np.array_equal(getattr(own, k), v), k
    assert np.array_equal(start, plan) and all((own.around[i] == x.around[i]).all() for i in range(len(plan)))
    bare, none = catalogue.laid(grid, ScoreConfig(), False).load()
    assert bare.extrema is None and bare.area is None and bare.reference is None and none is None
    cfg = chain.ChainConfig(iterations=5, seed=3, score=ScoreConfig(weight_pop_deviation=1.0))
    rows = lambda df: sorted(tuple(r) for r in df.drop("metrics").collect())
    assert rows(chain.run(spark, catalogue.laid(grid, cfg.score), cfg, 2)) == rows(chain.run(spark, x, cfg, 2, "history", plan))


def test_queries_of_chains_keep_the_layer_off_the_driver(spark, monkeypatch):
    monkeypatch.setattr(chain, "packed", lambda *a, **k: pytest.fail("the layer is collected"))
    monkeypatch.setattr(catalogue, "balanced", lambda x: pytest.fail("a plan is collected"))
    for name in ("initial_partition", "recom_chain", "recom_n3_chain", "flip_chain", "chain_invariants", "run_in_batches", "annealed_ensemble"):
        assert catalogue.QUERIES[name](spark, DATA).count()


def test_laid_layers_are_checked(spark):
    p = spark.createDataFrame([(0, 1, 0, 1, 1), (2, 1, 0, 1, 1)], "precinct_id long, population long, county_id int, dem_votes long, rep_votes long")
    e = spark.createDataFrame([], "u long, v long, shared_len double, is_virtual boolean")
    with pytest.raises(ValueError, match="0 to n - 1"):
        chain.laid(p, e, ScoreConfig())


def test_a_layer_of_any_size_is_laid_and_lies_in_mapped_files(spark, lattice, monkeypatch):
    grid, x, plan = lattice
    monkeypatch.setattr(chain, "MOST_PRECINCTS", 3)
    monkeypatch.setattr(chain, "MOST_EDGES", 3)
    monkeypatch.setattr(chain, "MAPPED", 1)
    monkeypatch.setattr(kernel, "BLOCK", 100)
    own, start = catalogue.laid(grid, everything()).load()
    for k, v in x.__dict__.items():
        if k != "around":
            assert np.array_equal(getattr(own, k), v), k
            a = getattr(own, k)
            while isinstance(a.base, np.ndarray):
                a = a.base
            assert isinstance(a, np.memmap) or a.base is not None, k
    assert np.array_equal(start, plan) and own.extrema[:, 3, 2].flags.c_contiguous
    assert np.array_equal(own.cut(plan), np.flatnonzero(plan[x.u] != plan[x.v]))
    with pytest.raises(ValueError, match="more than 3"):
        catalogue.packed(grid)


def test_trees_are_summed_and_parted_by_layers():
    rng = np.random.default_rng(2)
    for n in (2, 3, 40, 400):
        v = np.arange(1, n)
        u = np.array([int(rng.integers(max(0, k - 3), k)) for k in v])
        values, root = rng.integers(1, 99, n), int(rng.integers(n))
        tree, sums = kernel.rooted(n, u, v, root, np.bincount(np.r_[u, v], minlength=n), values)
        near = kernel.Around(n, u, v)
        below = {}

        def walk(a, before):
            below[a] = {a}.union(*(walk(int(b), a) for b in near[a] if b != before))
            assert tree.parent[a] == (a if before is None else before)
            return below[a]

        walk(root, None)
        assert sums.tolist() == [sum(values[list(below[a])].tolist()) for a in range(n)] == tree.below(values).tolist()
        for a in range(0, n, 7):
            assert set(np.flatnonzero(tree.subtree(a)).tolist()) == below[a]


def test_a_cut_takes_little_memory():
    import tracemalloc

    w = 200
    k = np.arange(w * w)
    u, v = np.r_[k[k % w < w - 1], k[:-w]], np.r_[k[k % w < w - 1] + 1, k[w:]]
    x = kernel.Arrays(np.ones(w * w, np.int64), u.astype(np.int32), v.astype(np.int32))
    tracemalloc.start()
    got = kernel.balanced_cut(x, k, w * w / 2, 0.2, np.random.default_rng(1))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got is not None and most < 150 * w * w, most / w / w


def test_pieces_without_a_node_are_those_of_a_walk():
    rng = np.random.default_rng(4)
    u, v = np.array([(a, b) for a in range(60) for b in range(a) if rng.random() < 0.04 or a == b + 1]).T
    x, plan = kernel.Arrays(np.ones(60, np.int64), u, v), rng.integers(0, 3, 60)
    seen = set()
    for a in range(60):
        rest = np.where(plan == plan[a], plan, -1)
        rest[a] = -1
        seen.add(kernel.stays_connected(x, plan, a))
        assert kernel.stays_connected(x, plan, a) == (pieces(x, rest, plan[a]) == 1)
    plan[:] = 0
    seen.add(kernel.stays_connected(x, plan, 30))
    assert seen == {True, False}
    plan[7] = 1
    assert not kernel.stays_connected(x, plan, 7)


#: Queries of chains, whose layer may have any size.
OF_ANY_SIZE = ["annealed_ensemble", "recom_n3_chain", "run_in_batches", "initial_partition", "chain_invariants"]


@pytest.mark.parametrize("name", OF_ANY_SIZE)
def test_queries_of_chains_take_layers_of_any_size(spark, monkeypatch, name):
    monkeypatch.setattr(chain, "MOST_PRECINCTS", 3)
    monkeypatch.setattr(chain, "MOST_EDGES", 3)
    assert catalogue.QUERIES[name](spark, DATA).count()
