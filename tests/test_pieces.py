"""Work by pieces of a graph gives what a broadcast graph gives."""

import random

import numpy as np
import pandas as pd
import pytest

from signflow.operators import compact, numeric, reach, solve
from signflow.operators import consistency as C

ARC, IV = "src long, dst long, m int", "iv_id long, node long, mask int"


def _graph(spark, seed=3, pieces=30):
    """Pieces of three to nine nodes, whose arcs are dealt to several tasks, and clamps on some, twice on the first."""
    rng = random.Random(seed)
    arcs, iv = [], []
    for p in range(pieces):
        nodes = [100 * p + k for k in range(rng.randint(3, 9))]
        arcs += {(a, b): (a, b, rng.choice((1, 1, 2, 2, 3))) for a, b in (rng.sample(nodes, 2) for _ in range(2 * len(nodes)))}.values()
        iv += [(p, nodes[0], rng.choice((1, 2)))] if p % 3 else []
    iv += [(1000, 0, 1), (1001, 0, 2), (1001, 200, 1), (1002, 77_777, 2)]
    rng.shuffle(arcs)
    return spark.createDataFrame(arcs, ARC).repartition(5), spark.createDataFrame(iv, IV)


def _rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def shrunk(monkeypatch):
    """Broadcasts are for graphs of up to three arcs, and for no number of interventions."""
    for m in (solve, reach, numeric, C):
        monkeypatch.setattr(m, "small", lambda df, most=3: compact.small(df, min(most, 3)))


def test_pieces_are_what_arcs_join(spark):
    arcs, _ = _graph(spark)
    cut, nodes = compact.pieces(arcs)
    got = dict(_rows(nodes))
    assert got == {n: 100 * (n // 100) + min(x % 100 for x in got if x // 100 == n // 100 and got[x] == got[n]) for n in got}
    assert all(got[s] == got[d] == p for s, d, p in cut.select("src", "dst", "piece").collect())
    chain = spark.createDataFrame([(k, k + 1, 1) for k in range(200)], ARC).repartition(40)
    assert {p for _, p in _rows(compact.pieces(chain)[1])} == {0}


def test_roots_by_joins_alone(spark, monkeypatch):
    monkeypatch.setattr(compact, "small", lambda df, most=0: False)
    chain = spark.createDataFrame([(k, k + 1, 1) for k in range(60)] + [(100, 101, 1)], ARC).repartition(16)
    assert dict(_rows(compact.pieces(chain)[1])) == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


def test_components_by_piece(spark, shrunk):
    arcs, _ = _graph(spark)
    pairs = [tuple(r)[:2] for r in arcs.collect()]
    out = {n: [] for p in pairs for n in p}
    for a, b in pairs:
        out[a].append(b)
    want = sorted((n, min(c)) for c in solve.strong_components(sorted(out), out.__getitem__) for n in c)
    assert _rows(solve.components_of(arcs)) == want
    # pieces of more arcs than a task may have
    assert _rows(solve.components_of(arcs, max_arcs=12)) == want


def test_component_of_a_hub_and_the_rest():
    rng = np.random.default_rng(1)
    big = rng.integers(0, 900, (11_000, 2))
    tail = np.array([(k, k + 1) for k in range(900, 1200)] + [(5, 900), (1100, 1050)])
    arcs = np.concatenate([big, tail])
    out = {n: [] for n in np.unique(arcs).tolist()}
    for a, b in arcs.tolist():
        out[a].append(b)
    got = solve._components([pd.DataFrame(arcs, columns=["src", "dst"])])
    assert dict(zip(got.node, got.scc)) == {n: min(c) for c in solve.strong_components(out, out.__getitem__) for n in c}
    # a search of too many rounds leaves all to the walk node by node
    ring = np.arange(12_000)
    got = solve._components([pd.DataFrame({"src": ring, "dst": np.roll(ring, -1)})])
    assert (got.scc == 0).all()


@pytest.mark.parametrize("exact_max", [0, 16])
def test_solve_by_piece(spark, shrunk, exact_max):
    arcs, iv = _graph(spark)
    assert _rows(solve.solve(arcs, iv, exact_max=exact_max)) == _rows(solve.solve(arcs, iv, exact_max=exact_max, max_arcs=0))


def test_some_pieces_are_larger_than_a_task(spark, shrunk):
    arcs, iv = _graph(spark)
    assert _rows(solve.solve(arcs, iv, max_cone=11)) == _rows(solve.solve(arcs, iv, max_arcs=0))


def test_determination_follows_causation(spark, shrunk):
    arcs, iv = _graph(spark)
    up = spark.createDataFrame([(n, 9_000 + n // 300, 1 + n % 2) for n in (0, 1, 2, 100, 101, 200, 300, 500, 600)] + [(9_000 + k, 9_100, 1) for k in range(3)], "micro long, macro long, m int")
    assert _rows(solve.solve(arcs, iv, up)) == _rows(solve.solve(arcs, iv, up, max_arcs=0))


def test_reach_by_piece(spark, shrunk):
    arcs, iv = _graph(spark)
    assert _rows(reach.signed_reach(arcs, iv)) == _rows(reach.joined_reach(arcs, iv))


def test_walks_by_piece(spark, shrunk):
    arcs, iv = _graph(spark)
    for a, b in zip(_rows(numeric.random_walk(arcs, iv, tolerance=0.1)), _rows(numeric.random_walk(arcs, iv, tolerance=0.1, max_arcs=0)), strict=True):
        assert a == pytest.approx(b, abs=2e-9)


def test_consistency_by_piece(spark, shrunk):
    arcs, iv = _graph(spark)
    assert _rows(C.consistent(arcs, iv)) == _rows(C.consistent(arcs, iv, max_arcs=0))


def test_draws_by_piece(spark, monkeypatch):
    arcs, iv = _graph(spark)
    want = _rows(numeric.sampled_signs(arcs, iv, draws=20, parts=2))
    monkeypatch.setattr(numeric, "few", lambda iv: False)
    assert _rows(numeric.sampled_signs(arcs, iv, draws=20, parts=2)) == want


def test_two_by_two_stability_is_that_of_eigenvalues():
    j = np.random.default_rng(2).uniform(-1.5, 1.5, (2_000, 2, 2))
    assert (numeric._stable_pair(j) == (np.linalg.eigvals(j).real.max(axis=1) < -1e-9)).all()
