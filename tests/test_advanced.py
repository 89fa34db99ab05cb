import itertools
import random

from pyspark.sql import functions as F

from signflow.operators import consistency as C
from signflow.operators import solve as S
from signflow.operators.nulls import permute_signs, rewire
from signflow.operators.numeric import monte_carlo, random_walk


def d_separated(arcs, x, y, z):
    """By the definition: no simple walk of the undirected graph is open."""
    kids = {}
    for a, b in arcs:
        kids.setdefault(a, set()).add(b)
    below = {}

    def desc(n):
        if n not in below:
            below[n] = {n} | {m for k in kids.get(n, ()) for m in desc(k)}
        return below[n]

    def walk(path):
        if path[-1] == y:
            return all((not (desc(b) & z)) is False if (a, b) in arcs and (c, b) in arcs else b not in z for a, b, c in zip(path, path[1:], path[2:]))
        return any(walk([*path, n]) for n in nodes if n not in path and ((path[-1], n) in arcs or (n, path[-1]) in arcs))

    nodes = {n for e in arcs for n in e}
    return not walk([x])


def test_separation_on_acyclic_graphs_by_definition(spark):
    from signflow.operators.separation import separated

    rng = random.Random(8)
    rows, xs, ys, zs, comp, want = [], [], [], [], [], {}
    for g in range(12):
        arcs = {(i, j) for i in range(6) for j in range(i + 1, 6) if rng.random() < 0.35}
        rows += [(100 * g + i, 100 * g + j) for i, j in arcs]
        comp += [(100 * g + i, 100 * g + i) for i in range(6)]
        for x, y in itertools.combinations(range(6), 2):
            z = {n for n in range(6) if n not in (x, y) and rng.random() < 0.4}
            q = f"{g}:{x}:{y}"
            xs.append((q, 100 * g + x))
            ys.append((q, 100 * g + y))
            zs += [(q, 100 * g + n) for n in z]
            want[q] = d_separated(arcs, x, y, z)
    t = "q string, node long"
    got = separated(spark.createDataFrame(rows, "src long, dst long"), spark.createDataFrame(comp, "node long, scc long"), spark.createDataFrame(xs, t), spark.createDataFrame(ys, t), spark.createDataFrame(zs, t))
    assert {r.q: r.separated for r in got.collect()} == want


def test_a_loop_partner_opens_a_collider(spark):
    from signflow.operators.separation import separated

    arcs = spark.createDataFrame([(1, 3), (2, 4), (3, 4), (4, 3)], "src long, dst long")
    comp = S.components_of(arcs)
    one = lambda q, n: spark.createDataFrame([(q, n)], "q string, node long")
    none = spark.createDataFrame([], "q string, node long")
    assert separated(arcs, comp, one("a", 1), one("a", 2), none).first().separated
    assert not separated(arcs, comp, one("a", 1), one("a", 2), one("a", 4)).first().separated


def test_consistency_by_enumeration():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(2, 5)
        into = {i: [(j, rng.choice((1, 2, 3))) for j in range(n) if j != i and rng.random() < 0.5] for i in range(n)}
        forcing = {i: rng.choice((0, 0, 1, 2, 3)) for i in range(n)}
        models = []
        for signs in itertools.product((1, 2, 0), repeat=n):
            ok = True
            for v in range(n):
                pos, neg = bool(forcing[v] & 1), bool(forcing[v] & 2)
                for u, m in into[v]:
                    for flip in (0, 1):
                        if m >> flip & 1 and signs[u]:
                            eff = signs[u] if not flip else 3 - signs[u]
                            pos |= eff == 1
                            neg |= eff == 2
                ok &= {1: pos, 2: neg, 0: pos == neg}[signs[v]]
            if ok:
                models.append(signs)
        got = C.cautious(list(range(n)), into.__getitem__, forcing, {})
        assert got == {v: models[0][v] for v in range(n) if models and len({s[v] for s in models}) == 1}


def test_consistency_and_determinants_never_disagree():
    rng = random.Random(9)
    for _ in range(80):
        n = rng.randint(2, 6)
        arcs = [(i, (i + 1) % n, rng.choice((1, 2))) for i in range(n)] + [(-1, 0, 1)]
        arcs += [(i, j, rng.choice((1, 2))) for i in range(n) for j in range(n) if i != j and (i + 1) % n != j and rng.random() < 0.2]
        a, b = S.solve_map(arcs, {-1: 1}), C.solve_consistent(arcs, {-1: 1})
        assert all({a.get(k, 0), b.get(k, 0)} != {1, 2} for k in range(n))


def test_sampled_systems_never_contradict_predictions():
    arcs = [(0, 1, 1), (1, 2, 2), (2, 0, 1), (1, 3, 1), (3, 1, 2)]
    for clamp in ({0: 1}, {2: 2}):
        got = S.solve_map(arcs, clamp)
        cut = [a for a in arcs if a[1] not in clamp]
        counts = monte_carlo(cut, clamp, 300, 3)
        assert set(counts) == set(got) - set(clamp)
        for n in counts:
            plus, minus, zero = counts[n]
            assert plus + minus + zero == 300
            assert not (got[n] == 1 and minus or got[n] == 2 and plus)


def test_verdicts_of_sampled_signs(spark):
    from signflow.operators.numeric import validate

    p = spark.createDataFrame([("a", n, m) for n, m in enumerate((1, 1, 2, 3, 3))], "iv_id string, node int, mask int")
    c = spark.createDataFrame([("a", 0, 100, 0, 0), ("a", 1, 97, 3, 0), ("a", 2, 2, 98, 0), ("a", 3, 99, 1, 0), ("a", 4, 60, 40, 0)], "iv_id string, node int, plus long, minus long, zero long")
    assert [r.verdict for r in validate(p, c).orderBy("node").collect()] == ["confirmed", "contradicted", "confirmed", "conservative", "warranted"]


def test_nulls_keep_what_they_should(spark):
    rng = random.Random(1)
    arcs = sorted({(rng.randint(0, 30), rng.randint(31, 60)) for _ in range(150)})
    arcs = [(s, d, rng.choice((1, 2))) for s, d in arcs]
    df = spark.createDataFrame(arcs, "src long, dst long, m int")
    out = [tuple(r) for r in rewire(df, rounds=4, seed=4).collect()]
    for k in (0, 1):
        assert sorted(r[k] for r in out) == sorted(r[k] for r in arcs)
    assert sorted((r[0], r[2]) for r in out) == sorted((r[0], r[2]) for r in arcs)
    assert len({r[:2] for r in out}) == len(out) and sorted(out) != arcs
    fixed = spark.createDataFrame([(i,) for i in range(0, 61, 2)], "node long")
    held = {tuple(r) for r in rewire(df, rounds=4, seed=4, movable=fixed).collect()}
    assert {a for a in arcs if a[0] % 2 or a[1] % 2} <= held
    mixed = permute_signs(df, 5)
    assert mixed.groupBy("m").count().exceptAll(df.groupBy("m").count()).isEmpty()
    assert mixed.select("src", "dst").exceptAll(df.select("src", "dst")).isEmpty()
    assert not mixed.exceptAll(df).isEmpty()


def test_random_walk_is_the_linear_solution_both_ways(spark):
    import numpy as np

    rng = random.Random(6)
    arcs = sorted({(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(30)})
    arcs = [(s, d, rng.choice((1, 2))) for s, d in arcs if s != d]
    live = [a for a in arcs if a[1] != 3]
    m = np.zeros((10, 10))
    deg = {s: sum(a[0] == s for a in live) for s in range(10)}
    for s, d, sign in live:
        m[d, s] += (1 if sign == 1 else -1) / deg[s]
    e = np.zeros(10)
    e[3] = -1
    want = 0.15 * np.linalg.solve(np.eye(10) - 0.85 * m, e)
    df = spark.createDataFrame(arcs, "src long, dst long, m int")
    iv = spark.createDataFrame([("a", 3, 2)], "iv_id string, node long, mask int")
    near = {r.node: r.score for r in random_walk(df, iv).collect()}
    assert near and all(abs(v - want[n]) < 1e-8 for n, v in near.items())
    far = {r.node: r.score for r in random_walk(df, iv, alpha=0.5, tolerance=1e-4, max_arcs=0).collect()}
    half = 0.5 * np.linalg.solve(np.eye(10) - 0.5 * m, e)
    assert set(far) == set(near) and all(abs(v - half[n]) < 1e-3 for n, v in far.items())


def test_numbered_rows_and_running_sums(spark):
    from signflow.functions.storage import numbered

    rng = random.Random(4)
    rows = [(rng.randint(-50, 50), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(7)
    got = numbered(df, "k", "v", total="v").orderBy("number").collect()
    assert [(r.k, r.v) for r in got] == sorted(rows) and [r.number for r in got] == list(range(300))
    acc = 0
    for r in got:
        assert r.v_before == acc
        acc += r.v


def test_exact_p_by_enumeration(spark):
    from itertools import product
    from math import comb

    from signflow.operators.scoring import exact_p

    tables = [(2, 1, 1, 3), (1, 2, 0, 2), (3, 0, 2, 1)]
    total = 0.0
    for ks in product(*[range(0, 5) for _ in tables]):
        p = 1.0
        for k, (a, b, c, d) in zip(ks, tables):
            w, o, n = a + c, a + b, a + b + c + d
            p *= comb(w, k) * comb(n - w, o - k) / comb(n, o) if 0 <= k <= w and 0 <= o - k <= n - w else 0
        total += p * (sum(ks) >= sum(t[0] for t in tables))
    got = exact_p(spark.createDataFrame(tables, "a long, b long, c long, d long")).first()
    assert got.strata == 3 and abs(got.p - total) < 1e-12


def test_quotas_meet_their_total():
    from signflow.operators.scoring import quotas

    for sizes, total, floor in (({"a": 100, "b": 10, "c": 1}, 20, 2), ({"a": 3, "b": 3}, 20, 1), ({"a": 1000, "b": 1, "c": 1}, 10, 1), ({"x": 7, "y": 7, "z": 7}, 10, 1)):
        q = quotas(sizes, total, floor)
        assert sum(q.values()) == min(total, sum(sizes.values())) and all(q[k] <= sizes[k] for k in q)
        assert all(q[k] >= min(floor, sizes[k]) for k in q if sizes[k] >= floor)
