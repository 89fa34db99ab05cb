import itertools
import random

import pytest

from signflow.functions.signs import mul, neg
from signflow.operators import solve as S


def brute_determinant(m):
    total, n = 0, len(m)
    for p in itertools.permutations(range(n)):
        term = 1
        for r, c in enumerate(p):
            term = mul(term, m[r][c])
        if sum(p[i] > p[j] for i in range(n) for j in range(i + 1, n)) % 2:
            term = neg(term)
        total |= term
    return total


def test_determinant_against_all_permutations():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(0, 6)
        m = [[rng.choice((0, 0, 1, 2, 3)) for _ in range(n)] for _ in range(n)]
        assert S.sign_determinant(m) == brute_determinant(m)


def test_unit_graphs():
    assert S.solve_map([("a", "b", 1), ("b", "c", 2)], {"a": 1}) == {"a": 1, "b": 1, "c": 2}
    assert S.solve_map([("a", "b", 1), ("a", "c", 1), ("b", "d", 1), ("c", "d", 2)], {"a": 1})["d"] == 3
    # surgery cuts the way back into the clamped node
    assert S.solve_map([("a", "b", 1), ("b", "a", 2)], {"a": 1}) == {"a": 1, "b": 1}
    ring = [(i, (i + 1) % 30, 1) for i in range(30)] + [(-1, 0, 1)]
    assert set(S.solve_map(ring, {-1: 1}).values()) == {1}
    # a forced loop of two negative arcs is determined exactly
    assert S.solve_map([("f", "x", 1), ("x", "y", 2), ("y", "x", 2)], {"f": 1}) == {"f": 1, "x": 1, "y": 2}
    assert S.solve_map([("a", "a", 2), ("b", "a", 1)], {"b": 1}) == {"a": 1, "b": 1}


def test_determination_enters_as_forcing_and_cycles_across_scales_raise():
    assert S.solve_map([("m", "n", 2)], {"a": 1}, [("a", "m", 1)]) == {"a": 1, "m": 1, "n": 2}
    with pytest.raises(ValueError, match="cycle"):
        S.solve_map([("b", "a", 1), ("f", "a", 1)], {"f": 1}, [("a", "b", 1)])


def test_exact_and_loop_never_contradict():
    rng = random.Random(20)
    for _ in range(400):
        n = rng.randint(2, 8)
        arcs = [(i, (i + 1) % n, rng.choice((1, 2))) for i in range(n)]
        arcs += [(i, j, rng.choice((1, 2))) for i in range(n) for j in range(n) if i != j and (i + 1) % n != j and rng.random() < 0.28]
        arcs += [(-1, i, rng.choice((1, 2))) for i in range(n) if rng.random() < 0.35 or i == 0]
        exact, loop = S.solve_map(arcs, {-1: 1}), S.solve_map(arcs, {-1: 1}, exact_max=0)
        assert all({exact.get(k, 0), loop.get(k, 0)} != {1, 2} for k in range(n))
        flipped = S.solve_map(arcs, {-1: 2})
        assert {k: neg(v) for k, v in exact.items()} == flipped


def test_batched_reach_is_the_loop_engine(spark):
    from signflow.operators.reach import joined_reach, signed_reach

    rng = random.Random(11)
    nodes = range(40)
    arcs = sorted({(rng.choice(nodes), rng.choice(nodes)) for _ in range(110)})
    arcs = [(s, d, rng.choice((1, 2, 3))) for s, d in arcs]
    clamps = {f"i{k}": {rng.choice(nodes): rng.choice((1, 2)) for _ in range(rng.randint(1, 3))} for k in range(12)}
    a = spark.createDataFrame(arcs, "src long, dst long, m int")
    iv = spark.createDataFrame([(k, n, m) for k, c in clamps.items() for n, m in c.items()], "iv_id string, node long, mask int")
    got = {(r.iv_id, r.node): r["mask"] for r in signed_reach(a, iv).collect()}
    want = {(k, n): m for k, c in clamps.items() for n, m in S.solve_map(arcs, c, exact_max=0).items()}
    assert got == want
    assert {(r.iv_id, r.node): r["mask"] for r in joined_reach(a, iv).collect()} == want
    tier = {(r.iv_id, r.node): r["mask"] for r in S.solve(a, iv, exact_max=0).collect()}
    assert tier == want


def test_components_by_joins_and_in_one_task_agree(spark):
    rng = random.Random(3)
    arcs = spark.createDataFrame([(rng.randint(0, 30), rng.randint(0, 30)) for _ in range(45)], "src long, dst long")
    a = {tuple(r) for r in S.components_of(arcs).select("node", "scc").collect()}
    b = {tuple(r) for r in S.coloured_components(arcs.distinct()).select("node", "scc").collect()}
    assert a == b


def test_cones_and_levels_solve_as_one_task_does(spark):
    rng = random.Random(12)
    arcs = [(f"n{rng.randint(0, 60)}", f"n{rng.randint(0, 60)}", rng.choice((1, 2, 1, 2, 3))) for _ in range(75)]
    # rings of some nodes, and one too large for determinants
    for base, size in ((100, 2), (110, 3), (120, 5), (130, 18)):
        arcs += [(f"n{base + i}", f"n{base + (i + 1) % size}", rng.choice((1, 2))) for i in range(size)] + [(f"n{rng.randint(0, 60)}", f"n{base}", 1), (f"n{base + 1}", f"n{rng.randint(0, 60)}", 2)]
    best = {}
    for s, d, m in arcs:
        best[s, d] = best.get((s, d), 0) | m
    arcs = [(s, d, m) for (s, d), m in best.items()]
    con = [("n3", "top", 1), ("n7", "top", 2), ("n100", "top", 1), ("top", "higher", 2)]
    clamps = {f"i{k}": {f"n{rng.randint(0, 60)}": rng.choice((1, 2)) for _ in range(rng.randint(1, 2))} for k in range(6)}
    a = spark.createDataFrame(arcs, "src string, dst string, m int")
    c = spark.createDataFrame(con, "micro string, macro string, m int")
    iv = spark.createDataFrame([(k, n, m) for k, x in clamps.items() for n, m in x.items()], "iv_id string, node string, mask int")
    want = {(k, n): m for k, x in clamps.items() for n, m in S.solve_map(arcs, x, con).items()}
    assert {3} < set(want.values())
    for how in ({}, {"max_arcs": 0}, {"max_arcs": 0, "max_cone": 0}):
        assert {(r.iv_id, r.node): r["mask"] for r in S.solve(a, iv, c, **how).collect()} == want, how


def test_first_simple_paths_by_enumeration(spark):
    from signflow.operators.paths import paths_between, simple_paths

    rng = random.Random(2)
    arcs = sorted({(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(32)})
    arcs = [(s, d, rng.choice((1, 2))) for s, d in arcs if s != d]
    out = {}
    for s, d, m in arcs:
        out.setdefault(s, []).append((d, m))

    def every(path, sign, target):
        if path[-1] == target:
            yield path, sign
            return
        if len(path) <= 5:
            for d, m in sorted(out.get(path[-1], ())):
                if d not in path:
                    yield from every([*path, d], mul(sign, m), target)

    for target in range(1, 10):
        want = sorted(list(every([0], 1, target))[:7], key=lambda f: (len(f[0]), f[0]))
        assert paths_between(arcs, 0, target, 1, 5, 7) == want
    a = spark.createDataFrame(arcs, "src long, dst long, m int")
    iv = spark.createDataFrame([("a", 0, 1)], "iv_id string, node long, mask int")
    goal = spark.createDataFrame([("a", 5)], "iv_id string, node long")
    for how in ({}, {"max_arcs": 0}):
        got = [(r.path, r["mask"]) for r in simple_paths(a, iv, goal, 5, 7, **how).collect()]
        assert got == paths_between([x for x in arcs if x[1] != 0], 0, 5, 1, 5, 7)
