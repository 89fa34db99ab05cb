"""Bit-parallel distances, interval labels, longest depths, whole-pool ranks and ablations, against plain definitions."""

import random

import pytest

from signflow.operators import ablation, distances, intervals, scoring


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("hops", [None, 0, 2])
def test_hop_distances(spark, hops):
    # 150 sources make three groups; a chain is longer than the rounds between two stores
    rng = random.Random(1)
    arcs = {(rng.randrange(300), rng.randrange(300)) for _ in range(420)} | {(1000 + i, 1001 + i) for i in range(20)}
    sources = [(f"s{i}", rng.randrange(300)) for i in range(150)] + [("s0", 7), ("chain", 1000), ("chain", 1005), ("alone", 5000), ("alone", 5000)]
    want = {}
    for name in {s for s, _ in sources}:
        dist = {n: 0 for s, n in sources if s == name}
        front = list(dist)
        while front:
            front = [b for a in front for x, b in arcs if x == a and b not in dist and not dist.update({b: dist[a] + 1})]
        want |= {(name, n): k for n, k in dist.items() if hops is None or k <= hops}
    got = distances.hop_distances(frame(spark, "src long, dst long, m int", [(a, b, 1) for a, b in arcs]), frame(spark, "iv_id string, node long", sources), hops).collect()
    assert {(r.iv_id, r.node): r.dist for r in got} == want and len(got) == len(want)


def test_pairwise(spark):
    arcs = frame(spark, "src string, dst string", [("a", "b"), ("c", "b"), ("d", "d")])
    got = distances.pairwise(arcs, frame(spark, "node string", [("a",), ("c",), ("d",), ("c",)]))
    assert [tuple(r) for r in got.collect()] == [("a", "c", 2)]


def above(edges, x):
    seen, work = set(), [d for s, d in edges if s == x]
    while work:
        y = work.pop()
        if y not in seen:
            seen.add(y)
            work += [d for s, d in edges if s == y]
    return seen


@pytest.mark.parametrize("kind", ["forest", "dag", "cyclic", "chain", "empty"])
def test_interval_labels(spark, kind):
    rng = random.Random(len(kind))
    n = 120
    edges = {(i, rng.randrange(i)) for i in range(1, n) if rng.random() < 0.95} if kind != "empty" else set()
    if kind in ("dag", "cyclic"):
        edges |= {(i, rng.randrange(i)) for i in rng.sample(range(5, n), 15)}
    if kind == "cyclic":
        edges |= {(200, 201), (201, 202), (202, 200), (203, 200), (200, 5), (204, 203), (3, 204), (300, 301), (301, 300), (302, 301)}
    if kind == "chain":
        edges = {(i, i - 1) for i in range(1, 24)}
    nodes = sorted({x for e in edges for x in e} | {998, 999})
    asked = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(1500)] + [(x, x) for x in nodes]
    df = frame(spark, "src long, dst long", [*edges, (None, 1), (2, None), *list(edges)[:3]])
    got = intervals.is_below(frame(spark, "part long, whole long, tag int", [(a, b, 1) for a, b in asked]), df).collect()
    ups = {x: above(edges, x) for x in nodes}
    assert len(got) == len(asked) and all(r.below == (r.whole in ups[r.part]) for r in got)
    lab = {r.node: r for r in intervals.labels(df).collect()}
    if kind in ("forest", "dag", "chain"):
        assert sorted(r["first"] for r in lab.values()) == list(range(len(lab))) and set(lab) == {x for e in edges for x in e}
    if kind == "cyclic":
        assert not {300, 301, 302} & set(lab) and lab[201].more
    if kind == "forest":
        assert not any(r.more for r in lab.values())


def test_longest_depth(spark):
    edges = [("x", "a"), ("a", "b"), ("b", "root"), ("x", "root"), ("y", "root"), ("x", "a")]
    got = {r.term: r.depth for r in intervals.longest_depth(frame(spark, "src string, dst string", edges)).collect()}
    assert got == {"root": 0, "b": 1, "y": 1, "a": 2, "x": 3}
    with pytest.raises(ValueError, match="cycle"):
        intervals.longest_depth(frame(spark, "src string, dst string", [("a", "b"), ("b", "a")])).collect()


def test_silent_candidates_take_part_in_ranks(spark):
    # A contradicts, B and C say nothing: A comes third
    candidates = frame(spark, "candidate string, node string, mask int", [("A", "n", 2), ("B", "z", 1), ("C", "n", 3), ("X", "m", 1), ("X", "k", 2), ("Y", "m", 1), ("Z", "m", 1), ("out", "n", 1)])
    pool = frame(spark, "candidate string", [(c,) for c in ["A", "B", "C", "X", "Y", "Z", "A"]])
    observed = frame(spark, "grp string, node string, expected int", [("one", "n", 1), ("two", "m", 1), ("two", "k", 1), ("none", "q", 1)])
    got = {(r.grp, r.candidate): (r.agree, r.disagree, r.ambiguous, r.candidates, r["rank"], r["unique"]) for r in scoring.rank_explanations(candidates, observed, pool, "grp", "candidate").collect()}
    assert got == {
        ("one", "A"): (0, 1, 0, 1, 6, True),
        ("one", None): (0, 0, 1, 5, 1, False),
        ("two", "Y"): (1, 0, 1, 1, 1, False),
        ("two", "Z"): (1, 0, 1, 1, 1, False),
        ("two", None): (0, 0, 2, 3, 3, False),
        ("two", "X"): (1, 1, 0, 1, 6, True),
        ("none", None): (0, 0, 1, 6, 1, False),
    }


def test_comparisons_of_configurations(spark):
    rows = lambda *x: frame(spark, "iv_id string, node string, mask int", list(x))
    full = rows(("i", "a", 1), ("i", "b", 3), ("i", "c", 2), ("i", "d", None), ("i", "e", 1))
    other = rows(("i", "a", 3), ("i", "b", 1), ("i", "c", 1), ("i", "d", 3), ("i", "e", 1))
    assert tuple(ablation.compare_forward(full, other, ["iv_id", "node"]).first()) == (3, 1, 1, 1)
    with pytest.raises(ValueError, match="same pairs"):
        ablation.compare_forward(full, rows(("i", "a", 1)), ["iv_id", "node"])
    ranks = lambda *x: frame(spark, "gene string, rank long", list(x))
    got = ablation.compare_ranks(ranks(("g", 1), ("h", 5), ("k", 2)), ranks(("g", 4), ("h", 3), ("k", 2)), "gene").first()
    assert tuple(got) == (2, 1, 1, 3)
    with pytest.raises(ValueError, match="same keys"):
        ablation.compare_ranks(ranks(("g", 1)), ranks(("h", 1)), "gene")


def test_layers_are_added_one_after_another(spark):
    arcs = lambda *x: frame(spark, "src string, dst string, m int, ord int", [(*a, 0) for a in x])
    causal, made, told = arcs(("a", "b", 1)), arcs(("b", "c", 1), ("a", "b", 2)), arcs(("a", "c", 2), ("c", "d", 1))
    parts = frame(spark, "micro string, macro string, m int", [("d", "whole", 2)])
    clamp = frame(spark, "iv_id string, node string, mask int", [("i", "a", 1)])
    seen = frame(spark, "iv_id string, node string, expected int", [("i", n, 1) for n in ("b", "c", "whole")])
    got = {r.configuration: r for r in ablation.layer_ablation(causal, made, told, parts, clamp, seen).collect()}
    row = lambda k: tuple(got[k])[1:]
    # causal, production, quantitative, constitutive; determinate, predicted; correct, wrong, abstain; changes
    assert row("causal_only") == (1, 0, 0, 0, 2, 2, 1, 0, 2, 0, 0, 0, 0)
    assert row("causal_production") == (1, 1, 0, 0, 3, 3, 2, 0, 1, 1, 0, 1, 0)
    assert row("causal_production_quantitative") == (1, 1, 2, 0, 2, 4, 1, 0, 2, 0, 0, 0, 0)
    assert row("full_evaluated_fragment") == (1, 1, 2, 1, 2, 5, 1, 0, 2, 0, 0, 0, 0)


def test_a_map_within_a_larger_one(spark):
    arcs = lambda *x: frame(spark, "src string, dst string, m int", list(x))
    clamp = frame(spark, "iv_id string, node string, mask int", [("i", "a", 1)])
    seen = frame(spark, "iv_id string, node string, expected int, critical boolean", [("i", "b", 1, True), ("i", "c", 1, False), ("i", "far", 1, True)])
    got = {r.group: tuple(r)[1:] for r in ablation.subsystem_comparison(arcs(("a", "b", 1), ("b", "c", 1)), arcs(("a", "z", 1), ("z", "c", 2), ("c", "far", 1)), clamp, seen).collect()}
    assert got == {"all": (2, 2, 2, 1, 1), "critical": (1, 1, 1, 1, 1)}
