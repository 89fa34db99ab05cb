"""Comparative statics per intervention, each on its own surgered graph.

Singletons are solved by propagation, small strongly connected components by
sign determinants, large ones by the loop fixpoint, in topological order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signflow.functions.signs import mul, neg, times
from signflow.functions.storage import fixpoint, store
from signflow.operators.compact import MAX_ARCS, MAX_CONE, SHARED, Compact, by_broadcast, by_cone, by_piece, clamped, cones, pieces, small
from signflow.operators.reach import double_cover, levels

EXACT_MAX = 16

Arcs = dict[str, list[tuple[str, int]]]


def strong_components(nodes, children) -> list[list]:
    """Strongly connected components, each after all those it leads to (reverse topological order); no recursion."""
    index, low, stack, on, out = {}, {}, [], set(), []
    for root in nodes:
        if root in index:
            continue
        work = [(root, iter(children(root)))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(children(w))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    comp = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        comp.append(w)
                        if w == v:
                            break
                    out.append(comp)
    return out


def sign_determinant(matrix: list[list[int]]) -> int:
    """The mask of a sign matrix's determinant: the sum over its non-zero permutation terms, row by row over sets of used columns."""
    full, states = (1 << len(matrix)) - 1, {0: 1}
    for row in matrix:
        new: dict[int, int] = {}
        for used, value in states.items():
            for c, entry in enumerate(row):
                if entry and not used >> c & 1:
                    term = mul(entry, value)
                    if (used >> (c + 1)).bit_count() & 1:
                        term = neg(term)
                    key = used | 1 << c
                    new[key] = new.get(key, 0) | term
        states = new
    return states.get(full, 0)


def solve_component(members: list, parents, sign: dict, forcing: dict, exact_max: int) -> dict:
    """Signs of a component of two or more nodes; ``parents(n)`` yields (node, mask) over all arcs into n."""
    inside = {n: i for i, n in enumerate(members)}
    b, within = [], []
    for n in members:
        acc, own = forcing.get(n, 0), []
        for p, m in parents(n):
            if p in inside:
                if p != n:
                    own.append((inside[p], m))
            else:
                acc |= mul(sign.get(p, 0), m)
        b.append(acc)
        within.append(own)
    size = len(members)
    if size <= exact_max:
        jac = [[0] * size for _ in members]
        for i, own in enumerate(within):
            jac[i][i] = 2
            for j, m in own:
                jac[i][j] = m
        out = {}
        for n, i in inside.items():
            num = sign_determinant([[neg(b[r]) if c == i else x for c, x in enumerate(row)] for r, row in enumerate(jac)])
            out[n] = neg(num) if size % 2 else num
        return out
    value = list(b)
    children: list[list[tuple[int, int]]] = [[] for _ in members]
    for i, own in enumerate(within):
        for j, m in own:
            children[j].append((i, m))
    todo = [i for i, v in enumerate(value) if v]
    while todo:
        i = todo.pop()
        for j, m in children[i]:
            new = value[j] | mul(value[i], m)
            if new != value[j]:
                value[j] = new
                todo.append(j)
    return {n: value[i] for n, i in inside.items()}


def solve_map(arcs: list[tuple], clamps: dict, constitutive: list[tuple] = (), exact_max: int = EXACT_MAX) -> dict:
    """node -> mask for what the clamps reach; determination enters a constituted node as forcing."""
    into: dict = {}
    out: dict = {}
    up: dict = {}
    for s, d, m in arcs:
        if d not in clamps:
            into.setdefault(d, []).append((s, m))
            out.setdefault(s, []).append(d)
    both = {k: list(v) for k, v in out.items()}
    for micro, macro, m in constitutive:
        up.setdefault(macro, []).append((micro, m))
        both.setdefault(micro, []).append(macro)
    reach, todo = set(clamps), list(clamps)
    while todo:
        for w in both.get(todo.pop(), ()):
            if w not in reach:
                reach.add(w)
                todo.append(w)
    # only what is reached can carry a sign; a component is reached whole or not at all
    comps = strong_components(sorted(reach), lambda v: out.get(v, ()))
    comp_of = {n: k for k, c in enumerate(comps) for n in c}
    order = strong_components(range(len(comps)), lambda k: {comp_of[w] for n in comps[k] for w in both.get(n, ()) if w in comp_of and comp_of[w] != k})
    if any(len(c) > 1 for c in order):
        raise ValueError("causal and constitutive edges form a cycle across scales")
    sign = dict(clamps)
    for (k,) in reversed(order):
        members = comps[k]
        forcing = {}
        for n in members:
            acc = 0
            for micro, m in up.get(n, ()):
                acc |= mul(sign.get(micro, 0), m)
            if acc:
                forcing[n] = acc
        if len(members) == 1:
            (n,) = members
            if n not in clamps:
                acc = forcing.get(n, 0)
                for p, m in into.get(n, ()):
                    if p != n:
                        acc |= mul(sign.get(p, 0), m)
                sign[n] = acc
        else:
            got = solve_component(sorted(members), lambda n: into.get(n, ()), sign, forcing, exact_max)
            sign.update({n: v for n, v in got.items() if n not in clamps})
    return {n: sign[n] for n in reach if sign.get(n)}


def solve(arcs: DataFrame, interventions: DataFrame, constitutive: DataFrame | None = None, exact_max: int = EXACT_MAX, max_arcs: int = MAX_ARCS, max_cone: int = MAX_CONE) -> DataFrame:
    """(iv_id, node, mask) of each intervention, with exact and loop components; nodes that don't move are left out.

    ``arcs`` (src, dst, m) and ``constitutive`` (micro, macro, m) are broadcast
    within ``max_arcs``.  A larger graph is solved in pieces that fit in a
    task, and what it constitutes, where that has no arcs of its own, after it.
    In what is larger still (of a ``max_arcs`` of zero, in all) each
    intervention's cone is found by joins; cones within ``max_cone`` arcs are
    solved in a task each, and larger ones level by level with joins.  All ways
    give the same signs.
    """
    kind, iv = dict(arcs.dtypes)["src"], dict(interventions.dtypes)["iv_id"]
    schema = f"iv_id {iv}, node {kind}, mask int"
    arcs = store(arcs.select("src", "dst", "m"), "arcs")

    def run(graph: Compact, also: Compact | None, clamps: dict) -> list[tuple]:
        own, more = graph.cone(clamps, also)
        return list(solve_map(own, clamps, more, exact_max).items())

    if small(arcs, max_arcs) and (constitutive is None or small(constitutive, max_arcs)):
        return by_broadcast(arcs, interventions, run, schema, constitutive)
    if max_arcs and constitutive is None:
        near, far_arcs, far = by_piece(arcs, interventions, run, schema, max_cone)
        return near if far is None else near.unionByName(_by_cones(far_arcs, far, None, exact_max, max_cone, schema))
    if max_arcs and _on_top(arcs, interventions, constitutive):
        from signflow.operators.multiscale import upward

        return upward(solve(arcs, interventions, None, exact_max, max_arcs, max_cone), constitutive).select("iv_id", "node", "mask")
    return _by_cones(arcs, interventions, constitutive, exact_max, max_cone, schema)


def _on_top(arcs: DataFrame, interventions: DataFrame, constitutive: DataFrame) -> bool:
    """Whether what is constituted has no causal arcs and isn't clamped, so that determination follows causation."""
    touched = arcs.select(F.col("src").alias("node")).union(arcs.select("dst")).union(interventions.select("node"))
    return touched.join(constitutive.select(F.col("macro").alias("node")).distinct(), "node", "left_semi").isEmpty()


def _by_cones(arcs: DataFrame, interventions: DataFrame, constitutive: DataFrame | None, exact_max: int, max_cone: int, schema: str) -> DataFrame:
    own, more = cones(arcs, interventions, constitutive)
    sizes = own.groupBy("iv_id").agg(F.count("*").alias("n"))
    large = store(sizes.where(F.col("n") > max_cone).select("iv_id"), "large")
    if large.isEmpty():
        return by_cone(own, interventions, lambda a, c, clamps: list(solve_map(a, clamps, c, exact_max).items()), schema, more)
    part = lambda df, how: df.join(large, "iv_id", how) if df is not None else None
    near = by_cone(part(own, "left_anti"), part(interventions, "left_anti"), lambda a, c, clamps: list(solve_map(a, clamps, c, exact_max).items()), schema, part(more, "left_anti"))
    return near.unionByName(solve_by_levels(part(own, "left_semi"), part(interventions, "left_semi"), part(more, "left_semi"), exact_max))


def solve_by_levels(own: DataFrame, interventions: DataFrame, more: DataFrame | None = None, exact_max: int = EXACT_MAX) -> DataFrame:
    """The same from cones (iv_id, src, dst, m) and (iv_id, micro, macro, m) by joins alone, one level of components after another.

    Nodes of different interventions are told apart as (iv_id, node) pairs, so
    all are solved at once.  A task never holds more than one small component.
    """
    iv, kind = dict(interventions.dtypes)["iv_id"], dict(own.dtypes)["src"]
    key = lambda c: F.struct("iv_id", F.col(c).alias("node"))
    a = store(own.where("src <> dst").select(key("src").alias("src"), key("dst").alias("dst"), "m"), "level-arcs")
    c = more.select(key("micro").alias("src"), key("macro").alias("dst"), "m") if more is not None else a.limit(0)
    c = store(c, "level-parts")
    clamps = store(clamped(interventions).select(key("node").alias("node"), "mask"), "level-clamps")
    nodes = a.select(F.col("src").alias("node")).union(a.select("dst")).union(c.select("src")).union(c.select("dst")).union(clamps.select("node")).distinct()
    of_arcs = coloured_components(a.select("src", "dst").distinct())
    comp = store(nodes.join(of_arcs, "node", "left").select("node", F.coalesce("scc", "node").alias("scc")), "level-sccs")
    s, d = comp.select(F.col("node").alias("src"), F.col("scc").alias("s")), comp.select(F.col("node").alias("dst"), F.col("scc").alias("d"))
    placed = store(a.withColumn("causal", F.lit(True)).unionByName(c.withColumn("causal", F.lit(False))).join(s, "src").join(d, "dst"), "level-placed")
    between = placed.where("s <> d").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct()
    level = levels(between)
    size = comp.groupBy("scc").agg(F.count("*").alias("size"))
    at = comp.join(level.withColumnRenamed("node", "scc"), "scc", "left").join(size, "scc").select("node", "scc", "size", F.coalesce("level", F.lit(0)).alias("level"))
    at = store(at.join(clamps.select("node"), "node", "left_anti"), "level-nodes")
    top = at.agg(F.max("level")).first()[0]
    inside = placed.where("s = d and causal").select(F.col("s").alias("scc"), "src", "dst", "m")
    outer = placed.where("s <> d or not causal").select("src", "dst", "m")
    sign = clamps
    for k in range(-1 if top is None else top + 1):
        here = store(at.where(F.col("level") == k), "level")
        force = outer.join(sign.withColumnRenamed("node", "src"), "src").join(here.select(F.col("node").alias("dst")), "dst", "left_semi").groupBy(F.col("dst").alias("node")).agg(F.bit_or(times(F.col("mask"), F.col("m"))).cast("int").alias("mask"))
        forced = store(here.join(force, "node", "left").select("node", "scc", "size", F.coalesce("mask", F.lit(0)).cast("int").alias("mask")), "level")
        got = forced.where("size = 1").select("node", "mask")
        mid = forced.where((F.col("size") > 1) & (F.col("size") <= exact_max))
        if not mid.isEmpty():
            links = inside.join(mid.select("scc").distinct(), "scc", "left_semi")

            def exact(members: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
                force = dict(zip(members.name.tolist(), members["mask"].tolist()))
                into: dict = {}
                for x, y, m in zip(pairs.src.tolist(), pairs.dst.tolist(), pairs.m.tolist()):
                    into.setdefault(y, []).append((x, m))
                out = solve_component(sorted(force), lambda n: into.get(n, ()), {}, force, exact_max)
                return pd.DataFrame({"iv": members.iv.iloc[0], "name": list(out), "mask": list(out.values())})

            flat = mid.select("scc", F.col("node.iv_id").alias("iv"), F.col("node.node").alias("name"), "mask")
            ends = links.select("scc", F.col("src.node").alias("src"), F.col("dst.node").alias("dst"), "m")
            done = flat.groupBy("scc").cogroup(ends.groupBy("scc")).applyInPandas(exact, f"iv {iv}, name {kind}, mask int")
            got = got.unionByName(done.select(F.struct(F.col("iv").alias("iv_id"), F.col("name").alias("node")).alias("node"), "mask"))
        big = forced.where(F.col("size") > exact_max)
        if not big.isEmpty():
            cover = store(double_cover(inside.join(big.select("scc").distinct(), "scc", "left_semi")), "level-cover")
            seed = big.where("mask > 0").select("node", F.explode(F.when(F.col("mask") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.col("mask") - 1))).alias("minus"))
            both = fixpoint(seed, lambda f, cover=cover: f.join(cover, f.node == cover.src).select(F.col("dst").alias("node"), F.col("minus").bitwiseXOR(F.col("flip")).alias("minus")), "level-loop")
            got = got.unionByName(both.groupBy("node").agg(F.bit_or(F.col("minus") + 1).cast("int").alias("mask")))
        sign = sign.unionByName(store(got.where("mask > 0"), "level-signs"))
        if k % 8 == 7:
            sign = store(sign, "level-signs")
    return sign.select("node.iv_id", "node.node", "mask")


def components_of(arcs: DataFrame, max_arcs: int = MAX_ARCS) -> DataFrame:
    """(node, scc): every node of the arcs with the least node of its strongly connected component.

    Of a graph that falls into pieces, tasks find those of each piece of up to
    ``max_arcs`` in linear time; in larger pieces colours spread forwards and
    backwards by joins.
    """
    kind = dict(arcs.dtypes)["src"]
    pairs = store(arcs.select("src", "dst").where("src is not null and dst is not null"), "pairs")
    if not small(pairs, min(max_arcs, SHARED)):
        return _components_by_piece(pairs, max_arcs) if max_arcs else coloured_components(pairs.distinct())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield _components(list(frames))

    return pairs.coalesce(1).mapInPandas(run, f"node {kind}, scc {kind}")


def _spread(start: np.ndarray, heads: np.ndarray, first: int, rounds: int = 1_000) -> np.ndarray | None:
    """Which nodes ``first`` reaches over arcs in order of their source; None where that takes more rounds."""
    seen, front = np.zeros(len(start) - 1, bool), np.array([first])
    seen[first] = True
    for _ in range(rounds):
        n = start[front + 1] - start[front]
        ends = np.cumsum(n)
        to = heads[np.arange(ends[-1]) + np.repeat(start[front] - ends + n, n)]
        front = np.unique(to[~seen[to]])
        if not len(front):
            return seen
        seen[front] = True
    return None


def _around_hub(s: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` nodes share the component of the one with the most arcs in and out; none where the search is long."""
    into, out = np.bincount(d, minlength=n), np.bincount(s, minlength=n)
    hub = int(np.argmax(np.minimum(into, out)))
    at = lambda deg: np.concatenate([[0], np.cumsum(deg)])
    ahead = _spread(at(out), d[np.argsort(s, kind="stable")], hub)
    behind = _spread(at(into), s[np.argsort(d, kind="stable")], hub) if ahead is not None else None
    return ahead & behind if behind is not None else np.zeros(n, bool)


def _components(frames: list[pd.DataFrame]) -> pd.DataFrame:
    """(node, scc) of some arcs; of a large graph the component of its hub is found over arrays, the rest node by node."""
    src, dst = (np.concatenate([pdf[c].to_numpy() for pdf in frames]) if frames else np.zeros(0, np.int64) for c in ("src", "dst"))
    names, code = np.unique(np.concatenate([src, dst]), return_inverse=True)
    s, d = code[: len(src)], code[len(src) :]
    hub = _around_hub(s, d, len(names)) if len(s) > 10_000 else np.zeros(len(names), bool)
    scc = np.full(len(names), int(np.argmax(hub)) if hub.any() else 0)
    out: dict = {n: [] for n in np.flatnonzero(~hub).tolist()}
    rest = ~hub[s] & ~hub[d]
    for a, b in zip(s[rest].tolist(), d[rest].tolist()):
        out[a].append(b)
    for c in strong_components(out, out.__getitem__):
        scc[c] = min(c)
    return pd.DataFrame({"node": names, "scc": names[scc]})


def _components_by_piece(pairs: DataFrame, max_arcs: int) -> DataFrame:
    kind = dict(pairs.dtypes)["src"]
    cut, _ = pieces(pairs)
    size = store(cut.groupBy("piece").agg(F.count("*").alias("n")), "piece-sizes")
    total, large, over = size.agg(F.sum("n"), F.count_if(F.col("n") > SHARED), F.count_if(F.col("n") > max_arcs)).first()
    tasks = max(total // SHARED, 4 * large, pairs.sparkSession.sparkContext.defaultParallelism)
    key = F.when(F.col("n") > SHARED, F.concat(F.lit("own:"), F.col("piece").cast("string"))).otherwise(F.pmod(F.xxhash64("piece"), F.lit(tasks)).cast("string"))
    near = cut.join(size.where(F.col("n") <= max_arcs), "piece").select("src", "dst", key.alias("__task")).repartition(tasks, "__task")
    got = near.groupBy("__task").applyInPandas(lambda pdf: _components([pdf]), f"node {kind}, scc {kind}")
    if not over:
        return got
    far = cut.join(size.where(F.col("n") > max_arcs), "piece", "left_semi").select("src", "dst").distinct()
    return got.unionByName(coloured_components(far))


def coloured_components(pairs: DataFrame) -> DataFrame:
    """The same by joins alone: each node takes the least node that reaches it; those that reach back share a component."""
    left = store(pairs.where("src is not null and dst is not null"), "scc")
    nodes = store(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct(), "scc")
    done = None
    while not nodes.isEmpty():
        colour = store(nodes.withColumn("colour", F.col("node")), "scc")
        while True:
            spread = left.join(colour.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "colour")
            new = store(colour.unionByName(spread).groupBy("node").agg(F.min("colour").alias("colour")), "scc")
            if new.exceptAll(colour).isEmpty():
                break
            colour = new
        one = left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("cd")), "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("colour"))
        one = store(one, "scc")
        seed = colour.where("node = colour").select("colour", "node")
        back = fixpoint(seed, lambda f: f.join(one.withColumnRenamed("dst", "node"), ["colour", "node"]).select("colour", F.col("src").alias("node")), "scc")
        got = store(back.select("node", F.col("colour").alias("scc")), "scc")
        done = got if done is None else done.unionByName(got)
        nodes = store(nodes.join(got, "node", "left_anti"), "scc")
        left = store(left.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"), "scc")
    return done if done is not None else nodes.withColumn("scc", F.col("node"))


def condensation(arcs: DataFrame, sccs: DataFrame) -> DataFrame:
    """(src, dst) between different components, each once."""
    a = sccs.select(F.col("node").alias("src"), F.col("scc").alias("s"))
    b = sccs.select(F.col("node").alias("dst"), F.col("scc").alias("d"))
    return arcs.select("src", "dst").join(a, "src").join(b, "dst").where("s <> d").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct()
