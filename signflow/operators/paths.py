"""Paths, neighbourhoods, labels, acyclification, moral graphs and determined nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signflow.functions.signs import mul, times
from signflow.functions.storage import store
from signflow.operators.compact import MAX_ARCS, by_broadcast, by_cone, cones, small


def bfs(arcs: DataFrame, seeds: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(iv_id, node, dist, path, mask): a shortest path to each node, of several the lexicographically first, and its sign.

    The sign starts from the seed's own (``mask``).  Arcs into a seed of the
    same ``iv_id`` can't lie on a shortest path, so a search from several seeds
    at once needs no surgery.  Ties are settled round by round: a prefix of the
    first path is itself first, so one path per node and round is enough.  The
    search ends when nothing new is reached, or after ``max_hops`` where given.
    """
    hops = store(arcs.where("src <> dst").select("src", "dst", "m"), "hops")
    front = seen = store(seeds.select("iv_id", "node", F.lit(0).alias("dist"), F.array("node").alias("path"), F.col("mask").cast("int").alias("mask")), "bfs")
    k = 0
    while max_hops is None or k < max_hops:
        k += 1
        step = front.join(hops, front.node == hops.src).select("iv_id", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), times(F.col("mask"), F.col("m")).alias("mask"))
        best = step.groupBy("iv_id", "node").agg(F.min(F.struct("path", "mask")).alias("b"))
        new = best.join(seen.select("iv_id", "node"), ["iv_id", "node"], "left_anti")
        front = store(new.select("iv_id", "node", F.lit(k).alias("dist"), "b.path", "b.mask"), "bfs")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if k % 8 == 0:
            seen = store(seen, "bfs")
    return seen


def paths_between(arcs: list[tuple], source, target, mask: int, max_hops: int, max_paths: int) -> list[tuple[list, int]]:
    """(path, sign) of the lexicographically first simple paths of at most ``max_hops`` arcs, shorter ones before longer ones.

    The search goes on only to nodes from which the target is near enough.
    """
    out: dict = {}
    back: dict = {}
    for s, d, m in arcs:
        if s != d:
            out.setdefault(s, []).append((d, m))
            back.setdefault(d, []).append(s)
    far, front = {target: 0}, [target]
    for k in range(1, max_hops + 1):
        front = [s for d in front for s in back.get(d, ()) if s not in far and not far.update({s: k})]
    found: list[tuple[list, int]] = []
    if source == target or source not in far:
        return found
    path, signs = [source], [mask]
    work = [iter(sorted(out.get(source, ())))]
    while work and len(found) < max_paths:
        step = next(work[-1], None)
        if step is None:
            work.pop()
            path.pop()
            signs.pop()
            continue
        d, m = step
        if d in path or len(path) + far.get(d, max_hops + 1) > max_hops:
            continue
        sign = mul(signs[-1], m)
        if d == target:
            found.append(([*path, d], sign))
        else:
            path.append(d)
            signs.append(sign)
            work.append(iter(sorted(out.get(d, ()))))
    return sorted(found, key=lambda f: (len(f[0]), f[0]))


def simple_paths(arcs: DataFrame, interventions: DataFrame, targets: DataFrame, max_hops: int = 12, max_paths: int = 24, max_arcs: int = MAX_ARCS) -> DataFrame:
    """(iv_id, source, target, path, mask): for each clamp and each target (iv_id, node) the first ``max_paths`` simple paths of at most ``max_hops`` arcs.

    Both numbers are the feature's own: a trace shows so many paths of such a
    length.  Arcs into clamped nodes are cut.
    """
    kind, iv = dict(arcs.dtypes)["src"], dict(interventions.dtypes)["iv_id"]
    schema = f"iv_id {iv}, source {kind}, target {kind}, path array<{kind}>, mask int"
    arcs = store(arcs.select("src", "dst", "m"), "arcs")
    # targets travel beside the clamps, as masks of 8 and more
    marks = interventions.select("iv_id", "node", "mask").unionByName(targets.join(interventions.select("iv_id").distinct(), "iv_id", "left_semi").select("iv_id", "node", F.lit(8).alias("mask")).distinct())
    marks = store(marks, "marks")

    def run(own: list[tuple], marks: dict) -> list[tuple]:
        rows = []
        for source, m in marks.items():
            for target, t in marks.items():
                if m & 3 and t & 8:
                    rows += [(source, target, path, sign) for path, sign in paths_between(own, source, target, m & 3, max_hops, max_paths)]
        return rows

    if small(arcs, max_arcs):
        return by_broadcast(arcs, marks, lambda graph, _, marks: run(graph.cone({n: m & 3 for n, m in marks.items() if m & 3})[0], marks), schema)
    return by_cone(cones(arcs, interventions)[0], marks, lambda own, _, marks: run(own, marks), schema)


def undirected(arcs: DataFrame) -> DataFrame:
    return arcs.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(arcs.select("dst", "src")).distinct()


def neighbourhood(arcs: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(iv_id, node) within so many undirected hops, the seeds included."""
    und = store(undirected(arcs), "undirected")
    out = front = seeds.select("iv_id", "node")
    for _ in range(hops):
        front = store(front.join(und, front.node == und.a).select("iv_id", F.col("b").alias("node")).distinct(), "khop")
        out = out.union(front)
    return out.distinct()


def nearest_label(arcs: DataFrame, seeds: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(node, label, dist): the label of the nearest seed over undirected arcs, of equally near ones the smallest; a node that none reaches is left out."""
    und = store(undirected(arcs), "undirected")
    seen = front = store(seeds.groupBy("node").agg(F.min("label").alias("label")).withColumn("dist", F.lit(0)), "labels")
    k = 0
    while max_hops is None or k < max_hops:
        k += 1
        step = front.join(und, front.node == und.a).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("label"))
        front = store(step.join(seen.select("node"), "node", "left_anti").withColumn("dist", F.lit(k)), "labels")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if k % 8 == 0:
            seen = store(seen, "labels")
    return seen


def labelled(nodes: DataFrame, arcs: DataFrame, seeds: DataFrame, default: str) -> DataFrame:
    """(node, label): ``nearest_label`` of every node, with a default for what no seed reaches."""
    return nodes.select("node").join(nearest_label(arcs, seeds).select("node", "label"), "node", "left").select("node", F.coalesce("label", F.lit(default)).alias("label"))


def acyclify(arcs: DataFrame, sccs: DataFrame) -> DataFrame:
    """Each arc into a component, lifted to all of its nodes; arcs within components are left out."""
    a, b = sccs.select(F.col("node").alias("src"), F.col("scc").alias("s")), sccs.select(F.col("node").alias("dst"), F.col("scc").alias("d"))
    into = arcs.select("src", "dst").join(a, "src").join(b, "dst").where("s <> d").select("src", "d").distinct()
    return into.join(sccs.select(F.col("scc").alias("d"), F.col("node").alias("dst")), "d").select("src", "dst").distinct()


def latent_causes(sccs: DataFrame) -> DataFrame:
    """(src, dst) arcs of one latent common cause for each component of two or more nodes."""
    big = sccs.groupBy("scc").agg(F.count("*").alias("n")).where("n > 1").select("scc")
    return sccs.join(big, "scc").select(F.concat(F.lit("latent:"), F.col("scc").cast("string")).alias("src"), F.col("node").cast("string").alias("dst"))


def moralise(pairs: DataFrame) -> DataFrame:
    """Undirected edges (a < b) of the moral graph: arcs, and pairs of parents of a common child."""
    e = pairs.select("src", "dst").distinct()
    wed = e.select(F.col("src").alias("a"), "dst").join(e.select(F.col("src").alias("b"), "dst"), "dst").where("a < b").select("a", "b")
    return e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).union(wed).distinct()


def definitional(defs: DataFrame) -> DataFrame:
    """(node, parents) of nodes all of whose incoming arcs are definitional."""
    return defs.groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("parents"), F.bool_and("definitional").alias("ok")).where("ok").drop("ok")


def definitions(arcs: DataFrame, constitutive: DataFrame | None = None, ratios: DataFrame | None = None) -> DataFrame:
    """(src, dst, definitional) of all layers: arcs as they are marked, aggregations, and the two sides of a ratio (result, numerator, denominator)."""
    out = arcs.select("src", "dst", "definitional")
    if constitutive is not None:
        out = out.unionByName(constitutive.select(F.col("micro").alias("src"), F.col("macro").alias("dst"), (F.col("relation") == "aggregation").alias("definitional")))
    if ratios is not None:
        out = out.unionByName(ratios.select(F.explode(F.array("numerator", "denominator")).alias("src"), F.col("result").alias("dst"), F.lit(True).alias("definitional")))
    return out.groupBy("src", "dst").agg(F.bool_and("definitional").alias("definitional"))


def determined(defs: DataFrame, seeds: DataFrame) -> DataFrame:
    """The deterministic closure of ``seeds``: a definitional node enters once all its parents are in."""
    nodes = store(definitional(defs), "definitional")
    parents = store(defs.select("src", F.col("dst").alias("node")).distinct().join(nodes, "node"), "parents")
    inside = store(seeds.select("node").distinct(), "determined")
    while True:
        known = parents.join(inside.withColumnRenamed("node", "src"), "src", "left_semi").groupBy("node", "parents").agg(F.count("*").alias("known"))
        new = store(known.where("known = parents").select("node").join(inside, "node", "left_anti"), "determined")
        if new.isEmpty():
            return inside
        inside = store(inside.union(new), "determined")
