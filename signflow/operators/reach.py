"""Reachability on the signed double cover, batched over interventions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signflow.functions.signs import MINUS, PLUS
from signflow.functions.storage import fixpoint, store
from signflow.operators.compact import MAX_ARCS, SHARED, Compact, by_broadcast, by_piece, few, small


def double_cover(arcs: DataFrame) -> DataFrame:
    """(src, dst, flip): an arc of either sign once, an undetermined one both ways; self-loops have no effect."""
    flips = F.when(F.col("m") == PLUS, F.array(F.lit(0))).when(F.col("m") == MINUS, F.array(F.lit(1))).when(F.col("m") == 3, F.array(F.lit(0), F.lit(1)))
    return arcs.where("src <> dst").select("src", "dst", F.explode(flips).alias("flip")).distinct()


def signed_reach(arcs: DataFrame, interventions: DataFrame, max_arcs: int = MAX_ARCS) -> DataFrame:
    """(iv_id, node, mask): the least fixpoint of sign propagation from the clamps.

    ``interventions`` has (iv_id, node, mask).  Arcs into clamped nodes are cut
    for that intervention.  The operator is monotone, so its fixpoint is
    reachability of (node, polarity) pairs; what is reached both ways is
    undetermined.  Graphs within ``max_arcs`` are broadcast and searched by
    tasks of many interventions; larger ones, and where interventions are many,
    in pieces that fit in a task; in what is larger still (of a ``max_arcs`` of
    zero, in all) a frontier of all interventions is joined with the arcs,
    round by round.
    """
    arcs = store(arcs.select("src", "dst", "m"), "arcs")
    iv, kind = dict(interventions.dtypes)["iv_id"], dict(arcs.dtypes)["src"]
    schema = f"iv_id {iv}, node {kind}, mask int"

    def run(graph: Compact, _: Compact | None, clamps: dict) -> list[tuple]:
        at, mask = graph.reach(clamps)
        known = dict(zip(graph.names[at].tolist(), mask.tolist()))
        return list((clamps | known).items())

    # a search in a broadcast graph goes over arrays of all its nodes
    if small(arcs, max_arcs) and (small(arcs, min(max_arcs, SHARED)) or few(interventions)):
        return by_broadcast(arcs, interventions, run, schema)
    if not max_arcs:
        return joined_reach(arcs, interventions)
    near, far_arcs, far = by_piece(arcs, interventions, run, schema)
    return near if far is None else near.unionByName(joined_reach(far_arcs, far))


def joined_reach(arcs: DataFrame, interventions: DataFrame) -> DataFrame:
    """``signed_reach`` by joins alone, at any size: work is the frontier times its out-degree."""
    cover = store(double_cover(arcs), "cover")
    clamps = interventions.select("iv_id", F.col("node").alias("dst"))
    seed = interventions.select("iv_id", "node", F.explode(F.when(F.col("mask") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.when(F.col("mask") == MINUS, 1).otherwise(0)))).alias("minus"))

    def step(front: DataFrame) -> DataFrame:
        out = front.join(cover, front.node == cover.src).select("iv_id", "dst", F.col("minus").bitwiseXOR(F.col("flip")).alias("minus"))
        return out.join(clamps, ["iv_id", "dst"], "left_anti").withColumnRenamed("dst", "node")

    got = fixpoint(seed, step, "reach")
    return got.groupBy("iv_id", "node").agg(F.bit_or(F.when(F.col("minus") == 1, 2).otherwise(1)).cast("int").alias("mask"))


def descendants(pairs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(iv_id, node) reachable over (src, dst) pairs, the seeds included."""
    hops = store(pairs.select("src", "dst").distinct(), "hops")
    return fixpoint(seeds.select("iv_id", "node"), lambda f: f.join(hops, f.node == hops.src).select("iv_id", F.col("dst").alias("node")), "descendants")


def propagate_once(arcs: DataFrame, signs: DataFrame) -> DataFrame:
    """(node, mask): the sum over each node's parents with a sign, self-loops left out."""
    from signflow.functions.signs import times

    j = arcs.where("src <> dst").join(signs, arcs.src == signs.node)
    return j.groupBy("dst").agg(F.bit_or(times(F.col("mask"), F.col("m"))).cast("int").alias("mask")).withColumnRenamed("dst", "node")


def closure(pairs: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(src, dst, dist): all pairs with a path, and its least length, by rounds of one hop."""
    hops = store(pairs.select("src", "dst").distinct(), "hops")
    seen = front = store(hops.withColumn("dist", F.lit(1)), "closure")
    for k in range(2, max_rounds):
        step = front.select("src", F.col("dst").alias("via")).join(hops.withColumnRenamed("src", "via"), "via").select("src", "dst").distinct()
        front = store(step.join(seen, ["src", "dst"], "left_anti").withColumn("dist", F.lit(k)), "closure")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        if k % 8 == 0:
            seen = store(seen, "closure")
    raise RuntimeError("closure: too many rounds")


def trim(pairs: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """The pairs that stay when nodes without incoming pairs are removed again and again; empty for an acyclic graph."""
    cur = store(pairs.select("src", "dst").where("src is not null and dst is not null").distinct(), "trim")
    n = cur.count()
    for _ in range(max_rounds):
        nxt = store(cur.join(cur.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"), "trim")
        left = nxt.count()
        if left in (0, n):
            return nxt
        cur, n = nxt, left
    raise RuntimeError("trim: too many rounds")


def levels(pairs: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(node, level): longest path from a source of an acyclic graph; a cycle raises."""
    cur = store(pairs.select("src", "dst").distinct(), "levels")
    out = None
    for k in range(max_rounds):
        heads = cur.select(F.col("src").alias("node")).union(cur.select("dst")).distinct().join(cur.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
        got = store(heads.withColumn("level", F.lit(k)), "levels")
        if got.isEmpty():
            if cur.isEmpty():
                return out if out is not None else got
            raise ValueError("the graph has a cycle")
        last = cur.select(F.col("dst").alias("node")).distinct()
        rest = store(cur.join(got.select(F.col("node").alias("src")), "src", "left_anti").select("src", "dst"), "levels")
        # targets that lose their last incoming pair without being a source themselves end here
        ends = last.join(rest.select(F.col("src").alias("node")).union(rest.select("dst")).distinct(), "node", "left_anti").withColumn("level", F.lit(k + 1))
        out = got if out is None else out.unionByName(got)
        out = store(out.unionByName(ends), "levels")
        cur = rest
        if cur.isEmpty():
            return out
    raise RuntimeError("levels: too many rounds")
