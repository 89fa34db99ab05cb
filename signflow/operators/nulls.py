"""Null models: signs dealt out anew, and rewiring that keeps degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signflow.functions.storage import numbered, store


def permute_signs(arcs: DataFrame, seed: int) -> DataFrame:
    """The same arcs with their signs in another order: as many of each sign as before.

    Any sign can go to any arc: arcs and signs are put in two orders by two
    hashes, and meet by their numbers.
    """
    a = store(arcs.select("src", "dst", "m"), "permute")
    left = numbered(a.select("src", "dst", F.xxhash64("src", "dst", F.lit(seed)).alias("h")), "h", "src", "dst")
    right = numbered(a.select("m", F.xxhash64("dst", "src", F.lit(seed + 1)).alias("h"), "src", "dst"), "h", "src", "dst").select("m", "number")
    return left.join(right, "number").select("src", "dst", "m")


def scale_order(arcs: DataFrame, constitutive: DataFrame) -> DataFrame:
    """(node, level): an order in which no causal arc leads down and every determination (micro, macro) leads up.

    It is the level of a node's component in the graph of components.  A graph
    with a cycle of causation and determination across scales has none; that
    raises.
    """
    from signflow.operators.reach import levels
    from signflow.operators.solve import components_of

    a = store(arcs.select("src", "dst").where("src <> dst").distinct(), "order-arcs")
    comp = store(components_of(a), "order-components")
    c = constitutive.select(F.col("micro").alias("src"), F.col("macro").alias("dst")).distinct()
    s, d = comp.select(F.col("node").alias("src"), F.col("scc").alias("s")), comp.select(F.col("node").alias("dst"), F.col("scc").alias("d"))
    both = a.withColumn("up", F.lit(False)).unionByName(c.withColumn("up", F.lit(True))).join(s, "src", "left").join(d, "dst", "left")
    lifted = store(both.select(F.coalesce("s", "src").alias("src"), F.coalesce("d", "dst").alias("dst"), "up"), "order-lifted")
    if not lifted.where("up and src = dst").isEmpty():
        raise ValueError("a determination lies within a causal component")
    level = levels(lifted.where("src <> dst").select("src", "dst")).withColumnRenamed("node", "of")
    nodes = both.select(F.col("src").alias("node")).union(both.select("dst")).distinct().join(comp, "node", "left").withColumn("of", F.coalesce("scc", "node"))
    return store(nodes.join(level, "of", "left").select("node", F.coalesce("level", F.lit(0)).alias("level")), "order")


def rewire(arcs: DataFrame, rounds: int = 8, seed: int = 1, movable: DataFrame | None = None, order: DataFrame | None = None) -> DataFrame:
    """(src, dst, m) with the ends of pairs of arcs exchanged, round by round.

    Each node keeps its in- and out-degree, each arc its source and sign.  In a
    round all arcs are paired by a random order; a pair exchanges its ends if
    that makes neither a self-loop nor an arc that exists or that another pair
    makes.  ``movable`` (node) confines this to arcs between such nodes.

    With ``order`` (node, level), as of ``scale_order``, a pair stays as it is
    where one of its new arcs would lead down.  The order holds for the graph
    after every exchange, so none of them can close a cycle across scales.
    """
    cur = arcs.select("src", "dst", "m")
    if order is None:
        cur = cur.withColumns({"sl": F.lit(0), "dl": F.lit(0)})
    else:
        at = lambda node, name: order.select(F.col("node").alias(node), F.col("level").alias(name))
        cur = cur.join(at("src", "sl"), "src", "left").join(at("dst", "dl"), "dst", "left").select("src", "dst", "m", F.coalesce("sl", F.lit(0)).alias("sl"), F.coalesce("dl", F.lit(0)).alias("dl"))
    cur = store(cur, "rewire")
    columns = cur.columns
    still = cur.limit(0)
    if movable is not None:
        ok = store(movable.select("node").distinct(), "movable")
        free = cur.join(ok.withColumnRenamed("node", "src"), "src", "left_semi").join(ok.withColumnRenamed("node", "dst"), "dst", "left_semi")
        cur, still = store(free.select(*columns), "rewire"), store(cur.exceptAll(free.select(*columns)), "still")
    for k in range(rounds):
        n = numbered(cur.withColumn("h", F.xxhash64("src", "dst", F.lit(seed), F.lit(k))), "h", "src", "dst").withColumn("pair", F.floor(F.col("number") / 2))
        p = n.groupBy("pair").agg(F.min_by(F.struct(*columns), "number").alias("a"), F.max_by(F.struct(*columns), "number").alias("b"), F.count("*").alias("n"))
        p = store(p, "pairs")
        want = p.where("n = 2 and a.src <> b.dst and b.src <> a.dst and a.src <> a.dst and b.src <> b.dst and a.sl <= b.dl and b.sl <= a.dl")
        made = want.select("pair", F.explode(F.array(F.struct("a.src", "b.dst"), F.struct("b.src", "a.dst"))).alias("x")).select("pair", "x.src", "x.dst")
        taken = made.join(cur.select("src", "dst").union(still.select("src", "dst")).distinct(), ["src", "dst"], "left_semi").select("pair")
        double = made.groupBy("src", "dst").agg(F.count("*").alias("n")).where("n > 1").join(made, ["src", "dst"]).select("pair")
        good = store(want.select("pair").join(taken.union(double), "pair", "left_anti").withColumn("good", F.lit(True)), "good")
        q = p.join(good, "pair", "left")
        end = lambda x, y, c: F.when(F.col("good"), F.col(f"{y}.{c}")).otherwise(F.col(f"{x}.{c}")).alias(c)
        half = lambda x, y: [f"{x}.src", end(x, y, "dst"), f"{x}.m", f"{x}.sl", end(x, y, "dl")]
        cur = store(q.select(*half("a", "b")).unionByName(q.where("n = 2").select(*half("b", "a"))), "rewire")
    return cur.unionByName(still).select("src", "dst", "m")


def rewired(arcs: DataFrame, replicates: int, rounds: int = 8, seed: int = 1, movable: DataFrame | None = None, acyclic: DataFrame | None = None) -> DataFrame:
    """(replicate, src, dst, m): so many rewired graphs.

    With ``acyclic``, constitutive pairs (micro, macro), every single exchange
    is guarded (see ``rewire``), so each graph stays free of cycles across
    scales and none is drawn twice.
    """
    from functools import reduce

    order = scale_order(arcs, acyclic) if acyclic is not None else None
    return reduce(DataFrame.unionByName, [rewire(arcs, rounds, seed * 1_000 + k, movable, order).select(F.lit(k).alias("replicate"), "src", "dst", "m") for k in range(replicates)])
