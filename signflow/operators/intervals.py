"""Reachability in hierarchies by interval labels, without the table of all pairs.

Each node keeps one of its parents; that makes a forest.  Its nodes are
numbered so that a node's own number and those of all below it are one
interval, and a question is a comparison of two numbers.  Only nodes with a
second parent somewhere above them can be below more than their interval says;
questions about these are searched for, over all parents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signflow.functions.storage import numbered, store
from signflow.operators.reach import descendants, levels


def _jump(up: DataFrame, add: str, also: str | None = None) -> DataFrame:
    """(node, total[, any]): ``add`` summed and ``also`` or-ed over a node and all above it in a forest (node, parent, …); nodes that reach no root are left out.

    Every round doubles how far a node has looked, so a chain of n takes log n rounds.
    """
    cur = store(up.select("node", F.col("parent").alias("at"), F.col(add).cast("long").alias("total"), (F.col(also) if also else F.lit(False)).alias("any")), "jump")
    left = cur.where("at is not null").count()
    while left:
        far = cur.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("total").alias("more"), F.col("any").alias("also"))
        j = cur.join(far, "at", "left")
        cur = store(j.select("node", F.col("next").alias("at"), (F.col("total") + F.coalesce("more", F.lit(0))).alias("total"), (F.col("any") | F.coalesce("also", F.lit(False))).alias("any")), "jump")
        now = cur.where("at is not null").count()
        if now == left:
            break  # what is left goes round in circles
        left = now
    return cur.where("at is null").select("node", "total", "any")


def labels(edges: DataFrame) -> DataFrame:
    """(node, first, last, more): the interval of each node over (src, dst), src below dst.

    ``more`` tells that a node above it, or itself, has a second parent.  Nodes
    whose kept parents lead round a cycle have no label.
    """
    e = store(edges.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct(), "hierarchy")
    kept = e.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("parent"), (F.count("*") > 1).alias("second"))
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    up = store(nodes.join(kept, "node", "left").select("node", "parent", F.coalesce("second", F.lit(False)).alias("second"), F.lit(1).alias("one")), "forest")
    deep = store(_jump(up, "one", "second"), "depths")
    tree = store(up.join(deep, "node").select("node", "parent", F.col("total").alias("depth"), F.col("any").alias("more")), "forest")
    # sizes, from the deepest nodes up
    top = tree.agg(F.max("depth")).first()[0] or 0
    sizes = None
    below = tree.where("false").select(F.col("parent").alias("node"), F.lit(0).cast("long").alias("size"))
    for k in range(top, 0, -1):
        at = tree.where(F.col("depth") == k).join(below, "node", "left").select("node", "parent", (F.coalesce("size", F.lit(0)) + 1).alias("size"))
        at = store(at, "sizes")
        sizes = at if sizes is None else sizes.unionByName(at)
        below = at.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("size"))
    if sizes is None:
        return tree.select("node", F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("last"), "more")
    # a node begins after its parent and the parent's children before it; roots follow each other
    run = store(numbered(sizes, F.col("parent").asc_nulls_first(), "node", total="size"), "siblings")
    base = run.groupBy(F.col("parent").alias("of")).agg(F.min("size_before").alias("base"))
    placed = run.join(base, F.col("parent").eqNullSafe(F.col("of"))).select("node", "parent", (F.col("size_before") - F.col("base") + F.when(F.col("parent").isNull(), 0).otherwise(1)).alias("step"))
    first = _jump(store(placed, "steps"), "step")
    return store(first.join(sizes.select("node", "size"), "node").join(tree.select("node", "more"), "node").select("node", F.col("total").alias("first"), (F.col("total") + F.col("size") - 1).alias("last"), "more"), "labels")


def is_below(pairs: DataFrame, edges: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """The rows of ``pairs`` (part, whole, …) with ``below``: whether steps of (src, dst) lead from part to whole; a node isn't below itself unless a cycle leads back.

    Intervals settle what they can; the rest, parts with a second way up and
    parts without a label, is searched step by step over all edges.
    """
    lab = labels(edges) if labelled is None else labelled
    a, b = lab.select(F.col("node").alias("part"), F.col("first").alias("p"), "more"), lab.select(F.col("node").alias("whole"), F.col("first").alias("w0"), F.col("last").alias("w1"))
    asked = store(pairs.select("part", "whole").distinct().join(a, "part", "left").join(b, "whole", "left"), "asked")
    e = edges.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct()
    known = store(e.select(F.col("src").alias("part")).distinct(), "has-parents")
    inside = F.coalesce(F.col("p").between(F.col("w0"), F.col("w1")) & (F.col("part") != F.col("whole")), F.lit(False))
    open_ = asked.where(~inside & (F.coalesce("more", F.lit(True)))).join(known, "part", "left_semi")
    open_ = store(open_.select("part", "whole"), "open")
    # from the parents on, so that a node is below itself only around a cycle
    seeds = open_.select("part").distinct().join(e.withColumnRenamed("src", "part"), "part").select(F.col("part").alias("iv_id"), F.col("dst").alias("node"))
    more = descendants(e, seeds).select(F.col("iv_id").alias("part"), F.col("node").alias("whole")).join(open_, ["part", "whole"], "left_semi") if not open_.isEmpty() else open_
    sure = asked.where(inside).select("part", "whole").unionByName(more.select("part", "whole")).distinct().withColumn("below", F.lit(True))
    return pairs.join(sure, ["part", "whole"], "left").withColumn("below", F.coalesce("below", F.lit(False)))


def longest_depth(edges: DataFrame) -> DataFrame:
    """(term, depth): of every node of an acyclic hierarchy (src below dst) the longest way up to a root; a cycle raises."""
    down = edges.where("src is not null and dst is not null").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return levels(down).select(F.col("node").alias("term"), F.col("level").alias("depth"))
