"""Hop distances from many sources at once, 64 of them in a long."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signflow.functions.storage import numbered, store

BITS = 64


def hop_distances(arcs: DataFrame, sources: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(iv_id, node, dist) of every node that a source reaches over (src, dst), the sources at 0.

    ``sources`` has (iv_id, node); one ``iv_id`` may have several nodes.  The
    sources are numbered and each group of 64 shares one row per node, a bit a
    source.  A round joins the bits that are new with the arcs and gathers them
    by ``bit_or``; what was reached before is masked out.  No paths are carried.
    """
    hops = store(arcs.where("src <> dst").select("src", "dst").distinct(), "hops")
    named = store(numbered(sources.select("iv_id").distinct(), "iv_id"), "sources")
    bit = F.expr(f"shiftleft(1L, cast(number % {BITS} as int))")
    start = sources.select("iv_id", "node").distinct().join(named, "iv_id").select(F.floor(F.col("number") / BITS).alias("grp"), "node", bit.alias("bits"))
    front = store(start.groupBy("grp", "node").agg(F.bit_or("bits").alias("bits")).withColumn("dist", F.lit(0)), "distances")
    found, seen, k = front, front.select("grp", "node", "bits"), 0
    while max_hops is None or k < max_hops:
        k += 1
        step = front.join(hops, front.node == hops.src).select("grp", F.col("dst").alias("node"), "bits", F.lit(None).cast("long").alias("old"))
        known = seen.select("grp", "node", F.lit(None).cast("long").alias("bits"), F.col("bits").alias("old"))
        both = step.unionByName(known).groupBy("grp", "node").agg(F.bit_or("bits").alias("bits"), F.coalesce(F.bit_or("old"), F.lit(0)).alias("old"))
        new = F.col("bits").bitwiseAND(F.bitwise_not("old"))
        front = store(both.where(new != 0).select("grp", "node", new.alias("bits"), F.lit(k).alias("dist")), "distances")
        if front.isEmpty():
            break
        found, seen = found.unionByName(front), seen.unionByName(front.select("grp", "node", "bits"))
        if k % 8 == 0:
            found = store(found, "distances")
            seen = store(seen.groupBy("grp", "node").agg(F.bit_or("bits").alias("bits")), "distances-seen")
    # from bits back to sources
    which = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.getbit("bits", i) == 1)
    rows = found.select("grp", "node", "dist", F.explode(which).alias("b")).select((F.col("grp") * BITS + F.col("b")).alias("number"), "node", "dist")
    return rows.join(named, "number").select("iv_id", "node", "dist")


def pairwise(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, dist) of all chosen nodes (node), a < b, over undirected arcs; pairs without a path are left out."""
    both = arcs.select("src", "dst").unionByName(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    chosen = nodes.select("node").distinct()
    found = hop_distances(both, chosen.select(F.col("node").alias("iv_id"), "node"))
    return found.join(chosen, "node", "left_semi").where("iv_id < node").select(F.col("iv_id").alias("a"), F.col("node").alias("b"), "dist")
