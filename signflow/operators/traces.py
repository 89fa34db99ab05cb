"""Signed traces: paths with running signs, the static answer, and whether they agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signflow.functions.signs import decode
from signflow.operators.paths import simple_paths
from signflow.operators.solve import solve


def combined(arcs: DataFrame, constitutive: DataFrame) -> DataFrame:
    """(src, dst, m, kind): causal arcs and determination; where both join a pair, determination counts."""
    c = constitutive.select(F.col("micro").alias("src"), F.col("macro").alias("dst"), "m", F.lit("constitutive").alias("kind"))
    return arcs.select("src", "dst", "m", F.lit("causal").alias("kind")).join(c.select("src", "dst"), ["src", "dst"], "left_anti").unionByName(c)


def traces(arcs: DataFrame, interventions: DataFrame, targets: DataFrame, constitutive: DataFrame | None = None, max_hops: int = 12, max_paths: int = 24) -> DataFrame:
    """(iv_id, node, paths, consensus, net, agrees) of each target (iv_id, node) that a clamp leads to.

    ``paths`` are the first simple paths as text, ``consensus`` is the sign they
    have in common, or undetermined, ``net`` is the static solution.
    """
    both = combined(arcs, constitutive) if constitutive is not None else arcs
    found = simple_paths(both.select("src", "dst", "m"), interventions, targets, max_hops, max_paths)
    text = F.concat(F.array_join(F.transform("path", lambda x: x.cast("string")), " > "), F.lit(" ("), decode(F.col("mask")), F.lit(")"))
    by = found.groupBy("iv_id", F.col("target").alias("node")).agg(F.array_sort(F.collect_list(F.struct(F.size("path").alias("n"), "path", text.alias("text")))).alias("p"), F.bit_or("mask").cast("int").alias("consensus"))
    net = solve(arcs, interventions, constitutive).withColumnRenamed("mask", "net")
    out = by.join(net, ["iv_id", "node"], "left").withColumn("net", F.coalesce("net", F.lit(0)))
    return out.select("iv_id", "node", F.transform("p", lambda x: x.text).alias("paths"), "consensus", "net", (F.col("consensus") == F.col("net")).alias("agrees"))


def induced(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The arcs both of whose ends are among ``nodes``."""
    n = nodes.select("node").distinct()
    return arcs.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")


def faceted(nodes: DataFrame, arcs: DataFrame, systems: list[str], sources: list[str]) -> DataFrame:
    """(node) visible under a choice of systems and sources.

    Nodes of a chosen system and source are seen; arcs of a chosen source bring
    the ends that are not seen, where the other end is.  ``nodes`` has (node,
    system, source), ``arcs`` (src, dst, source).
    """
    seen = nodes.where(F.col("system").isin(*systems) & F.col("source").isin(*sources)).select("node").distinct()
    live = arcs.where(F.col("source").isin(*sources))
    ends = [live.join(seen.withColumnRenamed("node", a), a, "left_semi").select(F.col(b).alias("node")) for a, b in (("src", "dst"), ("dst", "src"))]
    return seen.union(ends[0]).union(ends[1]).distinct()
