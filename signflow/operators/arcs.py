"""Operational arcs: context slices, parallel influences, precedence of layers, surgery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signflow.functions.signs import parallel


def contexts(edges: DataFrame) -> DataFrame:
    """The selectable contexts, each once."""
    return edges.where("context is not null").select("context").distinct()


def active_edges(edges: DataFrame, selected: Sequence[str] | None) -> DataFrame:
    """Edges of a fixed regime: those without a context and those of a selected one; None selects nothing and keeps all."""
    if selected is None:
        return edges
    known = {r[0] for r in contexts(edges).collect()}
    if unknown := sorted(set(selected) - known):
        raise ValueError(f"unknown contexts: {unknown}")
    return edges.where(F.col("context").isNull() | F.col("context").isin(*selected)) if selected else edges.where("context is null")


def context_slice(edges: DataFrame, modulations: DataFrame, selected: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """A regime as a map of its own: guards discharged, modulations of absent edges pruned."""
    kept = active_edges(edges, selected).withColumn("context", F.lit(None).cast("string"))
    return kept, modulations.join(kept.select(F.col("id").alias("influence_id")).distinct(), "influence_id", "left_semi")


def combine(edges: DataFrame, selected: Sequence[str] | None = None) -> DataFrame:
    """One arc per (src, dst): m, n influences, ambiguous.

    With a selection, parallel influences are summed.  Without one, an arc that
    has contextual influences is determinate only if an unconditional one
    exists, is determinate, and every contextual one agrees with it.
    """
    e = active_edges(edges, selected)
    plain = F.col("context").isNull()
    g = e.groupBy("src", "dst").agg(
        parallel(F.col("m")).alias("all_m"),
        F.bit_or(F.when(plain, F.col("m"))).alias("base"),
        F.bit_or(F.when(~plain, F.col("m"))).alias("guarded"),
        F.count("*").alias("n"),
        F.count_distinct("m").alias("signs"),
    )
    if selected is None:
        agree = F.col("base").isNotNull() & (F.col("base") != 3) & (F.col("guarded") == F.col("base"))
        loose = F.col("guarded").isNotNull() & ~agree
    else:
        loose = F.lit(False)
    m = F.when(loose, 3).otherwise(F.col("all_m")).cast("int")
    return g.select("src", "dst", m.alias("m"), "n", (loose | (F.col("signs") > 1)).alias("ambiguous"))


def layered(causal: DataFrame, production: DataFrame, quantitative: DataFrame) -> DataFrame:
    """Arcs (src, dst, m, kind) of three layers; the first layer that has an ordered pair keeps it.

    Within the derived layers the record with the smallest ``ord`` counts.
    """
    layers = causal.select("src", "dst", "m", F.lit("causal-influence").alias("kind"), F.lit(0).alias("layer"), F.lit(0).cast("long").alias("ord"))
    for k, (df, kind) in enumerate(((production, "production-derived"), (quantitative, "quantitative-derived")), 1):
        layers = layers.unionByName(df.select("src", "dst", "m", F.lit(kind).alias("kind"), F.lit(k).alias("layer"), F.col("ord").cast("long").alias("ord")))
    best = layers.groupBy("src", "dst").agg(F.min_by(F.struct("m", "kind"), F.struct("layer", "ord", "m")).alias("x"))
    return best.select("src", "dst", "x.m", "x.kind")


def surgery(cone: DataFrame, interventions: DataFrame) -> DataFrame:
    """Per intervention (iv_id, src, dst, m), without the arcs that enter a clamped node.

    Interventions and arcs are never multiplied: a search cuts arcs as it meets
    them, and this does so for arcs that already belong to an intervention.
    """
    return cone.join(interventions.select("iv_id", F.col("node").alias("dst")).distinct(), ["iv_id", "dst"], "left_anti").select("iv_id", "src", "dst", "m")


def surgery_sizes(arcs: DataFrame, interventions: DataFrame) -> DataFrame:
    """(iv_id, arcs_left, sum_m) after surgery on the whole graph, from the arcs that each intervention cuts."""
    cut = interventions.select("iv_id", F.col("node").alias("dst")).distinct().join(arcs, "dst", "left").groupBy("iv_id").agg(F.count("m").alias("cut"), F.coalesce(F.sum("m"), F.lit(0)).alias("cut_m"))
    # one row
    whole = arcs.agg(F.count("*").alias("n"), F.sum("m").alias("s"))
    return cut.join(F.broadcast(whole), F.lit(True)).select("iv_id", (F.col("n") - F.col("cut")).alias("arcs_left"), (F.col("s") - F.col("cut_m")).alias("sum_m"))


def opposing_pairs(edges: DataFrame) -> DataFrame:
    """Ordered pairs with influences of opposite sign."""
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n"), F.count_distinct("m").alias("signs")).where("signs > 1")
