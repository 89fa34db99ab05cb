"""Second-order questions: gains, synergies, interactions, regimes, counterfactuals.

Modulations are (modulator, src, dst, mu, can_flip), predictions (iv_id, node,
mask) with the clamps among them, as a solve gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signflow.functions.signs import times


def modulations_of(modulations: DataFrame, influence: str | None = None, pair: tuple | None = None) -> DataFrame:
    """Modulations of one influence, by its id or by its ends."""
    if influence is not None:
        return modulations.where(F.col("influence_id") == influence)
    return modulations.where((F.col("src") == pair[0]) & (F.col("dst") == pair[1]))


def interaction_signs(modulations: DataFrame, arcs: DataFrame) -> DataFrame:
    """(modulator, src, dst, mu, m, iota): the interaction sign is the modulation's sign times the arc's."""
    return modulations.join(arcs, ["src", "dst"]).select("modulator", "src", "dst", "mu", "m", times(F.col("mu"), F.col("m")).alias("iota"))


def interaction_phrase(iota: Column, can_flip: Column) -> Column:
    back = F.when(can_flip, "dampens the influence and may reverse it").otherwise("dampens the influence")
    return F.when(iota == 1, F.lit("amplifies the influence")).when(iota == 2, back).otherwise("changes the influence, which way is open")


def gain_changes(modulations: DataFrame, predictions: DataFrame) -> DataFrame:
    """(iv_id, src, dst, modulator, gain): how an intervention changes the gain of the modulated arcs, where it does so determinately."""
    return _gains(modulations, predictions).where("gain in (1, 2)")


def _gains(modulations: DataFrame, predictions: DataFrame) -> DataFrame:
    j = modulations.join(predictions.where("mask > 0").select("iv_id", F.col("node").alias("modulator"), "mask"), "modulator")
    return j.select("iv_id", "src", "dst", "modulator", times(F.col("mu"), F.col("mask")).alias("gain"))


def gain_sensitivity(modulations: DataFrame, predictions: DataFrame) -> DataFrame:
    """(iv_id, src, dst, gain, modulators): the sum of what all responding modulators do to an arc's gain, undetermined ones among them."""
    return _gains(modulations, predictions).groupBy("iv_id", "src", "dst").agg(F.bit_or("gain").cast("int").alias("gain"), F.count_distinct("modulator").alias("modulators"))


def synergies(interactions: DataFrame, predictions: DataFrame) -> DataFrame:
    """(iv_id, modulator, src, dst, iota, source_change, modulator_change, cross, target, verdict).

    Where source and modulator both move determinately and the cross term has a
    sign: ``synergistic`` if it agrees with the predicted sign of the target,
    ``antagonistic`` if it is the opposite, ``reinforces`` where the target's
    own direction is open.
    """
    p = predictions.where("mask > 0").select("iv_id", "node", F.col("mask").cast("int").alias("mask"))
    moved = p.where("mask in (1, 2)")
    j = interactions.join(moved.select("iv_id", F.col("node").alias("modulator"), F.col("mask").alias("dm")), "modulator")
    j = j.join(moved.select("iv_id", F.col("node").alias("src"), F.col("mask").alias("ds")), ["iv_id", "src"])
    j = j.join(p.select("iv_id", F.col("node").alias("dst"), F.col("mask").alias("dt")), ["iv_id", "dst"], "left")
    cross = times(F.col("iota"), times(F.col("ds"), F.col("dm")))
    target = F.coalesce("dt", F.lit(3))
    verdict = F.when(target == 3, "reinforces").when(cross == target, "synergistic").otherwise("antagonistic")
    out = j.select("iv_id", "modulator", "src", "dst", "iota", F.col("ds").alias("source_change"), F.col("dm").alias("modulator_change"), cross.alias("cross"), target.alias("target"), verdict.alias("verdict"))
    return out.where("cross in (1, 2)")


def regime_signs(modulations: DataFrame, arcs: DataFrame) -> DataFrame:
    """(modulator, src, dst, low, high) of modulations that can flip their arc: its sign on either side of the threshold.

    The arc keeps its sign on the side where the gain is larger and has the
    opposite one on the other; with an open modulation both are open.
    """
    j = modulations.where("can_flip").join(arcs, ["src", "dst"])
    m, flipped = F.col("m"), times(F.lit(2), F.col("m"))
    side = lambda keeps: F.when(F.col("mu") == keeps, m).when(F.col("mu") == 3 - keeps, flipped).otherwise(3).cast("int")
    return j.select("modulator", "src", "dst", side(2).alias("low"), side(1).alias("high"))


def shadows(modulations: DataFrame, edges: DataFrame) -> DataFrame:
    """(modulator, dst, m, present): the first-order arc that each modulation implies, and whether an edge of that very sign exists."""
    s = modulations.select("modulator", "dst", F.col("mu").alias("m")).distinct()
    have = edges.select(F.col("src").alias("modulator"), "dst", "m").distinct().withColumn("present", F.lit(True))
    return s.join(have, ["modulator", "dst", "m"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def but_for(predictions: DataFrame, interventions: DataFrame) -> DataFrame:
    """(iv_id, node, factual, counterfactual, necessary) of all that moves but the clamps themselves: without them nothing would."""
    p = predictions.where("mask > 0").join(interventions.select("iv_id", "node"), ["iv_id", "node"], "left_anti")
    return p.select("iv_id", "node", F.col("mask").alias("factual"), F.lit(0).alias("counterfactual"), F.col("mask").isin(1, 2).alias("necessary"))
