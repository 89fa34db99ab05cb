"""Determination across scales after a causal solve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signflow.functions.signs import times
from signflow.functions.storage import store
from signflow.operators.reach import levels


def upward(signs: DataFrame, constitutive: DataFrame) -> DataFrame:
    """(iv_id, node, mask, note): causal signs carried up the determination (micro, macro, m), level by level.

    A node takes the sum of its parts' signs times the determination's sign,
    added to its own causal sign if it has one.  ``note`` is ``determined`` for
    nodes that have a sign by their parts alone, ``combined`` where the parts
    changed a causal sign, else null.  A cycle of determination raises.
    """
    c = store(constitutive.select("micro", "macro", "m"), "upward")
    level = levels(c.select(F.col("micro").alias("src"), F.col("macro").alias("dst")))
    top = level.agg(F.max("level")).first()[0] or 0
    at = store(c.join(level.select(F.col("node").alias("macro"), "level"), "macro"), "upward")
    cur = store(signs.where("mask > 0").select("iv_id", "node", F.col("mask").cast("int").alias("mask"), F.lit(None).cast("string").alias("note")), "upward")
    for k in range(1, top + 1):
        parts = at.where(F.col("level") == k).join(cur.select("iv_id", F.col("node").alias("micro"), "mask"), "micro")
        up = parts.groupBy("iv_id", F.col("macro").alias("node")).agg(F.bit_or(times(F.col("mask"), F.col("m"))).cast("int").alias("up"))
        j = cur.join(up, ["iv_id", "node"], "full")
        mask = F.coalesce("mask", F.lit(0)).bitwiseOR(F.coalesce("up", F.lit(0))).cast("int")
        note = F.when(F.col("up").isNull(), F.col("note")).when(F.col("mask").isNull(), "determined").when(mask != F.col("mask"), "combined").otherwise(F.col("note"))
        cur = store(j.select("iv_id", "node", mask.alias("mask"), note.alias("note")), "upward")
    return cur
