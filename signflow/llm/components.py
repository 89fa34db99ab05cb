"""Connected components over an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signflow.llm.common import materialise, release


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Map each node of ``edges`` (u long, v long) to the smallest node it reaches.

    Returns (node, root) for every node that is not itself a root.  Self-loops,
    repeated and reversed edges are allowed, null ends are ignored, an empty
    table gives an empty table.  Every round is an aggregation with map-side
    combine and an equi-join whose hot keys AQE can split; each round's table is
    written to the shared folder, and nothing but two numbers reaches the driver.
    """
    cur = materialise(edges.select("u", "v").where("u <> v").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        nxt = materialise(_small_star(_large_star(cur)), "stars")
        mark = tuple(nxt.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        release(cur)
        cur = nxt
        if mark == seen:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
