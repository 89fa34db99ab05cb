"""Separation in graphs with cycles, batched over questions.

Sigma-separation is d-separation after acyclification.  There, a component and
its outside parents are one family: its members and parents are all adjacent in
the moral graph, directly or by the component's latent cause.  So the moral
graph is kept as pairs of node and family, linear in the arcs, and a walk goes
from node to family to node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signflow.functions.storage import fixpoint, store


def ancestors(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(q, node): the nodes of each question and all that lead to them."""
    back = store(arcs.select("src", "dst").distinct(), "back")
    return fixpoint(nodes.select("q", "node").distinct(), lambda f: f.join(back, f.node == back.dst).select("q", F.col("src").alias("node")), "ancestors")


def families(arcs: DataFrame, sccs: DataFrame) -> DataFrame:
    """(node, family): members of a component, and the parents of any of them."""
    s = sccs.select("node", F.col("scc").alias("family"))
    return s.unionByName(arcs.select("src", "dst").join(s.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "family")).distinct()


def separated(arcs: DataFrame, sccs: DataFrame, x: DataFrame, y: DataFrame, z: DataFrame) -> DataFrame:
    """(q, separated): whether no open walk joins x and y given z; each is a table (q, node).

    With the components of an acyclic graph, where each node is its own, this
    is d-separation.
    """
    anc = store(ancestors(arcs, x.unionByName(y).unionByName(z)), "ancestors")
    fam = store(families(arcs, sccs), "families")
    # a family takes part where one of its own members is an ancestor
    own = anc.join(sccs, "node").select("q", F.col("scc").alias("family")).distinct()
    walk = store(anc.join(fam, "node").join(own, ["q", "family"], "left_semi").join(z.select("q", "node"), ["q", "node"], "left_anti").select("q", "node", "family"), "walk")
    seed = x.join(z, ["q", "node"], "left_anti").select("q", "node").distinct()

    def step(front: DataFrame) -> DataFrame:
        near = front.join(walk, ["q", "node"]).select("q", "family").distinct()
        return near.join(walk, ["q", "family"]).select("q", "node")

    open_ = fixpoint(seed, step, "open")
    met = open_.join(y.select("q", "node"), ["q", "node"]).select("q").distinct().withColumn("met", F.lit(True))
    return x.select("q").distinct().join(met, "q", "left").select("q", F.col("met").isNull().alias("separated"))
