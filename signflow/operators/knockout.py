"""Knockout reports: which phenotypes an intervention predicts, and which it leaves open."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signflow.functions.storage import store
from signflow.operators.second_order import gain_changes, interaction_signs, synergies
from signflow.operators.solve import components_of, solve


def first_terms(index: DataFrame) -> DataFrame:
    """(node, sign, label): of several terms for a node and sign, the one with the smallest ``ord`` (then label)."""
    return index.where("sign in (1, 2)").groupBy("node", "sign").agg(F.min_by("label", F.struct("ord", "label")).alias("label"))


def phenotypes(predictions: DataFrame, index: DataFrame) -> DataFrame:
    """(iv_id, node, mask, label) of predicted signs that the index (node, sign, label) has a term for."""
    return predictions.join(index, "node").where(F.col("mask") == F.col("sign")).select("iv_id", "node", "mask", "label")


def affected(predictions: DataFrame, index: DataFrame, neutral: DataFrame | None = None) -> DataFrame:
    """(iv_id, node, label) of indexed nodes that are reached without a determinate sign, with their neutral term (node, label), null without one."""
    hit = predictions.where("mask = 3").join(index.select("node").distinct(), "node", "left_semi").select("iv_id", "node")
    return hit.join(neutral.select("node", "label"), "node", "left").select("iv_id", "node", "label") if neutral is not None else hit.withColumn("label", F.lit(None).cast("string"))


def largest_component(sccs: DataFrame) -> DataFrame:
    """(node) of the largest component of two or more nodes; of equally large ones the least."""
    size = sccs.groupBy("scc").agg(F.count("*").alias("n")).where("n > 1")
    big = size.agg(F.min_by("scc", F.struct(-F.col("n"), "scc")).alias("scc"))
    return sccs.join(F.broadcast(big), "scc", "left_semi").select("node")


def in_largest(rows: DataFrame, sccs: DataFrame) -> DataFrame:
    """``rows`` with ``in_largest``, by which, and then by label without case, a report is ordered."""
    inside = largest_component(sccs).withColumn("in_largest", F.lit(True))
    return rows.join(inside, "node", "left").withColumn("in_largest", F.coalesce("in_largest", F.lit(False)))


class Knockout:
    """The report of each intervention on solved signs, of one clamp or several; what isn't asked for isn't worked out.

    An intervention that clamps an unknown node becomes an error row.  Clamps
    are not phenotypes of themselves.  With ``modulations``, gain changes and
    synergies follow from the same solution; without, these are None.
    """

    def __init__(self, arcs: DataFrame, interventions: DataFrame, index: DataFrame, neutral: DataFrame | None = None, constitutive: DataFrame | None = None, modulations: DataFrame | None = None, nodes: DataFrame | None = None) -> None:
        self.arcs, self.interventions, self.index, self.neutral, self.constitutive, self.modulations = arcs, interventions, index, neutral, constitutive, modulations
        self.nodes = nodes.select("node") if nodes is not None else arcs.select(F.col("src").alias("node")).union(arcs.select("dst"))

    @cached_property
    def _bad(self) -> DataFrame:
        return self.interventions.join(self.nodes.distinct(), "node", "left_anti")

    @cached_property
    def _good(self) -> DataFrame:
        return self.interventions.join(self._bad.select("iv_id").distinct(), "iv_id", "left_anti")

    @cached_property
    def _moved(self) -> DataFrame:
        return self.predicted.join(self._good.select("iv_id", "node"), ["iv_id", "node"], "left_anti")

    @cached_property
    def _sccs(self) -> DataFrame:
        return store(components_of(self.arcs), "sccs")

    @cached_property
    def errors(self) -> DataFrame:
        return self._bad.groupBy("iv_id").agg(F.concat(F.lit("unknown nodes: "), F.array_join(F.array_sort(F.collect_set(F.col("node").cast("string"))), ", ")).alias("error"))

    @cached_property
    def predicted(self) -> DataFrame:
        return store(solve(self.arcs, self._good, self.constitutive), "predicted")

    @cached_property
    def phenotypes(self) -> DataFrame:
        return in_largest(phenotypes(self._moved, first_terms(self.index)), self._sccs)

    @cached_property
    def affected(self) -> DataFrame:
        return in_largest(affected(self._moved, self.index, self.neutral), self._sccs)

    @cached_property
    def summary(self) -> DataFrame:
        counts = self.predicted.groupBy("iv_id").agg(F.count("*").alias("predicted"), F.count_if(F.col("mask") != 3).alias("determinate"))
        return self._good.select("iv_id").distinct().join(counts, "iv_id", "left")

    @cached_property
    def gains(self) -> DataFrame | None:
        return gain_changes(self.modulations, self.predicted) if self.modulations is not None else None

    @cached_property
    def synergies(self) -> DataFrame | None:
        return synergies(interaction_signs(self.modulations, self.arcs), self.predicted) if self.modulations is not None else None


def knockout(arcs: DataFrame, interventions: DataFrame, index: DataFrame, neutral: DataFrame | None = None, constitutive: DataFrame | None = None, modulations: DataFrame | None = None, nodes: DataFrame | None = None) -> Knockout:
    return Knockout(arcs, interventions, index, neutral, constitutive, modulations, nodes)
