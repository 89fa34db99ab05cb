"""Entity reconciliation: known ids, equal labels, equal identifiers and like labels, the first that tells counting."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signflow.functions.storage import store
from signflow.functions.text import normalise_label

#: Scores of an equal label, one whose quality differs, equal identifiers, and the least score of a like label and what an equal quality adds.
LABEL, LABEL_ONLY, IDENTIFIERS, FUZZY, SAME_QUALITY = 0.95, 0.84, 0.6, 0.86, 0.03
#: Like labels that are kept for a review.
REVIEWS = 5


def _labels(proposed: DataFrame, catalog: DataFrame, synonyms: dict[str, str] | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Both tables with labels in normal form, the known ids, what else is proposed, and its best match of an equal label."""
    p = store(proposed.select("id", "entity_iri", "quality_iri", normalise_label(F.col("label"), synonyms).alias("norm")), "proposed")
    c = store(catalog.select(F.col("id").alias("match"), F.col("entity_iri").alias("ce"), F.col("quality_iri").alias("cq"), normalise_label(F.col("label"), synonyms).alias("cnorm")), "catalog")
    known = p.join(c.select(F.col("match").alias("id")), "id", "left_semi").select("id", F.lit("existing").alias("status"), F.col("id").alias("match"), F.lit(1.0).alias("score"))
    left = store(p.join(known.select("id"), "id", "left_anti"), "reconcile")
    differs = F.coalesce(F.col("quality_iri") != F.col("cq"), F.lit(False))
    # of a label and quality the first id is the best
    first = c.groupBy("cnorm", "cq").agg(F.min("match").alias("match"))
    label = store(_best(left.join(first, F.col("norm") == F.col("cnorm")).withColumn("score", F.when(differs, LABEL_ONLY).otherwise(LABEL))), "reconcile")
    return p, c, known, left, label


def _best(df: DataFrame) -> DataFrame:
    return df.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "match")).alias("b")).select("id", "b.match", (-F.col("b.s")).alias("score"))


def _by_label(label: DataFrame) -> DataFrame:
    return label.select("id", F.when(F.col("score") >= 0.9, "duplicate").otherwise("review").alias("status"), "match", "score")


def sure(proposed: DataFrame, catalog: DataFrame, synonyms: dict[str, str] | None = None) -> DataFrame:
    """The rows of ``classify`` that known ids and equal labels decide; like labels aren't searched."""
    _, _, known, _, label = _labels(proposed, catalog, synonyms)
    return known.unionByName(_by_label(label))


def classify(proposed: DataFrame, catalog: DataFrame, synonyms: dict[str, str] | None = None, fuzzy: float = FUZZY) -> DataFrame:
    """(id, status, match, score) of proposed nodes (id, label, entity_iri, quality_iri) against a catalog of the same columns.

    ``existing`` where the id is known; ``duplicate`` where a label is equal in
    normal form and its quality doesn't differ; ``review`` where it differs, or
    else the identifiers are the same, or else labels are like; else ``novel``.
    ``match`` is the best of the layer, of equal ones the first id.

    Like labels meet on their rarest pairs of neighbouring letters (see
    ``candidates``); the ratio is worked out only for what bounds leave.
    """
    p, c, known, left, label = _labels(proposed, catalog, synonyms)
    rest = left.join(label.select("id"), "id", "left_anti")
    first = c.groupBy("ce", "cq").agg(F.min("match").alias("match"))
    same = store(_best(rest.join(first, F.col("entity_iri").eqNullSafe(F.col("ce")) & F.col("quality_iri").eqNullSafe(F.col("cq"))).withColumn("score", F.lit(IDENTIFIERS))), "reconcile")
    rest = store(rest.join(same.select("id"), "id", "left_anti"), "reconcile")
    like = _best(alike(rest, c, fuzzy))
    out = known.unionByName(_by_label(label))
    out = out.unionByName(same.select("id", F.lit("review").alias("status"), "match", "score")).unionByName(like.select("id", F.lit("review").alias("status"), "match", "score"))
    out = store(out, "reconcile")
    novel = p.join(out.select("id"), "id", "left_anti").select("id", F.lit("novel").alias("status"), F.lit(None).cast(dict(out.dtypes)["match"]).alias("match"), F.lit(0.0).alias("score"))
    return out.unionByName(novel)


def _marks(x: str, n: int) -> Column:
    """Each run of ``n`` characters with the number of its occurrence: of two texts as many are equal as runs can be paired."""
    runs = F.when(F.length(x) >= n, F.transform(F.sequence(F.lit(1), F.length(x) - (n - 1)), lambda i: F.substring(F.col(x), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.transform(runs, lambda r, i: F.concat(r, F.size(F.filter(F.slice(runs, F.lit(1), i + 1), lambda q: q == r)).cast("string")))


def _meet(a: DataFrame, b: DataFrame, marks: str) -> DataFrame:
    """(a, b) of labels (label, len, marks, need) that share one of the rarest marks of each, of which as many are used as the label could lack and one more."""
    often = a.select(F.explode(marks).alias("t")).unionAll(b.select(F.explode(marks))).groupBy("t").agg(F.count("*").alias("n"))

    def rarest(df: DataFrame, name: str) -> DataFrame:
        ranked = df.select("label", "len", F.col("need"), F.explode(marks).alias("t")).join(often, "t").groupBy("label", "len", "need").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("r"))
        used = F.size("r") - F.greatest("need", F.lit(1)) + 1
        return ranked.where(used > 0).select(F.col("label").alias(name), F.col("len").alias(f"{name}_len"), F.explode(F.slice("r", F.lit(1), used.cast("int"))).alias("x")).select(name, f"{name}_len", F.col("x.t").alias("t"))

    return rarest(a, "a").join(rarest(b, "b"), "t")


def candidates(left: DataFrame, catalog: DataFrame, fuzzy: float = FUZZY) -> DataFrame:
    """(a, b): the pairs of distinct labels (label each) that may be as like as ``fuzzy``; none that is gets lost.

    A pair of ratio r has M = r / 2 of both lengths in matching blocks.  Blocks
    are parted by characters that don't match, of which there are la + lb - 2 M,
    so all but one more than these of the M characters begin a pair of
    neighbours that both labels have: at least 3 M - (la + lb) - 1 pairs of
    neighbours are common.  Labels meet on their rarest pairs, and lengths, the
    number of common pairs of neighbours and of common characters rule out the
    rest, all of it in SQL.  Labels for which that bound says nothing, very
    short ones, meet on single characters.
    """
    total = lambda x: 2 * x / (2 - fuzzy)  # noqa: E731  the least sum of the lengths of a label of length x and a partner
    pair_need = lambda x: F.ceil((1.5 * fuzzy - 1) * x - 1 - 1e-9)

    def rows(df: DataFrame) -> DataFrame:
        d = df.where("label <> ''").distinct().withColumns({"len": F.length("label"), "ones": _marks("label", 1), "twos": _marks("label", 2)})
        return store(d.withColumns({"need2": pair_need(total(F.col("len"))), "need1": F.ceil(fuzzy / 2 * total(F.col("len")) - 1e-9)}), "labels")

    a, b = rows(left.select("label")), rows(catalog.select("label"))
    by_two = _meet(a.withColumn("need", F.col("need2")), b.withColumn("need", F.col("need2")), "twos")
    short = lambda df: df.where("need2 < 1").withColumn("need", F.col("need1"))
    by_one = _meet(short(a), short(b), "ones")
    both = F.col("a_len") + F.col("b_len")
    met = by_two.unionByName(by_one).where(2 * F.least("a_len", "b_len") >= fuzzy * both - 1e-9).select("a", "b").distinct()
    side = lambda df, name: df.select(F.col("label").alias(name), F.col("len").alias(f"{name}_len"), F.col("ones").alias(f"{name}1"), F.col("twos").alias(f"{name}2"))
    j = met.join(side(a, "a"), "a").join(side(b, "b"), "b")
    return j.where((F.size(F.array_intersect("a1", "b1")) >= F.ceil(fuzzy / 2 * both - 1e-9)) & (F.size(F.array_intersect("a2", "b2")) >= pair_need(both))).select("a", "b")


def alike(left: DataFrame, catalog: DataFrame, fuzzy: float = FUZZY) -> DataFrame:
    """(id, match, score) of labels at least as like as ``fuzzy`` by matching blocks, the best ``REVIEWS`` of each id; see ``candidates``."""
    pairs = candidates(left.select(F.col("norm").alias("label")), catalog.select(F.col("cnorm").alias("label")), fuzzy)

    def ratio(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(ratio=[SequenceMatcher(None, x, y).ratio() for x, y in zip(pdf.a, pdf.b)])

    near = pairs.mapInPandas(ratio, "a string, b string, ratio double").where(F.col("ratio") >= fuzzy)
    score = F.round(F.when(F.col("quality_iri") == F.col("cq"), F.least(F.lit(1.0), F.col("ratio") + SAME_QUALITY)).otherwise(F.col("ratio")), 3)
    # rows of one label and quality score alike: of the catalog's the first ids count, and those proposed share the matches
    of_label = Window.partitionBy("cnorm", "cq").orderBy("match")
    kept = catalog.select("cnorm", "cq", "match").withColumn("k", F.row_number().over(of_label)).where(F.col("k") <= REVIEWS).drop("k")
    j = left.select("norm", "quality_iri").distinct().join(near, F.col("norm") == F.col("a")).join(kept, F.col("cnorm") == F.col("b"))
    w = Window.partitionBy("norm", "quality_iri").orderBy(F.desc("score"), "match")
    top = j.select("norm", "quality_iri", "match", score.alias("score")).withColumn("k", F.row_number().over(w)).where(F.col("k") <= REVIEWS).drop("k")
    top = top.withColumnsRenamed({"norm": "n", "quality_iri": "q"})
    return left.select("id", "norm", "quality_iri").join(top, (F.col("norm") == F.col("n")) & F.col("quality_iri").eqNullSafe(F.col("q"))).select("id", "match", "score")
