"""Annotations, terms, drugs and the nodes they stand for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signflow.functions.signs import times
from signflow.functions.storage import numbered
from signflow.functions.text import QUALIFIERS, analyte_tokens, direction, has_specific, tokens
from signflow.operators.gates import containment_join
from signflow.operators.scoring import drop_conflicts, roll_up, score


def mapped_observations(annotations: DataFrame, closure: DataFrame, term_map: DataFrame) -> DataFrame:
    """(grp, node, expected) of annotations (grp, term), by the term itself or what it is a kind of.

    ``closure`` is (src, dst), ``term_map`` (term, node, sign).  Keys with both
    signs are left out.
    """
    up = annotations.join(closure.select(F.col("src").alias("term"), F.col("dst").alias("up")), "term").select("grp", F.col("up").alias("term"))
    every = annotations.select("grp", "term").unionByName(up).distinct()
    rows = every.join(term_map, "term").select("grp", "node", F.col("sign").alias("expected"))
    return drop_conflicts(rows, ["grp", "node"], "expected")


def excluded(rows: DataFrame, leakage: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose composite key isn't among those to leave out."""
    return rows.join(leakage.select(*keys).distinct(), keys, "left_anti")


def group_coverage(terms: DataFrame, closure: DataFrame, annotations: DataFrame) -> DataFrame:
    """(term, groups): of each term how many distinct groups are annotated with it or a kind of it; 0 for none."""
    down = terms.select("term").join(closure.select(F.col("dst").alias("term"), F.col("src").alias("below")), "term").unionByName(terms.select("term", F.col("term").alias("below")))
    n = down.join(annotations.select(F.col("term").alias("below"), "grp"), "below").groupBy("term").agg(F.count_distinct("grp").alias("groups"))
    return terms.select("term").distinct().join(n, "term", "left").select("term", F.coalesce("groups", F.lit(0)).alias("groups"))


def ranked_gaps(terms: DataFrame, coverage: DataFrame, names: DataFrame) -> DataFrame:
    """(place, term, groups, name) by falling coverage, then name, then term; places from 1."""
    rows = terms.select("term").distinct().join(coverage, "term").join(names.select("term", "name"), "term").select("term", "groups", "name")
    return numbered(rows, F.desc("groups"), "name", "term").select((F.col("number") + 1).alias("place"), "term", "groups", "name")


def candidates(terms: DataFrame, nodes: DataFrame, term_map: DataFrame, closure: DataFrame) -> DataFrame:
    """(term, sign, node, matches, class) of directional terms (term, name) that no mapped term covers.

    A term matches the nodes (node, label) that have all its words; of several
    the one with fewest words, then the first, is taken.  ``class`` is
    ``candidate`` where that one is alone with so few words and the term's words
    are more than general, ``ambiguous`` where it isn't, ``gap`` without a match.
    """
    covered = closure.select(F.col("src").alias("term"), F.col("dst").alias("up")).join(term_map.select(F.col("term").alias("up")), "up").select("term").union(term_map.select("term")).distinct()
    t = terms.select("term", direction(F.col("name")).alias("sign"), analyte_tokens(F.col("name")).alias("words")).where("sign is not null").join(covered, "term", "left_anti")
    index = nodes.select("node", F.array_except(F.array_union(tokens(F.col("label")), tokens(F.translate(F.col("node").cast("string"), "_", " "))), F.array(*[F.lit(q) for q in QUALIFIERS])).alias("tokens"))
    met = containment_join(t.select(F.col("term").alias("l_id"), F.col("words").alias("tokens")), index.select(F.col("node").alias("r_id"), "tokens"))
    m = met.join(index.select(F.col("node").alias("r_id"), F.size("tokens").alias("n")), "r_id")
    best = m.groupBy(F.col("l_id").alias("term")).agg(F.min_by("r_id", F.struct("n", "r_id")).alias("node"), F.count("*").alias("matches"), F.array_sort(F.collect_list("n")).alias("sizes"))
    j = t.join(best, "term", "left")
    alone = (F.col("matches") == 1) | (F.col("sizes")[0] < F.try_element_at("sizes", F.lit(2)))
    kind = F.when(F.col("node").isNull(), "gap").when(has_specific(F.col("words")) & alone, "candidate").otherwise("ambiguous")
    return j.select("term", "sign", "node", F.coalesce("matches", F.lit(0)).alias("matches"), kind.alias("class"))


def nearest(terms: DataFrame, closure: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, found, dist): of the wanted terms above each term the nearest, of equally near ones the first; ``closure`` is (src, dst, dist)."""
    up = terms.select("term").join(closure.select(F.col("src").alias("term"), F.col("dst").alias("found"), "dist"), "term").join(wanted.select(F.col("term").alias("found")).distinct(), "found", "left_semi")
    return up.groupBy("term").agg(F.min(F.struct("dist", "found")).alias("b")).select("term", "b.found", "b.dist")


#: Words of terms about the whole body's blood, and about other samples.
SYSTEMIC = r"(?i)circulat|blood|plasma|serum|systemic"
OTHER_SAMPLES = r"(?i)saliva|urin|urine|csf|cerebrospinal|sweat|fecal|stool|sputum"


def neutral_terms(mapped: DataFrame, closure: DataFrame, names: DataFrame, depths: DataFrame) -> DataFrame:
    """(node, term, votes): for each node the neutral term that most of its directional terms have nearest above them.

    ``mapped`` is (node, term), ``names`` (term, name), ``depths`` (term,
    depth).  Of equal votes a term of the blood comes first, then a deeper one,
    then the first by name of the term.
    """
    wanted = names.where(F.startswith(F.lower("name"), F.lit("abnormal")) & direction(F.col("name")).isNull())
    near = nearest(mapped.select("term").distinct(), closure, wanted)
    votes = mapped.join(near, "term").groupBy("node", F.col("found").alias("term")).agg(F.count_distinct("term").alias("votes"))
    systemic = (F.col("name").rlike(SYSTEMIC) & ~F.col("name").rlike(OTHER_SAMPLES)).cast("int")
    j = votes.join(names.select("term", "name"), "term").join(depths.select("term", "depth"), "term", "left")
    return j.groupBy("node").agg(F.min(F.struct((-F.col("votes")).alias("v"), (-systemic).alias("s"), (-F.coalesce("depth", F.lit(0))).alias("d"), "term", "votes")).alias("b")).select("node", "b.term", "b.votes")


# --- drugs -------------------------------------------------------------------------


def drug_clamps(mechanisms: DataFrame, molecules: DataFrame, targets: DataFrame, proteins: DataFrame, nodes: DataFrame, actions: DataFrame) -> DataFrame:
    """(drug, node, mask): what a drug's mechanisms do to nodes, by molecule, human single-protein target, accession and protein.

    Nodes that a drug acts on both ways are left out.  Isoform suffixes of
    accessions are dropped.
    """
    acc = F.split_part(F.col("accession"), F.lit("-"), F.lit(1))
    p = proteins.select(acc.alias("accession"), "protein").distinct().join(nodes.select("protein", "node").distinct(), "protein").select("accession", "node")
    t = targets.where("organism = 'Homo sapiens' and target_type = 'SINGLE PROTEIN'").select("target", F.explode("accessions").alias("accession")).join(p, "accession").select("target", "node").distinct()
    j = mechanisms.join(actions.select("action_type", "mask"), "action_type").join(molecules.where("coalesce(pref_name, '') <> ''").select("molecule", F.lower("pref_name").alias("drug")), "molecule").join(t, "target")
    return drop_conflicts(j.select("drug", "node", "mask"), ["drug", "node"], "mask")


def crosswalk(names: DataFrame, aliases: DataFrame, gold: DataFrame) -> DataFrame:
    """(name, gold): each name's entry in the gold labels, by the name itself or else by its first alias that is there."""
    every = names.select("name", F.lower("name").alias("alias"), F.lit(0).alias("k")).unionByName(aliases.select("name", F.lower("alias").alias("alias"), F.lit(1).alias("k")))
    hit = every.join(gold.select(F.col("gold").alias("alias")).distinct(), "alias")
    return hit.groupBy("name").agg(F.min(F.struct("k", "alias")).alias("b")).select("name", F.col("b.alias").alias("gold"))


def one_hop(arcs: DataFrame, clamps: DataFrame) -> DataFrame:
    """(iv_id, node, mask): what clamps (iv_id, node, mask) do to their neighbours alone; clamped nodes are left out."""
    j = clamps.join(arcs, clamps.node == arcs.src).select("iv_id", F.col("dst").alias("node"), times(F.col("mask"), F.col("m")).alias("mask"))
    return j.join(clamps.select("iv_id", "node"), ["iv_id", "node"], "left_anti").groupBy("iv_id", "node").agg(F.bit_or("mask").cast("int").alias("mask"))


def documented(predictions: DataFrame, gold: DataFrame, clamps: DataFrame, measurable: DataFrame) -> DataFrame:
    """(iv_id, corroborated, contradicted, undocumented) of determinate predictions for measurable nodes that aren't clamped, against documented signs (iv_id, node, sign)."""
    p = predictions.where("mask in (1, 2)").join(clamps.select("iv_id", "node"), ["iv_id", "node"], "left_anti").join(measurable.select("node").distinct(), "node", "left_semi")
    g = gold.groupBy("iv_id", "node").agg(F.collect_set("sign").alias("signs"))
    j = p.join(g, ["iv_id", "node"], "left")
    hit = F.array_contains("signs", F.col("mask"))
    return j.groupBy("iv_id").agg(F.count_if(hit).alias("corroborated"), F.count_if(~hit).alias("contradicted"), F.count_if(F.col("signs").isNull()).alias("undocumented"))


def paradoxes(pairs: DataFrame, solved: DataFrame, arcs: DataFrame, clamps: DataFrame) -> DataFrame:
    """(iv_id, node, expected, solved, one_hop, resolved): documented effects that feedback turns round, as the solver and as immediate effects have them.

    ``pairs`` (iv_id, node, expected) are the effects to look at; ``resolved``
    tells those that the solver gets right and the immediate effect doesn't.
    """
    hop = one_hop(arcs, clamps).select("iv_id", "node", F.col("mask").alias("one_hop"))
    j = pairs.join(solved.select("iv_id", "node", F.col("mask").alias("solved")), ["iv_id", "node"], "left").join(hop, ["iv_id", "node"], "left")
    right = lambda c: F.coalesce(F.col(c) == F.col("expected"), F.lit(False))
    return j.select("iv_id", "node", "expected", "solved", "one_hop", (right("solved") & ~right("one_hop")).alias("resolved"))


def recall(predictions: DataFrame, gold: DataFrame, clamps: DataFrame) -> DataFrame:
    """Counts over documented pairs (iv_id, node, sign) of one direction: determinate, correct, abstained."""
    g = drop_conflicts(gold.join(clamps.select("iv_id", "node"), ["iv_id", "node"], "left_anti").select("iv_id", "node", F.col("sign").alias("expected")), ["iv_id", "node"], "expected")
    return roll_up(score(g, predictions, ["iv_id", "node"]), "iv_id")


# --- joins of tables with each other --------------------------------------------------


def merged(tables: list[DataFrame], key: str) -> DataFrame:
    """Full outer merge of tables by a key."""
    return reduce(lambda a, b: a.join(b, key, "full"), tables)


def witnesses(records: DataFrame, axioms: DataFrame, keys: list[str]) -> DataFrame:
    """Records that no axiom with the same keys supports."""
    return records.join(axioms.select(*keys).distinct(), keys, "left_anti")


def entailed(links: DataFrame, closure: DataFrame) -> DataFrame:
    """(src, dst) that follow from existential links under a hierarchy (src, dst): kinds of the source have the link, to the target and to all that it is a kind of."""
    up = closure.select("src", "dst")
    wide = links.select("src", "dst").unionByName(links.join(up.select(F.col("src").alias("dst"), F.col("dst").alias("more")), "dst").select("src", F.col("more").alias("dst"))).distinct()
    deep = wide.join(up.select(F.col("dst").alias("src"), F.col("src").alias("kind")), "src").select(F.col("kind").alias("src"), "dst")
    return wide.unionByName(deep).distinct()


def ratio_pairs(arguments: DataFrame) -> DataFrame:
    """(result, numerator, denominator): every numerator of a result (result, role, node) with every denominator."""
    n = arguments.where("role = 'numerator'").select("result", F.col("node").alias("numerator"))
    return n.join(arguments.where("role = 'denominator'").select("result", F.col("node").alias("denominator")), "result")


def snapshot(sections: dict[str, DataFrame]) -> DataFrame:
    """(section, n, digest): each section's number of rows, and a digest of their canonical JSON that doesn't depend on their order.

    The rows' SHA-256 digests are added up in eight parts of 32 bits, which any
    number of tasks can do, and the sums are digested once more.
    """
    from signflow.functions.text import canonical_json

    def part(k: int) -> Column:
        return F.sum(F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")).cast("string")

    out = []
    for name, df in sections.items():
        h = df.select(F.sha2(canonical_json(*df.columns), 256).alias("h"))
        row = h.agg(F.count("*").alias("n"), F.sha2(F.concat_ws(",", *[F.coalesce(part(k), F.lit("0")) for k in range(8)]), 256).alias("digest"))
        out.append(row.select(F.lit(name).alias("section"), "n", "digest"))
    return reduce(DataFrame.unionByName, out)
