"""Validation gates: each returns rows (gate, level, subject, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signflow.functions.storage import store
from signflow.functions.text import stable_id
from signflow.operators.intervals import is_below
from signflow.operators.reach import descendants

#: Scales from fine to coarse, and those of whole organs and more.
SCALES = ("molecular", "subcellular", "cellular", "tissue", "organ", "organ_system", "organism")
MACRO_SCALES = ("organ", "organ_system", "organism")
#: Evidence that comes from intervening, and evidence of mere association.
INTERVENTIONAL = ("perturbation", "pharmacological", "genetic_lof_gof", "mendelian_randomization", "mechanistic_model", "curated_mechanistic")
ASSOCIATIONAL = ("binding_only", "coexpression", "observational_association", "unknown")
#: Fixed values: (part of a resource's name, the best class of evidence that it gives); the first that is found counts.
RESOURCES = (
    ("signor", "curated_mechanistic"), ("indra", "curated_mechanistic"), ("trrust", "curated_mechanistic"), ("collectri", "curated_mechanistic"),
    ("omnipath", "curated_mechanistic"), ("go-cam", "curated_mechanistic"), ("biomodels", "mechanistic_model"), ("cellml", "mechanistic_model"),
    ("physiome", "mechanistic_model"), ("ginsim", "curated_mechanistic"), ("cell collective", "curated_mechanistic"), ("aracne", "coexpression"),
    ("genie3", "coexpression"), ("wgcna", "coexpression"), ("coexpression", "coexpression"), ("co-expression", "coexpression"),
    ("chip-seq", "binding_only"), ("chip-atlas", "binding_only"), ("encode tfbs", "binding_only"), ("gwas catalog", "observational_association"),
)
#: Kinds of constitutive relations, and qualities of processes.
CONSTITUTIVE_KINDS = ("part_of+determination", "aggregation", "participation")
PROCESS_QUALITIES = ("PATO:0000161", "PATO:0001574", "PATO:0002243", "PATO:0001492", "PATO:0000044", "PATO:0002242")
#: Prefixes of identifiers that a node may carry.
PREFIXES = ("UBERON", "GO", "CL", "CHEBI", "PR", "PATO", "HP", "UO", "MONDO")


def findings(rows: DataFrame, gate: str, level: str | Column, subject: Column, message: Column) -> DataFrame:
    return rows.select(F.lit(gate).alias("gate"), (F.lit(level) if isinstance(level, str) else level).alias("level"), subject.cast("string").alias("subject"), message.alias("message"))


def _pair(a: str, b: str, sep: str = ">") -> Column:
    return F.concat_ws(sep, F.col(a).cast("string"), F.col(b).cast("string"))


# --- keys and references --------------------------------------------------------


def missing_keys(rows: DataFrame, column: str, target: DataFrame, key: str, gate: str) -> DataFrame:
    """Referential integrity: values of ``column`` that ``target`` doesn't have."""
    bad = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("k")).distinct().join(target.select(F.col(key).alias("k")).distinct(), "k", "left_anti")
    return findings(bad, gate, "error", F.col("k"), F.concat(F.lit(f"{column} "), F.col("k").cast("string"), F.lit(" is unknown")))


def ambiguous_keys(rows: DataFrame, keys: list[str], gate: str) -> DataFrame:
    """Keys that should be unique and aren't."""
    bad = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return findings(bad, gate, "error", F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), F.concat(F.lit("occurs "), F.col("n").cast("string"), F.lit(" times")))


def resolved(modulations: DataFrame, influences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(modulation, its one influence), and findings where none or several fit.

    ``modulations`` has (modulator, influence_id, edge_source, edge_target),
    ``influences`` (id, source, target).  An influence_id decides where it is
    given; else the ends do.
    """
    m = modulations.withColumn("__m", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("modulator", "influence_id", "edge_source", "edge_target")])).dropDuplicates(["__m"])
    # influences are counted for what they are asked for by; where one alone fits, it is that one
    by_id = influences.groupBy(F.col("id").alias("found")).agg(F.count("id").alias("n"), F.min("source").alias("source"), F.min("target").alias("target"))
    by_ends = influences.groupBy("source", "target").agg(F.count("id").alias("n"), F.min("id").alias("found"))
    named = m.where("influence_id is not null").join(by_id, F.col("influence_id") == F.col("found"), "left")
    ended = m.where("influence_id is null").join(by_ends, (F.col("edge_source") == F.col("source")) & (F.col("edge_target") == F.col("target")), "left")
    j = store(named.unionByName(ended).withColumn("n", F.coalesce("n", F.lit(0))), "resolved")
    bad = j.where("n <> 1")
    message = F.when(F.col("n") == 0, "fits no influence").otherwise(F.concat(F.lit("fits "), F.col("n").cast("string"), F.lit(" influences")))
    good = j.where("n = 1").drop("__m", "n")
    return good, findings(bad, "modulation", "error", F.col("__m"), message)


# --- scales, parts and grounding -------------------------------------------------


def scale_rank(scale: Column) -> Column:
    return reduce(lambda e, p: e.when(scale == p[1], p[0]), enumerate(SCALES), F.when(F.lit(False), 0)).cast("int")


def scale_inversions(pairs: DataFrame) -> DataFrame:
    """Constitutive pairs (micro, macro, micro_scale, macro_scale) whose part is coarser than its whole; equal scales are allowed."""
    bad = pairs.where(scale_rank(F.col("micro_scale")) > scale_rank(F.col("macro_scale")))
    return findings(bad, "constitution", "error", _pair("micro", "macro"), F.concat(F.col("micro_scale"), F.lit(" within "), F.col("macro_scale")))


def not_part_of(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (part, whole) that no chain of part_of steps (src, dst) supports; by interval labels, without a table of all pairs."""
    bad = is_below(pairs, edges).where("not below")
    return findings(bad, "part_of", "error", _pair("part", "whole"), F.lit("no part_of path"))


def entity_kind(iri: Column) -> Column:
    """Anatomical, substance, process or unknown, by the identifier's prefix."""
    p = F.split_part(iri, F.lit(":"), F.lit(1))
    return F.when(p.isin("UBERON", "CL"), "anatomical").when(p.isin("CHEBI", "PR"), "substance").when(p == "GO", "process").otherwise("unknown")


def constitution(edges: DataFrame, nodes: DataFrame, backbone: DataFrame, closure: DataFrame) -> DataFrame:
    """Findings on constitutive edges (micro, macro, relation, sign).

    Errors: an unknown relation; a part on a coarser scale; a structural
    relation into a substance, or between anchors that the ``backbone`` (id)
    knows and its ``closure`` (src, dst) doesn't connect; an aggregation that
    isn't positive, or of anatomical entities that aren't part and whole.
    Notes: anchors that are missing or not in the backbone.
    """
    n = lambda p: nodes.select(F.col("id").alias(p), F.col("scale").alias(f"{p}_scale"), F.col("entity_iri").alias(f"{p}_iri"), F.col("bearer_entity_iri").alias(f"{p}_bearer"))
    e = edges.join(n("micro"), "micro").join(n("macro"), "macro")
    for p in ("micro", "macro"):
        e = e.withColumn(f"{p}_kind", F.coalesce(entity_kind(F.col(f"{p}_iri")), F.lit("unknown")))
        e = e.withColumn(f"{p}_anchor", F.when((F.col(f"{p}_kind") == "anatomical") | (F.col("relation") == "aggregation"), F.col(f"{p}_iri")).otherwise(F.col(f"{p}_bearer")))
        known = backbone.select(F.col("id").alias(f"{p}_anchor"), F.lit(True).alias(f"{p}_known")).distinct()
        e = e.join(known, f"{p}_anchor", "left")
    path = closure.select(F.col("src").alias("micro_anchor"), F.col("dst").alias("macro_anchor"), F.lit(True).alias("path")).distinct()
    e = store(e.join(path, ["micro_anchor", "macro_anchor"], "left"), "constitution")
    known_kind = F.col("relation").isin(*CONSTITUTIVE_KINDS)
    structural, aggregation = F.col("relation") == "part_of+determination", F.col("relation") == "aggregation"
    substance = structural & (F.col("macro_kind") == "substance")
    anchored = F.col("micro_anchor").isNotNull() & F.col("macro_anchor").isNotNull()
    both = F.col("micro_known").isNotNull() & F.col("macro_known").isNotNull()
    anatomical = (F.col("micro_kind") == "anatomical") & (F.col("macro_kind") == "anatomical")
    checked = (structural & ~substance) | (aggregation & anatomical)
    rules = [
        ("error", ~known_kind, F.concat(F.lit("unknown relation "), "relation")),
        ("error", known_kind & (scale_rank(F.col("micro_scale")) > scale_rank(F.col("macro_scale"))), F.concat("micro_scale", F.lit(" within "), "macro_scale")),
        ("error", substance, F.lit("a substance is produced, not constituted")),
        ("error", aggregation & (F.col("sign") != "+"), F.lit("an aggregation is positive")),
        ("error", checked & anchored & both & F.col("path").isNull(), F.lit("no part_of path")),
        ("note", checked & anchored & ~both, F.lit("anchors are not in the backbone")),
        ("note", structural & ~substance & ~anchored, F.lit("no anchor to verify part_of by")),
    ]
    return reduce(DataFrame.unionByName, [findings(e.where(when), "constitution", level, _pair("micro", "macro"), message) for level, when, message in rules])


def grounding(nodes: DataFrame, arcs: DataFrame, constitutive: DataFrame) -> DataFrame:
    """(node, bucket) of nodes on macro scales (node, scale, exogenous).

    ``grounded`` with something that constitutes them, else ``exogenous``, else
    ``derived`` with a causal parent other than themselves, else ``ungrounded``.
    """
    made = constitutive.select(F.col("macro").alias("node")).distinct().withColumn("made", F.lit(True))
    caused = arcs.where("src <> dst").select(F.col("dst").alias("node")).distinct().withColumn("caused", F.lit(True))
    n = nodes.where(F.col("scale").isin(*MACRO_SCALES)).join(made, "node", "left").join(caused, "node", "left")
    return n.select("node", F.when(F.col("made"), "grounded").when(F.col("exogenous"), "exogenous").when(F.col("caused"), "derived").otherwise("ungrounded").alias("bucket"))


def free_floating(nodes: DataFrame, constitutive: DataFrame) -> DataFrame:
    """(node) on macro scales that nothing constitutes and that aren't exogenous."""
    n = nodes.where(F.col("scale").isin(*MACRO_SCALES) & ~F.coalesce("exogenous", F.lit(False)))
    return n.select("node").join(constitutive.select(F.col("macro").alias("node")).distinct(), "node", "left_anti")


def cross_scale_cycle(arcs: DataFrame, constitutive: DataFrame) -> DataFrame:
    """(src, dst) between components that lie on or behind a cycle of causation and determination; empty where a solve across scales is possible."""
    from signflow.operators.reach import trim
    from signflow.operators.solve import components_of

    a = store(arcs.select("src", "dst").where("src <> dst").distinct(), "meta")
    comp = store(components_of(a), "meta")
    c = constitutive.select(F.col("micro").alias("src"), F.col("macro").alias("dst")).distinct()
    s, d = comp.select(F.col("node").alias("src"), F.col("scc").alias("s")), comp.select(F.col("node").alias("dst"), F.col("scc").alias("d"))
    lifted = a.unionByName(c).join(s, "src", "left").join(d, "dst", "left").select(F.coalesce("s", "src").alias("src"), F.coalesce("d", "dst").alias("dst")).where("src <> dst")
    return trim(lifted)


# --- bearers and quantities --------------------------------------------------------


def bearer_kind(declared: Column, quality: Column) -> Column:
    """What bears a node's quality: as declared, a process for a process quality, else a material entity."""
    return F.coalesce(F.nullif(declared, F.lit("")), F.when(quality.isin(*PROCESS_QUALITIES), "occurrent").otherwise("continuant"))


def regimes(pairs: DataFrame, nodes: DataFrame, src: str, dst: str) -> DataFrame:
    """``pairs`` with ``regime``: material or process constitution within a kind of bearer, causal across."""
    kind = lambda p: nodes.select(F.col("id").alias(p), bearer_kind(F.col("bearer_kind"), F.col("quality_iri")).alias(f"__{p}"))
    j = pairs.join(kind(src), src).join(kind(dst), dst)
    a, b = F.col(f"__{src}"), F.col(f"__{dst}")
    regime = F.when((a == "continuant") & (b == "continuant"), "material_constitution").when((a == "occurrent") & (b == "occurrent"), "process_constitution").otherwise("causal")
    return j.withColumn("regime", regime).drop(f"__{src}", f"__{dst}")


def bearer_divide(constitutive: DataFrame, production: DataFrame, nodes: DataFrame) -> DataFrame:
    """Constitution across the divide between things and processes is an error; process constitution, and production within a kind, are noted."""
    c, p = regimes(constitutive, nodes, "micro", "macro"), regimes(production, nodes, "source", "target")
    return reduce(
        DataFrame.unionByName,
        [
            findings(c.where("regime = 'causal'"), "bearer", "error", _pair("micro", "macro"), F.lit("constitution crosses the divide of things and processes")),
            findings(c.where("regime = 'process_constitution'"), "bearer", "note", _pair("micro", "macro"), F.lit("process constitution")),
            findings(p.where("regime <> 'causal'"), "bearer", "note", _pair("source", "target"), F.lit("production within one kind of bearer")),
        ],
    )


def bearer_axiom(nodes: DataFrame, entity_kinds: DataFrame, quality_kinds: DataFrame, strict: bool = False) -> DataFrame:
    """Nodes whose entity is of another kind than their quality demands.

    ``entity_kinds`` and ``quality_kinds`` are (iri, kind); where either doesn't
    tell, nothing is said.  The entity is the node's own or, without one, its
    bearer.  Errors with ``strict``, else notes.
    """
    n = nodes.select("id", F.coalesce(F.nullif("entity_iri", F.lit("")), F.nullif("bearer_entity_iri", F.lit(""))).alias("e"), F.col("quality_iri").alias("q"))
    j = n.join(entity_kinds.select(F.col("iri").alias("e"), F.col("kind").alias("has")), "e").join(quality_kinds.select(F.col("iri").alias("q"), F.col("kind").alias("needs")), "q")
    return findings(j.where("has <> needs"), "bearer_axiom", "error" if strict else "note", F.col("id"), F.concat(F.lit("a quality of a "), "needs", F.lit(" on a "), "has"))


def inherited_kinds(is_a: DataFrame, roots: DataFrame) -> DataFrame:
    """(iri, kind) of terms under the ``roots`` (iri, kind) of a hierarchy (src, dst); of several the first by name."""
    from signflow.operators.reach import closure

    up = closure(is_a).select(F.col("src").alias("iri"), F.col("dst").alias("root"))
    under = up.join(roots.withColumnRenamed("iri", "root"), "root").select("iri", "kind").unionByName(roots.select("iri", "kind"))
    return under.groupBy("iri").agg(F.min("kind").alias("kind"))


def quantity_kinds(nodes: DataFrame, kinds: DataFrame) -> DataFrame:
    """(id, quantity): extensive, ratio, rate or, where nothing tells, intensive; a node's own quality_kind comes first."""
    j = nodes.select("id", "quality_kind", "quality_iri").join(kinds.select(F.col("iri").alias("quality_iri"), F.col("kind")), "quality_iri", "left")
    return j.select("id", F.coalesce(F.nullif("quality_kind", F.lit("")), "kind", F.lit("intensive")).alias("quantity"))


def determination_signs(constitutive: DataFrame, quantities: DataFrame) -> DataFrame:
    """(micro, macro, m): an aggregation into an extensive quantity or a rate is positive, whatever it says; else the asserted sign.  Of several the last relation by name counts."""
    q = quantities.select(F.col("id").alias("macro"), "quantity")
    plus = (F.col("relation") == "aggregation") & F.col("quantity").isin("extensive", "rate")
    asserted = F.when(F.col("sign") == "+", 1).when(F.col("sign") == "-", 2).otherwise(3)
    j = constitutive.join(q, "macro", "left").select("micro", "macro", "relation", F.when(F.coalesce(plus, F.lit(False)), 1).otherwise(asserted).cast("int").alias("m"))
    return j.groupBy("micro", "macro").agg(F.max_by("m", F.struct("relation", "m")).alias("m"))


def quantity_typing(constitutive: DataFrame, nodes: DataFrame, kinds: DataFrame, quantitative: DataFrame, causal: DataFrame) -> DataFrame:
    """Findings on material constitution, definitions (kind, result, arguments) and ratios against the kinds of quantities.

    Errors: an argument that is also a cause of the result; an aggregation into
    what doesn't add up, or of unlike qualities; causal edges that contradict a
    ratio.  Notes: structural determination of ratios and intensive quantities;
    ratios whose result or sides are of another kind.
    """
    q = store(quantity_kinds(nodes, kinds), "quantities")
    material = regimes(constitutive, nodes, "micro", "macro").where("regime = 'material_constitution'")
    iri = lambda p: nodes.select(F.col("id").alias(p), F.col("quality_iri").alias(f"{p}_q"))
    c = material.join(q.select(F.col("id").alias("macro"), "quantity"), "macro").join(iri("micro"), "micro").join(iri("macro"), "macro")
    adds, aggregation = F.col("quantity").isin("extensive", "rate"), F.col("relation") == "aggregation"
    args = quantitative.select("kind", "result", F.posexplode("arguments").alias("k", "a")).select("kind", "result", F.col("a.node").alias("node"), F.col("a.role").alias("role"))
    authored = args.join(causal.select(F.col("source").alias("node"), F.col("target").alias("result"), "sign"), ["node", "result"])
    ratio = args.where("kind = 'ratio'")
    side = ratio.join(q.select(F.col("id").alias("node"), "quantity"), "node")
    wrong_sign = ((F.col("role") == "numerator") & (F.col("sign") != "+")) | ((F.col("role") == "denominator") & (F.col("sign") != "-"))
    return reduce(
        DataFrame.unionByName,
        [
            findings(authored.select("kind", "node", "result").distinct(), "quantity", "error", _pair("node", "result"), F.concat(F.lit("an argument of the "), "kind", F.lit(" is also a cause"))),
            findings(c.where(aggregation & ~adds), "quantity", "error", _pair("micro", "macro"), F.concat(F.lit("aggregation into a quantity that is "), "quantity")),
            findings(c.where(aggregation & adds & (F.col("micro_q") != F.col("macro_q"))), "quantity", "error", _pair("micro", "macro"), F.lit("aggregation of unlike qualities")),
            findings(c.where(~aggregation & (F.col("quantity") == "ratio")), "quantity", "note", _pair("micro", "macro"), F.lit("a ratio has two sides and no parts")),
            findings(c.where(~aggregation & (F.col("quantity") == "intensive")), "quantity", "note", _pair("micro", "macro"), F.lit("the sign is asserted, not derived")),
            findings(ratio.select("result").distinct().join(q.select(F.col("id").alias("result"), "quantity"), "result").where("quantity <> 'ratio'"), "quantity", "note", F.col("result"), F.concat(F.lit("result of a ratio is "), "quantity")),
            findings(side.where(~adds), "quantity", "note", _pair("node", "result"), F.concat("role", F.lit(" is "), "quantity")),
            findings(authored.where((F.col("kind") == "ratio") & wrong_sign), "quantity", "error", _pair("node", "result"), F.concat("role", F.lit(" edge is "), "sign")),
        ],
    )


# --- evidence and identifiers --------------------------------------------------------


def evidence_class(source: Column, rules: tuple[tuple[str, str], ...] = RESOURCES, default: str = "unknown") -> Column:
    """The class of the first rule whose text a resource's name contains, without regard to case."""
    low = F.lower(F.coalesce(source, F.lit("")))
    return reduce(lambda e, r: e.when(F.contains(low, F.lit(r[0])), r[1]), rules, F.when(F.lit(False), "")).otherwise(default)


def admits(evidence: Column) -> Column:
    """Whether a class of evidence supports a causal edge; no class doesn't."""
    return F.coalesce(evidence.isin(*INTERVENTIONAL), F.lit(False))


def evidence_audit(edges: DataFrame, require_all: bool = False) -> DataFrame:
    """Findings on causal edges (source, target, causal_evidence) that rest on association or, with ``require_all``, on nothing."""
    e = edges.where(~admits(F.col("causal_evidence")))
    e = e if require_all else e.where("causal_evidence is not null")
    return findings(e, "causal_evidence", "error", _pair("source", "target"), F.coalesce(F.concat(F.lit("only association: "), "causal_evidence"), F.lit("no class of evidence")))


def modulation_audit(modulations: DataFrame) -> DataFrame:
    """Findings on modulations (modulator, edge_source, edge_target, causal_evidence); a class is always required."""
    e = modulations.where(~admits(F.col("causal_evidence")))
    return findings(e, "causal_evidence", "error", F.concat_ws(">", *[F.col(c).cast("string") for c in ("modulator", "edge_source", "edge_target")]), F.coalesce(F.concat(F.lit("only association: "), "causal_evidence"), F.lit("no class of evidence")))


def evidence_census(edges: DataFrame) -> DataFrame:
    """(causal_evidence, n, admits) of edges with any class or none (``unclassified``), and a row over all, causal_evidence null, which admits nothing."""
    e = edges.select(F.coalesce("causal_evidence", F.lit("unclassified")).alias("evidence"))
    n = e.rollup("evidence").agg(F.count("*").alias("n"))
    return n.select(F.col("evidence").alias("causal_evidence"), "n", admits(F.col("evidence")).alias("admits"))


def identifiers(nodes: DataFrame, verified: DataFrame) -> DataFrame:
    """Findings on a node's identifiers: form and prefix are errors, a quality from elsewhere than PATO and what is not yet verified (iri) are notes."""
    fields = ("entity_iri", "quality_iri", "bearer_entity_iri")
    x = nodes.select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.trim(f).alias("iri")) for f in fields])).alias("f")).select("id", "f.field", "f.iri").where("iri <> ''")
    legal = F.col("iri").rlike("^[A-Za-z][A-Za-z0-9_-]*:[A-Za-z0-9][A-Za-z0-9._-]*$")
    prefix = F.upper(F.split_part(F.col("iri"), F.lit(":"), F.lit(1)))
    allowed = prefix.isin(*PREFIXES)
    x = x.join(verified.select("iri", F.lit(True).alias("ok")).distinct(), "iri", "left")
    subject = F.concat_ws(".", F.col("id").cast("string"), "field")
    return reduce(
        DataFrame.unionByName,
        [
            findings(x.where(~legal), "ontology", "error", subject, F.concat("iri", F.lit(" is no identifier"))),
            findings(x.where(legal & ~allowed), "ontology", "error", subject, F.concat(prefix, F.lit(" is not allowed"))),
            findings(x.where(legal & allowed & (F.col("field") == "quality_iri") & (prefix != "PATO")), "ontology", "note", subject, F.concat("iri", F.lit(" is no PATO term"))),
            findings(x.where(legal & allowed & F.col("ok").isNull()), "ontology", "note", subject, F.concat("iri", F.lit(" is not verified yet"))),
        ],
    )


def verify_terms(used: DataFrame, terms: DataFrame) -> DataFrame:
    """(iri, problem) of used identifiers (iri, asserted label or null) that the terms (id, label, synonyms, obsolete) lack, that are obsolete, or whose label is neither the term's nor a synonym."""
    flat = lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))
    j = used.join(terms.select(F.col("id").alias("iri"), "label", "synonyms", "obsolete", F.lit(True).alias("found")), "iri", "left")
    other = F.col("asserted").isNotNull() & (flat(F.col("asserted")) != flat(F.col("label"))) & ~F.exists("synonyms", lambda s: flat(s) == flat(F.col("asserted")))
    problems = F.array(F.when(F.col("found").isNull(), F.lit("not found")), F.when(F.col("obsolete"), F.lit("obsolete")), F.when(F.col("found") & other, F.lit("label differs")))
    return j.select("iri", F.explode(F.array_compact(problems)).alias("problem"))


# --- reports and sets --------------------------------------------------------------


def report(gates: list[DataFrame], expected: list[str]) -> DataFrame:
    """(gate, errors, notes, ok) of every expected gate, with those that found nothing."""
    rows = reduce(DataFrame.unionByName, gates)
    spark = rows.sparkSession
    base = spark.createDataFrame([(g,) for g in expected], "gate string")
    n = rows.groupBy("gate").agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") != "error").alias("notes"))
    out = base.join(n, "gate", "left").select("gate", F.coalesce("errors", F.lit(0)).cast("long").alias("errors"), F.coalesce("notes", F.lit(0)).cast("long").alias("notes"))
    return out.withColumn("ok", F.col("errors") == 0)


def new_errors(candidate: DataFrame, base: DataFrame) -> DataFrame:
    """Errors of the candidate that the base doesn't have; notes stay."""
    return candidate.where("level = 'error'").distinct().join(base.where("level = 'error'").distinct(), ["gate", "level", "subject", "message"], "left_anti").unionByName(candidate.where("level <> 'error'"))


def entailment_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(…, side): rows that only one of two sets has, repeats counted."""
    return expected.exceptAll(actual).withColumn("side", F.lit("missing")).unionByName(actual.exceptAll(expected).withColumn("side", F.lit("extra")))


def grouping_classes(pairs: DataFrame, closure: DataFrame) -> DataFrame:
    """(whole, witnesses): wholes that at least one pair supports, over the closure."""
    up = closure.select(F.col("src").alias("part"), F.col("dst").alias("whole"))
    return pairs.select("part").distinct().join(up, "part").groupBy("whole").agg(F.count_distinct("part").alias("witnesses"))


def licensed_groupings(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """(id, mode, entity, whole, quality, members): classes of a quality of a whole or its parts, where physiology licenses them.

    ``nodes`` has (id, entity, context, quality, kind, occurrent), ``steps``
    (part, whole).  An extensive quality composes over part_of; an extensive
    quality or rate of a process composes for the same process in a part of
    the same site; intensive qualities don't compose.  A class needs a witness:
    another node of that quality on a proper part.  Its members are the first
    node of the whole itself and all on its proper parts.
    """
    process = F.col("occurrent") & F.col("kind").isin("extensive", "rate")
    mode = F.when(process, "process").when(~F.col("occurrent") & (F.col("kind") == "extensive"), "continuant")
    c = nodes.where("entity is not null and quality is not null").withColumn("mode", mode).where("mode is not null")
    c = store(c.select("id", "mode", "entity", "quality", F.when(F.col("mode") == "process", F.col("context")).otherwise(F.col("entity")).alias("site"), F.when(F.col("mode") == "process", F.col("entity")).otherwise("").alias("same")).where("site is not null"), "composable")
    up = steps.select(F.col("part").alias("src"), F.col("whole").alias("dst")).distinct()
    seeds = c.select(F.col("site").alias("iv_id"), F.col("site").alias("node")).distinct()
    above = descendants(up, seeds).where("iv_id <> node").select(F.col("iv_id").alias("site"), F.col("node").alias("whole"))
    wholes = c.groupBy("mode", "same", "quality", F.col("site").alias("whole"), "entity").agg(F.min("id").alias("first"))
    lower = c.select("id", "mode", "same", "quality", "site").join(above, "site")
    met = wholes.join(lower, ["mode", "same", "quality", "whole"]).groupBy("mode", "entity", "whole", "quality").agg(F.array_sort(F.array_union(F.collect_set("first"), F.collect_set("id"))).alias("members"))
    ident = F.concat(F.lit("grouping-"), stable_id(F.col("mode"), F.col("entity"), F.col("whole"), F.col("quality")))
    return met.select(ident.alias("id"), "mode", "entity", "whole", "quality", "members")


def containment_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l_id, r_id): rows of (l_id, tokens) all of whose tokens are among those of (r_id, tokens).

    Rows of the left side meet the right side on their rarest token alone; the
    others are checked on the pair, so frequent tokens join nothing.  Rows
    without tokens match nothing.
    """
    a = left.select("l_id", F.array_distinct("tokens").alias("need")).where(F.size("need") > 0)
    b = right.select("r_id", F.array_distinct("tokens").alias("have"))
    spread = b.select("r_id", "have", F.explode("have").alias("t"))
    often = spread.groupBy("t").agg(F.count("*").alias("n"))
    wanted = a.select("l_id", "need", F.explode("need").alias("t")).join(often, "t", "left")
    rare = wanted.groupBy("l_id", "need").agg(F.min_by("t", F.struct(F.coalesce("n", F.lit(0)), "t")).alias("t"))
    return rare.join(spread, "t").where(F.size(F.array_except("need", "have")) == 0).select("l_id", "r_id")
