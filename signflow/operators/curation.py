"""Contributions to a map: their gates, the transforms of fragments, review ledgers and submissions."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signflow.functions.storage import put_if_absent
from signflow.operators import gates as G
from signflow.sources.fragments import COLLECTIONS, LEGACY, columns_of, last_of

Tables = dict[str, DataFrame]


def candidate(base: Tables, contribution: Tables) -> Tables:
    """The base with the contribution's records, which replace those of the same key; nodes that differ are found by ``schema_gate``."""
    out = {}
    for k, (schema, _) in COLLECTIONS.items():
        cols = columns_of(schema)
        both = base[k].select(*cols, F.lit(0).alias("ord"), F.lit(0).alias("pos")).unionByName(contribution[k].select(*cols, F.lit(1).alias("ord"), F.lit(0).alias("pos")))
        out[k] = last_of(k, both)
    return out


def schema_gate(base: Tables, contribution: Tables, cand: Tables) -> DataFrame:
    """Nodes that exist otherwise, and references that lead nowhere."""
    cols = columns_of(COLLECTIONS["nodes"][0])
    text = lambda p: F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols]).alias(p)
    differ = contribution["nodes"].select("id", text("new")).join(base["nodes"].select("id", text("old")), "id").where("new <> old")
    refs = [("causal_edges", "source"), ("causal_edges", "target"), ("production_edges", "source"), ("production_edges", "target"), ("constitutive_edges", "micro"), ("constitutive_edges", "macro"), ("modulation_edges", "modulator"), ("quantitative_definitions", "result")]
    out = [G.findings(differ, "schema", "error", F.col("id"), F.lit("exists with another definition"))]
    out += [G.missing_keys(cand[k], c, cand["nodes"], "id", "schema") for k, c in refs]
    out.append(G.missing_keys(cand["quantitative_definitions"].select(F.explode("arguments.node").alias("argument")), "argument", cand["nodes"], "id", "schema"))
    return reduce(DataFrame.unionByName, out)


def _lacks(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def provenance_gate(c: Tables) -> DataFrame:
    """Evidence is required, a mechanism too but of causal edges, whose lack is noted; so is that of a node's identifiers."""
    pair = lambda a, b: F.concat_ws(">", a, b)
    e, p, m, q, n = c["causal_edges"], c["production_edges"], c["modulation_edges"], c["quantitative_definitions"], c["nodes"]
    rules = [
        (e, "error", _lacks("evidence"), pair("source", "target"), "no evidence"),
        (e, "note", _lacks("mechanism"), pair("source", "target"), "no mechanism"),
        (p, "error", _lacks("evidence"), pair("source", "target"), "no evidence"),
        (p, "error", _lacks("mechanism"), pair("source", "target"), "no mechanism"),
        (m, "error", _lacks("evidence"), F.concat_ws(">", "modulator", F.coalesce("influence_id", pair("edge_source", "edge_target"))), "no evidence"),
        (q, "error", _lacks("evidence"), F.concat_ws(":", "kind", "result"), "no evidence"),
        (q, "error", _lacks("mechanism"), F.concat_ws(":", "kind", "result"), "no mechanism"),
        (n, "note", _lacks("entity_iri") | _lacks("quality_iri"), F.col("id"), "no entity or quality"),
    ]
    return reduce(DataFrame.unionByName, [G.findings(df.where(when), "provenance", level, subject, F.lit(message)) for df, level, when, subject, message in rules])


def evidence_gate(c: Tables) -> DataFrame:
    """Every new influence but self-loops, and every modulation, needs interventional evidence; new production needs a class."""
    legacy = c["production_edges"].where(F.col("production_evidence") == LEGACY)
    return reduce(DataFrame.unionByName, [G.evidence_audit(c["causal_edges"].where("source <> target"), require_all=True), G.modulation_audit(c["modulation_edges"]), G.findings(legacy, "causal_evidence", "error", F.concat_ws(">", "source", "target"), F.lit("production without a class of evidence"))])


def arcs_of(tables: Tables) -> DataFrame:
    from signflow.sources.fragments import operational

    return operational(tables).select("src", "dst", "m")


def acyclicity_gate(cand: Tables) -> DataFrame:
    cyc = G.cross_scale_cycle(arcs_of(cand), cand["constitutive_edges"])
    return G.findings(cyc.limit(1), "acyclicity", "error", F.concat_ws(">", "src", "dst"), F.lit("causation and determination form a cycle"))


def soundness_gate(predicted: DataFrame, observed: DataFrame, nodes: DataFrame, index: DataFrame) -> DataFrame:
    """Determinate predictions (grp, node, mask) that observations (grp, node, expected) contradict, and nodes of the phenotype index that the map lacks."""
    from signflow.operators.scoring import score

    wrong = score(observed, predicted, ["grp", "node"]).where("status = 'wrong'")
    return G.findings(wrong, "soundness", "error", F.concat_ws(":", F.col("grp").cast("string"), F.col("node").cast("string")), F.lit("predicted the wrong way")).unionByName(G.missing_keys(index, "node", nodes, "id", "soundness"))


#: The gates that every contribution passes, in order.
GATES = ("schema", "provenance", "causal_evidence", "ontology", "quantity", "constitution", "bearer", "bearer_axiom", "acyclicity")


def review(base: Tables, contribution: Tables, backbone: DataFrame, closure: DataFrame, verified: DataFrame, kinds: DataFrame, entity_kinds: DataFrame, quality_kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, findings) of a contribution; of what the base already has only new errors count.

    A contribution without any record isn't acceptable.  With a schema error the
    structural gates aren't run: they count as failed.
    """
    cand = candidate(base, contribution)
    schema = schema_gate(base, contribution, cand)
    found = [schema, provenance_gate(contribution), evidence_gate(contribution), G.identifiers(contribution["nodes"], verified)]
    broken = not schema.isEmpty()
    if broken:
        found += [G.findings(schema.limit(1), g, "error", F.lit("schema"), F.lit("mend the schema first")) for g in GATES[4:]]
    else:
        quantity = lambda t: G.quantity_typing(t["constitutive_edges"], t["nodes"], kinds, t["quantitative_definitions"], t["causal_edges"])
        found.append(G.new_errors(quantity(cand), quantity(base)))
        found.append(G.new_errors(G.constitution(cand["constitutive_edges"], cand["nodes"], backbone, closure), G.constitution(base["constitutive_edges"], base["nodes"], backbone, closure)))
        found.append(G.bearer_divide(cand["constitutive_edges"], cand["production_edges"], cand["nodes"]))
        found.append(G.new_errors(G.bearer_axiom(cand["nodes"], entity_kinds, quality_kinds, strict=True), G.bearer_axiom(base["nodes"], entity_kinds, quality_kinds, strict=True)))
        found.append(acyclicity_gate(cand))
    if all(df.isEmpty() for df in contribution.values()):
        spark = schema.sparkSession
        found.append(spark.createDataFrame([("schema", "error", "contribution", "is empty")], schema.schema))
    rows = reduce(DataFrame.unionByName, found)
    return G.report([rows], list(GATES)), rows


def fragment_findings(own: Tables, others: DataFrame) -> DataFrame:
    """A fragment by itself: missing evidence, bad signs, references that neither it nor the other fragments' nodes (id) have, and whether it touches the rest at all."""
    refs = reduce(DataFrame.union, [own[k].select(F.col(c).alias("id")) for k, c in (("causal_edges", "source"), ("causal_edges", "target"), ("production_edges", "source"), ("production_edges", "target"), ("constitutive_edges", "micro"), ("constitutive_edges", "macro"), ("modulation_edges", "modulator"), ("modulation_edges", "edge_source"), ("modulation_edges", "edge_target"), ("quantitative_definitions", "result"))])
    refs = refs.union(own["quantitative_definitions"].select(F.explode("arguments.node"))).where("id is not null").distinct()
    outside = refs.join(own["nodes"].select("id"), "id", "left_anti")
    dangling = outside.join(others.select("id").distinct(), "id", "left_anti")
    sign = own["causal_edges"].where(~F.coalesce(F.col("sign").isin("+", "-", "?"), F.lit(False)))
    out = [
        provenance_gate(own).where("message <> 'no entity or quality'"),
        G.findings(dangling, "references", "error", F.col("id"), F.lit("is unknown")),
        G.findings(sign, "schema", "error", F.concat_ws(">", "source", "target"), F.lit("has no sign")),
    ]
    boundary = outside.join(others.select("id").distinct(), "id", "left_semi")
    island = others.limit(1).select(F.lit("fragment").alias("s")).join(boundary.limit(1).select(F.lit("fragment").alias("s")), "s", "left_anti")
    out.append(G.findings(island, "references", "note", F.col("s"), F.lit("touches no other fragment")))
    return reduce(DataFrame.unionByName, out)


# --- transforms ---------------------------------------------------------------------


def remapped(tables: Tables, remap: DataFrame) -> Tables:
    """Records with their nodes renamed by (old, new); renamed nodes themselves go."""
    out = dict(tables)
    out["nodes"] = tables["nodes"].join(remap.select(F.col("old").alias("id")), "id", "left_anti").select(*tables["nodes"].columns)
    for k, ends in (("causal_edges", ("source", "target")), ("production_edges", ("source", "target")), ("constitutive_edges", ("micro", "macro")), ("modulation_edges", ("modulator", "edge_source", "edge_target"))):
        df = out[k]
        for c in ends:
            df = df.join(remap.select(F.col("old").alias(c), "new"), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
        out[k] = df.select(*tables[k].columns)
    return out


def finalised(edges: DataFrame, remap: DataFrame, most: int = 1500) -> DataFrame:
    """(source, target, sign, evidence) after a merge: one edge per pair, ``?`` where signs differ, self-loops that the merge made left out, evidence joined in order and cut at ``most`` characters."""
    e = edges.select("source", "target", "sign", "evidence")
    for c in ("source", "target"):
        e = e.join(remap.select(F.col("old").alias(c), "new"), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
    g = e.where("source <> target").groupBy("source", "target").agg(F.array_sort(F.collect_set(F.coalesce("evidence", F.lit("")))).alias("all"), F.count_distinct("sign").alias("n"), F.min("sign").alias("s"))
    text = F.array_join(F.filter("all", lambda x: x != ""), "  ||  ")
    return g.select("source", "target", F.when(F.col("n") > 1, "?").otherwise(F.col("s")).alias("sign"), F.substring(text, 1, most).alias("evidence"))


def moved_production(constitutive: DataFrame, causal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(production, constitutive) with legacy production taken out of the constitutive edges; what the causal edges (source, target, sign) say too is dropped."""
    old = constitutive.where("relation = 'production'").select(F.col("micro").alias("source"), F.col("macro").alias("target"), F.coalesce("sign", F.lit("+")).alias("sign"), F.lit(LEGACY).alias("production_evidence"))
    return old.join(causal.select("source", "target", "sign").distinct(), ["source", "target", "sign"], "left_anti").select("source", "target", "sign", "production_evidence"), constitutive.where("relation <> 'production'")


def review_context(reviews: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """(id, incoming, outgoing) of nodes under review: at most ``most`` neighbours each way, in order, as a reviewer sees them."""
    def near(own: str, other: str, name: str) -> DataFrame:
        e = edges.select(F.col(own).alias("id"), F.concat_ws(" ", F.col(other), "sign").alias("x")).distinct()
        return e.groupBy("id").agg(F.slice(F.array_sort(F.collect_set("x")), 1, most).alias(name))

    out = reviews.select("id").distinct().join(near("target", "source", "incoming"), "id", "left").join(near("source", "target", "outgoing"), "id", "left")
    return out.select("id", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("incoming", "outgoing")])


# --- ledgers and reviews ----------------------------------------------------------------

#: Outcomes that take an influence out, or replace it.
REMOVE = ("reject", "reclassify_production", "reclassify_quantitative", "reclassify_constitutive")
SUPERSEDE = ("supersede",)


def ledger_violations(items: DataFrame, source: DataFrame, released: DataFrame) -> DataFrame:
    """Findings on decided work items against the authored and the released influences (id, causal_evidence).

    ``items`` has (item, influence_id, status, decision, replacement_id,
    replacement_evidence).  Until it is approved a decision changes nothing: the
    influence stays, without a class.  An accepted one has its class in both, a
    removed one is in neither, a superseded one has left and its replacement has
    the promised class.
    """
    def at(df: DataFrame, key: str, p: str) -> DataFrame:
        return df.select(F.col("id").alias(key), F.lit(True).alias(f"{p}_there"), F.col("causal_evidence").alias(f"{p}_class")).dropDuplicates([key])

    j = items.join(at(source, "influence_id", "src"), "influence_id", "left").join(at(released, "influence_id", "rel"), "influence_id", "left")
    j = j.join(at(source, "replacement_id", "rsrc"), "replacement_id", "left").join(at(released, "replacement_id", "rrel"), "replacement_id", "left")
    there = lambda p: F.coalesce(F.col(f"{p}_there"), F.lit(False))
    accept = F.col("decision").isin(*G.INTERVENTIONAL)
    early = ~there("src") | ~there("rel") | F.col("src_class").isNotNull() | F.col("rel_class").isNotNull()
    missed = ~F.col("src_class").eqNullSafe(F.col("decision")) | ~F.col("rel_class").eqNullSafe(F.col("decision"))
    complete = F.col("replacement_id").isNotNull() & G.admits(F.col("replacement_evidence"))
    replaced = F.col("rsrc_class").eqNullSafe(F.col("replacement_evidence")) & F.col("rrel_class").eqNullSafe(F.col("replacement_evidence"))
    problem = (
        F.when(~accept & ~F.col("decision").isin(*REMOVE, *SUPERSEDE), "unknown outcome")
        .when(F.col("decision").isin(*SUPERSEDE) & ~complete, "incomplete replacement")
        .when(F.col("status") == "proposed", F.when(early, "applied before approval"))
        .when(accept, F.when(missed, "acceptance not applied"))
        .when(F.col("decision").isin(*REMOVE), F.when(there("src") | there("rel"), "removal not applied"))
        .otherwise(F.when(there("src") | there("rel"), "superseded but still there").when(~replaced, "replacement not applied"))
    )
    return G.findings(j.withColumn("problem", problem).where("problem is not null"), "ledger", "error", F.col("item"), F.col("problem"))


def worklist(influences: DataFrame) -> DataFrame:
    """(item, influence_id, source, target, sign) of influences without a class of evidence; the item's name is a digest of its ends and sign."""
    digest = F.substring(F.sha2(F.concat_ws("\0", "source", "target", "sign"), 256), 1, 16)
    return influences.where("causal_evidence is null").select(F.concat(F.lit("legacy-evidence-"), digest).alias("item"), F.col("id").alias("influence_id"), "source", "target", "sign")


def imported_reviews(sampled: DataFrame, sent: DataFrame, returned: DataFrame, key: str, identity: list[str], verdict: str = "verdict") -> tuple[DataFrame, DataFrame]:
    """(reviews, findings): what came back, and where it isn't what was sent.

    Rows meet by ``key``, never by their place.  Rows that are missing, added or
    repeated, changed identity columns and verdicts before sending are findings.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    name = lambda df, p: df.select(F.col(key), *[text(c).alias(f"{p}_{c}") for c in identity if c != key], *([text(verdict).alias(f"{p}_verdict")] if verdict in df.columns else []), F.lit(True).alias(p))
    j = name(sampled, "sample").join(name(sent, "sent"), key, "full").join(name(returned, "back"), key, "full")
    out = [G.findings(j.where(F.col(p).isNull()), "review", "error", F.col(key), F.lit(f"missing in {p}")) for p in ("sample", "sent", "back")]
    for c in (c for c in identity if c != key):
        out.append(G.findings(j.where(F.col(f"sample_{c}") != F.col(f"sent_{c}")), "review", "error", F.col(key), F.lit(f"{c} differs from the sample")))
        out.append(G.findings(j.where(F.col(f"sent_{c}") != F.col(f"back_{c}")), "review", "error", F.col(key), F.lit(f"{c} was changed")))
    if verdict in sent.columns:
        out.append(G.findings(j.where("sent_verdict <> ''"), "review", "error", F.col(key), F.lit("had a verdict when sent")))
    out.append(G.ambiguous_keys(returned, [key], "review"))
    status = F.when(F.upper(text(verdict)) == "TRUE", "accepted").when(F.upper(text(verdict)) == "FALSE?", "flagged").when(F.upper(text(verdict)) == "FALSE", "rejected").otherwise("open")
    return returned.withColumn("status", status), reduce(DataFrame.unionByName, out)


# --- submissions ----------------------------------------------------------------------

SUBMISSION = "id string, curator string, created string, status string, title string, note string, contribution string, review_note string, version long"
#: The states of a submission, and where each may lead.
STATES = {"pending": ("validated", "rejected"), "validated": ("approved", "rejected"), "approved": ("merged", "rejected"), "merged": (), "rejected": ()}


class Submissions:
    """Submissions as a log of numbered commits; the last version of an id counts.

    A commit is a small file that names a folder of rows.  Whoever writes reads
    the log, checks what it wants against the state, writes the rows and then
    tries to make the next commit, which only one writer can.  The others read
    again and check again, so no two changes rest on the same state.  Every
    ``compact_every`` commits the rows as they stand are put into one folder.
    """

    def __init__(self, spark: SparkSession, path: str, compact_every: int = 50) -> None:
        self.spark, self.path, self.compact_every = spark, path.rstrip("/"), compact_every

    def _commits(self) -> list[tuple[int, dict]]:
        """(number, commit) from the last whole state on."""
        jvm = self.spark.sparkContext._jvm
        log = jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        fs = log.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(log):
            return []
        numbers = sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(log) if re.fullmatch(r"\d+\.json", f.getPath().getName()))
        out: list[tuple[int, dict]] = []
        for n in reversed(numbers):
            stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/{n:012d}.json"))
            commit = json.loads(bytes(stream.readAllBytes()))
            stream.close()
            out.append((n, commit))
            if commit["whole"]:
                break
        return out[::-1]

    def _read(self, commits: list[tuple[int, dict]]) -> DataFrame:
        if not commits:
            return self.spark.createDataFrame([], SUBMISSION)
        return self.spark.read.schema(SUBMISSION).parquet(*[f"{self.path}/rows/{c['rows']}" for _, c in commits])

    @staticmethod
    def _last(rows: DataFrame) -> DataFrame:
        return rows.groupBy("id").agg(F.max_by(F.struct("*"), "version").alias("x")).select("x.*")

    def list(self, status: str | None = None) -> DataFrame:
        """Submissions as they stand, the newest first; rows whose contribution isn't JSON are left out."""
        good = self._last(self._read(self._commits())).where(F.try_parse_json("contribution").isNotNull())
        return (good.where(F.col("status") == status) if status else good).orderBy(F.desc("created"), "id")

    def _commit(self, change: Callable[[DataFrame], DataFrame], attempts: int = 100) -> None:
        """Add the rows that ``change`` makes of the state; it is asked again whenever another writer was first."""
        for _ in range(attempts):
            commits = self._commits()
            folder = uuid.uuid4().hex
            state = self._last(self._read(commits))
            change(state).write.parquet(f"{self.path}/rows/{folder}")
            number = commits[-1][0] + 1 if commits else 0
            if put_if_absent(self.spark, f"{self.path}/log/{number:012d}.json", json.dumps({"rows": folder, "whole": False})):
                if len(commits) + 1 >= self.compact_every:
                    self._compact()
                return
        raise RuntimeError(f"{attempts} other commits came first")

    def _compact(self) -> None:
        """One folder for the state; if another writer comes first, a later commit compacts."""
        commits, folder = self._commits(), uuid.uuid4().hex
        self._last(self._read(commits)).write.parquet(f"{self.path}/rows/{folder}")
        put_if_absent(self.spark, f"{self.path}/log/{commits[-1][0] + 1:012d}.json", json.dumps({"rows": folder, "whole": True}))

    def add(self, rows: DataFrame) -> None:
        """New submissions (id, curator, created, title, note, contribution); they are pending.  Unsafe, repeated and known ids raise."""
        from signflow.functions.text import is_safe_id

        if not rows.where(~is_safe_id(F.col("id"))).isEmpty():
            raise ValueError("an id isn't safe in a path")
        if not rows.groupBy("id").count().where("count > 1").isEmpty():
            raise ValueError("an id is there twice")

        def change(state: DataFrame) -> DataFrame:
            if not rows.join(state.select("id"), "id", "left_semi").isEmpty():
                raise ValueError("an id is known already")
            return rows.select("id", "curator", "created", F.lit("pending").alias("status"), "title", "note", "contribution", F.lit(None).cast("string").alias("review_note"), F.lit(0).cast("long").alias("version"))

        self._commit(change)

    def move(self, ident: str, status: str, note: str | None = None) -> None:
        """A submission's next state; states that don't follow raise, also where another writer has moved it meanwhile."""

        def change(state: DataFrame) -> DataFrame:
            now = state.where(F.col("id") == ident).first()
            if now is None:
                raise KeyError(ident)
            if status not in STATES[now.status]:
                raise ValueError(f"{now.status} doesn't lead to {status}")
            row = now.asDict() | {"status": status, "review_note": note, "version": now.version + 1}
            return self.spark.createDataFrame([tuple(row[c.split()[0]] for c in SUBMISSION.split(", "))], SUBMISSION)

        self._commit(change)


def axioms(tables: Tables) -> DataFrame:
    """(axiom) lines that a contribution would add, for a preview."""
    t = tables
    word = lambda c: F.when(c == "+", "positively").when(c == "-", "negatively").otherwise("in an open direction")
    rows = [
        t["nodes"].select(F.concat(F.lit("Declaration(Class(:"), "id", F.lit("))")).alias("axiom")),
        t["causal_edges"].select(F.concat(F.lit("SubClassOf(:"), "source", F.lit(" influences "), word(F.col("sign")), F.lit(" :"), "target", F.lit(")")).alias("axiom")),
        t["production_edges"].select(F.concat(F.lit("SubClassOf(:"), "source", F.lit(" produces :"), "target", F.lit(")")).alias("axiom")),
        t["constitutive_edges"].select(F.concat(F.lit("SubClassOf(:"), "micro", F.lit(" "), "relation", F.lit(" :"), "macro", F.lit(")")).alias("axiom")),
        t["modulation_edges"].select(F.concat(F.lit("SubClassOf(:"), "modulator", F.lit(" modulates "), F.coalesce("influence_id", F.concat_ws(">", "edge_source", "edge_target")), F.lit(")")).alias("axiom")),
        t["quantitative_definitions"].select(F.concat(F.lit("SubClassOf(:"), "result", F.lit(" is "), "kind", F.lit(" of "), F.array_join(F.transform("arguments", lambda a: a.node), ", "), F.lit(")")).alias("axiom")),
    ]
    return reduce(DataFrame.union, rows)

