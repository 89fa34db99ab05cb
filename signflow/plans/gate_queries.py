"""Queries on gates: parts as typed nodes, with constitution, evidence, identifiers, ledgers and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from signflow.functions.storage import store
from signflow.operators import curation as C
from signflow.operators import gates as G
from signflow.operators import reach as R
from signflow.plans.graph_queries import CON, _constitutive
from signflow.sources import derived as D
from signflow.sources.derived import ALL_SQL, FLOW_SQL, SEQUENCE_SQL

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _list(values: tuple) -> str:
    return "[" + ", ".join("null" if v is None else f"'{v}'" for v in values) + "]"


def _pick(values: tuple, index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (index + 1).cast("int"))


ENTITIES = {"SMALL": "UBERON:", "MEDIUM": "CL:", "LARGE": "CHEBI:", "ECONOMY": "GO:", "STANDARD": "XX:"}
QUALITIES = ("PATO:0000070", "PATO:0000918", "PATO:0000033", "PATO:0000161", "PATO:0000044", "not an id", None)
RELATIONS = ("part_of+determination", "aggregation", "participation", "aggregation", "other")
KINDS = (("PATO:0000070", "extensive"), ("PATO:0000918", "extensive"), ("PATO:0000033", "ratio"), ("PATO:0000161", "rate"))
EVIDENCE = (*G.INTERVENTIONAL, *G.ASSOCIATIONAL, None)

#: Parts as nodes; a part is constituted by those of twice its number.
NODES = f"""nodes as (select p_partkey::varchar as id, p_partkey as k, p_name as label, {_list(G.SCALES)}[p_size % 7 + 1] as scale,
  case p_type {' '.join(f"when '{t}' then '{p}'" for t, p in ENTITIES.items())} end || (p_size % 40) as entity_iri, {_list(QUALITIES)}[p_partkey % 7 + 1] as quality_iri,
  case when p_size % 3 = 0 then 'UBERON:' || (p_size % 10) end as bearer_entity_iri, case when p_partkey % 11 = 0 then 'occurrent' end as bearer_kind, p_retailprice < 950 as exogenous from part)"""
EDGES = f"edges as (select p_partkey::varchar as micro, (p_partkey // 2)::varchar as macro, {_list(RELATIONS)}[p_size % 5 + 1] as relation, case when p_size % 3 = 0 then '-' else '+' end as sign from part where p_partkey > 0)"
BACKBONE = "backbone as (select 'UBERON:' || i as id, i from (select unnest(range(0, 40)) as i) where i % 4 <> 3), steps(src, dst) as (select 'UBERON:' || i, 'UBERON:' || (i // 2) from (select unnest(range(1, 40)) as i)), closure(src, dst) as (select * from steps union select c.src, s.dst from closure c join steps s on s.src = c.dst)"


def _nodes(s, d):
    p, k, n = D.table(s, d, "part"), F.col("p_partkey"), F.col("p_size")
    prefix = F.coalesce(*[F.when(F.col("p_type") == t, x) for t, x in ENTITIES.items()])
    return p.select(
        k.cast("string").alias("id"),
        F.col("p_name").alias("label"),
        _pick(G.SCALES, n % 7).alias("scale"),
        F.concat(prefix, (n % 40).cast("string")).alias("entity_iri"),
        _pick(QUALITIES, k % 7).alias("quality_iri"),
        F.when(n % 3 == 0, F.concat(F.lit("UBERON:"), (n % 10).cast("string"))).alias("bearer_entity_iri"),
        F.when(k % 11 == 0, "occurrent").alias("bearer_kind"),
        F.lit(None).cast("string").alias("quality_kind"),
        (F.col("p_retailprice") < 950).alias("exogenous"),
    )


def _edges(s, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    return D.table(s, d, "part").where("p_partkey > 0").select(k.cast("string").alias("micro"), F.floor(k / 2).cast("long").cast("string").alias("macro"), _pick(RELATIONS, n % 5).alias("relation"), F.when(n % 3 == 0, "-").otherwise("+").alias("sign"))


def _backbone(s):
    name = lambda i: F.concat(F.lit("UBERON:"), i.cast("string"))
    ids = s.range(40)
    return ids.where("id % 4 <> 3").select(name(F.col("id")).alias("id")), R.closure(ids.where("id > 0").select(name(F.col("id")).alias("src"), name(F.floor(F.col("id") / 2)).alias("dst")))


def _kinds(s):
    return s.createDataFrame(list(KINDS), "iri string, kind string")


MISSING = "select 'references' as gate, 'error' as level, k::varchar as subject, 'l_suppkey ' || k || ' is unknown' as message from (select distinct l_suppkey as k from lineitem where l_suppkey not in (select s_suppkey from supplier where s_acctbal > 0))"


@query("fk_violations", MISSING)
def fk_violations(s, d):
    return G.missing_keys(D.table(s, d, "lineitem"), "l_suppkey", D.table(s, d, "supplier").where("s_acctbal > 0"), "s_suppkey", "references")


@query("ambiguous_keys", "select 'unique' as gate, 'error' as level, l_orderkey || '|' || l_linenumber as subject, 'occurs ' || count(*) || ' times' as message from lineitem group by l_orderkey, l_linenumber having count(*) > 1")
def ambiguous_keys(s, d):
    return G.ambiguous_keys(D.table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], "unique")


#: Modulations name an influence, or its ends, or nothing that exists.
MODULATIONS = "m as (select p_partkey as modulator, case when p_size % 3 = 0 then p_partkey * 10 + 1 end as influence_id, p_partkey % 50 as edge_source, p_size as edge_target from part), i as (select l_orderkey * 10 + l_linenumber as id, l_partkey % 50 as source, l_linenumber as target from lineitem)"


def _modulations(s, d):
    m = D.table(s, d, "part").select(F.col("p_partkey").alias("modulator"), F.when(F.col("p_size") % 3 == 0, F.col("p_partkey") * 10 + 1).alias("influence_id"), (F.col("p_partkey") % 50).alias("edge_source"), F.col("p_size").alias("edge_target"))
    i = D.table(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 50).alias("source"), F.col("l_linenumber").alias("target"))
    return G.resolved(m, i)


@query("modulation_resolution", f"""with {MODULATIONS}, n as (select m.*, count(i.id) as n from m left join i on (influence_id is not null and i.id = influence_id) or (influence_id is null and i.source = edge_source and i.target = edge_target) group by all)
select 'modulation' as gate, 'error' as level, modulator || '|' || coalesce(influence_id::varchar, '') || '|' || edge_source || '|' || edge_target as subject, case when n = 0 then 'fits no influence' else 'fits ' || n || ' influences' end as message from n where n <> 1""")
def modulation_resolution(s, d):
    return _modulations(s, d)[1]


@query("modulation_found", f"""with {MODULATIONS}, n as (select m.*, count(i.id) as n, min(i.id) as found from m left join i on (influence_id is not null and i.id = influence_id) or (influence_id is null and i.source = edge_source and i.target = edge_target) group by all) select modulator, found from n where n = 1""")
def modulation_found(s, d):
    return _modulations(s, d)[0].select("modulator", "found")


RESOURCE = "(['Signor 3', 'OmniPath', 'BioModels x', 'Cell Collective', 'my GENIE3 run', 'ChIP-Seq', 'GWAS Catalog', 'elsewhere'])[p_partkey % 8 + 1]"


@query("evidence_sources", f"select p_partkey, case {' '.join(f'''when contains(lower(x), '{a}') then '{b}' ''' for a, b in G.RESOURCES)} else 'unknown' end as evidence from (select p_partkey, {RESOURCE} as x from part)")
def evidence_sources(s, d):
    """The best class of evidence that a named resource gives."""
    x = _pick(("Signor 3", "OmniPath", "BioModels x", "Cell Collective", "my GENIE3 run", "ChIP-Seq", "GWAS Catalog", "elsewhere"), F.col("p_partkey") % 8)
    return D.table(s, d, "part").select("p_partkey", G.evidence_class(x).alias("evidence"))


CAUSAL = f"causal as (select l_partkey::varchar as source, l_suppkey::varchar as target, {_list(EVIDENCE)}[l_linenumber + l_orderkey % 5] as causal_evidence from lineitem)"
_IV = ", ".join(f"'{x}'" for x in G.INTERVENTIONAL)


def _causal(s, d):
    at = F.col("l_linenumber") + F.col("l_orderkey") % 5 - 1
    ev = F.try_element_at(F.array(*[F.lit(x).cast("string") for x in EVIDENCE]), (at + 1).cast("int"))
    return D.table(s, d, "lineitem").select(F.col("l_partkey").cast("string").alias("source"), F.col("l_suppkey").cast("string").alias("target"), ev.alias("causal_evidence"))


@query("evidence_census", f"with {CAUSAL}, e as (select coalesce(causal_evidence, 'unclassified') as causal_evidence from causal) select causal_evidence, count(*)::bigint as n, coalesce(causal_evidence in ({_IV}), false) as admits from e group by rollup (causal_evidence)")
def evidence_census(s, d):
    return G.evidence_census(_causal(s, d))


AUDIT = "select 'causal_evidence' as gate, 'error' as level, source || '>' || target as subject, coalesce('only association: ' || causal_evidence, 'no class of evidence') as message from causal where (causal_evidence not in ({iv}) or causal_evidence is null)"


@query("evidence_audit", f"with {CAUSAL} {AUDIT.format(iv=_IV)} and causal_evidence is not null")
def evidence_audit(s, d):
    return G.evidence_audit(_causal(s, d))


@query("evidence_required", f"with {CAUSAL} {AUDIT.format(iv=_IV)}")
def evidence_required(s, d):
    return G.evidence_audit(_causal(s, d), require_all=True)


@query("modulation_audit", f"with {CAUSAL} select 'causal_evidence' as gate, 'error' as level, source || '>' || source || '>' || target as subject, coalesce('only association: ' || causal_evidence, 'no class of evidence') as message from causal where causal_evidence not in ({_IV}) or causal_evidence is null")
def modulation_audit(s, d):
    return G.modulation_audit(_causal(s, d).select(F.col("source").alias("modulator"), F.col("source").alias("edge_source"), F.col("target").alias("edge_target"), "causal_evidence"))


RANK = "list_position({scales}, {x})"


def _rank(x: str) -> str:
    return RANK.format(scales=_list(G.SCALES), x=x)


@query("scale_inversion", f"""with {NODES}, {EDGES} select 'constitution' as gate, 'error' as level, micro || '>' || macro as subject, a.scale || ' within ' || b.scale as message
from edges join nodes a on a.id = micro join nodes b on b.id = macro where {_rank('a.scale')} > {_rank('b.scale')}""")
def scale_inversion(s, d):
    n = _nodes(s, d).select("id", "scale")
    e = _edges(s, d).join(n.select(F.col("id").alias("micro"), F.col("scale").alias("micro_scale")), "micro").join(n.select(F.col("id").alias("macro"), F.col("scale").alias("macro_scale")), "macro")
    return G.scale_inversions(e)


_KIND = "coalesce(case when split_part({x}, ':', 1) in ('UBERON', 'CL') then 'anatomical' when split_part({x}, ':', 1) in ('CHEBI', 'PR') then 'substance' when split_part({x}, ':', 1) = 'GO' then 'process' end, 'unknown')"
CONSTITUTION = f"""e as (select micro, macro, relation, sign, a.scale as s1, b.scale as s2, {_KIND.format(x='a.entity_iri')} as k1, {_KIND.format(x='b.entity_iri')} as k2, a.entity_iri as e1, b.entity_iri as e2, a.bearer_entity_iri as b1, b.bearer_entity_iri as b2
  from edges join nodes a on a.id = micro join nodes b on b.id = macro),
f as (select *, case when k1 = 'anatomical' or relation = 'aggregation' then e1 else b1 end as x1, case when k2 = 'anatomical' or relation = 'aggregation' then e2 else b2 end as x2 from e),
g as (select *, x1 in (select id from backbone) and x2 in (select id from backbone) as known, exists (select 1 from closure where src = x1 and dst = x2) as path, relation = 'part_of+determination' as st, relation = 'aggregation' as ag, k2 = 'substance' as sub, k1 = 'anatomical' and k2 = 'anatomical' as anat, x1 is not null and x2 is not null as anch from f),
h as (select micro || '>' || macro as subject, unnest([
  case when relation not in ('part_of+determination', 'aggregation', 'participation') then 'error|unknown relation ' || relation end,
  case when relation in ('part_of+determination', 'aggregation', 'participation') and {_rank('s1')} > {_rank('s2')} then 'error|' || s1 || ' within ' || s2 end,
  case when st and sub then 'error|a substance is produced, not constituted' end,
  case when ag and sign <> '+' then 'error|an aggregation is positive' end,
  case when (st and not sub or ag and anat) and anch and known and not path then 'error|no part_of path' end,
  case when (st and not sub or ag and anat) and anch and not known then 'note|anchors are not in the backbone' end,
  case when st and not sub and not anch then 'note|no anchor to verify part_of by' end]) as x from g)"""


@query("constitution", f"with recursive {NODES}, {EDGES}, {BACKBONE}, {CONSTITUTION} select 'constitution' as gate, split_part(x, '|', 1) as level, subject, split_part(x, '|', 2) as message from h where x is not null")
def constitution(s, d):
    return G.constitution(_edges(s, d), _nodes(s, d), *_backbone(s))


@query("partof_violations", f"""with recursive {CON}, r(src, dst) as (select micro, macro from con union select r.src, con.macro from r join con on con.micro = r.dst)
select 'part_of' as gate, 'error' as level, o_orderkey || '>' || (2000000000000 + o_custkey % 25) as subject, 'no part_of path' as message from orders where not exists (select 1 from r where src = o_orderkey and dst = 2000000000000 + o_custkey % 25)""")
def partof_violations(s, d):
    """Orders that don't belong to the nation one would guess."""
    steps = _constitutive(s, d).select(F.col("micro").alias("src"), F.col("macro").alias("dst"))
    pairs = D.table(s, d, "orders").select(F.col("o_orderkey").alias("part"), (F.lit(2 * 10**12).cast("long") + F.col("o_custkey") % 25).alias("whole"))
    return G.not_part_of(pairs, steps)


@query("grounding_buckets", f"""with {NODES}, {EDGES}, {ALL_SQL} select id as node, case when id in (select macro from edges) then 'grounded' when exogenous then 'exogenous' when k in (select dst from arc where src <> dst) then 'derived' else 'ungrounded' end as bucket
from nodes where scale in ('organ', 'organ_system', 'organism')""")
def grounding_buckets(s, d):
    arcs = D.arcs(s, d).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    return G.grounding(_nodes(s, d).select(F.col("id").alias("node"), "scale", "exogenous"), arcs, _edges(s, d))


@query("free_floating", f"with {NODES}, {EDGES} select id as node from nodes where scale in ('organ', 'organ_system', 'organism') and not exogenous and id not in (select macro from edges)")
def free_floating(s, d):
    return G.free_floating(_nodes(s, d).select(F.col("id").alias("node"), "scale", "exogenous"), _edges(s, d))


BEARER = "coalesce(bearer_kind, case when quality_iri in (" + ", ".join(f"'{q}'" for q in G.PROCESS_QUALITIES) + ") then 'occurrent' else 'continuant' end)"
REGIME = f"""kinds as (select id, {BEARER} as b from nodes), reg as (select edges.*, case when x.b = 'continuant' and y.b = 'continuant' then 'material_constitution' when x.b = 'occurrent' and y.b = 'occurrent' then 'process_constitution' else 'causal' end as regime
  from edges join kinds x on x.id = micro join kinds y on y.id = macro)"""


@query("regime_split", f"with {NODES}, {EDGES}, {REGIME} select micro, macro, relation, sign, regime from reg")
def regime_split(s, d):
    return G.regimes(_edges(s, d), _nodes(s, d), "micro", "macro").select("micro", "macro", "relation", "sign", "regime")


@query("bearer_divide", f"""with {NODES}, {EDGES}, {REGIME} select 'bearer' as gate, case regime when 'causal' then 'error' else 'note' end as level, micro || '>' || macro as subject,
  case regime when 'causal' then 'constitution crosses the divide of things and processes' else 'process constitution' end as message from reg where regime <> 'material_constitution'
union all select 'bearer', 'note', micro || '>' || macro, 'production within one kind of bearer' from reg where regime <> 'causal'""")
def bearer_divide(s, d):
    e = _edges(s, d)
    return G.bearer_divide(e, e.select(F.col("micro").alias("source"), F.col("macro").alias("target")), _nodes(s, d))


@query("bearer_axiom", f"""with {NODES}, j as (select id, case split_part(coalesce(entity_iri, bearer_entity_iri), ':', 1) when 'GO' then 'occurrent' when 'UBERON' then 'continuant' when 'CL' then 'continuant' when 'CHEBI' then 'continuant' end as has,
  case quality_iri when 'PATO:0000161' then 'occurrent' when 'PATO:0000044' then 'occurrent' when 'PATO:0000070' then 'continuant' end as needs from nodes)
select 'bearer_axiom' as gate, 'error' as level, id as subject, 'a quality of a ' || needs || ' on a ' || has as message from j where has <> needs""")
def bearer_axiom(s, d):
    """Kinds of qualities come down a hierarchy of terms, kinds of entities from their prefix."""
    n = _nodes(s, d)
    e = n.select(F.coalesce("entity_iri", "bearer_entity_iri").alias("iri")).distinct()
    p = F.split_part(F.col("iri"), F.lit(":"), F.lit(1))
    entity = e.select("iri", F.when(p == "GO", "occurrent").when(p.isin("UBERON", "CL", "CHEBI"), "continuant").alias("kind")).where("kind is not null")
    is_a = s.createDataFrame([("PATO:0000161", "PATO:p"), ("PATO:0000044", "PATO:f"), ("PATO:f", "PATO:p"), ("PATO:0000070", "PATO:o")], "src string, dst string")
    quality = G.inherited_kinds(is_a, s.createDataFrame([("PATO:p", "occurrent"), ("PATO:o", "continuant")], "iri string, kind string"))
    return G.bearer_axiom(n, entity, quality, strict=True)


_QK = "coalesce(case quality_iri " + " ".join(f"when '{i}' then '{k}'" for i, k in KINDS) + " end, 'intensive')"


@query("determination_signs", f"with {NODES}, {EDGES} select micro, macro, (case when relation = 'aggregation' and {_QK} in ('extensive', 'rate') then 1 when sign = '+' then 1 when sign = '-' then 2 else 3 end)::int as m from edges join nodes on nodes.id = macro")
def determination_signs(s, d):
    return G.determination_signs(_edges(s, d), G.quantity_kinds(_nodes(s, d), _kinds(s)))


QUANT = "q as (select p_partkey::varchar as result, (p_partkey + 1)::varchar as num, (p_partkey + 2)::varchar as den from part)"


@query("quantity_typing", f"""with {NODES}, {EDGES}, {REGIME}, {QUANT}, qk as (select id, {_QK} as quantity, quality_iri from nodes),
c as (select reg.*, y.quantity, x.quality_iri as q1, y.quality_iri as q2 from reg join qk x on x.id = micro join qk y on y.id = macro where regime = 'material_constitution'),
args as (select result, num as node, 'numerator' as role from q union all select result, den, 'denominator' from q), cause as (select distinct l_partkey::varchar as source, (l_partkey - 1)::varchar as target, '-' as sign from lineitem),
au as (select args.*, sign from args join cause on source = node and target = result),
rows as (select 'error' as level, node || '>' || result as subject, 'an argument of the ratio is also a cause' as message from (select distinct node, result from au)
union all select 'error', micro || '>' || macro, 'aggregation into a quantity that is ' || quantity from c where relation = 'aggregation' and quantity not in ('extensive', 'rate')
union all select 'error', micro || '>' || macro, 'aggregation of unlike qualities' from c where relation = 'aggregation' and quantity in ('extensive', 'rate') and q1 <> q2
union all select 'note', micro || '>' || macro, 'a ratio has two sides and no parts' from c where relation <> 'aggregation' and quantity = 'ratio'
union all select 'note', micro || '>' || macro, 'the sign is asserted, not derived' from c where relation <> 'aggregation' and quantity = 'intensive'
union all select 'note', result, 'result of a ratio is ' || quantity from q join qk on id = result where quantity <> 'ratio'
union all select 'note', node || '>' || result, role || ' is ' || quantity from args join qk on id = node where quantity not in ('extensive', 'rate')
union all select 'error', node || '>' || result, role || ' edge is ' || sign from au where role = 'numerator')
select 'quantity' as gate, * from rows""")
def quantity_typing(s, d):
    return G.quantity_typing(_edges(s, d), _nodes(s, d), _kinds(s), _quantitative(s, d), _causes(s, d))


def _quantitative(s, d):
    side = lambda k, role, sign: F.struct((F.col("p_partkey") + k).cast("string").alias("node"), F.lit(role).alias("role"), F.lit(sign).alias("derivative_sign"))
    return D.table(s, d, "part").select(F.lit("ratio").alias("kind"), F.col("p_partkey").cast("string").alias("result"), F.array(side(1, "numerator", "+"), side(2, "denominator", "-")).alias("arguments"))


def _causes(s, d):
    return D.table(s, d, "lineitem").select(F.col("l_partkey").cast("string").alias("source"), (F.col("l_partkey") - 1).cast("string").alias("target"), F.lit("-").alias("sign")).distinct()


_FIELDS = "unnest([{'f': 'entity_iri', 'iri': entity_iri}, {'f': 'quality_iri', 'iri': quality_iri}, {'f': 'bearer_entity_iri', 'iri': bearer_entity_iri}])"
_PFX = ", ".join(f"'{p}'" for p in G.PREFIXES)


@query("identifiers", f"""with {NODES}, u as (select id, {_FIELDS} as x from nodes), v as (select id || '.' || x.f as subject, x.f as f, x.iri as iri, regexp_full_match(x.iri, '[A-Za-z][A-Za-z0-9_-]*:[A-Za-z0-9][A-Za-z0-9._-]*') as legal, upper(split_part(x.iri, ':', 1)) as p from u where x.iri is not null)
select 'ontology' as gate, 'error' as level, subject, iri || ' is no identifier' as message from v where not legal union all select 'ontology', 'error', subject, p || ' is not allowed' from v where legal and p not in ({_PFX})
union all select 'ontology', 'note', subject, iri || ' is no PATO term' from v where legal and p in ({_PFX}) and f = 'quality_iri' and p <> 'PATO' union all select 'ontology', 'note', subject, iri || ' is not verified yet' from v where legal and p in ({_PFX}) and iri not like 'UBERON:1%'""")
def identifiers(s, d):
    n = _nodes(s, d)
    known = n.select(F.explode(F.array("entity_iri", "bearer_entity_iri")).alias("iri")).where("iri like 'UBERON:1%'").distinct()
    return G.identifiers(n, known)


@query("verify_terms", """with u as (select distinct p_size % 30 as k, case when p_size % 2 = 0 then 'Term ' || (p_size % 30) when p_size % 3 = 0 then 'alias' end as asserted from part),
p as (select k, asserted, k < 25 as found, k % 7 = 0 as obsolete, k % 4 <> 0 and asserted is not null and asserted <> 'alias' as other from u)
select 'T:' || k as iri, unnest(list_filter([case when not found then 'not found' end, case when found and obsolete then 'obsolete' end, case when found and other then 'label differs' end], lambda x: x is not null)) as problem from p""")
def verify_terms(s, d):
    k = F.col("p_size") % 30
    used = D.table(s, d, "part").select(F.concat(F.lit("T:"), k.cast("string")).alias("iri"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Term "), k.cast("string"))).when(F.col("p_size") % 3 == 0, "alias").alias("asserted")).distinct()
    terms = s.range(25).select(F.concat(F.lit("T:"), F.col("id").cast("string")).alias("id"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("term  "), F.col("id").cast("string"))).otherwise("another").alias("label"), F.array(F.lit("ALIAS")).alias("synonyms"), (F.col("id") % 7 == 0).alias("obsolete"))
    return G.verify_terms(used, terms)


#: Work items on lines: what was decided, and what became of it in source and release.
LEDGER = """items as (select l_orderkey || '/' || l_linenumber || '/' || l_partkey as item, l_orderkey as i, case when l_linestatus = 'F' then 'approved' else 'proposed' end as status, (['perturbation', 'reject', 'supersede', 'maybe'])[l_partkey % 4 + 1] as decision, case when l_suppkey % 3 > 0 then l_suppkey end as r, case when l_suppkey % 5 > 0 then 'pharmacological' else 'coexpression' end as rev from lineitem),
src as (select o_orderkey as id, case when o_orderstatus = 'F' then 'perturbation' end as c from orders where o_orderpriority <> '1-URGENT'), rel as (select o_orderkey as id, case when o_orderstatus <> 'O' then case when o_orderkey < 50 then 'pharmacological' else 'perturbation' end end as c from orders where o_orderpriority <> '5-LOW'),
j as (select items.*, s.id is not null as st, s.c as sc, l.id is not null as lt, l.c as lc, rs.c as rsc, rl.c as rlc from items left join src s on s.id = i left join rel l on l.id = i left join src rs on rs.id = r left join rel rl on rl.id = r),
p as (select item, case when decision = 'maybe' then 'unknown outcome' when decision = 'supersede' and (r is null or rev = 'coexpression') then 'incomplete replacement'
  when status = 'proposed' then case when not st or not lt or sc is not null or lc is not null then 'applied before approval' end
  when decision = 'perturbation' then case when sc is distinct from decision or lc is distinct from decision then 'acceptance not applied' end
  when decision = 'reject' then case when st or lt then 'removal not applied' end when st or lt then 'superseded but still there' when rsc is distinct from rev or rlc is distinct from rev then 'replacement not applied' end as problem from j)"""


@query("ledger_violations", f"with {LEDGER} select 'ledger' as gate, 'error' as level, item as subject, problem as message from p where problem is not null")
def ledger_violations(s, d):
    line = D.table(s, d, "lineitem")
    items = line.select(F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey").alias("item"), F.col("l_orderkey").alias("influence_id"), F.when(F.col("l_linestatus") == "F", "approved").otherwise("proposed").alias("status"), _pick(("perturbation", "reject", "supersede", "maybe"), F.col("l_partkey") % 4).alias("decision"), F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey")).alias("replacement_id"), F.when(F.col("l_suppkey") % 5 > 0, "pharmacological").otherwise("coexpression").alias("replacement_evidence"))
    o = D.table(s, d, "orders")
    source = o.where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "perturbation").alias("causal_evidence"))
    released = o.where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "O", F.when(F.col("o_orderkey") < 50, "pharmacological").otherwise("perturbation")).alias("causal_evidence"))
    return C.ledger_violations(items, source, released)


@query("worklist", "select 'legacy-evidence-' || substr(sha256(l_partkey || chr(0) || l_suppkey || chr(0) || l_returnflag), 1, 16) as item, l_orderkey as influence_id, l_partkey::varchar as source, l_suppkey::varchar as target, l_returnflag as sign from lineitem where l_linestatus = 'O'")
def worklist(s, d):
    return C.worklist(D.table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").cast("string").alias("source"), F.col("l_suppkey").cast("string").alias("target"), F.col("l_returnflag").alias("sign"), F.when(F.col("l_linestatus") == "F", "perturbation").alias("causal_evidence")))


@query("review_import", """with a as (select p_partkey as k, p_name as n from part where p_size < 45), b as (select p_partkey as k, case when p_size = 3 then p_name || '?' else p_name end as n, case when p_size = 4 then 'TRUE' else '' end as v from part where p_size > 1), c as (select p_partkey as k, case when p_size = 5 then 'x' else p_name end as n from part where p_size <> 9),
j as (select coalesce(a.k, b.k, c.k) as k, a.k is null as x, b.k is null as y, c.k is null as z, a.n as an, b.n as bn, c.n as cn, v from a full join b on a.k = b.k full join c on coalesce(a.k, b.k) = c.k)
select 'review' as gate, 'error' as level, k::varchar as subject, m as message from (select k, unnest([case when x then 'missing in sample' end, case when y then 'missing in sent' end, case when z then 'missing in back' end, case when an <> bn then 'name differs from the sample' end, case when bn <> cn then 'name was changed' end, case when v <> '' then 'had a verdict when sent' end]) as m from j) where m is not null""")
def review_import(s, d):
    p = D.table(s, d, "part")
    sample = p.where("p_size < 45").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))
    sent = p.where("p_size > 1").select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") == 3, F.concat("p_name", F.lit("?"))).otherwise(F.col("p_name")).alias("name"), F.when(F.col("p_size") == 4, "TRUE").otherwise("").alias("verdict"))
    back = p.where("p_size <> 9").select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") == 5, "x").otherwise(F.col("p_name")).alias("name"), F.lit("TRUE").alias("verdict"))
    return C.imported_reviews(sample, sent, back, "k", ["k", "name"])[1]


@query("gate_rollup", f"""with f as (select 'references' as gate, count(*) as errors from ({MISSING})
union all select 'unique', count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1) union all select 'empty', 0)
select gate, errors::bigint as errors, 0::bigint as notes, errors = 0 as ok from f""")
def gate_rollup(s, d):
    return G.report([fk_violations(s, d), ambiguous_keys(s, d)], ["references", "unique", "empty"])


@query("new_errors", f"""with recursive {NODES}, {EDGES}, {BACKBONE}, {CONSTITUTION}, x as (select subject, split_part(x, '|', 1) as level, split_part(x, '|', 2) as message, split_part(subject, '>', 1)::bigint as k from h where x is not null)
select 'constitution' as gate, level, subject, message from x where level = 'note' or k % 2 = 1""")
def new_errors(s, d):
    """Errors of a map that its first half, every second edge, didn't have."""
    e, n, back = _edges(s, d), _nodes(s, d), _backbone(s)
    return G.new_errors(G.constitution(e, n, *back), G.constitution(e.where("cast(micro as long) % 2 = 0"), n, *back))


@query("cross_scale_cycle", f"""with recursive {SEQUENCE_SQL}, a as (select x.node as src, y.node as dst from seq x join seq y on y.cust = x.cust and y.k = x.k + 1), c as (select node as src, lag(node) over (partition by cust order by k) as dst from seq where cust % 2 = 0),
m as (select * from a union select * from c where dst is not null), f(n) as (select y.node from seq x join seq y on y.cust = x.cust and y.k = x.k + 1 where x.cust % 2 = 0 union select x.node from seq x join seq y on y.cust = x.cust and y.k = x.k + 1 where x.cust % 2 = 0)
select src, dst from m where src in (select n from f)""")
def cross_scale_cycle(s, d):
    """Orders cause the next one; those of every second customer are also made up by it, which no solve can untangle."""
    q = D.sequence(s, d).select("cust", "k", "node")
    nxt = q.select("cust", (F.col("k") - 1).alias("k"), F.col("node").alias("other"))
    j = q.join(nxt, ["cust", "k"])
    return G.cross_scale_cycle(j.select(F.col("node").alias("src"), F.col("other").alias("dst")), j.where("cust % 2 = 0").select(F.col("other").alias("micro"), F.col("node").alias("macro")))


@query("entailment_diff", """with a as (select l_partkey as k, l_suppkey as v from lineitem where l_returnflag = 'R'), b as (select l_partkey as k, l_suppkey as v from lineitem where l_linestatus = 'F')
(select k, v, 'missing' as side from (select * from a except all select * from b)) union all (select k, v, 'extra' from (select * from b except all select * from a))""")
def entailment_diff(s, d):
    line = D.table(s, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("v"), "l_returnflag", "l_linestatus")
    return G.entailment_diff(line.where("l_returnflag = 'R'").select("k", "v"), line.where("l_linestatus = 'F'").select("k", "v"))


@query("grouping_classes", f"""with recursive {CON}, r(src, dst) as (select micro, macro from con union select r.src, con.macro from r join con on con.micro = r.dst)
select dst::bigint as whole, count(distinct src)::bigint as witnesses from r where src in (select l_orderkey from lineitem) group by dst""")
def grouping_classes(s, d):
    closure = store(R.closure(_constitutive(s, d).select(F.col("micro").alias("src"), F.col("macro").alias("dst"))), "closure")
    return G.grouping_classes(D.table(s, d, "lineitem").select(F.col("l_orderkey").alias("part")), closure)


@query("licensed_groupings", """with recursive up(site, whole) as (select 'U:' || p_partkey, p_partkey // 2 from part where p_partkey > 1 union all select site, whole // 2 from up where whole > 1),
n as (select p_partkey::varchar as id, p_size % 2 = 0 as occurrent, case when p_size % 2 = 0 then 'GO:' || (p_size % 6) else 'U:' || p_partkey end as entity, case when p_size % 7 > 0 then 'U:' || p_partkey end as context, case when p_size % 11 > 0 then 'Q:' || p_type end as quality, (['extensive', 'rate', 'intensive'])[p_size % 3 + 1] as kind from part),
c as (select id, mode, entity, quality, case mode when 'process' then context else entity end as site, case mode when 'process' then entity else '' end as same from (select *, case when occurrent and kind in ('extensive', 'rate') then 'process' when not occurrent and kind = 'extensive' then 'continuant' end as mode from n where quality is not null) where mode is not null and (mode <> 'process' or context is not null)),
w as (select mode, same, quality, site as whole, entity, min(id) as first from c group by all), lower as (select c.*, 'U:' || up.whole as whole from c join up using (site)),
m as (select w.mode, w.entity, w.whole, w.quality, list_sort(list_distinct(list_append(list(lower.id), any_value(first)))) as members from w join lower on lower.mode = w.mode and lower.same = w.same and lower.quality = w.quality and lower.whole = w.whole group by all)
select 'grouping-' || sha256(mode || chr(31) || entity || chr(31) || whole || chr(31) || quality)[1:20] as id, mode, entity, whole, quality, array_to_string(members, ',') as members from m""")
def licensed_groupings(s, d):
    """Classes of a quality of a part or what is below it, where extensive qualities and rates of processes license them."""
    k, n = F.col("p_partkey"), F.col("p_size")
    p = D.table(s, d, "part")
    site = F.concat(F.lit("U:"), k.cast("string"))
    nodes = p.select(k.cast("string").alias("id"), F.when(n % 2 == 0, F.concat(F.lit("GO:"), (n % 6).cast("string"))).otherwise(site).alias("entity"), F.when(n % 7 > 0, site).alias("context"), F.when(n % 11 > 0, F.concat(F.lit("Q:"), "p_type")).alias("quality"), _pick(("extensive", "rate", "intensive"), n % 3).alias("kind"), (n % 2 == 0).alias("occurrent"))
    steps = p.where("p_partkey > 1").select(site.alias("part"), F.concat(F.lit("U:"), F.floor(k / 2).cast("string")).alias("whole"))
    return G.licensed_groupings(nodes, steps).withColumn("members", F.array_join("members", ","))


@query("finalised_edges", f"""with {FLOW_SQL}, remap as (select node as old, node - node % 3 as new from seq), e as (select src, dst, ([ '+', '-', '?' ])[m] as sign, 'e' || m as evidence from arc),
r as (select coalesce(x.new, src) as source, coalesce(y.new, dst) as target, sign, evidence from e left join remap x on x.old = src left join remap y on y.old = dst)
select source, target, case when count(distinct sign) > 1 then '?' else min(sign) end as sign, string_agg(distinct evidence, '  ||  ' order by evidence) as evidence from r where source <> target group by source, target""")
def finalised_edges(s, d):
    """Orders merged three by three by number: one edge a pair, conflicts open, loops gone."""
    e = D.flow(s, d).select(F.col("src").alias("source"), F.col("dst").alias("target"), _pick(("+", "-", "?"), F.col("m") - 1).alias("sign"), F.concat(F.lit("e"), F.col("m").cast("string")).alias("evidence"))
    remap = D.sequence(s, d).select(F.col("node").alias("old"), (F.col("node") - F.col("node") % 3).alias("new"))
    return C.finalised(e, remap)


@query("moved_production", f"with {EDGES} select micro as source, macro as target, sign, 'legacy-evidence-unclassified' as production_evidence from edges where relation = 'other' and not exists (select 1 from lineitem where l_partkey::varchar = micro and l_suppkey::varchar = macro and sign = '+')")
def moved_production(s, d):
    e = _edges(s, d).withColumn("relation", F.when(F.col("relation") == "other", "production").otherwise(F.col("relation")))
    causal = D.table(s, d, "lineitem").select(F.col("l_partkey").cast("string").alias("source"), F.col("l_suppkey").cast("string").alias("target"), F.lit("+").alias("sign"))
    return C.moved_production(e, causal)[0]


@query("review_context", """with e as (select distinct l_partkey as s, l_suppkey as t, l_returnflag as g from lineitem), r as (select p_partkey as id from part),
i as (select t as id, list_sort(list(distinct s || ' ' || g))[1:5] as x from e group by t), o as (select s as id, list_sort(list(distinct t || ' ' || g))[1:5] as x from e group by s)
select r.id, coalesce(array_to_string(i.x, ','), '') as incoming, coalesce(array_to_string(o.x, ','), '') as outgoing from r left join i using (id) left join o using (id)""")
def review_context(s, d):
    e = D.table(s, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_returnflag").alias("sign"))
    out = C.review_context(D.table(s, d, "part").select(F.col("p_partkey").alias("id")), e)
    return out.select("id", F.array_join("incoming", ",").alias("incoming"), F.array_join("outgoing", ",").alias("outgoing"))
