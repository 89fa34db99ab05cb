"""Queries on annotations and terms, drugs, joins of tables, and maps as fragments, manifests and ontologies."""

from __future__ import annotations

from pyspark.sql import functions as F

from signflow.functions.storage import new_path, store
from signflow.operators import alignment as L
from signflow.operators import reach as R
from signflow.operators.intervals import longest_depth
from signflow.plans.graph_queries import ORDERS
from signflow.plans.text_queries import _term
from signflow.sources import derived as D
from signflow.sources import fragments as M
from signflow.sources import scans
from signflow.sources.derived import FLOW_SQL, SOLVED_SQL, times_sql

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


# --- annotations ----------------------------------------------------------------------

#: Parts are terms, each a kind of the one of half its number and, where three divides it, of a third; orders are annotated with what they hold; orders' lines map terms to nodes.
TERMS = """steps(src, dst) as (select p_partkey, p_partkey // 2 from part where p_partkey > 0 union select p_partkey, p_partkey // 3 from part where p_partkey > 0 and p_partkey % 3 = 0), up(src, dst, dist) as (select src, dst, 1 from steps union all select up.src, steps.dst, dist + 1 from up join steps on steps.src = up.dst),
ann as (select distinct l_orderkey as grp, l_partkey as term from lineitem), map as (select p_partkey as term, p_partkey % 40 as node, (case when p_size > 25 then 1 else 2 end)::int as sign from part where p_size % 5 < 3)"""
SEEN = "every as (select grp, term from ann union select grp, dst from ann join up on src = term), obs as (select grp, node, min(sign)::int as expected from every join map using (term) group by grp, node having count(distinct sign) = 1)"


def _steps(s, d):
    k = F.col("p_partkey")
    up = F.array_compact(F.array(F.floor(k / 2).cast("long"), F.when(k % 3 == 0, F.floor(k / 3).cast("long"))))
    return D.table(s, d, "part").where("p_partkey > 0").select(k.alias("src"), F.explode(up).alias("dst")).distinct()


def _closure(s, d):
    return store(R.closure(_steps(s, d)), "closure")


def _annotations(s, d):
    return D.table(s, d, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_partkey").alias("term")).distinct()


def _term_map(s, d):
    p = D.table(s, d, "part").where("p_size % 5 < 3")
    return p.select(F.col("p_partkey").alias("term"), (F.col("p_partkey") % 40).alias("node"), F.when(F.col("p_size") > 25, 1).otherwise(2).cast("int").alias("sign"))


@query("mapped_observations", f"with recursive {TERMS}, {SEEN} select * from obs")
def mapped_observations(s, d):
    return L.mapped_observations(_annotations(s, d), _closure(s, d), _term_map(s, d))


@query("group_coverage", f"with recursive {TERMS}, below as (select p_partkey as term, p_partkey as b from part union all select dst, src from up) select below.term, count(distinct grp)::bigint as groups from below left join ann on ann.term = b group by below.term")
def group_coverage(s, d):
    return L.group_coverage(D.table(s, d, "part").select(F.col("p_partkey").alias("term")), _closure(s, d), _annotations(s, d))


@query("ranked_gaps", f"with recursive {TERMS}, g as (select p_partkey as term, p_name as name from part), below as (select term, term as b from g union all select g.term, src from up join g on g.term = dst), n as (select below.term, count(distinct grp) as groups from below left join ann on ann.term = b group by below.term) select row_number() over (order by groups desc, name, term) as place, term, groups::bigint as groups, name from g join n using (term)")
def ranked_gaps(s, d):
    gaps = D.table(s, d, "part").select(F.col("p_partkey").alias("term"), F.col("p_name").alias("name"))
    return L.ranked_gaps(gaps, L.group_coverage(gaps, _closure(s, d), _annotations(s, d)), gaps)


@query("nearest_match", f"with recursive {TERMS} select src as term, arg_min(dst, (dist, dst)) as found, min(dist)::int as dist from up where dst in (select p_partkey from part where p_size % 4 = 0) group by src")
def nearest_match(s, d):
    p = D.table(s, d, "part")
    return L.nearest(p.select(F.col("p_partkey").alias("term")), _closure(s, d), p.where("p_size % 4 = 0").select(F.col("p_partkey").alias("term")))


NAMED = "names as (select p_partkey as term, case when p_size % 3 = 0 then 'Abnormal ' || (['blood', 'urine', 'x'])[p_size % 7 % 3 + 1] || ' ' || p_name else 'Increased ' || p_name end as name from part)"


@query("neutral_terms", f"""with recursive {TERMS}, {NAMED}, near as (select src as term, arg_min(dst, (dist, dst)) as found from up join names on names.term = dst and lower(name) like 'abnormal%' group by src),
votes as (select node, found as term, count(distinct map.term) as votes from map join near using (term) group by node, found), depth as (select src as term, max(dist) as depth from up group by src),
s as (select votes.*, (name ilike '%blood%')::int as sys, coalesce(depth, 0) as depth from votes join names using (term) left join depth using (term))
select node, arg_min(term, (-votes, -sys, -depth, term)) as term, max(votes)::bigint as votes from s group by node""")
def neutral_terms(s, d):
    """For each node the neutral term by a vote of its directional ones."""
    n = F.col("p_size")
    kind = F.element_at(F.array(F.lit("blood"), F.lit("urine"), F.lit("x")), (n % 7 % 3 + 1).cast("int"))
    names = D.table(s, d, "part").select(F.col("p_partkey").alias("term"), F.when(n % 3 == 0, F.concat_ws(" ", F.lit("Abnormal"), kind, "p_name")).otherwise(F.concat(F.lit("Increased "), "p_name")).alias("name"))
    return L.neutral_terms(_term_map(s, d).select("node", "term"), _closure(s, d), names, longest_depth(_steps(s, d)))


@query("term_depth", f"with recursive {TERMS} select p_partkey as term, coalesce(max(dist), 0)::int as depth from part left join up on src = p_partkey group by p_partkey")
def term_depth(s, d):
    """The longest way from each term up to a root."""
    return D.table(s, d, "part").select(F.col("p_partkey").alias("term")).join(longest_depth(_steps(s, d)), "term", "left").select("term", F.coalesce("depth", F.lit(0)).alias("depth"))


@query("term_candidates")
def term_candidates(s, d):
    """Directional terms and the nodes that have all their words."""
    p = D.table(s, d, "part")
    terms = p.select(F.col("p_partkey").alias("term"), _term().alias("name"))
    nodes = p.select(F.concat_ws("_", "p_name", "p_brand").alias("node"), F.concat_ws(" ", "p_name", "p_type", F.lit("potassium")).alias("label")).distinct()
    return L.candidates(terms, nodes, p.where("p_size = 13").select(F.col("p_partkey").alias("term")), _closure(s, d))


# --- drugs -----------------------------------------------------------------------------

#: Suppliers are drugs: what they ship acts on parts, which stand for targets, proteins and, at last, customers' orders.
DRUGS = """mech as (select l_suppkey as molecule, l_partkey as target, (['INHIBITOR', 'AGONIST', 'OTHER'])[l_linenumber % 3 + 1] as action_type from lineitem),
tgt as (select p_partkey as target, case when p_size % 3 > 0 then 'Homo sapiens' else 'Mus' end as organism, case when p_size % 5 > 0 then 'SINGLE PROTEIN' else 'FAMILY' end as target_type, 'P' || p_partkey as acc from part),
prot as (select 'P' || p_partkey as acc, 'PR:' || (p_partkey // 2) as protein from part), pn as (select 'PR:' || o_orderkey as protein, o_orderkey as node from orders),
act as (select s_name as drug, node, case action_type when 'INHIBITOR' then 2 else 1 end as mask from mech join supplier on s_suppkey = molecule join tgt using (target) join prot using (acc) join pn using (protein) where action_type <> 'OTHER' and organism = 'Homo sapiens' and target_type = 'SINGLE PROTEIN'),
clamp as (select lower(drug) as drug, node, min(mask)::int as mask from act group by lower(drug), node having count(distinct mask) = 1)"""


def _clamps(s, d):
    acc = lambda k: F.concat(F.lit("P"), k.cast("string"))
    line, part = D.table(s, d, "lineitem"), D.table(s, d, "part")
    action = F.element_at(F.array(F.lit("INHIBITOR"), F.lit("AGONIST"), F.lit("OTHER")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    mech = line.select(F.col("l_suppkey").alias("molecule"), F.col("l_partkey").alias("target"), action.alias("action_type"))
    mol = D.table(s, d, "supplier").select(F.col("s_suppkey").alias("molecule"), F.col("s_name").alias("pref_name"))
    # an isoform stands for its protein
    tgt = part.select(F.col("p_partkey").alias("target"), F.when(F.col("p_size") % 3 > 0, "Homo sapiens").otherwise("Mus").alias("organism"), F.when(F.col("p_size") % 5 > 0, "SINGLE PROTEIN").otherwise("FAMILY").alias("target_type"), F.array(acc(F.col("p_partkey"))).alias("accessions"))
    prot = part.select(F.concat(acc(F.col("p_partkey")), F.lit("-2")).alias("accession"), F.concat(F.lit("PR:"), F.floor(F.col("p_partkey") / 2).cast("string")).alias("protein"))
    nodes = D.table(s, d, "orders").select(F.concat(F.lit("PR:"), F.col("o_orderkey").cast("string")).alias("protein"), F.col("o_orderkey").alias("node"))
    actions = s.createDataFrame([("INHIBITOR", 2), ("AGONIST", 1)], "action_type string, mask int")
    return store(L.drug_clamps(mech, mol, tgt, prot, nodes, actions), "clamps")


@query("drug_clamps", f"with {DRUGS} select drug, node, mask from clamp")
def drug_clamps(s, d):
    return _clamps(s, d)


@query("drug_crosswalk", "with a as (select lower(s_name) as name, unnest([lower(s_name), 'alias ' || (s_suppkey % 30), 'other ' || (s_suppkey % 11)]) as alias, unnest([0, 1, 1]) as k from supplier), g as (select 'alias ' || i as gold from (select unnest(range(0, 20)) as i) union all select 'other ' || i from (select unnest(range(0, 8)) as i) union all select lower(s_name) from supplier where s_suppkey % 7 = 0) select name, arg_min(alias, (k, alias)) as gold from a join g on gold = alias group by name")
def drug_crosswalk(s, d):
    p = D.table(s, d, "supplier")
    name, k = F.lower("s_name"), F.col("s_suppkey")
    of = lambda w, n: F.concat(F.lit(f"{w} "), n.cast("string"))
    aliases = p.select(name.alias("name"), F.explode(F.array(of("Alias", k % 30), of("Other", k % 11))).alias("alias"))
    gold = s.range(20).select(of("alias", F.col("id")).alias("gold")).union(s.range(8).select(of("other", F.col("id")))).union(p.where("s_suppkey % 7 = 0").select(name))
    return L.crosswalk(p.select(name.alias("name")), aliases, gold)


DRUG_GOLD = "gold as (select distinct c_custkey as iv_id, l_orderkey as node, (case when l_tax > 0.04 then 1 else 2 end)::int as sign from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey), measurable as (select o_orderkey as node from orders where o_orderpriority <> '5-LOW')"


def _gold(s, d):
    line = D.table(s, d, "lineitem").select(F.col("l_orderkey").alias("node"), F.when(F.col("l_tax") > 0.04, 1).otherwise(2).cast("int").alias("sign"))
    return line.join(D.table(s, d, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_custkey").alias("iv_id")), "node").select("iv_id", "node", "sign").distinct()


FREE_GOLD = "g as (select iv_id, node, list(sign) as signs from gold group by iv_id, node), p as (select solved.* from solved where mask in (1, 2) and node in (select node from measurable) and not exists (select 1 from iv where iv.iv_id = solved.iv_id and iv.node = solved.node))"


@query("documented_effects", f"with recursive {ORDERS}, {SOLVED_SQL}, {DRUG_GOLD}, {FREE_GOLD} select p.iv_id, count(*) filter (list_contains(signs, mask))::bigint as corroborated, count(*) filter (not list_contains(signs, mask))::bigint as contradicted, count(*) filter (signs is null)::bigint as undocumented from p left join g using (iv_id, node) group by p.iv_id")
def documented_effects(s, d):
    """Determinate predictions against documented effects, of which a node may have both signs."""
    from signflow.operators.solve import solve

    iv = D.firsts(s, d)
    measurable = D.table(s, d, "orders").where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("node"))
    return L.documented(solve(D.flow(s, d), iv), _gold(s, d), iv, measurable)


@query("documented_recall", f"""with recursive {ORDERS}, {SOLVED_SQL}, {DRUG_GOLD}, o as (select iv_id, node, min(sign) as expected from gold where not exists (select 1 from iv where iv.iv_id = gold.iv_id and iv.node = gold.node) group by iv_id, node having count(distinct sign) = 1),
st as (select o.iv_id, case when mask is null then 'missing' when mask = 3 then 'ambiguous' when mask = expected then 'correct' else 'wrong' end as status from o left join solved using (iv_id, node)),
n as (select iv_id, count(*) filter (status = 'correct')::bigint as correct, count(*) filter (status = 'wrong')::bigint as wrong, count(*) filter (status = 'ambiguous')::bigint as ambiguous, count(*) filter (status = 'missing')::bigint as missing, count(*) as n from st group by rollup (iv_id))
select iv_id, correct, wrong, ambiguous, missing, case when correct + wrong > 0 then correct / (correct + wrong) end as precision, (correct + wrong) / n as coverage, correct / n as accuracy from n""")
def documented_recall(s, d):
    from signflow.operators.solve import solve

    iv = D.firsts(s, d)
    return L.recall(solve(D.flow(s, d), iv), _gold(s, d), iv)


HOP = f"hop as (select iv_id, arc.dst as node, bit_or({times_sql('iv.mask', 'arc.m')})::int as mask from iv join arc on arc.src = iv.node where not exists (select 1 from iv i2 where i2.iv_id = iv.iv_id and i2.node = arc.dst) group by iv_id, arc.dst)"


@query("documented_one_hop", f"with recursive {ORDERS}, {HOP}, {DRUG_GOLD}, {FREE_GOLD.replace('solved', 'hop')} select p.iv_id, count(*) filter (list_contains(signs, mask))::bigint as corroborated, count(*) filter (not list_contains(signs, mask))::bigint as contradicted, count(*) filter (signs is null)::bigint as undocumented from p left join g using (iv_id, node) group by p.iv_id")
def documented_one_hop(s, d):
    """Immediate effects alone against documented ones."""
    arcs, iv = D.flow(s, d), D.firsts(s, d)
    measurable = D.table(s, d, "orders").where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("node"))
    return L.documented(L.one_hop(arcs, iv), _gold(s, d), iv, measurable)


@query("drug_paradoxes", f"""with recursive {ORDERS}, {SOLVED_SQL}, {HOP}, {DRUG_GOLD}, o as (select iv_id, node, min(sign) as expected from gold where not exists (select 1 from iv where iv.iv_id = gold.iv_id and iv.node = gold.node) group by iv_id, node having count(distinct sign) = 1)
select o.*, solved.mask as solved, hop.mask as one_hop, coalesce(solved.mask = expected, false) and not coalesce(hop.mask = expected, false) as resolved from o left join solved using (iv_id, node) left join hop using (iv_id, node)""")
def drug_paradoxes(s, d):
    """Documented effects of one direction beside what the solver and the immediate effects say."""
    from signflow.operators.scoring import drop_conflicts
    from signflow.operators.solve import solve

    arcs, iv = store(D.flow(s, d), "arcs"), D.firsts(s, d)
    free = _gold(s, d).join(iv.select("iv_id", "node"), ["iv_id", "node"], "left_anti").withColumnRenamed("sign", "expected")
    return L.paradoxes(drop_conflicts(free, ["iv_id", "node"], "expected"), solve(arcs, iv), arcs, iv)


# --- tables with each other -----------------------------------------------------------------


@query("outer_merge", "with a as (select 2 * c_custkey as k, c_acctbal as a from customer), b as (select s_suppkey as k, s_acctbal as b from supplier), c as (select n_nationkey::bigint as k, n_name as c from nation) select coalesce(a.k, b.k, c.k) as k, a, b, c from a full join b on a.k = b.k full join c on c.k = coalesce(a.k, b.k)")
def outer_merge(s, d):
    a = D.table(s, d, "customer").select((F.col("c_custkey") * 2).alias("k"), F.col("c_acctbal").alias("a"))
    b = D.table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("b"))
    return L.merged([a, b, D.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("c"))], "k")


@query("first_introducer", "select l_partkey as id, arg_min(l_orderkey, (l_shipdate, l_orderkey)) as owner from lineitem group by l_partkey")
def first_introducer(s, d):
    """The order that first ships each part."""
    line = D.table(s, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("owner"), "l_shipdate")
    return M.first_owner(line, "id", "owner", "l_shipdate")


@query("witness_check", "select distinct l_partkey as src, l_suppkey as dst from lineitem where l_returnflag = 'R' and (l_partkey, l_suppkey) not in (select (l_partkey, l_suppkey) from lineitem where l_returnflag = 'A')")
def witness_check(s, d):
    """Embedded records that no asserted axiom supports."""
    line = D.table(s, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), "l_returnflag")
    return L.witnesses(line.where("l_returnflag = 'R'").select("src", "dst").distinct(), line.where("l_returnflag = 'A'"), ["src", "dst"])


@query("entailed_links", f"""with recursive {TERMS}, l as (select distinct l_partkey as src, l_suppkey as dst from lineitem), w as (select src, dst from l union select l.src, up.dst from l join up on up.src = l.dst)
select src, dst from w union select up.src, w.dst from w join up on up.dst = w.src""")
def entailed_links(s, d):
    """What follows from links between parts, as kinds of each other."""
    line = D.table(s, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    return L.entailed(line, _closure(s, d))


@query("point_lookup", "select p_partkey, p_name from part where p_partkey = 61")
def point_lookup(s, d):
    return M.point(D.table(s, d, "part"), "p_partkey", 61).select("p_partkey", "p_name")


@query("ratio_pairs", "select a.l_orderkey as result, a.l_partkey as numerator, b.l_partkey as denominator from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey where a.l_returnflag = 'R' and b.l_returnflag = 'A'")
def ratio_pairs(s, d):
    role = F.when(F.col("l_returnflag") == "R", "numerator").when(F.col("l_returnflag") == "A", "denominator")
    return L.ratio_pairs(D.table(s, d, "lineitem").select(F.col("l_orderkey").alias("result"), role.alias("role"), F.col("l_partkey").alias("node")))


@query("snapshot", """with h as (select 'nation' as section, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') as h from nation union all select 'region', sha256('{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}') from region),
p as (select section, k, sum(('0x' || h[8 * k + 1:8 * k + 8])::bigint)::varchar as s from h, (select unnest(range(0, 8)) as k) group by section, k)
select section, (select count(*) from h where h.section = p.section)::bigint as n, sha256(string_agg(s, ',' order by k)) as digest from p group by section""")
def snapshot(s, d):
    return L.snapshot({"nation": D.table(s, d, "nation"), "region": D.table(s, d, "region")})


# --- maps as files -----------------------------------------------------------------------


def _map(s, d):
    """The graph of orders as the collections of a map."""
    text = lambda c: F.col(c).cast("string")
    q = D.sequence(s, d)
    none = lambda name: F.lit(None).cast("string").alias(name)
    nodes = q.select(text("node").alias("id"), F.concat(F.lit("order "), text("node")).alias("label"), F.lit("organ").alias("scale"), none("entity_iri"), none("quality_iri"), none("bearer_entity_iri"), none("bearer_kind"), none("quality_kind"), (F.col("k") == 1).alias("exogenous"))
    sign = F.when(F.col("m") == 1, "+").when(F.col("m") == 2, "-").otherwise("?")
    causal = D.flow(s, d).select(text("src").alias("source"), text("dst").alias("target"), sign.alias("sign"))
    causal = causal.select(M.influence_id(F.col("source"), F.col("sign"), F.col("target"), F.lit(None)).alias("id"), "source", "target", "sign", none("context"), none("context_label"), none("context_kind"), none("mechanism"), F.lit("as observed").alias("evidence"), none("causal_evidence"), F.lit(False).alias("definitional"))
    nxt = q.select("cust", (F.col("k") - 3).alias("k"), F.col("node").alias("far"))
    prod = q.join(nxt, ["cust", "k"]).select(text("node").alias("source"), text("far").alias("target"), F.lit("+").alias("sign"), F.lit(M.LEGACY).alias("production_evidence"), none("mechanism"), none("evidence"))
    part = q.where("k > 1").join(q.where("k = 1").select("cust", F.col("node").alias("first")), "cust")
    con = part.where("k = 2").select(text("node").alias("micro"), text("first").alias("macro"), F.lit("aggregation").alias("relation"), F.lit("+").alias("sign"))
    empty = lambda schema: s.createDataFrame([], schema.replace("node: string, role: string, derivative_sign: string", "node string, role string, derivative_sign string"))
    return {"nodes": nodes, "causal_edges": causal, "production_edges": prod, "constitutive_edges": con, "modulation_edges": empty(M.MODULATION), "quantitative_definitions": empty(M.QUANTITATIVE)}


PROD3 = "prod as (select a.node as src, b.node as dst from seq a join seq b on b.cust = a.cust and b.k = a.k + 3)"
OPERATIONAL = f"with {FLOW_SQL}, {PROD3}, g as (select src, dst, bit_or(m)::int as m from arc group by src, dst) select src::varchar as src, dst::varchar as dst, m, 'causal-influence' as kind, false as definitional from g union all select src::varchar, dst::varchar, 1, 'production-derived', false from prod where not exists (select 1 from g where g.src = prod.src and g.dst = prod.dst)"


@query("operational_arcs", OPERATIONAL)
def operational_arcs(s, d):
    return M.operational(_map(s, d))


@query("map_inventory", f"with o as ({OPERATIONAL}) select kind, count(*)::bigint as n from o group by kind union all select 'constitutive-constraint', (select count(*) from (select o_custkey from orders group by 1 having count(*) > 1)) union all select 'modulation', 0")
def map_inventory(s, d):
    return M.inventory(_map(s, d))


@query("manifest_round_trip", OPERATIONAL)
def manifest_round_trip(s, d):
    """The map written as the sections of a manifest, read back, adapted to a map, and its operational arcs."""
    m = _map(s, d)
    path = new_path(s, "manifest")
    none = F.array().cast("array<string>").alias("trace_ids")
    status = F.lit(M.LEGACY).alias("evidence_status")
    context = F.lit(None).cast("struct<id: string, label: string, kind: string, description: string>").alias("context")
    inf = m["causal_edges"].select("id", "source", "target", "sign", context, "mechanism", "evidence", "causal_evidence", status, "definitional", none)
    prod = m["production_edges"].select(F.concat_ws(">", "source", "target").alias("id"), *M.columns_of(M.PRODUCTION), status, none)
    con = m["constitutive_edges"].select(F.concat_ws(">", "micro", "macro").alias("id"), *M.columns_of(M.CONSTITUTIVE), none)
    M.write_manifest({"nodes": m["nodes"], "influences": inf, "production_relations": prod, "constitutive_constraints": con}, path)

    def back(name: str, df):
        return s.read.schema(df.schema).json(f"{path}/{name}")

    empty = s.createDataFrame([], "id string, modulator string, influence_id string, sign string, can_flip_sign boolean, mechanism string, evidence string, causal_evidence string, trace_ids array<string>"), s.createDataFrame([], "id string, kind string, result string, arguments array<struct<node string, role string, derivative_sign string>>, mechanism string, evidence string, origin string, trace_ids array<string>")
    whole = s.createDataFrame([("1.0.0", "orders", "", "1.2.0")], "schema_version string, name string, description string, projection_version string")
    got = {"manifest": whole, "nodes": back("nodes", m["nodes"]), "influences": back("influences", inf), "production_relations": back("production_relations", prod), "constitutive_constraints": back("constitutive_constraints", con), "modulation": empty[0], "quantitative_expressions": empty[1], "projection_traces": s.createDataFrame([], "trace_id string")}
    return M.operational(M.to_map(got))


@query("manifest_document", OPERATIONAL)
def manifest_document(s, d):
    """The map written as one JSON document, read as a manifest, adapted to a map, and its operational arcs."""
    m = _map(s, d)
    path = new_path(s, "manifest")
    none = F.array().cast("array<string>").alias("trace_ids")
    status = F.lit(M.LEGACY).alias("evidence_status")
    context = F.lit(None).cast("struct<id: string, label: string, kind: string, description: string>").alias("context")
    whole = s.createDataFrame([("1.0.0", "orders", "a map", "1.2.0")], "schema_version string, name string, description string, projection_version string")
    inf = m["causal_edges"].select("id", "source", "target", "sign", context, "mechanism", "evidence", "causal_evidence", status, "definitional", none)
    prod = m["production_edges"].select(F.concat_ws(">", "source", "target").alias("id"), *M.columns_of(M.PRODUCTION), status, none)
    con = m["constitutive_edges"].select(F.concat_ws(">", "micro", "macro").alias("id"), *M.columns_of(M.CONSTITUTIVE), none)
    trace = s.createDataFrame([], "trace_id string")
    M.write_manifest_document({"manifest": whole, "nodes": m["nodes"], "influences": inf, "production_relations": prod, "constitutive_constraints": con, "quantitative_expressions": trace, "modulation": trace, "projection_traces": trace}, path)
    return M.operational(M.to_map(M.read_manifest(s, path)))


#: Influences between consecutive lines of orders with all their fields, and production by suppliers.
RECORDS = """inf as (select (a.l_orderkey * 10 + a.l_linenumber)::varchar as id, a.l_partkey::varchar as src, b.l_partkey::varchar as dst, case when b.l_extendedprice >= a.l_extendedprice then 1 else 2 end as m,
    case when b.l_returnflag <> 'N' then b.l_returnflag end as context, b.l_linestatus as mechanism, 'q' || floor(a.l_quantity / 10)::int as evidence, case when a.l_discount >= 0.05 then 'perturbation' end as causal_evidence
  from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1),
g as (select src, dst, bit_or(m) as all_m, bit_or(m) filter (context is null) as base, bit_or(m) filter (context is not null) as guarded, count(distinct m) as signs, count(distinct mechanism) as n1, min(mechanism) as mechanism, count(distinct evidence) as n2, min(evidence) as evidence, count(distinct causal_evidence) as n3, min(causal_evidence) as causal_evidence,
  list(id order by id) as ids, list(context order by id, context) filter (context is not null) as contexts, list(id || (['+', '-', '?'])[m] || coalesce(context, '') || mechanism || evidence || coalesce(causal_evidence, '') order by id, m, context nulls first, mechanism, evidence, causal_evidence nulls first) as parallel from inf group by src, dst),
h as (select *, guarded is not null and not coalesce(base is not null and base <> 3 and guarded = base, false) as loose from g),
prod as (select distinct l_suppkey::varchar as src, l_partkey::varchar as dst, case when l_discount < 0.05 then 1 else 2 end as m, l_linestatus as mechanism, l_returnflag as production_evidence from lineitem)"""


@query("operational_records", f"""with {RECORDS} select src, dst, (case when loose then 3 else all_m end)::int as m, 'causal-influence' as kind, loose or signs > 1 as ambiguous, false as definitional, case when n1 = 1 then mechanism end as mechanism, case when n2 = 1 then evidence end as evidence, case when n3 = 1 then causal_evidence end as causal_evidence, null::varchar as production_evidence,
  case when len(ids) = 1 then ids[1] end as influence_id, array_to_string(ids, ',') as influence_ids, coalesce(array_to_string(contexts, ','), '') as contexts, array_to_string(parallel, ',') as parallel from h
union all select src, dst, m, 'production-derived', false, false, mechanism, null, null, production_evidence, null, null, null, null from prod where (src, dst) not in (select (src, dst) from g) qualify row_number() over (partition by src, dst order by m, mechanism, production_evidence) = 1""")
def operational_records(s, d):
    """Arcs between parts with unique mechanism, evidence and class, influence ids, contexts and all parallel records."""
    line = D.table(s, d, "lineitem")
    nxt = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").cast("string").alias("target"), F.col("l_extendedprice").alias("price2"), F.col("l_returnflag").alias("flag2"), F.col("l_linestatus").alias("mechanism"))
    none = lambda name: F.lit(None).cast("string").alias(name)
    e = line.join(nxt, ["l_orderkey", "l_linenumber"]).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("id"), F.col("l_partkey").cast("string").alias("source"), "target", F.when(F.col("price2") >= F.col("l_extendedprice"), "+").otherwise("-").alias("sign"), F.when(F.col("flag2") != "N", F.col("flag2")).alias("context"),
        none("context_label"), none("context_kind"), "mechanism", F.concat(F.lit("q"), F.floor(F.col("l_quantity") / 10).cast("string")).alias("evidence"), F.when(F.col("l_discount") >= 0.05, "perturbation").alias("causal_evidence"), F.lit(False).alias("definitional"),
    )
    p = line.select(F.col("l_suppkey").cast("string").alias("source"), F.col("l_partkey").cast("string").alias("target"), F.when(F.col("l_discount") < 0.05, "+").otherwise("-").alias("sign"), F.col("l_returnflag").alias("production_evidence"), F.col("l_linestatus").alias("mechanism"), none("evidence")).distinct()
    q = s.createDataFrame([], M.QUANTITATIVE.replace("node: string, role: string, derivative_sign: string", "node string, role string, derivative_sign string"))
    out = M.operational_records({"causal_edges": e, "production_edges": p, "quantitative_definitions": q})
    line_of = lambda x: F.concat(x.id, x.sign, F.coalesce(x.context, F.lit("")), x.mechanism, x.evidence, F.coalesce(x.causal_evidence, F.lit("")))
    text = {"influence_ids": F.array_join("influence_ids", ","), "contexts": F.array_join(F.transform("contexts", lambda x: x.id), ","), "parallel": F.array_join(F.transform("parallel", line_of), ",")}
    return out.withColumns(text).drop("quantitative_kind", "quantitative_role")


@query("ontology_round_trip", f"with {FLOW_SQL} select distinct src::varchar as source, dst::varchar as target, ([ '+', '-', '?' ])[m] as sign from arc")
def ontology_round_trip(s, d):
    """The influences embedded in an ontology's lines, each witnessed by an axiom."""
    m = _map(s, d)
    inf = m["causal_edges"].select("source", "target", "sign").distinct()
    lines = store(scans.owl(m["nodes"], {"Influence": inf}), "owl")
    back = scans.owl_records(lines, "Influence", "source string, target string, sign string")
    seen = scans.owl_axioms(lines, "Influence").select(F.col("src").alias("source"), F.col("dst").alias("target"))
    return back.join(seen.distinct(), ["source", "target"], "left_semi").select("source", "target", "sign")


@query("axiom_preview", f"""with {FLOW_SQL}, {PROD3} select 'Declaration(Class(:' || node || '))' as axiom from seq union all select 'SubClassOf(:' || src || ' influences ' || (['positively', 'negatively', 'in an open direction'])[m] || ' :' || dst || ')' from arc
union all select 'SubClassOf(:' || src || ' produces :' || dst || ')' from prod union all select 'SubClassOf(:' || b.node || ' aggregation :' || a.node || ')' from seq a join seq b on a.cust = b.cust and a.k = 1 and b.k = 2""")
def axiom_preview(s, d):
    from signflow.operators.curation import axioms

    return axioms(_map(s, d))


@query("turtle_lines", f"""with {FLOW_SQL} select '[] a <http://example.org/Influence> ; <http://example.org/source> <http://example.org/' || src || '> ; <http://example.org/target> <http://example.org/' || dst || '> ; <http://example.org/sign> "' || ([ '+', '-', '?' ])[m] || '" .' as line from arc""")
def turtle_lines(s, d):
    return scans.turtle(D.flow(s, d))


@query("cross_citations", "with w as (select distinct p_partkey % 300 as pmid from part), c as (select p_partkey as pmid from part where p_size > 20) select pmid, ((row_number() over (order by pmid) - 1) // 20)::bigint as batch from w where pmid not in (select pmid from c)")
def cross_citations(s, d):
    """Citations that a cache lacks, in batches for a fetch."""
    p = D.table(s, d, "part")
    return scans.to_fetch(p.select((F.col("p_partkey") % 300).alias("pmid")), p.where("p_size > 20").select(F.col("p_partkey").alias("pmid")), "pmid", 20)


@query("derivative_rules", """with x as (select p_partkey as id, (['ratio', 'sum', 'product', 'rate'])[p_size % 4 + 1] as kind, case when p_size % 3 = 0 then '-' else '+' end as s1, case when p_size % 5 = 0 then '+' else '-' end as s2 from part)
select id, kind, 2::bigint as rules, (case kind when 'ratio' then (s1 <> '+')::int + (s2 <> '-')::int when 'rate' then 0 else (s1 <> '+')::int + (s2 <> '+')::int end)::bigint as broken from x""")
def derivative_rules(s, d):
    from signflow.operators.numeric import derivative_rules as run

    return run(_expressions(s, d))


def _expressions(s, d):
    n = F.col("p_size")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("ratio", "sum", "product", "rate")]), (n % 4 + 1).cast("int"))
    arg = lambda node, role, sign: F.struct(F.lit(node).alias("node"), F.lit(role).alias("role"), sign.alias("derivative_sign"))
    return D.table(s, d, "part").select(F.col("p_partkey").alias("id"), kind.alias("kind"), F.array(arg("a", "numerator", F.when(n % 3 == 0, "-").otherwise("+")), arg("b", "denominator", F.when(n % 5 == 0, "+").otherwise("-"))).alias("arguments"))


@query("realised_modulations", "select l_orderkey, l_linenumber, l_partkey, 16::bigint as trials, (case l_returnflag when 'N' then 16 else 0 end)::bigint as failed from lineitem")
def realised_modulations(s, d):
    """Every line's modulation against its mixed derivative; open ones can't hold."""
    from signflow.operators.numeric import realised_modulations as run

    sign = F.when(F.col("l_returnflag") == "A", "+").when(F.col("l_returnflag") == "R", "-").otherwise("?")
    return run(D.table(s, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("id"), sign.alias("sign"))).select("id.*", "trials", "failed")


@query("realised_signs", """with x as (select p_partkey as id, (['ratio', 'sum', 'product', 'rate'])[p_size % 4 + 1] as kind, case when p_size % 3 = 0 then '-' else '+' end as s1, case when p_size % 5 = 0 then '+' else '-' end as s2 from part)
select id, kind, 16::bigint as trials, (case when kind = 'rate' or kind = 'ratio' and s1 = '+' and s2 = '-' or kind in ('sum', 'product') and s1 = '+' and s2 = '+' then 0 else 16 end)::bigint as failed from x""")
def realised_signs(s, d):
    """Declared derivative signs against finite differences of random realisations."""
    from signflow.operators.numeric import realised

    return realised(_expressions(s, d))
