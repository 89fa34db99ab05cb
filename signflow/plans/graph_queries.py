"""Queries on arcs, reach, components, levels and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signflow.functions.storage import store
from signflow.operators import arcs as A
from signflow.operators import paths as P
from signflow.operators import reach as R
from signflow.operators.distances import hop_distances, pairwise
from signflow.operators import solve as S
from signflow.sources import derived as D
from signflow.sources.derived import ALL_SQL, FIRSTS_SQL, FLOW_SQL, INFLUENCES_SQL, LINKED_SQL, LOOPS_SQL, PRODUCTION_SQL, SEEDS_SQL, SOLVED_SQL, times_sql

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


@query("arcs_combine", f"with {ALL_SQL} select * from arc")
def arcs_combine(s: SparkSession, d: str) -> DataFrame:
    return D.arcs(s, d)


GUARDED = f"""with {INFLUENCES_SQL}, g as (select src, dst, bit_or(m) as all_m, bit_or(case when context is null then m end) as base,
  bit_or(case when context is not null then m end) as guarded, count(*) as n, count(distinct m) as signs from inf group by src, dst)
select src, dst, (case when guarded is not null and not coalesce(base <> 3 and guarded = base, false) then 3 else all_m end)::int as m, n::bigint as n,
  (guarded is not null and not coalesce(base <> 3 and guarded = base, false)) or signs > 1 as ambiguous from g"""


@query("context_active_none", GUARDED)
def context_active_none(s, d):
    return A.combine(D.influences(s, d))


def _sliced(where: str) -> str:
    return f"with {INFLUENCES_SQL} select src, dst, bit_or(m)::int as m, count(*)::bigint as n, count(distinct m) > 1 as ambiguous from inf where {where} group by src, dst"


@query("context_active_selected", _sliced("context is null or context = 'R'"))
def context_active_selected(s, d):
    return A.combine(D.influences(s, d), ["R"])


@query("context_active_empty", _sliced("context is null"))
def context_active_empty(s, d):
    return A.combine(D.influences(s, d), [])


@query("contexts", f"with {INFLUENCES_SQL} select distinct context from inf where context is not null")
def contexts(s, d):
    return A.contexts(D.influences(s, d))


@query("arcs_precedence", f"""with {ALL_SQL}, {PRODUCTION_SQL}, p as (select src, dst, arg_min(m, (ord, m)) as m from prod group by src, dst)
select src, dst, m, 'causal-influence' as kind from arc union all
select src, dst, m, 'production-derived' from p where not exists (select 1 from arc where arc.src = p.src and arc.dst = p.dst)""")
def arcs_precedence(s, d):
    none = s.createDataFrame([], "src long, dst long, m int, ord long")
    return A.layered(D.arcs(s, d), D.production(s, d), none)


@query("opposing_pairs", f"with {INFLUENCES_SQL} select src, dst, count(*)::bigint as n, count(distinct m)::bigint as signs from inf group by src, dst having count(distinct m) > 1")
def opposing_pairs(s, d):
    return A.opposing_pairs(D.influences(s, d))


#: The graph of orders and one intervention per customer.
ORDERS = f"{FLOW_SQL}, {FIRSTS_SQL}"
#: One intervention per nation: the first order by number of its customers is raised.
NATIONS_SQL = "iv as (select c_nationkey as iv_id, min(o_orderkey) as node, 1 as mask from orders join customer on o_custkey = c_custkey group by c_nationkey)"


def _nations(s, d):
    c = D.table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("iv_id"))
    return D.table(s, d, "orders").join(c, "o_custkey").groupBy("iv_id").agg(F.min("o_orderkey").alias("node")).withColumn("mask", F.lit(1))


@query("context_slice", f"with {INFLUENCES_SQL} select src, dst, m, count(*)::bigint as n from inf where context is null or context = 'A' group by src, dst, m")
def context_slice(s, d):
    """The influences of one regime, with their guards discharged; modulations of the others go with them."""
    inf = D.influences(s, d).withColumn("id", F.concat_ws(">", "src", "dst", "m", "context"))
    mod = inf.select(F.col("id").alias("influence_id")).distinct()
    kept, left = A.context_slice(inf, mod, ["A"])
    return kept.join(left.withColumnRenamed("influence_id", "id"), "id", "left_semi").groupBy("src", "dst", "m").agg(F.count("*").alias("n"))


@query("do_surgery", f"""with {ALL_SQL}, {SEEDS_SQL} select iv_id, ((select count(*) from arc) - count(arc.dst))::bigint as arcs_left, ((select sum(m) from arc) - coalesce(sum(m), 0))::bigint as sum_m
from iv left join arc on arc.dst = iv.node group by iv_id""")
def do_surgery(s, d):
    """What surgery leaves of the graph, from what it cuts; the product of graphs and interventions is never made."""
    return A.surgery_sizes(D.arcs(s, d), D.seeds(s, d))


REACH = """cover as (select src, dst, unnest(case m when 1 then [0] when 2 then [1] else [0, 1] end) as flip from arc),
r(iv_id, node, minus) as (select iv_id, node, mask - 1 from iv union
  select r.iv_id, c.dst, xor(r.minus, c.flip) from r join cover c on c.src = r.node where not exists (select 1 from iv where iv.iv_id = r.iv_id and iv.node = c.dst))
select iv_id, node, bit_or(case when minus = 1 then 2 else 1 end)::int as mask from r group by iv_id, node"""
ONE = "iv as (select 'raise' as iv_id, arg_min(src, (-n, src)) as node, 1 as mask from (select src, count(*) as n from arc group by src))"


def _hub(arcs: DataFrame) -> DataFrame:
    n = arcs.groupBy("src").agg(F.count("*").alias("n"))
    return n.agg(F.min_by("src", F.struct(-F.col("n"), "src")).alias("node")).select(F.lit("raise").alias("iv_id"), "node", F.lit(1).alias("mask"))


@query("signed_reach", f"with recursive {ALL_SQL}, {ONE}, {REACH}")
def signed_reach(s, d):
    """Flagship: what moves, and which way, when the part with the most influences is raised."""
    a = store(D.arcs(s, d), "arcs")
    return R.signed_reach(a, _hub(a))


@query("signed_reach_batch", f"with recursive {ALL_SQL}, {SEEDS_SQL}, {REACH}")
def signed_reach_batch(s, d):
    return R.signed_reach(D.arcs(s, d), D.seeds(s, d))


@query("signed_reach_joined", f"with recursive {ORDERS}, {REACH}")
def signed_reach_joined(s, d):
    """Every customer's intervention on the graph of orders, by the joins that hold at any size."""
    return R.joined_reach(D.flow(s, d), D.firsts(s, d))


MULTI = "iv as (select 'both' as iv_id, min(p_partkey) as node, 1 as mask from part union all select 'both', max(p_partkey), 2 from part)"


@query("signed_reach_multi_clamp", f"with recursive {ALL_SQL}, {MULTI}, {REACH}")
def signed_reach_multi_clamp(s, d):
    p = D.table(s, d, "part").agg(F.min("p_partkey").alias("a"), F.max("p_partkey").alias("b"))
    two = p.select(F.lit("both").alias("iv_id"), F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("mask")), F.struct(F.col("b").alias("node"), F.lit(2).alias("mask")))))
    return R.signed_reach(D.arcs(s, d), two)


@query("descendants", f"with recursive {ALL_SQL}, {SEEDS_SQL}, r(iv_id, node) as (select iv_id, node from iv union select iv_id, dst from r join arc on src = node) select * from r")
def descendants(s, d):
    return R.descendants(D.arcs(s, d), D.seeds(s, d))


TIMES = "case when a.mask = 3 or arc.m = 3 then 3 when a.mask = 1 then arc.m else (case arc.m when 1 then 2 when 2 then 1 end) end"


@query("propagate_once", f"with {ALL_SQL}, a as (select p_partkey as node, case when p_size < 15 then 1 when p_size < 30 then 2 else 3 end as mask from part) select dst as node, bit_or({TIMES})::int as mask from arc join a on a.node = arc.src where arc.src <> arc.dst group by dst")
def propagate_once(s, d):
    signs = D.table(s, d, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_size") < 15, 1).when(F.col("p_size") < 30, 2).otherwise(3).cast("int").alias("mask"))
    return R.propagate_once(D.arcs(s, d), signs)


SCC = """up(a, b) as (select src, src from arc union select dst, dst from arc union select up.a, arc.dst from up join arc on arc.src = up.b),
scc as (select x.a as node, min(x.b) as scc from up x join up y on x.a = y.b and x.b = y.a group by x.a)"""


@query("scc", f"with recursive {LOOPS_SQL}, {SCC} select node, scc from scc")
def scc(s, d):
    """Components of two and more orders, where urgent ones feed back."""
    return S.components_of(D.flow(s, d, paired=False))


@query("scc_parts", f"with recursive {ALL_SQL}, {SCC} select node, scc from scc")
def scc_parts(s, d):
    return S.components_of(D.arcs(s, d))


@query("scc_joined", f"with recursive {LOOPS_SQL}, {SCC} select node, scc from scc")
def scc_joined(s, d):
    """The same by joins alone, as beyond the broadcast bound."""
    return S.components_of(D.flow(s, d, paired=False), max_arcs=0)


@query("largest_scc", f"with recursive {ALL_SQL}, {SCC} select scc, count(*)::bigint as size from scc group by scc qualify row_number() over (order by count(*) desc, scc) = 1")
def largest_scc(s, d):
    return S.components_of(D.arcs(s, d)).groupBy("scc").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "scc").limit(1)


@query("condensation_edges", f"with recursive {LOOPS_SQL}, {SCC} select distinct x.scc as src, y.scc as dst from arc join scc x on x.node = src join scc y on y.node = dst where x.scc <> y.scc")
def condensation_edges(s, d):
    a = store(D.flow(s, d, paired=False), "arcs")
    return S.condensation(a, store(S.components_of(a), "sccs"))


@query("topo_levels", f"""with recursive {LOOPS_SQL}, {SCC}, dag as (select distinct x.scc as src, y.scc as dst from arc join scc x on x.node = src join scc y on y.node = dst where x.scc <> y.scc),
l(node, level) as (select src, 0 from dag where src not in (select dst from dag) union select dag.dst, l.level + 1 from l join dag on dag.src = l.node) select node, max(level)::int as level from l group by node""")
def topo_levels(s, d):
    """Levels of the components: the longest chain that leads to each."""
    return R.levels(condensation_edges(s, d))


@query("dag_check", f"with recursive {LOOPS_SQL}, {SCC}, core as (select src, dst from arc join scc x on x.node = src join scc y on y.node = dst where x.scc = y.scc), f(n) as (select dst from core union select arc.dst from f join arc on arc.src = f.n) select distinct arc.src, arc.dst from arc where arc.src in (select n from f)")
def dag_check(s, d):
    """The arcs on or behind a cycle; none of them for an acyclic graph."""
    return R.trim(D.flow(s, d, paired=False))


@query("solve_pairs", f"with recursive {ORDERS}, {SOLVED_SQL} select * from solved")
def solve_pairs(s, d):
    """Comparative statics of every customer's intervention; components of two orders have a closed form, which the SQL uses."""
    return S.solve(D.flow(s, d), D.firsts(s, d))


@query("solve_by_cones", f"with recursive {ORDERS}, {SOLVED_SQL} select * from solved")
def solve_by_cones(s, d):
    """The same where the graph is too large to broadcast: each intervention's cone is found by joins."""
    return S.solve(D.flow(s, d), D.firsts(s, d), max_arcs=0)


@query("solve_exact")
def solve_exact(s, d):
    """Comparative statics on the graph of orders whose components have up to sixteen nodes and more: determinants, and the loop engine beyond."""
    return S.solve(D.flow(s, d, paired=False), D.firsts(s, d))


@query("solve_loop", f"with recursive {LOOPS_SQL}, {FIRSTS_SQL}, {REACH}")
def solve_loop(s, d):
    """With every component on the loop engine the answer is the signed reach."""
    return S.solve(D.flow(s, d, paired=False), D.firsts(s, d), exact_max=0)


@query("solve_by_levels", f"with recursive {ORDERS}, {SOLVED_SQL} select * from solved")
def solve_by_levels(s, d):
    """The same signs one level of components after another, by joins alone, as for cones beyond a task's bound."""
    return S.solve(D.flow(s, d), D.firsts(s, d), max_arcs=0, max_cone=0)


@query("solve_linked", f"with recursive {LINKED_SQL}, {NATIONS_SQL}, {REACH}")
def solve_linked(s, d):
    """Orders linked across customers by the parts they share: one component and cones that grow with the data, found by joins."""
    return S.solve(D.linked(s, d), _nations(s, d), exact_max=0, max_arcs=0)


@query("scc_linked")
def scc_linked(s, d):
    """Components of the linked orders, most of them one."""
    return S.components_of(D.linked(s, d))


CUSTOMER, NATION, REGION = 10**12, 2 * 10**12, 3 * 10**12
CON = f"""con as (select o_orderkey as micro, {CUSTOMER} + o_custkey as macro, case when o_totalprice >= 100000 then 1 else 2 end as m from orders
  union all select {CUSTOMER} + c_custkey, {NATION} + c_nationkey, case when c_acctbal >= 0 then 1 else 2 end from customer union all select {NATION} + n_nationkey, {REGION} + n_regionkey, 1 from nation)"""


def _constitutive(s, d):
    """Orders make up customers, customers nations, nations regions."""
    at = lambda base, c: F.lit(base).cast("long") + F.col(c)
    orders = D.table(s, d, "orders").select(F.col("o_orderkey").alias("micro"), at(CUSTOMER, "o_custkey").alias("macro"), F.when(F.col("o_totalprice") >= 100000, 1).otherwise(2).cast("int").alias("m"))
    cust = D.table(s, d, "customer").select(at(CUSTOMER, "c_custkey").alias("micro"), at(NATION, "c_nationkey").alias("macro"), F.when(F.col("c_acctbal") >= 0, 1).otherwise(2).cast("int").alias("m"))
    nat = D.table(s, d, "nation").select(at(NATION, "n_nationkey").alias("micro"), at(REGION, "n_regionkey").alias("macro"), F.lit(1).alias("m"))
    return orders.unionByName(cust).unionByName(nat)


UP = f"""c1 as (select iv_id, con.macro as node, bit_or({times_sql('solved.mask', 'con.m')})::int as mask from solved join con on con.micro = solved.node group by iv_id, con.macro),
c2 as (select iv_id, con.macro as node, bit_or({times_sql('c1.mask', 'con.m')})::int as mask from c1 join con on con.micro = c1.node group by iv_id, con.macro),
c3 as (select iv_id, con.macro as node, bit_or({times_sql('c2.mask', 'con.m')})::int as mask from c2 join con on con.micro = c2.node group by iv_id, con.macro)"""


@query("multiscale_solve", f"with recursive {ORDERS}, {SOLVED_SQL}, {CON}, {UP} select * from solved union all select * from c1 union all select * from c2 union all select * from c3")
def multiscale_solve(s, d):
    """Causal statics and determination in one walk over components: orders, customers, nations, regions."""
    return S.solve(D.flow(s, d), D.firsts(s, d), _constitutive(s, d))


@query("upward_determination", f"""with recursive {ORDERS}, {SOLVED_SQL}, {CON}, {UP}
select *, null::varchar as note from solved union all select *, 'determined' from c1 union all select *, 'determined' from c2 union all select *, 'determined' from c3""")
def upward_determination(s, d):
    """Signs of a finished causal solve carried up the scales."""
    from signflow.operators.multiscale import upward

    return upward(solve_pairs(s, d), _constitutive(s, d))


@query("constitutive_levels", f"""with recursive {CON}, l(node, level) as (select micro, 0 from con where micro not in (select macro from con) union select con.macro, level + 1 from l join con on con.micro = l.node)
select node::bigint as node, max(level)::int as level from l group by node""")
def constitutive_levels(s, d):
    return R.levels(_constitutive(s, d).select(F.col("micro").alias("src"), F.col("macro").alias("dst")))


@query("conservation", f"with {CON} select macro::bigint as whole, count(*)::bigint as parts, min(micro)::bigint as first_part, bit_or(m)::int as m from con group by macro")
def conservation(s, d):
    return _constitutive(s, d).groupBy(F.col("macro").alias("whole")).agg(F.count("*").alias("parts"), F.min("micro").alias("first_part"), F.bit_or("m").cast("int").alias("m"))


#: Breadth first, each node once: ``using key`` keeps what is found, and only new nodes go on.
BFS = """r(iv_id, node, dist) using key (iv_id, node) as (select iv_id, node, 0 from iv union
  select r.iv_id, arc.dst, min(r.dist + 1) from r join arc on arc.src = r.node left join recurring.r o on o.iv_id = r.iv_id and o.node = arc.dst where o.dist is null group by r.iv_id, arc.dst)"""


@query("shortest_distance", f"with recursive {ALL_SQL}, {SEEDS_SQL}, {BFS} select iv_id, node, dist::int as dist from r")
def shortest_distance(s, d):
    """Hops from the brands' first parts to every part, 64 sources in a long."""
    return hop_distances(D.arcs(s, d), D.seeds(s, d))


SHORTEST = f"""best(iv_id, node, path, mask) using key (iv_id, node) as (select iv_id, node, [node], mask from iv union
  select b.iv_id, arc.dst, min(list_append(b.path, arc.dst)), arg_min({times_sql('b.mask', 'arc.m')}::int, list_append(b.path, arc.dst)) from best b join arc on arc.src = b.node left join recurring.best o on o.iv_id = b.iv_id and o.node = arc.dst where o.path is null group by b.iv_id, arc.dst)"""


@query("shortest_signed_path", f"with recursive {ORDERS}, {SHORTEST} select iv_id, node, (len(path) - 1)::int as dist, array_to_string(path, '>') as path, mask::int as mask from best")
def shortest_signed_path(s, d):
    """Of the shortest paths the lexicographically first, with its running sign."""
    out = P.bfs(D.flow(s, d), D.firsts(s, d))
    return out.select("iv_id", "node", "dist", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "mask")


@query("multi_source_bfs", f"with recursive {ALL_SQL}, iv as (select 'any' as iv_id, min(p_partkey) as node from part group by p_brand), {BFS} select node, dist::int as dist from r")
def multi_source_bfs(s, d):
    """One search from all sources at once, instead of one per source."""
    one = D.seeds(s, d).select(F.lit("any").alias("iv_id"), "node", "mask").distinct()
    return P.bfs(D.arcs(s, d), one).select("node", "dist")


LAST = "last as (select cust as iv_id, arg_max(node, k) as node from seq group by cust having count(*) > 1)"
PATHS = f"""walk(iv_id, node, path, mask) as (select iv_id, node, [node], mask from iv union all
  select w.iv_id, arc.dst, list_append(w.path, arc.dst), {times_sql('w.mask', 'arc.m')} from walk w join arc on arc.src = w.node where len(w.path) <= 12 and not list_contains(w.path, arc.dst)),
found as (select walk.*, row_number() over (partition by walk.iv_id, walk.node order by path) as k from walk join last on last.iv_id = walk.iv_id and last.node = walk.node)"""


def _last(s, d):
    return D.sequence(s, d).groupBy(F.col("cust").alias("iv_id")).agg(F.max_by("node", "k").alias("node"), F.count("*").alias("n")).where("n > 1").drop("n")


@query("bounded_paths", f"with recursive {ORDERS}, {LAST}, {PATHS} select iv_id, node as target, array_to_string(path, '>') as path, mask::int as mask from found where k <= 24")
def bounded_paths(s, d):
    """From each customer's first order to the last one: the first 24 simple paths of at most 12 arcs."""
    out = P.simple_paths(D.flow(s, d), D.firsts(s, d), _last(s, d))
    return out.select("iv_id", "target", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "mask")


@query("path_consensus", f"with recursive {ORDERS}, {LAST}, {PATHS} select iv_id, node as target, count(*)::bigint as paths, bit_or(mask)::int as mask from found where k <= 24 group by iv_id, node")
def path_consensus(s, d):
    """The sign that those paths have in common, undetermined where they differ."""
    return P.simple_paths(D.flow(s, d), D.firsts(s, d), _last(s, d)).groupBy("iv_id", "target").agg(F.count("*").alias("paths"), F.bit_or("mask").cast("int").alias("mask"))


@query("traces", f"""with recursive {ORDERS}, {SOLVED_SQL}, {LAST}, {PATHS}
select f.iv_id, f.node, string_agg(array_to_string(path, ' > ') || ' (' || case f.mask when 1 then '+' when 2 then '-' else '?' end || ')', '; ' order by len(path), path) as paths, bit_or(f.mask)::int as consensus,
  coalesce(any_value(solved.mask), 0)::int as net, bit_or(f.mask) = coalesce(any_value(solved.mask), 0) as agrees
from found f left join solved on solved.iv_id = f.iv_id and solved.node = f.node where k <= 24 group by f.iv_id, f.node""")
def traces(s, d):
    from signflow.operators.traces import traces as run

    return run(D.flow(s, d), D.firsts(s, d), _last(s, d)).withColumn("paths", F.array_join("paths", "; "))


@query("khop", f"with recursive {ALL_SQL}, {SEEDS_SQL}, und as (select src as a, dst as b from arc union select dst, src from arc), r(iv_id, node, k) as (select iv_id, node, 0 from iv union select iv_id, b, k + 1 from r join und on a = node where k < 2) select distinct iv_id, node from r")
def khop(s, d):
    return P.neighbourhood(D.arcs(s, d), D.seeds(s, d), hops=2)


@query("label_propagation", f"""with recursive {ALL_SQL}, {SEEDS_SQL}, und as (select src as a, dst as b from arc union select dst, src from arc),
r(node, label, dist) using key (node) as (select node, min(iv_id), 0 from iv group by node union
  select und.b, min(r.label), min(r.dist) + 1 from r join und on und.a = r.node left join recurring.r o on o.node = und.b where o.dist is null group by und.b)
select p_partkey as node, coalesce(label, 'none') as label from part left join r on r.node = p_partkey""")
def label_propagation(s, d):
    """Each node takes the label of the nearest seed, of equally near ones the first; what none reaches has a default."""
    nodes = D.table(s, d, "part").select(F.col("p_partkey").alias("node"))
    return P.labelled(nodes, D.arcs(s, d), D.seeds(s, d).select("node", F.col("iv_id").alias("label")), "none")


@query("pairwise_distance", f"""with recursive {ALL_SQL}, iv as (select min(p_partkey) as iv_id, min(p_partkey) as node from part group by p_brand), und as (select src, dst from arc union select dst, src from arc),
{BFS.replace('join arc on arc.src', 'join und arc on arc.src')} select iv_id as a, node as b, dist::int as dist from r where iv_id < node and node in (select node from iv)""")
def pairwise_distance(s, d):
    """Undirected distances between the brands' first parts."""
    return pairwise(D.arcs(s, d), D.seeds(s, d).select("node").distinct())


@query("ancestor_closure", f"""with recursive {CON}, r(src, dst, dist) as (select micro, macro, 1 from con union select r.src, con.macro, dist + 1 from r join con on con.micro = r.dst)
select src::bigint as src, dst::bigint as dst, min(dist)::int as dist from r group by src, dst""")
def ancestor_closure(s, d):
    return R.closure(_constitutive(s, d).select(F.col("micro").alias("src"), F.col("macro").alias("dst")))


@query("acyclify", f"""with recursive {LOOPS_SQL}, {SCC}
select distinct arc.src, y.node as dst from arc join scc x on x.node = arc.src join scc z on z.node = arc.dst join scc y on y.scc = z.scc where x.scc <> z.scc""")
def acyclify(s, d):
    """Arcs from outside a component reach each of its nodes, and the arcs inside it go."""
    a = store(D.flow(s, d, paired=False), "arcs")
    return P.acyclify(a, store(S.components_of(a), "sccs"))


@query("latent_causes", f"with recursive {LOOPS_SQL}, {SCC} select 'latent:' || scc as src, node::varchar as dst from scc where scc in (select scc from scc group by scc having count(*) > 1)")
def latent_causes(s, d):
    return P.latent_causes(store(S.components_of(D.flow(s, d, paired=False)), "sccs"))


@query("moral_edges", f"""with recursive {LOOPS_SQL}, {SCC}, dag as (select distinct arc.src, y.node as dst from arc join scc x on x.node = arc.src join scc z on z.node = arc.dst join scc y on y.scc = z.scc where x.scc <> z.scc)
select distinct least(a, b) as a, greatest(a, b) as b from (select src as a, dst as b from dag union all select x.src, y.src from dag x join dag y on x.dst = y.dst and x.src < y.src)""")
def moral_edges(s, d):
    return P.moralise(store(acyclify(s, d), "dag"))


DET = """def as (select a.node as src, b.node as dst, a.status = b.status as definitional from seq a join seq b on b.cust = a.cust and b.k = a.k + 1
  union all select a.node, b.node, true from seq a join seq b on b.cust = a.cust and b.k = a.k + 2 where a.status = b.status)"""


def _definitions(s, d):
    """An order is defined by those before it where all have its status."""
    q = D.sequence(s, d).select("cust", "k", "node", "status")
    nxt = q.select("cust", F.col("k").alias("k2"), F.col("node").alias("dst"), F.col("status").alias("status2"))
    j = q.join(nxt, "cust").where("k2 = k + 1 or k2 = k + 2 and status = status2")
    return P.definitions(j.select(F.col("node").alias("src"), "dst", (F.col("status") == F.col("status2")).alias("definitional")))


@query("definitional_nodes", f"with {D.SEQUENCE_SQL}, {DET} select dst as node, count(*)::bigint as parents from def group by dst having bool_and(definitional)")
def definitional_nodes(s, d):
    return P.definitional(_definitions(s, d))


DET_ROUND = """n{k} as (select node from n{j} union select o.node from own o where not exists (select 1 from def where def.dst = o.node and def.src not in (select node from n{j})))"""


@query("det_closure", f"with {D.SEQUENCE_SQL}, {DET}, own as (select dst as node from def group by dst having bool_and(definitional)), n0 as (select node from seq where k = 1), " + ", ".join(DET_ROUND.format(k=k, j=k - 1) for k in range(1, 41)) + " select node from n40")
def det_closure(s, d):
    """First orders, and every order all of whose definition is determined; no customer of the checked tables has more than forty."""
    return P.determined(_definitions(s, d), D.sequence(s, d).where("k = 1").select("node"))


@query("rwr", f"""with recursive {ORDERS}, w as (select src, dst, 0.85 * (case m when 1 then 1.0 else -1.0 end) / count(*) over (partition by src) as w from arc where m <> 3 and src <> dst and dst not in (select node from iv)),
cone(iv_id, node) as (select iv_id, node from iv union select cone.iv_id, arc.dst from cone join arc on arc.src = cone.node where arc.dst not in (select node from iv)),
walk(iv_id, node, r, k) as (select iv_id, node, 0.15::double * case mask when 2 then -1.0::double else 1.0::double end, 0 from iv union all
  select walk.iv_id, w.dst, sum(walk.r * w.w)::double, any_value(walk.k) + 1 from walk join w on w.src = walk.node where k < 171 group by walk.iv_id, w.dst)
select cone.iv_id, cone.node, round(coalesce(sum(r), 0), 9) + 0.0 as score from cone left join walk on walk.iv_id = cone.iv_id and walk.node = cone.node group by cone.iv_id, cone.node""")
def rwr(s, d):
    """Signed random walk with restart, from every customer's intervention, until what is left is below 1e-12."""
    from signflow.operators.numeric import random_walk

    return random_walk(D.flow(s, d), D.firsts(s, d), alpha=0.85)


@query("alpha_sweep", f"""with recursive {ORDERS}, al(alpha) as (values (2.0::double / 3), (5.0::double / 7), (0.85::double)),
w as (select src, dst, (case m when 1 then 1.0 else -1.0 end)::double / count(*) over (partition by src) as w from arc where m <> 3 and src <> dst and dst not in (select node from iv)),
cone(iv_id, node) as (select iv_id, node from iv union select cone.iv_id, arc.dst from cone join arc on arc.src = cone.node where arc.dst not in (select node from iv)),
walk(alpha, iv_id, node, r, k) as (select alpha, iv_id, node, (1 - alpha) * case mask when 2 then -1.0::double else 1.0::double end, 0 from iv, al union all
  select walk.alpha, walk.iv_id, w.dst, sum(walk.r * walk.alpha * w.w)::double, any_value(walk.k) + 1 from walk join w on w.src = walk.node where k < 171 group by walk.alpha, walk.iv_id, w.dst)
select al.alpha, cone.iv_id, cone.node, round(coalesce(sum(r), 0), 9) + 0.0 as score from al cross join cone left join walk on walk.alpha = al.alpha and walk.iv_id = cone.iv_id and walk.node = cone.node group by al.alpha, cone.iv_id, cone.node""")
def alpha_sweep(s, d):
    """The walk at three restart shares."""
    from signflow.operators.numeric import alpha_sweep as run

    return run(store(D.flow(s, d), "arcs"), D.firsts(s, d), [2 / 3, 5 / 7, 0.85])


SEP_XYZ = """x as (select cust as q, node from seq where k = 1), y as (select cust as q, arg_max(node, k) as node from seq group by cust), z as (select s.cust as q, s.node from seq s where s.k = 3 and exists (select 1 from seq t where t.cust = s.cust and t.k = 4))"""


@query("sigma_separation", f"""with recursive {LOOPS_SQL}, {SCC}, {SEP_XYZ}, anc(q, node) as (select * from x union select * from y union select * from z union select q, src from anc join arc on dst = node),
comp as (select node, scc from scc union select node, node from seq where node not in (select node from scc)),
fam as (select node, scc as family from comp union select arc.src, comp.scc from arc join comp on comp.node = arc.dst), own as (select distinct q, scc as family from anc join comp using (node)),
walk as (select anc.q, anc.node, fam.family from anc join fam using (node) join own on own.q = anc.q and own.family = fam.family where not exists (select 1 from z where z.q = anc.q and z.node = anc.node)),
o(q, node) as (select q, node from x union select o.q, w2.node from o join walk w1 on w1.q = o.q and w1.node = o.node join walk w2 on w2.q = w1.q and w2.family = w1.family)
select x.q, not exists (select 1 from o join y on y.q = o.q and y.node = o.node where o.q = x.q) as separated from x""")
def sigma_separation(s, d):
    """Per customer: the first and the last order, given the third, over the graph with loops."""
    from signflow.operators.separation import separated

    a = store(D.flow(s, d, paired=False), "arcs")
    q = store(D.sequence(s, d).select(F.col("cust").alias("q"), "k", "node"), "sequence")
    x, y = q.where("k = 1").select("q", "node"), q.groupBy("q").agg(F.max_by("node", "k").alias("node"))
    z = q.where("k = 3").join(q.where("k = 4").select("q"), "q", "left_semi").select("q", "node")
    comp = S.components_of(a)
    comp = store(comp.unionByName(q.select("node").join(comp, "node", "left_anti").select("node", F.col("node").alias("scc"))), "sccs")
    return separated(a, comp, x, y, z)


@query("asp_cautious")
def asp_cautious(s, d):
    """What all consistent signs agree on, on the graph of orders with loops."""
    from signflow.operators.consistency import consistent

    return consistent(D.flow(s, d, paired=False), D.firsts(s, d))


@query("asp_parts")
def asp_parts(s, d):
    """The same on the graph of parts, almost all of it one component."""
    from signflow.operators.consistency import consistent

    return consistent(D.arcs(s, d), D.seeds(s, d))


@query("abduction")
def abduction(s, d):
    """What observing the sixth order of each customer settles."""
    from signflow.operators.consistency import abduction as run

    seen = D.sequence(s, d).where("k = 6").select(F.col("cust").alias("iv_id"), "node", F.when(F.col("price") >= 100000, 1).otherwise(2).cast("int").alias("mask"))
    return run(D.flow(s, d, paired=False), D.firsts(s, d), seen)


@query("sign_permutation_null")
def sign_permutation_null(s, d):
    from signflow.operators.nulls import permute_signs

    return permute_signs(D.arcs(s, d), 7)


@query("rewired_null")
def rewired_null(s, d):
    from signflow.operators.nulls import rewired

    return rewired(D.arcs(s, d), 2, rounds=4)


@query("rewired_guarded")
def rewired_guarded(s, d):
    """Rewiring confined to orders, that keeps causation and determination free of cycles across scales."""
    from signflow.operators.nulls import rewired

    return rewired(D.flow(s, d), 1, rounds=2, acyclic=_constitutive(s, d))


@query("numeric_validate")
def numeric_validate(s, d):
    """Every customer's solved signs against 64 sampled stable systems of the customer's orders."""
    from signflow.operators.numeric import sampled_signs, validate

    arcs, iv = store(D.flow(s, d), "arcs"), D.firsts(s, d)
    solved = S.solve(arcs, iv).join(iv.select("iv_id", "node"), ["iv_id", "node"], "left_anti")
    return validate(solved, sampled_signs(arcs, iv, draws=64, parts=1))


@query("induced_subgraph", f"with {ALL_SQL} select src, dst, m from arc where src in (select p_partkey from part where p_size > 25) and dst in (select p_partkey from part where p_size > 25)")
def induced_subgraph(s, d):
    from signflow.operators.traces import induced

    return induced(D.arcs(s, d), D.table(s, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("node")))


@query("faceted_nodes", f"""with {INFLUENCES_SQL}, seen as (select p_partkey as node from part where p_brand in ('Brand#1', 'Brand#2') and p_type in ('SMALL', 'LARGE')), live as (select src, dst from inf where context = 'R')
select node from seen union select dst from live where src in (select node from seen) union select src from live where dst in (select node from seen)""")
def faceted_nodes(s, d):
    from signflow.operators.traces import faceted

    nodes = D.table(s, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("system"), F.col("p_type").alias("source"))
    arcs = D.influences(s, d).select("src", "dst", F.when(F.col("context") == "R", "SMALL").otherwise("none").alias("source"))
    return faceted(nodes, arcs, ["Brand#1", "Brand#2"], ["SMALL", "LARGE"])


@query("combined_graph", f"""with {FLOW_SQL}, {CON} select src::bigint as src, dst::bigint as dst, m::int as m, 'causal' as kind from arc where not exists (select 1 from con where micro = src and macro = dst)
union all select micro::bigint, macro::bigint, m::int, 'constitutive' from con""")
def combined_graph(s, d):
    from signflow.operators.traces import combined

    return combined(D.flow(s, d), _constitutive(s, d))


@query("layer_toggles", f"""with {ALL_SQL}, {PRODUCTION_SQL}, p as (select distinct src, dst from prod where not exists (select 1 from arc where arc.src = prod.src and arc.dst = prod.dst))
select 'causal' as layers, (select count(*) from arc)::bigint as arcs union all select 'causal+production', ((select count(*) from arc) + (select count(*) from p))::bigint""")
def layer_toggles(s, d):
    """How many operational arcs there are without and with the production layer."""
    arcs, prod = store(D.arcs(s, d), "arcs"), D.production(s, d)
    none = prod.limit(0)
    one = A.layered(arcs, none, none).agg(F.count("*").alias("arcs")).select(F.lit("causal").alias("layers"), "arcs")
    two = A.layered(arcs, prod, none).agg(F.count("*").alias("arcs")).select(F.lit("causal+production").alias("layers"), "arcs")
    return one.unionByName(two)
