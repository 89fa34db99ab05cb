"""Queries on scoring, ranking, knockouts and second-order effects, over solved signs of the graph of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from signflow.functions.storage import store
from signflow.functions.text import harmonic_chance
from signflow.operators import alignment as L
from signflow.operators import knockout as K
from signflow.operators import paths as P
from signflow.operators import reach as R
from signflow.operators import scoring as S
from signflow.operators import second_order as O
from signflow.operators.solve import solve
from signflow.plans.graph_queries import CON, ORDERS, REACH, SHORTEST, _constitutive
from signflow.sources import derived as D
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


SOLVED = f"with recursive {ORDERS}, {SOLVED_SQL}"
#: What lines of orders say of them: an observation per line, of the order's customer.
OBS = "obs as (select o_custkey as grp, o_orderkey as node, case when l_discount >= 0.05 then 1 else 2 end as expected from lineitem join orders on l_orderkey = o_orderkey)"
OBS1 = OBS + ", obs1 as (select grp, node, min(expected)::int as expected from obs group by grp, node having count(distinct expected) = 1)"
#: The same without the clamped orders, which no prediction is about.
FREE = OBS1 + ", free as (select * from obs1 where not exists (select 1 from iv where iv.iv_id = grp and iv.node = obs1.node))"


def _obs(s, d):
    line = D.table(s, d, "lineitem").select("l_orderkey", F.when(F.col("l_discount") >= 0.05, 1).otherwise(2).cast("int").alias("expected"))
    orders = D.table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("grp"))
    return line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("grp", F.col("o_orderkey").alias("node"), "expected")


def _obs1(s, d):
    return S.drop_conflicts(_obs(s, d), ["grp", "node"], "expected")


def _solved(s, d):
    return store(solve(D.flow(s, d), D.firsts(s, d)), "solved")


def _free(s, d):
    return L.excluded(_obs1(s, d), D.firsts(s, d).select(F.col("iv_id").alias("grp"), "node"), ["grp", "node"])


def _pred(s, d):
    return _solved(s, d).withColumnRenamed("iv_id", "grp")


@query("conflict_drop", f"with {OBS1} select grp, node, expected from obs1")
def conflict_drop(s, d):
    return _obs1(s, d)


@query("direction_variable", f"with {OBS} select grp, node, count(distinct expected)::bigint as signs from obs group by grp, node having count(distinct expected) > 1")
def direction_variable(s, d):
    return S.direction_variable(_obs(s, d), ["grp", "node"], "expected")


@query("affected_soundness", f"""{SOLVED}, {OBS}, v as (select grp, node from obs group by grp, node having count(distinct expected) > 1)
select count(*)::bigint as variable, count(*) filter (mask is not null)::bigint as reached, count(*) filter (mask = 3)::bigint as undetermined from v left join solved on solved.iv_id = grp and solved.node = v.node""")
def affected_soundness(s, d):
    """Of what is observed both ways: how much is reached, and how much of that left open, as it should be."""
    v = S.direction_variable(_obs(s, d), ["grp", "node"], "expected").join(_pred(s, d), ["grp", "node"], "left")
    return v.agg(F.count("*").alias("variable"), F.count("mask").alias("reached"), F.count_if(F.col("mask") == 3).alias("undetermined"))


@query("excluded_keys", f"with recursive {ORDERS}, {FREE} select * from free")
def excluded_keys(s, d):
    return _free(s, d)


STATUS = "case when mask is null then 'missing' when mask = 3 then 'ambiguous' when mask = expected then 'correct' else 'wrong' end"
SCORED = f"{SOLVED}, {FREE}, scored as (select grp, free.node, expected, mask::int as mask, {STATUS} as status from free left join solved on solved.iv_id = grp and solved.node = free.node)"


@query("forward_score", f"{SCORED} select * from scored")
def forward_score(s, d):
    """Observations against the solved signs of each customer's intervention."""
    return S.score(_free(s, d), _pred(s, d), ["grp", "node"])


COUNTS = "count(*) filter (status = 'correct')::bigint as correct, count(*) filter (status = 'wrong')::bigint as wrong, count(*) filter (status = 'ambiguous')::bigint as ambiguous, count(*) filter (status = 'missing')::bigint as missing"
SHARES = "case when correct + wrong > 0 then correct / (correct + wrong) end as precision, (correct + wrong) / n as coverage, correct / n as accuracy"


@query("benchmark_rollup", f"""{SCORED}, c as (select scored.*, k % 2 = 0 as critical from scored join seq on seq.node = scored.node),
n as (select grp, {COUNTS}, count(*) as n, count(*) filter (critical)::bigint as critical, count(*) filter (critical and status = 'correct')::bigint as critical_correct from c group by rollup (grp))
select grp, correct, wrong, ambiguous, missing, {SHARES}, critical, critical_correct from n""")
def benchmark_rollup(s, d):
    """Per customer and over all; orders that feed back are the loop-critical ones."""
    q = D.sequence(s, d).select("node", (F.col("k") % 2 == 0).alias("critical"))
    return S.roll_up(forward_score(s, d).join(q, "node"), "grp", "critical")


@query("forward_eval", f"{SCORED}, n as (select {COUNTS}, count(*) as n from scored) select correct, wrong, ambiguous + missing as abstain, correct + wrong as determinate, case when correct + wrong > 0 then correct / (correct + wrong) end as accuracy from n")
def forward_eval(s, d):
    n = S.roll_up(forward_score(s, d), "grp").where("grp is null")
    return n.select("correct", "wrong", (F.col("ambiguous") + F.col("missing")).alias("abstain"), (F.col("correct") + F.col("wrong")).alias("determinate"), F.col("precision").alias("accuracy"))


@query("soundness_gate", f"""{SCORED} select 'soundness' as gate, 'error' as level, grp || ':' || node as subject, 'predicted the wrong way' as message from scored where status = 'wrong'
union all select 'soundness', 'error', (10 * p_partkey)::varchar, 'node ' || 10 * p_partkey || ' is unknown' from part where 10 * p_partkey not in (select o_orderkey from orders)""")
def soundness_gate(s, d):
    """Contradicted predictions, and nodes of an index (here: tens of parts' numbers) that the map lacks."""
    from signflow.operators.curation import soundness_gate as run

    nodes = D.table(s, d, "orders").select(F.col("o_orderkey").alias("id"))
    return run(_pred(s, d), _free(s, d), nodes, D.table(s, d, "part").select((F.col("p_partkey") * 10).alias("node")))


@query("novel_hits", f"{SOLVED}, {OBS} select iv_id as grp, solved.node, mask from solved where mask in (1, 2) and not exists (select 1 from obs where grp = iv_id and obs.node = solved.node) and not exists (select 1 from iv where iv.iv_id = solved.iv_id and iv.node = solved.node)")
def novel_hits(s, d):
    return L.excluded(S.novel(_pred(s, d), _obs(s, d), ["grp", "node"]), D.firsts(s, d).select(F.col("iv_id").alias("grp"), "node"), ["grp", "node"])


# --- diagnosis ----------------------------------------------------------------------

#: Candidates: each customer's first three orders, raised or lowered.
POOL = "pool as (select node || case mask when 1 then '+' else '-' end as iv_id, node, mask from seq, (values (1), (2)) v(mask) where k <= 3)"
BACK = f"with recursive {FLOW_SQL}, {POOL}, iv as (select * from pool), {SOLVED_SQL}, {OBS1}"
JUDGED = f"""{BACK}, j as (select grp, iv_id as candidate, count(*) filter (mask = expected)::bigint as agree, count(*) filter (mask <> expected)::bigint as disagree from obs1 join solved using (node) where mask in (1, 2) group by grp, iv_id),
of_grp as (select grp, count(*) as n from obs1 group by grp), silent as (select grp, (select count(*) from pool) - coalesce(met, 0) as candidates from of_grp left join (select grp, count(*) as met from j group by grp) using (grp)),
every as (select *, 1 as candidates from j union all select grp, null, 0, 0, candidates from silent where candidates > 0),
ranked as (select grp, candidate, agree::bigint as agree, disagree::bigint as disagree, (n - agree - disagree)::bigint as ambiguous, candidates::bigint as candidates,
  (1 + coalesce((select sum(candidates) from every b where b.grp = a.grp and (b.agree - b.disagree, -b.disagree, b.agree) > (a.agree - a.disagree, -a.disagree, a.agree)), 0))::bigint as rank,
  sum(candidates) over (partition by grp, agree, disagree) = 1 as "unique" from every a join of_grp using (grp))"""


def _pool(s, d):
    q = D.sequence(s, d).where("k <= 3").select("node", F.explode(F.array(F.lit(1), F.lit(2))).alias("mask"))
    return q.select(F.concat(F.col("node").cast("string"), F.when(F.col("mask") == 1, "+").otherwise("-")).alias("iv_id"), "node", "mask")


def _judged(s, d):
    """Every candidate is solved once, whatever the number of groups it is held against."""
    return store(solve(D.flow(s, d), _pool(s, d)), "candidates").withColumnRenamed("iv_id", "candidate")


@query("rank_explanations", f"{JUDGED} select * from ranked")
def rank_explanations(s, d):
    """The whole pool ranked for each customer; candidates that decide none of the customer's orders are one row."""
    return S.rank_explanations(_judged(s, d), _obs1(s, d), _pool(s, d).select(F.col("iv_id").alias("candidate")), "grp", "candidate")


@query("rank_unique_top1", f'{JUDGED} select grp, candidate from ranked where rank = 1 and "unique"')
def rank_unique_top1(s, d):
    return rank_explanations(s, d).where(F.col("rank") == 1).where("unique").select("grp", "candidate")


TRUE = f"""{JUDGED}, truth as (select cust as grp, node || case when c_acctbal >= 0 then '+' else '-' end as candidate from seq join customer on c_custkey = cust where k = 1 and cust in (select grp from obs1)),
own as (select grp, candidate, coalesce(agree, 0) as agree, coalesce(disagree, 0) as disagree from truth left join j using (grp, candidate)),
pairs2 as (select own.*, j.candidate as other, (j.agree - j.disagree, -j.disagree, j.agree) > (own.agree - own.disagree, -own.disagree, own.agree) as better, (j.agree, j.disagree) = (own.agree, own.disagree) as equal from own left join j on j.grp = own.grp and j.candidate <> own.candidate),
met as (select grp, candidate, agree, disagree, count(*) filter (better and other is not null) as better, count(*) filter (equal and other is not null) as equal, count(other) as met from pairs2 group by all),
placed as (select grp, candidate, agree, disagree, better + case when (0, 0, 0) > (agree - disagree, -disagree, agree) then (select count(*) from pool) - 1 - met else 0 end as better, equal + case when agree = 0 and disagree = 0 then (select count(*) from pool) - 1 - met else 0 end as equal from met),
ranks as (select grp, candidate, agree::bigint as agree, disagree::bigint as disagree, (better + 1)::bigint as rank, better = 0 and equal = 0 as "unique" from placed)"""


def _ranks(s, d):
    c = D.table(s, d, "customer").select(F.col("c_custkey").alias("cust"), F.when(F.col("c_acctbal") >= 0, "+").otherwise("-").alias("sign"))
    truth = D.sequence(s, d).where("k = 1").join(c, "cust").select(F.col("cust").alias("grp"), F.concat(F.col("node").cast("string"), "sign").alias("candidate"))
    pool = _pool(s, d).select(F.col("iv_id").alias("candidate"))
    return S.rank_true(_judged(s, d), _obs1(s, d), truth, pool, "grp", "candidate")


@query("backward_eval", f"{TRUE} select * from ranks")
def backward_eval(s, d):
    """The rank of each customer's true intervention among all candidates."""
    return _ranks(s, d)


@query("mrr_topk", f"""{TRUE} select count(*)::bigint as n, round(avg(1 / rank), 9) as mrr, quantile_cont(rank, 0.5)::double as median_rank,
count(*) filter (rank = 1 and "unique")::bigint as top1, count(*) filter (rank <= 3)::bigint as top3, count(*) filter (rank <= 10)::bigint as top10 from ranks""")
def mrr_topk(s, d):
    return S.rank_metrics(_ranks(s, d)).withColumn("mrr", F.round("mrr", 9))


@query("chance_expectation", "select n_nationkey::int as n, round(list_sum(list_transform(range(1, n_nationkey + 2), lambda k: 1.0 / k)) / (n_nationkey + 1), 12) as chance from nation")
def chance_expectation(s, d):
    return D.table(s, d, "nation").select(F.col("n_nationkey").alias("n"), F.round(harmonic_chance(F.col("n_nationkey") + 1), 12).alias("chance"))


# --- methods against each other -------------------------------------------------------

HOP = f"""hop as (select iv_id, arc.dst as node, bit_or({times_sql('iv.mask', 'arc.m')})::int as mask from iv join arc on arc.src = iv.node where not exists (select 1 from iv i2 where i2.iv_id = iv.iv_id and i2.node = arc.dst) group by iv_id, arc.dst)"""
PAIRED = f"""{SOLVED}, {SHORTEST}, {HOP}, {FREE}, paired as (select grp, free.node, expected, solved.mask as solver, best.mask as shortest, hop.mask as one_hop from free
left join solved on solved.iv_id = grp and solved.node = free.node left join best on best.iv_id = grp and best.node = free.node left join hop on hop.iv_id = grp and hop.node = free.node)"""


def _paired(s, d):
    arcs, iv = store(D.flow(s, d), "arcs"), D.firsts(s, d)
    name = lambda df: df.select(F.col("iv_id").alias("grp"), "node", "mask")
    return store(S.paired({"solver": name(solve(arcs, iv)), "shortest": name(P.bfs(arcs, iv)), "one_hop": name(L.one_hop(arcs, iv))}, _free(s, d), ["grp", "node"]), "paired")


def _method(m: str) -> str:
    return f"select '{m}' as method, count(*) filter ({m} in (1, 2) and {m} = expected)::bigint as correct, count(*) filter ({m} in (1, 2) and {m} <> expected)::bigint as wrong, count(*) filter (coalesce({m}, 3) = 3)::bigint as abstain from paired"


@query("paired_baselines", f"{PAIRED}, m as ({' union all '.join(map(_method, ('solver', 'shortest', 'one_hop')))}) select *, case when correct + wrong > 0 then correct / (correct + wrong) end as precision from m")
def paired_baselines(s, d):
    """The solver, the shortest path's sign and the direct effect, over the same observations."""
    return S.method_scores(_paired(s, d), ["solver", "shortest", "one_hop"])


@query("feedback_contrast", f"""{PAIRED} select count(*) filter (solver in (1, 2) and shortest in (1, 2) and solver <> shortest)::bigint as differ,
count(*) filter (solver in (1, 2) and shortest in (1, 2) and solver <> shortest and solver = expected)::bigint as solver_right, count(*) filter (solver in (1, 2) and shortest in (1, 2) and solver <> shortest and shortest = expected)::bigint as naive_right,
count(*) filter (coalesce(solver, 3) = 3 and shortest in (1, 2))::bigint as feedback, count(*) filter (coalesce(solver, 3) = 3 and shortest in (1, 2) and shortest = expected)::bigint as feedback_right from paired""")
def feedback_contrast(s, d):
    return S.contrasts(_paired(s, d), "solver", "shortest")


@query("one_hop", f"with recursive {ORDERS}, {HOP} select * from hop")
def one_hop(s, d):
    return L.one_hop(D.flow(s, d), D.firsts(s, d))


@query("engine_comparison", f"""{SOLVED}, loops as (select iv_id, node, mask from ({{reach}})) , a as (select * from solved where mask in (1, 2)), b as (select * from loops where mask in (1, 2))
select count(*) filter (b.mask is null)::bigint as lost, count(*) filter (a.mask is null)::bigint as gained, count(*) filter (a.mask <> b.mask)::bigint as flipped, count(*) filter (a.mask = b.mask)::bigint as same from a full join b using (iv_id, node)""".format(reach="with recursive " + REACH.replace("cover as", "cover as", 1)))
def engine_comparison(s, d):
    """What the loop engine loses of what determinants decide in components of two; nothing may flip."""
    return S.prediction_diff(_solved(s, d), R.signed_reach(D.flow(s, d), D.firsts(s, d)), ["iv_id", "node"])


@query("consistency_comparison")
def consistency_comparison(s, d):
    """Sign consistency against determinants on the graph with loops; nothing may flip."""
    from signflow.operators.consistency import consistent

    arcs, iv = store(D.flow(s, d, paired=False), "arcs"), D.firsts(s, d)
    return S.prediction_diff(solve(arcs, iv), consistent(arcs, iv), ["iv_id", "node"])


#: The same feedback as in the graph with loops joins the components of two: surroundings that share all nodes.
WITHIN = FLOW_SQL.replace("arc as (", "alone as (", 1) + f""", arc as (select src, dst, bit_or(m)::int as m from (select * from alone union all
  select b.node, a.node, case b.status when 'F' then 2 when 'O' then 1 else 3 end from seq a join seq b on a.cust = b.cust and b.k = a.k + 1 where b.priority in ('1-URGENT', '2-HIGH')) group by src, dst)"""


@query("subsystem_comparison", f"""with recursive {WITHIN}, {D.FIRSTS_SQL}, {SOLVED_SQL}, {FREE}, within as (with recursive {REACH}),
j as (select k % 2 = 0 as critical, expected, solved.mask as a, within.mask as b from free join seq on seq.node = free.node left join solved on solved.iv_id = grp and solved.node = free.node left join within on within.iv_id = grp and within.node = free.node
  where free.node in (select src from alone union select dst from alone)),
g as (select 'all' as "group", * from j union all select 'critical', * from j where critical)
select "group", count(*)::bigint as total, count(*) filter (a in (1, 2))::bigint as fragment_determinate, count(*) filter (a in (1, 2) and a = expected)::bigint as fragment_correct, count(*) filter (b in (1, 2))::bigint as composed_determinate, count(*) filter (b in (1, 2) and b = expected)::bigint as composed_correct from g group by "group" """)
def subsystem_comparison(s, d):
    """The graph of orders by itself, its components exact, and within the graph with more feedback, on the loop engine."""
    from signflow.operators.ablation import subsystem_comparison as run

    critical = D.sequence(s, d).select("node", (F.col("k") % 2 == 0).alias("critical"))
    observed = _free(s, d).withColumnRenamed("grp", "iv_id").join(critical, "node")
    return run(D.flow(s, d), D.flow(s, d, paired=False), D.firsts(s, d), observed, composed_exact_max=0)


#: Three layers over customers' orders, all of them forward: influences unless the next order is pending, production two orders on, quantities one order on.
LAYERS = f"""{D.SEQUENCE_SQL}, step as (select a.node as src, b.node as dst, b.k - a.k as far, b.status as status, case when b.price >= a.price then 1 else 2 end as m, b.priority as priority from seq a join seq b on a.cust = b.cust and b.k - a.k in (1, 2)),
causal as (select src, dst, m from step where far = 1 and status <> 'P' or far = 2 and priority = '5-LOW'),
made as (select src, dst, m from step where far = 2), told as (select src, dst, 3 - m as m from step where far = 1),
cfg as (select unnest(['causal_only', 'causal_production', 'causal_production_quantitative', 'full_evaluated_fragment']) as configuration, unnest([0, 1, 2, 3]) as layers),
arcs as (select configuration, src, dst, m, 0 as layer from cfg, causal union all select configuration, src, dst, m, 1 from cfg, made where layers >= 1 and (src, dst) not in (select (src, dst) from causal)
  union all select configuration, src, dst, m, 2 from cfg, told where layers >= 2 and (src, dst) not in (select (src, dst) from causal union select (src, dst) from made))"""


@query("layer_ablation", f"""with recursive {LAYERS}, {D.FIRSTS_SQL}, {FREE}, {CON},
r(configuration, iv_id, node, minus) as (select configuration, iv_id, node, mask - 1 from cfg, iv union (select r.configuration, r.iv_id, a.dst, xor(r.minus, a.m - 1) from r join arcs a on a.configuration = r.configuration and a.src = r.node where not exists (select 1 from iv where iv.iv_id = r.iv_id and iv.node = a.dst)
  union all select r.configuration, r.iv_id, con.macro, xor(r.minus, con.m - 1) from r join con on con.micro = r.node where r.configuration = 'full_evaluated_fragment')),
s as (select configuration, iv_id, node, bit_or(minus + 1) as mask from r group by all),
p as (select configuration, grp, free.node, expected, case when mask in (1, 2) then mask else 3 end as mask from cfg join free on true left join s using (configuration) where s.iv_id = grp and s.node = free.node
  union all select configuration, grp, free.node, expected, 3 from cfg, free where (configuration, grp, free.node) not in (select (configuration, iv_id, node) from s)),
ch as (select p.configuration, count(*) filter (p.mask <> f.mask) as changed_pairs, count(*) filter (f.mask < 3 and p.mask = 3) as determinate_to_abstain, count(*) filter (f.mask = 3 and p.mask < 3) as abstain_to_determinate, count(*) filter (f.mask < 3 and p.mask < 3 and p.mask <> f.mask) as sign_flips,
  count(*) filter (p.mask = p.expected) as correct, count(*) filter (p.mask < 3 and p.mask <> p.expected) as wrong, count(*) filter (p.mask = 3) as abstain from p join p f on f.configuration = 'full_evaluated_fragment' and f.grp = p.grp and f.node = p.node group by p.configuration),
k as (select configuration, count(*) filter (layer = 0) as causal_arcs, count(*) filter (layer = 1) as production_shadow_arcs, count(*) filter (layer = 2) as quantitative_shadow_arcs from arcs group by configuration)
select configuration, causal_arcs::bigint as causal_arcs, production_shadow_arcs::bigint as production_shadow_arcs, quantitative_shadow_arcs::bigint as quantitative_shadow_arcs, case when configuration = 'full_evaluated_fragment' then (select count(*) from con) else 0 end::bigint as constitutive_constraints,
  (select count(*) from s where s.configuration = k.configuration and mask < 3)::bigint as determinate, (select count(*) from s where s.configuration = k.configuration)::bigint as predicted,
  correct::bigint as correct, wrong::bigint as wrong, abstain::bigint as abstain, changed_pairs::bigint as changed_pairs, determinate_to_abstain::bigint as determinate_to_abstain, abstain_to_determinate::bigint as abstain_to_determinate, sign_flips::bigint as sign_flips from k join ch using (configuration)""")
def layer_ablation(s, d):
    """Signs solved with one layer after another added, against the full map."""
    from signflow.operators.ablation import layer_ablation as run

    q = D.sequence(s, d)
    later = q.select("cust", F.col("k").alias("k2"), F.col("node").alias("dst"), F.col("price").alias("price2"), F.col("status").alias("status2"), F.col("priority").alias("priority2"))
    step = q.select("cust", F.col("k"), F.explode(F.array(F.lit(1), F.lit(2))).alias("far"), F.col("node").alias("src"), "price").withColumn("k2", F.col("k") + F.col("far")).join(later, ["cust", "k2"])
    step = store(step.select("src", "dst", "far", "status2", "priority2", F.when(F.col("price2") >= F.col("price"), 1).otherwise(2).cast("int").alias("m"), F.lit(0).alias("ord")), "steps")
    causal = step.where("far = 1 and status2 <> 'P' or far = 2 and priority2 = '5-LOW'")
    told = step.where("far = 1").withColumn("m", (3 - F.col("m")).cast("int"))
    return run(causal, step.where("far = 2"), told, _constitutive(s, d), D.firsts(s, d), _free(s, d).withColumnRenamed("grp", "iv_id"))


@query("risk_coverage", """with g as (select l_discount as threshold, count(*) as n, count(*) filter (l_returnflag = 'R') as ok from lineitem group by 1),
r as (select threshold, sum(n) over w as covered, sum(ok) over w as "right" from g window w as (order by threshold desc))
select threshold, covered::bigint as covered, "right"::bigint as "right", covered / (select count(*) from lineitem) as coverage, "right" / covered as precision from r""")
def risk_coverage(s, d):
    line = D.table(s, d, "lineitem").select(F.col("l_discount").alias("threshold"), (F.col("l_returnflag") == "R").alias("ok"))
    return S.risk_coverage(line, "threshold", "ok")


@query("stratified_quota", """with n as (select p_brand, count(*) as n from part group by p_brand), t as (select sum(n) as every from n),
q0 as (select p_brand, n, least(n, greatest(floor(200 * n / every + 0.5), case when n >= 1 then 1 else 0 end)) as q, row_number() over (order by n desc, p_brand) as place, (select count(*) from n) as strata from n, t),
q as (select p_brand, q + case when s < 200 then (200 - s) // strata + case when place <= (200 - s) % strata then 1 else 0 end else -((s - 200) // strata) - case when place <= (s - 200) % strata then 1 else 0 end end as quota from q0, (select sum(q)::bigint as s from q0)),
r as (select p_brand, p_partkey, p_name, row_number() over (partition by p_brand order by md5(p_partkey::varchar), p_partkey) as k from part) select p_brand, p_partkey, p_name from r join q using (p_brand) where k <= quota""")
def stratified_quota(s, d):
    return S.stratified_quota(D.table(s, d, "part").select("p_brand", "p_partkey", "p_name"), "p_brand", "p_partkey", 200)


STRATA = """select p_brand, count(*) filter (l_returnflag = 'N' and l_linestatus = 'F')::bigint as a, count(*) filter (l_returnflag = 'N' and l_linestatus <> 'F')::bigint as b,
count(*) filter (l_returnflag <> 'N' and l_linestatus = 'F')::bigint as c, count(*) filter (l_returnflag <> 'N' and l_linestatus <> 'F')::bigint as d from lineitem join part on l_partkey = p_partkey group by p_brand"""


def _strata(s, d):
    j = D.table(s, d, "lineitem").select("l_partkey", (F.col("l_returnflag") == "N").alias("abstained"), (F.col("l_linestatus") == "F").alias("wrong")).join(D.table(s, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return S.strata_table(j, "p_brand")


@query("strata_table", f"with t as ({STRATA}) select * from t where a + b > 0 and c + d > 0")
def strata_table(s, d):
    return _strata(s, d)


EXACT = """t as (select s_nationkey, count(*) filter (s_acctbal > 5000 and s_suppkey < 0.5 * s_acctbal) as a, count(*) filter (s_acctbal > 5000 and not s_suppkey < 0.5 * s_acctbal) as b,
  count(*) filter (s_acctbal <= 5000 and s_suppkey < 0.5 * s_acctbal) as c, count(*) filter (s_acctbal <= 5000 and not s_suppkey < 0.5 * s_acctbal) as d from supplier group by 1),
u as (select *, row_number() over (order by s_nationkey) as i, a + c as w, a + b as o, a + b + c + d as n from t where a + b > 0 and c + d > 0),
comb(n, k, c) as (select n, k, list_product(list_transform(range(1, k + 1), lambda x: (n - k + x) / x::double)) from (select unnest(range(0, 200)) as n), (select unnest(range(0, 200)) as k) where k <= n),
one as (select i, r.k, coalesce(x.c, 1) * coalesce(y.c, 1) / z.c as p from u, (select unnest(range(0, 200)) as k) r join comb x on x.n = u.w and x.k = r.k join comb y on y.n = u.n - u.w and y.k = u.o - r.k join comb z on z.n = u.n and z.k = u.o),
law(i, s, p) as (select 0::bigint, 0::bigint, 1.0::double union all select any_value(law.i) + 1, law.s + one.k, sum(law.p * one.p) from law join one on one.i = law.i + 1 group by law.s + one.k)"""


@query("strata_exact_p", f"with recursive {EXACT} select (select count(*) from u)::bigint as strata, round(sum(p), 9) as p from law where i = (select coalesce(max(i), 0) from u) and s >= (select coalesce(sum(a), 0) from u)")
def strata_exact_p(s, d):
    """One exact p over the nations' suppliers."""
    part = D.table(s, d, "supplier").select("s_nationkey", (F.col("s_acctbal") > 5000).alias("abstained"), (F.col("s_suppkey") < 0.5 * F.col("s_acctbal")).alias("wrong"))
    return S.exact_p(S.strata_table(part, "s_nationkey")).select(F.col("strata").cast("long").alias("strata"), F.round("p", 9).alias("p"))


@query("verdict_rollup", "select l_returnflag as kind, count(*)::bigint as n, count(*) filter (l_linestatus = 'F')::bigint as accepted from lineitem group by grouping sets ((), (l_returnflag))")
def verdict_rollup(s, d):
    return D.table(s, d, "lineitem").rollup(F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("accepted"))


@query("rank_auc", """with g as (select value, count(*) filter (event_type = 'error') as p, count(*) filter (event_type <> 'error') as q from events where value is not null group by value),
b as (select *, coalesce(sum(q) over (order by value rows between unbounded preceding and 1 preceding), 0) as lower from g) select round(sum(p * (lower + q / 2)) / (sum(p) * sum(q)), 12) as auc from b""")
def rank_auc(s, d):
    return S.rank_auc(D.table(s, d, "events").select("value", (F.col("event_type") == "error").alias("pos")), "value", "pos").select(F.round("auc", 12).alias("auc"))


@query("correlation_p", """with c as (select l_returnflag, corr(l_quantity, l_extendedprice) as r, count(*) as n from lineitem group by 1), z as (select *, abs(atanh(greatest(-0.999999, least(0.999999, r)))) * sqrt(greatest(n - 3, 1)) / sqrt(2.0) as x from c), t as (select *, 1 / (1 + 0.3275911 * x) as t from z)
select l_returnflag, round(r, 9) as r, n::bigint as n, round(t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x), 7) as p from t""")
def correlation_p(s, d):
    c = D.table(s, d, "lineitem").groupBy("l_returnflag").agg(F.corr("l_quantity", "l_extendedprice").alias("r"), F.count("*").alias("n"))
    return c.select("l_returnflag", F.round("r", 9).alias("r"), "n", F.round(S.fisher_p(F.col("r"), F.col("n")), 7).alias("p"))


_PC = ("l_quantity", "l_extendedprice", "l_discount")


@query("partial_correlation", """with r as (select corr(l_quantity, l_extendedprice) as ab, corr(l_quantity, l_discount) as ac, corr(l_extendedprice, l_discount) as bc from lineitem),
p as (select (ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)) as ab, (ac - ab * bc) / sqrt((1 - ab * ab) * (1 - bc * bc)) as ac, (bc - ab * ac) / sqrt((1 - ab * ab) * (1 - ac * ac)) as bc from r)
select a, b, round(v, 6) as r from (select 'l_quantity' as a, 'l_extendedprice' as b, ab as v from p union all select 'l_extendedprice', 'l_quantity', ab from p union all select 'l_quantity', 'l_discount', ac from p union all select 'l_discount', 'l_quantity', ac from p
union all select 'l_extendedprice', 'l_discount', bc from p union all select 'l_discount', 'l_extendedprice', bc from p union all select 'l_quantity', 'l_quantity', 1.0 union all select 'l_extendedprice', 'l_extendedprice', 1.0 union all select 'l_discount', 'l_discount', 1.0)""")
def partial_correlation(s, d):
    got = S.partial_correlations(D.table(s, d, "lineitem"), list(_PC))
    return s.createDataFrame([(a, b, round(got[i][j], 6)) for i, a in enumerate(_PC) for j, b in enumerate(_PC)], "a string, b string, r double")


# --- knockout reports -----------------------------------------------------------------

TERMS = """terms as (select l_orderkey as node, (case when l_tax >= 0.04 then 1 else 2 end)::int as sign, l_returnflag || l_linestatus as label, l_linenumber as ord from lineitem),
firstterm as (select node, sign, arg_min(label, (ord, label)) as label from terms group by node, sign),
neutral as (select o_orderkey as node, o_orderpriority as label from orders where o_orderpriority <> '5-LOW'),
big as (select unnest([a, b]) as node from pairs where b is not null qualify dense_rank() over (order by least(a, b)) = 1),
moved as (select * from solved where not exists (select 1 from iv where iv.iv_id = solved.iv_id and iv.node = solved.node))"""


def _knockout(s, d, **how):
    terms = D.table(s, d, "lineitem").select(F.col("l_orderkey").alias("node"), F.when(F.col("l_tax") >= 0.04, 1).otherwise(2).cast("int").alias("sign"), F.concat("l_returnflag", "l_linestatus").alias("label"), F.col("l_linenumber").alias("ord"))
    neutral = D.table(s, d, "orders").where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("node"), F.col("o_orderpriority").alias("label"))
    k = F.col("s_suppkey")
    # suppliers clamp orders that don't exist
    lost = D.table(s, d, "supplier").select((-1 - k).alias("iv_id"), F.explode(F.array(-2 * k - 5, -2 * k - 7)).alias("node"), F.lit(1).alias("mask"))
    iv = D.firsts(s, d).unionByName(lost)
    return K.knockout(store(D.flow(s, d), "arcs"), iv, terms, neutral, nodes=D.table(s, d, "orders").select(F.col("o_orderkey").alias("node")), **how)


@query("knockout_phenotypes", f"{SOLVED}, {TERMS} select iv_id, node, mask, label, node in (select node from big) as in_largest from moved join firstterm using (node) where mask = sign")
def knockout_phenotypes(s, d):
    return _knockout(s, d).phenotypes.select("iv_id", "node", "mask", "label", "in_largest")


@query("knockout_affected", f"{SOLVED}, {TERMS} select iv_id, node, neutral.label, node in (select node from big) as in_largest from moved left join neutral using (node) where mask = 3 and node in (select node from firstterm)")
def knockout_affected(s, d):
    return _knockout(s, d).affected.select("iv_id", "node", "label", "in_largest")


@query("knockout_summary", f"{SOLVED} select iv_id, count(*)::bigint as predicted, count(*) filter (mask <> 3)::bigint as determinate from solved group by iv_id")
def knockout_summary(s, d):
    return _knockout(s, d).summary


@query("knockout_errors", "select -1 - s_suppkey as iv_id, 'unknown nodes: ' || array_to_string(list_sort([(-2 * s_suppkey - 5)::varchar, (-2 * s_suppkey - 7)::varchar]), ', ') as error from supplier")
def knockout_errors(s, d):
    return _knockout(s, d).errors


# --- second order -----------------------------------------------------------------------

MOD = """mod as (select a.node as modulator, b.node as src, c.node as dst, (case when a.priority < b.priority then 1 when a.priority > b.priority then 2 else 3 end)::int as mu, a.status = 'F' as can_flip
  from seq a join seq b on b.cust = a.cust and b.k = a.k + 1 join seq c on c.cust = a.cust and c.k = a.k + 2)"""


def _mod(s, d):
    """An order modulates how its customer's next one influences the one after that."""
    q = D.sequence(s, d).select("cust", "k", "node", "priority", "status")
    b = q.select("cust", (F.col("k") - 1).alias("k"), F.col("node").alias("src"), F.col("priority").alias("p2"))
    c = q.select("cust", (F.col("k") - 2).alias("k"), F.col("node").alias("dst"))
    mu = F.when(F.col("priority") < F.col("p2"), 1).when(F.col("priority") > F.col("p2"), 2).otherwise(3).cast("int")
    return q.join(b, ["cust", "k"]).join(c, ["cust", "k"]).select(F.col("node").alias("modulator"), "src", "dst", mu.alias("mu"), (F.col("status") == "F").alias("can_flip"))


@query("modulations_of_edge", f"with {FLOW_SQL}, {MOD} select * from mod where (src, dst) = (select (src, dst) from mod order by src, dst limit 1)")
def modulations_of_edge(s, d):
    m = store(_mod(s, d), "mod")
    one = m.orderBy("src", "dst").first()
    return O.modulations_of(m, pair=(one.src, one.dst))


@query("interaction_sign", f"with {FLOW_SQL}, {MOD} select modulator, src, dst, mu, m, {times_sql('mu', 'm')}::int as iota, case {times_sql('mu', 'm')} when 1 then 'amplifies the influence' when 2 then case when can_flip then 'dampens the influence and may reverse it' else 'dampens the influence' end else 'changes the influence, which way is open' end as phrase from mod join arc using (src, dst)")
def interaction_sign(s, d):
    m = _mod(s, d)
    out = O.interaction_signs(m, D.flow(s, d)).join(m.select("modulator", "src", "dst", "can_flip"), ["modulator", "src", "dst"])
    return out.withColumn("phrase", O.interaction_phrase(F.col("iota"), F.col("can_flip"))).drop("can_flip")


GAIN = f"gain as (select iv_id, src, dst, modulator, {times_sql('mu', 'mask')}::int as gain from mod join solved on solved.node = mod.modulator)"


@query("gain_changes", f"{SOLVED}, {MOD}, {GAIN} select iv_id, src, dst, modulator, gain from gain where gain in (1, 2)")
def gain_changes(s, d):
    return O.gain_changes(_mod(s, d), _solved(s, d))


@query("gain_sensitivity", f"{SOLVED}, {MOD}, {GAIN} select iv_id, src, dst, bit_or(gain)::int as gain, count(distinct modulator)::bigint as modulators from gain group by iv_id, src, dst")
def gain_sensitivity(s, d):
    return O.gain_sensitivity(_mod(s, d), _solved(s, d))


@query("synergies", f"""{SOLVED}, {MOD}, i as (select mod.*, {times_sql('mu', 'm')}::int as iota from mod join arc using (src, dst)),
syn as (select p.iv_id, modulator, i.src, i.dst, iota, q.mask as source_change, p.mask as modulator_change, {times_sql('iota', times_sql('q.mask', 'p.mask'))}::int as "cross", coalesce(t.mask, 3)::int as target
  from i join solved p on p.node = modulator join solved q on q.node = i.src and q.iv_id = p.iv_id left join solved t on t.node = i.dst and t.iv_id = p.iv_id where p.mask in (1, 2) and q.mask in (1, 2))
select *, case when target = 3 then 'reinforces' when "cross" = target then 'synergistic' else 'antagonistic' end as verdict from syn where "cross" in (1, 2)""")
def synergies(s, d):
    return O.synergies(O.interaction_signs(_mod(s, d), D.flow(s, d)), _solved(s, d))


@query("regime_signs", f"with {FLOW_SQL}, {MOD} select modulator, src, dst, (case mu when 2 then m when 1 then {times_sql('2', 'm')} else 3 end)::int as low, (case mu when 1 then m when 2 then {times_sql('2', 'm')} else 3 end)::int as high from mod join arc using (src, dst) where can_flip")
def regime_signs(s, d):
    return O.regime_signs(_mod(s, d), D.flow(s, d))


@query("shadow_present", f"with {FLOW_SQL}, {MOD} select distinct modulator, mod.dst, mu as m, exists (select 1 from arc where arc.src = mod.modulator and arc.dst = mod.dst and arc.m = mu) as present from mod")
def shadow_present(s, d):
    return O.shadows(_mod(s, d), D.flow(s, d))


@query("but_for", f"{SOLVED} select iv_id, node, mask as factual, 0 as counterfactual, mask in (1, 2) as necessary from solved where not exists (select 1 from iv where iv.iv_id = solved.iv_id and iv.node = solved.node)")
def but_for(s, d):
    return O.but_for(_solved(s, d), D.firsts(s, d))
