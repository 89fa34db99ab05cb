"""Typed signed graphs over order tables, so that every graph operator has data at every size.

The graph of parts: a line influences the next line of its order, positively if
its extended price doesn't fall, negatively if it does.  It is dense and almost
all of it is one strong component.

The graph of orders: an order influences its customer's next one by whether the
total price rises, and the one after that where both have the same status; and
some orders feed back on the one before.  Its components are small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- parts --------------------------------------------------------------------


def influences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, m, context): one row per pair of consecutive lines of an order."""
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag"]
    a = table(spark, sf_dir, "lineitem").select(*cols)
    b = a.select(*[F.col(c).alias("n" + c) for c in cols])
    j = a.join(b, (F.col("l_orderkey") == F.col("nl_orderkey")) & (F.col("nl_linenumber") == F.col("l_linenumber") + 1)).where("l_partkey <> nl_partkey")
    return j.select(
        F.col("l_partkey").alias("src"),
        F.col("nl_partkey").alias("dst"),
        F.when(F.col("nl_extendedprice") >= F.col("l_extendedprice"), 1).otherwise(2).cast("int").alias("m"),
        F.when(F.col("nl_returnflag") != "N", F.col("nl_returnflag")).alias("context"),
    )


INFLUENCES_SQL = """inf as (select a.l_partkey as src, b.l_partkey as dst, case when b.l_extendedprice >= a.l_extendedprice then 1 else 2 end as m,
  case when b.l_returnflag <> 'N' then b.l_returnflag end as context
  from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1 where a.l_partkey <> b.l_partkey)"""
ALL_SQL = INFLUENCES_SQL + ", arc as (select src, dst, bit_or(m)::int as m from inf group by src, dst)"


def arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel influences summed: (src, dst, m)."""
    return influences(spark, sf_dir).groupBy("src", "dst").agg(F.bit_or("m").cast("int").alias("m"))


def production(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer of suppliers' numbers on the parts they sell, by discount: (src, dst, m, ord)."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.when(F.col("l_discount") < 0.05, 1).otherwise(2).cast("int").alias("m"), F.col("l_orderkey").alias("ord")).where("src <> dst")


PRODUCTION_SQL = "prod as (select l_suppkey as src, l_partkey as dst, case when l_discount < 0.05 then 1 else 2 end as m, l_orderkey as ord from lineitem where l_suppkey <> l_partkey)"


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One intervention per brand: its part of the smallest key is raised."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("iv_id")).agg(F.min("p_partkey").alias("node")).withColumn("mask", F.lit(1))


SEEDS_SQL = "iv as (select p_brand as iv_id, min(p_partkey) as node, 1 as mask from part group by p_brand)"


# --- orders -------------------------------------------------------------------


def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cust, k, node, price, status, priority): each customer's orders by date, numbered from 1."""
    w = Window.partitionBy("cust").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cust"), "o_orderdate", "o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return o.withColumn("k", F.row_number().over(w)).select("cust", "k", F.col("o_orderkey").alias("node"), "price", "status", "priority")


def flow(spark: SparkSession, sf_dir: str, paired: bool = True) -> DataFrame:
    """(src, dst, m) of the graph of orders.

    Paired: every second order feeds back on the one before it, so components
    have at most two orders.  Otherwise urgent and high-priority orders feed
    back, which makes components of two and more.
    """
    w = Window.partitionBy("cust").orderBy("k")
    s = sequence(spark, sf_dir)
    s = s.withColumns({f"{c}{i}": F.lead(c, i).over(w) for i in (1, 2) for c in ("node", "price", "status", "priority")})
    up = lambda i: F.when(F.col(f"price{i}") >= F.col("price"), 1).otherwise(2).cast("int")
    back = (F.col("k") % 2 == 1) if paired else F.col("priority1").isin("1-URGENT", "2-HIGH")
    sign = F.when(F.col("status1") == "F", 2).when(F.col("status1") == "O", 1).otherwise(3).cast("int")
    arcs = F.array(
        F.when(F.col("node1").isNotNull(), F.struct(F.col("node").alias("src"), F.col("node1").alias("dst"), up(1).alias("m"))),
        F.when(F.col("status2") == F.col("status"), F.struct(F.col("node").alias("src"), F.col("node2").alias("dst"), up(2).alias("m"))),
        F.when(F.col("node1").isNotNull() & back, F.struct(F.col("node1").alias("src"), F.col("node").alias("dst"), sign.alias("m"))),
    )
    return s.select(F.inline(F.array_compact(arcs)))


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, m): the graph of orders with loops, and each part's orders one after another by number.

    Parts link the orders of different customers, so components and cones grow
    with the data.
    """
    w = Window.partitionBy("l_partkey").orderBy("l_orderkey")
    line = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_orderkey").agg(F.max("l_returnflag").alias("flag"))
    step = line.select(F.col("l_orderkey").alias("src"), F.lead("l_orderkey").over(w).alias("dst"), F.when(F.col("flag") == "R", 2).otherwise(1).cast("int").alias("m")).where("dst is not null")
    return flow(spark, sf_dir, paired=False).unionByName(step).groupBy("src", "dst").agg(F.bit_or("m").cast("int").alias("m"))


SEQUENCE_SQL = "seq as (select o_custkey as cust, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as k, o_orderkey as node, o_totalprice as price, o_orderstatus as status, o_orderpriority as priority from orders)"
_BACK = "case b.status when 'F' then 2 when 'O' then 1 else 3 end"
_FLOW = SEQUENCE_SQL + """, arc as (select a.node as src, b.node as dst, case when b.price >= a.price then 1 else 2 end as m from seq a join seq b on a.cust = b.cust and b.k = a.k + 1
  union all select a.node, b.node, case when b.price >= a.price then 1 else 2 end from seq a join seq b on a.cust = b.cust and b.k = a.k + 2 where a.status = b.status
  union all select b.node, a.node, {back} from seq a join seq b on a.cust = b.cust and b.k = a.k + 1 where {where})"""
FLOW_SQL = _FLOW.format(back=_BACK, where="a.k % 2 = 1")
LOOPS_SQL = _FLOW.format(back=_BACK, where="b.priority in ('1-URGENT', '2-HIGH')")


LINKED_SQL = LOOPS_SQL.replace("arc as (", "own as (", 1) + """, held as (select l_partkey, l_orderkey, max(l_returnflag) as flag from lineitem group by 1, 2),
arc as (select src, dst, bit_or(m)::int as m from (select src, dst, m from own union all select l_orderkey, lead(l_orderkey) over (partition by l_partkey order by l_orderkey), case when flag = 'R' then 2 else 1 end from held) where dst is not null group by src, dst)"""


def firsts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One intervention per customer: the first order is raised or, of a customer in debt, lowered."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust"), F.when(F.col("c_acctbal") >= 0, 1).otherwise(2).cast("int").alias("mask"))
    return sequence(spark, sf_dir).where("k = 1").join(c, "cust").select(F.col("cust").alias("iv_id"), "node", "mask")


FIRSTS_SQL = "iv as (select cust as iv_id, node, (case when c_acctbal >= 0 then 1 else 2 end)::int as mask from seq join customer on c_custkey = cust where k = 1)"


def times_sql(a: str, b: str) -> str:
    """The product of two masks as SQL; null arcs carry nothing."""
    return f"(case when coalesce({a}, 0) = 0 or coalesce({b}, 0) = 0 then 0 when {a} = 3 or {b} = 3 then 3 when {a} = 1 then {b} when {b} = 1 then 2 else 1 end)"


#: The closed form of components of two, pair by pair, for interventions iv(iv_id, node, mask) of one clamp: needs ``recursive`` and SEQUENCE_SQL's seq; gives solved(iv_id, node, mask).
SOLVED_SQL = f"""pairs as (select a.cust, (a.k + 1) // 2 as j, a.node as a, b.node as b,
    case when a.price >= p.price then 1 else 2 end as f, case when a.status = q.status then case when a.price >= q.price then 1 else 2 end end as sa,
    case when b.status = p.status then case when b.price >= p.price then 1 else 2 end end as sb,
    case when b.price >= a.price then 1 else 2 end as alpha, case b.status when 'F' then 2 when 'O' then 1 when 'P' then 3 end as beta
  from seq a left join seq b on b.cust = a.cust and b.k = a.k + 1 left join seq p on p.cust = a.cust and p.k = a.k - 1 left join seq q on q.cust = a.cust and q.k = a.k - 2 where a.k % 2 = 1),
x(iv_id, cust, j, xa, xb) as (select iv_id, cust, j, case when node = a then mask else {times_sql('beta', 'mask')} end, case when node = a then {times_sql('alpha', 'mask')} else mask end from iv join pairs on node in (a, b)
  union all select iv_id, cust, j, fa | {times_sql('beta', 'fb')}, case when b is null then 0 else fb | {times_sql('alpha', 'fa')} end from (
    select x.iv_id, pairs.*, {times_sql('f', 'x.xb')} | {times_sql('sa', 'x.xa')} as fa, {times_sql('sb', 'x.xb')} as fb from x join pairs on pairs.cust = x.cust and pairs.j = x.j + 1)),
solved as (select iv_id, a as node, xa::int as mask from x join pairs using (cust, j) where xa > 0 union all select iv_id, b, xb::int from x join pairs using (cust, j) where b is not null and xb > 0)"""
