import itertools

from pyspark.sql import functions as F

from signflow.functions import signs

PLUS = {("0", x): x for x in "0+-?"} | {(x, "0"): x for x in "0+-?"} | {("+", "+"): "+", ("-", "-"): "-"}
TIMES = {("+", "+"): "+", ("-", "-"): "+", ("+", "-"): "-", ("-", "+"): "-"}


def test_both_algebras_by_table(spark):
    pairs = list(itertools.product("0+-?", repeat=2))
    df = spark.createDataFrame(pairs, "a string, b string").withColumns({"x": signs.encode(F.col("a")), "y": signs.encode(F.col("b"))})
    got = df.select("a", "b", signs.decode(F.col("x").bitwiseOR(F.col("y"))).alias("s"), signs.decode(signs.times(F.col("x"), F.col("y"))).alias("t")).collect()
    for a, b, s, t in got:
        assert s == PLUS.get((a, b), "?")
        assert t == ("0" if "0" in (a, b) else TIMES.get((a, b), "?"))
        assert signs.MASKS[t] == signs.mul(signs.MASKS[a], signs.MASKS[b])


def test_parallel_sum_of_nothing_is_undetermined(spark):
    empty = spark.createDataFrame([], "m int")
    assert empty.agg(signs.parallel(F.col("m"))).first()[0] == 3


def test_swap(spark):
    got = spark.createDataFrame([(m,) for m in range(4)], "m int").select(signs.swap(F.col("m"))).collect()
    assert [r[0] for r in got] == [0, 2, 1, 3] == [signs.neg(m) for m in range(4)]
