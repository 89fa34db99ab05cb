"""Joins of predictions with observations, ranks, roll-ups, diffs and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signflow.functions.storage import numbered, store


def status(expected: Column, predicted: Column) -> Column:
    return F.when(predicted.isNull() | (predicted == 0), "missing").when(predicted == 3, "ambiguous").when(predicted == expected, "correct").otherwise("wrong")


def score(observed: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Each observation (keys, expected) with its prediction (keys, mask) and status."""
    return observed.join(predicted, keys, "left").withColumn("status", status(F.col("expected"), F.col("mask")))


def roll_up(scored: DataFrame, case: str, critical: str | None = None) -> DataFrame:
    """Counts of each status per case and over all (case null), with precision, coverage and accuracy, null over nothing.

    With ``critical``, a boolean column, also how many observations depend on a
    feedback loop, and how many of those are right.
    """
    n = {s: F.count_if(F.col("status") == s) for s in ("correct", "wrong", "ambiguous", "missing")}
    done = n["correct"] + n["wrong"]
    more = [F.count_if(critical).alias("critical"), F.count_if(F.col(critical) & (F.col("status") == "correct")).alias("critical_correct")] if critical else []
    return scored.rollup(case).agg(*[v.alias(k) for k, v in n.items()], F.try_divide(n["correct"], done).alias("precision"), F.try_divide(done, F.count("*")).alias("coverage"), F.try_divide(n["correct"], F.count("*")).alias("accuracy"), *more)


def drop_conflicts(rows: DataFrame, keys: list[str], sign: str) -> DataFrame:
    """Keys with one distinct sign, and that sign."""
    return rows.groupBy(*keys).agg(F.count_distinct(sign).alias("k"), F.min(sign).alias(sign)).where("k = 1").drop("k")


def direction_variable(rows: DataFrame, keys: list[str], sign: str) -> DataFrame:
    """Keys seen with more than one sign."""
    return rows.groupBy(*keys).agg(F.count_distinct(sign).alias("signs")).where("signs > 1")


def novel(predicted: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Determinate predictions that nobody has observed."""
    return predicted.where("mask in (1, 2)").join(observed.select(*keys).distinct(), keys, "left_anti")


def rank_explanations(candidates: DataFrame, observed: DataFrame, pool: DataFrame, group: str, candidate: str) -> DataFrame:
    """(group, candidate, agree, disagree, ambiguous, candidates, rank, unique): the whole pool ranked for each group.

    By agreements less disagreements, then fewer disagreements, then more
    agreements.  The rank is one more than the number of strictly better
    candidates of the pool; ``unique`` tells a rank without peers;
    ``ambiguous`` counts the group's observations that a candidate leaves open.

    ``candidates`` (candidate, node, mask) meets ``observed`` (group, node,
    expected) on the node, never as a product.  The candidates of ``pool``
    (candidate) that decide none of a group's observations all score zero and
    share one rank; they are one row without a name, and ``candidates`` says
    how many they are (1 in all other rows).
    """
    j = observed.join(candidates.where("mask in (1, 2)"), "node").groupBy(group, candidate).agg(F.count_if(F.col("mask") == F.col("expected")).alias("agree"), F.count_if(F.col("mask") != F.col("expected")).alias("disagree"))
    j = store(j.join(pool.select(candidate).distinct(), candidate, "left_semi"), "scores")
    size = pool.select(candidate).distinct().count()
    seen = observed.groupBy(group).agg(F.count("*").alias("observations"))
    met = j.groupBy(group).agg(F.count("*").alias("met"))
    silent = seen.join(met, group, "left").select(group, (F.lit(size) - F.coalesce("met", F.lit(0))).alias("candidates")).where("candidates > 0")
    named = j.select(group, candidate, "agree", "disagree", F.lit(1).cast("long").alias("candidates"))
    none = F.lit(0).cast("long")
    every = named.unionByName(silent.select(group, F.lit(None).cast(dict(named.dtypes)[candidate]).alias(candidate), none.alias("agree"), none.alias("disagree"), "candidates"))
    order = [(F.col("agree") - F.col("disagree")).desc(), F.col("disagree").asc(), F.col("agree").desc()]
    peers = Window.partitionBy(group, "agree", "disagree")
    ranked = every.withColumns({"upto": F.sum("candidates").over(Window.partitionBy(group).orderBy(*order)), "peers": F.sum("candidates").over(peers)})
    ranked = ranked.withColumns({"rank": F.col("upto") - F.col("peers") + 1, "unique": F.col("peers") == 1})
    return ranked.join(seen, group).select(group, candidate, "agree", "disagree", (F.col("observations") - F.col("agree") - F.col("disagree")).alias("ambiguous"), "candidates", "rank", "unique")


def rank_true(candidates: DataFrame, observed: DataFrame, truth: DataFrame, pool: DataFrame, group: str, candidate: str) -> DataFrame:
    """(group, candidate, agree, disagree, rank, unique) of each group's true candidate among the whole pool.

    ``truth`` has (group, candidate).  Groups without a true candidate in the
    pool, or without observations, are left out.  Candidates that meet no
    observation have 0 agreements and 0 disagreements; their number counts, they
    are never listed.
    """
    j = store(observed.join(candidates.where("mask in (1, 2)"), "node").groupBy(group, candidate).agg(F.count_if(F.col("mask") == F.col("expected")).alias("agree"), F.count_if(F.col("mask") != F.col("expected")).alias("disagree")), "scores")
    size = pool.select(candidate).distinct().count()
    t = truth.join(pool.select(candidate).distinct(), candidate, "left_semi").join(observed.select(group).distinct(), group, "left_semi").select(group, candidate).distinct()
    t = t.join(j, [group, candidate], "left").select(group, candidate, F.coalesce("agree", F.lit(0)).alias("agree"), F.coalesce("disagree", F.lit(0)).alias("disagree"))
    key = lambda p: F.struct(F.col(f"{p}agree") - F.col(f"{p}disagree"), -F.col(f"{p}disagree"), F.col(f"{p}agree"))
    others = j.select(group, F.col(candidate).alias("other"), F.col("agree").alias("oagree"), F.col("disagree").alias("odisagree"))
    k = t.withColumn("own", key("")).join(others, group, "left").withColumn("its", key("o"))
    met = F.col("other").isNotNull() & (F.col("other") != F.col(candidate))
    n = k.groupBy(group, candidate, "agree", "disagree", "own").agg(F.count_if(met & (F.col("its") > F.col("own"))).alias("better"), F.count_if(met & (F.col("its") == F.col("own"))).alias("equal"), F.count_if(met).alias("met"))
    # the rest of the pool scores zero
    zero = F.struct(F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"))
    silent = F.lit(size) - 1 - F.col("met")
    better = F.col("better") + F.when(zero > F.col("own"), silent).otherwise(0)
    equal = F.col("equal") + F.when(zero == F.col("own"), silent).otherwise(0)
    return n.select(group, candidate, "agree", "disagree", (better + 1).cast("long").alias("rank"), ((better == 0) & (equal == 0)).alias("unique"))


def rank_metrics(ranks: DataFrame, ks: tuple[int, ...] = (3, 10)) -> DataFrame:
    """n, mean reciprocal and median rank of the true candidates, how many are first alone, and how many are within each k."""
    first = F.count_if((F.col("rank") == 1) & F.col("unique")).alias("top1")
    return ranks.agg(F.count("*").alias("n"), F.avg(1 / F.col("rank")).alias("mrr"), F.percentile("rank", F.lit(0.5)).alias("median_rank"), first, *[F.count_if(F.col("rank") <= k).alias(f"top{k}") for k in ks])


def paired(frames: dict[str, DataFrame], observed: DataFrame, keys: list[str]) -> DataFrame:
    """Observations with the prediction of each method beside them: (keys, expected, one column per method)."""
    out = observed
    for name, df in frames.items():
        out = out.join(df.select(*keys, F.col("mask").alias(name)), keys, "left")
    return out


def method_scores(pairs: DataFrame, methods: list[str]) -> DataFrame:
    """(method, correct, wrong, abstain, precision) of paired predictions."""
    from functools import reduce

    det = lambda c: F.coalesce(F.col(c).isin(1, 2), F.lit(False))
    rows = [pairs.agg(F.count_if(det(m) & (F.col(m) == F.col("expected"))).alias("correct"), F.count_if(det(m) & (F.col(m) != F.col("expected"))).alias("wrong"), F.count_if(~det(m)).alias("abstain")).select(F.lit(m).alias("method"), "correct", "wrong", "abstain") for m in methods]
    return reduce(DataFrame.unionByName, rows).withColumn("precision", F.try_divide("correct", F.col("correct") + F.col("wrong")))


def contrasts(pairs: DataFrame, solver: str, naive: str) -> DataFrame:
    """Where both commit and differ, and who is right; and where the solver abstains but the other commits, and how often that is right."""
    det = lambda c: F.coalesce(F.col(c).isin(1, 2), F.lit(False))
    differ = det(solver) & det(naive) & (F.col(solver) != F.col(naive))
    alone = ~det(solver) & det(naive)
    right = lambda c: F.col(c) == F.col("expected")
    return pairs.agg(F.count_if(differ).alias("differ"), F.count_if(differ & right(solver)).alias("solver_right"), F.count_if(differ & right(naive)).alias("naive_right"), F.count_if(alone).alias("feedback"), F.count_if(alone & right(naive)).alias("feedback_right"))


def risk_coverage(scored: DataFrame, threshold: str, correct: str) -> DataFrame:
    """Coverage and precision at each distinct threshold, ties as one group, from the highest down."""
    g = scored.groupBy(threshold).agg(F.count("*").alias("n"), F.sum(F.col(correct).cast("long")).alias("ok"))
    total = g.agg(F.sum("n").alias("total"))
    one = numbered(g, F.col(threshold).desc(), total="n")
    run = numbered(one.drop("number"), F.col(threshold).desc(), total="ok").select(threshold, (F.col("n_before") + F.col("n")).alias("covered"), (F.col("ok_before") + F.col("ok")).alias("right"))
    return run.crossJoin(F.broadcast(total)).select(threshold, "covered", "right", (F.col("covered") / F.col("total")).alias("coverage"), (F.col("right") / F.col("covered")).alias("precision"))


def prediction_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """lost, gained, flipped and same among determinate predictions of two runs."""
    a, b = before.where("mask in (1, 2)").select(*keys, F.col("mask").alias("old")), after.where("mask in (1, 2)").select(*keys, F.col("mask").alias("new"))
    j = a.join(b, keys, "full")
    return j.agg(F.count_if(F.col("new").isNull()).alias("lost"), F.count_if(F.col("old").isNull()).alias("gained"), F.count_if(F.col("old") != F.col("new")).alias("flipped"), F.count_if(F.col("old") == F.col("new")).alias("same"))


def quotas(sizes: dict, total: int, floor: int = 1) -> dict:
    """Rows to take from strata of these sizes: each one's share, rounded, and at least ``floor`` where it has as many.

    The largest strata give or take one row each in turn until ``total`` is met.
    """
    every = sum(sizes.values())
    out = {k: min(n, max(int(total * n / every + 0.5), floor if n >= floor else 0)) for k, n in sizes.items()}
    order = sorted(sizes, key=lambda k: (-sizes[k], str(k)))
    step = -1 if sum(out.values()) > total else 1
    while sum(out.values()) != min(total, every):
        moved = False
        for k in order:
            if sum(out.values()) == min(total, every):
                break
            if step < 0 and out[k] > floor or step > 0 and out[k] < sizes[k]:
                out[k] += step
                moved = True
        if not moved:
            break
    return out


def stratified_quota(rows: DataFrame, stratum: str, key: str, total: int, floor: int = 1) -> DataFrame:
    """A sample of ``total`` rows by ``quotas`` of the strata, of which there are few; rows are taken by a hash of their key."""
    sizes = {r[0]: r[1] for r in rows.groupBy(stratum).agg(F.count("*").alias("n")).collect()}
    q = rows.sparkSession.createDataFrame([(k, n) for k, n in quotas(sizes, total, floor).items()], f"__s {dict(rows.dtypes)[stratum]}, __q long")
    w = Window.partitionBy(stratum).orderBy(F.md5(F.col(key).cast("string")), key)
    ranked = rows.join(F.broadcast(q), rows[stratum].eqNullSafe(F.col("__s"))).withColumn("__k", F.row_number().over(w))
    return ranked.where("__k <= __q").select(*rows.columns)


def strata_table(rows: DataFrame, stratum: str) -> DataFrame:
    """Per stratum the two-by-two table of abstained and wrong, for strata that have both kinds."""
    return rows.groupBy(stratum).agg(
        F.count_if(F.col("abstained") & F.col("wrong")).alias("a"),
        F.count_if(F.col("abstained") & ~F.col("wrong")).alias("b"),
        F.count_if(~F.col("abstained") & F.col("wrong")).alias("c"),
        F.count_if(~F.col("abstained") & ~F.col("wrong")).alias("d"),
    ).where("a + b > 0 and c + d > 0")


def exact_p(tables: DataFrame) -> DataFrame:
    """(strata, p): one-sided exact p that so many of the wrong are among the abstained, over strata (a, b, c, d).

    Each stratum's hypergeometric law is worked out on Spark as logarithms; laws
    are convolved pairwise, round by round, so that no task gets more than two.
    Without strata p is 1.
    """
    from math import ceil, lgamma, log2

    import numpy as np
    import pandas as pd

    def law(frames):
        for pdf in frames:
            rows = []
            for key, a, b, c, d in pdf[["key", "a", "b", "c", "d"]].itertuples(index=False):
                n, wrong, out = a + b + c + d, a + c, a + b
                lo, hi = max(0, out - (n - wrong)), min(wrong, out)
                comb = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
                p = np.exp([comb(wrong, k) + comb(n - wrong, out - k) - comb(n, out) for k in range(lo, hi + 1)])
                rows.append((key, lo, (p / p.sum()).tolist(), a))
            yield pd.DataFrame(rows, columns=["key", "low", "p", "seen"])

    schema = "key long, low long, p array<double>, seen long"
    laws = store(numbered(tables.select("a", "b", "c", "d"), "a", "b", "c", "d", name="key").mapInPandas(law, schema), "laws")
    n = laws.count()
    if not n:
        return tables.sparkSession.createDataFrame([(0, 1.0)], "strata int, p double")

    def two(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        p = np.array([1.0])
        for x in pdf.p:
            p = np.convolve(p, np.array(x))
        return pd.DataFrame({"key": [pdf.key.iloc[0] // 2], "low": [pdf.low.sum()], "p": [p.tolist()], "seen": [pdf.seen.sum()]})

    for _ in range(ceil(log2(n)) if n > 1 else 0):
        laws = store(laws.groupBy(F.floor(F.col("key") / 2)).applyInPandas(two, schema), "laws")
    tail = F.expr("aggregate(slice(p, cast(greatest(seen - low, 0) + 1 as int), size(p)), 0D, (x, y) -> x + y)")
    return laws.select(F.lit(n).alias("strata"), tail.alias("p"))


def partial_correlations(rows: DataFrame, columns: list[str]) -> list[list[float]]:
    """The matrix of partial correlations, from one pass of sums over all rows."""
    import numpy as np

    x = rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    aggs = [F.count("*")] + [F.sum(c) for c in columns] + [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(columns) for b in columns[i:]]
    got = list(x.agg(*[e.alias(f"x{i}") for i, e in enumerate(aggs)]).first())
    k, n = len(columns), got[0]
    mean = np.array(got[1 : k + 1]) / n
    cov = np.zeros((k, k))
    cov[np.triu_indices(k)] = np.array(got[k + 1 :]) / n
    cov = np.triu(cov) + np.triu(cov, 1).T - np.outer(mean, mean)
    p = np.linalg.pinv(cov)
    out = -p / np.sqrt(np.outer(np.diag(p), np.diag(p)))
    np.fill_diagonal(out, 1.0)
    return out.tolist()


def rank_auc(rows: DataFrame, value: str, positive: str) -> DataFrame:
    """Area under the ROC curve by ranks, ties halved, from the distinct values' counts."""
    g = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    below = numbered(g, value, total="q")
    return below.agg(F.try_divide(F.sum(F.col("p") * (F.col("q_before") + F.col("q") / 2)), F.sum("p") * F.sum("q")).alias("auc"))


def fisher_p(r: Column, n: Column, given: int = 0) -> Column:
    """Two-sided p of a (partial) correlation by Fisher's transformation; the normal tail by a series good to 1e-7."""
    r = F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), r))
    z = F.abs(F.atanh(r)) * F.sqrt(F.greatest(n - given - 3, F.lit(1)))
    x = z / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    # fixed values: a rational approximation of the complementary error function
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)
