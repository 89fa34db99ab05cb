"""Numeric operators: signed random walks, Monte-Carlo checks of predicted signs, realisable derivatives."""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signflow.functions.storage import store
from signflow.functions.text import sign_of
from signflow.operators.compact import MAX_ARCS, Compact, by_broadcast, by_piece, cones, few, small
from signflow.operators.solve import strong_components


def _rounds(alpha: float, tolerance: float) -> int:
    """Rounds after which what is left of the series is below the tolerance."""
    return ceil(log(tolerance) / log(alpha)) if 0 < alpha < 1 else 1


def walk(arcs: list[tuple], clamps: dict, alpha: float, tolerance: float, unknown: str) -> dict:
    """node -> score over one cone, by the series of the walk; signs of undetermined arcs are zero or, ``as_minus``, negative."""
    names = sorted({n for s, d, _ in arcs for n in (s, d)} | set(clamps))
    at = {n: i for i, n in enumerate(names)}
    live = [(at[s], at[d], 1.0 if m == 1 else -1.0) for s, d, m in arcs if s != d and (m != 3 or unknown == "as_minus")]
    e = np.zeros(len(names))
    for n, m in clamps.items():
        e[at[n]] = -1.0 if m == 2 else 1.0
    if not live:
        return {n: (1 - alpha) * float(e[i]) for n, i in at.items() if e[i]}
    src, dst, sign = (np.array(c) for c in zip(*live))
    src, dst = src.astype(np.int64), dst.astype(np.int64)
    weight = alpha * sign / np.bincount(src, minlength=len(names))[src]
    part = total = (1 - alpha) * e
    for _ in range(_rounds(alpha, tolerance)):
        part = np.bincount(dst, weight * part[src], len(names))
        total = total + part
    return {n: float(total[i]) for n, i in at.items()}


def random_walk(arcs: DataFrame, seeds: DataFrame, alpha: float = 0.85, tolerance: float = 1e-12, unknown: str = "drop", max_arcs: int = MAX_ARCS) -> DataFrame:
    """(iv_id, node, score): the solution of ``r = (1 - alpha) e + alpha S r`` over what each intervention reaches.

    S holds each arc's sign over its source's out-degree; arcs into clamped
    nodes are cut.  The series is summed until what is left is below
    ``tolerance``.  Undetermined arcs are dropped, or read as negative with
    ``unknown="as_minus"``.
    """
    return alpha_sweep(arcs, seeds, [alpha], tolerance=tolerance, unknown=unknown, max_arcs=max_arcs).drop("alpha")


def alpha_sweep(arcs: DataFrame, seeds: DataFrame, alphas: list[float], tolerance: float = 1e-12, unknown: str = "drop", max_arcs: int = MAX_ARCS) -> DataFrame:
    """(alpha, iv_id, node, score) of a walk for each restart share, over cones that are found once."""
    kind, iv = dict(arcs.dtypes)["src"], dict(seeds.dtypes)["iv_id"]
    arcs = store(arcs.where("src <> dst").select("src", "dst", "m"), "arcs")
    schema = f"iv_id {iv}, node {kind}, alpha double, score double"

    def run(graph: Compact, _: Compact | None, clamps: dict) -> list[tuple]:
        own = graph.cone(clamps)[0]
        return [(n, a, r) for a in alphas for n, r in walk(own, clamps, a, tolerance, unknown).items()]

    far_arcs = far = None
    if small(arcs, max_arcs) and few(seeds):
        out = by_broadcast(arcs, seeds, run, schema)
    elif max_arcs:
        out, far_arcs, far = by_piece(arcs, seeds, run, schema)
    else:
        out, far_arcs, far = None, arcs, seeds
    if out is not None:
        out = out.select("alpha", "iv_id", "node", (F.round("score", 9) + F.lit(0.0)).alias("score"))
    if far is not None:
        for a in alphas:
            more = _joined_walk(far_arcs, far, a, tolerance, unknown).select(F.lit(a).alias("alpha"), "iv_id", "node", "score")
            out = more if out is None else out.unionByName(more)
    return out


def _joined_walk(arcs: DataFrame, seeds: DataFrame, alpha: float, tolerance: float, unknown: str) -> DataFrame:
    own, _ = cones(arcs, seeds)
    a = own.where("m <> 3" if unknown == "drop" else "true").select("iv_id", "src", "dst", F.when(F.col("m") == 1, 1.0).otherwise(-1.0).alias("s"))
    deg = a.groupBy("iv_id", "src").agg(F.count("*").alias("deg"))
    w = store(a.join(deg, ["iv_id", "src"]).select("iv_id", "src", "dst", (alpha * F.col("s") / F.col("deg")).alias("w")), "walk")
    part = total = store(seeds.select("iv_id", "node", ((1 - alpha) * F.when(F.col("mask") == 2, -1.0).otherwise(1.0)).alias("r")), "walk")
    for k in range(_rounds(alpha, tolerance)):
        part = part.withColumnRenamed("node", "src").join(w, ["iv_id", "src"]).groupBy("iv_id", F.col("dst").alias("node")).agg(F.sum(F.col("r") * F.col("w")).alias("r"))
        if k % 3 == 2:
            part = store(part, "walk")
        total = total.unionByName(part)
        if k % 9 == 8:
            total = store(total.groupBy("iv_id", "node").agg(F.sum("r").alias("r")), "walk")
    # what is reached without any flow has the score zero
    nodes = own.select("iv_id", F.col("src").alias("node")).union(own.select("iv_id", "dst")).distinct()
    return nodes.withColumn("r", F.lit(0.0)).unionByName(total).groupBy("iv_id", "node").agg((F.round(F.sum("r"), 9) + F.lit(0.0)).alias("score"))


def _stable_pair(j: np.ndarray) -> np.ndarray:
    """Which two-by-two matrices have both eigenvalues' real parts below zero."""
    half, det = (j[:, 0, 0] + j[:, 1, 1]) / 2, j[:, 0, 0] * j[:, 1, 1] - j[:, 0, 1] * j[:, 1, 0]
    return half + np.sqrt(np.maximum(half * half - det, 0)) < -1e-9


def monte_carlo(arcs: list[tuple], clamps: dict, draws: int, seed: int, unknown: str = "as_minus", most: int = 50) -> dict:
    """node -> (plus, minus, zero) counts over ``draws`` stable systems of a cone; unstable ones are drawn anew, ``most`` times as many at most."""
    names = sorted({n for s, d, _ in arcs for n in (s, d)} - set(clamps))
    at, n = {x: i for i, x in enumerate(names)}, len(names)
    count = np.zeros((n, 3), np.int64)
    rng = np.random.default_rng(seed)
    inner = [(at[d], at[s], m) for s, d, m in arcs if s in at and d in at and s != d]
    outer = [(at[d], 1.0 if clamps[s] == 1 else -1.0, m) for s, d, m in arcs if s in clamps and d in at]
    sign = lambda ms: np.array([1.0 if m == 1 else -1.0 for m in ms])
    kept = tried = 0
    if not n:
        return {}
    # arcs between components don't change the eigenvalues
    leads: dict = {}
    for d, s, _ in inner:
        leads.setdefault(s, []).append(d)
    loops = [np.array(sorted(c)) for c in strong_components(range(n), lambda v: leads.get(v, ())) if len(c) > 1]
    while kept < draws and tried < draws * most:
        size = min(256, 2 * (draws - kept), draws * most - tried)
        tried += size
        j = np.zeros((size, n, n))
        j[:, np.arange(n), np.arange(n)] = -rng.uniform(0.2, 1.5, (size, n))
        b = np.zeros((size, n))
        for rows, fill in ((inner, j), (outer, b)):
            for k, (d, s, m) in enumerate(rows):
                signs = rng.choice((-1.0, 1.0), size) if m == 3 and unknown == "both" else sign([m])
                strength = signs * rng.uniform(0.1, 1.0, size)
                if fill is j:
                    j[:, d, s] = strength
                else:
                    b[:, d] += strength * s
        stable = np.ones(size, bool)
        for c in loops:
            part = j[:, c[:, None], c[None, :]]
            if len(c) == 2:
                stable &= _stable_pair(part)
            else:
                stable[stable] = np.linalg.eigvals(part[stable]).real.max(axis=1) < -1e-9
        stable &= np.cumsum(stable) <= draws - kept
        kept += int(stable.sum())
        x = np.linalg.solve(j[stable], -b[stable][:, :, None])[:, :, 0]
        count += np.stack([(x > 1e-9).sum(axis=0), (x < -1e-9).sum(axis=0), (np.abs(x) <= 1e-9).sum(axis=0)], axis=1)
    return {x: tuple(count[i].tolist()) for x, i in at.items()}


def sampled_signs(arcs: DataFrame, interventions: DataFrame, draws: int = 2_000, seed: int = 1, parts: int = 8, max_nodes: int = 400, unknown: str = "as_minus") -> DataFrame:
    """(iv_id, node, plus, minus, zero) over sampled stable systems of each intervention's cone.

    Draws are dealt out over tasks by (intervention, part), or, of many
    interventions, by the piece of the graph they are on.  A cone of more
    than ``max_nodes`` nodes raises: a draw solves a dense system.
    """
    kind, iv = dict(arcs.dtypes)["src"], dict(interventions.dtypes)["iv_id"]
    arcs = store(arcs.select("src", "dst", "m"), "arcs")
    schema = f"iv_id {iv}, node {kind}, plus long, minus long, zero long"
    near = None
    if not few(interventions):
        # interventions enough for all tasks: each is drawn for where its piece is

        def whole(graph: Compact, _: Compact | None, clamps: dict) -> list[tuple]:
            cone = sorted(graph.cone(clamps)[0])
            if (n := len({x for s, d, _ in cone for x in (s, d)})) > max_nodes:
                raise ValueError(f"a cone of {n} nodes is larger than {max_nodes}")
            out: dict = {}
            for part in range(parts):
                for x, c in monte_carlo(cone, clamps, draws // parts + (part < draws % parts), seed * 1_000 + part, unknown).items():
                    out[x] = tuple(map(sum, zip(out.get(x, (0, 0, 0)), c)))
            return [(x, *c) for x, c in out.items()]

        near, arcs, interventions = by_piece(arcs, interventions, whole, schema, merged=False)
        if interventions is None:
            return near
    own, _ = cones(arcs, interventions)
    size = own.select("iv_id", F.explode(F.array("src", "dst")).alias("node")).groupBy("iv_id").agg(F.count_distinct("node").alias("n")).agg(F.max("n")).first()[0] or 0
    if size > max_nodes:
        raise ValueError(f"a cone of {size} nodes is larger than {max_nodes}")
    rows = own.select("iv_id", "src", "dst", "m", F.lit(False).alias("clamp")).unionByName(interventions.select("iv_id", F.col("node").alias("src"), F.col("node").alias("dst"), F.col("mask").alias("m"), F.lit(True).alias("clamp")))
    dealt = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part, arc = int(pdf.part.iloc[0]), pdf[~pdf.clamp]
        clamps = dict(zip(pdf[pdf.clamp].src.tolist(), pdf[pdf.clamp].m.tolist()))
        arcs = sorted(zip(arc.src.tolist(), arc.dst.tolist(), arc.m.tolist()))
        got = monte_carlo(arcs, clamps, draws // parts + (part < draws % parts), seed * 1_000 + part, unknown)
        return pd.DataFrame([(pdf.iv_id.iloc[0], n, *c) for n, c in got.items()], columns=["iv_id", "node", "plus", "minus", "zero"])

    counts = dealt.groupBy("iv_id", "part").applyInPandas(run, schema)
    if near is not None:
        counts = counts.unionByName(near)
    return counts.groupBy("iv_id", "node").agg(*[F.sum(c).alias(c) for c in ("plus", "minus", "zero")])


def validate(predictions: DataFrame, counts: DataFrame, dominance: float = 0.98) -> DataFrame:
    """(iv_id, node, mask, plus, minus, zero, verdict) of predicted against sampled signs.

    A determinate sign is ``confirmed`` unless the opposite one has more than
    ``1 - dominance`` of the draws (``contradicted``); an undetermined one is
    ``conservative`` where one sign has at least ``dominance`` of the draws, else
    ``warranted``.
    """
    total = F.col("plus") + F.col("minus") + F.col("zero")
    against = F.when(F.col("mask") == 1, F.col("minus")).otherwise(F.col("plus")) / total
    stable = F.greatest("plus", "minus") / total >= dominance
    verdict = F.when(F.col("mask") == 3, F.when(stable, "conservative").otherwise("warranted")).when(against > 1 - dominance, "contradicted").otherwise("confirmed")
    return predictions.join(counts.where(total > 0), ["iv_id", "node"]).select("iv_id", "node", "mask", "plus", "minus", "zero", verdict.alias("verdict"))


#: The derivative sign that each kind of expression gives all arguments; a ratio's depends on the role.
DERIVATIVES = {"sum": "+", "aggregation": "+", "product": "+"}


def derivative_rules(expressions: DataFrame) -> DataFrame:
    """(id, kind, rules, broken) of expressions (id, kind, arguments of (node, role, derivative_sign)), checked exactly."""
    x = expressions.select("id", "kind", F.posexplode("arguments").alias("k", "a"), F.size("arguments").alias("n"))
    fixed = F.coalesce(*[F.when(F.col("kind") == k, F.lit(s)) for k, s in DERIVATIVES.items()])
    role = F.when((F.col("k") == 0) & (F.col("a.role") == "numerator"), "+").when((F.col("k") == 1) & (F.col("a.role") == "denominator"), "-").otherwise("none")
    want = F.when(F.col("kind") == "ratio", role).otherwise(F.coalesce(fixed, F.col("a.derivative_sign")))
    open_ = ~F.coalesce(F.col("a.derivative_sign"), F.lit("")).isin("+", "-")
    bad = (F.coalesce(F.col("a.derivative_sign"), F.lit("")) != want) | ((F.col("kind") == "ratio") & (F.col("n") != 2)) | open_
    return x.groupBy("id", "kind").agg(F.count("*").alias("rules"), F.count_if(bad).alias("broken"))


def realised_modulations(modulations: DataFrame, trials: int = 16) -> DataFrame:
    """(id, trials, failed) of modulations (id, sign): the mixed derivative of a product of both variables, by finite differences at points drawn from a hash, against the declared sign."""
    mu, e = F.when(F.col("sign") == "+", 1.0).otherwise(-1.0), 1e-4
    at = lambda k, what: 0.1 + 9.9 * F.pmod(F.xxhash64("id", k, F.lit(what)), F.lit(1 << 32)) / F.lit(float(1 << 32))

    def fails(k: Column) -> Column:
        x, m = at(k, "x"), at(k, "m")
        f = lambda a, b: mu * (x + a) * (m + b)
        mixed = (f(e, e) - f(e, -e) - f(-e, e) + f(-e, -e)) / (4 * e * e)
        return F.coalesce(sign_of(mixed, 1e-5) != F.col("sign"), F.lit(True)) | F.isnan(mixed)

    failed = F.size(F.filter(F.sequence(F.lit(1), F.lit(trials)), fails)).cast("long")
    return modulations.select("id", F.lit(trials).cast("long").alias("trials"), failed.alias("failed"))


def realised(expressions: DataFrame, trials: int = 16, seed: int = 1) -> DataFrame:
    """(id, kind, trials, failed): finite differences of random realisations against the declared derivative signs.

    General functions are realised as signed linear ones, which shows that the
    declared signs can hold together.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, kind, arguments in zip(pdf.id, pdf.kind, pdf.arguments):
            want = [a["derivative_sign"] for a in arguments]
            rng = np.random.default_rng([seed, *str(key).encode()])
            line = np.array([{"+": 1.0, "-": -1.0}.get(x, 0.0) for x in want])
            fail = 0
            f = {"ratio": lambda v: v[0] / v[1] if len(v) == 2 else 0.0, "sum": np.sum, "aggregation": np.sum, "product": np.prod}.get(kind, lambda v: line @ v)
            for _ in range(trials):
                v = rng.uniform(0.5, 10, len(want))
                got = []
                for i in range(len(v)):
                    up, down = v.copy(), v.copy()
                    up[i] += 1e-5
                    down[i] -= 1e-5
                    slope = float(f(up) - f(down)) / 2e-5
                    got.append("+" if slope > 1e-7 else "-" if slope < -1e-7 else "?")
                fail += got != want
            out.append((key, kind, trials, fail))
        return pd.DataFrame(out, columns=["id", "kind", "trials", "failed"])

    return expressions.select("id", "kind", "arguments").mapInPandas(lambda frames: map(run, frames), f"id {dict(expressions.dtypes)['id']}, kind string, trials long, failed long")
