"""Command line: ``python -m signflow COMMAND MAP ...`` over YAML fragments.

    eval MAP... --spec FILE                 expected signs of a benchmark; exit code 1 on a wrong one
    hpo MAP... --genes FILE --observed FILE forward and backward evaluation of gene lesions
    knockout MAP... --do NODE=SIGN          phenotypes of an intervention
    trace MAP... --do NODE=SIGN --target N  signed paths to a node
    modulation MAP... --do NODE=SIGN        gain changes and synergies
    consistency MAP... --do NODE=SIGN       what all consistent signs agree on
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signflow.functions.signs import MASKS, decode, encode
from signflow.sources.fragments import compose, operational, read_fragments


def _yaml(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def clamps_of(spark: SparkSession, cases: dict[str, dict[str, str]]) -> DataFrame:
    """(iv_id, node, mask) of cases of named signs."""
    return spark.createDataFrame([(c, n, MASKS[str(s)]) for c, do in cases.items() for n, s in do.items()], "iv_id string, node string, mask int")


def determination(tables: dict[str, DataFrame], kinds: DataFrame | None = None) -> DataFrame:
    from signflow.operators.gates import determination_signs, quantity_kinds

    none = tables["nodes"].sparkSession.createDataFrame([], "iri string, kind string")
    return determination_signs(tables["constitutive_edges"], quantity_kinds(tables["nodes"], kinds if kinds is not None else none))


def benchmark(tables: dict[str, DataFrame], spec: dict) -> DataFrame:
    """(iv_id, node, expected, mask, status, critical) of a benchmark's cases; each is solved in its contexts, none without any."""
    from functools import reduce

    from signflow.operators.scoring import score
    from signflow.operators.solve import solve

    spark = tables["nodes"].sparkSession
    groups: dict[tuple, list[dict]] = {}
    for case in spec["interventions"]:
        groups.setdefault(tuple(case.get("contexts") or ()), []).append(case)
    parts = []
    for contexts, cases in groups.items():
        arcs = operational(tables, list(contexts)).select("src", "dst", "m")
        iv = clamps_of(spark, {c["id"]: c["do"] for c in cases})
        parts.append(solve(arcs, iv, determination(tables) if spec.get("multiscale") else None))
    predicted = reduce(DataFrame.unionByName, parts)
    want = [(c["id"], n, MASKS[str(s)], n in (c.get("loop_critical") or ())) for c in spec["interventions"] for n, s in c["expected"].items()]
    expected = spark.createDataFrame(want, "iv_id string, node string, expected int, critical boolean")
    return score(expected, predicted, ["iv_id", "node"])


def _show(df: DataFrame) -> None:
    for row in df.collect():
        print("\t".join("" if x is None else str(x) for x in row))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="signflow", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=["eval", "hpo", "knockout", "trace", "modulation", "consistency"])
    p.add_argument("map", nargs="+")
    p.add_argument("--do", action="append", default=[])
    for name in ("spec", "genes", "observed", "terms", "target"):
        p.add_argument(f"--{name}")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    tables = compose(read_fragments(spark, a.map), a.map)
    arcs = operational(tables).select("src", "dst", "m")
    if a.command == "eval":
        from signflow.operators.scoring import roll_up

        scored = benchmark(tables, _yaml(a.spec)).cache()
        _show(roll_up(scored, "iv_id").orderBy(F.col("iv_id").asc_nulls_last()))
        return int(not scored.where("status = 'wrong'").isEmpty())
    if a.command == "hpo":
        from signflow.operators.scoring import rank_true, roll_up, score
        from signflow.operators.solve import solve

        genes, seen = _yaml(a.genes)["genes"], _yaml(a.observed)["observations"]
        lesions = clamps_of(spark, {g: x["primary"] for g, x in genes.items()})
        predicted = solve(arcs, lesions, determination(tables))
        obs = spark.createDataFrame([(g, n, MASKS[str(s)]) for g, x in seen.items() for n, s in (x.get("observed") or {}).items()], "iv_id string, node string, expected int").join(lesions.select("iv_id", "node"), ["iv_id", "node"], "left_anti")
        _show(roll_up(score(obs, predicted, ["iv_id", "node"]), "iv_id"))
        single = lesions.groupBy("iv_id").agg(F.count("*").alias("n"), F.first("node").alias("node"), F.first("mask").alias("mask")).where("n = 1")
        name = F.concat("node", decode(F.col("mask")))
        pool = lesions.select("node").distinct().withColumn("mask", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("candidate", name)
        solved = solve(arcs, pool.select(F.col("candidate").alias("iv_id"), "node", "mask"), determination(tables)).withColumnRenamed("iv_id", "candidate")
        _show(rank_true(solved, obs.withColumnRenamed("iv_id", "grp"), single.select(F.col("iv_id").alias("grp"), name.alias("candidate")), pool, "grp", "candidate").orderBy("grp"))
        return 0
    iv = clamps_of(spark, {"do": dict(x.rsplit("=", 1) for x in a.do)})
    if a.command == "knockout":
        from signflow.operators.knockout import knockout

        terms = [(t["node"], MASKS[str(t["sign"])], t.get("label") or k, i) for i, (k, t) in enumerate((_yaml(a.terms)["terms"] if a.terms else {}).items())]
        r = knockout(arcs, iv, spark.createDataFrame(terms, "node string, sign int, label string, ord int"), constitutive=determination(tables), nodes=tables["nodes"].select(F.col("id").alias("node")))
        _show(r.errors)
        _show(r.phenotypes.orderBy("in_largest", F.lower("label"), "node").select("node", decode(F.col("mask")), "label"))
        _show(r.affected.orderBy("in_largest", "node").select("node", F.lit("?")))
        return int(not r.errors.isEmpty())
    if a.command == "trace":
        from signflow.operators.traces import traces

        t = traces(arcs, iv, iv.select("iv_id").distinct().withColumn("node", F.lit(a.target)), determination(tables))
        _show(t.select("node", decode(F.col("net")), F.explode("paths")))
        return 0
    if a.command == "modulation":
        from signflow.operators.second_order import gain_changes, interaction_signs, synergies
        from signflow.operators.solve import solve

        mod = tables["modulation_edges"].select("modulator", F.col("edge_source").alias("src"), F.col("edge_target").alias("dst"), encode(F.col("sign")).alias("mu"), F.col("can_flip_sign").alias("can_flip"))
        pred = solve(arcs, iv)
        _show(gain_changes(mod, pred))
        _show(synergies(interaction_signs(mod, arcs), pred))
        return 0
    from signflow.operators.consistency import consistent

    _show(consistent(arcs, iv).orderBy("node").select("node", decode(F.col("mask"))))
    return 0


if __name__ == "__main__":
    sys.exit(main())
