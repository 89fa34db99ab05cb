"""Operational arcs with all that is known of them, licensed groupings, first owners and paradoxes, by hand."""

import pytest

from signflow.operators import alignment, gates
from signflow.sources import fragments as M


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def a_map(spark):
    edge = lambda i, s, t, sign, ctx=None, mech=None, ev=None, ce=None, d=False: (i, s, t, sign, ctx, ctx and ctx.upper(), ctx and "state", mech, ev, ce, d)
    q = "kind string, result string, arguments array<struct<node: string, role: string, derivative_sign: string>>, mechanism string, evidence string"
    return {
        "causal_edges": frame(spark, M.CAUSAL, edge("i2", "a", "b", "+", None, "m", "e1", "perturbation"), edge("i1", "a", "b", "+", "fed", "m", "e2"), edge("i3", "b", "c", "-", "fed", "", None, "perturbation", True), edge("i4", "c", "d", "+", None, "x"), edge("i5", "c", "d", "-", None, "x")),
        "production_edges": frame(spark, M.PRODUCTION, ("a", "b", "-", "pe", "pm", None), ("p", "c", "+", "pe", "", "ev")),
        "quantitative_definitions": frame(spark, q.replace("node: ", "node ").replace("role: ", "role ").replace("sign: ", "sign "), ("ratio", "c", [("p", "numerator", "+"), ("z", "denominator", "-")], None, "def")),
    }


def test_operational_records(spark):
    got = {(r.src, r.dst): r for r in M.operational_records(a_map(spark)).collect()}
    r = got["a", "b"]
    assert (r.m, r.kind, r.ambiguous, r.definitional, r.mechanism, r.evidence, r.causal_evidence, r.influence_id, r.influence_ids) == (1, "causal-influence", False, False, "m", None, "perturbation", None, ["i1", "i2"])
    assert [x.id for x in r.contexts] == ["fed"] and [(x.id, x.sign, x.context) for x in r.parallel] == [("i1", "+", "fed"), ("i2", "+", None)]
    r = got["b", "c"]  # a contextual influence alone is open
    assert (r.m, r.ambiguous, r.definitional, r.mechanism, r.influence_id) == (3, True, True, None, "i3")
    r = got["c", "d"]
    assert (r.m, r.ambiguous, r.mechanism, r.contexts) == (3, True, "x", [])
    r = got["p", "c"]  # production comes before quantities
    assert (r.m, r.kind, r.production_evidence, r.mechanism, r.evidence, r.influence_ids) == (1, "production-derived", "pe", None, "ev", None)
    r = got["z", "c"]
    assert (r.m, r.kind, r.definitional, r.mechanism, r.quantitative_kind, r.quantitative_role) == (2, "quantitative-derived", True, "ratio identity (c)", "ratio", "denominator")
    assert len(got) == 5
    # in the regime of the context its influences count, and without the layers theirs are gone
    fed = {(r.src, r.dst): (r.m, r.ambiguous) for r in M.operational_records(a_map(spark), ["fed"], ()).collect()}
    assert fed == {("a", "b"): (1, False), ("b", "c"): (2, False), ("c", "d"): (3, True)}
    # the same arcs as without the records
    plain = {(r.src, r.dst): (r.m, r.kind, r.definitional) for r in M.operational(a_map(spark)).collect()}
    assert plain == {k: (r.m, r.kind, r.definitional) for k, r in got.items()}


def test_licensed_groupings(spark):
    steps = frame(spark, "part string, whole string", ("lobule", "lobe"), ("lobe", "liver"), ("wall", "heart"))
    node = lambda i, e, c, q, k, o: (i, e, c, q, k, o)
    nodes = frame(spark, "id string, entity string, context string, quality string, kind string, occurrent boolean",
        node("mass-liver", "liver", None, "mass", "extensive", False), node("mass-lobe", "lobe", None, "mass", "extensive", False), node("mass-lobule", "lobule", "liver", "mass", "extensive", False), node("mass-again", "liver", None, "mass", "extensive", False),
        node("pressure-heart", "heart", None, "pressure", "intensive", False), node("pressure-wall", "wall", None, "pressure", "intensive", False), node("mass-heart", "heart", None, "mass", "extensive", False), node("rate-of-thing", "liver", None, "flow", "rate", False),
        node("making-liver", "synthesis", "liver", "rate", "rate", True), node("making-lobe", "synthesis", "lobe", "rate", "rate", True), node("decay-lobule", "decay", "lobule", "rate", "rate", True), node("no-site", "synthesis", None, "rate", "rate", True), node("no-quality", "lobe", None, None, "extensive", False))
    got = {(r.mode, r.entity, r.whole, r.quality): r.members for r in gates.licensed_groupings(nodes, steps).collect()}
    assert got == {
        ("continuant", "liver", "liver", "mass"): ["mass-again", "mass-lobe", "mass-lobule"],
        ("continuant", "lobe", "lobe", "mass"): ["mass-lobe", "mass-lobule"],
        ("process", "synthesis", "liver", "rate"): ["making-liver", "making-lobe"],
    }


def test_first_owner_and_paradoxes(spark):
    rows = frame(spark, "id string, path string, ord int", ("a", "z", 1), ("a", "y", 1), ("a", "b", 2), ("c", "q", 5))
    assert {tuple(r) for r in M.first_owner(rows, "id", "path", "ord").collect()} == {("a", "y"), ("c", "q")}
    pairs = frame(spark, "iv_id string, node string, expected int", ("d", "x", 1), ("d", "y", 2), ("d", "z", 1))
    solved = frame(spark, "iv_id string, node string, mask int", ("d", "x", 1), ("d", "y", 3))
    arcs, clamp = frame(spark, "src string, dst string, m int", ("t", "x", 2), ("t", "y", 2), ("x", "z", 1)), frame(spark, "iv_id string, node string, mask int", ("d", "t", 1))
    got = {r.node: (r.solved, r.one_hop, r.resolved) for r in alignment.paradoxes(pairs, solved, arcs, clamp).collect()}
    assert got == {"x": (1, 2, True), "y": (3, 2, False), "z": (None, None, False)}


def test_a_manifest_as_one_document(spark, tmp_path):
    whole = frame(spark, "schema_version string, name string, description string, projection_version string", ("1", 'a "name"', "é", "1.2.0"))
    nodes = frame(spark, "id string, label string", *[(f"n{i}", f", {i}" if i % 2 else None) for i in range(30)])
    none = frame(spark, "id string")
    tables = {"manifest": whole, "nodes": nodes} | {k: none for k in ("influences", "production_relations", "constitutive_constraints", "quantitative_expressions", "modulation", "projection_traces")}
    M.write_manifest_document(tables, f"file://{tmp_path}/doc")
    got = M.read_manifest(spark, f"file://{tmp_path}/doc")
    assert {(r.id, r.label) for r in got["nodes"].collect()} == {tuple(r) for r in nodes.collect()}
    assert tuple(got["manifest"].first()) == tuple(whole.first()) and got["influences"].isEmpty()
    with pytest.raises(ValueError, match="signflow.manifest"):
        M.read_manifest(spark)
