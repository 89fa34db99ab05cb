import pytest

from signflow.plans import registry
from tests.oracle import connect, same

#: A minute even on the smallest tables; test_solve holds the same way to solve against the others.
SLOW = {"solve_by_levels"}


@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql()) - SLOW))
def test_query_equals_its_sql(spark, sf_dir, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    same(got, connect(sf_dir).sql(registry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", ["solve_exact", "asp_cautious", "consistency_comparison", "abduction", "sign_permutation_null", "rewired_null", "term_candidates", "reconcile"])
def test_queries_without_sql_run(spark, sf_dir, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    assert len(got)
    if name == "consistency_comparison":
        assert got.flipped[0] == 0


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_asp_parts_agrees_with_what_is_reachable(spark, sf_dir):
    from signflow.operators.reach import signed_reach
    from signflow.sources import derived as D

    got = {(r.iv_id, r.node): r.mask for r in registry.queries()["asp_parts"](spark, sf_dir).collect()}
    reach = {(r.iv_id, r.node): r.mask for r in signed_reach(D.arcs(spark, sf_dir), D.seeds(spark, sf_dir)).collect()}
    assert got and set(got) <= set(reach) and all(m == 3 or m & reach[k] for k, m in got.items())


def test_rewired_guarded_keeps_degrees_and_scales(spark, sf_dir):
    from signflow.operators.gates import cross_scale_cycle
    from signflow.plans.graph_queries import _constitutive
    from signflow.sources import derived as D

    got, arcs = registry.queries()["rewired_guarded"](spark, sf_dir).cache(), D.flow(spark, sf_dir)
    for columns in (("src", "m"), ("dst",)):
        assert rows(got, *columns) == rows(arcs, *columns)
    assert rows(got, "src", "dst") != rows(arcs, "src", "dst")
    assert cross_scale_cycle(got, _constitutive(spark, sf_dir)).isEmpty()


def test_sampled_systems_contradict_no_solved_sign(spark, sf_dir):
    got = registry.queries()["numeric_validate"](spark, sf_dir).groupBy("verdict").count().collect()
    n = {r.verdict: r["count"] for r in got}
    assert n["confirmed"] > 500 and "contradicted" not in n


def test_linked_components_by_joins_and_in_one_task(spark, sf_dir):
    from signflow.operators.solve import components_of
    from signflow.sources import derived as D

    one = rows(registry.queries()["scc_linked"](spark, sf_dir), "node", "scc")
    assert one == rows(components_of(D.linked(spark, sf_dir), max_arcs=0), "node", "scc")
    sizes = {}
    for _, c in one:
        sizes[c] = sizes.get(c, 0) + 1
    assert max(sizes.values()) > 16


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry_module_imports():
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries())
