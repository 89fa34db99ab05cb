"""Sources called from SQL, and rewiring whose every exchange is guarded."""

import random
import zipfile

import pytest

from signflow.operators import gates, nulls
from signflow.sources.table_functions import register

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def book(path, *sheets):
    with zipfile.ZipFile(path, "w") as z:
        for k, rows in enumerate(sheets):
            body = "".join(f'<row r="{i + 1}">' + "".join(f'<c r="{"ABC"[j]}{i + 1}" t="inlineStr"><is><t>{x}</t></is></c>' for j, x in enumerate(r) if x is not None) + "</row>" for i, r in enumerate(rows))
            z.writestr(f"xl/worksheets/sheet{k + 1}.xml", f"<worksheet {NS}><sheetData>{body}</sheetData></worksheet>")


def test_workbooks_by_sql(spark, tmp_path):
    (tmp_path / "books").mkdir()
    book(tmp_path / "books/a.xlsx", [["id", "name"], ["1", "x"], [None, "y"]], [["name", "id"], ["z", "2"]])
    book(tmp_path / "books/b.xlsx", [["id", "other", "name"], ["3", "o", "w"]])
    register(spark)
    files = f"table(select path, content from binaryFile.`file://{tmp_path}/books`) partition by (path)"
    rows = spark.sql(f"select substring_index(path, '/', -1) as f, sheet, row, cells['A'] as a from xlsx_rows({files})").collect()
    assert {(r.f, r.sheet, r.row, r.a) for r in rows} == {("a.xlsx", 1, 1, "id"), ("a.xlsx", 1, 2, "1"), ("a.xlsx", 1, 3, None), ("a.xlsx", 2, 1, "name"), ("a.xlsx", 2, 2, "z"), ("b.xlsx", 1, 1, "id"), ("b.xlsx", 1, 2, "3")}
    # with names the columns are others
    named = spark.sql(f"select * from xlsx_rows({files}, 'id', 'name')")
    assert named.columns == ["path", "sheet", "row", "id", "name"]
    assert {(r.sheet, r.id, r.name) for r in named.collect()} == {(1, "1", "x"), (1, None, "y"), (2, "2", "z"), (1, "3", "w")}
    with pytest.raises(Exception, match="no columns"):
        spark.sql(f"select * from xlsx_rows({files}, 'nope')").collect()
    with pytest.raises(Exception, match="path and content"):
        spark.sql("select * from xlsx_rows(table(select 1 as x))").collect()


def test_fragments_by_sql(spark, tmp_path):
    (tmp_path / "maps").mkdir()
    (tmp_path / "maps/a.yaml").write_text("nodes:\n- {id: a, entity: 'UBERON:1'}\n- {id: b}\nedges:\n- {from: a, to: b, effect: increases, context: Fed State}\nratio_definitions:\n- {ratio: b, numerator: a, denominator: c}\n")
    (tmp_path / "maps/b.yaml").write_text("name: empty\n")
    register(spark)
    files = f"table(select * from binaryFile.`file://{tmp_path}/maps`) partition by (path)"
    nodes = spark.sql(f"select * from fragment_records({files}, 'nodes')")
    assert [(r.place, r.id, r.entity_iri, r.exogenous) for r in nodes.orderBy("place").collect()] == [(0, "a", "UBERON:1", False), (1, "b", None, False)]
    edges = spark.sql(f"select source, target, sign, context from fragment_records({files}, 'causal_edges')").collect()
    assert [tuple(r) for r in edges] == [("a", "b", "+", "fed-state")]
    q = spark.sql(f"select kind, x.node, x.role from fragment_records({files}, 'quantitative_definitions') lateral view explode(arguments) t as x").collect()
    assert {tuple(r) for r in q} == {("ratio", "a", "numerator"), ("ratio", "c", "denominator")}
    with pytest.raises(Exception, match="collections"):
        spark.sql(f"select * from fragment_records({files}, 'nope')").collect()


def degrees(rows):
    out, into = {}, {}
    for r in rows:
        out.setdefault(r.src, []).append(r.m)
        into[r.dst] = into.get(r.dst, 0) + 1
    return {k: sorted(v) for k, v in out.items()}, into


def test_no_exchange_closes_a_cycle_across_scales(spark):
    # organs above cells above molecules; feedback within a scale, causes from below
    rng = random.Random(6)
    scale = {f"n{i}": i % 3 for i in range(60)}
    names = sorted(scale)
    arcs = {(a, b) for a, b in ((rng.choice(names), rng.choice(names)) for _ in range(400)) if a != b and scale[a] <= scale[b]}
    arcs = [(a, b, rng.choice([1, 2])) for a, b in sorted(arcs)]
    parts = [(a, b) for a, b in ((rng.choice(names), rng.choice(names)) for _ in range(60)) if scale[a] < scale[b]]
    df = spark.createDataFrame(arcs, "src string, dst string, m int")
    con = spark.createDataFrame(parts, "micro string, macro string")
    level = {r.node: r.level for r in nulls.scale_order(df, con).collect()}
    assert all(level[a] <= level[b] for a, b, _ in arcs) and all(level[a] < level[b] for a, b in parts)
    free = nulls.rewired(df, 1, rounds=4)
    assert not gates.cross_scale_cycle(free.select("src", "dst"), con).isEmpty()  # unguarded, a cycle comes about
    got = nulls.rewired(df, 2, rounds=4, acyclic=con)
    for k in (0, 1):
        one = got.where(f"replicate = {k}").cache()
        rows = one.collect()
        assert degrees(rows) == degrees(df.collect()) and len({(r.src, r.dst) for r in rows}) == len(arcs)
        assert sum((r.src, r.dst) not in {(a, b) for a, b, _ in arcs} for r in rows) > 100
        assert gates.cross_scale_cycle(one.select("src", "dst"), con).isEmpty()
        assert all(level[r.src] <= level[r.dst] for r in rows)
    with pytest.raises(ValueError, match="within a causal component"):
        nulls.scale_order(spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, m int"), spark.createDataFrame([("a", "b")], "micro string, macro string"))
    with pytest.raises(ValueError, match="cycle"):
        nulls.scale_order(spark.createDataFrame([("b", "a", 1)], "src string, dst string, m int"), spark.createDataFrame([("a", "b")], "micro string, macro string"))
