import pytest

from signflow.sources import scans

FRAGMENT = """name: x
nodes:
- {id: a, label: A, scale: organ}
- {id: b, label: B, scale: organ}
causal_edges:
- {source: a, target: b, sign: '+', mechanism: first}
constitutive_edges:
- {micro: a, macro: b, relation: aggregation, sign: '+'}
"""


def test_fragments_compose_and_the_last_record_counts(spark, tmp_path):
    (tmp_path / "one.yaml").write_text(FRAGMENT)
    (tmp_path / "two.yaml").write_text(FRAGMENT.replace("first", "second"))
    f = scans.read_fragments(spark, [str(tmp_path / "one.yaml"), str(tmp_path / "two.yaml")])
    got = scans.compose(f, ["one.yaml", "two.yaml"])
    assert got["nodes"].count() == 2
    assert [r.mechanism for r in got["causal_edges"].collect()] == ["second"]
    (tmp_path / "three.yaml").write_text(FRAGMENT.replace("label: B", "label: Other"))
    with pytest.raises(ValueError, match="differently"):
        scans.compose(scans.read_fragments(spark, [str(tmp_path)]), [])


def test_obo_terms(spark, tmp_path):
    (tmp_path / "x.obo").write_text('format-version: 1.2\n\n[Term]\nid: X:1\nname: one\nsynonym: "uno" EXACT []\nis_a: X:0 ! root\n\n[Term]\nid: X:2\nname: two\nis_obsolete: true\nreplaced_by: X:1\n\n[Typedef]\nid: p\n')
    got = {r.id: r for r in scans.read_obo(spark, str(tmp_path / "x.obo")).collect()}
    assert set(got) == {"X:1", "X:2"}
    assert got["X:1"].synonyms == ["uno"] and got["X:1"].parents == ["X:0"] and not got["X:1"].obsolete
    assert got["X:2"].obsolete and got["X:2"].replaced_by == "X:1"


def test_records_round_trip_and_fail_closed(spark):
    rows = spark.createDataFrame([("a", 1), ("é\n", 2)], "k string, v long")
    lines = scans.encode_records(rows, "node")
    back = scans.decode_records(lines, "node", "k string, v long")
    assert {tuple(r) for r in back.collect()} == {("a", 1), ("é\n", 2)}
    with pytest.raises(ValueError):
        scans.decode_records(lines.where("seq = 1"), "node", "k string, v long")
    with pytest.raises(ValueError):
        scans.decode_records(lines, "edge", "k string, v long")


def test_sharded_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(50)], "k string, v long")
    scans.write_sharded(rows, "k", str(tmp_path / "out"))
    assert scans.read_sharded(spark, str(tmp_path / "out"), "k string, v long").exceptAll(rows).isEmpty()


def test_turtle_lines(spark):
    out = scans.turtle(spark.createDataFrame([("a b", "c", 2)], "src string, dst string, m int")).collect()
    assert out[0].line.count("<") == 6 and "a%20b" in out[0].line and out[0].line.endswith('"-" .')


def test_catalog_and_checksums(spark, tmp_path):
    nodes = spark.createDataFrame([("b", "B", "organ", None, None), ("a", "A", "organ", None, None)], "id string, label string, scale string, entity_iri string, quality_iri string")
    scans.write_catalog(nodes, str(tmp_path / "cat"))
    back = spark.read.csv(str(tmp_path / "cat/tsv"), sep="\t", header=True).select("id", "label")
    assert not scans.stale(back, nodes.select("id", "label")) and scans.stale(back.limit(1), nodes.select("id", "label"))
    (tmp_path / "in").mkdir()
    for n in "xy":
        (tmp_path / "in" / n).write_text(n)
    sums = {r.path.rsplit("/", 1)[1]: r.sha256 for r in scans.checksums(spark, str(tmp_path / "in")).collect()}
    expected = spark.createDataFrame([("x", sums["x"]), ("y", "0"), ("z", "0")], "name string, sha256 string")
    assert {tuple(r) for r in scans.verify_checksums(spark, str(tmp_path / "in"), expected).collect()} == {("y", "changed"), ("z", "missing")}
