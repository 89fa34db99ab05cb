"""Labels that many rows share are matched once."""

from signflow.operators import reconcile as R

COLUMNS = "id long, label string, entity_iri string, quality_iri string"


def test_equal_labels_do_not_multiply(spark, monkeypatch):
    sizes = []
    best = R._best
    monkeypatch.setattr(R, "_best", lambda df: sizes.append(df.count()) or best(df))
    p = spark.createDataFrame([(1_000 + k, "plasma glucose level", "e", "a" if k % 2 else None) for k in range(40)] + [(2_000, "plasma glucosa level", "x", "b"), (7, "anything", "x", "y")], COLUMNS)
    c = spark.createDataFrame([(k, "plasma glucose level", "f", "b" if k < 30 else "a") for k in range(10, 60)] + [(7, "else", "f", "y")], COLUMNS)
    got = {r.id: (r.status, r.match, r.score) for r in R.classify(p, c).collect()}
    assert all(got[1_000 + k] == ("duplicate", 30 if k % 2 else 10, 0.95) for k in range(40))
    assert got[7] == ("existing", 7, 1.0)
    assert got[2_000][:2] == ("review", 10) and got[2_000][2] > 0.86
    assert max(sizes) <= 80
    want = {k: v for k, v in got.items() if v[0] in ("existing", "duplicate")}
    assert {r.id: (r.status, r.match, r.score) for r in R.sure(p, c).collect()} == want


def test_as_many_matches_as_a_review_has(spark):
    left = spark.createDataFrame([(k, "plasma glucosa level", "b") for k in range(3)], "id long, norm string, quality_iri string")
    c = spark.createDataFrame([(k, "plasma glucose level", "b" if k > 50 else "a") for k in range(10, 60)], "match long, cnorm string, cq string")
    got = sorted((r.id, r.match) for r in R.alike(left, c).collect())
    assert got == [(k, m) for k in range(3) for m in range(51, 56)]
