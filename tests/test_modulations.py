"""Modulations and the influences they fit."""

from signflow.operators import gates


def test_modulations_count_influences_without_listing_them(spark, monkeypatch):
    rows = []
    monkeypatch.setattr(gates, "store", lambda df, label: rows.append(df.count()) or df)
    m = spark.createDataFrame([(k, None, 1, 1) for k in range(50)] + [(90, 7, 0, 0), (91, None, 2, 2)], "modulator long, influence_id long, edge_source long, edge_target long")
    i = spark.createDataFrame([(k, 1, 1) for k in range(60)] + [(70, 2, 2)], "id long, source long, target long")
    good, bad = gates.resolved(m, i)
    assert sorted(map(tuple, good.select("modulator", "found").collect())) == [(90, 7), (91, 70)]
    assert {r.message for r in bad.collect()} == {"fits 60 influences"} and bad.count() == 50
    assert rows == [52]
