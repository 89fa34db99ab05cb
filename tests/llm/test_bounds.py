"""What reaches the driver stays within bytes, whatever the texts' lengths and the number of rows."""

from pyspark.sql import functions as F

from signflow.llm import decontaminate, langid, toxicity
from signflow.llm.common import within_bytes


def test_the_first_rows_that_fit(spark):
    df = spark.createDataFrame([(i, "x" * (i % 5)) for i in range(50)], "k long, t string")
    size, order = F.length("t"), F.col("k") % 7
    assert within_bytes(df, size, order, 100).count() == 50
    kept = [r.k for r in within_bytes(df, size, order, 40).collect()]
    assert sum(k % 5 for k in kept) <= 40 < sum(k % 5 for k in kept) + 5
    assert max(k % 7 for k in kept) <= min(k % 7 for k in range(50) if k not in kept)
    assert within_bytes(df, size, order, 0).where("t <> ''").isEmpty()


def test_many_items_are_not_collected(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "other")], "doc_id long, text string")
    known = spark.createDataFrame([(7, "two three four five six")], "item_id long, text string")
    none = spark.range(30_000).select(F.col("id").alias("item_id"), F.lit(None).cast("string").alias("text"))
    blank = none.withColumn("text", F.lit("..."))
    taken = []
    monkeypatch.setattr(decontaminate.Index, "__init__", lambda self, rows, words, threshold, old=decontaminate.Index.__init__: (taken.append(len(rows)), old(self, rows, words, threshold))[1])
    for items, most in ((known.unionByName(none), 1), (known.unionByName(blank), 0)):
        taken.clear()
        got = decontaminate.contained_items(docs, items, max_index_words=100_000)
        assert [(r.doc_id, r.item_id) for r in got.collect()] == [(1, 7)] and len(taken) == most and max(taken, default=1) == 1
        assert [r.doc_id for r in decontaminate.clean_rows(docs, items, max_index_words=100_000).collect()] == [2]


def test_samples_give_way_to_long_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole = langid.train(docs)
    small = langid.train(docs, max_bytes=150_000)
    assert len(small.langs) > 1 and set(small.langs) <= set(whole.langs)
    right = [r for r in langid.predict(docs, small).join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'").collect()]
    right = [r for r in right if r.lang in small.langs]
    assert sum(r.lang == r.lang_pred for r in right) > 0.8 * len(right)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for most in (0, 20_000):
        model = toxicity.train(docs, labels, max_bytes=most)
        assert all(0 <= r.score <= 1 for r in toxicity.score(docs, model).collect())


def test_whole_samples_are_the_same(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    a, b = toxicity.train(docs, labels), toxicity.train(docs, labels, max_bytes=1 << 40)
    assert a.index == b.index and (a.weights == b.weights).all()
    c, d = langid.train(docs), langid.train(docs, max_bytes=1 << 40)
    assert c.langs == d.langs and (c.weights == d.weights).all() and c.temperature == d.temperature
