import numpy as np
import pytest
from pyspark.sql import functions as F

from signflow.llm.common import materialise
from signflow.llm.simhash import shingle_hashes

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        left[name] = docs
        if name != "packing":
            assert docs.columns == columns
    ids = {n: {r[0] for r in d.select("doc_id").collect()} for n, d in left.items()}
    assert ids["toxicity"] >= ids["langid"] >= ids["simhash"] >= ids["decontaminate"] == ids["packing"]
    # of similar documents one stays, and nothing else goes
    texts = dict(tuple(r) for r in left["langid"].select("doc_id", "text").collect())
    sets = {i: shingle_hashes(t.encode(), 5) for i, t in texts.items()}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    order = sorted(sets)
    for k, i in enumerate(order):
        for j in order[k + 1 :]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) > 0:
                both = len(np.intersect1d(a, b, assume_unique=True))
                if both >= 0.8 * (len(a) + len(b) - both):
                    x, y = find(i), find(j)
                    up[max(x, y)] = min(x, y)
    want = {i for i in sets if find(i) == i}
    assert want == ids["simhash"]
    # no benchmark item is left whole
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = [r.text for r in left["decontaminate"].collect()]
    assert not any(item in text for item in items for text in kept)
    assert left["packing"].agg(F.sum("length")).first()[0] == sum(r[0] for r in left["packing"].groupBy("doc_id").agg(F.first("doc_tokens")).select("first(doc_tokens)").collect())


def test_empty_documents_pass_through(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        assert docs.count() == 0


def test_stages_with_nulls_repeats_and_clashing_columns(spark, sf_dir):
    """Every stage takes null ids, texts and languages, shared ids, repeated rows and columns named as its own work columns are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).select("doc_id", "text", "lang", "source", "n_chars")
    some = [r.text for r in docs.collect() if r.lang == "en" and len(r.text) > 200][:2]
    odd = [(None, None, None, None, None), (None, some[0], "en", None, 1), (7, some[1], None, "a", 2), (7, some[1], None, "a", 2), (7, some[0], "en", "b", 3), (8, "", "en", "a", 0), (9, "word " * 30_000, "en", "a", 5)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    extra = ["score", "node", "words", "fp", "rows", "shard", "group", "h", "row", "__keep"]
    docs = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(extra)])
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = materialise(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns, name
        assert docs.exceptAll(before).isEmpty(), name
    # of the repeated rows and the shared text one is left, and its id is the smallest that is not null
    left = [(r.doc_id, r.text) for r in docs.collect()]
    assert sum(t == some[0] for _, t in left) <= 1 and sum(t == some[1] for _, t in left) <= 1
    assert (None, some[0]) not in left and (None, None) not in left
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.where("start = 0").count() == docs.count()
