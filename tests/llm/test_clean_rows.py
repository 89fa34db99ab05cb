"""Rows without test items, by the broadcast index and by the join beyond it."""

from signflow.llm import decontaminate


def test_rows_are_judged_one_by_one(spark):
    dirty = "so one two three four five six"
    rows = [(None, dirty), (None, "nothing of it here"), (1, dirty), (1, "a clean row of the same id"), (2, None), (3, dirty), (4, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, "one two three four five six")], "item_id long, text string")
    want = sorted((r for r in rows if r[1] != dirty), key=str)
    for limit in (1_000_000, 0):
        out = decontaminate.clean_rows(docs, items, max_index_words=limit)
        assert out.columns == docs.columns
        assert sorted((tuple(r) for r in out.collect()), key=str) == want
