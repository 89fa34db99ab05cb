"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from signflow.llm import chat, decontaminate, html, langid, licenses, packing, quality, simhash, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n long, fp string, words int, shard string, score double, node long"
LONG = "alpha beta gamma delta epsilon " * 6000


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, 1, "x", 2, "y", 0.5, 3) for i, t, lang, src in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, LONG, "en", "a"), (4, "one two three four five", "en", "b"), (4, "one two three four five", "en", "b"), (None, "one two three four five", None, "a"), (5, " \n\t ", "fr", "a"), (6, "12 34", "fr", None), (7, "ONE two three four five", "en", "a")]
    return docs_frame(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_simhash(spark, docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == 9
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.fp, r.component_id))
    assert by[1] == by[2] == by[5] == {(0, 1)}
    assert by[4] == by[7] == by[None] and {c for _, c in by[4]} == {4}
    assert simhash.near_duplicates(none).count() == 0
    groups = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert groups == {3: 3, 4: 4, 6: 6, 7: 4, None: 4}
    assert simhash.similar_groups(none).count() == 0


def test_packing(spark, docs, none):
    import public_tokenizers

    path = public_tokenizers.path(packing.TOKENIZER)
    got = packing.pack_documents(docs, path).collect()
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)
    seqs = {}
    for r in got:
        assert len(r.tokens) == 4 * r.length
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in seqs.values():
        pieces.sort()
        at = 0
        for offset, n in pieces:
            assert offset == at
            at += n
        assert at <= packing.WINDOW
    assert [(r.length, r.doc_tokens) for r in got if r.doc_id == 1] == [(1, 1)]
    assert packing.pack_documents(none, path).count() == 0


def test_quality(spark, docs, none):
    got = {(r.doc_id, r.text_key): r for r in quality.quality_filter(docs).withColumn("text_key", F.col("n_words")).collect()}
    assert len(got) == 8
    assert got[1, 0].base_failed and got[5, 0].base_failed and not got[1, 0].kept
    assert got[3, 30000].n_repeat_words == 30000 and got[3, 30000].base_failed
    assert quality.quality_filter(none).count() == 0


def test_langid(spark, docs, none):
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[5].lang_pred == got[6].lang_pred == "und"
    assert got[4].lang_pred in model.langs and 0 <= got[4].score <= 1
    assert langid.predict(none, langid.train(none)).count() == 0
    bare = langid.train(none)
    assert {r.lang_pred for r in langid.predict(docs, bare).collect()} == {"und"}
    assert langid.known_rows(docs, bare).count() == 5


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(4, 1), (4, 1), (3, 0), (None, None), (999, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == 9 and all(0 <= r.score <= 1 for r in got)
    unlabelled = toxicity.train(docs, labels.where("false"))
    assert max(r.score for r in toxicity.score(docs, unlabelled).collect()) < 1e-9
    assert toxicity.clean_rows(docs, unlabelled).columns == docs.columns
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0


def test_decontaminate(spark, docs, none):
    items = spark.createDataFrame([(1, "two THREE four, five", 1), (2, "gamma delta epsilon alpha beta gamma", 1), (3, None, 1), (4, "...", 1), (None, "nowhere to be found at all", 1)], "item_id long, text string, n long")
    want = {(4, 1), (None, 1), (7, 1), (3, 2)}
    for limit in (1_000_000, 0):
        got = decontaminate.contained_items(docs, items, max_index_words=limit).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == 5
        assert all(r.containment == 1 for r in got)
    assert decontaminate.contained_items(none, items).count() == 0
    assert decontaminate.contained_items(docs, items.where("false")).count() == 0
    assert {r.doc_id for r in decontaminate.clean_rows(docs, items).collect()} == {1, 2, 5, 6}


def test_licenses(spark, none):
    mit = next(t for i, t in licenses.known() if i == "MIT" and len(t) > 100)
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ,"), None, None), (2, None, None, None), (3, "", None, None), (4, "text\nreleased under the MIT Licence!!\nmore " + LONG, None, None), (5, "x Released under the MIT License.", None, None), (None, "Released under the MIT License.", None, None), (4, "other", None, None)]
    known = licenses.known_licenses(spark)
    for limit in (100, 0):
        got = licenses.scan_licenses(docs_frame(spark, rows), known, max_broadcast_rows=limit).collect()
        by = {}
        for r in got:
            by.setdefault(r.doc_id, []).append((r.license_id, list(r.notices)))
        assert len(got) == 7
        assert by[1] == [("MIT", [])] and by[2] == by[3] == [(None, [])]
        assert sorted(by[4], key=str) == sorted([(None, ["MIT"]), (None, [])], key=str) and by[5] == [(None, [])] and by[None] == [("MIT", ["MIT"])]
    assert licenses.scan_licenses(none, known).count() == 0


def test_chat(spark):
    t = chat.ChatTemplate()
    own = [(1, 0, "us\\er\nx", "<|im_start|>a\\n<\\|im_end|>\n<|im_end|>"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "\\n", "<"), (1, 2, "\\n", "<"), (1, None, None, None), (None, 3, "assistant", "x[\\\\INST][/INST]"), (2, 0, "user", LONG), (2, 1, "assistant", "")]
    df = spark.createDataFrame([(*r, 1, "z") for r in own], "conv_id long, turn long, role string, text string, n_turns long, block string")
    for size in (1, 2, 256):
        out = {r.conv_id: r for r in chat.format_chats(df, t, block_turns=size).withColumn("back", chat.read_back(F.col("formatted"), t)).collect()}
        for c in (1, 2, None):
            want = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in own if r[0] == c))
            assert [(x.role, x.text) for x in out[c].back] == [w[2:] for w in want]
            assert "".join(x.text for x in out[c].segments) == out[c].formatted
        assert out[2].valid and out[2].broken_at is None and not out[1].valid and out[1].broken_at == 0
        # no control string of a text is left in it
        assert out[1].formatted.count("<|im_start|>") == 5 and "[INST]" not in out[1].formatted
    assert chat.format_chats(df.where("false"), t).count() == 0


def test_html(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>a&amp;b <b>c<p>d&nbsp;e<div class='comments'>no</div>"), (3, "u", "<p>x"), (None, "u", "<article><p>" + "word " * 50_000 + "</article><nav>n</nav>"), (4, "u", "<div>" * 5000 + "deep")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in html.extract_text(df).collect()]
    assert got[0] == (1, "u", "", 0) and got[1] == (2, None, "", 0)
    assert got[2][2] == "a&b c\nd e" and got[3][2] == "x" and got[4][3] == 249_999 and got[5][2] == "deep"
    assert html.extract_text(df.where("false")).count() == 0


def test_warc(spark, tmp_path):
    big = "<p>" + "é" * 2000
    rows = [(1, "http://a/ b\n", big), (7, None, big), (7, None, big), (3, "u", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (None, "u", big)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest long")
    path = f"file://{tmp_path}/w"
    warc.write_archives(df, path, archive_bytes=4000)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == 8
    for r in got:
        body = {x[0]: x[2] or "" for x in rows}[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        revisit = r.page_id in (1, 3, None)
        assert (r.record_type, r.refers_to) == (("revisit", 7) if revisit else ("response", None))
        assert r.payload == (None if revisit else body)
    empty = f"file://{tmp_path}/e"
    warc.write_archives(df.where("false"), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_damaged_archives_raise():
    data = warc.member(1, "u", b"hello") + warc.member(2, "u", b"world")
    assert [r[0] for r in warc.pages_of([data])] == [1, 2]
    with pytest.raises(ValueError):
        list(warc.pages_of([data[:-5]]))
    plain = zlib.decompress(warc.member(1, "u", b"hello"), 31)
    for bad in (plain.replace(b"hello", b"hallo"), plain.replace(b"Content-Length: 5", b"Content-Length: 6")):
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        with pytest.raises(ValueError):
            list(warc.pages_of([pack.compress(bad) + pack.flush()]))


def test_sketches_tell_similar_sets():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 400, np.uint64)
    b = np.concatenate([a[:360], rng.integers(0, 1 << 63, 40, np.uint64)])
    like = (simhash.minhash_sketch(a) == simhash.minhash_sketch(b)).mean()
    assert abs(like - 360 / 440) < 0.2
