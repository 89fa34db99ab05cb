"""Trained models against plain loops, pages without marked articles, wrapped licences, other tokenizers, roles and archives."""

import hashlib
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from signflow.llm import chat, decontaminate, langid, licenses, packing, toxicity, warc
from signflow.llm.html import main_text
from signflow.llm.license_texts import TEXTS


def test_ftrl_equals_a_plain_loop():
    rng = np.random.default_rng(4)
    d, langs = 12, ["a", "b", "c"]
    rows = []
    for i in range(40):
        at = np.sort(rng.choice(d, 5, replace=False))
        rows.append((langs[i % 3], at, rng.integers(1, 4, 5)))
    idf = rng.uniform(1, 2, d)
    alpha, beta, l1, l2, epochs = 0.5, 1.0, 0.02, 0.02, 3
    got = langid.fit(rows, idf, epochs=epochs, alpha=alpha, beta=beta, l1=l1, l2=l2, seed=7)
    z, n = [[0.0] * 3 for _ in range(d + 1)], [[0.0] * 3 for _ in range(d + 1)]

    def weight(f, c):
        if abs(z[f][c]) <= l1:
            return 0.0
        return -(z[f][c] - np.sign(z[f][c]) * l1) / ((beta + n[f][c] ** 0.5) / alpha + l2)

    order = np.random.default_rng(7)
    order.permutation(len(rows))
    for _ in range(epochs):
        for i in order.permutation(np.arange(len(rows))):
            lang, at, count = rows[i]
            x = [float(np.log1p(c) * idf[f]) for f, c in zip(at, count)]
            norm = sum(v * v for v in x) ** 0.5
            x = [(int(f), v / norm) for f, v in zip(at, x)] + [(d, 1.0)]
            logit = [sum(v * weight(f, c) for f, v in x) for c in range(3)]
            e = [np.exp(v - max(logit)) for v in logit]
            for c in range(3):
                miss = e[c] / sum(e) - (langs[c] == lang)
                for f, v in x:
                    g = miss * v
                    # the weight before the update enters the sum of gradients
                    w = weight(f, c)
                    z[f][c] += g - ((n[f][c] + g * g) ** 0.5 - n[f][c] ** 0.5) / alpha * w
                    n[f][c] += g * g
    want = np.array([[weight(f, c) for c in range(3)] for f in range(d + 1)])
    assert np.allclose(got.weights, want[:-1]) and np.allclose(got.bias, want[-1])


def test_pu_risk_equals_a_plain_loop():
    rng = np.random.default_rng(2)
    bad, plain = [f"bad{i}xyz" for i in range(3)], [f"w{i}" for i in range(30)]
    positive = [set(rng.choice(plain, 4)) | {bad[i % 3]} for i in range(60)]
    unlabelled = [set(rng.choice(plain, 4)) | ({bad[i % 3]} if i % 10 == 0 else set()) for i in range(300)]
    prior, rounds, l2, rate = 0.1, 60, 3e-5, 0.1
    got = toxicity.fit(positive, unlabelled, prior, rounds=rounds, l2=l2, rate=rate)
    names = list(got.index)
    assert any("bad0xyz" in f for f in names)

    def features(words):
        out = []
        for k, f in enumerate(names):
            c = sum(f in toxicity.word_features(w) for w in words)
            out += [1.0 if c > level else 0.0 for level in range(toxicity.LEVELS)]
        return out

    xp, xu = np.array([features(w) for w in positive]), np.array([features(w) for w in unlabelled])
    live = got.weights != 0
    w, b, m, v = np.zeros(xp.shape[1]), float(np.log(prior / (1 - prior))), np.zeros(xp.shape[1] + 1), np.zeros(xp.shape[1] + 1)
    loss = lambda z: np.log1p(np.exp(z))
    risk_u = lambda w, b: loss(xu @ w + b).mean() - prior * loss(xp @ w + b).mean()
    risk_p = lambda w, b: prior * loss(-(xp @ w + b)).mean()
    for t in range(1, rounds + 1):
        # the gradient by differences: of the whole risk, or, where the corrected part is below zero, of that part turned round
        f = (lambda w, b: risk_p(w, b) + risk_u(w, b)) if risk_u(w, b) >= 0 else (lambda w, b: -risk_u(w, b))
        g = np.zeros(len(w) + 1)
        for i in np.flatnonzero(live):
            e = np.zeros(len(w))
            e[i] = 1e-5
            g[i] = (f(w + e, b) - f(w - e, b)) / 2e-5 + l2 * w[i]
        g[-1] = (f(w, b + 1e-5) - f(w, b - 1e-5)) / 2e-5
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - np.where(live, step[:-1], 0), b - step[-1]
    assert np.allclose(got.weights, w, atol=1e-3)


SENT = "This is a sentence of plain words that goes on for a while, as sentences of articles do. "


def test_sections_of_a_page_without_article_tags():
    one = "".join(f"<p>First {i} {SENT * 3}</p>" for i in range(5))
    two = "".join(f"<p>Second {i} {SENT * 3}</p>" for i in range(3))
    links = "<ul>" + "".join(f"<li><a href=/{i}>Go to {i}</a></li>" for i in range(30)) + "</ul>"
    page = f"<body><div id=top>{links}</div><div id=wrap><section>{one}</section><section>{two}</section></div><div><a href=x>about</a> | <a href=y>terms</a></div></body>"
    lines = main_text(page).split("\n")
    assert [x.split()[:2] for x in lines] == [["First", str(i)] for i in range(5)] + [["Second", str(i)] for i in range(3)]


def test_density_chooses_among_marked_articles():
    teaser = "".join(f"<article><a href=/{i}>Read this next {i}</a></article>" for i in range(6))
    body = "".join(f"<p>{SENT * 4}</p>" for _ in range(6))
    assert main_text(f"<body><div>{teaser}</div><article><h1>Title</h1>{body}</article></body>") == "\n".join(["Title", *[(SENT * 4).strip()] * 6])


def test_names_of_paragraphs_say_nothing_and_comments_go():
    page = f"<body><main><article><p class='share-price notice'>{SENT}</p><p>{SENT * 3}</p><div class='ad'>buy</div></article><section id='comments'><p>{SENT * 9}</p></section></main></body>"
    assert main_text(page) == f"{SENT.strip()}\n{(SENT * 3).strip()}"


@pytest.mark.parametrize("page", ['<a "' * 40_000, "<a b=\"" * 40_000, "</b>" * 60_000, "<b>" * 30_000 + "</i>" * 30_000, "<b>" * 20_000 + "<p>x" * 20_000, "<!--" * 40_000, "<script>" * 30_000, "<" * 200_000])
def test_odd_pages_take_time_in_proportion(page):
    start = time.time()
    main_text(page)
    assert time.time() - start < 5


def test_quoted_brackets_and_comments():
    assert main_text("<p title='a>b'>x<!-- <p>no</p> --> y<!-->z<p>1 < 2 &lt; 3") == "x yz\n1 < 2 < 3"


def test_wrapped_licences_keep_their_digest(spark):
    import textwrap

    rows = []
    for k, (i, titles, text) in enumerate(TEXTS):
        for width in range(40, 121, 8):
            whole = "\n".join(textwrap.wrap(" ".join(text.split()), width, break_long_words=False))
            title = titles[width % len(titles)] if titles else ""
            rows.append((k, i, f"{title}\n\nCopyright (c) 2021 Some Body <a@b.c>\nAll rights reserved.\n\n{whole}\n"))
        rows.append((k, i, "Copyright \u00a9 2020-2024 Some Body. " + " ".join(text.split())))
    docs = spark.createDataFrame([(n, r[2]) for n, r in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan_licenses(docs, licenses.known_licenses(spark)).collect()}
    # the two BSD texts and MIT's title stand for one licence each
    assert [got[n] for n in range(len(rows))] == [r[1] for r in rows]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_of_any_tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    tok, enc = Tokenizer.from_file(path), packing.Encoder(path)
    texts = ["Hello  World", "It's 3.14 o'clock\n\nNow", " lead", "\u4e2d\u6587 caf\u00e9 \U0001f600", ""]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [tok.encode(x, add_special_tokens=False).ids for x in texts]


def test_roles_of_any_characters_read_back(spark):
    t = chat.ChatTemplate()
    roles = ["\x00\x01", "a\\b", "\\", "\\n\n", "b\\bn", "<|im_end|>\\", "[INST]\n\\b"]
    df = spark.createDataFrame([(i, 0, r, r) for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df, t).withColumn("back", chat.read_back(F.col("formatted"), t)).collect()
    assert {r.conv_id: [(x.role, x.text) for x in r.back] for r in out} == {i: [(r, r)] for i, r in enumerate(roles)}


def test_only_letters_make_a_language():
    m = langid.Model(["en"], np.zeros((1 << langid.BITS, 1)), np.zeros(1), np.ones(1 << langid.BITS))
    assert [m.predict(x)[0] for x in ("\u00b2\u00bd", "\u2167", "\u2460", "1 2", "a", "\u00e9", "\u4e2d")] == ["und"] * 4 + ["en"] * 3


def test_rows_that_share_an_id_teach_once(spark):
    rows = [(1, f"hello there friend {i}", "en") for i in range(50)] + [(i, f"guten tag mein freund {i}", "de") for i in range(2, 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(langid.train(docs).langs) <= {"en", "de"}


def test_clean_rows_tells_rows_apart_at_any_size(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    rows = [(1, "x one two three four five six seven y"), (1, "clean text of its own here"), (None, "one two three four five six seven"), (None, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (1_000_000, 0):
        assert sorted(map(str, (tuple(r) for r in decontaminate.clean_rows(docs, items, max_index_words=limit).collect()))) == sorted(map(str, [rows[1], rows[3]]))


def test_archives_are_cut_by_size_and_only_committed_ones_count(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", "x" * 50 + str(i)) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    path = f"file://{tmp_path}/w"
    warc.write_archives(df, path, archive_bytes=1500)
    files = list((tmp_path / "w").glob("*.warc.gz"))
    assert len(files) > 3 and max(f.stat().st_size for f in files) < 2500
    (tmp_path / "w" / "pages-000000-0000-999.warc.gz").write_bytes(warc.member(1, "u", b"of a lost attempt"))
    assert sorted(r.page_id for r in warc.read_archives(spark, path).collect()) == list(range(60))


def test_long_licences_are_known(spark):
    from pathlib import Path

    folder = Path("/usr/share/common-licenses")
    if not folder.is_dir():
        pytest.skip("no licence texts here")
    want = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    texts = {n: (folder / n).read_text(errors="replace") for n in want}
    # without the appendix, in capitals, with other line ends
    cut = {n: t.split("END OF TERMS AND CONDITIONS")[0] for n, t in texts.items() if "END OF TERMS AND CONDITIONS" in t}
    rows = [(n, t) for some in (texts, cut, {n: t.upper() for n, t in texts.items()}, {n: t.replace("\n", "\r\n") for n, t in texts.items()}) for n, t in some.items()]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan_licenses(docs, licenses.known_licenses(spark)).collect()}
    assert {rows[i][0]: x for i, x in got.items()} == want and all(got[i] == want[n] for i, (n, _) in enumerate(rows))


def test_holders_without_a_year(spark):
    mit = next(t for i, t in licenses.known() if i == "MIT" and len(t) > 100)
    docs = [(1, "Copyright Example Corp. and other contributors\n\n" + mit), (2, "// Copyright The Authors\n" + mit), (3, "Copyright notice of ours\n" + mit), (4, "copyright\n" + mit)]
    got = {r.doc_id: r.license_id for r in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"), licenses.known_licenses(spark)).collect()}
    assert got == {1: "MIT", 2: None, 3: None, 4: None}


def foreign(kind, ident, http, body, *more):
    block = http.replace("\n", "\r\n").encode() + b"\r\n\r\n" + body
    head = "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {ident}", f"Content-Length: {len(block)}", *more])
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def test_archives_of_other_writers(spark, tmp_path):
    sha = lambda b: hashlib.sha1(b).hexdigest()
    chunks = b"5\r\nhello\r\n6;x=y\r\n world\r\n0\r\n\r\n"
    data = b"".join([
        foreign("warcinfo", "<urn:uuid:0>", "software: x", b""),
        foreign("response", "<urn:uuid:1>", "HTTP/1.1 200 OK\nTransfer-Encoding: chunked", chunks, "WARC-Payload-Digest: sha1:" + sha(b"hello world")),
        foreign("response", "<urn:uuid:2>", "HTTP/1.1 200 OK\nTransfer-Encoding: gzip, chunked", chunks, "WARC-Payload-Digest: " + warc.b32_sha1(chunks)),
        foreign("response", "<urn:uuid:3>", "HTTP/1.0 200 OK", b"to the end", "WARC-Target-URI: http://x/"),
        foreign("response", "<urn:uuid:4>", "HTTP/1.1 200 OK\nContent-Length: 3", b"abc", "WARC-Payload-Digest: sha256:00"),
        foreign("revisit", "<urn:uuid:5>", "HTTP/1.1 304 Not Modified", b"", "WARC-Refers-To: <urn:uuid:3>"),
        foreign("revisit", "<urn:x-page:6>", "HTTP/1.1 200 OK\nContent-Length: 10", b"", "WARC-Refers-To: <urn:x-page:9>", "WARC-Payload-Digest: " + warc.b32_sha1(b"to the end")),
    ])
    (tmp_path / "far.warc.gz").write_bytes(data)
    got = [tuple(r) for r in warc.read_archives(spark, f"file://{tmp_path}").collect()]
    whole = b"hello world"
    assert got == [
        (None, "response", 11, sha(whole), None, None, "<urn:uuid:1>", None, whole),
        (None, "response", 11, sha(whole), None, None, "<urn:uuid:2>", None, whole),
        (None, "response", 10, sha(b"to the end"), None, "http://x/", "<urn:uuid:3>", None, b"to the end"),
        (None, "response", 3, sha(b"abc"), None, None, "<urn:uuid:4>", None, b"abc"),
        (None, "revisit", None, None, None, None, "<urn:uuid:5>", "<urn:uuid:3>", None),
        (6, "revisit", 10, sha(b"to the end"), 9, None, "<urn:x-page:6>", "<urn:x-page:9>", None),
    ]
    for body, more in ((chunks[:-9], ()), (b"zz\r\n", ()), (chunks, ("WARC-Payload-Digest: sha1:" + sha(b"other"),))):
        with pytest.raises(ValueError):
            list(warc.pages_of([foreign("response", "<a>", "HTTP/1.1 200 OK\nTransfer-Encoding: chunked", body, *more)]))
    with pytest.raises(ValueError):
        list(warc.pages_of([foreign("response", "<a>", "HTTP/1.1 200 OK\nContent-Length: 4", b"abc")]))


def test_archives_are_gzip_once(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", "x" * 2000 + str(i)) for i in range(5)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, f"file://{tmp_path}/w")
    (name,) = (tmp_path / "w").glob("*.warc.gz")
    data, heads = name.read_bytes(), []
    while data:
        unpack = zlib.decompressobj(31)
        heads.append(unpack.decompress(data)[:8])
        data = unpack.unused_data
    assert heads == [b"WARC/1.1"] * 5
