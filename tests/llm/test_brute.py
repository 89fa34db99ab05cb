"""Every operator's driver query against SQL, brute force, a round trip or held-out labels."""

import collections
import hashlib
import html as htmllib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql.functions import expr as F_expr

from signflow.llm import html, registry, simhash
from tests.oracle import connect, same


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    same(registry.queries()[name](spark, sf_dir).toPandas(), connect(sf_dir).sql(registry.oracle_sql()[name]).df())


def test_op1_reads_back_every_turn(spark, sf_dir):
    got = registry.queries()["op1_chat"](spark, sf_dir).toPandas().set_index("conv_id")
    own = "</s>[INST] ok [/INST]"
    turns = collections.defaultdict(list)
    for c, t, role, text in [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()] + [(-1, 0, "user", own), (-1, 1, "assistant", own)]:
        turns[c].append((t, role or "", text or ""))
    assert set(turns) == set(got.index)
    for c, rows in turns.items():
        rows.sort()
        told = "".join(f"{r}\n{t}\n" for _, r, t in rows)
        loss = "".join(t for _, r, t in rows if r == "assistant")
        g = got.loc[c]
        assert (g.n_turns, g.turns_sha256) == (len(rows), hashlib.sha256(told.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_op2_holds_every_id_once_with_little_padding(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = registry.queries()["op2_packing"](spark, sf_dir).toPandas()
    texts = dict(tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    for doc, rows in got.sort_values("start").groupby("doc_id"):
        ids = tok.encode(texts.pop(doc) or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in rows.itertuples():
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert not texts
    sizes = got.groupby("sequence_id").length.sum()
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes)
    assert sizes.max() <= 2048 and padding <= 0.01 * 2048 * len(sizes)


def test_encoder_equals_the_tokenizer_on_odd_texts():
    import random

    import public_tokenizers

    from signflow.llm.packing import Encoder

    enc = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(1)
    pool = "abcABCéÉßßÿ'''st.,!_-²½½ İıΣς́é <|endoftext|>\x1c\x85  中文 12٣ re'll\t\n\x0b"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["a<|endoftext|>b", "it's'S 'RE we'Re''s"]
    assert enc.encode(texts) == [enc._whole(t) for t in texts]


def test_each_word_of_a_batch_is_looked_up_once(monkeypatch):
    import public_tokenizers
    import pyarrow as pa

    from signflow.llm import packing

    enc = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Hello hello,  HELLO!? hello.", "\u00dcber \u00fcber: hello;\n", "", "x1 (hello)"]
    assert enc.encode(texts) == [enc._whole(t) for t in texts]
    # words of letters share what is kept, whatever their case and stops
    assert set(enc.words) == {"", "hello", ",", "!?", ".", "\u00fcber", ":", ";", "x1", "(hello)"}
    # what is kept is bounded within a text, too
    monkeypatch.setattr(packing, "CACHE_WORDS", 100)
    enc._forget()
    many = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}a{i % 7}" for i in range(600))
    assert enc.encode([many, many]) == [enc._whole(many)] * 2
    assert len(enc.words) + len(enc.words.older) <= 100 and len(enc.parts) + len(enc.parts.older) <= 100
    # texts are encoded in slices of bounded bytes
    batch = pa.RecordBatch.from_arrays([pa.array(["aa", None, "b" * 9, "", "cc", "dd"])], names=["t"])
    assert [b.column(0).to_pylist() for b in packing.chunks(batch, 0, 4)] == [["aa", None], ["b" * 9], ["", "cc", "dd"]]


def test_op4_fingerprints_by_sql_functions(spark, sf_dir):
    """Spark's own hash, whose seed is 42 too, over shingles made by SQL functions."""
    import pyspark.sql.functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("t"))
    w = F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    h = docs.select("doc_id", w.alias("w")).select("doc_id", F.expr("case when size(w) = 0 then array() when size(w) < 4 then array(xxhash64(array_join(w, ' '))) else transform(sequence(1, size(w) - 3), i -> xxhash64(array_join(slice(w, i, 4), ' '))) end").alias("h"))
    bits = h.select("doc_id", *[F.expr(f"size(h) > 0 and 2 * size(filter(h, x -> shiftrightunsigned(x, {k}) & 1 = 1)) > size(h)").alias(f"b{k}") for k in range(64)])
    want = {r.doc_id: sum(r[f"b{k}"] << k for k in range(64)) for r in bits.collect()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in registry.queries()["op4_simhash"](spark, sf_dir).collect()} == want


def test_op4_components_by_all_pairs(spark, sf_dir):
    got = registry.queries()["op4_simhash"](spark, sf_dir).toPandas()
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in got.itertuples()} == {i: simhash.fingerprint_bytes(t.encode()) for i, t in texts}
    up = {i: i for i in got.doc_id}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    fps = [(r.doc_id, int(r.fingerprint, 16)) for r in got.itertuples()]
    for k, (i, a) in enumerate(fps):
        for j, b in fps[k + 1 :]:
            if (a ^ b).bit_count() <= 4:
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    assert {r.doc_id: r.component_id for r in got.itertuples()} == {i: find(i) for i in up}


def test_tree_finds_every_link_of_dense_and_sparse_fingerprints(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 60, np.uint64)
    near = [b ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 6), replace=False))) for b in base for _ in range(30)]
    fp = np.unique(np.array(near + list(rng.integers(0, 1 << 63, 500, np.uint64)), np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    from signflow.llm.components import components

    roots = {r.node: r.root for r in components(simhash.near_links(df, 4, shard_rows=100, block_rows=60)).collect()}
    up = {int(x): int(x) for x in fp.view(np.int64)}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp[i] ^ fp[i + 1 :]) <= 4):
            a, b = find(int(fp.view(np.int64)[i])), find(int(fp.view(np.int64)[i + 1 + j]))
            up[max(a, b)] = min(a, b)
    assert {x: roots.get(x, x) for x in up} == {x: find(x) for x in up}


def test_components_of_chains_and_stars(spark):
    from signflow.llm.components import components

    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (7, 6), (7, 6)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, **{1000 + i: 1000 for i in range(1, 300)}}


def test_quality_sketches_beyond_their_size_keep_the_rank(spark):
    """With more items than a sketch keeps, quartiles stay within three hundredths of their rank; merged ones too."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(5, 1, 30_000), rng.exponential(3, 10_000)])
    df = spark.createDataFrame([(float(v), int(i % 7)) for i, v in enumerate(x)], "v double, g int").repartition(8)
    part = df.groupBy("g").agg(F_expr("kll_sketch_agg_double(v, 200)").alias("s"))
    got = part.agg(F_expr("kll_merge_agg_double(s, 200)").alias("s")).select(*[F_expr(f"kll_sketch_get_quantile_double(s, {q}D)").alias(f"q{i}") for i, q in enumerate((0.25, 0.75))]).first()
    for value, q in zip(got, (0.25, 0.75)):
        assert abs((x <= value).mean() - q) < 0.03


def _held(spark, name, sf):
    return registry.queries()[name](spark, sf).toPandas().query("held_out")


def test_op5_and_op8_on_the_held_out_quarter(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.1")
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas()
    x = _held(spark, "op5_langid", sf).merge(lang, on="doc_id")
    assert (x.lang == x.lang_pred).mean() > 0.995 and x.score.between(0, 1).all()
    toxic = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").toPandas()
    y = _held(spark, "op8_toxicity", sf).merge(toxic, on="doc_id")
    hit = y[y.predicted == 1]
    # the README's figures are 93 % and 3 of 870
    assert (y[y.toxic == 1].predicted == 1).mean() > 0.9 and (y[y.toxic == 0].predicted == 1).mean() < 0.01 and (hit.toxic == 1).mean() > 0.95


def test_op10_on_pages_of_one_article(spark, sf_dir):
    got = {r.page_id: r.text for r in registry.queries()["op10_html"](spark, sf_dir).collect()}
    for page, body in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect():
        article = re.search(r"<article>(.*?)</article>", body, re.S)[1]
        blocks = (re.sub(r"\s+", " ", htmllib.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", article))
        assert got[page] == "\n".join(b for b in blocks if b)


def test_strategies_fill_the_window_and_shards_keep_every_token():
    from signflow.llm import packing

    s = packing.strategies(64)
    assert (s.sum(axis=1) == 64).all() and len(np.unique(s, axis=0)) == len(s)
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 700, 2000)
    hist = np.bincount(-(-(lengths % 256) // 4), minlength=65).astype(float)
    hist[0] = 0
    out = packing.pack_shard(lengths, packing.solve_nnls(hist), 256, 4)
    seen = np.zeros(lengths.sum(), int)
    base = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    for row in out:
        assert sum(n for *_, n in row) <= 256
        for doc, at, n in row:
            seen[base[doc] + at : base[doc] + at + n] += 1
    assert (seen == 1).all()
    sizes = [sum(n for *_, n in row) for row in out]
    assert sum(256 - x for x in sizes if x & (x - 1)) < 0.02 * 256 * len(sizes)


def brute_article(html_text):
    """The selection by its definitions: densities by walking each subtree, sums over block children, the path's threshold."""
    g = html.Page(html_text)
    n = len(g.tag)
    _, _, drop = g.densities()

    def under(i):
        out = [i]
        for j in range(1, n):
            if j != i and any(a == i for a in ancestors(j)):
                out.append(j)
        return out

    def ancestors(j):
        while j:
            j = g.parent[j]
            yield j

    own = {}
    for node, t in g.flow:
        if t and not drop[node]:
            k = len(re.sub(r"\s+", " ", t).strip())
            linked = any(g.tag[a] == "a" for a in [node, *ancestors(node)])
            c, lc = own.get(node, (0, 0))
            own[node] = (c + k, lc + k * linked)
    subtree = {i: [j for j in under(i) if not drop[j]] for i in range(n) if not drop[i]}
    chars = {i: [sum(own.get(j, (0, 0))[x] for j in s) for x in (0, 1)] for i, s in subtree.items()}
    ratio = chars[0][1] / max(1, chars[0][0])
    density = {i: html.text_density(chars[i][0], chars[i][1], len(s) - 1, sum(g.tag[j] == "a" for j in s if j != i), ratio) if chars[i][0] else 0.0 for i, s in subtree.items()}
    total = {i: sum(density[j] for j in range(1, n) if g.parent[j] == i and j in density and g.tag[j] in html.BLOCK) for i in density}
    best = min(density, key=lambda i: (-total[i], i))
    path = [best, *ancestors(best)]
    body = next(i for i in range(n) if g.tag[i] == "body")
    threshold = min(density[i] or density[best] for i in path if i == best or i == body or body in list(ancestors(i)))
    marked = {i for i in density if g.tag[i] in ("article", "main") and density[i] >= threshold}
    if up := [i for i in path if i in marked]:
        return {up[0]}
    if down := [i for i in marked if best in ancestors(i)]:
        return {min(down, key=lambda i: (-total[i], i))}
    chosen = {best}
    work = [0, body]
    while work:
        i = work.pop()
        if i in density and density[i] >= threshold > 0:
            # of the subtree the greatest sum, among nodes with text
            top = min([j for j in subtree[i] if density[j] or j == i], key=lambda j: (-total[j], j))
            chosen.add(top if total[top] else i)
            work += [j for j in range(1, n) if g.parent[j] == i and j not in (0, body)]
    return chosen


@pytest.mark.parametrize("renamed", [False, True])
def test_densities_decide(spark, sf_dir, renamed):
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect() if r.html and len(r.html) < 9_000][:60]
    for x in pages:
        x = x.replace("<article>", "<div>").replace("</article>", "</div>") if renamed else x
        g = html.Page(x)
        density, total, drop = g.densities()
        cover = lambda ids, g=g: {i for i in range(len(g.tag)) if any(a in ids for a in chain(g, i))}
        assert cover(g._select(density, total, drop)) == cover(brute_article(x))


def chain(g, i):
    out = [i]
    while i:
        i = g.parent[i]
        out.append(i)
    return out


def test_unmarked_pages_give_the_same_article(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect():
        assert html.main_text(r.html) == html.main_text((r.html or "").replace("<article>", "<div>").replace("</article>", "</div>"))


@pytest.mark.parametrize("name", ["social history", "related-work", "tags", "promotion", "rail", "menu of the day", "share-price", "comments-on-kant", "widget-economics", "notice", "banner", "table-of-contents navigation"])
def test_names_inside_an_article_say_little(name):
    page = '<body><nav><a href=x>a</a></nav>{open}<h1>Head</h1><p>' + "some words of it " * 20 + f'</p><div class="{name}"><p>KEPT</p></div><p>' + "more words here " * 20 + "</p>{close}</body>"
    for tag in ("article", "div"):
        assert "KEPT" in html.main_text(page.replace("{open}", f"<{tag}>").replace("{close}", f"</{tag}>")).split("\n")


def test_parts_inside_an_article():
    page = '<body><header>Site</header><article><header><p>By Someone</p></header><h1>T</h1><p>Press <button>OK</button> now and <math><mi>x</mi><annotation>TeX</annotation></math> go.</p><figure class="promo"><figcaption>Caption</figcaption></figure><form><button>Send</button></form><div class="ad">AD</div><section id="comments"><p>reader</p></section><aside>side</aside><button>Share</button></article><footer>f</footer></body>'
    assert html.main_text(page) == "By Someone\nT\nPress OK now and x go.\nCaption"
