"""The pipeline's groups of similar texts, against every pair of texts."""

import numpy as np
import pytest

from signflow.llm import simhash
from signflow.llm.simhash import fingerprints, near_duplicates, one_per_group, shingle_hashes, similar_groups


def brute(texts):
    sets = {i: shingle_hashes(t.encode(), 5) for i, t in texts.items()}
    sets = {i: s for i, s in sets.items() if len(s)}
    root = {i: i for i in sets}
    order = sorted(sets)
    for k, i in enumerate(order):
        for j in order[k + 1 :]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)):
                both = len(np.intersect1d(a, b, assume_unique=True))
                if both >= 0.8 * (len(a) + len(b) - both) - 1e-9 and root[i] != root[j]:
                    keep, gone = sorted((root[i], root[j]))
                    root = {x: keep if r == gone else r for x, r in root.items()}
    return root


def grouped(spark, texts, **how):
    got = similar_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), **how)
    return {r.doc_id: r.component_id for r in got.collect()}


@pytest.mark.parametrize("group_shingles", [2_000_000, 3_000])
def test_copies_that_only_their_base_connects(spark, group_shingles):
    # each copy has 0.818 in common with the base, and far less than 0.8 with the other copies
    rng, texts = np.random.default_rng(5), {}
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(204)]
        texts[1000 * g + 999] = " ".join(base)
        for c in range(100):
            copy = list(base)
            for at in rng.choice(np.arange(5, 200, 5), 4, replace=False):
                copy[at] = f"c{c}"
            texts[1000 * g + c] = " ".join(copy)
    got = grouped(spark, texts, group_shingles=group_shingles)
    assert got == {i: i // 1000 * 1000 for i in texts}


def test_short_texts_and_ties(spark):
    # one word more at the end, of few shingles: simhash bits tie, similarities of 0.8 and a little less
    texts = {10 * n + k: " ".join([f"n{n}w{i}" for i in range(n + 4 - k)]) for n in range(1, 40) for k in range(4)}
    got = grouped(spark, texts, block_rows=20)
    assert got == brute(texts)


def test_documents(spark, sf_dir):
    texts = dict(tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    assert grouped(spark, texts) == brute(texts)


def test_pairs_near_the_threshold(spark):
    # chains of texts, each a bit over or under 0.8 from the last, in one bucket cut into many blocks
    rng, texts = np.random.default_rng(11), {}
    for g in range(30):
        cur = [f"g{g}w{i}" for i in range(120)]
        for k in range(6):
            texts[100 * g + k] = " ".join(cur)
            for at in rng.choice(np.arange(3, 117), 2 + int(rng.integers(0, 3)), replace=False):
                cur[at] = f"n{rng.integers(1 << 40)}"
    want = brute(texts)
    assert grouped(spark, texts, block_rows=4, group_shingles=500) == want
    assert 30 < len(set(want.values())) < len(texts)


def test_links_that_the_tree_alone_finds(spark):
    # 0.8 in common, fingerprints three bits apart, and no MinHash bucket in common
    words = [str(i) for i in range(15341719, 15341738)]
    texts = {1: " ".join(words), 2: " ".join(words[:16]), 3: " ".join(words[:8])}
    a, b = (shingle_hashes(texts[i].encode(), 5) for i in (1, 2))
    same = simhash.minhash_sketch(a) == simhash.minhash_sketch(b)
    assert not same.reshape(simhash.BANDS, simhash.ROWS).all(axis=1).any()
    assert grouped(spark, texts) == brute(texts) == {1: 1, 2: 1, 3: 3}
    assert sorted(r.doc_id for r in one_per_group(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()) == [1, 3]


def test_the_tree_links_fingerprints_within_the_radius(spark):
    # on its own: every two texts within four bits are connected, equal fingerprints of different texts too
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 60)
    fp = [int(x) ^ sum(1 << int(k) for k in rng.choice(63, int(rng.integers(0, 4)), replace=False)) for x in base for _ in range(5)]
    fp += fp[:20]
    up = list(range(len(fp)))
    for i in range(len(fp)):
        for j in range(i):
            if up[i] != up[j] and (fp[i] ^ fp[j]).bit_count() <= 4:
                keep, gone = sorted((up[i], up[j]))
                up = [keep if r == gone else r for r in up]
    edges = simhash._by_tree(spark.createDataFrame(list(enumerate(fp)), "node long, fp long"), 4, shard_rows=40)
    root = {r.node: r.root for r in simhash.components(edges).collect()}
    assert [root.get(i, i) for i in range(len(fp))] == up
    assert len(set(up)) < len(set(fp))


def test_one_row_of_a_group_stays(spark):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, a, "en"), (1, a, "de"), (1, a, "de"), (1, b, None), (2, b, "en"), (None, a, "fr"), (None, "only here, without an id", "x"), (3, None, "a"), (4, None, "a"), (5, " \t", "a"), (None, "", None)]
    got = one_per_group(spark.createDataFrame(rows, "doc_id long, text string, node string"))
    assert got.columns == ["doc_id", "text", "node"]
    want = [(1, a, "de"), (1, b, None), (None, rows[6][1], "x"), *rows[7:]]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert one_per_group(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shards_cut_into_blocks_lose_no_link(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 9)))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fp = {r.doc_id: r.fp & (1 << 64) - 1 for r in fingerprints(docs).collect()}
    up = {i: i for i in fp}
    for i in sorted(fp):
        for j in range(i):
            if up[i] != up[j] and (fp[i] ^ fp[j]).bit_count() <= 4:
                keep, gone = sorted((up[i], up[j]))
                up = {k: keep if r == gone else r for k, r in up.items()}
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, shard_rows=40, block_rows=15).collect()} == up
