"""Centroids, the n-gram join and resampling: brute force, odd rows, and the parts that only large inputs reach."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from signflow.llm import centroids, ngram_join, resample


# --- centroids ----------------------------------------------------------------


def brute_clusters(rows, k, rounds, dim):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, y, strict=True)), i) for i, y in enumerate(c))

    for _ in range(rounds):
        mine = [[] for _ in c]
        for _, v in kept:
            mine[near(v)[1]].append(v)
        c = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else old for m, old in zip(mine, c, strict=True)]
    got = [(i, *near(v)) for i, v in kept]
    return sorted(((i, n, d, sum(e for _, e, m in got if m == n), sum(e for _, e, _ in got), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for i, d, n in got), key=str)


VECTORS = "vec_id long, embedding array<float>, label int, v int, cluster string, distance int"


def clustered(spark, rows, **how):
    got = centroids.cluster(spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in rows], VECTORS), **how)
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got.collect()), key=str)


def test_centroids_by_hand(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.choice([0.0, 0.25, -0.25, 1.5, 0.003], 4)]) for i in range(120)]
    rows += [(7, rows[7][1]), (None, rows[9][1]), (None, rows[10][1]), (200, None), (201, []), (202, [0.0] * 3), (203, [0.0, None, 0.0, 0.0]), (204, [float("nan")] * 4), (205, [float("inf"), 0.0, 0.0, 0.0]), (206, [0.0, float("-inf"), 0.0, 0.0])]
    assert clustered(spark, rows, k=9, rounds=3, dim=4) == brute_clusters(rows, 9, 3, 4)
    # fewer vectors than centroids, equal vectors, and none
    few = [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [-0.5, 0.0])]
    assert clustered(spark, few, k=40, rounds=2, dim=2) == brute_clusters(few, 40, 2, 2)
    assert clustered(spark, [(1, [0.5])], dim=2) == [] and clustered(spark, [], dim=2) == []


@pytest.mark.parametrize("size", [3, 200, 1 << 13, 1 << 25])
def test_screening_is_exact(size):
    # centroids that differ in one unit, so that float32 products can't tell them apart
    rng = np.random.default_rng(size)
    base = rng.integers(-size, size + 1, 64)
    c = base + rng.integers(-1, 2, (40, 64))
    c[20] = c[3]
    x = np.concatenate([base + rng.integers(-2, 3, (500, 64)), rng.integers(-size, size + 1, (500, 64)), c])
    exact = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (centroids.nearest(x, c) == exact).all()


def test_bound_holds():
    rng = np.random.default_rng(1)
    for scale in (1, 1000, 1 << 24):
        x, c = rng.integers(-scale, scale + 1, (300, 64)), rng.integers(-scale, scale + 1, (40, 64))
        off = np.abs((x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64) - (x @ c.T))
        assert (off <= centroids.error_bound(64) * np.sqrt((x * x).sum(1))[:, None] * np.sqrt((c * c).sum(1))[None]).all()


def test_components_beyond_a_long(spark):
    with pytest.raises(Exception, match="passes"):
        clustered(spark, [(1, [1e30, 0.0])], dim=2)


# --- n-gram join --------------------------------------------------------------


def brute_join(rows, words=5, percent=80):
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w)} if 0 < len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)})
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both) and root[i] != root[j]:
                keep, gone = root[i], root[j]
                root = [keep if r == gone else r for r in root]
    ids = lambda k: [i for (i, _), r in zip(rows, root, strict=True) if r == root[k] and i is not None]
    return sorted(((rows[k][0], len(sets[k]), min(ids(k), default=None)) for k in range(len(rows))), key=str)


def joined(spark, rows, **how):
    frame = spark.createDataFrame([(i, t, 1, 2, "x", "y") for i, t in rows], "doc_id long, text string, node int, n long, bits string, tile string")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(frame, **how).collect()), key=str)


def edited(rng, g, copies, length, edits):
    base = [f"g{g}w{i}" for i in range(length)]
    out = [" ".join(base)]
    for c in range(copies):
        copy = list(base)
        for at in rng.choice(length, edits, replace=False):
            copy[at] = f"c{c}x{at}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("how", [{}, {"block_rows": 16, "group_shingles": 1_500}])
def test_join_of_copies_and_passages(spark, how):
    rng = np.random.default_rng(7)
    shared = " ".join(f"passage{i}" for i in range(60))
    texts = [t for g in range(6) for t in edited(rng, g, 25, 40 + 60 * g, g)]
    texts += [f"{' '.join(f'o{k}w{i}' for i in range(20 + k))} {shared}" for k in range(60)] + [shared] * 5
    # chains of sizes around 0.8 of each other
    texts += [" ".join(f"n{n}w{i}" for i in range(n + 4 + k)) for n in range(1, 60, 3) for k in range(-3, 4)]
    rows = list(enumerate(texts))
    assert joined(spark, rows, **how) == brute_join(rows)


def test_join_of_odd_rows(spark):
    long_ = "alpha beta gamma delta epsilon zeta eta theta iota " * 4000
    rows = [(1, None), (2, ""), (3, " \n\t\x0b"), (9, "ONE two"), (4, "one  TWO\n"), (4, "one two"), (None, "one two"), (5, "two one"), (6, long_), (8, long_ + "more"), (None, "only null ids here"), (7, "É é"), (10, "é é"), (11, "a\x1cb c d e f g"), (12, "a b c d e f g"), (13, "a a a a a a a"), (14, "a a a a a")]
    assert joined(spark, rows) == brute_join(rows)
    assert joined(spark, []) == []
    assert joined(spark, [(1, None)]) == [(1, 0, 1)]


def test_bitmap_bound_never_drops_a_pair():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n, m = rng.integers(1, 400, 2)
        pool = rng.integers(0, 1 << 63, n + m, np.uint64)
        a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[: n * 9 // 10], pool[n : n + m // 12]]))
        both = len(np.intersect1d(a, b))
        assert ngram_join.overlap(a, b) == both
        if 100 * both >= 80 * (len(a) + len(b) - both):
            sizes, maps = np.array([len(a), len(b)]), [np.frombuffer(ngram_join.bitmap(x), np.uint8) for x in (a, b)]
            assert ngram_join.bounded_links(sizes, maps, 80) == [(0, 1)]
            heat = rng.integers(0, 3, ngram_join.CELLS)
            assert len(np.intersect1d(ngram_join.prefix(a, heat), ngram_join.prefix(b, heat)))
            band = np.searchsorted(ngram_join.band_edges(), sizes, side="right")
            assert abs(band[0] - band[1]) <= 1


# --- resampling ---------------------------------------------------------------


def brute_resample(rows, target, ngram, buckets, percent, min_words):
    def of(text):
        w = [x for x in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, ngram + 1) for i in range(len(w) - n + 1)]

    docs, s, t = [(i, *of(x)) for i, x in rows], np.zeros(buckets), np.zeros(buckets)
    for _, _, f in docs:
        np.add.at(s, f, 1)
    for x in target:
        np.add.at(t, of(x)[1], 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    out = []
    for i, n, f in docs:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = None if i is None else int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    may = sorted((r for r in out if r[1] >= min_words and r[0] is not None), key=lambda r: (-r[4], r[0]))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=str)


DOCS = "doc_id long, text string, key string, rank int, score string, gain int, n_words string"


@pytest.mark.parametrize("ngram, chunk", [(1, 16), (2, 16), (3, 7), (1, 1 << 14), (2, 1 << 14)])
def test_resample_by_hand(spark, ngram, chunk):
    rng = np.random.default_rng(ngram)
    vocab = [f"w{i}" for i in range(40)] + ["É", "日本", "Über", "A1"]
    rows = [(i, "".join(vocab[k] + [" ", "-", "\n", ", "][k % 4] for k in rng.integers(0, len(vocab), rng.integers(0, 60)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "!?"), (None, rows[3][1] * 2), (5, rows[5][1]), (5, rows[5][1]), (103, "x" * 500 + " y " * 30), (104, ("word " * 9000).strip()), (105, ("word " * 9000).strip())]
    target = [rows[1][1], None, "w1 w2 w1 w2", "", rows[104 % 80][1]]
    docs = spark.createDataFrame([(i, t, "k", 1, "s", 2, "n") for i, t in rows], DOCS)
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, n long")
    got = resample.resample(docs, goal, ngram=ngram, buckets=50, percent=30, min_words=10, chunk_bytes=chunk).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_resample(rows, target, ngram, 50, 30, 10)


def test_resample_of_empty_tables(spark):
    docs, goal = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert resample.resample(docs.where("false"), goal).count() == 0
    got = resample.resample(docs, goal, percent=100).collect()
    assert [(r.doc_id, r.n_words, r.rank) for r in got] == [(1, 40, 1)]


def test_chunks_own_each_run_once():
    raw = ("één two-three " * 50 + "x" * 90 + " end").encode()
    for n in (1, 2, 3):
        for size in (1, 5, 40, 10_000):
            parts = [resample.features(p, n, 1000, own) for p, own in resample.chunks(raw, size, n)]
            words, all_ = resample.features(raw, n, 1000)
            assert sum(w for w, _ in parts) == words
            assert sorted(np.concatenate([f for _, f in parts]).tolist()) == sorted(all_.tolist())
