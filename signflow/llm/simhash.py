"""SimHash near-duplicates, with links found exactly by a vantage-point tree.

The Hamming metric on 64 bits is the sum of eight Hamming metrics on disjoint
bytes.  Each byte has a vantage point, and a fingerprint's distances to the
eight vantage points place it in the tree.  By the triangle inequality, two
fingerprints differ in at least ``sum(|d_i(x) - d_i(y)|)`` bits, so a branch is
pruned once that sum passes the radius.

The upper levels of the tree deal fingerprints out to shards of Spark.  A
fingerprint lives in one shard and is also sent, as a query, to each later
shard whose boundary lies within the radius.  Inside a shard a dual-tree join
descends the same levels and compares what is left bit by bit, so the links are
exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signflow.llm.common import materialise, table
from signflow.llm.components import components

SEED = 42
LEVELS = 8
#: Fingerprints that a shard should hold as its own, and the fewest shards of any input.
SHARD_ROWS, MIN_SHARDS = 65_536, 8
#: Fingerprints of a block, of which a search task holds two.
BLOCK_ROWS = 16_384
#: Fingerprints looked at to choose vantage points and shell bounds; a bound that does not grow with the input.
SAMPLE_ROWS = 2_048
LEAF_PAIRS = 1 << 16


def hashes(raw: bytes | None, words: int) -> np.ndarray:
    """The hashes of a text's word shingles, repeats included; a text with fewer words is one shingle, a wordless one has none."""
    parts = (raw or b"").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) < words:
        shingles = [b" ".join(parts)]
    else:
        shingles = map(b" ".join, zip(*(parts[i:] for i in range(words))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in shingles), np.uint64)


def simhash(h: np.ndarray) -> int:
    """The bits that are set in over half the hashes, as an unsigned number; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint_bytes(raw: bytes | None, words: int = 4) -> int:
    """The 64-bit SimHash of a text's UTF-8 bytes, as an unsigned number."""
    return simhash(hashes(raw, words))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp long) per row; a null or wordless text has fingerprint 0.

    Rows with a null id keep it.  Repeated rows give repeated rows.  Other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint_bytes(x, words) for x in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw")).mapInArrow(run, "doc_id long, fp long")


# --- the tree -----------------------------------------------------------------


def level_distances(fp: np.ndarray, vantage: np.ndarray) -> np.ndarray:
    """(n, 8) distances, byte by byte, to the vantage point."""
    return np.bitwise_count(fp.view(np.uint8).reshape(-1, LEVELS) ^ vantage.view(np.uint8))


def choose_tree(sample: np.ndarray, total: int, shard_rows: int = SHARD_ROWS) -> tuple[np.ndarray, list[tuple[int, list[int]]]]:
    """A vantage point for each byte and, for the levels that deal out shards, the inner bounds of their shells.

    For each byte the value of the sample is taken from which the sample's
    distances spread most, as in a classic vantage-point tree.  Levels are cut
    at the median, in three or more shells once eight halvings are too few.
    """
    if not len(sample):
        sample = np.zeros(1, np.uint64)
    octets = sample.view(np.uint8).reshape(-1, LEVELS)
    vantage = np.zeros(LEVELS, np.uint8)
    spread = np.zeros(LEVELS)
    for i in range(LEVELS):
        cand = np.unique(octets[:, i])
        var = np.bitwise_count(octets[:, i][None, :] ^ cand[:, None]).var(axis=1)
        vantage[i], spread[i] = cand[int(var.argmax())], var.max()
    d = level_distances(sample, vantage.view(np.uint64))
    need = max(MIN_SHARDS, total / shard_rows)
    shells = 2
    while shells < 6 and shells**LEVELS < need:
        shells += 1
    plan, have = [], 1.0
    for i in np.argsort(-spread, kind="stable"):
        if have >= need:
            break
        cuts = sorted({int(x) for x in np.quantile(d[:, i], np.arange(1, shells) / shells, method="higher")} - {0})
        if cuts:
            share = max(np.bincount(np.searchsorted(cuts, d[:, i], side="right"))) / len(d)
            if share < 1:
                plan.append((int(i), cuts))
                have /= share
    return vantage.view(np.uint64), plan


def route(fp: np.ndarray, vantage: np.ndarray, plan: list[tuple[int, list[int]]], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, home): each fingerprint once at home, and as a query in each later shard within the radius."""
    d = level_distances(fp, vantage).astype(np.int16)
    row, shard = np.arange(len(fp)), np.zeros(len(fp), np.int64)
    home, spent = np.zeros(len(fp), np.int64), np.zeros(len(fp), np.int16)
    for i, cuts in plan:
        lows, highs = np.array([0, *cuts]), np.array([*cuts, 9]) - 1
        own = np.searchsorted(cuts, d[:, i], side="right")
        home = home * len(lows) + own
        at = d[row, i]
        cost = np.maximum(0, np.maximum(lows[None, :] - at[:, None], at[:, None] - highs[None, :])) + spent[:, None]
        keep, s = np.nonzero(cost <= radius)
        row, shard, spent = row[keep], shard[keep] * len(lows) + s, cost[keep, s].astype(np.int16)
    own = home[row]
    keep = shard >= own
    return row[keep], shard[keep], shard[keep] == own[keep]


class _Links:
    """Union-find over the fingerprints of a shard."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, x: np.ndarray) -> np.ndarray:
        while True:
            y = self.up[x]
            if np.array_equal(y, x):
                return x
            x = self.up[y]

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root(a), self.root(b)
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            open_ = lo != hi
            lo, hi = lo[open_], hi[open_]
            if not len(lo):
                return
            np.minimum.at(self.up, hi, lo)
            a, b = lo, hi

    def block(self, fp: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> None:
        """Link the near ones among a x b, a bounded strip at a time."""
        step = max(1, LEAF_PAIRS * 4 // max(1, len(b)))
        for at in range(0, len(a), step):
            i, j = np.nonzero(np.bitwise_count(fp[a[at : at + step], None] ^ fp[None, b]) <= radius)
            if len(i):
                self.add(a[at + i], b[j])


def descend(links: _Links, fp: np.ndarray, home: np.ndarray, vantage: np.ndarray, radius: int) -> None:
    """Dual-tree join of a task: home rows with the guests or, where it has none, with each other."""
    d = level_distances(fp, vantage)

    def split(x: np.ndarray, level: int) -> list[tuple[int, np.ndarray]]:
        v = d[x, level]
        order = np.argsort(v, kind="stable")
        x, v = x[order], v[order]
        cut = np.flatnonzero(np.diff(v)) + 1
        return [(int(v[p]), part) for p, part in zip([0, *cut], np.split(x, cut))]

    def join(a: np.ndarray, b: np.ndarray, level: int, left: int, same: bool) -> None:
        if level == LEVELS or len(a) * len(b) <= LEAF_PAIRS:
            links.block(fp, a, b, radius)
            return
        pa_ = split(a, level)
        pb = pa_ if same else split(b, level)
        for i, (da, xa) in enumerate(pa_):
            for j, (db, xb) in enumerate(pb):
                if abs(da - db) <= left and not (same and j < i):
                    join(xa, xb, level + 1, left - abs(da - db), same and i == j)

    own, guest = np.flatnonzero(home), np.flatnonzero(~home)
    if len(guest):
        if len(own):
            join(own, guest, 0, radius, False)
    elif len(own):
        join(own, own, 0, radius, True)


def shard_links(fp: np.ndarray, home: np.ndarray, vantage: np.ndarray, radius: int) -> np.ndarray:
    """Root position of each fingerprint of a shard, over all links of which one end is at home."""
    links = _Links(len(fp))
    descend(links, fp, home, vantage, radius)
    return links.root(np.arange(len(fp)))


def near_links(distinct: DataFrame, radius: int = 4, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges (u, v) that connect what is linked among distinct fingerprints.

    ``distinct`` has one row per fingerprint (fp long).  The rows at home in a
    shard, and its guests, are cut into blocks of about ``block_rows`` by a hash;
    a task holds two blocks, whatever a shard holds: two home blocks, or a home
    block and a block of guests, and searches between them alone.  Of each task a spanning star per group is
    returned, not all its pairs: a group of n takes n - 1 edges and no link
    between different fingerprints is lost.
    """
    total = distinct.count()
    sample = np.array([r[0] for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE_ROWS).collect()], np.int64).view(np.uint64)
    vantage, plan = choose_tree(sample, total, shard_rows)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            row, shard, home = route(fp, vantage, plan, radius)
            for at in range(0, len(row), 1 << 16):
                s = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(shard[s]), pa.array(fp[row[s]].view(np.int64)), pa.array(home[s])], names=["shard", "fp", "home"])

    def search(t: pa.Table) -> pa.Table:
        fp = t.column("fp").to_numpy().view(np.uint64)
        order = np.argsort(fp.view(np.int64), kind="stable")
        fp, home = fp[order], t.column("home").to_numpy()[order]
        root = shard_links(fp, home, vantage, radius)
        i = np.flatnonzero(root != np.arange(len(fp)))
        return pa.table({"u": fp[i].view(np.int64), "v": fp[root[i]].view(np.int64)})

    dealt = materialise(distinct.select("fp").mapInArrow(deal, "shard long, fp long, home boolean"), "dealt")
    blocks = dealt.groupBy("shard").agg(*[F.greatest(F.lit(1), F.ceil(F.count_if(of) / block_rows)).cast("long").alias(name) for of, name in ((F.col("home"), "home_blocks"), (~F.col("home"), "guest_blocks"))])
    # one row a shard
    blocks = materialise(blocks, "blocks")
    pairs = blocks.agg(F.sum(F.expr("home_blocks * (home_blocks + 1) / 2 + home_blocks * guest_blocks"))).first()[0] or 1
    placed = dealt.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("fp", F.lit("block")), F.when(F.col("home"), F.col("home_blocks")).otherwise(F.col("guest_blocks"))))

    def tasks(of: str, pair: Callable[[Column], Column]) -> Column:
        return F.transform(F.sequence(F.lit(0).cast("long"), F.col(of) - 1), pair)

    # kind 0: two home blocks; kind 1: a home block and a block of guests
    own = tasks("home_blocks", lambda k: F.struct(F.lit(0).alias("kind"), F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    met = tasks("guest_blocks", lambda k: F.struct(F.lit(1).alias("kind"), F.col("block").alias("i"), k.alias("j")))
    visits = tasks("home_blocks", lambda k: F.struct(F.lit(1).alias("kind"), k.alias("i"), F.col("block").alias("j")))
    spread = placed.select("shard", "fp", "home", "block", F.explode(F.when(F.col("home"), F.concat(own, met)).otherwise(visits)).alias("at"))
    # of two home blocks the second visits the first; what lies within a block is searched where it meets itself
    host = F.when(F.col("at.kind") == 0, (F.col("at.i") == F.col("at.j")) | (F.col("block") == F.col("at.i"))).otherwise(F.col("home"))
    spread = spread.select("shard", "fp", host.alias("home"), "at.kind", "at.i", "at.j")
    # a pair of blocks is few bytes and much work: as many tasks as pairs, up to a bound
    return spread.repartition(int(min(pairs, 20_000)), "shard", "kind", "i", "j").groupBy("shard", "kind", "i", "j").applyInArrow(search, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document: doc_id, fp long, component_id (smallest doc_id reachable).

    Copies share a fingerprint and meet once, in a map-side combined
    aggregation; only distinct fingerprints enter the tree.  A null doc_id keeps
    its row and takes the component of its fingerprint; an empty table gives an
    empty table.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, words), "fps")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    roots = components(near_links(distinct, radius, shard_rows, block_rows))
    placed = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_fp = placed.join(least, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- similar texts, verified --------------------------------------------------

#: MinHash values of a text, one byte of each; BANDS runs of ROWS of them are the keys under which texts meet.
BANDS, ROWS = 32, 5
SKETCH = BANDS * ROWS
_MIX = np.random.default_rng(2024).integers(1, 1 << 63, (2, SKETCH), np.uint64) | np.uint64(1)


def shingle_hashes(raw: bytes | None, words: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted."""
    return np.unique(hashes(raw, words))


def minhash_sketch(h: np.ndarray) -> np.ndarray:
    """The least values under SKETCH mixes of the hashes, the low byte of each."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 1 << 11):
        x = h[at : at + (1 << 11), None] * _MIX[0][None] + _MIX[1][None]
        least = np.minimum(least, (x ^ (x >> np.uint64(31))).min(axis=0))
    return (least & np.uint64(0xFF)).astype(np.uint8)


def least_agreement(threshold: float) -> float:
    """The share of equal sketch values below which a pair isn't looked at: six standard errors under what a pair at the threshold has on average."""
    return threshold - 6 * (threshold * (1 - threshold) / SKETCH) ** 0.5


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, node, raw): ``node`` tells equal texts by 64 bits of hash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("node"), F.col("text").cast("binary").alias("raw"))


def _profiles(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, node, fp, n, sketch): SimHash, number of distinct shingles and MinHash sketch of each text with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = [hashes(x, words) for x in b.column(2).to_pylist()]
            fp = np.fromiter(map(simhash, every), np.uint64, b.num_rows)
            h = [np.unique(x) for x in every]
            cols = [b.column(0), b.column(1), pa.array(fp.view(np.int64)), pa.array([len(x) for x in h], pa.int64()), pa.array([minhash_sketch(x).tobytes() for x in h], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "node", "fp", "n", "sketch"])

    return _texts(docs).mapInArrow(run, "doc_id long, node long, fp long, n long, sketch binary").where("n > 0")


def _by_tree(profiles: DataFrame, radius: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges (u, v) that connect the texts (node, fp) whose fingerprints differ in at most ``radius`` bits, found by the vantage-point tree."""
    first = materialise(profiles.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    equal = profiles.join(first, "fp").where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    ends = [first.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_node")) for end in ("u", "v")]
    near = near_links(first.select("fp"), radius, shard_rows).join(ends[0], "u").join(ends[1], "v")
    return equal.unionByName(near.select(F.col("u_node").alias("u"), F.col("v_node").alias("v")))


def agreeing_links(n: np.ndarray, sketch: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose sizes and sketches allow the similarity.

    A group is found from its first row outwards; each of its rows is compared
    with the rows that no group has yet, so that close copies cost one pass.
    """
    least, open_, kept = least_agreement(threshold) * SKETCH, np.arange(len(n)), []
    while len(open_) > 1:
        front, open_ = [int(open_[0])], open_[1:]
        while front and len(open_):
            x = front.pop()
            fits = np.flatnonzero(np.minimum(n[open_], n[x]) >= threshold * np.maximum(n[open_], n[x]) - 1e-9)
            found = fits[(sketch[open_[fits]] == sketch[x]).sum(axis=1) >= least]
            if len(found):
                got = open_[found].tolist()
                kept += [(x, y) for y in got]
                front += got
                open_ = np.delete(open_, found)
    return kept


def _likely(distinct: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """Edges (u, v) that span, within each bucket, what sizes and sketches don't rule out.

    A text is in a bucket for each run of ROWS sketch values.  Buckets with the
    same members count once.  Small buckets share tasks; one of more than
    ``block_rows`` members is cut into blocks, and each two blocks meet in a task.
    """
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("sketch", i * ROWS + 1, F.lit(ROWS))))
    rows = distinct.select("node", F.explode(keys).alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("m"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark"), F.min("node").alias("least")).where("m > 1")
    once = shared.groupBy("m", "mark", "least").agg(F.min("key").alias("key")).select("key", "m")
    member = materialise(rows.join(once, "key"), "buckets")
    tasks = max(1, -(-member.count() // 8192))
    blocks = F.ceil(F.col("m") / block_rows).cast("long")
    block = F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks"))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    cut = member.withColumn("blocks", blocks).withColumn("block", block).withColumn("at", F.explode(F.when(F.col("blocks") == 1, others).otherwise(F.filter(others, lambda x: x.i < x.j))))
    cut = cut.withColumn("task", F.when(F.col("blocks") > 1, F.col("key")).otherwise(F.pmod("key", F.lit(tasks))))
    dealt = cut.select((F.col("blocks") > 1).alias("big"), "task", "at.i", "at.j", "key", "node").join(distinct, "node")

    def search(t: pa.Table) -> pa.Table:
        key, node, n = (t.column(c).to_numpy() for c in ("key", "node", "n"))
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        order = np.lexsort((node, key))
        pairs = []
        for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            pairs += [(int(part[x]), int(part[y])) for x, y in agreeing_links(n[part], sketch[part], threshold)]
        pairs = np.array(pairs, np.int64).reshape(-1, 2)
        return pa.table({"u": node[pairs[:, 0]], "v": node[pairs[:, 1]]})

    return dealt.groupBy("big", "task", "i", "j").applyInArrow(search, "u long, v long").distinct()


def verified_links(sets: list[np.ndarray], home: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs, of a home row and another row, whose sets have the Jaccard similarity.

    Any pair whose ends are still apart is compared on the whole sets before it
    joins them, so no failing pair keeps another from being looked at.
    """
    order = np.argsort([len(x) for x in sets], kind="stable")
    n, home = np.array([len(sets[i]) for i in order], np.int64), home[order]
    token = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1]
    start = np.concatenate([[0], np.cumsum(n)])
    mark, label, kept = np.zeros(len(token) and int(token.max()) + 1, bool), np.arange(len(n)), []
    for x in np.flatnonzero(home)[::-1].tolist():
        y = np.arange(np.searchsorted(n, n[x] * threshold - 1e-9), np.searchsorted(n, n[x] / threshold + 1e-9, side="right"))
        y = y[~home[y] | (y < x)][::-1]
        mark[mine := token[start[x] : start[x + 1]]] = True
        while len(y := y[label[y] != label[x]]):
            some, y = y[:256], y[256:]
            ends = np.cumsum(n[some])
            both = np.add.reduceat(mark[token[np.arange(ends[-1]) + np.repeat(start[some] - ends + n[some], n[some])]], ends - n[some], dtype=np.int64)
            some = some[both >= threshold * (n[x] + n[some] - both) - 1e-9]
            if len(some):
                labels, at = np.unique(label[some], return_index=True)
                kept += [(int(order[x]), int(order[k])) for k in some[at]]
                label[np.isin(label, labels)] = label[x]
        mark[mine] = False
    return kept


def similar_groups(docs: DataFrame, words: int = 5, threshold: float = 0.8, radius: int = 4, block_rows: int = 4_096, group_shingles: int = 2_000_000) -> DataFrame:
    """(doc_id, node, component_id) of every row with words: groups of texts whose shingle sets have a Jaccard similarity of ``threshold``.

    The vantage-point tree connects all texts whose SimHash fingerprints differ
    in at most ``radius`` bits.  A pair at 0.8 differs in about ten bits, beyond
    what a tree can prune, so texts also meet in buckets of MinHash runs, where
    such a pair is missed about three times in a million and a likelier one far
    less; those that sizes and sketches don't rule out (see ``least_agreement``)
    are connected too.  What both connect is brought together with all its
    shingles, in blocks of about ``group_shingles``, and only pairs that have the
    similarity are joined.

    ``component_id`` is the smallest doc_id of the group, null ids left aside,
    ``node`` a hash of the text: rows of equal text meet once.  Rows without
    words are left out; repeated rows and shared ids are rows of their own; an
    empty table gives an empty table.
    """
    prof, groups = _groups(docs, words, threshold, radius, block_rows, group_shingles)
    least = groups.groupBy("group").agg(F.min("least_id").alias("component_id"))
    of_node = groups.join(least, "group").select("node", "group", "component_id")
    return prof.select("doc_id", "node").join(of_node, "node")


def _groups(docs: DataFrame, words: int = 5, threshold: float = 0.8, radius: int = 4, block_rows: int = 4_096, group_shingles: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, …) of the rows with words, and (node, group, least_id, rows) of each text: its least id, null ids last, and how many rows have it."""
    prof = materialise(_profiles(docs, words), "profiles")
    distinct = materialise(prof.select("node", "fp", "n", "sketch").distinct(), "profile-groups")
    near = materialise(_by_tree(distinct.select("node", "fp"), radius), "near")
    rest = materialise(_likely(distinct.select("node", "n", "sketch"), threshold, block_rows), "likely")
    likely = near.unionByName(rest)
    sure = materialise(_verified(docs, distinct, components(likely), words, threshold, group_shingles), "sure")
    # copies are counted before anything is joined, so a text of many copies is one row
    ids = prof.groupBy("node", "doc_id").agg(F.count("*").alias("rows"))
    first = ids.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rows")).alias("x")).select("node", F.col("x.doc_id").alias("least_id"), "x.rows")
    groups = first.join(components(sure), "node", "left").select("node", F.coalesce("root", "node").alias("group"), "least_id", "rows")
    return prof, materialise(groups, "groups")


def one_per_group(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, all columns: of each group of similar texts the row with the smallest doc_id.

    A null id comes after all others.  Where rows of that id and text repeat,
    the least by all its columns stays.  Rows without words stay, each of them.
    """
    _, groups = _groups(docs, **how)
    best = groups.groupBy("group").agg(F.min(F.struct(F.col("least_id").isNull().alias("none"), "least_id", "node", "rows")).alias("x"))
    chosen = materialise(best.select(F.col("x.least_id").alias("__id"), F.col("x.node").alias("__node"), F.col("x.rows").alias("__rows")), "chosen")
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^ \t\n\r\x0b\f]")
    key = F.xxhash64("text")
    kept = docs.where(~wordless).withColumn("__key", key)
    kept = kept.join(chosen, (F.col("__key") == F.col("__node")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id")))
    single = kept.where("__rows = 1").select(*docs.columns)
    repeated = kept.where("__rows > 1").select(*docs.columns, "__node", "__id").groupBy("__node", "__id").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return docs.where(wordless).unionByName(single).unionByName(repeated)


def _verified(
    docs: DataFrame, distinct: DataFrame, roots: DataFrame, words: int, threshold: float, group_shingles: int, sets_of: Callable = shingle_hashes, links_of: Callable = verified_links
) -> DataFrame:
    """Edges (u, v) that span what pairs with the similarity connect, inside each group of candidates (node, root).

    ``sets_of`` gives a text's sorted shingle hashes, ``links_of`` the pairs among such sets.

    Small groups share tasks; of a group of more than ``group_shingles`` each
    two blocks meet in a task, so that a task holds about two blocks' shingles.
    """
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).join(distinct.select("node", "n").distinct(), "node")
    sizes = materialise(roots.groupBy("root").agg(F.sum("n").alias("m")), "candidate-sizes")
    tasks = max(1, -(-(sizes.where(F.col("m") <= group_shingles).agg(F.sum("m")).first()[0] or 0) * 4 // group_shingles))
    member = roots.join(sizes, "root").withColumn("blocks", F.ceil(F.col("m") / group_shingles).cast("long"))
    member = member.withColumns({"block": F.pmod(F.xxhash64("node"), F.col("blocks")), "task": F.when(F.col("blocks") > 1, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(tasks)))})
    member = materialise(member.select("node", "root", "task", "blocks", "block"), "candidate-groups")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            # copies in the same task are worked out once; the set is bounded, what it forgets is only repeated work
            node = b.column(0).to_pylist()
            new = [i for i, x in enumerate(node) if not (x in seen or seen.add(x))]
            if len(seen) > 1 << 20:
                seen.clear()
            h = [sets_of(b.column(1)[i].as_py(), words).tobytes() for i in new]
            yield pa.RecordBatch.from_arrays([pa.array([node[i] for i in new], pa.int64()), pa.array(h, pa.binary())], names=["node", "h"])

    texts = _texts(docs).select("node", "raw").join(member.select("node"), "node", "left_semi")
    found = member.join(texts.mapInArrow(sets, "node long, h binary").where("length(h) > 0").dropDuplicates(["node"]), "node")
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    dealt = found.withColumn("at", F.explode(pair)).select("blocks", "task", "at.i", "at.j", (F.col("block") == F.col("at.i")).alias("home"), "root", "node", "h")

    def verify(t: pa.Table) -> pa.Table:
        root, node, home = (t.column(c).to_numpy() for c in ("root", "node", "home"))
        h = [np.frombuffer(x, np.uint64) for x in t.column("h").to_pylist()]
        order = np.lexsort((node, root))
        edges = []
        for part in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
            edges += [(int(part[x]), int(part[y])) for x, y in links_of([h[k] for k in part], home[part], threshold)]
        pairs = np.array(edges, np.int64).reshape(-1, 2)
        return pa.table({"u": node[pairs[:, 0]], "v": node[pairs[:, 1]]})

    return dealt.groupBy((F.col("blocks") > 1).alias("big"), "task", "i", "j").applyInArrow(verify, "u long, v long")
