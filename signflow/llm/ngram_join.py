"""Word n-gram Jaccard self-join: size-banded tiles, bitmap bounds, exact intersections.

Sizes are cut into bands so that sets of the wanted similarity lie in one band
or in two next to each other.  A tile is a shared n-gram and a band: its rows
are the sets of that band and of the next whose *prefix* holds the n-gram.  In
an order of n-grams that all sets share, two similar sets have one of their
first n - ceil(t n) + 1 n-grams in common, so every linked pair meets in a tile.
The order puts n-grams that many texts hold last, by counts over the whole
corpus, so a passage that thousands of documents share makes no large tiles.

In a tile each set has a bitmap with a bit per hashed n-gram.  A bit that only
one of two bitmaps has stands for an n-gram that only that set has, so bit
counts bound the overlap from above.  What the bound leaves connects
candidates; these meet with their whole sorted sets, and only a pair whose
exact intersection is large enough becomes a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signflow.llm.common import materialise, table
from signflow.llm.components import components
from signflow.llm.simhash import _texts, _verified

WORDS, PERCENT, SEED = 5, 80, 42
#: Cells of the table of n-gram counts (its size does not grow with the corpus) and cells of one of its rows.
CELLS, STRIP = 1 << 20, 1 << 14
#: Bits of the shortest and the longest bitmap; between them a set has one to two bits an n-gram.
LEAST_BITS, MOST_BITS = 64, 1 << 15
#: Sets of a tile beyond which it is cut into blocks.
BLOCK_ROWS = 4_096
#: Prefix n-grams that a task groups.
TASK_KEYS = 1 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Hashes of words, worked out once; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 19:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


_words = _Words()


def shingle_set(raw: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word runs; the whole sequence where it is shorter, none without words."""
    parts = (raw or b"").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, parts), np.uint64, len(parts))
    run = min(words, len(w))
    h = np.full(len(w) - run + 1, run, np.uint64)
    for i in range(run):
        h = (h ^ (h >> np.uint64(29))) * _MULTIPLIER + w[i : i + len(h)]
    h = (h ^ (h >> np.uint64(32))) * _MULTIPLIER
    return np.unique(h ^ (h >> np.uint64(29)))


def band_edges(percent: int = PERCENT, most: int = 1 << 40) -> np.ndarray:
    """First size of each band: sizes two bands apart are too far apart to link."""
    edges = [1]
    while edges[-1] < most:
        edges.append(edges[-1] * 100 // percent + 1)
    return np.array(edges, np.int64)


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The smallest intersection with which 100 * both >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def prefix(h: np.ndarray, heat: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """A set's first n-grams, coolest first: one of them is in every set that links with it."""
    n = len(h)
    if not n:
        return h
    keep = n - -(-percent * n // 100) + 1
    warm = heat[h >> np.uint64(44)]
    if keep < n:
        limit = np.partition(warm, keep - 1)[keep - 1]
        h, warm = h[warm <= limit], warm[warm <= limit]
    return h[np.lexsort((h, warm))[:keep]]


def bitmap(h: np.ndarray) -> bytes:
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << max(0, len(h) - 1).bit_length()))
    out = np.zeros(bits, bool)
    out[(h & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def _heat(docs: DataFrame, words: int) -> np.ndarray:
    """How many n-grams of all rows fall into each cell, by the upper 20 bits of their hash.

    Only an order is made of it, so cells that several n-grams share do no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for b in batches:
            for raw in b.column(0).to_pylist():
                h = shingle_set(raw, words)
                np.add.at(cells, (h >> np.uint64(44)).astype(np.int64), 1)
        for i, strip in enumerate(cells.reshape(-1, STRIP)):
            if strip.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([strip.tobytes()], pa.binary())], names=["i", "n"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in t.column("n").to_pylist())
        return pa.table({"i": t.column("i").slice(0, 1), "n": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((CELLS // STRIP, STRIP), np.int64)
    parts = docs.select(F.col("text").cast("binary").alias("raw")).mapInArrow(run, "i long, n binary")
    for r in parts.groupBy("i").applyInArrow(add, "i long, n binary").collect():  # 64 rows, 8 MB in all
        out[r.i] = np.frombuffer(r.n, np.int64)
    return out.reshape(-1)


def _profiles(docs: DataFrame, heat, words: int, percent: int) -> DataFrame:
    """(doc_id, node, n, bits, keys): size, bitmap and prefix of each row's set; ``node`` tells equal texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, bits, keys = [], [], []
            for raw in b.column(2).to_pylist():
                h = shingle_set(raw, words)
                n.append(len(h))
                bits.append(bitmap(h))
                keys.append(prefix(h, heat.value, percent).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(bits, pa.binary()), pa.array(keys, pa.binary())], names=["doc_id", "node", "n", "bits", "keys"])

    return _texts(docs).mapInArrow(run, "doc_id long, node long, n long, bits binary, keys binary")


def tiles_of(key: np.ndarray, node: np.ndarray, band: np.ndarray) -> Iterator[np.ndarray]:
    """Positions of the rows of each tile that has two rows or more and one of its own band."""
    order = np.lexsort((node, band, key))
    k = key[order]
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    end = np.append(start[1:], len(k))
    for a, z in zip(start[end - start > 1], end[end - start > 1], strict=True):
        rows = order[a:z]
        bands = band[rows]
        own = np.unique(bands)
        for x in own:
            lo, hi = np.searchsorted(bands, [x, x + 2])
            if hi - lo > 1:
                yield rows[lo:hi]


def _tiles(distinct: DataFrame, percent: int) -> DataFrame:
    """(tile, m, node): the members of each tile; tiles with the same members are one.

    Prefixes go to the grouping tasks as packed arrays, one shuffle of 18 bytes
    a prefix n-gram.
    """
    edges = band_edges(percent)
    total = distinct.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    parts = max(1, total // 8 // TASK_KEYS)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [np.frombuffer(x, np.uint64) for x in b.column(2).to_pylist()]
            if not (counts := np.array([len(k) for k in keys])).sum():
                continue
            key = np.concatenate(keys)
            node = np.repeat(b.column(0).to_numpy(), counts)
            band = np.repeat(np.searchsorted(edges, b.column(1).to_numpy(), side="right").astype(np.uint16), counts)
            part = (key % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            groups = np.split(order, np.flatnonzero(np.diff(part[order])) + 1)
            cols = [pa.array([int(part[g[0]]) for g in groups], pa.int64()), *(pa.array([c[g].tobytes() for g in groups], pa.binary()) for c in (key, node, band))]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "key", "node", "band"])

    def meet(t: pa.Table) -> pa.Table:
        key, node, band = (np.frombuffer(b"".join(t.column(c).to_pylist()), kind) for c, kind in (("key", np.uint64), ("node", np.int64), ("band", np.uint16)))
        x = node.view(np.uint64) * _MULTIPLIER
        mark = (x ^ (x >> np.uint64(31))) * _MULTIPLIER
        seen, tile, m, who = set(), [], [], []
        for rows in tiles_of(key, node, band):
            name = int(mark[rows].sum(dtype=np.uint64).view(np.int64))
            if name not in seen:
                seen.add(name)
                tile.append(np.full(len(rows), name))
                m.append(np.full(len(rows), len(rows)))
                who.append(node[rows])
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return pa.table({"tile": pa.array(join(tile), pa.int64()), "m": pa.array(join(m), pa.int64()), "node": pa.array(join(who), pa.int64())})

    packed = distinct.select("node", "n", "keys").mapInArrow(split, "part long, key binary, node binary, band binary")
    return packed.repartition(int(parts), "part").groupBy("part").applyInArrow(meet, "tile long, m long, node long").distinct()


def bounded_links(n: np.ndarray, bits: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that sizes and bitmaps leave.

    A group is found from its first row outwards; each of its rows is compared
    with those that no group has yet.
    """
    width = min(len(b) for b in bits)
    # a longer bitmap is folded onto the shortest one's bits
    maps = np.stack([np.bitwise_or.reduce(b.reshape(-1, width), axis=0) for b in bits]).view(np.uint64)
    ones = np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
    open_, kept = np.arange(len(n)), []
    while len(open_) > 1:
        front, open_ = [int(open_[0])], open_[1:]
        while front and len(open_):
            x = front.pop()
            need = least_overlap(n[open_], n[x], percent)
            fits = np.flatnonzero(np.minimum(n[open_], n[x]) >= need)
            both = np.bitwise_count(maps[open_[fits]] & maps[x]).sum(axis=1, dtype=np.int64)
            # a bit of one side alone is an n-gram that the other lacks
            most = np.minimum(n[x] - (ones[x] - both), n[open_[fits]] - (ones[open_[fits]] - both))
            found = fits[most >= need[fits]]
            if len(found):
                got = open_[found].tolist()
                kept += [(x, y) for y in got]
                front += got
                open_ = np.delete(open_, found)
    return kept


def _candidates(tiles: DataFrame, distinct: DataFrame, percent: int, block_rows: int) -> DataFrame:
    """Edges (u, v) that span, within each tile, what sizes and bitmaps don't rule out.

    Small tiles share tasks; a tile of more than ``block_rows`` sets is cut into
    blocks, and each two blocks meet in a task.
    """
    tasks = max(1, -(-tiles.count() // 8_192))
    blocks = F.ceil(F.col("m") / block_rows).cast("long")
    block = F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks"))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    cut = tiles.withColumn("blocks", blocks).withColumn("block", block).withColumn("at", F.explode(F.when(F.col("blocks") == 1, others).otherwise(F.filter(others, lambda x: x.i < x.j))))
    cut = cut.withColumn("task", F.when(F.col("blocks") > 1, F.col("tile")).otherwise(F.pmod("tile", F.lit(tasks))))
    dealt = cut.select((F.col("blocks") > 1).alias("big"), "task", "at.i", "at.j", "tile", "node").join(distinct.select("node", "n", "bits"), "node")

    def search(t: pa.Table) -> pa.Table:
        tile, node, n = (t.column(c).to_numpy() for c in ("tile", "node", "n"))
        bits = [np.frombuffer(x, np.uint8) for x in t.column("bits").to_pylist()]
        order = np.lexsort((node, tile))
        pairs = []
        for part in np.split(order, np.flatnonzero(np.diff(tile[order])) + 1):
            pairs += [(int(part[x]), int(part[y])) for x, y in bounded_links(n[part], [bits[k] for k in part], percent)]
        pairs = np.array(pairs, np.int64).reshape(-1, 2)
        return pa.table({"u": node[pairs[:, 0]], "v": node[pairs[:, 1]]})

    return dealt.groupBy("big", "task", "i", "j").applyInArrow(search, "u long, v long").distinct()


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def exact_links(sets: list[np.ndarray], home: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the linked pairs of a home row and another row, by intersections of their sorted sets.

    Each pair whose ends are still apart is compared, so no failing pair hides another.
    """
    percent = round(threshold * 100)
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    n, at_home = np.array([len(sets[i]) for i in order], np.int64), home[order]
    label, kept = np.arange(len(n)), []
    for x in np.flatnonzero(at_home)[::-1].tolist():
        fits = np.flatnonzero(np.minimum(n, n[x]) >= least_overlap(n, n[x], percent))
        fits = fits[(~at_home[fits] | (fits < x)) & (label[fits] != label[x])]
        for y in fits[::-1].tolist():
            if label[x] != label[y] and overlap(sets[order[x]], sets[order[y]]) >= least_overlap(n[x], n[y], percent):
                kept.append((order[x], order[y]))
                label[label == label[y]] = label[x]
    return kept


def ngram_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block_rows: int = BLOCK_ROWS, group_shingles: int = 2_000_000) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles long, component_id.

    Two rows link when 100 times their sets' intersection is at least
    ``percent`` times the union; ``component_id`` is the smallest doc_id that
    links reach, null ids left aside.  No linked pair is lost, whatever its
    n-grams' counts.  Equal texts, repeated rows and shared ids are one set in
    the search and rows of their own in the result.

    A row without words or text has an empty set, no links and its own id as
    component; a text of fewer words is one n-gram.  A text of any length is
    taken whole.  Columns besides the two are not read; an empty table gives an
    empty table.
    """
    spark = docs.sparkSession
    heat = spark.sparkContext.broadcast(_heat(docs, words))
    prof = materialise(_profiles(docs, heat, words, percent), "ngram-profiles")
    distinct = materialise(prof.where("n > 0").select("node", "n", "bits", "keys").dropDuplicates(["node"]), "ngram-sets")
    tiles = materialise(_tiles(distinct, percent), "ngram-tiles")
    likely = materialise(_candidates(tiles, distinct, percent, block_rows), "ngram-likely")
    sure = materialise(_verified(docs, distinct.select("node", "n"), components(likely), words, percent / 100, group_shingles, shingle_set, exact_links), "ngram-sure")
    first = prof.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least_id"))
    groups = materialise(first.join(components(sure), "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("group")), "ngram-groups")
    least = groups.groupBy("group").agg(F.min("least_id").alias("component_id"))
    of_node = groups.join(least, "group").select("node", "component_id")
    rows = prof.select("doc_id", "node", F.col("n").alias("n_shingles"))
    linked = rows.where("n_shingles > 0").join(of_node, "node").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


ORACLE = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (select distinct doc_id, array_to_string(w[i:i + {WORDS - 1}], ' ') as s from
  (select doc_id, w, unnest(range(1, greatest(len(w) - {WORDS - 2}, 2))) as i from w where len(w) > 0)),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
both_ as (select a.doc_id as u, b.doc_id as v, count(*) as k from s a join s b using (s) where a.doc_id < b.doc_id group by all),
half as materialized (select u, v from both_ join n x on u = x.doc_id join n y on v = y.doc_id where 100 * k >= {PERCENT} * (x.n + y.n - k)),
link as materialized (select u, v from half union all select v, u from half),
reach(a, b) as (select doc_id, doc_id from n union select a, v from reach join link on b = u),
c as (select a as doc_id, min(b) as component_id from reach group by a)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(component_id, d.doc_id) as component_id
from documents d left join n using (doc_id) left join c using (doc_id)
"""
