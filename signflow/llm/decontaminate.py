"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item is in a document if at least ``threshold`` of its distinct word
shingles are.  Items are partitioned by size; for a partition whose largest
item has u shingles, an item's sketch is its ``floor((1 - threshold) * u) + 1``
least shingle hashes.  An item that is contained lacks fewer shingles than its
sketch has, so at least one of the sketch is in the document: candidates that
share a sketch hash miss nothing.  Documents with fewer shingles than an item
needs are passed over, and candidates are verified on the shingles themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signflow.llm.common import materialise, table

WORD = re.compile(r"\w+")
WORDS = 5
THRESHOLD = 0.8
#: Words of all items together up to which the items' index is broadcast; beyond, the search is a shuffled join.
MAX_INDEX_WORDS = 1_000_000
SCHEMA = "doc_id long, item_id long, n_item long, n_shared long, containment double"


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class WordHashes(dict):
    """From a white-space-separated part of a text to its words' hashes (64 bits each); bounded."""

    def __missing__(self, part: str) -> bytes:
        if len(self) > 200_000:
            self.clear()
        self[part] = got = np.array([xxhash.xxh64_intdigest(w) for w in WORD.findall(part)], np.uint64).tobytes()
        return got

    def of(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, (text or "").lower().split())), np.uint64)


_MULT = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` words, in their order."""
    if len(h) < n:
        return h[:0]
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * _MULT + h[i : len(h) - n + 1 + i]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def sketch_size(n: int, threshold: float) -> int:
    """Of an item of n shingles, by the largest size of its partition (a power of two)."""
    upper = 1 << (n - 1).bit_length()
    return min(n, int((1 - threshold) * upper + 1e-9) + 1)


class Index:
    """Sketches by window length, and the items' shingles to verify on."""

    def __init__(self, items: list[tuple[int, str]], words: int, threshold: float) -> None:
        self.items: list[tuple[int, int, frozenset[str], int]] = []
        lookup: dict[int, dict[int, list[int]]] = {}
        hashes = WordHashes()
        for item_id, text in items:
            w = words_of(text)
            size = min(words, len(w))
            if not size:
                continue
            shingles = frozenset(" ".join(w[i : i + size]) for i in range(len(w) - size + 1))
            h = np.unique(window_hashes(hashes.of(text), size))
            need = ceil(threshold * len(shingles) - 1e-9)
            k = len(self.items)
            self.items.append((item_id, size, shingles, need))
            for x in h[: sketch_size(len(shingles), threshold)].tolist():
                lookup.setdefault(size, {}).setdefault(x, []).append(k)
        self.lookup = {size: (np.array(sorted(d), np.uint64), d) for size, d in lookup.items()}

    def search(self, text: str | None, hashes: WordHashes) -> list[tuple[int, int, int]]:
        """(item_id, shingles of the item, how many of them the text has) of the items that the text contains."""
        h, found = hashes.of(text), []
        for size, (keys, items) in self.lookup.items():
            win = window_hashes(h, size)
            if not len(win):
                continue
            at = np.minimum(np.searchsorted(keys, win), len(keys) - 1)
            hits = np.unique(win[keys[at] == win]).tolist()
            if hits:
                w = words_of(text)
                own = {" ".join(w[i : i + size]) for i in range(len(w) - size + 1)}
                for k in sorted({k for x in hits for k in items[x]}):
                    item_id, _, shingles, need = self.items[k]
                    if len(own) >= need and (n := len(shingles & own)) >= need:
                        found.append((item_id, len(shingles), n))
        return found


#: Characters that a row of the index counts for besides its text.
ROW_CHARS = 64


def _with_text(items: DataFrame) -> DataFrame:
    """Items without a text match nothing and stay where they are."""
    return items.where(F.length("text") > 0)


def _cost(items: DataFrame) -> int:
    """What an index of the items takes, in characters: their texts, and so much for each row."""
    return items.agg(F.coalesce(F.sum(F.length("text") + ROW_CHARS), F.lit(0))).first()[0]


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, max_index_words: int = MAX_INDEX_WORDS, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs of a document and a test item that it contains: doc_id, item_id, n_item, n_shared, containment.

    Words are runs of letters, digits and underscores, lower-cased.  An item of
    fewer words than a shingle is one shingle.  Null and wordless texts match
    nothing; repeated rows give repeated pairs; null ids are kept as they are.
    The items' index is broadcast only below ``max_index_words``, rows counted
    with their texts; larger sets are searched with a join on sketch hashes.
    Empty tables give no pairs; texts of any length are taken whole; other
    columns, whatever their names, are not read.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    t = _with_text(items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")))
    if _cost(t) <= 8 * max_index_words:
        return _indexed(d, t, threshold, words)
    return _joined(d, t, threshold, words)


def _indexed(docs: DataFrame, items: DataFrame, threshold: float, words: int) -> DataFrame:
    index = docs.sparkSession.sparkContext.broadcast(Index([(r[0], r[1]) for r in items.collect()], words, threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            out = [(i, *found, found[2] / found[1]) for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for found in index.value.search(x, hashes)]
            cols = list(zip(*out)) if out else [()] * 5
            kinds = [pa.int64()] * 4 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "n_item", "n_shared", "containment"])

    return docs.mapInArrow(run, SCHEMA)


def clean_rows(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, max_index_words: int = MAX_INDEX_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no test item; rows with a null or wordless text stay."""
    t = _with_text(items.select(F.col("item_id").cast("long").alias("item_id"), "text"))
    if _cost(t) > 8 * max_index_words:
        # rows are told apart by a key of their own: ids may be null or shared
        keyed = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "decontaminate-rows")
        found = _joined(keyed.select(F.col("__row").alias("doc_id"), "text"), t, threshold, words).select(F.col("doc_id").alias("__row")).distinct()
        return keyed.join(found, "__row", "left_anti").select(*docs.columns)
    index = docs.sparkSession.sparkContext.broadcast(Index([(r[0], r[1]) for r in t.collect()], words, threshold))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            yield b.filter(pa.array([not index.value.search(x, hashes) for x in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _joined(docs: DataFrame, items: DataFrame, threshold: float, words: int) -> DataFrame:
    """The same search where the items are too many to broadcast.

    Hashes of the documents' shingles, of the window lengths that items have,
    meet the items' sketches; both texts of a candidate pair are then brought
    together and compared.  Shingles themselves are never stored or shuffled.
    """
    names = materialise(docs.withColumn("drow", F.monotonically_increasing_id()).select("drow", "doc_id", "text"), "decontaminate-docs")
    it = materialise(items.withColumn("trow", F.monotonically_increasing_id()).select("trow", "item_id", F.col("text").alias("item_text")), "decontaminate-items")

    def hashed(of_items: bool, sizes: tuple[int, ...] = ()):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for b in batches:
                for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    w = hashes.of(text)
                    for size in (min(words, len(w)),) if of_items else sizes:
                        h = np.unique(window_hashes(w, size)) if size else w[:0]
                        n = len(h)
                        h = h[: sketch_size(n, threshold)] if of_items and n else h
                        for at in range(0, len(h), 1 << 14):
                            part = h[at : at + (1 << 14)]
                            yield pa.RecordBatch.from_arrays([pa.array([row] * len(part), pa.int64()), pa.array([size] * len(part), pa.int32()), pa.array([n] * len(part), pa.int64()), pa.array(part.view(np.int64))], names=["row", "size", "n", "h"])

        return run

    kind = "row long, size int, n long, h long"
    ts = materialise(it.select("trow", "item_text").mapInArrow(hashed(True), kind), "decontaminate-sketches").alias("t")
    sizes = tuple(sorted(r[0] for r in ts.select("t.size").distinct().collect()))
    ds = names.select("drow", "text").mapInArrow(hashed(False, sizes), kind).alias("d")
    met = ds.join(ts, F.expr("d.size = t.size and d.h = t.h")).where("d.n >= ceil(t.n * %r - 1e-9)" % threshold)
    pairs = materialise(met.select(F.col("d.row").alias("drow"), F.col("t.row").alias("trow")).distinct(), "decontaminate-pairs")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            doc, text, item, item_text, drow = (b.column(i).to_pylist() for i in range(5))
            out = [(row, i, *f) for i, x, k, y, row in zip(doc, text, item, item_text, drow) for f in Index([(k, y)], words, threshold).search(x, hashes)]
            cols = list(zip(*[(i, k, n, m, m / n) for _, i, k, n, m in out])) if out else [()] * 5
            kinds = [pa.int64()] * 4 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "item_id", "n_item", "n_shared", "containment"])

    both = pairs.join(names, "drow").join(it, "trow").select("doc_id", "text", "item_id", "item_text", "drow")
    return both.mapInArrow(verify, SCHEMA)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = rf"""
with dw as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') as w from documents),
iw as (select item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') as w from benchmark),
ip as (select item_id, w, unnest(range(1, greatest(1, len(w) - {WORDS - 2}))) as i from iw where len(w) > 0),
its as (select distinct item_id, array_to_string(w[i:i + {WORDS - 1}], ' ') as s from ip),
n as (select item_id, count(*)::bigint as n_item from its group by item_id),
dp as (select doc_id, w, unnest(range(1, len(w) - {WORDS - 2})) as i from dw where len(w) >= {WORDS}),
ds as (select distinct doc_id, array_to_string(w[i:i + {WORDS - 1}], ' ') as s from dp),
c as (select doc_id, item_id, count(*)::bigint as n_shared from ds join its using (s) group by doc_id, item_id)
select doc_id, item_id, n_item, n_shared, n_shared / n_item as containment
from c join n using (item_id) where n_shared >= ceil({THRESHOLD} * n_item - 1e-9)
"""
