"""Target-distribution importance resampling over hashed word runs.

Runs of one to n words fall into buckets by CRC-32.  What the target has more
of in a bucket than the corpus gains, and a document's weight is its features'
mean gain.  Documents are drawn without replacement by weight plus Gumbel noise
from a hash of their id, so that a run repeats.

Long texts are skewed work: they are cut at word boundaries into chunks that
Spark deals out.  A chunk owns the runs that start in it and carries the n - 1
words after it; counts and gains of chunks are added up per text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signflow.functions.storage import numbered
from signflow.llm.common import materialise, table

NGRAM, BUCKETS, SEED, MIN_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
#: Bytes of a chunk, and of a text that stays whole.
CHUNK_BYTES = 1 << 14

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_OTHER = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: A-Z to lower case, and what parts words to a space.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@lru_cache(1 << 18)
def _bucket(run: bytes, buckets: int) -> int:
    return zlib.crc32(run) % buckets


def features(raw: bytes | None, ngram: int = NGRAM, buckets: int = BUCKETS, own: int | None = None) -> tuple[int, np.ndarray]:
    """(words, buckets of the runs) of a text's UTF-8 bytes; of a chunk only what starts in its first ``own`` bytes."""
    if not raw:
        return 0, np.zeros(0, np.int64)
    words = raw.translate(_PLAIN).split()
    mine = len(words) if own is None or own >= len(raw) else len(raw[:own].translate(_PLAIN).split())
    out = [_bucket(w, buckets) for w in words[:mine]]
    for n in range(2, ngram + 1):
        out += [_bucket(b" ".join(words[i : i + n]), buckets) for i in range(min(mine, len(words) - n + 1))]
    return mine, np.array(out, np.int64)


def chunks(raw: bytes, size: int = CHUNK_BYTES, ngram: int = NGRAM) -> Iterator[tuple[bytes, int]]:
    """(bytes, bytes of its own) of each chunk: cut at the first boundary past ``size``, with the next ngram - 1 words carried."""
    at = 0
    while at < len(raw):
        cut = _OTHER.search(raw, at + size) if at + size < len(raw) else None
        end = cut.start() if cut else len(raw)
        stop = end
        for _ in range(ngram - 1):
            word = _WORD.search(raw, stop)
            stop = word.end() if word else len(raw)
        yield raw[at:stop], end - at
        at = end


def _pieces(docs: DataFrame, ngram: int, size: int) -> DataFrame:
    """(key, piece, own) of the distinct texts longer than ``size`` bytes, dealt out chunk by chunk."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, raw in zip(b.column(0), b.column(1), strict=True):
                parts = list(chunks(raw.as_py(), size, ngram))
                for at in range(0, len(parts), 256):
                    some = parts[at : at + 256]
                    cols = [pa.array([key.as_py()] * len(some), pa.int64()), pa.array(range(at, at + len(some)), pa.int64()), pa.array([p for p, _ in some], pa.binary()), pa.array([n for _, n in some], pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, names=["key", "chunk", "piece", "own"])

    long_ = docs.where(F.octet_length("text") > size)
    once = long_.select(F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("raw")).dropDuplicates(["key"])
    return once.mapInArrow(cut, "key long, chunk long, piece binary, own long").repartition("key", "chunk").drop("chunk")


def _bucket_counts(rows: DataFrame, ngram: int, buckets: int) -> DataFrame:
    """(bucket, n) over (raw, own, times): a task returns at most one row per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for raw, own, times in zip(*(c.to_pylist() for c in b.columns), strict=True):
                np.add.at(total, features(raw, ngram, buckets, own)[1], times)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return rows.mapInArrow(run, "bucket long, n long")


def corpus_counts(docs: DataFrame, pieces: DataFrame | None, ngram: int = NGRAM, buckets: int = BUCKETS, size: int = CHUNK_BYTES) -> np.ndarray:
    """How many features of all rows fall into each bucket; ``pieces`` as of ``_pieces``, None where no text is cut."""
    one, none = F.lit(1).cast("long").alias("times"), F.lit(None).cast("long").alias("own")
    short = docs if pieces is None else docs.where(F.octet_length("text") <= size)
    parts = _bucket_counts(short.select(F.col("text").cast("binary").alias("raw"), none, one), ngram, buckets)
    if pieces is not None:
        copies = docs.where(F.octet_length("text") > size).groupBy(F.xxhash64("text").alias("key")).agg(F.count("*").alias("times"))
        parts = parts.unionByName(_bucket_counts(pieces.join(copies, "key").select(F.col("piece").alias("raw"), "own", "times"), ngram, buckets))
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r.bucket] = r.n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t + 1) * (S + B) / ((s + 1) * (T + B)))) of each of the B buckets."""
    all_s, all_t, b = float(corpus.sum()), float(target.sum()), float(len(corpus))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_s + b) / ((s + 1.0) * (all_t + b)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _gained(rows: DataFrame, gains: np.ndarray, ngram: int) -> DataFrame:
    """(key, n_words, n_features, gain) of (key, raw, own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(w, len(f), int(gains[f].sum())) for w, f in (features(raw, ngram, len(gains), own) for raw, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[i] for g in got], pa.int64()) for i in range(3))], names=["key", "n_words", "n_features", "gain"])

    return rows.mapInArrow(run, "key long, n_words long, n_features long, gain long")


def resample(docs: DataFrame, target: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, rank, all long.

    ``weight`` is the floored mean gain of the features, 0 without any; ``rank``
    numbers the drawn ones, floor(percent * N / 100) of the N documents with
    ``min_words`` words, by score, ties to the smaller id.

    A null or wordless text has no features and isn't drawn.  A row with a null
    id counts in the corpus, has no score and is neither in N nor drawn.
    Repeated rows are rows of their own and draw side by side.  Empty tables
    count as zero features.  A text of any length is read whole, in chunks.
    Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = materialise(_pieces(docs, ngram, chunk_bytes), "pieces")
    gains = bucket_gains(corpus_counts(docs, pieces, ngram, buckets, chunk_bytes), corpus_counts(target.select("text"), None, ngram, buckets))
    whole = F.coalesce(F.octet_length("text") <= chunk_bytes, F.lit(True))
    none = F.lit(None).cast("long").alias("own")
    short = _gained(docs.where(whole).select(F.col("doc_id").alias("key"), F.col("text").cast("binary").alias("raw"), none), gains, ngram).withColumnRenamed("key", "doc_id")
    of_text = _gained(pieces.select("key", F.col("piece").alias("raw"), "own"), gains, ngram).groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n_words", "n_features", "gain")))
    long_ = docs.where(~whole).select("doc_id", F.xxhash64("text").alias("key")).join(of_text, "key").drop("key")
    gumbel = F.floor(-1000 * F.ln(-F.ln((F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0))))
    rows = short.unionByName(long_).withColumn("weight", F.when(F.col("n_features") == 0, F.lit(0).cast("long")).otherwise(F.expr("(gain - pmod(gain, n_features)) div n_features")))
    rows = materialise(rows.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + gumbel).cast("long").alias("score")), "scores")
    may = (F.col("n_words") >= min_words) & F.col("doc_id").isNotNull()
    drawn = rows.where(may).count() * percent // 100
    ranked = numbered(rows.where(may), F.col("score").desc(), F.col("doc_id"), name="place")
    ranked = ranked.withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1)).drop("place")
    return ranked.unionByName(rows.where(~may).withColumn("rank", F.lit(None).cast("long")))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = rf"""
with recursive poly as (select i, 0 as k, i as c from range(256) t(i)
  union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from poly where k < 8),
tab as (select list(c order by i) as t from poly where k = 8),
texts as (select 0 as side, doc_id, text from documents union all select 1, item_id, text from benchmark),
word as materialized (select side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from texts),
crc as materialized (select w, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, octet_length(encode(w)) * 2, 2), lambda i: ('0x' || substring(hex(encode(w)), i, 2))::bigint)),
    lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % {BUCKETS} as b from (select distinct w from word), tab),
f as materialized (select side, doc_id, b, count(*) as n from word join crc using (w) group by all),
tot as (select coalesce(sum(n) filter (side = 0), 0)::double as s, coalesce(sum(n) filter (side = 1), 0)::double as t from f),
per as (select b, coalesce(sum(n) filter (side = 0), 0)::double as s, coalesce(sum(n) filter (side = 1), 0)::double as t from f group by b),
gain as materialized (select b, floor(1000 * ln((per.t + 1) * (tot.s + {BUCKETS}) / ((per.s + 1) * (tot.t + {BUCKETS}))))::bigint as g from per, tot),
doc as (select doc_id, sum(n)::bigint as n_features, sum(n * g)::bigint as gain from f join gain using (b) where side = 0 group by doc_id),
sc as (select d.doc_id, coalesce(n_features, 0) as n_features, coalesce((gain - ((gain % n_features) + n_features) % n_features) // n_features, 0)::bigint as weight,
  floor(-1000 * ln(-ln((('0x' || substring(sha256('{SEED}:' || d.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as noise
  from documents d left join doc using (doc_id)),
r as (select *, row_number() over (order by weight + noise desc, doc_id) as place, count(*) over () as n from sc where n_features >= {MIN_WORDS})
select sc.doc_id, sc.n_features, sc.weight, sc.weight + sc.noise as score, case when r.place <= {PERCENT} * r.n // 100 then r.place end as rank
from sc left join r using (doc_id)
"""
