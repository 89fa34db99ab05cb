"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of character n-grams (one to three characters,
hashed).  The weights are trained with follow-the-regularised-leader and an
elastic net, and the confidence is calibrated with a temperature on rows that
training did not see.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signflow.llm.common import held_out, materialise, table, within_bytes

BITS = 15
#: Rows of each language that the classifier is fitted on, about; it doesn't grow with the corpus.
ROWS_PER_LANG = 1_000
#: Rows of all languages together that the classifier is fitted on, about.
MAX_ROWS = 20_000
#: Bytes of n-gram counts that the driver gets, whatever the texts' lengths.
MAX_BYTES = 64 << 20
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
SPACES = re.compile(r"\s+")


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets and counts of a whole text's character n-grams, case-folded, runs of white space as one space."""
    c = np.frombuffer(f" {SPACES.sub(' ', text.lower()).strip()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    one = c * np.uint32(0x9E3779B1)
    two = one[:-1] * np.uint32(0x85EBCA6B) + one[1:]
    three = two[:-1] * np.uint32(0x85EBCA6B) + one[2:]
    h = np.concatenate([one, two + np.uint32(0x27D4EB2F), three + np.uint32(0x165667B1)])
    h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE35)
    n = np.bincount(h >> np.uint32(32 - BITS), minlength=1 << BITS)
    at = np.flatnonzero(n)
    return at, n[at]


def weigh(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(n) * idf[at]
    return x / max(float(np.sqrt(x @ x)), 1e-12)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.bias + weigh(at, n, self.idf) @ self.weights[at]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its calibrated probability; ``und`` and 0 for null or letterless texts, or without a learned language."""
        if not self.langs or not text or not LETTER.search(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(*ngrams(text)) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 7) -> Model:
    """FTRL-proximal over ``rows`` (language, buckets, counts), then a temperature on each fifth row, which FTRL doesn't see."""
    langs = sorted({r[0] for r in rows})
    k, d = len(langs), len(idf)
    z, g2 = np.zeros((d + 1, k)), np.zeros((d + 1, k))
    if not k:
        return Model([], z[:-1], z[-1], idf)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    hold = order[:: 5] if len(rows) >= 50 else order[:0]
    train = np.setdiff1d(order, hold)
    data = [(langs.index(lang), np.append(at, d).astype(np.int32), np.append(weigh(at, n, idf), 1.0).astype(np.float32)) for lang, at, n in rows]

    def solve(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(train):
            y, at, x = data[i]
            zi, ni = z[at], g2[at]
            w = solve(zi, ni)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            new = ni + g * g
            z[at] = zi + g - (np.sqrt(new) - np.sqrt(ni)) / alpha * w
            g2[at] = new
    w = solve(z, g2)
    model = Model(langs, w[:-1], w[-1], idf)
    if len(hold):
        scores = [(y, x @ w[at]) for y, at, x in (data[i] for i in hold)]
        grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
        loss = [sum(-np.log(max(1e-12, softmax(s / t)[y])) for y, s in scores) for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def train(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """Learn from text and non-null lang of the rows outside the held-out quarter.

    Document frequencies are counted over all those rows; about
    ``rows_per_lang`` rows of each language, and ``max_rows`` of all, drawn by a
    hash of their id, are sent to the driver as n-gram counts, of at most
    ``max_bytes``: where long texts pass that, fewer rows of each language are
    drawn.  Rows that share
    an id and a language count as one, that of the least text; rows with a null
    id, text or lang teach nothing; without rows the model knows no language.
    """
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    per = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}

    def df_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs_seen = np.zeros(1 << BITS, np.int64), 0
        for b in batches:
            for text in b.column(0).to_pylist():
                df[ngrams(text)[0]] += 1
                docs_seen += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], docs_seen))], names=["bucket", "n"])

    counted = dict(tuple(r) for r in rows.select("text").mapInArrow(df_run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect())
    total = counted.pop(-1, 0)
    df = np.zeros(1 << BITS)
    for bucket, n in counted.items():
        df[bucket] = n
    idf = np.log((1 + total) / (1 + df)) + 1

    most = min(rows_per_lang, max_rows / max(1, len(per)))
    rates = {k: min(1.0, most / n) for k, n in per.items()}
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(int(v * (1 << 30)))) for k, v in sorted(rates.items())], F.lit(0))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) < share).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [ngrams(x) for x in b.column(2).to_pylist()]
            cols = [b.column(0), b.column(1), pa.array([g[0].astype("<u2").tobytes() for g in got], pa.binary()), pa.array([g[1].astype("<u4").tobytes() for g in got], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang", "at", "n"])

    told = materialise(drawn.mapInArrow(take, "doc_id long, lang string, at binary, n binary"), "langid-sample")
    # a row's place among those drawn of its language, as a share, so that each language gives way alike
    place = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) / F.greatest(share, F.lit(1))
    got = within_bytes(told, F.octet_length("at") + F.octet_length("n"), place, max_bytes).collect()
    sample = sorted((r for r in got), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
    return fit([(r[1], np.frombuffer(r[2], "<u2"), np.frombuffer(r[3], "<u4")) for r in sample], idf)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for each row's whole text, however long; null ids and repeated rows stay, an empty table gives an empty table; other columns, whatever their names, are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [m.predict(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def known_rows(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a known language with a score of ``least``; without a learned language, those with letters.

    Null, empty and letterless texts go; null ids and repeated rows are rows of
    their own; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def known(m: Model, text: str | None) -> bool:
        if not m.langs:
            return bool(text and LETTER.search(text))
        lang, score = m.predict(text)
        return lang != UNKNOWN and score >= least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            yield b.filter(pa.array([known(m, x) for x in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict(docs, train(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
