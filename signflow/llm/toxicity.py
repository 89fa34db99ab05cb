"""Toxicity by non-negative positive-unlabelled learning.

The learner sees confirmed toxic texts and unlabelled texts.  Its risk is
``prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])`` with the
logistic loss, where the unlabelled part is corrected by the class prior and
kept from falling below zero.  The model is linear on the words and the word
beginnings that a text has, and its bias is set so that the mean score over the
unlabelled sample is the prior.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signflow.llm.common import held_out, materialise, table, within_bytes

WORD = re.compile(r"\w+")
PREFIXES = (4, 5, 6, 7)
#: A feature counts once, and again when two and when three distinct words of a text have it.
LEVELS = 3
#: Standard errors by which a feature's share among the toxic must exceed that among all.
MIN_Z = 4.0
#: Bounds of the samples the classifier is fitted on; they don't grow with the corpus.
MAX_POSITIVE = 3_000
MAX_UNLABELLED = 6_000
#: Bytes of the sample's distinct words, whatever the texts' lengths.
MAX_BYTES = 64 << 20
MAX_FEATURES = 4_096
THRESHOLD = 0.3
#: The class prior where no row is labelled.
DEFAULT_PRIOR = 0.1


def word_features(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:k] for k in PREFIXES if len(word) > k)]


def text_words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


class Found(dict):
    """From a word to the numbers of its features in ``index``; bounded."""

    def __init__(self, index: dict[str, int]) -> None:
        self.index = index

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 100_000:
            self.clear()
        self[word] = got = tuple(self.index[f] for f in word_features(word) if f in self.index)
        return got

    def slots(self, words: set[str]) -> list[int]:
        """``LEVELS * feature + level`` for each level that the number of a text's distinct words with a feature reaches."""
        count: dict[int, int] = {}
        for w in words:
            for f in self[w]:
                count[f] = count.get(f, 0) + 1
        return sorted(LEVELS * f + k for f, c in count.items() for k in range(min(c, LEVELS)))


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray
    bias: float

    def scorer(self):
        """A function from text to score."""
        found, weights, bias = Found(self.index), self.weights.tolist(), self.bias

        def score(text: str | None) -> float:
            z = bias + sum(weights[i] for i in found.slots(text_words(text)))
            return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))

        return score


def fit(positive: list[set[str]], unlabelled: list[set[str]], prior: float, **how) -> Model:
    """``fit_slots`` on texts given as sets of words."""
    least, seen = least_texts(len(positive)), {}
    for words in positive:
        for f in {f for w in words for f in word_features(w)}:
            seen[f] = seen.get(f, 0) + 1
    names = sorted(f for f, k in seen.items() if k >= least)
    found = Found({f: i for i, f in enumerate(names)})
    return fit_slots(names, *([np.array(found.slots(words), np.int32) for words in docs] for docs in (positive, unlabelled)), prior, **how)


def least_texts(positive: int) -> int:
    """Positive texts that a feature must be in."""
    return max(3, positive // 100)


def fit_slots(names: list[str], positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 400, l2: float = 3e-5, rate: float = 0.1, limit: int = MAX_FEATURES) -> Model:
    """Fit the non-negative PU risk with full-batch Adam on the features that set the two samples apart most.

    ``names`` are the candidate features, a text is the array of its slots (see
    ``Found.slots``).  Without positive texts nothing is toxic; without
    unlabelled texts, or features that tell, the model knows only the prior.
    """
    odds = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return Model({}, np.zeros(0), odds if positive else -50.0)
    n_p, n_u = len(positive), len(unlabelled)
    least = least_texts(n_p)

    def matrix(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(docs), dtype=np.int32), [len(g) for g in docs]), np.concatenate(docs)

    (rp, cp), (ru, cu) = matrix(positive), matrix(unlabelled)
    d = LEVELS * len(names)
    k, u = np.bincount(cp, minlength=d), np.bincount(cu, minlength=d)
    pooled = (k + u) / (n_p + n_u)
    z = (k / n_p - u / n_u) / np.sqrt(np.maximum(1e-12, pooled * (1 - pooled) * (1 / n_p + 1 / n_u)))
    z[(k < least) | (z < MIN_Z)] = 0
    use = np.zeros(d, bool)
    use[np.argsort(-z, kind="stable")[:limit]] = True
    use &= z > 0
    if not use.any():
        return Model({}, np.zeros(0), odds)
    rp, cp, ru, cu = rp[use[cp]], cp[use[cp]], ru[use[cu]], cu[use[cu]]
    w, b = np.zeros(d), odds
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    for t in range(1, rounds + 1):
        zp, zu = np.bincount(rp, w[cp], n_p) + b, np.bincount(ru, w[cu], n_u) + b
        below = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp, gu = -prior * sig(-zp) / n_p, np.zeros(n_u)
        # the corrected negative risk; where it is below zero, its gradient is turned round
        side = 1.0 if below >= 0 else -1.0
        if side < 0:
            gp = np.zeros(n_p)
        gp = gp - side * prior * sig(zp) / n_p
        gu = side * sig(zu) / n_u
        g = np.append(np.bincount(cp, gp[rp], d) + np.bincount(cu, gu[ru], d) + l2 * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = np.where(use, w - step[:-1], 0.0), b - step[-1]
    # the mean posterior over the unlabelled sample is the prior; a small sample can leave the bias elsewhere
    z, low, high = np.bincount(ru, w[cu], n_u), -50.0, 50.0
    for _ in range(60):
        b = (low + high) / 2
        low, high = (low, b) if sig(z + b).mean() > prior else (b, high)
    kept = np.flatnonzero(use.reshape(-1, LEVELS).any(axis=1))
    return Model({names[f]: i for i, f in enumerate(kept)}, w.reshape(-1, LEVELS)[kept].ravel(), float(b))


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_bytes: int = MAX_BYTES) -> Model:
    """Fit on rows outside the held-out quarter.

    The prior is the share of toxic rows among all labelled ones.  Positive ids
    are a sample of at most ``max_positive``, so that they may be broadcast;
    about ``max_unlabelled`` texts are drawn by a hash of their id; of both, as
    many as have words of ``max_bytes`` in all.  Rows that
    share an id count as one, rows with a null id teach nothing; without
    labels, or without texts, the model knows only the prior.  The sample's
    features are counted on Spark; the driver gets the numbers of those that
    enough positive texts have.
    """
    known = labels.where(~held_out() & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    prior = min(0.9, max(1e-3, toxic / n)) if n and toxic else DEFAULT_PRIOR
    chosen = known.where("toxic = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positive)
    ids = docs.sparkSession.createDataFrame([(r[0], True) for r in chosen.collect()], "pos_id long, pos boolean")
    rest = docs.where(~held_out()).select("doc_id", "text")
    total = rest.count()
    share = min(1.0, max_unlabelled / max(1, total))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("unlabelled")), F.lit(1 << 30)) < int(share * (1 << 30))
    picked = rest.join(F.broadcast(ids), F.col("doc_id") == F.col("pos_id"), "left").withColumn("draw", draw).where("pos or draw").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("pos", F.lit(False)).alias("pos"), "draw", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = pa.array([" ".join(sorted(text_words(x))) for x in b.column(3).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), words], names=["doc_id", "pos", "draw", "words"])

    told = picked.mapInArrow(run, "doc_id long, pos boolean, draw boolean, words string")
    once = materialise(told.groupBy("doc_id", "pos", "draw").agg(F.min("words").alias("words")).select("pos", "draw", "words"), "toxicity-sample")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(sorted({f for w in words.split() for f in word_features(w)}), pa.string())], names=["f"])

    once = within_bytes(once, F.octet_length("words"), F.xxhash64("words"), max_bytes)
    positive = once.where("pos")
    enough = least_texts(positive.count())
    names = [r[0] for r in positive.select("words").mapInArrow(features, "f string").groupBy("f").count().where(F.col("count") >= enough).select("f").orderBy("f").collect()]
    shared = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found(shared.value)
        for b in batches:
            got = [np.array(found.slots(set(words.split())), "<i4").tobytes() for words in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.binary())], names=["pos", "draw", "slots"])

    # in an order of their own, so that sums of floats don't depend on how the rows were spread
    got = sorted(once.mapInArrow(slots, "pos boolean, draw boolean, slots binary").collect(), key=lambda r: (bytes(r[2]), r[0], r[1]))
    rows = [(r[0], r[1], np.frombuffer(r[2], "<i4")) for r in got]
    return fit_slots(names, [x for pos, _, x in rows if pos], [x for _, drawn, x in rows if drawn], prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): whole texts, however long; a null or empty text gets the score of a text without words; null ids and repeated rows stay; an empty table gives an empty one; other columns, whatever their names, are not read."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([of(x) for x in b.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def clean_rows(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``threshold``.

    Null and empty texts score as a text without words does; null ids and
    repeated rows are rows of their own; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.scorer()
        for b in batches:
            yield b.filter(pa.array([of(x) < threshold for x in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
