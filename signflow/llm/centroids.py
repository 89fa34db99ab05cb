"""Lloyd's clustering of integer vectors with exact assignments.

Every distance that decides is exact.  A float32 matrix product gives all dot
products of a batch at once; its rounding error has a rigorous bound, so each
centroid's distance lies in an interval.  A centroid whose interval lies above
another's can't be nearest.  Where one is left it is the answer; where several
overlap, their distances are worked out in integers and ties go to the lowest
number.

Centroids are few (k times d numbers); they go to the tasks with the function,
and a round brings back sums per cluster, added up on Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signflow.llm.common import materialise, table

DIM, K, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Largest magnitude of an integer component for which squared distances fit a long, up to 1,024 components.
LARGEST = 1 << 25
#: Relative error of a float32 operation.
UNIT = 2.0**-24


def kept_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id long, v array<int>): the rows whose vector has ``dim`` components, none null or non-finite, as floor(scale * x).

    A null vector goes; a null id and repeated rows stay.  A component beyond
    ``LARGEST`` in magnitude is an error, as distances would not fit a long.
    Other columns are not read.
    """
    whole = F.transform("x", lambda c: F.floor(F.lit(float(scale)) * c))
    df = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    df = df.where((F.size("x") == dim) & F.forall("x", lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(c)))
    far = F.exists("x", lambda c: F.abs(c) * float(scale) > float(LARGEST))
    return df.select("vec_id", F.when(far, F.raise_error(F.lit(f"a component times {scale} passes {LARGEST}"))).otherwise(whole).cast("array<int>").alias("v"))


def first_centroids(kept: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:vec_id``, in that order; null ids come last, ties go by the vector."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.orderBy(key.asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def error_bound(length: int) -> float:
    """What a float32 dot product of rounded inputs may be off, as a share of the product of the two norms.

    ``length`` products and sums and the rounding of both inputs, in any order
    of summation, and a margin for the float64 arithmetic of the intervals.
    """
    n = length + 3
    return n * UNIT / (1 - n * UNIT) * (1 + 1e-9)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The exactly nearest row of ``c`` of each row of ``x`` (both int64), lowest number on ties."""
    with np.errstate(over="ignore"):
        dots = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    x2, c2 = (x * x).sum(axis=1).astype(np.float64), (c * c).sum(axis=1).astype(np.float64)
    # the part of the distance that depends on the centroid: |c|^2 - 2 x.c
    part = c2[None, :] - 2 * dots
    norms = np.sqrt(x2)[:, None] * np.sqrt(c2)[None, :]
    off = 2 * error_bound(x.shape[1]) * norms + 2.0**-50 * (c2[None, :] + 2 * np.abs(dots))
    left = part - off <= (part + off).min(axis=1)[:, None]
    best = left.argmax(axis=1)
    row, number = np.nonzero(left & (left.sum(axis=1) > 1)[:, None])
    if len(row):
        exact = np.empty(len(row), np.int64)
        for at in range(0, len(row), 1 << 14):
            s = slice(at, at + (1 << 14))
            exact[s] = ((x[row[s]] - c[number[s]]) ** 2).sum(axis=1)
        order = np.lexsort((number, exact, row))
        first = np.flatnonzero(np.diff(row[order], prepend=-1))
        best[row[order][first]] = number[order][first]
    return best


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def _sums(vectors: DataFrame, c: np.ndarray) -> list:
    """(cluster, n, sums of each component) of every cluster that has vectors."""
    k, dim = c.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0), dim)
                best = nearest(x, c)
                order = np.argsort(best, kind="stable")
                at = np.flatnonzero(np.diff(best[order], prepend=-1))
                total[best[order][at]] += np.add.reduceat(x[order], at, axis=0)
                n += np.bincount(best, minlength=k)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), *(pa.array(total[some, i]) for i in range(dim))], names=["cluster", "n", *(f"s{i}" for i in range(dim))])

    schema = ", ".join(["cluster long", "n long", *(f"s{i} long" for i in range(dim))])
    parts = vectors.select("v").mapInArrow(run, schema)
    # at most k rows a task; sums in decimals, so that no number of rows overflows
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col(f"s{i}").cast("decimal(38,0)")) for i in range(dim))).alias("s"))
    return added.collect()


def fit(vectors: DataFrame, c: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids after ``rounds`` rounds: floor(sum / count) of each component, exactly; a cluster without vectors keeps its centroid."""
    for _ in range(rounds):
        moved = c.copy()
        for r in _sums(vectors, c):
            moved[r.cluster] = [int(s) // r.n for s in r.s]
        c = moved
    return c


def assign(vectors: DataFrame, c: np.ndarray) -> DataFrame:
    """(vec_id, cluster int, distance long): the nearest centroid and the squared distance to it."""
    dim = c.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dim)
            best = nearest(x, c)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best.astype(np.int32)), pa.array(((x - c[best]) ** 2).sum(axis=1))], names=["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, cluster int, distance long")


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors of another length, with a null or non-finite component, or null,
    are left out (see ``kept_vectors``).  With fewer than ``k`` vectors there
    are as many centroids as vectors; equal centroids are allowed, the lower
    number gets the vectors.  A table without kept vectors gives an empty
    result.  Repeated rows are rows of their own; columns besides the two named
    ones are not read.
    """
    kept = materialise(kept_vectors(vectors, dim, scale, id_col, vector_col), "vectors")
    c = first_centroids(kept, k, seed)
    if not len(c):
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    c = fit(kept, c, rounds)
    out = materialise(assign(kept, c), "assigned")
    # k rows
    inertia = {r.cluster: r.d for r in out.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}

    def of_cluster(values: list, kind: str) -> Column:
        return F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cluster") + 1)

    return out.withColumns(
        {
            "cluster_inertia": of_cluster([inertia.get(i, 0) for i in range(len(c))], "long"),
            "inertia": F.lit(sum(inertia.values())).cast("long"),
            "centroid_sha256": of_cluster([digest(x) for x in c], "string"),
        }
    )


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    rounds = [
        f"""kept as materialized (select vec_id, list_transform(embedding, lambda x: floor({SCALE}::double * x::double)::bigint) as v from embeddings
  where len(embedding) = {DIM} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
x as materialized (select vec_id, unnest(range({DIM})) as i, unnest(v) as x from kept),
seeded as (select vec_id, row_number() over (order by sha256('{SEED}:' || vec_id)) - 1 as c from kept qualify c < {K}),
c0 as materialized (select c, i, x as y from seeded join x using (vec_id))"""
    ]
    for r in range(ROUNDS + 1):
        rounds.append(
            f"""a{r} as materialized (select vec_id, c, d from (select vec_id, c, sum((x - y) * (x - y))::bigint as d from x join c{r} using (i) group by vec_id, c)
  qualify row_number() over (partition by vec_id order by d, c) = 1)"""
        )
        if r < ROUNDS:
            rounds.append(
                f"""m{r} as (select c, i, sum(x)::hugeint as s, count(*)::hugeint as n from a{r} join x using (vec_id) group by c, i),
c{r + 1} as materialized (select o.c, o.i, coalesce((s - ((s % n) + n) % n) // n, o.y)::bigint as y from c{r} o left join m{r} m on o.c = m.c and o.i = m.i)"""
            )
    return f"""with {", ".join(rounds)},
h as (select c, sha256(string_agg(y::varchar, ',' order by i)) as centroid_sha256 from c{ROUNDS} group by c)
select vec_id, c::int as cluster, d as distance, sum(d) over (partition by c)::bigint as cluster_inertia, sum(d) over ()::bigint as inertia, centroid_sha256
from a{ROUNDS} join h using (c)"""


ORACLE = _oracle()
