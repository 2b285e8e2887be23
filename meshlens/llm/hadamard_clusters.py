"""Operator 12, centroid clustering by a progressive Walsh-Hadamard search.

Vectors of exactly 64 finite components become integers floor(64 * x).  The exact integer Walsh-Hadamard transform of
vectors and centroids keeps squared distances up to the factor 64, so coefficients in order of sequency (coarse to
fine) give a growing lower bound of each distance.  Per vector, the centroid that leads after the first coefficients
is finished and bounds the search; a centroid goes as soon as its bound is strictly worse, and all 64 coefficients
are finished for those that are left.  Ties go to the smaller number, so the result is that of a full search.

Centroids start as the vectors of smallest sha256 of ``1:<vec_id>``; each round replaces every non-empty one by the
exact floor(sum / count) of its members.

Scale: one scan per round.  Tasks send partial sums (one row per centroid, component and limb of 32 bits, so no sum
overflows), which Spark adds up; only the centroids (``k`` x 64 integers) pass through the driver and the tasks.

Cases: vectors that are null, of another length, or with a null or non-finite component are left out; repeated rows
and ids count each; a null id hashes as ``1:``; of equal ids the smaller vector comes first; fewer vectors than ``k``
give fewer centroids; no vector gives no rows; a distance or sum that does not fit a long is null (components are exact
at any size); other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlens.llm.common import Scratch

DIM, SCALE = 64, 64
CENTROIDS, ROUNDS = 16, 3
#: Coefficient blocks, coarse to fine; a centroid is finished as a bound after the first LEAD blocks.
_BLOCKS = [(0, 1), (1, 2), (2, 4), (4, 8), (8, 16), (16, 32), (32, 64)]
LEAD = 3
#: Vectors searched at a time in a task.
ROWS = 4096
#: Components up to this size keep every 64 * distance within a long; larger ones take Python's integers.
_SMALL = 1 << 23
_LONG = 1 << 63
_LIMB = (1 << 32) - 1


def _natural(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row by butterflies, exact for integers of any kind."""
    n, step = len(x), 1
    while step < DIM:
        x = x.reshape(n, -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        step *= 2
    return x.reshape(n, DIM)


#: Coefficients by their number of sign changes.
_SEQUENCY = np.argsort(np.count_nonzero(np.diff(_natural(np.eye(DIM, dtype=np.int64)), axis=1), axis=1), kind="stable")


def transform(x: np.ndarray) -> np.ndarray:
    """The coefficients of each row, coarse to fine."""
    return _natural(x)[:, _SEQUENCY]


def quantize(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite doubles; as Python's integers if one is too large for the fast way."""
    if not len(x) or np.abs(x).max() <= _SMALL // SCALE:
        return np.floor(SCALE * x).astype(np.int64)
    exact = np.frompyfunc(lambda v: math.floor(SCALE * v) if abs(v) < 1 << 53 else SCALE * int(v), 1, 1)
    return exact(x).astype(object)


def _small(x: np.ndarray) -> bool:
    return x.dtype != object or max(map(abs, x.ravel().tolist()), default=0) <= _SMALL


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (ties: smaller number) and its squared distance."""
    kind = np.int64 if _small(vectors) and _small(centroids) else object
    v, c = transform(vectors.astype(kind)), transform(centroids.astype(kind))
    n, k = len(v), len(c)
    at, cent = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    part = np.zeros(n * k, dtype=kind)
    bound = None
    for turn, (a, b) in enumerate(_BLOCKS):
        diff = v[at, a:b] - c[cent, a:b]
        part = part + (diff * diff).sum(axis=1)
        if turn == LEAD - 1:
            lead = np.argmin(part.reshape(n, k), axis=1)
            rest = v[:, b:] - c[lead, b:]
            bound = part.reshape(n, k)[np.arange(n), lead] + (rest * rest).sum(axis=1)
        if bound is not None:
            keep = (part <= bound[at]).astype(bool)
            at, cent, part = at[keep], cent[keep], part[keep]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(part, first) if len(first) else part
    ties = np.flatnonzero((part == np.repeat(least, np.diff(np.r_[first, len(at)]))).astype(bool))
    best = ties[np.unique(at[ties], return_index=True)[1]]
    return cent[best], part[best] // DIM


def _searched(batches: Iterator[pa.RecordBatch], centroids: list[list[int]]):
    """(ids, vectors, clusters, distances) of pieces of the batches."""
    cents = np.array(centroids, dtype=object)
    cents = cents.astype(np.int64) if _small(cents) else cents
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            piece = batch.slice(start, ROWS)
            vectors = quantize(piece.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM))
            yield piece.column(0), vectors, *nearest(vectors, cents)


def _partial_sums(centroids: list[list[int]]) -> Callable:
    """Rows (cluster, pos, limb, part): signed limbs of 32 bits of the members' sums; pos DIM holds their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for _, vectors, cluster, _ in _searched(batches, centroids):
            for j in np.unique(cluster).tolist():
                mine = vectors[cluster == j]
                got = [int(x) for x in mine.sum(axis=0)] + [len(mine)]
                sums[j] = [a + b for a, b in zip(sums[j], got)] if j in sums else got
        rows = []
        for j, values in sums.items():
            for pos, value in enumerate(values):
                sign, left, limb = (-1 if value < 0 else 1), abs(value), 0
                while left:
                    rows.append((j, pos, limb, sign * (left & _LIMB)))
                    left, limb = left >> 32, limb + 1
        cols = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["cluster", "pos", "limb", "part"])
    return run


def _assigned(centroids: list[list[int]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, cluster, distance in _searched(batches, centroids):
            fits = [int(d) if d < _LONG else None for d in distance.tolist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(fits, pa.int64())],
                                             ["vec_id", "cluster", "distance"])
    return run


def kept_vectors(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, x): vectors of exactly DIM components, none null or non-finite, as doubles."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (vectors.where(F.col(vector).isNotNull() & (F.size(vector) == DIM) & finite)
            .select(F.col("vec_id").cast("long"), x.alias("x")))


def cluster_vectors(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept row of ``vectors``."""
    spark = vectors.sparkSession
    kept = kept_vectors(vectors)
    name = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.orderBy(name, "x").limit(k).collect()
    cents = [[int(v) for v in quantize(np.array([r["x"]]))[0]] for r in first]
    if not cents:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, "
                                         "centroid_sha256 string")
    for _ in range(rounds):
        sums = [[0] * (DIM + 1) for _ in cents]
        for r in (kept.mapInArrow(_partial_sums(cents), "cluster long, pos long, limb long, part long")
                  .groupBy("cluster", "pos", "limb").agg(F.sum("part").alias("part")).collect()):
            sums[r["cluster"]][r["pos"]] += r["part"] << (32 * r["limb"])
        cents = [[v // s[DIM] for v in s[:DIM]] if s[DIM] else c for s, c in zip(sums, cents)]

    found = Scratch(spark).save(kept.mapInArrow(_assigned(cents), "vec_id long, cluster int, distance long"))
    whole = F.count("*") == F.count("distance")
    per = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum"), whole.alias("whole")).collect()
    total = sum(int(r["sum"]) for r in per if r["whole"]) if all(r["whole"] for r in per) else None

    def long(v: int | None) -> int | None:
        return v if v is not None and v < _LONG else None
    about = spark.createDataFrame(
        [(r["cluster"], long(int(r["sum"]) if r["whole"] else None), long(total),
          hashlib.sha256(",".join(map(str, cents[r["cluster"]])).encode()).hexdigest()) for r in per],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return (found.join(F.broadcast(about), "cluster")
            .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))


def oracle(k: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    """The same clustering as DuckDB SQL, by full search."""
    def assigned(r: int) -> str:
        return f"""a{r} AS MATERIALIZED (
  SELECT rn, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := d, cluster := cluster)) AS best
  FROM (SELECT k.rn, k.vec_id, k.v, c.cluster,
               CAST(list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
        FROM k, c{r} c) GROUP BY rn)"""

    def moved(r: int) -> str:
        return f"""c{r + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT cluster, list(CAST((s - (((s % n) + n) % n)) // n AS BIGINT) ORDER BY pos) AS v
    FROM (SELECT best.cluster AS cluster, pos, sum(v[pos]) AS s, count(*) AS n
          FROM a{r}, (SELECT unnest(range(1, {DIM + 1})) AS pos) GROUP BY ALL) GROUP BY cluster) m USING (cluster))"""

    steps = ",\n".join(x for r in range(rounds) for x in (assigned(r), moved(r)))
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS rn, vec_id,
         list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {DIM}),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS cluster, v
  FROM (SELECT v, sha256('1:' || CAST(vec_id AS VARCHAR)) AS h FROM k ORDER BY h LIMIT {k})),
{steps},
{assigned(rounds)}
SELECT vec_id, best.cluster AS cluster, best.d AS distance,
       CAST(sum(best.d) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c ON c.cluster = best.cluster"""
