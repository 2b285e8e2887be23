"""A stored coarse index for approximate vector search (V-05): built once, searched without refitting.

``build_index`` fits the centroids on a bounded sample and writes every vector once, partitioned by the list of its
nearest centroid; ``search_index`` reads the centroids and, by partition pruning, only the lists that the queries probe.

Cases: vectors that are null, of another length than the first centroid, with a null or non-finite component or of
length zero have no cosine and are not indexed; such queries return no row; an empty table gives an empty index.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlens.functions.vectors import dot, l2_norm

#: Vectors on which the centroids are fitted (those of the smallest id hash); all vectors are indexed.
SAMPLE = 100_000
#: Vectors and queries of a list that one cell of a search compares, about, and queries per matrix product.
BLOCK, ROWS = 4_096, 512


def _usable(vector: str) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & (F.size(v) > 0) & (l2_norm(v) > 0), F.lit(False))


def _centroids(spark: SparkSession, path: str) -> list[tuple[int, list[float]]]:
    """The list numbers and centroids: at most the ``n_lists`` of the build."""
    rows = spark.read.schema("list_id int, centroid array<double>").parquet(f"{path}/centroids").orderBy("list_id").collect()
    return [(r.list_id, list(r.centroid)) for r in rows]


def _nearest(vector: Column, centroids: list[tuple[int, list[float]]], n: int) -> Column:
    """The numbers of the ``n`` lists whose centroids are most similar (ties: smaller number)."""
    near = F.array(*[F.struct((-dot(F.array(*map(F.lit, c)), vector)).alias("far"), F.lit(i).alias("list_id"))
                     for i, c in centroids])
    return F.slice(F.transform(F.array_sort(near), lambda x: x["list_id"]), 1, n)


def build_index(vectors: DataFrame, path: str, n_lists: int = 16, seed: int = 7, sample: int = SAMPLE,
                id_col: str = "symbol_id", vec_col: str = "vector") -> str:
    """Write the index of ``vectors`` to the new folder ``path`` (on storage that all executors share); return ``path``.

    ``path/centroids`` has list_id and centroid (of length one), ``path/lists/list_id=<n>`` has id and vector.  Rows are dealt by
    range over (list, id), so a list of a third of all vectors is written by many tasks."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    spark = vectors.sparkSession
    rows = (vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vector"))
            .where(_usable("vector")))
    fit_on = (rows.orderBy(F.xxhash64("id"), "id").limit(sample)
              .select(array_to_vector("vector").alias("raw")))
    fit_on = Normalizer(inputCol="raw", outputCol="features").transform(fit_on).select("features")
    centers = [] if rows.isEmpty() else KMeans(k=n_lists, seed=seed).fit(fit_on).clusterCenters()
    centers = [(i, [float(x) / (math.hypot(*c) or 1.0) for x in c]) for i, c in enumerate(centers)]
    spark.createDataFrame(centers, "list_id int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    lists = rows.withColumn("list_id", F.lit(0))
    if centers:
        lists = (rows.where(F.size("vector") == len(centers[0][1]))
                 .withColumn("list_id", _nearest(F.col("vector"), centers, 1)[0]).repartitionByRange("list_id", "id"))
    lists.write.partitionBy("list_id").parquet(f"{path}/lists")
    return path


def _best_of_cell(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a cell's vectors and queries: (query_id, id, score) of each query's ``k`` best, and some more.

    Matrix products find them (by the score of six digits, then by id); their scores are then summed component by
    component, as :func:`meshlens.functions.vectors.cosine` does."""
    step = ROWS

    def matrix(table: pa.Table, col: str) -> np.ndarray:
        return table.column(col).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)

    def norms_of(rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.add.accumulate(rows * rows, axis=1)[:, -1])

    def best(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if vectors.num_rows and queries.num_rows:
            vectors = vectors.sort_by("id")  # ties by id are ties by place, null first
            n_null = vectors.column("id").null_count
            vectors = pa.concat_tables([vectors.slice(vectors.num_rows - n_null), vectors.slice(0, vectors.num_rows - n_null)])
            v, q = matrix(vectors, "vector"), matrix(queries, "q")
            nv, nq, n = norms_of(v), norms_of(q), len(v)
            unit, most = (v / nv[:, None]).T, min(n, 2 * k)
            place = np.arange(n - 1, -1, -1)
            at, ids, scores = [], [], []
            for i in range(0, len(q), step):
                part, norms = q[i:i + step], nq[i:i + step]
                near = (part / norms[:, None]) @ unit * 1e6
                digits = np.where(np.isnan(near), 2e6, np.copysign(np.floor(np.abs(near) + 0.5), near)).astype(np.int64)
                top = np.argpartition(digits * n + place, n - most, axis=1)[:, n - most:]
                score = np.add.accumulate(part[:, None, :] * v[top], axis=2)[:, :, -1] / (nv[top] * norms[:, None])
                at.append(np.repeat(np.arange(i, i + len(part)), most))
                ids.append(top.ravel())
                scores.append(score.ravel())
            return pa.table({"query_id": queries.column("query_id").take(pa.array(np.concatenate(at))),
                             "id": vectors.column("id").take(pa.array(np.concatenate(ids))), "score": np.concatenate(scores)})
        return pa.table({"query_id": queries.column("query_id").slice(0, 0), "id": pa.array([], pa.int64()),
                         "score": pa.array([], pa.float64())})
    return best


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 20, n_probe: int = 12) -> DataFrame:
    """V-05: query_id, id, score and rank of the ``k`` most similar vectors (exact cosine, rounded to six digits; ties
    by id) within the ``n_probe`` nearest lists of each of ``queries`` (query_id, vector).

    Vectors and queries of a list are dealt into runs of about ``BLOCK``; every two runs of a list meet in one cell,
    which a task compares by matrix products, and passes on the best of.

    The recall depends on the data; all lists (``n_probe`` of the build's ``n_lists`` or more) give the exact answer."""
    centroids = _centroids(spark, path)
    if not centroids:
        return spark.createDataFrame([], "query_id long, id long, score double, rank int")
    probes = (queries.select("query_id", F.col("vector").cast("array<double>").alias("q"))
              .where(_usable("q") & (F.size("q") == len(centroids[0][1])))
              .withColumn("list_id", F.explode(_nearest(F.col("q"), centroids, n_probe))))
    asked = {r.list_id: r["count"] for r in probes.groupBy("list_id").count().collect()}  # at most n_lists
    lists = (spark.read.schema("id long, vector array<double>, list_id int").parquet(f"{path}/lists")
             .where(F.col("list_id").isin(*asked)))
    held = {r.list_id: r["count"] for r in lists.groupBy("list_id").count().collect()}
    runs = F.broadcast(spark.createDataFrame([(i, -(-n // BLOCK), -(-asked[i] // BLOCK)) for i, n in held.items()],
                                             "list_id int, _v int, _q int"))

    def dealt(rows: DataFrame, by: list[str], own: str, other: str) -> DataFrame:
        return (rows.join(runs, "list_id").withColumn(own, F.pmod(F.xxhash64(*by), own))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1))))
    cell = [F.col("list_id"), F.col("_v").cast("long").alias("_v"), F.col("_q").cast("long").alias("_q")]
    vectors = dealt(lists, ["id", "vector"], "_v", "_q").select(*cell, "id", "vector").groupBy("list_id", "_v", "_q")
    queried = dealt(probes, ["query_id", "q"], "_q", "_v").select(*cell, "query_id", "q").groupBy("list_id", "_v", "_q")
    scored = (vectors.cogroup(queried).applyInArrow(_best_of_cell(k), f"query_id {dict(probes.dtypes)['query_id']}, id long, score double")
              .withColumn("score", F.round("score", 6)))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
