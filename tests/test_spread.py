"""Costly work on each part is dealt over tasks, however few files hold the table."""

import pytest
from pyspark.sql import functions as F

from meshlens.operators import graph
from meshlens.plans.config_queries import _ddl, _manifests
from meshlens.plans.graph_queries import _layered
from meshlens.sources import probes
from meshlens.sources.tables import load_tables, spread


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("parts")
    k = F.col("id")
    (spark.range(12_000).select(k.alias("p_partkey"), F.lit("red bolt").alias("p_name"), F.concat(F.lit("Brand#"), k % 25 + 1).alias("p_brand"),
                                F.lit("STEEL").alias("p_type"), (k % 50).cast("int").alias("p_size"))
     .coalesce(1).write.parquet(f"{path}/part.parquet"))
    spark.range(3).select(k.alias("doc_id"), F.lit("t").alias("text")).write.parquet(f"{path}/documents.parquet")
    return load_tables(spark, str(path))


@pytest.mark.parametrize("rows", [_ddl, _manifests, probes.v_code, _layered])
def test_one_file_is_worked_on_by_several_tasks(tables, rows):
    counts = [r["count"] for r in rows(tables).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(counts) == 3 and max(counts) < 0.5 * sum(counts)


def test_spread_keeps_rows(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (None, "a")], "x int, y string")
    assert sorted(map(str, spread(rows, 1).collect())) == sorted(map(str, rows.collect()))
    assert spread(rows.limit(0)).count() == 0


def test_filter_of_nodes_ends_walks(spark):
    edges = spark.createDataFrame([(1, 2, "A"), (1, 3, "A"), (2, 4, "A"), (3, 5, "B"), (3, 1, "A"), (5, None, "A")], "src long, dst long, type string")
    allowed = spark.createDataFrame([(3,), (4,), (5,), (5,)], "id long")
    got = graph.traverse(spark.createDataFrame([(1,)], "seed long"), edges, 3, allowed_nodes=allowed)
    assert sorted(map(tuple, got.collect())) == [(1, 3, 1, "A", 1), (1, 5, 2, "B", 3)]
