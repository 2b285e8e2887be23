"""Joins of few keys that make many pairs: whole, without repeats, and spread over tasks."""

from collections import Counter

from pyspark.sql import functions as F

from meshlens.operators import dealing, graph, resolution
from meshlens.plans.misc_queries import j32_service_bundle


def _spread(df):
    """The rows of the largest task and of all."""
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(counts), sum(counts)


def test_dealt_join_is_the_join(spark, monkeypatch):
    monkeypatch.setattr(dealing, "RUN", 7)
    monkeypatch.setattr(dealing, "CELL_PAIRS", 50)
    a = spark.createDataFrame([(i % 3 if i % 11 else None, i // 2) for i in range(120)] + [(9, 1)], "k long, x long")
    b = spark.createDataFrame([(i % 4 if i % 7 else None, i) for i in range(90)] + [(2, 5), (2, 5)], "k long, y long")
    got = dealing.dealt_join(a, b, "k", "x", "y")
    assert got.columns == ["k", "x", "y"]
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, a.join(b, "k").collect()))
    assert dealing.dealt_join(a.where("k = 9"), b, "k", "x", "y").isEmpty()


def test_override_pairs_of_one_name_are_spread(spark, monkeypatch):
    monkeypatch.setattr(dealing, "CELL_PAIRS", 2_000)
    monkeypatch.setattr(dealing, "RUN", 20)
    rows = [(i, "run", "METHOD", i % 2 == 0, i % 2 == 1, False) for i in range(600)]
    rows += [(0, "stop", "METHOD", True, False, False), (700, "stop", "METHOD", False, True, False), (1, "stop", "METHOD", False, True, False),
             (None, "stop", "METHOD", True, True, False), (2, None, "METHOD", True, True, False)]
    m = spark.createDataFrame(rows, "id long, name string, kind string, is_override boolean, is_virtual boolean, is_abstract boolean")
    want = {(s, d, "OVERRIDES") for s, n, _, o, _, _ in rows for d, n2, _, _, v, a in rows
            if o and (v or a) and n is not None and n == n2 and s is not None and d is not None and s != d}
    edges = resolution.override_edges(m)
    got = Counter(map(tuple, edges.collect()))
    assert set(got) == want and set(got.values()) == {1}
    most, total = _spread(edges)
    assert most < total / 4


def test_interface_edges_of_shared_ids_stay_distinct(spark):
    s = spark.createDataFrame(
        [(1, "I", "INTERFACE", "I", None), (2, "C", "CLASS", "C", None), (1, "run", "METHOD", "I.run", "I"), (2, "run", "METHOD", "C.run", "C"),
         (3, "run", "METHOD", "C.run", "C"), (1, "stop", "METHOD", "I.stop", "I"), (3, "stop", "METHOD", "C.stop", "C")],
        "id long, name string, kind string, fqn string, parent_name string")
    e = spark.createDataFrame([(2, 1, "IMPLEMENTS"), (2, 1, "IMPLEMENTS"), (2, 4, "INHERITS")], "src long, dst long, type string")
    got = sorted(map(tuple, graph.interface_edges(s, e).collect()))
    assert got == [(1, 2, "IMPLEMENTED_BY"), (1, 3, "IMPLEMENTED_BY"), (4, 2, "INHERITED_BY")]


def test_service_bundle_is_spread_over_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dealing, "CELL_PAIRS", 2_000)
    monkeypatch.setattr(dealing, "RUN", 50)
    spark.range(500).select((F.col("id") * 25 + 4).alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(300).select(F.col("id").alias("p_partkey"), F.lit("red bolt").alias("p_name"), F.lit("Brand#4").alias("p_brand")).write.parquet(
        f"{tmp_path}/part.parquet")
    spark.range(20).select(F.col("id").alias("user_id"), F.lit("view").alias("event_type")).write.parquet(f"{tmp_path}/events.parquet")
    out = j32_service_bundle(spark, str(tmp_path))
    kinds = {r["item_kind"]: r["count"] for r in out.groupBy("item_kind").count().collect()}
    assert kinds == {"controller": 500, "method": 500 * 200, "dependency": 500, "published_event": 500}
    most, total = _spread(out)
    assert most < total / 4
