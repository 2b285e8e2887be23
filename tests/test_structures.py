"""Directory digests, project groups, cascades over table graphs and the stored vector index against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from meshlens.operators import projects as P
from meshlens.operators import vector_index as VI
from meshlens.operators.digests import directory_digests
from meshlens.operators.graph import connected_components
from meshlens.sources import sinks as S


def _sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _combine(entries):
    rows = [(_sha(name), digest) for name, digest in entries]
    for digits in (4, 2, 0):
        groups = {}
        for name, digest in rows:
            groups.setdefault(name[:digits], []).append(f"{name}:{digest}")
        rows = [(name, _sha("\n".join(sorted(v)))) for name, v in groups.items()]
    return rows[0][1] if rows else ""


def _digest(files, directory):
    prefix = f"{directory}/" if directory else ""
    below = [(p[len(prefix):], h or "") for p, h in files if p.startswith(prefix)]
    own = _combine([(p, h) for p, h in below if "/" not in p])
    folders = _combine([(d, _digest(files, prefix + d)) for d in sorted({p.split("/")[0] for p, _ in below if "/" in p})])
    return _sha(f"{own}:{folders}")


FILES = [("a/x.py", "1"), ("a/y.py", None), ("a/b/c/z.py", "3"), ("a2/x.py", "1"), ("top.md", "4"), ("top.md", "4"),
         *[(f"big/{i}.md", str(i)) for i in range(300)]]


def test_directory_digests(spark):
    df = spark.createDataFrame([("r", p, h) for p, h in FILES] + [("s", "a/x.py", "1"), (None, "q", "1"), ("r", None, "1")],
                               "repository string, path string, content_hash string")
    got = {(r.repository, r.directory): r for r in directory_digests(df).collect()}
    dirs = ["", "a", "a/b", "a/b/c", "a2", "big"]
    assert set(got) == {("r", d) for d in dirs} | {("s", ""), ("s", "a"), (None, "")}
    for d in dirs:
        assert got["r", d].digest == _digest(FILES, d)
    assert got["r", ""].n_files == len(FILES) and got["r", "a"].n_files == 3
    assert got["s", "a"].digest == got["r", "a2"].digest


def test_a_change_reaches_the_ancestors_alone(spark):
    def run(rows):
        df = spark.createDataFrame([("r", p, h) for p, h in rows], "repository string, path string, content_hash string")
        return {r.directory: r.digest for r in directory_digests(df).collect()}
    old, new = run(FILES), run([(p, "new" if p == "a/b/c/z.py" else h) for p, h in FILES])
    assert {d for d in old if old[d] != new[d]} == {"", "a", "a/b", "a/b/c"}


def test_no_files_no_digests(spark):
    assert directory_digests(spark.createDataFrame([], "repository string, path string, content_hash string")).count() == 0


def test_components_of_chains_hubs_and_random_links(spark):
    rnd = random.Random(5)
    links = [(i, i + 1) for i in range(1, 200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    links += [(rnd.randrange(2000, 2300), rnd.randrange(2000, 2300)) for _ in range(150)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(links + [(None, 7), (8, None)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {x: find(x) for x in list(root)}


PROJECTS = ("id long, repository_id long, name string, solution_id long, project_guid string, assembly_name string, "
            "target_framework string, file_path string, extra string")


def test_projects_over_chains_of_keys(spark):
    rows = [(1, 1, "A", None, "g1", None, None, "x/a", "e"), (2, 1, "B", None, "g1", "asm", "", "x/b", "e"),
            (3, 1, "C", 9, "g2", "asm", None, "x/c", "e"), (4, 1, "D", None, None, None, "net8", "/abs/d", "e"),
            (5, 1, "E", None, "g2", "", "net6", "/abs/d", "e"), (6, 2, "A", None, "g1", "asm", None, "x/a", "e"),
            (7, None, "A", None, "g1", None, None, None, "e"), (8, None, "Z", None, "g1", None, None, "", "e")]
    p = spark.createDataFrame(rows, PROJECTS)
    groups = P.project_groups(p, ("project_guid", "file_path", "assembly_name"))
    assert {r.id: r.group_id for r in groups.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 7, 8: 7}
    merged, remap = P.merge_projects(p, groups)
    got = {r.primary_id: r for r in merged.collect()}
    assert set(got) == {3, 6, 7}
    assert (got[3].n_members, got[3].n_guids, got[3].project_guid, got[3].score) == (5, 2, "g2", 1110)
    assert (got[3].file_path, got[3].target_framework, got[3].assembly_name) == ("/abs/d", "net8", "asm")
    symbols = spark.createDataFrame([(10, 1), (11, 3), (12, 6), (13, 99), (14, None)], "id long, project_id long")
    assert {r.id: r.project_id for r in P.remap_projects(symbols, remap).collect()} == {10: 3, 11: 3, 12: 6, 13: 99, 14: None}


def test_projects_of_one_name(spark):
    p = spark.createDataFrame([(1, 1, "A", None, None, None, None, "x", ""), (2, 1, "A", None, None, "q", None, "y", ""),
                               (3, 2, "A", None, None, None, None, "z", ""), (4, 1, None, None, None, None, None, "z", "")], PROJECTS)
    got = {r.id: r.group_id for r in P.project_groups(p).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_cascade_over_tables(spark):
    def df(rows, cols):
        return spark.createDataFrame(rows, ", ".join(f"{c} long" for c in cols))
    tables = {"edges": df([(1, 2), (2, 3), (3, 3), (None, 3)], ["src", "dst"]),
              "symbols": df([(1, 10, None), (2, 11, 1), (3, 12, 1), (4, None, 3)], ["id", "file_id", "parent_id"]),
              "files": df([(10, 1), (11, 1), (12, 2)], ["id", "repo"]), "repos": df([(1,), (2,)], ["id"]),
              "notes": df([(1, 1), (2, 4)], ["id", "symbol_id"]),
              "folders": df([(1, None, 1), (2, 1, None), (3, 2, None), (4, None, 2)], ["id", "up", "repo"])}
    keys = [S.ForeignKey("files", "repo", "repos"), S.ForeignKey("symbols", "file_id", "files"),
            S.ForeignKey("symbols", "parent_id", "symbols", set_null=True), S.ForeignKey("edges", "src", "symbols"),
            S.ForeignKey("edges", "dst", "symbols"), S.ForeignKey("notes", "symbol_id", "symbols", set_null=True),
            S.ForeignKey("folders", "repo", "repos"), S.ForeignKey("folders", "up", "folders")]
    left = S.cascade_tables(tables, keys, "repos", spark.createDataFrame([(1,), (None,)], "id long"))
    got = {name: sorted(map(tuple, d.collect()), key=str) for name, d in left.items()}
    assert got == {"repos": [(2,)], "files": [(12, 2)], "symbols": [(3, 12, None), (4, None, 3)],
                   "edges": [(3, 3), (None, 3)], "notes": [(1, None), (2, 4)], "folders": [(4, None, 2)]}


@pytest.fixture(scope="module")
def index(spark, sf_dir, tmp_path_factory):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("symbol_id"), F.col("embedding").alias("vector"))
    return v, VI.build_index(v, str(tmp_path_factory.mktemp("index") / "v"))


def test_index_holds_every_vector(spark, index):
    v, path = index
    assert spark.read.parquet(f"{path}/lists").select("id").exceptAll(v.select("symbol_id")).count() == 0
    assert spark.read.parquet(f"{path}/lists").count() == v.count()


def test_index_recall_and_pruning(spark, index):
    v, path = index
    queries = v.where("symbol_id % 20 = 0").select(F.col("symbol_id").alias("query_id"), "vector")
    lists = spark.read.parquet(f"{path}/centroids").count()
    exact = {(r.query_id, r.id): r.score for r in VI.search_index(spark, path, queries, 10, lists).collect()}
    found = VI.search_index(spark, path, queries, 10, 12)
    rows = {(r.query_id, r.id): r.score for r in found.collect()}
    assert len(rows) == len(exact) and len(rows.keys() & exact.keys()) >= 0.9 * len(exact)
    assert all(exact[x] == s for x, s in rows.items() if x in exact)
    one = VI.search_index(spark, path, queries.limit(1), 5, 2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*list_id#\d+ IN", plan), plan


def test_all_lists_equal_brute_force(spark, index):
    import numpy as np
    v, path = index
    rows = [(r.symbol_id, np.array(r.vector, float)) for r in v.collect()]
    q = rows[0][1]
    want = sorted((-round(float(x @ q / np.linalg.norm(x) / np.linalg.norm(q)), 6), i) for i, x in rows)[:10]
    got = VI.search_index(spark, path, v.where(F.col("symbol_id") == rows[0][0]).select(F.lit(1).alias("query_id"), "vector"), 10, 99)
    assert [(-r.score, r.id) for r in got.orderBy("rank").collect()] == want


def test_odd_vectors_are_left_out(spark, tmp_path):
    nan = float("nan")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [nan, 1.0]), (5, [0.0, 0.0]), (6, []), (7, [None, 1.0])],
                              "symbol_id long, vector array<double>")
    path = VI.build_index(v, str(tmp_path / "a"), n_lists=2)
    got = VI.search_index(spark, path, v.select(F.col("symbol_id").alias("query_id"), "vector"), 5, 2)
    assert {(r.query_id, r.id) for r in got.collect()} == {(1, 1), (1, 2), (2, 1), (2, 2)}
    empty = VI.build_index(v.limit(0), str(tmp_path / "b"))
    assert VI.search_index(spark, empty, v.select(F.col("symbol_id").alias("query_id"), "vector")).count() == 0


def test_search_in_cells_equals_the_joined_search(spark, tmp_path, monkeypatch):
    """Several runs per list, ties by id, equal and null ids: the rows of scoring every probed pair by expressions."""
    from collections import Counter

    from meshlens.functions.vectors import cosine
    monkeypatch.setattr(VI, "BLOCK", 8)
    monkeypatch.setattr(VI, "ROWS", 3)
    rows = [(i, [float(i * i % 17 - 8), float(i % 5), 1.0]) for i in range(120)] + [(7, [1.0, 0.0, 0.0]), (None, [0.0, 0.0, 2.0])] \
        + [(1000 + i, [3.0, 3.0, 3.0]) for i in range(40)]
    v = spark.createDataFrame(rows, "symbol_id long, vector array<float>")
    path = VI.build_index(v, str(tmp_path / "c"), n_lists=3)
    queries = v.select(F.col("symbol_id").alias("query_id"), "vector")
    pairs = (v.withColumnRenamed("symbol_id", "id").withColumn("v", F.col("vector").cast("array<double>")).drop("vector")
             .crossJoin(queries.select("query_id", F.col("vector").cast("array<double>").alias("q"))))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    want = (pairs.select("query_id", "id", F.round(cosine(F.col("v"), F.col("q")), 6).alias("score"))
            .withColumn("rank", F.row_number().over(best)).where("rank <= 5"))
    got = VI.search_index(spark, path, queries, 5, 3)
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" in plan
