"""Queries over whole structures: directory trees (A-17), project groups (A-20), table graphs (SNK-06), the vector
index (V-05)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from meshlens.operators import projects as P
from meshlens.operators import vector_index as VI
from meshlens.operators.digests import directory_digests
from meshlens.plans.catalog import register
from meshlens.session import ensure_checkpoint_dir
from meshlens.sources import probes
from meshlens.sources import sinks as S
from meshlens.sources.tables import load_tables


def _digest_sql(rows: str, keys: str) -> str:
    """DuckDB: one digest per ``keys`` of the rows (name, digest, n_files), combined by the SHA-256 of the names."""
    sql = f"(SELECT {keys}, sha256(name) AS name, digest, n_files FROM {rows})"
    for digits in (4, 2, 0):
        sql = (f"(SELECT {keys}, left(name, {digits}) AS name, sum(n_files) AS n_files,\n"
               f"  sha256(string_agg(name || ':' || digest, chr(10) ORDER BY name || ':' || digest)) AS digest\n"
               f"  FROM {sql} GROUP BY {keys}, left(name, {digits}))")
    return sql


@register("a17_directory_digests", sql=f"""
WITH RECURSIVE r AS (
  SELECT repository, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS directory,
         string_split(path, '/')[-1] AS name, coalesce(content_hash, '') AS digest, 1 AS n_files
  FROM v_tree WHERE path IS NOT NULL),
own AS (
  SELECT repository, directory, CASE WHEN directory = '' THEN 0 ELSE len(string_split(directory, '/')) END AS depth,
         digest, n_files FROM {_digest_sql("r", "repository, directory")}),
tree AS (
  SELECT repository, directory, depth, CAST(n_files AS BIGINT) AS n_files, sha256(digest || ':') AS digest
  FROM own WHERE depth = (SELECT max(depth) FROM own)
  UNION ALL
  SELECT repository, directory, depth, CAST(sum(n_files) AS BIGINT),
         sha256(coalesce(max(of_files), '') || ':' || coalesce(max(of_folders), ''))
  FROM (
    SELECT repository, directory, depth, n_files, digest AS of_files, NULL AS of_folders
    FROM own WHERE depth IN (SELECT depth - 1 FROM tree)
    UNION ALL
    SELECT repository, directory, depth, n_files, NULL, digest FROM {_digest_sql('''(
      SELECT repository, CASE WHEN contains(directory, '/') THEN regexp_replace(directory, '/[^/]*$', '') ELSE '' END AS directory,
             depth - 1 AS depth, string_split(directory, '/')[-1] AS name, digest, n_files FROM tree WHERE depth > 0)''',
                                                                                "repository, directory, depth")})
  GROUP BY repository, directory, depth)
SELECT repository, directory, CAST(depth AS INTEGER) AS depth, n_files, digest FROM tree""")
def a17_directory_digests(spark, sf_dir):
    """A-17: the digest of every directory, rolled up from its files and subdirectories."""
    return directory_digests(probes.v_tree(load_tables(spark, sf_dir)))


PROJECT_KEYS = ("project_guid", "file_path", "assembly_name")

KEYED_PROJECTS_SQL = """(SELECT c_custkey AS id, c_custkey // 40 AS repository_id, c_mktsegment AS name,
  CASE WHEN c_custkey % 4 = 1 THEN c_custkey END AS solution_id,
  CASE WHEN c_custkey % 3 = 0 THEN 'g' || CAST(c_custkey // 7 AS VARCHAR) END AS project_guid,
  CASE WHEN c_custkey % 5 < 2 THEN 'a' || CAST(c_custkey // 5 AS VARCHAR) END AS assembly_name,
  CASE WHEN c_custkey % 7 = 0 THEN 'net8.0' END AS target_framework,
  CASE WHEN c_custkey % 2 = 0 THEN (CASE WHEN c_nationkey % 2 = 0 THEN '/' ELSE '' END) || 'p' || CAST(c_custkey // 4 AS VARCHAR) END AS file_path
  FROM customer)"""


def _keyed_projects(t):
    """Projects whose GUIDs, paths and assembly names are shared by few others of their repository."""
    k = F.col("c_custkey")

    def part(prefix, n):
        return F.concat(F.lit(prefix), F.floor(k / n).cast("string"))
    return t.customer.select(
        k.alias("id"), F.floor(k / 40).alias("repository_id"), F.col("c_mktsegment").alias("name"),
        F.when(k % 4 == 1, k).alias("solution_id"), F.when(k % 3 == 0, part("g", 7)).alias("project_guid"),
        F.when(k % 5 < 2, part("a", 5)).alias("assembly_name"), F.when(k % 7 == 0, F.lit("net8.0")).alias("target_framework"),
        F.when(k % 2 == 0, F.concat(F.when(F.col("c_nationkey") % 2 == 0, "/").otherwise(""), part("p", 4))).alias("file_path"))


def _merged_sql(group_sql: str) -> str:
    """DuckDB: CTEs up to ``best`` and ``merged``; ``group_sql`` gives (id, group_id)."""
    return f"""
p AS {KEYED_PROJECTS_SQL},
grp AS ({group_sql}),
m AS (SELECT p.*, group_id, (CASE WHEN solution_id IS NOT NULL THEN 1000 ELSE 0 END) + (CASE WHEN project_guid IS NOT NULL THEN 100 ELSE 0 END)
        + (CASE WHEN assembly_name IS NOT NULL THEN 10 ELSE 0 END) + (CASE WHEN target_framework IS NOT NULL THEN 1 ELSE 0 END) AS score
      FROM p JOIN grp USING (id)),
best AS (SELECT group_id, arg_max(id, (score, -id)) AS primary_id, CAST(max(score) AS INTEGER) AS score, count(*) AS n_members,
                count(DISTINCT project_guid) AS n_guids,
                arg_min(assembly_name, id) AS a, arg_min(target_framework, id) AS f,
                arg_min(file_path, id) FILTER (WHERE starts_with(file_path, '/')) AS absolute
         FROM m GROUP BY group_id),
merged AS (SELECT primary_id, p.repository_id, p.name, best.score, n_members, n_guids, p.solution_id, p.project_guid,
                  CASE WHEN starts_with(p.file_path, '/') THEN p.file_path ELSE coalesce(absolute, p.file_path) END AS file_path,
                  coalesce(p.assembly_name, a) AS assembly_name, coalesce(p.target_framework, f) AS target_framework
           FROM best JOIN p ON p.id = primary_id)"""


NAME_GROUPS = "SELECT id, min(id) OVER (PARTITION BY repository_id, name) AS group_id FROM p"
KEY_GROUPS = """SELECT id, min(other) AS group_id FROM reach GROUP BY id"""
REACH_SQL = f"""
pk AS (SELECT id, repository_id, 1 AS k, project_guid AS v FROM {KEYED_PROJECTS_SQL} UNION ALL
       SELECT id, repository_id, 2, file_path FROM {KEYED_PROJECTS_SQL} UNION ALL
       SELECT id, repository_id, 3, assembly_name FROM {KEYED_PROJECTS_SQL}),
near AS (SELECT DISTINCT x.id AS a, y.id AS b FROM pk x JOIN pk y ON x.repository_id = y.repository_id AND x.k = y.k AND x.v = y.v),
reach AS (SELECT c_custkey AS id, c_custkey AS other FROM customer
          UNION SELECT reach.id, near.b FROM reach JOIN near ON near.a = reach.other)"""


@register("a20_merge_projects", sql=f"WITH {_merged_sql(NAME_GROUPS)} SELECT * FROM merged")
def a20_merge_projects(spark, sf_dir):
    """A-20: one merged project per repository and name, fields filled from its duplicates."""
    p = _keyed_projects(load_tables(spark, sf_dir))
    return P.merge_projects(p, P.project_groups(p))[0]


@register("a20_connected_projects", sql=f"WITH RECURSIVE {REACH_SQL}, {_merged_sql(KEY_GROUPS)} SELECT * FROM merged")
def a20_connected_projects(spark, sf_dir):
    """A-20: projects connected over GUIDs, paths and assembly names; groups may hold several GUIDs."""
    p = _keyed_projects(load_tables(spark, sf_dir))
    return P.merge_projects(p, P.project_groups(p, PROJECT_KEYS))[0]


@register("a20_remapped_symbols", sql=f"""
WITH RECURSIVE {REACH_SQL}, {_merged_sql(KEY_GROUPS)}
SELECT o_orderkey AS id, coalesce(primary_id, o_custkey) AS project_id
FROM orders LEFT JOIN grp ON grp.id = o_custkey LEFT JOIN best USING (group_id)""")
def a20_remapped_symbols(spark, sf_dir):
    """A-20: what points at a merged project (orders at customers) points at its primary afterwards."""
    t = load_tables(spark, sf_dir)
    p = _keyed_projects(t)
    remap = P.merge_projects(p, P.project_groups(p, PROJECT_KEYS))[1]
    return P.remap_projects(t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id")), remap)


GONE_REPOSITORY = "src3"
FOREIGN_KEYS = [
    S.ForeignKey("symbols", "file_id", "files"), S.ForeignKey("symbols", "parent_id", "symbols", set_null=True),
    S.ForeignKey("relations", "src", "symbols"), S.ForeignKey("relations", "dst", "symbols"),
    S.ForeignKey("vectors", "chunk_id", "files"), S.ForeignKey("vectors", "symbol_id", "symbols", set_null=True)]

TABLE_COUNTS = {"files": ("id", "id"), "symbols": ("id", "parent_id"), "relations": ("src", "dst"),
                "vectors": ("chunk_id", "symbol_id")}


@register("snk06_cascade_tables", sql=f"""
WITH gone AS (SELECT id FROM v_files WHERE repository = '{GONE_REPOSITORY}'),
sym AS (SELECT id, file_id, CASE WHEN parent_name IS NOT NULL THEN {probes.TYPE_ID_BASE} + CAST(split_part(parent_name, '#', 2) AS BIGINT) END AS parent_id
        FROM v_symbols),
gs AS (SELECT id FROM sym WHERE file_id IN (SELECT id FROM gone)),
f AS (SELECT id AS a, id AS b FROM v_files WHERE id NOT IN (SELECT id FROM gone)),
s AS (SELECT id AS a, CASE WHEN parent_id NOT IN (SELECT id FROM gs) THEN parent_id END AS b FROM sym WHERE id NOT IN (SELECT id FROM gs)),
e AS (SELECT src AS a, dst AS b FROM v_edges WHERE src NOT IN (SELECT id FROM gs) AND dst NOT IN (SELECT id FROM gs)),
v AS (SELECT chunk_id AS a, CASE WHEN symbol_id NOT IN (SELECT id FROM gs) THEN symbol_id END AS b FROM v_vec
      WHERE chunk_id NOT IN (SELECT id FROM gone))
SELECT t AS table_name, count(*) AS n_rows, count(b) AS n_references, CAST(sum(a) AS BIGINT) AS id_sum
FROM (SELECT 'files' AS t, * FROM f UNION ALL SELECT 'symbols', * FROM s UNION ALL SELECT 'relations', * FROM e
      UNION ALL SELECT 'vectors', * FROM v) GROUP BY t""")
def snk06_cascade_tables(spark, sf_dir):
    """SNK-06: files, symbols, relations and vectors after one repository's files are deleted: rows gone, keys blanked."""
    t = load_tables(spark, sf_dir)
    files = probes.v_files(t)
    parent = F.lit(probes.TYPE_ID_BASE) + F.substring_index("parent_name", "#", -1).cast("long")
    tables = {"files": files.select("id", "repository"),
              "symbols": probes.v_symbols(t).select("id", "file_id", parent.alias("parent_id")),
              "relations": probes.v_edges(t).select("src", "dst"),
              "vectors": probes.v_vec(t).select("chunk_id", "symbol_id")}
    left = S.cascade_tables(tables, FOREIGN_KEYS, "files", files.where(F.col("repository") == GONE_REPOSITORY).select("id"))
    return S.union_all([left[name].agg(F.count(F.lit(1)).alias("n_rows"), F.count(b).alias("n_references"),
                                       F.sum(a).alias("id_sum")).select(F.lit(name).alias("table_name"), "*")
                        for name, (a, b) in TABLE_COUNTS.items()])


@register("v05_index_search")
def v05_index_search(spark, sf_dir):
    """V-05: the 10 most similar vectors of every vector whose id is divisible by 20, from a stored index of all
    vectors (16 lists, 12 probed: the test vectors are close to random)."""
    t = load_tables(spark, sf_dir)
    v = probes.v_vec(t)
    path = VI.build_index(v, f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}")
    queries = v.where(F.col("symbol_id") % 20 == 0).select(F.col("symbol_id").alias("query_id"), "vector")
    return VI.search_index(spark, path, queries, k=10, n_probe=12)
