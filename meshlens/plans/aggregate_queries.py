"""Registered aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlens.operators import aggregates as A
from meshlens.operators import relational as R
from meshlens.plans.catalog import register
from meshlens.sources import probes
from meshlens.sources.tables import load_tables

PROJECT_MAP_DEPTH = 2


def _t(spark, sf_dir):
    return load_tables(spark, sf_dir)


CTX_SQL = "(SELECT s.*, f.path, f.repository, f.language FROM v_symbols s JOIN v_files f ON s.file_id = f.id)"
SPF_SQL = """(SELECT f.id, f.repository, f.path, f.language, f.line_count, f.size_bytes,
  CAST(coalesce(c.n, 0) AS BIGINT) AS symbol_count
  FROM v_files f LEFT JOIN (SELECT file_id, count(*) AS n FROM v_symbols GROUP BY file_id) c ON c.file_id = f.id)"""


@register("a01_overview_stats", sql="""
SELECT 'total_repositories' AS metric, CAST(count(DISTINCT repository) AS BIGINT) AS value FROM v_files
UNION ALL SELECT 'total_files', count(*) FROM v_files
UNION ALL SELECT 'total_symbols', count(*) FROM v_symbols
UNION ALL SELECT 'total_endpoints', count(*) FROM v_endpoints
UNION ALL SELECT 'total_outgoing_calls', count(*) FROM v_calls
UNION ALL SELECT 'total_published_events', count(*) FROM v_pub
UNION ALL SELECT 'total_event_subscriptions', count(*) FROM v_sub""")
def a01_overview_stats(spark, sf_dir):
    t = _t(spark, sf_dir)
    return A.overview_stats(probes.v_files(t), probes.v_symbols(t), probes.v_endpoints(t),
                            probes.v_calls(t), probes.v_pub(t), probes.v_sub(t))


@register("a01_top_languages", sql="""
SELECT language, count(*) AS file_count, CAST(sum(size_bytes) AS BIGINT) AS size_bytes
FROM v_files GROUP BY language ORDER BY file_count DESC, language LIMIT 10""")
def a01_top_languages(spark, sf_dir):
    return A.top_languages(probes.v_files(_t(spark, sf_dir)))


@register("a02_repository_stats", sql=f"""
SELECT repository, count(*) AS total_files, CAST(sum(symbol_count) AS BIGINT) AS total_symbols,
       CAST(0 AS BIGINT) AS total_endpoints,
       count(*) FILTER (WHERE symbol_count = 0) AS files_with_no_symbols,
       round(sum(symbol_count) / count(*), 2) AS avg_symbols_per_file
FROM {SPF_SQL} GROUP BY repository""")
def a02_repository_stats(spark, sf_dir):
    t = _t(spark, sf_dir)
    return A.repository_stats(probes.v_files(t), probes.v_symbols(t))


@register("a03_kind_distribution", sql=f"""
SELECT repository, kind, count(*) AS n FROM {CTX_SQL} GROUP BY repository, kind""")
def a03_kind_distribution(spark, sf_dir):
    t = _t(spark, sf_dir)
    return A.kind_distribution(probes.v_symbols(t), probes.v_files(t))


@register("a03_language_distribution", sql="""
SELECT repository, language, count(*) AS file_count, CAST(sum(size_bytes) AS BIGINT) AS size_bytes
FROM v_files GROUP BY repository, language""")
def a03_language_distribution(spark, sf_dir):
    return A.language_distribution(probes.v_files(_t(spark, sf_dir)))


@register("a03_relation_distribution", sql=f"""
SELECT c.repository, e.type, count(*) AS n FROM v_edges e JOIN {CTX_SQL} c ON c.id = e.src
GROUP BY c.repository, e.type""")
def a03_relation_distribution(spark, sf_dir):
    t = _t(spark, sf_dir)
    return A.relation_distribution(probes.v_edges(t), probes.v_symbols(t), probes.v_files(t))


@register("a04_language_share", sql="""
SELECT repository, language, bytes, round(bytes * 100.0 / sum(bytes) OVER (PARTITION BY repository), 2) AS pct,
       row_number() OVER (PARTITION BY repository ORDER BY bytes DESC, language) = 1 AS is_primary
FROM (SELECT repository, language, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM v_files
      WHERE size_bytes > 0 GROUP BY repository, language)""")
def a04_language_share(spark, sf_dir):
    return A.language_share(probes.v_files(_t(spark, sf_dir)))


@register("a05_primary_language", sql="""
WITH g AS (SELECT repository, language, count(*) AS n FROM v_files WHERE language IS NOT NULL GROUP BY ALL),
top AS (SELECT repository, language FROM (
  SELECT *, row_number() OVER (PARTITION BY repository ORDER BY n DESC, language) AS r FROM g) WHERE r = 1)
SELECT r.repository, coalesce(top.language, 'Unknown') AS primary_language
FROM (SELECT DISTINCT repository FROM v_files) r LEFT JOIN top ON top.repository = r.repository""")
def a05_primary_language(spark, sf_dir):
    return A.primary_language_by_files(probes.v_files(_t(spark, sf_dir)))


@register("a06_tech_stack", sql="""
SELECT repository, array_to_string(list_sort(list(DISTINCT language)), ',') AS tech_stack
FROM v_files WHERE language IS NOT NULL GROUP BY repository""")
def a06_tech_stack(spark, sf_dir):
    return A.tech_stack(probes.v_files(_t(spark, sf_dir)))


@register("a08_quality_metrics", sql=f"""
SELECT repository, round(avg(line_count), 1) AS avg_lines_per_file, round(avg(size_bytes) / 1024.0, 2) AS avg_kb_per_file,
       count(*) FILTER (WHERE line_count > 0 AND symbol_count = 0) AS files_without_symbols,
       CASE WHEN round(avg(line_count), 1) < 300 THEN 'good' ELSE 'warning' END AS line_status
FROM {SPF_SQL} GROUP BY repository""")
def a08_quality_metrics(spark, sf_dir):
    t = _t(spark, sf_dir)
    return A.quality_metrics(probes.v_files(t), probes.v_symbols(t))


@register("a09_entity_shape_counts", sql="""
SELECT vec_id AS entity_id, CAST(len(embedding) AS INTEGER) AS n_properties,
       CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS n_relationships,
       label > 0 AS has_primary_key
FROM embeddings""")
def a09_entity_shape_counts(spark, sf_dir):
    """A-09 on the embeddings arrays: property count = array size, relationship
    count = positive entries, primary key = positive label."""
    e = _t(spark, sf_dir).embeddings
    return e.select(F.col("vec_id").alias("entity_id"), F.size("embedding").alias("n_properties"),
                    F.size(F.filter("embedding", lambda x: x > 0)).alias("n_relationships"),
                    (F.col("label") > 0).alias("has_primary_key"))


@register("a10_enrichment_coverage", sql="""
SELECT d.source AS repository, count(*) AS total, count(l.doc_id) AS enriched,
       round(count(l.doc_id) * 100.0 / count(*), 2) AS pct
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source""")
def a10_enrichment_coverage(spark, sf_dir):
    t = _t(spark, sf_dir)
    return A.enrichment_coverage(t.documents, t.labels)


@register("a11_symbols_per_file", sql=f"""
SELECT id, repository, path, symbol_count FROM {SPF_SQL}""")
def a11_symbols_per_file(spark, sf_dir):
    t = _t(spark, sf_dir)
    return A.symbols_per_file(probes.v_files(t), probes.v_symbols(t))


@register("a12_largest_classes", sql="""
SELECT c.id, c.name, CAST(coalesce(k.n, 0) AS BIGINT) AS method_count
FROM (SELECT * FROM v_symbols WHERE kind = 'CLASS') c
LEFT JOIN (SELECT parent_name, count(*) AS n FROM v_symbols WHERE kind = 'METHOD' GROUP BY parent_name) k
  ON k.parent_name = c.fqn
ORDER BY method_count DESC, c.id LIMIT 10""")
def a12_largest_classes(spark, sf_dir):
    return A.largest_classes(probes.v_symbols(_t(spark, sf_dir)))


@register("a13_god_classes", sql="""
SELECT c.id, c.name, k.members, round(least(1.0, k.members / 50.0), 4) AS confidence
FROM (SELECT * FROM v_symbols WHERE kind IN ('CLASS', 'INTERFACE')) c
JOIN (SELECT parent_name, count(*) AS members FROM v_symbols WHERE parent_name IS NOT NULL GROUP BY parent_name) k
  ON k.parent_name = c.fqn WHERE k.members > 30""")
def a13_god_classes(spark, sf_dir):
    return A.god_classes(probes.v_symbols(_t(spark, sf_dir)))


@register("a13_god_classes_same_file", sql="""
SELECT c.id, c.name, m.methods, CAST(0.8 AS DOUBLE) AS confidence
FROM (SELECT * FROM v_symbols WHERE kind = 'CLASS') c
JOIN (SELECT parent_name, file_id, count(*) AS methods FROM v_symbols WHERE kind = 'METHOD' GROUP BY ALL) m
  ON m.parent_name = c.fqn AND m.file_id = c.file_id WHERE m.methods > 20""")
def a13_god_classes_same_file(spark, sf_dir):
    return A.god_classes_same_file(probes.v_symbols(_t(spark, sf_dir)))


def _indicator_case(col: str) -> str:
    parts = []
    for i, (_, names) in enumerate(A.MODULE_INDICATORS):
        lst = ", ".join(f"'{n}'" for n in names)
        parts.append(f"WHEN {col} IN ({lst}) THEN {i}")
    return "CASE " + " ".join(parts) + " END"


def _type_case(col: str) -> str:
    parts = [f"WHEN {col} = {i} THEN '{name}'" for i, (name, _) in enumerate(A.MODULE_INDICATORS)]
    return "CASE " + " ".join(parts) + " ELSE 'directory' END"


_ENTRY = ", ".join(f"'{n}'" for n in A.ENTRY_POINT_FILES)
_DOMINANT = ", ".join(f"'{n}'" for n in A.DOMINANT_FILES)

FILES_DIR_SQL = """(SELECT *, parts[len(parts)] AS filename, len(parts) - 1 AS dir_depth,
   array_to_string(parts[1:greatest(len(parts) - 1, 1)], '/') AS dir,
   coalesce(lower(language), 'unknown') AS lang
 FROM (SELECT *, string_split(path, '/') AS parts FROM {src}))"""

MODULE_STATS_SQL = f"""
WITH f AS (SELECT d.*, coalesce(c.n, 0) AS symbol_count, {_indicator_case('filename')} AS prio
           FROM {FILES_DIR_SQL.format(src='v_files')} d
           LEFT JOIN (SELECT file_id, count(*) AS n FROM v_symbols GROUP BY file_id) c ON c.file_id = d.id
           WHERE dir_depth >= 1),
langs AS (SELECT repository, dir, array_to_string(list_sort(list(lang || ':' || CAST(c AS VARCHAR))), ',') AS languages
          FROM (SELECT repository, dir, lang, count(*) AS c FROM f GROUP BY ALL) GROUP BY ALL),
g AS (SELECT repository, dir, count(*) AS file_count, CAST(sum(symbol_count) AS BIGINT) AS symbol_count,
             CAST(sum(coalesce(line_count, 0)) AS BIGINT) AS line_count, min(prio) AS prio,
             coalesce(array_to_string(list_sort(list(DISTINCT filename) FILTER (WHERE filename IN ({_ENTRY}))), ','), '') AS entry_points,
             bool_or(contains(lower(filename), 'test') OR contains(lower(filename), 'spec')) AS has_tests
      FROM f GROUP BY ALL)
SELECT g.repository, g.dir AS path, split_part(g.dir, '/', -1) AS name, CAST(len(string_split(g.dir, '/')) AS INTEGER) AS depth,
       {_type_case('prio')} AS module_type, prio IS NOT NULL AS is_package, file_count, symbol_count, line_count,
       languages, entry_points, has_tests
FROM g JOIN langs USING (repository, dir)
WHERE prio IS NOT NULL OR file_count >= 2 OR symbol_count >= 5"""


@register("a14_module_stats", sql=MODULE_STATS_SQL)
def a14_module_stats(spark, sf_dir):
    t = _t(spark, sf_dir)
    return A.module_stats(probes.v_files(t), probes.v_symbols(t))


def _purpose_case(col: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in A.DIRECTORY_PURPOSES.items()) + " END"


@register("a15_project_map", sql=f"""
WITH f AS (SELECT *, array_to_string(parts[1:least(dir_depth, {PROJECT_MAP_DEPTH})], '/') AS target
           FROM {FILES_DIR_SQL.format(src='v_tree')} WHERE dir_depth >= 1),
dirs AS (SELECT DISTINCT repository, array_to_string(parts[1:k], '/') AS target
         FROM (SELECT repository, parts, unnest(generate_series(1, greatest(least(len(parts) - 1, {PROJECT_MAP_DEPTH}), 1))) AS k FROM f)),
tl AS (SELECT repository, target, lang AS top_lang, c AS top_c FROM (
         SELECT *, row_number() OVER (PARTITION BY repository, target ORDER BY c DESC, lang) AS r
         FROM (SELECT repository, target, lang, count(*) AS c FROM f GROUP BY ALL)) WHERE r = 1),
g AS (SELECT repository, target, count(*) AS file_count, CAST(sum(coalesce(line_count, 0)) AS BIGINT) AS line_count,
             array_to_string(list_sort(list(DISTINCT filename) FILTER (WHERE filename IN ({_DOMINANT}))), ',') AS dominant_files
      FROM f GROUP BY ALL)
SELECT d.repository, d.target AS path, split_part(d.target, '/', -1) AS name,
       CAST(len(string_split(d.target, '/')) AS INTEGER) AS depth,
       CAST(coalesce(g.file_count, 0) AS BIGINT) AS file_count, CAST(coalesce(g.line_count, 0) AS BIGINT) AS line_count,
       CASE WHEN tl.top_c * 2 > g.file_count THEN tl.top_lang END AS dominant_language,
       {_purpose_case("lower(split_part(d.target, '/', -1))")} AS purpose,
       coalesce(g.dominant_files, '') AS dominant_files
FROM dirs d LEFT JOIN g USING (repository, target) LEFT JOIN tl USING (repository, target)""")
def a15_project_map(spark, sf_dir):
    return A.project_map(probes.v_tree(_t(spark, sf_dir)), PROJECT_MAP_DEPTH)


@register("a16_repository_totals", sql=f"""
WITH f AS (SELECT *, coalesce(lower(language), 'unknown') AS lang FROM {SPF_SQL}),
tot AS (SELECT repository, count(*) AS total_files, CAST(sum(coalesce(line_count, 0)) AS BIGINT) AS total_lines,
               CAST(sum(coalesce(size_bytes, 0)) AS BIGINT) AS total_size, CAST(sum(symbol_count) AS BIGINT) AS total_symbols
        FROM f GROUP BY repository)
SELECT l.repository, l.lang, l.files, tot.total_files, tot.total_lines, tot.total_size, tot.total_symbols,
       round(l.files * 100.0 / tot.total_files, 1) AS pct
FROM (SELECT repository, lang, count(*) AS files FROM f GROUP BY ALL) l JOIN tot USING (repository)""")
def a16_repository_totals(spark, sf_dir):
    t = _t(spark, sf_dir)
    return A.repository_totals(probes.v_files(t), probes.v_symbols(t))


@register("a17_module_hash", sql="""
WITH m AS (SELECT repository, path, content_hash,
                  array_to_string(parts[1:k], '/') AS module_path
           FROM (SELECT *, unnest(generate_series(1, greatest(len(parts) - 1, 1))) AS k
                 FROM (SELECT *, string_split(path, '/') AS parts FROM v_files)))
SELECT repository, module_path, sha256(string_agg(path || ':' || coalesce(content_hash, ''), '' ORDER BY path)) AS module_hash
FROM m GROUP BY repository, module_path""")
def a17_module_hash(spark, sf_dir):
    return A.module_hash(probes.v_files(_t(spark, sf_dir)))


PARTS_SQL = """(SELECT id, parent_name AS fqn, 'CLASS' AS kind, file_id, start_line, end_line, documentation
  FROM v_symbols WHERE parent_name IS NOT NULL)"""


def _parts(t):
    """Partial-class probe: member rows seen as fragments of their brand class."""
    s = probes.v_symbols(t).where(F.col("parent_name").isNotNull())
    return s.select("id", F.col("parent_name").alias("fqn"), F.lit("CLASS").alias("kind"), "file_id",
                    "start_line", "end_line", "documentation")


@register("a18_merge_partials", sql=f"""
SELECT fqn, kind, count(*) AS n_parts, count(DISTINCT file_id) AS n_files, min(start_line) AS start_line,
       max(end_line) AS end_line, arg_min(id, (file_id, id)) AS primary_id, count(documentation) AS n_documented
FROM {PARTS_SQL} GROUP BY fqn, kind HAVING count(*) > 1""")
def a18_merge_partials(spark, sf_dir):
    return A.merge_partials(_parts(_t(spark, sf_dir)))


@register("a19_fragment_to_primary", sql=f"""
WITH p AS {PARTS_SQL},
m AS (SELECT fqn, kind, arg_min(id, (file_id, id)) AS primary_id FROM p GROUP BY fqn, kind HAVING count(*) > 1)
SELECT p.id AS fragment_id, m.primary_id AS merged_into FROM p JOIN m USING (fqn, kind) WHERE p.id <> m.primary_id""")
def a19_fragment_to_primary(spark, sf_dir):
    return A.fragment_to_primary(_parts(_t(spark, sf_dir)))


PROJECTS_SQL = """(SELECT c_custkey AS id, c_nationkey AS repository_id, c_mktsegment AS name,
  CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS solution_id,
  CASE WHEN c_custkey % 3 = 0 THEN 'g' || CAST(c_custkey AS VARCHAR) END AS project_guid,
  CASE WHEN c_custkey % 5 = 0 THEN c_name END AS assembly_name,
  CASE WHEN c_custkey % 7 = 0 THEN 'net8.0' END AS target_framework FROM customer)"""


def _projects(t):
    c = t.customer
    k = F.col("c_custkey")
    return c.select(k.alias("id"), F.col("c_nationkey").alias("repository_id"), F.col("c_mktsegment").alias("name"),
                    F.when(k % 2 == 0, k).alias("solution_id"),
                    F.when(k % 3 == 0, F.concat(F.lit("g"), k.cast("string"))).alias("project_guid"),
                    F.when(k % 5 == 0, F.col("c_name")).alias("assembly_name"),
                    F.when(k % 7 == 0, F.lit("net8.0")).alias("target_framework"))


@register("a20_dedupe_projects", sql=f"""
WITH p AS (SELECT *, (CASE WHEN solution_id IS NOT NULL THEN 1000 ELSE 0 END)
                   + (CASE WHEN project_guid IS NOT NULL THEN 100 ELSE 0 END)
                   + (CASE WHEN assembly_name IS NOT NULL THEN 10 ELSE 0 END)
                   + (CASE WHEN target_framework IS NOT NULL THEN 1 ELSE 0 END) AS score FROM {PROJECTS_SQL}),
b AS (SELECT repository_id, name, arg_max(id, (score, -id)) AS primary_id, max(score) AS primary_score,
             count(*) AS n_members FROM p GROUP BY ALL)
SELECT p.id, p.repository_id, p.name, b.primary_id, b.primary_score, b.n_members FROM p JOIN b USING (repository_id, name)""")
def a20_dedupe_projects(spark, sf_dir):
    return A.dedupe_projects(_projects(_t(spark, sf_dir)))


@register("a22_latest_per_key", sql="""
SELECT o_custkey, o_orderkey, o_orderdate FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
WHERE rn = 1""")
def a22_latest_per_key(spark, sf_dir):
    o = _t(spark, sf_dir).orders.select("o_custkey", "o_orderkey", "o_orderdate")
    return A.latest_per_key(o, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])


DEPS_SQL = """(SELECT p_partkey AS id, p_partkey % 50 AS repository_id, p_name AS package_name,
  CASE WHEN p_size % 3 <> 0 THEN CAST(p_size AS VARCHAR) || '.0' END AS package_version,
  p_type AS dependency_type, p_size > 40 AS is_dev_dependency FROM part)"""


def _deps(t):
    p = t.part
    return p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 50).alias("repository_id"),
                    F.col("p_name").alias("package_name"),
                    F.when(F.col("p_size") % 3 != 0, F.concat(F.col("p_size").cast("string"), F.lit(".0")))
                    .alias("package_version"),
                    F.col("p_type").alias("dependency_type"), (F.col("p_size") > 40).alias("is_dev_dependency"))


@register("a23_dependency_report", sql=f"""
SELECT id, dependency_type,
       package_name || ' ' || coalesce(package_version, 'unknown') || CASE WHEN is_dev_dependency THEN ' (dev)' ELSE '' END AS display,
       count(*) OVER (PARTITION BY dependency_type) AS type_count
FROM {DEPS_SQL}""")
def a23_dependency_report(spark, sf_dir):
    """A-23: display string per dependency and the count of its type (a
    grouped count joined back — no window over a hot type)."""
    d = _deps(_t(spark, sf_dir))
    counts = d.groupBy("dependency_type").agg(F.count(F.lit(1)).alias("type_count"))
    disp = F.concat(F.col("package_name"), F.lit(" "), F.coalesce("package_version", F.lit("unknown")),
                    F.when(F.col("is_dev_dependency"), F.lit(" (dev)")).otherwise(F.lit("")))
    return d.select("id", "dependency_type", disp.alias("display")).join(counts, "dependency_type")


def _ext_case(col: str) -> str:
    parts = []
    for words, label in A.EXTERNAL_SYSTEMS:
        cond = " OR ".join(f"contains(lower({col}), '{w}')" for w in words)
        parts.append(f"WHEN {cond} THEN '{label}'")
    return "CASE " + " ".join(parts) + " END"


# part names hold no package words; the probe appends a word chosen by size
EXT_DEPS_SQL = """(SELECT p_partkey % 50 AS repository_id,
  p_name || CASE p_size % 6 WHEN 0 THEN '.rabbitmq' WHEN 1 THEN '.postgres' WHEN 2 THEN '.redis'
                            WHEN 3 THEN '.mongodb' ELSE '' END AS package_name FROM part)"""


@register("a24_external_systems", sql=f"""
SELECT DISTINCT repository_id, {_ext_case('package_name')} AS system FROM {EXT_DEPS_SQL}
WHERE {_ext_case('package_name')} IS NOT NULL""")
def a24_external_systems(spark, sf_dir):
    p = _t(spark, sf_dir).part
    word = (F.when(F.col("p_size") % 6 == 0, ".rabbitmq").when(F.col("p_size") % 6 == 1, ".postgres")
            .when(F.col("p_size") % 6 == 2, ".redis").when(F.col("p_size") % 6 == 3, ".mongodb").otherwise(""))
    d = p.select((F.col("p_partkey") % 50).alias("repository_id"),
                 F.concat(F.col("p_name"), word).alias("package_name"))
    return A.external_systems(d)


@register("a26_parent_match_audit", sql="""
WITH p AS (SELECT DISTINCT parent_name FROM v_symbols WHERE parent_name IS NOT NULL),
c AS (SELECT * FROM v_symbols WHERE kind IN ('CLASS', 'INTERFACE')),
j AS (SELECT p.parent_name, p.parent_name IN (SELECT fqn FROM c) AS fqn_hit,
             p.parent_name IN (SELECT name FROM c) AS name_hit FROM p)
SELECT count(*) AS distinct_parents, count(*) FILTER (WHERE fqn_hit) AS matched,
       count(*) FILTER (WHERE NOT fqn_hit) AS unmatched, count(*) FILTER (WHERE NOT fqn_hit AND name_hit) AS name_only
FROM j""")
def a26_parent_match_audit(spark, sf_dir):
    return A.parent_match_audit(probes.v_symbols(_t(spark, sf_dir)))


@register("a27_language_file_symbol_stats", sql=f"""
SELECT language, count(*) AS files, CAST(sum(symbol_count) AS BIGINT) AS symbols FROM {SPF_SQL} GROUP BY language""")
def a27_language_file_symbol_stats(spark, sf_dir):
    t = _t(spark, sf_dir)
    return A.language_file_symbol_stats(probes.v_files(t), probes.v_symbols(t))


@register("a28_key_symbols", sql=f"""
WITH s1 AS (SELECT * FROM {CTX_SQL}),
s2 AS (SELECT *, coalesce(complexity, 0) + CASE WHEN kind = 'ENDPOINT' OR contains(name, 'Controller')
            OR contains(name, 'Service') OR contains(name, 'Handler') OR contains(name, 'Manager') THEN 1000 ELSE 0 END
            AS priority_score FROM s1),
s3 AS (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY priority_score DESC, coalesce(complexity, 0) DESC, id) AS rank FROM s2)
SELECT repository, id, name, priority_score, CAST(rank AS BIGINT) AS rank FROM s3 WHERE rank <= 50""")
def a28_key_symbols(spark, sf_dir):
    t = _t(spark, sf_dir)
    return A.key_symbols(R.symbol_context(probes.v_symbols(t), probes.v_files(t)))


@register("a29_context_budget", sql="""
SELECT conv_id, turn, CAST(cum_len AS BIGINT) AS cum_len FROM (
  SELECT conv_id, turn, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_len FROM v_turns)
WHERE cum_len <= 30000""")
def a29_context_budget(spark, sf_dir):
    tr = probes.v_turns(_t(spark, sf_dir))
    return (R.running_budget(tr, ["conv_id"], [F.col("turn")], F.length("text"), 30000)
            .select("conv_id", "turn", F.col("cum_len").cast("bigint").alias("cum_len")))


@register("a31_heuristic_module_summary", sql=f"""
WITH m AS ({MODULE_STATS_SQL}),
l AS (SELECT repository, path, arg_min(split_part(x, ':', 1), (-CAST(split_part(x, ':', 2) AS INTEGER), split_part(x, ':', 1))) AS lang
      FROM (SELECT repository, path, unnest(string_split(languages, ',')) AS x FROM m) GROUP BY ALL)
SELECT m.repository, m.path,
       CASE WHEN is_package THEN 'A ' || l.lang || ' package containing ' || CAST(file_count AS VARCHAR) || ' files'
            ELSE 'A directory containing ' || CAST(file_count AS VARCHAR) || ' ' || l.lang || ' files' END
       || CASE WHEN symbol_count > 0 THEN '. with ' || CAST(symbol_count AS VARCHAR) || ' code symbols ('
               || CAST(line_count AS VARCHAR) || ' lines)' ELSE '' END || '.' AS functional_summary,
       'Module at ' || m.path AS business_purpose,
       CAST(least(10, greatest(1, file_count // 2)) AS INTEGER) AS complexity_score
FROM m JOIN l USING (repository, path)""")
def a31_heuristic_module_summary(spark, sf_dir):
    t = _t(spark, sf_dir)
    return A.heuristic_module_summary(A.module_stats(probes.v_files(t), probes.v_symbols(t)))


@register("a33_system_map", sql=f"""
WITH pl AS (SELECT repository, language FROM (
  SELECT repository, language, row_number() OVER (PARTITION BY repository ORDER BY n DESC, language) AS r
  FROM (SELECT repository, language, count(*) AS n FROM v_files WHERE language IS NOT NULL GROUP BY ALL)) WHERE r = 1),
ts AS (SELECT repository, array_to_string(list_sort(list(DISTINCT language)), ',') AS tech_stack
       FROM v_files WHERE language IS NOT NULL GROUP BY repository),
top AS (SELECT repository, id, name, r FROM (
  SELECT repository, id, name, row_number() OVER (PARTITION BY repository ORDER BY coalesce(complexity, 0) DESC, id) AS r
  FROM {CTX_SQL} WHERE kind IN ('CLASS', 'MODULE', 'NAMESPACE')) WHERE r <= 10)
SELECT top.repository, pl.language AS primary_language, ts.tech_stack, top.id AS symbol_id, top.name,
       CAST(top.r AS BIGINT) AS rank
FROM top LEFT JOIN pl USING (repository) LEFT JOIN ts USING (repository)""")
def a33_system_map(spark, sf_dir):
    """A-33: per repository: primary language, tech stack and the first 10
    CLASS/MODULE/NAMESPACE symbols (complexity desc, id) in long form."""
    from pyspark.sql import Window
    t = _t(spark, sf_dir)
    files = probes.v_files(t)
    ctx = R.symbol_context(probes.v_symbols(t), files)
    w = Window.partitionBy("repository").orderBy(F.coalesce("complexity", F.lit(0)).desc(), "id")
    top = (ctx.where(F.col("kind").isin("CLASS", "MODULE", "NAMESPACE"))
           .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 10))
    pl = A.primary_language_by_files(files).where(F.col("primary_language") != "Unknown")
    return (top.join(pl, "repository", "left").join(A.tech_stack(files), "repository", "left")
            .select("repository", "primary_language", "tech_stack", F.col("id").alias("symbol_id"), "name",
                    F.col("rank").cast("bigint").alias("rank")))


@register("s03_merge_id_sets", sql=f"""
WITH p AS {PARTS_SQL},
g AS (SELECT fqn, kind FROM p GROUP BY fqn, kind HAVING count(*) > 1)
SELECT DISTINCT fqn, kind, 'file' AS id_kind, file_id AS value FROM p JOIN g USING (fqn, kind) WHERE file_id IS NOT NULL
UNION ALL SELECT DISTINCT fqn, kind, 'symbol', id FROM p JOIN g USING (fqn, kind)""")
def s03_merge_id_sets(spark, sf_dir):
    """S-03: the union of file ids and merged symbol ids of each merged
    partial-type group (A-18), in long form (no per-group array)."""
    parts = _parts(_t(spark, sf_dir))
    groups = A.merge_partials(parts).select("fqn", "kind")
    p = parts.join(groups, ["fqn", "kind"], "left_semi")
    files = p.where(F.col("file_id").isNotNull()).select("fqn", "kind", F.lit("file").alias("id_kind"),
                                                          F.col("file_id").alias("value")).distinct()
    syms = p.select("fqn", "kind", F.lit("symbol").alias("id_kind"), F.col("id").alias("value")).distinct()
    return files.unionByName(syms)
