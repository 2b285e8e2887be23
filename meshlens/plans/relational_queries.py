"""Registered filter / join / sort / window / set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlens.functions.urls import normalize_url
from meshlens.operators import relational as R
from meshlens.plans.oracle_views import norm_url_sql
from meshlens.plans.catalog import register
from meshlens.sources import probes
from meshlens.sources.tables import load_tables

# Fixed values pinned for the probes: literals that occur in the data.
GLOB = "src1/**/d3/*.md"
LANGUAGE = "en"
MIN_COMPLEXITY = 10
TOP_N = 50


def _ctx(t):
    return R.symbol_context(probes.v_symbols(t), probes.v_files(t))


CTX_SQL = "(SELECT s.*, f.path, f.repository, f.language FROM v_symbols s JOIN v_files f ON s.file_id = f.id)"


@register("f01_path_glob", sql=f"""
SELECT f.id, f.path, f.repository, coalesce(c.n, 0) AS symbol_count
FROM v_files f LEFT JOIN (SELECT file_id, count(*) AS n FROM v_symbols GROUP BY file_id) c ON c.file_id = f.id
WHERE regexp_matches(f.path, '{R.search_glob_regex(GLOB)}')""")
def f01_path_glob(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    return R.path_glob(probes.v_files(t), probes.v_symbols(t), GLOB)


_EXCL = "|".join(f"(?:{R.exclusion_glob_regex(g)})" for g in R.DEFAULT_EXCLUSIONS)


@register("f02_exclude_paths", sql=f"""
SELECT id, path FROM v_tree WHERE NOT regexp_matches(replace(path, '\\', '/'), '{_EXCL}')""")
def f02_exclude_paths(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    return R.exclude_paths(probes.v_tree(t)).select("id", "path")


_TEST = "|".join(f"(?:{R.exclusion_glob_regex(g)})" for g in R.TEST_PATTERNS)
_GEN = "|".join(f"(?:(?i){r})" for r in R.GENERATED_REGEXES)


@register("f03_flag_files", sql=f"""
SELECT id, path, regexp_matches(replace(path, '\\', '/'), '{_TEST}') AS is_test,
       regexp_matches(path, '{_GEN}') AS is_generated
FROM v_tree""")
def f03_flag_files(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    return R.flag_files(probes.v_tree(t))


@register("f07_filter_entities", sql="""
SELECT id, name, kind, access FROM v_symbols
WHERE kind IN ('METHOD', 'FUNCTION') AND access = 'PUBLIC'""")
def f07_filter_entities(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    return R.filter_entities(probes.v_symbols(t), kind=("METHOD", "FUNCTION"), access="PUBLIC",
                             language=None).select("id", "name", "kind", "access")


@register("f08_public_methods", sql=f"""
SELECT id, name, signature, path, repository FROM {CTX_SQL}
WHERE kind IN ('METHOD', 'FUNCTION') AND access = 'PUBLIC'""")
def f08_public_methods(spark, sf_dir):
    return R.public_methods(_ctx(load_tables(spark, sf_dir)))


@register("f09_undocumented", sql=f"""
SELECT id, name, kind, signature, path FROM {CTX_SQL}
WHERE kind IN ('METHOD', 'FUNCTION', 'CLASS') AND access = 'PUBLIC'
  AND (documentation IS NULL OR documentation = '')""")
def f09_undocumented(spark, sf_dir):
    return R.undocumented(_ctx(load_tables(spark, sf_dir)))


# the probe has no class named "controller"; "brand#1" pins the same predicate
CONTROLLER_TERM = "brand#1"


@register("f10_controllers", sql=f"""
SELECT id, name, kind, signature, path, repository FROM {CTX_SQL}
WHERE kind = 'CLASS' AND (contains(lower(name), '{CONTROLLER_TERM}') OR contains(lower(path), '{CONTROLLER_TERM}'))""")
def f10_controllers(spark, sf_dir):
    return R.controllers(_ctx(load_tables(spark, sf_dir)), CONTROLLER_TERM)


@register("f11_symbols_by_language", sql=f"""
SELECT id, name, kind, signature, path FROM {CTX_SQL} WHERE language = '{LANGUAGE}'""")
def f11_symbols_by_language(spark, sf_dir):
    return R.symbols_by_language(_ctx(load_tables(spark, sf_dir)), LANGUAGE)


@register("j01_symbol_context", sql=f"""
SELECT id, name, kind, file_id, path, repository FROM {CTX_SQL}""")
def j01_symbol_context(spark, sf_dir):
    return _ctx(load_tables(spark, sf_dir)).select("id", "name", "kind", "file_id", "path", "repository")


@register("j02_symbol_edges", sql="""
WITH e AS (SELECT * FROM v_edges WHERE type IN ('CALLS', 'INHERITS')),
u AS (SELECT src AS id, dst AS other_id, CASE WHEN type = 'CALLS' THEN 'calls' ELSE 'inherits_from' END AS relation FROM e
      UNION ALL
      SELECT dst, src, CASE WHEN type = 'CALLS' THEN 'called_by' ELSE 'inherited_by' END FROM e)
SELECT u.id, u.relation, u.other_id, o.name AS other_name, o.kind AS other_kind
FROM u JOIN v_symbols o ON o.id = u.other_id
WHERE u.id IN (SELECT id FROM v_symbols)""")
def j02_symbol_edges(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    return R.symbol_edges(probes.v_symbols(t), probes.v_edges(t))


@register("j03_callers", sql="""
SELECT e.dst AS target_id, e.src AS caller_id, s.name AS caller_name, s.kind AS caller_kind
FROM v_edges e JOIN v_symbols s ON s.id = e.src WHERE e.type = 'CALLS'""")
def j03_callers(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    return R.callers(probes.v_symbols(t), probes.v_edges(t))


@register("j03_calling_symbols", sql="""
SELECT id, name, kind FROM v_symbols WHERE id IN (SELECT src FROM v_edges WHERE type = 'CALLS')""")
def j03_calling_symbols(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    return R.calling_symbols(probes.v_symbols(t), probes.v_edges(t))


@register("j04_usages", sql="""
SELECT dst AS symbol_id, type, count(*) AS n FROM v_edges GROUP BY dst, type""")
def j04_usages(spark, sf_dir):
    return R.usages(probes.v_edges(load_tables(spark, sf_dir)))


@register("j04_references_filtered", sql="""
SELECT dst AS symbol_id, type, count(*) AS n FROM v_edges WHERE type IN ('USES', 'IMPORTS') GROUP BY dst, type""")
def j04_references_filtered(spark, sf_dir):
    return R.usages(probes.v_edges(load_tables(spark, sf_dir)), types=("USES", "IMPORTS"))


@register("j05_implementations", sql="""
SELECT e.dst AS interface_id, d.name AS interface_name, e.src AS class_id, s.name AS class_name
FROM v_edges e JOIN v_symbols s ON s.id = e.src JOIN v_symbols d ON d.id = e.dst
WHERE e.type = 'IMPLEMENTS' AND s.kind = 'CLASS' AND d.kind = 'INTERFACE'""")
def j05_implementations(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    return R.implementations(probes.v_symbols(t), probes.v_edges(t))


@register("j06_inheritance_pairs", sql="""
SELECT e.src AS child_id, s.name AS child_name, e.dst AS parent_id, d.name AS parent_name
FROM v_edges e JOIN v_symbols s ON s.id = e.src JOIN v_symbols d ON d.id = e.dst
WHERE e.type = 'INHERITS' AND s.kind = 'CLASS' AND d.kind IN ('CLASS', 'INTERFACE')""")
def j06_inheritance_pairs(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    return R.inheritance_pairs(probes.v_symbols(t), probes.v_edges(t))


@register("j07_unused_symbols", sql=f"""
SELECT id, name, kind, signature, path FROM {CTX_SQL} c
WHERE kind IN ('METHOD', 'FUNCTION', 'CLASS') AND access <> 'PRIVATE'
  AND NOT EXISTS (SELECT 1 FROM v_edges e WHERE e.type = 'CALLS' AND e.dst = c.id)""")
def j07_unused_symbols(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    return R.unused_symbols(_ctx(t), probes.v_edges(t))


@register("j08_dead_code", sql="""
SELECT id, name, kind, 0.6::DOUBLE AS confidence FROM v_symbols s
WHERE kind IN ('METHOD', 'FUNCTION', 'CLASS') AND access = 'PUBLIC'
  AND NOT EXISTS (SELECT 1 FROM v_edges e WHERE e.dst = s.id)""")
def j08_dead_code(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    return R.dead_code(probes.v_symbols(t), probes.v_edges(t))


@register("j09_files_without_symbols", sql="""
SELECT id, path FROM v_files f WHERE NOT EXISTS (SELECT 1 FROM v_symbols s WHERE s.file_id = f.id)""")
def j09_files_without_symbols(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    return R.files_without_symbols(probes.v_files(t), probes.v_symbols(t))


@register("j10_orphan_edges", sql="""
SELECT src, dst, type FROM v_edges e
WHERE NOT (EXISTS (SELECT 1 FROM v_symbols s WHERE s.id = e.src) AND EXISTS (SELECT 1 FROM v_symbols s WHERE s.id = e.dst))""")
def j10_orphan_edges(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    return R.orphan_edges(probes.v_edges(t), probes.v_symbols(t)).select("src", "dst", "type")


@register("j10_clean_edges", sql="""
SELECT src, dst, type FROM v_edges e
WHERE EXISTS (SELECT 1 FROM v_symbols s WHERE s.id = e.src) AND EXISTS (SELECT 1 FROM v_symbols s WHERE s.id = e.dst)""")
def j10_clean_edges(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    return R.clean_edges(probes.v_edges(t), probes.v_symbols(t)).select("src", "dst", "type")


@register("j30_tracked_status", sql="""
SELECT n.id, n.path, o.id AS tracked_id, o.id IS NOT NULL AS is_tracked
FROM v_new n LEFT JOIN v_old o ON o.path = n.path""")
def j30_tracked_status(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    return R.tracked_status(probes.v_new(t).select("id", "path"), probes.v_old(t).select("id", "path"),
                            ["path"]).select("id", "path", "tracked_id", "is_tracked")


@register("j30_tracked_counts", sql="""
SELECT count(*) FILTER (WHERE o.id IS NOT NULL) AS tracked, count(*) FILTER (WHERE o.id IS NULL) AS untracked
FROM v_new n LEFT JOIN v_old o ON o.path = n.path""")
def j30_tracked_counts(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    s = R.tracked_status(probes.v_new(t).select("id", "path"), probes.v_old(t).select("id", "path"), ["path"])
    return s.agg(F.count(F.when(F.col("is_tracked"), 1)).alias("tracked"),
                 F.count(F.when(~F.col("is_tracked"), 1)).alias("untracked"))


@register("j31_controller_methods", sql="""
WITH cls AS (SELECT id AS class_id, fqn AS class_fqn FROM v_symbols WHERE kind IN ('CLASS', 'INTERFACE')),
m AS (SELECT * FROM v_symbols WHERE kind IN ('METHOD', 'FUNCTION'))
SELECT method_id, class_id, tier FROM (
  SELECT m.id AS method_id, cls.class_id, 2 AS tier,
         row_number() OVER (PARTITION BY m.id ORDER BY cls.class_id) AS rn
  FROM m JOIN cls ON m.parent_name = cls.class_fqn) WHERE rn = 1""")
def j31_controller_methods(spark, sf_dir):
    return R.controller_methods(probes.v_symbols(load_tables(spark, sf_dir)))


# ----------------------------------------------------------------- sorts / top-k / windows

@register("t01_complex_methods", sql=f"""
SELECT id, name, complexity, signature, path, repository FROM {CTX_SQL}
WHERE kind IN ('METHOD', 'FUNCTION') AND complexity > {MIN_COMPLEXITY}
ORDER BY complexity DESC, path, id LIMIT {TOP_N}""")
def t01_complex_methods(spark, sf_dir):
    ctx = _ctx(load_tables(spark, sf_dir))
    return (ctx.where(F.col("kind").isin("METHOD", "FUNCTION") & (F.col("complexity") > MIN_COMPLEXITY))
            .orderBy(F.col("complexity").desc(), "path", "id").limit(TOP_N)
            .select("id", "name", "complexity", "signature", "path", "repository"))


@register("t02_page_with_total", sql="""
SELECT id, status, started_at, (SELECT count(*) FROM v_jobs) AS total FROM v_jobs
ORDER BY started_at DESC, id DESC LIMIT 20 OFFSET 40""")
def t02_page_with_total(spark, sf_dir):
    """T-02: third page of 20, newest first, with the total count (a one-row
    aggregate joined back — no global window over the whole table)."""
    jobs = probes.v_jobs(load_tables(spark, sf_dir))
    total = jobs.agg(F.count(F.lit(1)).alias("total"))
    page = (jobs.orderBy(F.col("started_at").desc(), F.col("id").desc()).offset(40).limit(20)
            .select("id", "status", "started_at"))
    return page.withColumn("total", total.scalar())


@register("t05_tie_broken_topk", sql="""
SELECT id, path, size_bytes FROM v_files ORDER BY size_bytes DESC, path, id LIMIT 25""")
def t05_tie_broken_topk(spark, sf_dir):
    f = probes.v_files(load_tables(spark, sf_dir))
    return f.orderBy(F.col("size_bytes").desc(), "path", "id").limit(25).select("id", "path", "size_bytes")


@register("t06_entry_points_first", sql="""
SELECT id, name FROM v_symbols ORDER BY (name LIKE '%widget%') DESC, id LIMIT 30""")
def t06_entry_points_first(spark, sf_dir):
    s = probes.v_symbols(load_tables(spark, sf_dir))
    return s.orderBy(F.col("name").like("%widget%").desc(), "id").limit(30).select("id", "name")


@register("t07_symbols_in_file", sql="""
SELECT file_id, kind, count(*) AS n, min(start_line) AS first_line,
       left(coalesce(arg_min_null(documentation, CAST(start_line AS BIGINT) * 100000000000000 + id), ''), 100) AS first_doc_preview
FROM v_symbols WHERE file_id IS NOT NULL GROUP BY file_id, kind""")
def t07_symbols_in_file(spark, sf_dir):
    """T-07: per file and kind: count, first line and the first symbol's 100-char
    doc preview (first by start line, then id)."""
    s = probes.v_symbols(load_tables(spark, sf_dir)).where(F.col("file_id").isNotNull())
    return s.groupBy("file_id", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.min("start_line").alias("first_line"),
        F.substring(F.coalesce(F.min_by("documentation", F.struct("start_line", "id")), F.lit("")), 1, 100)
        .alias("first_doc_preview"))


@register("t04_sample_per_group", sql="""
SELECT id, repository, language, path FROM (
  SELECT *, row_number() OVER (PARTITION BY repository, language ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) AS rn FROM v_files)
WHERE rn <= 5""")
def t04_sample_per_group(spark, sf_dir):
    f = probes.v_files(load_tables(spark, sf_dir)).select("id", "repository", "language", "path")
    return R.sample_per_group(f, ["repository", "language"], "id", n=5)


@register("w01_rank_list", sql="""
SELECT id, CAST(row_number() OVER (ORDER BY size_bytes DESC, id) AS BIGINT) AS rank
FROM v_files ORDER BY size_bytes DESC, id LIMIT 100""")
def w01_rank_list(spark, sf_dir):
    from pyspark.sql import Window
    f = probes.v_files(load_tables(spark, sf_dir))
    order = [F.col("size_bytes").desc(), F.col("id")]
    return (f.orderBy(*order).limit(100)
            .withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
            .select("id", "rank"))


@register("w02_first_chunk", sql="""
SELECT conv_id, arg_min(text, turn) AS snippet FROM v_turns GROUP BY conv_id""")
def w02_first_chunk(spark, sf_dir):
    return R.first_chunk(probes.v_turns(load_tables(spark, sf_dir)), "conv_id", "turn", "text")


@register("w03_best_match_per_key", sql="""
SELECT id, repository, size_bytes FROM (
  SELECT id, repository, size_bytes, row_number() OVER (PARTITION BY repository ORDER BY size_bytes DESC, id) AS rn
  FROM v_files) WHERE rn = 1""")
def w03_best_match_per_key(spark, sf_dir):
    f = probes.v_files(load_tables(spark, sf_dir)).select("id", "repository", "size_bytes")
    return R.top_per_key(f, ["repository"], [F.col("size_bytes").desc(), F.col("id")])


@register("w04_running_budget", sql="""
SELECT conv_id, turn, CAST(cum_len AS BIGINT) AS cum_len FROM (
  SELECT conv_id, turn, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_len FROM v_turns)
WHERE cum_len <= 3000""")
def w04_running_budget(spark, sf_dir):
    tr = probes.v_turns(load_tables(spark, sf_dir))
    return (R.running_budget(tr, ["conv_id"], [F.col("turn")], F.length("text"), 3000)
            .select("conv_id", "turn", F.col("cum_len").cast("bigint").alias("cum_len")))


@register("w05_nearest_preceding", sql="""
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (
         PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS preceding
FROM v_turns""")
def w05_nearest_preceding(spark, sf_dir):
    tr = probes.v_turns(load_tables(spark, sf_dir))
    return R.nearest_preceding(tr, ["conv_id"], "turn", F.col("role") == "user", F.col("turn")) \
        .select("conv_id", "turn", "preceding")


# ----------------------------------------------------------------- set operations

@register("s02_segment_overlap", sql=f"""
WITH c AS (SELECT id, {norm_url_sql('path')} AS route,
                  list_distinct(list_filter(string_split(lower(path), '/'), lambda x: x <> '')) AS segs FROM v_calls),
e AS (SELECT id, route, list_distinct(list_filter(string_split(route, '/'), lambda x: x <> '')) AS segs FROM v_endpoints)
SELECT c.id AS call_id, e.id AS endpoint_id, CAST(len(list_intersect(c.segs, e.segs)) AS BIGINT) AS shared
FROM c JOIN e ON c.route = e.route""")
def s02_segment_overlap(spark, sf_dir):
    """S-02: shared path segments between each call and the endpoint with the
    same normalized route (an equi-join; no pairs within a segment group)."""
    t = load_tables(spark, sf_dir)

    def segs(c):
        return F.array_distinct(F.filter(F.split(c, "/"), lambda x: x != ""))
    c = probes.v_calls(t).select(F.col("id").alias("call_id"), normalize_url(F.col("path")).alias("route"),
                                 segs(F.lower("path")).alias("a"))
    e = probes.v_endpoints(t).select(F.col("id").alias("endpoint_id"), "route", segs(F.col("route")).alias("b"))
    return c.join(e, "route").select("call_id", "endpoint_id",
                                     R.segment_overlap(F.col("a"), F.col("b")).cast("bigint").alias("shared"))


@register("s04_snapshot_diff", sql="""
WITH o AS (SELECT path AS old_path, content_hash AS old_hash FROM v_old),
n AS (SELECT path AS new_path, content_hash AS new_hash FROM v_new),
j AS (SELECT * FROM o FULL OUTER JOIN n ON o.old_path = n.new_path),
added AS (SELECT new_path, new_hash FROM j WHERE old_path IS NULL),
deleted AS (SELECT old_path, old_hash FROM j WHERE new_path IS NULL),
dk AS (SELECT *, row_number() OVER (PARTITION BY old_hash ORDER BY old_path) AS k FROM deleted),
ak AS (SELECT *, row_number() OVER (PARTITION BY new_hash ORDER BY new_path) AS k FROM added),
ren AS (SELECT dk.old_path, ak.new_path FROM dk JOIN ak ON dk.old_hash = ak.new_hash AND dk.k = ak.k)
SELECT 'A' AS change, NULL::VARCHAR AS old_path, new_path FROM added WHERE new_path NOT IN (SELECT new_path FROM ren)
UNION ALL SELECT 'D', old_path, NULL FROM deleted WHERE old_path NOT IN (SELECT old_path FROM ren)
UNION ALL SELECT 'M', old_path, new_path FROM j WHERE old_path IS NOT NULL AND new_path IS NOT NULL AND old_hash <> new_hash
UNION ALL SELECT 'R', old_path, new_path FROM ren""")
def s04_snapshot_diff(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    return R.snapshot_diff(probes.v_old(t), probes.v_new(t)).select("change", "old_path", "new_path")


PROJECTS_SQL = """(SELECT CAST(row_number() OVER (ORDER BY repository, language) AS BIGINT) AS id,
   repository || '/' || language || '/App.csproj' AS project_path FROM (SELECT DISTINCT repository, language FROM v_files)
 UNION ALL
 SELECT CAST(100000 + row_number() OVER (ORDER BY repository, language) AS BIGINT),
   repository || '/' || language || '/d3/Sub.csproj' FROM (SELECT DISTINCT repository, language FROM v_files WHERE id % 7 = 3))"""


def _projects(t):
    from pyspark.sql import Window
    f = probes.v_files(t)
    # one project per (repository, language): a small set by nature
    top = (f.select("repository", "language").distinct()
           .select(F.row_number().over(Window.orderBy("repository", "language")).cast("bigint").alias("id"),
                   F.concat_ws("/", "repository", "language", F.lit("App.csproj")).alias("project_path")))
    sub = (f.where(F.col("id") % 7 == 3).select("repository", "language").distinct()
           .select((F.lit(100000) + F.row_number().over(Window.orderBy("repository", "language"))).cast("bigint").alias("id"),
                   F.concat_ws("/", "repository", "language", F.lit("d3"), F.lit("Sub.csproj")).alias("project_path")))
    return top.unionByName(sub)


@register("j18_assign_files_to_projects", sql=f"""
WITH p AS (SELECT id AS project_id, regexp_replace(project_path, '/[^/]*$', '') AS dir FROM {PROJECTS_SQL}),
anc AS (SELECT f.id, f.path, k AS depth, array_to_string(string_split(f.path, '/')[1:k], '/') AS dir
        FROM v_files f, unnest(generate_series(1, greatest(len(string_split(f.path, '/')) - 1, 1))) AS g(k)
        WHERE len(string_split(f.path, '/')) > 1),
best AS (SELECT a.id, arg_max(p.project_id, (a.depth, -p.project_id)) AS project_id FROM anc a JOIN p USING (dir) GROUP BY a.id)
SELECT f.id, f.path, best.project_id FROM v_files f LEFT JOIN best USING (id)""")
def j18_assign_files_to_projects(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    return R.assign_files_to_projects(probes.v_files(t), _projects(t))
