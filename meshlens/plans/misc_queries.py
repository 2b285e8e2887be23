"""Registered queries T-03, A-25, A-30, P-10, J-33, SRC-01."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlens.operators import calls as CALLS
from meshlens.operators import aggregates as A
from meshlens.operators import extract as E
from meshlens.operators import relational as R
from meshlens.operators.dealing import dealt_join
from meshlens.plans.catalog import register
from meshlens.plans.lifecycle_queries import pattern_probe
from meshlens.plans.relational_queries import PROJECTS_SQL, _projects
from meshlens.plans.text_queries import sq
from meshlens.sources import probes
from meshlens.sources.tables import load_tables, scan_corpus


def _t(spark, sf_dir):
    return load_tables(spark, sf_dir)


def _ord_sql(col: str, values) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{v}' THEN {i + 1}" for i, v in enumerate(values)) + " END"


@register("t03_module_symbols", sql=f"""
WITH f AS (SELECT id AS file_id, repository, array_to_string(string_split(path, '/')[1:k], '/') AS module
           FROM v_files, unnest(generate_series(1, greatest(len(string_split(path, '/')) - 1, 1))) AS g(k)),
s AS (SELECT id, name, kind, access, file_id FROM v_symbols WHERE kind IN ('CLASS', 'FUNCTION', 'METHOD', 'INTERFACE')),
r AS (SELECT f.repository, f.module, s.id, s.name, s.kind, s.access,
             row_number() OVER (PARTITION BY f.repository, f.module ORDER BY {_ord_sql('s.access', A.ACCESS_ORDER)} NULLS LAST,
                                {_ord_sql('s.kind', A.KIND_ORDER)} NULLS LAST, s.name, s.id) AS rank
      FROM f JOIN s USING (file_id))
SELECT repository, module, CAST(rank AS INTEGER) AS rank, id, name, kind, access FROM r WHERE rank <= 50""")
def t03_module_symbols(spark, sf_dir):
    t = _t(spark, sf_dir)
    out = A.module_symbols(probes.v_files(t), probes.v_symbols(t))
    return out.withColumn("rank", F.col("rank").cast("int"))


@register("a25_unique_external_calls", sql="""
SELECT repository, http_method, url_pattern, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY repository ORDER BY http_method, url_pattern) AS rank FROM (
    SELECT DISTINCT repository, http_method, path AS url_pattern FROM v_calls)) WHERE rank <= 10""")
def a25_unique_external_calls(spark, sf_dir):
    c = probes.v_calls(_t(spark, sf_dir)).select("repository", "http_method", F.col("path").alias("url_pattern"))
    return A.unique_external_calls(c).withColumn("rank", F.col("rank").cast("int"))


@register("a30_service_controllers", sql="""
WITH cls AS (SELECT DISTINCT CAST(1000000000000 + b AS BIGINT) AS id, 'Brand' || CAST(b AS VARCHAR) || CASE b % 6
               WHEN 0 THEN 'Factory' WHEN 1 THEN 'Repository' WHEN 2 THEN 'Builder' WHEN 3 THEN 'Singleton'
               WHEN 4 THEN 'Controller' ELSE 'EventHandler' END AS name, b FROM (
             SELECT CAST(split_part(p_brand, '#', 2) AS INTEGER) AS b FROM part))
SELECT CAST(b % 3 AS BIGINT) AS service_id, id AS controller_id, name AS controller_name FROM cls WHERE ends_with(name, 'Controller')""")
def a30_service_controllers(spark, sf_dir):
    """A-30: controllers (name suffix) of each service (probe: service = brand mod 3)."""
    classes, _ = pattern_probe(_t(spark, sf_dir))
    return (classes.where(F.col("name").endswith("Controller"))
            .select(((F.col("id") - 1_000_000_000_000) % 3).alias("service_id"), F.col("id").alias("controller_id"),
                    F.col("name").alias("controller_name")))


@register("p10_library_services", sql=f"""
WITH pr AS (SELECT id, project_path AS name, CASE WHEN id % 2 = 1 THEN 'Library' ELSE 'Exe' END AS output_type
            FROM {PROJECTS_SQL}),
p AS (SELECT id AS project_id, regexp_replace(name, '/[^/]*$', '') AS dir FROM pr),
anc AS (SELECT f.id, k AS depth, array_to_string(string_split(f.path, '/')[1:k], '/') AS dir
        FROM v_files f, unnest(generate_series(1, greatest(len(string_split(f.path, '/')) - 1, 1))) AS g(k)
        WHERE len(string_split(f.path, '/')) > 1),
fp AS (SELECT a.id AS file_id, arg_max(p.project_id, (a.depth, -p.project_id)) AS project_id FROM anc a JOIN p USING (dir)
       GROUP BY a.id),
cnt AS (SELECT fp.project_id, count(*) AS symbol_count FROM v_symbols s JOIN fp ON fp.file_id = s.file_id GROUP BY 1)
SELECT pr.id, pr.name, cnt.symbol_count, CAST(10 + cnt.symbol_count // 10 AS BIGINT) AS score, 'Library' AS service_type,
       CASE WHEN contains(lower(pr.name), 'domain') THEN 'Domain layer detected'
            WHEN contains(lower(pr.name), 'application') THEN 'Application layer detected'
            WHEN contains(lower(pr.name), 'infrastructure') OR contains(lower(pr.name), 'persistence') THEN 'Infrastructure layer detected'
            WHEN contains(lower(pr.name), 'shared') OR contains(lower(pr.name), 'common') THEN 'Shared library detected'
            WHEN contains(lower(pr.name), 'core') THEN 'Core library detected' END AS layer_reason
FROM pr JOIN cnt ON cnt.project_id = pr.id WHERE lower(pr.output_type) = 'library' AND cnt.symbol_count >= 10""")
def p10_library_services(spark, sf_dir):
    t = _t(spark, sf_dir)
    projects = _projects(t).select("id", F.col("project_path").alias("name"),
                                   F.when(F.col("id") % 2 == 1, "Library").otherwise("Exe").alias("output_type"))
    fp = R.assign_files_to_projects(probes.v_files(t), _projects(t)).select(F.col("id").alias("file_id"), "project_id")
    sp = probes.v_symbols(t).join(fp, "file_id", "left").select("id", "project_id")
    return A.library_services(projects, sp)


@register("j33_handler_for_subscription", sql=f"""
WITH l AS (SELECT id, CAST(generate_subscripts(string_split(content, chr(10)), 1) AS BIGINT) AS line_no,
                  unnest(string_split(content, chr(10))) AS line FROM v_code WHERE language = 'csharp'),
subs AS (SELECT id, line_no, unnest(regexp_extract_all(line, {sq(CALLS.EVENT_RULES[-1].regex)}, 1)) AS event_type_name FROM l),
cls AS (SELECT id, line_no, unnest(regexp_extract_all(line, {sq(E.SYMBOL_RULES['csharp'][1])}, 1)) AS class_name FROM l)
SELECT s.id, s.line_no, s.event_type_name,
       (SELECT arg_max(c.class_name, c.line_no) FROM cls c WHERE c.id = s.id AND c.line_no <= s.line_no) AS handler_class
FROM subs s""")
def j33_handler_for_subscription(spark, sf_dir):
    """J-33: each ``IConsumer<T>`` subscription → the class declared at or
    before its line in the same file (null when none): a running "last class"
    window over the file's lines (W-05)."""
    from pyspark.sql import Window
    code = probes.v_code(_t(spark, sf_dir)).where(F.col("language") == "csharp")
    lines = E.numbered_lines(code, "id", "content").withColumn("line_no", F.col("line_no").cast("bigint"))
    cls = F.try_element_at(F.regexp_extract_all("line", F.lit(E.SYMBOL_RULES["csharp"][1]), 1), F.lit(-1))
    w = Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("handler_class", F.last(cls, ignorenulls=True).over(w))
    subs = lines.select("id", "line_no", "handler_class",
                        F.explode(F.regexp_extract_all("line", F.lit(CALLS.EVENT_RULES[-1].regex), 1)).alias("event_type_name"))
    return subs.select("id", "line_no", "event_type_name", "handler_class")


@register("src01_scan_corpus")
def src01_scan_corpus(spark, sf_dir):
    """SRC-01: the snapshot directory listed as files (parquet only) with sizes."""
    return scan_corpus(spark, sf_dir, "*.parquet").select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"), "size")


SERVICES_SQL = """(SELECT s_suppkey AS id,
  CASE s_suppkey % 4 WHEN 0 THEN 'API' WHEN 1 THEN 'Worker' WHEN 2 THEN 'Library' ELSE 'Console' END AS service_type,
  'Org' || CAST(s_suppkey % 5 AS VARCHAR) || '.' || CASE s_suppkey % 4 WHEN 0 THEN 'Api' WHEN 1 THEN 'Jobs'
     WHEN 2 THEN CASE s_suppkey % 3 WHEN 0 THEN 'Domain' WHEN 1 THEN 'Shared.Utils' ELSE 'Infrastructure' END ELSE 'Cli' END
     || CAST(s_suppkey AS VARCHAR) AS name FROM supplier)"""


def _services(t):
    s = t.supplier
    k = F.col("s_suppkey")
    stype = F.when(k % 4 == 0, "API").when(k % 4 == 1, "Worker").when(k % 4 == 2, "Library").otherwise("Console")
    part = (F.when(k % 4 == 0, "Api").when(k % 4 == 1, "Jobs")
            .when(k % 4 == 2, F.when(k % 3 == 0, "Domain").when(k % 3 == 1, "Shared.Utils").otherwise("Infrastructure"))
            .otherwise("Cli"))
    return s.select(k.alias("id"), stype.alias("service_type"),
                    F.concat(F.lit("Org"), (k % 5).cast("string"), F.lit("."), part, k.cast("string")).alias("name"))


@register("a32_project_structure", sql=f"""
WITH s AS {SERVICES_SQL},
dep AS (SELECT regexp_extract(name, '^(.*)\\.[^.]*$', 1) AS prefix, id, name, service_type FROM s
        WHERE service_type IN ('API', 'Worker', 'Console') AND contains(name, '.')),
libs AS (SELECT id, name, service_type FROM s WHERE service_type = 'Library'),
lp AS (SELECT id, name, service_type, array_to_string(string_split(name, '.')[1:k], '.') AS prefix
       FROM libs, unnest(generate_series(1, len(string_split(name, '.')) - 1)) AS g(k) WHERE len(string_split(name, '.')) > 1),
claimed AS (SELECT * FROM lp WHERE prefix IN (SELECT prefix FROM dep)),
allr AS (SELECT prefix, id, name, service_type FROM dep
         UNION ALL SELECT prefix, id, name, service_type FROM claimed
         UNION ALL SELECT NULL, id, name, service_type FROM libs WHERE id NOT IN (SELECT id FROM claimed))
SELECT *, CASE WHEN service_type <> 'Library' THEN NULL
               WHEN contains(lower(name), 'domain') THEN 'Domain' WHEN contains(lower(name), 'application') THEN 'Application'
               WHEN contains(lower(name), 'infrastructure') THEN 'Infrastructure'
               WHEN contains(lower(name), 'shared') OR contains(lower(name), 'common') THEN 'Shared' ELSE 'Library' END AS layer
FROM allr""")
def a32_project_structure(spark, sf_dir):
    return A.project_structure(_services(_t(spark, sf_dir)))


@register("j32_service_bundle", sql=f"""
WITH s AS {SERVICES_SQL},
sv AS (SELECT id AS service_id, id % 25 AS b, id % 10 AS repo FROM s),
cls AS (SELECT DISTINCT CAST(split_part(p_brand, '#', 2) AS INTEGER) AS b, p_brand FROM part),
ctrl AS (SELECT b, p_brand, 'Brand' || CAST(b AS VARCHAR) || 'Controller' AS name FROM cls WHERE b % 6 = 4),
meth AS (SELECT c.b, CASE WHEN split_part(p.p_name, ' ', 2) = 'anvil' THEN c.name ELSE split_part(p.p_name, ' ', 1) || '_' || split_part(p.p_name, ' ', 2) END AS name
         FROM ctrl c JOIN part p ON p.p_brand = c.p_brand WHERE p.p_partkey % 3 <> 2),
deps AS (SELECT DISTINCT CAST(split_part(p_brand, '#', 2) AS INTEGER) AS b, replace(p_name, ' ', '-') AS name FROM part),
ev AS (SELECT DISTINCT repo, event_type FROM v_pub)
SELECT sv.service_id, 'controller' AS item_kind, c.name AS item FROM sv JOIN ctrl c USING (b)
UNION ALL SELECT sv.service_id, 'method', m.name FROM sv JOIN meth m USING (b)
UNION ALL SELECT sv.service_id, 'dependency', d.name FROM sv JOIN deps d USING (b)
UNION ALL SELECT sv.service_id, 'published_event', ev.event_type FROM sv JOIN ev USING (repo)""")
def j32_service_bundle(spark, sf_dir):
    """J-32 in long form: per service (probe: supplier services; service s owns
    brand s mod 25 and repository s mod 10) its controller classes, their
    methods, its package dependencies and its published event types — each
    list is an equi-join on the service's key, no per-service arrays; the joins
    of many services with many rows of a brand are dealt over tasks by pairs."""
    t = _t(spark, sf_dir)
    sv = _services(t).select(F.col("id").alias("service_id"), (F.col("id") % 25).alias("b"),
                             (F.col("id") % 10).alias("repo"))
    p = t.part.withColumn("b", F.substring_index("p_brand", "#", -1).cast("int").cast("long"))
    ctrl = (p.select("b", "p_brand").distinct().where(F.col("b") % 6 == 4)
            .withColumn("name", F.concat(F.lit("Brand"), F.col("b").cast("string"), F.lit("Controller"))))
    first = F.substring_index("p_name", " ", 1)
    second = F.substring_index("p_name", " ", -1)
    meth = (ctrl.select("b", "p_brand", F.col("name").alias("cname"))
            .join(p.where(F.col("p_partkey") % 3 != 2).select("p_brand", "p_name", "p_partkey"), "p_brand")
            .select("b", "p_partkey", F.when(second == "anvil", F.col("cname")).otherwise(F.concat(first, F.lit("_"), second)).alias("name")))
    deps = p.select("b", F.regexp_replace("p_name", " ", "-").alias("name")).distinct()
    ev = probes.v_pub(t).select("repo", "event_type").distinct()
    return (sv.join(ctrl, "b").select("service_id", F.lit("controller").alias("item_kind"), F.col("name").alias("item"))
            .unionByName(dealt_join(sv, meth, "b", "service_id", "p_partkey").select(
                "service_id", F.lit("method").alias("item_kind"), F.col("name").alias("item")))
            .unionByName(dealt_join(sv, deps, "b", "service_id", "name").select(
                "service_id", F.lit("dependency").alias("item_kind"), F.col("name").alias("item")))
            .unionByName(sv.join(ev, "repo").select("service_id", F.lit("published_event").alias("item_kind"),
                                                   F.col("event_type").alias("item"))))


from meshlens.sources.tables import TABLE_NAMES  # noqa: E402


@register("src02_load_tables", sql=" UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in TABLE_NAMES))
def src02_load_tables(spark, sf_dir):
    """SRC-02: every entity table of the snapshot, loaded lazily, with its row
    count (a count reads only parquet row-group metadata)."""
    t = _t(spark, sf_dir)
    out = None
    for n in TABLE_NAMES:
        c = getattr(t, n).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
        out = c if out is None else out.unionByName(c)
    return out
