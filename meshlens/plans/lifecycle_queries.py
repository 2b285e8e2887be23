"""Registered pattern-detection (§2.13) and job-lifecycle (§2.14) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlens.operators import patterns as P
from meshlens.plans.catalog import register
from meshlens.sources import probes
from meshlens.sources.tables import load_tables

# Fixed values of the pattern probe: part names become code-like member names
# (first word → verb), brands become classes with a role suffix.
VERB_BY_WORD = {"blue": "Get", "cold": "Create", "hot": "Add", "large": "Update", "new": "Delete",
                "old": "Find", "red": "Build", "small": "Instance"}
SUFFIXES = ("Factory", "Repository", "Builder", "Singleton", "Controller", "EventHandler")
ASOF = "1998-08-01 00:00:00"


def _t(spark, sf_dir):
    return load_tables(spark, sf_dir)


def _class_name(b: F.Column) -> F.Column:
    expr = None
    for i, s in enumerate(SUFFIXES):
        c = F.when(b % len(SUFFIXES) == i, F.lit(s))
        expr = c if expr is None else expr.when(b % len(SUFFIXES) == i, F.lit(s))
    return F.concat(F.lit("Brand"), b.cast("string"), expr)


def pattern_probe(t):
    """(classes, members): brand classes and their part members."""
    p = t.part
    b = F.substring_index("p_brand", "#", -1).cast("int")
    classes = (p.select("p_brand").distinct().withColumn("b", b)
               .select((F.lit(1_000_000_000_000) + F.col("b")).cast("bigint").alias("id"),
                       _class_name(F.col("b")).alias("name"), F.col("p_brand").alias("fqn"),
                       F.lit("CLASS").alias("kind")))
    first = F.substring_index("p_name", " ", 1)
    second = F.substring_index("p_name", " ", -1)
    verb = None
    for w, v in VERB_BY_WORD.items():
        verb = F.when(first == w, F.lit(v)) if verb is None else verb.when(first == w, F.lit(v))
    cname = _class_name(b)
    name = (F.when(second == "anvil", cname)
            .when((first == "red") & (F.col("p_size") % 4 == 0), F.lit("Build"))
            .otherwise(F.concat(verb, F.initcap(second))))
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, "METHOD").when(k % 3 == 1, "FUNCTION").otherwise("VARIABLE")
    access = F.when(k % 4 == 0, "PUBLIC").when(k % 4 == 1, "PRIVATE").when(k % 4 == 2, "PROTECTED")
    members = p.select(k.alias("id"), name.alias("name"), kind.alias("kind"), access.alias("access"),
                       F.col("p_brand").alias("parent_name"),
                       F.when(F.col("p_size") % 3 == 0, cname).otherwise(F.lit("void")).alias("return_type"))
    # methods of the first kind are the bulk: keep kinds METHOD for pattern members
    members = members.withColumn("kind", F.when(F.col("kind") == "FUNCTION", F.lit("METHOD")).otherwise(F.col("kind")))
    return classes, members


def _cname_sql(b: str) -> str:
    cases = " ".join(f"WHEN {b} % {len(SUFFIXES)} = {i} THEN '{s}'" for i, s in enumerate(SUFFIXES))
    return f"('Brand' || CAST({b} AS VARCHAR) || CASE {cases} END)"


_VERB_SQL = "CASE " + " ".join(f"WHEN split_part(p_name, ' ', 1) = '{w}' THEN '{v}'"
                               for w, v in VERB_BY_WORD.items()) + " END"
_B = "CAST(split_part(p_brand, '#', 2) AS INTEGER)"

PROBE_SQL = f"""
cls AS (SELECT DISTINCT CAST(1000000000000 + {_B} AS BIGINT) AS id, {_cname_sql(_B)} AS name, p_brand AS fqn,
               'CLASS' AS kind FROM part),
mem AS (SELECT p_partkey AS id,
          CASE WHEN split_part(p_name, ' ', 2) = 'anvil' THEN {_cname_sql(_B)}
               WHEN split_part(p_name, ' ', 1) = 'red' AND p_size % 4 = 0 THEN 'Build'
               ELSE {_VERB_SQL} || upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) END AS name,
          CASE WHEN p_partkey % 3 = 2 THEN 'VARIABLE' ELSE 'METHOD' END AS kind,
          CASE p_partkey % 4 WHEN 0 THEN 'PUBLIC' WHEN 1 THEN 'PRIVATE' WHEN 2 THEN 'PROTECTED' END AS access,
          p_brand AS parent_name,
          CASE WHEN p_size % 3 = 0 THEN {_cname_sql(_B)} ELSE 'void' END AS return_type FROM part),
j AS (SELECT c.id AS class_id, c.name AS class_name, c.kind AS class_kind, m.name AS m_name, m.kind AS m_kind,
             m.access AS m_access, m.return_type AS m_return
      FROM cls c LEFT JOIN mem m ON m.parent_name = c.fqn)"""

SINGLETON_SQL = f"""WITH {PROBE_SQL},
g AS (SELECT class_id, class_name,
        max(CASE WHEN m_kind = 'VARIABLE' AND m_access = 'PRIVATE' AND contains(lower(m_name), 'instance') THEN 1 ELSE 0 END) AS f1,
        max(CASE WHEN m_kind = 'METHOD' AND m_name = class_name AND m_access = 'PRIVATE' THEN 1 ELSE 0 END) AS f2,
        max(CASE WHEN m_kind = 'METHOD' AND (contains(lower(m_name), 'getinstance') OR contains(lower(m_name), 'instance'))
                 AND m_access = 'PUBLIC' THEN 1 ELSE 0 END) AS f3
      FROM j WHERE class_kind = 'CLASS' GROUP BY ALL)
SELECT class_id, class_name, 'Singleton' AS pattern, round((f1 + f2 + f3) / 3.0, 4) AS confidence
FROM g WHERE f1 + f2 + f3 >= 2"""

FACTORY_SQL = f"""WITH {PROBE_SQL}
SELECT class_id, class_name, 'Factory' AS pattern, CAST(0.8 AS DOUBLE) AS confidence FROM j
WHERE class_kind = 'CLASS' AND contains(lower(class_name), 'factory') GROUP BY ALL
HAVING max(CASE WHEN m_kind = 'METHOD' AND (contains(lower(m_name), 'create') OR contains(lower(m_name), 'make')
           OR contains(lower(m_name), 'build') OR contains(lower(m_name), 'get')) THEN 1 ELSE 0 END) = 1"""

REPOSITORY_SQL = f"""WITH {PROBE_SQL},
g AS (SELECT class_id, class_name, """ + " + ".join(
    f"max(CASE WHEN m_kind = 'METHOD' AND contains(lower(m_name), '{w}') THEN 1 ELSE 0 END)" for w in P.CRUD_WORDS) + \
    """ AS n FROM j WHERE class_kind IN ('CLASS', 'INTERFACE') AND contains(lower(class_name), 'repository') GROUP BY ALL)
SELECT class_id, class_name, 'Repository' AS pattern, round(n / 5.0, 4) AS confidence FROM g WHERE n >= 3"""

BUILDER_SQL = f"""WITH {PROBE_SQL},
g AS (SELECT class_id, class_name,
        max(CASE WHEN m_kind = 'METHOD' AND lower(m_name) = 'build' THEN 1 ELSE 0 END) AS has_build,
        sum(CASE WHEN m_kind = 'METHOD' AND m_return IS NOT NULL AND contains(m_return, class_name) THEN 1 ELSE 0 END) AS fluent
      FROM j WHERE class_kind = 'CLASS' AND contains(lower(class_name), 'builder') GROUP BY ALL)
SELECT class_id, class_name, 'Builder' AS pattern, CAST(round(least(0.9, 0.5 + fluent * 0.1), 4) AS DOUBLE) AS confidence
FROM g WHERE has_build = 1 AND fluent > 0"""

OBSERVER_SQL = f"""WITH {PROBE_SQL}
SELECT id AS class_id, name AS class_name, 'Observer' AS pattern, CAST(0.7 AS DOUBLE) AS confidence FROM cls
WHERE kind = 'CLASS' AND (contains(name, 'Observer') OR contains(name, 'Event') OR contains(name, 'Listener')
      OR contains(name, 'Handler'))"""


@register("p01_singleton", sql=SINGLETON_SQL)
def p01_singleton(spark, sf_dir):
    return P.singleton(*pattern_probe(_t(spark, sf_dir)))


@register("p02_factory", sql=FACTORY_SQL)
def p02_factory(spark, sf_dir):
    return P.factory(*pattern_probe(_t(spark, sf_dir)))


@register("p03_repository", sql=REPOSITORY_SQL)
def p03_repository(spark, sf_dir):
    return P.repository(*pattern_probe(_t(spark, sf_dir)))


@register("p04_builder", sql=BUILDER_SQL)
def p04_builder(spark, sf_dir):
    return P.builder(*pattern_probe(_t(spark, sf_dir)))


@register("p05_observer", sql=OBSERVER_SQL)
def p05_observer(spark, sf_dir):
    classes, _ = pattern_probe(_t(spark, sf_dir))
    return P.observer(classes)


@register("p06_layer_counts", sql=f"""WITH {PROBE_SQL},
cr AS (SELECT c.*, f.repository FROM cls c JOIN v_files f ON f.id = (c.id - 1000000000000) % (SELECT count(*) FROM documents))
SELECT repository, count(*) FILTER (WHERE kind = 'CLASS' AND contains(lower(name), 'controller')) AS controllers,
       count(*) FILTER (WHERE kind = 'CLASS' AND contains(lower(name), 'service')) AS services,
       count(*) FILTER (WHERE kind IN ('CLASS', 'INTERFACE') AND contains(lower(name), 'repository')) AS repositories
FROM cr GROUP BY repository""")
def p06_layer_counts(spark, sf_dir):
    t = _t(spark, sf_dir)
    classes, _ = pattern_probe(t)
    n_docs = t.documents.select(F.count(F.lit(1))).scalar()
    files = probes.v_files(t).select(F.col("id").alias("fid"), "repository")
    cr = classes.withColumn("fid", (F.col("id") - 1_000_000_000_000) % n_docs).join(files, "fid")
    return P.layer_counts(cr)


@register("p07_long_methods", sql="""
SELECT id, name, end_line - start_line AS lines, complexity FROM v_symbols
WHERE kind IN ('METHOD', 'FUNCTION') AND (end_line - start_line > 50 OR complexity > 15)""")
def p07_long_methods(spark, sf_dir):
    return P.long_methods(probes.v_symbols(_t(spark, sf_dir)))


@register("p08_architecture_styles", sql="""
SELECT repository, max(CASE WHEN contains(lower(path), 'controller') THEN 1 ELSE 0 END) = 1
                   AND max(CASE WHEN contains(lower(path), 'model') THEN 1 ELSE 0 END) = 1 AS mvc,
       (max(CASE WHEN contains(lower(path), '/domain/') OR starts_with(lower(path), 'domain/') THEN 1 ELSE 0 END)
      + max(CASE WHEN contains(lower(path), '/application/') OR starts_with(lower(path), 'application/') THEN 1 ELSE 0 END)
      + max(CASE WHEN contains(lower(path), '/infrastructure/') OR starts_with(lower(path), 'infrastructure/') THEN 1 ELSE 0 END)
      + max(CASE WHEN contains(lower(path), '/presentation/') OR starts_with(lower(path), 'presentation/') THEN 1 ELSE 0 END)) >= 3
       AS clean_architecture
FROM v_tree GROUP BY repository""")
def p08_architecture_styles(spark, sf_dir):
    return P.architecture_styles(probes.v_tree(_t(spark, sf_dir)))


@register("p11_pattern_report", sql=f"""
SELECT pattern, count(*) AS n, CAST(round(sum(confidence), 4) AS DOUBLE) AS total_confidence FROM (
  SELECT * FROM ({SINGLETON_SQL}) UNION ALL SELECT * FROM ({FACTORY_SQL}) UNION ALL SELECT * FROM ({REPOSITORY_SQL})
  UNION ALL SELECT * FROM ({BUILDER_SQL}) UNION ALL SELECT * FROM ({OBSERVER_SQL})) GROUP BY pattern""")
def p11_pattern_report(spark, sf_dir):
    classes, members = pattern_probe(_t(spark, sf_dir))
    return P.pattern_report(P.singleton(classes, members), P.factory(classes, members),
                            P.repository(classes, members), P.builder(classes, members), P.observer(classes))


# ----------------------------------------------------------------------------- L-*

@register("l01_jobs_by_status", sql="""
SELECT s.status, coalesce(g.n, 0) AS n FROM (VALUES ('PENDING'), ('RUNNING'), ('COMPLETED'), ('FAILED'),
  ('CANCELLED'), ('RETRYING')) AS s(status) LEFT JOIN (SELECT status, count(*) AS n FROM v_jobs GROUP BY status) g
  USING (status)
UNION ALL SELECT 'TOTAL', count(*) FROM v_jobs""")
def l01_jobs_by_status(spark, sf_dir):
    return P.jobs_by_status(probes.v_jobs(_t(spark, sf_dir)), spark)


@register("l02_stuck_jobs", sql=f"""
SELECT id, started_at FROM v_jobs WHERE status = 'RUNNING' AND started_at < TIMESTAMP '{ASOF}' - INTERVAL 60 MINUTE""")
def l02_stuck_jobs(spark, sf_dir):
    return P.stuck_jobs(probes.v_jobs(_t(spark, sf_dir)), ASOF).select("id", "started_at")


@register("l03_pending_queue", sql="""
SELECT id, started_at FROM v_jobs WHERE status = 'PENDING' ORDER BY started_at, id LIMIT 100""")
def l03_pending_queue(spark, sf_dir):
    j = probes.v_jobs(_t(spark, sf_dir))
    return j.where(F.col("status") == "PENDING").orderBy("started_at", "id").limit(100).select("id", "started_at")


@register("l03_recent_failures", sql="""
SELECT id, updated_at FROM v_jobs WHERE status = 'FAILED' ORDER BY updated_at DESC, id DESC LIMIT 100""")
def l03_recent_failures(spark, sf_dir):
    j = probes.v_jobs(_t(spark, sf_dir))
    return (j.where(F.col("status") == "FAILED").orderBy(F.col("updated_at").desc(), F.col("id").desc())
            .limit(100).select("id", "updated_at"))


@register("l04_retention", sql=f"""
SELECT id, status FROM v_jobs
WHERE NOT coalesce(status IN ('COMPLETED', 'FAILED', 'CANCELLED') AND updated_at < TIMESTAMP '{ASOF}' - INTERVAL 30 DAY, false)""")
def l04_retention(spark, sf_dir):
    return P.retention(probes.v_jobs(_t(spark, sf_dir)), ASOF).select("id", "status")


@register("l05_retry_eligible", sql="""
SELECT id, retry_count FROM v_jobs WHERE status = 'FAILED' AND retry_count < max_retries""")
def l05_retry_eligible(spark, sf_dir):
    return P.retry_eligible(probes.v_jobs(_t(spark, sf_dir))).select("id", "retry_count")


@register("l06_close_interrupted", sql=f"""
SELECT id, repository_id, CASE WHEN status = 'RUNNING' THEN 'FAILED' ELSE status END AS status,
       CASE WHEN status = 'RUNNING' THEN date_diff('second', started_at, TIMESTAMP '{ASOF}') END AS duration_seconds,
       CASE WHEN status = 'RUNNING' THEN 'Job interrupted' END AS error_message
FROM v_jobs""")
def l06_close_interrupted(spark, sf_dir):
    return P.close_interrupted(probes.v_jobs(_t(spark, sf_dir)), ASOF)


@register("l07_progress_pct", sql="""
SELECT id, CASE WHEN max_retries > 0 THEN round(retry_count * 100.0 / max_retries, 2) ELSE 0.0 END AS progress
FROM v_jobs""")
def l07_progress_pct(spark, sf_dir):
    j = probes.v_jobs(_t(spark, sf_dir))
    return j.select("id", P.progress_pct(F.col("retry_count"), F.col("max_retries")).alias("progress"))


@register("l08_sync_history", sql="""
SELECT repository_id, id, CAST(rank AS INTEGER) AS rank FROM (
  SELECT repository_id, id, row_number() OVER (PARTITION BY repository_id ORDER BY started_at DESC, id DESC) AS rank
  FROM v_jobs) WHERE rank <= 10""")
def l08_sync_history(spark, sf_dir):
    return P.history_page(probes.v_jobs(_t(spark, sf_dir)), "repository_id").select("repository_id", "id", "rank")


# ----------------------------------------------------------------------------- P-09

SERVICE_PROJECTS_SQL = """(SELECT s_suppkey AS id,
  'Svc' || CAST(s_suppkey AS VARCHAR) || CASE s_suppkey % 5 WHEN 0 THEN '.API' WHEN 1 THEN '.Service' WHEN 2 THEN '.Console'
       WHEN 3 THEN '.Web' ELSE '' END AS name,
  '<Project Sdk="' || CASE s_suppkey % 3 WHEN 0 THEN 'Microsoft.NET.Sdk.Web' WHEN 1 THEN 'Microsoft.NET.Sdk.Worker'
       ELSE 'Microsoft.NET.Sdk' END || '">' || CASE WHEN s_suppkey % 4 = 0 THEN '<OutputType>Exe</OutputType>' ELSE '' END
       || CASE WHEN s_suppkey % 2 = 0 THEN '<PackageReference Include="Microsoft.AspNetCore.App" />' ELSE '' END
       || '</Project>' AS project_xml,
  CASE s_suppkey % 7 WHEN 0 THEN 'var b = WebApplication.CreateBuilder(args); builder.Services.AddScoped<X>();'
       WHEN 1 THEN 'services.AddMediatR(); services.AddMassTransit();' WHEN 2 THEN 'Host.CreateDefaultBuilder(args)'
       ELSE NULL END AS startup FROM supplier)"""


def _service_projects(t):
    s = t.supplier
    k = F.col("s_suppkey")
    suffix = (F.when(k % 5 == 0, ".API").when(k % 5 == 1, ".Service").when(k % 5 == 2, ".Console")
              .when(k % 5 == 3, ".Web").otherwise(""))
    sdk = F.when(k % 3 == 0, "Microsoft.NET.Sdk.Web").when(k % 3 == 1, "Microsoft.NET.Sdk.Worker").otherwise("Microsoft.NET.Sdk")
    xml = F.concat(F.lit('<Project Sdk="'), sdk, F.lit('">'),
                   F.when(k % 4 == 0, "<OutputType>Exe</OutputType>").otherwise(""),
                   F.when(k % 2 == 0, '<PackageReference Include="Microsoft.AspNetCore.App" />').otherwise(""),
                   F.lit("</Project>"))
    startup = (F.when(k % 7 == 0, "var b = WebApplication.CreateBuilder(args); builder.Services.AddScoped<X>();")
               .when(k % 7 == 1, "services.AddMediatR(); services.AddMassTransit();")
               .when(k % 7 == 2, "Host.CreateDefaultBuilder(args)"))
    return s.select(k.alias("id"), F.concat(F.lit("Svc"), k.cast("string"), suffix).alias("name"),
                    xml.alias("project_xml"), startup.alias("startup"))


@register("p09_service_boundaries", sql=f"""
WITH p AS {SERVICE_PROJECTS_SQL},
cls AS (SELECT DISTINCT CAST(split_part(p_brand, '#', 2) AS INTEGER) AS b FROM part),
ctrl AS (SELECT b AS project_id, count(*) AS n FROM cls WHERE b % 6 = 4 GROUP BY b),
f AS (SELECT p.*, coalesce(project_xml, '') AS px, coalesce(startup, '') AS st, coalesce(ctrl.n, 0) > 0 AS has_ctrl
      FROM p LEFT JOIN ctrl ON ctrl.project_id = p.id),
g AS (SELECT *, contains(px, 'Sdk="Microsoft.NET.Sdk.Web"') AS web, contains(px, 'Sdk="Microsoft.NET.Sdk.Worker"') AS worker,
             contains(px, 'Microsoft.AspNetCore') AS asp,
             contains(st, 'CreateBuilder') OR contains(st, 'CreateDefaultBuilder') OR contains(st, 'CreateApplicationBuilder') AS host
      FROM f),
s AS (SELECT *, (CASE WHEN web THEN 50 ELSE 0 END) + (CASE WHEN worker THEN 50 ELSE 0 END)
        + (CASE WHEN contains(px, '<OutputType>Exe</OutputType>') OR web OR worker THEN 20 ELSE 0 END)
        + (CASE WHEN asp THEN 20 ELSE 0 END) + (CASE WHEN has_ctrl THEN 100 ELSE 0 END)
        + (CASE WHEN contains(st, 'services.Add') OR contains(st, 'builder.Services.Add') THEN 50 ELSE 0 END)
        + (CASE WHEN contains(st, 'AddMediatR') THEN 30 ELSE 0 END)
        + (CASE WHEN contains(st, 'AddMassTransit') OR contains(st, 'AddNServiceBus') THEN 30 ELSE 0 END)
        + (CASE WHEN host THEN 100 ELSE 0 END)
        + (CASE WHEN ends_with(name, '.API') OR ends_with(name, '.Service') OR ends_with(name, '.Web') THEN 10 ELSE 0 END) AS score
      FROM g)
SELECT id, name, score, (has_ctrl OR host OR score >= 50) AS is_service,
       CASE WHEN NOT (has_ctrl OR host OR score >= 50) THEN NULL WHEN has_ctrl THEN 'API'
            WHEN web OR asp THEN CASE WHEN contains(name, '.API') OR contains(name, '.Api') OR contains(name, '.WebApi')
                                      THEN 'API' ELSE 'Worker' END
            WHEN contains(name, 'Console') OR contains(name, 'Cli') THEN 'Console' ELSE 'Worker' END AS service_type
FROM s""")
def p09_service_boundaries(spark, sf_dir):
    t = _t(spark, sf_dir)
    classes, _ = pattern_probe(t)
    ctrl = (classes.where(F.col("name").endswith("Controller"))
            .groupBy(((F.col("id") - 1_000_000_000_000).cast("bigint")).alias("project_id")).agg(F.count(F.lit(1)).alias("n")))
    return P.service_boundaries(_service_projects(t), ctrl)


# ----------------------------------------------------------------------------- E-14

def api_endpoints(classes, members):
    """E-14: every METHOD of a controller class becomes an endpoint row: verb
    from the method-name prefix (X-24), route = ``api/[controller]`` with the
    controller name substituted, joined with the lower-case action (X-08)."""
    from meshlens.functions.code import http_verb
    from meshlens.functions.urls import combine_routes, controller_route
    c = classes.where(F.col("name").endswith("Controller")).select(
        F.col("id").alias("controller_id"), F.col("name").alias("controller"), F.col("fqn").alias("parent_name"))
    m = members.where(F.col("kind") == "METHOD").select(F.col("id").alias("method_id"), F.col("name").alias("action"),
                                                       "parent_name")
    j = c.join(m, "parent_name")
    route = combine_routes(controller_route(F.lit("api/[controller]"), F.col("controller"), F.lit(None).cast("string")),
                           F.lower("action"))
    return j.select("controller_id", "method_id", "controller", "action", http_verb(F.col("action")).alias("http_method"),
                    route.alias("route"))


@register("e14_api_endpoints", sql=f"""WITH {PROBE_SQL},
c AS (SELECT id AS controller_id, name AS controller, fqn FROM cls WHERE ends_with(name, 'Controller')),
e AS (SELECT c.controller_id, m.id AS method_id, c.controller, m.name AS action FROM c JOIN mem m ON m.parent_name = c.fqn
      WHERE m.kind = 'METHOD')
SELECT controller_id, method_id, controller, action,
       CASE WHEN starts_with(action, 'Get') THEN 'GET' WHEN starts_with(action, 'Post') THEN 'POST'
            WHEN starts_with(action, 'Put') THEN 'PUT' WHEN starts_with(action, 'Delete') THEN 'DELETE'
            WHEN starts_with(action, 'Patch') THEN 'PATCH' ELSE 'HTTP' END AS http_method,
       regexp_replace('/api/' || replace(controller, 'Controller', '') || '/' || lower(action), '/{{2,}}', '/', 'g') AS route
FROM e""")
def e14_api_endpoints(spark, sf_dir):
    return api_endpoints(*pattern_probe(_t(spark, sf_dir)))
