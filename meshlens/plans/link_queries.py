"""Registered cross-service linking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlens.functions.urls import normalize_url
from meshlens.operators import linking as L
from meshlens.plans.catalog import register
from meshlens.plans.oracle_views import norm_url_sql
from meshlens.plans.text_queries import sq
from meshlens.sources import probes
from meshlens.sources.tables import load_tables


def _t(spark, sf_dir):
    return load_tables(spark, sf_dir)


# The gateway configuration the probe calls are routed through
# (configuration, not data: a literal route table).
GATEWAY_ROUTES = (
    dict(id=1, gateway_type="ocelot", downstream="/en/{everything}", upstream="/lang/en/{everything}", priority=1),
    dict(id=2, gateway_type="ocelot", downstream="/{lang}/{id}", upstream="/content/{id}/{lang}", priority=0),
    dict(id=3, gateway_type="nginx", downstream=r"^/fr/([0-9]+)\.html", upstream="/legacy/fr/$1", priority=2,
         is_regex=True),
    dict(id=4, gateway_type="nginx", downstream="/de/", upstream="/german/", priority=0),
)


def _rules(spark):
    rows = [(r["id"], r["gateway_type"], r["downstream"], r["upstream"], r["priority"], r.get("is_regex", False))
            for r in GATEWAY_ROUTES]
    return L.compile_routes(spark.createDataFrame(
        rows, "id long, gateway_type string, downstream string, upstream string, priority int, is_regex boolean"))


# the same four routes as DuckDB patterns: (id, type, priority, template length, pattern, replacement, collapse)
_ROUTE_ROWS = (
    (1, "ocelot", 1, 16, r"^/en/(.+)$", r"/lang/en/\1", False),
    (2, "ocelot", 0, 12, r"^/([^/]+)/([^/]+)$", r"/content/\2/\1", False),
    (3, "nginx", 2, 21, r"(?s)^(?:^/fr/([0-9]+)\.html).*$", r"/legacy/fr/\1", False),
    (4, "nginx", 0, 4, r"(?s)^/de//*(.*)$", r"/german/\1", True),
)


def _routes_sql() -> str:
    rows = ", ".join(f"({i}, '{t}', {p}, {n}, {sq(rx)}, {sq(rep)}, {str(c).upper()})" for i, t, p, n, rx, rep, c in _ROUTE_ROWS)
    return f"(SELECT * FROM (VALUES {rows}) AS t(route_id, gateway_type, priority, tlen, regex, replacement, collapse))"


RESOLVE_SQL = f"""
(SELECT id, path, route_id, gateway_type,
        CASE WHEN collapse THEN regexp_replace(regexp_replace(path, regex, replacement), '/{{2,}}', '/', 'g')
             ELSE regexp_replace(path, regex, replacement) END AS resolved_path
 FROM (SELECT c.id, c.path, r.*, row_number() OVER (PARTITION BY c.id ORDER BY r.priority DESC, r.tlen, r.route_id) AS rn
       FROM v_calls c JOIN {_routes_sql()} r ON regexp_matches(c.path, r.regex))
 WHERE rn = 1)"""


@register("j14_resolve_gateway", sql=f"SELECT id, path, CAST(route_id AS BIGINT) AS route_id, gateway_type, resolved_path FROM {RESOLVE_SQL}")
def j14_resolve_gateway(spark, sf_dir):
    c = probes.v_calls(_t(spark, sf_dir))
    return L.resolve_gateway(c, _rules(spark))


def _config_texts(t):
    """One nginx configuration per first letter of the call paths, with a commented-out location."""
    letter = F.substring(F.regexp_replace("path", "^/+", ""), 1, 1)
    letters = probes.v_calls(t).select(letter.alias("c")).where(F.col("c") != "").distinct()
    return letters.select(F.col("c").alias("id"), F.concat(
        F.lit("server {\n  # location /"), F.col("c"), F.lit(" { proxy_pass http://old/gone/; }\n  location /"), F.col("c"),
        F.lit(" {\n    if ($x) { return 1; }\n    proxy_pass http://svc-"), F.col("c"), F.lit(":80/api/;\n  }\n}")).alias("text"))


@register("j14_gateway_from_configs", sql="""
SELECT id, path, 'nginx' AS gateway_type, regexp_replace('/api/' || ltrim(substr(path, 3), '/'), '/{2,}', '/', 'g') AS resolved_path
FROM v_calls WHERE regexp_matches(path, '^/[^/]')""")
def j14_gateway_from_configs(spark, sf_dir):
    """J-14 on the routes that E-12 reads from configuration texts; locations match by plain prefix."""
    from meshlens.operators import configs as C
    t = _t(spark, sf_dir)
    nginx = C.nginx_routes(_config_texts(t), "id", "text")
    ocelot = C.ocelot_routes(_config_texts(t).where("false"), "id", "text")
    return L.resolve_gateway(probes.v_calls(t), L.compile_routes(L.routes_from_configs(ocelot, nginx))).drop("route_id")


# letters that two texts share: the lesser count of each character
_SHARED = ("list_sum(list_transform(list_distinct(string_split({a}, '')), "
           "lambda ch: least(length({a}) - length(replace({a}, ch, '')), length({b}) - length(replace({b}, ch, '')))))")


@register("j13_candidate_endpoints", sql=f"""
WITH cr AS (SELECT DISTINCT {norm_url_sql('path')} AS call_route FROM v_calls),
ep AS (SELECT id AS endpoint_id, route AS ep_route FROM v_endpoints)
SELECT call_route, endpoint_id, ep_route FROM cr JOIN ep
  ON call_route = ep_route OR (call_route <> '' AND ep_route <> ''
     AND 2 * {_SHARED.format(a='call_route', b='ep_route')} >= 0.6 * (length(call_route) + length(ep_route)) - 1e-9)""")
def j13_candidate_endpoints(spark, sf_dir):
    t = _t(spark, sf_dir)
    c = probes.v_calls(t).select(normalize_url(F.col("path")).alias("call_route"))
    e = probes.v_endpoints(t)
    return L.candidate_endpoints(c, e)


def ratio_ctes(pairs: str) -> str:
    """Ratcliff–Obershelp similarity as recursive CTEs: ``pairs`` (a, b) → ``ro`` (a, b, ratio).  Each step finds the
    longest common block of a piece (earliest in a, then in b) and goes on left and right of it."""
    block = """list_max(flatten(list_transform(range(1, length(x) + 1), lambda i: list_filter(list_transform(
      range(1, length(x) - i + 2), lambda k: struct_pack(k := k, i := -i, j := -strpos(y, substr(x, i, k)))), lambda m: m.j < 0))))"""
    return f"""cut(a, b, x, y, m) AS (
  SELECT a, b, a, b, {block.replace('(x', '(a').replace('(y,', '(b,')} FROM {pairs}
  UNION ALL
  SELECT a, b, x, y, {block} FROM (
    SELECT a, b, unnest([substr(x, 1, -m.i - 1), substr(x, -m.i + m.k)]) AS x,
           unnest([substr(y, 1, -m.j - 1), substr(y, -m.j + m.k)]) AS y FROM cut WHERE m IS NOT NULL)
  WHERE x <> '' AND y <> ''),
ro AS (SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 1.0 ELSE 2.0 * coalesce(sum(m.k), 0) / (length(a) + length(b)) END AS ratio
       FROM cut GROUP BY a, b)"""


_SYNONYMS = " OR ".join(
    f"(lower(call_method) = '{verb}' AND (" + " OR ".join(f"contains(lower(ep_route), '{w}')" for w in words) + "))"
    for verb, words in L.METHOD_SYNONYMS.items())
_METHOD_OK = f"(upper(call_method) = upper(ep_method) OR contains(lower(ep_route), lower(call_method)) OR {_SYNONYMS})"


def links_sql(resolved: str | None) -> str:
    """J-12 over all pairs of calls and endpoints as a query body (starts with WITH RECURSIVE)."""
    gateway = f"LEFT JOIN {resolved} g ON g.id = c.id" if resolved else "LEFT JOIN (SELECT 0 AS id, '' AS resolved_path WHERE false) g ON g.id = c.id"
    route = norm_url_sql("coalesce(resolved_path, c.path)")
    return f"""RECURSIVE lc AS (SELECT c.id AS call_id, c.http_method AS call_method, g.resolved_path IS NOT NULL AS gateway,
                  {route} AS call_route FROM v_calls c {gateway}),
le AS (SELECT id AS endpoint_id, route AS ep_route, http_method AS ep_method FROM v_endpoints),
lp AS (SELECT DISTINCT call_route AS a, ep_route AS b FROM (SELECT DISTINCT call_route FROM lc), (SELECT DISTINCT ep_route FROM le)
          WHERE call_route <> '' AND ep_route <> ''
            AND 2 * {_SHARED.format(a='call_route', b='ep_route')} >= 0.4 * (length(call_route) + length(ep_route)) - 1e-9),
{ratio_ctes('lp')},
ls AS (SELECT call_id, endpoint_id, gateway,
              round(0.5 * CASE WHEN call_route = ep_route THEN 1.0 ELSE ratio END + CASE WHEN {_METHOD_OK} THEN 0.3 ELSE 0.0 END
                    + CASE WHEN gateway THEN 0.2 ELSE 0.1 END, 6) AS score
       FROM lc JOIN le ON true LEFT JOIN ro ON ro.a = call_route AND ro.b = ep_route WHERE call_route = ep_route OR ratio IS NOT NULL),
api_links AS (SELECT call_id, arg_min(endpoint_id, (-score, endpoint_id)) AS endpoint_id, CAST(max(score) AS DOUBLE) AS score,
                 any_value(gateway) AS gateway FROM ls WHERE score * 100 >= 70 - 1e-9 GROUP BY call_id)"""


_LINK_COLUMNS = """SELECT call_id, endpoint_id, score, CAST(floor(score * 100 + 1e-9) AS INTEGER) AS match_confidence,
       CASE WHEN gateway THEN 'gateway_resolved' WHEN score >= 0.9 THEN 'exact' ELSE 'fuzzy' END AS match_method FROM api_links"""


def _named_endpoints(t):
    return probes.v_endpoints(t).withColumn("name", F.col("route"))


@register("j12_exact_links", sql="""
WITH c AS (SELECT id, http_method AS call_method, {norm} AS call_route FROM v_calls),
j AS (SELECT c.id AS call_id, e.id AS endpoint_id,
             0.5 + CASE WHEN upper(c.call_method) = upper(e.http_method) OR contains(lower(e.route), lower(c.call_method))
                        THEN 0.3 ELSE 0.0 END + 0.1 AS score
      FROM c JOIN v_endpoints e ON e.route = c.call_route)
SELECT call_id, endpoint_id, CAST(round(score, 6) AS DOUBLE) AS score, CAST(floor(score * 100 + 1e-9) AS INTEGER) AS match_confidence,
       CASE WHEN score >= 0.9 THEN 'exact' ELSE 'fuzzy' END AS match_method
FROM j WHERE score * 100 >= 70 - 1e-9""".replace("{norm}", norm_url_sql("path")))
def j12_exact_links(spark, sf_dir):
    """J-12 exact tier: calls whose normalized route equals an endpoint route.
    The full operator with the fuzzy tier is ``j12_link_calls_to_endpoints``."""
    t = _t(spark, sf_dir)
    e = _named_endpoints(t)
    c = probes.v_calls(t)
    best = L.link_calls_to_endpoints(c, e)
    exact = c.select(F.col("id").alias("call_id"), normalize_url(F.col("path")).alias("route"))
    return (best.join(exact, "call_id").join(e.select(F.col("id").alias("endpoint_id"), "route"), ["endpoint_id", "route"])
            .drop("route"))


@register("j12_link_calls_to_endpoints", sql=f"WITH {links_sql(RESOLVE_SQL)} {_LINK_COLUMNS}")
def j12_link_calls_to_endpoints(spark, sf_dir):
    """J-12 full: gateway rewrite, exact + fuzzy candidates, best per call."""
    t = _t(spark, sf_dir)
    c = probes.v_calls(t)
    return L.link_calls_to_endpoints(c, _named_endpoints(t), L.resolve_gateway(c, _rules(spark)))


@register("x05_sequence_ratio", sql=f"""
WITH RECURSIVE t AS (SELECT id, {norm_url_sql('path')} AS a, lower(regexp_replace(path, '^/+|/+$', '', 'g')) AS b FROM v_calls),
p AS (SELECT DISTINCT a, b FROM t), {ratio_ctes('p')}
SELECT id, CAST(ratio AS DOUBLE) AS ratio FROM t JOIN ro USING (a, b)""")
def x05_sequence_ratio(spark, sf_dir):
    """X-05 on every call: normalized route vs the raw lower-cased path."""
    c = probes.v_calls(_t(spark, sf_dir))
    return c.select("id", L.sequence_ratio(normalize_url(F.col("path")),
                                           F.lower(F.regexp_replace("path", r"^/+|/+$", ""))).alias("ratio"))


@register("x06_http_method_matches", sql="""
SELECT c.id AS call_id, e.id AS endpoint_id,
  coalesce(upper(c.http_method) = upper(e.http_method) OR contains(lower(e.route), lower(c.http_method))
    OR (lower(c.http_method) = 'get' AND (contains(lower(e.route), 'get') OR contains(lower(e.route), 'fetch')
        OR contains(lower(e.route), 'retrieve') OR contains(lower(e.route), 'list') OR contains(lower(e.route), 'find')
        OR contains(lower(e.route), 'load')))
    OR (lower(c.http_method) = 'post' AND (contains(lower(e.route), 'post') OR contains(lower(e.route), 'create')
        OR contains(lower(e.route), 'add') OR contains(lower(e.route), 'insert') OR contains(lower(e.route), 'save')
        OR contains(lower(e.route), 'submit')))
    OR (lower(c.http_method) = 'put' AND (contains(lower(e.route), 'put') OR contains(lower(e.route), 'update')
        OR contains(lower(e.route), 'modify') OR contains(lower(e.route), 'edit') OR contains(lower(e.route), 'change')))
    OR (lower(c.http_method) = 'delete' AND (contains(lower(e.route), 'delete') OR contains(lower(e.route), 'remove')
        OR contains(lower(e.route), 'destroy') OR contains(lower(e.route), 'erase'))), false) AS method_matches
FROM v_calls c JOIN v_endpoints e ON e.route = {norm}""".replace("{norm}", norm_url_sql("c.path")))
def x06_http_method_matches(spark, sf_dir):
    t = _t(spark, sf_dir)
    c = probes.v_calls(t).withColumn("route", normalize_url(F.col("path")))
    e = probes.v_endpoints(t).select(F.col("id").alias("endpoint_id"), "route", F.col("http_method").alias("ep_method"))
    j = c.join(e, "route")
    return j.select(F.col("id").alias("call_id"), "endpoint_id",
                    L.http_method_matches(F.col("http_method"), F.col("ep_method"), F.lit(None).cast("string"),
                                          F.col("route")).alias("method_matches"))


RK_REGEX_SQL = ("'^' || array_to_string(list_transform(string_split({p}, '.'), lambda w: CASE WHEN w = '*' THEN '\\.[^.]*' "
                "WHEN w = '#' THEN '(?:\\.[^.]*)*' ELSE '\\.\\Q' || w || '\\E' END), '') || '$'")


def _rk_match_sql(key: str, pattern: str) -> str:
    return f"regexp_matches('.' || {key}, {RK_REGEX_SQL.format(p=pattern)})"


@register("x09_routing_key_matches", sql=f"""
SELECT p.id AS pub_id, s.id AS sub_id, {_rk_match_sql('p.routing_key', 's.pattern')} AS matches
FROM v_pub p JOIN v_sub s ON p.event_type = s.event_type""")
def x09_routing_key_matches(spark, sf_dir):
    t = _t(spark, sf_dir)
    p = probes.v_pub(t).select(F.col("id").alias("pub_id"), "event_type", "routing_key")
    s = probes.v_sub(t).select(F.col("id").alias("sub_id"), "event_type", "pattern")
    return p.join(s, "event_type").select("pub_id", "sub_id",
                                          L.routing_key_matches(F.col("routing_key"), F.col("pattern")).alias("matches"))


EVENT_LINKS_SQL = f"""
(SELECT * FROM (
  SELECT p.id AS pub_id, p.repo AS pub_repo, s.id AS sub_id, s.repo AS sub_repo, 'exact_type' AS match_method,
         CAST(70 + CASE WHEN p.topic = s.queue THEN 20 ELSE 0 END
              + CASE WHEN {_rk_match_sql('p.routing_key', 's.pattern')} THEN 10 ELSE 0 END AS INTEGER) AS match_confidence
  FROM v_pub p JOIN v_sub s ON p.event_type = s.event_type WHERE p.repo <> s.repo) WHERE match_confidence >= 80)"""


@register("j15_link_events", sql=f"SELECT * FROM {EVENT_LINKS_SQL}")
def j15_link_events(spark, sf_dir):
    t = _t(spark, sf_dir)
    return L.link_events(probes.v_pub(t), probes.v_sub(t), fuzzy=False)


@register("j15_event_keys", sql=f"""
WITH o AS (SELECT id, event_type, 'topic' AS kind, topic AS value FROM v_pub UNION SELECT id, event_type, 'route', routing_key FROM v_pub),
i AS (SELECT s.id, event_type, 'topic' AS kind, queue AS value FROM v_sub s
      UNION SELECT s.id, s.event_type, 'route', k.routing_key FROM v_sub s JOIN (SELECT DISTINCT event_type, routing_key FROM v_pub) k
        ON k.event_type = s.event_type AND {_rk_match_sql('k.routing_key', 's.pattern')}),
m AS (SELECT 'out' AS side, * FROM o UNION ALL SELECT 'in', * FROM i WHERE (event_type, kind, value) IN (SELECT (event_type, kind, value) FROM o))
SELECT side, id AS member, '{{"kind":"' || kind || '","event_type":"' || event_type || '","value":"' || value || '"}}' AS key FROM m""")
def j15_event_keys(spark, sf_dir):
    """J-15 (equal types) factored: publishers and subscribers of a topic or a routing key instead of their pairs."""
    t = _t(spark, sf_dir)
    return L.event_keys(probes.v_pub(t), probes.v_sub(t)).rows()


@register("j15_event_key_pairs", sql=f"SELECT DISTINCT pub_id AS src, sub_id AS dst, 'EVENT' AS type FROM {EVENT_LINKS_SQL} WHERE pub_id % 20 = 0 AND pub_id <> sub_id")
def j15_event_key_pairs(spark, sf_dir):
    """The pairs of the factored links on demand: for every publisher whose id is divisible by 20."""
    t = _t(spark, sf_dir)
    asked = probes.v_pub(t).where(F.col("id") % 20 == 0).select(F.col("id").alias("src"))
    return L.event_keys(probes.v_pub(t), probes.v_sub(t)).pairs(asked)


@register("j15_link_events_fuzzy")
def j15_link_events_fuzzy(spark, sf_dir):
    t = _t(spark, sf_dir)
    return L.link_events(probes.v_pub(t), probes.v_sub(t), fuzzy=True)


def api_links(spark, t):
    """J-12's links between the calls and endpoints of the tables, with the repositories of both."""
    c = probes.v_calls(t)
    links = L.link_calls_to_endpoints(c, _named_endpoints(t), L.resolve_gateway(c, _rules(spark)))
    return (links.join(c.select(F.col("id").alias("call_id"), F.col("repository").alias("call_repo")), "call_id")
            .join(probes.v_endpoints(t).select(F.col("id").alias("endpoint_id"), F.col("repository").alias("ep_repo")),
                  "endpoint_id"))


API_SQL = f"""{links_sql(RESOLVE_SQL)},
api AS (SELECT l.*, c.repository AS call_repo, e.repository AS ep_repo
        FROM api_links l JOIN v_calls c ON c.id = l.call_id JOIN v_endpoints e ON e.id = l.endpoint_id)"""


@register("g10_cross_service_edges", sql=f"""
WITH {API_SQL},
ev AS (SELECT CAST(pub_repo AS VARCHAR) AS src_repo, CAST(sub_repo AS VARCHAR) AS dst_repo FROM {EVENT_LINKS_SQL})
SELECT src_repo, dst_repo, kind, count(*) AS links FROM (
  SELECT call_repo AS src_repo, ep_repo AS dst_repo, 'api' AS kind FROM api UNION ALL SELECT src_repo, dst_repo, 'event' FROM ev)
GROUP BY ALL""")
def g10_cross_service_edges(spark, sf_dir):
    t = _t(spark, sf_dir)
    api = api_links(spark, t).select(F.col("call_repo").alias("src_repo"), F.col("ep_repo").alias("dst_repo"))
    ev = L.link_events(probes.v_pub(t), probes.v_sub(t), fuzzy=False)
    return L.cross_service_edges(api, ev)


SERVICES_SQL = """(SELECT s_suppkey AS service_id, 'src' || CAST(s_suppkey % 25 AS VARCHAR) AS service_name,
  'src' || CAST(s_nationkey AS VARCHAR) AS image_name FROM supplier)"""
REPOS_SQL = """(SELECT row_number() OVER (ORDER BY repository) AS repo_id, repository AS repo_name,
  'org/' || repository || '-svc' AS repo_path FROM (SELECT DISTINCT repository FROM v_files))"""


def _services(t):
    s = t.supplier
    return s.select(F.col("s_suppkey").alias("service_id"),
                    F.concat(F.lit("src"), (F.col("s_suppkey") % 25).cast("string")).alias("service_name"),
                    F.concat(F.lit("src"), F.col("s_nationkey").cast("string")).alias("image_name"))


def _repos(t):
    from pyspark.sql import Window
    r = probes.v_files(t).select(F.col("repository").alias("repo_name")).distinct()
    # the distinct repository set is small by nature (one row per repository)
    return r.select(F.row_number().over(Window.orderBy("repo_name")).cast("bigint").alias("repo_id"), "repo_name",
                    F.concat(F.lit("org/"), F.col("repo_name"), F.lit("-svc")).alias("repo_path"))


MAPPING_SQL = f"""
(WITH sv AS (SELECT service_id, lower(service_name) AS sname, lower(image_name) AS iname FROM {SERVICES_SQL}),
rp AS (SELECT repo_id, lower(repo_name) AS rname, lower(repo_path) AS rpath FROM {REPOS_SQL}),
c AS (SELECT service_id, repo_id, 100 AS confidence FROM sv JOIN rp ON sname = rname
      UNION ALL SELECT service_id, repo_id, 95 FROM sv JOIN rp ON iname = rname
      UNION ALL SELECT service_id, repo_id, 80 FROM sv JOIN rp ON contains(rpath, sname)
      UNION ALL SELECT service_id, repo_id, 70 FROM sv JOIN rp ON contains(rname, sname) OR contains(sname, rname))
SELECT service_id, CAST(repo_id AS BIGINT) AS repo_id, confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY service_id ORDER BY confidence DESC, repo_id) AS rn FROM c) WHERE rn = 1)"""


@register("j16_map_services_to_repos", sql=f"SELECT * FROM {MAPPING_SQL} WHERE confidence >= 70")
def j16_map_services_to_repos(spark, sf_dir):
    t = _t(spark, sf_dir)
    return L.map_services_to_repos(_services(t), _repos(t))


@register("j17_resolve_service_urls", sql=f"""
WITH m AS (SELECT s.service_name, m.repo_id, m.confidence FROM {MAPPING_SQL} m JOIN {SERVICES_SQL} s USING (service_id)),
best AS (SELECT service_name, arg_max(repo_id, (confidence, -repo_id)) AS repo_id, max(confidence) AS confidence
         FROM m GROUP BY service_name)
SELECT c.id, c.host, best.repo_id, best.confidence
FROM (SELECT id, 'src' || CAST(id % 30 AS VARCHAR) AS host FROM v_calls) c JOIN best ON best.service_name = c.host""")
def j17_resolve_service_urls(spark, sf_dir):
    """J-17: each call's service host (probe: ``src<id mod 30>``) → repository."""
    t = _t(spark, sf_dir)
    m = L.map_services_to_repos(_services(t), _repos(t)).join(_services(t).select("service_id", "service_name"),
                                                              "service_id")
    urls = probes.v_calls(t).select("id", F.concat(F.lit("src"), (F.col("id") % 30).cast("string")).alias("host"))
    return L.resolve_service_urls(urls, m).select("id", "host", "repo_id", "confidence")


@register("j35_mapping_report", sql=f"""
SELECT s.service_name, r.repo_name, m.confidence, 'auto' AS mapping_method
FROM {MAPPING_SQL} m JOIN {SERVICES_SQL} s USING (service_id) JOIN {REPOS_SQL} r USING (repo_id)
UNION ALL
SELECT 'manual-' || repo_name, repo_name, 100, 'manual' FROM {REPOS_SQL} WHERE repo_id % 5 = 0""")
def j35_mapping_report(spark, sf_dir):
    """J-35: automatic mappings joined to names, with manual mappings (every
    fifth repository has one, confidence 100) unioned in."""
    t = _t(spark, sf_dir)
    repos = _repos(t)
    m = L.map_services_to_repos(_services(t), repos)
    auto = (m.join(_services(t), "service_id").join(repos, "repo_id")
            .select("service_name", "repo_name", "confidence", F.lit("auto").alias("mapping_method")))
    manual = repos.where(F.col("repo_id") % 5 == 0).select(
        F.concat(F.lit("manual-"), F.col("repo_name")).alias("service_name"), "repo_name",
        F.lit(100).alias("confidence"), F.lit("manual").alias("mapping_method"))
    return auto.unionByName(manual)


@register("a07_integration_summary", sql=f"""
WITH {links_sql(RESOLVE_SQL)}
SELECT 'count' AS section, 'outgoing_calls' AS item, count(*) AS n FROM v_calls
UNION ALL SELECT 'count', 'published_events', count(*) FROM v_pub
UNION ALL SELECT 'count', 'subscriptions', count(*) FROM v_sub
UNION ALL SELECT 'count', 'event_links', count(*) FROM {EVENT_LINKS_SQL}
UNION ALL SELECT 'count', 'api_links', count(*) FROM api_links
UNION ALL SELECT * FROM (SELECT 'top_url', route, count(*) AS n FROM (SELECT {norm_url_sql('path')} AS route FROM v_calls)
                         GROUP BY route ORDER BY n DESC, route LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'top_event', event_type, count(*) AS n FROM v_pub GROUP BY event_type
                         ORDER BY n DESC, event_type LIMIT 5)""")
def a07_integration_summary(spark, sf_dir):
    """A-07 in long form: counts, top-5 URL patterns and top-5 event types."""
    t = _t(spark, sf_dir)
    calls, pubs, subs = probes.v_calls(t), probes.v_pub(t), probes.v_sub(t)
    links = L.link_events(pubs, subs, fuzzy=False)

    def cnt(df, item):
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("count").alias("section"),
                                                             F.lit(item).alias("item"), "n")
    top_url = (calls.groupBy(normalize_url(F.col("path")).alias("item")).agg(F.count(F.lit(1)).alias("n"))
               .orderBy(F.col("n").desc(), "item").limit(5).select(F.lit("top_url").alias("section"), "item", "n"))
    top_ev = (pubs.groupBy(F.col("event_type").alias("item")).agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.col("n").desc(), "item").limit(5).select(F.lit("top_event").alias("section"), "item", "n"))
    out = cnt(calls, "outgoing_calls")
    for part in (cnt(pubs, "published_events"), cnt(subs, "subscriptions"), cnt(links, "event_links"),
                 cnt(api_links(spark, t), "api_links"), top_url, top_ev):
        out = out.unionByName(part)
    return out


def _templates(t):
    e = probes.v_endpoints(t)
    return e.select("id", F.concat(F.lit("/"), F.regexp_replace("route", r"\*", "{p}")).alias("template"), "http_method")


@register("j29_match_endpoint", sql="""
WITH ep AS (SELECT id AS endpoint_id, '/' || replace(route, '*', '{p}') AS template, http_method AS ep_method FROM v_endpoints),
req AS (SELECT id AS request_id, path, http_method AS req_method FROM v_calls),
m AS (SELECT r.request_id, e.endpoint_id,
             CASE WHEN regexp_full_match(r.path, '(?i)' || regexp_replace(e.template, '\\{[^}]+\\}', '[^/]+', 'g')) THEN 1
                  WHEN contains(r.path, e.template) OR contains(e.template, r.path) THEN 2 END AS tier
      FROM req r JOIN ep e ON r.req_method IS NULL OR r.req_method = '' OR e.ep_method = r.req_method)
SELECT request_id, arg_min(endpoint_id, (tier, endpoint_id)) AS endpoint_id, CAST(min(tier) AS INTEGER) AS tier
FROM m WHERE tier IS NOT NULL GROUP BY request_id""")
def j29_match_endpoint(spark, sf_dir):
    t = _t(spark, sf_dir)
    req = probes.v_calls(t).select("id", "path", "http_method")
    return L.match_endpoint(req, _templates(t)).select("request_id", "endpoint_id", F.col("tier").cast("int"))


# ----------------------------------------------------------------------------- J-11

@register("j11_connected_endpoints", sql=f"""
WITH {API_SQL},
np AS (SELECT count(*) AS n FROM part),
ev AS (SELECT * FROM {EVENT_LINKS_SQL})
SELECT api.call_id % (SELECT n FROM np) AS symbol_id, 'outgoing_call' AS relation, api.endpoint_id AS other_id,
       api.ep_repo AS other_repository FROM api
UNION ALL SELECT api.endpoint_id % (SELECT n FROM np), 'incoming_call', api.call_id, api.call_repo FROM api
UNION ALL SELECT ev.pub_id % (SELECT n FROM np), 'publishes_to', ev.sub_id, CAST(ev.sub_repo AS VARCHAR) FROM ev
UNION ALL SELECT ev.sub_id % (SELECT n FROM np), 'subscribed_from', ev.pub_id, CAST(ev.pub_repo AS VARCHAR) FROM ev""")
def j11_connected_endpoints(spark, sf_dir):
    """J-11 in long form: for every symbol, the endpoints its calls reach (J-12 links), the
    calls reaching the endpoints it serves, the subscriptions its events reach
    and the publishers of the events it handles (probe: a call / endpoint /
    event row belongs to the symbol id = row id mod part count)."""
    t = _t(spark, sf_dir)
    n = t.part.select(F.count(F.lit(1))).scalar()
    api = api_links(spark, t)
    ev = L.link_events(probes.v_pub(t), probes.v_sub(t), fuzzy=False)
    parts = [
        api.select((F.col("call_id") % n).alias("symbol_id"), F.lit("outgoing_call").alias("relation"),
                   F.col("endpoint_id").alias("other_id"), F.col("ep_repo").alias("other_repository")),
        api.select((F.col("endpoint_id") % n).alias("symbol_id"), F.lit("incoming_call").alias("relation"),
                   F.col("call_id").alias("other_id"), F.col("call_repo").alias("other_repository")),
        ev.select((F.col("pub_id") % n).alias("symbol_id"), F.lit("publishes_to").alias("relation"),
                  F.col("sub_id").alias("other_id"), F.col("sub_repo").cast("string").alias("other_repository")),
        ev.select((F.col("sub_id") % n).alias("symbol_id"), F.lit("subscribed_from").alias("relation"),
                  F.col("pub_id").alias("other_id"), F.col("pub_repo").cast("string").alias("other_repository")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
