"""Registered structured-config extraction queries (E-11, E-12, E-13, E-15 with X-30).

Probe texts are generated from the driver's tables (pages, endpoints, suppliers,
parts) so each query's work grows with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlens.operators import configs as C
from meshlens.operators import ddl as D
from meshlens.operators import manifests as M
from meshlens.plans.catalog import register
from meshlens.plans.text_queries import sq
from meshlens.sources import probes
from meshlens.sources.tables import load_tables, spread


def _t(spark, sf_dir):
    return load_tables(spark, sf_dir)


OCELOT_SQL = """('{"Routes": [{"UpstreamPathTemplate": "' || path || '", "DownstreamPathTemplate": "/svc' || path
  || '", "DownstreamHostAndPorts": [{"Host": "' || host || '", "Port": ' || CAST(80 + id % 3 AS VARCHAR)
  || '}], "UpstreamHttpMethod": ["Get", "Post"], "Key": "r' || CAST(id AS VARCHAR) || '", "Priority": '
  || CAST(id % 3 AS VARCHAR) || '}, {"DownstreamPathTemplate": "/orphan"}]}')"""


def _ocelot(t):
    c = probes.v_calls(t)
    txt = F.concat(F.lit('{"Routes": [{"UpstreamPathTemplate": "'), F.col("path"), F.lit('", "DownstreamPathTemplate": "/svc'),
                   F.col("path"), F.lit('", "DownstreamHostAndPorts": [{"Host": "'), F.col("host"), F.lit('", "Port": '),
                   (F.lit(80) + F.col("id") % 3).cast("string"),
                   F.lit('}], "UpstreamHttpMethod": ["Get", "Post"], "Key": "r'), F.col("id").cast("string"),
                   F.lit('", "Priority": '), (F.col("id") % 3).cast("string"),
                   F.lit('}, {"DownstreamPathTemplate": "/orphan"}]}'))
    return c.select("id", txt.alias("text"))


@register("e12_ocelot_routes", sql=f"""
SELECT id, 'ocelot' AS gateway_type, r->>'$.UpstreamPathTemplate' AS downstream_path,
       r->>'$.DownstreamPathTemplate' AS upstream_path,
       coalesce(r->>'$.DownstreamHostAndPorts[0].Host', r->>'$.DownstreamHost') AS upstream_host,
       CAST(coalesce(r->>'$.DownstreamHostAndPorts[0].Port', r->>'$.DownstreamPort') AS INTEGER) AS upstream_port,
       array_to_string(from_json(r->'$.UpstreamHttpMethod', '["VARCHAR"]'), ',') AS http_methods,
       coalesce(r->>'$.Key', r->>'$.RouteKey') AS route_name, coalesce(CAST(r->>'$.Priority' AS INTEGER), 0) AS priority
FROM (SELECT id, unnest(from_json(j->'$.Routes', '["JSON"]')) AS r FROM (SELECT id, {OCELOT_SQL}::JSON AS j FROM v_calls))
WHERE r->>'$.UpstreamPathTemplate' IS NOT NULL""")
def e12_ocelot_routes(spark, sf_dir):
    return C.ocelot_routes(_ocelot(_t(spark, sf_dir)), "id", "text")


# DuckDB patterns for the probe text: one location, its target
_LOCATION = r"(?s)location\s+([=~*]*)\s*(\S+)\s*\{([^}]*)\}"
_PROXY = r"proxy_pass ([^;]+);"
_TARGET = r"^http://([^:/]+)(?::([0-9]+))?(/.*)?$"
NGINX_SQL = """('server {' || chr(10) || '  location /' || split_part(trim(path, '/'), '/', 1) || '/ {' || chr(10)
  || '    proxy_pass http://' || host || ':8080/api/;' || chr(10) || '  }' || chr(10)
  || '  location ~ ^/x/(.*)$ { proxy_set_header Host $host; proxy_pass http://b' || CAST(id % 4 AS VARCHAR) || '/$1; }' || chr(10)
  || '  location = /health { return 200; }' || chr(10) || '}')"""


def _nginx(t):
    c = probes.v_calls(t)
    first = F.element_at(F.split(F.regexp_replace("path", r"^/+|/+$", ""), "/"), 1)
    txt = F.concat(F.lit("server {\n  location /"), first, F.lit("/ {\n    proxy_pass http://"), F.col("host"),
                   F.lit(":8080/api/;\n  }\n  location ~ ^/x/(.*)$ { proxy_set_header Host $host; proxy_pass http://b"),
                   (F.col("id") % 4).cast("string"), F.lit("/$1; }\n  location = /health { return 200; }\n}"))
    return c.select("id", txt.alias("text"))


@register("e12_nginx_routes", sql=f"""
WITH t AS (SELECT id, {NGINX_SQL} AS text FROM v_calls),
l AS (SELECT id, unnest(regexp_extract_all(text, {sq(_LOCATION)}, 1)) AS m,
             unnest(regexp_extract_all(text, {sq(_LOCATION)}, 2)) AS p,
             unnest(regexp_extract_all(text, {sq(_LOCATION)}, 3)) AS b FROM t),
x AS (SELECT *, trim(regexp_extract(b, {sq(_PROXY)}, 1)) AS proxy FROM l)
SELECT id, 'nginx' AS gateway_type, trim(m) AS modifier, trim(p) AS downstream_path,
       CASE WHEN regexp_extract(proxy, {sq(_TARGET)}, 3) = '' THEN '/' ELSE regexp_extract(proxy, {sq(_TARGET)}, 3) END AS upstream_path,
       regexp_extract(proxy, {sq(_TARGET)}, 1) AS upstream_host,
       CAST(nullif(regexp_extract(proxy, {sq(_TARGET)}, 2), '') AS INTEGER) AS upstream_port
FROM x WHERE proxy <> ''""")
def e12_nginx_routes(spark, sf_dir):
    return C.nginx_routes(_nginx(_t(spark, sf_dir)), "id", "text")


OPENAPI_SQL = """('{"paths": {"/' || route || '": {"' || lower(http_method) || '": {"operationId": "op' || CAST(id AS VARCHAR)
  || '", "tags": ["t' || CAST(id % 3 AS VARCHAR) || '"], "parameters": [{"name": "id", "in": "path"}, {"name": "q", "in": "query"}],'
  || ' "responses": {"200": {"description": "ok"}, "404": {"description": "missing"}}}, "x-extra": {"operationId": "skip"}}}}')"""


def _openapi(t):
    e = probes.v_endpoints(t)
    txt = F.concat(F.lit('{"paths": {"/'), F.col("route"), F.lit('": {"'), F.lower("http_method"),
                   F.lit('": {"operationId": "op'), F.col("id").cast("string"), F.lit('", "tags": ["t'),
                   (F.col("id") % 3).cast("string"),
                   F.lit('"], "parameters": [{"name": "id", "in": "path"}, {"name": "q", "in": "query"}], '
                         '"responses": {"200": {"description": "ok"}, "404": {"description": "missing"}}}, '
                         '"x-extra": {"operationId": "skip"}}}}'))
    return e.select("id", txt.alias("text"))


@register("e13_openapi_operations", sql=f"""
WITH s AS (SELECT id, {OPENAPI_SQL}::JSON AS j FROM v_endpoints),
p AS (SELECT s.id, pe.key AS path, pe.value AS ops FROM s, json_each(s.j, '$.paths') pe),
o AS (SELECT p.id, p.path, oe.key AS method, oe.value AS op FROM p, json_each(p.ops) oe
      WHERE oe.key IN ('get', 'post', 'put', 'delete', 'patch', 'head', 'options'))
SELECT id, path, upper(method) AS http_method, op->>'$.operationId' AS operation_id,
       array_to_string(from_json(op->'$.tags', '["VARCHAR"]'), ',') AS tags,
       array_to_string(list_transform(from_json(op->'$.parameters', '[{{"name": "VARCHAR"}}]'), lambda x: x.name), ',') AS parameters,
       array_to_string(list_sort(json_keys(op->'$.responses')), ',') AS responses
FROM o""")
def e13_openapi_operations(spark, sf_dir):
    return C.openapi_operations(_openapi(_t(spark, sf_dir)), "id", "text")


COMPOSE_SQL = """('{"services": {"svc' || CAST(s_suppkey AS VARCHAR) || '": {"image": "registry/src' || CAST(s_nationkey AS VARCHAR)
  || ':1.' || CAST(s_suppkey % 3 AS VARCHAR) || '", "ports": ["80' || CAST(s_suppkey % 10 AS VARCHAR) || ':80/tcp", "900'
  || CAST(s_suppkey % 4 AS VARCHAR) || '", "bad"], "environment": ["A=1", "B=x' || CAST(s_suppkey AS VARCHAR) || '=y", "BARE"],'
  || ' "volumes": ["./data:/data:ro", "named:/var"], "depends_on": ["db"]}, "db": {"image": "postgres:16", "ports": ["5432:5432"]}}}')"""


def _compose(t):
    s = t.supplier
    k = F.col("s_suppkey")
    txt = F.concat(F.lit('{"services": {"svc'), k.cast("string"), F.lit('": {"image": "registry/src'),
                   F.col("s_nationkey").cast("string"), F.lit(":1."), (k % 3).cast("string"), F.lit('", "ports": ["80'),
                   (k % 10).cast("string"), F.lit(':80/tcp", "900'), (k % 4).cast("string"),
                   F.lit('", "bad"], "environment": ["A=1", "B=x'), k.cast("string"),
                   F.lit('=y", "BARE"], "volumes": ["./data:/data:ro", "named:/var"], "depends_on": ["db"]}, '
                         '"db": {"image": "postgres:16", "ports": ["5432:5432"]}}}'))
    return s.select(k.alias("id"), txt.alias("text"))


@register("e15_docker_services", sql=r"""
WITH s AS (SELECT id, j FROM (SELECT s_suppkey AS id, {compose}::JSON AS j FROM supplier)),
e AS (SELECT s.id, se.key AS service_name, se.value AS v FROM s, json_each(s.j, '$.services') se),
p AS (SELECT id, service_name, list_filter(list_transform(coalesce(from_json(v->'$.ports', '["VARCHAR"]'), []), lambda x:
        CASE WHEN regexp_matches(x, '^(\d+):(\d+)(?:/(tcp|udp))?$')
             THEN coalesce(regexp_extract(x, '^(\d+):(\d+)(?:/(tcp|udp))?$', 1), '') || ':' || regexp_extract(x, '^(\d+):(\d+)(?:/(tcp|udp))?$', 2)
                  || '/' || coalesce(nullif(regexp_extract(x, '^(\d+):(\d+)(?:/(tcp|udp))?$', 3), ''), 'tcp')
             WHEN regexp_matches(x, '^\d+$') THEN ':' || x || '/tcp' END), lambda y: y IS NOT NULL) AS ports,
        list_transform(coalesce(from_json(v->'$.environment', '["VARCHAR"]'), []), lambda x:
          split_part(x, '=', 1) || '=' || CASE WHEN contains(x, '=') THEN regexp_extract(x, '^[^=]*=(.*)$', 1) ELSE '' END) AS env,
        list_transform(list_filter(coalesce(from_json(v->'$.volumes', '["VARCHAR"]'), []), lambda x: len(string_split(x, ':')) >= 2),
          lambda x: string_split(x, ':')[1] || '>' || string_split(x, ':')[2] || '>' ||
            CASE WHEN len(string_split(x, ':')) > 2 THEN string_split(x, ':')[3] ELSE 'rw' END || '>' ||
            CASE WHEN starts_with(x, '/') OR starts_with(x, '.') THEN 'bind' ELSE 'volume' END) AS vols,
        v->>'$.image' AS image FROM e)
SELECT id, service_name, image, array_to_string(ports, ',') AS ports, array_to_string(list_sort(env), ',') AS environment,
       array_to_string(vols, ',') AS volumes,
       array_to_string(list_transform(list_filter(ports, lambda x: split_part(split_part(x, ':', 2), '/', 1) IN ('80', '8080', '3000', '5000')),
         lambda x: 'http://' || service_name || ':' || split_part(split_part(x, ':', 2), '/', 1)), ',') AS service_urls
FROM p""".replace("{compose}", COMPOSE_SQL))
def e15_docker_services(spark, sf_dir):
    d = C.docker_services(_compose(_t(spark, sf_dir)), "id", "text")
    ports = F.array_join(F.transform("ports", lambda x: F.concat(F.coalesce(x["host"].cast("string"), F.lit("")), F.lit(":"),
                                                                   x["container"].cast("string"), F.lit("/"), x["protocol"])), ",")
    env = F.array_join(F.array_sort(F.transform(F.map_entries("environment"),
                                                lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    vols = F.array_join(F.transform("volumes", lambda v: F.concat_ws(">", v["source"], v["target"], v["mode"], v["type"])), ",")
    return d.select("id", "service_name", "image", ports.alias("ports"), env.alias("environment"), vols.alias("volumes"),
                    F.array_join("service_urls", ",").alias("service_urls"))


# Definitions with quotes, nested parentheses and comments; {k}, {n} and {b} stand for the part's key, name and brand.
_DDL_TEXT = """-- CREATE TABLE Not.There (a INT);
CREATE TABLE dbo.T{k} (
  Id INT NOT NULL PRIMARY KEY, /* it's (odd */
  [Name] NVARCHAR(50) NULL DEFAULT '{n};{b}, (x',
  Price DECIMAL(10, 2) DEFAULT (round((1 + 2) * 3, 2)),
  Kind ENUM('a,b', 'c)') NOT NULL, Size ENUM(1,2,3), At TIMESTAMP DEFAULT now(),
  Note TEXT DEFAULT 'not null',
  CONSTRAINT PK_T{k} PRIMARY KEY (Id), CHECK (Size IN (1, (2)) AND Name <> ');'),
  FOREIGN KEY (Kind) REFERENCES dbo.Kinds(Id)
);
INSERT INTO x VALUES ('CREATE TABLE Fake (a INT);');
CREATE OR REPLACE VIEW V{k} (a, b) AS SELECT ';' AS a, "{n}" AS b FROM dbo.T{k} WHERE Id IN (SELECT 1);
CREATE PROCEDURE P{k}(IN a INT, OUT b DECIMAL(10,2), c VARCHAR(5) DEFAULT ',') BEGIN SELECT a; SELECT '{n}'; END;
CREATE FUNCTION F{k}() RETURNS INT BEGIN RETURN {k}; END;
"""


def _ddl_sql() -> str:
    out = sq(_DDL_TEXT)
    for mark, value in (("{k}", "CAST(p_partkey AS VARCHAR)"), ("{n}", "replace(p_name, ' ', '_')"), ("{b}", "p_brand")):
        out = f"replace({out}, '{mark}', {value})"
    return out


DDL_SQL = _ddl_sql()


def _ddl(t):
    text = F.lit(_DDL_TEXT)
    for mark, value in (("{k}", F.col("p_partkey").cast("string")), ("{n}", F.replace("p_name", F.lit(" "), F.lit("_"))),
                        ("{b}", F.col("p_brand"))):
        text = F.replace(text, F.lit(mark), value)
    return spread(t.part.select("p_partkey", "p_name", "p_brand")).select(F.col("p_partkey").alias("id"), text.alias("text"))


def _re2(pattern: str) -> str:
    return sq(D.greedy(pattern))


def _found_sql(pattern: str, names: list[str]) -> str:
    groups = ", ".join(f"unnest(regexp_extract_all(text, {_re2(pattern)}, {i + 1})) AS {n}" for i, n in enumerate(names))
    return f"""(SELECT * FROM (SELECT id, {groups} FROM (
  SELECT p_partkey AS id, regexp_replace({DDL_SQL}, {_re2(D.COMMENT)}, '\\1', 'g') AS text FROM part)) WHERE {names[0]} <> '')"""


_BARE_NAME = """regexp_replace({c}, '[\\[\\]"`'']', '', 'g')"""
_TRIM = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_ITEMS_SQL = f"list_transform(regexp_extract_all({{c}}, {_re2(D.ITEM)}), lambda x: {_TRIM.format(c='x')})"
TABLE_ITEMS_SQL = f"""(SELECT *, regexp_replace(d, {_re2(D.OUTSIDE)}, ' ', 'g') AS bare FROM (
  SELECT id, {_BARE_NAME.format(c='table_name')} AS table_name, CAST(generate_subscripts(items, 1) AS INTEGER) AS ordinal, unnest(items) AS d
  FROM (SELECT *, {_ITEMS_SQL.format(c='body')} AS items FROM {_found_sql(D.TABLE, ['table_name', 'body'])})) WHERE d <> '')"""


@register("e11_ddl_columns", sql=f"""
SELECT id, table_name, ordinal, {_BARE_NAME.format(c=f"regexp_extract(d, {_re2(D.COLUMN)}, 1)")} AS column_name,
       upper(regexp_replace(regexp_extract(d, {_re2(D.COLUMN)}, 2), '\\s+', ' ', 'g'))
         || regexp_replace(regexp_extract(d, {_re2(D.COLUMN)}, 3), '\\s*([(),])\\s*', '\\1', 'g') AS data_type,
       NOT regexp_matches(bare, '(?i)\\bNOT\\s+NULL\\b') AS nullable,
       nullif(regexp_extract(d, {_re2(D.DEFAULT)}, 1), '') AS default_value
FROM {TABLE_ITEMS_SQL} WHERE NOT regexp_matches(d, {_re2(D.TABLE_LEVEL)}) AND regexp_matches(d, {_re2(D.COLUMN)})""")
def e11_ddl_columns(spark, sf_dir):
    return D.ddl_columns(_ddl(_t(spark, sf_dir)), "id", "text")


@register("e11_ddl_constraints", sql=f"""
SELECT id, table_name, ordinal, nullif(regexp_extract(d, '(?i)\\bCONSTRAINT\\s+([\\w$]+)', 1), '') AS constraint_name,
       upper(regexp_replace(regexp_extract(bare, {_re2(D.CONSTRAINT)}, 1), '\\s+', ' ', 'g')) AS constraint_type, d AS definition
FROM {TABLE_ITEMS_SQL} WHERE regexp_matches(bare, {_re2(D.CONSTRAINT)})""")
def e11_ddl_constraints(spark, sf_dir):
    return D.ddl_constraints(_ddl(_t(spark, sf_dir)), "id", "text")


@register("e11_ddl_views", sql=f"""
SELECT id, {_BARE_NAME.format(c='view_name')} AS view_name, {_TRIM.format(c='query')} AS query
FROM {_found_sql(D.VIEW, ['view_name', 'query'])}""")
def e11_ddl_views(spark, sf_dir):
    return D.ddl_views(_ddl(_t(spark, sf_dir)), "id", "text")


@register("e11_ddl_procedures", sql=f"""
WITH p AS (SELECT id, upper(kind) AS kind, {_BARE_NAME.format(c='name')} AS name, {_TRIM.format(c='body')} AS body,
                  CASE WHEN contains(upper(returns), 'RETURNS') THEN {_TRIM.format(c='returns')} END AS returns,
                  list_filter({_ITEMS_SQL.format(c='params')}, lambda x: regexp_matches(x, {_re2(D.PARAMETER)})) AS items
           FROM {_found_sql(D.PROCEDURE, ['kind', 'name', 'params', 'returns', 'body'])}),
q AS (SELECT * EXCLUDE items, CAST(g AS INTEGER) AS position, items[g] AS d FROM p LEFT JOIN LATERAL
        (SELECT unnest(generate_series(1, len(p.items))) AS g) ON true)
SELECT id, kind, name, position, CASE WHEN d IS NULL THEN NULL WHEN regexp_extract(d, {_re2(D.PARAMETER)}, 1) = '' THEN 'IN'
                                      ELSE upper(regexp_extract(d, {_re2(D.PARAMETER)}, 1)) END AS direction,
       regexp_extract(d, {_re2(D.PARAMETER)}, 2) AS param_name,
       upper(regexp_replace(regexp_extract(d, {_re2(D.PARAMETER)}, 3), '\\s+', '', 'g')) AS param_type, returns, body FROM q""")
def e11_ddl_procedures(spark, sf_dir):
    return D.ddl_procedures(_ddl(_t(spark, sf_dir)), "id", "text")


# Manifests and lock files; {k}, {n}, {m}, {s} and {f} stand for the part's key, name, key mod 7, size and key mod 5.
_MANIFESTS = (
    ("pkgs/{k}/package.json", """{"dependencies": {"{n}": "^1.{s}.0"}, "devDependencies": {"jest-{m}": "~29.0.0"}, "peerDependencies": {}}""", None),
    ("pkgs/{k}/package-lock.json", """{"lockfileVersion": 1, "dependencies": {"{n}": {"version": "1.{s}.0", "requires": {"b": "^1.0.0", "gone": "*"},
      "dependencies": {"b": {"version": "1.{m}.0", "requires": {"c": "*"}, "dependencies": {"c": {"version": "9.0.{f}"}}}}},
      "b": {"version": "2.0.0", "requires": {"c": "^1"}}, "c": {"version": "1.1.1"}}}""", 5),
    ("lock2/{k}/package-lock.json", """{"lockfileVersion": 2, "packages": {"": {"devDependencies": {"jest-{m}": "*"}},
      "node_modules/jest-{m}": {"version": "29.0.{s}", "dependencies": {"@s/b": "^1", "c": "1"}},
      "node_modules/jest-{m}/node_modules/@s/b": {"version": "1.0.0", "dependencies": {"c": "*"}}, "node_modules/c": {"version": "{f}.0.0"}},
      "dependencies": {}}""", 3),
    ("py/{k}/requirements.txt", "# deps\n{n}==1.{s}\nflask[async] >= 2.0\n-r base.txt\n", None),
    ("py/{k}/Pipfile", "[[source]]\nurl = \"x\"\n\n[packages]\n{n} = \"==1.{s}\"\nflask = {version = \">=2\", extras = [\"a\"]}\nbare = {path = \".\"}\n\n"
                       "[dev-packages]\npytest = \"*\"\n", 4),
    ("py/{k}/pyproject.toml", "[project]\nname = \"x\"\ndependencies = [\n  \"{n}[a]>=1.{s}; python_version > '3'\",\n  \"flask (==2.0)\",\n]\n"
                              "[project.optional-dependencies]\ndev = [\"pytest\"]\ndocs = [\"mkdocs>=1\"]\n"
                              "[tool.poetry.dependencies]\npython = \"^3.9\"\nrich = \"^{m}\"\n[tool.poetry.group.test.dependencies]\n"
                              "tox = {version = \"4.{f}\"}\n", 4),
    ("net/{k}/App.csproj", """<Project><ItemGroup><PackageReference Include="Pkg{s}" Version="3.{f}.0" /><PackageReference Include="NoVersion" />
      <PackageReference PrivateAssets="All" Include="Tool" Version="1"/></ItemGroup></Project>""", None),
    ("net/{k}/packages.config", """<packages><package id="Old{s}" version="1.{f}" targetFramework="net48" /></packages>""", 6),
)
_MARKS_SQL = (("{k}", "CAST(p_partkey AS VARCHAR)"), ("{n}", "replace(p_name, ' ', '-')"), ("{m}", "CAST(p_partkey % 7 AS VARCHAR)"),
              ("{s}", "CAST(p_size AS VARCHAR)"), ("{f}", "CAST(p_partkey % 5 AS VARCHAR)"))


def _filled_sql(text: str) -> str:
    out = sq(text)
    for mark, value in _MARKS_SQL:
        out = f"replace({out}, '{mark}', {value})"
    return out


MANIFESTS_SQL = "(" + " UNION ALL ".join(
    f"SELECT {_filled_sql(path)} AS path, {_filled_sql(text)} AS content FROM part" + (f" WHERE p_partkey % {every} = 0" if every else "")
    for path, text, every in _MANIFESTS) + ")"


def _manifests(t):
    marks = (("{k}", F.col("p_partkey").cast("string")), ("{n}", F.replace("p_name", F.lit(" "), F.lit("-"))),
             ("{m}", (F.col("p_partkey") % 7).cast("string")), ("{s}", F.col("p_size").cast("string")),
             ("{f}", (F.col("p_partkey") % 5).cast("string")))

    def filled(text):
        out = F.lit(text)
        for mark, value in marks:
            out = F.replace(out, F.lit(mark), value)
        return out
    every = F.array(*[F.struct(filled(path).alias("path"), filled(text).alias("content"),
                               (F.col("p_partkey") % (n or 1) == 0).alias("on")) for path, text, n in _MANIFESTS])
    return spread(t.part.select("p_partkey", "p_name", "p_size")).select(F.explode(every).alias("f")).where("f.on").select("f.path", "f.content")


_REQ = sq(M.REQ_LINE)
_DEV = ", ".join(sq(x) for x in M.DEV_GROUPS)
# the nodes of lock files: version 1 opened by recursion, version 2 by path
LOCK_NODES_CTES = r"""locks AS (SELECT path, content::JSON AS d FROM m WHERE lower(split_part(path, '/', -1)) = 'package-lock.json'),
roots AS (SELECT locks.path, json_keys(e.value, '$.devDependencies') AS dev FROM locks, json_each(d, '$.packages') e WHERE e.key = ''),
tree(path, node, package, parent, version, requires, deps) AS (
  SELECT locks.path, 'node_modules/' || e.key, e.key, '', e.value->>'$.version', e.value->'$.requires', e.value->'$.dependencies'
  FROM locks, json_each(d, '$.dependencies') e WHERE (d->'$.packages') IS NULL
  UNION ALL
  SELECT tree.path, node || '/node_modules/' || e.key, e.key, node, e.value->>'$.version', e.value->'$.requires', e.value->'$.dependencies'
  FROM tree, json_each(deps) e WHERE deps IS NOT NULL),
nodes AS (SELECT path, node, package, parent, version, requires, false AS is_dev_dependency FROM tree
  UNION ALL
  SELECT locks.path, e.key, split_part(e.key, 'node_modules/', -1), '', e.value->>'$.version', e.value->'$.dependencies',
         coalesce(list_contains(roots.dev, split_part(e.key, 'node_modules/', -1)), false)
  FROM locks LEFT JOIN roots ON roots.path = locks.path, json_each(d, '$.packages') e WHERE (d->'$.packages') IS NOT NULL AND e.key <> ''),
deep AS (SELECT *, CAST(len(string_split(node, 'node_modules/')) - 2 AS INTEGER) AS depth FROM nodes)"""


@register("e07_extract_dependencies", sql=f"""
WITH RECURSIVE m AS {MANIFESTS_SQL}, {LOCK_NODES_CTES},
f AS (SELECT path, content, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, lower(split_part(path, '/', -1)) AS base FROM m),
npm AS (SELECT * FROM f WHERE base = 'package.json' AND dir NOT IN (SELECT dir FROM f WHERE base = 'package-lock.json')),
npmd AS (SELECT npm.path, e.key AS package, NULL::VARCHAR AS version, json_extract_string(e.value, '$') AS version_constraint,
                g.dev AS is_dev_dependency, 'npm' AS dependency_type
         FROM npm, (VALUES ('dependencies', false), ('devDependencies', true), ('peerDependencies', false)) g(field, dev),
              json_each(npm.content::JSON, '$.' || g.field) e),
rl AS (SELECT path, trim(unnest(string_split(content, chr(10)))) AS l, false AS dev FROM f WHERE ends_with(base, '.txt') AND contains(base, 'requirements')),
sec AS (SELECT path, base, regexp_extract(x, '^\\[([^\\]]+)\\]', 1) AS name, x AS body FROM (
          SELECT path, base, unnest(string_split(regexp_replace(content, {sq(M.SECTION)}, chr(1) || '\\1', 'g'), chr(1))) AS x
          FROM f WHERE base IN ('pipfile', 'pyproject.toml')) WHERE starts_with(x, '[')),
arr AS (SELECT path, name, unnest(regexp_extract_all(body, {sq('(?m)' + M.ARRAY.replace('*+', '*'))}, 1)) AS arr,
               unnest(regexp_extract_all(body, {sq('(?m)' + M.ARRAY.replace('*+', '*'))}, 2)) AS items FROM sec WHERE base = 'pyproject.toml'),
al AS (SELECT path, trim(regexp_replace(split_part(x, ';', 1), '[()]', ' ', 'g')) AS l, name <> 'project' AND arr IN ({_DEV}) AS dev FROM (
         SELECT *, unnest(regexp_extract_all(items, '"([^"]*)"', 1)) AS x FROM arr
         WHERE name = 'project.optional-dependencies' OR (name = 'project' AND arr = 'dependencies'))),
pl AS (SELECT * FROM rl WHERE l <> '' AND NOT starts_with(l, '#') AND NOT starts_with(l, '-r ') AND NOT starts_with(l, '-c ')
         AND NOT starts_with(l, '-e ') AND NOT starts_with(l, '--') UNION ALL SELECT * FROM al),
pip AS (SELECT path, regexp_extract(l, {_REQ}, 1) AS package, trim(regexp_extract(l, {_REQ}, 2)) AS spec, dev FROM pl WHERE regexp_matches(l, {_REQ})),
ent AS (SELECT path, base, regexp_extract(l, {sq(M.ENTRY)}, 1) AS package, trim(regexp_extract(l, {sq(M.ENTRY)}, 2)) AS v,
               name IN ('dev-packages', 'tool.poetry.dev-dependencies') OR starts_with(name, 'tool.poetry.group.') AS dev
        FROM (SELECT *, trim(unnest(string_split(body, chr(10)))) AS l FROM sec)
        WHERE regexp_matches(l, {sq(M.ENTRY)}) AND ((base = 'pipfile' AND name IN ('packages', 'dev-packages')) OR (base = 'pyproject.toml'
          AND (name IN ('tool.poetry.dependencies', 'tool.poetry.dev-dependencies') OR regexp_matches(name, '^tool\\.poetry\\.group\\.[^.]+\\.dependencies$'))))),
entd AS (SELECT path, package, NULL::VARCHAR AS version, nullif(CASE WHEN starts_with(v, '"') THEN regexp_extract(v, '^"([^"]*)"', 1)
           WHEN starts_with(v, '{{') THEN coalesce(nullif(regexp_extract(v, 'version\\s*=\\s*"([^"]*)"', 1), ''), CASE base WHEN 'pipfile' THEN '*' ELSE '' END)
           ELSE v END, '') AS version_constraint, dev, 'pip' AS t FROM ent WHERE package <> 'python'),
xml AS (SELECT path, unnest(regexp_extract_all(content, {sq(M.PACKAGE_REFERENCE)}, 0)) AS tag,
               unnest(regexp_extract_all(content, {sq(M.PACKAGE_REFERENCE)}, 1)) AS package FROM f WHERE ends_with(base, '.csproj')
        UNION ALL SELECT path, unnest(regexp_extract_all(content, {sq(M.PACKAGE_ELEMENT)}, 0)), unnest(regexp_extract_all(content, {sq(M.PACKAGE_ELEMENT)}, 1))
        FROM f WHERE base = 'packages.config'),
allrows AS (SELECT * FROM npmd
  UNION ALL SELECT path, package, CASE WHEN contains(spec, '==') THEN trim(split_part(spec, '==', 2)) END, nullif(spec, ''), dev, 'pip' FROM pip
  UNION ALL SELECT * FROM entd
  UNION ALL SELECT path, package, nullif(regexp_extract(tag, {sq(M.VERSION_ATTRIBUTE)}, 1), ''), nullif(regexp_extract(tag, {sq(M.VERSION_ATTRIBUTE)}, 1), ''),
                   regexp_matches(tag, {sq(M.DEV_ATTRIBUTE)}), 'nuget' FROM xml)
SELECT path, package, version, version_constraint, is_dev_dependency, false AS is_transitive, 0 AS depth, dependency_type FROM allrows
UNION ALL SELECT path, package, version, version, is_dev_dependency, depth > 0, depth, 'npm' FROM deep""")
def e07_extract_dependencies(spark, sf_dir):
    return M.extract_dependencies(_manifests(_t(spark, sf_dir)))


@register("e07_lock_requirements", sql=f"""
WITH RECURSIVE m AS {MANIFESTS_SQL}, {LOCK_NODES_CTES},
req AS (SELECT nodes.path, node, e.key AS package, e.value->>'$' AS range FROM nodes, json_each(requires) e WHERE requires IS NOT NULL),
up AS (SELECT r.*, n.node AS found, n.version, coalesce(length(regexp_replace(n.node, '/?node_modules/' || r.package || '$', '')), 0) AS len,
              regexp_replace(n.node, '/?node_modules/' || r.package || '$', '') AS folder
       FROM req r JOIN nodes n ON n.path = r.path AND n.package = r.package
       WHERE regexp_replace(n.node, '/?node_modules/' || r.package || '$', '') = '' OR r.node = regexp_replace(n.node, '/?node_modules/' || r.package || '$', '')
          OR starts_with(r.node, regexp_replace(n.node, '/?node_modules/' || r.package || '$', '') || '/')),
b AS (SELECT path, node, package, arg_max(struct_pack(found := found, version := version, folder := folder), len) AS b FROM up GROUP BY ALL)
SELECT path, node, package, range, b.found AS served_by, b.version AS version, CASE WHEN b.found IS NOT NULL THEN b.folder <> node END AS hoisted
FROM req LEFT JOIN b USING (path, node, package)""")
def e07_lock_requirements(spark, sf_dir):
    return M.lock_requirements(_manifests(_t(spark, sf_dir)))
