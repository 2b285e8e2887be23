"""Registered scalar-expression and extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlens.functions import code as X
from meshlens.functions.text import WORD_RE, first_n_and_more, mask, token_estimate, tokenize, truncate
from meshlens.functions.urls import image_name, normalize_url, service_host
from meshlens.functions.vectors import cosine
from meshlens.operators import calls as K
from meshlens.operators import aggregates as A
from meshlens.operators import extract as E
from meshlens.operators import relational as R
from meshlens.operators.search import keyword_score, query_vector
from meshlens.plans.catalog import register
from meshlens.plans.oracle_views import norm_url_sql
from meshlens.sources import probes
from meshlens.sources.tables import load_tables


def sq(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def _t(spark, sf_dir):
    return load_tables(spark, sf_dir)


CTX_SQL = "(SELECT s.*, f.path, f.repository, f.language FROM v_symbols s JOIN v_files f ON s.file_id = f.id)"
LINES_SQL = """(SELECT {id} AS id, CAST(generate_subscripts(string_split({text}, chr(10)), 1) AS BIGINT) AS line_no,
  unnest(string_split({text}, chr(10))) AS line FROM {src} {where})"""

# ----------------------------------------------------------------------------- X-*

_STOP = ", ".join(sq(w) for w in __import__("meshlens.functions.text", fromlist=["x"]).QUERY_STOP_WORDS)


@register("x01_tokenize", sql=f"""
SELECT id, CAST(len(toks) AS BIGINT) AS n_tokens, sha256(array_to_string(toks, ' ')) AS tokens_sha
FROM (SELECT id, list_filter(regexp_extract_all(lower(content), {sq(WORD_RE)}, 0),
                             lambda t: NOT list_contains([{_STOP}], t) AND length(t) >= 2) AS toks FROM v_files)""")
def x01_tokenize(spark, sf_dir):
    f = probes.v_files(_t(spark, sf_dir))
    toks = tokenize(F.col("content"))
    return f.select("id", F.size(toks).cast("bigint").alias("n_tokens"),
                    F.sha2(F.array_join(toks, " "), 256).alias("tokens_sha"))


@register("x02_keyword_score", sql="""
SELECT id,
  (CASE WHEN lower(name) = 'red widget' THEN 10.0 WHEN contains(lower(name), 'red widget') THEN 5.0
        WHEN contains(lower(coalesce(fqn, '')), 'red widget') THEN 4.0
        WHEN contains(lower(coalesce(signature, '')), 'red widget') THEN 2.0
        WHEN contains(lower(coalesce(documentation, '')), 'red widget') THEN 1.0 ELSE 0.0 END)
  + t1 + t2 + ((CASE WHEN t1 > 0 THEN 1 ELSE 0 END) + (CASE WHEN t2 > 0 THEN 1 ELSE 0 END)) / 2.0 * 3.0 AS score
FROM (SELECT *,
  CASE WHEN contains(lower(name), 'red') THEN 2.0 WHEN contains(lower(coalesce(fqn, '')), 'red') THEN 1.5
       WHEN contains(lower(coalesce(signature, '')), 'red') THEN 1.0
       WHEN contains(lower(coalesce(documentation, '')), 'red') THEN 0.5 ELSE 0.0 END AS t1,
  CASE WHEN contains(lower(name), 'widget') THEN 2.0 WHEN contains(lower(coalesce(fqn, '')), 'widget') THEN 1.5
       WHEN contains(lower(coalesce(signature, '')), 'widget') THEN 1.0
       WHEN contains(lower(coalesce(documentation, '')), 'widget') THEN 0.5 ELSE 0.0 END AS t2
  FROM v_symbols)""")
def x02_keyword_score(spark, sf_dir):
    s = probes.v_symbols(_t(spark, sf_dir))
    return s.select("id", keyword_score("red widget").cast("double").alias("score"))


@register("x03_normalize_url", sql=f"SELECT id, {norm_url_sql('path')} AS route FROM v_calls")
def x03_normalize_url(spark, sf_dir):
    c = probes.v_calls(_t(spark, sf_dir))
    return c.select("id", normalize_url(F.col("path")).alias("route"))


@register("x10_service_host", sql="""
SELECT id, regexp_extract(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^([^/:]*)', 1) AS host FROM v_calls""")
def x10_service_host(spark, sf_dir):
    c = probes.v_calls(_t(spark, sf_dir))
    return c.select("id", service_host(F.col("url")).alias("host"))


IMAGE_SQL = "(SELECT id, host || '/' || split_part(trim(path, '/'), '/', 1) || ':v' || CAST(id % 3 AS VARCHAR) AS image FROM v_calls)"


@register("x11_image_name", sql=f"""
SELECT id, split_part(split_part(image, '/', -1), ':', 1) AS image_name FROM {IMAGE_SQL}""")
def x11_image_name(spark, sf_dir):
    c = probes.v_calls(_t(spark, sf_dir))
    img = F.concat(F.col("host"), F.lit("/"),
                   F.element_at(F.split(F.regexp_replace("path", r"^/+|/+$", ""), "/"), 1),
                   F.lit(":v"), (F.col("id") % 3).cast("string"))
    return c.select("id", image_name(img).alias("image_name"))


@register("x12_layer", sql=f"""
SELECT id, {X.layer_sql('name', 'parent_name', 'path', 'kind')} AS layer FROM v_named""")
def x12_layer(spark, sf_dir):
    return probes.v_named(_t(spark, sf_dir)).select("id", X.layer(F.col("name"), F.col("parent_name"), F.col("path"), F.col("kind")).alias("layer"))


@register("x13_roles", sql=f"""
SELECT id, array_to_string({X.roles_sql('fqn', 'name')}, ',') AS roles FROM v_named""")
def x13_roles(spark, sf_dir):
    s = probes.v_named(_t(spark, sf_dir))
    return s.select("id", F.array_join(X.roles(F.col("fqn"), F.col("name")), ",").alias("roles"))


def _lang_sql(path: str) -> str:
    base = f"lower(split_part({path}, '/', -1))"
    suf = f"lower(regexp_extract(split_part({path}, '/', -1), '(?:.)(\\.[^.]*)$', 1))"
    cases = " ".join(f"WHEN {suf} = '{k}' THEN '{v}'" for k, v in X.EXTENSION_LANGUAGE)
    return (f"CASE WHEN {suf} = '.json' THEN (CASE WHEN starts_with({base}, 'appsettings') THEN 'CSHARP' "
            f"ELSE 'JAVASCRIPT' END) {cases} ELSE 'UNKNOWN' END")


@register("x14_language_of", sql=f"""
SELECT id, {_lang_sql('path')} AS language FROM v_tree""")
def x14_language_of(spark, sf_dir):
    c = probes.v_tree(_t(spark, sf_dir))
    return c.select("id", X.language_of(F.col("path")).alias("language"))


@register("x15_is_external", sql=f"""
SELECT id, {X.contains_any_sql("lower(coalesce(path, ''))", [i.lower() for i in X.EXTERNAL_INDICATORS])}
        OR {X.contains_any_sql("lower(coalesce(fqn, ''))", [i.lower() for i in X.EXTERNAL_INDICATORS])} AS is_external
FROM v_named""")
def x15_is_external(spark, sf_dir):
    return probes.v_named(_t(spark, sf_dir)).select("id", X.is_external(F.col("path"), F.col("fqn")).alias("is_external"))


@register("x16_edge_confidence", sql=f"""
SELECT e.src, e.dst, e.type,
  round(least(0.5 + CASE WHEN coalesce(c.signature, '') <> '' THEN 0.1 ELSE 0.0 END
             + CASE WHEN coalesce(c.documentation, '') <> '' THEN 0.1 ELSE 0.0 END
             + CASE WHEN contains(upper(e.type), 'CALL') THEN 0.2 ELSE 0.0 END
             + CASE WHEN {X.contains_any_sql("lower(coalesce(c.path, ''))", X.STANDARD_PATHS)} THEN 0.1 ELSE 0.0 END,
             1.0), 4)::DOUBLE AS confidence
FROM v_edges e JOIN {CTX_SQL} c ON c.id = e.dst""")
def x16_edge_confidence(spark, sf_dir):
    t = _t(spark, sf_dir)
    ctx = R.symbol_context(probes.v_symbols(t), probes.v_files(t)).select(
        F.col("id").alias("dst"), "signature", "documentation", "path")
    e = probes.v_edges(t).join(ctx, "dst")
    return e.select("src", "dst", "type", X.edge_confidence(F.col("signature"), F.col("documentation"),
                                                            F.col("type"), F.col("path")).alias("confidence"))


@register("x17_token_estimate", sql="""
SELECT id, CAST(CASE WHEN t = 0 THEN 20 ELSE t END AS BIGINT) AS sig_tokens
FROM (SELECT id, (coalesce(length(signature), 0) + coalesce(CASE WHEN length(documentation) < 200
      THEN length(documentation) ELSE 0 END, 0)) // 4 AS t FROM v_symbols)""")
def x17_token_estimate(spark, sf_dir):
    s = probes.v_symbols(_t(spark, sf_dir))
    return s.select("id", X.token_estimate_signature(F.col("signature"), F.col("documentation")).alias("sig_tokens"))


@register("x17_code_tokens", sql="SELECT id, CAST(length(content) // 4 AS BIGINT) AS code_tokens FROM v_files")
def x17_code_tokens(spark, sf_dir):
    f = probes.v_files(_t(spark, sf_dir))
    return f.select("id", token_estimate(F.col("content")).alias("code_tokens"))


@register("x18_namespace_public", sql="""
SELECT id, regexp_extract(fqn, '^(.*)\\.[^.]*$', 1) AS namespace, coalesce(lower(access) IN ('public', 'protected'), false) AS is_public
FROM v_symbols""")
def x18_namespace_public(spark, sf_dir):
    s = probes.v_symbols(_t(spark, sf_dir))
    return s.select("id", X.namespace_of(F.col("fqn")).alias("namespace"),
                    F.coalesce(X.is_public(F.col("access")), F.lit(False)).alias("is_public"))


SIG_SQL = """(SELECT p_partkey AS id, CASE p_partkey % 3
   WHEN 0 THEN 'public class C' || CAST(p_partkey AS VARCHAR) || ' : ' || replace(p_brand, '#', '') || ', I' || p_type || ' {'
   WHEN 1 THEN 'class C' || CAST(p_partkey AS VARCHAR) || ' extends ' || replace(p_brand, '#', '') || ' implements I' || p_type || ', IOther {'
   ELSE 'function ' || replace(p_name, ' ', '_') || '()' END AS signature FROM part)"""


def _sigs(t):
    p = t.part
    k = F.col("p_partkey")
    brand = F.regexp_replace("p_brand", "#", "")
    sig = (F.when(k % 3 == 0, F.concat(F.lit("public class C"), k.cast("string"), F.lit(" : "), brand,
                                       F.lit(", I"), F.col("p_type"), F.lit(" {")))
           .when(k % 3 == 1, F.concat(F.lit("class C"), k.cast("string"), F.lit(" extends "), brand,
                                      F.lit(" implements I"), F.col("p_type"), F.lit(", IOther {")))
           .otherwise(F.concat(F.lit("function "), F.regexp_replace("p_name", " ", "_"), F.lit("()"))))
    return p.select(k.alias("id"), sig.alias("signature"))


def _base_types_sql(sig: str) -> str:
    colon = f"string_split(trim(split_part(split_part({sig}, ':', 2), '{{', 1)), ',')"
    ext = f"[trim(split_part(split_part(split_part({sig}, 'extends', 2), '{{', 1), 'implements', 1))]"
    impl = f"string_split(trim(split_part(split_part({sig}, 'implements', 2), '{{', 1)), ',')"
    first = f"CASE WHEN contains({sig}, ':') THEN {colon} WHEN contains({sig}, 'extends') THEN {ext} ELSE [] END"
    rest = f"CASE WHEN contains({sig}, 'implements') THEN {impl} ELSE [] END"
    return f"list_filter(list_transform(list_concat({first}, {rest}), lambda x: trim(x)), lambda x: x <> '')"


@register("x19_base_types", sql=f"""
SELECT id, array_to_string({_base_types_sql('signature')}, '|') AS base_types FROM {SIG_SQL}""")
def x19_base_types(spark, sf_dir):
    s = _sigs(_t(spark, sf_dir))
    return s.select("id", F.array_join(X.base_types(F.col("signature")), "|").alias("base_types"))


@register("x20_clean_type", sql="""
SELECT p_partkey AS id, CASE WHEN t IN ('void', 'string', 'int', 'bool', 'var', 'object', 'Task', 'List', 'IEnumerable',
  'IQueryable') OR t = '' THEN NULL ELSE t END AS clean_type
FROM (SELECT p_partkey, trim(split_part(split_part(raw, '[', 1), '<', 1)) AS t FROM
      (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_type || '<int>' WHEN 1 THEN p_type || '[]'
                               WHEN 2 THEN 'List<' || p_type || '>' ELSE ' ' || p_type END AS raw FROM part))""")
def x20_clean_type(spark, sf_dir):
    p = _t(spark, sf_dir).part
    k = F.col("p_partkey")
    raw = (F.when(k % 4 == 0, F.concat("p_type", F.lit("<int>"))).when(k % 4 == 1, F.concat("p_type", F.lit("[]")))
           .when(k % 4 == 2, F.concat(F.lit("List<"), F.col("p_type"), F.lit(">")))
           .otherwise(F.concat(F.lit(" "), F.col("p_type"))))
    return p.select(k.alias("id"), X.clean_type(raw).alias("clean_type"))


@register("x21_content_hash", sql="SELECT id, sha256(content) AS content_hash FROM v_files")
def x21_content_hash(spark, sf_dir):
    f = probes.v_files(_t(spark, sf_dir))
    return f.select("id", F.sha2(F.col("content"), 256).alias("content_hash"))


@register("x22_mask", sql="""
SELECT c_custkey, CASE WHEN length(c_name) <= 4 THEN repeat('*', length(c_name))
  ELSE left(c_name, 4) || repeat('*', greatest(length(c_name) - 8, 0)) || right(c_name, 4) END AS masked
FROM customer""")
def x22_mask(spark, sf_dir):
    c = _t(spark, sf_dir).customer
    return c.select("c_custkey", mask(F.col("c_name")).alias("masked"))


@register("x23_truncate", sql="SELECT id, left(content, 100) AS preview FROM v_files")
def x23_truncate(spark, sf_dir):
    f = probes.v_files(_t(spark, sf_dir))
    return f.select("id", truncate(F.col("content"), 100).alias("preview"))


def _size_sql(x: str) -> str:
    units = ["B", "KB", "MB", "GB", "TB"]
    parts = [f"WHEN {x} < {1024.0 ** (i + 1)} THEN printf('%.1f', {x} / {1024.0 ** i}) || ' {u}'"
             for i, u in enumerate(units)]
    return "CASE " + " ".join(parts) + f" ELSE printf('%.1f', {x} / {1024.0 ** 5}) || ' PB' END"


@register("x24_format_size", sql=f"""
SELECT id, {_size_sql('CAST(size_bytes * 97 AS DOUBLE)')} AS size_text FROM v_files""")
def x24_format_size(spark, sf_dir):
    f = probes.v_files(_t(spark, sf_dir))
    return f.select("id", A.format_size(F.col("size_bytes") * 97).alias("size_text"))


@register("x24_http_verb", sql="""
SELECT id, CASE WHEN starts_with(m, 'Get') THEN 'GET' WHEN starts_with(m, 'Post') THEN 'POST'
  WHEN starts_with(m, 'Put') THEN 'PUT' WHEN starts_with(m, 'Delete') THEN 'DELETE'
  WHEN starts_with(m, 'Patch') THEN 'PATCH' ELSE 'HTTP' END AS verb
FROM (SELECT id, CASE id % 6 WHEN 0 THEN 'Get' WHEN 1 THEN 'Post' WHEN 2 THEN 'Put' WHEN 3 THEN 'Delete'
                  WHEN 4 THEN 'Patch' ELSE 'Find' END || replace(name, ' ', '') AS m FROM v_symbols)""")
def x24_http_verb(spark, sf_dir):
    s = probes.v_symbols(_t(spark, sf_dir))
    pre = (F.when(F.col("id") % 6 == 0, "Get").when(F.col("id") % 6 == 1, "Post").when(F.col("id") % 6 == 2, "Put")
           .when(F.col("id") % 6 == 3, "Delete").when(F.col("id") % 6 == 4, "Patch").otherwise("Find"))
    m = F.concat(pre, F.regexp_replace("name", " ", ""))
    return s.select("id", X.http_verb(m).alias("verb"))


@register("x25_normalize_guid_path", sql="""
SELECT id, upper(trim(regexp_replace('{' || md5(path) || '}', '[{}]', '', 'g'))) AS guid,
  array_to_string(list_reduce(list_filter(string_split(repository || '/sln/' ||
      replace(language || '\\..\\' || language || '\\.\\proj' || CAST(id % 3 AS VARCHAR) || '.csproj', '\\', '/'), '/'),
      lambda s: s <> '' AND s <> '.'),
    lambda acc, s: CASE WHEN s = '..' THEN acc[1:greatest(len(acc) - 1, 0)] ELSE list_append(acc, s) END,
    []::VARCHAR[]), '/') AS project_path
FROM v_files""")
def x25_normalize_guid_path(spark, sf_dir):
    f = probes.v_files(_t(spark, sf_dir))
    rel = F.concat(F.col("language"), F.lit("\\..\\"), F.col("language"), F.lit("\\.\\proj"),
                   (F.col("id") % 3).cast("string"), F.lit(".csproj"))
    return f.select("id", X.normalize_guid(F.concat(F.lit("{"), F.md5("path"), F.lit("}"))).alias("guid"),
                    X.normalize_project_path(rel, F.concat(F.col("repository"), F.lit("/sln"))).alias("project_path"))


@register("x26_cosine", sql="""
SELECT symbol_id, round(list_cosine_similarity(vector::DOUBLE[], (SELECT vector::DOUBLE[] FROM v_vec WHERE chunk_id = 0)), 6) AS cosine
FROM v_vec""")
def x26_cosine(spark, sf_dir):
    v = probes.v_vec(_t(spark, sf_dir))
    q = query_vector(v, "chunk_id", 0)
    return v.select("symbol_id", F.round(cosine(F.col("vector"), q), 6).alias("cosine"))


ENV_FILE_SQL = "'appsettings.' || event_type || '.json'"


@register("x29_environment_of", sql=f"""
SELECT id, CASE WHEN len(p) > 2 AND p[-1] = 'json' AND p[-2] NOT IN ('appsettings', 'json') THEN p[-2]
  ELSE 'default' END AS environment
FROM (SELECT id, string_split(lower(CASE WHEN id % 5 = 0 THEN 'appsettings.json' ELSE {ENV_FILE_SQL} END), '.') AS p FROM v_json)""")
def x29_environment_of(spark, sf_dir):
    j = probes.v_json(_t(spark, sf_dir))
    name = F.when(F.col("id") % 5 == 0, F.lit("appsettings.json")).otherwise(
        F.concat(F.lit("appsettings."), F.col("event_type"), F.lit(".json")))
    return j.select("id", X.environment_of(name).alias("environment"))


@register("x31_first_n_and_more", sql="""
SELECT conv_id, turn, CASE WHEN len(w) - 5 > 0 THEN array_to_string(w[1:5], ', ') || ' ... and '
  || CAST(len(w) - 5 AS VARCHAR) || ' more' ELSE array_to_string(w[1:5], ', ') END AS words
FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM v_turns)""")
def x31_first_n_and_more(spark, sf_dir):
    tr = probes.v_turns(_t(spark, sf_dir))
    return tr.select("conv_id", "turn", first_n_and_more(F.split("text", " ")).alias("words"))


# ----------------------------------------------------------------------------- E-*

def _calls_sql(rules, src: str, id_expr: str, text: str) -> str:
    """Every rule over whole texts: line = 1 + line breaks in the pieces and matches before."""
    breaks = "(length({x}) - length(replace({x}, chr(10), '')))"
    parts = []
    for r in rules:
        rx = sq(r.re2)
        verbs = "".join(f"nullif(regexp_extract_all(t, {rx}, {g})[i], ''), " for g in r.verbs)
        url = sq(r.fixed_url) if r.fixed_url else f"{sq(r.prefix)} || regexp_extract_all(t, {rx}, {r.url})[i]"
        parts.append(
            f"SELECT id, CAST(1 + coalesce(list_sum(list_transform(p[1:i], lambda x: {breaks.format(x='x')})), 0) "
            f"+ coalesce(list_sum(list_transform(h[1:i - 1], lambda x: {breaks.format(x='x')})), 0) AS BIGINT) AS line_no, "
            f"{sq(r.library)} AS library, upper(coalesce({verbs}{sq(r.verb)})) AS http_method, {url} AS url_pattern "
            f"FROM (SELECT id, t, p, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT id, t, string_split_regex(t, {rx}) AS p, "
            f"regexp_extract_all(t, {rx}) AS h FROM l WHERE regexp_matches(t, {rx})))")
    return (f"WITH l AS (SELECT {id_expr} AS id, {text} AS t FROM {src}), c AS ({' UNION ALL '.join(parts)})\n"
            "SELECT *, (contains(url_pattern, '{') OR contains(url_pattern, '$')) AS is_dynamic_url FROM c")


ALL_CALL_RULES = K.CSHARP_CALL_RULES + K.JS_CALL_RULES


@register("e02_extract_http_calls", sql=_calls_sql(ALL_CALL_RULES, "pages", "page_id", "html"))
def e02_extract_http_calls(spark, sf_dir):
    pg = _t(spark, sf_dir).pages.withColumnRenamed("page_id", "id")
    return K.extract_calls(pg, "id", "html", ALL_CALL_RULES).withColumn("line_no", F.col("line_no").cast("bigint"))


@register("e02_extract_client_calls", sql=_calls_sql(K.CSHARP_CALL_RULES, "v_code", "id", "content"))
def e02_extract_client_calls(spark, sf_dir):
    c = probes.v_code(_t(spark, sf_dir))
    return K.extract_calls(c, "id", "content", K.CSHARP_CALL_RULES).withColumn("line_no", F.col("line_no").cast("bigint"))


@register("e03_extract_js_calls", sql=_calls_sql(K.JS_CALL_RULES, "v_code", "id", "content"))
def e03_extract_js_calls(spark, sf_dir):
    c = probes.v_code(_t(spark, sf_dir))
    return K.extract_calls(c, "id", "content", K.JS_CALL_RULES).withColumn("line_no", F.col("line_no").cast("bigint"))


@register("e05_extract_imports", sql=f"""
SELECT id, module, trim(name) AS name, 'named' AS kind FROM (
  SELECT id, z[1] AS module, unnest(string_split(z[2], ',')) AS name FROM (
    SELECT page_id AS id, unnest(list_zip(regexp_extract_all(html, {sq(E.IMPORT_NAMED)}, 2),
                                          regexp_extract_all(html, {sq(E.IMPORT_NAMED)}, 1))) AS z FROM pages))
WHERE trim(name) <> ''
UNION ALL SELECT id, z[1], z[2], 'default' FROM (
  SELECT page_id AS id, unnest(list_zip(regexp_extract_all(html, {sq(E.IMPORT_DEFAULT)}, 2),
                                        regexp_extract_all(html, {sq(E.IMPORT_DEFAULT)}, 1))) AS z FROM pages)
UNION ALL SELECT page_id, unnest(regexp_extract_all(html, {sq(E.USING_NS)}, 1)), NULL, 'using' FROM pages""")
def e05_extract_imports(spark, sf_dir):
    pg = _t(spark, sf_dir).pages.withColumnRenamed("page_id", "id")
    return E.extract_imports(pg, "id", "html")


SECTIONS_SQL = """
WITH l AS {lines},
l2 AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s FROM l),
l3 AS (SELECT *, starts_with(s, '#') AS is_boundary,
              sum(CASE WHEN starts_with(s, '#') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY line_no
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg FROM l2),
heads AS (SELECT id, seg, line_no AS start_line, CAST(length(regexp_extract(s, '^(#{{1,6}})\\s+(.+)$', 1)) AS BIGINT) AS level,
                 trim(regexp_extract(s, '^(#{{1,6}})\\s+(.+)$', 2)) AS title
          FROM l3 WHERE regexp_matches(s, '^(#{{1,6}})\\s+(.+)$')),
body AS (SELECT * FROM l3 WHERE NOT is_boundary AND seg > 0),
counts AS (SELECT id, seg, count(*) AS n_lines, min(line_no) AS first_line FROM body GROUP BY ALL),
firsts AS (SELECT b.id, b.seg, string_agg(b.line, chr(10) ORDER BY b.line_no) AS content
           FROM body b JOIN counts c USING (id, seg) GROUP BY ALL)
SELECT h.id AS doc_id, h.start_line, h.level, h.title, h.start_line + coalesce(c.n_lines, 0) AS end_line,
       coalesce(f.content, '') AS content
FROM heads h LEFT JOIN counts c USING (id, seg) LEFT JOIN firsts f USING (id, seg)"""


@register("e08_doc_sections", sql=SECTIONS_SQL.format(
    lines=LINES_SQL.format(id="doc_id", text="text", src="v_md", where="")))
def e08_doc_sections(spark, sf_dir):
    md = probes.v_md(_t(spark, sf_dir))
    out = E.doc_sections(md, "doc_id", "text")
    return out.select("doc_id", F.col("start_line").cast("bigint"), F.col("level").cast("bigint"), "title",
                      F.col("end_line").cast("bigint"), "content")


@register("e09_code_blocks", sql=f"""
WITH l AS {LINES_SQL.format(id="doc_id", text="text", src="v_md", where="")},
l2 AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s FROM l),
l3 AS (SELECT *, starts_with(s, '```') AS is_fence,
              sum(CASE WHEN starts_with(s, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY line_no
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nf FROM l2),
opens AS (SELECT id, CAST((nf + 1) // 2 AS INTEGER) AS block, line_no AS start_line,
                 coalesce(nullif(regexp_extract(s, '^```(\\w+)', 1), ''), 'unknown') AS language FROM l3 WHERE is_fence AND nf % 2 = 1),
closes AS (SELECT id, CAST(nf // 2 AS INTEGER) AS block, line_no AS end_line FROM l3 WHERE is_fence AND nf % 2 = 0),
inner_l AS (SELECT id, CAST((nf + 1) // 2 AS INTEGER) AS block, line_no, line FROM l3 WHERE NOT is_fence AND nf % 2 = 1),
counts AS (SELECT id, block, count(*) AS line_count, min(line_no) AS first_line FROM inner_l GROUP BY ALL),
firsts AS (SELECT i.id, i.block, string_agg(i.line, chr(10) ORDER BY i.line_no) AS code
           FROM inner_l i JOIN counts c USING (id, block) GROUP BY ALL)
SELECT o.id AS doc_id, o.start_line, c.end_line, o.language, n.line_count, f.code
FROM opens o JOIN closes c USING (id, block) JOIN counts n USING (id, block) JOIN firsts f USING (id, block)""")
def e09_code_blocks(spark, sf_dir):
    md = probes.v_md(_t(spark, sf_dir))
    out = E.code_blocks(md, "doc_id", "text")
    return out.select("doc_id", F.col("start_line").cast("bigint"), F.col("end_line").cast("bigint"), "language",
                      "line_count", "code")


MD_LINKS_SQL = "(SELECT page_id, regexp_replace(html, '<a href=\"([^\"]*)\">([^<]*)</a>', '[\\2](\\1)', 'g') AS md FROM pages)"


@register("e10_extract_links", sql=f"""
SELECT page_id, unnest(regexp_extract_all(md, {sq(E.LINK_INLINE)}, 2)) AS target, 'inline' AS kind FROM {MD_LINKS_SQL}
UNION ALL
SELECT page_id, unnest(regexp_extract_all(md, {sq(E.LINK_REF)}, 2)), 'reference' FROM {MD_LINKS_SQL}""")
def e10_extract_links(spark, sf_dir):
    pg = _t(spark, sf_dir).pages
    md = pg.select("page_id", F.regexp_replace("html", r'<a href="([^"]*)">([^<]*)</a>', "[$2]($1)").alias("md"))
    return E.extract_links(md, "page_id", "md")


# ----------------------------------------------------------------------------- chunking

@register("v06_chunk_words", sql="""
WITH d AS (SELECT doc_id, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS st FROM documents),
w AS (SELECT doc_id, text, string_split_regex(st, '\\s+') AS words,
             CASE WHEN st = '' THEN 0 ELSE len(string_split_regex(st, '\\s+')) END AS n FROM d)
SELECT doc_id, 0 AS chunk_no, text AS chunk, n AS n_words FROM w WHERE n <= 512
UNION ALL
SELECT doc_id, CAST(k AS INTEGER) AS chunk_no, array_to_string(words[s + 1:s + 512], ' ') AS chunk,
       least(512, n - s) AS n_words
FROM (SELECT doc_id, words, n, unnest(generate_series(0, n - 1, 462)) AS s,
             unnest(range(0, len(generate_series(0, n - 1, 462)))) AS k FROM w WHERE n > 512)""")
def v06_chunk_words(spark, sf_dir):
    d = _t(spark, sf_dir).documents
    return E.chunk_words(d, "doc_id", "text").select("doc_id", F.col("chunk_no").cast("int"), "chunk",
                                                    F.col("n_words").cast("bigint"))


@register("v07_chunk_lines", sql="""
SELECT doc_id, CAST(k AS INTEGER) AS chunk_no, s + 1 AS start_line, least(s + 50, len(l)) AS end_line,
       array_to_string(l[s + 1:s + 50], chr(10)) AS chunk
FROM (SELECT doc_id, l, unnest(generate_series(0, len(l) - 1, 50)) AS s,
             unnest(range(0, len(generate_series(0, len(l) - 1, 50)))) AS k
      FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""")
def v07_chunk_lines(spark, sf_dir):
    d = _t(spark, sf_dir).documents
    return E.chunk_lines(d, "doc_id", "text").select(
        "doc_id", F.col("chunk_no").cast("int"), F.col("start_line").cast("bigint"),
        F.col("end_line").cast("bigint"), "chunk")


# ----------------------------------------------------------------------------- X-27 / X-28 / E-06

from meshlens.functions.jsonflat import COMMENT_RE, TRAILING_COMMA_RE, flatten_json, strip_json_comments  # noqa: E402

CONFIG_TEXT_SQL = """('{ // settings' || chr(10) || '"App": {"Props": ' || json || ', "Tags": ["a", "b"], "Enabled": '
  || CASE WHEN id % 2 = 0 THEN 'true' ELSE 'false' END || ', "Missing": null, "Empty": {},' || chr(10)
  || '/* block */ "ApiToken": "tok' || CAST(id AS VARCHAR) || '", "Url": "http://h/x//y", '
  || '"ConnectionStrings": {"Default": "Server=db;Password=p' || CAST(user_id AS VARCHAR) || '"},}, "Version": 2.5,}')"""


def _config_text():
    return F.concat(
        F.lit('{ // settings\n"App": {"Props": '), F.col("json"), F.lit(', "Tags": ["a", "b"], "Enabled": '),
        F.when(F.col("id") % 2 == 0, F.lit("true")).otherwise(F.lit("false")),
        F.lit(', "Missing": null, "Empty": {},\n/* block */ "ApiToken": "tok'), F.col("id").cast("string"),
        F.lit('", "Url": "http://h/x//y", "ConnectionStrings": {"Default": "Server=db;Password=p'),
        F.col("user_id").cast("string"), F.lit('"},}, "Version": 2.5,}'))


CLEAN_SQL = (f"regexp_replace(regexp_replace({CONFIG_TEXT_SQL}, {sq(COMMENT_RE)}, '\\1', 'g'), "
             f"{sq(TRAILING_COMMA_RE)}, '\\1\\2', 'g')")
FLAT_SQL = f"""(SELECT c.id,
   ltrim(replace(regexp_replace(regexp_replace(t.fullkey, '^\\$', ''), '\\[([0-9]+)\\]', ':\\1', 'g'), '.', ':'), ':') AS key,
   json_extract_string(t.value, '$') AS value,
   CASE WHEN t.type = 'BOOLEAN' THEN 'boolean' WHEN t.type IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT', 'INTEGER')
        THEN 'number' ELSE 'string' END AS type
 FROM (SELECT id, {CLEAN_SQL} AS j FROM v_json) c, json_tree(c.j) t
 WHERE t.type NOT IN ('OBJECT', 'ARRAY'))"""


def _config_files(t):
    j = probes.v_json(t)
    return j.select("id", _config_text().alias("text"),
                    F.concat(F.lit("config/appsettings."), F.col("event_type"), F.lit(".json")).alias("file_name"))


@register("x27_flatten_json", sql=f"SELECT id, key, value, type FROM {FLAT_SQL}")
def x27_flatten_json(spark, sf_dir):
    f = _config_files(_t(spark, sf_dir)).select("id", strip_json_comments(F.col("text")).alias("j"))
    return flatten_json(f, "id", "j")


@register("x28_secret_keys", sql=f"""
SELECT DISTINCT key, {X.contains_any_sql('lower(key)', X.SECRET_KEY_TERMS)} AS is_secret FROM {FLAT_SQL}""")
def x28_secret_keys(spark, sf_dir):
    f = _config_files(_t(spark, sf_dir)).select("id", strip_json_comments(F.col("text")).alias("j"))
    return flatten_json(f, "id", "j").select("key", X.is_secret_key(F.col("key")).alias("is_secret")).distinct()


@register("e06_extract_config", sql=f"""
SELECT f.id, f.key AS config_key,
       CASE WHEN {X.contains_any_sql('lower(f.key)', X.SECRET_KEY_TERMS)} THEN '***' ELSE f.value END AS config_value,
       f.type AS config_type, lower(j.event_type) AS environment,
       CAST({X.contains_any_sql('lower(f.key)', X.SECRET_KEY_TERMS)} AS INTEGER) AS is_secret
FROM {FLAT_SQL} f JOIN v_json j ON j.id = f.id""")
def e06_extract_config(spark, sf_dir):
    return E.extract_config(_config_files(_t(spark, sf_dir)), "id", "text", "file_name")


# ----------------------------------------------------------------------------- X-04 / X-07 / X-08

from meshlens.functions.urls import (API_DOC, HTTP_ATTR_DOC, ROUTE_ATTR_DOC, SIG_ROUTE,  # noqa: E402
                                     combine_routes, controller_route, extract_route, normalize_template_url)

URL_TEXT_SQL = """(SELECT id, CASE id % 4 WHEN 0 THEN '"' || path || '"' WHEN 1 THEN '`${base}' || path || '/${id}`'
  WHEN 2 THEN 'base + "' || path || '" + suffix' ELSE 'apiUrl' END AS url_text FROM v_calls)"""


@register("x04_normalize_template_url", sql=r"""
WITH u AS (SELECT id, url_text, regexp_replace(trim(url_text), '^["''`]+|["''`]+$', '', 'g') AS clean FROM {src}),
p AS (SELECT *, array_to_string(list_transform(list_filter(string_split(url_text, '+'), lambda x: contains(x, '"') OR contains(x, '''')),
        lambda x: regexp_replace(trim(x), '^["'']+|["'']+$', '', 'g')), '') AS static FROM u)
SELECT id,
  CASE WHEN contains(clean, '${') OR contains(url_text, '`') THEN regexp_replace(clean, '\$\{[^}]+\}', '{var}', 'g')
       WHEN contains(url_text, '+') THEN CASE WHEN static = '' THEN '{dynamic_url}' ELSE static END
       WHEN NOT starts_with(clean, '/') AND NOT starts_with(clean, 'http') THEN '{variable_url}'
       ELSE clean END AS url,
  (contains(clean, '${') OR contains(url_text, '`') OR contains(url_text, '+')
   OR (NOT starts_with(clean, '/') AND NOT starts_with(clean, 'http'))) AS is_dynamic
FROM p""".replace("{src}", URL_TEXT_SQL))
def x04_normalize_template_url(spark, sf_dir):
    c = probes.v_calls(_t(spark, sf_dir))
    i = F.col("id")
    txt = (F.when(i % 4 == 0, F.concat(F.lit('"'), F.col("path"), F.lit('"')))
           .when(i % 4 == 1, F.concat(F.lit("`${base}"), F.col("path"), F.lit("/${id}`")))
           .when(i % 4 == 2, F.concat(F.lit('base + "'), F.col("path"), F.lit('" + suffix')))
           .otherwise(F.lit("apiUrl")))
    n = normalize_template_url(txt)
    return c.select("id", n["url"].alias("url"), n["is_dynamic"].alias("is_dynamic"))


ROUTE_SYM_SQL = """(SELECT id, NULL::VARCHAR AS doc_route, CASE WHEN id % 5 = 4 THEN path END AS attr_route,
  CASE WHEN id % 5 = 0 THEN http_method || ' ' || path ELSE 'void M' || CAST(id AS VARCHAR) || '()' END AS signature,
  CASE id % 5 WHEN 1 THEN '[Route("' || path || '")]' WHEN 2 THEN 'x [HttpGet("' || path || '")] y'
              WHEN 3 THEN 'API Endpoint: GET ' || path || ' more' END AS documentation FROM v_calls)"""


def _route_syms(t):
    c = probes.v_calls(t)
    i = F.col("id")
    return c.select("id", F.lit(None).cast("string").alias("doc_route"),
                    F.when(i % 5 == 4, F.col("path")).alias("attr_route"),
                    F.when(i % 5 == 0, F.concat_ws(" ", "http_method", "path"))
                    .otherwise(F.concat(F.lit("void M"), i.cast("string"), F.lit("()"))).alias("signature"),
                    F.when(i % 5 == 1, F.concat(F.lit('[Route("'), F.col("path"), F.lit('")]')))
                    .when(i % 5 == 2, F.concat(F.lit('x [HttpGet("'), F.col("path"), F.lit('")] y')))
                    .when(i % 5 == 3, F.concat(F.lit("API Endpoint: GET "), F.col("path"), F.lit(" more")))
                    .alias("documentation"))


@register("x07_extract_route", sql=f"""
SELECT id, coalesce(doc_route, attr_route,
  nullif(regexp_extract(coalesce(signature, ''), {sq(SIG_ROUTE)}, 1), ''),
  nullif(regexp_extract(coalesce(documentation, ''), {sq(ROUTE_ATTR_DOC)}, 1), ''),
  nullif(regexp_extract(coalesce(documentation, ''), {sq(HTTP_ATTR_DOC)}, 1), ''),
  nullif(regexp_extract(coalesce(documentation, ''), {sq(API_DOC)}, 1), '')) AS route
FROM {ROUTE_SYM_SQL}""")
def x07_extract_route(spark, sf_dir):
    s = _route_syms(_t(spark, sf_dir))
    return s.select("id", extract_route(F.col("doc_route"), F.col("attr_route"), F.col("signature"),
                                        F.col("documentation")).alias("route"))


@register("x08_combine_routes", sql="""
WITH r AS (SELECT id, replace(CASE WHEN id % 2 = 0 THEN 'api/[area]/[controller]' ELSE '/api/[controller]/' END,
                              '[controller]', replace('Brand' || CAST(id % 25 AS VARCHAR) || 'Controller', 'Controller', '')) AS t0,
                  CASE WHEN id % 3 = 0 THEN 'v' || CAST(id % 4 AS VARCHAR) END AS area, path FROM v_calls),
c AS (SELECT id, CASE WHEN area IS NOT NULL AND area <> '' THEN replace(t0, '[area]', area) ELSE t0 END AS base,
             CASE WHEN id % 7 = 0 THEN '' ELSE trim(path, '/') END AS method FROM r),
s AS (SELECT id, CASE WHEN base <> '' AND NOT starts_with(base, '/') THEN '/' || base ELSE base END AS b,
             CASE WHEN method <> '' AND NOT starts_with(method, '/') THEN '/' || method ELSE method END AS m FROM c)
SELECT id, CASE WHEN regexp_replace(b || m, '/{2,}', '/', 'g') = '' THEN '/' ELSE regexp_replace(b || m, '/{2,}', '/', 'g') END AS full_route
FROM s""")
def x08_combine_routes(spark, sf_dir):
    c = probes.v_calls(_t(spark, sf_dir))
    i = F.col("id")
    tmpl = F.when(i % 2 == 0, F.lit("api/[area]/[controller]")).otherwise(F.lit("/api/[controller]/"))
    name = F.concat(F.lit("Brand"), (i % 25).cast("string"), F.lit("Controller"))
    area = F.when(i % 3 == 0, F.concat(F.lit("v"), (i % 4).cast("string")))
    base = controller_route(tmpl, name, area)
    method = F.when(i % 7 == 0, F.lit("")).otherwise(F.regexp_replace("path", r"^/+|/+$", ""))
    return c.select("id", combine_routes(base, method).alias("full_route"))


# ----------------------------------------------------------------------------- E-01 / E-04 / E-19

def _symbols_sql() -> str:
    parts = []
    for lang, rules in E.SYMBOL_RULES.items():
        for i, rx in enumerate(rules):
            parts.append(f"SELECT id, language, line_no, {i} AS rule_no, unnest(regexp_extract_all(line, {sq(rx)}, 1)) AS name "
                         f"FROM l WHERE language = '{lang}'")
    stops = ", ".join(sq(w) for w in E.SYMBOL_STOP_NAMES)
    lines = ("(SELECT id, language, CAST(generate_subscripts(string_split(content, chr(10)), 1) AS INTEGER) AS line_no, "
             "unnest(string_split(content, chr(10))) AS line FROM v_code)")
    return (f"WITH l AS {lines}, h AS ({' UNION ALL '.join(parts)}) "
            f"SELECT id, language, line_no, rule_no, name FROM h WHERE length(name) > 1 AND name NOT IN ({stops})")


@register("e01_extract_symbols", sql=_symbols_sql())
def e01_extract_symbols(spark, sf_dir):
    c = probes.v_code(_t(spark, sf_dir))
    return E.extract_symbols(c, "id", "content", "language").select(
        "id", "language", F.col("line_no").cast("int"), F.col("rule_no").cast("int"), "name")


@register("e04_extract_events", sql="SELECT id, line_no, library AS messaging_library, http_method AS direction, "
                                    "url_pattern AS event_type_name FROM ("
                                    + _calls_sql(K.EVENT_RULES, "v_code", "id", "content") + ")")
def e04_extract_events(spark, sf_dir):
    c = probes.v_code(_t(spark, sf_dir))
    return K.extract_events(c, "id", "content").withColumn("line_no", F.col("line_no").cast("bigint"))


_REACT = ", ".join(sq(h) for h in E.REACT_HOOKS)


@register("e19_extract_hooks", sql=f"""
WITH l AS {LINES_SQL.format(id="id", text="content", src="v_code", where="WHERE contains(content, 'use')")},
h AS (SELECT id, line_no, unnest(regexp_extract_all(line, {sq(E.HOOK_RE)}, 1)) AS hook,
             unnest(regexp_extract_all(line, {sq(E.HOOK_RE)}, 2)) AS args FROM l)
SELECT id, line_no, hook,
       array_to_string(list_filter(list_transform(string_split(args, ','), lambda a: trim(a)), lambda a: a <> '')[1:3], '|') AS arguments,
       hook NOT IN ({_REACT}) AS is_custom
FROM h""")
def e19_extract_hooks(spark, sf_dir):
    c = probes.v_code(_t(spark, sf_dir))
    return E.extract_hooks(c, "id", "content").withColumn("line_no", F.col("line_no").cast("bigint"))


# ----------------------------------------------------------------------------- E-17

MANIFEST_SQL = """(SELECT doc_id, '# Manifest ' || CAST(doc_id AS VARCHAR) || chr(10) || chr(10)
  || coalesce(nullif(trim(split_part(text, chr(10), 1)), ''), 'pitch') || chr(10)
  || '## Primary Capabilities' || chr(10) || '- serve ' || lang || chr(10) || '* index ' || source || chr(10) || 'not a bullet' || chr(10)
  || '## Infrastructure Dependencies' || chr(10) || '- store-' || CAST(doc_id % 4 AS VARCHAR) || chr(10)
  || '##Domain Boundaries' || chr(10) || 'Owns Data: ' || source || ', ' || lang || ',' || chr(10)
  || 'Reads data: events' || chr(10) || '## Key Workflows' || chr(10) || '- sync' || chr(10) || '- link' || chr(10)
  || '## Primary Capabilities again' || chr(10) || '- replaced ' || CAST(doc_id % 3 AS VARCHAR) AS text FROM documents)"""


def _manifests_md(t):
    d = t.documents
    nl = F.lit("\n")
    first = F.trim(F.element_at(F.split("text", "\n"), 1))
    txt = F.concat(F.lit("# Manifest "), F.col("doc_id").cast("string"), nl, nl,
                   F.coalesce(F.when(first != "", first), F.lit("pitch")), nl,
                   F.lit("## Primary Capabilities\n- serve "), F.col("lang"), F.lit("\n* index "), F.col("source"),
                   F.lit("\nnot a bullet\n## Infrastructure Dependencies\n- store-"), (F.col("doc_id") % 4).cast("string"),
                   F.lit("\n##Domain Boundaries\nOwns Data: "), F.col("source"), F.lit(", "), F.col("lang"),
                   F.lit(",\nReads data: events\n## Key Workflows\n- sync\n- link\n## Primary Capabilities again\n- replaced "),
                   (F.col("doc_id") % 3).cast("string"))
    return d.select("doc_id", txt.alias("text"))


@register("e17_manifest_sections", sql=f"""
WITH l AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS line_no,
                  unnest(string_split(text, chr(10))) AS line FROM {MANIFEST_SQL}),
l2 AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s,
              sum(CASE WHEN starts_with(line, '##') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sec FROM l),
pitch AS (SELECT doc_id, 'pitch' AS field, 1 AS item_no, arg_min(s, line_no) AS value FROM l2
          WHERE s <> '' AND NOT starts_with(s, '#') GROUP BY doc_id),
heads AS (SELECT doc_id, sec, line_no AS head_line, trim(regexp_replace(line, '^##\\s*', '')) AS header FROM l2
          WHERE sec > 0 AND starts_with(line, '##')),
cats AS (SELECT *, CASE WHEN contains(lower(header), 'capabilities') THEN 'primary_capabilities'
                        WHEN contains(lower(header), 'dependencies') THEN 'infrastructure_dependencies'
                        WHEN contains(lower(header), 'boundaries') OR contains(lower(header), 'domain') THEN 'domain_boundaries'
                        WHEN contains(lower(header), 'workflows') THEN 'key_workflows' END AS field FROM heads),
last AS (SELECT doc_id, field, max(sec) AS sec FROM cats WHERE field IS NOT NULL GROUP BY ALL),
body AS (SELECT l2.*, h.head_line FROM l2 JOIN heads h USING (doc_id, sec) WHERE l2.line_no > h.head_line AND l2.s <> ''),
sl AS (SELECT body.*, last.field FROM body JOIN last USING (doc_id, sec)),
bullets AS (SELECT doc_id, field, row_number() OVER (PARTITION BY doc_id, field ORDER BY line_no) AS item_no,
                   trim(regexp_replace(s, '^[-* ]+', '')) AS value
            FROM sl WHERE field <> 'domain_boundaries' AND (starts_with(s, '-') OR starts_with(s, '*'))),
bnd AS (SELECT *, CASE WHEN contains(lower(s), 'owns data') THEN 'owns' WHEN contains(lower(s), 'reads data') THEN 'reads' END AS kind
        FROM sl WHERE field = 'domain_boundaries'),
ll AS (SELECT doc_id, kind, arg_max(s, line_no) AS s FROM bnd WHERE kind IS NOT NULL AND contains(s, ':') GROUP BY ALL),
items AS (SELECT doc_id, kind AS field, row_number() OVER (PARTITION BY doc_id, kind ORDER BY pos) AS item_no, trim(v) AS value
          FROM (SELECT doc_id, kind, generate_subscripts(string_split(substr(s, instr(s, ':') + 1), ','), 1) AS pos,
                       unnest(string_split(substr(s, instr(s, ':') + 1), ',')) AS v FROM ll) WHERE trim(v) <> '')
SELECT doc_id, field, CAST(item_no AS INTEGER) AS item_no, value FROM pitch
UNION ALL SELECT doc_id, field, CAST(item_no AS INTEGER), value FROM bullets
UNION ALL SELECT doc_id, field, CAST(item_no AS INTEGER), value FROM items""")
def e17_manifest_sections(spark, sf_dir):
    out = E.manifest_sections(_manifests_md(_t(spark, sf_dir)), "doc_id", "text")
    return out.select("doc_id", "field", F.col("item_no").cast("int"), "value")
