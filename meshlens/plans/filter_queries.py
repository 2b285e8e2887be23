"""Registered filter queries F-04, F-05, F-06, F-12, F-13, F-16, F-17."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlens.functions import code as X
from meshlens.operators import extract as E
from meshlens.operators import relational as R
from meshlens.plans.catalog import register
from meshlens.plans.text_queries import FLAT_SQL, _config_files
from meshlens.sources import probes
from meshlens.sources.tables import load_tables


def _t(spark, sf_dir):
    return load_tables(spark, sf_dir)


def _cfg(t):
    cfg = E.extract_config(_config_files(t), "id", "text", "file_name")
    return cfg.join(probes.v_json(t).select("id", (F.col("user_id") % 10).alias("repository_id")), "id")


_SECRET = X.contains_any_sql("lower(f.key)", X.SECRET_KEY_TERMS)
CFG_SQL = f"""(SELECT f.id, f.key AS config_key, CASE WHEN {_SECRET} THEN '***' ELSE f.value END AS config_value,
  f.type AS config_type, lower(j.event_type) AS environment, CAST({_SECRET} AS INTEGER) AS is_secret,
  j.user_id % 10 AS repository_id FROM {FLAT_SQL} f JOIN v_json j ON j.id = f.id)"""

KEY_GLOB = "app:*"


@register("f04_config_search", sql=f"""
SELECT id, config_key, CASE WHEN is_secret = 1 THEN '[REDACTED]' ELSE config_value END AS display_value
FROM {CFG_SQL} WHERE config_key ILIKE '{R.like_glob(KEY_GLOB)}' AND repository_id = 3 AND environment = 'click'""")
def f04_config_search(spark, sf_dir):
    c = R.config_search(_cfg(_t(spark, sf_dir)), KEY_GLOB, repository=3, environment="click")
    return c.select("id", "config_key", "display_value")


@register("f06_config_findings", sql=f"""
SELECT id, config_key, '********' AS masked_value FROM {CFG_SQL}
WHERE is_secret = 1 OR contains(lower(config_key), 'connection') OR contains(lower(config_key), 'endpoint')
   OR contains(lower(config_key), 'key')""")
def f06_config_findings(spark, sf_dir):
    return R.config_findings(_cfg(_t(spark, sf_dir))).select("id", "config_key", "masked_value")


DOC_QUERY = "ment"
SECTIONS_AS_SYMBOLS = """(SELECT doc_id, start_line, 'DOCUMENT_SECTION' AS kind, title AS name, content AS documentation,
  '## ' || title AS signature FROM ({sections}))"""


from meshlens.plans.text_queries import LINES_SQL, SECTIONS_SQL  # noqa: E402

_SECTIONS = SECTIONS_SQL.format(lines=LINES_SQL.format(id="doc_id", text="text", src="v_md", where=""))


@register("f05_doc_search", sql=f"""
WITH sec AS ({_SECTIONS})
SELECT doc_id, start_line, title AS name, left(content, 300) AS preview FROM sec
WHERE contains(lower(title), '{DOC_QUERY}') OR contains(lower(content), '{DOC_QUERY}')
   OR contains(lower('## ' || title), '{DOC_QUERY}')""")
def f05_doc_search(spark, sf_dir):
    """F-05 over the Markdown sections of E-08 (seen as DOCUMENT_SECTION symbols)."""
    md = probes.v_md(_t(spark, sf_dir))
    sec = E.doc_sections(md, "doc_id", "text").select(
        "doc_id", F.col("start_line").cast("bigint").alias("start_line"), F.lit("DOCUMENT_SECTION").alias("kind"),
        F.col("title").alias("name"), F.col("content").alias("documentation"),
        F.concat(F.lit("## "), F.col("title")).alias("signature"))
    return R.doc_search(sec, DOC_QUERY).select("doc_id", "start_line", "name", "preview")


GENERIC_TEXT = "find all widget symbols in economy"


@register("f12_generic_keyword_filter", sql="""
SELECT s.id, s.name FROM v_symbols s WHERE """ + " OR ".join(
    f"contains(lower(coalesce(s.name, '')), '{k}') OR contains(lower(coalesce(s.signature, '')), '{k}')"
    for k in R.generic_keywords(GENERIC_TEXT)))
def f12_generic_keyword_filter(spark, sf_dir):
    s = probes.v_symbols(_t(spark, sf_dir))
    return R.generic_keyword_filter(s, GENERIC_TEXT).select("id", "name")


@register("f13_endpoint_filter", sql="""
SELECT id, route FROM v_endpoints WHERE upper(http_method) = 'GET' AND regexp_matches(route, '^en/.*$')""")
def f13_endpoint_filter(spark, sf_dir):
    e = probes.v_endpoints(_t(spark, sf_dir))
    return R.endpoint_filter(e, "get", "en/*").select("id", "route")


TREE_PREFIX = "src1"


@register("f16_file_tree", sql=f"""
WITH f AS (SELECT id, substr(path, {len(TREE_PREFIX) + 2}) AS rel FROM v_files WHERE starts_with(path, '{TREE_PREFIX}/')),
p AS (SELECT id, rel, string_split(rel, '/') AS parts, len(string_split(rel, '/')) - 1 AS ndir FROM f),
dirs AS (SELECT DISTINCT array_to_string(parts[1:k], '/') AS dir FROM p, unnest(generate_series(1, least(ndir, 2))) AS g(k)
         WHERE ndir >= 1),
spf AS (SELECT file_id, count(*) AS n FROM v_symbols GROUP BY file_id),
direct AS (SELECT array_to_string(parts[1:ndir], '/') AS dir, count(*) AS direct_files,
                  CAST(sum(coalesce(spf.n, 0)) AS BIGINT) AS symbols
           FROM p LEFT JOIN spf ON spf.file_id = p.id WHERE ndir BETWEEN 1 AND 2 GROUP BY 1)
SELECT d.dir, CAST(len(string_split(d.dir, '/')) AS INTEGER) AS depth, coalesce(x.direct_files, 0) AS direct_files,
       coalesce(x.symbols, 0) AS symbols FROM dirs d LEFT JOIN direct x USING (dir)""")
def f16_file_tree(spark, sf_dir):
    t = _t(spark, sf_dir)
    return R.file_tree(probes.v_files(t), probes.v_symbols(t), TREE_PREFIX, 2)


@register("f17_entity_mapping", sql="""
SELECT vec_id AS entity_id, 'dbo' AS schema_name, CAST(least(len(embedding), 20) AS INTEGER) AS properties_shown,
       CAST(greatest(len(embedding) - 20, 0) AS INTEGER) AS properties_more,
       CAST(least(len(list_filter(embedding, lambda x: x > 0)), 10) AS INTEGER) AS relationships_shown,
       CAST(greatest(len(list_filter(embedding, lambda x: x > 0)) - 10, 0) AS INTEGER) AS relationships_more
FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)""")
def f17_entity_mapping(spark, sf_dir):
    """F-17 on the embeddings arrays: properties = the vector, relationships =
    its positive entries; the first 20 / 10 are shown and the rest counted;
    schema defaults to ``dbo``; entities selected by a semi-join on labels."""
    t = _t(spark, sf_dir)
    e = t.embeddings.join(t.labels.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    pos = F.filter("embedding", lambda x: x > 0)
    return e.select(F.col("vec_id").alias("entity_id"), F.lit("dbo").alias("schema_name"),
                    F.size(F.slice("embedding", 1, 20)).alias("properties_shown"),
                    F.greatest(F.size("embedding") - 20, F.lit(0)).alias("properties_more"),
                    F.size(F.slice(pos, 1, 10)).alias("relationships_shown"),
                    F.greatest(F.size(pos) - 10, F.lit(0)).alias("relationships_more"))
