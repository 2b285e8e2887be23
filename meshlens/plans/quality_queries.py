"""Registered data-quality and security queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlens.operators import extract as E
from meshlens.operators import quality as Q
from meshlens.plans.catalog import register
from meshlens.plans.text_queries import sq
from meshlens.sources import probes
from meshlens.sources.tables import load_tables


def _t(spark, sf_dir):
    return load_tables(spark, sf_dir)


SYM_ROWS_SQL = """(SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN NULL ELSE l_returnflag END AS name,
  l_linenumber AS start_line, CAST(floor(l_quantity / 10) AS INTEGER) AS end_line FROM lineitem)"""


@register("dq01_validate_symbols", sql=f"""
SELECT l_orderkey, l_linenumber, array_to_string(list_filter([
    CASE WHEN name IS NULL THEN 'Missing required field: name' END,
    CASE WHEN start_line IS NULL THEN 'Missing required field: start_line' END,
    CASE WHEN end_line IS NULL THEN 'Missing required field: end_line' END,
    CASE WHEN start_line > end_line THEN 'start_line (' || CAST(start_line AS VARCHAR) || ') cannot be greater than end_line ('
         || CAST(end_line AS VARCHAR) || ')' END], lambda x: x IS NOT NULL), '; ') AS errors
FROM {SYM_ROWS_SQL}
WHERE name IS NULL OR start_line > end_line""")
def dq01_validate_symbols(spark, sf_dir):
    li = _t(spark, sf_dir).lineitem
    rows = li.select("l_orderkey", "l_linenumber",
                     F.when(F.col("l_tax") == 0, F.lit(None).cast("string")).otherwise(F.col("l_returnflag")).alias("name"),
                     F.col("l_linenumber").alias("start_line"),
                     F.floor(F.col("l_quantity") / 10).cast("int").alias("end_line"))
    v = Q.validate_symbols(rows)
    return v.where(~F.col("is_valid")).select("l_orderkey", "l_linenumber",
                                              F.array_join("errors", "; ").alias("errors"))


@register("dq02_clip_lengths", sql="""
SELECT id, left(content, 1000) AS name, left(path, 2000) AS fully_qualified_name,
       length(content) > 1000 OR length(path) > 2000 AS was_clipped FROM v_files""")
def dq02_clip_lengths(spark, sf_dir):
    f = probes.v_files(_t(spark, sf_dir)).select("id", F.col("content").alias("name"),
                                                  F.col("path").alias("fully_qualified_name"))
    return Q.clip_lengths(f, {"name": 1000, "fully_qualified_name": 2000})


def _spans_sql(text: str, rx: str) -> str:
    pieces = f"string_split_regex({text}, {sq(rx)})"
    hits = f"regexp_extract_all({text}, {sq(rx)}, 0)"
    start = (f"list_sum(list_transform({pieces}[1:k + 1], lambda x: length(x))) + "
             f"coalesce(list_sum(list_transform({hits}[1:k], lambda x: length(x))), 0)")
    return (f"list_transform(range(0, len({hits})), lambda k: {{'start': CAST({start} AS INTEGER), "
            f"'end': CAST({start} + length({hits}[k + 1]) AS INTEGER)}})")


def _secrets_sql() -> str:
    any_rx = "(?i)" + "|".join(f"(?:{rx})" for rx, _ in E.SECRET_PATTERNS)
    parts = []
    for rx, typ in E.SECRET_PATTERNS:
        parts.append(f"SELECT doc_id, '{typ}' AS type, unnest({_spans_sql('text', '(?i)' + rx)}) AS h, text FROM d")
    body = " UNION ALL ".join(parts)
    return (f"WITH d AS (SELECT doc_id, text FROM documents WHERE regexp_matches(text, {sq(any_rx)})), "
            f"u AS ({body}) "
            "SELECT doc_id, type, h.start AS start, h.end AS \"end\", "
            "substring(text, greatest(h.start - 20, 0) + 1, least(h.end + 20, length(text)) - greatest(h.start - 20, 0)) AS context "
            "FROM u")


@register("dq03_scan_secrets", sql=_secrets_sql())
def dq03_scan_secrets(spark, sf_dir):
    d = _t(spark, sf_dir).documents
    return E.scan_secrets(d, "doc_id", "text")


def _redact_sql(text: str) -> str:
    out = text
    for rx, typ in E.SECRET_PATTERNS:
        out = f"regexp_replace({out}, {sq('(?i)' + rx)}, '[REDACTED_{typ.upper()}]', 'g')"
    return out


@register("dq04_redact_secrets", sql=f"""
SELECT doc_id, sha256({_redact_sql('text')}) AS redacted_sha, length({_redact_sql('text')}) AS redacted_len FROM documents""")
def dq04_redact_secrets(spark, sf_dir):
    d = _t(spark, sf_dir).documents
    r = E.redact_secrets(F.col("text"))
    return d.select("doc_id", F.sha2(r, 256).alias("redacted_sha"), F.length(r).cast("bigint").alias("redacted_len"))


_DANGER = "(?i)" + "|".join(f"(?:{p})" for p in E.DANGEROUS_PATTERNS)
_ALLOWED_EXT = ", ".join(sq(e) for e in Q.ALLOWED_CODE_EXTENSIONS)
_REPO_RX = "|".join(f"(?:{p})" for p in Q.ALLOWED_REPO_URLS)


@register("dq05_screens", sql=f"""
SELECT id,
  NOT contains(path, '..') AND NOT starts_with(path, '/') AND NOT regexp_matches(path, {sq(_DANGER)}) AS path_safe,
  lower(regexp_extract(split_part(path, '/', -1), '(?:.)(\\.[^.]*)$', 1)) IN ({_ALLOWED_EXT}) AS extension_allowed,
  regexp_matches(url, {sq(_REPO_RX)}) AS repo_url_allowed
FROM v_calls""")
def dq05_screens(spark, sf_dir):
    c = probes.v_calls(_t(spark, sf_dir))
    return c.select("id", Q.path_is_safe(F.col("path")).alias("path_safe"),
                    Q.extension_allowed(F.col("path")).alias("extension_allowed"),
                    Q.repo_url_allowed(F.col("url")).alias("repo_url_allowed"))


@register("dq05_screen_names", sql=f"""
SELECT id, regexp_matches(name, {sq(Q.SYMBOL_NAME_RE)}) AS name_valid FROM v_symbols""")
def dq05_screen_names(spark, sf_dir):
    s = probes.v_symbols(_t(spark, sf_dir))
    return s.select("id", Q.symbol_name_valid(F.col("name")).alias("name_valid"))


def _sanitize_sql(text: str) -> str:
    out = f"replace({text}, chr(0), '')"
    for p in E.DANGEROUS_PATTERNS:
        out = f"regexp_replace({out}, {sq('(?i)' + p)}, '', 'g')"
    return out


@register("dq06_sanitize_text", sql=f"""
SELECT page_id, sha256({_sanitize_sql('html')}) AS sanitized_sha FROM pages""")
def dq06_sanitize_text(spark, sf_dir):
    p = _t(spark, sf_dir).pages
    return p.select("page_id", F.sha2(E.sanitize_text(F.col("html")), 256).alias("sanitized_sha"))


FK_PAIRS = (
    ("lineitem.l_orderkey", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem.l_partkey", "lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem.l_suppkey", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("orders.o_custkey", "orders", "o_custkey", "customer", "c_custkey"),
    ("customer.c_nationkey", "customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier.s_nationkey", "supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation.n_regionkey", "nation", "n_regionkey", "region", "r_regionkey"),
    ("labels.doc_id", "labels", "doc_id", "documents", "doc_id"),
)


@register("dq07_fk_audit", sql=" UNION ALL ".join(
    f"SELECT '{n}' AS foreign_key, count(*) AS orphans FROM {c} WHERE {cc} IS NOT NULL AND {cc} NOT IN "
    f"(SELECT {pc} FROM {p} WHERE {pc} IS NOT NULL)" for n, c, cc, p, pc in FK_PAIRS))
def dq07_fk_audit(spark, sf_dir):
    t = _t(spark, sf_dir)
    return Q.fk_audit([(n, getattr(t, c), cc, getattr(t, p), pc) for n, c, cc, p, pc in FK_PAIRS])


@register("dq08_exact_duplicates", sql="""
SELECT content_hash, count(*) AS copies, min(id) AS first_id FROM v_files GROUP BY content_hash HAVING count(*) > 1""")
def dq08_exact_duplicates(spark, sf_dir):
    f = probes.v_files(_t(spark, sf_dir))
    return Q.exact_duplicates(f, "id", "content_hash")
