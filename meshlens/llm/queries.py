"""The registered queries of the training-data operators, with DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meshlens.llm import hadamard_clusters, mixing
from meshlens.llm.chat_rotation import rotate, speakers
from meshlens.llm.common import table
from meshlens.llm.decontaminate import decontaminate
from meshlens.llm.exact_dedup import exact_dedup
from meshlens.llm.jaccard_join import jaccard_join
from meshlens.llm.language_id import language_id
from meshlens.llm.pii import personal_data
from meshlens.llm.quality import quality
from meshlens.llm.substring_dedup import substring_dedup
from meshlens.llm.token_alignment import align
from meshlens.llm.toxicity import toxicity
from meshlens.llm.warc_revisit import capture_records, resolve_revisits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


@_query("op1_exact_dedup", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     n AS (SELECT doc_id, length(t) AS cp, sha256(regexp_replace(t, '[ \t\n\v\f\r]', '', 'g')) AS text_sha256 FROM d)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY cp DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY cp DESC, doc_id) = 1 AS kept,
       text_sha256
FROM n""")
def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


@_query("op4_jaccard_join")
def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


@_query("op5_toxicity")
def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op6_language_id")
def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


@_query("op9_decontaminate")
def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query("op10_quality")
def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_ROTATION_SQL = """
WITH t AS (SELECT conv_id, coalesce(turn, 0) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
     n AS (SELECT conv_id, turn, text, role = 'system' AS is_system,
                  CASE WHEN role = 'user' THEN 'user' || CAST((turn // 2) % 2 AS VARCHAR) ELSE role END AS speaker FROM t),
     s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, speaker, is_system, md5(text)) - 1 AS rank FROM n),
     p AS (SELECT DISTINCT conv_id, speaker AS participant FROM s WHERE NOT is_system),
     c AS (SELECT conv_id, part, last_value(system IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY part
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS system
           FROM (SELECT conv_id, rank // 256 AS part, arg_max(text, rank) FILTER (is_system) AS system FROM s GROUP BY ALL)),
     x AS (SELECT s.*, rank // 256 AS part, participant, speaker = participant AND NOT is_system AS target,
                  CASE WHEN is_system THEN '<|system|>' WHEN speaker = participant THEN '<|assistant|>'
                       ELSE '<|user name=' || speaker || '|>' END || chr(10) AS head
           FROM s JOIN p USING (conv_id)),
     y AS (SELECT *, head || text || '<|end|>' || chr(10) AS piece FROM x),
     z AS (SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY conv_id, participant ORDER BY rank
                                                   ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM y),
     g AS (SELECT conv_id, CAST(part AS INTEGER) AS part, participant, CAST(count(*) AS INTEGER) AS n_turns,
                  CAST(count(*) FILTER (target) AS INTEGER) AS n_targets, CAST(min(upto - length(piece)) AS BIGINT) AS start,
                  string_agg(piece, '' ORDER BY rank) AS rendered,
                  coalesce(string_agg(CAST(upto - length(piece) + length(head) AS VARCHAR) || ':' || CAST(upto - 8 AS VARCHAR),
                                      ',' ORDER BY rank) FILTER (target), '') AS mask
           FROM z GROUP BY conv_id, part, participant)
SELECT g.*, coalesce('<|system|>' || chr(10) || c.system || '<|end|>' || chr(10), '') AS context, sha256(rendered) AS rendered_sha256
FROM g JOIN c ON c.conv_id = g.conv_id AND c.part = g.part"""


@_query("op2_chat_rotation", _ROTATION_SQL)
def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(speakers(table(spark, sf_dir, "conversations")))


@_query("op3_mixing", mixing.oracle())
def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


_REVISIT_SQL = r"""
WITH p AS (SELECT CAST(page_id AS BIGINT) AS id, url, '"' || md5(coalesce(html, '')) || '"' AS tag,
                  CAST(length(coalesce(html, '')) AS VARCHAR) AS size FROM pages),
     q AS (SELECT p.*, r, id * 3 + r AS record_id, id + r * 1000 AS ts FROM p, (VALUES (0), (1), (2)) AS v(r)),
     e AS (SELECT *, CASE WHEN r = 0 THEN tag WHEN r = 1 AND id % 5 <> 0 THEN 'W/' || tag WHEN r = 2 AND id % 7 = 0 THEN '"changed"'
                          WHEN r = 2 AND id % 11 <> 0 THEN tag END AS etag,
                  CASE WHEN r = 0 OR (r = 1 AND id % 5 = 0) THEN 'day ' || CAST(id % 28 AS VARCHAR) END AS modified,
                  regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM q),
     f AS (SELECT *, regexp_replace(u, '^[^/?]*', '') AS rest,
                  regexp_replace(lower(regexp_replace(regexp_replace(u, '[/?].*$', ''), ':[0-9]*$', '')), '^(www|m)[.]', '') AS host
           FROM e),
     g AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(rest, '[?].*$', ''), '(/index)?[.]html?$', ''), '/+$', '') AS path,
                  list_sort(list_filter(string_split(CASE WHEN contains(rest, '?') THEN regexp_replace(rest, '^[^?]*[?]', '') ELSE '' END, '&'),
                       lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))) AS params
           FROM f),
     c AS (SELECT *, host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS url_key FROM g),
     w AS (SELECT *, last_value(CASE WHEN r = 0 THEN record_id END IGNORE NULLS) OVER
                    (PARTITION BY url_key ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base_id FROM c),
     j AS (SELECT w.*, b.record_id AS b_id, b.etag AS b_etag, b.modified AS b_modified, b.size AS b_size, b.ts AS b_ts
           FROM w LEFT JOIN c b ON w.r > 0 AND b.record_id = w.base_id),
     o AS (SELECT *, CASE WHEN r = 0 THEN 'response' WHEN b_id IS NULL THEN 'unresolved'
                          WHEN etag IS NOT NULL THEN CASE WHEN replace(etag, 'W/', '') = b_etag THEN 'verified' ELSE 'mismatch' END
                          WHEN modified IS NOT NULL THEN CASE WHEN modified = b_modified THEN 'verified' ELSE 'mismatch' END
                          ELSE 'unchecked' END AS outcome FROM j)
SELECT record_id, url_key, CASE WHEN r = 0 THEN 'response' ELSE 'revisit' END AS kind,
       CASE WHEN r = 0 THEN record_id WHEN outcome IN ('verified', 'unchecked') THEN b_id END AS payload_record_id, outcome,
       array_to_string(list_sort(list_filter([
           'cache-control: max-age=' || CAST(r * 60 AS VARCHAR),
           'content-length: ' || CASE WHEN r = 0 THEN size WHEN outcome IN ('verified', 'unchecked') THEN b_size END,
           'date: t' || CAST(ts AS VARCHAR),
           'etag: ' || coalesce(etag, CASE WHEN outcome IN ('verified', 'unchecked') THEN b_etag END),
           'last-modified: ' || coalesce(modified, CASE WHEN outcome IN ('verified', 'unchecked') THEN b_modified END),
           'server: s' || CASE WHEN outcome IN ('verified', 'unchecked') THEN '0' ELSE CAST(r AS VARCHAR) END
       ], lambda x: x IS NOT NULL)), chr(10)) AS headers
FROM o"""


@_query("op7_warc_revisit", _REVISIT_SQL)
def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_revisits(capture_records(table(spark, sf_dir, "pages")))


@_query("op8_pii")
def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


@_query("op11_substring_dedup")
def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


@_query("op12_hadamard_clusters", hadamard_clusters.oracle())
def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hadamard_clusters.cluster_vectors(table(spark, sf_dir, "embeddings"))


@_query("op13_token_alignment")
def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
