"""Registered search / vector / chunk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlens.operators import search
from meshlens.plans.catalog import register
from meshlens.sources import probes
from meshlens.sources.tables import load_tables

# Fixed values pinned for the probes: a term that occurs in the
# data, the query vector row, and a threshold the test vectors reach.
QUERY_TEXT = "red widget"
QUERY_VEC_ID = 0
VEC_THRESHOLD = 0.1
LIMIT = 20


def _qvec(t):
    return search.query_vector(probes.v_vec(t), "chunk_id", QUERY_VEC_ID)


KW_SCORED_SQL = f"""
(SELECT id, name,
    (CASE WHEN lower(name) = '{QUERY_TEXT}' THEN 10.0 WHEN contains(lower(name), '{QUERY_TEXT}') THEN 5.0
          WHEN contains(lower(coalesce(fqn, '')), '{QUERY_TEXT}') THEN 4.0
          WHEN contains(lower(coalesce(signature, '')), '{QUERY_TEXT}') THEN 2.0
          WHEN contains(lower(coalesce(documentation, '')), '{QUERY_TEXT}') THEN 1.0 ELSE 0.0 END)
    + t1 + t2 + ((CASE WHEN t1 > 0 THEN 1 ELSE 0 END) + (CASE WHEN t2 > 0 THEN 1 ELSE 0 END)) / 2.0 * 3.0 AS score
  FROM (SELECT *,
    CASE WHEN contains(lower(name), 'red') THEN 2.0 WHEN contains(lower(coalesce(fqn, '')), 'red') THEN 1.5
         WHEN contains(lower(coalesce(signature, '')), 'red') THEN 1.0
         WHEN contains(lower(coalesce(documentation, '')), 'red') THEN 0.5 ELSE 0.0 END AS t1,
    CASE WHEN contains(lower(name), 'widget') THEN 2.0 WHEN contains(lower(coalesce(fqn, '')), 'widget') THEN 1.5
         WHEN contains(lower(coalesce(signature, '')), 'widget') THEN 1.0
         WHEN contains(lower(coalesce(documentation, '')), 'widget') THEN 0.5 ELSE 0.0 END AS t2
    FROM v_symbols
    WHERE contains(lower(name), 'red') OR contains(lower(coalesce(signature, '')), 'red')
       OR contains(lower(coalesce(documentation, '')), 'red') OR contains(lower(coalesce(fqn, '')), 'red')
       OR contains(lower(name), 'widget') OR contains(lower(coalesce(signature, '')), 'widget')
       OR contains(lower(coalesce(documentation, '')), 'widget') OR contains(lower(coalesce(fqn, '')), 'widget')))"""


@register("v04_hybrid_search", sql=f"""
WITH q AS (SELECT vector::DOUBLE[] AS qv FROM v_vec WHERE chunk_id = {QUERY_VEC_ID}),
kw_scored AS (SELECT * FROM {KW_SCORED_SQL}),
kw AS (SELECT id AS symbol_id, row_number() OVER (ORDER BY score DESC, name, id) AS rank
       FROM kw_scored ORDER BY score DESC, name, id LIMIT {2 * LIMIT}),
sims AS (SELECT symbol_id, round(list_cosine_similarity(vector::DOUBLE[], (SELECT qv FROM q)), 6) AS score FROM v_vec),
best AS (SELECT symbol_id, max(score) AS score FROM sims WHERE score >= {VEC_THRESHOLD} GROUP BY symbol_id),
vs AS (SELECT symbol_id, row_number() OVER (ORDER BY score DESC, symbol_id) AS rank
       FROM best ORDER BY score DESC, symbol_id LIMIT {2 * LIMIT}),
u AS (SELECT symbol_id, rank, 0 AS l FROM kw UNION ALL SELECT symbol_id, rank, 1 FROM vs),
f AS (SELECT symbol_id, round(sum(1.0 / (60 + rank)), 10) AS score,
             max(CASE WHEN l = 0 THEN rank END) AS keyword_rank, max(CASE WHEN l = 1 THEN rank END) AS vector_rank
      FROM u GROUP BY symbol_id)
SELECT symbol_id, score, CAST(keyword_rank AS BIGINT) AS keyword_rank, CAST(vector_rank AS BIGINT) AS vector_rank,
       CAST(row_number() OVER (ORDER BY score DESC, symbol_id) AS BIGINT) AS rank
FROM f ORDER BY score DESC, symbol_id LIMIT {LIMIT}
""")
def v04_hybrid_search(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    return search.hybrid_search(probes.v_symbols(t), probes.v_vec(t), QUERY_TEXT, _qvec(t),
                                limit=LIMIT, threshold=VEC_THRESHOLD)


@register("v01_keyword_search", sql=f"""
SELECT id, name, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (ORDER BY score DESC, name, id) AS BIGINT) AS rank
FROM {KW_SCORED_SQL} ORDER BY score DESC, name, id LIMIT 100""")
def v01_keyword_search(spark, sf_dir):
    """V-01: top 100 keyword hits (every match scored before the limit)."""
    t = load_tables(spark, sf_dir)
    return search.keyword_search(probes.v_symbols(t), QUERY_TEXT, 100).select(
        "id", "name", F.col("score").cast("double"), "rank")


@register("v02_vector_search", sql=f"""
WITH q AS (SELECT vector::DOUBLE[] AS qv FROM v_vec WHERE chunk_id = {QUERY_VEC_ID}),
sims AS (SELECT symbol_id, round(list_cosine_similarity(vector::DOUBLE[], (SELECT qv FROM q)), 6) AS score FROM v_vec),
best AS (SELECT symbol_id, max(score) AS score FROM sims WHERE score >= {VEC_THRESHOLD} GROUP BY symbol_id)
SELECT symbol_id, score, CAST(row_number() OVER (ORDER BY score DESC, symbol_id) AS BIGINT) AS rank
FROM best ORDER BY score DESC, symbol_id LIMIT 50""")
def v02_vector_search(spark, sf_dir):
    """V-02: best chunk per symbol above the threshold, top 50."""
    t = load_tables(spark, sf_dir)
    return search.vector_search(probes.v_vec(t), _qvec(t), 50, VEC_THRESHOLD)


BOOST_TERM = "gear"


@register("v03_boosted_search", sql=f"""
WITH q AS (SELECT vector::DOUBLE[] AS qv FROM v_vec WHERE chunk_id = {QUERY_VEC_ID}),
sims AS (SELECT symbol_id, round(list_cosine_similarity(vector::DOUBLE[], (SELECT qv FROM q)), 6) AS score FROM v_vec),
best AS (SELECT symbol_id, max(score) AS score FROM sims WHERE score >= {VEC_THRESHOLD} GROUP BY symbol_id),
vec AS (SELECT symbol_id, score AS vscore FROM best ORDER BY score DESC, symbol_id LIMIT 20),
s AS (SELECT v.*, f.path FROM v_symbols v LEFT JOIN v_files f ON f.id = v.file_id),
txt AS (SELECT id AS symbol_id FROM s WHERE contains(lower(name), '{BOOST_TERM}') OR contains(lower(coalesce(fqn, '')), '{BOOST_TERM}')
        ORDER BY id LIMIT 10),
cand AS (SELECT coalesce(vec.symbol_id, txt.symbol_id) AS symbol_id, vec.vscore FROM vec FULL OUTER JOIN txt ON vec.symbol_id = txt.symbol_id),
sc AS (SELECT c.symbol_id, s.name, round(coalesce(c.vscore, 0.0)
         + CASE WHEN lower(s.name) = '{BOOST_TERM}' THEN 0.5 WHEN contains(lower(s.name), '{BOOST_TERM}') THEN 0.2 ELSE 0.0 END
         + CASE WHEN contains(lower(coalesce(s.path, '')), '{BOOST_TERM}') THEN 0.1 ELSE 0.0 END
         + CASE WHEN s.kind IN ('CLASS', 'INTERFACE', 'STRUCT', 'MODULE') THEN 0.1
                WHEN s.kind IN ('FUNCTION', 'METHOD') THEN 0.05 ELSE 0.0 END, 6) AS score
       FROM cand c JOIN s ON s.id = c.symbol_id)
SELECT symbol_id, name, score, CAST(row_number() OVER (ORDER BY score DESC, symbol_id) AS BIGINT) AS rank
FROM sc ORDER BY score DESC, symbol_id LIMIT 10""")
def v03_boosted_search(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    files = probes.v_files(t).select(F.col("id").alias("file_id"), "path")
    syms = probes.v_symbols(t).join(files, "file_id", "left")
    return search.boosted_search(syms, probes.v_vec(t), BOOST_TERM, _qvec(t), k=10, threshold=VEC_THRESHOLD)


@register("v05_ivf_search")
def v05_ivf_search(spark, sf_dir):
    """V-05: approximate top-20 by cosine over 16 lists, 4 probed."""
    t = load_tables(spark, sf_dir)
    v = probes.v_vec(t)
    row = v.where(F.col("chunk_id") == QUERY_VEC_ID).select("vector").limit(1).collect()
    return search.ivf_search(spark, v, [float(x) for x in row[0][0]], k=20)


@register("v09_reuse_vectors", sql="""
WITH cache AS (SELECT sha256(d.text) AS content_hash, 'm1' AS model FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id)
SELECT f.id, f.content_hash, f.content_hash IN (SELECT content_hash FROM cache WHERE model = 'm1') AS hit FROM v_files f""")
def v09_reuse_vectors(spark, sf_dir):
    """V-09: files whose content hash already has a vector (model ``m1``) reuse it."""
    t = load_tables(spark, sf_dir)
    cache = (t.documents.join(t.embeddings, t.documents["doc_id"] == t.embeddings["vec_id"])
             .select(F.sha2("text", 256).alias("content_hash"), F.lit("m1").alias("model"),
                     F.col("embedding").alias("vector")))
    files = probes.v_files(t).select("id", "content_hash")
    return search.reuse_vectors(files, cache, "m1").select("id", "content_hash", "hit")


@register("v08_symbol_chunks", sql="""
WITH s AS (SELECT * FROM v_symbols),
f AS (SELECT id AS file_id, path, string_split(content, chr(10)) AS lines FROM v_files),
parents AS (SELECT fqn AS parent_name, arg_min(name, id) AS pname, arg_min_null(signature, id) AS psig, 1 AS has
            FROM v_symbols WHERE fqn IS NOT NULL GROUP BY fqn),
cn AS (SELECT e.src, d.name AS dst_name, e.dst FROM v_edges e JOIN v_symbols d ON d.id = e.dst WHERE e.type = 'CALLS'),
calls AS (SELECT src AS id, string_agg(dst_name, ', ' ORDER BY dst_name, dst) AS calls FROM cn GROUP BY src),
imp AS (SELECT file_id, string_agg(name, ', ' ORDER BY name) AS imports FROM (SELECT DISTINCT s.file_id, d.name FROM v_edges e
        JOIN v_symbols s ON s.id = e.src JOIN v_symbols d ON d.id = e.dst WHERE e.type = 'IMPORTS') GROUP BY file_id),
impl AS (SELECT e.src AS id, string_agg(d.name, ', ' ORDER BY d.name) AS impl FROM v_edges e JOIN v_symbols d ON d.id = e.dst
         WHERE e.type = 'IMPLEMENTS' GROUP BY e.src),
inh AS (SELECT e.src AS id, string_agg(d.name, ', ' ORDER BY d.name) AS inh FROM v_edges e JOIN v_symbols d ON d.id = e.dst
        WHERE e.type = 'INHERITS' GROUP BY e.src),
j AS (SELECT s.*, f.path, f.lines, p.pname, p.psig, p.has, c.calls, i.impl, h.inh, m.imports,
             regexp_extract(s.fqn, '^(.*)\\.[^.]*$', 1) AS ns
      FROM s JOIN f USING (file_id) LEFT JOIN parents p USING (parent_name) LEFT JOIN calls c ON c.id = s.id
      LEFT JOIN impl i ON i.id = s.id LEFT JOIN inh h ON h.id = s.id LEFT JOIN imp m ON m.file_id = s.file_id),
b AS (SELECT *, array_to_string(lines[start_line:least(len(lines), end_line)], chr(10)) AS body FROM j),
t AS (SELECT id, array_to_string(list_filter([
        'File: ' || path,
        CASE WHEN ns <> '' THEN 'Namespace: ' || ns END,
        CASE WHEN imports <> '' THEN 'Imports: ' || imports END,
        '',
        CASE WHEN has = 1 THEN '// In class: ' || pname END,
        CASE WHEN has = 1 THEN '// ' || coalesce(psig, 'None') END,
        CASE WHEN has = 1 THEN '' END,
        signature,
        CASE WHEN start_line IS NOT NULL AND end_line IS NOT NULL AND body <> '' THEN body END,
        CASE WHEN calls IS NOT NULL THEN chr(10) || '// Calls: ' || calls END,
        CASE WHEN impl IS NOT NULL THEN '// Implements: ' || impl END,
        CASE WHEN inh IS NOT NULL THEN '// Inherits from: ' || inh END], lambda x: x IS NOT NULL), chr(10)) AS content FROM b),
u AS (SELECT id, 'code' AS content_type, content FROM t
      UNION ALL SELECT id, 'documentation', array_to_string(list_filter([name || ' (' || kind || ')', 'File: ' || path,
        CASE WHEN ns <> '' THEN 'Namespace: ' || ns END, '', documentation], lambda x: x IS NOT NULL), chr(10)) FROM j WHERE documentation <> '')
SELECT id, content_type, sha256(content) AS content_hash,
       CAST(len(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> '')) AS BIGINT) AS word_count,
       CAST(length(content) AS BIGINT) AS char_count
FROM u""")
def v08_symbol_chunks(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    s, e = probes.v_symbols(t), probes.v_edges(t)
    imports = (e.where(F.col("type") == "IMPORTS").join(s.select(F.col("id").alias("src"), "file_id"), "src")
               .join(s.select(F.col("id").alias("dst"), "name"), "dst").select("file_id", "name"))
    return search.symbol_chunks(s, probes.v_files(t), e, imports=imports)


@register("s01_fuse_lists", sql=f"""
WITH kw AS (SELECT id AS symbol_id, score FROM {KW_SCORED_SQL} ORDER BY score DESC, name, id LIMIT 40),
q AS (SELECT vector::DOUBLE[] AS qv FROM v_vec WHERE chunk_id = {QUERY_VEC_ID}),
sims AS (SELECT symbol_id, round(list_cosine_similarity(vector::DOUBLE[], (SELECT qv FROM q)), 6) AS score FROM v_vec),
vs AS (SELECT symbol_id, max(score) AS score FROM sims WHERE score >= {VEC_THRESHOLD} GROUP BY symbol_id
       ORDER BY score DESC, symbol_id LIMIT 40)
SELECT coalesce(kw.symbol_id, vs.symbol_id) AS symbol_id, CAST(kw.score AS DOUBLE) AS score_a, vs.score AS score_b,
       round(coalesce(CAST(kw.score AS DOUBLE), 0.0) + coalesce(vs.score, 0.0), 6) AS score
FROM kw FULL OUTER JOIN vs ON kw.symbol_id = vs.symbol_id""")
def s01_fuse_lists(spark, sf_dir):
    """S-01: outer union by id of the keyword and vector hit lists with both scores and their sum."""
    from meshlens.operators.relational import fuse_lists
    t = load_tables(spark, sf_dir)
    kw = search.keyword_search(probes.v_symbols(t), QUERY_TEXT, 40).select(F.col("id").alias("symbol_id"),
                                                                          F.col("score").cast("double"))
    vs = search.vector_search(probes.v_vec(t), _qvec(t), 40, VEC_THRESHOLD).select("symbol_id", "score")
    return fuse_lists(kw, vs, "symbol_id").select("symbol_id", "score_a", "score_b", F.round("score", 6).alias("score"))


PARSED_SQL = """(SELECT p_partkey AS id, '{"name": "' || replace(p_name, ' ', '_') || '", "kind": "'
  || CASE p_partkey % 3 WHEN 0 THEN 'METHOD' WHEN 1 THEN 'FUNCTION' ELSE 'CLASS' END || '", "fully_qualified_name": '
  || CASE WHEN p_partkey % 5 = 0 THEN 'null' ELSE '"' || replace(p_brand, '#', '') || '.' || replace(p_name, ' ', '_') || '"' END
  || ', "signature": "public ' || p_type || ' ' || replace(p_name, ' ', '_') || '(int a,  string b)", "return_type": "'
  || p_type || '", "complexity": ' || CASE WHEN p_partkey % 3 = 0 THEN '1' ELSE CAST(p_size AS VARCHAR) END
  || ', "parameters": [' || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '{"name": "a", "type": "int"}'
       ELSE '{"name": "a", "type": "int"}, {"name": "b", "type": "string"}' END || '], "structured_docs": {"is_partial": '
  || CASE WHEN p_partkey % 6 = 0 THEN 'true' ELSE 'false' END || ', "is_lambda": false, "closure_variables": ["x"], '
  || '"linq_pattern": null}}' AS j FROM part)"""


def _parsed(t):
    p = t.part
    k = F.col("p_partkey")
    name = F.regexp_replace("p_name", " ", "_")
    fqn = F.when(k % 5 == 0, F.lit("null")).otherwise(
        F.concat(F.lit('"'), F.regexp_replace("p_brand", "#", ""), F.lit("."), name, F.lit('"')))
    params = (F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.lit('{"name": "a", "type": "int"}'))
              .otherwise(F.lit('{"name": "a", "type": "int"}, {"name": "b", "type": "string"}')))
    j = F.concat(F.lit('{"name": "'), name, F.lit('", "kind": "'),
                 F.when(k % 3 == 0, "METHOD").when(k % 3 == 1, "FUNCTION").otherwise("CLASS"),
                 F.lit('", "fully_qualified_name": '), fqn, F.lit(', "signature": "public '), F.col("p_type"), F.lit(" "),
                 name, F.lit('(int a,  string b)", "return_type": "'), F.col("p_type"), F.lit('", "complexity": '),
                 F.when(k % 3 == 0, F.lit("1")).otherwise(F.col("p_size").cast("string")), F.lit(', "parameters": ['),
                 params, F.lit('], "structured_docs": {"is_partial": '),
                 F.when(k % 6 == 0, F.lit("true")).otherwise(F.lit("false")),
                 F.lit(', "is_lambda": false, "closure_variables": ["x"], "linq_pattern": null}}'))
    return p.select(k.alias("id"), j.alias("j"))


@register("v10_build_symbol_rows", sql=f"""
WITH p AS (SELECT id, j::JSON AS j FROM {PARSED_SQL}),
x AS (SELECT id, j->>'$.name' AS name, j->>'$.kind' AS kind, j->>'$.fully_qualified_name' AS fqn0,
             j->>'$.signature' AS signature, j->>'$.return_type' AS return_type,
             coalesce(CAST(j->>'$.complexity' AS INTEGER), 1) AS c, coalesce(json_array_length(j->'$.parameters'), 0) AS np,
             CAST(j->>'$.structured_docs.is_partial' AS BOOLEAN) AS is_partial,
             CAST(j->>'$.structured_docs.is_lambda' AS BOOLEAN) AS is_lambda,
             from_json(j->'$.structured_docs.closure_variables', '["VARCHAR"]') AS cv,
             j->>'$.structured_docs.linq_pattern' AS linq_pattern FROM p)
SELECT id, name, kind, coalesce(fqn0, name) AS fqn, return_type,
       CAST(CASE WHEN c = 1 AND np > 0 THEN c + np ELSE c END AS INTEGER) AS complexity,
       CAST(CASE WHEN c = 1 AND np > 0 THEN c + np ELSE c END AS INTEGER) AS complexity_score,
       CAST(CASE WHEN signature IS NULL THEN 0 ELSE len(list_filter(string_split_regex(signature, '\\s+'), lambda w: w <> '')) END AS INTEGER) AS token_count,
       CASE WHEN coalesce(is_partial, false) THEN 1 ELSE 0 END AS is_partial,
       CASE WHEN coalesce(is_lambda, false) THEN 1 ELSE 0 END AS is_lambda,
       array_to_string(coalesce(cv, []), ',') AS closure_variables, linq_pattern
FROM x""")
def v10_build_symbol_rows(spark, sf_dir):
    return search.build_symbol_rows(_parsed(load_tables(spark, sf_dir)), "id", "j")
