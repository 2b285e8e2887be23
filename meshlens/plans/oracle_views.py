"""DuckDB text of the probe views (twin of :mod:`meshlens.sources.probes`).

``with_views(body)`` prefixes a query body with exactly the CTEs it names,
in dependency order, so every oracle is one self-contained SQL string over
the driver's pre-registered tables.
"""

from __future__ import annotations

import re

from meshlens.sources.probes import NAME_ENDINGS, TREE_FILES, TREE_FOLDERS

VIEWS: dict[str, str] = {
    "v_files": """
SELECT doc_id AS id, source AS repository, lang AS language, n_chars AS size_bytes,
       text AS content,
       source || '/' || lang || '/d' || CAST(doc_id % 7 AS VARCHAR) || '/' || CAST(doc_id AS VARCHAR) || '.md' AS path,
       CAST(len(string_split(text, chr(10))) AS BIGINT) AS line_count,
       sha256(text) AS content_hash
FROM documents""",
    "v_symbols": """
SELECT p_partkey AS id, p_name AS name, p_type AS signature, p_brand || '.' || p_name AS fqn,
       p_brand AS parent_name, CAST(p_size AS INTEGER) AS complexity, CAST(p_size AS INTEGER) AS start_line,
       CAST(p_size + p_partkey % 60 AS INTEGER) AS end_line,
       CASE p_partkey % 3 WHEN 0 THEN 'METHOD' WHEN 1 THEN 'FUNCTION' ELSE 'VARIABLE' END AS kind,
       CASE p_partkey % 4 WHEN 0 THEN 'PUBLIC' WHEN 1 THEN 'PRIVATE' WHEN 2 THEN 'PROTECTED' END AS access,
       CASE WHEN p_size % 2 = 0 THEN p_type END AS documentation,
       CAST(p_partkey % (SELECT count(*) FROM documents) AS BIGINT) AS file_id
FROM part
UNION ALL
SELECT CAST(1000000000000 + b AS BIGINT) AS id, p_brand AS name, NULL AS signature, p_brand AS fqn,
       NULL AS parent_name, NULL AS complexity, NULL AS start_line, NULL AS end_line,
       CASE WHEN b % 5 = 0 THEN 'INTERFACE' ELSE 'CLASS' END AS kind, 'PUBLIC' AS access,
       NULL AS documentation, CAST(b % (SELECT count(*) FROM documents) AS BIGINT) AS file_id
FROM (SELECT DISTINCT p_brand, CAST(split_part(p_brand, '#', 2) AS INTEGER) AS b FROM part)""",
    "v_brands": """
SELECT DISTINCT CAST(split_part(p_brand, '#', 2) AS INTEGER) AS b FROM part""",
    "v_edges": """
SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst,
       CASE a.l_returnflag WHEN 'A' THEN 'CALLS' WHEN 'N' THEN 'USES' WHEN 'R' THEN 'IMPORTS' END AS type
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
WHERE a.l_partkey <> b.l_partkey
UNION ALL
SELECT CAST(1000000000000 + b AS BIGINT), CAST(1000000000000 + b - b % 5 AS BIGINT), 'IMPLEMENTS'
FROM v_brands WHERE b % 5 <> 0 AND (b - b % 5) IN (SELECT b FROM v_brands)
UNION ALL
SELECT CAST(1000000000000 + b AS BIGINT), CAST(1000000000000 + b - 1 AS BIGINT), 'INHERITS'
FROM v_brands WHERE b % 5 = 2""",
    "v_calls": """
SELECT page_id AS id, url,
       regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS scheme,
       regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1) AS host,
       regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
       regexp_extract(url, '\\?([^#]*)', 1) AS query,
       regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1) AS repository,
       CASE page_id % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' ELSE 'DELETE' END AS http_method
FROM pages""",
    "v_endpoints": """
SELECT id, route, repository, CASE WHEN id % 4 = 0 THEN 'GET' ELSE 'POST' END AS http_method
FROM (SELECT {norm_path} AS route, min(id) AS id, arg_min(host, id) AS repository
      FROM v_calls WHERE id % 2 = 0 GROUP BY 1)""",
    "v_pub": """
SELECT *, CAST(row_number() OVER (ORDER BY event_type, repo, topic, routing_key) AS BIGINT) AS id
FROM (SELECT DISTINCT event_type, user_id % 10 AS repo, 't' || CAST(user_id % 3 AS VARCHAR) AS topic,
             event_type || '.' || CAST(user_id % 2 AS VARCHAR) AS routing_key FROM events)""",
    "v_sub": """
SELECT *, CAST(row_number() OVER (ORDER BY event_type, repo, queue, pattern) AS BIGINT) AS id
FROM (SELECT DISTINCT event_type, user_id % 7 + 5 AS repo, 't' || CAST(user_id % 4 AS VARCHAR) AS queue,
             event_type || '.*' AS pattern FROM events)""",
    "v_jobs": """
SELECT o_orderkey AS id, o_custkey AS repository_id,
       CASE WHEN o_orderstatus = 'P' THEN 'PENDING' WHEN o_orderstatus = 'O' THEN 'RUNNING'
            WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'COMPLETED'
            WHEN o_orderstatus = 'F' THEN 'FAILED' END AS status,
       o_orderdate AS started_at, o_orderdate + INTERVAL 1 DAY AS updated_at,
       CAST(o_orderkey % 5 AS INTEGER) AS retry_count, 3 AS max_retries
FROM orders""",
    "v_vec": """
SELECT vec_id AS chunk_id, vec_id AS symbol_id, label, embedding AS vector FROM embeddings""",
    "v_json": """
SELECT event_id AS id, user_id, event_type, props AS json FROM events""",
    "v_md": """
SELECT doc_id, source, array_to_string(list_transform(string_split(text, chr(10)), lambda x, k:
         CASE WHEN doc_id % 2 = 0 AND k > 7 AND (k - 1) % 7 = 0 THEN
              (CASE WHEN doc_id % 2 = 0 AND k % 7 = 0 AND k < len(string_split(text, chr(10)))
                    THEN '```' || chr(10) ELSE '' END)
              || (CASE WHEN k % 5 = 0 THEN '## ' || x ELSE x END) || chr(10) || '```'
         ELSE (CASE WHEN doc_id % 2 = 0 AND k % 7 = 0 AND k < len(string_split(text, chr(10)))
                    THEN '```' || chr(10) ELSE '' END)
              || (CASE WHEN k % 5 = 0 THEN '## ' || x ELSE x END) END), chr(10)) AS text
FROM documents""",
    "v_code": """
SELECT p_partkey AS id,
  CASE p_partkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'go' WHEN 2 THEN 'typescript' ELSE 'csharp' END AS language,
  CASE p_partkey % 4
    WHEN 0 THEN 'class ' || replace(p_brand, '#', '') || ':' || chr(10) || '    def ' || replace(p_name, ' ', '_')
      || '(self):' || chr(10) || '        return 1' || chr(10) || 'def helper_' || CAST(p_partkey AS VARCHAR) || '():'
      || chr(10) || '    pass'
    WHEN 1 THEN 'func ' || replace(p_name, ' ', '_') || '() {}' || chr(10) || 'type ' || replace(p_brand, '#', '') || ' struct {}'
    WHEN 2 THEN 'export class ' || replace(p_brand, '#', '') || ' {}' || chr(10) || 'export const ' || replace(p_name, ' ', '_')
      || ' = (a) => a;' || chr(10) || 'interface I' || replace(p_brand, '#', '') || ' {}' || chr(10)
      || 'const [v, setV] = useState(0); useEffect(() => {}, []);' || chr(10)
      || 'await fetch(`/api/${v}/' || replace(p_name, ' ', '_') || '`, { method: ''post'' }); axios.get(' || chr(10)
      || '  ' || chr(39) || '/v' || CAST(p_partkey AS VARCHAR) || chr(39) || '); axios({ url: ''/c'', method: "PUT" });'
    ELSE 'public class ' || replace(p_brand, '#', '') || 'Handler : IConsumer<' || replace(p_brand, '#', '') || 'Created> {'
      || chr(10) || '    public async Task<int> ' || replace(p_name, ' ', '_') || '(int a) { await bus.Publish<'
      || replace(p_brand, '#', '') || 'Created>(msg); _bus.Send(new ' || replace(p_brand, '#', '') || 'Command()); }'
      || chr(10) || '  client.GetAsync(' || chr(10) || '    baseUrl + "/api/' || replace(p_name, ' ', '_')
      || '"); api.HttpPost<int>("p/' || CAST(p_partkey AS VARCHAR) || '", d); [HttpGet("no")] x.QueueEvent(Made'
      || replace(p_brand, '#', '') || '(1));' || chr(10)
      || '  new RestRequest($"r/{a["k"]}/' || CAST(p_partkey AS VARCHAR) || '", Method.Put); }' END AS content
FROM part""",
    "v_turns": """
SELECT conv_id, turn, role, text FROM conversations""",
    "v_old": """
SELECT id, repository, path, content, content_hash FROM v_files WHERE id % 10 <> 0""",
    "v_new": """
SELECT id, repository,
       CASE WHEN id % 10 = 3 THEN 'moved/' || path ELSE path END AS path,
       CASE WHEN id % 10 = 2 THEN translate(content, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE content END AS content,
       sha256(CASE WHEN id % 10 = 2 THEN translate(content, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE content END) AS content_hash
FROM v_files WHERE id % 10 <> 1""",
}


def norm_url_sql(expr: str) -> str:
    """DuckDB twin of :func:`meshlens.functions.urls.normalize_url`."""
    s = f"regexp_replace({expr}, '^/+|/+$', '', 'g')"
    s = f"regexp_replace({s}, '\\{{[^}}]+\\}}', '*', 'g')"
    s = f"regexp_replace({s}, ':[^/]+', '*', 'g')"
    s = f"regexp_replace({s}, '[0-9]+', '*', 'g')"
    return f"lower({s})"


_FOLDER = f"[{', '.join(repr(x) for x in TREE_FOLDERS)}][id % {len(TREE_FOLDERS)} + 1]"
_FILE = f"[{', '.join(repr(x) for x in TREE_FILES)}][id % {len(TREE_FILES)} + 1]"
_ENDING = f"[{', '.join(repr(x) for x in NAME_ENDINGS)}][id % {len(NAME_ENDINGS)} + 1]"
VIEWS["v_tree"] = f"""
SELECT * REPLACE (repository || '/' || {_FOLDER} || '/d' || CAST(id % 13 AS VARCHAR) || '/' || CAST(id AS VARCHAR) || '.' || {_FILE} AS path)
FROM v_files"""
VIEWS["v_named"] = f"""
SELECT * REPLACE (replace(name, ' ', '_') || {_ENDING} AS name,
                  CASE WHEN id % 10 = 4 THEN 'System.' ELSE '' END || fqn || {_ENDING} AS fqn),
       {_FOLDER} || '/s' || CAST(id AS VARCHAR) || '.' || {_FILE} AS path
FROM v_symbols"""
VIEWS["v_endpoints"] = VIEWS["v_endpoints"].replace("{norm_path}", norm_url_sql("path"))

_NAME_RE = re.compile(r"\b(v_[a-z_]+)\b")


def _deps(text: str) -> list[str]:
    return [n for n in dict.fromkeys(_NAME_RE.findall(text)) if n in VIEWS]


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the CTEs it references (transitively)."""
    views = dict(VIEWS)
    if extra:
        views.update(extra)
    order: list[str] = []
    seen: set[str] = set()

    def visit(name: str) -> None:
        if name in seen:
            return
        seen.add(name)
        for dep in [n for n in dict.fromkeys(_NAME_RE.findall(views[name])) if n in views and n != name]:
            visit(dep)
        order.append(name)

    for n in [n for n in dict.fromkeys(_NAME_RE.findall(body)) if n in views]:
        visit(n)
    body = body.strip()
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({views[n].strip()})" for n in order)
    m = re.match(r"(?is)^with\s+(recursive\s+)?", body)
    if m:  # merge with the body's own WITH list
        rec = "RECURSIVE " if m.group(1) else ""
        return f"WITH {rec}{ctes},\n{body[m.end():]}"
    return f"WITH {ctes}\n{body}"
