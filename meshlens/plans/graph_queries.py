"""Registered graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlens.functions import code as X
from meshlens.operators import graph as G
from meshlens.operators import linking as L
from meshlens.operators import resolution as RS
from meshlens.plans.catalog import register
from meshlens.plans.link_queries import EVENT_LINKS_SQL, RESOLVE_SQL, links_sql
from meshlens.sources import probes
from meshlens.sources.tables import load_tables, spread

# Fixed values pinned for the probe: traversal seeds are the symbols a search
# for this name returns (the reference traverses from a found symbol).
SEED_NAME = "red widget"
DEPTH = 3


def _t(spark, sf_dir):
    return load_tables(spark, sf_dir)


def _seeds(t):
    return probes.v_symbols(t).where(F.col("name") == SEED_NAME).select(F.col("id").alias("seed"))


def _walk_ctes(depth: int, edges: str, allowed: str | None = None, seeds_sql: str | None = None) -> str:
    """Recursive-CTE twin of :func:`meshlens.operators.graph.traverse`; the
    result is the CTE ``trav``."""
    allow = f" AND e.dst IN (SELECT id FROM {allowed})" if allowed else ""
    seeds_sql = seeds_sql or f"SELECT id AS seed FROM v_symbols WHERE name = '{SEED_NAME}'"
    return f"""seeds AS ({seeds_sql}),
e AS (SELECT DISTINCT src, dst, relation FROM {edges}),
walk(seed, node, depth) AS (
  SELECT seed, seed, 0 FROM seeds
  UNION
  SELECT w.seed, e.dst, w.depth + 1 FROM walk w JOIN e ON e.src = w.node WHERE w.depth < {depth}{allow}),
md AS (SELECT seed, node, min(depth) AS depth FROM walk GROUP BY ALL),
trav AS (SELECT m.seed, m.node, CAST(m.depth AS INTEGER) AS depth, min(e.relation) AS relation, min(p.node) AS parent
  FROM md m JOIN md p ON p.seed = m.seed AND p.depth = m.depth - 1
  JOIN e ON e.src = p.node AND e.dst = m.node
  WHERE m.depth >= 1 GROUP BY m.seed, m.node, m.depth)"""


def _walk_sql(depth: int, edges: str, allowed: str | None = None) -> str:
    return f"WITH RECURSIVE {_walk_ctes(depth, edges, allowed)}\nSELECT * FROM trav"


DOWN_EDGES = "(SELECT src, dst, type AS relation FROM v_edges)"
UP_EDGES = "(SELECT dst AS src, src AS dst, 'CALLED_BY_' || type AS relation FROM v_edges)"


@register("g01_traverse", sql=_walk_sql(DEPTH, DOWN_EDGES))
def g01_traverse(spark, sf_dir):
    t = _t(spark, sf_dir)
    return G.traverse(_seeds(t), probes.v_edges(t), depth=DEPTH, direction="down")


@register("g06_call_tree_up", sql=_walk_sql(2, UP_EDGES))
def g06_call_tree_up(spark, sf_dir):
    """G-06 / G-01 upstream: callers' tree (BFS tree, parent = smallest id one level up)."""
    t = _t(spark, sf_dir)
    return G.traverse(_seeds(t), probes.v_edges(t), depth=2, direction="up")


# Fixed values pinned for the probe: the layers a trace keeps (X-12); external symbols are left out.
LAYERS = ("Controller", "Service", "Repository", "Model", "Unknown")
_EXTERNAL_SQL = " OR ".join(X.contains_any_sql(f"lower({c})", [i.lower() for i in X.EXTERNAL_INDICATORS]) for c in ("path", "fqn"))
NODES_SQL = f"""(SELECT id, {X.layer_sql('name', 'parent_name', 'path', 'kind')} AS layer, {_EXTERNAL_SQL} AS external FROM v_named)"""
ALLOWED_SQL = f"(SELECT id FROM {NODES_SQL} WHERE NOT external AND layer IN ({', '.join(repr(x) for x in LAYERS)}))"


def _layered(t):
    """(id, layer, external) of every symbol."""
    named = spread(probes.v_named(t).select("id", "name", "parent_name", "path", "kind", "fqn"))
    return named.select("id", X.layer(F.col("name"), F.col("parent_name"), F.col("path"), F.col("kind")).alias("layer"),
                        X.is_external(F.col("path"), F.col("fqn")).alias("external"))


def _allowed(t):
    return _layered(t).where(~F.col("external") & F.col("layer").isin(*LAYERS)).select("id")


def _token_nodes(t):
    return probes.v_symbols(t).select(F.col("id").alias("node"), X.token_estimate_signature(
        F.col("signature"), F.col("documentation")).alias("tokens"))


@register("g03_filter_layers", sql=_walk_sql(DEPTH, DOWN_EDGES, ALLOWED_SQL))
def g03_filter_layers(spark, sf_dir):
    """G-03: nodes of other layers and external ones are dropped (not reported, not expanded)."""
    t = _t(spark, sf_dir)
    return G.traverse(_seeds(t), probes.v_edges(t), depth=DEPTH, direction="down", allowed_nodes=_allowed(t))


TOKENS_SQL = """CASE WHEN t = 0 THEN 20 ELSE t END FROM (SELECT id, (coalesce(length(signature), 0)
  + coalesce(CASE WHEN length(documentation) < 200 THEN length(documentation) ELSE 0 END, 0)) // 4 AS t FROM v_symbols)"""


@register("g02_limit_traversal", sql=f"""
WITH RECURSIVE {_walk_ctes(DEPTH, "(SELECT src, dst, type AS relation FROM v_edges)")},
r AS (SELECT trav.*, s.tok, row_number() OVER (PARTITION BY seed ORDER BY depth, node) AS k
      FROM trav JOIN (SELECT id, {TOKENS_SQL.replace('FROM (SELECT id,', 'AS tok FROM (SELECT id,', 1)}) s ON s.id = trav.node),
r2 AS (SELECT *, coalesce(sum(tok) OVER (PARTITION BY seed ORDER BY depth, node
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM r WHERE k <= 51),
r3 AS (SELECT *, k <= 50 AND spent < 10000 AS ok FROM r2),
r4 AS (SELECT *, min(CASE WHEN NOT ok THEN k END) OVER (PARTITION BY seed) AS ff FROM r3)
SELECT seed, node, depth, CAST(k AS BIGINT) AS k, ff IS NOT NULL AS truncated FROM r4 WHERE ff IS NULL OR k < ff""")
def g02_limit_traversal(spark, sf_dir):
    """G-02: seeds leave the frontier at their budget; same rows as cutting the whole traversal."""
    t = _t(spark, sf_dir)
    out = G.budgeted_traverse(_seeds(t), probes.v_edges(t), _token_nodes(t), depth=DEPTH, max_symbols=50, max_tokens=10000)
    return out.select("seed", "node", "depth", "k", "truncated")


@register("g07_cycles_2", sql="""
WITH e AS (SELECT DISTINCT src, dst FROM v_edges WHERE type IN ('IMPORTS', 'USES') AND src <> dst)
SELECT e.src AS a, e.dst AS b FROM e JOIN e r ON r.src = e.dst AND r.dst = e.src WHERE e.src < e.dst""")
def g07_cycles_2(spark, sf_dir):
    return G.cycles_2(probes.v_edges(_t(spark, sf_dir)))


@register("g07_cycles_3", sql="""
WITH e AS (SELECT DISTINCT src, dst FROM v_edges WHERE type IN ('IMPORTS', 'USES') AND src <> dst)
SELECT DISTINCT list_sort([e1.src, e2.src, e3.src])[1] AS a, list_sort([e1.src, e2.src, e3.src])[2] AS b,
       list_sort([e1.src, e2.src, e3.src])[3] AS c
FROM e e1 JOIN e e2 ON e2.src = e1.dst JOIN e e3 ON e3.src = e2.dst AND e3.dst = e1.src
WHERE e1.src <> e2.src AND e2.src <> e3.src AND e1.src <> e3.src""")
def g07_cycles_3(spark, sf_dir):
    return G.cycles_3(probes.v_edges(_t(spark, sf_dir)))


@register("g07_scc")
def g07_scc(spark, sf_dir):
    """G-07 (set form): strongly connected components (≥ 2 nodes) over IMPORTS ∪ USES
    among the brand-type edges and the item edges."""
    return G.strongly_connected(probes.v_edges(_t(spark, sf_dir)), types=("IMPORTS", "USES"))


_TYPES = ("CALLS", "USES", "IMPORTS", "IMPLEMENTS", "INHERITS")


@register("g09_degree_stats", sql="SELECT node, " + ", ".join(
    f"count(*) FILTER (WHERE k = '{d}_{t}') AS {d}_{t.lower()}" for d in ("out", "in") for t in _TYPES) + """
FROM (SELECT src AS node, 'out_' || type AS k FROM v_edges UNION ALL SELECT dst, 'in_' || type FROM v_edges)
GROUP BY node""")
def g09_degree_stats(spark, sf_dir):
    return G.degree_stats(probes.v_edges(_t(spark, sf_dir)), _TYPES)


INTERFACE_KEYS_SQL = """impl AS (SELECT DISTINCT i.id AS iid, i.fqn AS ifqn, c.fqn AS cfqn FROM v_edges e
         JOIN v_symbols i ON i.id = e.dst AND i.kind = 'INTERFACE' JOIN v_symbols c ON c.id = e.src AND c.kind = 'CLASS'
         WHERE e.type = 'IMPLEMENTS'),
iout AS (SELECT DISTINCT m.id AS src, CAST(i.id AS VARCHAR) || ':' || m.name AS key
         FROM v_symbols m JOIN v_symbols i ON i.fqn = m.parent_name AND i.kind = 'INTERFACE' WHERE m.kind = 'METHOD'),
iin AS (SELECT DISTINCT CAST(iid AS VARCHAR) || ':' || m.name AS key, m.id AS dst FROM v_symbols m JOIN impl ON cfqn = m.parent_name
        WHERE m.kind = 'METHOD' AND CAST(iid AS VARCHAR) || ':' || m.name IN (SELECT key FROM iout))"""


@register("g04_interface_keys", sql=f"""
WITH {INTERFACE_KEYS_SQL}
SELECT 'out' AS side, src AS member, key FROM iout UNION ALL SELECT 'in', dst, key FROM iin""")
def g04_interface_keys(spark, sf_dir):
    """G-04 for methods, factored: members of an interface method's key instead of their pairs."""
    t = _t(spark, sf_dir)
    return G.interface_keys(probes.v_symbols(t), probes.v_edges(t)).rows()


@register("g04_interface_edges", sql="""
WITH s AS (SELECT id, name, kind, fqn, parent_name FROM v_symbols),
impl AS (SELECT e.dst AS src, e.src AS dst, 'IMPLEMENTED_BY' AS type FROM v_edges e JOIN s ON s.id = e.dst
         WHERE e.type = 'IMPLEMENTS' AND s.kind = 'INTERFACE'),
heirs AS (SELECT dst AS src, src AS dst, 'INHERITED_BY' AS type FROM v_edges WHERE type = 'INHERITS'),
pairs AS (SELECT i.src AS iid, i.dst AS cid, si.fqn AS ifqn, sc.fqn AS cfqn FROM impl i
          JOIN s si ON si.id = i.src AND si.kind = 'INTERFACE' JOIN s sc ON sc.id = i.dst AND sc.kind = 'CLASS'),
methods AS (SELECT im.id AS src, cm.id AS dst, 'IMPLEMENTED_BY' AS type FROM pairs p
            JOIN s im ON im.parent_name = p.ifqn AND im.kind = 'METHOD'
            JOIN s cm ON cm.parent_name = p.cfqn AND cm.kind = 'METHOD' AND cm.name = im.name)
SELECT DISTINCT * FROM (SELECT * FROM impl UNION ALL SELECT * FROM heirs UNION ALL SELECT * FROM methods)""")
def g04_interface_edges(spark, sf_dir):
    t = _t(spark, sf_dir)
    return G.interface_edges(probes.v_symbols(t), probes.v_edges(t))


# Nodes of the service graph: four times the id, plus the kind, so ranges never meet.
SYMBOL, ENDPOINT, HANDLER = 0, 1, 2


def _service_node(key, kind: int):
    return (key * 4 + kind).alias("node")


def _service_edges(spark, t):
    """G-11 edge set: CALLS between symbols ∪ API links of J-12 (caller symbol → endpoint) ∪ event links (publisher
    symbol → subscription handler), with their confidence.  The call / event rows carry their symbol: part key = row id
    mod part count."""
    from meshlens.plans.link_queries import api_links
    n_parts = t.part.select(F.count(F.lit(1))).scalar()

    def edges(df, src, dst, kind, relation, confidence):
        return df.select((src * 4).alias("src"), (dst * 4 + kind).alias("dst"), F.lit(relation).alias("type"),
                         confidence.cast("int").alias("confidence"))
    calls = edges(probes.v_edges(t).where(F.col("type") == "CALLS"), F.col("src"), F.col("dst"), SYMBOL, "CALLS", F.lit(100))
    api = edges(api_links(spark, t), F.col("call_id") % n_parts, F.col("endpoint_id"), ENDPOINT, "API_CALL",
                F.col("match_confidence"))
    ev = edges(L.link_events(probes.v_pub(t), probes.v_sub(t), fuzzy=False), F.col("pub_id") % n_parts, F.col("sub_id"),
               HANDLER, "EVENT", F.col("match_confidence"))
    return calls.unionByName(api).unionByName(ev)


SERVICE_EDGES_SQL = f"""se AS (SELECT src * 4 AS src, dst * 4 + {SYMBOL} AS dst, 'CALLS' AS relation, 100 AS confidence FROM v_edges WHERE type = 'CALLS'
  UNION ALL SELECT call_id % (SELECT count(*) FROM part) * 4, endpoint_id * 4 + {ENDPOINT}, 'API_CALL',
                   CAST(floor(score * 100 + 1e-9) AS INTEGER) FROM api_links
  UNION ALL SELECT pub_id % (SELECT count(*) FROM part) * 4, sub_id * 4 + {HANDLER}, 'EVENT', match_confidence FROM {EVENT_LINKS_SQL})"""


@register("g11_cross_service_trace", sql=f"""
WITH {links_sql(RESOLVE_SQL)}, {SERVICE_EDGES_SQL},
{_walk_ctes(DEPTH, 'se', seeds_sql=f"SELECT id * 4 AS seed FROM v_symbols WHERE name = '{SEED_NAME}'")}
SELECT trav.seed // 4 AS seed, node // 4 AS id, CAST(node % 4 AS INTEGER) AS kind, depth, trav.relation, parent // 4 AS parent,
       max(se.confidence) AS confidence
FROM trav JOIN se ON se.src = parent AND se.dst = node AND se.relation = trav.relation GROUP BY ALL""")
def g11_cross_service_trace(spark, sf_dir):
    """G-11: one traversal across code calls, API links and event links from
    the seed symbols; each node (symbol 0, endpoint 1, handler 2) carries the kind of edge that first
    reached it and that edge's confidence."""
    t = _t(spark, sf_dir)
    edges = _service_edges(spark, t).groupBy("src", "dst", "type").agg(F.max("confidence").alias("confidence"))
    trav = G.traverse(_seeds(t).select((F.col("seed") * 4).alias("seed")), edges, depth=DEPTH, direction="down")
    taken = edges.select(F.col("src").alias("parent"), F.col("dst").alias("node"), F.col("type").alias("relation"), "confidence")
    quarter = {c: F.floor(F.col(c) / 4) for c in ("seed", "parent")}
    return (trav.join(taken, ["parent", "node", "relation"])
            .select(quarter["seed"].alias("seed"), F.floor(F.col("node") / 4).alias("id"),
                    (F.col("node") % 4).cast("int").alias("kind"), "depth", "relation", quarter["parent"].alias("parent"), "confidence"))


# ----------------------------------------------------------------------------- G-08

from meshlens.plans.link_queries import _templates  # noqa: E402

MATCH_SQL = """(WITH ep AS (SELECT id AS endpoint_id, '/' || replace(route, '*', '{p}') AS template, http_method AS ep_method
                          FROM v_endpoints),
  req AS (SELECT id AS request_id, path, http_method AS req_method FROM v_calls),
  m AS (SELECT r.request_id, e.endpoint_id,
               CASE WHEN regexp_full_match(r.path, '(?i)' || regexp_replace(e.template, '\\{[^}]+\\}', '[^/]+', 'g')) THEN 1
                    WHEN contains(r.path, e.template) OR contains(e.template, r.path) THEN 2 END AS tier
        FROM req r JOIN ep e ON r.req_method IS NULL OR r.req_method = '' OR e.ep_method = r.req_method)
  SELECT request_id, arg_min(endpoint_id, (tier, endpoint_id)) AS endpoint_id FROM m WHERE tier IS NOT NULL GROUP BY request_id)"""
SEEDS_G08 = f"SELECT DISTINCT endpoint_id % (SELECT count(*) FROM part) AS seed FROM {MATCH_SQL}"
TRACE_EDGES_SQL = f"""(SELECT src, dst, type AS relation FROM v_edges
  UNION ALL SELECT src, dst, relation FROM types
  UNION ALL SELECT src, dst, 'IMPLEMENTED_BY' FROM iout JOIN iin USING (key) WHERE src <> dst
  UNION ALL SELECT src, dst, 'HANDLED_BY' FROM handlers)"""
#: Requests and handlers among the symbols of the probe: a symbol is a request by id, its handler the next symbol.
HANDLERS_SQL = """handlers AS (SELECT id AS src, id + 1 AS dst FROM v_symbols
  WHERE id < 1000000000000 AND id % 6 IN (0, 4) AND (id + 1) % 2 = 1 AND id + 1 IN (SELECT id FROM v_symbols))"""


def _request_classes(t):
    """(id, name, bases): requests (every sixth symbol and the one two before it) and handlers named after them."""
    s = probes.v_symbols(t).where(F.col("id") < probes.TYPE_ID_BASE).select("id")
    i = F.col("id")
    bases = F.when(i % 6 == 0, F.array(F.lit("IRequest<int>"))).when(i % 6 == 4, F.array(F.lit("IQuery")))
    return s.select("id", F.when(i % 2 == 0, F.concat(F.lit("R"), i.cast("string"))).otherwise(
        F.concat(F.lit("R"), (i - 1).cast("string"), F.lit("Handler"))).alias("name"),
        F.coalesce(bases, F.array(F.lit("Thing"))).alias("bases"))


@register("g08_request_trace", sql=f"""
WITH RECURSIVE {INTERFACE_KEYS_SQL}, {HANDLERS_SQL},
types AS (SELECT e.dst AS src, e.src AS dst, 'IMPLEMENTED_BY' AS relation FROM v_edges e JOIN v_symbols i ON i.id = e.dst AND i.kind = 'INTERFACE'
          WHERE e.type = 'IMPLEMENTS' UNION SELECT dst, src, 'INHERITED_BY' FROM v_edges WHERE type = 'INHERITS'),
{_walk_ctes(DEPTH, TRACE_EDGES_SQL, ALLOWED_SQL, seeds_sql=SEEDS_G08)},
r AS (SELECT trav.*, s.tok, row_number() OVER (PARTITION BY seed ORDER BY depth, node) AS k
      FROM trav JOIN (SELECT id, {TOKENS_SQL.replace('FROM (SELECT id,', 'AS tok FROM (SELECT id,', 1)}) s ON s.id = trav.node),
r2 AS (SELECT *, coalesce(sum(tok) OVER (PARTITION BY seed ORDER BY depth, node
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM r WHERE k <= 101),
r3 AS (SELECT *, k <= 100 AND spent < 20000 AS ok FROM r2),
r4 AS (SELECT *, min(CASE WHEN NOT ok THEN k END) OVER (PARTITION BY seed) AS ff FROM r3),
kept AS (SELECT r4.seed, r4.node, r4.depth, r4.relation, ff IS NOT NULL AS truncated, n.layer
         FROM r4 JOIN {NODES_SQL} n ON n.id = r4.node WHERE ff IS NULL OR k < ff),
per_seed AS (SELECT seed, count(*) AS n_symbols, max(depth) AS max_depth, bool_or(truncated) AS truncated,
                    count(*) FILTER (relation = 'IMPLEMENTED_BY') AS n_interfaces, count(*) FILTER (relation = 'HANDLED_BY') AS n_handlers,
                    array_to_string(list_sort(list(DISTINCT layer)), ',') AS layers FROM kept GROUP BY seed)
SELECT mt.request_id, mt.endpoint_id, ps.n_symbols, CAST(ps.max_depth AS INTEGER) AS max_depth, ps.truncated, ps.n_interfaces,
       ps.n_handlers, ps.layers
FROM {MATCH_SQL} mt JOIN per_seed ps ON ps.seed = mt.endpoint_id % (SELECT count(*) FROM part)""")
def g08_request_trace(spark, sf_dir):
    """G-08: each request → its endpoint (J-29) → the endpoint's handler symbol (probe: endpoint id mod part count) →
    BFS under the 100-symbol / 20 000-token budget (G-02) that skips other layers and external symbols (G-03) and goes
    on through implementations (G-04) and request handlers (G-05); per request: symbols reached, depth, layers visited
    (X-12), truncation, and how many symbols were reached by the last two."""
    t = _t(spark, sf_dir)
    n_parts = t.part.select(F.count(F.lit(1))).scalar()
    req = probes.v_calls(t).select("id", "path", "http_method")
    m = L.match_endpoint(req, _templates(t)).select("request_id", "endpoint_id")
    seeds = m.select((F.col("endpoint_id") % n_parts).alias("seed")).distinct()
    sym, edges = probes.v_symbols(t), probes.v_edges(t)
    edges = edges.unionByName(G.type_edges(sym, edges)).unionByName(RS.request_handlers(_request_classes(t)))
    nodes = _token_nodes(t).join(_allowed(t).withColumnRenamed("id", "node"), "node", "left_semi")
    kept = G.budgeted_traverse(seeds, edges, nodes, depth=DEPTH, keyed=[G.interface_keys(sym, probes.v_edges(t))],
                               max_symbols=100, max_tokens=20000)
    per_seed = (kept.join(_layered(t).withColumnRenamed("id", "node"), "node").groupBy("seed")
                .agg(F.count(F.lit(1)).alias("n_symbols"), F.max("depth").cast("int").alias("max_depth"),
                     F.max("truncated").alias("truncated"),
                     F.count_if(F.col("relation") == "IMPLEMENTED_BY").alias("n_interfaces"),
                     F.count_if(F.col("relation") == "HANDLED_BY").alias("n_handlers"),
                     F.array_join(F.array_sort(F.collect_set("layer")), ",").alias("layers")))
    return (m.withColumn("seed", F.col("endpoint_id") % n_parts).join(per_seed, "seed")
            .select("request_id", "endpoint_id", "n_symbols", "max_depth", "truncated", "n_interfaces", "n_handlers", "layers"))
