"""Registered resolution / edge-building queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlens.operators import relational as R
from meshlens.operators import resolution as RS
from meshlens.plans.catalog import register
from meshlens.plans.relational_queries import PROJECTS_SQL, _projects
from meshlens.sources import probes
from meshlens.sources.tables import load_tables


def _t(spark, sf_dir):
    return load_tables(spark, sf_dir)


INDEX_SQL = """(SELECT DISTINCT key, symbol_id FROM (
  SELECT name AS key, id AS symbol_id FROM v_symbols UNION ALL SELECT fqn, id FROM v_symbols) WHERE key IS NOT NULL)"""


def _resolve_sql(refs: str, cols: str) -> str:
    """Twin of :func:`meshlens.operators.resolution.resolve_types` over a refs
    subquery with a ``type_name`` column; ``cols`` = the refs columns kept."""
    return f"""(SELECT {cols}, i.symbol_id, 1 AS tier FROM {refs} r JOIN {INDEX_SQL} i ON i.key = r.type_name
  UNION ALL
  SELECT {cols}, i.symbol_id, 2 FROM {refs} r JOIN {INDEX_SQL} i ON i.key = split_part(r.type_name, '.', -1)
  WHERE r.type_name NOT IN (SELECT key FROM {INDEX_SQL}))"""


REFS_SQL = """(SELECT p_partkey AS ref_id, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN 'Acme.Models.' || p_brand
  ELSE p_type END AS type_name FROM part)"""


def _refs(t):
    k = F.col("p_partkey")
    return t.part.select(k.alias("ref_id"), F.when(k % 3 == 0, F.col("p_brand"))
                         .when(k % 3 == 1, F.concat(F.lit("Acme.Models."), F.col("p_brand")))
                         .otherwise(F.col("p_type")).alias("type_name"))


@register("j19_resolve_types", sql="SELECT ref_id, type_name, symbol_id, CAST(tier AS INTEGER) AS tier FROM "
                                    + _resolve_sql(REFS_SQL, "r.ref_id, r.type_name") + " x")
def j19_resolve_types(spark, sf_dir):
    t = _t(spark, sf_dir)
    return RS.resolve_types(_refs(t), probes.v_symbols(t)).select(
        "ref_id", "type_name", "symbol_id", F.col("tier").cast("int"))


@register("j19_resolve_unique", sql=f"""
SELECT ref_id, min(symbol_id) AS symbol_id FROM {_resolve_sql(REFS_SQL, 'r.ref_id')} x
GROUP BY ref_id HAVING count(*) = 1""")
def j19_resolve_unique(spark, sf_dir):
    t = _t(spark, sf_dir)
    return RS.resolve_types_unique(_refs(t), probes.v_symbols(t), "ref_id")


TYPE_REFS_SQL = """(SELECT p_partkey AS src, CASE WHEN t = '' OR t IN ('void', 'string', 'int', 'bool', 'var', 'object',
  'Task', 'List', 'IEnumerable', 'IQueryable') THEN NULL ELSE t END AS type_name FROM (
  SELECT p_partkey, trim(split_part(split_part(raw, '[', 1), '<', 1)) AS t FROM (
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand || '[]' WHEN 1 THEN 'List<' || p_brand || '>'
      WHEN 2 THEN 'Acme.' || p_brand || '<T>' ELSE 'int' END AS raw FROM part)))"""


@register("j24_reference_edges", sql=f"""
WITH refs AS (SELECT DISTINCT src, type_name FROM {TYPE_REFS_SQL} WHERE type_name IS NOT NULL)
SELECT DISTINCT src, symbol_id AS dst, 'REFERENCES' AS type FROM {_resolve_sql('refs', 'r.src, r.type_name')} x
WHERE src <> symbol_id""")
def j24_reference_edges(spark, sf_dir):
    t = _t(spark, sf_dir)
    k = F.col("p_partkey")
    raw = (F.when(k % 4 == 0, F.concat("p_brand", F.lit("[]")))
           .when(k % 4 == 1, F.concat(F.lit("List<"), F.col("p_brand"), F.lit(">")))
           .when(k % 4 == 2, F.concat(F.lit("Acme."), F.col("p_brand"), F.lit("<T>"))).otherwise(F.lit("int")))
    refs = t.part.select(k.alias("symbol_id"), raw.alias("type_name"))
    return RS.reference_edges(probes.v_symbols(t), refs)


SIG_SYMBOLS_SQL = """(SELECT id, name, kind, fqn, CASE WHEN id >= 1000000000000 THEN 'class ' || name || ' : Brand#'
  || CAST(id - 1000000000000 + 1 AS VARCHAR) || ', IMissing' ELSE signature END AS signature FROM v_symbols)"""


def _sig_symbols(t):
    s = probes.v_symbols(t)
    sig = F.when(F.col("id") >= 1_000_000_000_000, F.concat(F.lit("class "), F.col("name"), F.lit(" : Brand#"),
                                                     (F.col("id") - 1_000_000_000_000 + 1).cast("string"),
                                                     F.lit(", IMissing"))).otherwise(F.col("signature"))
    return s.withColumn("signature", sig)


def _base_types_sql(sig: str) -> str:
    from meshlens.plans.text_queries import _base_types_sql as b
    return b(sig)


@register("j26_inheritance_edges", sql=f"""
WITH t AS (SELECT DISTINCT id AS src, unnest({_base_types_sql('signature')}) AS type_name
           FROM {SIG_SYMBOLS_SQL} WHERE kind IN ('CLASS', 'INTERFACE') AND signature IS NOT NULL)
SELECT DISTINCT src, symbol_id AS dst, 'INHERITS' AS type FROM {_resolve_sql('t', 'r.src, r.type_name')} x
WHERE src <> symbol_id""")
def j26_inheritance_edges(spark, sf_dir):
    return RS.inheritance_edges(_sig_symbols(_t(spark, sf_dir)))


METHODS_SQL = """(SELECT p_partkey AS id, p_name AS name,
  CASE p_partkey % 3 WHEN 0 THEN 'METHOD' WHEN 1 THEN 'FUNCTION' ELSE 'VARIABLE' END AS kind,
  p_size % 5 = 0 AS is_override, p_size % 5 = 1 AS is_virtual, p_size % 7 = 0 AS is_abstract FROM part)"""


@register("j27_override_edges", sql=f"""
SELECT o.id AS src, v.id AS dst, 'OVERRIDES' AS type FROM {METHODS_SQL} o JOIN {METHODS_SQL} v ON v.name = o.name
WHERE o.kind = 'METHOD' AND o.is_override AND (v.is_virtual OR v.is_abstract) AND o.id <> v.id""")
def j27_override_edges(spark, sf_dir):
    return RS.override_edges(_methods(_t(spark, sf_dir)))


def _methods(t):
    k = F.col("p_partkey")
    return t.part.select(
        k.alias("id"), F.col("p_name").alias("name"),
        F.when(k % 3 == 0, "METHOD").when(k % 3 == 1, "FUNCTION").otherwise("VARIABLE").alias("kind"),
        (F.col("p_size") % 5 == 0).alias("is_override"), (F.col("p_size") % 5 == 1).alias("is_virtual"),
        (F.col("p_size") % 7 == 0).alias("is_abstract"))


@register("j27_override_keys", sql=f"""
WITH o AS (SELECT DISTINCT id, name FROM {METHODS_SQL} WHERE kind = 'METHOD' AND is_override)
SELECT 'out' AS side, id AS member, name AS key FROM o
UNION ALL SELECT 'in', id, name FROM {METHODS_SQL} WHERE (is_virtual OR is_abstract) AND name IN (SELECT name FROM o)""")
def j27_override_keys(spark, sf_dir):
    """J-27 factored by name: members instead of pairs."""
    return RS.override_keys(_methods(_t(spark, sf_dir))).rows()


@register("j28_containment_edges", sql="""
SELECT min(p.id) AS src, k.id AS dst, 'CONTAINS' AS type
FROM v_symbols k JOIN v_symbols p ON p.fqn = k.parent_name AND p.file_id = k.file_id
WHERE k.parent_name IS NOT NULL AND k.id <> p.id GROUP BY k.id""")
def j28_containment_edges(spark, sf_dir):
    return RS.containment_edges(probes.v_symbols(_t(spark, sf_dir)))


CALLS_SQL = """(SELECT CAST(e.src AS VARCHAR) || ':' || CAST(e.dst AS VARCHAR) AS call_id, e.src AS caller_id,
  d.name AS callee_name FROM v_edges e JOIN v_symbols d ON d.id = e.dst WHERE e.type = 'CALLS')"""
SYMS_REPO_SQL = "(SELECT s.*, f.repository FROM v_symbols s JOIN v_files f ON f.id = s.file_id)"


@register("j20_resolve_calls", sql=f"""
WITH s AS {SYMS_REPO_SQL},
c AS (SELECT * FROM s WHERE kind IN ('METHOD', 'FUNCTION')),
t1 AS (SELECT file_id, parent_name, name, min(id) AS t1 FROM c GROUP BY ALL),
t2 AS (SELECT parent_name, name, min(id) AS t2 FROM c WHERE parent_name IS NOT NULL GROUP BY ALL),
t3 AS (SELECT repository, name, min(id) AS t3 FROM c GROUP BY ALL),
j AS (SELECT k.call_id, k.caller_id, t1.t1, t2.t2, t3.t3 FROM {CALLS_SQL} k JOIN s ON s.id = k.caller_id
      LEFT JOIN t1 ON t1.file_id = s.file_id AND t1.parent_name = s.parent_name AND t1.name = k.callee_name
      LEFT JOIN t2 ON t2.parent_name = s.parent_name AND t2.name = k.callee_name
      LEFT JOIN t3 ON t3.repository = s.repository AND t3.name = k.callee_name)
SELECT call_id, caller_id, coalesce(t1, t2, t3) AS target_id,
       CASE WHEN t1 IS NOT NULL THEN 1 WHEN t2 IS NOT NULL THEN 2 ELSE 3 END AS tier
FROM j WHERE coalesce(t1, t2, t3) IS NOT NULL""")
def j20_resolve_calls(spark, sf_dir):
    t = _t(spark, sf_dir)
    s = probes.v_symbols(t)
    syms = s.join(probes.v_files(t).select(F.col("id").alias("file_id"), "repository"), "file_id")
    names = s.select(F.col("id").alias("dst"), F.col("name").alias("callee_name"))
    calls = (probes.v_edges(t).where(F.col("type") == "CALLS").join(names, "dst")
             .select(F.concat(F.col("src").cast("string"), F.lit(":"), F.col("dst").cast("string")).alias("call_id"),
                     F.col("src").alias("caller_id"), "callee_name"))
    return RS.resolve_calls(calls, syms).select("call_id", "caller_id", "target_id", F.col("tier").cast("int"))


# Symbols in namespaces, calls with receivers, declarations and imports of the probe.
SPACED_SQL = """(SELECT id, name, kind, file_id, 'r' || CAST(file_id % 2 AS VARCHAR) AS repository,
  CASE WHEN parent_name IS NULL THEN 'ns' || CAST(id % 3 AS VARCHAR) || '.' || fqn ELSE fqn END AS fqn,
  'ns' || CAST((1000000000000 + CAST(split_part(parent_name, '#', 2) AS BIGINT)) % 3 AS VARCHAR) || '.' || parent_name AS parent_name FROM v_symbols)"""
RECEIVER_CALLS_SQL = """(SELECT CAST(e.src AS VARCHAR) || ':' || CAST(e.dst AS VARCHAR) AS call_id, e.src AS caller_id, d.name AS callee_name,
  CASE e.src % 4 WHEN 1 THEN 'this' WHEN 2 THEN 'v' || CAST(e.dst % 5 AS VARCHAR) WHEN 3 THEN d.parent_name END AS receiver, e.dst % 50 AS line
  FROM v_edges e JOIN v_symbols d ON d.id = e.dst WHERE e.type = 'CALLS')"""
DECLARATIONS_SQL = """(SELECT file_id, 'v' || CAST(id % 5 AS VARCHAR) AS name, parent_name AS type_name, start_line AS line,
  start_line - 10 AS scope_start, end_line + 20 AS scope_end FROM v_symbols WHERE kind = 'VARIABLE')"""
FILE_IMPORTS_SQL = "(SELECT id AS file_id, 'ns' || CAST(id % 4 AS VARCHAR) AS module FROM v_files)"


def _spaced(t):
    def space(n):
        return F.concat(F.lit("ns"), (n % 3).cast("string"), F.lit("."))
    number = F.lit(probes.TYPE_ID_BASE) + F.substring_index("parent_name", "#", -1).cast("long")
    return probes.v_symbols(t).select(
        "id", "name", "kind", "file_id", F.concat(F.lit("r"), (F.col("file_id") % 2).cast("string")).alias("repository"),
        F.when(F.col("parent_name").isNull(), F.concat(space(F.col("id")), "fqn")).otherwise(F.col("fqn")).alias("fqn"),
        F.concat(space(number), "parent_name").alias("parent_name"))


def _receiver_calls(t):
    d = probes.v_symbols(t).select(F.col("id").alias("dst"), F.col("name").alias("callee_name"), "parent_name")
    e = probes.v_edges(t).where(F.col("type") == "CALLS").join(d, "dst")
    k = F.col("src") % 4
    receiver = F.when(k == 1, F.lit("this")).when(k == 2, F.concat(F.lit("v"), (F.col("dst") % 5).cast("string"))).when(k == 3, F.col("parent_name"))
    return e.select(F.concat(F.col("src").cast("string"), F.lit(":"), F.col("dst").cast("string")).alias("call_id"),
                    F.col("src").alias("caller_id"), "callee_name", receiver.alias("receiver"), (F.col("dst") % 50).alias("line"))


@register("j20_receiver_calls", sql=f"""
WITH s AS {SPACED_SQL}, k AS {RECEIVER_CALLS_SQL}, dcl AS {DECLARATIONS_SQL}, imp AS {FILE_IMPORTS_SQL},
c0 AS (SELECT k.*, s.file_id, s.parent_name, s.repository FROM k JOIN s ON s.id = k.caller_id),
ty AS (SELECT call_id, max(struct_pack(l := dcl.line, sc := scope_start, t := type_name)).t AS type_name FROM c0 JOIN dcl
       ON dcl.file_id = c0.file_id AND dcl.name = c0.receiver AND c0.line BETWEEN scope_start AND scope_end AND dcl.line <= c0.line GROUP BY call_id),
c AS (SELECT c0.*, type_name, coalesce(receiver, '') IN ('', 'this', 'base') AS self_call,
             CASE WHEN coalesce(receiver, '') NOT IN ('', 'this', 'base') THEN coalesce(type_name, receiver) END AS cls FROM c0 LEFT JOIN ty USING (call_id)),
f AS (SELECT call_id, repository, callee_name, cls AS fqn FROM c WHERE cls IS NOT NULL
      UNION ALL SELECT call_id, repository, callee_name, module || '.' || cls FROM c JOIN imp USING (file_id) WHERE cls IS NOT NULL),
x AS (SELECT f.call_id, min(m.id) AS t3 FROM f JOIN s k ON k.repository = f.repository AND k.fqn = f.fqn AND k.kind IN ('CLASS', 'INTERFACE')
      LEFT JOIN s m ON m.kind = 'METHOD' AND m.parent_name = k.fqn AND m.name = f.callee_name GROUP BY f.call_id),
j AS (SELECT c.call_id, c.caller_id, c.type_name,
  CASE WHEN self_call THEN (SELECT min(id) FROM s WHERE kind IN ('METHOD', 'FUNCTION') AND s.file_id = c.file_id AND s.parent_name = c.parent_name AND s.name = c.callee_name) END AS t1,
  (SELECT min(m.id) FROM s k JOIN s m ON m.parent_name = k.fqn AND m.kind = 'METHOD'
   WHERE k.kind = 'CLASS' AND k.repository = c.repository AND k.fqn = c.parent_name AND m.name = c.callee_name) AS t2,
  CASE WHEN x.call_id IS NOT NULL THEN x.t3 ELSE (SELECT min(m.id) FROM s k JOIN s m ON m.parent_name = k.fqn AND m.kind = 'METHOD'
   WHERE k.kind IN ('CLASS', 'INTERFACE') AND k.repository = c.repository AND k.name = c.cls AND m.name = c.callee_name) END AS t3,
  (SELECT min(id) FROM s WHERE kind IN ('METHOD', 'FUNCTION') AND s.repository = c.repository AND s.name = c.callee_name) AS t4
  FROM c LEFT JOIN x USING (call_id))
SELECT call_id, caller_id, coalesce(t1, t2, t3, t4) AS target_id,
       CASE WHEN t1 IS NOT NULL THEN 1 WHEN t2 IS NOT NULL THEN 2 WHEN t3 IS NOT NULL THEN 3 ELSE 4 END AS tier, type_name
FROM j WHERE coalesce(t1, t2, t3, t4) IS NOT NULL""")
def j20_receiver_calls(spark, sf_dir):
    """J-20 with typed receivers, own classes, imported namespaces and the repository as last resort."""
    t = _t(spark, sf_dir)
    s = probes.v_symbols(t).where(F.col("kind") == "VARIABLE")
    decl = s.select("file_id", F.concat(F.lit("v"), (F.col("id") % 5).cast("string")).alias("name"), F.col("parent_name").alias("type_name"),
                    F.col("start_line").alias("line"), (F.col("start_line") - 10).alias("scope_start"), (F.col("end_line") + 20).alias("scope_end"))
    imports = probes.v_files(t).select(F.col("id").alias("file_id"), F.concat(F.lit("ns"), (F.col("id") % 4).cast("string")).alias("module"))
    return RS.resolve_receiver_calls(_receiver_calls(t), _spaced(t), decl, imports)


# Named imports: every symbol's file imports the next symbol's name from a file that may only re-export it.
NAMED_SQL = """(SELECT s.id AS import_id, (s.file_id + s.id % 4) % (SELECT count(*) FROM documents) AS file_id, s.name FROM v_symbols s WHERE s.parent_name IS NOT NULL)"""
REEXPORTS_SQL = """(SELECT id AS file_id, (id + (SELECT count(*) FROM documents) - 1) % (SELECT count(*) FROM documents) AS from_file_id, NULL::VARCHAR AS name FROM v_files WHERE id % 3 <> 0
  UNION ALL SELECT file_id, (file_id + (SELECT count(*) FROM documents) - 2) % (SELECT count(*) FROM documents), name FROM v_symbols WHERE id % 5 = 0 AND parent_name IS NOT NULL)"""


@register("j22_named_imports", sql=f"""
WITH RECURSIVE n AS {NAMED_SQL}, r AS {REEXPORTS_SQL},
own AS (SELECT file_id, name, min(id) AS symbol_id FROM v_symbols GROUP BY ALL),
w(file_id, name, loc, hops, symbol_id) AS (
  SELECT DISTINCT n.file_id, n.name, n.file_id, 0, o.symbol_id FROM n LEFT JOIN own o ON o.file_id = n.file_id AND o.name = n.name
  UNION
  SELECT w.file_id, w.name, r.from_file_id, w.hops + 1, o.symbol_id FROM w JOIN r ON r.file_id = w.loc AND coalesce(r.name, w.name) = w.name
  LEFT JOIN own o ON o.file_id = r.from_file_id AND o.name = w.name WHERE w.symbol_id IS NULL AND w.hops < 12),
b AS (SELECT file_id, name, min(struct_pack(h := hops, s := symbol_id)) AS b FROM w WHERE symbol_id IS NOT NULL GROUP BY ALL)
SELECT import_id, b.s AS symbol_id, b.h AS hops FROM n JOIN b USING (file_id, name)""")
def j22_named_imports(spark, sf_dir):
    """J-22: named imports → symbols, through re-exports."""
    t = _t(spark, sf_dir)
    n = t.documents.select(F.count(F.lit(1))).scalar()
    s = probes.v_symbols(t)
    members = s.where(F.col("parent_name").isNotNull())
    named = members.select(F.col("id").alias("import_id"), ((F.col("file_id") + F.col("id") % 4) % n).alias("file_id"), "name")
    every = probes.v_files(t).where(F.col("id") % 3 != 0).select(F.col("id").alias("file_id"), ((F.col("id") + n - 1) % n).alias("from_file_id"),
                                                                 F.lit(None).cast("string").alias("name"))
    some = members.where(F.col("id") % 5 == 0).select("file_id", ((F.col("file_id") + n - 2) % n).alias("from_file_id"), "name")
    return RS.named_import_edges(named, s, every.unionByName(some))


IMPORTS_SQL = """(SELECT id AS import_id, path AS file_path, CASE id % 3
  WHEN 0 THEN './' || CAST(id + 140 AS VARCHAR)
  WHEN 1 THEN '../d' || CAST((id + 20) % 7 AS VARCHAR) || '/' || CAST(id + 20 AS VARCHAR)
  ELSE '@/x/' || CAST(id AS VARCHAR) END AS spec FROM v_files)"""


def _imports(t):
    f = probes.v_files(t)
    i = F.col("id")
    # sources are src<id mod 20> and directories d<id mod 7>: id + 140 stays in the
    # same directory, id + 20 in a sibling directory of the same source
    spec = (F.when(i % 3 == 0, F.concat(F.lit("./"), (i + 140).cast("string")))
            .when(i % 3 == 1, F.concat(F.lit("../d"), ((i + 20) % 7).cast("string"), F.lit("/"), (i + 20).cast("string")))
            .otherwise(F.concat(F.lit("@/x/"), i.cast("string"))))
    return f.select(i.alias("import_id"), F.col("path").alias("file_path"), spec.alias("spec"))


_SUFFIXES_SQL = "[" + ", ".join(f"'{s}'" for s in RS.IMPORT_SUFFIXES) + "]"


@register("j22_resolve_imports", sql=f"""
WITH i AS {IMPORTS_SQL},
r AS (SELECT import_id, CASE WHEN starts_with(spec, './') OR starts_with(spec, '../')
                             THEN regexp_extract(file_path, '^(.*)/[^/]*$', 1) || '/' || spec
                             WHEN starts_with(spec, '@/') THEN 'src/' || substr(spec, 3) ELSE spec END AS resolved FROM i),
n AS (SELECT import_id, array_to_string(list_reduce(list_filter(string_split(resolved, '/'), lambda s: s <> '' AND s <> '.'),
        lambda acc, s: CASE WHEN s = '..' THEN acc[1:greatest(len(acc) - 1, 0)] ELSE list_append(acc, s) END,
        []::VARCHAR[]), '/') AS base FROM r),
c AS (SELECT import_id, base || ({_SUFFIXES_SQL})[k] AS path, k - 1 AS rank
      FROM n, unnest(generate_series(1, {len(RS.IMPORT_SUFFIXES)})) AS g(k)),
best AS (SELECT c.import_id, arg_min(f.id, c.rank) AS file_id, min(c.rank) AS rank FROM c JOIN v_files f ON f.path = c.path
         GROUP BY c.import_id)
SELECT i.import_id, best.file_id, CAST(best.rank AS INTEGER) AS rank FROM i LEFT JOIN best USING (import_id)""")
def j22_resolve_imports(spark, sf_dir):
    t = _t(spark, sf_dir)
    out = RS.resolve_imports(_imports(t), probes.v_files(t))
    return out.select("import_id", "file_id", F.col("rank").cast("int"))


# Aliases of the probe: two prefixes of different length for every source folder.
ALIASES_SQL = """(SELECT '@' || repository AS prefix, repository AS target FROM (SELECT DISTINCT repository FROM v_files)
  UNION ALL SELECT '@' || repository || '/x', repository || '/' || lang FROM (SELECT repository, min(language) AS lang FROM v_files GROUP BY repository))"""
ALIASED_SQL = """(SELECT id AS import_id, path AS file_path, CASE id % 4 WHEN 0 THEN '@' || repository || '/' || language || '/d' || CAST(id % 7 AS VARCHAR) || '/' || CAST(id AS VARCHAR)
  WHEN 1 THEN '@' || repository || '/x/d' || CAST(id % 7 AS VARCHAR) || '/' || CAST(id AS VARCHAR) WHEN 2 THEN repository || '.' || language || '.d' || CAST(id % 7 AS VARCHAR) || '.' || CAST(id AS VARCHAR)
  ELSE './' || CAST(id + 140 AS VARCHAR) END AS spec FROM v_files)"""


@register("j22_aliased_imports", sql=f"""
WITH i AS {ALIASED_SQL}, a AS {ALIASES_SQL},
b AS (SELECT import_id, arg_max(struct_pack(p := prefix, t := target), length(prefix)) AS b FROM i JOIN a
      ON NOT starts_with(spec, '.') AND (spec = prefix OR starts_with(spec, prefix || '/')) GROUP BY import_id)
SELECT i.import_id, CASE WHEN b.b IS NOT NULL THEN b.b.t || substr(spec, length(b.b.p) + 1)
  WHEN NOT contains(spec, '/') AND regexp_matches(spec, '^\\w+(\\.\\w+)+$') THEN replace(spec, '.', '/') ELSE spec END AS spec,
  f.id AS file_id
FROM i LEFT JOIN b USING (import_id) LEFT JOIN v_files f ON f.path = CASE WHEN b.b IS NOT NULL THEN b.b.t || substr(spec, length(b.b.p) + 1)
  WHEN NOT contains(spec, '/') AND regexp_matches(spec, '^\\w+(\\.\\w+)+$') THEN replace(spec, '.', '/')
  WHEN starts_with(spec, './') THEN regexp_extract(file_path, '^(.*)/[^/]*$', 1) || substr(spec, 2) ELSE spec END || '.md'""")
def j22_aliased_imports(spark, sf_dir):
    """J-22 with an alias table (longest prefix) and dotted package paths."""
    t = _t(spark, sf_dir)
    f = probes.v_files(t)
    i, repo = F.col("id"), F.col("repository")
    tail = [F.concat(F.lit("d"), (i % 7).cast("string")), i.cast("string")]
    at = F.concat(F.lit("@"), repo)
    spec = (F.when(i % 4 == 0, F.concat_ws("/", at, "language", *tail)).when(i % 4 == 1, F.concat_ws("/", at, F.lit("x"), *tail))
            .when(i % 4 == 2, F.concat_ws(".", repo, "language", *tail)).otherwise(F.concat(F.lit("./"), (i + 140).cast("string"))))
    imports = f.select(i.alias("import_id"), F.col("path").alias("file_path"), spec.alias("spec"))
    per = f.groupBy("repository").agg(F.min("language").alias("lang"))
    aliases = per.select(at.alias("prefix"), repo.alias("target")).unionByName(
        per.select(F.concat(at, F.lit("/x")).alias("prefix"), F.concat_ws("/", repo, "lang").alias("target")))
    aliased = RS.apply_aliases(imports, aliases)
    return aliased.select("import_id", "spec").join(RS.resolve_imports(aliased, f).select("import_id", "file_id"), "import_id")


@register("j34_link_symbols_to_service", sql=f"""
WITH p AS (SELECT id AS project_id, regexp_replace(project_path, '/[^/]*$', '') AS dir FROM {PROJECTS_SQL}),
anc AS (SELECT f.id, k AS depth, array_to_string(string_split(f.path, '/')[1:k], '/') AS dir
        FROM v_files f, unnest(generate_series(1, greatest(len(string_split(f.path, '/')) - 1, 1))) AS g(k)
        WHERE len(string_split(f.path, '/')) > 1),
fp AS (SELECT a.id AS file_id, arg_max(p.project_id, (a.depth, -p.project_id)) AS project_id FROM anc a JOIN p USING (dir)
       GROUP BY a.id)
SELECT s.id, fp.project_id % 5 AS service_id FROM v_symbols s LEFT JOIN fp ON fp.file_id = s.file_id""")
def j34_link_symbols_to_service(spark, sf_dir):
    """J-34: symbol → its file's deepest project (J-18) → that project's
    service (probe: service = project id mod 5)."""
    t = _t(spark, sf_dir)
    fp = R.assign_files_to_projects(probes.v_files(t), _projects(t))
    ps = _projects(t).select(F.col("id").alias("project_id"), (F.col("id") % 5).alias("service_id"))
    return RS.link_symbols_to_service(probes.v_symbols(t), fp, ps)


USAGES_SQL = """(SELECT CAST(e.src AS VARCHAR) || ':' || CAST(e.dst AS VARCHAR) AS usage_id, e.src AS user_id,
  d.name AS member_name, CASE WHEN e.src % 2 = 0 THEN d.parent_name END AS receiver_type,
  CASE WHEN e.src % 3 = 0 THEN d.fqn END AS qualified
  FROM v_edges e JOIN v_symbols d ON d.id = e.dst WHERE e.type = 'USES')"""


@register("j21_resolve_usages", sql=f"""
WITH u AS (SELECT x.*, s.parent_name AS own_class FROM {USAGES_SQL} x LEFT JOIN v_symbols s ON s.id = x.user_id),
t1 AS (SELECT parent_name, name, min(id) AS t FROM v_symbols WHERE parent_name IS NOT NULL GROUP BY ALL),
t3 AS (SELECT fqn, min(id) AS t FROM v_symbols WHERE fqn IS NOT NULL GROUP BY fqn),
j AS (SELECT u.usage_id, u.user_id, a.t AS t1, b.t AS t2, c.t AS t3 FROM u
      LEFT JOIN t1 a ON a.parent_name = u.own_class AND a.name = u.member_name
      LEFT JOIN t1 b ON b.parent_name = u.receiver_type AND b.name = u.member_name
      LEFT JOIN t3 c ON c.fqn = u.qualified)
SELECT usage_id, user_id, coalesce(t1, t2, t3) AS target_id,
       CAST(CASE WHEN t1 IS NOT NULL THEN 1 WHEN t2 IS NOT NULL THEN 2 ELSE 3 END AS INTEGER) AS tier
FROM j WHERE coalesce(t1, t2, t3) IS NOT NULL""")
def j21_resolve_usages(spark, sf_dir):
    """J-21 over USES edges seen as member usages (the used member's name,
    its type as receiver for even users, its FQN as static reference for
    users divisible by 3)."""
    t = _t(spark, sf_dir)
    s = probes.v_symbols(t)
    d = s.select(F.col("id").alias("dst"), F.col("name").alias("member_name"), F.col("parent_name").alias("ptype"),
                 F.col("fqn").alias("dfqn"))
    u = (probes.v_edges(t).where(F.col("type") == "USES").join(d, "dst")
         .select(F.concat(F.col("src").cast("string"), F.lit(":"), F.col("dst").cast("string")).alias("usage_id"),
                 F.col("src").alias("user_id"), "member_name",
                 F.when(F.col("src") % 2 == 0, F.col("ptype")).alias("receiver_type"),
                 F.when(F.col("src") % 3 == 0, F.col("dfqn")).alias("qualified")))
    return RS.resolve_usages(u, s).select("usage_id", "user_id", "target_id", F.col("tier").cast("int"))


EXISTING_SQL = f"""(SELECT id, id % 3 AS repository_id, project_path AS file_path,
  CASE WHEN id % 2 = 0 THEN 'g' || CAST(id AS VARCHAR) END AS project_guid,
  CASE WHEN id % 5 = 0 THEN 'orphan' ELSE regexp_replace(split_part(project_path, '/', -1), '\\.csproj$', '') END AS name
  FROM {PROJECTS_SQL})"""
NEW_SQL = f"""(SELECT id + 2000000000000 AS id, repository_id,
  CASE id % 4 WHEN 0 THEN file_path WHEN 1 THEN 'moved/' || file_path WHEN 2 THEN '/app/' || file_path
              ELSE 'other/' || file_path END AS file_path,
  CASE WHEN id % 4 = 1 THEN project_guid END AS project_guid,
  CASE WHEN id % 5 = 0 THEN 'orphan' ELSE name END AS name FROM {EXISTING_SQL})"""


def _existing_projects(t):
    p = _projects(t)
    i = F.col("id")
    return p.select("id", (i % 3).alias("repository_id"), F.col("project_path").alias("file_path"),
                    F.when(i % 2 == 0, F.concat(F.lit("g"), i.cast("string"))).alias("project_guid"),
                    F.when(i % 5 == 0, F.lit("orphan")).otherwise(
                        F.regexp_replace(F.element_at(F.split("project_path", "/"), -1), r"\.csproj$", "")).alias("name"))


def _new_projects(t):
    e = _existing_projects(t)
    i = F.col("id")
    path = (F.when(i % 4 == 0, F.col("file_path")).when(i % 4 == 1, F.concat(F.lit("moved/"), F.col("file_path")))
            .when(i % 4 == 2, F.concat(F.lit("/app/"), F.col("file_path"))).otherwise(F.concat(F.lit("other/"), F.col("file_path"))))
    return e.select((i + 2000000000000).alias("id"), "repository_id", path.alias("file_path"),
                    F.when(i % 4 == 1, F.col("project_guid")).alias("project_guid"), "name")


@register("a21_match_existing_project", sql=f"""
WITH ex AS {EXISTING_SQL}, nw AS {NEW_SQL},
m AS (SELECT n.id AS nid, e.id AS eid, 1 AS tier FROM nw n JOIN ex e ON e.repository_id = n.repository_id AND e.file_path = n.file_path
  UNION ALL SELECT n.id, e.id, 2 FROM nw n JOIN ex e ON e.repository_id = n.repository_id AND e.project_guid = n.project_guid
    WHERE trim(coalesce(n.project_guid, '')) <> ''
  UNION ALL SELECT n.id, e.id, 3 FROM nw n JOIN ex e ON e.repository_id = n.repository_id AND e.name = n.name
    WHERE (ends_with(e.file_path, n.file_path) AND n.file_path <> '') OR (ends_with(n.file_path, e.file_path) AND e.file_path <> '')
  UNION ALL SELECT n.id, e.id, 4 FROM nw n JOIN ex e ON e.repository_id = n.repository_id AND e.name = n.name
    WHERE coalesce(e.file_path, '') = ''),
best AS (SELECT nid, arg_min(eid, (tier, eid)) AS existing_id, min(tier) AS tier FROM m GROUP BY nid)
SELECT nw.id, best.existing_id, CAST(best.tier AS INTEGER) AS tier FROM nw LEFT JOIN best ON best.nid = nw.id""")
def a21_match_existing_project(spark, sf_dir):
    t = _t(spark, sf_dir)
    out = RS.match_existing_project(_new_projects(t), _existing_projects(t))
    return out.select("id", "existing_id", F.col("tier").cast("int"))


SD_SQL = """(SELECT p_partkey AS id, p_name AS name, p_brand || '.' || p_name AS fqn,
  '{"references": [{"type": "di_registration", "name": "' || CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'Acme.' || p_brand END
  || '<IOptions>", "line": 3}, {"type": "variable", "name": "tmp"}, {"type": "di_registration", "name": "Missing"}],'
  || ' "lambdas": [{"name": "lambda_' || CAST(p_partkey AS VARCHAR) || '", "fully_qualified_name": "' || p_brand || '.'
  || replace(p_name, ' ', '_') || '.lambda", "start_line": ' || CAST(p_size AS VARCHAR) || ', "end_line": '
  || CAST(p_size + 2 AS VARCHAR) || ', "signature": "x => x", "closure_variables": ["a", "b' || CAST(p_partkey % 3 AS VARCHAR)
  || '"], "linq_pattern": "Select"}]}' AS structured_docs FROM part)"""


def _sd_symbols(t):
    p = t.part
    k = F.col("p_partkey")
    ref = F.when(k % 2 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("Acme."), F.col("p_brand")))
    sd = F.concat(F.lit('{"references": [{"type": "di_registration", "name": "'), ref,
                  F.lit('<IOptions>", "line": 3}, {"type": "variable", "name": "tmp"}, {"type": "di_registration", "name": "Missing"}], '
                        '"lambdas": [{"name": "lambda_'), k.cast("string"), F.lit('", "fully_qualified_name": "'),
                  F.col("p_brand"), F.lit("."), F.regexp_replace("p_name", " ", "_"), F.lit('.lambda", "start_line": '),
                  F.col("p_size").cast("string"), F.lit(', "end_line": '), (F.col("p_size") + 2).cast("string"),
                  F.lit(', "signature": "x => x", "closure_variables": ["a", "b'), (k % 3).cast("string"),
                  F.lit('"], "linq_pattern": "Select"}]}'))
    return p.select(k.alias("id"), F.col("p_name").alias("name"),
                    F.concat(F.col("p_brand"), F.lit("."), F.col("p_name")).alias("fqn"), sd.alias("structured_docs"))


@register("j25_uses_edges", sql=f"""
WITH sd AS {SD_SQL},
refs AS (SELECT DISTINCT id AS src, trim(split_part(r.name, '<', 1)) AS type_name FROM (
           SELECT id, unnest(from_json(structured_docs, '{{"references": [{{"type": "VARCHAR", "name": "VARCHAR", "line": "INTEGER"}}]}}').references) AS r
           FROM sd) WHERE r.type = 'di_registration' AND r.name IS NOT NULL)
SELECT DISTINCT src, symbol_id AS dst, 'USES' AS type FROM {_resolve_sql('refs', 'r.src, r.type_name')} x WHERE src <> symbol_id""")
def j25_uses_edges(spark, sf_dir):
    """J-25 over structured-docs JSON generated per part (DI registrations of
    the part's brand type, a variable reference and an unresolvable name)."""
    t = _t(spark, sf_dir)
    return RS.uses_edges(_sd_symbols(t), probes.v_symbols(t))


@register("e16_lambda_symbols", sql=f"""
WITH sd AS {SD_SQL}
SELECT id AS parent_id, l.name, l.fully_qualified_name AS fqn, 'METHOD' AS kind, l.start_line, l.end_line, l.signature,
       true AS is_lambda, array_to_string(coalesce(l.closure_variables, []), ',') AS closure_variables, l.linq_pattern
FROM (SELECT id, unnest(from_json(structured_docs, '{{"lambdas": [{{"name": "VARCHAR", "fully_qualified_name": "VARCHAR",
  "start_line": "INTEGER", "end_line": "INTEGER", "signature": "VARCHAR", "closure_variables": ["VARCHAR"],
  "linq_pattern": "VARCHAR"}}]}}').lambdas) AS l FROM sd)""")
def e16_lambda_symbols(spark, sf_dir):
    return RS.lambda_symbols(_sd_symbols(_t(spark, sf_dir)))


PROJECT_XML_SQL = f"""(SELECT id, project_path,
  '<Project><ItemGroup><ProjectReference Include="..\\\\' || CASE WHEN id % 2 = 0 THEN 'en' ELSE 'de' END
  || '\\\\App.csproj" /><ProjectReference Include="..\\\\..\\\\lib\\\\Lib.csproj" /></ItemGroup></Project>' AS project_xml
  FROM {PROJECTS_SQL})"""


def _project_xml(t):
    p = _projects(t)
    lang = F.when(F.col("id") % 2 == 0, F.lit("en")).otherwise(F.lit("de"))
    xml = F.concat(F.lit('<Project><ItemGroup><ProjectReference Include="..\\\\'), lang,
                   F.lit('\\\\App.csproj" /><ProjectReference Include="..\\\\..\\\\lib\\\\Lib.csproj" /></ItemGroup></Project>'))
    return p.select("id", "project_path", xml.alias("project_xml"))


@register("e18_project_references", sql=f"""
WITH p AS {PROJECT_XML_SQL},
r AS (SELECT id AS source_id, project_path AS source_path,
             unnest(regexp_extract_all(project_xml, '<ProjectReference\\s+Include="([^"]+)"', 1)) AS include FROM p),
n AS (SELECT *, array_to_string(list_reduce(list_filter(string_split(
         regexp_extract(replace(source_path, '\\', '/'), '^(.*)/[^/]*$', 1) || '/' || replace(include, '\\', '/'), '/'),
         lambda s: s <> '' AND s <> '.'),
       lambda acc, s: CASE WHEN s = '..' THEN acc[1:greatest(len(acc) - 1, 0)] ELSE list_append(acc, s) END,
       []::VARCHAR[]), '/') AS target_path FROM r)
SELECT n.source_id, n.source_path, n.target_path, k.id AS target_id, 'ProjectReference' AS reference_type
FROM n LEFT JOIN (SELECT id, replace(project_path, '\\', '/') AS target_path FROM p) k USING (target_path)""")
def e18_project_references(spark, sf_dir):
    return RS.project_references(_project_xml(_t(spark, sf_dir)))


CQRS_SQL = """(SELECT p_partkey AS id, replace(p_brand, '#', '') || 'Q' || CAST(p_partkey AS VARCHAR) AS name,
  CASE p_partkey % 3 WHEN 0 THEN ['IRequest<int>'] WHEN 1 THEN ['ICommand', 'IDisposable'] ELSE ['BaseThing'] END AS bases
  FROM part
  UNION ALL
  SELECT 9000000000000 + p_partkey, replace(p_brand, '#', '') || 'Q' || CAST(p_partkey AS VARCHAR) || 'Handler', ['IRequestHandler']
  FROM part WHERE p_partkey % 2 = 0)"""


def _cqrs(t):
    p = t.part
    k = F.col("p_partkey")
    name = F.concat(F.regexp_replace("p_brand", "#", ""), F.lit("Q"), k.cast("string"))
    bases = (F.when(k % 3 == 0, F.array(F.lit("IRequest<int>"))).when(k % 3 == 1, F.array(F.lit("ICommand"), F.lit("IDisposable")))
             .otherwise(F.array(F.lit("BaseThing"))))
    req = p.select(k.alias("id"), name.alias("name"), bases.alias("bases"))
    hnd = p.where(k % 2 == 0).select((F.lit(9_000_000_000_000) + k).alias("id"), F.concat(name, F.lit("Handler")).alias("name"),
                                      F.array(F.lit("IRequestHandler")).alias("bases"))
    return req.unionByName(hnd)


@register("g05_request_handlers", sql=f"""
WITH c AS {CQRS_SQL},
req AS (SELECT id AS src, name || 'Handler' AS hname FROM c
        WHERE len(list_filter(bases, lambda b: trim(split_part(b, '<', 1)) IN ('IRequest', 'ICommand', 'IQuery'))) > 0),
h AS (SELECT name AS hname, min(id) AS dst FROM c GROUP BY name)
SELECT req.src, h.dst, 'HANDLED_BY' AS type FROM req JOIN h USING (hname)""")
def g05_request_handlers(spark, sf_dir):
    return RS.request_handlers(_cqrs(_t(spark, sf_dir)))


@register("j23_import_edges", sql=f"""
WITH i AS {IMPORTS_SQL},
r AS (SELECT import_id, CASE WHEN starts_with(spec, './') OR starts_with(spec, '../')
                             THEN regexp_extract(file_path, '^(.*)/[^/]*$', 1) || '/' || spec
                             WHEN starts_with(spec, '@/') THEN 'src/' || substr(spec, 3) ELSE spec END AS resolved FROM i),
n AS (SELECT import_id, array_to_string(list_reduce(list_filter(string_split(resolved, '/'), lambda s: s <> '' AND s <> '.'),
        lambda acc, s: CASE WHEN s = '..' THEN acc[1:greatest(len(acc) - 1, 0)] ELSE list_append(acc, s) END,
        []::VARCHAR[]), '/') AS base FROM r),
c AS (SELECT import_id, base || ({_SUFFIXES_SQL})[k] AS path, k - 1 AS rank
      FROM n, unnest(generate_series(1, {len(RS.IMPORT_SUFFIXES)})) AS g(k)),
best AS (SELECT c.import_id, arg_min(f.id, c.rank) AS file_id FROM c JOIN v_files f ON f.path = c.path GROUP BY c.import_id),
spf AS (SELECT file_id, count(*) AS n FROM v_symbols GROUP BY file_id)
SELECT b.import_id AS src_file, b.file_id AS dst_file, a.n AS src_symbols, d.n AS dst_symbols,
       CAST(a.n * d.n AS BIGINT) AS symbol_edges
FROM best b JOIN spf a ON a.file_id = b.import_id JOIN spf d ON d.file_id = b.file_id""")
def j23_import_edges(spark, sf_dir):
    """J-23: the symbol × symbol IMPORTS edges between an importing and an
    imported file, kept as one row per file pair with both symbol counts (the
    edge set is their product; a consumer expands a single pair on demand) —
    the full product would be all pairs inside every file pair."""
    t = _t(spark, sf_dir)
    res = RS.resolve_imports(_imports(t), probes.v_files(t)).where(F.col("file_id").isNotNull())
    spf = probes.v_symbols(t).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    a = spf.select(F.col("file_id").alias("src_file"), F.col("n").alias("src_symbols"))
    d = spf.select(F.col("file_id").alias("dst_file"), F.col("n").alias("dst_symbols"))
    return (res.select(F.col("import_id").alias("src_file"), F.col("file_id").alias("dst_file"))
            .join(a, "src_file").join(d, "dst_file")
            .select("src_file", "dst_file", "src_symbols", "dst_symbols",
                    (F.col("src_symbols") * F.col("dst_symbols")).cast("bigint").alias("symbol_edges")))
