"""Registered incremental-refresh, sink and source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlens.operators import aggregates as A
from meshlens.plans.catalog import register
from meshlens.sources import probes
from meshlens.sources import sinks as S
from meshlens.sources.tables import load_tables
from meshlens.streaming import incremental as I


def _t(spark, sf_dir):
    return load_tables(spark, sf_dir)


DIFF_CTES = """o AS (SELECT path AS old_path, content_hash AS old_hash FROM v_old),
n AS (SELECT path AS new_path, content_hash AS new_hash FROM v_new),
j AS (SELECT * FROM o FULL OUTER JOIN n ON o.old_path = n.new_path),
added AS (SELECT new_path, new_hash FROM j WHERE old_path IS NULL),
deleted AS (SELECT old_path, old_hash FROM j WHERE new_path IS NULL),
dk AS (SELECT *, row_number() OVER (PARTITION BY old_hash ORDER BY old_path) AS k FROM deleted),
ak AS (SELECT *, row_number() OVER (PARTITION BY new_hash ORDER BY new_path) AS k FROM added),
ren AS (SELECT dk.old_path, ak.new_path FROM dk JOIN ak ON dk.old_hash = ak.new_hash AND dk.k = ak.k),
diff AS (SELECT 'A' AS change, NULL::VARCHAR AS old_path, new_path FROM added WHERE new_path NOT IN (SELECT new_path FROM ren)
  UNION ALL SELECT 'D', old_path, NULL FROM deleted WHERE old_path NOT IN (SELECT old_path FROM ren)
  UNION ALL SELECT 'M', old_path, new_path FROM j WHERE old_path IS NOT NULL AND new_path IS NOT NULL AND old_hash <> new_hash
  UNION ALL SELECT 'R', old_path, new_path FROM ren)"""


@register("st01_apply_changes", sql=f"""WITH {DIFF_CTES}
SELECT o.id, o.path, o.content_hash, '=' AS change FROM v_old o JOIN v_new n ON n.path = o.path AND n.content_hash = o.content_hash
UNION ALL
SELECT n.id, n.path, n.content_hash, d.change FROM diff d JOIN v_new n ON n.path = d.new_path WHERE d.change IN ('A', 'M')
UNION ALL
SELECT o.id, d.new_path, n.content_hash, 'R' FROM diff d JOIN v_old o ON o.path = d.old_path
  JOIN v_new n ON n.path = d.new_path WHERE d.change = 'R'""")
def st01_apply_changes(spark, sf_dir):
    t = _t(spark, sf_dir)
    return I.apply_changes(probes.v_old(t), probes.v_new(t))


@register("st02_skip_unchanged", sql="""
SELECT id, path FROM v_new n WHERE NOT EXISTS (SELECT 1 FROM v_old o WHERE o.path = n.path AND o.content_hash = n.content_hash)""")
def st02_skip_unchanged(spark, sf_dir):
    t = _t(spark, sf_dir)
    return I.skip_unchanged(probes.v_old(t), probes.v_new(t)).select("id", "path")


@register("st03_carry_over", sql="""
WITH old AS (SELECT o.path, o.content_hash, l.quality FROM v_old o LEFT JOIN labels l ON l.doc_id = o.id),
o2 AS (SELECT content_hash, any_value(quality) AS quality FROM old GROUP BY content_hash HAVING count(*) = 1)
SELECT n.id, n.path, coalesce(o1.quality, o2.quality) AS quality
FROM v_new n LEFT JOIN old o1 ON o1.path = n.path LEFT JOIN o2 ON o2.content_hash = n.content_hash""")
def st03_carry_over(spark, sf_dir):
    """ST-03: label values carried to the new snapshot by path, else by an
    unambiguous content hash."""
    t = _t(spark, sf_dir)
    old = probes.v_old(t).join(t.labels.select(F.col("doc_id").alias("id"), "quality"), "id", "left")
    out = I.carry_over(old.select("path", "content_hash", "quality"), probes.v_new(t).select("id", "path", "content_hash"),
                       ["quality"], primary="path", fallback="content_hash")
    return out.select("id", "path", "quality")


def _changed_and_deleted(t):
    from meshlens.operators.relational import snapshot_diff
    old = probes.v_old(t)
    d = snapshot_diff(old, probes.v_new(t))
    ids = old.select("id", F.col("path").alias("old_path"))
    # both sets are small id lists read several times: materialize them once
    changed = d.where(F.col("change").isin("M", "R")).join(ids, "old_path").select("id").checkpoint(eager=True)
    deleted = d.where(F.col("change") == "D").join(ids, "old_path").select("id").checkpoint(eager=True)
    return changed, deleted


@register("st04_rebuild_edges", sql=f"""WITH {DIFF_CTES},
changed AS (SELECT o.id FROM diff d JOIN v_old o ON o.path = d.old_path WHERE d.change IN ('M', 'R')),
deleted_f AS (SELECT o.id FROM diff d JOIN v_old o ON o.path = d.old_path WHERE d.change = 'D'),
touched AS (SELECT id FROM v_symbols WHERE file_id IN (SELECT id FROM changed)),
gone AS (SELECT id FROM v_symbols WHERE file_id IN (SELECT id FROM deleted_f)),
dropped AS (SELECT id FROM touched UNION SELECT id FROM gone),
alive AS (SELECT id FROM v_symbols WHERE id NOT IN (SELECT id FROM gone)),
fresh AS (SELECT * FROM v_edges WHERE src IN (SELECT id FROM alive) AND dst IN (SELECT id FROM alive))
SELECT src, dst, type, 'kept' AS origin FROM v_edges
WHERE src NOT IN (SELECT id FROM dropped) AND dst NOT IN (SELECT id FROM dropped)
UNION ALL
SELECT DISTINCT src, dst, type, 'rebuilt' FROM fresh
WHERE (src IN (SELECT id FROM touched) OR dst IN (SELECT id FROM touched))""")
def st04_rebuild_edges(spark, sf_dir):
    t = _t(spark, sf_dir)
    changed, deleted = _changed_and_deleted(t)
    edges = probes.v_edges(t).checkpoint(eager=True)

    def build(alive):
        ids = alive.select("id")
        return (edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
                .join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    return I.rebuild_edges(edges, probes.v_symbols(t), changed, deleted, build)


@register("st05_sync_report", sql=f"WITH {DIFF_CTES} SELECT change, count(*) AS n FROM diff GROUP BY change")
def st05_sync_report(spark, sf_dir):
    t = _t(spark, sf_dir)
    return I.sync_report(probes.v_old(t), probes.v_new(t))


@register("snk02_upsert", sql="""
SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.path ELSE o.path END AS path,
       CASE WHEN n.id IS NOT NULL THEN n.content_hash ELSE o.content_hash END AS content_hash,
       CASE WHEN n.id IS NOT NULL AND o.id IS NOT NULL THEN 2 WHEN n.id IS NOT NULL THEN 1 ELSE 1 END AS version
FROM (SELECT id, path, content_hash FROM v_old) o FULL OUTER JOIN (SELECT id, path, content_hash FROM v_new) n ON n.id = o.id""")
def snk02_upsert(spark, sf_dir):
    t = _t(spark, sf_dir)
    target = probes.v_old(t).select("id", "path", "content_hash", F.lit(1).alias("version"))
    return S.upsert(target, probes.v_new(t).select("id", "path", "content_hash"), ["id"], version_col="version")


@register("snk03_insert_new_links", sql=f"""
WITH links AS (SELECT p.id AS pub_id, s.id AS sub_id, 70 + CASE WHEN p.topic = s.queue THEN 20 ELSE 0 END AS conf
               FROM v_pub p JOIN v_sub s ON p.event_type = s.event_type WHERE p.repo <> s.repo)
SELECT pub_id, sub_id FROM links WHERE conf >= 70
EXCEPT SELECT pub_id, sub_id FROM links WHERE conf = 90""")
def snk03_insert_new_links(spark, sf_dir):
    """SNK-03: links already stored (the topic-matched ones) are skipped; the
    rest of the exact-type candidates are the rows to append."""
    t = _t(spark, sf_dir)
    p = probes.v_pub(t).select(F.col("id").alias("pub_id"), "event_type", F.col("repo").alias("pr"), "topic")
    s = probes.v_sub(t).select(F.col("id").alias("sub_id"), "event_type", F.col("repo").alias("sr"), "queue")
    links = (p.join(s, "event_type").where(F.col("pr") != F.col("sr"))
             .withColumn("conf", F.lit(70) + F.when(F.col("topic") == F.col("queue"), 20).otherwise(0)))
    existing = links.where(F.col("conf") == 90)
    return S.insert_new_links(existing, links.select("pub_id", "sub_id"), ["pub_id", "sub_id"]).distinct()


@register("snk04_store_embeddings", sql="""
SELECT v.chunk_id, v.label, f.id AS chunk_symbol FROM v_vec v JOIN v_files f ON f.id = v.chunk_id""")
def snk04_store_embeddings(spark, sf_dir):
    t = _t(spark, sf_dir)
    chunks = probes.v_files(t).select("id", F.col("id").alias("symbol_id"))
    return S.store_embeddings(probes.v_vec(t).select("chunk_id", "label"), chunks)


@register("snk05_export_names", sql="""
SELECT id, left(regexp_replace(regexp_replace(repository || ' ' || path, '[./\\\\ ]', '_', 'g'), '[<>:"|?*]', '', 'g'), 100) AS file_name
FROM v_files""")
def snk05_export_names(spark, sf_dir):
    f = probes.v_files(_t(spark, sf_dir))
    return f.select("id", S.export_file_name(F.concat_ws(" ", "repository", "path")).alias("file_name"))


DELETED_REPO = "src3"


@register("snk06_cascade_delete", sql=f"""
WITH gone AS (SELECT id FROM v_files WHERE repository = '{DELETED_REPO}'),
f AS (SELECT * FROM v_files WHERE id NOT IN (SELECT id FROM gone)),
s AS (SELECT * FROM v_symbols WHERE file_id IS NULL OR file_id NOT IN (SELECT id FROM gone)),
e AS (SELECT * FROM v_edges WHERE src IN (SELECT id FROM s) AND dst IN (SELECT id FROM s)),
v AS (SELECT * FROM v_vec WHERE chunk_id IS NULL OR chunk_id NOT IN (SELECT id FROM gone))
SELECT 'files' AS table_name, count(*) AS remaining FROM f UNION ALL SELECT 'symbols', count(*) FROM s
UNION ALL SELECT 'relations', count(*) FROM e UNION ALL SELECT 'embeddings', count(*) FROM v""")
def snk06_cascade_delete(spark, sf_dir):
    """SNK-06: what remains after deleting one repository: its files, their
    symbols, edges touching those symbols and vectors of its chunks go."""
    t = _t(spark, sf_dir)
    files = probes.v_files(t)
    gone_repo = files.where(F.col("repository") == DELETED_REPO).select("id")
    left = S.cascade_delete(gone_repo, "id", [("files", files, "id"), ("symbols", probes.v_symbols(t), "file_id"),
                                              ("embeddings", probes.v_vec(t), "chunk_id")])
    s = left["symbols"].select("id")
    e = (probes.v_edges(t).join(s.withColumnRenamed("id", "src"), "src", "left_semi")
         .join(s.withColumnRenamed("id", "dst"), "dst", "left_semi"))

    def cnt(df, name):
        return df.agg(F.count(F.lit(1)).alias("remaining")).select(F.lit(name).alias("table_name"), "remaining")
    return S.union_all([cnt(left["files"], "files"), cnt(left["symbols"], "symbols"), cnt(e, "relations"),
                        cnt(left["embeddings"], "embeddings")])


@register("src03_build_file_table", sql="""
SELECT n.path, 'MARKDOWN' AS language, CAST(len(string_split(n.content, chr(10))) AS BIGINT) AS line_count,
       sha256(n.content) AS content_hash, coalesce(o.content_hash = sha256(n.content), false) AS reused
FROM v_new n LEFT JOIN v_old o ON o.path = n.path""")
def src03_build_file_table(spark, sf_dir):
    t = _t(spark, sf_dir)
    return S.build_file_table(probes.v_new(t).select("path", "content"), probes.v_old(t)).drop("content")


@register("src04_read_lines", sql="""
WITH l AS (SELECT id, CAST(generate_subscripts(string_split(content, chr(10)), 1) AS INTEGER) AS line_no,
                  unnest(string_split(content, chr(10))) AS line FROM v_files),
n AS (SELECT id, len(string_split(content, chr(10))) AS n_lines FROM v_files),
sl AS (SELECT l.*, 2 AS start_line, 6 AS end_line FROM l JOIN n USING (id) WHERE line_no BETWEEN 2 AND least(6, n_lines)),
lt AS (SELECT id, max(line_no) AS last_text FROM sl WHERE trim(line) <> '' GROUP BY id)
SELECT sl.id, sl.start_line, sl.end_line, sl.line_no, printf('%6d | %s', sl.line_no, sl.line) AS text
FROM sl JOIN lt USING (id) WHERE sl.line_no <= lt.last_text""")
def src04_read_lines(spark, sf_dir):
    f = probes.v_files(_t(spark, sf_dir))
    ranges = f.select("id", F.lit(2).alias("start_line"), F.lit(6).alias("end_line"))
    return S.read_lines(f, ranges)


@register("src05_repository_catalog", sql="""
SELECT repository, count(*) AS total_files, CAST(sum(size_bytes) AS BIGINT) AS size_bytes,
       array_to_string(list_sort(list(DISTINCT language)), ',') AS languages
FROM v_files GROUP BY repository""")
def src05_repository_catalog(spark, sf_dir):
    return S.repository_catalog(probes.v_files(_t(spark, sf_dir)))


@register("f14_pending_enrichment", sql="""
SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
  AND length(source) >= 3""")
def f14_pending_enrichment(spark, sf_dir):
    t = _t(spark, sf_dir)
    return (t.documents.join(t.labels.select("doc_id"), "doc_id", "left_anti")
            .where(F.length("source") >= 3).select("doc_id", "source"))


@register("f15_significant_symbols", sql="""
SELECT id, name FROM v_symbols WHERE documentation IS NOT NULL AND NOT contains(lower(name), 'dto')
  AND NOT contains(lower(name), 'request') AND NOT contains(lower(name), 'response') AND NOT contains(lower(name), 'utility')
  AND NOT contains(lower(name), 'helper') AND NOT contains(lower(name), 'test')""")
def f15_significant_symbols(spark, sf_dir):
    s = probes.v_symbols(_t(spark, sf_dir))
    return A.significant_symbols(s, F.col("documentation").isNotNull()).select("id", "name")
