"""Sinks and file-level sources (SRC-03 … SRC-05).

Write operators use partition-level overwrite (``partitionOverwriteMode =
dynamic``) so replacing one repository's rows rewrites only its partition;
merge-style operators return the merged DataFrame (full outer join +
coalesce) and leave the write mode to the caller.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlens.functions.code import language_of
from meshlens.session import ensure_checkpoint_dir


def build_file_table(files: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """SRC-03: language by extension, line count, sha256; rows whose content is
    unchanged keep the stored hash row (``reused``)."""
    out = files.select("path", "content",
                       language_of(F.col("path")).alias("language"),
                       F.size(F.split("content", "\n")).cast("bigint").alias("line_count"),
                       F.sha2("content", 256).alias("content_hash"))
    if old is None:
        return out.withColumn("reused", F.lit(False))
    o = old.select("path", F.col("content_hash").alias("old_hash"))
    return (out.join(o, "path", "left").withColumn("reused", F.coalesce(F.col("old_hash") == F.col("content_hash"),
                                                                        F.lit(False))).drop("old_hash"))


def read_lines(files: DataFrame, ranges: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """SRC-04: numbered line slices: 1-based, inclusive, end clamped to the file,
    trailing blank lines of the slice dropped, ``%6d | line`` formatting.
    ``ranges``: (id, start_line, end_line).  A file's lines are cut in its own
    row; only the asked lines are exploded."""
    lines = F.split(F.col(text_col), "\n")
    first = F.greatest(F.col("start_line").cast("int"), F.lit(1))
    size = F.greatest(F.least(F.col("end_line").cast("int"), F.size(lines)) - first + 1, F.lit(0))
    part = files.select(id_col, text_col).join(ranges, id_col).withColumn("_part", F.slice(lines, first, size))
    filled = F.array_max(F.transform("_part", lambda l, i: F.when(F.trim(l) != "", i + 1)))
    part = part.withColumn("_part", F.slice("_part", F.lit(1), F.coalesce(filled, F.lit(0))))
    ex = part.select(id_col, "start_line", "end_line", first.alias("_first"), F.posexplode("_part").alias("_pos", "_line"))
    return ex.select(id_col, "start_line", "end_line", (F.col("_first") + F.col("_pos")).alias("line_no"),
                     F.format_string("%6d | %s", F.col("_first") + F.col("_pos"), F.col("_line")).alias("text"))


def repository_catalog(files: DataFrame) -> DataFrame:
    """SRC-05: per repository: files, bytes, languages — ordered by name."""
    return (files.groupBy("repository").agg(F.count(F.lit(1)).alias("total_files"),
                                           F.sum("size_bytes").cast("bigint").alias("size_bytes"),
                                           F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))
            .orderBy("repository"))


def replace_by_key(df: DataFrame, path: str, key: str, fmt: str = "parquet") -> None:
    """SNK-01: replace all rows of the keys present in ``df`` (dynamic partition
    overwrite by ``key``); other keys' partitions are untouched."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).format(fmt).save(path))


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], version_col: str | None = None) -> DataFrame:
    """SNK-02: update matching rows, insert new ones, keep untouched ones.

    All columns of ``target`` stay: a column that ``updates`` doesn't have keeps
    its value (null on new rows), a column that only ``updates`` has is added.
    Keys match null-safe; ``updates`` must hold a key once.  ``version_col`` is
    increased by one on rows that were updated."""
    values = [c for c in target.columns if c not in keys and c != version_col]
    values += [c for c in updates.columns if c not in keys and c not in values and c != version_col]
    t = target.select(*[F.col(k).alias(f"_tk_{k}") for k in keys], F.lit(True).alias("_t"),
                      *[F.col(c).alias(f"_t_{c}") for c in target.columns if c not in keys])
    u = updates.select(*[F.col(k).alias(f"_uk_{k}") for k in keys], F.lit(True).alias("_u"),
                       *[F.col(c).alias(f"_u_{c}") for c in updates.columns if c not in keys])
    j = t.join(u, reduce(lambda a, b: a & b, [F.col(f"_tk_{k}").eqNullSafe(F.col(f"_uk_{k}")) for k in keys]), "full_outer")
    cols = [F.when(F.col("_u"), F.col(f"_uk_{k}")).otherwise(F.col(f"_tk_{k}")).alias(k) for k in keys]
    for c in values:
        if c not in updates.columns:
            cols.append(F.col(f"_t_{c}").alias(c))
        elif c not in target.columns:
            cols.append(F.col(f"_u_{c}").alias(c))
        else:
            cols.append(F.when(F.col("_u"), F.col(f"_u_{c}")).otherwise(F.col(f"_t_{c}")).alias(c))
    if version_col:
        old = F.col(f"_t_{version_col}") if version_col in target.columns else F.lit(None).cast("int")
        cols.append(F.when(F.col("_u"), F.coalesce(old, F.lit(0)) + 1).otherwise(old).alias(version_col))
    return j.select(*cols)


def insert_new_links(existing: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-03: only the pairs that were not linked before (to be appended)."""
    return candidates.join(existing.select(*keys).distinct(), keys, "left_anti")


def store_embeddings(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """SNK-04: attach the chunk's symbol id; vectors of missing chunks are dropped."""
    return vectors.join(chunks.select(F.col("id").alias("chunk_id"), F.col("symbol_id").alias("chunk_symbol")),
                        "chunk_id", "inner")


def export_file_name(name: F.Column, max_len: int = 100) -> F.Column:
    """SNK-05: document file name: ``.``, ``/``, ``\\`` and spaces → ``_``,
    ``< > : " | ? *`` removed, cut at ``max_len``."""
    s = F.regexp_replace(name, r"[./\\ ]", "_")
    s = F.regexp_replace(s, r"[<>:\"|?*]", "")
    return F.substring(s, 1, max_len)


def export_docs(df: DataFrame, path: str, name_col: str, text_col: str) -> None:
    """SNK-05: one text document per row under ``path/name=<file name>/``.

    Of different names that give the same file name, all but the first get a
    suffix made from the whole name, so each document has its own folder."""
    named = df.select(export_file_name(F.col(name_col)).alias("name"), F.col(name_col).alias("_full"),
                      F.col(text_col).alias("value"))
    first = named.groupBy("name").agg(F.min("_full").alias("_first"))
    name = F.when(F.col("_full").eqNullSafe(F.col("_first")), F.col("name")) \
        .otherwise(F.concat(F.col("name"), F.lit("~"), F.substring(F.sha2("_full", 256), 1, 16)))
    (named.join(first, "name", "left").select(name.alias("name"), "value")
     .write.mode("overwrite").partitionBy("name").text(path))


def cascade_delete(parents: DataFrame, parent_key: str, children: list[tuple[str, DataFrame, str]]) -> dict:
    """SNK-06: rows that survive deleting ``parents``: each child table keeps
    the rows whose foreign key does not point at a deleted parent (chained by
    the caller for deeper levels)."""
    gone = parents.select(F.col(parent_key).alias("_k"))
    return {name: df.join(gone, df[fk] == gone["_k"], "left_anti") for name, df, fk in children}


@dataclass(frozen=True)
class ForeignKey:
    """``child.column`` points at ``parent.key``; its rows go with the parent's, or are blanked (``set_null``)."""

    child: str
    column: str
    parent: str
    key: str = "id"
    set_null: bool = False


def cascade_tables(tables: dict[str, DataFrame], foreign_keys: list[ForeignKey], start: str,
                   gone: DataFrame) -> dict[str, DataFrame]:
    """SNK-06 over a whole graph of tables: every table as it is after the rows of ``start`` in ``gone`` are deleted.

    ``gone`` has one column, named as a column of ``start``.  Tables are visited parents first; what passes from a
    table to the next are the distinct keys of its deleted rows, kept by a reliable checkpoint.  A row goes if any of
    its cascading keys points at a deleted row, otherwise its ``set_null`` keys that do are blanked.  A cascading key
    on its own table is followed level by level.  Null keys point at nothing; a table that nothing touches returns
    as it is.  Other cycles of tables raise ``graphlib.CycleError``.
    """
    ensure_checkpoint_dir(gone.sparkSession)
    before = {name: {fk.parent for fk in foreign_keys if fk.child == name and fk.parent != name} for name in tables}
    lost: dict[tuple[str, str], DataFrame] = {}
    out = {}
    for name in TopologicalSorter(before).static_order():
        rows = tables[name]
        hits = [(fk.column, lost[fk.parent, fk.key]) for fk in foreign_keys
                if fk.child == name and not fk.set_null and (fk.parent, fk.key) in lost]
        if name == start:
            hits.append((gone.columns[0], gone.select(F.col(gone.columns[0]).alias("_k")).distinct().checkpoint(eager=True)))
        own = [fk for fk in foreign_keys if fk.child == fk.parent == name and not fk.set_null]
        needed = {fk.key for fk in foreign_keys if fk.parent == name}
        if hits and needed:
            found, frontier = None, hits
            while frontier:
                new = union_all([rows.join(k, rows[c] == k["_k"], "left_semi").select(*needed)
                                 for c, k in frontier]).distinct()
                new = (new if found is None else new.subtract(found)).checkpoint(eager=True)
                found = new if found is None else found.union(new)
                frontier = [(fk.column, new.select(F.col(fk.key).alias("_k")).where("_k is not null").distinct())
                            for fk in own if not new.isEmpty()]
            for key in needed:
                lost[name, key] = found.select(F.col(key).alias("_k")).where("_k is not null").distinct().checkpoint(eager=True)
        hits += [(fk.column, lost[name, fk.key]) for fk in own if (name, fk.key) in lost]
        for column, k in hits:
            rows = rows.join(k, rows[column] == k["_k"], "left_anti")
        for fk in foreign_keys:
            if fk.child == name and fk.set_null and (fk.parent, fk.key) in lost:
                k = lost[fk.parent, fk.key].select("_k", F.lit(True).alias("_lost"))
                rows = (rows.join(k, rows[fk.column] == k["_k"], "left")
                        .withColumn(fk.column, F.when(F.col("_lost").isNull(), F.col(fk.column))).drop("_k", "_lost"))
        out[name] = rows
    return out


def union_all(dfs) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)
