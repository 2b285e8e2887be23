"""Merge of duplicate projects (A-20): groups, field-wise merge and the remap of what points at them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlens.operators.graph import connected_components

#: Fields that a primary project takes from its duplicates where it has none.
FILLED = ("assembly_name", "target_framework", "output_type", "root_namespace", "define_constants", "lang_version",
          "nullable_context")


def project_groups(projects: DataFrame, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """(id, group_id): projects of one repository that share a key belong together, also over a chain of keys.

    ``group_id`` is the smallest id of the group.  Every member is linked with the smallest id of each of its keys, so
    a key of a third of all projects gives as many links as members, not their pairs.  A null or empty key links
    nothing."""
    rows = projects.select("id", "repository_id", F.explode(F.array(*[
        F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("k"))
    rows = rows.select("id", "repository_id", "k.*").where("value <> ''")
    firsts = rows.groupBy("repository_id", "key", "value").agg(F.min("id").alias("first"))
    r, f = rows.alias("r"), firsts.alias("f")
    links = r.join(f, F.col("r.repository_id").eqNullSafe(F.col("f.repository_id")) & (F.col("r.key") == F.col("f.key"))
                   & (F.col("r.value") == F.col("f.value"))).select(F.col("r.id").alias("a"), F.col("f.first").alias("b"))
    groups = connected_components(links)
    return (projects.select("id").distinct().join(groups.withColumnRenamed("node", "id"), "id", "left")
            .select("id", F.coalesce("component", "id").alias("group_id")))


def merge_projects(projects: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A-20: one merged project per group, and the remap (id, primary_id) of every member.

    The primary is the member of the highest score 1000 solution + 100 GUID + 10 assembly + 1 framework (smallest id
    on ties).  It keeps its name, solution and GUID; each field of ``FILLED`` that the table has and that it lacks
    (null or empty) comes from the member of the smallest id that has it; a path that is not absolute is replaced by the
    absolute path of the smallest id.  ``n_guids`` above 1 marks a group whose members disagree on the GUID.
    """
    def has(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("")) != ""

    fields = [c for c in FILLED if c in projects.columns]
    member = projects.join(groups, "id").withColumn("score", sum(
        F.when(has(c), F.lit(points)).otherwise(0)
        for c, points in (("solution_id", 1000), ("project_guid", 100), ("assembly_name", 10), ("target_framework", 1))))
    best = member.groupBy("group_id").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "id")).getField("id").alias("primary_id"),
        F.max("score").alias("score"), F.countDistinct("id").alias("n_members"),
        F.countDistinct(F.when(has("project_guid"), F.col("project_guid"))).alias("n_guids"))
    remap = groups.join(best.select("group_id", "primary_id"), "group_id").select("id", "primary_id")

    def first(c, where):
        return F.min(F.when(where, F.struct("id", c))).getField(c)

    absolute = F.col("file_path").startswith("/")
    fill = member.groupBy("group_id").agg(*[first(c, has(c)).alias(f"_{c}") for c in fields],
                                          first("file_path", absolute).alias("_file_path"))
    own = projects.select(F.col("id").alias("primary_id"), "repository_id", "name", "solution_id", "project_guid",
                          "file_path", *fields).dropDuplicates(["primary_id"])
    merged = best.join(own, "primary_id").join(fill, "group_id").select(
        "primary_id", "repository_id", "name", "score", "n_members", "n_guids", "solution_id", "project_guid",
        F.when(absolute, F.col("file_path")).otherwise(F.coalesce("_file_path", "file_path")).alias("file_path"),
        *[F.when(has(c), F.col(c)).otherwise(F.coalesce(f"_{c}", c)).alias(c) for c in fields])
    return merged, remap


def remap_projects(rows: DataFrame, remap: DataFrame, column: str = "project_id") -> DataFrame:
    """``rows`` with ``column`` moved from merged projects to their primary; other values, null among them, stay."""
    moved = remap.where("id <> primary_id").select(F.col("id").alias("_old"), F.col("primary_id").alias("_new"))
    return (rows.join(moved, rows[column] == moved["_old"], "left")
            .withColumn(column, F.coalesce("_new", column)).drop("_old", "_new"))
