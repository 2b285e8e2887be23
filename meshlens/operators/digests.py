"""Directory digests rolled up the tree (A-17): files into directories, directories into their parents.

``module_hash`` hashes all files below a directory in one sequence, as the reference does, so the task of a
top-level directory reads its whole tree.  Here a directory's digest comes from the digests of its own files and
of its direct subdirectories only.  A change of one file changes the digests of its ancestors and no others.

Entries of a directory are combined in a tree of three steps by the SHA-256 of their names (first four hex digits,
then two, then all), so that a directory with very many files is spread over 65,536 groups as well.

Cases: a null path is left out; a null content hash counts as empty; repeated rows count as often as they occur; an
empty table gives no rows; a path without ``/`` lies in the root ``''``, which every repository has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlens.session import ensure_checkpoint_dir


def _parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def _depth(directory: Column) -> Column:
    return F.when(directory == "", 0).otherwise(F.size(F.split(directory, "/")))


def _combined(entries: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(entries)), "\n"), 256)


def _entry_digest(entries: DataFrame, keys: list[str]) -> DataFrame:
    """One digest (and the sum of ``n_files``) per ``keys`` of the rows (name, digest, n_files)."""
    named = entries.withColumn("name", F.sha2("name", 256))
    for digits in (4, 2, 0):
        named = (named.groupBy(*keys, F.substring("name", 1, digits).alias("group"))
                 .agg(_combined(F.concat_ws(":", "name", "digest")).alias("digest"), F.sum("n_files").alias("n_files"))
                 .withColumnRenamed("group", "name"))
    return named.drop("name")


def directory_digests(files: DataFrame, repository: str = "repository") -> DataFrame:
    """A-17: repository, directory, depth, n_files (below it) and digest of every directory that has files below it.

    One round per level of depth, from the deepest up; each round reads the digests of the level below it and the
    digests of that level's own files, which are made once for all levels.  Only the largest depth reaches the driver.
    """
    ensure_checkpoint_dir(files.sparkSession)
    keys = ["repository", "directory", "depth"]
    rows = files.where(F.col("path").isNotNull()).select(
        F.col(repository).alias("repository"), _parent(F.col("path")).alias("directory"),
        F.substring_index("path", "/", -1).alias("name"), F.coalesce("content_hash", F.lit("")).alias("digest"),
        F.lit(1).cast("long").alias("n_files"))
    own = (_entry_digest(rows.withColumn("depth", _depth(F.col("directory"))), keys)
           .withColumnRenamed("digest", "of_files").checkpoint(eager=True))
    deepest = own.agg(F.max("depth")).first()[0]
    out = level = None
    for depth in range(deepest if deepest is not None else 0, -1, -1):
        parts = own.where(F.col("depth") == depth).withColumn("of_folders", F.lit(None).cast("string"))
        if level is not None:
            below = level.select("repository", _parent(F.col("directory")).alias("directory"),
                                 F.lit(depth).alias("depth"), F.substring_index("directory", "/", -1).alias("name"),
                                 "digest", "n_files")
            parts = parts.unionByName(_entry_digest(below, keys).withColumnRenamed("digest", "of_folders")
                                      .withColumn("of_files", F.lit(None).cast("string")))
        level = (parts.groupBy(*keys).agg(F.max("of_files").alias("f"), F.max("of_folders").alias("d"),
                                          F.sum("n_files").alias("n_files"))
                 .select(*keys, "n_files", F.sha2(F.concat(F.coalesce("f", F.lit("")), F.lit(":"),
                                                           F.coalesce("d", F.lit(""))), 256).alias("digest"))
                 .checkpoint(eager=True))
        out = level if out is None else out.unionByName(level)
    return out
