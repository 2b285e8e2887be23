"""Data quality and security operators.

All checks are row-local expressions or anti-joins, so they run in the scan
stage or as one shuffle per foreign key; duplicate detection is a partial +
final hash aggregate on the content hash (a hot hash is merged map-side).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlens.functions.code import file_suffix
from meshlens.operators.extract import DANGEROUS_PATTERNS


def validate_symbols(df: DataFrame, name: str = "name", start: str = "start_line", end: str = "end_line") -> DataFrame:
    """DQ-01: ``errors`` = messages for missing name/start/end and start > end."""
    msgs = [F.when(F.col(c).isNull(), F.lit(f"Missing required field: {c_name}"))
            for c, c_name in ((name, "name"), (start, "start_line"), (end, "end_line"))]
    order = F.when(F.col(start) > F.col(end),
                   F.concat(F.lit("start_line ("), F.col(start).cast("string"),
                            F.lit(") cannot be greater than end_line ("), F.col(end).cast("string"), F.lit(")")))
    errs = F.filter(F.array(*msgs, order), lambda x: x.isNotNull())
    return df.withColumn("errors", errs).withColumn("is_valid", F.size("errors") == 0)


def clip_lengths(df: DataFrame, caps: dict[str, int]) -> DataFrame:
    """DQ-02: cut each capped column and flag rows where any cut happened."""
    cut = reduce(lambda a, b: a | b, [F.coalesce(F.length(c) > n, F.lit(False)) for c, n in caps.items()])
    out = df.withColumn("was_clipped", cut)
    for c, n in caps.items():
        out = out.withColumn(c, F.substring(F.col(c), 1, n))
    return out


# Allowed code extensions (DQ-05).
ALLOWED_CODE_EXTENSIONS = (".py", ".js", ".ts", ".tsx", ".jsx", ".cs", ".java", ".go", ".vue", ".md", ".json",
                           ".yaml", ".yml", ".xml", ".sql", ".csproj", ".sln", ".txt", ".html", ".css", ".scss")
# Allowed repository URL prefixes (DQ-05), as anchored regexes.
ALLOWED_REPO_URLS = (r"^https://github\.com/", r"^https://gitlab\.com/", r"^git@github\.com:", r"^git@gitlab\.com:",
                     r"^https://.*\.visualstudio\.com/", r"^https://dev\.azure\.com/")
SYMBOL_NAME_RE = r"^[a-zA-Z0-9_\.\-<>]+$"


def path_is_safe(path: Column, allow_absolute: bool = False) -> Column:
    """DQ-05: no ``..``, not absolute (unless allowed), no dangerous pattern."""
    ok = ~path.contains("..")
    if not allow_absolute:
        ok = ok & ~path.startswith("/")
    return ok & ~path.rlike("(?i)" + "|".join(f"(?:{p})" for p in DANGEROUS_PATTERNS))


def extension_allowed(path: Column) -> Column:
    return file_suffix(path).isin(list(ALLOWED_CODE_EXTENSIONS))


def repo_url_allowed(url: Column) -> Column:
    return url.rlike("|".join(f"(?:{p})" for p in ALLOWED_REPO_URLS))


def symbol_name_valid(name: Column) -> Column:
    return name.rlike(SYMBOL_NAME_RE)


def fk_audit(pairs) -> DataFrame:
    """DQ-07: orphan count per foreign key: ``pairs`` = (name, child df, child
    col, parent df, parent col).  One anti-join per key, unioned."""
    parts = []
    for name, child, ccol, parent, pcol in pairs:
        orphans = (child.select(F.col(ccol).alias("k")).where(F.col("k").isNotNull())
                   .join(parent.select(F.col(pcol).alias("k")), "k", "left_anti"))
        parts.append(orphans.agg(F.count(F.lit(1)).alias("orphans")).withColumn("foreign_key", F.lit(name)))
    return reduce(DataFrame.unionByName, parts).select("foreign_key", "orphans")


def exact_duplicates(df: DataFrame, id_col: str, hash_col: str) -> DataFrame:
    """DQ-08: content hashes held by more than one row: copies and lowest id."""
    return (df.groupBy(hash_col).agg(F.count(F.lit(1)).alias("copies"), F.min(id_col).alias("first_id"))
            .where(F.col("copies") > 1))
