"""Aggregations over files, symbols and edges.

All statistics are computed for every repository / directory / class in one
job.  Each ``groupBy`` runs as a partial (map-side) + final hash aggregate, so
a repository holding a third of all files costs one extra merge, not a hot
task.  Per-group lists are only built over *bounded* domains (languages,
indicator file names); unbounded per-group outputs stay in long form.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Module indicator file names by module type, in the reference's
# priority order (A-14).
MODULE_INDICATORS = (
    ("python_package", ("__init__.py",)),
    ("typescript_module", ("package.json", "tsconfig.json", "index.ts", "index.tsx")),
    ("javascript_module", ("package.json", "index.js", "index.jsx")),
    ("csharp_namespace", (".csproj", "AssemblyInfo.cs")),
    ("go_package", ("go.mod", "main.go")),
    ("rust_crate", ("Cargo.toml", "lib.rs", "main.rs")),
)

# Entry point file names (A-14).
ENTRY_POINT_FILES = ("__init__.py", "__main__.py", "main.py", "app.py", "server.py", "index.ts",
                     "index.tsx", "index.js", "index.jsx", "main.ts", "main.js", "App.tsx", "App.jsx")

# Dominant file names (A-15).
DOMINANT_FILES = ("__init__.py", "main.py", "app.py", "index.ts", "index.js", "index.tsx", "index.jsx",
                  "server.py", "server.js", "routes.py", "router.ts", "README.md", "package.json",
                  "requirements.txt", "setup.py", "pyproject.toml")

# Directory name → purpose (A-15).
DIRECTORY_PURPOSES = {
    "api": "API Endpoints & Controllers", "apis": "API Endpoints & Controllers",
    "controllers": "API Controllers", "models": "Data Models & Entities", "database": "Database Layer",
    "db": "Database Layer", "schemas": "Database Schemas", "migrations": "Database Migrations",
    "services": "Business Logic Services", "service": "Business Logic Services",
    "utils": "Utility Functions", "utilities": "Utility Functions", "helpers": "Helper Functions",
    "lib": "Shared Libraries", "libs": "Shared Libraries", "core": "Core Framework",
    "common": "Common/Shared Code", "shared": "Common/Shared Code", "components": "UI Components",
    "views": "View Templates", "pages": "Page Components", "routes": "Routing Logic",
    "router": "Routing Logic", "middleware": "Middleware", "middlewares": "Middleware",
    "auth": "Authentication & Authorization", "authentication": "Authentication & Authorization",
    "security": "Security Layer", "config": "Configuration", "configuration": "Configuration",
    "settings": "Settings & Config", "tests": "Test Suite", "test": "Test Suite",
    "__tests__": "Test Suite", "spec": "Test Specifications", "fixtures": "Test Fixtures",
    "mocks": "Test Mocks", "workers": "Background Workers", "tasks": "Async Tasks",
    "jobs": "Background Jobs", "queue": "Queue Processing", "parsers": "Parsing Logic",
    "extractors": "Data Extraction", "embeddings": "Vector Embeddings", "vector_store": "Vector Storage",
    "mcp_server": "MCP Server Integration", "gitlab": "GitLab Integration",
    "azuredevops": "Azure DevOps Integration", "scripts": "Utility Scripts", "docs": "Documentation",
    "documentation": "Documentation", "ui": "User Interface", "frontend": "Frontend Code",
    "backend": "Backend Code", "client": "Client Application", "server": "Server Application",
    "public": "Public Assets", "static": "Static Files", "assets": "Application Assets",
    "images": "Image Assets", "styles": "Stylesheets", "css": "CSS Styles", "types": "Type Definitions",
    "interfaces": "Interface Definitions", "dto": "Data Transfer Objects", "entities": "Domain Entities",
    "repositories": "Repository Pattern", "domain": "Domain Logic",
    "infrastructure": "Infrastructure Layer", "presentation": "Presentation Layer",
}


def _cnt(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


def lit_map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


# --------------------------------------------------------------------------- global / per repository

def overview_stats(files: DataFrame, symbols: DataFrame, endpoints: DataFrame, calls: DataFrame,
                   pubs: DataFrame, subs: DataFrame) -> DataFrame:
    """A-01: global counts as (metric, value) rows — a union of one-row
    aggregates, no cross join of single-row frames."""
    parts = [
        files.agg(F.countDistinct("repository").alias("value")).withColumn("metric", F.lit("total_repositories")),
        files.agg(F.count(F.lit(1)).alias("value")).withColumn("metric", F.lit("total_files")),
        symbols.agg(F.count(F.lit(1)).alias("value")).withColumn("metric", F.lit("total_symbols")),
        endpoints.agg(F.count(F.lit(1)).alias("value")).withColumn("metric", F.lit("total_endpoints")),
        calls.agg(F.count(F.lit(1)).alias("value")).withColumn("metric", F.lit("total_outgoing_calls")),
        pubs.agg(F.count(F.lit(1)).alias("value")).withColumn("metric", F.lit("total_published_events")),
        subs.agg(F.count(F.lit(1)).alias("value")).withColumn("metric", F.lit("total_event_subscriptions")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("metric", F.col("value").cast("bigint").alias("value"))


def top_languages(files: DataFrame, n: int = 10) -> DataFrame:
    """A-01: top-n languages by file count (ties by language), with bytes."""
    return (files.groupBy("language").agg(_cnt("file_count"), F.sum("size_bytes").cast("bigint").alias("size_bytes"))
            .orderBy(F.col("file_count").desc(), "language").limit(n))


def _symbols_per_file(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy(F.col("file_id").alias("id")).agg(_cnt("symbol_count"))


def symbols_per_file(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """A-11: symbol count per file, 0 kept."""
    return (files.select("id", "repository", "path").join(_symbols_per_file(symbols), "id", "left")
            .withColumn("symbol_count", F.coalesce("symbol_count", F.lit(0)).cast("bigint")))


def repository_stats(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """A-02: per repository: files, symbols, endpoints, files with no symbols,
    average symbols per file (2 decimals, 0 without files)."""
    spf = symbols_per_file(files, symbols)
    ends = (symbols.where(F.col("kind") == "ENDPOINT").groupBy(F.col("file_id").alias("id"))
            .agg(_cnt("ep")))
    g = (spf.join(ends, "id", "left").groupBy("repository")
         .agg(_cnt("total_files"), F.sum("symbol_count").cast("bigint").alias("total_symbols"),
              F.coalesce(F.sum("ep"), F.lit(0)).cast("bigint").alias("total_endpoints"),
              F.count(F.when(F.col("symbol_count") == 0, 1)).alias("files_with_no_symbols")))
    return g.withColumn("avg_symbols_per_file",
                        F.when(F.col("total_files") > 0,
                               F.round(F.col("total_symbols") / F.col("total_files"), 2)).otherwise(0.0))


def kind_distribution(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """A-03: symbols per (repository, kind)."""
    return (symbols.join(files.select(F.col("id").alias("file_id"), "repository"), "file_id")
            .groupBy("repository", "kind").agg(_cnt("n")))


def language_distribution(files: DataFrame) -> DataFrame:
    """A-03: files and bytes per (repository, language)."""
    return files.groupBy("repository", "language").agg(_cnt("file_count"),
                                                       F.sum("size_bytes").cast("bigint").alias("size_bytes"))


def relation_distribution(edges: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """A-03: edges per (repository of the source symbol, type)."""
    src_repo = symbols.select(F.col("id").alias("src"), "file_id").join(
        files.select(F.col("id").alias("file_id"), "repository"), "file_id")
    return edges.join(src_repo, "src").groupBy("repository", "type").agg(_cnt("n"))


def language_share(files: DataFrame) -> DataFrame:
    """A-04: share of bytes per language (2 decimals) and the primary language
    (most bytes, then name) per repository; zero / null sizes skipped."""
    f = files.where(F.col("size_bytes") > 0)
    g = f.groupBy("repository", "language").agg(F.sum("size_bytes").cast("bigint").alias("bytes"))
    tot = Window.partitionBy("repository")
    rk = Window.partitionBy("repository").orderBy(F.col("bytes").desc(), "language")
    return (g.withColumn("pct", F.round(F.col("bytes") * 100.0 / F.sum("bytes").over(tot), 2))
            .withColumn("is_primary", F.row_number().over(rk) == 1))


def primary_language_by_files(files: DataFrame) -> DataFrame:
    """A-05: most frequent language per repository (ties by name), ``Unknown``
    when the repository has no language."""
    g = files.where(F.col("language").isNotNull()).groupBy("repository", "language").agg(_cnt("n"))
    rk = Window.partitionBy("repository").orderBy(F.col("n").desc(), "language")
    top = g.withColumn("_r", F.row_number().over(rk)).where("_r = 1").select("repository", "language")
    repos = files.select("repository").distinct()
    return (repos.join(top, "repository", "left")
            .select("repository", F.coalesce("language", F.lit("Unknown")).alias("primary_language")))


def tech_stack(files: DataFrame) -> DataFrame:
    """A-06: sorted distinct non-null languages per repository (bounded domain)."""
    return (files.where(F.col("language").isNotNull()).groupBy("repository")
            .agg(F.array_join(F.array_sort(F.collect_set("language")), ",").alias("tech_stack")))


def quality_metrics(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """A-08: per repository: average lines per file (1 decimal) with status
    (good < 300, else warning), average KB per file (2 decimals), files that
    have lines but no symbols (counted, not read from one group)."""
    spf = symbols_per_file(files.select("id", "repository", "path", "line_count", "size_bytes")
                           .withColumnRenamed("line_count", "lc"), symbols)
    j = spf.join(files.select("id", "line_count", "size_bytes"), "id")
    g = j.groupBy("repository").agg(
        F.round(F.avg("line_count"), 1).alias("avg_lines_per_file"),
        F.round(F.avg("size_bytes") / 1024.0, 2).alias("avg_kb_per_file"),
        F.count(F.when((F.col("line_count") > 0) & (F.col("symbol_count") == 0), 1)).alias("files_without_symbols"))
    return g.withColumn("line_status", F.when(F.col("avg_lines_per_file") < 300, "good").otherwise("warning"))


def enrichment_coverage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A-10: per repository: rows, rows with enrichment, percent (2 decimals)."""
    j = docs.select("doc_id", F.col("source").alias("repository")).join(
        labels.select("doc_id", F.lit(1).alias("enriched")), "doc_id", "left")
    g = j.groupBy("repository").agg(_cnt("total"), F.count("enriched").alias("enriched"))
    return g.withColumn("pct", F.round(F.col("enriched") * 100.0 / F.col("total"), 2))


def largest_classes(symbols: DataFrame, n: int = 10) -> DataFrame:
    """A-12: CLASS rows with their METHOD child count (left join keeps 0),
    top ``n`` by count then id.  Children are linked by parent name = FQN."""
    cls = symbols.where(F.col("kind") == "CLASS").select("id", "name", F.col("fqn").alias("pkey"))
    kids = (symbols.where(F.col("kind") == "METHOD").groupBy(F.col("parent_name").alias("pkey"))
            .agg(_cnt("method_count")))
    return (cls.join(kids, "pkey", "left")
            .select("id", "name", F.coalesce("method_count", F.lit(0)).cast("bigint").alias("method_count"))
            .orderBy(F.col("method_count").desc(), "id").limit(n))


def god_classes(symbols: DataFrame, threshold: int = 30) -> DataFrame:
    """A-13: classes with more than ``threshold`` children by parent FQN;
    confidence min(1, n/50)."""
    kids = symbols.where(F.col("parent_name").isNotNull()).groupBy(F.col("parent_name").alias("fqn")).agg(_cnt("members"))
    cls = symbols.where(F.col("kind").isin("CLASS", "INTERFACE")).select("id", "name", "fqn")
    return (cls.join(kids.where(F.col("members") > threshold), "fqn")
            .select("id", "name", "members", F.round(F.least(F.lit(1.0), F.col("members") / 50.0), 4).alias("confidence")))


def god_classes_same_file(symbols: DataFrame, threshold: int = 20) -> DataFrame:
    """A-13 (second detector): more than ``threshold`` METHOD children in the
    same file as the class; confidence .8."""
    cls = symbols.where(F.col("kind") == "CLASS").select("id", "name", "fqn", "file_id")
    m = (symbols.where(F.col("kind") == "METHOD")
         .groupBy(F.col("parent_name").alias("fqn"), "file_id").agg(_cnt("methods")))
    return (cls.join(m, ["fqn", "file_id"]).where(F.col("methods") > threshold)
            .select("id", "name", "methods", F.lit(0.8).alias("confidence")))


# --------------------------------------------------------------------------- directories

def with_dir(files: DataFrame) -> DataFrame:
    parts = F.split(F.col("path"), "/")
    return (files.withColumn("_parts", parts)
            .withColumn("filename", F.element_at("_parts", -1))
            .withColumn("dir_depth", F.size("_parts") - 1)
            .withColumn("dir", F.array_join(F.slice("_parts", 1, F.greatest(F.size("_parts") - 1, F.lit(1))), "/"))
            .drop("_parts"))


def _lang_key(c: str = "language") -> Column:
    return F.coalesce(F.lower(F.col(c)), F.lit("unknown"))


def module_stats(files: DataFrame, symbols: DataFrame, min_depth: int = 1, max_depth: int | None = None) -> DataFrame:
    """A-14: per (repository, directory of any depth) over its *direct* files: counts, lines,
    language counts, entry points, test hint, module type by indicator file;
    kept when a package, ≥ 2 files or ≥ 5 symbols."""
    f = with_dir(files).where((F.col("dir_depth") >= 1) & (F.col("dir_depth") >= min_depth))
    if max_depth is not None:
        f = f.where(F.col("dir_depth") <= max_depth)
    prio = None
    for i, (_, names) in enumerate(MODULE_INDICATORS):
        cond = F.col("filename").isin(list(names))
        prio = F.when(cond, F.lit(i)) if prio is None else prio.when(cond, F.lit(i))
    spf = _symbols_per_file(symbols)
    f = (f.join(spf, "id", "left")
         .withColumn("symbol_count", F.coalesce("symbol_count", F.lit(0)))
         .withColumn("prio", prio)
         .withColumn("lang", _lang_key()))
    per_lang = f.groupBy("repository", "dir", "lang").agg(_cnt("c"))
    langs = per_lang.groupBy("repository", "dir").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat("lang", F.lit(":"), F.col("c").cast("string")))), ",")
        .alias("languages"))
    g = f.groupBy("repository", "dir").agg(
        _cnt("file_count"), F.sum("symbol_count").cast("bigint").alias("symbol_count"),
        F.sum(F.coalesce("line_count", F.lit(0))).cast("bigint").alias("line_count"),
        F.min("prio").alias("prio"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("filename").isin(list(ENTRY_POINT_FILES)),
                                                       F.col("filename")))), ",").alias("entry_points"),
        F.max(F.lower("filename").contains("test") | F.lower("filename").contains("spec")).alias("has_tests"))
    mtype = F.lit("directory")
    for i, (name, _) in reversed(list(enumerate(MODULE_INDICATORS))):
        mtype = F.when(F.col("prio") == i, F.lit(name)).otherwise(mtype)
    out = (g.join(langs, ["repository", "dir"])
           .withColumn("is_package", F.col("prio").isNotNull())
           .withColumn("module_type", mtype)
           .where(F.col("is_package") | (F.col("file_count") >= 2) | (F.col("symbol_count") >= 5)))
    return out.select("repository", F.col("dir").alias("path"),
                      F.element_at(F.split("dir", "/"), -1).alias("name"),
                      (F.size(F.split("dir", "/"))).cast("int").alias("depth"),
                      "module_type", "is_package", "file_count", "symbol_count", "line_count",
                      "languages", "entry_points", "has_tests")


def dir_prefixes(path: Column, max_depth: int | None = None) -> Column:
    """All ancestor directories of a path (``a``, ``a/b``, …), deepest last."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1
    if max_depth is not None:
        n = F.least(n, F.lit(max_depth))
    return F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                       lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def project_map(files: DataFrame, max_depth: int = 2) -> DataFrame:
    """A-15: per repository directory up to ``max_depth``: files credited to the
    ancestor at min(depth, max_depth), lines, dominant language if > 50 %,
    purpose by directory name, dominant files."""
    f = with_dir(files).where(F.col("dir_depth") >= 1)
    target = F.array_join(F.slice(F.split("path", "/"), 1, F.least(F.col("dir_depth"), F.lit(max_depth))), "/")
    f = f.withColumn("target", target).withColumn("lang", _lang_key())
    dirs = (f.select("repository", F.explode(dir_prefixes(F.col("path"), max_depth)).alias("target"))
            .distinct())
    per_lang = f.groupBy("repository", "target", "lang").agg(_cnt("c"))
    top_lang = (per_lang.withColumn("_r", F.row_number().over(
        Window.partitionBy("repository", "target").orderBy(F.col("c").desc(), "lang"))).where("_r = 1")
                .select("repository", "target", F.col("lang").alias("top_lang"), F.col("c").alias("top_c")))
    g = f.groupBy("repository", "target").agg(
        _cnt("file_count"), F.sum(F.coalesce("line_count", F.lit(0))).cast("bigint").alias("line_count"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("filename").isin(list(DOMINANT_FILES)),
                                                       F.col("filename")))), ",").alias("dominant_files"))
    j = dirs.join(g, ["repository", "target"], "left").join(top_lang, ["repository", "target"], "left")
    name = F.element_at(F.split("target", "/"), -1)
    purposes = lit_map(DIRECTORY_PURPOSES)
    return j.select(
        "repository", F.col("target").alias("path"), name.alias("name"),
        F.size(F.split("target", "/")).cast("int").alias("depth"),
        F.coalesce("file_count", F.lit(0)).cast("bigint").alias("file_count"),
        F.coalesce("line_count", F.lit(0)).cast("bigint").alias("line_count"),
        F.when(F.col("top_c") * 2 > F.col("file_count"), F.col("top_lang")).alias("dominant_language"),
        F.element_at(purposes, F.lower(name)).alias("purpose"),
        F.coalesce("dominant_files", F.lit("")).alias("dominant_files"))


def repository_totals(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """A-16: per repository and language: files, lines, bytes and the
    language's percent of the repository's files (1 decimal), plus
    repository-wide totals repeated on each row."""
    spf = symbols_per_file(files, symbols).select("id", "symbol_count")
    f = files.join(spf, "id", "left").withColumn("lang", _lang_key())
    per_lang = f.groupBy("repository", "lang").agg(_cnt("files"))
    tot = f.groupBy("repository").agg(
        _cnt("total_files"), F.sum(F.coalesce("line_count", F.lit(0))).cast("bigint").alias("total_lines"),
        F.sum(F.coalesce("size_bytes", F.lit(0))).cast("bigint").alias("total_size"),
        F.sum(F.coalesce("symbol_count", F.lit(0))).cast("bigint").alias("total_symbols"))
    return (per_lang.join(tot, "repository")
            .withColumn("pct", F.round(F.col("files") * 100.0 / F.col("total_files"), 1)))


def format_size(c: Column) -> Column:
    """X-24: 1024-step units with one decimal (``500.0 B``, ``2.0 KB``)."""
    units = ["B", "KB", "MB", "GB", "TB"]
    x = c.cast("double")

    def one_decimal(v):  # half-even like the reference's float formatting
        return F.format_string("%.1f", F.bround(v, 1))

    expr = F.concat(one_decimal(x / (1024.0 ** 5)), F.lit(" PB"))
    for i in reversed(range(len(units))):
        expr = F.when(x < 1024.0 ** (i + 1),
                      F.concat(one_decimal(x / (1024.0 ** i)), F.lit(" " + units[i]))).otherwise(expr)
    return expr


# --------------------------------------------------------------------------- module hash (A-17)

def _hash_partition(batches):
    import pandas as pd
    cur, h = None, None
    for pdf in batches:
        out_m, out_h = [], []
        for m, p, ch in zip(pdf["module"], pdf["path"], pdf["content_hash"]):
            if m != cur:
                if cur is not None:
                    out_m.append(cur)
                    out_h.append(h.hexdigest())
                cur, h = m, hashlib.sha256()
            h.update(f"{p}:{ch or ''}".encode("utf-8"))
        if out_m:
            yield pd.DataFrame({"module": out_m, "module_hash": out_h})
    if cur is not None:
        yield pd.DataFrame({"module": [cur], "module_hash": [h.hexdigest()]})


def module_hash(files: DataFrame, key_cols=("repository",)) -> DataFrame:
    """A-17: sha256 over ``path:content_hash`` of all files below each directory
    (every ancestor prefix ``d/``), in path order.

    SHA-256 is sequential, so each module's rows are hash-partitioned and
    sorted by (module, path) and streamed through an incremental hasher inside
    the task: memory per module is O(1) however many files it has, and nothing
    is collected into one row.
    """
    key = F.concat_ws("\u0001", *[F.col(k) for k in key_cols])
    rows = files.select(key.alias("_k"), "path", "content_hash",
                        F.explode(dir_prefixes(F.col("path"))).alias("dir"))
    rows = rows.withColumn("module", F.concat_ws("\u0001", "_k", "dir"))
    ordered = (rows.select("module", "path", "content_hash")
               .repartition("module").sortWithinPartitions("module", "path"))
    hashed = ordered.mapInPandas(_hash_partition, "module string, module_hash string")
    parts = F.split(F.col("module"), "\u0001")
    out = hashed.select(*[F.element_at(parts, i + 1).alias(k) for i, k in enumerate(key_cols)],
                        F.element_at(parts, len(key_cols) + 1).alias("module_path"), "module_hash")
    return out


# --------------------------------------------------------------------------- merges, dedupes, reports

def merge_partials(parts: DataFrame) -> DataFrame:
    """A-18: groups of partial type declarations by (fqn, kind) with more than
    one part: primary = lowest file id (then id), min start, max end, number of
    parts and files.  The member id list stays in long form (A-19) so a group
    with millions of parts never becomes one row."""
    g = parts.groupBy("fqn", "kind").agg(
        _cnt("n_parts"), F.countDistinct("file_id").alias("n_files"),
        F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"),
        F.min(F.struct("file_id", "id")).getField("id").alias("primary_id"),
        F.count("documentation").alias("n_documented"))
    return g.where(F.col("n_parts") > 1)


def fragment_to_primary(parts: DataFrame) -> DataFrame:
    """A-19: every fragment id of a merged group → its primary id."""
    m = merge_partials(parts).select("fqn", "kind", "primary_id")
    return (parts.join(m, ["fqn", "kind"]).where(F.col("id") != F.col("primary_id"))
            .select(F.col("id").alias("fragment_id"), F.col("primary_id").alias("merged_into")))


def dedupe_projects(projects: DataFrame) -> DataFrame:
    """A-20: per (repository, name) group the primary project = highest
    1000·solution + 100·guid + 10·assembly + 1·framework score (lowest id on
    ties); every member is remapped to it."""
    score = (F.when(F.col("solution_id").isNotNull(), 1000).otherwise(0)
             + F.when(F.col("project_guid").isNotNull(), 100).otherwise(0)
             + F.when(F.col("assembly_name").isNotNull(), 10).otherwise(0)
             + F.when(F.col("target_framework").isNotNull(), 1).otherwise(0))
    p = projects.withColumn("score", score)
    best = p.groupBy("repository_id", "name").agg(
        F.max(F.struct(F.col("score"), (-F.col("id")).alias("neg_id"))).alias("_b"), _cnt("n_members"))
    best = best.select("repository_id", "name", (-F.col("_b.neg_id")).alias("primary_id"),
                       F.col("_b.score").alias("primary_score"), "n_members")
    return (p.join(best, ["repository_id", "name"])
            .select("id", "repository_id", "name", "primary_id", "primary_score", "n_members"))


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """A-22: newest row per key.  ``row_number() = 1`` is planned with a
    partial WindowGroupLimit before the shuffle, so a hot key is cut to one
    row per map task before it moves."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


# Package-name keywords → external system (A-24), first match wins.
EXTERNAL_SYSTEMS = (
    (("rabbitmq", "masstransit"), "Message Queue (RabbitMQ)"),
    (("entityframework", "sqlserver", "postgres"), "Relational Database"),
    (("redis", "stackexchange"), "Cache (Redis)"),
    (("mongodb",), "Document Database (MongoDB)"),
)


def external_system(name: Column) -> Column:
    n = F.lower(name)
    expr = None
    for words, label in EXTERNAL_SYSTEMS:
        cond = None
        for w in words:
            c = n.contains(w)
            cond = c if cond is None else cond | c
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def external_systems(deps: DataFrame, key: str = "repository_id", name_col: str = "package_name") -> DataFrame:
    """A-24: distinct external systems per repository (bounded: four labels)."""
    return (deps.select(key, external_system(F.col(name_col)).alias("system"))
            .where(F.col("system").isNotNull()).distinct())


def parent_match_audit(symbols: DataFrame) -> DataFrame:
    """A-26: distinct parent names, how many resolve to a class FQN, how many not,
    and how many resolve only by bare class name."""
    parents = symbols.where(F.col("parent_name").isNotNull()).select("parent_name").distinct()
    cls = symbols.where(F.col("kind").isin("CLASS", "INTERFACE"))
    by_fqn = cls.select(F.col("fqn").alias("parent_name")).distinct().withColumn("fqn_hit", F.lit(1))
    by_name = cls.select(F.col("name").alias("parent_name")).distinct().withColumn("name_hit", F.lit(1))
    j = parents.join(by_fqn, "parent_name", "left").join(by_name, "parent_name", "left")
    return j.agg(_cnt("distinct_parents"), F.count("fqn_hit").alias("matched"),
                 F.count(F.when(F.col("fqn_hit").isNull(), 1)).alias("unmatched"),
                 F.count(F.when(F.col("fqn_hit").isNull() & F.col("name_hit").isNotNull(), 1)).alias("name_only"))


def language_file_symbol_stats(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """A-27: files and symbols per language."""
    spf = symbols_per_file(files, symbols).select("id", "symbol_count")
    return (files.select("id", "language").join(spf, "id", "left").groupBy("language")
            .agg(_cnt("files"), F.sum("symbol_count").cast("bigint").alias("symbols")))


# Name parts that mark a high-priority symbol (A-28).
KEY_SYMBOL_NAME_PARTS = ("Controller", "Service", "Handler", "Manager")
# Name parts excluded from significant symbols (F-15), case-insensitive.
NOISE_NAME_PARTS = ("DTO", "Request", "Response", "Utility", "Helper", "Test")


def significant_symbols(ctx: DataFrame, enriched: Column) -> DataFrame:
    """F-15: enriched symbols whose name has none of the noise parts."""
    cond = enriched
    for p in NOISE_NAME_PARTS:
        cond = cond & ~F.lower("name").contains(p.lower())
    return ctx.where(cond)


def key_symbols(ctx: DataFrame, keep: int = 50) -> DataFrame:
    """A-28: per repository the top ``keep`` symbols by complexity, +1000 for
    endpoints and Controller/Service/Handler/Manager names, of all symbols."""
    c = F.coalesce(F.col("complexity"), F.lit(0))
    hp = F.col("kind") == "ENDPOINT"
    for p in KEY_SYMBOL_NAME_PARTS:
        hp = hp | F.col("name").contains(p)
    stage = ctx.withColumn("priority_score", c + F.when(hp, 1000).otherwise(0))
    w2 = Window.partitionBy("repository").orderBy(F.col("priority_score").desc(), c.desc(), F.col("id"))
    return (stage.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= keep)
            .select("repository", "id", "name", "priority_score", F.col("rank").cast("bigint").alias("rank")))


def heuristic_module_summary(modules: DataFrame) -> DataFrame:
    """A-31: generated sentence and complexity clamp(files div 2, 1, 10) from
    the module statistics (primary language = most files, then name)."""
    langs = F.split(F.col("languages"), ",")
    pairs = F.transform(langs, lambda x: F.struct(
        F.element_at(F.split(x, ":"), 2).cast("int").alias("c"),
        F.element_at(F.split(x, ":"), 1).alias("lang")))
    best = F.aggregate(pairs, F.struct(F.lit(-1).alias("c"), F.lit("unknown").alias("lang")),
                       lambda acc, x: F.when((x["c"] > acc["c"]) | ((x["c"] == acc["c"]) & (x["lang"] < acc["lang"])),
                                             x).otherwise(acc))
    lang = best["lang"]
    first = F.when(F.col("is_package"),
                   F.concat(F.lit("A "), lang, F.lit(" package containing "), F.col("file_count").cast("string"),
                            F.lit(" files"))) \
        .otherwise(F.concat(F.lit("A directory containing "), F.col("file_count").cast("string"), F.lit(" "),
                            lang, F.lit(" files")))
    second = F.concat(F.lit(". with "), F.col("symbol_count").cast("string"), F.lit(" code symbols ("),
                      F.col("line_count").cast("string"), F.lit(" lines)"))
    summary = F.concat(first, F.when(F.col("symbol_count") > 0, second).otherwise(F.lit("")), F.lit("."))
    return modules.select("repository", "path", summary.alias("functional_summary"),
                          F.concat(F.lit("Module at "), F.col("path")).alias("business_purpose"),
                          F.least(F.lit(10), F.greatest(F.lit(1), F.floor(F.col("file_count") / 2)))
                          .cast("int").alias("complexity_score"))


# --------------------------------------------------------------------------- module symbols, calls, controllers, libraries

# Enum declaration orders used for sorting (T-03).
ACCESS_ORDER = ("PUBLIC", "PRIVATE", "PROTECTED", "INTERNAL", "PROTECTED_INTERNAL", "PRIVATE_PROTECTED")
KIND_ORDER = ("FUNCTION", "METHOD", "CLASS", "INTERFACE", "STRUCT", "ENUM", "VARIABLE", "CONSTANT", "PROPERTY",
              "NAMESPACE", "MODULE", "TYPE_ALIAS", "DOCUMENT_SECTION", "CODE_EXAMPLE", "ENDPOINT")


def ordinal(c: Column, values) -> Column:
    """Position of ``c`` in an enum's declaration order (null when absent)."""
    return F.array_position(F.array(*[F.lit(v) for v in values]), c).cast("int")


def module_symbols(files: DataFrame, symbols: DataFrame, limit: int = 50) -> DataFrame:
    """T-03: per directory module, the first ``limit`` CLASS / FUNCTION / METHOD /
    INTERFACE symbols of its files (any depth below it), ordered by access
    then kind in enum order (nulls last), then name and id.  Every module is
    answered at once: symbols are exploded to their files' ancestor
    directories and ranked per module with a partial top-k."""
    f = files.select(F.col("id").alias("file_id"), "repository", F.explode(dir_prefixes(F.col("path"))).alias("module"))
    s = symbols.where(F.col("kind").isin("CLASS", "FUNCTION", "METHOD", "INTERFACE")).select(
        "id", "name", "kind", "access", "file_id")
    j = f.join(s, "file_id")
    w = Window.partitionBy("repository", "module").orderBy(
        ordinal(F.col("access"), ACCESS_ORDER).asc_nulls_last(), ordinal(F.col("kind"), KIND_ORDER).asc_nulls_last(),
        F.col("name").asc(), F.col("id").asc())
    return (j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
            .select("repository", "module", "rank", "id", "name", "kind", "access"))


def unique_external_calls(calls: DataFrame, key: str = "repository", n: int = 10) -> DataFrame:
    """A-25: distinct (method, URL) per key, the first ``n`` by method then URL."""
    d = calls.select(key, "http_method", "url_pattern").distinct()
    w = Window.partitionBy(key).orderBy("http_method", "url_pattern")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def library_services(projects: DataFrame, symbol_projects: DataFrame, min_symbols: int = 10) -> DataFrame:
    """P-10: library projects with at least ``min_symbols`` symbols become
    services: score 10 + n div 10, layer reason from the project name."""
    counts = symbol_projects.where(F.col("project_id").isNotNull()).groupBy("project_id").agg(
        F.count(F.lit(1)).alias("symbol_count"))
    n = F.lower("name")
    reason = (F.when(n.contains("domain"), "Domain layer detected")
              .when(n.contains("application"), "Application layer detected")
              .when(n.contains("infrastructure") | n.contains("persistence"), "Infrastructure layer detected")
              .when(n.contains("shared") | n.contains("common"), "Shared library detected")
              .when(n.contains("core"), "Core library detected"))
    return (projects.where(F.lower("output_type") == "library")
            .join(counts, F.col("id") == F.col("project_id")).where(F.col("symbol_count") >= min_symbols)
            .select("id", "name", "symbol_count", (F.lit(10) + F.floor(F.col("symbol_count") / 10)).cast("bigint").alias("score"),
                    F.lit("Library").alias("service_type"), reason.alias("layer_reason")))


def library_layer(name: Column) -> Column:
    n = F.lower(F.coalesce(name, F.lit("")))
    return (F.when(n.contains("domain"), "Domain").when(n.contains("application"), "Application")
            .when(n.contains("infrastructure"), "Infrastructure")
            .when(n.contains("shared") | n.contains("common"), "Shared").otherwise("Library"))


def project_structure(services: DataFrame) -> DataFrame:
    """A-32: deployable services (API / Worker / Console) grouped with the
    libraries named under their dotted prefix (``prefix.`` + …), each with a
    layer, plus the standalone libraries no deployable claims (prefix null).

    Long form — one row per (prefix group, member) — so a prefix shared by many
    services and libraries stays linear; "the libraries of service S" is the
    filter ``prefix = prefix(S)``.  "Name starts with prefix + '.'" is an
    equi-join on the library's exploded dotted prefixes."""
    dep = (services.where(F.col("service_type").isin("API", "Worker", "Console") & F.col("name").contains("."))
           .select(F.regexp_extract("name", r"^(.*)\.[^.]*$", 1).alias("prefix"), "id", "name", "service_type"))
    prefixes = dep.select("prefix").distinct()
    libs = services.where(F.col("service_type") == "Library").select("id", "name", "service_type")
    parts = F.split("name", r"\.")
    lp = (libs.where(F.size(parts) > 1)
          .select("id", "name", "service_type",
                  F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1),
                                        lambda k: F.array_join(F.slice(parts, 1, k), "."))).alias("prefix")))
    claimed = lp.join(prefixes, "prefix", "left_semi")
    standalone = (libs.join(claimed.select("id").distinct(), "id", "left_anti")
                  .select(F.lit(None).cast("string").alias("prefix"), "id", "name", "service_type"))
    out = dep.unionByName(claimed.select("prefix", "id", "name", "service_type")).unionByName(standalone)
    return out.withColumn("layer", F.when(F.col("service_type") == "Library", library_layer(F.col("name"))))
