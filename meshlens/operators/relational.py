"""Filters, joins, sorts, windows and set operators over the entity tables
(SURVEY §2.2, §2.3 J-01..J-10/J-30/J-31/J-33/J-34, §2.5, §2.6, §2.7).

Every operator answers for all entities at once; a single-entity answer is a
filter on the result.  Joins are equi-joins (Catalyst picks broadcast when the
statistics show a small side, sort-merge otherwise); OR-conditions are split
into unions of equi-joins so no join degenerates into a nested loop.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlens.session import ensure_checkpoint_dir

# --------------------------------------------------------------------------- globs

# Default exclusion globs of the reference (F-02).
DEFAULT_EXCLUSIONS = (
    "**/node_modules/**", "**/bin/**", "**/obj/**", "**/dist/**", "**/build/**", "**/out/**",
    "**/.next/**", "**/.nuxt/**", "**/target/**",
    "**/*.g.cs", "**/*.Designer.cs", "**/*.designer.cs", "**/*.generated.cs",
    "**/*.generated.js", "**/*.generated.ts",
    "**/*.min.js", "**/*.min.css", "**/*.bundle.js",
    "**/packages/**", "**/vendor/**", "**/.pnpm/**", "**/bower_components/**",
    "**/vendor*.js", "**/vendor*.css",
    "**/.vs/**", "**/.vscode/**", "**/.idea/**", "**/__pycache__/**", "**/.git/**",
    "**/coverage/**", "**/htmlcov/**", "**/.coverage/**", "**/.nyc_output/**",
    "**/*.tmp", "**/*.temp", "**/*.swp", "**/*.bak",
    "**/package-lock.json", "**/yarn.lock", "**/pnpm-lock.yaml",
)

# Test-file globs of the reference (F-03).
TEST_PATTERNS = (
    "**/test/**", "**/tests/**", "**/__tests__/**", "**/spec/**", "**/specs/**",
    "**/*.test.js", "**/*.test.ts", "**/*.spec.js", "**/*.spec.ts", "**/*.test.tsx",
    "**/*.spec.tsx", "**/Test*.cs", "**/*Test.cs", "**/*Tests.cs",
)

# Generated-file regexes of the reference (F-03), case-insensitive.
GENERATED_REGEXES = (
    r"\.g\.cs$", r"\.Designer\.cs$", r"\.designer\.cs$", r"\.generated\.(cs|js|ts)$",
    r"\.min\.(js|css)$", r"\.bundle\.js$",
)


def exclusion_glob_regex(glob: str) -> str:
    """Glob → regex for exclusion rules: regex specials escaped, ``**`` any depth,
    ``*`` within a segment, ``?`` one char, matched from the start only.

    A leading ``**/`` may also match nothing, so a root-level ``bin/x`` is
    excluded (the reference compiles it to ``.*/bin/.*`` and misses it).
    """
    rx = glob
    for ch in "\\.+^$[]{}()":
        rx = rx.replace(ch, "\\" + ch)
    rx = rx.replace("**", "\0").replace("*", "[^/]*").replace("\0", ".*").replace("?", ".")
    if rx.startswith(".*/"):
        rx = "(?:.*/)?" + rx[3:]
    elif not rx.startswith(".*"):
        rx = ".*" + rx
    return "^" + rx


def search_glob_regex(glob: str) -> str:
    """F-01 glob: ``**`` → ``.*``, ``*`` → ``[^/]*``; anchored, case-insensitive;
    other regex characters are kept as they are (reference behaviour)."""
    rx = glob.replace("**", "\0").replace("*", "[^/]*").replace("\0", ".*")
    return f"(?i)^{rx}$"


def any_rlike(c: Column, regexes) -> Column:
    return c.rlike("|".join(f"(?:{r})" for r in regexes))


def path_glob(files: DataFrame, symbols: DataFrame, glob: str) -> DataFrame:
    """F-01: files whose path matches the glob, with their symbol counts (0 kept)."""
    counts = symbols.groupBy(F.col("file_id").alias("id")).agg(F.count(F.lit(1)).alias("symbol_count"))
    hit = files.where(F.col("path").rlike(search_glob_regex(glob))).select("id", "path", "repository")
    return (hit.join(counts, "id", "left")
            .select("id", "path", "repository", F.coalesce("symbol_count", F.lit(0)).alias("symbol_count")))


def exclude_paths(files: DataFrame, extra_globs=()) -> DataFrame:
    """F-02: drop build / generated / vendor / IDE / lock files (one negated alternation)."""
    rx = [exclusion_glob_regex(g) for g in tuple(DEFAULT_EXCLUSIONS) + tuple(extra_globs)]
    return files.where(~any_rlike(F.regexp_replace("path", r"\\", "/"), rx))


def gitignore_globs(lines: DataFrame, col: str = "line") -> DataFrame:
    """F-02: gitignore lines → globs (comments / blanks skipped, ``/`` root
    stripped, ``**/`` prefixed)."""
    s = F.trim(F.col(col))
    s2 = F.regexp_replace(s, r"^/", "")
    g = F.when(s2.startswith("**/"), s2).otherwise(F.concat(F.lit("**/"), s2))
    return lines.where((s != "") & ~s.startswith("#")).select(g.alias("glob"))


def flag_files(files: DataFrame) -> DataFrame:
    """F-03: ``is_test`` / ``is_generated`` flags."""
    p = F.regexp_replace("path", r"\\", "/")
    return files.select("id", "path",
                        any_rlike(p, [exclusion_glob_regex(g) for g in TEST_PATTERNS]).alias("is_test"),
                        any_rlike(F.col("path"), [f"(?i){r}" for r in GENERATED_REGEXES]).alias("is_generated"))


def filter_entities(df: DataFrame, **eq) -> DataFrame:
    """F-07: conjunction of optional equality / IN filters (None = no filter)."""
    conds = []
    for k, v in eq.items():
        if v is None:
            continue
        conds.append(F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == v)
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


# --------------------------------------------------------------------------- joins

def symbol_context(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """J-01: symbol ⋈ file ⋈ repository (repository is a file attribute here)."""
    f = files.select(F.col("id").alias("file_id"), "path", "repository", "language")
    return symbols.join(f, "file_id", "inner")


def public_methods(ctx: DataFrame) -> DataFrame:
    """F-08: public METHOD/FUNCTION, ordered by path, name, id."""
    return (ctx.where(F.col("kind").isin("METHOD", "FUNCTION") & (F.col("access") == "PUBLIC"))
            .select("id", "name", "signature", "path", "repository"))


def undocumented(ctx: DataFrame) -> DataFrame:
    """F-09: public METHOD/FUNCTION/CLASS with null or empty documentation."""
    return (ctx.where(F.col("kind").isin("METHOD", "FUNCTION", "CLASS") & (F.col("access") == "PUBLIC")
                      & (F.col("documentation").isNull() | (F.col("documentation") == "")))
            .select("id", "name", "kind", "signature", "path"))


def controllers(ctx: DataFrame, term: str = "controller") -> DataFrame:
    """F-10: CLASS whose name or path contains the term (case-folded)."""
    t = term.lower()
    return (ctx.where((F.col("kind") == "CLASS")
                      & (F.lower("name").contains(t) | F.lower("path").contains(t)))
            .select("id", "name", "kind", "signature", "path", "repository"))


def symbols_by_language(ctx: DataFrame, language: str) -> DataFrame:
    """F-11: symbols of files in one language."""
    return ctx.where(F.col("language") == language).select("id", "name", "kind", "signature", "path")


def edges_with_names(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    s = symbols.select("id", "name", "kind")
    src = s.select(F.col("id").alias("src"), F.col("name").alias("src_name"), F.col("kind").alias("src_kind"))
    dst = s.select(F.col("id").alias("dst"), F.col("name").alias("dst_name"), F.col("kind").alias("dst_kind"))
    return edges.join(src, "src", "inner").join(dst, "dst", "inner")


def symbol_edges(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """J-02: every symbol's calls / called_by / inherits_from / inherited_by
    neighbours with their names and kinds.

    Long form (one row per neighbour) instead of per-symbol lists, so a hub
    symbol with millions of edges never becomes one giant row; a per-symbol
    list is a ``groupBy`` on top for bounded consumers."""
    rel_out = F.when(F.col("type") == "CALLS", "calls").when(F.col("type") == "INHERITS", "inherits_from")
    rel_in = F.when(F.col("type") == "CALLS", "called_by").when(F.col("type") == "INHERITS", "inherited_by")
    e = edges.where(F.col("type").isin("CALLS", "INHERITS"))
    out = e.select(F.col("src").alias("id"), F.col("dst").alias("other_id"), rel_out.alias("relation"))
    inc = e.select(F.col("dst").alias("id"), F.col("src").alias("other_id"), rel_in.alias("relation"))
    names = symbols.select(F.col("id").alias("other_id"), F.col("name").alias("other_name"),
                           F.col("kind").alias("other_kind"))
    return (out.unionByName(inc)
            .join(symbols.select("id"), "id", "left_semi")
            .join(names, "other_id", "inner")
            .select("id", "relation", "other_id", "other_name", "other_kind"))


def callers(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """J-03 (join form): every CALLS edge with the caller's name and kind."""
    s = symbols.select(F.col("id").alias("src"), F.col("name").alias("caller_name"),
                       F.col("kind").alias("caller_kind"))
    return (edges.where(F.col("type") == "CALLS")
            .join(s, "src", "inner")
            .select(F.col("dst").alias("target_id"), F.col("src").alias("caller_id"), "caller_name", "caller_kind"))


def calling_symbols(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """J-03 (semi-join form): symbols that call at least one symbol."""
    return symbols.join(edges.where(F.col("type") == "CALLS").select(F.col("src").alias("id")),
                        "id", "left_semi").select("id", "name", "kind")


def usages(edges: DataFrame, types=None) -> DataFrame:
    """J-04: incoming edges per target, grouped by type (optional type filter)."""
    e = edges if not types else edges.where(F.col("type").isin(list(types)))
    return e.groupBy(F.col("dst").alias("symbol_id"), "type").agg(F.count(F.lit(1)).alias("n"))


def implementations(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """J-05: classes with an IMPLEMENTS edge into an INTERFACE."""
    e = edges_with_names(edges.where(F.col("type") == "IMPLEMENTS"), symbols)
    return (e.where((F.col("src_kind") == "CLASS") & (F.col("dst_kind") == "INTERFACE"))
            .select(F.col("dst").alias("interface_id"), F.col("dst_name").alias("interface_name"),
                    F.col("src").alias("class_id"), F.col("src_name").alias("class_name")))


def inheritance_pairs(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """J-06: child CLASS → parent CLASS/INTERFACE over INHERITS."""
    e = edges_with_names(edges.where(F.col("type") == "INHERITS"), symbols)
    return (e.where((F.col("src_kind") == "CLASS") & F.col("dst_kind").isin("CLASS", "INTERFACE"))
            .select(F.col("src").alias("child_id"), F.col("src_name").alias("child_name"),
                    F.col("dst").alias("parent_id"), F.col("dst_name").alias("parent_name")))


def unused_symbols(ctx: DataFrame, edges: DataFrame) -> DataFrame:
    """J-07: METHOD/FUNCTION/CLASS never a CALLS target, access not PRIVATE.
    An anti-join is null-safe where SQL ``NOT IN`` is not."""
    targets = edges.where(F.col("type") == "CALLS").select(F.col("dst").alias("id"))
    return (ctx.where(F.col("kind").isin("METHOD", "FUNCTION", "CLASS") & (F.col("access") != "PRIVATE"))
            .join(targets, "id", "left_anti")
            .select("id", "name", "kind", "signature", "path"))


def dead_code(symbols: DataFrame, edges: DataFrame, confidence: float = 0.6) -> DataFrame:
    """J-08: public callable or class with no incoming edge of any type."""
    targets = edges.select(F.col("dst").alias("id"))
    return (symbols.where(F.col("kind").isin("METHOD", "FUNCTION", "CLASS") & (F.col("access") == "PUBLIC"))
            .join(targets, "id", "left_anti")
            .select("id", "name", "kind", F.lit(confidence).alias("confidence")))


def files_without_symbols(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """J-09."""
    return files.join(symbols.select(F.col("file_id").alias("id")), "id", "left_anti").select("id", "path")


def orphan_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """J-10: edges whose source or target symbol is missing (a null end is missing).

    Two joins against the distinct ids flag the ends; every edge row is decided
    once, whatever its type."""
    ids = symbols.select("id").distinct()
    src = ids.select(F.col("id").alias("src"), F.lit(True).alias("_has_src"))
    dst = ids.select(F.col("id").alias("dst"), F.lit(True).alias("_has_dst"))
    flagged = edges.join(src, "src", "left").join(dst, "dst", "left")
    return flagged.where("_has_src is null or _has_dst is null").select(*edges.columns)


def clean_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """J-10: edges whose both ends exist."""
    ids = symbols.select("id")
    return (edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
            .join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"))


def tracked_status(discovered: DataFrame, tracked: DataFrame, keys: list[str]) -> DataFrame:
    """J-30: left join flag ``is_tracked`` with the tracked row's id."""
    t = tracked.select(*keys, F.col("id").alias("tracked_id"))
    return (discovered.join(t, keys, "left")
            .withColumn("is_tracked", F.col("tracked_id").isNotNull()))


def controller_methods(symbols: DataFrame) -> DataFrame:
    """J-31: methods matched to their class by parent id **or** parent FQN.

    The OR is split into two equi-joins (parent id; parent name = class FQN),
    unioned with the id match taking priority — an OR join would be a nested
    loop."""
    cls = symbols.where(F.col("kind").isin("CLASS", "INTERFACE")).select(
        F.col("id").alias("class_id"), F.col("fqn").alias("class_fqn"))
    m = symbols.where(F.col("kind").isin("METHOD", "FUNCTION"))
    parent_id = m.withColumn("parent_symbol_id", F.lit(None).cast("bigint")) \
        if "parent_symbol_id" not in m.columns else m
    by_id = parent_id.join(cls, parent_id["parent_symbol_id"] == cls["class_id"], "inner") \
        .select(F.col("id").alias("method_id"), "class_id", F.lit(1).alias("tier"))
    by_name = m.join(cls, m["parent_name"] == cls["class_fqn"], "inner") \
        .select(F.col("id").alias("method_id"), "class_id", F.lit(2).alias("tier"))
    w = Window.partitionBy("method_id").orderBy("tier", "class_id")
    return (by_id.unionByName(by_name).withColumn("rn", F.row_number().over(w))
            .where("rn = 1").drop("rn"))


# --------------------------------------------------------------------------- windows / top-k

def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """Keep the first ``n`` rows per key under a total order (W-03, A-22)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def first_chunk(chunks: DataFrame, key: str, order_col: str, text_col: str, max_len: int | None = None) -> DataFrame:
    """W-02: first chunk per key; with ``max_len`` cut at that many chars plus
    ``...``, and ``snippet_cut`` says where.
    ``min_by`` is a hash aggregate (partial + final), no sort per group."""
    g = chunks.groupBy(key).agg(F.min_by(F.col(text_col), F.col(order_col)).alias("snippet"))
    if max_len is None:
        return g
    s = F.col("snippet")
    cut = F.coalesce(F.length(s) > max_len, F.lit(False))
    return g.select(key, F.when(cut, F.concat(F.substring(s, 1, max_len), F.lit("..."))).otherwise(s).alias("snippet"),
                    cut.alias("snippet_cut"))


def running_budget(df: DataFrame, keys: list[str], order: list[Column], len_col: Column,
                   max_total: int, per_row_extra: int = 1) -> DataFrame:
    """A-29 / W-04: keep the longest prefix (in rank order) whose cumulative
    length (+``per_row_extra`` per row) fits the budget."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (df.withColumn("cum_len", F.sum(len_col + per_row_extra).over(w))
            .where(F.col("cum_len") <= max_total))


def nearest_preceding(df: DataFrame, keys: list[str], pos_col: str, is_anchor: Column,
                      anchor_value: Column) -> DataFrame:
    """W-05: for every row, the last anchor value strictly before it."""
    w = (Window.partitionBy(*keys).orderBy(pos_col)
         .rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("preceding", F.last(F.when(is_anchor, anchor_value), ignorenulls=True).over(w))


# --------------------------------------------------------------------------- set operations

def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "path", hash_col: str = "content_hash") -> DataFrame:
    """S-04: A / M / D / R between two snapshots (columns change, old_path, new_path, old_hash, new_hash).

    Both snapshots are tagged, united and aggregated per path (one shuffle,
    combined map-side), which classifies A, M and D; hashes are compared
    null-safe, so a null hash on both sides is unchanged and never a rename.
    A deleted path whose exact content re-appears under an added path is a
    rename; copies are paired 1:1, the k-th deleted path (by name) of a hash
    with its k-th added path.  The k-th place is counted in buckets of the
    path's own hash, so one content with very many copies is spread out."""
    ensure_checkpoint_dir(old.sparkSession)

    def side(df: DataFrame, tag: int) -> DataFrame:
        return df.select(F.col(key).alias("path"), F.col(hash_col).alias("hash"), F.lit(tag).alias("tag"))

    def of(tag: int) -> Column:
        return F.max(F.when(F.col("tag") == tag, F.struct(F.col("hash"))))

    both = (side(old, 0).unionByName(side(new, 1)).groupBy("path").agg(of(0).alias("o"), of(1).alias("n"))
            .withColumn("change", F.when(F.col("o").isNull(), "A").when(F.col("n").isNull(), "D")
                        .when(~F.col("o.hash").eqNullSafe(F.col("n.hash")), "M"))
            .where(F.col("change").isNotNull())
            .select("change", "path", F.col("o.hash").alias("old_hash"), F.col("n.hash").alias("new_hash"))
            .checkpoint(eager=True))  # read by three branches: hash the texts once
    moved = F.col("change").isin("A", "D") & F.coalesce("old_hash", "new_hash").isNotNull()
    rows = both.where(moved).withColumn("hash", F.coalesce("old_hash", "new_hash"))
    # a hash with both an added and a deleted path; the others can't be renames
    paired = (rows.groupBy("hash").agg(F.count_if(F.col("change") == "A").alias("na"),
                                       F.count_if(F.col("change") == "D").alias("nd"))
              .where("na > 0 and nd > 0").select("hash"))
    rows = rows.join(paired, "hash").withColumn("lead2", F.substring("path", 1, 2))
    # place = rows in earlier buckets (a path prefix, so buckets are in order) + place in the own bucket
    sizes = rows.groupBy("hash", "change", "lead2").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("hash", "change").orderBy("lead2").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    inside = Window.partitionBy("hash", "change", "lead2").orderBy("path")
    placed = (rows.withColumn("r", F.row_number().over(inside)).join(offsets, ["hash", "change", "lead2"])
              .select("hash", "change", "path", (F.col("r") + F.col("offset")).alias("k")))
    renamed = (placed.groupBy("hash", "k").agg(F.max(F.when(F.col("change") == "D", F.col("path"))).alias("old_path"),
                                               F.max(F.when(F.col("change") == "A", F.col("path"))).alias("new_path"))
               .where("old_path is not null and new_path is not null"))
    taken = renamed.select(F.explode(F.array(F.struct(F.lit("D").alias("change"), F.col("old_path").alias("path")),
                                             F.struct(F.lit("A").alias("change"), F.col("new_path").alias("path"))))
                           .alias("x")).select("x.change", "x.path")
    rest = both.join(taken, ["change", "path"], "left_anti")
    return (rest.select("change", F.when(F.col("change") != "A", F.col("path")).alias("old_path"),
                        F.when(F.col("change") != "D", F.col("path")).alias("new_path"), "old_hash", "new_hash")
            .unionByName(renamed.select(F.lit("R").alias("change"), "old_path", "new_path",
                                        F.col("hash").alias("old_hash"), F.col("hash").alias("new_hash"))))


def segment_overlap(a: Column, b: Column) -> Column:
    """S-02: size of the intersection of two path-segment sets."""
    return F.size(F.array_intersect(F.array_distinct(a), F.array_distinct(b)))


def fuse_lists(a: DataFrame, b: DataFrame, key: str, score: str = "score") -> DataFrame:
    """S-01: outer union of two scored lists by id; a score per side and their sum."""
    j = (a.select(key, F.col(score).alias("score_a"))
         .join(b.select(key, F.col(score).alias("score_b")), key, "full_outer"))
    return j.withColumn("score", F.coalesce("score_a", F.lit(0.0)) + F.coalesce("score_b", F.lit(0.0)))


def sample_per_group(df: DataFrame, group: list[str], id_col: str, n: int = 5, seed: int = 42) -> DataFrame:
    """T-04: ``n`` pseudo-random rows per group, reproducible: the random key is
    the md5 of ``seed:id``, so a retried task draws the same sample."""
    draw = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(id_col).cast("string")).cast("binary"))
    w = Window.partitionBy(*group).orderBy(draw, F.col(id_col))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")



def assign_files_to_projects(files: DataFrame, projects: DataFrame) -> DataFrame:
    """J-18: each file → the deepest project whose directory contains it
    (lowest project id among equally deep ones); files outside every project
    get null.  The theta "path starts with directory" becomes an equi-join on
    the file's exploded ancestor directories."""
    pdir = F.regexp_replace(F.regexp_replace("project_path", r"\\", "/"), r"/[^/]*$", "")
    p = projects.select(F.col("id").alias("project_id"), pdir.alias("dir")).where(F.col("dir") != "")
    parts = F.split(F.col("path"), "/")
    anc = files.select("id", "path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
                                                           lambda k: F.struct(k.alias("depth"),
                                                                              F.array_join(F.slice(parts, 1, k), "/").alias("dir"))))
                       .alias("a")).where(F.size(parts) > 1).select("id", "path", F.col("a.depth").alias("depth"),
                                                                    F.col("a.dir").alias("dir"))
    hit = anc.join(p, "dir")
    best = hit.groupBy("id").agg(F.max(F.struct(F.col("depth"), (-F.col("project_id")).alias("neg"))).alias("_b"))
    best = best.select("id", (-F.col("_b.neg")).alias("project_id"))
    return files.select("id", "path").join(best, "id", "left")


# --------------------------------------------------------------------------- more filters (F-04 … F-17)

def like_glob(glob: str) -> str:
    """F-04: ``*`` → ``%`` (other LIKE wildcards, e.g. ``_``, stay active as in the reference)."""
    return glob.replace("*", "%")


def config_search(cfg: DataFrame, key_glob: str, repository=None, environment=None) -> DataFrame:
    """F-04: config entries whose key matches the glob (case-insensitive),
    optional repository / environment filters; secrets shown as ``[REDACTED]``."""
    df = cfg.where(F.col("config_key").ilike(like_glob(key_glob)))
    if repository is not None:
        df = df.where(F.col("repository_id") == repository)
    if environment is not None:
        df = df.where(F.col("environment") == environment)
    return df.withColumn("display_value", F.when(F.col("is_secret") == 1, F.lit("[REDACTED]"))
                         .otherwise(F.col("config_value")))


def config_findings(cfg: DataFrame, top: int | None = None) -> DataFrame:
    """F-06: secret entries or keys about connections / endpoints / keys, value
    masked; only the first ``top`` by (id, key) when asked for."""
    k = F.lower("config_key")
    hit = (F.col("is_secret") == 1) | k.contains("connection") | k.contains("endpoint") | k.contains("key")
    out = cfg.where(hit).withColumn("masked_value", F.lit("********"))
    return out if top is None else out.orderBy("id", "config_key").limit(top)


def doc_search(sections: DataFrame, query: str, preview: int = 300) -> DataFrame:
    """F-05: DOCUMENT_SECTION / CODE_EXAMPLE rows whose name, documentation or
    signature contains the query (case-folded), with a preview."""
    q = query.lower()
    cond = (F.lower(F.coalesce("name", F.lit(""))).contains(q) | F.lower(F.coalesce("documentation", F.lit(""))).contains(q)
            | F.lower(F.coalesce("signature", F.lit(""))).contains(q))
    return (sections.where(F.col("kind").isin("DOCUMENT_SECTION", "CODE_EXAMPLE") & cond)
            .withColumn("preview", F.substring(F.coalesce("documentation", F.lit("")), 1, preview)))


# Words ignored by the generic keyword filter (F-12).
GENERIC_STOP_WORDS = ("find", "get", "list", "show", "all", "the")


def generic_keywords(text: str) -> list[str]:
    """F-12 keyword list (driver-side, from the user's text): words longer than
    3 characters, not stop words."""
    return [w for w in text.lower().split() if len(w) > 3 and w not in GENERIC_STOP_WORDS]


def generic_keyword_filter(ctx: DataFrame, text: str) -> DataFrame:
    """F-12: OR of ``contains`` on lower-case name / signature per keyword (all rows when none)."""
    kws = generic_keywords(text)
    if not kws:
        return ctx
    cond = reduce(lambda a, b: a | b, [F.lower(F.coalesce("name", F.lit(""))).contains(k)
                                       | F.lower(F.coalesce("signature", F.lit(""))).contains(k) for k in kws])
    return ctx.where(cond)


def endpoint_filter(endpoints: DataFrame, method: str | None = None, route_glob: str | None = None) -> DataFrame:
    """F-13: method equality (case-folded) and a ``*`` → ``.*`` anchored route match."""
    df = endpoints
    if method:
        df = df.where(F.upper("http_method") == method.upper())
    if route_glob:
        rx = "^" + re.escape(route_glob).replace(r"\*", ".*") + "$"
        df = df.where(F.col("route").rlike(rx))
    return df


def file_tree(files: DataFrame, symbols: DataFrame, prefix: str = "", depth: int = 2) -> DataFrame:
    """F-16: directories below ``prefix`` down to ``depth`` levels with their
    direct-file and symbol counts (directories holding no direct file appear
    with zeros)."""
    pre = prefix.strip("/")
    f = files if not pre else files.where(F.col("path").startswith(pre + "/"))
    rel = F.expr(f"substring(path, {len(pre) + 2})") if pre else F.col("path")
    f = f.select("id", rel.alias("rel"))
    parts = F.split("rel", "/")
    ndir = F.size(parts) - 1
    dirs = (f.where(ndir >= 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.least(ndir, F.lit(depth))),
                                                            lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("dir"))
            .distinct())
    spf = symbols.groupBy(F.col("file_id").alias("id")).agg(F.count(F.lit(1)).alias("n_sym"))
    direct = (f.where((ndir >= 1) & (ndir <= depth)).join(spf, "id", "left")
              .groupBy(F.array_join(F.slice(parts, 1, ndir), "/").alias("dir"))
              .agg(F.count(F.lit(1)).alias("direct_files"), F.sum(F.coalesce("n_sym", F.lit(0))).cast("bigint").alias("symbols")))
    return (dirs.join(direct, "dir", "left")
            .select("dir", F.size(F.split("dir", "/")).cast("int").alias("depth"),
                    F.coalesce("direct_files", F.lit(0)).cast("bigint").alias("direct_files"),
                    F.coalesce("symbols", F.lit(0)).cast("bigint").alias("symbols")))
