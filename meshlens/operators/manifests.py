"""Dependencies from manifests and lock files (E-07).

The file table is read once: every manifest row becomes rows of the common shape by its kind, in place.  A lock file of
version 1 nests packages in packages: its tree is opened level by level until none is left, at any depth; version 2
names each package by its path.  Both give the same node table, on which requirements are resolved as Node does: the
nearest enclosing folder that holds the package.

TOML is read as far as dependency tables need: double-quoted strings, inline tables on a line, arrays over lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlens.session import ensure_checkpoint_dir

NPM_PARTS = (("dependencies", False), ("devDependencies", True), ("peerDependencies", False))
NPM_SCHEMA = "struct<" + ", ".join(f"{part}: map<string,string>" for part, _ in NPM_PARTS) + ">"
LOCK_SCHEMA = ("struct<packages: map<string, struct<version: string, dependencies: map<string,string>, "
               "devDependencies: map<string,string>>>, dependencies: map<string,string>>")
NODE_SCHEMA = "struct<version: string, requires: map<string,string>, dependencies: map<string,string>>"
# name, then the rest without an extras list
REQ_LINE = r"^([\w.-]+)(?:\[[^\]]*\])?(.*)$"
PACKAGE_REFERENCE = r"<PackageReference\s+[^>]*Include=\"([^\"]+)\"[^>]*>"
PACKAGE_ELEMENT = r"<package\s+[^>]*id=\"([^\"]+)\"[^>]*>"
VERSION_ATTRIBUTE = r"(?i)\bversion=\"([^\"]*)\""
DEV_ATTRIBUTE = (r"PrivateAssets=\"All\"|"
                 r"IncludeAssets=\"runtime; build; native; contentfiles; analyzers\"")
SECTION = r"(?m)^(\[[^\[\]\n]+\])[ \t]*$"
ENTRY = r"^\"?([\w.-]+)\"?\s*=\s*(.*)$"
ARRAY = r"^([\w-]+)\s*=\s*\[((?:[^\"\]]*+\"[^\"]*+\")*+)"
#: Optional groups that are for development.
DEV_GROUPS = ("dev", "test", "tests", "development")
ROWS = ("array<struct<package: string, version: string, version_constraint: string, is_dev_dependency: boolean, "
        "dependency_type: string>>")
COLUMNS = ("path", "package", "version", "version_constraint", "is_dev_dependency", "is_transitive", "depth", "dependency_type")


def _base(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def _dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def manifest_kind(path: Column) -> Column:
    base = _base(path)
    return (F.when(base == "package.json", "npm").when(base == "package-lock.json", "lock")
            .when(base.endswith(".txt") & base.contains("requirements"), "pip")
            .when(base == "pipfile", "pipfile").when(base == "pyproject.toml", "pyproject")
            .when(base == "packages.config", "config")
            .when(base.endswith(".csproj") | base.isin("directory.build.props", "directory.packages.props"), "nuget"))


def _row(package: Column, version: Column, constraint: Column, dev: Column, kind: str) -> Column:
    def text(c: Column) -> Column:
        return F.when(c != "", c)
    return F.struct(package.alias("package"), text(version).alias("version"), text(constraint).alias("version_constraint"),
                    dev.alias("is_dev_dependency"), F.lit(kind).alias("dependency_type"))


def _requirement(line: Column, dev: Column) -> Column:
    spec = F.trim(F.regexp_extract(line, REQ_LINE, 2))
    version = F.when(spec.contains("=="), F.trim(F.element_at(F.split(spec, "=="), 2)))
    return _row(F.regexp_extract(line, REQ_LINE, 1), version, spec, dev, "pip")


def _npm(text: Column) -> Column:
    doc = F.from_json(text, NPM_SCHEMA)
    none = F.create_map().cast("map<string,string>")

    def rows(part: str, dev: bool) -> Column:
        return F.transform(F.map_entries(F.coalesce(doc[part], none)), lambda e: _row(
            e["key"], F.lit(None).cast("string"), e["value"], F.lit(dev), "npm"))
    return F.concat(*(rows(part, dev) for part, dev in NPM_PARTS))


def _pip(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    skipped = ("#", "-r ", "-c ", "-e ", "--")
    kept = F.filter(lines, lambda x: (x != "") & ~reduce(lambda a, b: a | b, [x.startswith(s) for s in skipped]) & x.rlike(REQ_LINE))
    return F.transform(kept, lambda x: _requirement(x, F.lit(False)))


def _sections(text: Column) -> Column:
    """The tables of a TOML text: (name, lines)."""
    cut = F.filter(F.split(F.regexp_replace(text, SECTION, "\u0001$1"), "\u0001"), lambda x: x.startswith("["))
    return F.transform(cut, lambda x: F.struct(F.regexp_extract(x, r"^\[([^\]]+)\]", 1).alias("name"), x.alias("body")))


def _entries(sections: Column, dev_of, missing: str) -> Column:
    """``name = "spec"`` and ``name = {version = "spec"}`` lines of the sections for which ``dev_of`` isn't null."""
    def lines(s: Column) -> Column:
        found = F.filter(F.transform(F.split(s["body"], "\n"), lambda x: F.trim(x)), lambda x: x.rlike(ENTRY))
        return F.transform(found, lambda x: F.struct(F.regexp_extract(x, ENTRY, 1).alias("name"),
                                                     F.trim(F.regexp_extract(x, ENTRY, 2)).alias("value"), dev_of(s["name"]).alias("dev")))
    entries = F.flatten(F.transform(F.filter(sections, lambda s: dev_of(s["name"]).isNotNull()), lines))

    def spec(value: Column) -> Column:
        inline = F.regexp_extract(value, r"version\s*=\s*\"([^\"]*)\"", 1)
        return (F.when(value.startswith('"'), F.regexp_extract(value, r"^\"([^\"]*)\"", 1))
                .when(value.startswith("{"), F.when(inline == "", F.lit(missing)).otherwise(inline)).otherwise(value))
    return F.transform(F.filter(entries, lambda e: e["name"] != "python"), lambda e: _row(
        e["name"], F.lit(None).cast("string"), spec(e["value"]), e["dev"], "pip"))


def _pipfile(text: Column) -> Column:
    return _entries(_sections(text), lambda n: F.when(n == "packages", False).when(n == "dev-packages", True), "*")


def _pyproject(text: Column) -> Column:
    sections = _sections(text)

    def poetry(n: Column) -> Column:
        return (F.when(n == "tool.poetry.dependencies", False).when(n == "tool.poetry.dev-dependencies", True)
                .when(n.rlike(r"^tool\.poetry\.group\.[^.]+\.dependencies$"), True))

    def arrays(s: Column) -> Column:
        """Requirement strings of a section's arrays, with the array's name."""
        both = F.arrays_zip(F.regexp_extract_all(s["body"], F.lit("(?m)" + ARRAY), 1).alias("name"),
                            F.regexp_extract_all(s["body"], F.lit("(?m)" + ARRAY), 2).alias("items"))
        named = F.filter(both, lambda z: (s["name"] == "project.optional-dependencies")
                         | ((s["name"] == "project") & (z["name"] == "dependencies")))
        return F.flatten(F.transform(named, lambda z: F.transform(
            F.regexp_extract_all(z["items"], F.lit(r"\"([^\"]*)\""), 1),
            lambda x: F.struct(F.trim(F.regexp_replace(F.substring_index(x, ";", 1), r"[()]", " ")).alias("line"),
                               ((s["name"] != "project") & z["name"].isin(*DEV_GROUPS)).alias("dev")))))
    listed = F.filter(F.flatten(F.transform(sections, arrays)), lambda x: x["line"].rlike(REQ_LINE))
    return F.concat(F.transform(listed, lambda x: _requirement(x["line"], x["dev"])), _entries(sections, poetry, ""))


def _xml(text: Column, element: str) -> Column:
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(element), 0).alias("tag"),
                         F.regexp_extract_all(text, F.lit(element), 1).alias("name"))
    return F.transform(found, lambda z: _row(z["name"], F.regexp_extract(z["tag"], VERSION_ATTRIBUTE, 1),
                                             F.regexp_extract(z["tag"], VERSION_ATTRIBUTE, 1),
                                             z["tag"].rlike(DEV_ATTRIBUTE), "nuget"))


def lock_nodes(files: DataFrame) -> DataFrame:
    """The packages of every package-lock.json: path, node (its place, as ``node_modules/a/node_modules/b``), package,
    parent (place, '' at the top), depth (0 at the top), version, dev flag and requires (name → range)."""
    ensure_checkpoint_dir(files.sparkSession)
    lock = files.where(_base(F.col("path")) == "package-lock.json").select("path", F.from_json("content", LOCK_SCHEMA).alias("d"))
    root = F.col("d.packages")[""]
    dev = F.map_keys(F.coalesce(root["devDependencies"], F.create_map().cast("map<string,string>")))
    two = (lock.where(F.col("d.packages").isNotNull()).select("path", dev.alias("dev"), F.explode("d.packages").alias("node", "p"))
           .where("node <> ''"))
    two = two.select("path", "node", F.element_at(F.split("node", "node_modules/"), -1).alias("package"), "p.version", "dev",
                     F.col("p.dependencies").alias("requires"))
    two = (two.withColumn("parent", F.regexp_extract("node", r"^(.*?)/?node_modules/(?:(?!node_modules/).)*$", 1))
           .withColumn("is_dev_dependency", F.array_contains("dev", F.col("package"))).drop("dev"))
    level = (lock.where(F.col("d.packages").isNull()).select("path", F.lit("").alias("parent"), F.explode("d.dependencies").alias("package", "j")))
    levels = []
    while True:
        level = level.withColumn("p", F.from_json("j", NODE_SCHEMA)).withColumn("node", F.concat(
            F.when(F.col("parent") == "", F.lit("")).otherwise(F.concat("parent", F.lit("/"))), F.lit("node_modules/"), F.col("package")))
        level = level.select("path", "node", "package", "parent", "p").checkpoint(eager=True)
        levels.append(level)
        level = (level.where(F.size("p.dependencies") > 0)
                 .select("path", F.col("node").alias("parent"), F.explode("p.dependencies").alias("package", "j")))
        if level.isEmpty():
            break
    one = reduce(DataFrame.unionByName, levels).select(
        "path", "node", "package", "p.version", F.col("p.requires").alias("requires"), "parent", F.lit(False).alias("is_dev_dependency"))
    depth = F.size(F.split("node", "node_modules/")) - 2
    return two.unionByName(one).withColumn("depth", depth)


def extract_dependencies(files: DataFrame) -> DataFrame:
    """E-07: one row per dependency of package.json, package-lock.json (versions 1 and 2), requirements*.txt, Pipfile,
    pyproject.toml (PEP 621 and Poetry), .csproj, Directory.*.props and packages.config: package, exact version,
    constraint, dev and transitive flags, depth in the tree of a lock file, manifest type.  A package.json with a
    package-lock.json beside it is skipped (an anti-join on the directory)."""
    kind = manifest_kind(F.col("path"))
    lock_dirs = files.where(_base(F.col("path")) == "package-lock.json").select(_dir(F.col("path")).alias("_dir"), F.lit("npm").alias("_kind")).distinct()
    plain = files.select("path", "content", kind.alias("kind")).where(F.col("kind").isNotNull() & (F.col("kind") != "lock"))
    plain = plain.join(lock_dirs, (_dir(F.col("path")) == F.col("_dir")) & (F.col("kind") == F.col("_kind")), "left_anti")
    text, k = F.coalesce("content", F.lit("")), F.col("kind")
    by_kind = {"npm": _npm(text), "pip": _pip(text), "pipfile": _pipfile(text), "pyproject": _pyproject(text),
               "nuget": _xml(text, PACKAGE_REFERENCE), "config": _xml(text, PACKAGE_ELEMENT)}
    rows = F.coalesce(*(F.when(k == name, found.cast(ROWS)) for name, found in by_kind.items()))
    flat = (plain.select("path", F.explode(rows).alias("r")).select("path", "r.*")
            .withColumns({"is_transitive": F.lit(False), "depth": F.lit(0)}))
    locked = lock_nodes(files).select("path", "package", "version", F.col("version").alias("version_constraint"), "is_dev_dependency",
                                      (F.col("depth") > 0).alias("is_transitive"), "depth", F.lit("npm").alias("dependency_type"))
    return flat.select(*COLUMNS).unionByName(locked.select(*COLUMNS))


def lock_requirements(files: DataFrame) -> DataFrame:
    """E-07: what each locked package requires → the package that serves it: the one in the nearest enclosing folder
    (own, then the parents', up to the top); null where the lock file has none.  ``hoisted``: it lies above the
    package's own folder."""
    ensure_checkpoint_dir(files.sparkSession)
    nodes = lock_nodes(files).checkpoint(eager=True)
    asked = nodes.select("path", "node", F.explode("requires").alias("package", "range"))
    steps = F.split("node", "/(?=node_modules/)")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.struct(i.alias("level"), F.concat_ws(
        "/", F.slice(steps, 1, i), F.array(F.concat(F.lit("node_modules/"), F.col("package")))).alias("found")))
    places = asked.select("path", "node", "package", "range", F.size(steps).alias("own"), F.explode(above).alias("c")).select(
        "path", "node", "package", "range", "own", "c.*")
    hit = (places.join(nodes.select("path", F.col("node").alias("found"), F.col("version").alias("found_version")), ["path", "found"])
           .groupBy("path", "node", "package").agg(F.max(F.struct("level", "found", "found_version")).alias("b")))
    return (asked.join(hit, ["path", "node", "package"], "left")
            .select("path", "node", "package", "range", F.col("b.found").alias("served_by"), F.col("b.found_version").alias("version"),
                    (F.col("b.level") < F.size(steps)).alias("hoisted")))
