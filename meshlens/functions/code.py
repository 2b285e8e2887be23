"""Scalar expressions over symbols and paths (X-12 … X-20, X-24, X-25, X-28, X-29).

Rule tables are plain data; :func:`contains_any` turns one into a native
``Column`` (and :func:`contains_any_sql` into the DuckDB twin used by the
oracle), so both engines evaluate the same rule list.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_any(c: Column, parts) -> Column:
    """One alternation, so that ``c`` is evaluated once however many parts there are."""
    return c.rlike("|".join(re.escape(p) for p in parts))


def contains_any_sql(c: str, parts) -> str:
    return "(" + " OR ".join(f"contains({c}, '{p}')" for p in parts) + ")"


def endswith_any(c: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, [c.endswith(p) for p in parts])


# Layer rules in the reference's order (X-12).  Each rule: layer,
# substrings of the lower-case name or parent name, substrings of the lower-case path.
LAYER_RULES = (
    ("Controller", ("controller", "apicontroller"), ("controllers/", "controller/", "/controllers", "/controller")),
    ("Service", ("service", "manager", "handler", "processor", "provider"),
     ("services/", "service/", "handlers/", "business/")),
    ("Database", ("dbcontext", "database", "connection", "dbset", "context"), ()),
    ("Repository", ("repository", "repo", "store", "dao", "dataaccess"),
     ("repositories/", "repository/", "data/", "dataaccess/", "dal/", "persistence/", "stores/")),
    ("Middleware", ("middleware",), ("middleware",)),
    ("Validator", ("validator", "validation"), ("validators/", "validation/")),
    ("Mapper", ("mapper", "mapping", "profile"), ("mappers/", "mapping/", "mappings/")),
)
DB_ORM_NAME_PARTS = ("entityframework", "ef.", "sequelize", "typeorm", "mongoose")
MODEL_PATH_PARTS = ("models/", "model/", "entities/", "entity/", "domain/", "dtos/", "dto/", "viewmodels/",
                    "contracts/")
MODEL_NAME_SUFFIXES = ("dto", "viewmodel", "entity", "model")
UTILITY_NAME_PARTS = ("helper", "util", "utility", "extension", "common")
UTILITY_PATH_PARTS = ("helpers/", "utils/", "utilities/", "extensions/", "common/")


def layer(name: Column, parent: Column, path: Column, kind: Column) -> Column:
    """X-12: first matching layer, else ``Unknown`` (Model only for CLASS)."""
    n = F.lower(F.coalesce(name, F.lit("")))
    p = F.lower(F.coalesce(parent, F.lit("")))
    fp = F.lower(F.coalesce(path, F.lit("")))
    expr = None
    for lay, name_parts, path_parts in LAYER_RULES:
        cond = contains_any(n, name_parts) | contains_any(p, name_parts)
        if path_parts:
            cond = cond | contains_any(fp, path_parts)
        if lay == "Database":
            cond = cond | contains_any(n, DB_ORM_NAME_PARTS)
        expr = F.when(cond, F.lit(lay)) if expr is None else expr.when(cond, F.lit(lay))
    is_class = kind == "CLASS"
    expr = expr.when(is_class & (contains_any(fp, MODEL_PATH_PARTS) | endswith_any(n, MODEL_NAME_SUFFIXES)),
                     F.lit("Model"))
    util = contains_any(n, UTILITY_NAME_PARTS) | contains_any(p, UTILITY_NAME_PARTS) | contains_any(fp, UTILITY_PATH_PARTS)
    return expr.when(util, F.lit("Utility")).otherwise(F.lit("Unknown"))


def layer_sql(name: str, parent: str, path: str, kind: str) -> str:
    n, p, fp = f"lower(coalesce({name}, ''))", f"lower(coalesce({parent}, ''))", f"lower(coalesce({path}, ''))"
    parts = []
    for lay, name_parts, path_parts in LAYER_RULES:
        cond = f"{contains_any_sql(n, name_parts)} OR {contains_any_sql(p, name_parts)}"
        if path_parts:
            cond += f" OR {contains_any_sql(fp, path_parts)}"
        if lay == "Database":
            cond += f" OR {contains_any_sql(n, DB_ORM_NAME_PARTS)}"
        parts.append(f"WHEN {cond} THEN '{lay}'")
    suffix = "(" + " OR ".join(f"ends_with({n}, '{s}')" for s in MODEL_NAME_SUFFIXES) + ")"
    parts.append(f"WHEN {kind} = 'CLASS' AND ({contains_any_sql(fp, MODEL_PATH_PARTS)} OR {suffix}) THEN 'Model'")
    parts.append(f"WHEN {contains_any_sql(n, UTILITY_NAME_PARTS)} OR {contains_any_sql(p, UTILITY_NAME_PARTS)} "
                 f"OR {contains_any_sql(fp, UTILITY_PATH_PARTS)} THEN 'Utility'")
    return "CASE " + " ".join(parts) + " ELSE 'Unknown' END"


# Role keywords (X-13), matched against the lower-case FQN (or name).
ROLE_KEYWORDS = (
    ("Controller", ("controller", "api", "endpoint")),
    ("Service", ("service", "manager", "handler", "provider")),
    ("Repository", ("repository", "repo", "dao", "dataaccess")),
    ("Model", ("model", "entity", "dto", "viewmodel")),
    ("Utility", ("helper", "util", "utils", "utility", "extension")),
)


def roles(fqn: Column, name: Column) -> Column:
    """X-13: roles whose keyword occurs in the FQN (or name), in rule order."""
    s = F.lower(F.coalesce(fqn, name, F.lit("")))
    arr = F.array(*[F.when(contains_any(s, kws), F.lit(r)) for r, kws in ROLE_KEYWORDS])
    return F.filter(arr, lambda x: x.isNotNull())


def roles_sql(fqn: str, name: str) -> str:
    s = f"lower(coalesce({fqn}, {name}, ''))"
    items = ", ".join(f"CASE WHEN {contains_any_sql(s, kws)} THEN '{r}' END" for r, kws in ROLE_KEYWORDS)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


# Extension → language (X-14).
EXTENSION_LANGUAGE = (
    (".cs", "CSHARP"), (".js", "JAVASCRIPT"), (".jsx", "JAVASCRIPT"), (".mjs", "JAVASCRIPT"),
    (".ts", "TYPESCRIPT"), (".tsx", "TYPESCRIPT"), (".vue", "VUE"), (".py", "PYTHON"),
    (".md", "MARKDOWN"), (".markdown", "MARKDOWN"), (".sql", "SQL"), (".ddl", "SQL"),
    (".csproj", "CSHARP"), (".sln", "CSHARP"),
)


def file_suffix(path: Column) -> Column:
    """Lower-case extension of the last path part (``''`` when none)."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(base, r"(?:.)(\.[^.]*)$", 1))


def language_of(path: Column) -> Column:
    """X-14: extension map; ``.json`` is C# for ``appsettings*`` else JavaScript."""
    suf = file_suffix(path)
    expr = F.element_at(F.create_map(*[x for k, v in EXTENSION_LANGUAGE for x in (F.lit(k), F.lit(v))]), suf)
    base = F.lower(F.element_at(F.split(path, "/"), -1))
    json_lang = F.when(base.startswith("appsettings"), F.lit("CSHARP")).otherwise(F.lit("JAVASCRIPT"))
    return F.when(suf == ".json", json_lang).otherwise(F.coalesce(expr, F.lit("UNKNOWN")))


# External package indicators (X-15), compared case-insensitively.
EXTERNAL_INDICATORS = (".dll", "node_modules/", "site-packages/", "System.", "Microsoft.", "Newtonsoft.",
                       "EntityFramework")


def is_external(path: Column, fqn: Column) -> Column:
    """X-15."""
    p, f = F.lower(F.coalesce(path, F.lit(""))), F.lower(F.coalesce(fqn, F.lit("")))
    low = [i.lower() for i in EXTERNAL_INDICATORS]
    return contains_any(p, low) | contains_any(f, low)


# Standard locations raising edge confidence (X-16).
STANDARD_PATHS = ("controllers/", "services/", "repositories/", "models/")


def edge_confidence(signature: Column, documentation: Column, relation: Column, path: Column) -> Column:
    """X-16: .5 + .1 signature + .1 docs + .2 CALL relation + .1 standard path, ≤ 1."""
    s = (F.lit(0.5)
         + F.when(F.coalesce(signature, F.lit("")) != "", 0.1).otherwise(0.0)
         + F.when(F.coalesce(documentation, F.lit("")) != "", 0.1).otherwise(0.0)
         + F.when(F.upper(F.coalesce(relation, F.lit(""))).contains("CALL"), 0.2).otherwise(0.0)
         + F.when(contains_any(F.lower(F.coalesce(path, F.lit(""))), STANDARD_PATHS), 0.1).otherwise(0.0))
    return F.round(F.least(s, F.lit(1.0)), 4)


def token_estimate_signature(signature: Column, documentation: Column) -> Column:
    """X-17 (signature form): (len(signature) + len(doc) if doc < 200 chars) div 4, or 20 when 0."""
    sl = F.coalesce(F.length(signature), F.lit(0))
    dl = F.when(F.length(documentation) < 200, F.length(documentation)).otherwise(0)
    t = F.floor((sl + F.coalesce(dl, F.lit(0))) / 4)
    return F.when(t == 0, F.lit(20)).otherwise(t).cast("bigint")


def namespace_of(fqn: Column) -> Column:
    """X-18: text before the last dot ('' when none)."""
    return F.regexp_extract(fqn, r"^(.*)\.[^.]*$", 1)


def is_public(access: Column) -> Column:
    """X-18: public or protected, case-folded (the reference's check is always false)."""
    return F.lower(access).isin("public", "protected")


# Type names skipped when building reference edges (X-20).
SKIPPED_TYPES = ("void", "string", "int", "bool", "var", "object", "Task", "List", "IEnumerable", "IQueryable")


def base_types(signature: Column) -> Column:
    """X-19: base names after ``:`` (C#), else after ``extends``; plus the
    ``implements`` list; each part cut at ``{`` and trimmed, empties dropped."""
    def after(sep: str) -> Column:
        return F.element_at(F.split(signature, sep), 2)

    colon = F.split(F.trim(F.substring_index(after(":"), "{", 1)), ",")
    ext = F.array(F.trim(F.substring_index(F.substring_index(after("extends"), "{", 1), "implements", 1)))
    first = (F.when(signature.contains(":"), colon)
             .when(signature.contains("extends"), ext)
             .otherwise(F.array().cast("array<string>")))
    impl = F.when(signature.contains("implements"),
                  F.split(F.trim(F.substring_index(after("implements"), "{", 1)), ",")) \
        .otherwise(F.array().cast("array<string>"))
    return F.filter(F.transform(F.concat(first, impl), lambda x: F.trim(x)), lambda x: x != "")


def clean_type(name: Column) -> Column:
    """X-20: cut at ``[`` and ``<``, trim; null when empty or a skipped type."""
    t = F.trim(F.substring_index(F.substring_index(name, "[", 1), "<", 1))
    return F.when(t.isin(list(SKIPPED_TYPES)) | (t == ""), F.lit(None).cast("string")).otherwise(t)


def normalize_guid(g: Column) -> Column:
    """X-25: strip braces, upper-case."""
    return F.upper(F.trim(F.regexp_replace(g, r"[{}]", "")))


def normalize_project_path(rel: Column, base_dir: Column) -> Column:
    """X-25: ``\\`` → ``/``, resolve ``.``/``..`` segments against ``base_dir``."""
    joined = F.concat_ws("/", F.when(base_dir != "", base_dir), F.regexp_replace(rel, r"\\", "/"))
    segs = F.filter(F.split(joined, "/"), lambda s: (s != "") & (s != "."))
    resolved = F.aggregate(segs, F.array().cast("array<string>"),
                           lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                           .otherwise(F.concat(acc, F.array(s))))
    return F.array_join(resolved, "/")


# Secret key terms (X-28).
SECRET_KEY_TERMS = ("password", "secret", "key", "token", "credential", "connectionstring")


def is_secret_key(key: Column) -> Column:
    """X-28: key contains any secret term (case-folded)."""
    return contains_any(F.lower(key), SECRET_KEY_TERMS)


def environment_of(file_name: Column) -> Column:
    """X-29: ``appsettings.Development.json`` → ``development``; else ``default``."""
    parts = F.split(F.lower(F.element_at(F.split(file_name, "/"), -1)), r"\.")
    env = F.try_element_at(parts, F.lit(-2))
    return F.when((F.size(parts) > 2) & (F.element_at(parts, -1) == "json") & ~env.isin("appsettings", "json"),
                  env).otherwise(F.lit("default"))


def http_verb(method_name: Column) -> Column:
    """X-24: HTTP verb from a method-name prefix."""
    expr = F.lit("HTTP")
    for pre, verb in reversed((("Get", "GET"), ("Post", "POST"), ("Put", "PUT"), ("Delete", "DELETE"),
                               ("Patch", "PATCH"))):
        expr = F.when(method_name.startswith(pre), F.lit(verb)).otherwise(expr)
    return expr
