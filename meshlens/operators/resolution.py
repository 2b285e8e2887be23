"""Name resolution and edge building.

The reference resolves one reference at a time against an in-memory index.
Here every reference of every symbol is resolved in one job: the symbol index is
a (key, symbol) DataFrame exploded from name and FQN, resolution tiers are
equi-joins, and a fallback tier only sees what the previous tiers left
unresolved (anti-join).  Cascades that pick *one* target per reference
pre-aggregate each tier to one candidate per key before joining, so a common
name never multiplies the reference rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlens.functions.code import base_types, clean_type
from meshlens.operators.graph import KeyedEdges
from meshlens.session import ensure_checkpoint_dir


def symbol_index(symbols: DataFrame) -> DataFrame:
    """(key, symbol_id) for every symbol's name and FQN (distinct)."""
    return (symbols.select(F.explode(F.array_distinct(F.array(F.col("name"), F.col("fqn")))).alias("key"),
                           F.col("id").alias("symbol_id"))
            .where(F.col("key").isNotNull()).distinct())


def resolve_types(refs: DataFrame, symbols: DataFrame, ref_col: str = "type_name") -> DataFrame:
    """J-19: a type name resolves to every symbol whose name or FQN equals it;
    names with no such symbol fall back to their last dotted part.  Returns the
    ``refs`` columns plus (symbol_id, tier) — a name may resolve to several
    symbols; unresolved references are absent."""
    idx = symbol_index(symbols)
    r = refs.withColumn("_key", F.col(ref_col)).where(F.col("_key").isNotNull())
    exact = r.join(idx.withColumnRenamed("key", "_key"), "_key").withColumn("tier", F.lit(1))
    keys = idx.select(F.col("key").alias("_key")).distinct()
    left = r.join(keys, "_key", "left_anti").withColumn("_key", F.substring_index("_key", ".", -1))
    simple = left.join(idx.withColumnRenamed("key", "_key"), "_key").withColumn("tier", F.lit(2))
    return exact.unionByName(simple).drop("_key")


def resolve_types_unique(refs: DataFrame, symbols: DataFrame, ref_id: str, ref_col: str = "type_name") -> DataFrame:
    """J-19 (import-aware variant): references that resolve to exactly one symbol."""
    res = resolve_types(refs, symbols, ref_col)
    n = res.groupBy(ref_id).agg(F.count(F.lit(1)).alias("n"), F.min("symbol_id").alias("symbol_id"))
    return n.where(F.col("n") == 1).select(ref_id, "symbol_id")


def reference_edges(symbols: DataFrame, type_refs: DataFrame) -> DataFrame:
    """J-24: REFERENCES edges from each symbol to the types it names
    (``type_refs``: symbol_id, type_name): names cut at ``[`` / ``<``, skipped
    primitives dropped, no self edges, one edge per target."""
    refs = (type_refs.select(F.col("symbol_id").alias("src"), clean_type(F.col("type_name")).alias("type_name"))
            .where(F.col("type_name").isNotNull()).distinct())
    res = resolve_types(refs, symbols)
    return (res.where(F.col("src") != F.col("symbol_id"))
            .select("src", F.col("symbol_id").alias("dst"), F.lit("REFERENCES").alias("type")).distinct())


def inheritance_edges(symbols: DataFrame) -> DataFrame:
    """J-26: CLASS / INTERFACE symbols → every base type parsed from their
    signature (X-19), resolved by J-19, INHERITS, no self edges."""
    t = (symbols.where(F.col("kind").isin("CLASS", "INTERFACE") & F.col("signature").isNotNull())
         .select(F.col("id").alias("src"), F.explode(base_types(F.col("signature"))).alias("type_name")).distinct())
    res = resolve_types(t, symbols)
    return (res.where(F.col("src") != F.col("symbol_id"))
            .select("src", F.col("symbol_id").alias("dst"), F.lit("INHERITS").alias("type")).distinct())


def override_keys(methods: DataFrame) -> KeyedEdges:
    """J-27 factored by name: override METHOD → name → every symbol of that name that is virtual or abstract."""
    out = methods.where((F.col("kind") == "METHOD") & F.col("is_override")).select(F.col("id").alias("src"), F.col("name").alias("key"))
    into = methods.where(F.col("is_virtual") | F.col("is_abstract")).select(F.col("name").alias("key"), F.col("id").alias("dst"))
    return KeyedEdges(out.distinct(), into.distinct().join(out.select("key"), "key", "left_semi"), "OVERRIDES")


def override_edges(methods: DataFrame) -> DataFrame:
    """J-27: every override METHOD → every other symbol of the same name that
    is virtual or abstract: the pairs of :func:`override_keys`."""
    return override_keys(methods).pairs()


def containment_edges(symbols: DataFrame) -> DataFrame:
    """J-28: parent (by FQN) → child in the same file, CONTAINS; also the
    child's ``parent_symbol_id`` (lowest parent id when several match)."""
    parents = symbols.select(F.col("id").alias("parent_id"), F.col("fqn").alias("parent_name"), "file_id")
    kids = symbols.where(F.col("parent_name").isNotNull()).select("id", "parent_name", "file_id")
    j = kids.join(parents, ["file_id", "parent_name"]).where(F.col("id") != F.col("parent_id"))
    return j.groupBy("id").agg(F.min("parent_id").alias("parent_symbol_id")) \
        .select(F.col("parent_symbol_id").alias("src"), F.col("id").alias("dst"), F.lit("CONTAINS").alias("type"))


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """J-20: callee name → target by priority: (1) same file and parent as the
    caller, (2) same parent class, (3) any same-named callable of the caller's
    repository; lowest id within a tier.  Each tier is first reduced to one
    candidate per key (min id), so every call meets at most one row per tier.

    ``calls``: call_id, caller_id, callee_name.  ``symbols``: id, name, kind,
    parent_name, file_id, repository."""
    callable_ = symbols.where(F.col("kind").isin("METHOD", "FUNCTION"))
    t1 = callable_.groupBy("file_id", "parent_name", "name").agg(F.min("id").alias("t1"))
    t2 = callable_.where(F.col("parent_name").isNotNull()).groupBy("parent_name", "name").agg(F.min("id").alias("t2"))
    t3 = callable_.groupBy("repository", "name").agg(F.min("id").alias("t3"))
    caller = symbols.select(F.col("id").alias("caller_id"), "file_id", "parent_name", "repository")
    c = calls.join(caller, "caller_id").withColumnRenamed("callee_name", "name")
    j = (c.join(t1, ["file_id", "parent_name", "name"], "left")
         .join(t2, ["parent_name", "name"], "left")
         .join(t3, ["repository", "name"], "left"))
    target = F.coalesce("t1", "t2", "t3")
    tier = F.when(F.col("t1").isNotNull(), 1).when(F.col("t2").isNotNull(), 2).when(F.col("t3").isNotNull(), 3)
    return j.where(target.isNotNull()).select("call_id", "caller_id", target.alias("target_id"), tier.alias("tier"))


def receiver_types(calls: DataFrame, declarations: DataFrame) -> DataFrame:
    """(call_id, type_name): the type of each call's receiver by the latest declaration of that name before the call
    whose scope holds it (an as-of join within the file; of equal lines the inner scope).

    ``calls``: call_id, file_id, receiver, line.  ``declarations``: file_id, name, type_name, line, scope_start,
    scope_end."""
    d = declarations.select(F.col("file_id").alias("_file"), F.col("name").alias("_name"), "type_name",
                            F.col("line").alias("_line"), "scope_start", "scope_end")
    inside = (F.col("scope_start") <= F.col("line")) & (F.col("line") <= F.col("scope_end")) & (F.col("_line") <= F.col("line"))
    return (calls.join(d, (F.col("file_id") == F.col("_file")) & (F.col("receiver") == F.col("_name")) & inside)
            .groupBy("call_id").agg(F.max(F.struct("_line", "scope_start", "type_name")).alias("b"))
            .select("call_id", F.col("b.type_name").alias("type_name")))


def resolve_receiver_calls(calls: DataFrame, symbols: DataFrame, declarations: DataFrame, imports: DataFrame) -> DataFrame:
    """J-20 with receivers and imports, in the order: (1) a call without receiver, or on ``this`` / ``base``: a callable
    of the caller's file and parent; (2) a method of the caller's own class; (3) a method of the class that types the
    receiver (its declared type, else its name): classes whose FQN is that name, alone or after an imported namespace;
    where there are none, classes of that simple name; (4) any callable of the name in the repository.  Lowest id
    within a tier; each tier is reduced to one candidate per key before it is joined.

    ``calls``: call_id, caller_id, callee_name, receiver, line.  ``symbols``: id, name, kind, fqn, parent_name, file_id,
    repository.  ``declarations``: see :func:`receiver_types`.  ``imports``: file_id, module."""
    callable_ = symbols.where(F.col("kind").isin("METHOD", "FUNCTION"))
    methods = symbols.where(F.col("kind") == "METHOD").groupBy(F.col("parent_name").alias("class_fqn"), "name").agg(F.min("id").alias("m"))
    t1 = callable_.groupBy("file_id", "parent_name", "name").agg(F.min("id").alias("t1"))
    classes = symbols.where(F.col("kind").isin("CLASS", "INTERFACE")).select(
        "repository", "kind", F.col("name").alias("class_name"), F.col("fqn").alias("class_fqn"))
    own = (classes.where(F.col("kind") == "CLASS").select("repository", "class_fqn").distinct().join(methods, "class_fqn")
           .select("repository", F.col("class_fqn").alias("parent_name"), "name", F.col("m").alias("t2")))
    by_fqn = classes.select("repository", "class_fqn").distinct()
    in_fqn = by_fqn.join(methods, "class_fqn").select("repository", "class_fqn", "name", F.col("m").alias("t3"))
    by_name = (classes.select("repository", "class_name", "class_fqn").distinct().join(methods, "class_fqn")
               .groupBy("repository", "class_name", "name").agg(F.min("m").alias("t3n")))
    t4 = callable_.groupBy("repository", "name").agg(F.min("id").alias("t4"))

    caller = symbols.select(F.col("id").alias("caller_id"), "file_id", "parent_name", "repository")
    c = calls.join(caller, "caller_id").withColumnRenamed("callee_name", "name")
    self_call = F.col("receiver").isNull() | F.col("receiver").isin("", "this", "base")
    c = (c.join(receiver_types(c, declarations), "call_id", "left")
         .withColumns({"self_call": self_call, "class_name": F.when(~self_call, F.coalesce("type_name", "receiver"))}))
    named = c.where("class_name is not null").select("call_id", "file_id", "repository", "name", "class_name")
    spaces = named.join(imports.select("file_id", "module").distinct(), "file_id")
    fqns = (named.select("call_id", "repository", "name", F.col("class_name").alias("class_fqn"))
            .unionByName(spaces.select("call_id", "repository", "name", F.concat("module", F.lit("."), "class_name").alias("class_fqn")))
            .join(by_fqn, ["repository", "class_fqn"]))
    exact = (fqns.join(in_fqn, ["repository", "class_fqn", "name"], "left").groupBy("call_id").agg(F.min("t3").alias("t3"))
             .withColumn("known", F.lit(True)))
    j = (c.join(t1, ["file_id", "parent_name", "name"], "left").join(own, ["repository", "parent_name", "name"], "left")
         .join(exact, "call_id", "left").join(by_name, ["repository", "class_name", "name"], "left")
         .join(t4, ["repository", "name"], "left"))
    tiers = [F.when(F.col("self_call"), F.col("t1")), F.col("t2"), F.when(F.col("known"), F.col("t3")).otherwise(F.col("t3n")), F.col("t4")]
    tier = F.coalesce(*(F.when(t.isNotNull(), i + 1) for i, t in enumerate(tiers)))
    return (j.where(tier.isNotNull()).select("call_id", "caller_id", F.coalesce(*tiers).alias("target_id"), tier.alias("tier"),
                                            "type_name"))


# Candidate suffixes tried for an import specifier, in preference order (J-22).
IMPORT_SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".md", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """J-22: relative (``./``, ``../``) and alias (``@/``) specifiers → candidate
    paths (suffix list, ``index.*``) with a preference rank → the existing file
    of best rank.  ``imports``: import_id, file_path, spec."""
    aliases = aliases or {"@/": "src/"}
    spec = F.col("spec")
    base_dir = F.regexp_extract(F.col("file_path"), r"^(.*)/[^/]*$", 1)
    resolved = F.when(spec.startswith("./") | spec.startswith("../"), F.concat_ws("/", base_dir, spec))
    for prefix, target in aliases.items():
        resolved = resolved.when(spec.startswith(prefix), F.concat(F.lit(target), F.expr(f"substring(spec, {len(prefix) + 1})")))
    resolved = resolved.otherwise(spec)
    segs = F.filter(F.split(resolved, "/"), lambda s: (s != "") & (s != "."))
    norm = F.array_join(F.aggregate(segs, F.array().cast("array<string>"),
                                    lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                                    .otherwise(F.concat(acc, F.array(s)))), "/")
    cand = (imports.select("import_id", norm.alias("base"))
            .select("import_id", F.posexplode(F.array(*[F.concat(F.col("base"), F.lit(s)) for s in IMPORT_SUFFIXES]))
                    .alias("rank", "path")))
    hit = cand.join(files.select(F.col("id").alias("file_id"), "path"), "path")
    best = hit.groupBy("import_id").agg(F.min_by("file_id", "rank").alias("file_id"), F.min("rank").alias("rank"))
    return imports.select("import_id").join(best, "import_id", "left")


def apply_aliases(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """J-22: ``imports`` with the longest alias that starts their specifier (at a ``/`` or as a whole) replaced by its
    target; package paths with dots become paths.  ``aliases``: prefix, target; relative specifiers stay.

    Every specifier meets the alias table through its own prefixes, an equi-join however many aliases there are."""
    spec = F.col("spec")
    segs = F.split(spec, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(segs)), lambda k: F.array_join(F.slice(segs, 1, k), "/"))
    keyed = imports.where(~spec.startswith(".")).select("import_id", "spec", F.explode(prefixes).alias("prefix"))
    best = (keyed.join(aliases.groupBy("prefix").agg(F.min("target").alias("target")), "prefix").groupBy("import_id")
            .agg(F.max_by(F.struct("prefix", "target"), F.length("prefix")).alias("b")))
    out = imports.join(best, "import_id", "left")
    aliased = F.concat(F.col("b.target"), F.expr("substring(spec, length(b.prefix) + 1)"))
    dotted = ~spec.startswith(".") & ~spec.contains("/") & spec.rlike(r"^\w+(\.\w+)+$")
    return out.withColumn("spec", F.when(F.col("b").isNotNull(), aliased)
                          .when(dotted, F.translate(spec, ".", "/")).otherwise(spec)).drop("b")


def named_import_edges(named: DataFrame, symbols: DataFrame, reexports: DataFrame) -> DataFrame:
    """J-22: named imports → symbols: the imported file's own symbol of that name, else the one that its re-exports
    lead to (``export {name} from`` or ``export * from``), to a fix-point; of several at the least distance the lowest id.
    Distinct (file, name) questions are followed, not imports; a file is asked once per question, so cycles end.

    ``named``: import_id, file_id (the imported file), name.  ``reexports``: file_id, from_file_id, name (null: all).
    Returns (import_id, symbol_id, hops)."""
    ensure_checkpoint_dir(named.sparkSession)
    own = symbols.groupBy("file_id", "name").agg(F.min("id").alias("symbol_id"))
    links = reexports.select(F.col("file_id").alias("at"), "from_file_id", F.col("name").alias("only")).distinct()
    asked = named.select("file_id", "name").distinct().withColumn("at", F.col("file_id")).checkpoint(eager=True)
    seen, found, hops = asked, [], 0
    while True:
        here = asked.join(own.withColumnRenamed("file_id", "at"), ["at", "name"], "left")
        level = (here.where("symbol_id is not null").groupBy("file_id", "name").agg(F.min("symbol_id").alias("symbol_id"))
                 .withColumn("hops", F.lit(hops)).checkpoint(eager=True))
        found.append(level)
        left = asked.join(level, ["file_id", "name"], "left_anti")
        nxt = (left.join(links, "at").where(F.col("only").isNull() | (F.col("only") == F.col("name")))
               .select("file_id", "name", F.col("from_file_id").alias("at")).distinct()
               .join(seen, ["file_id", "name", "at"], "left_anti").checkpoint(eager=True))
        if nxt.isEmpty():
            break
        seen, asked, hops = seen.unionByName(nxt), nxt, hops + 1
    answers = reduce(DataFrame.unionByName, found)
    return named.join(answers, ["file_id", "name"]).select("import_id", "symbol_id", "hops")


def link_symbols_to_service(symbols: DataFrame, file_projects: DataFrame, project_services: DataFrame) -> DataFrame:
    """J-34: a symbol's service is its file's project's service."""
    fp = file_projects.select(F.col("id").alias("file_id"), "project_id")
    return (symbols.join(fp, "file_id", "left").join(project_services, "project_id", "left")
            .select("id", "service_id"))


def resolve_usages(usages: DataFrame, symbols: DataFrame) -> DataFrame:
    """J-21: member usage → target by priority: (1) a member of that name in
    the user's own class, (2) in the receiver's type, (3) a static
    ``Type.member`` reference matched by FQN; lowest id within a tier.  Tiers
    are reduced to one candidate per key before joining.

    ``usages``: usage_id, user_id, member_name, receiver_type (nullable),
    qualified (nullable ``Type.member``)."""
    mem = symbols.where(F.col("parent_name").isNotNull())
    t1 = mem.groupBy("parent_name", "name").agg(F.min("id").alias("t1"))
    t3 = symbols.where(F.col("fqn").isNotNull()).groupBy("fqn").agg(F.min("id").alias("t3"))
    user = symbols.select(F.col("id").alias("user_id"), F.col("parent_name").alias("own_class"))
    u = usages.join(user, "user_id", "left")
    j = (u.join(t1.withColumnRenamed("parent_name", "own_class").withColumnRenamed("name", "member_name"),
                ["own_class", "member_name"], "left")
         .join(t1.withColumnRenamed("parent_name", "receiver_type").withColumnRenamed("name", "member_name")
               .withColumnRenamed("t1", "t2"), ["receiver_type", "member_name"], "left")
         .join(t3.withColumnRenamed("fqn", "qualified"), "qualified", "left"))
    target = F.coalesce("t1", "t2", "t3")
    tier = F.when(F.col("t1").isNotNull(), 1).when(F.col("t2").isNotNull(), 2).when(F.col("t3").isNotNull(), 3)
    return j.where(target.isNotNull()).select("usage_id", "user_id", target.alias("target_id"), tier.alias("tier"))


def all_suffixes(s):
    """Every suffix of ``s`` (O(L) per value)."""
    n = F.length(s)
    return F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(s, i, 1 << 20))


def match_existing_project(new: DataFrame, existing: DataFrame) -> DataFrame:
    """A-21: each parsed project → the stored project it updates: (1) same
    repository and file path, (2) same GUID, (3) same name with one path a
    suffix of the other, (4) a same-named stored project without a path;
    lowest tier, then lowest id.  The suffix test is an equi-join on exploded
    suffixes (both directions), so no (name)-group pairs are enumerated."""
    ex = existing.select(F.col("id").alias("eid"), F.col("repository_id").alias("rid"), F.col("file_path").alias("epath"),
                         F.col("project_guid").alias("eguid"), F.col("name").alias("ename"))
    nw = new.select(F.col("id").alias("nid"), F.col("repository_id").alias("rid"), F.col("file_path").alias("npath"),
                    F.col("project_guid").alias("nguid"), F.col("name").alias("nname"))
    t1 = nw.join(ex, (nw["rid"] == ex["rid"]) & (F.col("npath") == F.col("epath"))).select("nid", "eid", F.lit(1).alias("tier"))
    t2 = (nw.where(F.trim(F.coalesce("nguid", F.lit(""))) != "")
          .join(ex, (nw["rid"] == ex["rid"]) & (F.col("nguid") == F.col("eguid"))).select("nid", "eid", F.lit(2).alias("tier")))
    ex_suf = ex.where(F.col("epath") != "").select("eid", "rid", "ename", F.explode(all_suffixes(F.col("epath"))).alias("suf"))
    nw_suf = nw.where(F.col("npath") != "").select("nid", "rid", "nname", F.explode(all_suffixes(F.col("npath"))).alias("suf"))
    t3a = (nw.join(ex_suf, (nw["rid"] == ex_suf["rid"]) & (F.col("nname") == F.col("ename")) & (F.col("npath") == F.col("suf")))
           .select("nid", "eid"))
    t3b = (nw_suf.join(ex, (nw_suf["rid"] == ex["rid"]) & (F.col("nname") == F.col("ename")) & (F.col("epath") == F.col("suf")))
           .select("nid", "eid"))
    t3 = t3a.unionByName(t3b).withColumn("tier", F.lit(3))
    t4 = (nw.join(ex.where(F.coalesce(F.col("epath"), F.lit("")) == ""),
                  (nw["rid"] == ex["rid"]) & (F.col("nname") == F.col("ename"))).select("nid", "eid", F.lit(4).alias("tier")))
    m = t1.unionByName(t2).unionByName(t3).unionByName(t4)
    best = m.groupBy("nid").agg(F.min(F.struct("tier", "eid")).alias("b"))
    return (new.select(F.col("id").alias("nid")).join(best, "nid", "left")
            .select(F.col("nid").alias("id"), F.col("b.eid").alias("existing_id"), F.col("b.tier").alias("tier")))


STRUCTURED_DOCS_SCHEMA = ("struct<references: array<struct<type: string, name: string, line: int>>, "
                          "lambdas: array<struct<name: string, fully_qualified_name: string, start_line: int, "
                          "end_line: int, signature: string, closure_variables: array<string>, linq_pattern: string>>>")


def uses_edges(documented: DataFrame, symbols: DataFrame, docs_col: str = "structured_docs") -> DataFrame:
    """J-25: each documented symbol's ``di_registration`` references (from its
    structured docs JSON) → USES edges to the types they resolve to among
    ``symbols`` (generic arguments cut), no self edges, one per target."""
    refs = (documented.select(F.col("id").alias("src"),
                           F.explode(F.from_json(F.col(docs_col), STRUCTURED_DOCS_SCHEMA)["references"]).alias("r"))
            .where((F.col("r.type") == "di_registration") & F.col("r.name").isNotNull())
            .select("src", F.trim(F.substring_index(F.col("r.name"), "<", 1)).alias("type_name")).distinct())
    res = resolve_types(refs, symbols)
    return (res.where(F.col("src") != F.col("symbol_id"))
            .select("src", F.col("symbol_id").alias("dst"), F.lit("USES").alias("type")).distinct())


def lambda_symbols(symbols: DataFrame, docs_col: str = "structured_docs") -> DataFrame:
    """E-16: lambdas recorded in a symbol's structured docs become METHOD
    child symbols (``is_lambda``), with their closure variables and LINQ pattern."""
    lam = symbols.select(F.col("id").alias("parent_id"),
                         F.explode(F.from_json(F.col(docs_col), STRUCTURED_DOCS_SCHEMA)["lambdas"]).alias("l"))
    return lam.select("parent_id", F.col("l.name").alias("name"), F.col("l.fully_qualified_name").alias("fqn"),
                      F.lit("METHOD").alias("kind"), F.col("l.start_line").alias("start_line"),
                      F.col("l.end_line").alias("end_line"), F.col("l.signature").alias("signature"),
                      F.lit(True).alias("is_lambda"),
                      F.array_join(F.coalesce(F.col("l.closure_variables"), F.array().cast("array<string>")), ",")
                      .alias("closure_variables"), F.col("l.linq_pattern").alias("linq_pattern"))


PROJECT_REFERENCE = r"<ProjectReference\s+Include=\"([^\"]+)\""


def project_references(projects: DataFrame, xml_col: str = "project_xml") -> DataFrame:
    """E-18: ``<ProjectReference Include="..\\X\\X.csproj"/>`` → project-to-project
    edges: the include is normalized against the referencing project's
    directory (X-25) and resolved to a project id by path (null when unknown)."""
    from meshlens.functions.code import normalize_project_path
    refs = projects.select(F.col("id").alias("source_id"), F.col("project_path").alias("source_path"),
                           F.explode(F.regexp_extract_all(F.col(xml_col), F.lit(PROJECT_REFERENCE), 1)).alias("include"))
    base = F.regexp_extract(F.regexp_replace("source_path", r"\\", "/"), r"^(.*)/[^/]*$", 1)
    refs = refs.withColumn("target_path", normalize_project_path(F.col("include"), base))
    known = projects.select(F.col("id").alias("target_id"), F.regexp_replace("project_path", r"\\", "/").alias("target_path"))
    return (refs.join(known, "target_path", "left")
            .select("source_id", "source_path", "target_path", "target_id",
                    F.lit("ProjectReference").alias("reference_type")))


# Request interfaces whose implementers get a ``<Name>Handler`` (G-05).
REQUEST_INTERFACES = ("IRequest", "ICommand", "IQuery")


def request_handlers(classes: DataFrame) -> DataFrame:
    """G-05: classes implementing IRequest / ICommand / IQuery → the class named
    ``<Name>Handler`` (derived HANDLED_BY edges).  ``classes``: id, name, bases
    (array of base type names)."""
    base_names = F.transform(F.col("bases"), lambda b: F.trim(F.substring_index(b, "<", 1)))
    is_req = F.exists(base_names, lambda b: b.isin(list(REQUEST_INTERFACES)))
    req = classes.where(is_req).select(F.col("id").alias("src"), F.concat(F.col("name"), F.lit("Handler")).alias("hname"))
    handlers = classes.groupBy(F.col("name").alias("hname")).agg(F.min("id").alias("dst"))
    return req.join(handlers, "hname").select("src", "dst", F.lit("HANDLED_BY").alias("type"))
