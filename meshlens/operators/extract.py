"""Extraction jobs over text tables.

Each job is a ``select`` + ``explode`` over the text column, row-local but for
E-17, E-19 and E-01, which number lines first; calls and events are in ``calls``.  Rule lists are applied as one array-building expression per row (one
``regexp_extract_all`` per rule, concatenated, exploded once) — never as a
join of rules × files.  Line numbers come from splitting on ``\\n`` first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rule_needle(rx: str) -> str:
    """A literal every match of ``rx`` must contain (its longest required
    literal run), used as a cheap ``instr`` pre-check; ``''`` when none can be
    proven.  Literals inside optional groups (``(…)?``, ``(…)*``) or inside
    alternations are not required and are ignored."""
    stack = [[[], False]]               # per group: [required runs, has alternation]
    cur, i = "", 0

    def flush():
        nonlocal cur
        stack[-1][0].append(cur)
        cur = ""

    while i < len(rx):
        c = rx[i]
        if c == "\\" and i + 1 < len(rx):
            if rx[i + 1].isalnum():     # class escape (\s, \d, \b, …)
                flush()
            else:
                cur += rx[i + 1]
            i += 2
            continue
        if c == "[":                    # character class
            flush()
            j = i + 1
            while j < len(rx) and rx[j] != "]":
                j += 2 if rx[j] == "\\" else 1
            i = j + 1
            continue
        if c in "?*{":                  # previous char optional / repeated
            cur = cur[:-1]
            flush()
        elif c == "+" or c in "^$.":
            flush()
        elif c == "(":
            flush()
            stack.append([[], False])
            if rx[i + 1:i + 3] == "?:":
                i += 2
        elif c == ")":
            flush()
            runs, alt = stack.pop()
            optional = i + 1 < len(rx) and rx[i + 1] in "?*"
            if not optional and not alt:
                stack[-1][0].extend(runs)
        elif c == "|":
            flush()
            stack[-1][1] = True
        else:
            cur += c
        i += 1
    flush()
    runs, alt = stack[0]
    if alt:
        return ""
    return max(runs, key=len) if any(runs) else ""


def numbered_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no 1-based, line) for every line of every text."""
    return df.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line")) \
        .select(id_col, (F.col("pos") + 1).alias("line_no"), "line")


# Import rules (E-05): ES named, ES default, C# using.
IMPORT_NAMED = r"import\s*\{([^}]*)\}\s*from\s*['\"]([^'\"]+)['\"]"
IMPORT_DEFAULT = r"import\s+(\w+)\s+from\s*['\"]([^'\"]+)['\"]"
USING_NS = r"(?m)^\s*using\s+([\w.]+)\s*;"


def extract_imports(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """E-05: (file, module, imported name, kind)."""
    t = F.col(text_col)
    named = files.select(id_col, F.explode(F.arrays_zip(F.regexp_extract_all(t, F.lit(IMPORT_NAMED), 2).alias("m"),
                                                       F.regexp_extract_all(t, F.lit(IMPORT_NAMED), 1).alias("n")))
                         .alias("z"))
    named = named.select(id_col, F.col("z.m").alias("module"),
                         F.explode(F.split(F.col("z.n"), ",")).alias("name")) \
        .select(id_col, "module", F.trim("name").alias("name"), F.lit("named").alias("kind")) \
        .where(F.col("name") != "")
    default = files.select(id_col, F.explode(F.arrays_zip(
        F.regexp_extract_all(t, F.lit(IMPORT_DEFAULT), 2).alias("m"),
        F.regexp_extract_all(t, F.lit(IMPORT_DEFAULT), 1).alias("n"))).alias("z")) \
        .select(id_col, F.col("z.m").alias("module"), F.col("z.n").alias("name"), F.lit("default").alias("kind"))
    using = files.select(id_col, F.explode(F.regexp_extract_all(t, F.lit(USING_NS), 1)).alias("module")) \
        .select(id_col, "module", F.lit(None).cast("string").alias("name"), F.lit("using").alias("kind"))
    return named.unionByName(default).unionByName(using)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


# Fixed value: a heading line.
HEADING_RE = r"^(#{1,6})\s+(.+)$"


def _numbered_spans(lines: Column, starts: Column, ends: Column, body: Column) -> Column:
    """Structs (start, end, first line, text between) from aligned arrays of 0-based line positions."""
    return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.struct(
        x["a"].alias("a"), x["b"].alias("b"), F.element_at(lines, x["a"] + 1).alias("head"),
        F.array_join(F.slice(body, x["a"] + 2, F.greatest(x["b"] - x["a"] - 1, F.lit(0))), "\n").alias("text")))


def _once(df: DataFrame, name: str, value: Column, *keep: str) -> DataFrame:
    """``df`` with ``value`` as a column that is computed once per row, however often it is used and however dear it is
    (a projection would be copied into every use)."""
    return df.select(*keep, F.explode(F.array(value)).alias(name))


# where a line starts whose first character but white space is "#"
_BEFORE_HEADING = r"(?md)^(?=[^\S\n]*#)"


def doc_sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """E-08: Markdown headings with level, title, line span and the whole text of
    their section (until the next line starting ``#``).

    Row-local and linear: one split before every ``#`` line gives the sections, one
    pass over the lines their numbers; no line crosses a shuffle."""
    d = _once(docs, "_t", F.col(text_col), id_col).where(F.col("_t").contains("#"))
    lines = F.split("_t", "\n")
    marks = F.filter(F.transform(lines, lambda line, i: F.when(line.rlike(r"^\s*#"), i + 1)), lambda i: i.isNotNull())
    d = _once(d, "_x", F.struct(F.size(lines).alias("_n"), marks.alias("_m"), F.split("_t", _BEFORE_HEADING).alias("_p")), id_col)
    d = d.select(id_col, "_x.*").where(F.size("_m") > 0)
    ends = F.concat(F.transform(F.slice("_m", 2, F.size("_m")), lambda i: i - 1), F.array("_n"))
    pieces = F.slice("_p", F.size("_p") - F.size("_m") + 1, F.size("_m"))  # without the text before the first heading
    ex = d.select(id_col, "_n", F.explode(F.arrays_zip(F.col("_m").alias("start"), ends.alias("end"), pieces.alias("piece"))).alias("x"))
    head = _strip(F.substring_index("x.piece", "\n", 1))
    rest = F.expr("CASE WHEN instr(x.piece, '\n') > 0 THEN substring(x.piece, instr(x.piece, '\n') + 1) ELSE '' END")
    # the line break before the next heading belongs to neither
    content = F.when((F.col("x.end") < F.col("_n")) & rest.endswith("\n"), F.expr("left(_r, length(_r) - 1)")).otherwise(F.col("_r"))
    return (ex.withColumns({"_h": head, "_r": rest}).where(F.col("_h").rlike(HEADING_RE))
            .select(id_col, F.col("x.start").alias("start_line"), F.length(F.regexp_extract("_h", HEADING_RE, 1)).alias("level"),
                    F.trim(F.regexp_extract("_h", HEADING_RE, 2)).alias("title"), F.col("x.end").alias("end_line"),
                    content.alias("content")))


def code_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """E-09: fenced blocks: opening/closing line, language hint, line count and
    the whole code.  Row-local: fences alternate between opening and closing;
    an unclosed last block and blocks without a line are dropped (as in the
    reference)."""
    d = _once(docs, "_t", F.col(text_col), id_col).where(F.col("_t").contains("```"))
    d = _once(d, "_l", F.split("_t", "\n"), id_col)
    d = _once(d, "_s", F.transform("_l", _strip), id_col, "_l")
    fences = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: F.element_at("_s", i + 1).startswith("```"))
    d = _once(d, "_f", fences, id_col, "_l", "_s")
    pairs = F.sequence(F.lit(0), F.floor(F.size("_f") / 2).cast("int") - 1)
    d = d.where(F.size("_f") > 1).withColumns({
        "_a": F.transform(pairs, lambda k: F.element_at("_f", 2 * k + 1)),
        "_b": F.transform(pairs, lambda k: F.element_at("_f", 2 * k + 2))})
    ex = d.select(id_col, F.explode(_numbered_spans(F.col("_s"), F.col("_a"), F.col("_b"), F.col("_l"))).alias("x"))
    language = F.coalesce(F.nullif(F.regexp_extract("x.head", r"^```(\w+)", 1), F.lit("")), F.lit("unknown"))
    return (ex.where(F.col("x.b") > F.col("x.a") + 1)
            .select(id_col, (F.col("x.a") + 1).alias("start_line"), (F.col("x.b") + 1).alias("end_line"),
                    language.alias("language"), (F.col("x.b") - F.col("x.a") - 1).cast("long").alias("line_count"),
                    F.col("x.text").alias("code")))


# Inline and reference links.
LINK_INLINE = r"\[([^\]]+)\]\(([^\)]+)\)"
LINK_REF = r"\[([^\]]+)\]\[([^\]]+)\]"


def extract_links(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """E-10: targets of ``[t](u)`` and ``[t][r]`` links."""
    t = F.col(text_col)
    inline = docs.select(id_col, F.explode(F.regexp_extract_all(t, F.lit(LINK_INLINE), 2)).alias("target")) \
        .withColumn("kind", F.lit("inline"))
    ref = docs.select(id_col, F.explode(F.regexp_extract_all(t, F.lit(LINK_REF), 2)).alias("target")) \
        .withColumn("kind", F.lit("reference"))
    return inline.unionByName(ref)


# --------------------------------------------------------------------------- secrets (DQ-03 / DQ-04)

# Secret rules (DQ-03), applied case-insensitively, in order.
SECRET_PATTERNS = (
    (r"password\s*=\s*[\"']([^\"']+)[\"']", "password"),
    (r"api[_-]?key\s*=\s*[\"']([^\"']+)[\"']", "api_key"),
    (r"secret\s*=\s*[\"']([^\"']+)[\"']", "secret"),
    (r"token\s*=\s*[\"']([^\"']+)[\"']", "token"),
    (r"[\"']sk_live_[a-zA-Z0-9]{24,}[\"']", "stripe_key"),
    (r"[\"']pk_live_[a-zA-Z0-9]{24,}[\"']", "stripe_key"),
    (r"-----BEGIN PRIVATE KEY-----", "private_key"),
    (r"-----BEGIN RSA PRIVATE KEY-----", "rsa_key"),
)


def _match_spans(text: Column, rx: str) -> Column:
    """Array<struct<start, end>> (0-based, end exclusive) of all non-overlapping
    matches: the pieces between matches (``split``) and the matches themselves
    (``regexp_extract_all``) interleave, so prefix sums give the offsets."""
    pieces = F.split(text, rx)
    hits = F.regexp_extract_all(text, F.lit(rx), 0)

    def start(k):
        before = F.aggregate(F.slice(pieces, 1, k + 1), F.lit(0), lambda a, x: a + F.length(x))
        prev = F.aggregate(F.slice(hits, 1, k), F.lit(0), lambda a, x: a + F.length(x))
        return before + prev

    idx = F.sequence(F.lit(0), F.size(hits) - 1)
    return F.when(F.size(hits) > 0, F.transform(idx, lambda k: F.struct(
        start(k).alias("start"), (start(k) + F.length(F.element_at(hits, k + 1))).alias("end")))) \
        .otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def scan_secrets(docs: DataFrame, id_col: str, text_col: str, context: int = 20) -> DataFrame:
    """DQ-03: one row per secret match: type, span, ±``context`` characters."""
    t = F.col(text_col)
    # one case-insensitive alternation pass (measured faster than lower() + literal checks
    # on multilingual text); only matching texts get the per-rule span extraction
    d = docs.where(t.rlike("(?i)" + "|".join(f"(?:{rx})" for rx, _ in SECRET_PATTERNS)))
    def tag(typ):
        return lambda s: F.struct(F.lit(typ).alias("type"), s["start"].alias("start"), s["end"].alias("end"))

    per_rule = [F.transform(_match_spans(t, "(?i)" + rx), tag(typ)) for rx, typ in SECRET_PATTERNS]
    ex = d.select(id_col, t.alias("_t"), F.explode(F.concat(*per_rule)).alias("h"))
    st, en = F.col("h.start"), F.col("h.end")
    lo = F.greatest(st - context, F.lit(0))
    hi = F.least(en + context, F.length("_t"))
    return ex.select(id_col, F.col("h.type").alias("type"), st.alias("start"), en.alias("end"),
                     F.substring("_t", lo + 1, hi - lo).alias("context"))


def redact_secrets(text: Column) -> Column:
    """DQ-04: every rule's matches replaced by ``[REDACTED_TYPE]``, in rule order."""
    out = text
    for rx, typ in SECRET_PATTERNS:
        out = F.regexp_replace(out, "(?i)" + rx, f"[REDACTED_{typ.upper()}]")
    return out


# Dangerous input patterns (DQ-05 / DQ-06), case-insensitive.
DANGEROUS_PATTERNS = (r";\s*DROP\s+TABLE", r"<script", r"javascript:", r"\.\./\.\.", r"\\\\", r"eval\s*\(",
                      r"exec\s*\(", r"__import__")


def sanitize_text(text: Column, max_length: int | None = None) -> Column:
    """DQ-06: drop NUL, delete dangerous patterns (of the first ``max_length`` characters when asked for)."""
    out = F.regexp_replace(text if max_length is None else F.substring(text, 1, max_length), "\u0000", "")
    for rx in DANGEROUS_PATTERNS:
        out = F.regexp_replace(out, "(?i)" + rx, "")
    return out


# --------------------------------------------------------------------------- chunking (V-06 / V-07)

def chunk_words(docs: DataFrame, id_col: str, text_col: str, size: int = 512, overlap: int = 50) -> DataFrame:
    """V-06: overlapping word windows (step ``size - overlap``); a text of at
    most ``size`` words stays one chunk with its original text."""
    words = F.filter(F.split(F.col(text_col), r"\s+"), lambda w: w != "")
    n = F.size(words)
    step = size - overlap
    d = docs.select(id_col, F.col(text_col).alias("_t"), words.alias("_w"), n.alias("_n"))
    single = d.where(F.col("_n") <= size).select(id_col, F.lit(0).alias("chunk_no"), F.col("_t").alias("chunk"),
                                                 F.col("_n").alias("n_words"))
    multi = (d.where(F.col("_n") > size)
             .select(id_col, "_w", "_n", F.posexplode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(step)))
                     .alias("chunk_no", "start"))
             .select(id_col, "chunk_no",
                     F.array_join(F.slice("_w", F.col("start") + 1, F.lit(size)), " ").alias("chunk"),
                     F.least(F.lit(size), F.col("_n") - F.col("start")).alias("n_words")))
    return single.unionByName(multi)


def chunk_lines(docs: DataFrame, id_col: str, text_col: str, size: int = 50) -> DataFrame:
    """V-07: fixed blocks of ``size`` lines."""
    lines = F.split(F.col(text_col), "\n")
    d = docs.select(id_col, lines.alias("_l"))
    return (d.select(id_col, "_l", F.posexplode(F.sequence(F.lit(0), F.size("_l") - 1, F.lit(size)))
                     .alias("chunk_no", "start"))
            .select(id_col, "chunk_no", (F.col("start") + 1).alias("start_line"),
                    F.least(F.col("start") + size, F.size("_l")).alias("end_line"),
                    F.array_join(F.slice("_l", F.col("start") + 1, F.lit(size)), "\n").alias("chunk")))


# --------------------------------------------------------------------------- configuration (E-06)

def extract_config(files: DataFrame, id_col: str, text_col: str, name_col: str) -> DataFrame:
    """E-06: JSON configuration (comments and trailing commas allowed) → one row
    per flattened key with value (``***`` when the key looks secret), type,
    environment (from the file name) and ``is_secret``."""
    from meshlens.functions.code import environment_of, is_secret_key
    from meshlens.functions.jsonflat import flatten_json, strip_json_comments

    cleaned = _once(files.withColumn("environment", environment_of(F.col(name_col))), "_json",
                    strip_json_comments(F.col(text_col)), id_col, "environment")
    secret = is_secret_key(F.col("key"))
    return (flatten_json(cleaned, id_col, "_json", keep=("environment",))
            .select(id_col, F.col("key").alias("config_key"),
                    F.when(secret, F.lit("***")).otherwise(F.col("value")).alias("config_value"),
                    F.col("type").alias("config_type"), "environment", secret.cast("int").alias("is_secret")))


XML_SETTING = r"<add\s+key=\"([^\"]*)\"\s+value=\"([^\"]*)\""
XML_CONNECTION = r"<add\s+name=\"([^\"]*)\"\s+connectionString=\"([^\"]*)\""


def extract_xml_config(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """E-06 (XML): ``appSettings`` / ``connectionStrings`` ``<add …/>`` entries."""
    from meshlens.functions.code import is_secret_key
    t = F.col(text_col)
    app = files.select(id_col, F.explode(F.arrays_zip(F.regexp_extract_all(t, F.lit(XML_SETTING), 1).alias("k"),
                                                     F.regexp_extract_all(t, F.lit(XML_SETTING), 2).alias("v")))
                       .alias("z")).select(id_col, F.col("z.k").alias("config_key"), F.col("z.v").alias("v"))
    con = files.select(id_col, F.explode(F.arrays_zip(F.regexp_extract_all(t, F.lit(XML_CONNECTION), 1).alias("k"),
                                                     F.regexp_extract_all(t, F.lit(XML_CONNECTION), 2).alias("v")))
                       .alias("z")).select(id_col, F.concat(F.lit("ConnectionStrings:"), F.col("z.k")).alias("config_key"),
                                           F.col("z.v").alias("v"))
    allx = app.unionByName(con)
    secret = is_secret_key(F.col("config_key"))
    return allx.select(id_col, "config_key", F.when(secret, F.lit("***")).otherwise(F.col("v")).alias("config_value"),
                       secret.cast("int").alias("is_secret"))


# --------------------------------------------------------------------------- symbols, events, components

# Arrow functions: ``const f = (…) => …``.  Written unrolled — parenthesised
# groups iterate per group, other characters as one class — so the Java engine
# does not recurse per character (the alternation form overflows its stack on
# long minified lines).
ARROW_RULE = r"(?:export\s+)?const\s+(\w+)\s*=\s*[^=(]*(?:\([^)]*\)[^=(]*)*=>"

# Lightweight symbol rules by language (E-01); group 1 is the name.
SYMBOL_RULES = {
    "go": (r"^func\s+(?:\([^)]+\)\s+)?(\w+)\s*\(", r"^type\s+(\w+)\s+(?:struct|interface)\b"),
    "python": (r"^(?:async\s+)?def\s+(\w+)\s*\(", r"^class\s+(\w+)"),
    "javascript": (r"(?:export\s+)?(?:async\s+)?function\s+(\w+)", r"(?:export\s+)?class\s+(\w+)",
                   ARROW_RULE),
    "typescript": (r"(?:export\s+)?(?:async\s+)?function\s+(\w+)", r"(?:export\s+)?class\s+(\w+)",
                   r"(?:export\s+)?interface\s+(\w+)", r"(?:export\s+)?type\s+(\w+)\s*=",
                   ARROW_RULE),
    "csharp": (r"\b(?:public|private|protected|internal)\s+(?:static\s+)?(?:async\s+)?[\w<>\[\],\s]+\s+(\w+)\s*\(",
               r"\b(?:public|private|internal)\s+(?:partial\s+)?class\s+(\w+)",
               r"\b(?:public|private|internal)\s+interface\s+(\w+)"),
    "java": (r"\b(?:public|private|protected)\s+(?:static\s+)?[\w<>\[\],\s]+\s+(\w+)\s*\(",
             r"\b(?:public|private)\s+(?:abstract\s+)?class\s+(\w+)", r"\b(?:public|private)\s+interface\s+(\w+)"),
    "yaml": (r"^(\w[\w-]*):",),
}
# Names never reported as symbols (E-01).
SYMBOL_STOP_NAMES = ("if", "for", "else", "return", "var", "let", "const")


def extract_symbols(files: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """E-01: symbol names by language rules, line by line (``^`` anchors at
    line starts, as with MULTILINE); names longer than one character and not
    keywords; files of any size.  Every name is kept (long form); the
    reference's 50-name display cap is a presentation limit."""
    lines = files.select(id_col, lang_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
    arrays = []
    for lang, rules in SYMBOL_RULES.items():
        for i, rx in enumerate(rules):
            hits = F.regexp_extract_all(F.col("line"), F.lit(rx), 1)
            tagged = F.transform(hits, _rule_tag(i))
            arrays.append(F.when(F.col(lang_col) == lang, tagged))
    allhits = F.flatten(F.filter(F.array(*arrays), lambda a: a.isNotNull()))
    ex = lines.select(id_col, lang_col, (F.col("pos") + 1).alias("line_no"), F.explode(allhits).alias("h"))
    name = F.col("h.name")
    return (ex.where((F.length(name) > 1) & ~name.isin(list(SYMBOL_STOP_NAMES)))
            .select(id_col, lang_col, "line_no", F.col("h.rule_no").alias("rule_no"), name.alias("name")))


def _rule_tag(i: int):
    return lambda h: F.struct(F.lit(i).alias("rule_no"), h.alias("name"))


HOOK_RE = r"\b(use[A-Z]\w*)\s*\(([^()]*)"


def extract_hooks(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """E-19: React hook calls ``use[A-Z]…(`` per line: name, line, up to 3
    argument texts, custom flag (not one of React's own hooks)."""
    react = F.array(*[F.lit(h) for h in REACT_HOOKS])
    lines = numbered_lines(files.where(F.col(text_col).contains("use")), id_col, text_col)
    z = F.arrays_zip(F.regexp_extract_all(F.col("line"), F.lit(HOOK_RE), 1).alias("hook"),
                     F.regexp_extract_all(F.col("line"), F.lit(HOOK_RE), 2).alias("args"))
    ex = lines.select(id_col, "line_no", F.explode(z).alias("h"))
    args = F.slice(F.filter(F.transform(F.split(F.col("h.args"), ","), lambda a: F.trim(a)), lambda a: a != ""), 1, 3)
    return ex.select(id_col, "line_no", F.col("h.hook").alias("hook"), F.array_join(args, "|").alias("arguments"),
                     (~F.array_contains(react, F.col("h.hook"))).alias("is_custom"))


# React's built-in hooks (E-19).
REACT_HOOKS = ("useState", "useEffect", "useContext", "useReducer", "useCallback", "useMemo", "useRef",
               "useLayoutEffect", "useImperativeHandle", "useDebugValue")


# --------------------------------------------------------------------------- E-17 manifest sections

def _category(header: Column) -> Column:
    h = F.lower(header)
    return (F.when(h.contains("capabilities"), "primary_capabilities")
            .when(h.contains("dependencies"), "infrastructure_dependencies")
            .when(h.contains("boundaries") | h.contains("domain"), "domain_boundaries")
            .when(h.contains("workflows"), "key_workflows"))


def manifest_sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """E-17: structured fields of a service manifest (Markdown) in long form
    ``(id, field, item_no, value)``: ``pitch`` (first non-heading line),
    bullet lists under capabilities / dependencies / workflows headings and
    the ``owns`` / ``reads`` data lists of a boundaries section.  When a
    category repeats, its last section wins (as in the reference)."""
    lines = numbered_lines(docs, id_col, text_col).withColumn("s", _strip(F.col("line")))
    w = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("sec", F.sum(F.col("line").startswith("##").cast("int")).over(w))
    pitch = (lines.where((F.col("s") != "") & ~F.col("s").startswith("#")).groupBy(id_col)
             .agg(F.min_by("s", "line_no").alias("value"))
             .select(id_col, F.lit("pitch").alias("field"), F.lit(1).alias("item_no"), "value"))
    heads = (lines.where((F.col("sec") > 0) & F.col("line").startswith("##"))
             .select(id_col, "sec", F.trim(F.regexp_replace("line", r"^##\s*", "")).alias("header"), "line_no"))
    cats = heads.withColumn("field", _category(F.col("header"))).where(F.col("field").isNotNull())
    last = cats.groupBy(id_col, "field").agg(F.max("sec").alias("sec"))
    body = (lines.join(heads.select(id_col, "sec", F.col("line_no").alias("head_line")), [id_col, "sec"])
            .where((F.col("line_no") > F.col("head_line")) & (F.col("s") != "")))
    sec_lines = body.join(last, [id_col, "sec"])
    bullets = (sec_lines.where((F.col("field") != "domain_boundaries")
                               & (F.col("s").startswith("-") | F.col("s").startswith("*")))
               .select(id_col, "field", "line_no", F.trim(F.regexp_replace("s", r"^[-* ]+", "")).alias("value")))
    wb = Window.partitionBy(id_col, "field").orderBy("line_no")
    bullets = bullets.select(id_col, "field", F.row_number().over(wb).alias("item_no"), "value")
    bnd = sec_lines.where(F.col("field") == "domain_boundaries")
    low = F.lower("s")
    kind = F.when(low.contains("owns data"), "owns").when(low.contains("reads data"), "reads")
    bnd = bnd.withColumn("kind", kind).where(F.col("kind").isNotNull() & F.col("s").contains(":"))
    last_line = bnd.groupBy(id_col, "kind").agg(F.max_by("s", "line_no").alias("s"))
    items = last_line.select(id_col, F.col("kind").alias("field"),
                             F.posexplode(F.split(F.expr("substring(s, instr(s, ':') + 1)"), ",")).alias("pos", "v"))
    items = items.where(F.trim("v") != "")
    wi = Window.partitionBy(id_col, "field").orderBy("pos")
    items = items.select(id_col, "field", F.row_number().over(wi).alias("item_no"), F.trim("v").alias("value"))
    return pitch.unionByName(bullets).unionByName(items)
