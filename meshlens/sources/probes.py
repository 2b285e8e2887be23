"""Probe views: the reference's entity shapes built from the driver's tables.

The test data holds no source code, so every operator is exercised on a view
that stands for one reference table (SURVEY §1.5).  The DuckDB text of the
same views lives in :mod:`meshlens.plans.oracle_views`; both must stay in step.

All views are plain projections / joins / windows over the parquet scans, so
Catalyst prunes the columns a query does not use and pushes its filters down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshlens.functions.urls import normalize_url
from meshlens.sources.tables import Tables, spread

# Fixed values of the probe definitions.
KIND_BY_MOD3 = ("METHOD", "FUNCTION", "VARIABLE")
ACCESS_BY_MOD4 = ("PUBLIC", "PRIVATE", "PROTECTED", None)
EDGE_TYPE_BY_FLAG = {"A": "CALLS", "N": "USES", "R": "IMPORTS"}
TYPE_ID_BASE = 1_000_000_000_000
HTTP_BY_MOD4 = ("GET", "POST", "PUT", "DELETE")
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
ASCII_UPPER = ASCII_LOWER.upper()


def _pick(idx: F.Column, values) -> F.Column:
    expr = None
    for i, v in enumerate(values):
        lit = F.lit(v) if v is not None else F.lit(None).cast("string")
        expr = F.when(idx == i, lit) if expr is None else expr.when(idx == i, lit)
    return expr


def v_files(t: Tables) -> DataFrame:
    """``files`` + ``chunks``: one row per document."""
    d = t.documents
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("repository"),
        F.col("lang").alias("language"),
        F.col("n_chars").alias("size_bytes"),
        F.col("text").alias("content"),
        F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/d"),
                 (F.col("doc_id") % 7).cast("string"), F.lit("/"),
                 F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.size(F.split(F.col("text"), "\n")).cast("bigint").alias("line_count"),
        F.sha2(F.col("text"), 256).alias("content_hash"),
    )


def _n_docs(t: Tables) -> F.Column:
    # scalar subquery: Spark runs it once and inlines the value
    return t.documents.select(F.count(F.lit(1))).scalar()


def v_symbols(t: Tables) -> DataFrame:
    """``symbols``: member rows from ``part`` plus one type row per brand."""
    p = t.part
    n_docs = _n_docs(t)
    key = F.col("p_partkey")
    members = p.select(
        key.alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("signature"),
        F.concat(F.col("p_brand"), F.lit("."), F.col("p_name")).alias("fqn"),
        F.col("p_brand").alias("parent_name"),
        F.col("p_size").cast("int").alias("complexity"),
        F.col("p_size").cast("int").alias("start_line"),
        (F.col("p_size") + key % 60).cast("int").alias("end_line"),
        _pick(key % 3, KIND_BY_MOD3).alias("kind"),
        _pick(key % 4, ACCESS_BY_MOD4).alias("access"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("documentation"),
        (key % n_docs).cast("bigint").alias("file_id"),
    )
    b = F.substring_index(F.col("p_brand"), "#", -1).cast("int")
    types = (p.select("p_brand").distinct()
             .select(F.col("p_brand"), b.alias("b"))
             .select(
                 (F.lit(TYPE_ID_BASE) + F.col("b")).cast("bigint").alias("id"),
                 F.col("p_brand").alias("name"),
                 F.lit(None).cast("string").alias("signature"),
                 F.col("p_brand").alias("fqn"),
                 F.lit(None).cast("string").alias("parent_name"),
                 F.lit(None).cast("int").alias("complexity"),
                 F.lit(None).cast("int").alias("start_line"),
                 F.lit(None).cast("int").alias("end_line"),
                 F.when(F.col("b") % 5 == 0, F.lit("INTERFACE")).otherwise(F.lit("CLASS")).alias("kind"),
                 F.lit("PUBLIC").alias("access"),
                 F.lit(None).cast("string").alias("documentation"),
                 (F.col("b") % n_docs).cast("bigint").alias("file_id"),
             ))
    return members.unionByName(types)


# Fixed values of the probe definitions: code-like folders, file names and name endings.
TREE_FOLDERS = ("src/Controllers", "src/Services", "src/domain/models", "src/application", "src/infrastructure/repositories",
                "presentation/views", "tests/unit", "node_modules/pkg", "src/Generated", "docs", "lib/utils")
TREE_FILES = ("main.py", "README.md", "package-lock.json", "File.cs", "file.test.ts", "file.vue", "File.designer.cs",
              "appsettings.json")
NAME_ENDINGS = ("Controller", "Service", "Repository", "Dto", "Helper", "", "Handler", "DbContext", "")


def _nth(i: F.Column, values) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))


def v_tree(t: Tables) -> DataFrame:
    """``files`` with code-like paths: sources, tests, generated and vendored folders."""
    i = F.col("id")
    return v_files(t).withColumn("path", F.concat_ws(
        "/", "repository", _nth(i, TREE_FOLDERS), F.concat(F.lit("d"), (i % 13).cast("string")),
        F.concat(i.cast("string"), F.lit("."), _nth(i, TREE_FILES))))


def v_named(t: Tables) -> DataFrame:
    """``symbols`` with code-like names and the path of a code-like file."""
    i = F.col("id")
    ending = _nth(i, NAME_ENDINGS)
    return v_symbols(t).withColumns({
        "name": F.concat(F.replace("name", F.lit(" "), F.lit("_")), ending),
        "fqn": F.concat(F.when(i % 10 == 4, F.lit("System.")).otherwise(F.lit("")), "fqn", ending),
        "path": F.concat(_nth(i, TREE_FOLDERS), F.lit("/s"), i.cast("string"), F.lit("."),
                         _nth(i, TREE_FILES))})


def brand_numbers(t: Tables) -> DataFrame:
    return (t.part.select(F.substring_index("p_brand", "#", -1).cast("int").alias("b"))
            .distinct())


def v_edges(t: Tables) -> DataFrame:
    """``relations``: line items of an order call their successor line.

    An equi-join on ``(orderkey, linenumber + 1)``.  In this data the pair
    (orderkey, linenumber) is *not* unique, so the join (not a ``lead``
    window) is the exact form; its fan-out is bounded by lines per order.
    """
    l = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    a = l.select(F.col("l_orderkey").alias("ok"), (F.col("l_linenumber") + 1).alias("ln"),
                 F.col("l_partkey").alias("src"), F.col("l_returnflag").alias("flag"))
    b = l.select(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"),
                 F.col("l_partkey").alias("dst"))
    etype = (F.when(F.col("flag") == "A", "CALLS").when(F.col("flag") == "N", "USES")
             .when(F.col("flag") == "R", "IMPORTS"))
    item_edges = (a.join(b, ["ok", "ln"], "inner")
                  .where(F.col("src") != F.col("dst"))
                  .select("src", "dst", etype.alias("type"))
                  .distinct())
    brands = brand_numbers(t)
    impl = (brands.where(F.col("b") % 5 != 0)
            .withColumn("tb", F.col("b") - F.col("b") % 5)
            .join(brands.select(F.col("b").alias("tb")), "tb", "left_semi")
            .select((F.lit(TYPE_ID_BASE) + F.col("b")).cast("bigint").alias("src"),
                    (F.lit(TYPE_ID_BASE) + F.col("tb")).cast("bigint").alias("dst"),
                    F.lit("IMPLEMENTS").alias("type")))
    inh = (brands.where(F.col("b") % 5 == 2)
           .select((F.lit(TYPE_ID_BASE) + F.col("b")).cast("bigint").alias("src"),
                   (F.lit(TYPE_ID_BASE) + F.col("b") - 1).cast("bigint").alias("dst"),
                   F.lit("INHERITS").alias("type")))
    return item_edges.unionByName(impl).unionByName(inh)


URL_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*)://"
URL_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)"
URL_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
URL_QUERY = r"\?([^#]*)"


def v_calls(t: Tables) -> DataFrame:
    """Outgoing calls: one per page URL; repository = host."""
    pg = t.pages
    return pg.select(
        F.col("page_id").alias("id"),
        F.col("url"),
        F.regexp_extract("url", URL_SCHEME, 1).alias("scheme"),
        F.regexp_extract("url", URL_HOST, 1).alias("host"),
        F.regexp_extract("url", URL_PATH, 1).alias("path"),
        F.regexp_extract("url", URL_QUERY, 1).alias("query"),
        F.regexp_extract("url", URL_HOST, 1).alias("repository"),
        _pick(F.col("page_id") % 4, HTTP_BY_MOD4).alias("http_method"),
    )


def v_endpoints(t: Tables) -> DataFrame:
    """Endpoints: distinct normalized paths of even pages, id = min(page_id)."""
    c = v_calls(t).where(F.col("id") % 2 == 0)
    g = (c.groupBy(normalize_url(F.col("path")).alias("route"))
         .agg(F.min("id").alias("id"), F.min_by("host", "id").alias("repository")))
    return g.select("id", "route", "repository",
                    F.when(F.col("id") % 4 == 0, F.lit("GET")).otherwise(F.lit("POST")).alias("http_method"))


def v_pub(t: Tables) -> DataFrame:
    """Published events.  The distinct domain is bounded by construction
    (types × 10 × 3 × 2), so the global id numbering sorts a tiny set."""
    e = t.events
    d = e.select(
        F.col("event_type"),
        (F.col("user_id") % 10).alias("repo"),
        F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("topic"),
        F.concat(F.col("event_type"), F.lit("."), (F.col("user_id") % 2).cast("string")).alias("routing_key"),
    ).distinct()
    w = Window.orderBy("event_type", "repo", "topic", "routing_key")
    return d.withColumn("id", F.row_number().over(w).cast("bigint"))


def v_sub(t: Tables) -> DataFrame:
    """Event subscriptions (bounded distinct domain, see :func:`v_pub`)."""
    e = t.events
    d = e.select(
        F.col("event_type"),
        (F.col("user_id") % 7 + 5).alias("repo"),
        F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string")).alias("queue"),
        F.concat(F.col("event_type"), F.lit(".*")).alias("pattern"),
    ).distinct()
    w = Window.orderBy("event_type", "repo", "queue", "pattern")
    return d.withColumn("id", F.row_number().over(w).cast("bigint"))


def v_jobs(t: Tables) -> DataFrame:
    o = t.orders
    st = (F.when(F.col("o_orderstatus") == "P", "PENDING")
          .when(F.col("o_orderstatus") == "O", "RUNNING")
          .when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 2 == 0), "COMPLETED")
          .when(F.col("o_orderstatus") == "F", "FAILED"))
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("repository_id"),
        st.alias("status"),
        F.col("o_orderdate").alias("started_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("updated_at"),
        (F.col("o_orderkey") % 5).cast("int").alias("retry_count"),
        F.lit(3).alias("max_retries"),
    )


def v_vec(t: Tables) -> DataFrame:
    e = t.embeddings
    return e.select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("symbol_id"),
                    F.col("label"), F.col("embedding").alias("vector"))


def v_json(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_id").alias("id"), F.col("user_id"),
                           F.col("event_type"), F.col("props").alias("json"))


def v_md(t: Tables) -> DataFrame:
    """Markdown: every 5th line a ``## `` heading; for even docs each 7th line and
    the following one fenced with three backticks."""
    d = t.documents
    lines = F.split(F.col("text"), "\n")
    n = F.size(lines)

    def fmt(x, i):
        k = i + 1
        even = F.col("doc_id") % 2 == 0
        body = F.when(k % 5 == 0, F.concat(F.lit("## "), x)).otherwise(x)
        opened = F.when(even & (k % 7 == 0) & (k < n), F.concat(F.lit("```\n"), body)).otherwise(body)
        return F.when(even & (k > 7) & ((k - 1) % 7 == 0),
                      F.concat(opened, F.lit("\n```"))).otherwise(opened)

    return d.select(F.col("doc_id"), F.col("source"),
                    F.array_join(F.transform(lines, fmt), "\n").alias("text"))


def v_turns(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", "role", "text")


def v_old(t: Tables) -> DataFrame:
    f = v_files(t)
    return f.where(F.col("id") % 10 != 0).select("id", "repository", "path", "content", "content_hash")


def v_new(t: Tables) -> DataFrame:
    f = v_files(t).where(F.col("id") % 10 != 1)
    # ASCII upper-casing (translate) — engine-independent, unlike full Unicode case mapping
    content = F.when(F.col("id") % 10 == 2, F.translate("content", ASCII_LOWER, ASCII_UPPER)).otherwise(F.col("content"))
    path = F.when(F.col("id") % 10 == 3, F.concat(F.lit("moved/"), F.col("path"))).otherwise(F.col("path"))
    return f.select("id", "repository", path.alias("path"), content.alias("content"),
                    F.sha2(content, 256).alias("content_hash"))


CODE_LANGS = ("python", "go", "typescript", "csharp")


def v_code(t: Tables) -> DataFrame:
    """Source-code probe: one small file per part, in one of four languages
    (by part key), naming the part's brand as a type and its name as a function."""
    p = t.part.select("p_partkey", "p_name", "p_brand")
    b = F.regexp_replace("p_brand", "#", "")
    n = F.regexp_replace("p_name", " ", "_")
    k = F.col("p_partkey")
    nl = F.lit("\n")
    py = F.concat(F.lit("class "), b, F.lit(":"), nl, F.lit("    def "), n, F.lit("(self):"), nl, F.lit("        return 1"),
                  nl, F.lit("def helper_"), k.cast("string"), F.lit("():"), nl, F.lit("    pass"))
    go = F.concat(F.lit("func "), n, F.lit("() {}"), nl, F.lit("type "), b, F.lit(" struct {}"))
    ts = F.concat(F.lit("export class "), b, F.lit(" {}"), nl, F.lit("export const "), n, F.lit(" = (a) => a;"), nl,
                  F.lit("interface I"), b, F.lit(" {}"), nl, F.lit("const [v, setV] = useState(0); useEffect(() => {}, []);"), nl,
                  F.lit("await fetch(`/api/${v}/"), n, F.lit("`, { method: 'post' }); axios.get("), nl,
                  F.lit("  '/v"), k.cast("string"), F.lit("'); axios({ url: '/c', method: \"PUT\" });"))
    cs = F.concat(F.lit("public class "), b, F.lit("Handler : IConsumer<"), b, F.lit("Created> {"), nl,
                  F.lit("    public async Task<int> "), n, F.lit("(int a) { await bus.Publish<"), b,
                  F.lit("Created>(msg); _bus.Send(new "), b, F.lit("Command()); }"), nl,
                  F.lit("  client.GetAsync("), nl, F.lit("    baseUrl + \"/api/"), n, F.lit("\"); api.HttpPost<int>(\"p/"),
                  k.cast("string"), F.lit("\", d); [HttpGet(\"no\")] x.QueueEvent(Made"), b, F.lit("(1));"), nl,
                  F.lit("  new RestRequest($\"r/{a[\"k\"]}/"), k.cast("string"), F.lit("\", Method.Put); }"))
    lang = F.when(k % 4 == 0, "python").when(k % 4 == 1, "go").when(k % 4 == 2, "typescript").otherwise("csharp")
    code = F.when(k % 4 == 0, py).when(k % 4 == 1, go).when(k % 4 == 2, ts).otherwise(cs)
    return spread(p).select(k.alias("id"), lang.alias("language"), code.alias("content"))
