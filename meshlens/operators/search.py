"""Search operators: keyword (V-01), vector (V-02), boosted (V-03), hybrid (V-04).

Scale notes
-----------
* The query text / query vector is a *parameter*: it enters the plan as literals
  or as a one-row scalar subquery, so scoring is a narrow projection over the
  symbol / vector scan (no join, no shuffle).
* Top-k is ``orderBy(...).limit(k)`` → ``TakeOrderedAndProject``: each task keeps
  its own k best rows and only k·tasks rows reach the final merge.  Ranks are
  numbered *after* the limit, on at most k rows.
* Best-chunk-per-symbol is a partial/final hash aggregate on the symbol key,
  done before the top-k (pre-aggregate before shuffling).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlens.functions.text import tokenize_query_literal
from meshlens.functions.vectors import cosine, l2_norm

RRF_K = 60


def _lower(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def keyword_score(query: str, name="name", fqn="fqn", signature="signature",
                  documentation="documentation") -> Column:
    """X-02: phrase tier (10/5/4/2/1) + per-token tier (2/1.5/1/.5) + 3·matched/total."""
    q = query.lower()
    tokens = tokenize_query_literal(query)
    n, f, s, d = _lower(name), _lower(fqn), _lower(signature), _lower(documentation)
    phrase = (F.when(n == q, 10.0).when(n.contains(q), 5.0).when(f.contains(q), 4.0)
              .when(s.contains(q), 2.0).when(d.contains(q), 1.0).otherwise(0.0))
    score = phrase
    matched = F.lit(0)
    for t in tokens:
        tier = (F.when(n.contains(t), 2.0).when(f.contains(t), 1.5).when(s.contains(t), 1.0)
                .when(d.contains(t), 0.5).otherwise(0.0))
        score = score + tier
        matched = matched + F.when(tier > 0, 1).otherwise(0)
    if len(tokens) > 1:
        score = score + matched / F.lit(float(len(tokens))) * 3.0
    return score


def keyword_match(query: str, fields=("name", "signature", "documentation", "fqn")) -> Column:
    """V-01 candidate predicate: phrase or any token (len ≥ 2) inside any field."""
    terms = [query.lower()] + [t for t in tokenize_query_literal(query) if len(t) >= 2]
    conds = [_lower(c).contains(t) for t in terms for c in fields]
    return reduce(lambda a, b: a | b, conds)


def _ranked(df: DataFrame, order: list[Column], limit: int | None, rank_col: str) -> DataFrame:
    top = df.orderBy(*order)
    if limit is not None:
        top = top.limit(limit)
    # numbering runs on the (bounded) limited result only
    return top.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def keyword_search(symbols: DataFrame, query: str, limit: int | None = 20,
                   id_col: str = "id") -> DataFrame:
    """V-01: every match is scored before the limit; order score desc, name, id."""
    scored = (symbols.where(keyword_match(query))
              .withColumn("score", keyword_score(query)))
    order = [F.col("score").desc(), F.col("name").asc(), F.col(id_col).asc()]
    return _ranked(scored, order, limit, "rank")


def query_vector(vectors: DataFrame, key_col: str, key_value, vec_col: str = "vector",
                 max_dim: int = 65536) -> Column:
    """A query vector taken from one table row, as a literal array.

    The reference receives the query vector as a parameter (from its embedding
    model); here it is read from the table.  Only one row of bounded width
    (checked against ``max_dim``) reaches the driver; Spark's higher-order
    functions do not accept a scalar subquery, and a one-row join would be a
    cross join, so the literal is the cheapest exact form.
    """
    row = vectors.where(F.col(key_col) == key_value).select(F.col(vec_col)).limit(2).collect()
    if len(row) != 1:
        raise ValueError(f"expected exactly one query vector for {key_col}={key_value}, got {len(row)}")
    vec = row[0][0]
    if vec is None or len(vec) > max_dim:
        raise ValueError("query vector missing or wider than max_dim")
    return F.array(*[F.lit(float(x)).cast("double") for x in vec])


def vector_search(vectors: DataFrame, qvec: Column, k: int | None = 20, threshold: float = 0.7,
                  symbol_col: str = "symbol_id", vec_col: str = "vector",
                  digits: int = 6) -> DataFrame:
    """V-02: cosine ≥ threshold, best chunk per symbol, top ``k`` by score, id."""
    qnorm = l2_norm(qvec)
    sims = (vectors.select(F.col(symbol_col).alias("symbol_id"),
                           F.round(cosine(F.col(vec_col), qvec, qnorm), digits).alias("score"))
            .where(F.col("score") >= threshold))
    best = sims.groupBy("symbol_id").agg(F.max("score").alias("score"))
    order = [F.col("score").desc(), F.col("symbol_id").asc()]
    return _ranked(best, order, k, "rank")


def reciprocal_rank_fusion(lists: list[DataFrame], limit: int, k: int = RRF_K,
                           id_col: str = "symbol_id", digits: int = 10) -> DataFrame:
    """S-01 + V-04: outer union of ranked lists, score = Σ 1/(k + rank)."""
    tagged = [l.select(F.col(id_col).alias("symbol_id"), F.col("rank"),
                       F.lit(i).alias("list_no")) for i, l in enumerate(lists)]
    allr = reduce(DataFrame.unionByName, tagged)
    aggs = [F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))), digits).alias("score")]
    aggs += [F.max(F.when(F.col("list_no") == i, F.col("rank"))).alias(f"rank_{i}")
             for i in range(len(lists))]
    fused = allr.groupBy("symbol_id").agg(*aggs)
    order = [F.col("score").desc(), F.col("symbol_id").asc()]
    return _ranked(fused, order, limit, "rank")


def hybrid_search(symbols: DataFrame, vectors: DataFrame, query: str, qvec: Column,
                  limit: int = 20, threshold: float = 0.5) -> DataFrame:
    """V-04: keyword and vector lists of 2·limit each, fused by reciprocal rank."""
    kw = keyword_search(symbols, query, 2 * limit).select(F.col("id").alias("symbol_id"), "rank")
    vs = vector_search(vectors, qvec, 2 * limit, threshold).select("symbol_id", "rank")
    fused = reciprocal_rank_fusion([kw, vs], limit)
    return fused.select("symbol_id", "score", F.col("rank_0").alias("keyword_rank"),
                        F.col("rank_1").alias("vector_rank"), "rank")


def boosted_search(symbols: DataFrame, vectors: DataFrame, query: str, qvec: Column,
                   k: int = 10, threshold: float = 0.7, digits: int = 6) -> DataFrame:
    """V-03: top 2k vector hits ∪ the first k name/FQN substring hits (lowest id
    replaces the reference's arbitrary order), then additive boosts: +.5 exact
    name else +.2 name contains; +.1 query in file path; +.1 high-level kind,
    +.05 callable.  ``symbols`` must carry the file ``path``."""
    q = query.lower()
    vec = vector_search(vectors, qvec, 2 * k, threshold).select("symbol_id", F.col("score").alias("vscore"))
    txt = (symbols.where(F.lower("name").contains(q) | F.lower(F.coalesce("fqn", F.lit(""))).contains(q))
           .select(F.col("id").alias("symbol_id")).orderBy("symbol_id").limit(k))
    cand = vec.join(txt, "symbol_id", "full_outer")
    s = cand.join(symbols.withColumnRenamed("id", "symbol_id"), "symbol_id", "inner")
    name_l = F.lower("name")
    boost = (F.when(name_l == q, 0.5).when(name_l.contains(q), 0.2).otherwise(0.0)
             + F.when(F.lower(F.coalesce("path", F.lit(""))).contains(q), 0.1).otherwise(0.0)
             + F.when(F.col("kind").isin("CLASS", "INTERFACE", "STRUCT", "MODULE"), 0.1)
             .when(F.col("kind").isin("FUNCTION", "METHOD"), 0.05).otherwise(0.0))
    scored = s.select("symbol_id", "name",
                      F.round(F.coalesce(F.col("vscore"), F.lit(0.0)) + boost, digits).alias("score"))
    order = [F.col("score").desc(), F.col("symbol_id").asc()]
    return _ranked(scored, order, k, "rank")


def reuse_vectors(chunks: DataFrame, cached: DataFrame, model: str) -> DataFrame:
    """V-09: chunks whose (content hash, model) already has a vector reuse it
    (``hit``); the others are returned with ``hit = false`` for embedding."""
    c = cached.where(F.col("model") == model).select("content_hash", F.col("vector").alias("cached_vector"))
    c = c.dropDuplicates(["content_hash"])
    return chunks.join(c, "content_hash", "left").withColumn("hit", F.col("cached_vector").isNotNull())


def ivf_search(spark, vectors: DataFrame, qvec: list[float], k: int = 20, n_lists: int = 16, n_probe: int = 4,
               seed: int = 7, vec_col: str = "vector", id_col: str = "symbol_id") -> DataFrame:
    """V-05: approximate cosine top-k over coarse clusters (IVF).

    Vectors are L2-normalized and clustered with ``pyspark.ml`` KMeans
    (``n_lists`` centroids); the query probes its ``n_probe`` nearest centroids
    and ranks only their members — the candidate scan shrinks to about
    n_probe / n_lists of the table.  Exact cosine is used inside the probed lists."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    normed = vectors.select(F.col(id_col).alias("symbol_id"), F.col(vec_col).alias("vector"),
                            F.transform(F.col(vec_col).cast("array<double>"),
                                        lambda x: x / l2_norm(F.col(vec_col))).alias("unit"))
    feats = normed.withColumn("features", array_to_vector("unit"))
    model = KMeans(k=n_lists, seed=seed, featuresCol="features", predictionCol="list_id").fit(feats)
    centers = [[float(x) for x in c] for c in model.clusterCenters()]
    q = F.array(*[F.lit(float(x)) for x in qvec])
    cent = spark.createDataFrame([(i, c) for i, c in enumerate(centers)], "list_id int, centroid array<double>")
    probe = (cent.select("list_id", cosine(F.col("centroid"), q).alias("cs"))
             .orderBy(F.col("cs").desc(), "list_id").limit(n_probe).select("list_id"))
    assigned = model.transform(feats).select("symbol_id", "vector", "list_id")
    cand = assigned.join(F.broadcast(probe), "list_id")
    scored = cand.select("symbol_id", F.round(cosine(F.col("vector"), q), 6).alias("score"))
    order = [F.col("score").desc(), F.col("symbol_id").asc()]
    return _ranked(scored, order, k, "rank")


def symbol_chunks(symbols: DataFrame, files: DataFrame, edges: DataFrame, max_body_lines: int | None = None,
                  max_calls: int | None = None, imports: DataFrame | None = None) -> DataFrame:
    """V-08: the code chunk text of every symbol — file, namespace, what its file imports
    (``imports``: file_id, name), parent class (name and signature), signature, body lines,
    callees, implemented and inherited types — with its SHA-256 and word count; and a
    documentation chunk (name, kind, file, namespace, text) of every documented symbol.

    All lines, imports and callees count; with ``max_body_lines`` or ``max_calls`` the
    first ones do, and ``body_cut`` or ``calls_cut`` says whether there are more
    (callees through a per-symbol ``row_number()``, a partial top-k before the
    shuffle)."""
    from meshlens.functions.code import namespace_of

    s = symbols.select("id", "name", "kind", "fqn", "signature", "parent_name", "start_line", "end_line", "file_id", "documentation")
    f = files.select(F.col("id").alias("file_id"), "path", F.split(F.col("content"), "\n").alias("lines"))
    parents = (symbols.where(F.col("fqn").isNotNull()).groupBy(F.col("fqn").alias("parent_name"))
               .agg(F.min_by(F.struct(F.col("name").alias("pname"), F.col("signature").alias("psig")), F.col("id")).alias("p")))
    names = symbols.select(F.col("id").alias("dst"), F.col("name").alias("dst_name"))
    calls = edges.where(F.col("type") == "CALLS").join(names, "dst")
    callee = F.struct("dst_name", "dst")
    calls_cut = F.lit(False)
    if max_calls is not None:
        wc = Window.partitionBy("src").orderBy("dst_name", "dst")
        calls = calls.withColumn("k", F.row_number().over(wc)).where(F.col("k") <= max_calls + 1)
        callee, calls_cut = F.when(F.col("k") <= max_calls, callee), F.max(F.col("k")) > max_calls
    calls = (calls.groupBy(F.col("src").alias("id"))
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(callee)), lambda x: x["dst_name"]), ", ")
                  .alias("calls"), calls_cut.alias("calls_cut")))

    def bases(t, col):
        return (edges.where(F.col("type") == t).join(names, "dst").groupBy(F.col("src").alias("id"))
                .agg(F.array_join(F.array_sort(F.collect_list("dst_name")), ", ").alias(col)))

    j = (s.join(f, "file_id").join(parents, "parent_name", "left").join(calls, "id", "left")
         .join(bases("IMPLEMENTS", "impl"), "id", "left").join(bases("INHERITS", "inh"), "id", "left"))
    if imports is None:
        j = j.withColumn("imports", F.lit(None).cast("string"))
    else:
        j = j.join(imports.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("imports")),
                   "file_id", "left")
    ns = namespace_of(F.col("fqn"))
    n_lines = F.size("lines")
    end = F.least(n_lines, F.col("end_line"))
    last = end if max_body_lines is None else F.least(end, F.col("start_line") + max_body_lines - 1)
    body = F.array_join(F.slice("lines", F.col("start_line"), F.greatest(last - F.col("start_line") + 1, F.lit(0))), "\n")
    has_parent = F.col("p").isNotNull()
    parts = F.array(
        F.concat(F.lit("File: "), F.col("path")),
        F.when(ns != "", F.concat(F.lit("Namespace: "), ns)),
        F.when(F.col("imports") != "", F.concat(F.lit("Imports: "), F.col("imports"))),
        F.lit(""),
        F.when(has_parent, F.concat(F.lit("// In class: "), F.col("p.pname"))),
        F.when(has_parent, F.concat(F.lit("// "), F.coalesce(F.col("p.psig"), F.lit("None")))),
        F.when(has_parent, F.lit("")),
        F.col("signature"),
        F.when(F.col("start_line").isNotNull() & F.col("end_line").isNotNull() & (body != ""), body),
        F.when(F.col("calls").isNotNull(), F.concat(F.lit("\n// Calls: "), F.col("calls"))),
        F.when(F.col("impl").isNotNull(), F.concat(F.lit("// Implements: "), F.col("impl"))),
        F.when(F.col("inh").isNotNull(), F.concat(F.lit("// Inherits from: "), F.col("inh"))))
    content = F.array_join(F.filter(parts, lambda x: x.isNotNull()), "\n")
    flags = {}
    if max_body_lines is not None:
        flags["body_cut"] = F.coalesce(end > last, F.lit(False))
    if max_calls is not None:
        flags["calls_cut"] = F.coalesce("calls_cut", F.lit(False))
    head = F.array(F.concat("name", F.lit(" ("), "kind", F.lit(")")), F.concat(F.lit("File: "), "path"),
                   F.when(ns != "", F.concat(F.lit("Namespace: "), ns)), F.lit(""), F.col("documentation"))
    documentation = F.when(F.col("documentation") != "", F.array_join(F.filter(head, lambda x: x.isNotNull()), "\n"))
    chunks = F.array(F.struct(F.lit("code").alias("content_type"), content.alias("content")),
                     F.struct(F.lit("documentation").alias("content_type"), documentation.alias("content")))
    out = j.select("id", F.explode(F.filter(chunks, lambda c: c["content"].isNotNull())).alias("c"), *(c.alias(n) for n, c in flags.items()))
    out = out.select("id", "c.*", *flags)
    return out.select("id", "content_type", F.sha2("content", 256).alias("content_hash"),
                      F.size(F.filter(F.split("content", r"\s+"), lambda w: w != "")).cast("bigint").alias("word_count"),
                      F.length("content").cast("bigint").alias("char_count"), *flags)


PARSED_SYMBOL_SCHEMA = ("struct<name: string, kind: string, fully_qualified_name: string, signature: string, "
                        "return_type: string, complexity: int, parameters: array<struct<name: string, type: string>>, "
                        "structured_docs: struct<is_partial: boolean, is_lambda: boolean, "
                        "closure_variables: array<string>, linq_pattern: string>>")


def build_symbol_rows(parsed: DataFrame, id_col: str, json_col: str, max_fqn: int | None = None,
                      max_return_type: int | None = None) -> DataFrame:
    """V-10: symbol rows from parser output (JSON): complexity (parser value,
    default 1, plus the parameter count when the parser left the default),
    FQN (name when missing), return type, token count = words of the
    signature, partial / lambda flags, closure variables, LINQ pattern.

    With ``max_fqn`` or ``max_return_type`` that text is cut, and ``fqn_cut``
    or ``return_type_cut`` says where."""
    p = F.from_json(F.col(json_col), PARSED_SYMBOL_SCHEMA)
    d = parsed.select(F.col(id_col), p.alias("p"))
    c = F.coalesce(F.col("p.complexity"), F.lit(1))
    n_params = F.coalesce(F.size(F.col("p.parameters")), F.lit(0))
    complexity = F.when((c == 1) & (n_params > 0), c + n_params).otherwise(c)
    sig = F.col("p.signature")
    tokens = F.when(sig.isNull(), F.lit(0)).otherwise(F.size(F.filter(F.split(sig, r"\s+"), lambda w: w != "")))
    sd = F.col("p.structured_docs")
    fqn, return_type, flags = F.coalesce(F.col("p.fully_qualified_name"), F.col("p.name")), F.col("p.return_type"), []
    if max_fqn is not None:
        flags.append(F.coalesce(F.length(fqn) > max_fqn, F.lit(False)).alias("fqn_cut"))
        fqn = F.substring(fqn, 1, max_fqn)
    if max_return_type is not None:
        flags.append(F.coalesce(F.length(return_type) > max_return_type, F.lit(False)).alias("return_type_cut"))
        return_type = F.substring(return_type, 1, max_return_type)
    return d.select(id_col, F.col("p.name").alias("name"), F.col("p.kind").alias("kind"),
                    fqn.alias("fqn"), return_type.alias("return_type"),
                    complexity.cast("int").alias("complexity"), complexity.cast("int").alias("complexity_score"),
                    tokens.cast("int").alias("token_count"),
                    F.when(F.coalesce(sd["is_partial"], F.lit(False)), 1).otherwise(0).alias("is_partial"),
                    F.when(F.coalesce(sd["is_lambda"], F.lit(False)), 1).otherwise(0).alias("is_lambda"),
                    F.array_join(F.coalesce(sd["closure_variables"], F.array().cast("array<string>")), ",")
                    .alias("closure_variables"), sd["linq_pattern"].alias("linq_pattern"), *flags)
