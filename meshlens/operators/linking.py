"""Cross-service linking.

Plan shape
----------
* Gateway routes (J-14) are rows of E-12, compiled into (regex, replacement)
  columns.  Calls meet routes through an equi-join on the route's literal
  prefix: a call carries its path's prefixes of the lengths that occur, so no
  call is tested against routes that cannot match (regex locations, which
  have no literal prefix, meet all calls).
* Call → endpoint (J-12/J-13): the exact tier is an equi-join on the
  normalized route.  The fuzzy tier works on *distinct* normalized routes
  (many calls collapse into one template): an inverted index of their rarest
  letters with the length and count bounds of the similarity that each call
  still needs; survivors are scored with one Arrow UDF (X-05).
* Event links (J-15) are an equi-join on the event type (AQE splits a hot
  type); the fuzzy tier compares distinct type names only, with the
  lossless length-ratio bound ``2·min/(la+lb) ≥ .8``.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshlens.functions.urls import normalize_url
from meshlens.operators.graph import KeyedEdges

API_LINK_THRESHOLD = 70     # percent
EVENT_LINK_THRESHOLD = 80   # percent

# Ocelot catch-all placeholder names.
CATCH_ALL = ("everything", "url", "path", "remainder")


# --------------------------------------------------------------------------- X-05

@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """X-05: Ratcliff–Obershelp similarity (``difflib.SequenceMatcher.ratio``).
    Arrow-batched; only ever applied to blocked candidate pairs."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() if x is not None and y is not None else None
                      for x, y in zip(a, b)], dtype="float64")


def ratio_upper_bound(la: Column, lb: Column) -> Column:
    """Exact upper bound of the ratio from lengths alone: 2·min/(la+lb)."""
    return F.when(la + lb == 0, F.lit(1.0)).otherwise(2.0 * F.least(la, lb) / (la + lb))


# --------------------------------------------------------------------------- X-06 / X-09

# Verb synonyms searched in an endpoint's name (X-06).
METHOD_SYNONYMS = {
    "get": ("get", "fetch", "retrieve", "list", "find", "load"),
    "post": ("post", "create", "add", "insert", "save", "submit"),
    "put": ("put", "update", "modify", "edit", "change"),
    "delete": ("delete", "remove", "destroy", "erase"),
    "patch": ("patch", "partial", "modify"),
}


def http_method_matches(call_method: Column, ep_method: Column, ep_signature: Column, ep_name: Column,
                        ep_attributes: Column | None = None) -> Column:
    """X-06: declared method equal, ``Http<Verb>`` attribute, signature prefix,
    verb or synonym in the endpoint name; true when no method is declared."""
    cm = F.upper(call_method)
    cl = F.lower(call_method)
    name = F.lower(F.coalesce(ep_name, F.lit("")))
    cond = (ep_method.isNotNull() & (ep_method != "") & (cm == F.upper(ep_method)))
    if ep_attributes is not None:
        cond = cond | F.array_contains(ep_attributes, F.concat(F.lit("Http"), F.initcap(cl)))
    cond = cond | F.upper(F.coalesce(ep_signature, F.lit(""))).startswith(F.concat(cm, F.lit(" ")))
    cond = cond | name.contains(cl)
    syn = None
    for verb, words in METHOD_SYNONYMS.items():
        hit = (cl == verb) & F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.instr(name, w) > 0)
        syn = hit if syn is None else syn | hit
    cond = cond | syn | ep_method.isNull()
    return F.coalesce(cond, F.lit(False))


def routing_key_regex(pattern: Column) -> Column:
    """X-09: AMQP binding pattern → regex matched against ``'.' + key``:
    ``*`` = one word, ``#`` = zero or more words, other words literal."""
    parts = F.split(pattern, r"\.")
    toks = F.transform(parts, lambda p: F.when(p == "*", F.lit(r"\.[^.]*"))
                       .when(p == "#", F.lit(r"(?:\.[^.]*)*"))
                       .otherwise(F.concat(F.lit(r"\.\Q"), p, F.lit(r"\E"))))
    return F.concat(F.lit("^"), F.array_join(toks, ""), F.lit("$"))


def routing_key_matches(key: Column, pattern: Column) -> Column:
    return F.regexp(F.concat(F.lit("."), key), routing_key_regex(pattern))


# --------------------------------------------------------------------------- J-14 gateway

PLACEHOLDER = r"\{([^}]+)\}"


def compile_routes(routes: DataFrame) -> DataFrame:
    """Gateway routes → match/rewrite rules, as columns.

    ``routes``: id, gateway_type (``ocelot`` / ``nginx``), downstream
    (frontend-facing template or nginx location), upstream, priority, is_regex.
    Each rule has a Java regex with its replacement, the literal ``prefix`` that
    every matching path starts with (the join key; empty for regex locations)
    and the sort key of the reference: priority desc, then shortest template.
    An nginx location without a regex matches by plain prefix (``/de`` matches
    ``/developers``)."""
    down, up = F.col("downstream"), F.coalesce("upstream", F.lit("/"))
    ocelot = F.col("gateway_type") == "ocelot"
    is_regex = ~ocelot & F.coalesce("is_regex", F.lit(False))

    def quoted(c: Column) -> Column:
        return F.when(c == "", F.lit("")).otherwise(F.concat(F.lit("\\Q"), c, F.lit("\\E")))

    names = F.regexp_extract_all(down, F.lit(PLACEHOLDER), F.lit(1))
    parts = F.split(down, PLACEHOLDER, -1)
    numbered = F.transform(names, lambda n, i: F.struct(n.alias("name"), (i + 1).cast("string").alias("no"),
                                                        F.element_at(parts, i + 2).alias("after")))
    body = F.aggregate(numbered, quoted(F.element_at(parts, 1)), lambda acc, x: F.concat(
        acc, F.lit("(?<g"), x["no"], F.when(F.lower(x["name"]).isin(*CATCH_ALL), ">.+)").otherwise(">[^/]+)"),
        quoted(x["after"])))
    plain = F.regexp_replace(up, r"([\\$])", r"\\$1")
    filled = F.aggregate(numbered, plain, lambda acc, x: F.replace(
        acc, F.concat(F.lit("{"), x["name"], F.lit("}")), F.concat(F.lit("${g"), x["no"], F.lit("}"))))
    stem = F.concat(F.regexp_replace(plain, "/+$", ""), F.lit("/$1"))
    return routes.where(down.isNotNull() & (down != "")).select(
        F.col("id").cast("long").alias("route_id"), "gateway_type", F.coalesce("priority", F.lit(0)).alias("priority"),
        F.length(down).alias("tlen"),
        F.when(ocelot, F.element_at(parts, 1)).when(is_regex, F.lit("")).otherwise(down).alias("prefix"),
        F.when(ocelot, F.concat(F.lit("^"), body, F.lit("$")))
        .when(is_regex, F.concat(F.lit("(?s)^(?:"), down, F.lit(").*$")))
        .otherwise(F.concat(F.lit("(?s)^"), quoted(down), F.lit("/*(.*)$"))).alias("regex"),
        # a regex location's text keeps its $1, $2 …; any other dollar sign is itself
        F.when(ocelot, filled).when(is_regex, F.regexp_replace(up, r"\$(?![0-9])", r"\\\$")).otherwise(stem)
        .alias("replacement"),
        (~ocelot & ~is_regex).alias("collapse"))


def routes_from_configs(ocelot: DataFrame, nginx: DataFrame) -> DataFrame:
    """The route table of E-12's rows: (id, gateway_type, downstream, upstream, priority, is_regex)."""
    def numbered(df: DataFrame) -> DataFrame:
        return df.select(F.xxhash64("gateway_type", *df.columns).alias("id"), "gateway_type", "downstream", "upstream",
                         "priority", "is_regex").distinct()
    o = ocelot.select("gateway_type", F.col("downstream_path").alias("downstream"), F.col("upstream_path").alias("upstream"),
                      "priority", F.lit(False).alias("is_regex"))
    n = nginx.select("gateway_type", F.col("downstream_path").alias("downstream"), F.col("upstream_path").alias("upstream"),
                     F.lit(0).alias("priority"), F.col("modifier").contains("~").alias("is_regex"))
    return numbered(o).unionByName(numbered(n))


def resolve_gateway(calls: DataFrame, rules: DataFrame, path_col: str = "path", id_col: str = "id") -> DataFrame:
    """J-14: the first matching route (priority desc, shortest template, route
    id) rewrites the call path; calls without a match are not returned.

    ``rules``: output of :func:`compile_routes`.  Calls meet rules by an equi-join
    on the prefixes of their path whose lengths occur in the rules."""
    sizes = sorted(r[0] for r in rules.select(F.length("prefix")).distinct().collect())  # at most a path's length
    path = F.col(path_col)
    prefixes = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sizes]) if sizes else \
        F.array().cast("array<string>")
    keyed = calls.select(id_col, path_col, F.explode(F.array_compact(prefixes)).alias("prefix"))
    cand = keyed.join(rules, "prefix").where(F.regexp(path, F.col("regex")))
    best = cand.groupBy(id_col, path_col).agg(F.min_by(
        F.struct("route_id", "gateway_type", "regex", "replacement", "collapse"),
        F.struct(-F.col("priority"), "tlen", "route_id")).alias("r"))
    rewritten = F.regexp_replace(path, F.col("r.regex"), F.col("r.replacement"))
    rewritten = F.when(F.col("r.collapse"), F.regexp_replace(rewritten, "/{2,}", "/")).otherwise(rewritten)
    return best.select(id_col, path_col, "r.route_id", "r.gateway_type", rewritten.alias("resolved_path"))


# --------------------------------------------------------------------------- J-12 / J-13

def letters(route: Column) -> Column:
    """The characters of a text as a set: the k-th ``a`` is ``ak``, so common letters are common elements."""
    ordered = F.array_sort(F.filter(F.split(route, ""), lambda c: c != ""))
    return F.transform(ordered, lambda c, i: F.concat(c, (i + 1 - F.array_position(ordered, c)).cast("string")))


def _need(la: Column, lb: Column, ratio: Column) -> Column:
    """Letters that two texts must share for that ratio; a matched character is a shared one."""
    return F.ceil(ratio * (la + lb) / 2 - 1e-9)


def _prefixes(routes: DataFrame, route: str, rare: DataFrame) -> DataFrame:
    """(route, ratio, token, pos, len): the rarest letters of each route, as many as a partner of the least length
    that can still reach ``ratio`` must meet."""
    tokens = (routes.select(route, "ratio", F.length(route).alias("len"), F.explode(letters(F.col(route))).alias("token"))
              .join(rare, "token", "left"))
    pos = F.row_number().over(Window.partitionBy(route, "ratio").orderBy(F.coalesce("df", F.lit(0)), "token"))
    least = F.ceil(F.col("len") * F.col("ratio") / (2 - F.col("ratio")) - 1e-9)
    return (tokens.withColumn("pos", pos).where(F.col("pos") <= F.col("len") - least + 1)
            .select(route, "ratio", "token", "pos", "len"))


def similar_routes(call_routes: DataFrame, routes: DataFrame) -> DataFrame:
    """(call_route, ep_route, ratio) of all pairs of different routes that may reach ``ratio`` (> 0) of the call's side:
    by their lengths and by the letters that they share, which bounds X-05 from above.

    ``call_routes``: (call_route, ratio), ``routes``: (ep_route), both distinct.  Letters are ordered by the number of
    endpoint routes that have them.  A pair with enough common letters has one among the first of both sides, so only
    these meet in a join, and only where the letters left on both sides can still be enough."""
    rare = routes.select(F.explode(letters(F.col("ep_route"))).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("df"))
    wanted = [r[0] for r in call_routes.select("ratio").distinct().collect()]  # a value per kind of call
    if not wanted:
        return call_routes.select("call_route", F.col("call_route").alias("ep_route"), "ratio").where("false")
    per_ratio = routes.select("ep_route", F.explode(F.array(*[F.lit(float(w)) for w in wanted])).alias("ratio"))
    a = _prefixes(call_routes, "call_route", rare).withColumnsRenamed({"pos": "pos_a", "len": "len_a"})
    b = _prefixes(per_ratio, "ep_route", rare).withColumnsRenamed({"pos": "pos_b", "len": "len_b"})
    need = _need(F.col("len_a"), F.col("len_b"), F.col("ratio"))
    left = F.least(F.col("len_a") - F.col("pos_a"), F.col("len_b") - F.col("pos_b")) + 1
    met = (a.join(b, ["ratio", "token"])
           .where((F.least("len_a", "len_b") >= need) & (left >= need) & (F.col("call_route") != F.col("ep_route")))
           .select("call_route", "ep_route", "ratio").distinct())
    shared = F.size(F.array_intersect(letters(F.col("call_route")), letters(F.col("ep_route"))))
    return met.where(shared >= _need(F.length("call_route"), F.length("ep_route"), F.col("ratio")))


def candidate_endpoints(call_routes: DataFrame, endpoints: DataFrame) -> DataFrame:
    """J-13 on distinct normalized call routes: every endpoint whose route is the same or may be as similar as
    ``min_ratio`` (a column of ``call_routes``; by default what a call without a gateway needs), whatever their number.
    No segment need be shared: the result is that of comparing each call route with all endpoint routes."""
    if "min_ratio" not in call_routes.columns:
        call_routes = call_routes.withColumn("min_ratio", F.lit((API_LINK_THRESHOLD - 40) / 50.0))
    cr = call_routes.groupBy("call_route").agg(F.min("min_ratio").alias("ratio"))
    ep = endpoints.select(F.col("id").alias("endpoint_id"), F.col("route").alias("ep_route"))
    routes = ep.select("ep_route").distinct()  # pairs are made of distinct routes, endpoints join at the end
    exact = cr.join(routes, cr["call_route"] == routes["ep_route"]).select("call_route", "ep_route")
    similar = similar_routes(cr, routes).select("call_route", "ep_route")
    return exact.unionByName(similar).join(ep, "ep_route").select("call_route", "endpoint_id", "ep_route")


def link_calls_to_endpoints(calls: DataFrame, endpoints: DataFrame, resolved: DataFrame | None = None,
                            threshold: int = API_LINK_THRESHOLD) -> DataFrame:
    """J-12: best endpoint per call.  score = 50·(exact route, else ratio) +
    30·method match + (20 gateway-resolved, else 10); keep ≥ ``threshold``;
    method label gateway_resolved / exact (≥ 90) / fuzzy; ties → lowest id.

    A call with an endpoint of its own route and method has its best already; only the other calls' routes are
    compared with the rest.  ``calls``: id, path, http_method.  ``endpoints``: id, route, http_method
    (+ optional signature/name).  ``resolved``: J-14 output (id, resolved_path).
    """
    c = calls.select("id", "path", F.col("http_method").alias("call_method"))
    if resolved is not None:
        c = c.join(resolved.select("id", "resolved_path"), "id", "left")
    else:
        c = c.withColumn("resolved_path", F.lit(None).cast("string"))
    c = (c.withColumn("call_route", normalize_url(F.coalesce("resolved_path", "path")))
         .withColumn("gateway", F.col("resolved_path").isNotNull()))
    ep = endpoints.select(F.col("id").alias("endpoint_id"), F.col("route").alias("ep_route"), F.col("http_method").alias("ep_method"),
                          *[F.col(c_).alias("ep_" + c_) if c_ in endpoints.columns else F.lit(None).cast("string").alias("ep_" + c_)
                            for c_ in ("signature", "name")])
    method_ok = http_method_matches(F.col("call_method"), F.col("ep_method"), F.col("ep_signature"), F.col("ep_name"))
    points = F.when(method_ok, 0.3).otherwise(0.0) + F.when(F.col("gateway"), 0.2).otherwise(0.1)

    def scored(pairs: DataFrame, url_score: Column) -> DataFrame:
        return pairs.select("id", "gateway", "endpoint_id", method_ok.alias("method_ok"),
                            F.round(0.5 * url_score + points, 6).alias("score"))

    same = scored(c.join(ep, F.col("call_route") == F.col("ep_route")), F.lit(1.0))
    settled = same.where("method_ok").select("id").distinct()
    # the other two parts of the score give at most 30 + (20 or 10) points
    ratio = F.greatest(F.lit(0.01), (F.lit(threshold) - F.when(F.col("gateway"), 50).otherwise(40)) / 50.0)
    rest = c.join(settled, "id", "left_anti").withColumn("ratio", ratio)
    routes = rest.groupBy("call_route").agg(F.min("ratio").alias("ratio"))
    sim = (similar_routes(routes, ep.select("ep_route").distinct())
           .withColumn("url_score", sequence_ratio(F.col("call_route"), F.col("ep_route")))
           .where(F.col("url_score") >= F.col("ratio") - 1e-9).drop("ratio"))
    near = scored(rest.join(sim, "call_route").join(ep, "ep_route"), F.col("url_score"))
    best = (same.unionByName(near).where(F.col("score") * 100 >= threshold - 1e-9).groupBy("id")
            .agg(F.max(F.struct("score", (-F.col("endpoint_id")).alias("minus"), "gateway")).alias("b")))
    score = F.col("b.score")
    label = F.when(F.col("b.gateway"), "gateway_resolved").when(score >= 0.9, "exact").otherwise("fuzzy")
    return best.select(F.col("id").alias("call_id"), (-F.col("b.minus")).alias("endpoint_id"), score.alias("score"),
                       F.floor(score * 100 + 1e-9).cast("int").alias("match_confidence"), label.alias("match_method"))


# --------------------------------------------------------------------------- J-15 events

def link_events(pubs: DataFrame, subs: DataFrame, threshold: int = EVENT_LINK_THRESHOLD,
                fuzzy: bool = True) -> DataFrame:
    """J-15: cross-repository publisher → subscriber links in integer points:
    70 exact type (or 70·ratio for ratio ≥ .8), +20 topic = queue, +10 routing
    key matches the subscription pattern; keep ≥ ``threshold``."""
    p = pubs.select(F.col("id").alias("pub_id"), F.col("repo").alias("pub_repo"),
                    F.col("event_type").alias("pub_type"), "topic", "routing_key")
    s = subs.select(F.col("id").alias("sub_id"), F.col("repo").alias("sub_repo"),
                    F.col("event_type").alias("sub_type"), "queue", "pattern")
    exact = (p.join(s, p["pub_type"] == s["sub_type"]).where(F.col("pub_repo") != F.col("sub_repo"))
             .withColumn("type_points", F.lit(70.0)).withColumn("match_method", F.lit("exact_type")))
    out = exact
    if fuzzy:
        pt = p.select(F.col("pub_type").alias("a")).distinct()
        st = s.select(F.col("sub_type").alias("b")).distinct()
        la, lb = F.length("a"), F.length("b")
        # distinct type names only; the length bucket equi-join keeps every pair
        # whose length ratio can reach .8 (lb within [la·2/3, la·3/2])
        pb = pt.select("a", F.explode(F.sequence(F.ceil(la * 2.0 / 3.0).cast("int"),
                                                F.floor(la * 1.5).cast("int"))).alias("len_b"))
        pairs = (pb.join(st.withColumn("len_b", lb), "len_b").where(F.col("a") != F.col("b"))
                 .where(ratio_upper_bound(F.length("a"), F.length("b")) >= 0.8)
                 .withColumn("ratio", sequence_ratio(F.lower("a"), F.lower("b")))
                 .where(F.col("ratio") >= 0.8))
        fz = (p.join(pairs, p["pub_type"] == pairs["a"]).join(s, s["sub_type"] == F.col("b"))
              .where(F.col("pub_repo") != F.col("sub_repo"))
              .withColumn("type_points", F.col("ratio") * 70.0).withColumn("match_method", F.lit("fuzzy_type"))
              .drop("a", "b", "len_b", "ratio"))
        out = exact.unionByName(fz)
    pts = (F.col("type_points")
           + F.when(F.col("topic").isNotNull() & F.col("queue").isNotNull() & (F.col("topic") == F.col("queue")), 20)
           .otherwise(0)
           + F.when(F.col("routing_key").isNotNull() & F.col("pattern").isNotNull()
                    & routing_key_matches(F.col("routing_key"), F.col("pattern")), 10).otherwise(0))
    return (out.withColumn("points", pts).where(F.col("points") >= threshold)
            .select("pub_id", "pub_repo", "sub_id", "sub_repo", "match_method",
                    F.floor(F.col("points") + 1e-9).cast("int").alias("match_confidence")))


def event_keys(pubs: DataFrame, subs: DataFrame) -> KeyedEdges:
    """J-15's links of equal event types, factored: publisher → key → subscriber of another repository (``tag``).

    With the type equal (70 points) a link needs the topic to be the queue (20) or the routing key to match the pattern
    (10).  So a key is a type with a topic, or a type with a routing key; patterns are matched with the distinct
    routing keys of their type, never with publishers.  Rows grow with publishers and subscribers, not their pairs."""
    def key(kind: str, value: Column) -> Column:
        return F.to_json(F.struct(F.lit(kind).alias("kind"), F.col("event_type"), value.alias("value"))).alias("key")
    p = pubs.select(F.col("id").alias("src"), F.col("repo").cast("string").alias("tag"), "event_type", "topic", "routing_key")
    s = subs.select(F.col("id").alias("dst"), F.col("repo").cast("string").alias("tag"), "event_type", "queue", "pattern")
    routes = p.select("event_type", "routing_key").distinct().join(s.select("event_type", "pattern").distinct(), "event_type")
    routes = routes.where(routing_key_matches(F.col("routing_key"), F.col("pattern")))
    out = (p.where(F.col("topic").isNotNull()).select("src", "tag", key("topic", F.col("topic")))
           .unionByName(p.where(F.col("routing_key").isNotNull()).select("src", "tag", key("route", F.col("routing_key")))))
    into = (s.where(F.col("queue").isNotNull()).select(key("topic", F.col("queue")), "dst", "tag")
            .unionByName(s.join(routes, ["event_type", "pattern"]).select(key("route", F.col("routing_key")), "dst", "tag")))
    return KeyedEdges(out.distinct(), into.distinct().join(out.select("key"), "key", "left_semi"), "EVENT")


def cross_service_edges(api_links: DataFrame, event_links: DataFrame) -> DataFrame:
    """G-10: repository-pair service graph from API and event links."""
    a = api_links.select(F.col("src_repo").cast("string").alias("src_repo"),
                         F.col("dst_repo").cast("string").alias("dst_repo"), F.lit("api").alias("kind"))
    e = event_links.select(F.col("pub_repo").cast("string").alias("src_repo"),
                           F.col("sub_repo").cast("string").alias("dst_repo"), F.lit("event").alias("kind"))
    return (a.unionByName(e).groupBy("src_repo", "dst_repo", "kind").agg(F.count(F.lit(1)).alias("links")))


# --------------------------------------------------------------------------- J-16 / J-17 / J-35

def all_substrings(s: Column) -> Column:
    """Every substring of ``s`` (O(L²) per value; names and paths are short)."""
    n = F.length(s)
    return F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                                 lambda i: F.transform(F.sequence(i, F.greatest(n, i)),
                                                       lambda j: F.substring(s, i, j - i + 1))))


def map_services_to_repos(services: DataFrame, repos: DataFrame, min_conf: int = 70) -> DataFrame:
    """J-16: tiers 100 exact name, 95 image name, 80 service name inside the
    repository path, 70 either name contains the other; best tier per service,
    lowest repository id on ties.  Substring tiers are equi-joins on exploded
    substrings (exact, no nested loop), and every repository-side key is first
    reduced to its lowest repository id, so a service meets at most one row
    per tier however many repositories share a name or substring."""
    sv = services.select("service_id", F.lower("service_name").alias("sname"), F.lower("image_name").alias("iname"))
    rp = repos.select("repo_id", F.lower("repo_name").alias("rname"), F.lower("repo_path").alias("rpath"))
    by_name = rp.groupBy("rname").agg(F.min("repo_id").alias("repo_id"))
    t100 = sv.join(by_name, sv["sname"] == by_name["rname"]).select("service_id", "repo_id", F.lit(100).alias("confidence"))
    t95 = (sv.where(F.col("iname").isNotNull()).join(by_name, F.col("iname") == F.col("rname"))
           .select("service_id", "repo_id", F.lit(95).alias("confidence")))
    path_subs = (rp.select("repo_id", F.explode(F.array_distinct(all_substrings(F.col("rpath")))).alias("sub"))
                 .groupBy("sub").agg(F.min("repo_id").alias("repo_id")))
    t80 = (sv.join(path_subs, sv["sname"] == path_subs["sub"]).select("service_id", "repo_id")
           .withColumn("confidence", F.lit(80)))
    name_subs = (rp.select("repo_id", F.explode(F.array_distinct(all_substrings(F.col("rname")))).alias("sub"))
                 .groupBy("sub").agg(F.min("repo_id").alias("repo_id")))
    svc_subs = sv.select("service_id", F.explode(F.array_distinct(all_substrings(F.col("sname")))).alias("sub"))
    t70a = sv.join(name_subs, sv["sname"] == name_subs["sub"]).select("service_id", "repo_id")
    t70b = (svc_subs.join(by_name, svc_subs["sub"] == by_name["rname"]).groupBy("service_id")
            .agg(F.min("repo_id").alias("repo_id")))
    t70 = t70a.unionByName(t70b).withColumn("confidence", F.lit(70))
    allc = t100.unionByName(t95).unionByName(t80).unionByName(t70)
    best = allc.groupBy("service_id").agg(F.max(F.struct(F.col("confidence"), (-F.col("repo_id")).alias("neg"))).alias("b"))
    return (best.select("service_id", (-F.col("b.neg")).alias("repo_id"), F.col("b.confidence").alias("confidence"))
            .where(F.col("confidence") >= min_conf))


def resolve_service_urls(urls: DataFrame, mappings: DataFrame) -> DataFrame:
    """J-17: host of each URL → the mapped repository with highest confidence."""
    best = mappings.groupBy("service_name").agg(
        F.max(F.struct(F.col("confidence"), (-F.col("repo_id")).alias("neg"))).alias("_b"))
    best = best.select("service_name", (-F.col("_b.neg")).alias("repo_id"), F.col("_b.confidence").alias("confidence"))
    return urls.join(best, urls["host"] == best["service_name"], "inner").drop("service_name")


# --------------------------------------------------------------------------- J-29

def match_endpoint(requests: DataFrame, endpoints: DataFrame) -> DataFrame:
    """J-29: request (path, method) → endpoint route template.  Tier 1: the
    template with ``{x}`` → ``[^/]+`` matches the whole path (case-insensitive);
    tier 2: template inside path or path inside template.  The method must be
    equal when the request carries one; lowest tier, then lowest endpoint id.

    Tier 1 meets endpoints through their first literal segment (templates that
    start with a placeholder sit under ``*``); tier 2 through exploded
    substrings (O(L²) per short path) — both equi-joins, no nested loop."""
    ep = endpoints.select(F.col("id").alias("endpoint_id"), "template", F.col("http_method").alias("ep_method"))
    rx = F.concat(F.lit("(?i)^"), F.regexp_replace("template", r"\{[^}]+\}", "[^/]+"), F.lit("$"))
    first = F.lower(F.element_at(F.split(F.regexp_replace("template", r"^/+", ""), "/"), 1))
    ep1 = ep.withColumn("rx", rx).withColumn("key", F.when(first.contains("{"), F.lit("*")).otherwise(first))
    req = requests.select(F.col("id").alias("request_id"), "path", F.col("http_method").alias("req_method"))
    rkey = F.lower(F.element_at(F.split(F.regexp_replace("path", r"^/+", ""), "/"), 1))
    method_ok = F.col("req_method").isNull() | (F.col("req_method") == "") | (F.col("ep_method") == F.col("req_method"))
    t1 = (req.select("request_id", "path", "req_method", F.explode(F.array(rkey, F.lit("*"))).alias("key"))
          .join(ep1, "key").where(method_ok & F.regexp(F.col("path"), F.col("rx")))
          .select("request_id", "endpoint_id", F.lit(1).alias("tier")))
    subs_p = req.select("request_id", "req_method", F.explode(F.array_distinct(all_substrings(F.col("path")))).alias("s"))
    ep_by_tpl = ep.groupBy("template", "ep_method").agg(F.min("endpoint_id").alias("endpoint_id"))
    in_path = (subs_p.join(ep_by_tpl, subs_p["s"] == ep_by_tpl["template"]).where(method_ok)
               .select("request_id", "endpoint_id"))
    # one candidate per (substring, method): a short path shared by many
    # requests meets each template substring row once, not every template
    subs_t = (ep.select("endpoint_id", "ep_method", F.explode(F.array_distinct(all_substrings(F.col("template")))).alias("s"))
              .groupBy("s", "ep_method").agg(F.min("endpoint_id").alias("endpoint_id")))
    in_tpl = (subs_t.join(req, subs_t["s"] == req["path"]).where(method_ok).select("request_id", "endpoint_id"))
    t2 = in_path.unionByName(in_tpl).withColumn("tier", F.lit(2))
    allm = t1.unionByName(t2)
    best = allm.groupBy("request_id").agg(F.min(F.struct("tier", "endpoint_id")).alias("b"))
    return best.select("request_id", F.col("b.endpoint_id").alias("endpoint_id"), F.col("b.tier").alias("tier"))
