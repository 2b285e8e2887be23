"""Operator 7, WARC not-modified revisits: an as-of join to the latest earlier full response of the canonical URL.

A revisit record answers "not modified" and has headers but no payload.  It is resolved to the latest full response
of the same canonical URL that was captured before it.  Its validators must agree: the entity tags where both have
one (weak comparison), else the modification dates; without a pair to compare the revisit is ``unchecked``.  A resolved
record takes the stored headers, updated by those that a 304 answer may send (RFC 9110, section 15.4.5).

Scale: payloads don't take part; the result names the record whose payload holds.  The as-of join runs in buckets of
``BUCKET`` time units: within a bucket by a window, across buckets by the last response of each (URL, bucket), which is
pre-aggregated.  A URL with a third of all captures is thus spread over its buckets.

Cases: null URLs match nothing and null times sort first; of responses at one time the larger record id is the later
one, and a response at the same time as a revisit counts as earlier only by a smaller id; repeated rows are resolved
alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET = 4096
#: Headers that a 304 answer may carry and that replace stored ones (fixed values).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified")
#: Query parameters that don't name content (fixed values).
_TRACKING = r"(utm_[a-z]+|ref|fbclid|gclid|sessionid)"


def canonical_url(url: Column) -> Column:
    """Lower-case host without port and mobile or www label, path without index page and trailing slash, other
    parameters in order; scheme, fragment and tracking parameters go."""
    u = F.regexp_replace(url, "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rest = F.regexp_replace(u, "^[^/?]*", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(u, "[/?].*$", ""), ":[0-9]*$", ""))
    host = F.regexp_replace(host, "^(www|m)[.]", "")
    path = F.regexp_replace(F.regexp_replace(rest, "[?].*$", ""), "(/index)?[.]html?$", "")
    path = F.regexp_replace(path, "/+$", "")
    query = F.when(F.instr(rest, "?") > 0, F.regexp_replace(rest, "^[^?]*[?]", "")).otherwise("")
    kept = F.array_sort(F.filter(F.split(query, "&"),
                                 lambda p: (p != "") & ~p.rlike(f"^{_TRACKING}(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def resolve_revisits(records: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """All ``records`` (record_id, url, ts, kind, etag, modified, headers) with what each revisit resolves to.

    ``kind`` is ``response`` or ``revisit``; ``headers`` maps lower-case names to values.  Columns: record_id, url_key,
    kind, payload_record_id (null: unresolved), outcome, headers (merged, as ``name: value`` lines in order).
    """
    rec = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), "ts", "kind", "etag", "modified",
                         "headers").withColumn("bucket", F.floor(F.coalesce("ts", F.lit(0)) / bucket))
    full = F.struct("ts", "record_id", "etag", "modified", "headers")
    is_full = F.col("kind") == "response"
    earlier = (Window.partitionBy("url_key", "bucket").orderBy("ts", "record_id")
               .rowsBetween(Window.unboundedPreceding, -1))
    within = rec.withColumn("near", F.last(F.when(is_full, full), ignorenulls=True).over(earlier))
    lasts = rec.groupBy("url_key", "bucket").agg(
        F.max_by(F.when(is_full, full), F.when(is_full, F.struct("ts", "record_id"))).alias("last"))
    before = Window.partitionBy("url_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("url_key", "bucket", F.last("last", ignorenulls=True).over(before).alias("far"))
    joined = within.join(carried, ["url_key", "bucket"], "left")
    base = F.when(is_full | F.col("url_key").isNull(), None).otherwise(F.coalesce("near", "far"))
    weak = lambda tag: F.regexp_replace(tag, "^W/", "")
    tags = F.col("etag").isNotNull() & F.col("base.etag").isNotNull()
    dates = F.col("modified").isNotNull() & F.col("base.modified").isNotNull()
    outcome = (F.when(is_full, "response").when(F.col("base").isNull(), "unresolved")
               .when(tags, F.when(weak(F.col("etag")) == weak(F.col("base.etag")), "verified").otherwise("mismatch"))
               .when(dates, F.when(F.col("modified") == F.col("base.modified"), "verified").otherwise("mismatch"))
               .otherwise("unchecked"))
    good = F.col("outcome").isin("verified", "unchecked")
    own = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    update = F.map_filter(own, lambda k, v: k.isin(*PERMITTED))
    stored = F.map_filter(F.coalesce("base.headers", F.create_map().cast("map<string,string>")),
                          lambda k, v: ~F.map_contains_key(update, k))
    merged = F.when(good, F.map_concat(stored, update)).otherwise(own)
    return (joined.withColumn("base", base).withColumn("outcome", outcome)
            .select("record_id", "url_key", "kind",
                    F.when(is_full, F.col("record_id")).when(good, F.col("base.record_id")).alias("payload_record_id"),
                    "outcome",
                    F.array_join(F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat_ws(": ", e["key"], e["value"]))),
                                 "\n").alias("headers")))


def capture_records(pages: DataFrame) -> DataFrame:
    """Capture records of a (page_id, url, html) table: every page as a full response and two later recrawls of it.

    The table has no capture headers, so they derive from its rows: times from the id, the entity tag from the
    payload.  The first recrawl gets "not modified" with the tag (weak), or with the modification date only where
    the id is a multiple of 5; the second one has another tag where the id is a multiple of 7, and no validator where
    it is a multiple of 11.
    """
    page = pages.select(F.col("page_id").cast("long").alias("id"), "url",
                        F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"')).alias("tag"),
                        F.length(F.coalesce("html", F.lit(""))).cast("string").alias("size"))
    rounds = page.withColumn("round", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    i, r = F.col("id"), F.col("round")
    etag = (F.when(r == 0, F.col("tag")).when((r == 1) & (i % 5 != 0), F.concat(F.lit("W/"), "tag"))
            .when((r == 2) & (i % 7 == 0), F.lit('"changed"')).when((r == 2) & (i % 11 != 0), F.col("tag")))
    modified = F.when((r == 0) | ((r == 1) & (i % 5 == 0)), F.concat(F.lit("day "), (i % 28).cast("string")))
    ts = i + r * 1000
    names = ["date", "etag", "last-modified", "content-length", "cache-control", "server"]
    values = [F.concat(F.lit("t"), ts.cast("string")), etag, modified, F.when(r == 0, F.col("size")),
              F.concat(F.lit("max-age="), (r * 60).cast("string")), F.concat(F.lit("s"), r.cast("string"))]
    headers = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*values)), lambda k, v: v.isNotNull())
    return rounds.select((i * 3 + r).alias("record_id"), "url", ts.alias("ts"),
                         F.when(r == 0, "response").otherwise("revisit").alias("kind"),
                         etag.alias("etag"), modified.alias("modified"), headers.alias("headers"))
