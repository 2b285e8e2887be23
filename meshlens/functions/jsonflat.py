"""JSON flattening (X-27) and JSON-with-comments cleaning (E-06), on VARIANT.

``flatten_json`` turns every leaf of a JSON document into a row
``(key path "A:B:0", value text, type)`` by exploding objects and arrays level
by level with ``variant_explode_outer`` (a lateral, row-local generator — no
shuffle).  Empty containers produce no rows, as in the reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# String-aware cleaning: a JSON string literal (kept) or a comment / trailing
# comma (dropped).  The string body is written as an unrolled loop so the
# regex engine iterates per escape sequence, not per character.
_JSON_STRING = r'("[^"\\]*(?:\\.[^"\\]*)*")'
COMMENT_RE = _JSON_STRING + r"|//[^\n]*|/\*[\s\S]*?\*/"
TRAILING_COMMA_RE = _JSON_STRING + r"|,(\s*[}\]])"


def strip_json_comments(text: Column) -> Column:
    """Remove ``//`` and ``/* */`` comments and trailing commas outside strings."""
    no_comments = F.regexp_replace(text, COMMENT_RE, "$1")
    return F.regexp_replace(no_comments, TRAILING_COMMA_RE, "$1$2")


def _is_container(v: Column) -> Column:
    t = F.schema_of_variant(v)
    return t.startswith("OBJECT") | t.startswith("ARRAY")


def _leaf_type(v: Column) -> Column:
    t = F.schema_of_variant(v)
    return (F.when(t == "BOOLEAN", F.lit("boolean"))
            .when(t.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.lit("number"))
            .otherwise(F.lit("string")))


def nesting_depth(json: Column) -> Column:
    """Levels of containers in a JSON text (an upper bound on malformed text)."""
    bare = F.regexp_replace(json, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    brackets = F.filter(F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), ""), lambda b: b != "")

    def step(acc: Column, b: Column) -> Column:
        depth = acc["depth"] + F.when(b.isin("{", "["), 1).otherwise(-1)
        return F.struct(depth.alias("depth"), F.greatest(acc["top"], depth).alias("top"))

    return F.aggregate(brackets, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("top")), step, lambda acc: acc["top"])


def flatten_json(df: DataFrame, id_col: str, json_col: str, sep: str = ":", keep: tuple[str, ...] = ()) -> DataFrame:
    """X-27: (id, ``keep`` columns, key, value, type) for every JSON leaf at any depth (nulls kept with a null value).

    One scan and one chain of generators: each level opens the containers and
    passes leaves through.  The number of levels is that of the data, read by
    one aggregate beforehand."""
    spark = df.sparkSession
    depth = df.agg(F.max(nesting_depth(F.col(json_col)))).first()[0] or 0
    cols = ["_id", *keep]
    cur = (df.select(F.col(id_col).alias("_id"), *keep, F.parse_json(F.col(json_col)).alias("v"), F.lit("").alias("path"))
           .where(_is_container(F.col("v"))))
    for _ in range(max(1, depth)):
        cur = cur.withColumn("box", F.when(_is_container(F.col("v")), F.col("v")))
        ex = cur.lateralJoin(spark.tvf.variant_explode_outer(F.col("box").outer()))
        step = F.coalesce(F.col("key"), F.col("pos").cast("string"))
        opened = F.col("box").isNotNull()
        path = (F.when(~opened, F.col("path")).when(F.col("path") == "", step)
                .otherwise(F.concat(F.col("path"), F.lit(sep), step)))
        cur = (ex.where(~opened | step.isNotNull())  # an empty container gives no row
               .select(*cols, path.alias("path"), F.when(opened, F.col("value")).otherwise(F.col("v")).alias("v")))
    return (cur.where(~_is_container(F.col("v")))
            .select(F.col("_id").alias(id_col), *keep, F.col("path").alias("key"),
                    F.expr("variant_get(v, '$', 'string')").alias("value"), _leaf_type(F.col("v")).alias("type")))
