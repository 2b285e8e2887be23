"""SQL definitions in texts (E-11): tables with columns and constraints, views, procedures with parameters.

One alternation finds the statements of a text; quotes and parentheses (to ``LEVELS`` deep) are part of the patterns, so
a comma or semicolon inside them ends nothing.  All repetitions are possessive: the JVM's engine runs them in a loop,
without backtracking, however long the text.  Everything is row-local.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parentheses in parentheses that a definition may have.
LEVELS = 16
_QUOTED = r"""'[^']*+'|"[^"]*+"|`[^`]*+`|\[[^\]]*+\]"""
_PLAIN = r"""[^()'"`\[]++"""


def _balanced(levels: int) -> str:
    inner = rf"\((?:{_PLAIN}|{_QUOTED})*+\)"
    for _ in range(levels - 1):
        inner = rf"\((?:{_PLAIN}|{_QUOTED}|{inner})*+\)"
    return inner


PARENS = _balanced(LEVELS)
_BODY = rf"(?:{_PLAIN}|{_QUOTED}|{PARENS})*+"
_NAME = rf"(?:[\w.$]++|{_QUOTED})++"
_CREATE = r"\bCREATE\s+(?:OR\s+(?:REPLACE|ALTER)\s+)?"
#: Strings are matched too, and passed over: a statement in a string is none.
TABLE = rf"(?is)'[^']*+'|{_CREATE}(?:TEMP(?:ORARY)?\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?({_NAME})\s*\(({_BODY})\)"
VIEW = (rf"(?is)'[^']*+'|{_CREATE}(?:MATERIALIZED\s+)?VIEW\s+(?:IF\s+NOT\s+EXISTS\s+)?({_NAME})\s*(?:{PARENS}\s*)?"
        r"""AS\s+((?:[^;'"]++|'[^']*+'|"[^"]*+")++)""")
PROCEDURE = (rf"(?is)'[^']*+'|{_CREATE}(PROCEDURE|FUNCTION)\s+({_NAME})\s*\(({_BODY})\)([^;']*?)\b(?:BEGIN|AS)\b(.*?)"
             r"\bEND\s*;")
COMMENT = r"('[^']*+')|--[^\n]*+|/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/"
ITEM = rf"""(?:[^,()'"`\[]++|{_QUOTED}|{PARENS})++"""
COLUMN = rf"""(?is)^({_QUOTED}|[\w$]+)\s+([a-z_]\w*(?:\s+(?:PRECISION|VARYING|UNSIGNED))?)\s*({PARENS})?(.*)$"""
DEFAULT = rf"(?is)\bDEFAULT\s+((?:'[^']*+')++|{PARENS}|[\w.+-]+(?:{PARENS})?)"
OUTSIDE = rf"'[^']*+'|{PARENS}"
TABLE_LEVEL = r"(?i)^(CONSTRAINT|PRIMARY\s+KEY|FOREIGN\s+KEY|UNIQUE|CHECK|INDEX|KEY)\b"
CONSTRAINT = r"(?i)\b(PRIMARY\s+KEY|FOREIGN\s+KEY|UNIQUE|CHECK|REFERENCES)\b"
PARAMETER = rf"(?is)^(?:(INOUT|IN|OUT)\s+)?(@?[\w$]+)\s+([a-z_]\w*\s*(?:{PARENS})?)(.*)$"


def greedy(pattern: str) -> str:
    """The pattern for engines that never backtrack and know no possessive repetition."""
    return pattern.replace("++", "+").replace("*+", "*")


def without_comments(text: Column) -> Column:
    return F.regexp_replace(text, COMMENT, "$1")


def _found(files: DataFrame, id_col: str, text_col: str, pattern: str, names: list[str]) -> DataFrame:
    """One row per statement, its groups by name; groups of passed strings are empty."""
    text = without_comments(F.col(text_col))
    z = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(pattern), i + 1).alias(n) for i, n in enumerate(names)))
    return files.select(id_col, F.explode(F.filter(z, lambda x: x[names[0]] != "")).alias("z")).select(id_col, "z.*")


def _items(body: Column) -> Column:
    """The parts between commas outside of quotes and parentheses."""
    return F.transform(F.regexp_extract_all(body, F.lit(ITEM), 0), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def _unquoted(name: Column) -> Column:
    return F.regexp_replace(name, r"""[\[\]"`']""", "")


def _table_items(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = _found(files, id_col, text_col, TABLE, ["table_name", "body"])
    return (t.select(id_col, _unquoted(F.col("table_name")).alias("table_name"), F.posexplode(_items(F.col("body"))).alias("pos", "d"))
            .where("d <> ''").withColumn("bare", F.regexp_replace("d", OUTSIDE, " ")).withColumn("ordinal", F.col("pos") + 1))


def ddl_columns(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """E-11: CREATE TABLE statements → one row per column (type with its arguments, nullable, default)."""
    c = _table_items(files, id_col, text_col).where(~F.col("d").rlike(TABLE_LEVEL) & F.col("d").rlike(COLUMN))
    default = F.regexp_extract("d", DEFAULT, 1)
    args = F.regexp_replace(F.regexp_extract("d", COLUMN, 3), r"\s*([(),])\s*", "$1")
    return c.select(id_col, "table_name", "ordinal", _unquoted(F.regexp_extract("d", COLUMN, 1)).alias("column_name"),
                    F.concat(F.upper(F.regexp_replace(F.regexp_extract("d", COLUMN, 2), r"\s+", " ")), args).alias("data_type"),
                    (~F.col("bare").rlike(r"(?i)\bNOT\s+NULL\b")).alias("nullable"),
                    F.when(default != "", default).alias("default_value"))


def ddl_constraints(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """E-11: the constraints of CREATE TABLE statements, of tables and of single columns, with their definition."""
    kind = F.upper(F.regexp_replace(F.regexp_extract("bare", CONSTRAINT, 1), r"\s+", " "))
    name = F.regexp_extract("d", r"(?i)\bCONSTRAINT\s+([\w$]+)", 1)
    return (_table_items(files, id_col, text_col).where(F.col("bare").rlike(CONSTRAINT))
            .select(id_col, "table_name", "ordinal", F.when(name != "", name).alias("constraint_name"),
                    kind.alias("constraint_type"), F.col("d").alias("definition")))


def ddl_views(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """E-11: CREATE VIEW statements → name and query."""
    v = _found(files, id_col, text_col, VIEW, ["view_name", "query"])
    return v.select(id_col, _unquoted(F.col("view_name")).alias("view_name"),
                    F.regexp_replace("query", r"^\s+|\s+$", "").alias("query"))


def ddl_procedures(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """E-11: CREATE PROCEDURE / FUNCTION statements → one row per parameter (direction IN unless said; one row with
    nulls without parameters), what a function RETURNS, and the body up to its first ``END;``."""
    p = _found(files, id_col, text_col, PROCEDURE, ["kind", "name", "params", "returns", "body"])
    returns = F.regexp_replace("returns", r"^\s+|\s+$", "")
    p = p.select(id_col, F.upper("kind").alias("kind"), _unquoted(F.col("name")).alias("name"),
                 F.when(F.upper("returns").contains("RETURNS"), returns).alias("returns"),
                 F.regexp_replace("body", r"^\s+|\s+$", "").alias("body"),
                 F.posexplode_outer(F.filter(_items(F.col("params")), lambda x: x.rlike(PARAMETER))).alias("pos", "d"))
    way = F.upper(F.regexp_extract("d", PARAMETER, 1))
    return p.select(id_col, "kind", "name", (F.col("pos") + 1).alias("position"),
                    F.when(F.col("d").isNull(), None).when(way == "", "IN").otherwise(way).alias("direction"),
                    F.regexp_extract("d", PARAMETER, 2).alias("param_name"),
                    F.upper(F.regexp_replace(F.regexp_extract("d", PARAMETER, 3), r"\s+", "")).alias("param_type"),
                    "returns", "body")
