"""E-11 on definitions with quotes, nested parentheses, comments and long bodies."""

from meshlens.operators import ddl as D


def run(spark, fn, text):
    return fn(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text").collect()


def test_columns_keep_quotes_and_arguments(spark):
    text = """CREATE TABLE IF NOT EXISTS "a b" (x INT DEFAULT ((1+(2))), `y` ENUM(1,2,3) NOT NULL DEFAULT 'x;y',
      z DOUBLE PRECISION, w NUMERIC(10 , 2) DEFAULT 'it''s, (', PRIMARY KEY (x))"""
    got = [(r.column_name, r.data_type, r.nullable, r.default_value) for r in run(spark, D.ddl_columns, text)]
    assert got == [("x", "INT", True, "((1+(2)))"), ("y", "ENUM(1,2,3)", False, "'x;y'"), ("z", "DOUBLE PRECISION", True, None),
                   ("w", "NUMERIC(10,2)", True, "'it''s, ('")]


def test_deep_parentheses_and_long_tables(spark):
    deep = "(" * D.LEVELS + "1,2" + ")" * D.LEVELS
    (r,) = run(spark, D.ddl_columns, f"create table t (a int default {deep});")
    assert r.default_value == deep
    n = 20000
    text = "CREATE TABLE t (" + ", ".join(f"c{i} VARCHAR({i}) DEFAULT '{i};,('" for i in range(n)) + ");"
    assert len(run(spark, D.ddl_columns, text)) == n


def test_constraints_views_and_comments(spark):
    text = """CREATE TABLE t (a INT REFERENCES u(id), CONSTRAINT k UNIQUE (a, b), CHECK (a > 0)); -- CREATE VIEW no AS SELECT 1;
    /* CREATE VIEW no2 AS SELECT 2; */ CREATE VIEW v AS SELECT ';' FROM t; SELECT 'CREATE VIEW no3 AS SELECT 3';"""
    assert [(r.constraint_name, r.constraint_type) for r in run(spark, D.ddl_constraints, text)] == [
        (None, "REFERENCES"), ("k", "UNIQUE"), (None, "CHECK")]
    assert [(r.view_name, r.query) for r in run(spark, D.ddl_views, text)] == [("v", "SELECT ';' FROM t")]


def test_procedures(spark):
    text = "CREATE PROCEDURE p(INOUT a DECIMAL(3,1), b TEXT) BEGIN x(1); END; CREATE FUNCTION f() RETURNS TABLE(a INT) AS y END;"
    got = [(r.kind, r.name, r.position, r.direction, r.param_type, r.returns) for r in run(spark, D.ddl_procedures, text)]
    assert got == [("PROCEDURE", "p", 1, "INOUT", "DECIMAL(3,1)", None), ("PROCEDURE", "p", 2, "IN", "TEXT", None),
                   ("FUNCTION", "f", None, None, None, "RETURNS TABLE(a INT)")]


def test_texts_without_definitions(spark):
    for text in (None, "", "no sql here", "CREATE TABLE t (a INT", "'" * 3, "CREATE TABLE t ();"):
        for fn in (D.ddl_columns, D.ddl_constraints, D.ddl_views, D.ddl_procedures):
            assert run(spark, fn, text) == []
