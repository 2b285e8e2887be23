"""V-08, V-10 and W-02 over whole texts; a cut only where it is asked for, with a flag."""

import hashlib
import json

from meshlens.operators import relational as R
from meshlens.operators import search

SYMBOLS = ("id long, name string, kind string, fqn string, signature string, parent_name string, start_line int, "
           "end_line int, file_id long, documentation string")


def chunk_inputs(spark):
    rows = [(1, "big", "METHOD", None, "def big()", None, 1, 150, 7, None)]
    rows += [(10 + i, f"callee{i}", "METHOD", None, f"def callee{i}()", None, 151, 151, 7, None) for i in range(8)]
    return (spark.createDataFrame(rows, SYMBOLS),
            spark.createDataFrame([(7, "a.py", "\n".join(f"line {i}" for i in range(151)))], "id long, path string, content string"),
            spark.createDataFrame([(1, 10 + i, "CALLS") for i in range(8)], "src long, dst long, type string"))


def chunk_text(lines, calls):
    return "\n".join(["File: a.py", "", "def big()", *(f"line {i}" for i in range(lines)),
                      "\n// Calls: " + ", ".join(f"callee{i}" for i in range(calls))])


def test_symbol_of_150_lines_and_8_callees(spark):
    whole = {r.id: r for r in search.symbol_chunks(*chunk_inputs(spark)).collect()}
    assert len(whole) == 9
    assert whole[1].content_hash == hashlib.sha256(chunk_text(150, 8).encode()).hexdigest()
    assert whole[1].char_count == len(chunk_text(150, 8)) and whole[1].word_count == len(chunk_text(150, 8).split())
    cut = {r.id: r for r in search.symbol_chunks(*chunk_inputs(spark), 100, 5).collect()}
    assert cut[1].content_hash == hashlib.sha256(chunk_text(100, 5).encode()).hexdigest()
    assert [i for i, r in cut.items() if r.body_cut] == [i for i, r in cut.items() if r.calls_cut] == [1]
    exact = {r.id: r for r in search.symbol_chunks(*chunk_inputs(spark), 150, 8).collect()}
    assert exact[1].content_hash == whole[1].content_hash and not exact[1].body_cut and not exact[1].calls_cut


def test_long_names_and_return_types(spark):
    parsed = [(1, json.dumps({"name": "n", "fully_qualified_name": "f" * 3000, "return_type": "r" * 1500})),
              (2, json.dumps({"name": "n"}))]
    df = spark.createDataFrame(parsed, "id long, j string")
    whole = {r.id: r for r in search.build_symbol_rows(df, "id", "j").collect()}
    assert (whole[1].fqn, whole[1].return_type, whole[2].fqn) == ("f" * 3000, "r" * 1500, "n")
    cut = {r.id: r for r in search.build_symbol_rows(df, "id", "j", 2000, 1000).collect()}
    assert (len(cut[1].fqn), len(cut[1].return_type), cut[1].fqn_cut, cut[1].return_type_cut) == (2000, 1000, True, True)
    assert (cut[2].fqn_cut, cut[2].return_type_cut) == (False, False)


def test_long_first_chunk(spark):
    df = spark.createDataFrame([(1, 0, "x" * 5000), (1, 1, "y"), (2, 0, "z"), (3, 0, None)], "k long, o int, t string")
    assert {r.k: r.snippet for r in R.first_chunk(df, "k", "o", "t").collect()} == {1: "x" * 5000, 2: "z", 3: None}
    cut = {r.k: (r.snippet, r.snippet_cut) for r in R.first_chunk(df, "k", "o", "t", 2000).collect()}
    assert cut == {1: ("x" * 2000 + "...", True), 2: ("z", False), 3: (None, False)}


def test_imports_and_documentation_chunk(spark):
    symbols = spark.createDataFrame([(1, "f", "FUNCTION", "ns.f", "def f()", None, 1, 1, 7, "What f does."),
                                     (2, "g", "FUNCTION", None, None, None, None, None, 7, "")], SYMBOLS)
    files = spark.createDataFrame([(7, "a.py", "body")], "id long, path string, content string")
    edges = spark.createDataFrame([], "src long, dst long, type string")
    imports = spark.createDataFrame([(7, f"m{i}") for i in range(8)] + [(7, "m0"), (9, "other")], "file_id long, name string")
    got = {(r.id, r.content_type): r.content_hash for r in search.symbol_chunks(symbols, files, edges, imports=imports).collect()}
    listed = "Imports: " + ", ".join(f"m{i}" for i in range(8))
    want = {(1, "code"): f"File: a.py\nNamespace: ns\n{listed}\n\ndef f()\nbody", (2, "code"): f"File: a.py\n{listed}\n",
            (1, "documentation"): "f (FUNCTION)\nFile: a.py\nNamespace: ns\n\nWhat f does."}
    assert got == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}
