"""J-20 with receivers and J-22 through aliases and re-exports, on small worked cases."""

from meshlens.operators import resolution as RS

SYMBOLS = "id long, name string, kind string, fqn string, parent_name string, file_id long, repository string"


def test_tiers_of_receiver_calls(spark):
    symbols = spark.createDataFrame([
        (1, "A", "CLASS", "x.A", None, 1, "r"), (2, "run", "METHOD", "x.A.run", "x.A", 1, "r"), (3, "go", "METHOD", "x.A.go", "x.A", 1, "r"),
        (4, "S", "INTERFACE", "y.S", None, 2, "r"), (5, "go", "METHOD", "y.S.go", "y.S", 2, "r"),
        (6, "S", "CLASS", "z.S", None, 3, "r"), (7, "go", "METHOD", "z.S.go", "z.S", 3, "r"), (8, "far", "FUNCTION", "far", None, 3, "r"),
        (9, "far", "FUNCTION", "far", None, 9, "other"), (10, "only", "METHOD", "z.S.only", "z.S", 3, "r")], SYMBOLS)
    calls = spark.createDataFrame([
        ("a", 2, "go", None, 5), ("b", 2, "go", "this", 5), ("c", 2, "only", "s", 5), ("d", 2, "only", "s", 50), ("e", 8, "go", "s", 5),
        ("f", 8, "go", "S", 5), ("g", 2, "far", "q", 5), ("h", 2, "none", "q", 5), ("i", 5, "go", "y.S", 1)],
        "call_id string, caller_id long, callee_name string, receiver string, line long")
    declarations = spark.createDataFrame([
        (1, "s", "S", 1, 1, 100), (1, "s", "y.S", 3, 3, 9), (1, "s", "late", 8, 1, 100), (3, "s", "Missing", 1, 1, 10)],
        "file_id long, name string, type_name string, line long, scope_start long, scope_end long")
    imports = spark.createDataFrame([(1, "z"), (1, "z"), (3, "y")], "file_id long, module string")
    got = {r.call_id: (r.target_id, r.tier, r.type_name) for r in RS.resolve_receiver_calls(calls, symbols, declarations, imports).collect()}
    assert got == {
        "a": (3, 1, None), "b": (3, 1, None),       # own file and parent
        "d": (10, 4, "late"),                        # declared as an unknown type: any callable of the name
        "c": (10, 4, "y.S"),                         # y.S is known by FQN but has no such method
        "e": (3, 4, "Missing"), "f": (5, 3, None),   # y.S through the import of file 3, not z.S
        "g": (8, 4, None), "i": (5, 3, None)}


def test_named_imports_through_cycles(spark):
    symbols = spark.createDataFrame([(1, "a", 10), (2, "b", 11), (3, "b", 12), (4, "c", 13)], "id long, name string, file_id long")
    named = spark.createDataFrame([("own", 10, "a"), ("one", 20, "b"), ("loop", 30, "c"), ("none", 30, "zzz"), ("named", 40, "c"), ("other", 40, "b")],
                                  "import_id string, file_id long, name string")
    reexports = spark.createDataFrame([(20, 11, None), (20, 12, None), (30, 31, None), (31, 30, None), (31, 13, None), (40, 13, "c"), (40, 40, None)],
                                      "file_id long, from_file_id long, name string")
    got = {r.import_id: (r.symbol_id, r.hops) for r in RS.named_import_edges(named, symbols, reexports).collect()}
    assert got == {"own": (1, 0), "one": (2, 1), "loop": (4, 2), "named": (4, 1)}


def test_longest_alias_wins(spark):
    imports = spark.createDataFrame([(1, "f", "@a/b/c"), (2, "f", "@a/x"), (3, "f", "@ab"), (4, "f", "./@a/x"), (5, "f", "p.q.r"), (6, "f", "react"),
                                     (7, "f", "@a")], "import_id long, file_path string, spec string")
    aliases = spark.createDataFrame([("@a", "src"), ("@a/b", "lib"), ("@a/b", "zlib")], "prefix string, target string")
    got = {r.import_id: r.spec for r in RS.apply_aliases(imports, aliases).collect()}
    assert got == {1: "lib/c", 2: "src/x", 3: "@ab", 4: "./@a/x", 5: "p/q/r", 6: "react", 7: "src"}
