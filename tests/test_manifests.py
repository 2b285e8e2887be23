"""E-07: trees of lock files at any depth, hoisting, TOML tables and XML attributes."""

import json

from meshlens.operators import manifests as M


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, content string")


def test_lock_tree_of_any_depth(spark):
    tree = {"version": "0.0.12"}
    for i in range(11, -1, -1):
        tree = {"version": f"0.0.{i}", "dependencies": {f"d{i + 1}": tree}}
    got = M.lock_nodes(files(spark, [("a/package-lock.json", json.dumps({"dependencies": {"d0": tree}}))])).collect()
    assert sorted((r.package, r.version, r.depth) for r in got) == sorted((f"d{i}", f"0.0.{i}", i) for i in range(13))
    assert {r.node: r.parent for r in got}["node_modules/d0/node_modules/d1"] == "node_modules/d0"


def test_requirements_resolve_to_the_nearest_folder(spark):
    packages = {"": {"devDependencies": {"t": "1"}}, "node_modules/a": {"version": "1", "dependencies": {"b": "^1", "c": "*"}},
                "node_modules/a/node_modules/b": {"version": "1.5", "dependencies": {"a": "*", "c": "*", "x": "*"}},
                "node_modules/b": {"version": "2"}, "node_modules/c": {"version": "3"}, "node_modules/t": {"version": "9"}}
    f = files(spark, [("p/package-lock.json", json.dumps({"packages": packages})), ("p/package.json", '{"dependencies": {"no": "1"}}'),
                      ("q/package-lock.json", None), ("r/package-lock.json", "not json")])
    got = {(r.node, r.package): (r.served_by, r.version, r.hoisted) for r in M.lock_requirements(f).collect()}
    a, ab = "node_modules/a", "node_modules/a/node_modules/b"
    assert got == {(a, "b"): (ab, "1.5", False), (a, "c"): ("node_modules/c", "3", True), (ab, "a"): (a, "1", True),
                   (ab, "c"): ("node_modules/c", "3", True), (ab, "x"): (None, None, None)}
    deps = {r.package: (r.is_dev_dependency, r.is_transitive) for r in M.extract_dependencies(f).where("version <> '2'").collect()}
    assert deps == {"a": (False, False), "b": (False, True), "c": (False, False), "t": (True, False)}


def test_toml_and_xml(spark):
    f = files(spark, [
        ("x/Pipfile", '[packages]\n"zope.event" = "==1"\nb = {git = "g"}\n[dev-packages]\nc = "*"\n[requires]\nd = "1"'),
        ("x/pyproject.toml", '[project]\ndependencies = ["a>=1", "b[x,y] == 2 ; python_version > 3"]\n[project.optional-dependencies]\n'
                             'test = ["c"]\n[tool.other]\ndependencies = ["no"]\n[tool.poetry.group.dev.dependencies]\ne = {version = "5"}'),
        ("x/packages.config", '<package version="1" id="old"/>'), ("x/Directory.Build.props", '<PackageReference Version="2" Include="p" PrivateAssets="All"/>'),
        ("x/empty/requirements.txt", None), ("x/other.txt", "a==1")])
    got = {(r.path.split("/")[-1], r.package, r.version, r.version_constraint, r.is_dev_dependency) for r in M.extract_dependencies(f).collect()}
    assert got == {("Pipfile", "zope.event", None, "==1", False), ("Pipfile", "b", None, "*", False), ("Pipfile", "c", None, "*", True),
                   ("pyproject.toml", "a", None, ">=1", False), ("pyproject.toml", "b", "2", "== 2", False), ("pyproject.toml", "c", None, None, True),
                   ("pyproject.toml", "e", None, "5", True), ("packages.config", "old", "1", "1", False),
                   ("Directory.Build.props", "p", "2", "2", True)}
