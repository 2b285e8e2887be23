"""The reference's worked examples (FIXTURES.md §2) as tiny-DataFrame cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from meshlens.functions import code as X
from meshlens.functions.jsonflat import flatten_json, strip_json_comments
from meshlens.functions.text import mask
from meshlens.functions.urls import normalize_url
from meshlens.operators import aggregates as A
from meshlens.operators import extract as E
from meshlens.operators import graph as G
from meshlens.operators import linking as L
from meshlens.operators import relational as R
from meshlens.operators import search as S


def one(df, col):
    return [r[col] for r in df.collect()]


def test_x03_normalize_url(spark):
    df = spark.createDataFrame([("/api/users/{id}",), ("/api/users/:id",), ("/api/users/123",), ("/api/users/",)], "u string")
    assert one(df.select(normalize_url(F.col("u")).alias("n")), "n") == ["api/users/*"] * 3 + ["api/users"]


def test_x05_sequence_ratio(spark):
    df = spark.createDataFrame([("/api/users/list", "/api/users/all"), ("/api/users", "/api/completely/different")],
                               "a string, b string")
    r = one(df.select(L.sequence_ratio(normalize_url(F.col("a")), normalize_url(F.col("b"))).alias("r")), "r")
    assert r[0] > 0.7 and r[1] < 0.5


def test_x06_http_method_matches(spark):
    rows = [("GET", "GetAllUsers"), ("GET", "FetchUserById"), ("POST", "CreateNewUser"), ("DELETE", "RemoveUser")]
    df = spark.createDataFrame(rows, "m string, name string")
    out = df.select(L.http_method_matches(F.col("m"), F.lit(""), F.lit(None).cast("string"), F.col("name")).alias("ok"))
    assert one(out, "ok") == [True] * 4
    # a declared, different method and no name hint → no match
    neg = spark.createDataFrame([("POST", "GET", "Users")], "m string, em string, name string")
    assert one(neg.select(L.http_method_matches(F.col("m"), F.col("em"), F.lit(None).cast("string"),
                                                F.col("name")).alias("ok")), "ok") == [False]


@pytest.mark.parametrize("key,pattern,expected", [
    ("user.created", "user.*", True), ("user.created.event", "user.*", False), ("user", "user.#", True),
    ("a.b.c", "#.c", True), ("a.b.c", "a.#.c", True), ("a.c", "a.#.c", True), ("x", "#", True)])
def test_x09_routing_key(spark, key, pattern, expected):
    df = spark.createDataFrame([(key, pattern)], "k string, p string")
    assert one(df.select(L.routing_key_matches(F.col("k"), F.col("p")).alias("m")), "m") == [expected]


def _resolve(spark, route, path):
    r = dict(is_regex=False) | route
    rules = L.compile_routes(spark.createDataFrame(
        [(1, r["gateway_type"], r["downstream"], r["upstream"], 0, r["is_regex"])],
        "id long, gateway_type string, downstream string, upstream string, priority int, is_regex boolean"))
    calls = spark.createDataFrame([(1, path)], "id long, path string")
    out = L.resolve_gateway(calls, rules).collect()
    return out[0]["resolved_path"] if out else None


def test_nginx_locations(spark):
    from meshlens.operators import configs as C
    text = """# location /old { proxy_pass http://gone; }
server {
  location = /exact { proxy_pass http://a:81; }
  location ~* ^/x/(.*)$ { if ($a) { set $b 1; } proxy_pass https://b.c/y/$1; }
  location /de{ proxy_set_header location x; proxy_pass http://d/e/; } # tail
  location /none { return 200; }
  location /outer { root /r; location /inner { proxy_pass http://in:9; } }
}"""
    rows = C.nginx_routes(spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string"), "id", "text").collect()
    assert sorted((r.modifier, r.downstream_path, r.upstream_host, r.upstream_port, r.upstream_path) for r in rows) == [
        ("", "/de", "d", None, "/e/"), ("", "/inner", "in", 9, "/"), ("=", "/exact", "a", 81, "/"),
        ("~*", "^/x/(.*)$", "b.c", None, "/y/$1")]


def test_sections_blocks_and_json_are_whole(spark):
    from meshlens.functions.jsonflat import flatten_json
    from meshlens.operators import extract as E
    from meshlens.operators import relational as R
    text = "# head\n" + "\n".join(f"line {i}" for i in range(1, 80)) + "\nneedle\n```py\n" + "x\n" * 90 + "```\n## next\n#notahead\nz"
    d = spark.createDataFrame([(1, text), (2, "no heads"), (3, None), (4, "")], "id long, text string")
    sec = sorted(E.doc_sections(d, "id", "text").collect(), key=lambda r: r.start_line)
    assert [(r.title, r.level, r.start_line) for r in sec] == [("head", 1, 1), ("next", 2, 174)]
    assert "needle" in sec[0].content and sec[0].end_line == 173 and sec[1].content == ""
    (b,) = E.code_blocks(d, "id", "text").collect()
    assert (b.start_line, b.end_line, b.language, b.line_count, b.code) == (82, 173, "py", 90, "\n".join(["x"] * 90))
    sym = E.doc_sections(d, "id", "text").selectExpr("id", "'DOCUMENT_SECTION' as kind", "title as name",
                                                     "content as documentation", "title as signature")
    assert R.doc_search(sym, "needle").count() == 1
    deep = '{"a":' * 30 + '[1, {"b": "x{[\\"}"}, [], {}, null]' + "}" * 30
    got = {(r.key, r.value) for r in flatten_json(spark.createDataFrame([(1, deep), (2, None), (3, "5")], "id long, j string"),
                                                  "id", "j").collect()}
    stem = ":".join("a" * 30)
    assert got == {(f"{stem}:0", "1"), (f"{stem}:1:b", 'x{["}'), (f"{stem}:4", None)}


def test_j14_gateway(spark):
    assert _resolve(spark, dict(gateway_type="nginx", downstream="/de", upstream="/german/"), "/developers/x") == "/german/velopers/x"
    assert _resolve(spark, dict(gateway_type="nginx", downstream="/de/", upstream="/german/"), "/developers/x") is None
    assert _resolve(spark, dict(gateway_type="ocelot", downstream="/api/{everything}", upstream="/{everything}"),
                    "/api/users/123/orders") == "/users/123/orders"
    assert _resolve(spark, dict(gateway_type="ocelot", downstream="/api/users/{userId}/orders/{orderId}",
                                upstream="/orders/{orderId}/user/{userId}"),
                    "/api/users/42/orders/99") == "/orders/99/user/42"
    assert _resolve(spark, dict(gateway_type="nginx", downstream=r"^/api/v(\d+)/(.+)$",
                                upstream="/backend/$2?version=$1", is_regex=True),
                    "/api/v2/users/123") == "/backend/users/123?version=2"
    assert _resolve(spark, dict(gateway_type="nginx", is_regex=True,
                                downstream=r"^/(.)/(.)/(.)/(.)/(.)/(.)/(.)/(.)/(.)/(.)/(.)/(.+)$",
                                upstream="/out/$12/$1"), "/a/b/c/d/e/f/g/h/i/j/k/final") == "/out/final/a"
    assert _resolve(spark, dict(gateway_type="nginx", downstream="/api/", upstream="/backend/"),
                    "/api/users/123") == "/backend/users/123"


def test_j12_scores(spark):
    calls = spark.createDataFrame([(1, "/api/users", "GET")], "id long, path string, http_method string")
    eps = spark.createDataFrame([(10, "api/users", "GET")], "id long, route string, http_method string")
    r = L.link_calls_to_endpoints(calls, eps).collect()
    assert r[0]["score"] == pytest.approx(0.9) and r[0]["match_method"] == "exact"
    resolved = spark.createDataFrame([(1, "/api/users")], "id long, resolved_path string")
    r = L.link_calls_to_endpoints(calls, eps, resolved).collect()
    assert r[0]["score"] == pytest.approx(1.0) and r[0]["match_method"] == "gateway_resolved"


def test_x02_keyword_score(spark):
    df = spark.createDataFrame([("test", None, None, None), ("test_function", None, None, None)],
                               "name string, fqn string, signature string, documentation string")
    s = one(df.select(S.keyword_score("test").alias("s")), "s")
    assert s[0] >= 10 and s[1] >= 5


def test_v01_ties_by_name(spark):
    df = spark.createDataFrame([(1, "b_test", None, None, None), (2, "a_test", None, None, None)],
                               "id long, name string, fqn string, signature string, documentation string")
    assert one(S.keyword_search(df, "test", 10), "name") == ["a_test", "b_test"]


def test_v02_best_chunk_per_symbol(spark):
    q = [1.0, 0.0]
    rows = [(7, [0.7, (1 - 0.49) ** 0.5]), (7, [0.9, (1 - 0.81) ** 0.5]), (7, [0.8, 0.6])]
    df = spark.createDataFrame(rows, "symbol_id long, vector array<double>")
    out = S.vector_search(df, F.array(*[F.lit(x) for x in q]), 10, 0.5).collect()
    assert len(out) == 1 and out[0]["score"] == pytest.approx(0.9)


def test_v04_rrf_sums_same_id(spark):
    a = spark.createDataFrame([(5, 1), (6, 2)], "symbol_id long, rank long")
    b = spark.createDataFrame([(5, 1)], "symbol_id long, rank long")
    out = {r["symbol_id"]: r["score"] for r in S.reciprocal_rank_fusion([a, b], 10).collect()}
    assert len(out) == 2 and out[5] == pytest.approx(2 / 61, abs=1e-9)


def test_x27_flatten_json(spark):
    doc = '{"Section": {"SubSection": {"Key": "v"}, "Array": [1, 2, 3]}, "Flag": true, "Nothing": null, "E": {}}'
    df = spark.createDataFrame([(1, doc)], "id long, j string")
    got = {r["key"]: (r["value"], r["type"]) for r in flatten_json(df, "id", "j").collect()}
    assert got["Section:SubSection:Key"] == ("v", "string")
    assert [got[f"Section:Array:{i}"][0] for i in range(3)] == ["1", "2", "3"]
    assert got["Flag"] == ("true", "boolean") and got["Nothing"] == (None, "string")
    assert not any(k.startswith("E") for k in got)


def test_e06_config_secrets_and_comments(spark):
    text = ('{\n  // comment\n  "ConnectionStrings": {"Default": "Server=x;Password=y"},\n'
            '  /* block */ "SecretKey": "abc", "Url": "http://a//b", "Items": [1, 2,],\n}')
    df = spark.createDataFrame([(1, text, "appsettings.Development.json")], "id long, text string, name string")
    rows = {r["config_key"]: r for r in E.extract_config(df, "id", "text", "name").collect()}
    assert rows["ConnectionStrings:Default"]["config_value"] == "***"
    assert rows["ConnectionStrings:Default"]["is_secret"] == 1
    assert rows["SecretKey"]["config_value"] == "***"
    assert rows["Url"]["config_value"] == "http://a//b"
    assert rows["Items:1"]["config_value"] == "2"
    assert rows["Url"]["environment"] == "development"
    cleaned = df.select(strip_json_comments(F.col("text")).alias("c")).collect()[0]["c"]
    assert "//" not in cleaned.replace("http://a//b", "")


def test_x19_base_types(spark):
    df = spark.createDataFrame([("class MyClass : BaseClass, IInterface1, IInterface2",),
                                ("class A extends B implements C, D {",)], "s string")
    got = one(df.select(X.base_types(F.col("s")).alias("b")), "b")
    assert got[0] == ["BaseClass", "IInterface1", "IInterface2"]
    assert got[1] == ["B", "C", "D"]


def test_a13_god_class_confidence(spark):
    rows = [(1, "Big", "CLASS", "Big", None)] + [(i + 2, f"m{i}", "METHOD", f"Big.m{i}", "Big") for i in range(50)]
    df = spark.createDataFrame(rows, "id long, name string, kind string, fqn string, parent_name string")
    out = A.god_classes(df).collect()
    assert out[0]["members"] == 50 and out[0]["confidence"] == pytest.approx(1.0)


def test_g07_cycles(spark):
    def edges(pairs):
        return spark.createDataFrame([(a, b, "IMPORTS") for a, b in pairs], "src long, dst long, type string")
    assert [tuple(r) for r in G.cycles_2(edges([(1, 2), (2, 1)])).collect()] == [(1, 2)]
    assert [tuple(r) for r in G.cycles_3(edges([(1, 2), (2, 3), (3, 1)])).collect()] == [(1, 2, 3)]
    assert G.cycles_2(edges([(1, 2), (2, 3)])).count() == 0
    assert G.cycles_3(edges([(1, 2), (2, 3), (1, 3)])).count() == 0
    scc = {r["id"] for r in G.strongly_connected(edges([(1, 2), (2, 3), (3, 1), (3, 4)])).collect()}
    assert scc == {1, 2, 3}


def test_a14_module_stats(spark):
    files = spark.createDataFrame([
        (1, "src/api/a.py", 100, "PYTHON"), (2, "src/api/b.py", 150, "PYTHON"),
        (3, "src/api/v1/c.py", 10, "PYTHON"), (4, "src/main.py", 5, "PYTHON")],
        "id long, path string, line_count long, language string").withColumn("repository", F.lit("r"))
    syms = spark.createDataFrame([], "id long, file_id long")
    out = {r["path"]: r for r in A.module_stats(files, syms, max_depth=2).collect()}
    assert out["src/api"]["file_count"] == 2 and out["src/api"]["line_count"] == 250
    assert "src/api/v1" not in out


def test_a15_project_map(spark):
    files = spark.createDataFrame([(1, "src/a.py", 30, "PYTHON"), (2, "src/b.py", 50, "PYTHON")],
                                  "id long, path string, line_count long, language string").withColumn("repository", F.lit("r"))
    out = {r["path"]: r for r in A.project_map(files, 2).collect()}
    assert out["src"]["file_count"] == 2 and out["src"]["line_count"] == 80
    assert out["src"]["dominant_language"] == "python"


def test_x24_format_size(spark):
    df = spark.createDataFrame([(500,), (2048,), (1048576,)], "b long")
    assert one(df.select(A.format_size(F.col("b")).alias("s")), "s") == ["500.0 B", "2.0 KB", "1.0 MB"]


def test_x12_layer(spark):
    df = spark.createDataFrame([("UserController", None, "", "CLASS"), ("UserManager", None, "", "CLASS"),
                                ("Thing", None, "app/models/thing.py", "CLASS"), ("Thing", None, "", "CLASS")],
                               "name string, parent string, path string, kind string")
    got = one(df.select(X.layer(F.col("name"), F.col("parent"), F.col("path"), F.col("kind")).alias("l")), "l")
    assert got == ["Controller", "Service", "Model", "Unknown"]


def test_j18_deepest_project(spark):
    projects = spark.createDataFrame([(1, "src/ProjectA/ProjectA.csproj"), (2, "src/ProjectB/ProjectB.csproj"),
                                      (3, "tests/ProjectA.Tests/ProjectA.Tests.csproj")], "id long, project_path string")
    files = spark.createDataFrame([(1, "src/ProjectA/ClassA.cs"), (2, "src/ProjectA/Services/UserService.cs"),
                                   (3, "src/ProjectB/ClassB.cs"), (4, "tests/ProjectA.Tests/ClassATests.cs"),
                                   (5, "README.md")], "id long, path string")
    got = {r["id"]: r["project_id"] for r in R.assign_files_to_projects(files, projects).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 3, 5: None}


def test_v06_chunk_overlap(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, text)], "id long, text string")
    chunks = sorted(E.chunk_words(df, "id", "text", size=10, overlap=2).collect(), key=lambda r: r["chunk_no"])
    assert len(chunks) > 1
    assert chunks[0]["chunk"].split()[-2:] == chunks[1]["chunk"].split()[:2]


def test_x22_mask(spark):
    df = spark.createDataFrame([("sk_test_1234567890",), ("abc",)], "s string")
    assert one(df.select(mask(F.col("s")).alias("m")), "m") == ["sk_t**********7890", "***"]


def test_dq03_spans(spark):
    text = 'x password = "hunter2" y'
    df = spark.createDataFrame([(1, text)], "id long, text string")
    r = E.scan_secrets(df, "id", "text").collect()
    assert r[0]["type"] == "password" and text[r[0]["start"]:r[0]["end"]] == 'password = "hunter2"'


def _calls(spark, text, rules):
    from meshlens.operators import calls as K
    rows = K.extract_calls(spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, t string"), "id", "t", rules).collect()
    assert all(r.id == 1 for r in rows)
    return sorted((r.line_no, r.library, r.http_method, r.url_pattern, r.is_dynamic_url) for r in rows)


CLIENT_CALLS = [
    ('x.GetAsync(\n  "/api/users")', (1, "HttpClient", "GET", "/api/users", False)),
    ('\n\nclient.GetAsync(baseUrl + "/api/users");', (3, "HttpClient", "GET", "/api/users", False)),
    ('c.PostAsync("api/" + "v1" + "/users", b);', (1, "HttpClient", "POST", "api/", False)),
    ('c.GetAsync($"api/{config["v1"]}/{o.Id()}/d");', (1, "HttpClient", "GET", 'api/{config["v1"]}/{o.Id()}/d', True)),
    ('c.PutAsJsonAsync<T>("u", x)', (1, "HttpClient.Json", "PUT", "u", False)),
    ('s.Delete<Dto>("d/1")', (1, "ServiceStack", "DELETE", "d/1", False)),
    ('new RestRequest("r", Method.POST)', (1, "RestSharp", "POST", "r", False)),
    ('new RestRequest("r")', (1, "RestSharp", "GET", "r", False)),
    ('[Put("/p/{id}")]', (1, "Refit", "PUT", "/p/{id}", True)),
    ('"f".PostUrlEncodedAsync(x)', (1, "Flurl", "POST", "f", False)),
    ('k.Execute<T>(new Uri("odata/x"))', (1, "OData", "GET", "odata/x", False)),
    ('_api.HttpGet<User>("api/users/1");\n[HttpGet("route")]', (1, "GenericWrapper", "GET", "api/users/1", False)),
    ('new HttpRequestMessage(HttpMethod.Get, "api/test")', (1, "HttpClient.SendAsync", "GET", "api/test", False)),
    ('new GreeterClient(channel)', (1, "Grpc.Core", "GRPC", "grpc://GreeterClient", False)),
    ('GrpcChannel.ForAddress("https://l:5001")', (1, "Grpc.Net.Client", "GRPC", "https://l:5001", False)),
    ('await c.ExecuteAsync<R>(q)', (1, "StrawberryShake", "GRAPHQL", "graphql://query", False)),
    ('conn.On("Got", (u) => {})', (1, "SignalR.Client", "SIGNALR", "signalr://Got", False)),
    ('ws.ConnectAsync(new Uri("ws://s"), t)', (1, "ClientWebSocket", "WEBSOCKET", "ws://s", False)),
    ('var x = Get(1); // "nothing"', None),
]


def test_client_calls(spark):
    from meshlens.operators import calls as K
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CLIENT_CALLS)], "id long, t string")
    got = sorted((r.id, r.line_no, r.library, r.http_method, r.url_pattern, r.is_dynamic_url)
                 for r in K.extract_calls(df, "id", "t", K.CSHARP_CALL_RULES).collect())
    assert got == [(i, *want) for i, (_, want) in enumerate(CLIENT_CALLS) if want]


def test_js_calls(spark):
    from meshlens.operators.calls import JS_CALL_RULES as J
    text = """fetch('/a');
const r = await fetch("/b", {
  headers: h, method: 'POST' });
axios.patch(`/c/${id}`);
axios({ method: 'delete', url: '/d' }); axios({ url: '/e' })
this.http.put<T>('/f', x); this.$http.get('/g'); https.request('/h', { method: 'PUT' });
got('/i'); got.post('/j'); superagent.get('/k'); useSWR('/l'); $fetch('/m', { method: 'PATCH' });
prefetch('/no'); map.get('/no');"""
    assert _calls(spark, text, J) == [
        (1, "fetch", "GET", "/a", False), (2, "fetch", "POST", "/b", False), (4, "axios", "PATCH", "/c/${id}", True),
        (5, "axios", "DELETE", "/d", False), (5, "axios", "GET", "/e", False), (6, "angular", "PUT", "/f", False),
        (6, "node", "PUT", "/h", False), (6, "vue", "GET", "/g", False), (7, "got", "GET", "/i", False),
        (7, "got", "POST", "/j", False), (7, "nuxt", "PATCH", "/m", False), (7, "superagent", "GET", "/k", False),
        (7, "swr", "GET", "/l", False)]


def test_events(spark):
    from meshlens.operators import calls as K
    text = "class H : IConsumer<Made> {\n bus.Publish<Done>(m); r.QueueEvent(CreateMessage(x));\n b.Publish(\n new Gone{}); }"
    rows = K.extract_events(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t").collect()
    assert sorted((r.line_no, r.direction, r.event_type_name) for r in rows) == [
        (1, "SUBSCRIBE", "Made"), (2, "PUBLISH", "CreateMessage"), (2, "PUBLISH", "Done"), (3, "PUBLISH", "Gone")]


def test_orphan_edges_with_null_type_and_ends(spark):
    from meshlens.operators import relational as R
    edges = spark.createDataFrame([(1, 2, None), (1, 9, "A"), (None, 2, "B"), (1, 9, "A")], "src long, dst long, type string")
    symbols = spark.createDataFrame([(1,), (2,), (2,)], "id long")
    got = sorted(map(str, map(tuple, R.orphan_edges(edges, symbols).collect())))
    assert got == sorted(map(str, [(1, 9, "A"), (1, 9, "A"), (None, 2, "B")]))
