"""Outgoing calls and published events in source texts.

A rule finds a call over the whole text, also across lines: its regex has one
group for the URL (or event type) and groups for the verb, if that is written
in the call.  Per text and rule, the pieces between the matches and the matches
themselves are walked once, which gives each match its line.  All of it is
row-local; a text without a rule's literal skips the rule.

Regexes use possessive loops where a repeated group stands, so the Java engine
neither recurses nor backtracks over long minified lines.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlens.operators.extract import rule_needle


@dataclass(frozen=True)
class Rule:
    """``verbs`` are the groups that may hold the verb (the first that does counts), else ``verb``."""

    library: str
    regex: str
    verb: str = "GET"
    url: int = 1
    verbs: tuple[int, ...] = ()
    prefix: str = ""
    fixed_url: str | None = None

    @property
    def re2(self) -> str:
        """The same pattern without possessive marks, for engines that never backtrack."""
        return self.regex.replace("*+", "*")


VERBS = "(Get|Post|Put|Delete|Patch)"
VERBS_JS = "(get|post|put|delete|patch|head|options)"
GENERIC = r"\s*(?:<[^>]+>)?\s*"
# a C# string literal (interpolations may hold quotes), after an optional concatenated prefix
LITERAL = r"\$?[\"']((?:\{[^}]*+\}|[^\"'{}])*+)[\"']"
FIRST = r"\(\s*[\w\s.+]*+" + LITERAL
# a JavaScript string literal, and the verb in an options object after it
JS = r"[\"'`]([^\"'`\n]*+)[\"'`]"
JS_FIRST = GENERIC + r"\(\s*" + JS
JS_METHOD = r"[^{}]*?\bmethod\s*:\s*[\"'`](\w+)"
JS_OPTIONS = r"(?:\s*,\s*\{" + JS_METHOD + ")?"
# not part of a longer name or of a member access on ``$``
ALONE = r"(?m)(?:^|[^\w$\n])"

# Library names and the callees by which each client is known (E-02).
CSHARP_CALL_RULES = (
    Rule("HttpClient", r"\." + VERBS + "Async" + GENERIC + FIRST, url=2, verbs=(1,)),
    Rule("HttpClient.Json", r"\.(Get|Post|Put)(?:From|As)JsonAsync" + GENERIC + FIRST, url=2, verbs=(1,)),
    Rule("ServiceStack", r"\." + VERBS + GENERIC + FIRST, url=2, verbs=(1,)),
    Rule("RestSharp", r"new\s+RestRequest\s*" + FIRST + r"(?:[^)]*?Method\.(\w+))?", verbs=(2,)),
    Rule("Refit", r"\[(Get|Post|Put|Delete)\s*\(\s*" + LITERAL + r"\s*\)\]", url=2, verbs=(1,)),
    Rule("Flurl", LITERAL + r"\s*\.\s*GetAsync"),
    Rule("Flurl", LITERAL + r"\s*\.\s*Post(?:Json|UrlEncoded)Async", verb="POST"),
    Rule("OData", r"\.Execute(?:Async)?" + GENERIC + r"\(\s*new\s+Uri\s*" + FIRST),
    Rule("GenericWrapper", r"(?m)(?:^|[^\w\[\n])Http" + VERBS + r"\w*" + GENERIC + r"\([^)\"']*" + LITERAL, url=2, verbs=(1,)),
    Rule("HttpClient.SendAsync", r"new\s+HttpRequestMessage\s*\(\s*HttpMethod\.(\w+)\s*,\s*" + LITERAL, url=2, verbs=(1,)),
    Rule("Grpc.Net.Client", r"GrpcChannel\.ForAddress\s*\(\s*" + LITERAL, verb="GRPC"),
    Rule("Grpc.Core", r"new\s+(\w+Client)\s*\(\s*channel\s*\)", verb="GRPC", prefix="grpc://"),
    Rule("GraphQL.Client", r"new\s+GraphQLHttpClient\s*\(\s*" + LITERAL, verb="GRAPHQL"),
    Rule("StrawberryShake", r"\.ExecuteAsync\s*<([^>]+)>\s*\(", verb="GRAPHQL", fixed_url="graphql://query"),
    Rule("GraphQL.Client", r"\.SendQueryAsync\s*<([^>]+)>\s*\(", verb="GRAPHQL", fixed_url="graphql://query"),
    Rule("SignalR.Client", r"\.WithUrl\s*\(\s*" + LITERAL, verb="SIGNALR"),
    Rule("SignalR.Client", r"\.(?:InvokeAsync|On)" + GENERIC + r"\(\s*" + LITERAL, verb="SIGNALR", prefix="signalr://"),
    Rule("ClientWebSocket", r"new\s+(ClientWebSocket)\s*\(", verb="WEBSOCKET", fixed_url="ws://connection"),
    Rule("ClientWebSocket", r"ConnectAsync\s*\(\s*new\s+Uri\s*\(\s*" + LITERAL, verb="WEBSOCKET"),
)

# Browser and Node clients (E-03), and the attributes by which a page loads others.
JS_CALL_RULES = (
    Rule("fetch", ALONE + r"(?:[\w.]*\.)?fetch" + JS_FIRST + JS_OPTIONS, verbs=(2,)),
    Rule("axios", r"\baxios(?:\.\w+)?\." + VERBS_JS + JS_FIRST, url=2, verbs=(1,)),
    Rule("axios", r"\baxios\s*\(\s*\{(?:" + JS_METHOD + r")?[^{}]*?\burl\s*:\s*" + JS + "(?:" + JS_METHOD + ")?", url=2,
         verbs=(1, 3)),
    Rule("angular", r"\.http\." + VERBS_JS + JS_FIRST, url=2, verbs=(1,)),
    Rule("vue", r"\$http\." + VERBS_JS + JS_FIRST, url=2, verbs=(1,)),
    Rule("node", r"(?m)(?:^|[^\w$.\n])https?\.(?:get|request)" + JS_FIRST + JS_OPTIONS, verbs=(2,)),
    Rule("got", ALONE + r"got(?:\." + VERBS_JS + ")?" + JS_FIRST, url=2, verbs=(1,)),
    Rule("superagent", r"\b(?:superagent|request)\." + VERBS_JS + JS_FIRST, url=2, verbs=(1,)),
    Rule("swr", r"\buseSWR" + JS_FIRST),
    Rule("nuxt", r"(?m)(?:^|[^\w\n])(?:useFetch|\$fetch)" + JS_FIRST + JS_OPTIONS, verbs=(2,)),
    Rule("html", r"\bhref\s*=\s*\"([^\"]*)\""),
    Rule("html", r"\bsrc\s*=\s*\"([^\"]*)\""),
)

# How events are published and consumed (E-04); the group is the event type.
EVENT_RULES = (
    Rule("MassTransit.Publish", r"\.Publish\s*<([^>]+)>", verb="PUBLISH"),
    Rule("MassTransit.Publish", r"\.Publish\s*\(\s*new\s+([^\s{(]+)", verb="PUBLISH"),
    Rule("MassTransit.PublishBatch", r"\.PublishBatch\s*<([^>]+)>", verb="PUBLISH"),
    Rule("MassTransit.Send", r"\.Send\s*<([^>]+)>", verb="PUBLISH"),
    Rule("MassTransit.Send", r"\.Send\s*\(\s*new\s+([^\s{(]+)", verb="PUBLISH"),
    Rule("MassTransit.Request", r"\.Request\s*<([^>]+)>", verb="PUBLISH"),
    Rule("QueueEvent", r"\.QueueEvent\s*\(\s*(?:new\s+)?(\w+)", verb="PUBLISH"),
    Rule("MassTransit.Consumer", r"IConsumer\s*<\s*(\w+)\s*>", verb="SUBSCRIBE"),
)


def _newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def _hits(text: Column, rule: Rule) -> Column:
    """Array<struct<library, verb, url, line_no>> of a rule's matches in a text."""
    rx = F.lit(rule.regex)
    groups = {"hit": 0, "url": rule.url} | {f"v{i}": g for i, g in enumerate(rule.verbs)}
    zipped = F.arrays_zip(F.split(text, rule.regex, -1).alias("gap"),
                          *(F.regexp_extract_all(text, rx, F.lit(g)).alias(n) for n, g in groups.items()))

    def step(acc: Column, x: Column) -> Column:
        line = acc["line"] + _newlines(x["gap"])
        verb = F.coalesce(*(F.nullif(x[f"v{i}"], F.lit("")) for i in range(len(rule.verbs))), F.lit(rule.verb))
        url = F.lit(rule.fixed_url) if rule.fixed_url else F.concat(F.lit(rule.prefix), x["url"])
        found = F.array(F.struct(F.lit(rule.library).alias("library"), F.upper(verb).alias("verb"), url.alias("url"),
                                 line.alias("line_no")))
        return F.struct((line + F.coalesce(_newlines(x["hit"]), F.lit(0))).alias("line"),
                        F.when(x["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], found)).alias("out"))

    none = F.array().cast("array<struct<library:string,verb:string,url:string,line_no:int>>")
    walked = F.aggregate(zipped, F.struct(F.lit(1).alias("line"), none.alias("out")), step)["out"]
    needle = rule_needle(rule.regex)
    return F.when(F.instr(text, needle) > 0, walked).otherwise(none) if needle else walked


def extract_calls(files: DataFrame, id_col: str, text_col: str, rules) -> DataFrame:
    """E-02 / E-03: one row per call: library, verb, URL, line of its start, dynamic flag."""
    text = F.col(text_col)
    files = files.select(id_col, F.explode(F.array(text)).alias(text_col))  # a projection would be copied into every rule
    needles = [rule_needle(r.regex) for r in rules]
    if all(needles):
        files = files.where(reduce(lambda a, b: a | b, [F.instr(text, n) > 0 for n in sorted(set(needles))]))
    hits = files.select(id_col, F.explode(F.concat(*(_hits(text, r) for r in rules))).alias("h"))
    url = F.col("h.url")
    return hits.select(id_col, "h.line_no", "h.library", F.col("h.verb").alias("http_method"), url.alias("url_pattern"),
                       (url.contains("{") | url.contains("$")).alias("is_dynamic_url"))


def extract_events(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """E-04: published events (library, event type, line) and ``IConsumer<T>`` subscriptions, one row per finding."""
    return extract_calls(files, id_col, text_col, EVENT_RULES).select(
        id_col, "line_no", F.col("library").alias("messaging_library"), F.col("http_method").alias("direction"),
        F.col("url_pattern").alias("event_type_name"))
