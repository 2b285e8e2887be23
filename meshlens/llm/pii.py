"""Operator 8, personal data by weak supervision (DataFrame functions only).

Base spans come from four strict patterns (email, ip, card, phone).  Broader patterns add candidates, such as spelled
"(at)" addresses, national phone numbers, IPv6 addresses and card-like groups that fail the check digit.  Five
labelers vote on every span, yes, no or abstain: a regex labeler, a structure labeler (check digit, digit counts), a
gazetteer (top-level domains, dialling codes, card ranges, address ranges) and two context labelers (cue words before
the span, signs of other numbers around it).  Expectation-maximisation over the counts of vote patterns (at most
4 * 3^5 rows, whatever the corpus) estimates the labelers' reliabilities; a logistic regression on its posteriors is
the final span classifier.  Base spans always stay; candidates stay when the classifier gives 0.5 or more.

Positions are code points, end exclusive: a text is split at the pattern's matches, and the lengths of the pieces and
matches add up.  All work on a document stays in its row; only vote patterns are aggregated.  The patterns are written
without nested backtracking, so long runs of digits or letters neither overflow the stack nor take quadratic time.

Cases: null text counts as empty and has no spans; failing matches are dropped without a retry; equal rows get equal
results; without candidates only base spans are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlens.llm.common import Scratch

KINDS = ("email", "ip", "card", "phone")
#: The strict patterns: leftmost matches of the same language as the documented ones, in possessive form.  A local
#: part starts at the last match's end or where no such sign stands before it; elsewhere it can't match either.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
GATE = {"email": "@", "ip": ".", "card": None, "phone": "+"}
BROAD = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+ ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]{1,63}+(?: ?[\[(] ?(?:dot|DOT) ?[\])] ?|\.)[A-Za-z]{2,12}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9 -])[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+.-])\(?0[0-9]{1,4}\)?[ ./-][0-9]{2,5}(?:[ .-][0-9]{2,5}){1,4}(?![0-9])",
}
_BROAD_GATE = {"email": "(?i)[\\[(] ?at ?[\\])]", "ip": "[0-9A-Fa-f]:[0-9A-Fa-f]", "card": "[0-9]{4}[ -][0-9]{4}",
               "phone": "0[0-9]{1,4}\\)?[ ./-][0-9]"}

#: Gazetteers and cue words (fixed values).
TLDS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "it", "eu")
DIALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47",
            "48", "49", "51", "52", "54", "55", "61", "62", "64", "65", "81", "82", "86", "90", "91")
CUES = {
    "email": "mail|contact|write|kontakt|correo|courriel|@|address",
    "ip": "ip|host|server|addr|client|login|from",
    "card": "card|visa|master|credit|pay|karte|carte|tarjeta|amex",
    "phone": "tel|phone|call|fax|mobile|whatsapp|handy|ruf",
}
AGAINST = r"(?i)(?:version|ver\.|isbn|doi|sha|md5|commit|order|id[:=#]|[#=/_])\s*$"

LABELERS = 5
ROUNDS = 30
_CONTEXT = 24


def _spans(text: Column, pattern: str, wanted: Column) -> Column:
    """(s, e, m) of the leftmost non-overlapping matches, where ``wanted`` holds."""
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("m"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        e = s + F.coalesce(F.length(x["m"]), F.lit(0))
        span = F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))
        return F.struct(e.alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], span)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.when(wanted, F.aggregate(pairs, start, step)["out"]).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        d = F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return acc + d
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _small(part: Column) -> Column:
    number = F.regexp_replace(part, "^0+", "")
    return (F.length(number) < 3) | ((F.length(number) == 3) & (number <= "255"))


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, "[.]"), _small)
    if kind == "card":
        d = _digits(m)
        return F.length(d).between(13, 19) & F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, text: Column, x: Column, base: bool) -> list[Column]:
    m, d = x["m"], _digits(x["m"])
    before = F.lower(F.substring(text, F.greatest(x["s"] - _CONTEXT, F.lit(0)) + 1, F.least(x["s"], F.lit(_CONTEXT))))
    after = F.substring(text, x["e"] + 1, F.lit(2))
    tld = F.lower(F.regexp_extract(m, "([A-Za-z]+)$", 1))
    structure = {
        "email": _vote(F.length(tld) >= 2, F.length(tld) == 0),
        "ip": _vote(m.rlike("^[0-9]{1,3}([.][0-9]{1,3}){3}$"), m.rlike("(^|[.])0[0-9]")),
        "card": _vote(F.length(d).between(13, 19) & _luhn(d), ~_luhn(d)),
        "phone": _vote(F.length(d).between(9, 13), ~F.length(d).between(9, 15)),
    }[kind]
    known = {
        "email": _vote(tld.isin(*TLDS), F.length(tld) < 2),
        "ip": _vote(~m.rlike("^(0|255|127)[.]"), m.rlike("^(0|255)[.]")),
        "card": _vote(d.rlike("^[3-6]"), d.rlike("^[0789]")),
        "phone": _vote(F.substring(d, 1, 2).isin(*DIALLING) | F.substring(d, 1, 1).isin("1", "7"), d.rlike("^00?[0-9]?0000")),
    }[kind]
    return [F.lit(1 if base else 0), structure, known, _vote(before.rlike(CUES[kind]), F.lit(False)),
            _vote(F.lit(False), before.rlike(AGAINST) | after.rlike("^[0-9A-Za-z_/%]"))]


def _is_valid(kind: str):
    return lambda x: _valid(kind, x["m"])


def _apart(base: Column):
    """Spans that overlap none of ``base``."""
    return lambda x: ~F.exists(base, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))


def _labelled(i: int, text: Column, base: bool):
    return lambda x: F.struct(F.lit(i).alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.lit(base).alias("base"),
                              F.array(*_votes(KINDS[i], text, x, base)).alias("v"))


def _base_of(i: int):
    return lambda x: x["base"] & (x["k"] == i)


def spans(docs: DataFrame) -> DataFrame:
    """doc_id and ``cands``: all base and candidate spans (k, s, e, base, v: votes) in order."""
    t = F.col("t")
    out = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    parts = []
    for i, kind in enumerate(KINDS):
        gate = t.contains(GATE[kind]) if GATE[kind] else t.rlike("[0-9](?:[ -]?[0-9]){12}")
        strict, broad = f"b_{kind}", f"c_{kind}"
        out = out.withColumn(strict, F.filter(_spans(t, BASE[kind], gate), _is_valid(kind)))
        out = out.withColumn(broad, F.filter(_spans(t, BROAD[kind], t.rlike(_BROAD_GATE[kind])), _apart(F.col(strict))))
        parts += [F.transform(strict, _labelled(i, t, True)), F.transform(broad, _labelled(i, t, False))]
    return out.select("doc_id", F.array_sort(F.concat(*parts)).alias("cands"))


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = ROUNDS) -> dict:
    """Posterior of every (kind, votes) pattern with its count, by expectation-maximisation.

    The latent label of a span is personal data or not; each kind has a prior, each labeler a distribution of votes
    given the label, smoothed by one vote.
    """
    like = [{y: {1: 0.6, 0: 0.3, -1: 0.1} if y else {1: 0.1, 0: 0.3, -1: 0.6} for y in (0, 1)} for _ in range(LABELERS)]
    prior = dict.fromkeys(range(len(KINDS)), 0.7)
    post: dict = {}
    for _ in range(rounds):
        for k, v, _n in patterns:
            one = math.log(prior[k]) + sum(math.log(like[j][1][x]) for j, x in enumerate(v))
            zero = math.log(1 - prior[k]) + sum(math.log(like[j][0][x]) for j, x in enumerate(v))
            post[k, v] = 1 / (1 + math.exp(min(500.0, zero - one)))
        for k in prior:
            own = [(post[k, v], n) for kk, v, n in patterns if kk == k]
            prior[k] = (2 + sum(p * n for p, n in own)) / (3 + sum(n for _, n in own))
        for j in range(LABELERS):
            for y in (0, 1):
                mass = {x: 1 + sum(n * (post[k, v] if y else 1 - post[k, v]) for k, v, n in patterns if v[j] == x)
                        for x in (-1, 0, 1)}
                like[j][y] = {x: m / sum(mass.values()) for x, m in mass.items()}
    return post


def _inputs(k: Column, v: Column) -> Column:
    """The classifier's inputs: the kind, and each labeler's yes and no."""
    return F.concat(F.array(*((k == i).cast("double") for i in range(len(KINDS)))),
                    F.array(*((v[j] == x).cast("double") for j in range(LABELERS) for x in (1, -1))))


def classifier(cands: DataFrame):
    """Column function of (k, v): the final probability that a span is personal data."""
    one = cands.select(F.explode("cands").alias("c"))
    rows = one.groupBy(F.col("c.k").alias("k"), F.col("c.v").alias("v")).count().orderBy("k", "v").collect()
    post = reliabilities([(r["k"], tuple(r["v"]), r["count"]) for r in rows])
    soft = [(r["k"], r["v"], y, float(r["count"]) * (post[r["k"], tuple(r["v"])] if y else 1 - post[r["k"], tuple(r["v"])]))
            for r in rows for y in (1, 0)]
    soft = [x for x in soft if x[3] > 1e-9]
    if {x[2] for x in soft} != {0, 1}:
        return lambda k, v: F.lit(1.0 if any(x[2] for x in soft) else 0.0)
    table = cands.sparkSession.createDataFrame(soft, "k int, v array<int>, label int, weight double")
    fit = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=50, standardization=False).fit(
        table.select(array_to_vector(_inputs(F.col("k"), F.col("v"))).alias("features"),
                     F.col("label").cast("double").alias("label"), "weight"))
    coef = F.array(*(F.lit(float(c)) for c in fit.coefficients))
    return lambda k, v: 1 / (1 + F.exp(-(F.lit(float(fit.intercept)) + F.aggregate(
        F.zip_with(_inputs(k, v), coef, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))))


def _text(xs: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(xs, lambda x: F.concat_ws(":", name[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans and n_added of every row of ``docs``."""
    cands = Scratch(docs.sparkSession).save(spans(docs))
    score = classifier(cands)
    base = F.filter("cands", lambda x: x["base"])
    stays = F.filter("cands", lambda x: x["base"] | (score(x["k"], x["v"]) >= 0.5))
    return cands.select(
        "doc_id",
        *(F.size(F.filter("cands", _base_of(i))).cast("long").alias(f"n_{kind}")
          for i, kind in enumerate(KINDS)),
        F.sha2(_text(base).cast("binary"), 256).alias("base_sha256"), _text(stays).alias("spans"),
        (F.size(stays) - F.size(base)).cast("long").alias("n_added"))
