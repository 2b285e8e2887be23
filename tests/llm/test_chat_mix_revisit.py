"""Operators 2, 3 and 7 against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from meshlens.llm import mixing
from meshlens.llm.chat_rotation import rotate
from meshlens.llm.warc_revisit import PERMITTED, canonical_url, resolve_revisits

TURNS = "conv_id long, turn int, speaker string, is_system boolean, text string, part int, rendered string"


def turns():
    rows = [(1, 0, "sys", True, "Be kind."), (1, 1, "ann", False, "hi"), (1, 2, "bob", False, None),
            (1, 3, "ann", False, "x" * 200000), (1, 3, "cy", False, "\U0001F600 tie"), (1, 3, "cy", False, "\U0001F600 tie"),
            (2, 0, "sys", True, "alone"), (3, None, None, None, "who"), (None, 1, "ann", False, "no id"), (4, 0, "bob", False, "")]
    rows += [(5, i, ("ann", "bob", "cy")[i % 3], i % 50 == 20, f"turn {i}") for i in range(300)]
    rows += [(6, None if i % 2 else 4, ("ann", "bob")[i % 3 == 0], False, f"equal {i % 40}") for i in range(90)]
    rows += [(7, 1, "ann", False, "the same")] * 70
    return [r + (7, "clash") for r in rows]


def whole(rows, me):
    """The rendering of a whole dialogue, its mask, and (size, targets, system turn so far) after every turn."""
    text, mask, after, system = "", [], [], None
    order = sorted(rows, key=lambda r: (r[0], r[1], r[2], hashlib.md5(r[3].encode()).hexdigest()))
    for _, s, y, x in order:
        text += "<|system|>\n" if y else "<|assistant|>\n" if s == me else f"<|user name={s}|>\n"
        if s == me and not y:
            mask.append(f"{len(text)}:{len(text) + len(x)}")
        text += x + "<|end|>\n"
        system = x if y else system
        after.append((len(text), len(mask), system))
    return text, mask, after


@pytest.mark.parametrize("size", [16, 256, 1000])
def test_rotation(spark, size):
    got = rotate(spark.createDataFrame(turns(), TURNS).repartition(5), size).collect()
    convs, parts = defaultdict(list), defaultdict(list)
    for c, t, s, y, x, *_ in turns():
        convs[c].append((t or 0, s or "unknown", bool(y), x or ""))
    for r in got:
        parts[r.conv_id, r.participant].append(r)
    assert set(parts) == {(c, s) for c, rows in convs.items() for _, s, y, _ in rows if not y}
    for (c, me), mine in parts.items():
        mine.sort(key=lambda r: r.part)
        text, mask, after = whole(convs[c], me)
        assert "".join(r.rendered for r in mine) == text
        assert ",".join(filter(None, (r["mask"] for r in mine))) == ",".join(mask)
        at = 0
        for k, r in enumerate(mine):
            begin, targets, system = after[at - 1] if at else (0, 0, None)
            at += r.n_turns
            assert (r.part, r.start, r.n_targets) == (k, begin, after[at - 1][1] - targets)
            assert r.n_turns == min(size, len(convs[c]) - k * size)
            assert r.context == ("" if system is None else f"<|system|>\n{system}<|end|>\n")
            assert r.rendered_sha256 == hashlib.sha256(r.rendered.encode()).hexdigest()


def test_rotation_of_nothing(spark):
    assert rotate(spark.createDataFrame([], TURNS)).collect() == []


def python_mix(rows, sweeps=mixing.SWEEPS, targets=None):
    cells = Counter()
    for _, s, la, t, n in rows:
        cells[s, la, t] += n
    goal = [defaultdict(float) for _ in range(3)]
    for d in range(3):
        for c, n in cells.items():
            goal[d][c[d]] += n
        goal[d] = targets[d] if targets and d in targets else {v: n ** mixing.EXPONENT for v, n in goal[d].items()}
    w = {c: float(n) for c, n in cells.items()}
    for _ in range(sweeps):
        for d in range(3):
            total = Counter()
            for c, x in w.items():
                total[c[d]] += x
            w = {c: x * goal[d].get(c[d], 0) / total[c[d]] if total[c[d]] else 0.0 for c, x in w.items()}
    ratio = {c: w[c] / n if n else 0.0 for c, n in cells.items()}
    top = max(ratio.values()) or 1.0
    return {c: r / top for c, r in ratio.items()}, w, ratio


def calibrated(ratio, cells, share):
    """min(1, lambda * ratio) with lambda found by bisection."""
    budget, lo, hi = share * sum(cells.values()), 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(1, mid * r) * cells[c] for c, r in ratio.items()) < budget else (lo, mid)
    return {c: min(1, hi * r) for c, r in ratio.items()}


def described(odd):
    out = []
    for r in odd.select("doc_id", "text", "source", "lang").collect():
        ws = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        hits = [sum(bool(re.match(f"[{letters}]", x)) for x in ws) for letters in mixing.TOPICS.values()]
        out.append((r.doc_id, r.source or "unknown", r.lang or "unknown", f"t{hits.index(max(hits))}", len(ws)))
    return out


@pytest.mark.filterwarnings("ignore:mixing")
@pytest.mark.parametrize("share", [None, 0.65])
def test_mixing(odd, monkeypatch, share):
    monkeypatch.setattr(mixing, "TOLERANCE", 1.0)  # one round of sweeps
    rows = described(odd)
    p, _, ratio = python_mix(rows)
    if share:
        cells = Counter()
        for _, *c, n in rows:
            cells[tuple(c)] += n
        p = calibrated(ratio, cells, share)
    got = mixing.mix(odd, share=share).collect()
    assert Counter((r.doc_id, r.source, r.lang, r.topic, r.n_tokens) for r in got) == Counter(rows)
    for r in got:
        assert r.probability == pytest.approx(p[r.source, r.lang, r.topic], abs=1e-8)
        draw = int(hashlib.md5(("null" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:13], 16) / 2 ** 52
        assert r.kept == (draw < r.probability)
    out = mixing.sample(odd, share=share)
    assert out.columns == odd.columns and out.count() == sum(r.kept for r in got)


def test_raked_marginals_meet_given_targets(spark):
    rng = random.Random(2)
    cells = [(f"s{i}", f"l{j}", f"t{k}", rng.randrange(1, 10 ** 6)) for i in range(6) for j in range(3) for k in range(2)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    share = {"source": {f"s{i}": (i + 1) / 21 for i in range(6)}, "lang": {"l0": 0.5, "l1": 0.3, "l2": 0.2},
             "topic": {"t0": 0.4, "t1": 0.6}}
    targets = {d: spark.createDataFrame(list(v.items()), "value string, share double") for d, v in share.items()}
    got = mixing.rake(df, targets, sweeps=8).collect()
    for d, want in share.items():
        sums = Counter()
        for r in got:
            sums[r[d]] += r.w
        for v, s in want.items():
            assert sums[v] / sum(sums.values()) == pytest.approx(s, abs=1e-3)


def test_mixing_of_nothing(none):
    assert mixing.mix(none).collect() == [] and mixing.sample(none).collect() == []


RECORDS = ("record_id long, url string, ts long, kind string, etag string, modified string, headers map<string,string>, "
           "bucket long, base string, outcome string")


def records():
    rng = random.Random(4)
    urls = ["http://a.org/x", "https://www.A.org:443/x/", "http://a.org/x?utm_source=q#f", "http://m.a.org/x/index.html",
            "http://a.org/x?b=2&a=1", "http://a.org/x?a=1&b=2&ref=z", "http://b.org", "http://b.org/", None]
    rows = []
    for i in range(400):
        kind = "response" if rng.random() < 0.4 else "revisit"
        tag = rng.choice([None, '"1"', 'W/"1"', '"2"'])
        when = rng.choice([None, "mon", "tue"])
        headers = rng.choice([None, {"date": f"d{i}", "server": f"s{i}"}, {"etag": tag or "-", "content-length": str(i)}])
        url = urls[0] if i % 3 == 0 else rng.choice(urls)
        rows.append((i, url, None if i % 50 == 0 else rng.randrange(0, 300), kind, tag, when, headers, 1, "clash", "clash"))
    return rows


def python_url(u):
    if u is None:
        return None
    u = re.sub("^[A-Za-z][A-Za-z0-9+.-]*://", "", re.sub("#.*$", "", u))
    m = re.match("([^/?]*)([^?]*)(?:[?](.*))?$", u)
    host = re.sub("^(www|m)[.]", "", re.sub(":[0-9]*$", "", m[1]).lower())
    path = re.sub("/+$", "", re.sub("(/index)?[.]html?$", "", m[2]))
    query = sorted(p for p in (m[3] or "").split("&")
                   if p and not re.match("(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)", p))
    return host + path + ("?" + "&".join(query) if query else "")


@pytest.mark.parametrize("bucket", [1, 37, 4096])
def test_revisits(spark, bucket):
    rows = records()
    got = {r.record_id: r for r in resolve_revisits(spark.createDataFrame(rows, RECORDS), bucket).collect()}
    assert len(got) == len(rows)
    # a null time falls into the bucket of 0 and sorts before it
    when = lambda r: (0 if r[2] is None else r[2] // bucket, -1 if r[2] is None else r[2], r[0])
    for r in rows:
        key, mine = python_url(r[1]), got[r[0]]
        assert mine.url_key == key
        own, merged = r[6] or {}, dict(r[6] or {})
        if r[3] == "response":
            want, ref = "response", r[0]
        else:
            past = [x for x in rows if x[3] == "response" and key is not None and python_url(x[1]) == key and when(x) < when(r)]
            base = max(past, key=when, default=None)
            want, ref = "unresolved", None
            if base:
                plain = lambda t: re.sub("^W/", "", t)
                if r[4] and base[4]:
                    want = "verified" if plain(r[4]) == plain(base[4]) else "mismatch"
                elif r[5] and base[5]:
                    want = "verified" if r[5] == base[5] else "mismatch"
                else:
                    want = "unchecked"
                if want != "mismatch":
                    ref = base[0]
                    merged = (base[6] or {}) | {k: v for k, v in own.items() if k in PERMITTED}
        assert (mine.outcome, mine.payload_record_id) == (want, ref)
        assert mine.headers == "\n".join(sorted(f"{k}: {v}" for k, v in merged.items()))


def test_revisits_of_nothing(spark):
    assert resolve_revisits(spark.createDataFrame([], RECORDS)).collect() == []


def test_canonical_urls(spark):
    urls = [r[1] for r in records()] + ["", "?", "HTTP://X.Y/Z?utm_campaign=1", "x.y/a.htm"]
    got = spark.createDataFrame([(u,) for u in urls], "url string").select(canonical_url(__import__(
        "pyspark.sql.functions", fromlist=["col"]).col("url"))).collect()
    assert [r[0] for r in got] == [python_url(u) for u in urls]
