import hashlib
import random
import re

from meshlens.llm.pii import KINDS, personal_data, reliabilities

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    total = 0
    for i, x in enumerate(map(int, reversed(d))):
        x = x * 2 if i % 2 else x
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind in KINDS:
        for m in re.finditer(BASE[kind], text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                  "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def fixture():
    rng = random.Random(9)
    pieces = ["a.b@c.de", "x@y", "@", "a@b.c@d.e", "a@b.c_d@e.f", "foo@bar.-x", "192.168.0.1", "1.2.3.4.5.6.7.8", "256.1.1.1",
              "0001.2.3.4", "12.3.x", "4432507379035540", "4111 1111 1111 1111", "4111-1111-1111-1112", "1 2 3 4 5 6 7 8 9 0 1 2 3",
              "+49 (30) 1234567", "+1-202-555-0143", "+1 2", "+12345678901234567890", "call 030 1234 5678", "mail me (at) host.org",
              "joe [at] mail [dot] com", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "version 1.2.3.4", "naïve \U0001F600", "tel:", "+",
              "....", "0 0 0 0 0 0 0 0 0 0 0 0 0 0 0", "a" * 40 + "@" + "b" * 30 + ".com", "--", "é@ü.com", "1.1.1.1@2.2.2.2"]
    rows = [(1, None), (2, ""), (3, " "), (None, "x@y.zz"), (4, "x@y.zz"), (4, "x@y.zz"), (5, "9" * 60000), (6, "ab.c-" * 40000),
            (7, "1." * 40000), (8, "+1 " + "2 " * 30000), (9, ("m@n.op " * 3000)), (10, "1 " * 30000 + "a"), (11, "a" * 200000 + "@")]
    rows += [(100 + i, rng.choice(["", " ", ",", "x"]).join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))))
             for i in range(300)]
    return rows


def test_base_spans_against_python(spark):
    rows = fixture()
    docs = spark.createDataFrame([r + ("clash", 1) for r in rows], "doc_id long, text string, cands string, t int").repartition(4)
    full = personal_data(docs).collect()
    got = sorted(str((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)) for r in full)
    want = []
    for i, t in rows:
        s = base_spans(t)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in s)
        want.append((i, *(sum(k == x[0] for x in s) for k in KINDS), hashlib.sha256(joined.encode()).hexdigest()))
    assert got == sorted(map(str, want))
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t)
    added = 0
    for r in full:
        spans = [(x.split(":")[0], *map(int, x.split(":")[1:])) for x in r.spans.split(",") if x]
        base = base_spans(texts[r.doc_id])
        assert set(base) <= set(spans) and len(spans) - len(base) == r.n_added
        assert spans == sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1]))
        added += r.n_added
    assert added > 0


def test_empty_table(none):
    assert personal_data(none).collect() == []


def test_no_candidates(spark):
    docs = spark.createDataFrame([(1, "nothing"), (2, None)], "doc_id long, text string")
    assert [(r.spans, r.n_added) for r in personal_data(docs).collect()] == [("", 0)] * 2


def test_reliabilities_recover_planted_labelers():
    rng = random.Random(1)
    counts = {}
    truth = {}
    for _ in range(20000):
        y = rng.random() < 0.6
        v = tuple((1 if (rng.random() < a) == y else -1) if rng.random() < 0.8 else 0 for a in (0.95, 0.9, 0.85, 0.7, 0.6))
        counts[0, v] = counts.get((0, v), 0) + 1
        truth.setdefault((0, v), []).append(y)
    post = reliabilities([(k, v, n) for (k, v), n in counts.items()])
    wrong = sum(sum(y != (post[key] >= 0.5) for y in ys) for key, ys in truth.items())
    assert wrong / 20000 < 0.06
