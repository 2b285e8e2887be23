import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from meshlens.llm import substring_dedup as sd
from tests.llm.conftest import prose


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, window):
    """(id, n_words, n_removed, digest, kept words) by counting all windows."""
    starts = Counter(tuple(w[i:i + window]) for _, t in rows for w in [words(t)] for i in range(len(w) - window + 1))
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for p in range(len(w) - window + 1):
            if starts[tuple(w[p:p + window])] > 1:
                gone.update(range(p, p + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def same(spark, rows, window, parts=4):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = [tuple(r) for r in sd.substring_dedup(docs, window).collect()]
    want = brute(rows, window)
    assert sorted(map(str, got)) == sorted(str(x[:4]) for x in want)
    return want


def planted(seed, window, n=60):
    """Texts with passages just below, at and above the window, at their ends and in their middle, periods and copies."""
    rng = random.Random(seed)
    passages = [prose(rng, window + d) for d in (-1, 0, 1, 7, window, 3 * window)]
    rows = []
    for i in range(n):
        parts = [prose(rng, rng.randrange(0, 2 * window)) for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice(passages))
        if i % 9 == 0:
            parts.append(" ".join(["ab cd"] * window))
        if i % 11 == 0:
            parts.append("zz " * (window + 2))
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(parts)))
    rows += [(100 + i, rows[3][1]) for i in range(20)] + [(3, rows[3][1]), (None, rows[4][1]), (None, None), (7, "")]
    twice = prose(rng, window + 3)
    return rows + [(200, twice + " x " + twice), (201, prose(rng, window))]


@pytest.mark.parametrize("window", [1, 2, 5, 9, 10, 35])
def test_against_counting(spark, window):
    want = same(spark, planted(window, window), window)
    assert any(r[2] for r in want) and (window < 5 or any(not r[2] for r in want))


def test_small_batches_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(sd, "BATCH_BYTES", 500)
    monkeypatch.setattr(sd, "BUCKET_VALUES", 50)
    same(spark, planted(77, 12), 12, parts=9)


def test_odd_table(odd, spark):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = [tuple(r) for r in sd.substring_dedup(odd).collect()]
    assert sorted(map(str, got)) == sorted(str(x[:4]) for x in brute(rows, 35))
    texts = sd.drop_repeats(odd)
    assert texts.columns == odd.columns
    want = sorted((str(i), k if n else (t or "")) for (i, t), (_, _, n, _, k) in zip(rows, brute(rows, 35)))
    assert sorted((str(r.doc_id), r.text or "") for r in texts.collect()) == want


def test_nothing_repeats_and_no_rows(spark, none):
    rng = random.Random(3)
    same(spark, [(i, prose(rng, 80, 10**6)) for i in range(30)], 35)
    assert sd.substring_dedup(none).collect() == []
    assert sd.drop_repeats(none).collect() == []


def test_spans(spark):
    p = " ".join(f"p{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "a b " + p), (2, p + " c"), (3, "a b c")], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.kept, [(s.start, s.end) for s in r.spans]) for r in sd.removed_spans(docs).collect()}
    assert got == {1: (40, "a b", [(2, 42)]), 2: (40, "c", [(0, 40)])}


def test_lengths_and_anchors():
    assert sd.lengths(35) == [9, 18, 35] and sd.lengths(9) == [9] and sd.lengths(1) == [1]
    for w in range(1, 200):
        s = sd.lengths(w)
        assert s[-1] == w and all(a < b <= 2 * a for a, b in zip(s, s[1:]))
    rng = np.random.default_rng(1)
    for n in (5, 8, 40, 300):
        h = rng.integers(1, 30, n).astype(np.uint64)
        w = int(rng.integers(1, 6))
        alive = rng.random(max(0, n - w + 1)) < 0.7
        want = sorted({q for p in np.flatnonzero(alive) for q in range(p, p + w) if h[q] == h[p:p + w].min()})
        assert sd._anchors(h, alive, w).tolist() == want
