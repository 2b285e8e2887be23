import random
from collections import Counter

import numpy as np

from meshlens.llm import decontaminate as dc
from meshlens.llm.common import grams, utf8, word_hashes
from tests.llm.conftest import edited, prose, words


def multiset(ws):
    n = min(5, len(ws))
    return Counter(tuple(ws[i:i + n]) for i in range(len(ws) - n + 1))


def brute(docs, items):
    """Per document the items of which some window of the item's length has similarity 0.8 or more."""
    out = []
    for _, text in docs:
        w, found = words(text), {}
        for item, t in items:
            x = words(t)
            if not x or not w:
                continue
            a = multiset(x)
            n = min(5, len(x))
            if not any(tuple(w[i:i + n]) in a for i in range(len(w) - n + 1)):
                continue  # no common shingle, so no similarity
            for s in range(max(1, len(w) - len(x) + 1)):
                win = w[s:s + len(x)]
                if len(x) < 5 and len(win) < len(x):
                    continue
                b = Counter(tuple(win[i:i + min(5, len(x))]) for i in range(len(win) - min(5, len(x)) + 1))
                both = sum((a & b).values())
                sim = both / max(1, sum(a.values()) + sum(b.values()) - both)
                if sim >= 0.8:
                    found[item] = max(sim, found.get(item, 0))
        out.append(found)
    return out


def fixture():
    rng = random.Random(5)
    items = [(i, prose(rng, rng.randrange(15, 70))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "just four words here"), (93, items[3][1]), (94, items[4][1].upper())]
    docs = [(1, None), (2, ""), (3, "w1"), (4, prose(rng, 3000)), (5, "xx just four words here yy"), (6, items[0][1]),
            (7, " ".join(items[1][1].split()[:-2])), (None, items[2][1])]
    for k in range(60):
        item = items[k % 25][1]
        text = edited(rng, item, (0, 0, 0.01, 0.03, 0.1)[k % 5])
        if k % 7 == 0:
            text = " ".join(text.split()[:len(text.split()) // 2])
        docs.append((10 + k, prose(rng, rng.randrange(0, 200)) + " " + text + "\n" + prose(rng, rng.randrange(0, 200))))
    docs += [docs[10], (200, " ".join(i[1] or "" for i in items))]
    return docs, items


def test_against_all_windows(spark):
    docs, items = fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = Counter((i, tuple(sorted(f)), round(max(f.values(), default=0), 9))
                   for (i, _), f in zip(docs, brute(docs, items)))
    got = dc.decontaminate(d, b).collect()
    assert Counter((r.doc_id, tuple(r["items"]), round(r.similarity, 9)) for r in got) == want
    assert all(r.contaminated == bool(r["items"]) and (r.best_item in r["items"] or not r["items"]) for r in got)
    assert sum(r.contaminated for r in got) > 30
    several = dc.decontaminate(d.dropDuplicates(["doc_id"]), b, block_bytes=500).collect()
    assert {r.doc_id: tuple(r["items"]) for r in several} == {r.doc_id: tuple(r["items"]) for r in got}


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    items = [" ".join(f"t{x}" for x in rng.integers(0, 10**6, 30)) for _ in range(200)]
    index = dc.Index(list(range(200)), items)
    (group,) = index.sizes[5]
    flips = np.zeros(500, np.uint64)
    for i in range(500):
        for bit in rng.choice(64, rng.integers(0, 30), replace=False):
            flips[i] ^= np.uint64(1) << np.uint64(bit)
    fp = group["fp"][rng.integers(0, 200, 500)] ^ flips
    near = np.bitwise_count(fp[:, None] ^ group["fp"][None, :]) <= dc.RADIUS
    assert set(index.candidates(group, fp).tolist()) == set(np.flatnonzero(near.ravel()).tolist())


def test_fingerprints_of_runs():
    rng = np.random.default_rng(2)
    raw, bounds = utf8(__import__("pyarrow").array([" ".join(f"t{x}" for x in rng.integers(0, 99, 400))]))
    g = grams(word_hashes(raw, bounds)[0], 5)
    starts = np.array([0, 1, 2, 50, 51, 300, 380])
    got = dc.fingerprints(g, starts, 12)
    for s, f in zip(starts, got):
        bits = np.unpackbits(g[s:s + 12].view(np.uint8).reshape(-1, 8), axis=1).astype(int)
        assert np.packbits((2 * bits - 1).sum(0) > 0).view(np.uint64)[0] == f


def test_empty_tables(spark, odd, none):
    b = spark.createDataFrame([], "item_id long, text string")
    assert dc.decontaminate(none, b).collect() == []
    assert dc.decontaminate(odd, b).where("contaminated").count() == 0
    out = dc.drop_contaminated(odd, b)
    assert out.columns == odd.columns and out.count() == odd.count()
