import random

import pytest

from meshlens.llm import jaccard_join as jj
from tests.llm.conftest import edited, odd_texts, prose, shingles


def brute(rows):
    """Smallest id reachable by links, for rows (id, text)."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(sets[k]), least.get(find(k), i)) for k, (i, _) in enumerate(rows)]


def same(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jj.jaccard_join(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))


def test_odd_rows(spark):
    same(spark, odd_texts())


@pytest.mark.parametrize("frequent", [1, 32])
def test_groups_passages_and_chains(spark, monkeypatch, frequent):
    """Near copies at and around the threshold, chains, a passage in many short texts, a large group of copies."""
    monkeypatch.setattr(jj, "FREQUENT", frequent)
    rng = random.Random(frequent)
    rows, n = [], 0
    for size in (5, 6, 9, 14, 20, 33, 60, 64, 65, 120, 128, 250):
        text = prose(rng, size)
        for share in (0, 0.01, 0.02, 0.03, 0.05):
            for _ in range(6):
                n += 1
                rows.append((n, edited(rng, text, share)))
        for cut in range(1, 8):
            n += 1
            rows.append((n, " ".join(text.split()[cut:])))
    chain = prose(rng, 150).split()
    for _ in range(25):  # each is near the last one, the ends are far apart
        n += 1
        at = rng.randrange(len(chain) - 4)
        chain = chain[:at] + [f"y{n}"] * 2 + chain[at + 2:]
        rows.append((n, " ".join(chain)))
    passage = prose(rng, 55)
    for _ in range(120):
        n += 1
        rows.append((n, prose(rng, rng.randrange(3, 30)) + " " + passage))
    rows += [(n + i, rows[0][1]) for i in range(1, 60)]
    same(spark, rows)


def test_blocks_share_one_key_for_every_link(monkeypatch):
    """Pigeonhole: sets within the bound of their band agree in a block that both keep."""
    import numpy as np
    rng = np.random.default_rng(3)
    for n in list(range(5, 60)) + [100, 127, 128, 129, 300, 1000]:
        for _ in range(5):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            most = int(2 * len(a) / 9)
            drop = rng.integers(0, most // 2 + 1)
            new = rng.integers(0, 2**63, most // 2 - drop // 2).astype(np.uint64)
            b = np.unique(np.r_[rng.permutation(a)[drop:], new])
            both = len(np.intersect1d(a, b))
            if 5 * both < 4 * (len(a) + len(b) - both) or np.array_equal(a, b):
                continue
            monkeypatch.setattr(jj, "shingle_sets", lambda _, both_sets=(a, b): iter(both_sets))
            sets = jj.Sets(None)
            keys = [set().union(*(set(jj._blocks(sets, i, *x).tolist()) for x in jj._instances(len(u))))
                    for i, u in enumerate((a, b))]
            assert keys[0] & keys[1]


def test_empty_table(none):
    assert jj.jaccard_join(none).collect() == []
    assert jj.drop_near_copies(none).collect() == []


def test_drop_near_copies(odd):
    out = jj.drop_near_copies(odd)
    assert out.columns == odd.columns
    rows = brute([(r.doc_id, r.text) for r in odd.collect()])
    assert {r.doc_id for r in out.collect()} == {i for i, _, c in rows if i == c}


@pytest.mark.parametrize("changed", [0.04, 0.055])
def test_template_texts_below_the_threshold_make_no_pairs(spark, monkeypatch, changed):
    """Texts on one template, each with words of its own: their keys are large, but only few rows meet all others."""
    rng = random.Random(5)
    template = prose(rng, 300)
    met, pairs = [], []

    def spy(rows, plain=jj._across):
        sizes = rows.groupBy("key").agg({"cls": "count", "slack": "max"}).collect()
        met.append(sum(r["count(cls)"] for r in sizes))
        pairs.append(rows.where("slack >= 0").count())
        return plain(rows)
    monkeypatch.setattr(jj, "_across", spy)
    for n in (60, 120):
        rows = [(i, edited(rng, template, changed)) for i in range(n)]
        rows += [(1000 + i, edited(rng, rows[i][1], 0.004)) for i in range(0, n, 7)]  # a few real links
        same(spark, rows)
    assert met[1] > 200 and pairs[1] < 0.25 * met[1]


def _open_rows(spark, n_crowd, keys):
    """Classes of a crowd in frequent keys, and one text that meets a member of the crowd in a small key alone."""
    rng = random.Random(8)
    texts = [prose(rng, 40) for _ in range(n_crowd)]
    texts.append(texts[0] + " end")
    docs = spark.createDataFrame([(c, t, c) for c, t in enumerate(texts)], "doc_id long, text string, text_id long")
    ids = jj.Sets(docs.orderBy("doc_id").toArrow().column("text").combine_chunks()).ids().tolist()
    classes = spark.createDataFrame([(i, (c, c)) for c, i in enumerate(ids)], "cls long, carrier struct<doc_id: long, text_id: long>")
    rows = [(k, i, i, ids[0], 36, n_crowd, *[0] * jj.FOLD) for k in range(keys) for i in ids[:-1]]
    rows += [(-1, i, i, ids[0], 36 + (i == ids[-1]), 2, *[0] * jj.FOLD) for i in (ids[0], ids[-1])]
    schema = "key long, cls long, comp long, main long, n long, size long, " + ", ".join(f"f{i} long" for i in range(jj.FOLD))
    return ids, docs, classes, spark.createDataFrame(rows, schema)


def test_links_of_small_keys_pass_the_own_shingles(spark):
    ids, docs, classes, rows = _open_rows(spark, 39, 1)
    with_slack = jj._with_slack(rows, docs, classes, jj.Scratch(spark))
    slack = {(r.key, r.cls): r.slack for r in with_slack.collect()}
    assert all(slack[0, i] == 36 - 9 * 36 for i in ids[1:-1])
    assert {tuple(r) for r in jj._across(with_slack).collect()} == {(min(ids[0], ids[-1]), max(ids[0], ids[-1]))}


def test_pairs_of_many_frequent_keys_are_made_once(spark, monkeypatch):
    """Before they are made distinct, too."""
    ids, _, _, rows = _open_rows(spark, 40, 20)
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.distinct", lambda df: df)
    made = sorted(map(tuple, jj._across(rows.withColumn("slack", rows["n"])).collect()))
    assert len(made) == len(set(made)) and len(made) == 40 * 39 // 2 + 1


def test_keys_that_a_round_of_pivots_did_not_serve_leave_the_rounds(spark):
    """Their rows are not joined again in each round."""
    def owned(moved):  # 20 classes in each of two keys; in key 1 those below ``moved`` are in one component
        rows = [(k, c, 0 if k == 1 and c < moved else c) for k in (1, 2) for c in range(20)]
        return spark.createDataFrame(rows, "key long, cls long, comp long")
    first = jj._heads(owned(1), 0, None)
    assert {(r.key, r.outside) for r in first.collect()} == {(1, 19), (2, 19)}
    second = jj._heads(owned(10), 1, first)
    assert [(r.key, r.main, r.outside) for r in second.collect()] == [(1, 0, 10)]
    assert jj._heads(owned(11), 2, second).collect() == []  # by less than a quarter
    assert jj._heads(owned(20), 2, second).collect() == []  # all in one component
