"""Operator 3 with a share of the tokens to keep."""

import random
from collections import Counter

import pytest

from meshlens.llm import mixing
from meshlens.llm.common import Scratch
from tests.llm.conftest import prose

DOCS = "doc_id long, text string, lang string, source string"


def corpus():
    rng = random.Random(8)
    return [(i, prose(rng, rng.randrange(20, 200)), ("en", "de")[i % 3 == 0], f"s{min(i % 7, 2)}") for i in range(300)]


@pytest.mark.filterwarnings("ignore:mixing")
@pytest.mark.parametrize("share", [0.1, 0.65, 1.0])
def test_one_rare_document_does_not_empty_the_sample(spark, share):
    for rows in (corpus(), corpus() + [(900, "only three words", None, "new")]):
        got = mixing.mix(spark.createDataFrame(rows, DOCS), share=share).collect()
        assert len(got) == len(rows) and all(0 <= r.probability <= 1 for r in got)
        total = sum(r.n_tokens for r in got)
        assert sum(r.probability * r.n_tokens for r in got) == pytest.approx(share * total, rel=1e-5)


def test_raked_below_the_tolerance(spark):
    rows = [(i, t, la, s) for i, (_, t, la, s) in enumerate(corpus())]
    described = mixing.described(spark.createDataFrame(rows, DOCS))
    p = {(r["_source"], r["_lang"], r["_topic"]): r.probability
         for r in mixing.probabilities(described, share=0.05).collect()}
    assert max(p.values()) < 1
    for d in range(3):
        kept, all_ = Counter(), Counter()
        for r in described.select("_source", "_lang", "_topic", "_tokens").collect():
            kept[r[d]] += p[r[0], r[1], r[2]] * r[3]
            all_[r[d]] += r[3]
        goal = {v: n ** mixing.EXPONENT for v, n in all_.items()}
        for v in goal:
            assert kept[v] / sum(kept.values()) == pytest.approx(goal[v] / sum(goal.values()), abs=mixing.TOLERANCE)


def test_share_of_nothing(none):
    assert mixing.mix(none, share=0.5).collect() == []


@pytest.mark.filterwarnings("ignore:mixing")
def test_own_topics(spark):
    rows = [(i, "a b", "en", "s", None if i == 3 else f"k{i % 2}") for i in range(8)]
    docs = spark.createDataFrame(rows, DOCS + ", subject string")
    got = {r.doc_id: r.topic for r in mixing.mix(docs, topic=docs["subject"]).collect()}
    assert got == {i: "unknown" if i == 3 else f"k{i % 2}" for i in range(8)}


@pytest.mark.parametrize("share", [None, 0.5])
def test_no_plan_holds_all_sweeps(spark, monkeypatch, share):
    rows = spark.createDataFrame([(f"s{i % 5}", f"l{i % 3}", f"t{i % 4}", 10 + i * i) for i in range(60)],
                                 "_source string, _lang string, _topic string, _tokens long")
    windows, save = [], Scratch.save

    def counted(self, df):
        windows.append(df._jdf.queryExecution().optimizedPlan().toString().count("Window ["))
        return save(self, df)
    monkeypatch.setattr(Scratch, "save", counted)
    got = {tuple(r)[:3]: r.probability for r in mixing.probabilities(rows, share=share).collect()}
    assert 1 <= max(windows) <= 3 * mixing.SAVED
    assert sum(windows) >= 3 * mixing.SWEEPS  # every sweep is made
    monkeypatch.setattr(mixing, "SAVED", mixing.SWEEPS)
    whole = {tuple(r)[:3]: r.probability for r in mixing.probabilities(rows, share=share).collect()}
    assert max(windows) >= 3 * mixing.SWEEPS
    assert got == pytest.approx(whole, abs=2e-9) and len(got) == 60
