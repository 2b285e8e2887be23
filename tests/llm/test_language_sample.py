"""Operator 6 learns every language of the training rows, however rare."""

import random

from meshlens.llm import language_id as li

WORDS = {"en": "the and with from that this", "de": "der die das und nicht auch", "fi": "ja hän että kyllä myös ovat"}


def docs(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(WORDS[la].split(), k=30)), la)
            for i, la in enumerate(["en"] * 900 + ["de"] * 900 + ["fi"] * 8)]
    return spark.createDataFrame(rows + [(5, "the the", "en")] * 400, "doc_id long, text string, lang string")


def test_a_rare_language_is_learned(spark):
    d = docs(spark)
    assert li.train(d, max_train=60)[0] == ["de", "en", "fi"]
    wrong = {r.doc_id for r in li.language_id(d, max_train=60).join(d.select("doc_id", "lang").distinct(), "doc_id")
             .where("lang <> lang_pred").collect()}
    assert not wrong


def test_sample_of_each_language(spark):
    d = docs(spark)
    train = {la: {r.doc_id for r in d.where(f"lang = '{la}'").where(li.remainder(5) != 0).collect()} for la in WORDS}
    got = li._sampled(d, 300).collect()
    assert len(got) == len({(r.doc_id, r.lang) for r in got})
    for la, ids in train.items():
        assert {r.doc_id for r in got if r.lang == la} <= ids
        assert sum(r.lang == la for r in got) == min(100, len(ids))
    got = li._sampled(d, 3).collect()
    assert all(sum(r.lang == la for r in got) == min(li.LEAST, len(ids)) for la, ids in train.items())
