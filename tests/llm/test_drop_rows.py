"""The dropping stages decide per row, where rows of one doc_id (or of none) have different texts."""

import random

from meshlens.llm import decontaminate as dc
from meshlens.llm import jaccard_join as jj
from meshlens.llm import toxicity as tx
from tests.llm.conftest import prose

DOCS = "doc_id long, text string"


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_near_copies(spark):
    rng = random.Random(9)
    a, b, c = (prose(rng, 120) for _ in range(3))
    a5, b7, c_ = (t + " tail" for t in (a, b, c))
    rows = [(3, a), (5, a5), (5, b), (7, b7), (None, b7), (None, c), (None, c_), (8, None), (None, None)]
    out = rows_of(jj.drop_near_copies(spark.createDataFrame(rows, DOCS)))
    assert len(out) == 5 and {r for r in out if r[0] or not r[1]} == {(3, a), (5, b), (8, None), (None, None)}
    assert sum(r in ((None, c), (None, c_)) for r in out) == 1


def test_contaminated(spark):
    item = prose(random.Random(1), 40)
    rows = [(1, "a b " + item), (1, "a clean text"), (None, item), (None, "another clean text"), (2, None)]
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    out = dc.drop_contaminated(spark.createDataFrame(rows, DOCS), bench)
    assert rows_of(out) == sorted([(1, "a clean text"), (None, "another clean text"), (2, None)], key=str)


def test_toxic(spark, monkeypatch):
    monkeypatch.setattr(tx, "TREES", 2)
    rng = random.Random(2)
    rows = [(i, prose(rng, 40) + (" vile filth you vile scum" * 4 if i % 2 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    bad, good = rows[1][1], rows[2][1]
    rows += [(900, bad), (900, good), (None, bad + " x"), (None, good + " x")]
    out = rows_of(tx.drop_toxic(spark.createDataFrame(rows, DOCS), labels))
    assert [r for r in out if r[0] is None or r[0] == 900] == sorted([(900, good), (None, good + " x")], key=str)
