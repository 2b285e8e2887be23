"""Several passes give one row per row, as one pass does."""

from collections import Counter

import pytest

from meshlens.llm import decontaminate as dc
from tests.llm.test_decontaminate import fixture


@pytest.mark.parametrize("block_bytes", [500, 4000])
def test_several_passes_over_repeated_and_null_ids(spark, block_bytes):
    docs, items = fixture()
    docs = docs + [(None, "clean text of a null id"), (None, None), (6, "a clean row of the id of a copy"), (6, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    one, several = (Counter((r.doc_id, r.contaminated, tuple(r["items"]), r.best_item, round(r.similarity, 9))
                            for r in dc.decontaminate(d, b, **kw).collect()) for kw in ({}, {"block_bytes": block_bytes}))
    assert several == one and sum(one.values()) == len(docs)
