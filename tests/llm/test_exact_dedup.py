import hashlib
import re
from collections import defaultdict

import pytest

from meshlens.llm.exact_dedup import drop_copies, exact_dedup


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


@pytest.mark.parametrize("block_bytes", [4096, 64, 7])
def test_against_grouping(odd, block_bytes):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i))
    got = exact_dedup(odd, block_bytes).collect()
    assert len(got) == len(rows)
    by_sha = defaultdict(list)
    for r in got:
        by_sha[r.text_sha256].append(r)
    for text, members in groups.items():
        mine = by_sha[hashlib.sha256(text.encode()).hexdigest()]
        best = min(members, key=lambda m: (m[0], m[1], m[2] or 0))[2]
        assert len(mine) == len(members) == mine[0].group_size
        assert {r.keep_id for r in mine} == {best}
        assert [r.doc_id for r in mine if r.kept] == [best]
        assert sorted(map(str, (r.doc_id for r in mine))) == sorted(str(m[2]) for m in members)


def test_blocks_in_another_order_differ(spark):
    a, b = "a" * 8, "b" * 8
    docs = spark.createDataFrame([(1, a + b), (2, b + a), (3, a + b + a), (4, a + b + a + b), (5, a + " " + b)],
                                 "doc_id long, text string")
    got = {r.doc_id: r.keep_id for r in exact_dedup(docs, 8).collect()}
    assert got == {1: 5, 2: 2, 3: 3, 4: 4, 5: 5}


def test_empty_table(none):
    assert exact_dedup(none).collect() == []
    assert drop_copies(none).collect() == []


def test_drop_copies_keeps_columns_and_one_of_each(odd):
    out = drop_copies(odd)
    assert out.columns == odd.columns
    got = [norm(r.text) for r in out.collect()]
    assert len(got) == len(set(got)) == len({norm(r.text) for r in odd.collect()})
