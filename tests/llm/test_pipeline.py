"""The pipeline's stages on the smallest tables, each against brute force on its own input."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from meshlens.llm import mixing
from meshlens.llm.common import Scratch, table
from meshlens.llm.toxicity import toxicity
from tests.llm.test_chat_mix_revisit import calibrated, described, python_mix
from tests.llm.test_decontaminate import brute as brute_items
from tests.llm.test_jaccard_join import brute as brute_components


def exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append((-len(r.text or ""), r.doc_id))
    return {min(g)[1] for g in groups.values()}


def test_stages_against_brute_force(spark, sf_dir, monkeypatch):
    monkeypatch.setattr("meshlens.llm.toxicity.TREES", 2)
    monkeypatch.setattr(mixing, "TOLERANCE", 1.0)  # one round of sweeps, as in python_mix
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    columns, labels = docs.columns, table(spark, sf_dir, "labels")
    bench = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_duplicates", "decontamination", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        if name == "toxicity":
            toxic = {r.doc_id for r in toxicity(docs, labels).collect() if r.predicted == 1}
            want = {r.doc_id for r in rows} - toxic
        elif name == "exact_dedup":
            want = exact(rows)
        elif name == "near_duplicates":
            want = {i for i, _, c in brute_components([(r.doc_id, r.text) for r in rows]) if i == c}
        elif name == "decontamination":
            want = {r.doc_id for r, f in zip(rows, brute_items([(r.doc_id, r.text) for r in rows], bench)) if not f}
        else:
            cells = Counter()
            for _, *c, n in described(docs):
                cells[tuple(c)] += n
            p = calibrated(python_mix(described(docs))[2], cells, mixing.SHARE)
            got = {r.doc_id: r for r in mixing.mix(docs).collect()}
            assert all(abs(r.probability - p[r.source, r.lang, r.topic]) < 1e-8 for r in got.values())
            want = {i for i, r in got.items() if r.kept}
        docs = scratch.save(stage(spark, docs, sf_dir))
        assert docs.columns == columns
        kept = docs.collect()
        assert {r.doc_id for r in kept} == want and len(kept) == len(want), name
        texts = {r.doc_id: r for r in rows}
        assert all(texts[r.doc_id] == r for r in kept)


def test_toxicity_stage_on_odd_and_empty_tables(spark, sf_dir, odd, none, monkeypatch):
    """The other stages' cases are in the tests of their operators."""
    monkeypatch.setattr("meshlens.llm.toxicity.TREES", 2)
    few = odd.where("doc_id is null or doc_id < 12")
    assert corpus_pipeline.toxicity_stage(spark, none, sf_dir).collect() == []
    out = corpus_pipeline.toxicity_stage(spark, few, sf_dir)
    assert out.columns == few.columns and out.count() <= few.count()


def test_every_operator_is_registered():
    import __spark_entry__ as entry
    names = set(entry.queries())
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= names


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op2_chat_rotation", "op3_mixing", "op7_warc_revisit"])
def test_queries_with_a_duckdb_twin(spark, sf_dir, name, monkeypatch):
    monkeypatch.setattr(mixing, "TOLERANCE", 1.0)  # the twin of op3 has one round of sweeps

    from meshlens.llm.queries import ORACLE, QUERIES
    from meshlens.plans.verify import _norm, duck_connect
    cur = duck_connect(sf_dir).execute(ORACLE[name])
    cols = [c[0] for c in cur.description]
    df = QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(cols)
    assert (Counter(tuple(_norm(r[c]) for c in cols) for r in df.collect())
            == Counter(tuple(_norm(v) for v in r) for r in cur.fetchall()))
