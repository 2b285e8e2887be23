import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from meshlens.llm import token_alignment as ta
from tests.llm.conftest import prose


def brute(texts):
    """Whole texts encoded at once, all ranges compared."""
    from tokenizers import Tokenizer
    voc = ta.vocabularies(ta.BYTE_BPE, ta.PIECE_BPE)
    a_tok = Tokenizer.from_file(ta.BYTE_BPE)
    a_tok.encode_special_tokens = True
    rows, corpus, in_docs = [], Counter(), Counter()
    for text in texts:
        raw = b" " + (text or "").encode()
        ids = [a_tok.encode(" " + text, add_special_tokens=False).ids, voc.b.encode(text)] if text else [[], []]
        spans = []
        for t, table in zip(ids, (voc.a_bytes, voc.b_bytes)):
            at, out = 0, []
            for i in t:
                out.append((at, at + len(table[i]), i))
                at += len(table[i])
            spans.append(out)
            if text and b"".join(table[i] for i in t) != raw:
                ids = [[], []]
        if not ids[0]:
            spans = [[], []]
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        members = [[[], []] for _ in cuts]
        for k, side in enumerate(spans):
            at = 0
            for _, e, i in side:
                at += e > cuts[at]
                members[at][k].append(str(i))
        groups = ["|".join(map(",".join, m)) for m in members]
        links, j0 = [], 0
        for s, e, i in spans[0]:
            while spans[1][j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(spans[1]) and spans[1][j][0] < e:
                links.append((i, spans[1][j][2]))
                j += 1
        corpus.update(links)
        in_docs.update(set(links))
        rows.append((len(spans[0]), len(spans[1]), len(groups), links, ";".join(groups)))
    most = defaultdict(int)
    for (_, b), n in corpus.items():
        most[b] = max(most[b], n)
    return [(na, nb, ng, len(links), sum(corpus[x] == most[x[1]] for x in links), sum(corpus[x] for x in links),
             hashlib.sha256(g.encode()).hexdigest() if g else "", g) for na, nb, ng, links, g in rows], corpus, in_docs


STRANGE = [None, "", " ", "  ", "a", " a", "a ", "a  b", "x\ty", "x \n y", "a b c", "it's 's 'll don't", "<|endoftext|> <s> </s> x",
           "▁x y", "x ▁ y", "naïve ﬁne Ångström", "日本語 テスト 中文", "😀 👨‍👩‍👧 a", "\x00 z", "a \x1c b \x85 c", "1234567 89,10",
           "é e ́", "<0x41> <unk>", "a　b", "http://x.y/z?q=1 #!$%", "ー" * 50, "y" * 5000, "\r\n\r\n a", "​ ﻿ x"]


def compare(spark, rows, **limits):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in ta.align(docs, groups=True).collect()]
    want, corpus, in_docs = brute([t for _, t in rows])
    assert sorted(map(str, got)) == sorted(str((i, *w)) for (i, _), w in zip(rows, want))
    return docs, corpus, in_docs


def test_strange_texts(spark):
    docs, corpus, in_docs = compare(spark, [*enumerate(STRANGE), (None, "a null id"), (3, "a"), (3, "a")])
    pairs = {(r.a_id, r.b_id): (r.n_docs, r.n_links) for r in ta.id_pairs(docs).collect()}
    assert pairs == {k: (in_docs[k], n) for k, n in corpus.items()}


@pytest.mark.parametrize("chunk", [8192, 16])
def test_prose_of_the_tables(spark, sf_dir, monkeypatch, chunk):
    """Whole documents; small chunks, slices and memory give the same."""
    monkeypatch.setattr(ta, "CHUNK_DOCS", chunk)
    if chunk < 100:
        monkeypatch.setattr(ta, "SLICE_BYTES", 20_000)
        monkeypatch.setattr(ta, "UNITS", 500)
        monkeypatch.setattr(ta, "CHUNK_ENTRIES", 3000)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(5)
    rows = rows[:120] + [(9000 + i, "the same words " * 40) for i in range(60)] + [(9999, prose(rng, 30000))]
    compare(spark, rows)


def test_empty_and_odd_tables(odd, none):
    assert ta.align(none).collect() == [] and ta.id_pairs(none).collect() == []
    assert ta.align(odd).count() == odd.count()


def test_bitmaps_come_back():
    rng = np.random.default_rng(2)
    for n_docs in (1, 7, 8, 9, 500):
        pair, doc = np.nonzero(rng.random((30, n_docs)) < rng.random((30, 1)) ** 3)
        maps = ta.Bitmaps(ta._containers(pair * 7, doc, n_docs), n_docs)
        at, number = maps.entries()
        assert sorted(zip((maps.pair[at] // 7).tolist(), number.tolist())) == sorted(zip(pair.tolist(), doc.tolist()))
        assert (maps.popcount() == np.unique(pair, return_counts=True)[1]).all()
