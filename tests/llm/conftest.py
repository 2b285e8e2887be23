import random
import re

import pytest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def prose(rng, n, vocabulary=3000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, share):
    return " ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


def odd_texts():
    """(doc_id, text): nulls, empties, white space, ties, repeated rows, copies, near copies and very long texts."""
    rng = random.Random(7)
    base, passage = prose(rng, 200), prose(rng, 60)
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "a null id"), (None, None), (4, "one"), (5, "One"), (6, "a b c d"),
            (7, "a  b\nc\td"), (8, "a b c d e"), (9, base), (9, base), (10, base.upper()), (11, base.replace(" ", "\n")),
            (12, prose(rng, 60000)), (13, "y" * 300000), (14, "naïve ünïcode \U0001F600 text   here now")]
    rows += [(20 + i, edited(rng, base, 0.002 * i)) for i in range(12)]
    rows += [(40 + i, passage + " " + prose(rng, 12 + i)) for i in range(30)]
    for i in range(40):
        text = prose(rng, rng.randrange(6, 120))
        rows += [(100 + 3 * i, text), (101 + 3 * i, edited(rng, text, 0.02)), (102 + 3 * i, text[:int(len(text) * 0.9)])]
    long = rows[14][1]
    rows += [(300, edited(rng, long, 0.01)), (301, long + " the end")]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The odd texts with all columns of documents, null languages and sources, and columns whose names clash."""
    rows = [dict(doc_id=i, text=t, lang=None if k % 7 == 0 else "en" if k % 2 else "de",
                source=None if k % 5 == 0 else f"src{k % 3}", n_chars=None, label=k, score=0.5, n=k, cls=k, name="x",
                rid=k, ref=k, kept="?", comp=k, key=k, value=None, level=k, tokens=k, w=1.0, carrier=0)
            for k, (i, t) in enumerate(odd_texts())]
    schema = ("doc_id long, text string, lang string, source string, n_chars long, label long, score double, n long, "
              "cls long, name string, rid long, ref long, kept string, comp long, key long, value string, level long, "
              "tokens long, w double, carrier long")
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], schema).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    """An empty table of documents."""
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
