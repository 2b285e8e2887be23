"""Operator 5, toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: density, number and variety of lexicon words, the same for spellings disguised by digits, signs
or repeated letters, their proximity to second-person words, capitals, punctuation and obfuscation rates, length.  The
lexicon (words and five-letter stems) is learned from the training rows by smoothed log-odds of their document
frequencies.  Training uses a bounded sample of labelled rows; four fifths of it grow the trees, the rest fits the
calibration.  Features are extracted in Arrow batches and scored by Spark ML, without a shuffle.

Cases: null text counts as empty and an empty text is scored like any other feature row; rows without a usable label
are not learned from; with no label or one class only, every score is the smoothed share of label 1 (0.5 without
labels); repeated rows score alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlens.llm.common import Scratch, remainder, text_id, training_rows, without

#: At most so many labelled rows train the model.
MAX_TRAIN = 20_000
#: At most so many terms in the lexicon; a term needs this many toxic rows and this log-odds ratio.
MAX_TERMS, MIN_ROWS, MIN_ODDS = 2000, 5, 3.0
STEM = 5
TREES, DEPTH, RATE = 20, 3, 0.3

#: Second-person words (fixed values).
YOU = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos "
                "usted ustedes ti tuyo tuya vosotros".split())
_DISGUISE = str.maketrans("0134578@$!+", "oieastbasit")
_WORD = re.compile(r"[^\W\d_]+")
# starts where a run of letters starts and never backtracks into it, so a very long run takes linear time
_MIXED = re.compile(r"(?<![^\W\d_])[^\W\d_]++[0-9@$*!+][0-9@$*!+\w]*")
_LONG = re.compile(r"(\w)\1\1")
_PUNCT = re.compile(r"[!?]")
_RUN = re.compile(r"[!?.*#$%&]{2,}")
_SIGN = re.compile(r"[#$%&*@^~<>{}|\\]")
_UPPER = re.compile(r"\b[A-Z]{2,}\b")
_CAPITAL = re.compile(r"[A-Z]")


def plain(token: str) -> str:
    """A disguised spelling as letters: look-alike signs replaced, other signs dropped, runs of a letter cut to one."""
    letters = re.sub(r"[\W\d_]", "", token.lower().translate(_DISGUISE))
    return re.sub(r"(\w)\1+", r"\1", letters)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic rows, rows) per batch; stems are marked by a trailing star."""
    for batch in batches:
        ones, rows = Counter(), Counter()
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = set(_WORD.findall(text.lower()))
            terms = words | {w[:STEM] + "*" for w in words if len(w) > STEM}
            rows.update(terms)
            if label:
                ones.update(terms)
        terms = list(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array([ones[t] for t in terms], pa.int64()),
             pa.array([rows[t] for t in terms], pa.int64())], ["term", "ones", "n"])


def learn_lexicon(rows: DataFrame, ones: int, n: int) -> set[str]:
    """At most MAX_TERMS words and stems that mark toxic rows."""
    odds = (F.log((F.col("ones") + 0.5) / (ones + 1)) - F.log((F.col("n") - F.col("ones") + 0.5) / (n - ones + 1)))
    got = (rows.select("text", "label").mapInArrow(_terms, "term string, ones long, n long")
           .groupBy("term").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n"))
           .where((F.col("ones") >= MIN_ROWS) & (odds >= MIN_ODDS))
           .orderBy(F.desc("ones"), "term").limit(MAX_TERMS).select("term").collect())
    return {r["term"] for r in got}


def extract(lexicon: set[str]):
    """The feature extractor for (doc_id, text) batches."""
    words_of = frozenset(t for t in lexicon if not t.endswith("*"))
    stems = frozenset(t[:-1] for t in lexicon if t.endswith("*"))
    plains = frozenset(plain(t) for t in words_of)

    def row(text: str) -> list[float]:
        words = _WORD.findall(text.lower())
        n, chars = max(1, len(words)), max(1, len(text))
        hits = [i for i, w in enumerate(words) if w in words_of or (len(w) > STEM and w[:STEM] in stems)]
        mixed = _MIXED.findall(text) + [w for w in words if _LONG.search(w)] if _LONG.search(text) else _MIXED.findall(text)
        masked = sum(plain(m) in plains for m in mixed)
        you = {i for i, w in enumerate(words) if w in YOU}
        near = sum(any(j in you for j in range(i - 5, i + 6)) for i in hits)
        capitals = len(_CAPITAL.findall(text))
        return [len(hits) / n, float(len(hits)), float(len({words[i] for i in hits})), masked / n, float(masked),
                near / n, near / max(1, len(hits)), len(you) / n, capitals / chars, len(_UPPER.findall(text)) / n,
                len(_PUNCT.findall(text)) / chars, len(_RUN.findall(text)) / n, len(_SIGN.findall(text)) / chars,
                len(mixed) / n, float(len(words)), sum(map(len, words)) / n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [row(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.float64())), *batch.columns[2:]],
                                             ["doc_id", "features", *batch.schema.names[2:]])
    return run


def _features(docs: DataFrame, lexicon: set[str]) -> DataFrame:
    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_id(F.col("text")).alias("text_id"))
            .mapInArrow(extract(lexicon), "doc_id long, features array<double>, text_id long")
            .withColumn("features", array_to_vector("features")))


def _scored(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, text_id, held_out, score and predicted of every row."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(training_rows(docs, labels, "toxic", 5, 0, max_train))
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    grown = rows.where(remainder(5) != 1)
    if 0 < ones < n and grown.select("label").distinct().count() == 2:
        lexicon = learn_lexicon(grown, ones, n)
        seen = scratch.save(_features(rows, lexicon).join(rows.select("doc_id", "label").distinct(), "doc_id")
                            .withColumn("label", F.col("label").cast("double")))
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=RATE, seed=0, cacheNodeIds=False,
                              checkpointInterval=-1).fit(seen.where(remainder(5) != 1).select("features", "label"))

        def margin(df: DataFrame) -> DataFrame:
            return model.transform(df).withColumn("margin", vector_to_array("rawPrediction")[1])

        held = margin(seen.where(remainder(5) == 1))
        if held.isEmpty():
            held = margin(seen)
        curve = IsotonicRegression(featuresCol="margin", predictionCol="fit").fit(held.select("margin", "label"))
        scored = (curve.transform(margin(_features(docs, lexicon)))
                  .select("doc_id", "text_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "fit")).alias("score")))
    else:
        scored = docs.select(F.col("doc_id").cast("long"), text_id(F.col("text")).alias("text_id"),
                             F.lit((ones + 1) / (n + 2)).alias("score"))
    return scored.select("doc_id", "text_id", (remainder(5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; learns where crc32(doc_id) mod 5 is not 0."""
    return _scored(docs, labels, max_train).drop("text_id")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic, each by its own text; all columns stay."""
    return without(docs, _scored(docs, labels).where("predicted = 1"))
