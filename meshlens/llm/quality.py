"""Operator 10, quality classifier: hashed word n-gram logistic regression, follow-the-regularised-leader updates.

Features of a text are its distinct words and word pairs, both as written and by shape (letters, capitals, digits and
every other sign, runs as one), hashed into ``DIM`` slots; each has the value 1 / sqrt(number of features).  Training
makes FTRL-proximal updates row by row over a bounded, documented sample of labelled rows in one task that streams
them; the model (DIM floats) is the only thing that reaches the driver.  Scoring is a sparse dot product per document
in Arrow batches, without a shuffle.

Cases: null text counts as empty and an empty text is scored by the intercept; rows without a usable label are not
learned from; with no label or one class only, the score is the smoothed share of label 1 (0.5 without labels);
repeated rows score alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlens.llm.common import _SPACE, grams, mix, mix_int, remainder, slices, training_rows, utf8, word_hashes

DIM = 1 << 18
#: At most so many labelled rows train the model.
MAX_TRAIN = 20_000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.1, 3

#: Signs by kind: letters (and bytes of non-ASCII letters) 'a', capitals 'A', digits '0', others themselves.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[97:123] = _KIND[128:] = 97
_KIND[65:91] = 65
_KIND[48:58] = 48


def _shapes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes by kind with runs as one sign, and the bounds of the rows in them."""
    kind = _KIND[raw]
    keep = np.ones(len(raw), bool)
    keep[1:] = (kind[1:] != kind[:-1]) | _SPACE[raw[1:]]
    edge = bounds[:-1]
    keep[edge[edge < len(raw)]] = True
    at = np.r_[0, np.cumsum(keep)]
    return kind[keep], at[bounds]


def features(col: pa.Array) -> Iterator[np.ndarray]:
    """For each row the sorted distinct feature slots."""
    raw, bounds = utf8(col)
    sets = []
    for salt, (r, b) in enumerate(((raw, bounds), _shapes(raw, bounds))):
        h, words = word_hashes(r, b, lower=False)
        h = mix(h ^ mix_int(500 + salt))
        sets.append((h, grams(h, 2), words))
    for i in range(len(bounds) - 1):
        got = []
        for h, pairs, words in sets:
            s, e = int(words[i]), int(words[i + 1])
            got += [h[s:e], pairs[s:max(s, e - 1)]]
        yield np.unique(np.concatenate(got) & np.uint64(DIM - 1)).astype(np.int64)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: intercept and weights.  Slot DIM is the intercept, which is not regularised."""
    z, n = np.zeros(DIM + 1), np.zeros(DIM + 1)
    rows: list[tuple[np.ndarray, int]] = []
    for batch in slices(batches, 0):
        rows += [(f.astype(np.int32), y) for f, y in zip(features(batch.column(0)), batch.column(1).to_pylist())]

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(z[i]) <= L1, 0.0, w)

    for _ in range(EPOCHS if {y for _, y in rows} == {0, 1} else 0):
        for f, y in rows:
            i = np.append(f, DIM)
            x = np.append(np.full(len(f), 1.0 / np.sqrt(max(1, len(f)))), 1.0)
            w = weights(i)
            g = (_sigmoid(w @ x) - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    w = weights(np.arange(DIM + 1))
    if {y for _, y in rows} != {0, 1}:
        ones = sum(y for _, y in rows)
        w[DIM] = np.log((ones + 1) / (len(rows) - ones + 1))
    yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()], pa.binary())], ["weights"])


def train(rows: DataFrame) -> np.ndarray:
    """Weights from (text, label) rows; the same at any partitioning, because rows are learned in order of doc_id."""
    got = (rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text").select("text", "label")
           .mapInArrow(_train, "weights binary").first())
    return np.frombuffer(got[0], np.float32) if got else np.zeros(DIM + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in slices(batches, 1):
            s = [w[DIM] + w[f].sum(dtype=np.float64) / np.sqrt(max(1, len(f))) for f in features(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_sigmoid(np.array(s, float)))],
                                             ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; learns where crc32(doc_id) mod 3 is not 1."""
    weights = train(training_rows(docs, labels, "quality", 3, 1, max_train))
    return score(docs, weights).select(
        "doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
