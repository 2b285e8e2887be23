"""Operator 6, language identification by error-correcting output codes.

Every language has a codeword of bits; one binary classifier over hashed character n-grams (1 to 3 bytes of the
lower-cased text, signs other than letters as one blank) predicts each bit.  Decoding is weighted by loss: the
languages are ranked by the logistic loss of their codeword against the margins, and the nearest one wins.  Up to 6
languages get the exhaustive code, more get the best of several random codes of 4 bits per doubling.  A prediction
whose two smallest losses lie within ``AMBIGUOUS`` is flagged.

Every language of the training rows is learned: the languages are counted over all of them, and the sample is drawn
per language, an equal part of ``MAX_TRAIN`` documents each but ``LEAST`` at the least (all, where it has fewer).  So the
sample is bounded by ``MAX_TRAIN`` documents or by ``LEAST`` a language.  Scoring is one pass over Arrow batches without
a shuffle.

Cases: null text or text without a letter gives ``und`` with score 0; rows of null lang are not learned from; without
any training row all documents are ``und``, with one language that language wins; ties go to the smaller language
value; repeated rows are predicted alike, and one of them is learned from; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshlens.llm.common import CHUNK_BYTES, remainder, utf8

DIM = 2048
MAX_TRAIN = 3000
#: Documents a language is learned from at least, if it has them.
LEAST = 20
AMBIGUOUS = 0.5
STEPS, RATE, DECAY = 300, 8.0, 1e-4

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def histograms(col: pa.Array) -> Iterator[np.ndarray]:
    """For each row the square roots of the shares of its n-gram slots."""
    raw, bounds = utf8(col)
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        total = np.zeros(DIM, np.int64)
        for a in range(s, e, CHUNK_BYTES):
            b = _FOLD[raw[a:min(e, a + CHUNK_BYTES + 2)]].astype(np.uint32)
            own = min(e, a + CHUNK_BYTES) - a
            one = b * np.uint32(0x9E3779B1)
            two = (b[:-1] * np.uint32(0x85EBCA6B)) ^ (b[1:] * np.uint32(0xC2B2AE35))
            three = two[:-1] * np.uint32(0x27D4EB2F) + b[2:] * np.uint32(0x165667B1)
            for gram in (one[:own], two[:own] * np.uint32(0x9E3779B1), three[:own] ^ (three[:own] >> np.uint32(15))):
                total += np.bincount((gram * np.uint32(0x7FEB352D)) >> np.uint32(21), minlength=DIM)
        yield np.sqrt(total / max(1, total.sum())).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """``n`` rows of bits (-1, 1): exhaustive up to 6 languages, else the random code of the largest least distance."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        bits = np.arange(1, 2 ** (n - 1))
        rest = (bits[None, :] >> np.arange(n - 1)[:, None]) & 1
        return np.vstack([np.ones((1, len(bits)), int), 1 - 2 * rest]).astype(np.int8)
    width = 4 * int(np.ceil(np.log2(n))) + 3
    best, most = None, -1
    for seed in range(50):
        code = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (n, width))
        code = code[:, np.abs(code.sum(0)) < n]
        near = ((code[:, None, :] != code[None, :, :]).sum(2) + 10 * width * np.eye(n, dtype=int)).min()
        if near > most:
            best, most = code, near
    return best


def _hist_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = [x.tobytes() for x in histograms(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(h, pa.binary())],
                                         ["doc_id", "lang", "hist"])


def _sampled(docs: DataFrame, max_train: int) -> DataFrame | None:
    """(doc_id, lang) to learn from: of each language the ids of the smallest hashes, outside the held-out fold.

    A hash threshold from the language's number of ids leaves about twice as many rows as are wanted and 60 more, so
    that the ranks of a large language aren't computed over all its rows in one task.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (remainder(5) != 0)).select("doc_id", "lang")
    found = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).collect()
    if not found:
        return None
    each = max(LEAST, max_train // len(found))
    share = docs.sparkSession.createDataFrame([(r["lang"], (2.0 * each + 60) / max(1, r["n"])) for r in found],
                                              "lang string, share double")
    near = (rows.join(F.broadcast(share), "lang")
            .where(F.xxhash64("doc_id") / F.lit(2.0 ** 64) + 0.5 < F.col("share")).select("doc_id", "lang").distinct())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    return near.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= each).select("doc_id", "lang")


def train(docs: DataFrame, max_train: int = MAX_TRAIN) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, codewords and weights (DIM + 1 rows) from a bounded sample outside the held-out fold."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"),
                       F.coalesce("text", F.lit("")).alias("text"))
    ids = _sampled(docs, max_train)
    rows = [] if ids is None else (
        docs.join(F.broadcast(ids), ["doc_id", "lang"]).select("doc_id", "lang", "text")
        .mapInArrow(_hist_rows, "doc_id long, lang string, hist binary")
        .groupBy("doc_id", "lang").agg(F.min("hist").alias("hist")).collect())  # a repeated id counts once a language
    rows.sort(key=lambda r: (r["lang"], bytes(r["hist"])))
    langs = sorted({r["lang"] for r in rows})
    code = codewords(len(langs))
    weights = np.zeros((DIM + 1, code.shape[1] if langs else 0), np.float32)
    if len(langs) > 1:
        x = np.stack([np.frombuffer(r["hist"], np.float32) for r in rows])
        y = np.array([langs.index(r["lang"]) for r in rows])
        share = 1.0 / np.bincount(y)[y] / len(langs)  # each language counts alike
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        target = code[y].astype(np.float32)
        step = np.zeros_like(weights)
        for _ in range(STEPS):
            slope = -target / (1.0 + np.exp(np.clip(target * (x @ weights), -35, 35)))
            step = 0.9 * step + x.T @ (slope * share[:, None].astype(np.float32)) + DECAY * weights
            weights -= RATE * step
    return langs, code, weights


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of every row of ``docs``."""
    langs, code, weights = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = pc.fill_null(pc.match_substring_regex(batch.column(1), r"\p{L}"), False).to_pylist()
            out = []
            for has, h in zip(letters, histograms(batch.column(1))):
                if not has or not langs:
                    out.append(("und", 0.0, False))
                    continue
                margin = h @ weights[:DIM] + weights[DIM]
                loss = np.logaddexp(0.0, -code * margin).sum(1)
                near = np.exp(loss.min() - loss)
                order = np.argsort(loss, kind="stable")
                close = len(langs) > 1 and loss[order[1]] - loss[order[0]] < AMBIGUOUS
                out.append((langs[order[0]], float(near[order[0]] / near.sum()), bool(close)))
            pred, score, close = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())],
                ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def language_id(docs: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every row; learns where crc32(doc_id) mod 5 is not 0."""
    return predict(docs, train(docs, max_train)).select(
        "doc_id", (remainder(5) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")
