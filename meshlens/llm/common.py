"""Helpers shared by the training-data operators: tables, scratch space, folds and hashed words.

Text is tokenised on UTF-8 bytes.  A word is a maximal run without the bytes 0x20 and 0x09-0x0D, which is the same
set of words as the pattern ``[^\\x20\\x09-\\x0D]+`` finds on code points.  Words and shingles are carried as 64-bit
hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlens.session import ensure_checkpoint_dir

SHINGLE = 5
#: Bytes of text hashed at a time; a longer document is cut at white space, so memory does not follow its length.
CHUNK_BYTES = 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SAME = np.arange(256, dtype=np.uint8)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate tables in the shared checkpoint folder; each cuts the lineage and survives lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *dfs: DataFrame) -> None:
        """Delete saved tables that nothing reads any more."""
        for df in dfs:
            for f in df.inputFiles()[:1]:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def text_id(text: Column) -> Column:
    """A hash of the text, which with the doc_id says which row is meant; null counts as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows of which ``gone`` has the doc_id (also null) and text_id; all columns stay."""
    gone = gone.select(F.col("doc_id").alias("_gone"), F.col("text_id").alias("_gone_text")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col("_gone"))
                     & (text_id(docs["text"]) == F.col("_gone_text")), "left_anti")


def remainder(mod: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % mod


def training_rows(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, max_rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``max_rows`` labelled documents outside the held-out fold.

    The rows are those with the smallest hash of their id, the same at any partitioning.  Only their ids are
    broadcast (at most ``max_rows``); contradictory repeated labels of one id take the largest.
    """
    ids = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder(mod) != held))
           .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    return (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
            .join(F.broadcast(ids), "doc_id"))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix_int(x: int) -> np.uint64:
    return mix(np.array([x & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))[0]


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row bounds of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    bounds = np.frombuffer(offsets, np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0]:bounds[-1]], bounds - bounds[0]


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``most`` bytes of a text column (one row at least)."""
    for batch in batches:
        ends = np.cumsum(np.r_[0, pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def _cuts(raw: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about CHUNK_BYTES that end at a row's end or, in a long row, at white space."""
    at, end = 0, int(bounds[-1])
    while at < end:
        to = at + CHUNK_BYTES
        if to >= end:
            to = end
        else:
            row_end = int(bounds[np.searchsorted(bounds, to, "right") - 1])
            if row_end > at:
                to = row_end
            else:
                step = to
                while step < end and not _SPACE[raw[step]]:
                    step += 1
                nxt = int(bounds[np.searchsorted(bounds, at, "right")])
                to = min(step, nxt)
        yield at, to
        at = to


def word_hashes(raw: np.ndarray, bounds: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each row the range of its words."""
    fold = _LOWER if lower else _SAME
    hashes, starts = [], []
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[bounds] = True
    for a, b in _cuts(raw, bounds):
        piece = raw[a:b]
        space = _SPACE[piece]
        begin = ~space
        begin[1:] &= space[:-1] | edge[a + 1:b]
        at = np.flatnonzero(begin)
        if not len(at):
            continue
        value = (fold[piece].astype(np.uint64) + np.uint64(1)) * _power(_BASE, b - a)[:b - a]
        value[space] = 0
        hashes.append(mix(np.add.reduceat(value, at) * _power(_BASE_INV, b - a)[at]))
        starts.append(at + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), bounds, "left")


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position on (of a whole batch; positions near a row's end overlap the next)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out += h[j:len(h) - n + 1 + j] * mix_int(j + 1)
    return mix(out ^ mix_int(1000 + n))


def shingle_sets(col: pa.Array, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its ``n``-word shingles; fewer words make one shingle.

    No word gives an empty set.
    """
    raw, bounds = utf8(col)
    h, words = word_hashes(raw, bounds)
    whole = grams(h, n)
    for s, e in zip(words[:-1].tolist(), words[1:].tolist()):
        if e - s >= n:
            yield np.unique(whole[s:e - n + 1])
        elif e > s:
            yield grams(h[s:e], e - s)
        else:
            yield np.zeros(0, np.uint64)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) for the nodes of undirected ``edges`` (a, b); ``comp`` is one node of the component.

    Each round maps every node to its smallest neighbour and contracts the edges by that map.  Ids are hashes, so
    a constant share of the nodes goes each round, however long the chains.  A hub's edges are pre-aggregated and
    its join is split by the adaptive skew rule.
    """
    edges = scratch.save(edges.select("a", "b").where("a <> b").distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = scratch.save(nodes.withColumn("comp", F.col("node")))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = scratch.save(both.groupBy(F.col("a").alias("comp")).agg(F.min("b").alias("low"))
                              .select("comp", F.least("comp", "low").alias("to")))
        moved = scratch.save(labels.join(parent, "comp", "left")
                             .select("node", F.coalesce("to", "comp").alias("comp")))
        pa_ = parent.select(F.col("comp").alias("a"), F.col("to").alias("ta"))
        pb_ = parent.select(F.col("comp").alias("b"), F.col("to").alias("tb"))
        shrunk = scratch.save(edges.join(pa_, "a").join(pb_, "b").where("ta <> tb")
                              .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        scratch.drop(labels, edges, parent)
        labels, edges = moved, shrunk
    return labels
