"""Operator 9, benchmark decontamination by SimHash of item-sized windows.

Every benchmark item has a 64-bit SimHash of its five-word shingles, weighted by how often each occurs.  A document is
read in windows of as many words as an item has; a window without any shingle of such an item has similarity 0 with
it and is passed over.  The fingerprints of the other windows are looked up in a multi-index: with ``RADIUS`` + 1
blocks of bits, every item within the Hamming radius agrees with the window in one block at least.  The pairs found
within the radius are verified by their exact weighted-shingle (multiset) Jaccard similarity, 0.8 or more.

At similarity 0.8 two fingerprints differ in 9.7 of 64 bits on average, with a deviation of 2.9; a radius of 20 is
3.5 deviations above that.

Scale: documents stay where they are (no shuffle).  The index of the items is broadcast in blocks of ``BLOCK_BYTES`` of
item text at most; a larger benchmark takes several passes over the documents, each with a block of bounded size.
For several passes the rows are saved with a key of their own first, and the passes are merged by that key.

Cases: null or empty items and documents match nothing; fewer than five words make one shingle, so such an item must
occur word for word; equal items are all reported, in order; of equal similarities the smallest item_id is the best;
a document shorter than an item is compared whole; empty tables give clean documents or no rows; every row is
judged by itself at any number of passes, also with a repeated or null doc_id; other columns are harmless.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlens.llm.common import SHINGLE, Scratch, grams, slices, text_id, utf8, without, word_hashes

RADIUS = 20
SIMILARITY = 0.8
#: Bytes of item text in one broadcast index.
BLOCK_BYTES = 16 << 20
_FILTER_BITS = 22
_CUTS = np.linspace(0, 64, RADIUS + 2).astype(int)


def fingerprints(g: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """SimHash of the ``width`` shingles from each start on; a shingle counts as often as it occurs."""
    out = np.zeros(len(starts), np.uint64)
    breaks = np.flatnonzero(np.diff(starts) > 1) + 1
    for run in np.split(np.arange(len(starts)), breaks):
        for part in np.array_split(run, 1 + len(run) // 4096):
            if not len(part):
                continue
            a, b = int(starts[part[0]]), int(starts[part[-1]]) + width
            bits = np.unpackbits(g[a:b].view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
            total = np.vstack([np.zeros((1, 64), np.int32), np.cumsum(2 * bits - 1, axis=0)])
            at = starts[part] - a
            out[part] = np.packbits(total[at + width] - total[at] > 0, axis=1).view(np.uint64).ravel()
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Multiset Jaccard similarity of two lists of shingles."""
    x, m = np.unique(a, return_counts=True)
    y, n = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(m[i], n[j]).sum())
    return both / max(1, len(a) + len(b) - both)


class Index:
    """The items of one block: by shingle size and length in words, their shingles, fingerprints and block tables."""

    def __init__(self, ids: list[int], texts: list[str]):
        raw, bounds = utf8(pa.array(texts, pa.string()))
        h, words = word_hashes(raw, bounds)
        groups: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for item, s, e in zip(ids, words[:-1].tolist(), words[1:].tolist()):
            if e > s:
                n = min(SHINGLE, e - s)
                groups.setdefault((n, e - s), []).append((item, grams(h[s:e], n)))
        self.sizes: dict[int, list[dict]] = {}
        for (n, length), items in sorted(groups.items()):
            fp = np.concatenate([fingerprints(g, np.zeros(1, np.int64), len(g)) for _, g in items])
            tables = []
            for a, b in zip(_CUTS[:-1].tolist(), _CUTS[1:].tolist()):
                block = self._block(fp, a, b)
                order = np.argsort(block, kind="stable")
                tables.append((a, b, block[order], order))
            self.sizes.setdefault(n, []).append(
                {"length": length, "items": items, "fp": fp, "tables": tables,
                 "shingles": np.unique(np.concatenate([g for _, g in items]))})
        self.vocab = {n: np.unique(np.concatenate([c["shingles"] for c in classes]))
                      for n, classes in self.sizes.items()}
        self.filter = {}
        for n, v in self.vocab.items():
            self.filter[n] = np.zeros(1 << _FILTER_BITS, bool)
            self.filter[n][(v >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    @staticmethod
    def _block(fp: np.ndarray, a: int, b: int) -> np.ndarray:
        return (fp >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)

    def hits(self, g: np.ndarray, n: int) -> np.ndarray:
        """Positions whose shingle some item has."""
        at = np.flatnonzero(self.filter[n][(g >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        v = self.vocab[n]
        return at[v[np.minimum(np.searchsorted(v, g[at]), len(v) - 1)] == g[at]]

    @classmethod
    def candidates(cls, group: dict, fp: np.ndarray) -> np.ndarray:
        """(window, item) pairs within the radius: one equal block is needed, so none is missed."""
        found = []
        for a, b, values, order in group["tables"]:
            block = cls._block(fp, a, b)
            lo, hi = np.searchsorted(values, block, "left"), np.searchsorted(values, block, "right")
            window = np.repeat(np.arange(len(fp)), hi - lo)
            item = order[np.arange(len(window)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
                         + np.repeat(lo, hi - lo)]
            found.append(window[np.bitwise_count(fp[window] ^ group["fp"][item]) <= RADIUS] * len(values)
                         + item[np.bitwise_count(fp[window] ^ group["fp"][item]) <= RADIUS])
        return np.unique(np.concatenate(found))

    def matches(self, g: np.ndarray, at: np.ndarray, n: int) -> dict[int, float]:
        """Best similarity per item for a document with shingles ``g``, of which ``at`` are some item's."""
        best: dict[int, float] = {}
        for group in self.sizes[n]:
            own = at[np.isin(g[at], group["shingles"])]
            if not len(own):
                continue
            width = min(group["length"] - n + 1, len(g))
            spread = np.zeros(len(g) + 1, np.int32)
            np.add.at(spread, np.maximum(0, own - width + 1), 1)
            np.add.at(spread, np.minimum(own, len(g) - width) + 1, -1)
            starts = np.flatnonzero(np.cumsum(spread[:len(g) - width + 1]) > 0)
            pairs = self.candidates(group, fingerprints(g, starts, width))
            for w, i in zip((pairs // len(group["fp"])).tolist(), (pairs % len(group["fp"])).tolist()):
                item, shingles = group["items"][i]
                if best.get(item, 0.0) < 1.0:
                    s = similarity(g[starts[w]:starts[w] + width], shingles)
                    if s >= SIMILARITY:
                        best[item] = max(s, best.get(item, 0.0))
        return best


def _search(index) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx: Index = index.value
        for batch in slices(batches, 1):
            raw, bounds = utf8(batch.column(1))
            h, words = word_hashes(raw, bounds)
            found: list[dict[int, float]] = [{} for _ in range(batch.num_rows)]
            for n in idx.sizes:
                g = grams(h, n)
                at = idx.hits(g, n)
                row = np.searchsorted(words, at, "right") - 1
                ok = at + n <= words[row + 1]
                at, row = at[ok], row[ok]
                for r in np.unique(row).tolist():
                    s, e = int(words[r]), int(words[r + 1]) - n + 1
                    found[r] |= idx.matches(g[s:e], at[row == r] - s, n)
            items = [sorted(f) for f in found]
            best = [min(f, key=lambda i, f=f: (-f[i], i)) if f else None for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(items, pa.list_(pa.int64())), pa.array(best, pa.int64()),
                 pa.array([f[b] if f else 0.0 for f, b in zip(found, best)], pa.float64()), *batch.columns[2:]],
                ["doc_id", "items", "best_item", "similarity", *batch.schema.names[2:]])
    return run


def _judged(rows: DataFrame, benchmark: DataFrame, block_bytes: int) -> DataFrame:
    """items, best_item, similarity and all columns but the text of each row of ``rows`` (doc_id, text, _row, ...).

    _row is a number, unique per row; columns after it are numbers too.
    """
    spark = rows.sparkSession
    bench = (benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
             .where("item_id is not null and text is not null").distinct())
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = 1 + int(size // block_bytes)
    if passes > 1:  # saved, so that a row has the same key in every pass
        rows = Scratch(spark).save(rows)
    out = None
    for p in range(passes):  # each pass has a block of items of about block_bytes
        block = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).orderBy("item_id", "text").collect()
        index = spark.sparkContext.broadcast(Index([r["item_id"] for r in block], [r["text"] for r in block]))
        found = rows.mapInArrow(_search(index), "doc_id long, items array<long>, best_item long, similarity double, "
                                + ", ".join(f"{c} long" for c in rows.columns[2:]))
        out = found if out is None else out.union(found)
    if passes > 1:
        best = F.max_by("best_item", F.struct("similarity", -F.col("best_item")))
        out = out.groupBy("_row").agg(*(F.first(c).alias(c) for c in ["doc_id", *rows.columns[3:]]),
                                      F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
                                      best.alias("best_item"), F.max("similarity").alias("similarity"))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, contaminated, items (ids found), best_item and similarity of every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"),
                       F.monotonically_increasing_id().alias("_row"))
    return _judged(rows, benchmark, block_bytes).select("doc_id", (F.size("items") > 0).alias("contaminated"), "items",
                                                        "best_item", "similarity")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns stay."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"),
                       F.monotonically_increasing_id().alias("_row"), text_id(F.col("text")).alias("text_id"))
    return without(docs, _judged(rows, benchmark, BLOCK_BYTES).where("size(items) > 0"))
