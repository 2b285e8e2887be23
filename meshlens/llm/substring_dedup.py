"""Operator 11, substring dedup by level-wise doubling.

A window is ``window`` consecutive words of one document; every word goes that is covered by a window whose words also
start anywhere else.  Windows are compared level by level, at lengths that double up to ``window`` (35: 9, 18, 35); the
hash of a length is made from two hashes of the length before.  Only windows repeated at one length are extended to
the next, and the search ends when no candidate survives.

Below the full length a window stands or falls with its anchor, the sub-window of least hash in it: equal windows have
equal anchors at the same offset, so a window whose anchor occurs once in the corpus is not repeated.  About one
sub-window in fourteen (nine, at the second level) is an anchor, so only those cross the shuffle.  At the full length
every surviving window is compared by 96 bits of two independent hash chains.

"Which of these values occur more than once" is asked of the whole table in the same way at every level: each batch of
documents sends its distinct values, sorted, to buckets by hash; a bucket answers with one bit per value.  A value that
a third of all documents share thus crosses the shuffle once per batch, and the number of buckets grows with the number
of values, so a bucket stays bounded.  Texts are read again only for documents with surviving windows.  Memory follows
BATCH_BYTES and the longest single text.

Cases: null or empty text, or text of white space, has no words (the digest is that of empty text); fewer words than
the window keep all; windows overlapping their own copies count as repeated; repeated rows repeat each other's windows;
an empty table gives no rows; a null doc_id stays null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlens.llm.common import Scratch, grams, mix, mix_int, slices, text_id, utf8, word_hashes

WINDOW = 35
#: The first length is at most this; a window no longer than it is compared at its full length alone.
BASE = 9
#: Bytes of text in a batch (one document at least).
BATCH_BYTES = 4 << 20
#: Values in a bucket, on average.
BUCKET_VALUES = 1 << 20

_U = np.uint64
_EVEN, _NONE = _U(0xFFFFFFFFFFFFFFFE), _U(0xFFFFFFFFFFFFFFFF)
_LEFT, _RIGHT, _SECOND, _KEY = mix_int(1101), mix_int(1102), mix_int(1103), mix_int(1104)


def lengths(window: int, base: int = BASE) -> list[int]:
    """The compared lengths, each at most twice the one before: 35 gives 9, 18, 35."""
    out = [window]
    while out[0] > base:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _longer(h: np.ndarray, length: int, to: int) -> np.ndarray:
    """Hashes of the windows of ``to`` words from those of ``length``, of which two cover it."""
    n, shift = len(h) + length - to, to - length
    if n <= 0:
        return np.zeros(0, _U)
    return mix(h[:n] * _LEFT + mix(h[shift:shift + n] ^ _RIGHT)) if shift else h


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """The least of the ``w`` values from each position on."""
    have = 1
    while have < w:
        step = min(have, w - have)
        v = np.minimum(v[:len(v) - step], v[step:])
        have += step
    return v


def _anchors(h: np.ndarray, alive: np.ndarray, w: int) -> np.ndarray:
    """Positions of the least of the ``w`` hashes from each position that is alive (all of them on a tie)."""
    if not alive.any():
        return np.zeros(0, np.int64)
    pad = np.full(w - 1, _NONE)
    least = np.where(alive, ~_least(h, w)[:len(alive)], _NONE)
    greatest = ~_least(np.r_[pad, least, pad], w)  # of the least hashes whose stretch holds the position
    return np.flatnonzero(greatest[:len(h)] == h)


def _distinct(values: np.ndarray, check: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, their checks, whether each occurs more than once, and the rank of every value."""
    key = mix(values ^ _KEY)
    order = np.argsort(key, kind="stable") if check is None else np.lexsort((check, key))
    key = key[order]
    other = np.zeros(0, np.uint32) if check is None else check[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    if check is not None:
        new[1:] |= other[1:] != other[:-1]
    first = np.flatnonzero(new)
    rank = np.empty(len(key), np.uint32)
    rank[order] = np.cumsum(new) - 1
    return key[first], other[first] if check is not None else other, np.diff(np.r_[first, len(key)]) > 1, rank


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def _cell(table: pa.Table | pa.RecordBatch, name: str, kind: type = np.uint8) -> np.ndarray:
    return np.frombuffer(table.column(name)[0].as_buffer(), kind)


def _list(values, kind: pa.DataType) -> pa.Array:
    return pa.array([values], pa.list_(kind))


_STATE = ("batch long, doc_id array<long>, text_id array<long>, n_words array<long>, alive binary, n_keys long, "
          "keys binary, checks binary, multi binary")


def _state(batch: int, doc_id, text_id, n_words, alive: np.ndarray, levels: list, more: dict) -> pa.RecordBatch:
    """One row of a batch: its documents, the windows alive, the keys to judge next and the anchors of each level."""
    keys, _, multi, _ = _distinct(levels[0][1] if levels else np.zeros(0, _U))
    cols = {"batch": pa.array([batch], pa.int64()), "doc_id": _list(doc_id, pa.int64()),
            "text_id": _list(text_id, pa.int64()), "n_words": _list(n_words, pa.int64()),
            "alive": pa.array([_bits(alive)], pa.binary()), "n_keys": pa.array([len(keys)], pa.int64()),
            "keys": pa.array([keys.tobytes()], pa.binary()), "checks": pa.array([b""], pa.binary()),
            "multi": pa.array([_bits(multi)], pa.binary())}
    for j, (at, value) in enumerate(levels):
        cols[f"at{j}"] = pa.array([at.astype(np.uint32).tobytes()], pa.binary())
        cols[f"value{j}"] = pa.array([value.tobytes()], pa.binary())
    cols |= more
    return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def _level_columns(n: int) -> str:
    return "".join(f", at{j} binary, value{j} binary" for j in range(n))


def _first(sizes: list[int]) -> Callable:
    """Batches of (doc_id, text, text_id) as state rows; every window is alive at first."""
    window = sizes[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for batch in slices(batches, 1, BATCH_BYTES):
            at += 1
            raw, bounds = utf8(batch.column(1))
            h, words = word_hashes(raw, bounds, lower=False)
            alive = np.zeros(max(0, len(h) - window + 1), dtype=bool)
            for s, e in zip(words[:-1].tolist(), words[1:].tolist()):
                alive[s:max(s, e - window + 1)] = True
            levels = []
            for j, size in enumerate(sizes[:-1]):
                h = _longer(h, sizes[j - 1], size) if j else grams(h, size)
                h = np.maximum(h & _EVEN, _U(2))
                pos = _anchors(h, alive, window - size + 1)
                levels.append((pos, h[pos]))
            whole = memoryview(raw.tobytes())
            sha = [hashlib.sha256(b" ".join(bytes(whole[s:e]).split())).digest()
                   for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield _state(at, batch.column(0).to_pylist(), batch.column(2).to_pylist(), np.diff(words), alive, levels,
                         {"sha": _list(sha, pa.binary())})
    return run


def _deal(buckets: int) -> Callable:
    """The distinct values of each batch, by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                row = rows.slice(i, 1)
                keys, checks = _cell(row, "keys", _U), _cell(row, "checks", np.uint32)
                if not len(keys):
                    continue
                multi = _flags(row.column("multi")[0].as_py(), len(keys))
                bucket = ((keys >> _U(32)) * _U(buckets)) >> _U(32)
                first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                ends = np.r_[first[1:], len(keys)]
                pairs = list(zip(first.tolist(), ends.tolist()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row.column("batch")[0].as_py()] * len(first), pa.int64()),
                     pa.array(bucket[first].astype(np.int64)),
                     pa.array([keys[s:e].tobytes() for s, e in pairs], pa.binary()),
                     pa.array([checks[s:e].tobytes() for s, e in pairs], pa.binary()),
                     pa.array([_bits(multi[s:e]) for s, e in pairs], pa.binary())],
                    ["batch", "bucket", "keys", "checks", "multi"])
    return run


def _judge(table: pa.Table) -> pa.Table:
    """For every batch's values in one bucket, a bit each: whether the value occurs more than once in the table."""
    keys = [np.frombuffer(v.as_buffer(), _U) for v in table.column("keys")]
    sizes = [len(k) for k in keys]
    multi = np.concatenate([_flags(v.as_py(), n) for v, n in zip(table.column("multi"), sizes)])
    key = np.concatenate(keys)
    check = np.concatenate([np.frombuffer(v.as_buffer(), np.uint32) for v in table.column("checks")])
    order = np.lexsort((check, key)) if len(check) else np.argsort(key, kind="stable")
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    if len(check):
        new[1:] |= check[order[1:]] != check[order[:-1]]
    first = np.flatnonzero(new)
    several = (np.diff(np.r_[first, len(key)]) > 1) | np.logical_or.reduceat(multi[order], first)
    seen = np.empty(len(key), dtype=bool)
    seen[order] = several[np.cumsum(new) - 1]
    ends = np.cumsum(sizes)
    return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "n": pa.array(sizes, pa.int64()),
                     "seen": pa.array([_bits(seen[e - n:e]) for n, e in zip(sizes, ends.tolist())], pa.binary())})


def _repeated(state: DataFrame, total: int) -> DataFrame:
    """(batch, bucket, n, seen): the buckets' answers about the ``total`` keys of ``state``."""
    buckets = max(int(state.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_VALUES))
    return (state.select("batch", "keys", "checks", "multi")
            .mapInArrow(_deal(buckets), "batch long, bucket long, keys binary, checks binary, multi binary")
            .groupBy("bucket").applyInArrow(_judge, "batch long, bucket long, n long, seen binary"))


def _answer(table: pa.Table) -> np.ndarray:
    """A batch's flags, in the order of its keys."""
    parts = sorted(zip(table.column("bucket").to_pylist(), table.column("n").to_pylist(), table.column("seen").to_pylist()))
    return np.concatenate([np.zeros(0, bool), *(_flags(bits, n) for _, n, bits in parts)])


def _extend(sizes: list[int], level: int) -> Callable:
    """State rows after ``level``: windows whose anchor is not repeated go, the anchors of the others come next."""
    window = sizes[-1]

    def run(state: pa.Table, answers: pa.Table) -> pa.Table:
        n_words = np.array(state.column("n_words")[0].as_py(), np.int64)
        total = int(n_words.sum())
        alive = _flags(state.column("alive")[0].as_py(), max(0, total - window + 1))
        levels = [(_cell(state, f"at{j}", np.uint32).astype(np.int64), _cell(state, f"value{j}", _U))
                  for j in range(len(sizes) - 1 - level)]
        (at, value), rest = levels[0], levels[1:]
        _, _, _, rank = _distinct(value)
        h = np.full(max(0, total - sizes[level] + 1), _NONE)
        h[at] = value | _answer(answers)[rank].astype(_U)  # hashes are even: the last bit says repeated
        if len(alive):
            alive &= (_least(h, window - sizes[level] + 1)[:len(alive)] & _U(1)).astype(bool)
        kept = []
        for j, (at, value) in enumerate(rest, level + 1):
            h = np.full(max(0, total - sizes[j] + 1), _NONE)
            h[at] = value
            pos = _anchors(h, alive, window - sizes[j] + 1)
            kept.append((pos, h[pos]))
        return pa.Table.from_batches([_state(
            state.column("batch")[0].as_py(), state.column("doc_id")[0].as_py(), state.column("text_id")[0].as_py(),
            n_words, alive, kept, {})])
    return run


def _runs(flags: np.ndarray) -> np.ndarray:
    """Starts and ends of the runs of true flags, one after the other."""
    return np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))


def _alive_documents(window: int) -> Callable:
    """(doc_id, text_id, runs): documents with windows alive, and the runs of their first words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                row = rows.slice(i, 1)
                ends = np.cumsum(row.column("n_words")[0].as_py() or [0]).tolist()
                total = ends[-1]
                flags = np.zeros(total, dtype=bool)
                n = max(0, total - window + 1)
                flags[:n] = _flags(row.column("alive")[0].as_py(), n)
                out = []
                for d, t, s, e in zip(row.column("doc_id")[0].as_py(), row.column("text_id")[0].as_py(), [0, *ends], ends):
                    runs = _runs(flags[s:e])
                    if len(runs):
                        out.append((d, t, runs.astype(np.uint32).tobytes()))
                cols = list(zip(*out)) if out else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                                                  pa.array(cols[2], pa.binary())], ["doc_id", "text_id", "runs"])
    return run


_FULL = ("batch long, doc_id array<long>, text_id array<long>, text array<binary>, runs array<binary>, n_keys long, "
         "keys binary, checks binary, multi binary, rank binary")


def _covered(runs: np.ndarray) -> np.ndarray:
    """Positions in the runs (start, end, start, end, ...)."""
    s, e = runs[::2].astype(np.int64), runs[1::2].astype(np.int64)
    n = e - s
    return np.repeat(s - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())


def _full(sizes: list[int]) -> Callable:
    """State rows of the full length: texts, runs and the distinct windows that are still candidates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_id = TaskContext.get().partitionId() << 32
        for batch in slices(batches, 2, BATCH_BYTES):
            batch_id += 1
            raw, bounds = utf8(batch.column(2))
            h, words = word_hashes(raw, bounds, lower=False)
            one, two = h, mix(h ^ _SECOND)
            for j, size in enumerate(sizes):
                one, two = ((_longer(x, sizes[j - 1], size) if j else grams(x, size)) for x in (one, two))
            runs = [np.frombuffer(v.as_buffer(), np.uint32) for v in batch.column(3)]
            at = np.concatenate([_covered(r) + s for r, s in zip(runs, words[:-1].tolist())])
            keys, checks, multi, rank = _distinct(one[at], (two[at] >> _U(32)).astype(np.uint32))
            text = batch.column(2).cast(pa.large_string()).cast(pa.large_binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch_id], pa.int64()), _list(batch.column(0).to_pylist(), pa.int64()),
                 _list(batch.column(1).to_pylist(), pa.int64()), _list(text.to_pylist(), pa.binary()),
                 _list([r.tobytes() for r in runs], pa.binary()), pa.array([len(keys)], pa.int64()),
                 pa.array([keys.tobytes()], pa.binary()), pa.array([checks.tobytes()], pa.binary()),
                 pa.array([_bits(multi)], pa.binary()), pa.array([rank.tobytes()], pa.binary())],
                ["batch", "doc_id", "text_id", "text", "runs", "n_keys", "keys", "checks", "multi", "rank"])
    return run


_CHANGED = "doc_id long, text_id long, n_removed long, kept_sha binary, kept string, spans array<struct<start:long,end:long>>"


def _render(window: int, texts: bool) -> Callable:
    """Documents that lose words: how many, the digest, and with ``texts`` the kept text and the removed word spans."""
    def run(state: pa.Table, answers: pa.Table) -> pa.Table:
        seen = _answer(answers)[_cell(state, "rank", np.uint32)]
        rows, at = [], 0
        for doc, tid, text, runs in zip(*(state.column(c)[0] for c in ("doc_id", "text_id", "text", "runs"))):
            start = _covered(np.frombuffer(runs.as_buffer(), np.uint32))
            start = start[seen[at:(at := at + len(start))]]
            if not len(start):
                continue
            words = text.as_py().split()
            depth = np.zeros(len(words) + 1, np.int64)
            depth[start] += 1
            np.add.at(depth, start + window, -1)
            gone = np.cumsum(depth[:-1]) > 0
            kept = b" ".join(compress(words, (~gone).tolist()))
            spans = _runs(gone).reshape(-1, 2).tolist() if texts else []
            rows.append((doc.as_py(), tid.as_py(), int(gone.sum()), hashlib.sha256(kept).digest(),
                         kept.decode() if texts else None, [{"start": s, "end": e} for s, e in spans]))
        cols = list(zip(*rows)) if rows else [[]] * 6
        return pa.table([pa.array(c, t) for c, t in zip(cols, (
            pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(),
            pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))],
            names=["doc_id", "text_id", "n_removed", "kept_sha", "kept", "spans"])
    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       text_id(F.col("text")).alias("text_id"))


def _same_row(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_id"] == b["text_id"])


def _searched(docs: DataFrame, window: int, texts: bool) -> tuple[DataFrame, DataFrame]:
    """State rows of all documents, and the changed documents, one row per doc_id and text."""
    spark, sizes = docs.sparkSession, lengths(window)
    scratch = Scratch(spark)
    docs = _keyed(docs)
    first = scratch.save(docs.select("doc_id", "text", "text_id").mapInArrow(
        _first(sizes), _STATE + _level_columns(len(sizes) - 1) + ", sha array<binary>"))
    state, none = first.drop("sha"), spark.createDataFrame([], _CHANGED)
    for level in range(len(sizes) - 1):
        total = state.agg(F.sum("n_keys")).first()[0] or 0
        if not total:
            return first, none
        state = scratch.save(
            state.drop("n_keys", "keys", "checks", "multi").groupBy("batch")
            .cogroup(_repeated(state, total).groupBy("batch"))
            .applyInArrow(_extend(sizes, level), _STATE + _level_columns(len(sizes) - 2 - level)))
    alive = scratch.save(state.select("doc_id", "text_id", "n_words", "alive")
                         .mapInArrow(_alive_documents(window), "doc_id long, text_id long, runs binary")
                         .groupBy("doc_id", "text_id").agg(F.first("runs").alias("runs")))
    full = scratch.save(docs.join(alive, _same_row(docs, alive))
                        .select(docs["doc_id"], docs["text_id"], "text", "runs").mapInArrow(_full(sizes), _FULL))
    total = full.agg(F.sum("n_keys")).first()[0] or 0
    if not total:
        return first, none
    changed = (full.select("batch", "doc_id", "text_id", "text", "runs", "rank").groupBy("batch")
               .cogroup(_repeated(full, total).groupBy("batch")).applyInArrow(_render(window, texts), _CHANGED))
    return first, scratch.save(changed.dropDuplicates(["doc_id", "text_id"]))


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of ``docs``."""
    first, changed = _searched(docs, window, texts=False)
    rows = (first.select(F.explode(F.arrays_zip("doc_id", "text_id", "n_words", "sha")).alias("r")).select("r.*"))
    return (rows.join(changed, _same_row(rows, changed), "left")
            .select(rows["doc_id"], "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
                    F.lower(F.hex(F.coalesce("kept_sha", "sha"))).alias("kept_sha256")))


def removed_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_id, n_removed, kept (text) and spans (of word numbers, end exclusive) of documents that lose words."""
    return _searched(docs, window, texts=True)[1].drop("kept_sha")


def drop_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the text of documents that lose words replaced by the kept words, joined by one space."""
    changed = removed_spans(docs, window).select(F.col("doc_id").alias("_id"), F.col("text_id").alias("_text"),
                                                 F.col("kept").alias("_kept"))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (text_id(docs["text"]) == F.col("_text"))
    return docs.join(changed, same, "left").withColumn("text", F.coalesce("_kept", "text")).drop("_id", "_text", "_kept")
