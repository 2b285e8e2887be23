"""Operator 1, exact dedup by deterministic block naming.

Every text is normalised (white space deleted) and cut into fixed-size byte blocks.  The distinct blocks are sorted
(within hash partitions) and numbered; then adjacent pairs of names likewise, until one name is left per document.  Two
documents carry the same (level, name) exactly when their normalised texts are equal: names stand for whole contents,
so there are no collisions.

Scale: each task first replaces equal blocks of a batch by one reference, so a block that a third of all documents
share crosses the shuffle once per batch, not once per document.  Only the dictionary of blocks (text, once) is
shuffled and sorted; everything after that is integers.

Cases: null text counts as empty and all empty texts are equal; among equal rows the longest original text stays,
then the smallest doc_id (null last); repeated rows of one doc_id form a group, one row of which has ``kept`` true;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlens.llm.common import Scratch

BLOCK_BYTES = 4096
_DELETE = b"\x20\x09\x0a\x0b\x0c\x0d"
_CUT = "rid long, doc_id long, code_points long, text_sha256 string, n_blocks int, refs array<long>, ref long, block binary"


def _cut(block_bytes: int):
    """Rows of documents (with references to blocks) and rows of the dictionary (reference and block)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            seen: dict[bytes, int] = {}
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                norm = (text or "").encode().translate(None, _DELETE)
                refs = []
                for i in range(0, max(1, len(norm)), block_bytes):
                    block = norm[i:i + block_bytes]
                    if block not in seen:
                        at += 1
                        seen[block] = at
                    refs.append(seen[block])
                at += 1
                rows.append((at, doc_id, len(text or ""), hashlib.sha256(norm).hexdigest(), len(refs), refs))
            n, m = len(rows), len(seen)
            cols = list(zip(*rows)) if rows else [[]] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c) + [None] * m, t) for c, t in zip(cols, types)]
                + [pa.array([None] * n + list(seen.values()), pa.int64()),
                   pa.array([None] * n + list(seen), pa.binary())],
                ["rid", "doc_id", "code_points", "text_sha256", "n_blocks", "refs", "ref", "block"])
    return run


def _name_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the distinct blocks of one sorted partition, one row at a time."""
    name, last = TaskContext.get().partitionId() << 40, None
    for batch in batches:
        names = []
        for block in batch.column(1).to_pylist():
            if block != last:
                name, last = name + 1, block
            names.append(name)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.int64())], ["ref", "name"])


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, level and name (the identity) of every row of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    cut = scratch.save(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
                       .mapInArrow(_cut(block_bytes), _CUT))
    meta = cut.where("block is null").select("rid", "doc_id", "code_points", "text_sha256", "n_blocks", "refs")
    blocks = cut.where("block is not null").select("ref", "block")

    # level 0: every block's partition is sorted and numbered in one pass; equal blocks meet once per batch at most
    named = scratch.save(blocks.repartition("block").sortWithinPartitions("block")
                         .mapInArrow(_name_runs, "ref long, name long"))
    cur = (meta.select("rid", "n_blocks", F.posexplode("refs").alias("pos", "ref"))
           .join(named, "ref").select("rid", F.col("n_blocks").alias("n"), "pos", "name"))
    cur = scratch.save(cur)
    longest = meta.agg(F.max("n_blocks")).first()[0] or 1
    done = cur.where("n = 1").select("rid", F.lit(0).alias("level"), "name")
    level = 0
    while longest > 1:
        level, longest = level + 1, (longest + 1) // 2
        pairs = (cur.where("n > 1").groupBy("rid", F.expr("cast((n + 1) div 2 as int)").alias("n"),
                                            F.expr("cast(pos div 2 as int)").alias("pos"))
                 .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("l"),
                      F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("r")))
        pairs = scratch.save(pairs)
        names = (pairs.select("l", "r").distinct().sortWithinPartitions("l", "r")
                 .withColumn("name", F.monotonically_increasing_id()))
        cur = scratch.save(pairs.join(names, ["l", "r"])
                           .select("rid", "n", "pos", "name"))
        done = done.union(cur.where("n = 1").select("rid", F.lit(level).alias("level"), "name"))

    ident = scratch.save(meta.drop("n_blocks", "refs").join(done, "rid"))
    best = F.struct("code_points", (-F.col("doc_id")).alias("minus_id"), (-F.col("rid")).alias("minus_rid"))
    groups = scratch.save(
        ident.groupBy("level", "name").agg(F.count("*").alias("group_size"), F.max(best).alias("best"))
        .select("level", "name", "group_size", (-F.col("best.minus_id")).alias("keep_id"),
                (-F.col("best.minus_rid")).alias("keep_rid")))  # saved, so that the join can split a large group
    return (ident.join(groups, ["level", "name"])
            .select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"),
                    "text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that exact dedup drops; all columns stay.

    Rows are matched by doc_id; of rows that repeat one doc_id and text, one stays.
    """
    row = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1 << 63))
    kept = exact_dedup(docs).where("kept").select(row.alias("_row"), F.col("text_sha256").alias("_sha"))
    norm = F.translate(F.coalesce("text", F.lit("")), " \t\n\x0b\x0c\r", "")
    return (docs.withColumns({"_row": row, "_sha": F.sha2(norm.cast("binary"), 256)})
            .join(kept, ["_row", "_sha"], "left_semi").dropDuplicates(["_row", "_sha"]).drop("_row", "_sha"))
