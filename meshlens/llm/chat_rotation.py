"""Operator 2, chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant and all
others as named users; the mask lists the character ranges of the assistant's texts, which alone count for the loss.

A rendering is stored in parts of ``PART_TURNS`` turns, cut by rank: the parts of a participant, joined in order, are the
one whole rendering, and ``start`` and the mask count from its beginning.  ``context`` repeats the system turn in force
where a part begins (the last one before it), for those who train on parts; it is no part of the rendering.

Scale: turns are range-partitioned by conversation and order, so a long conversation spreads over many tasks; a turn's
rank is its place in its partition plus the turns of its conversation in earlier partitions.  Offsets are prefix sums
over one row per part and participant.  No task holds more than a part's turns at once.

Cases: null text counts as empty, a null speaker as ``unknown``, a null turn as 0; a system turn is context for everyone
and nobody's perspective; a conversation of system turns only gives no rows; equal turn numbers keep the order of
speaker and md5 of the text; repeated rows are repeated turns; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshlens.llm.common import Scratch

PART_TURNS = 256


_SYSTEM, _SELF, _END = "<|system|>\n", "<|assistant|>\n", "<|end|>\n"


def _named(speaker: Column) -> Column:
    return F.concat(F.lit("<|user name="), speaker, F.lit("|>\n"))


def _mask(start: Column, pieces: Column, targets: Column, heads: Column) -> Column:
    """``start:end`` of each target text of a part, comma-joined; code points, end exclusive."""
    zero = F.struct(start.alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin, size = acc["at"] + F.length(x["head"]), F.length(x["piece"])
        end = acc["at"] + size - F.lit(len(_END))
        span = F.concat_ws(":", begin.cast("string"), end.cast("string"))
        return F.struct((acc["at"] + size).alias("at"),
                        F.when(x["target"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    zipped = F.arrays_zip(pieces.alias("piece"), targets.alias("target"), heads.alias("head"))
    return F.array_join(F.aggregate(zipped, zero, step)["spans"], ",")


def ranked(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """``turns`` with their ``rank`` (from 0) in their conversation."""
    order = ["conv_id", "turn", "speaker", "is_system", "_md5", "_row"]
    keyed = turns.withColumns({"_md5": F.md5(F.col("text").cast("binary")), "_row": F.monotonically_increasing_id()})
    placed = scratch.save(keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_md5", "_row")
                          .withColumn("_at", F.monotonically_increasing_id())
                          .withColumn("_run", F.shiftright("_at", 33)))
    earlier = Window.partitionBy("conv_id").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = (placed.groupBy("conv_id", "_run").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
            .withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
            .select(F.col("conv_id").alias("_conv"), F.col("_run").alias("_r"), "_first", "_before"))
    return (placed.join(runs, (F.col("_run") == F.col("_r")) & F.col("conv_id").eqNullSafe(F.col("_conv")))
            .withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before"))
            .drop("_at", "_run", "_conv", "_r", "_first", "_before"))


def rotate(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """One row per conversation, part and participant of ``turns`` (conv_id, turn, speaker, is_system, text).

    Columns: conv_id, part, participant, n_turns, n_targets, start, context, rendered, mask, rendered_sha256.
    """
    scratch = Scratch(turns.sparkSession)
    turns = turns.select("conv_id", F.coalesce(F.col("turn").cast("int"), F.lit(0)).alias("turn"),
                         F.coalesce("speaker", F.lit("unknown")).alias("speaker"),
                         F.coalesce("is_system", F.lit(False)).alias("is_system"),
                         F.coalesce("text", F.lit("")).alias("text"))
    turns = scratch.save(ranked(turns, scratch).withColumn("part", F.floor(F.col("rank") / part_turns).cast("int")))
    parts = (turns.groupBy("conv_id", "part")
             .agg(F.array_sort(F.collect_list(F.struct("rank", "speaker", "is_system", "text"))).alias("turns")))

    # sizes: every turn under its speaker's name, and how many turns of a part are whose
    head = F.when(F.col("is_system"), F.lit(_SYSTEM)).otherwise(_named(F.col("speaker")))
    sizes = turns.groupBy("conv_id", "part").agg(
        F.sum(F.length(head) + F.length("text") + len(_END)).alias("size"),
        F.max_by("text", F.when(F.col("is_system"), F.col("rank"))).alias("system"))
    by_part = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("system", F.last("system", True).over(by_part))
    own = (turns.where(~F.col("is_system")).groupBy("conv_id", "part", F.col("speaker").alias("participant"))
           .agg(F.count("*").alias("own")))
    own = scratch.save(own)
    people = own.select(F.col("conv_id").alias("_conv"), "participant").distinct()
    slim = sizes.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    slim = (slim.join(own.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"),
                                 F.col("participant").alias("_who"), "own"),
                      F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))
                      & (F.col("participant") == F.col("_who")), "left")
            .withColumn("size", F.col("size") - F.coalesce("own", F.lit(0))
                        * (F.length(_named(F.col("participant"))) - len(_SELF))))
    before = Window.partitionBy("conv_id", "participant").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    slim = slim.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), "participant", "system",
                       F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))

    me = F.col("participant")
    target = F.transform("turns", lambda t: (t["speaker"] == me) & ~t["is_system"])
    heads = F.transform("turns", lambda t: F.when(t["is_system"], F.lit(_SYSTEM))
                        .when(t["speaker"] == me, F.lit(_SELF)).otherwise(_named(t["speaker"])))
    piece = F.transform(F.arrays_zip("turns", "heads"),
                        lambda x: F.concat(x["heads"], x["turns"]["text"], F.lit(_END)))
    return (parts.join(slim, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")))
            .withColumns({"targets": target, "heads": heads}).withColumn("pieces", piece)
            .select("conv_id", "part", "participant", F.size("turns").alias("n_turns"),
                    F.size(F.filter("targets", lambda t: t)).alias("n_targets"), "start",
                    F.coalesce(F.concat(F.lit(_SYSTEM), "system", F.lit(_END)), F.lit("")).alias("context"),
                    F.array_join("pieces", "").alias("rendered"),
                    _mask(F.col("start"), F.col("pieces"), F.col("targets"), F.col("heads")).alias("mask"))
            .withColumn("rendered_sha256", F.sha2(F.col("rendered").cast("binary"), 256)))


def speakers(conversations: DataFrame) -> DataFrame:
    """The turns of a (conv_id, turn, role, text) table; its user turns alternate between two named people."""
    role = F.coalesce("role", F.lit("unknown"))
    name = F.when(role == "user", F.concat(F.lit("user"), F.pmod(F.floor(F.coalesce("turn", F.lit(0)) / 2), F.lit(2))
                                           .cast("string"))).otherwise(role)
    return conversations.select("conv_id", "turn", name.alias("speaker"), (role == "system").alias("is_system"), "text")
