"""Operator 4, n-gram Jaccard join by parity sketches.

A document is the set of its distinct 5-word shingles.  Every shingle flips one bit of a wide sketch, so the Hamming
distance of two sketches is at most the symmetric difference of the sets.  Sets a, b with Jaccard >= 0.8 have a
symmetric difference of at most (|a| + |b|) / 9.  Per size band that gives a bound k; the sketch is split into
k + 1 + m blocks, so two linked sets agree in at least m + 1 of them.  Blocks are joined on equality, pairs are then
filtered by folds of the sketch (512 bits, then two to four bits a shingle; lower bounds again) and verified on the
exact sets.

Sizes are banded by powers of two: ``main`` sketches compare sets of one band, ``cross`` sketches those on either side
of a power of two (sizes from 0.8 L to 1.25 L).  An empty block says little, and neither does a block that very many
documents share, such as one that holds only a common passage.  Each document may leave out up to m blocks in one
global order (empty first, then by falling frequency): of m + 1 common blocks, the last in this order stays on both
sides.  No pair is lost by this, at any threshold of "frequent".

Equal sets form one class before anything is compared.  Large groups of near copies don't make all their pairs: first
each class is verified against one pivot and components are built; in blocks that are still frequent, classes outside
the block's largest component are verified against further pivots of it.  At last, per block key, the classes outside
the key's largest component are compared with the others of that key, only across components.  Every linked pair is
thus compared or already connected, and the components are exact.

Texts on one template that are not similar enough share frequent blocks without linking, so nothing collapses there.
In such keys each class counts its own shingles, which no other component of such keys has: they all differ in any pair
of counted classes across components, so two classes can link only if 9 * (own + own') <= n + n'.  Where 9 * own > n on both sides, the
pair is never made: rows short of own shingles meet all others of their key, the rest meet only those.

Cases: null or empty text, or text of white space, gives an empty set, linked with nothing; fewer than five words make
one shingle; repeated rows are equal sets; an empty table gives no rows; a null doc_id never names a component unless
no other id is in it; other columns are ignored.  Shingles and classes are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshlens.llm.common import Scratch, components, mix, mix_int, shingle_sets, slices, text_id, without

#: Longs of the folded sketch that filters pairs in joins.
FOLD = 8
#: A block key of more classes counts as frequent.  It moves work only: results are the same at any value.
FREQUENT = 32
#: Rounds of further pivots for large groups; like FREQUENT, it moves work only.
MORE_PIVOTS = 6
#: Frequent keys by which a class knows the pairs that it has met; like FREQUENT, it moves work only.
FIRST_KEYS = 32
#: Rows of (class, pair) that are broadcast to pick texts; beyond that the texts are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Classes that one task remembers so as not to emit the blocks of an equal set twice.
REMEMBER = 200_000
#: Sets that one group of verification compares with its pivot.
GROUP = 128

_U = np.uint64
_FOLDED = ["n", *(f"f{i}" for i in range(FOLD))]
_SPREAD, _ZOBRIST, _CLASS = mix_int(76), mix_int(77), mix_int(78)


class Sets:
    """The shingle sets of a batch, one after the other, with their ids and hashes."""

    def __init__(self, col: pa.Array):
        sets = list(shingle_sets(col))
        self.n = np.array([len(u) for u in sets], np.int64)
        self.at = np.r_[0, np.cumsum(self.n)]
        self.u = np.concatenate(sets) if sets else np.zeros(0, _U)
        self.spread = mix(self.u ^ _SPREAD) >> _U(32)
        self.zobrist = mix(self.u ^ _ZOBRIST)

    def ids(self) -> np.ndarray:
        """One 64-bit id per set (that of an empty one means nothing)."""
        total = np.r_[_U(0), np.cumsum(mix(self.u ^ _CLASS), dtype=_U)]
        return mix((total[self.at[1:]] - total[self.at[:-1]]) ^ mix(self.n.astype(_U))).view(np.int64)

    def block(self, i: int, total: int) -> np.ndarray:
        """The block of each shingle of a set, out of ``total``."""
        return (self.spread[self.at[i]:self.at[i + 1]] * _U(total)) >> _U(32)

    def folds(self) -> np.ndarray:
        """The sketches folded to 64 * FOLD bits."""
        width = 64 * FOLD
        row = np.repeat(np.arange(len(self.n)), self.n)
        bits = np.bincount(row * width + (self.zobrist % _U(width)).astype(np.int64), minlength=len(self.n) * width) & 1
        return np.packbits(bits.astype(np.uint8)).view(np.int64).reshape(-1, FOLD)

    def wide(self, i: int) -> bytes:
        """The sketch of a set folded to two to four bits a shingle."""
        width = 1 << int(2 * self.n[i] - 1).bit_length()
        at = (self.zobrist[self.at[i]:self.at[i + 1]] % _U(width)).astype(np.int64)
        return np.packbits((np.bincount(at, minlength=max(8, width)) & 1).astype(np.uint8)).tobytes()


def _instances(n: int) -> list[tuple[int, int, int]]:
    """(kind, band, k) of the sketches that a set of ``n`` takes part in: kind 0 main, 1 cross."""
    if not n:
        return []
    b = n.bit_length() - 1
    low = 1 << b
    out = [(0, b, (4 * low - 2) // 9)]
    if 4 * n <= 5 * (low - 1):
        out.append((1, b, (low - 1) // 4))
    elif 5 * n >= 8 * low:
        out.append((1, b + 1, (2 * low - 1) // 4))
    return [x for x in out if x[2] > 0]  # k = 0: only equal sets, which are one class


def _parts(k: int) -> tuple[int, int]:
    """Number of blocks for a bound ``k``, and how many of them a set may leave out."""
    m = k // 2 + 1
    return k + 1 + m, m


def _blocks(sets: Sets, i: int, kind: int, band: int, k: int) -> np.ndarray:
    """Keys of the blocks that a set must keep before frequencies are known."""
    total, m = _parts(k)
    block = sets.block(i, total)
    order = np.argsort(block.astype(np.uint16) if total < 1 << 16 else block, kind="stable")
    block = block[order]
    first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    parity = np.bitwise_xor.reduceat(sets.zobrist[sets.at[i]:sets.at[i + 1]][order], first)
    salt = mix_int(1 + kind + 2 * band)
    keys = parity ^ mix((block[first] << _U(8)) ^ salt)
    if total - len(first) > m:
        free = np.setdiff1d(np.arange(total, dtype=_U), block[first])[:total - len(first) - m]
        keys = np.r_[keys, mix((free << _U(8)) ^ salt ^ _U(3))]
    return (mix(keys) & ~_U(1)) | _U(kind)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, size of the set, class id, blocks to spare in both kinds and the folded sketches."""
    for batch in slices(batches, 1):
        sets = Sets(batch.column(1))
        spare, wide = np.zeros((2, len(sets.n)), np.int32), []
        for i, n in enumerate(sets.n.tolist()):
            for kind, _, k in _instances(n):
                total, m = _parts(k)
                spare[kind, i] = max(0, m - total + np.count_nonzero(np.bincount(sets.block(i, total).astype(np.int64))))
            wide.append(sets.wide(i) if n else None)
        folds = sets.folds()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sets.n), pa.array(sets.ids(), mask=sets.n == 0), pa.array(spare[0]),
             pa.array(spare[1]), pa.array(wide, pa.binary()), *(pa.array(folds[:, i]) for i in range(FOLD)),
             batch.column(2)],
            ["doc_id", "n", "cls", "spare0", "spare1", "wide", *(f"f{i}" for i in range(FOLD)), "text_id"])


_DESCRIBED = ("doc_id long, n long, cls long, spare0 int, spare1 int, wide binary, "
              + ", ".join(f"f{i} long" for i in range(FOLD)) + ", text_id long")


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, cls) of every block; equal sets of one task are emitted once, which pre-aggregates groups of copies."""
    seen: set[int] = set()
    for batch in slices(batches, 0):
        sets = Sets(batch.column(0))
        keys, cls = [], []
        for i, (n, c) in enumerate(zip(sets.n.tolist(), sets.ids().tolist())):
            if not n or c in seen:
                continue
            if len(seen) < REMEMBER:
                seen.add(c)
            for kind, band, k in _instances(n):
                got = _blocks(sets, i, kind, band, k)
                keys.append(got)
                cls.append(np.full(len(got), c, np.int64))
        if keys:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(cls))], ["key", "cls"])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose wide sketches (columns 4 and 5; sizes 2 and 3) are near enough for a link."""
    def bits(v: pa.Scalar) -> np.ndarray:
        return np.frombuffer(v.as_buffer(), np.uint8)

    for batch in slices(batches, 4):
        keep = []
        for n, m, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5)):
            x, y = bits(x), bits(y)
            if len(x) != len(y):  # bit i of the smaller one is the parity of the bits i modulo its width
                x, y = sorted((x, y), key=len)
                y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
            keep.append(9 * int(np.bitwise_count(x ^ y).sum()) <= n + m)
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in (0, 1)], ["a", "b"])


def _tagged_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, part, cls, is_pivot, set); texts of another class under the same doc_id are passed over."""
    for batch in slices(batches, 4):
        sets = Sets(batch.column(4))
        mask = pa.array((sets.n > 0) & (sets.ids() == batch.column(2).to_numpy()))
        data = pa.array([sets.u[s:e].tobytes() for s, e in zip(sets.at[:-1].tolist(), sets.at[1:].tolist())], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(i).filter(mask) for i in range(4)), data.filter(mask)],
                                         ["b", "part", "cls", "other", "shingles"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The linked pairs: each group's rows start with its pivot's set, with which the others are compared."""
    group, pivot = None, None
    for batch in batches:
        a, b = [], []
        head = zip(*(batch.column(i).to_pylist() for i in range(4)))
        for (g, part, cls, other), data in zip(head, batch.column(4)):
            u = np.frombuffer(data.as_buffer(), _U)
            if not other:
                group, pivot = (g, part), u.copy()
            elif group == (g, part):
                both = len(np.intersect1d(u, pivot, assume_unique=True))
                if 100 * both >= 80 * (len(u) + len(pivot) - both):
                    a.append(cls)
                    b.append(g)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _side(classes: DataFrame, x: str, cols: list[str]) -> DataFrame:
    return classes.select(F.col("cls").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in cols))


def _may_link(a: str, b: str) -> str:
    distance = " + ".join(f"bit_count({a}f{i} ^ {b}f{i})" for i in range(FOLD))
    return f"5 * least({a}n, {b}n) >= 4 * greatest({a}n, {b}n) AND 9 * ({distance}) <= {a}n + {b}n"


def _verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """The linked pairs of (a, b): by wide sketches, then by their exact sets.

    The sets are made from the texts of the classes that are left, and cross the shuffle once per pair.  A class that
    is in many pairs is the pivot of several groups of about GROUP sets.
    """
    wide = (pairs.join(_side(classes, "a", ["n", "wide"]), "a").join(_side(classes, "b", ["n", "wide"]), "b")
            .select("a", "b", "a_n", "b_n", "a_wide", "b_wide"))
    close = scratch.save(wide.mapInArrow(_close, "a long, b long"))
    sizes = close.groupBy("b").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    grouped = scratch.save(close.join(sizes, "b").select("a", "b", F.pmod("a", "parts").alias("part")))
    need = scratch.save(
        grouped.select("b", "part", F.col("a").alias("cls"), F.lit(True).alias("other"))
        .union(grouped.select("b", "part", F.col("b").alias("cls"), F.lit(False).alias("other")).distinct())
        .join(classes.select("cls", "carrier"), "cls"))
    ids = F.broadcast(need) if need.count() <= BROADCAST_ROWS else need
    linked = scratch.save(
        docs.join(ids, docs["doc_id"].eqNullSafe(ids["carrier"]["doc_id"])
                  & (docs["text_id"] == ids["carrier"]["text_id"])).select("b", "part", "cls", "other", "text")
        .mapInArrow(_tagged_sets, "b long, part long, cls long, other boolean, shingles binary")
        .repartition("b", "part").sortWithinPartitions("b", "part", "other")
        .mapInArrow(_linked, "a long, b long").distinct())
    scratch.drop(close, grouped, need)
    return linked


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(comp, cls, shingle) of every shingle; texts of another class under the same doc_id are passed over."""
    for batch in slices(batches, 2):
        sets = Sets(batch.column(2))
        keep = np.repeat((sets.n > 0) & (sets.ids() == batch.column(1).to_numpy()), sets.n)
        comp, cls = (np.repeat(batch.column(i).to_numpy(), sets.n)[keep] for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(comp), pa.array(cls), pa.array(sets.u[keep].view(np.int64))],
                                         ["comp", "cls", "shingle"])


def _with_slack(open_rows: DataFrame, docs: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """``open_rows`` (key, cls, comp, n, size of the key, ...) with ``slack``: n - 9 * own shingles.

    Only classes in frequent keys are counted.  Another class may hold their own shingles, too: in keys with such a
    class all keep n."""
    crowd = scratch.save(open_rows.where(F.col("size") > FREQUENT).select("cls", "comp").distinct())
    if crowd.isEmpty():
        return open_rows.withColumn("slack", F.col("n"))
    mixed = open_rows.join(crowd, "cls", "left_anti").select("key").distinct().withColumn("mixed", F.lit(True))
    need = scratch.save(crowd.join(classes.select("cls", "carrier"), "cls"))
    ids = F.broadcast(need) if need.count() <= BROADCAST_ROWS else need
    rows = scratch.save(docs.join(ids, docs["doc_id"].eqNullSafe(ids["carrier"]["doc_id"])
                                  & (docs["text_id"] == ids["carrier"]["text_id"])).select("comp", "cls", "text")
                        .mapInArrow(_shingle_rows, "comp long, cls long, shingle long").dropDuplicates(["cls", "shingle"]))
    alone = rows.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo = hi").select("shingle")
    own = scratch.save(rows.join(alone, "shingle").groupBy("cls").agg(F.count("*").alias("own")))
    scratch.drop(need, rows)
    missing = F.when(F.col("mixed").isNull(), 9 * F.coalesce("own", F.lit(0))).otherwise(0)
    return (open_rows.join(own, "cls", "left").join(mixed, "key", "left")
            .withColumn("slack", F.col("n") - missing).drop("own", "mixed"))


def _across(open_rows: DataFrame) -> DataFrame:
    """(a, b): rows outside their key's main component with those of the key's other components that they may link to.

    Near copies share many frequent keys; they meet in the smallest one.  That is not met again in a larger one as far as
    both have it among their ``FIRST_KEYS``."""
    cols = ["key", "cls", "comp", "main", "slack", "before", *_FOLDED]
    first = (open_rows.where(F.col("size") > FREQUENT).groupBy("cls")
             .agg(F.slice(F.sort_array(F.collect_set("key")), 1, FIRST_KEYS).alias("first")))
    before = F.when(F.col("size") > FREQUENT, F.filter("first", lambda x: x < F.col("key")))
    open_rows = (open_rows.join(first, "cls", "left")
                 .withColumn("before", F.coalesce(before, F.array().cast("array<long>"))))

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        left, right = left.select(*cols).alias("l"), right.select(*cols).alias("r")
        return (left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.comp") != F.col("r.comp"))
                          & ((F.col("r.comp") == F.col("r.main")) | (F.col("l.cls") < F.col("r.cls")))
                          & (F.col("l.slack") + F.col("r.slack") >= 0) & F.expr(_may_link("l.", "r."))
                          & ~F.arrays_overlap("l.before", "r.before"))
                .select(F.least("l.cls", "r.cls").alias("a"), F.greatest("l.cls", "r.cls").alias("b")))
    left = open_rows.where("comp <> main")
    return (met(left.where("slack >= 0"), open_rows)
            .union(met(left.where("slack < 0"), open_rows.where("slack >= 0"))).distinct())


def _heads(owned: DataFrame, turn: int, before: DataFrame | None) -> DataFrame:
    """(key, main, pivot, outside): each key's largest component, a class of it and the number of classes outside it.

    A key that the last round (``before``) was of little use for is left to the comparison across components: it stays
    only while its outside classes fall by a quarter, so the rows of all rounds are at most four times the first's."""
    heads = (owned.groupBy("key", "comp").agg(F.count("*").alias("size"),
                                              F.min_by("cls", F.xxhash64("cls", F.lit(turn))).alias("pivot"))
             .groupBy("key").agg(F.max_by(F.struct("comp", "pivot"), F.struct("size", "comp")).alias("head"),
                                 (F.sum("size") - F.max("size")).alias("outside"))
             .where("outside > 0")
             .select("key", F.col("head.comp").alias("main"), F.col("head.pivot").alias("pivot"), "outside"))
    if before is None:
        return heads
    was = before.select("key", F.col("outside").alias("was"))
    return heads.join(was, "key").where("4 * outside <= 3 * was").drop("was")


def _best(rows: DataFrame) -> DataFrame:
    """(a, b): of the (cls, pivot) rows each class's most frequent pivot."""
    return (rows.groupBy("cls", "pivot").count().groupBy("cls")
            .agg(F.max_by("pivot", F.struct("count", "pivot")).alias("pivot"))
            .select(F.col("cls").alias("a"), F.col("pivot").alias("b")))


def _pivot_links(pairs: DataFrame, docs: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    near = (pairs.join(_side(classes, "a", _FOLDED), "a").join(_side(classes, "b", _FOLDED), "b")
            .where(_may_link("a_", "b_")).select("a", "b"))
    return _verify(scratch.save(near), docs, classes, scratch)


def _moved(comp: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``comp`` (node, comp) with the labels of the links' first ends moved to those of their second ends, by one step.

    The members of a label stay connected, which is all that the rounds need; the whole components come at the end.
    """
    def labelled(x: str) -> DataFrame:
        return comp.select(F.col("node").alias(x), F.col("comp").alias(f"l{x}"))

    ends = scratch.save(links.join(labelled("a"), "a", "left").join(labelled("b"), "b", "left")
                        .select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")))
    step = ends.groupBy(F.col("la").alias("comp")).agg(F.min("lb").alias("to"))
    new = (ends.select(F.col("a").alias("node")).union(ends.select("b")).distinct().join(comp, "node", "left_anti")
           .withColumn("comp", F.col("node")))
    return scratch.save(comp.union(new).join(step, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")))


def _joined(docs: DataFrame) -> DataFrame:
    """The columns of ``jaccard_join``, and text_id and leads: whether the row is the one that its component keeps.

    That is the row of the smallest doc_id (null last) and text_id, and the rows that repeat it.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_id(F.col("text")).alias("text_id"))
    rows = scratch.save(docs.mapInArrow(_describe, _DESCRIBED))
    classes = scratch.save(rows.where("cls is not null").groupBy("cls").agg(
        F.min(F.struct("doc_id", "text_id")).alias("carrier"),
        *(F.first(c).alias(c) for c in ("n", "spare0", "spare1", "wide", *(f"f{i}" for i in range(FOLD))))))

    # blocks that two classes share; a key has at most one row per class, however many a class has
    by_key = Window.partitionBy("key").orderBy("cls")
    shared = (docs.select("text").mapInArrow(_emit, "key long, cls long")
              .withColumns({"_last": F.lag("cls").over(by_key), "_next": F.lead("cls").over(by_key),
                            "pivot": F.first("cls").over(by_key)})
              .where("(cls <> pivot and cls <> _last) or (cls = pivot and cls <> _next)")
              .select("key", "cls", "pivot"))
    shared = scratch.save(shared)

    # frequent blocks: each class leaves out the most frequent ones it may
    frequent = shared.groupBy("key").count().where(F.col("count") > FREQUENT)
    spare = F.when(F.col("key").bitwiseAND(1) == 0, F.col("spare0")).otherwise(F.col("spare1"))
    order = Window.partitionBy("cls", F.col("key").bitwiseAND(1)).orderBy(F.desc("count"), "key")
    left_out = (shared.select("key", "cls").join(frequent, "key").join(classes.select("cls", "spare0", "spare1"), "cls")
                .withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= spare).select("key", "cls"))
    kept = scratch.save(shared.join(left_out, ["key", "cls"], "left_anti").select("key", "cls"))

    # one pivot per class: the class that it shares the most blocks with as their first
    pivots = _best(shared.where("cls <> pivot"))
    links = _pivot_links(pivots, docs, classes, scratch)
    comp = components(links, scratch)

    # frequent blocks that are still kept belong to large groups of near copies: more pivots, until none links any more
    large, heads = scratch.save(kept.join(frequent.select("key"), "key", "left_semi")), None
    for turn in range(MORE_PIVOTS):
        owned = (large.join(comp.withColumnRenamed("node", "cls"), "cls", "left")
                 .withColumn("comp", F.coalesce("comp", "cls")))
        heads = scratch.save(_heads(owned, turn, heads))
        found = _pivot_links(_best(owned.join(heads, "key").where("comp <> main")), docs, classes, scratch)
        if found.isEmpty():
            break
        links = links.union(found)
        comp = _moved(comp, found, scratch)

    # across components: rows outside the key's largest component against all others of the key
    members = scratch.save(kept.join(comp.withColumnRenamed("node", "cls"), "cls", "left")
                           .withColumn("comp", F.coalesce("comp", "cls"))
                           .join(classes.select("cls", *_FOLDED), "cls"))
    largest = (members.groupBy("key", "comp").count().groupBy("key")
               .agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.count("*").alias("comps"),
                    F.sum("count").alias("size"))
               .where("comps > 1").select("key", "main", "size"))
    across = _across(scratch.save(_with_slack(members.join(largest, "key"), docs, classes, scratch)))
    comp = components(links.union(_verify(scratch.save(across), docs, classes, scratch)), scratch)

    labelled = scratch.save(rows.select("doc_id", "text_id", F.col("n").alias("n_shingles"), "cls")
                            .join(comp.withColumnRenamed("node", "cls"), "cls", "left")
                            .withColumn("comp", F.coalesce("comp", "cls")))
    smallest = scratch.save(labelled.where("comp is not null").groupBy("comp")
                            .agg(F.min("doc_id").alias("component_id"),
                                 F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_id"))
                                 .alias("lead")))  # saved, so that the join can split a large one
    leads = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("text_id") == F.col("lead.text_id"))
    return (labelled.join(smallest, "comp", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
                    F.col("cls").alias("class_id"), "text_id", (F.col("comp").isNull() | leads).alias("leads")))


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id (equal sets; null when empty) of every row of ``docs``."""
    return _joined(docs).drop("text_id", "leads")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document, the one of the smallest id, of each component; rows that repeat its id and text stay."""
    return without(docs, _joined(docs).where("not leads"))
