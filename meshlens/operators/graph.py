"""Graph operators over the relation table, all seeds at once.

Iterative operators run one join + anti-join per BFS level.  Each level's
frontier is cut from its lineage with a *reliable* ``checkpoint()`` into the
session's ``spark.checkpoint.dir`` (a shared folder on a cluster), so a lost
executor recomputes at most one level and the plan does not grow with depth.
The loop's only driver action is the emptiness test of the new frontier.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlens.operators.dealing import dealt_join
from meshlens.session import ensure_checkpoint_dir


def directed_edges(edges: DataFrame, direction: str = "down", types=None) -> DataFrame:
    """(src, dst, relation) for the traversal direction: ``down`` follows edges,
    ``up`` reverses them with a ``CALLED_BY_`` label, ``both`` unions the two."""
    e = edges if not types else edges.where(F.col("type").isin(list(types)))
    down = e.select("src", "dst", F.col("type").alias("relation"))
    up = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"),
                  F.concat(F.lit("CALLED_BY_"), F.col("type")).alias("relation"))
    if direction == "down":
        return down
    if direction == "up":
        return up
    return down.unionByName(up)


def traverse(seeds: DataFrame, edges: DataFrame, depth: int = 3, direction: str = "down", types=None,
             allowed_nodes: DataFrame | None = None) -> DataFrame:
    """G-01 / G-03 / G-06: BFS from every seed; each node once per seed at its
    minimal depth, with the relation label (smallest among the edges reaching
    it at that depth) and its BFS-tree parent (smallest id one level up).

    ``seeds``: (seed).  ``allowed_nodes`` (id) drops nodes that fail a layer /
    external filter: they are neither reported nor expanded (G-03).
    Returns (seed, node, depth, relation, parent)."""
    ensure_checkpoint_dir(seeds.sparkSession)
    # the edge set is read once per level: materialize it once (reliably)
    e = directed_edges(edges, direction, types).distinct()
    if allowed_nodes is not None:  # an edge to another node is never walked
        e = e.join(allowed_nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "relation")
    e = e.checkpoint(eager=True)
    visited = seeds.select("seed", F.col("seed").alias("node"))
    frontier = visited
    levels = []
    for d in range(1, depth + 1):
        step = (frontier.join(e, frontier["node"] == e["src"])
                .select("seed", F.col("dst").alias("node"), "relation", F.col("src").alias("parent")))
        step = step.join(visited, ["seed", "node"], "left_anti")
        nxt = (step.groupBy("seed", "node")
               .agg(F.min("relation").alias("relation"), F.min("parent").alias("parent"))
               .withColumn("depth", F.lit(d)))
        if d == depth:
            # the last (and largest) level is never expanded: no checkpoint, no emptiness test
            levels.append(nxt)
            break
        nxt = nxt.checkpoint(eager=True)
        if nxt.isEmpty():
            break
        levels.append(nxt)
        visited = visited.unionByName(nxt.select("seed", "node"))
        frontier = nxt.select("seed", "node")
    if not levels:
        return seeds.sparkSession.createDataFrame(
            [], "seed long, node long, depth int, relation string, parent long")
    out = reduce(DataFrame.unionByName, levels)
    return out.select("seed", "node", F.col("depth").cast("int"), "relation", "parent")


@dataclass(frozen=True)
class KeyedEdges:
    """Edges kept as member → key → member: every (src, key) of ``out`` reaches every (key, dst) of ``into``.

    A key with m members on one side and n on the other takes m + n rows, not m·n.  Where both sides have a ``tag``,
    members of equal tags don't reach each other.  ``pairs`` expands the edges of chosen members only."""
    out: DataFrame
    into: DataFrame
    relation: str

    def _steps(self, frontier: DataFrame) -> DataFrame:
        """(*frontier columns, dst) for a frontier with a ``src`` column."""
        into = self.into
        if "tag" in self.out.columns:
            return (frontier.join(self.out, "src").join(into.withColumnRenamed("tag", "_tag"), "key")
                    .where(F.col("tag") != F.col("_tag")).drop("key", "tag", "_tag"))
        return frontier.join(self.out, "src").join(into, "key").drop("key")

    def pairs(self, members: DataFrame | None = None) -> DataFrame:
        """The edges (src, dst, type) of ``members`` (src), or all of them."""
        if members is None and "tag" not in self.out.columns:
            return self._all_pairs()
        start = self.out.select("src").distinct() if members is None else members.select("src").distinct()
        return (self._steps(start).where(F.col("src") != F.col("dst")).distinct()
                .withColumn("type", F.lit(self.relation)).select("src", "dst", "type"))

    def _all_pairs(self, beside: DataFrame | None = None) -> DataFrame:
        """All edges, and those of ``beside`` (src, dst, type), each once.

        A member of one key that is no source in ``beside`` makes each of its edges once: only the edges of the other
        members are compared with each other."""
        out, into = self.out.select("src", "key").distinct(), self.into.select("key", "dst").distinct()
        several = out.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("src")
        if beside is not None:
            several = several.union(beside.select("src")).distinct()

        def made(members: DataFrame) -> DataFrame:
            return (dealt_join(members, into, "key", "src", "dst").where(F.col("src") != F.col("dst"))
                    .select("src", "dst", F.lit(self.relation).alias("type")))
        rest = made(out.join(several, "src", "left_semi"))
        if beside is not None:
            rest = rest.unionByName(beside.select("src", "dst", "type"))
        return made(out.join(several, "src", "left_anti")).unionByName(rest.distinct())

    def rows(self) -> DataFrame:
        """The stored rows: (side, member, key)."""
        return (self.out.select(F.lit("out").alias("side"), F.col("src").alias("member"), "key")
                .unionByName(self.into.select(F.lit("in").alias("side"), F.col("dst").alias("member"), "key")))


def _first_targets(df: DataFrame, by: str, most: int) -> DataFrame:
    """The ``most`` smallest targets per ``by``: in breadth-first order by id, a result of half as many nodes per seed
    takes none beyond them."""
    w = Window.partitionBy(by).orderBy("dst")
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def budgeted_traverse(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, depth: int = 5, direction: str = "down",
                      types=None, keyed: Sequence[KeyedEdges] = (), max_symbols: int = 50,
                      max_tokens: int = 10000) -> DataFrame:
    """G-02 / G-03 / G-04 / G-05 in one loop: BFS under a budget of symbols and tokens per seed.

    ``nodes``: (node, tokens), the nodes that pass the layer / external filter; others are neither reported nor
    expanded.  ``keyed`` edges are expanded per frontier.  A seed takes nodes in the order of (depth, node) while it
    has fewer than ``max_symbols`` and the tokens before a node are below ``max_tokens``; at the first node that it
    can't take it is ``truncated`` and leaves the frontier, so later levels shrink.

    A node can offer at most twice the budget of its smallest targets, so a hub's other edges are never joined.
    Returns (seed, node, depth, relation, parent, k, truncated)."""
    ensure_checkpoint_dir(seeds.sparkSession)
    nodes = nodes.select("node", "tokens").checkpoint(eager=True)
    known = nodes.select(F.col("node").alias("dst"))
    most = 2 * max_symbols + 2
    e = directed_edges(edges, direction, types).distinct().join(known, "dst", "left_semi")
    near = _first_targets(e.select("src", "dst").distinct(), "src", most)
    e = e.join(near, ["src", "dst"], "left_semi").checkpoint(eager=True)
    keyed = [KeyedEdges(x.out, x.into.join(known, "dst", "left_semi").checkpoint(eager=True), x.relation) for x in keyed]
    visited = seeds.select("seed", F.col("seed").alias("node"))
    frontier, levels = visited, []
    for d in range(1, depth + 1):
        at = frontier.withColumnRenamed("node", "src")
        step = at.join(e, "src").select("seed", F.col("dst").alias("node"), "relation", F.col("src").alias("parent"))
        for x in keyed:
            step = step.unionByName(x._steps(at).where(F.col("src") != F.col("dst")).select(
                "seed", F.col("dst").alias("node"), F.lit(x.relation).alias("relation"), F.col("src").alias("parent")))
        new = (step.join(visited, ["seed", "node"], "left_anti").groupBy("seed", "node")
               .agg(F.min("relation").alias("relation"), F.min("parent").alias("parent")))
        w = Window.partitionBy("seed").orderBy("node")
        new = new.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max_symbols + 1).join(nodes, "node")
        if levels:
            spent = reduce(DataFrame.unionByName, levels).groupBy("seed").agg(
                F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("spent"))
            new = new.join(spent, "seed", "left")
        else:
            new = new.withColumns({"n": F.lit(0), "spent": F.lit(0)})
        before = F.coalesce("spent", F.lit(0)) + F.coalesce(
            F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        new = new.withColumn("k", F.coalesce("n", F.lit(0)) + F.col("rn")).withColumn("before", before)
        ok = (F.col("k") <= max_symbols) & (F.col("before") < max_tokens)
        end = F.min(F.when(~ok, F.col("rn"))).over(Window.partitionBy("seed"))
        new = (new.withColumn("end", end).where(F.col("end").isNull() | (F.col("rn") <= F.col("end")))
               .select("seed", "node", F.lit(d).alias("depth"), "relation", "parent", F.col("k").cast("long").alias("k"),
                       F.col("tokens").cast("long").alias("tokens"),
                       F.coalesce(F.col("rn") == F.col("end"), F.lit(False)).alias("over")).checkpoint(eager=True))
        if new.isEmpty():
            break
        levels.append(new)
        kept = new.where(~F.col("over")).select("seed", "node")
        visited = visited.unionByName(kept)
        frontier = kept.join(new.where("over").select("seed"), "seed", "left_anti")
    if not levels:
        return seeds.sparkSession.createDataFrame([], "seed long, node long, depth int, relation string, parent long, "
                                                      "k long, truncated boolean")
    out = reduce(DataFrame.unionByName, levels)
    cut = out.where("over").select("seed", F.lit(True).alias("truncated"))
    return (out.where(~F.col("over")).join(cut, "seed", "left")
            .select("seed", "node", "depth", "relation", "parent", "k", F.coalesce("truncated", F.lit(False)).alias("truncated")))


def limit_traversal(nodes: DataFrame, tokens: Column, max_symbols: int = 50, max_tokens: int = 10000) -> DataFrame:
    """G-02: keep nodes in BFS order (depth, node id) while fewer than
    ``max_symbols`` were kept and the tokens spent before them are below
    ``max_tokens``; ``truncated`` marks seeds whose result was cut.

    ``row_number() <= max_symbols`` is planned with a partial per-seed top-k
    before the shuffle, so the running token sum only sorts bounded groups."""
    w = Window.partitionBy("seed").orderBy("depth", "node")
    ranked = (nodes.withColumn("tokens", tokens).withColumn("k", F.row_number().over(w))
              .where(F.col("k") <= max_symbols + 1))
    wr = w.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("spent", F.coalesce(F.sum("tokens").over(wr), F.lit(0)))
    ok = (F.col("k") <= max_symbols) & (F.col("spent") < max_tokens)
    # the kept set is a prefix: the first failing row ends it
    first_fail = F.min(F.when(~ok, F.col("k"))).over(Window.partitionBy("seed"))
    marked = ranked.withColumn("ff", first_fail)
    kept = marked.where(F.col("ff").isNull() | (F.col("k") < F.col("ff")))
    return kept.withColumn("truncated", F.col("ff").isNotNull()).drop("ff", "spent")


def degree_stats(edges: DataFrame, types=("CALLS", "USES", "IMPORTS", "IMPLEMENTS", "INHERITS")) -> DataFrame:
    """G-09: in/out degree per node and type (pivot values given, so no extra
    job to discover them)."""
    out = edges.select(F.col("src").alias("node"), F.concat(F.lit("out_"), F.col("type")).alias("k"))
    inc = edges.select(F.col("dst").alias("node"), F.concat(F.lit("in_"), F.col("type")).alias("k"))
    keys = [f"{d}_{t}" for d in ("out", "in") for t in types]
    p = out.unionByName(inc).groupBy("node").pivot("k", keys).count()
    return p.select("node", *[F.coalesce(F.col(k), F.lit(0)).cast("bigint").alias(k.lower()) for k in keys])


def cycles_2(edges: DataFrame, types=("IMPORTS", "USES")) -> DataFrame:
    """G-07: two-node cycles a ⇄ b (a < b) over the given edge types."""
    e = edges.where(F.col("type").isin(list(types)) & (F.col("src") != F.col("dst"))).select("src", "dst").distinct()
    r = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return e.join(r, ["src", "dst"], "left_semi").where(F.col("src") < F.col("dst")) \
        .select(F.col("src").alias("a"), F.col("dst").alias("b"))


def cycles_3(edges: DataFrame, types=("IMPORTS", "USES")) -> DataFrame:
    """G-07: directed three-node cycles, one row per node set (a < b < c).

    Triangles are listed with degree ordering: every undirected edge points
    from its lower-ranked end (degree, id) to the higher one, so a node's
    out-list holds at most O(√E) entries and the wedge self-join costs
    O(E^1.5) even when one node holds a large share of all edges.  A triangle
    is a directed cycle when its three edges can be oriented a→b→c→a or
    a→c→b→a."""
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.where(F.col("type").isin(list(types)) & (F.col("src") != F.col("dst"))).select("src", "dst").distinct()
    # the undirected edge table with direction flags is read five times below:
    # materialize it once (reliable checkpoint) instead of re-deriving it
    und = (e.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"),
                    (F.col("src") < F.col("dst")).alias("fwd"))
           .groupBy("u", "v").agg(F.max(F.col("fwd").cast("int")).alias("uv"),
                                  F.max((~F.col("fwd")).cast("int")).alias("vu"))
           .checkpoint(eager=True))
    deg = (und.select(F.col("u").alias("n")).unionByName(und.select(F.col("v").alias("n")))
           .groupBy("n").agg(F.count(F.lit(1)).alias("d")))
    du = deg.select(F.col("n").alias("u"), F.col("d").alias("du"))
    dv = deg.select(F.col("n").alias("v"), F.col("d").alias("dv"))
    o = und.join(du, "u").join(dv, "v")
    low_u = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    oriented = o.select(F.when(low_u, F.col("u")).otherwise(F.col("v")).alias("x"),
                        F.when(low_u, F.col("v")).otherwise(F.col("u")).alias("y"),
                        F.when(low_u, F.col("dv")).otherwise(F.col("du")).alias("dy"))
    a = oriented.select("x", F.col("y").alias("p"), F.col("dy").alias("dp"))
    b = oriented.select("x", F.col("y").alias("q"), F.col("dy").alias("dq"))
    wedges = a.join(b, "x").where((F.col("dp") < F.col("dq")) | ((F.col("dp") == F.col("dq")) & (F.col("p") < F.col("q"))))
    closing = oriented.select(F.col("x").alias("p"), F.col("y").alias("q"))
    tri = wedges.join(closing, ["p", "q"], "left_semi").select(
        F.array_sort(F.array("x", "p", "q")).alias("t"))
    tri = tri.select(F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c"))
    # orientation flags of the three sides (a<b<c): uv means low→high exists
    ab = und.select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("uv").alias("ab"), F.col("vu").alias("ba"))
    bc = und.select(F.col("u").alias("b"), F.col("v").alias("c"), F.col("uv").alias("bc"), F.col("vu").alias("cb"))
    ac = und.select(F.col("u").alias("a"), F.col("v").alias("c"), F.col("uv").alias("ac"), F.col("vu").alias("ca"))
    j = tri.join(ab, ["a", "b"]).join(bc, ["b", "c"]).join(ac, ["a", "c"])
    cyc = ((F.col("ab") == 1) & (F.col("bc") == 1) & (F.col("ca") == 1)) | \
          ((F.col("ac") == 1) & (F.col("cb") == 1) & (F.col("ba") == 1))
    return j.where(cyc).select("a", "b", "c")


#: The first round of :func:`strongly_connected` starts from one node in so many.  It moves work only: results are the same
#: at any value.
FEW = 1024


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, ends) of sorted rows (id, end), each end once; a row holds a batch's ends of its id at most."""
    last = None
    for batch in batches:
        if batch.num_rows:
            ids, ends = (batch.column(i).to_numpy() for i in (0, 1))
            keep = np.r_[(ids[0], ends[0]) != last, (ids[1:] != ids[:-1]) | (ends[1:] != ends[:-1])]
            last = ids[-1], ends[-1]
            ids, ends = ids[keep], ends[keep]
            first = np.flatnonzero(np.r_[np.ones(min(1, len(ids)), bool), ids[1:] != ids[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(ids[first]), pa.ListArray.from_arrays(
                pa.array(np.r_[first, len(ids)], pa.int32()), pa.array(ends))], ["id", "ends"])


def _neighbours(edges: DataFrame, by: str, to: str) -> DataFrame:
    """(id, ends): the ends ``to`` of the edges of each end ``by``, dealt by id, so that joins on id move no edges."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (edges.select(F.col(by).cast("long").alias("id"), F.col(to).cast("long").alias("end"))
            .repartition(parts, "id").sortWithinPartitions("id", "end").mapInArrow(_runs, "id long, ends array<long>")
            .repartition(parts, "id").checkpoint(eager=True))


def _sent(nodes: DataFrame, neighbours: DataFrame, color: Column) -> DataFrame:
    """(id, sent): ``color`` of the colors that reach each neighbour of ``nodes`` (id, color)."""
    return (nodes.select("id", "color").join(neighbours, "id").select(F.explode("ends").alias("id"), "color")
            .groupBy("id").agg(color.alias("sent")))


def _rooted(out: DataFrame, into: DataFrame, few: int) -> DataFrame:
    """(id, color, found) of every node: the largest root that it is reached from (null: none), and whether it reaches
    that root; roots are one node in ``few``.

    Only nodes whose color has changed send it on, and on the way back each node sends once."""
    parts = int(out.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    root = F.pmod(F.xxhash64("id"), F.lit(few)) == 0
    nodes = (out.select("id").union(into.select("id")).distinct().repartition(parts, "id")
             .select("id", F.when(root, F.col("id")).alias("color"), root.alias("new")).checkpoint(eager=True))
    while not nodes.where("new").isEmpty():
        nodes = (nodes.join(_sent(nodes.where("new"), out, F.max("color")), "id", "left")
                 .select("id", F.greatest("color", "sent").alias("color"),
                         (F.col("sent").isNotNull() & (F.col("color").isNull() | (F.col("sent") > F.col("color")))).alias("new"))
                 .checkpoint(eager=True))
    # a node's color is at least that of each node before it, so the smallest color sent back tells whether its own is
    own = F.coalesce(F.col("id") == F.col("color"), F.lit(False))
    nodes = nodes.select("id", "color", own.alias("found"), own.alias("new"))
    while not nodes.where("new").isEmpty():
        hit = ~F.col("found") & F.coalesce(F.col("sent") == F.col("color"), F.lit(False))
        nodes = (nodes.join(_sent(nodes.where("new"), into, F.min("color")), "id", "left")
                 .select("id", "color", (F.col("found") | hit).alias("found"), hit.alias("new")).checkpoint(eager=True))
    return nodes.drop("new")


def _trimmed(e: DataFrame) -> DataFrame:
    """The edges left when nodes without an edge in or out, each a component of its own, are taken out again and again."""
    n = e.count()
    while n:
        both = (e.select(F.col("dst").alias("id")).distinct().join(e.select(F.col("src").alias("id")).distinct(), "id")
                .checkpoint(eager=True))
        e = (e.join(both.withColumnRenamed("id", "src"), "src", "left_semi")
             .join(both.withColumnRenamed("id", "dst"), "dst", "left_semi").checkpoint(eager=True))
        was, n = n, e.count()
        if n == was:
            break
    return e


def strongly_connected(edges: DataFrame, types=None) -> DataFrame:
    """G-07 (set form): strongly connected components with ≥ 2 nodes, by the
    forward-coloring / backward-reach method, run until every node is placed.

    Each round propagates the largest root forward to a fix-point (colors);
    from each root that kept its own color, edges are walked backwards inside
    the color and the reached nodes form the root's component, which leaves
    the graph with the edges between colors.  The first round has few roots,
    which place the large components; in the others, after nodes without
    remaining in- or out-edges are trimmed (they are singleton components),
    every node is a root.  Ids are longs.  Edges are kept as arrays of
    neighbours, dealt by node once a round, so a step shuffles only what it
    sends.  Every step is
    cut from its lineage by a reliable checkpoint.  The loops run to the end:
    no component is dropped."""
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges if not types else edges.where(F.col("type").isin(list(types)))
    e, few, found = e.where(F.col("src") != F.col("dst")).select("src", "dst"), FEW, []
    while not found or not e.isEmpty():
        out = _neighbours(e, "src", "dst")
        into = _neighbours(out.select("id", F.explode("ends").alias("dst")), "dst", "id")
        nodes = _rooted(out, into, few)
        found.append(nodes.where("found").select("id", F.col("color").alias("root")))
        left = nodes.where("not found").select("id", "color")
        e = _trimmed(left.join(out, "id").select(F.col("id").alias("src"), F.explode("ends").alias("dst"), "color")
                     .join(left.select(F.col("id").alias("dst"), F.col("color").alias("to")), "dst")
                     .where(F.col("color").eqNullSafe(F.col("to"))).select("src", "dst").checkpoint(eager=True))
        few = 1
    allc = reduce(DataFrame.unionByName, found)
    sizes = allc.groupBy("root").agg(F.max("id").alias("component"), F.count(F.lit(1)).alias("size"))
    return allc.join(sizes.where(F.col("size") >= 2), "root").select("id", "component", "size")


def interface_keys(symbols: DataFrame, edges: DataFrame) -> KeyedEdges:
    """G-04 for methods: interface METHOD → (interface, name) → same-named METHODs of the implementing classes
    (members linked to their type by parent name = FQN).  Rows grow with the members, not with their pairs."""
    s = symbols.select("id", "name", "kind", "fqn", "parent_name")
    iface = s.where(F.col("kind") == "INTERFACE").select(F.col("id").alias("iid"), F.col("fqn").alias("ifqn"))
    cls = s.where(F.col("kind") == "CLASS").select(F.col("id").alias("cid"), F.col("fqn").alias("cfqn"))
    impl = (edges.where(F.col("type") == "IMPLEMENTS").select(F.col("dst").alias("iid"), F.col("src").alias("cid")).distinct()
            .join(iface.select("iid"), "iid").join(cls, "cid"))
    methods = s.where(F.col("kind") == "METHOD")
    key = F.concat_ws(":", F.col("iid").cast("string"), F.col("name"))
    out = (methods.select(F.col("id").alias("src"), "name", F.col("parent_name").alias("ifqn")).join(iface, "ifqn")
           .select("src", key.alias("key")).distinct())
    into = (methods.select(F.col("id").alias("dst"), "name", F.col("parent_name").alias("cfqn")).join(impl, "cfqn")
            .select(key.alias("key"), "dst").distinct().join(out.select("key"), "key", "left_semi"))
    return KeyedEdges(out, into, "IMPLEMENTED_BY")


def type_edges(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """G-04 for types: INTERFACE → implementing class and base → heir (reverse IMPLEMENTS / INHERITS)."""
    impl = (edges.where(F.col("type") == "IMPLEMENTS")
            .join(symbols.where(F.col("kind") == "INTERFACE").select(F.col("id").alias("dst")), "dst")
            .select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("IMPLEMENTED_BY").alias("type")))
    heirs = (edges.where(F.col("type") == "INHERITS")
             .select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("INHERITED_BY").alias("type")))
    return impl.unionByName(heirs).distinct()


def interface_edges(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """G-04: derived edges INTERFACE → implementing class, base → heir, and interface METHOD → same-named METHOD of an
    implementing class, all pairs; :func:`interface_keys` keeps the last kind factored."""
    return interface_keys(symbols, edges)._all_pairs(type_edges(symbols, edges))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): every node of the undirected links (a, b) with the smallest node it is connected to.

    Each round moves a node to its neighbour (or itself) of the smallest hash, salted by the round, and contracts the
    links by that map, so chains of rising ids shrink as fast as any other shape.  A hub's links are aggregated before
    they are shuffled; every round is cut by a reliable checkpoint.  A node linked with itself alone is its own
    component; null ends are left out.
    """
    ensure_checkpoint_dir(links.sparkSession)
    links = links.select("a", "b").where("a is not null and b is not null").distinct().checkpoint(eager=True)
    labels = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("label", F.col("node"))
    rest, turn = links.where("a <> b"), 0
    while not rest.isEmpty():
        ends = rest.union(rest.select("b", "a"))
        near = ends.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", F.lit(turn)).alias("h"), "b")).alias("low"))
        move = near.select(F.col("a").alias("label"),
                           F.when(F.col("low.h") < F.xxhash64("a", F.lit(turn)), F.col("low.b")).otherwise(F.col("a")).alias("to")
                           ).checkpoint(eager=True)
        labels = (labels.join(move, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
                  .checkpoint(eager=True))
        rest = (rest.join(move.select(F.col("label").alias("a"), F.col("to").alias("ta")), "a")
                .join(move.select(F.col("label").alias("b"), F.col("to").alias("tb")), "b").where("ta <> tb")
                .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
                .checkpoint(eager=True))
        turn += 1
    smallest = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(smallest, "label").select("node", "component")
