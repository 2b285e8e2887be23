"""G-07 components: against reachability on small graphs, at any share of first roots, and without moving edges in a step."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from meshlens.operators import graph as G

SCHEMA = "src long, dst long, type string"


def brute(pairs):
    """{(id, largest id, size)} of the components with two nodes or more."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set())

    def reach(a):
        seen, rest = {a}, [a]
        while rest:
            for y in near[rest.pop()] - seen:
                seen.add(y)
                rest.append(y)
        return seen
    to = {a: reach(a) for a in near}
    own = {a: {b for b in to[a] if a in to[b]} for a in near}
    return {(a, max(c), len(c)) for a, c in own.items() if len(c) > 1}


@pytest.mark.parametrize("few", [3, 1024])
def test_components_at_any_share_of_first_roots(spark, monkeypatch, few):
    monkeypatch.setattr(G, "FEW", few)
    draw = random.Random(7)
    rows = [(draw.randrange(40), draw.randrange(40)) for _ in range(55)]        # small components, chains
    rows += [(100 + draw.randrange(30), 100 + draw.randrange(30)) for _ in range(120)]  # a large one
    rows += [(3, 104), (-5, -6), (-6, -5), (200, 201), (201, 202), (202, 202)]
    df = [(a, b, "USES") for a, b in rows + rows[:40]] + [(202, 200, "CALLS"), (None, 1, "USES"), (1, None, "USES")]
    got = [tuple(r) for r in G.strongly_connected(spark.createDataFrame(df, SCHEMA), types=("USES",)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)
    assert G.strongly_connected(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_step_moves_no_edges(spark):
    edges = spark.range(20_000).select(F.col("id").alias("src"), ((F.col("id") * 7 + 1) % 5_000).alias("dst"))
    out = G._neighbours(edges.union(edges), "src", "dst")
    assert out.agg(F.sum(F.size("ends"))).first()[0] == 20_000
    nodes = out.select("id", F.col("id").alias("color"))
    plan = G._sent(nodes, out, F.max("color"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the colors that it sends


def test_a_hub_is_kept_in_pieces(spark):
    hub = spark.range(1, 25_001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    out = G._neighbours(hub, "src", "dst")
    assert out.agg(F.max(F.size("ends"))).first()[0] <= 10_000
    back = hub.where("dst % 2 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    got = G.strongly_connected(hub.union(back)).agg(F.count("*"), F.max("size"), F.min("component")).first()
    assert tuple(got) == (12_501, 12_501, 25_000)
