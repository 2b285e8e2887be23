import hashlib
import math

import numpy as np

from meshlens.llm import hadamard_clusters as hc


def brute(rows, k=16, rounds=3):
    """Full search with Python's integers over (vec_id, x)."""
    kept = [(i, x) for i, x in rows if x is not None and len(x) == 64
            and all(v is not None and math.isfinite(v) for v in x)]
    vecs = [(i, [math.floor(64 * v) if abs(v) < 2 ** 53 else 64 * int(v) for v in x]) for i, x in kept]
    order = sorted(range(len(kept)), key=lambda j: (hashlib.sha256(f"1:{'' if kept[j][0] is None else kept[j][0]}".encode()).hexdigest(), kept[j][1]))
    cents = [vecs[j][1] for j in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents)) for _, v in vecs]
    for _ in range(rounds):
        got = assign()
        for j in range(len(cents)):
            mine = [v for (_, v), (_, c) in zip(vecs, got) if c == j]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine)]
    got = assign()
    inertia = sum(d for d, _ in got)
    return sorted(((i, c, d if d < 2 ** 63 else None) for (i, _), (d, c) in zip(vecs, got)), key=str), inertia, cents, got


def check(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    out = hc.cluster_vectors(df, **more).collect()
    want, inertia, cents, got = brute(rows, **more)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in out), key=str) == want
    for r in out:
        own = sum(d for d, c in got if c == r.cluster)
        assert r.cluster_inertia == (own if own < 2 ** 63 else None)
        assert r.inertia == (inertia if inertia < 2 ** 63 else None)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, cents[r.cluster])).encode()).hexdigest()


def vectors(n, seed=1, scale=0.3):
    rng = np.random.default_rng(seed)
    return [(i, [float(v) for v in rng.normal(0, scale, 64)]) for i in range(n)]


def test_against_full_search(spark):
    rows = vectors(200)
    rows += [(i, rows[3][1]) for i in range(500, 560)]                     # a hot vector
    rows += [(None, rows[5][1]), (7, rows[9][1]), (7, rows[9][1])]         # null and repeated ids
    rows += [(900, None), (901, []), (902, rows[0][1][:63]), (903, rows[0][1] + [0.0]), (904, [None] + rows[0][1][1:]),
             (905, [float("nan")] + rows[0][1][1:]), (906, [float("inf")] + rows[0][1][1:])]
    check(spark, rows)


def test_ties_go_to_the_smaller_number(spark):
    check(spark, [(i, [float((i >> j) & 1) for j in range(64)]) for i in range(64)])
    check(spark, [(i, [0.5] * 64) for i in range(40)])


def test_huge_components_are_exact(spark):
    rows = vectors(30) + [(100 + i, [v * 10.0 ** (3 * i) for v in x]) for i, x in vectors(40, 2)]
    rows += [(200, [1.7e308] * 64), (201, [-1.7e308] * 64)]
    check(spark, rows, k=5)


def test_fewer_vectors_than_centroids_and_none(spark):
    check(spark, vectors(5))
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, cluster int")
    assert hc.cluster_vectors(none).collect() == []


def test_extra_columns_and_floats(spark):
    rows = [(i, x, 1, "c", 2) for i, x in vectors(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster int, x string, distance int")
    assert hc.cluster_vectors(df).count() == 40


def test_transform_keeps_distances():
    rng = np.random.default_rng(5)
    a, b = rng.integers(-900, 900, (2, 50, 64))
    assert (((hc.transform(a) - hc.transform(b)) ** 2).sum(1) == 64 * ((a - b) ** 2).sum(1)).all()
    cluster, distance = hc.nearest(a, b)
    full = ((a[:, None] - b[None]) ** 2).sum(2)
    assert (cluster == full.argmin(1)).all() and (distance == full.min(1)).all()
