"""Clustering by two trees against plain Lloyd."""

import hashlib
import random

import numpy as np
import pytest

from compare import of_duck, of_spark
from conftest import DATA
from docmill.llm import clusters


def test_against_sql(spark, duck):
    assert of_spark(clusters.op11_clusters(spark, DATA)) == of_duck(duck, clusters.OP11_SQL)


def plain(rows, k, rounds, scale, seed=1):
    """Lloyd with every vector against every centroid, in Python's integers."""
    kept = [(i, [int(np.floor(scale * float(e))) for e in x]) for i, x in rows]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centres = [x for _, x in sorted(kept, key=key)[:k]]
    gap = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    closest = lambda x: min((gap(x, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        of = [closest(x)[1] for _, x in kept]
        for j in range(len(centres)):
            own = [x for (_, x), c in zip(kept, of) if c == j]
            if own:
                centres[j] = [sum(v) // len(own) for v in zip(*own)]
    return sorted((str(i), closest(x)[1], closest(x)[0]) for i, x in kept), centres


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_plain_lloyd(spark, seed):
    r = random.Random(seed)
    middles = [[r.uniform(-3, 3) for _ in range(6)] for _ in range(5)]
    good = [(i, [e + r.gauss(0, 0.2) for e in r.choice(middles)]) for i in range(300)]
    good += [(1000 + i, good[7][1]) for i in range(200)] + [(5, good[9][1]), (None, good[3][1]), (None, good[3][1])]  # copies, a repeated id, null ids
    odd = [(2000, [1.0]), (2001, None), (2002, [float("nan")] * 6), (2003, [None, *[1.0] * 5]), (2004, [float("inf")] * 6), (2005, [])]
    vectors = spark.createDataFrame([(i, x, 1) for i, x in good + odd], "vec_id long, embedding array<double>, cluster int").repartition(3)
    found = clusters.cluster(vectors, k=8, rounds=3, dims=6, scale=8).collect()
    wanted, centres = plain(good, 8, 3, 8)
    assert sorted((str(x.vec_id), x.cluster, x.distance) for x in found) == wanted
    for x in found:
        assert x.inertia == sum(d for *_, d in wanted) and x.cluster_inertia == sum(d for _, c, d in wanted if c == x.cluster)
        assert x.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[x.cluster])).encode()).hexdigest()


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<double>"
    assert clusters.cluster(spark.createDataFrame([], schema), dims=2).count() == 0
    found = clusters.cluster(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema), dims=2).collect()
    assert [(x.cluster, x.distance, x.inertia) for x in found] == [(0, 0, 0)] * 2  # equal centroids: the smaller number


def test_trees_hold_and_prune():
    r = np.random.default_rng(4)
    x = (r.integers(-4000, 4000, (8, 16))[r.integers(0, 8, 900)] + r.integers(-60, 60, (900, 16))).astype(np.int64)
    x[100:300] = x[5]
    tree, order = clusters.cover_tree(x)
    assert (tree.points == x[order]).all() and sorted(order.tolist()) == list(range(900))
    for a, b, radius, child, n in zip(tree.begin, tree.end, tree.radius, tree.child, tree.children):
        assert np.sqrt(clusters.squared(tree.points[a:b], tree.points[a : a + 1])).max() <= radius
        if n:
            assert (tree.begin[child], tree.end[child + n - 1]) == (a, b)
    centroids = x[r.choice(900, 16, replace=False)]
    found, runs, compared = clusters.nearest(tree, *clusters.cover_tree(centroids, 1))
    every = ((tree.points[:, None] - centroids[None]) ** 2).sum(2)
    assert (found == every.argmin(1)).all() and runs and compared < every.size / 2
    count, sums = clusters.sums_of(tree, found, runs, 16)
    assert (sums == np.array([tree.points[found == c].sum(0) for c in range(16)])).all() and count.sum() == 900


def test_too_large_raises(spark):
    with pytest.raises(Exception, match="exceed 64 bits"):
        clusters.cluster(spark.createDataFrame([(1, [1e12])], "vec_id long, embedding array<double>"), dims=1).count()
