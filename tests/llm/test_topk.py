"""Top-k search against all pairs, and what it copies."""

import numpy as np
import pytest

from docmill.llm import topk

SCHEMA = "vec_id long, embedding array<double>"


def plain(vectors, queries, k):
    """Every score, one pair at a time, in Python's integers."""
    whole = [(i, [int(np.floor(1024 * v)) for v in x]) for i, x in vectors]
    found = set()
    for q, x in whole:
        if q in queries:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in whole if i != q)
            found |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)}
    return found


def given(name):
    r = np.random.default_rng(5)
    if name == "sparse":
        rows = [r.normal(size=r.integers(0, 90)) * (r.random(1) < 0.9) for _ in range(400)]
        return [(i * 7 % 400 - 100, np.where(r.random(len(x)) < 0.1, x, 0).tolist()) for i, x in enumerate(rows)]
    if name == "ties":
        return [(i, r.integers(0, 2, 3).astype(float).tolist()) for i in range(1500)]
    if name == "large":
        return [(i, (r.normal(size=5) * 1e5).tolist()) for i in range(300)]
    return [(i, r.normal(size=64).tolist()) for i in range(300)] + [(5000 + i, [i / 64.0] * 64) for i in range(300)]


@pytest.mark.parametrize("grid", [(1 << 20, 4096), (500, 60)])
@pytest.mark.parametrize("name", ["dense", "sparse", "ties", "large"])
def test_all_pairs(spark, monkeypatch, name, grid):
    monkeypatch.setattr(topk, "GROUP_CELLS", grid[0])
    monkeypatch.setattr(topk, "PART_ROWS", grid[1])
    rows = given(name)
    asked = {i for i, _ in rows if i % 10 == 0}
    vectors = spark.createDataFrame(rows, SCHEMA)
    found = topk.top_k(vectors, vectors.where("vec_id % 10 = 0"), k=7)
    assert {tuple(r) for r in found.collect()} == plain(rows, asked, 7)


def test_no_broadcast_of_copies(spark):
    """Copies of queries don't go to the driver, however small the queries are and however many partitions there are."""
    vectors = spark.range(3000).selectExpr("id AS vec_id", "transform(sequence(1, 8), i -> (xxhash64(id, i) % 1000) / 1000D) AS embedding")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        found = topk.top_k(vectors, vectors.where("vec_id % 10 = 0"), k=3)
        assert len(found.collect()) == 900
        plan = found._jdf.queryExecution().executedPlan().toString()  # as it ran
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("slots", [12, 600])
def test_copies_follow_the_tables(slots):
    """Copies of queries and of candidates grow together, and a group fits a worker."""
    for candidates in (0, 1, 2000, 50_000, 600_000, 12_000_000, 10**9):
        queries = candidates // 100
        groups, parts = topk._grid(candidates, queries, 64 * queries, 10, slots)
        assert groups >= 1 and queries * 84 // groups <= topk.GROUP_CELLS
        assert 1 <= parts <= max(1, min(slots, candidates // topk.PART_ROWS + 1)) or parts * queries < groups * candidates + queries
