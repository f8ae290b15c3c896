"""Places of lines are settled where equal lines meet; regions are searched without counting what parts of the range rule out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.llm import lines, near
from docmill.llm.common import frugal


@pytest.mark.parametrize("held", [1, 1_000_000])
def test_each_line_has_one_first_place_and_the_others_are_gone(spark, monkeypatch, held):
    monkeypatch.setattr(lines, "_PLACES", held)
    rows = [(i, f"common\nown {i}\n \ncommon" + "\nhalf" * (i % 2)) for i in range(40)] + [(7, "common\ntwin"), (7, "common\ntwin")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("row", F.length("text").cast("long"))
    dealt = lines._banded(docs, 3).repartitionById(3, F.col("part")).select("entries", "places")
    found = dealt.mapInArrow(frugal(lines._shared()), lines.FOUND).where("doc_id IS NOT NULL").collect()
    want = sorted({(lines.line_hash(x), d, len(t), i) for d, t in rows for i, x in enumerate(t.split("\n")) if x.strip()}, key=lambda p: (p[0], p[1], p[3], p[2]))
    firsts = {}
    for p in want:
        firsts.setdefault(p[0], p)
    places = {(r.hash % (1 << 64), r.doc_id, r.row, r.line): r.gone for r in found}
    assert places == {p: p != firsts[p[0]] for p in want}


@pytest.mark.parametrize("few", [0, 12])
def test_region_links_are_those_of_all_pairs(monkeypatch, few):
    monkeypatch.setattr(near, "_FEW", few)
    rng = np.random.default_rng(4)
    base, sets = rng.integers(0, 1 << 32, 300, dtype=np.uint64).astype("<u4"), []
    for i in range(40):
        changed = base.copy()
        changed[: 4 * i] = rng.integers(0, 1 << 32, 4 * i, dtype=np.uint64)
        sets.append(np.unique(changed))
    found = near._links_in_region(np.arange(40), np.arange(40), sets, 80)
    root = list(range(40))
    for u, v in found:
        shared = len(np.intersect1d(sets[u], sets[v]))
        assert 100 * shared >= 80 * (len(sets[u]) + len(sets[v]) - shared)
        root = [root[u] if x == root[v] else x for x in root]
    for u in range(40):
        for v in range(u):
            shared = len(np.intersect1d(sets[u], sets[v]))
            assert root[u] == root[v] or 100 * shared < 80 * (len(sets[u]) + len(sets[v]) - shared)


def test_sets_ruled_out_are_not_counted(monkeypatch):
    rng = np.random.default_rng(5)
    base, sets = rng.integers(0, 1 << 32, 300, dtype=np.uint64).astype("<u4"), []
    for _ in range(30):
        sets.append(np.unique(np.concatenate([base[:150], rng.integers(0, 1 << 32, 150, dtype=np.uint64).astype("<u4")])))
    monkeypatch.setattr(np, "bincount", None)
    monkeypatch.setattr(np, "searchsorted", None)
    assert near._links_in_region(np.arange(30), np.arange(30), sets, 80) == []
