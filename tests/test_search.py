"""Options of the hybrid search on a small table."""

import pytest
from pyspark.sql import functions as F

from docmill.operators import search

SCHEMA = "chunk_id long, document_id long, project_id int, seq long, text string, embedding array<double>, embedding_model string"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(i, i // 3, i % 2, i, f"{'Payment terms apply ' if i % 4 == 0 else 'Other words '}{'filler ' * 60}{i}", [1.0, i / 10], "m" if i != 8 else "old") for i in range(12)]
    return spark.createDataFrame(rows, SCHEMA)


def found(df):
    return [(r.chunk_id, r.match_kind) for r in df.collect()]


def test_both_legs_in_a_scope(chunks):
    hits = found(search.hybrid_search(chunks, [1.0, 0.0], " payment ", "m", [0], k=10, candidates=3))
    assert dict(hits) == {0: "both", 4: "both", 2: "vector"}  # 8 is of another model, odd ones of another project
    wider = dict(found(search.hybrid_search(chunks, [1.0, 0.0], "payment", "m", [0, 1], k=10, candidates=3)))
    assert wider == {0: "both", 1: "vector", 2: "vector", 4: "keyword"}
    assert dict(found(search.hybrid_search(chunks, [1.0, 0.0], "payment", "m", [0, 1], document_id=1))) == {3: "vector", 4: "both", 5: "vector"}


def test_a_leg_can_be_missing(chunks):
    assert {k for _, k in found(search.hybrid_search(chunks, [1.0, 0.0], "p", "m", [0]))} == {"vector"}  # too short for words
    assert found(search.hybrid_search(chunks, [], "payment", "m", [0])) == [(0, "keyword"), (4, "keyword")]
    assert found(search.hybrid_search(chunks, [1.0, 0.0], "payment", "m", [])) == []
    assert found(search.hybrid_search(chunks, [], "", "m", [0])) == []


def test_snippets_follow_the_leg(chunks):
    rows = {r.chunk_id: r for r in search.hybrid_search(chunks, [1.0, 0.0], "terms", "m", [0]).collect()}
    assert rows[0].snippet[rows[0].hit_offset :].startswith("terms") and rows[2].hit_offset is None and rows[2].snippet.startswith("Other words")
    assert len(rows[2].snippet) <= search.semantic_snippet.__globals__["SEMANTIC_SNIPPET"] + 1


@pytest.mark.parametrize(("text", "term", "score"), [("the word itself", "word", 1.0), ("words", "word", 0.8), ("nothing", "xyz", 0.0), ("", "word", 0.0), (None, "word", 0.0)])
def test_word_similarity(spark, text, term, score):
    assert spark.createDataFrame([(text,)], "t string").select(search.word_similarity(F.col("t"), term)).first()[0] == pytest.approx(score)
