"""Chains of superseded decisions of any length, and blank lines."""

import pytest

from docmill.operators import reports
from docmill.streaming import ingest

SCHEMA = "id long, superseded_by long"


def chain(spark, rows):
    return {(r.id, r.last, r.steps) for r in reports.open_chain(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_long_chain(spark):
    assert chain(spark, [(i, i + 1) for i in range(300)] + [(300, None)]) == {(i, 300, 300 - i) for i in range(300)}


def test_nothing_superseded(spark):
    assert chain(spark, [(1, None), (None, None)]) == set() == chain(spark, [])


def test_branches_and_missing_ends(spark):
    assert chain(spark, [(1, 3), (2, 3), (3, 9), (None, 2)]) == {(1, 9, 2), (2, 9, 2), (3, 9, 1), (None, 9, 3)}


def test_circle_is_an_error(spark):
    decisions = spark.createDataFrame([(1, 2), (2, 1)], SCHEMA)
    with pytest.raises(ValueError, match="DECISION_CIRCLE"):
        reports.open_chain(decisions, rounds=4)


def test_blank_lines_of_unicode_space_go(spark):
    found = ingest.lines(spark.createDataFrame([(1, "a\n　 \n \t\nb \x1f\n\x1f")], "document_id long, content string")).collect()
    assert [(r.line_no, r.line) for r in found] == [(0, "a"), (3, "b \x1f")]
