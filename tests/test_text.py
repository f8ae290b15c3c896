"""Text expressions, row in and row out."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from docmill.functions import formats
from docmill.functions import text as t
from docmill.operators import documents, reports, search


def values(spark, rows, expression):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_headings(spark):
    yes = ["제3조(계약의 목적)", "제 12 장", "1. Scope", "1.2.3) Terms", "가. 목적", "Ⅱ. 개요", "IV. Plan", "## Any end.", "  3) 내용  "]
    no = ["", "본문 문장", "5.8%", "1.", "제3조 이 계약은 효력이 있다.", "3. 어느 정도입니까? (기준)", "1. " + "x" * 60, "■ item", "2. 제출함"]
    assert values(spark, yes, t.is_heading) == [True] * len(yes)
    assert values(spark, no, t.is_heading) == [False] * len(no)


def test_money(spark):
    rows = ["9,500,000원", "1,234,567 KRW", " 9500000 ", "", "-", "미정", "약 1억", "-500", "9,500,000.5", "12.0", None, "N/A"]
    wanted = [9500000, 1234567, 9500000, None, None, None, None, None, None, 12, None, None]
    assert [None if x is None else int(x) for x in values(spark, rows, t.parse_money)] == wanted


def test_quantity(spark):
    rows = ["3인월", "1.5 M/M", "1,200개", "-2", "없음", None, "x"]
    assert values(spark, rows, t.parse_quantity) == [Decimal("3.0000"), Decimal("1.5000"), Decimal("1200.0000"), None, None, None, None]


def test_tokens_and_strip(spark):
    assert values(spark, ["", "a", "ab", "a" * 907], t.token_estimate) == [0, 1, 2, 480]
    assert values(spark, ["　a b \n"], t.strip) == ["a b"]
    assert values(spark, ["a　　b \n c"], t.collapsed) == ["a b c"]
    assert values(spark, ["Page 12  of 300"], t.repeat_key) == ["Page # of #"]


def test_keyword_snippet_points_at_the_term(spark):
    rows = ["x" * 300 + " Needle " + "y" * 300, "Needle", "none here", "z" * 400]
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    snippet, offset = t.keyword_snippet(F.col("x"), "needle")
    for text, at in df.select(snippet, offset).collect():
        if at is not None:
            assert text[at : at + 6] == "Needle"
        assert len(text) <= 162
    assert [r[1] for r in df.select(snippet, offset).collect()][2:] == [None, None]


def test_wildcards(spark):
    rows = ["100% sure", "100 sure", "a_b", "axb"]
    assert values(spark, rows, lambda c: t.contains_ignoring_case(c, "0%")) == [True, False, False, False]
    assert values(spark, rows, lambda c: t.contains_ignoring_case(c, "A_B")) == [False, False, True, False]
    assert values(spark, ["the end", "th eend", "te"], lambda c: documents.ignoring_white_space(c, "t h%n")) == [True, True, False]


def test_word_similarity(spark):
    rows = ["계약금액", "계약금액은 얼마", "다른 말", "", None]
    assert values(spark, rows, lambda c: search.word_similarity(c, "계약금액")) == [1.0, 0.8, 0.0, 0.0, 0.0]


def test_scope_and_keyword_errors(spark):
    members = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "project_id int, user_id int")
    assert {r[0] for r in search.resolve_scope(members, 7).collect()} == {1, 2}
    assert {r[0] for r in search.resolve_scope(members, 7, [2, 2]).collect()} == {2}
    assert search.resolve_scope(members, 9).count() == 0
    with pytest.raises(search.SearchError, match="PROJECT_NOT_FOUND"):
        search.resolve_scope(members, 7, [2, 3])
    with pytest.raises(search.SearchError, match="KEYWORD_TOO_SHORT"):
        search.keyword_hits(members, " x ")
    with pytest.raises(ValueError, match="PERIOD_REQUIRED"):
        reports.report_preview(members, members, members, members, 1, "WEEKLY_REPORT")


def test_pieces_of_a_term_are_found_once(spark):
    rows = ["The aTHEthe", "", "none", "the", None, "thethe x", "the " * 40000]
    found = values(spark, rows, lambda x: formats.split_by(x, "the"))
    plain = [None if x is None else [(p.text, p.match) for p in x] for x in found]
    assert plain[:4] == [[("The", True), (" a", False), ("THE", True), ("the", True)], [], [("none", False)], [("the", True)]]
    assert plain[4:6] == [None, [("the", True), ("the", True), (" x", False)]]
    assert len(plain[6]) == 80000
    plan = spark.range(1).select(formats.split_by(F.col("id").cast("string"), "the").alias("p"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all(") == 1 and "get(regexp_extract_all" not in plan  # else each piece searches the whole text


def test_strip_takes_all_white_space_of_a_pattern(spark):
    ends = [chr(c) for c in (*range(0x250), 0x1680, 0x180E, *range(0x2000, 0x2070), 0x3000, 0xFEFF)]
    rows = ["", " \n", *[c for c in ends], *[f"{c} {c}a{c}b \n{c}" for c in ends]]
    df = spark.createDataFrame([(x,) for x in rows], "x string")
    plain = F.regexp_replace("x", r"(?U)^\s+|\s+$", "")
    assert df.where(~t.strip(F.col("x")).eqNullSafe(plain)).collect() == []
    plan = spark.range(1).select(t.strip(F.col("id").cast("string")).alias("p"))._jdf.queryExecution().analyzed().toString()
    assert "regexp_replace" not in plan  # which looks at each character of a long text
