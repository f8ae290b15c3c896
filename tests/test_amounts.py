"""Checks of amounts in exact decimals."""

from decimal import Decimal

from docmill.operators import amounts


def test_lines_match_to_the_last_digit(spark):
    rows = [(1, "a", Decimal("45"), Decimal("973.60"), Decimal("43811.80")), (2, "a", Decimal("45"), Decimal("973.60"), Decimal("43812.00")),
            (3, "a", Decimal("1.5"), Decimal("1.00"), Decimal("2.00")), (4, "a", None, Decimal("1.00"), Decimal("1.50"))]
    items = spark.createDataFrame(rows, "document_id long, item_name string, quantity decimal(18,4), unit_price decimal(18,2), amount decimal(18,2)")
    found = {r.document_id: (r.computed, r.matches) for r in amounts.line_check(items).collect()}
    assert found == {1: (Decimal(43812), False), 2: (Decimal(43812), True), 3: (Decimal(2), True), 4: (None, None)}


def test_money_is_whole_to_the_last_digit_and_parsed_once(spark):
    from pyspark.sql import functions as F

    from docmill.functions.text import parse_money

    rows = [("5.0000000001", None), ("5.0", 5), ("007 원", 7), ("1e3", 1000), ("999999999999999999", 999999999999999999), ("1234567890123456789012", 1234567890123456789012), ("-0", 0), ("none", None)]
    df = spark.createDataFrame([(x, None if n is None else Decimal(n)) for x, n in rows], "x string, n decimal(38,0)")
    assert df.where(~parse_money(F.col("x")).eqNullSafe(F.col("n"))).collect() == []
    item = "struct<item_name:string,amount:string,unit_price:string,quantity:string,unit:string,period_from:string,period_to:string,category:string,notes:string>"
    given = spark.createDataFrame([("1원", [("a", "5.0000000001", "2", "1개", "미정", "", None, "x", "- ")])], f"stated_total string, items array<{item}>")
    found = amounts.normalized_payloads(given)
    assert tuple(found.first()["items"][0]) == ("a", None, Decimal(2), Decimal("1.0000"), None, None, None, "x", None)
    assert found._jdf.queryExecution().analyzed().toString().count("[,\\s원") == 3  # currencies are taken off once for each amount
