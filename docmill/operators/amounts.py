"""Amount items: precedents, sums and checks, in exact decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.text import is_empty_mark, parse_money, parse_quantity

APPROVED = ("APPROVED", "EDITED")


def precedents(items: DataFrame, name: str, projects: list[int], limit: int = 20) -> DataFrame:
    """Approved items of a name in other projects: the name itself first, then what holds it (% and _
    are wild), dearest first."""
    exact = F.col("item_name") == name
    found = items.where(F.col("decision").isin(*APPROVED) & F.col("project_id").isin(*projects) & (exact | F.ilike("item_name", F.lit(f"%{name}%"))))
    found = found.select("document_id", "project_id", "item_name", "quantity", "unit_price", "amount", exact.alias("is_exact"))
    return found.orderBy(F.desc("is_exact"), F.desc("unit_price"), "document_id", "item_name", "quantity", "amount").limit(limit)


def precedent_summary(found: DataFrame) -> DataFrame:
    """Count, least, exact median and largest unit price of the precedents listed."""
    order = Window.orderBy("unit_price")  # the list is limited
    placed = found.where("unit_price IS NOT NULL").withColumn("place", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy()))
    middle = (F.col("place") == F.floor((F.col("n") + 1) / 2)) | (F.col("place") == F.floor(F.col("n") / 2) + 1)
    return placed.agg(
        F.count("*").alias("n"),
        F.min("unit_price").alias("min_price"),
        F.avg(F.when(middle, F.col("unit_price"))).cast("decimal(18,4)").alias("median_price"),
        F.max("unit_price").alias("max_price"),
    )


def by_category(items: DataFrame) -> DataFrame:
    return items.groupBy(F.coalesce("category", F.lit("OTHER")).alias("category")).agg(F.sum("amount").alias("amount"))


def total_check(items: DataFrame, stated: DataFrame) -> DataFrame:
    """Sums without and with VAT of each document against its stated total (document_id, stated_total)."""
    vat = F.coalesce(F.col("category") == "VAT", F.lit(False))
    sums = items.groupBy("document_id").agg(
        F.coalesce(F.sum(F.when(~vat, F.col("amount"))), F.lit(0).cast("decimal(28,2)")).alias("item_total"),
        F.coalesce(F.sum(F.when(vat, F.col("amount"))), F.lit(0).cast("decimal(28,2)")).alias("vat_total"),
    )
    difference = F.col("item_total") - F.col("stated_total")
    checked = sums.join(stated, "document_id", "left")
    return checked.select("document_id", "item_total", "vat_total", "stated_total", difference.alias("difference"), F.coalesce(difference == 0, F.lit(False)).alias("matches"))


def line_check(items: DataFrame) -> DataFrame:
    """Quantity times price, halves up to whole units, against the amount; null if a part is missing."""
    computed = F.round(F.col("quantity") * F.col("unit_price"), 0)
    matches = computed - F.col("amount") == 0  # compared with a decimal(38,0), the amount would lose its fraction
    return items.select("document_id", "item_name", "quantity", "unit_price", "amount", computed.cast("decimal(38,0)").alias("computed"), matches.alias("matches"))


def project_rollup(items: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Totals of each project; more than one currency raises CURRENCY_MISMATCH.

    ``documents`` (document_id, project_id) are counted with their items or without; if they aren't given, those with items
    are. A project without items has the default currency and totals of 0.
    """
    vat = F.coalesce(F.col("category") == "VAT", F.lit(False))
    each = items.groupBy("project_id", "document_id").agg(
        F.min("currency").alias("least"), F.max("currency").alias("most"), F.sum(F.when(~vat, F.col("amount"))).alias("items"), F.sum(F.when(vat, F.col("amount"))).alias("vat")
    )
    if documents is not None:
        each = documents.select("project_id", "document_id").distinct().join(each, ["project_id", "document_id"], "left")
    sums = each.groupBy("project_id").agg(
        F.count("*").alias("documents"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("items").alias("item_total"), F.sum("vat").alias("vat_total")
    )
    guard = F.when(F.col("least") != F.col("most"), F.raise_error(F.lit("CURRENCY_MISMATCH")).cast("string")).otherwise(F.coalesce("most", F.lit("KRW")))
    if documents is not None:
        sums = sums.withColumns({c: F.coalesce(c, F.lit(0)).cast("decimal(38,2)") for c in ("item_total", "vat_total")})
    return sums.select("project_id", "documents", guard.alias("currency"), "item_total", "vat_total")


def has_amounts(documents: DataFrame, items: DataFrame) -> DataFrame:
    """document_id, has_amounts of all documents (document_id)."""
    held = items.select("document_id").distinct().withColumn("held", F.lit(True))
    return documents.join(held, "document_id", "left").select("document_id", F.col("held").isNotNull().alias("has_amounts"))


#: Texts of an item that may say that they say nothing.
OPTIONAL = ("unit", "period_from", "period_to", "category", "notes")


def normalized_payloads(payloads: DataFrame) -> DataFrame:
    """Payloads (stated_total, items) with numbers for amounts, prices and quantities, and null for marks of emptiness.

    Items are structs of strings: item_name, amount, unit_price, quantity and ``OPTIONAL``. Payloads without a list of items stay
    without one, null items stay null.
    """

    def fixed(item: Column) -> Column:
        own = {"item_name": item["item_name"], "amount": parse_money(item["amount"]), "unit_price": parse_money(item["unit_price"]), "quantity": parse_quantity(item["quantity"])}
        own |= {c: F.when(~is_empty_mark(item[c]), item[c]) for c in OPTIONAL}
        return F.when(item.isNotNull(), F.struct(*[x.alias(c) for c, x in own.items()]))

    return payloads.withColumns({"stated_total": parse_money(F.col("stated_total")), "items": F.transform("items", fixed)})
