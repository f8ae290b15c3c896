"""Page structure at ingest: where the elements of pages stand in the content, and of what kind they are.

An element stands at the first place of its text behind the one before it, so equal texts take successive
places. The search is a fold over the elements of a page or document whose state is the text behind the cursor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import is_heading
from docmill.operators.layout import MIN_RATIO, headers_and_footers

# What marks a page in an extracted text, and kinds of elements.
PAGE_START, PAGE_END = ("\ue000OCR_REVIEW_", "_START\ue001"), ("\ue000OCR_REVIEW_", "_END\ue001")
LINE, HEADING, HEADER_FOOTER, AUTO = "TEXT_LINE", "HEADING", "HEADER_FOOTER", "AUTO"


def _mark(parts: tuple[str, str], page_number: Column) -> Column:
    return F.concat(F.lit(parts[0]), page_number.cast("string"), F.lit(parts[1]))


def marked(text: Column, page_number: Column) -> Column:
    """The text of a page between its marks."""
    return F.concat(_mark(PAGE_START, page_number), text, _mark(PAGE_END, page_number))


def _locate(part: Column, text: Column, begin: Column | None = None) -> Column:
    return F.call_function("locate", part, text, *([] if begin is None else [begin]))


def find_in_order(content: Column, elements: Column) -> Column:
    """start and end of each element (text, content_start, content_end) in the content, null where it isn't found.

    A given start is taken as it is; what isn't found leaves the cursor where it was.
    """

    def step(state: Column, e: Column) -> Column:
        at = _locate(e["text"], state["rest"])
        start = F.when(e["content_start"].isNotNull(), e["content_start"]).when(at > 0, state["cursor"] + at - 1).cast("long")
        end = F.coalesce(e["content_end"], start + F.length(e["text"])).cast("long")
        cursor = F.coalesce(end, state["cursor"])
        rest = F.when(end.isNull(), state["rest"]).otherwise(F.substring(content, cursor.cast("int") + 1, F.length(content)))
        found = F.concat(state["found"], F.array(F.struct(start.alias("start"), end.alias("end"))))
        return F.struct(cursor.alias("cursor"), rest.alias("rest"), found.alias("found"))

    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    first = F.struct(F.lit(0).cast("long").alias("cursor"), content.alias("rest"), none.alias("found"))
    return F.aggregate(elements, first, step, lambda s: s["found"])


def resolved_pages(contents: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contents without the marks of pages, and each element with its range.

    ``contents`` has document_id, content; ``pages`` has document_id, page_number (unique in its document), elements
    (text, ...) in order. Elements are looked for between the marks of their page only. A page without a
    start is left as it is, one without an end loses its start; the elements of both have no range.
    """
    listed = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "elements"))).alias("pages"))
    joined = contents.join(listed, "document_id", "left")

    def marks(p: Column) -> Column:
        start, end = _mark(PAGE_START, p["page_number"]), _mark(PAGE_END, p["page_number"])
        at = _locate(start, F.col("content"))
        until = F.when(at > 0, _locate(end, F.col("content"), at + F.length(start))).otherwise(0)
        fields = {"page_number": p["page_number"], "elements": p["elements"], "at": at, "n": F.length(start), "until": until, "m": F.length(end)}
        return F.struct(*[x.alias(k) for k, x in fields.items()])

    found = joined.withColumn("pages", F.transform("pages", marks))
    both = F.flatten(F.transform("pages", lambda p: F.array(F.struct(p["at"].alias("at"), p["n"].alias("n")), F.struct(p["until"].alias("at"), p["m"].alias("n")))))
    found = found.withColumn("cuts", F.array_sort(F.filter(both, lambda c: c["at"] > 0)))
    end_of = lambda c: c["at"] + c["n"]
    before = lambda i: F.coalesce(end_of(F.get("cuts", i - 1)), F.lit(1))
    pieces = F.transform("cuts", lambda c, i: F.substring(F.col("content"), before(i), c["at"] - before(i)))
    rest = F.substring(F.col("content"), end_of(F.element_at("cuts", -1)), F.length("content"))
    clean = F.when(F.coalesce(F.size("cuts"), F.lit(0)) > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col("content"))
    found = found.withColumn("clean", clean)

    def place(at: Column) -> Column:
        return at - 1 - F.aggregate(F.filter("cuts", lambda c: c["at"] < at), F.lit(0), lambda n, c: n + c["n"])

    each = found.select("document_id", "clean", "cuts", F.explode("pages").alias("p"))
    whole = (F.col("p.at") > 0) & (F.col("p.until") > 0)
    each = each.withColumns({"begin": F.when(whole, place(F.col("p.at"))), "until": F.when(whole, place(F.col("p.until")))})
    each = each.withColumn("segment", F.substring(F.col("clean"), F.col("begin") + 1, F.col("until") - F.col("begin")))
    asked = F.transform("p.elements", lambda e: F.struct(e["text"].alias("text"), F.lit(None).cast("long").alias("content_start"), F.lit(None).cast("long").alias("content_end")))
    each = each.withColumn("ranges", F.when(whole, find_in_order(F.col("segment"), asked)))
    rows = each.select("document_id", F.col("p.page_number").alias("page_number"), "begin", "ranges", F.posexplode("p.elements").alias("reading_order", "e"))
    spot = F.get("ranges", F.col("reading_order"))
    rows = rows.select("document_id", "page_number", "reading_order", "e.*", (F.col("begin") + spot["start"]).alias("content_start"), (F.col("begin") + spot["end"]).alias("content_end"))
    return found.select(*[F.col("clean").alias("content") if c == "content" else F.col(c) for c in contents.columns]), rows


def initial_elements(elements: DataFrame, contents: DataFrame, ratio: float = MIN_RATIO) -> DataFrame:
    """The elements of new documents with their kind and range.

    ``elements`` has document_id, page_number, reading_order, text, y, element_type, element_type_source,
    is_paragraph_start, content_start, content_end; a plain line becomes a header or footer where enough pages
    repeat it in their bands, else a heading if it reads like one. What has no range is looked for in
    the content (document_id, content) behind the element before it.
    """
    key = ["document_id", "page_number", "reading_order"]
    lines = elements.select(*key, F.col("page_number").alias("page"), "text", "y")
    repeated = headers_and_footers(lines, ratio).select(*key, F.lit(True).alias("repeated"))
    typed = elements.join(repeated, key, "left")
    plain, band = F.col("element_type") == LINE, F.coalesce("repeated", F.lit(False))
    title = plain & ~band & is_heading(F.col("text"))
    typed = typed.withColumns(
        {
            "element_type": F.when(plain & band, HEADER_FOOTER).when(title, HEADING).otherwise(F.col("element_type")),
            "element_type_source": F.when(plain, AUTO).otherwise(F.col("element_type_source")),
            "is_paragraph_start": F.when(plain & band, False).when(title, True).otherwise(F.col("is_paragraph_start")),
        }
    ).drop("repeated")
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "reading_order", "text", "content_start", "content_end")))
    found = elements.groupBy("document_id").agg(ordered.alias("elements")).join(contents.select("document_id", "content"), "document_id", "left")
    found = found.withColumn("ranges", find_in_order(F.coalesce("content", F.lit("")), F.col("elements")))
    ranges = found.select("document_id", F.explode(F.arrays_zip("elements", "ranges")).alias("z")).select(
        "document_id", "z.elements.page_number", "z.elements.reading_order", F.col("z.ranges.start").alias("content_start"), F.col("z.ranges.end").alias("content_end")
    )
    return typed.drop("content_start", "content_end").join(ranges, key)
