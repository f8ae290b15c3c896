"""Edits of reviewed elements that change their structure: batches, merges, their undoing, and splits.

Each request works on all documents at once and is all or nothing within a document: what is asked is checked
first, a document with any error stays as it is and gets the error as a row, and only the others are changed. What was
found fit is written to the shared folder, so that it is checked once for all the tables that change.
Texts are spliced and ranges moved from the original ranges, so several edits of a document don't meet.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.operators.storage import checkpointed

KEY = ["document_id", "element_id"]
#: Order of elements in a document.
PLACE = ["page_id", "reading_order", "element_id"]

# Names of errors and states, kinds of elements, and the limits of what lies together.
NO_DOCUMENT, NOT_FOUND, CONFLICT, STRUCTURE, TOO_FAR, MAPPING, NO_UNDO = (
    "DOCUMENT_NOT_FOUND", "OCR_ELEMENT_NOT_FOUND", "OCR_EDIT_CONFLICT", "OCR_INVALID_STRUCTURE", "OCR_MERGE_TOO_FAR",
    "OCR_CONTENT_MAPPING_CONFLICT", "OCR_MERGE_UNDO_UNAVAILABLE",
)
REOPENED = ("PENDING", "COMPLETED")
CORRECTED = "USER_CORRECTED"
TABLE_KINDS = ("TABLE_ROW", "TABLE_HEADER")
SAME_COLUMN, SAME_LINE, GAP_HEIGHTS, LEAST_RATIO, MOST_RATIO = 0.35, 0.5, 3, 0.1, 0.9


@dataclass(frozen=True)
class Review:
    """The tables of a review.

    elements: document_id, element_id (unique in its document), page_id, reading_order, text, x, y, width, height,
    confidence, source, element_type, element_type_source, is_paragraph_start, version, is_deleted, is_excluded, is_in_content, content_start,
    content_end; contents: document_id, content, char_count, ocr_char_count, text_version, is_confirmed;
    documents: document_id, review_status, ocr_revision. operations, revisions and events are written by the edits.
    """

    elements: DataFrame
    contents: DataFrame
    documents: DataFrame
    operations: DataFrame
    revisions: DataFrame
    events: DataFrame

    def settled(self) -> Review:
        """The same tables with their lineage cut, in buckets of documents; revisions and events, which no edit reads, stay as they are."""
        return Review(*map(_kept, (self.elements, self.contents, self.documents, self.operations)), self.revisions, self.events)


def _kept(df: DataFrame) -> DataFrame:
    """``df`` written in buckets of documents: what an edit does by document then needs no shuffle."""
    return checkpointed(df, "document_id")


OPERATIONS = "operation_id bigint, document_id bigint, survivor_id bigint, merged_version int, snapshot_json string, undone boolean, created_by int"
REVISIONS = "document_id bigint, element_id bigint, changed_by int, before_text string, after_text string, from_version int, to_version int"
EVENTS = "document_id bigint, page_id bigint, event_type string, details_json string, created_by int"
SNAPSHOT = """struct<selected_ids:array<bigint>,segment:string,origin:bigint,elements:array<struct<element_id:bigint,text:string,x:double,y:double,
    width:double,height:double,confidence:double,source:string,is_excluded:boolean,is_in_content:boolean,content_start:bigint,content_end:bigint>>>"""
SAVED = ["text", "x", "y", "width", "height", "confidence", "source", "is_excluded", "is_in_content"]


def opened(elements: DataFrame, contents: DataFrame, documents: DataFrame) -> Review:
    """A review that nobody has changed yet."""
    spark = elements.sparkSession
    return Review(elements, contents, documents, *(spark.createDataFrame([], s) for s in (OPERATIONS, REVISIONS, EVENTS)))


def _first_errors(asked: DataFrame, errors: DataFrame) -> DataFrame:
    """document_id, error of all documents asked for; of several errors (document_id, step, rank, error) the least."""
    least = errors.where("error IS NOT NULL").groupBy("document_id").agg(F.min(F.struct("step", "rank", "error"))["error"].alias("error"))
    return _kept(asked.select("document_id").distinct().join(least, "document_id", "left"))


def misfits(edits: DataFrame, contents: DataFrame) -> DataFrame:
    """document_id and step of the edits (document_id, step, start, end, expected) whose range doesn't hold what is expected."""
    listed = edits.groupBy("document_id").agg(F.collect_list(F.struct("step", "start", "end", "expected")).alias("edits"))

    def fits(e: Column) -> Column:
        there = F.substring(F.col("content"), e["start"].cast("int") + 1, (e["end"] - e["start"]).cast("int"))
        whole = e["start"].isNotNull() & e["end"].isNotNull() & (e["start"] <= e["end"]) & (e["end"] <= F.length("content"))
        return F.coalesce(whole & (there == e["expected"]), F.lit(False))

    bad = contents.select("document_id", "content").join(listed, "document_id").select("document_id", F.explode(F.filter("edits", lambda e: ~fits(e))).alias("e"))
    return bad.select("document_id", "e.step")


def spliced(contents: DataFrame, edits: DataFrame) -> DataFrame:
    """Contents with all edits (document_id, start, end, page_id, reading_order, element_id, replacement) put in."""
    listed = edits.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("start", *PLACE, "end", "replacement"))).alias("edits"))
    joined = contents.join(listed, "document_id", "left")
    part = lambda begin, end: F.substring(F.col("content"), begin.cast("int") + 1, (end - begin).cast("int"))
    before = lambda i: F.coalesce(F.get("edits", i - 1)["end"], F.lit(0))
    pieces = F.transform("edits", lambda e, i: F.concat(part(before(i), e["start"]), e["replacement"]))
    rest = part(F.element_at("edits", -1)["end"], F.length("content").cast("long"))
    text = F.when(F.col("edits").isNull(), F.col("content")).otherwise(F.concat(F.array_join(pieces, ""), rest))
    return joined.withColumn("content", text).withColumn("char_count", F.length("content")).select(*contents.columns)


def moved(elements: DataFrame) -> DataFrame:
    """Elements whose ``replacement`` (null: none) has gone into the text: their ranges, and those of live ones behind.

    A range moves by what the edits add that end before it, or where it begins and are earlier in order.
    """
    delta = F.length("replacement") - (F.col("content_end") - F.col("content_start"))
    rows = elements.withColumns({"__at": F.col("content_start"), "__kind": F.lit(0), "__delta": F.lit(0).cast("long")})
    live = rows.where("NOT is_deleted AND content_start IS NOT NULL")
    edits = live.where("replacement IS NOT NULL").select("document_id", *PLACE, F.col("content_end").alias("__at"), F.lit(1).alias("__kind"), delta.alias("__delta"))
    order = Window.partitionBy("document_id").orderBy("__at", *PLACE, "__kind")
    both = live.unionByName(edits, allowMissingColumns=True).withColumn("__shift", F.sum("__delta").over(order)).where("__kind = 0")
    start = F.col("content_start") + F.col("__shift")
    end = F.when(F.col("replacement").isNull(), F.col("content_end") + F.col("__shift")).otherwise(start + F.length("replacement"))
    both = both.select(*[{"content_start": start, "content_end": end}.get(c, F.col(c)).cast(elements.schema[c].dataType).alias(c) for c in elements.columns])
    return both.unionByName(rows.where("is_deleted OR content_start IS NULL").select(*elements.columns)).drop("replacement")


def _put(review: Review, replacements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements and contents after replacements (document_id, element_id, replacement) of texts in the content."""
    rows = review.elements.join(replacements, KEY, "left")
    edits = rows.where("replacement IS NOT NULL").select("document_id", *PLACE, F.col("content_start").alias("start"), F.col("content_end").alias("end"), "replacement")
    return moved(rows), spliced(review.contents, edits)


def _counted(review: Review, elements: DataFrame, contents: DataFrame, touched: DataFrame) -> Review:
    """Counters after ``touched`` (document_id, requests, bumps): revisions, text versions, kept characters; reviews reopen."""
    touched = touched.groupBy("document_id").agg(F.sum("requests").alias("requests"), F.sum("bumps").alias("bumps"))
    again = F.col("requests").isNotNull() & F.col("review_status").isin(*REOPENED)
    documents = review.documents.join(touched, "document_id", "left").withColumn("again", again)
    kept = elements.where("NOT is_deleted AND NOT is_excluded").groupBy("document_id").agg(F.sum(F.length("text")).alias("kept"))
    texts = contents.join(documents.select("document_id", "requests", "bumps", "again"), "document_id", "left").join(kept, "document_id", "left")
    texts = texts.withColumns(
        {
            "ocr_char_count": F.when(F.col("requests").isNotNull(), F.coalesce("kept", F.lit(0))).otherwise(F.col("ocr_char_count")).cast("long"),
            "text_version": (F.col("text_version") + F.coalesce("bumps", F.lit(0))).cast("int"),
            "is_confirmed": F.col("is_confirmed") & ~F.coalesce("again", F.lit(False)),
        }
    ).select(*contents.columns)
    revised = (F.col("ocr_revision") + F.coalesce("requests", F.lit(0))).cast("int")
    status = F.when(F.col("again"), "IN_PROGRESS").otherwise(F.col("review_status"))
    documents = documents.withColumns({"review_status": status, "ocr_revision": revised}).select(*review.documents.columns)
    return replace(review, elements=elements, contents=texts, documents=documents)


CHANGES = {
    "text": "string", "is_excluded": "boolean", "element_type": "string", "is_paragraph_start": "boolean", "x": "double", "y": "double", "width": "double",
    "height": "double", "re_ocr_applied": "boolean", "re_ocr_confidence": "double",
}


def edit_batch(review: Review, changes: DataFrame, user_id: int) -> tuple[Review, DataFrame]:
    """The review after a batch of changes for each document, and document_id, error (null: done) of each.

    ``changes`` has document_id, element_id, the version seen, and any of ``CHANGES`` (null: as it is). A heading
    begins a paragraph, a row of a table doesn't and may not be asked to; boxes stay within the page. The text
    version rises once if a text in the content or the structure changes, not for boxes or exclusions.
    """
    absent = {c: F.lit(None).cast(t) for c, t in CHANGES.items() if c not in changes.columns}
    asked = changes.withColumns(absent).select(*KEY, F.col("version").alias("seen"), *[F.col(c).cast(t).alias(f"new_{c}") for c, t in CHANGES.items()])
    asked = asked.withColumn("times", F.count("*").over(Window.partitionBy(*KEY)))
    joined = asked.join(review.elements, KEY, "left").join(review.documents.select("document_id", F.lit(True).alias("known")), "document_id", "left")
    kind = F.coalesce("new_element_type", "element_type")
    table = kind.isin(*TABLE_KINDS)
    begins = F.when(kind == "HEADING", True).when(table, False).otherwise(F.col("new_is_paragraph_start"))
    x, y, width, height = (F.coalesce(f"new_{c}", c) for c in ("x", "y", "width", "height"))
    bad = table & F.coalesce("new_is_paragraph_start", F.lit(False)) | (width <= 0) | (height <= 0) | (x + width > 1) | (y + height > 1)
    rank = F.when(F.col("known").isNull(), 0).when(F.col("version").isNull() | (F.col("times") > 1), 1).when(F.col("seen") != F.col("version"), 2).when(bad, 3)
    names = F.array(*map(F.lit, (NO_DOCUMENT, NOT_FOUND, CONFLICT, STRUCTURE)))
    checked = joined.select("document_id", F.lit(0).alias("step"), rank.alias("rank"), F.get(names, rank).alias("error"))
    text = F.col("new_text").isNotNull() & (F.col("new_text") != F.col("text"))
    edits = joined.where(text & F.col("is_in_content")).select("document_id", F.lit(1).alias("step"), F.col("content_start").alias("start"), F.col("content_end").alias("end"), F.col("text").alias("expected"))
    unfit = misfits(edits, review.contents).select("document_id", "step", F.lit(4).alias("rank"), F.lit(MAPPING).alias("error"))
    outcomes = _first_errors(asked, checked.unionByName(unfit))

    good = joined.join(outcomes.where("error IS NULL").select("document_id"), "document_id", "left_semi")
    differs = lambda new, old: F.coalesce(new != F.col(old), F.lit(False))
    structure = differs(F.col("new_element_type"), "element_type") | differs(begins, "is_paragraph_start")
    box = differs(F.col("new_x"), "x") | differs(F.col("new_y"), "y") | differs(F.col("new_width"), "width") | differs(F.col("new_height"), "height")
    again = F.coalesce("new_re_ocr_applied", F.lit(False))
    flags = {"text_changed": text, "structure_changed": structure, "type_changed": differs(F.col("new_element_type"), "element_type"), "begins": begins, "again": again}
    flags["changed"] = text | structure | box | again | differs(F.col("new_is_excluded"), "is_excluded")
    good = _kept(good.withColumns(flags).where("changed").select(*KEY, "is_in_content", F.col("text").alias("before"), "version", *flags, *[f"new_{c}" for c in CHANGES]))

    replacements = good.where("text_changed AND is_in_content").select(*KEY, F.col("new_text").alias("replacement"))
    elements, contents = _put(review, replacements)
    columns = elements.columns
    joined = elements.join(good.drop("is_in_content", "version"), KEY, "left")
    new = {c: F.coalesce(f"new_{c}", c) for c in ("text", "is_excluded", "element_type", "x", "y", "width", "height")}
    new |= {"is_paragraph_start": F.coalesce("begins", "is_paragraph_start"), "version": F.col("version") + F.col("changed").isNotNull().cast("int")}
    new |= {"confidence": F.when(F.col("again"), F.col("new_re_ocr_confidence")).otherwise(F.col("confidence")), "source": F.when(F.col("again"), "RE_OCR").otherwise(F.col("source"))}
    new["element_type_source"] = F.when(F.col("type_changed"), CORRECTED).otherwise(F.col("element_type_source"))
    elements = joined.withColumns(new).select(*columns)
    touched = good.groupBy("document_id").agg(F.lit(1).alias("requests"), F.max((F.col("text_changed") & F.col("is_in_content") | F.col("structure_changed")).cast("int")).alias("bumps"))
    after = _counted(review, elements, contents, touched)
    made = good.where("text_changed").select(*KEY, F.lit(user_id).alias("changed_by"), F.col("before").alias("before_text"), F.col("new_text").alias("after_text"), F.col("version").alias("from_version"), (F.col("version") + 1).alias("to_version"))
    return replace(after, revisions=review.revisions.unionByName(made)), outcomes


def _overlap(a: str, size: str) -> tuple[Column, Column]:
    """Of a member and the one before it: the overlap along one axis as a share of the smaller, and the gap."""
    end, end_before = F.col(a) + F.col(size), F.col(f"b_{a}") + F.col(f"b_{size}")
    shared = F.greatest(F.lit(0.0), F.least(end, end_before) - F.greatest(a, f"b_{a}"))
    gap = F.greatest(F.lit(0.0), F.greatest(a, f"b_{a}") - F.least(end, end_before))
    return shared / F.greatest(F.least(size, f"b_{size}"), F.lit(0.001)), gap


def merge_groups(review: Review, groups: DataFrame, user_id: int, join_with_space: bool = True) -> tuple[Review, DataFrame]:
    """The review with each group of neighbours merged into a new element, and document_id, error of each document.

    ``groups`` has document_id, step (the groups of a document in order), element_id and the version seen. Members
    are live, in the content, on one page, without live elements between them, and lie together. They stay
    as tombstones; the new element takes the first one's place, the least confidence and the box around all. An
    operation keeps what undoes the merge.
    """
    active = review.elements.where("NOT is_deleted").withColumn("position", F.row_number().over(Window.partitionBy("document_id", "page_id").orderBy("reading_order", "element_id")))
    turn = F.row_number().over(Window.partitionBy(*KEY).orderBy("step"))
    asked = groups.select(*KEY, "step", F.col("version").alias("seen")).withColumn("turn", turn)
    joined = asked.join(active, KEY, "left")
    inside = Window.partitionBy("document_id", "step").orderBy("reading_order", "element_id")
    joined = _kept(joined.withColumns({f"b_{c}": F.lag(c).over(inside) for c in ("x", "y", "width", "height")}))
    across, x_gap = _overlap("x", "width")
    down, y_gap = _overlap("y", "height")
    reach = F.greatest("height", "b_height") * GAP_HEIGHTS
    near = (across >= SAME_COLUMN) & (y_gap <= reach) | (down >= SAME_LINE) & (x_gap <= reach)
    rank = (
        F.when(F.col("version").isNull() | (F.col("turn") > 1), 1)
        .when(F.col("is_excluded") | ~F.col("is_in_content"), 2)
        .when(F.col("seen") != F.col("version"), 3)
        .when(F.col("b_x").isNotNull() & ~near, 5)
    )
    names = F.array(*map(F.lit, (NO_DOCUMENT, NOT_FOUND, STRUCTURE, CONFLICT, STRUCTURE, TOO_FAR)))
    whole = joined.withColumn("rank", rank).groupBy("document_id", "step").agg(
        F.min("rank").alias("least"),
        ((F.count_distinct("page_id") > 1) | (F.max("position") - F.min("position") + 1 != F.count("*"))).alias("apart"),
    )
    least = F.when((F.col("least") <= 3) | ~F.col("apart"), F.col("least")).otherwise(4)
    checked = whole.select("document_id", "step", least.alias("rank"), F.get(names, least).alias("error"))
    edits = joined.where("version IS NOT NULL").select("document_id", "step", F.col("content_start").alias("start"), F.col("content_end").alias("end"), F.col("text").alias("expected"))
    unfit = misfits(edits, review.contents).select("document_id", "step", F.lit(6).alias("rank"), F.lit(MAPPING).alias("error"))
    outcomes = _first_errors(asked, checked.unionByName(unfit))

    good = joined.join(outcomes.where("error IS NULL").select("document_id"), "document_id", "left_semi")
    members = F.array_sort(F.collect_list(F.struct("reading_order", *[c for c in review.elements.columns if c not in ("document_id", "reading_order", "is_deleted")])))
    each = good.groupBy("document_id", "step").agg(members.alias("m"), F.collect_list("element_id").alias("asked_ids"))
    first = F.col("m")[0]
    texts = F.filter(F.transform("m", lambda e: e["text"]), lambda s: s != "")
    edge = lambda f, at: f(F.transform("m", at))
    left, top = edge(F.array_min, lambda e: e["x"]), edge(F.array_min, lambda e: e["y"])
    right, bottom = edge(F.array_max, lambda e: e["x"] + e["width"]), edge(F.array_max, lambda e: e["y"] + e["height"])
    last_id = review.elements.groupBy("document_id").agg(F.max("element_id").alias("last_id"))
    each = each.join(last_id, "document_id").withColumns(
        {
            "merged_id": F.col("last_id") + F.row_number().over(Window.partitionBy("document_id").orderBy("step")),
            "merged": F.array_join(texts, " " if join_with_space else "\n"),
            "origin": edge(F.array_min, lambda e: e["content_start"]),
            "until": edge(F.array_max, lambda e: e["content_end"]),
        }
    )
    each = each.join(review.contents.select("document_id", "content"), "document_id", "left")
    segment = F.substring(F.col("content"), F.col("origin").cast("int") + 1, (F.col("until") - F.col("origin")).cast("int"))
    saved = F.transform("m", lambda e: F.struct(*[e[c].alias(c) for c in ("element_id", *SAVED, "content_start", "content_end")]))
    snapshot = F.to_json(F.struct(F.lit("NEW_ELEMENT").alias("result_strategy"), F.col("asked_ids").alias("selected_ids"), segment.alias("segment"), F.col("origin"), saved.alias("elements")))
    each = _kept(each.withColumn("snapshot_json", snapshot).drop("content"))

    at_first = each.select("document_id", first["element_id"].alias("element_id"), "merged", "merged_id", "step")
    replacements = good.select(*KEY).join(at_first.select(*KEY, "merged"), KEY, "left").select(*KEY, F.coalesce("merged", F.lit("")).alias("replacement"))
    elements, contents = _put(review, replacements)
    gone = F.col("gone").isNotNull()
    columns = elements.columns
    tombs = {"is_deleted": F.col("is_deleted") | gone, "is_in_content": F.col("is_in_content") & ~gone, "version": F.col("version") + gone.cast("int")}
    ranges = elements.select(*KEY, "content_start", "content_end").join(at_first, KEY).select("document_id", "step", "content_start", "content_end")
    new = each.join(ranges, ["document_id", "step"]).select(
        "document_id",
        F.col("merged_id").alias("element_id"),
        *[first[c].alias(c) for c in ("page_id", "reading_order", "element_type", "is_paragraph_start")],
        F.col("merged").alias("text"), left.alias("x"), top.alias("y"), (right - left).alias("width"), (bottom - top).alias("height"),
        F.array_min(F.array_compact(F.transform("m", lambda e: e["confidence"]))).alias("confidence"),
        F.lit("USER").alias("source"), F.lit(CORRECTED).alias("element_type_source"), F.lit(1).alias("version"), F.lit(False).alias("is_deleted"), F.lit(False).alias("is_excluded"), F.lit(True).alias("is_in_content"),
        "content_start", "content_end",
    )
    elements = _kept(elements.join(good.select(*KEY, F.lit(True).alias("gone")), KEY, "left").withColumns(tombs).select(*columns).unionByName(new.select(*columns)))
    changed = (F.col("merged") != first["text"]) | F.exists(F.slice("m", 2, F.greatest(F.size("m") - 1, F.lit(1))), lambda e: e["text"] != "")
    after = _counted(review, elements, contents, each.select("document_id", F.lit(1).alias("requests"), changed.cast("int").alias("bumps")))
    operations = each.select(
        F.col("merged_id").alias("operation_id"), "document_id", F.col("merged_id").alias("survivor_id"), F.lit(1).alias("merged_version"), "snapshot_json", F.lit(False).alias("undone"), F.lit(user_id).alias("created_by")
    )
    made = good.select(*KEY, F.lit(user_id).alias("changed_by"), F.col("text").alias("before_text"), F.lit("").alias("after_text"), F.col("version").alias("from_version"), (F.col("version") + 1).alias("to_version"))
    details = F.to_json(F.struct(F.col("merged_id").alias("result_id"), F.col("asked_ids").alias("source_ids"), F.size("m").alias("source_count")))
    events = each.select("document_id", first["page_id"].alias("page_id"), F.lit("MERGE").alias("event_type"), details.alias("details_json"), F.lit(user_id).alias("created_by"))
    return replace(after, operations=review.operations.unionByName(operations), revisions=review.revisions.unionByName(made), events=review.events.unionByName(events)), outcomes


def undo_merges(review: Review, chosen: DataFrame, user_id: int) -> tuple[Review, DataFrame, DataFrame]:
    """The review with the chosen operations (document_id, operation_id) undone; errors by document; the restored elements.

    An operation that is undone, or whose new element is gone or has changed since, or whose members aren't
    tombstones any more, can't be undone. Members get back what the operation kept, their ranges are laid out from
    where the new element stands now, and operations that made a restored element follow its version.
    """
    found = chosen.select("document_id", "operation_id").join(review.operations, ["document_id", "operation_id"], "left")
    found = found.withColumn("s", F.from_json("snapshot_json", SNAPSHOT))
    survivors = review.elements.select("document_id", F.col("element_id").alias("survivor_id"), "version", "is_deleted", "is_in_content", "page_id", "content_start", "content_end", F.col("text").alias("now"))
    found = _kept(found.join(survivors, ["document_id", "survivor_id"], "left"))
    stale = F.col("snapshot_json").isNull() | F.col("undone") | F.col("version").isNull() | F.col("is_deleted") | (F.col("version") != F.col("merged_version"))
    members = found.select("document_id", "operation_id", "survivor_id", F.explode("s.elements").alias("e"), F.col("s.origin").alias("origin"))
    members = members.select("document_id", "operation_id", "survivor_id", "origin", F.col("e.element_id").alias("element_id"), "e")
    alive = members.join(review.elements.select(*KEY, F.col("is_deleted").alias("tomb")), KEY, "left").where("tomb IS NULL OR NOT tomb")
    error = lambda df, rank, name: df.select("document_id", F.lit(0).alias("step"), F.lit(rank).alias("rank"), F.lit(name).alias("error"))
    expected = F.when(F.col("is_in_content"), F.col("now")).otherwise("")
    spliceable = found.where(F.col("s.origin").isNotNull())
    edits = spliceable.select("document_id", F.lit(0).alias("step"), F.col("content_start").alias("start"), F.col("content_end").alias("end"), expected.alias("expected"))
    errors = error(found.where(F.coalesce(stale, F.lit(True))), 1, NO_UNDO).unionByName(error(alive, 1, NO_UNDO)).unionByName(error(misfits(edits, review.contents), 2, MAPPING))
    outcomes = _first_errors(chosen, errors)

    fine = outcomes.where("error IS NULL").select("document_id")
    good, back = found.join(fine, "document_id", "left_semi"), members.join(fine, "document_id", "left_semi")
    replacements = good.where(F.col("s.origin").isNotNull()).select("document_id", F.col("survivor_id").alias("element_id"), F.col("s.segment").alias("replacement"))
    elements, contents = _put(review, replacements)
    columns = elements.columns
    starts = elements.select("document_id", F.col("element_id").alias("survivor_id"), F.col("content_start").alias("now_start"))
    back = back.join(starts, ["document_id", "survivor_id"])
    laid = lambda c: F.when(F.col("e")[c].isNotNull() & F.col("origin").isNotNull() & F.col("now_start").isNotNull(), F.col("now_start") + F.col("e")[c] - F.col("origin")).otherwise(F.col("e")[c])
    old = back.select(*KEY, *[F.col("e")[c].alias(f"old_{c}") for c in SAVED], laid("content_start").alias("old_content_start"), laid("content_end").alias("old_content_end"), F.lit(True).alias("restored"))
    gone = good.select("document_id", F.col("survivor_id").alias("element_id"), F.lit(True).alias("gone"))
    joined = elements.join(old, KEY, "left").join(gone, KEY, "left")
    restored, is_gone = F.col("restored").isNotNull(), F.col("gone").isNotNull()
    new = {c: F.when(restored, F.col(f"old_{c}")).otherwise(F.col(c)) for c in (*SAVED, "content_start", "content_end")}
    new["is_in_content"] = new["is_in_content"] & ~is_gone
    new |= {"is_deleted": F.col("is_deleted") & ~restored | is_gone, "version": F.col("version") + (restored | is_gone).cast("int")}
    elements = _kept(joined.select(*[new.get(c, F.col(c)).alias(c) for c in columns]))
    changed = F.col("s.origin").isNotNull() & (F.col("s.segment") != expected)
    after = _counted(review, elements, contents, good.select("document_id", F.lit(1).alias("requests"), changed.cast("int").alias("bumps")))

    now = elements.join(old.select(*KEY), KEY, "left_semi").select(*KEY, "version")
    follow = now.select("document_id", F.col("element_id").alias("survivor_id"), F.col("version").alias("follows"))
    done = good.select("document_id", "operation_id", F.lit(True).alias("done"))
    operations = review.operations.join(done, ["document_id", "operation_id"], "left").join(follow, ["document_id", "survivor_id"], "left")
    version = F.when(~F.col("undone") & F.col("follows").isNotNull(), F.col("follows")).otherwise(F.col("merged_version")).cast("int")
    operations = operations.withColumns({"merged_version": version, "undone": F.col("undone") | F.col("done").isNotNull()}).select(*review.operations.columns)
    details = F.to_json(F.struct(F.col("survivor_id").alias("result_id"), F.col("s.selected_ids").alias("restored_ids"), F.size("s.elements").alias("restored_count")))
    events = good.select("document_id", "page_id", F.lit("UNMERGE").alias("event_type"), details.alias("details_json"), F.lit(user_id).alias("created_by"))
    return replace(after, operations=operations, events=review.events.unionByName(events)), outcomes, now


def undo_to_originals(review: Review, chosen: DataFrame, user_id: int) -> tuple[Review, DataFrame]:
    """As ``undo_merges``, and so on with merges whose new element is restored by that, level by level, until none is.

    If any of a document's merges can't be undone, the document stays as it was. Each level is written out; there
    are as many as merges of merges.
    """
    now, pending, failed = review, _kept(chosen.select("document_id", "operation_id")), None
    while True:
        now, outcomes, restored = undo_merges(now, pending, user_id)
        outcomes = outcomes.where("error IS NOT NULL")
        failed = outcomes if failed is None else failed.unionByName(outcomes)
        now = now.settled()
        made = now.operations.where("NOT undone").select("operation_id", "document_id", F.col("survivor_id").alias("element_id"), F.col("merged_version").alias("version"))
        newest = made.join(restored, [*KEY, "version"]).groupBy(*KEY).agg(F.max("operation_id").alias("operation_id"))
        pending = _kept(newest.join(failed, "document_id", "left_anti").select("document_id", "operation_id"))
        if pending.isEmpty():
            break
    errors = failed.groupBy("document_id").agg(F.min("error").alias("error"))
    asked = chosen.select("document_id").distinct().join(errors, "document_id", "left")
    if failed.isEmpty():
        return now, asked
    stays = errors.select("document_id")
    pick = lambda old, new: new.join(stays, "document_id", "left_anti").unionByName(old.join(stays, "document_id", "left_semi"))
    names = ("elements", "contents", "documents", "operations", "revisions", "events")
    return Review(*(pick(getattr(review, n), getattr(now, n)) for n in names)), asked


def split_elements(review: Review, requests: DataFrame, user_id: int) -> tuple[Review, DataFrame]:
    """The review with elements cut in two, and document_id, error of each document.

    ``requests`` has document_id, element_id, the version seen, orientation (VERTICAL cuts the width, HORIZONTAL the
    height), ratio, first_text, second_text. The element stays as a tombstone, the two parts stand in its place by a
    newline between them, and later elements of the page move up by one.
    """
    asked = requests.select(*KEY, F.col("version").alias("seen"), "orientation", "ratio", "first_text", "second_text").withColumn("turn", F.row_number().over(Window.partitionBy(*KEY).orderBy("first_text")))
    joined = asked.join(review.elements, KEY, "left")
    bad = F.col("is_excluded") | ~F.col("is_in_content") | ~F.col("orientation").isin("VERTICAL", "HORIZONTAL") | ~F.col("ratio").between(LEAST_RATIO, MOST_RATIO)
    outside = (F.col("width") <= 0) | (F.col("height") <= 0) | (F.col("x") + F.col("width") > 1.000001) | (F.col("y") + F.col("height") > 1.000001)
    rank = F.when(F.col("version").isNull() | F.col("is_deleted") | (F.col("turn") > 1), 1).when(F.col("seen") != F.col("version"), 2).when(bad, 3).when(outside, 5)
    names = F.array(*map(F.lit, (NO_DOCUMENT, NOT_FOUND, CONFLICT, STRUCTURE, MAPPING, STRUCTURE)))
    checked = joined.select("document_id", F.lit(0).alias("step"), rank.alias("rank"), F.get(names, rank).alias("error"))
    edits = joined.where("version IS NOT NULL").select("document_id", F.lit(0).alias("step"), F.col("content_start").alias("start"), F.col("content_end").alias("end"), F.col("text").alias("expected"))
    unfit = misfits(edits, review.contents).select("document_id", "step", F.lit(4).alias("rank"), F.lit(MAPPING).alias("error"))
    outcomes = _first_errors(asked, checked.unionByName(unfit))

    good = _kept(joined.join(outcomes.where("error IS NULL").select("document_id"), "document_id", "left_semi"))
    both = F.concat("first_text", F.lit("\n"), "second_text")
    elements, contents = _put(review, good.select(*KEY, both.alias("replacement")))
    columns = elements.columns
    cut = good.select(*KEY, "orientation", "ratio", "first_text", "second_text")
    rows = elements.join(cut, KEY, "left").withColumn("is_cut", F.col("ratio").isNotNull())
    before = Window.partitionBy("document_id", "page_id").orderBy("reading_order").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("earlier", F.coalesce(F.sum(F.col("is_cut").cast("int")).over(before), F.lit(0)))
    last_id = elements.groupBy("document_id").agg(F.max("element_id").alias("last_id"))
    numbered = rows.where("is_cut").join(last_id, "document_id").withColumn("turn", F.row_number().over(Window.partitionBy("document_id").orderBy(*PLACE)))
    halves = numbered.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    second, vertical = F.col("half") == 1, F.col("orientation") == "VERTICAL"
    share = F.when(second, 1 - F.col("ratio")).otherwise(F.col("ratio"))
    text = F.when(second, F.col("second_text")).otherwise(F.col("first_text"))
    start = F.col("content_start") + F.when(second, F.length("first_text") + 1).otherwise(0)
    own = {
        "element_id": F.col("last_id") + 2 * F.col("turn") - 1 + F.col("half"),
        "reading_order": F.col("reading_order") + F.col("earlier") + F.col("half"),
        "text": text,
        "x": F.when(second & vertical, F.col("x") + F.col("width") * F.col("ratio")).otherwise(F.col("x")),
        "y": F.when(second & ~vertical, F.col("y") + F.col("height") * F.col("ratio")).otherwise(F.col("y")),
        "width": F.when(vertical, F.col("width") * share).otherwise(F.col("width")),
        "height": F.when(vertical, F.col("height")).otherwise(F.col("height") * share),
        "source": F.lit("USER"),
        "element_type_source": F.lit(CORRECTED),
        "is_paragraph_start": F.col("is_paragraph_start") & ~second,
        "version": F.lit(1),
        "content_start": start,
        "content_end": start + F.length(text),
    }
    types = {f.name: f.dataType for f in elements.schema}
    made = halves.select(*[own.get(c, F.col(c)).cast(types[c]).alias(c) for c in columns])
    tombs = {
        "reading_order": F.col("reading_order") + F.col("earlier"),
        "is_deleted": F.col("is_deleted") | F.col("is_cut"),
        "is_in_content": F.col("is_in_content") & ~F.col("is_cut"),
        "version": F.col("version") + F.col("is_cut").cast("int"),
    }
    elements = rows.select(*[tombs.get(c, F.col(c)).cast(types[c]).alias(c) for c in columns]).unionByName(made)
    changed = (both != F.col("text")).cast("int")
    after = _counted(review, elements, contents, good.select("document_id", F.lit(1).alias("requests"), changed.alias("bumps")))
    revisions = good.select(*KEY, F.lit(user_id).alias("changed_by"), F.col("text").alias("before_text"), both.alias("after_text"), F.col("version").alias("from_version"), (F.col("version") + 1).alias("to_version"))
    ids = F.array(F.col("last_id") + 2 * F.col("turn") - 1, F.col("last_id") + 2 * F.col("turn"))
    details = F.to_json(F.struct(F.col("element_id").alias("source_id"), ids.alias("created_ids"), "orientation", "ratio"))
    events = numbered.select("document_id", "page_id", F.lit("SPLIT").alias("event_type"), details.alias("details_json"), F.lit(user_id).alias("created_by"))
    return replace(after, revisions=review.revisions.unionByName(revisions), events=review.events.unionByName(events)), outcomes
