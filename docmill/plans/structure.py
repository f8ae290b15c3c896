"""Queries of batch edits, merges, their undoing and splits over all documents, with the SQL that gives the same rows.

Every turn of a conversation is an element, four to a page. Documents are of six kinds, by the rest of their id,
some of which ask for what isn't allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.operators import lifecycle, structure
from docmill.operators.storage import checkpointed
from docmill.plans.registry import USER, query
from docmill.plans.views import Views


def _i() -> Column:
    return F.col("element_id")


def _kind() -> Column:
    return F.col("document_id") % 6


def _opened(v: Views) -> structure.Review:
    rows = v.elements.select("document_id", F.col("reading_order").cast("long").alias("reading_order"), "text", "version", "confidence")
    rows = rows.withColumns({"is_deleted": F.lit(False), "is_excluded": F.lit(False)})
    placed, contents = lifecycle.start_review(rows)
    height = F.when(_kind() == 4, 0.02).otherwise(0.1)
    elements = placed.withColumn("element_id", F.col("reading_order")).select(
        "document_id", "element_id", F.floor(_i() / 4).alias("page_id"), "reading_order", "text", F.lit(0.1).alias("x"), ((_i() % 4) * F.lit(0.2)).alias("y"), F.lit(0.8).alias("width"),
        height.alias("height"), "confidence", F.lit("OCR").alias("source"), F.lit("PARAGRAPH").alias("element_type"), F.lit("DETECTED").alias("element_type_source"),
        (_i() % 4 == 0).alias("is_paragraph_start"), "version", "is_deleted", "is_excluded", "is_in_content", "content_start", "content_end",
    )
    chars = rows.groupBy("document_id").agg(F.sum(F.length("text")).alias("ocr_char_count"))
    elements, contents = (checkpointed(x, "document_id") for x in (elements, contents.join(chars, "document_id").withColumn("is_confirmed", F.lit(True))))
    status = F.element_at(F.array(*map(F.lit, ("PENDING", "IN_PROGRESS", "COMPLETED"))), (F.col("document_id") % 3 + 1).cast("int"))
    documents = contents.select("document_id", status.alias("review_status"), F.lit(0).alias("ocr_revision"))
    return structure.opened(elements, contents, documents)


def _by_document(review: structure.Review, outcomes: DataFrame) -> DataFrame:
    joined = review.contents.join(review.documents, "document_id").join(outcomes, "document_id", "left")
    return joined.select("document_id", "error", "content", "char_count", "ocr_char_count", "text_version", "is_confirmed", "review_status", "ocr_revision")


_E = """e AS (
  SELECT document_id, reading_order AS i, text, version, confidence, length(text) AS n, document_id % 6 AS kind, max(reading_order) OVER d AS last_i,
    ['PENDING','IN_PROGRESS','COMPLETED'][document_id % 3 + 1] AS status FROM v_elements WINDOW d AS (PARTITION BY document_id)
)"""
_DOCUMENT = """document_id, {error} AS error, {content} AS content, length({content})::INT AS char_count, ({chars})::BIGINT AS ocr_char_count, (1 + {bumps})::INT AS text_version,
  NOT ({requests} > 0 AND any_value(status) <> 'IN_PROGRESS') AS is_confirmed, CASE WHEN {requests} > 0 THEN 'IN_PROGRESS' ELSE any_value(status) END AS review_status,
  ({requests})::INT AS ocr_revision"""


# Batch edits: texts and an exclusion; a stale version; a row of a table that would begin a paragraph; boxes; a heading; an unknown element


def _batch(v: Views) -> tuple[structure.Review, DataFrame]:
    review = _opened(v)
    text = F.when((_kind() < 2) & (_i() % 2 == 0), F.concat(F.lit("new "), F.col("document_id").cast("string")))
    first = _i() == 0
    changes = review.elements.select(
        "document_id",
        F.when((_kind() == 5) & first, _i() + 1000).otherwise(_i()).alias("element_id"),
        (F.col("version") + (_kind().isin(1, 5) & first).cast("int")).alias("version"),
        text.alias("text"),
        F.when((_kind() == 0) & (_i() % 4 == 3), True).alias("is_excluded"),
        F.when((_kind() == 2) & first, "TABLE_ROW").when((_kind() == 4) & first, "HEADING").alias("element_type"),
        F.when((_kind() == 2) & first, True).alias("is_paragraph_start"),
        F.when(_kind() == 3, 0.15).alias("x"),
    )
    return structure.edit_batch(review, changes, USER)


_NEW = "CASE WHEN kind = 0 AND i % 2 = 0 THEN 'new ' || document_id ELSE text END"
_BATCH_ERROR = "CASE any_value(kind) WHEN 1 THEN 'OCR_EDIT_CONFLICT' WHEN 2 THEN 'OCR_INVALID_STRUCTURE' WHEN 5 THEN 'OCR_ELEMENT_NOT_FOUND' END"


@query(f"""WITH {_E} SELECT {_DOCUMENT.format(error=_BATCH_ERROR, content=f"string_agg({_NEW}, chr(10) ORDER BY i)", chars=f"sum(CASE WHEN kind = 0 AND i % 4 = 3 THEN 0 ELSE length({_NEW}) END)",
    bumps="any_value(kind IN (0, 4))::INT", requests="any_value(kind IN (0, 3, 4))::INT")} FROM e GROUP BY document_id""")
def review_batch_atomic(v: Views) -> DataFrame:
    return _by_document(*_batch(v))


@query(f"""WITH {_E}, f AS (SELECT *, {_NEW} AS now FROM e)
    SELECT document_id, i AS element_id, now AS text, kind = 0 AND i % 4 = 3 AS is_excluded, CASE WHEN kind = 4 AND i = 0 THEN 'HEADING' ELSE 'PARAGRAPH' END AS element_type,
      CASE WHEN kind = 4 AND i = 0 THEN 'USER_CORRECTED' ELSE 'DETECTED' END AS element_type_source, CASE WHEN kind = 3 THEN 0.15 ELSE 0.1 END::DOUBLE AS x,
      (version + (kind = 0 AND (i % 2 = 0 OR i % 4 = 3) OR kind = 3 OR kind = 4 AND i = 0)::INT)::INT AS version,
      coalesce(sum(length(now) + 1) OVER w, 0)::BIGINT AS content_start, (coalesce(sum(length(now) + 1) OVER w, 0) + length(now))::BIGINT AS content_end
    FROM f WINDOW w AS (PARTITION BY document_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def review_batch_elements(v: Views) -> DataFrame:
    return _batch(v)[0].elements.select("document_id", "element_id", "text", "is_excluded", "element_type", "element_type_source", "x", "version", "content_start", "content_end")


@query(f"""WITH {_E} SELECT document_id, i AS element_id, {USER}::INT AS changed_by, text AS before_text, {_NEW} AS after_text, version::INT AS from_version, (version + 1)::INT AS to_version
    FROM e WHERE kind = 0 AND i % 2 = 0""")
def review_batch_revisions(v: Views) -> DataFrame:
    return _batch(v)[0].revisions


# Merges: the first two elements of each page; a stale version; an element between; an unknown element; boxes that lie apart


def _merged(v: Views) -> tuple[structure.Review, DataFrame]:
    review = _opened(v)
    second = F.when(_kind() == 2, 2).otherwise(1)
    pages = Window.partitionBy("document_id", "page_id")
    rows = review.elements.where((_i() % 4 == 0) | (_i() % 4 == second)).withColumn("n", F.count("*").over(pages)).where("n = 2")
    groups = rows.select(
        "document_id",
        F.col("page_id").alias("step"),
        (_i() + F.when(_kind() == 3, 1000).otherwise(0)).alias("element_id"),
        (F.col("version") + ((_kind() == 1) & (_i() % 4 == 0)).cast("int")).alias("version"),
    )
    return structure.merge_groups(review, groups, USER)


_M = f"""{_E}, m AS (
  SELECT *, kind IN (0, 5) AND i - i % 4 + 1 <= last_i AS paired, kind IN (0, 5) AND i - i % 4 + 2 <= last_i AS tripled, lead(text) OVER w AS following, lead(confidence) OVER w AS confidence2
  FROM e WINDOW w AS (PARTITION BY document_id ORDER BY i)
), t AS (SELECT *, CASE WHEN paired AND i % 4 = 0 THEN text || ' ' || following WHEN paired AND i % 4 = 1 THEN '' ELSE text END AS now FROM m)"""
_MERGE_ERROR = """CASE WHEN any_value(kind) IN (0, 5) OR max(i) < any_value(CASE WHEN kind = 2 THEN 2 ELSE 1 END) THEN NULL
  ELSE ['OCR_EDIT_CONFLICT', 'OCR_INVALID_STRUCTURE', 'OCR_ELEMENT_NOT_FOUND', 'OCR_MERGE_TOO_FAR'][any_value(kind)] END"""
_PAIRS = "count(*) FILTER (paired AND i % 4 = 1)"


@query(f"""WITH {_M} SELECT {_DOCUMENT.format(error=_MERGE_ERROR, content="string_agg(now, chr(10) ORDER BY i)", chars="sum(length(now))", bumps=_PAIRS, requests=_PAIRS)} FROM t GROUP BY document_id""")
def review_merge(v: Views) -> DataFrame:
    return _by_document(*_merged(v))


@query(f"""WITH {_M}, p AS (
      SELECT *, coalesce(sum(length(now) + 1) OVER w, 0)::BIGINT AS a, last_i + sum((paired AND i % 4 = 0)::INT) OVER (PARTITION BY document_id ORDER BY i) AS new_id FROM t
      WINDOW w AS (PARTITION BY document_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT document_id, i::BIGINT AS element_id, i::BIGINT AS reading_order, CASE WHEN paired AND i % 4 < 2 THEN text ELSE now END AS text, paired AND i % 4 < 2 AS is_deleted, NOT (paired AND i % 4 < 2) AS is_in_content,
      (version + (paired AND i % 4 < 2)::INT)::INT AS version, (CASE WHEN kind = 4 THEN 0.02 ELSE 0.1 END)::DOUBLE AS height, confidence, a AS content_start, (a + length(now))::BIGINT AS content_end FROM p
    UNION ALL
    SELECT document_id, new_id::BIGINT, i::BIGINT, now, false, true, 1, 0.2::DOUBLE + 0.1, CASE WHEN confidence IS NULL OR confidence2 < confidence THEN coalesce(confidence2, confidence) ELSE confidence END, a, (a + length(now))::BIGINT
    FROM p WHERE paired AND i % 4 = 0""")
def review_merge_elements(v: Views) -> DataFrame:
    return _merged(v)[0].elements.select(
        "document_id", "element_id", "reading_order", "text", "is_deleted", "is_in_content", "version", F.round("height", 9).alias("height"), "confidence", "content_start", "content_end"
    )


@query(f"""WITH {_M} SELECT document_id, (i // 4)::BIGINT AS page_id, 'MERGE' AS event_type, {USER}::INT AS created_by,
      '{{"result_id":' || (last_i + row_number() OVER (PARTITION BY document_id ORDER BY i)) || ',"source_ids":[' || i || ',' || (i + 1) || '],"source_count":2}}' AS details_json
    FROM t WHERE paired AND i % 4 = 0""")
def review_merge_events(v: Views) -> DataFrame:
    events = _merged(v)[0].events
    ids = F.regexp_extract("details_json", r"\[(\d+),(\d+)\]", 1).cast("int"), F.regexp_extract("details_json", r"\[(\d+),(\d+)\]", 2).cast("int")
    listed = F.concat(F.lit("["), F.least(*ids).cast("string"), F.lit(","), F.greatest(*ids).cast("string"), F.lit("]"))
    return events.withColumn("details_json", F.regexp_replace("details_json", F.lit(r"\[\d+,\d+\]"), listed))


# Undone: each merged element is merged with the one behind it, and all merges are taken back to the originals


def _undone(v: Views) -> tuple[structure.Review, DataFrame]:
    review = _merged(v)[0].settled()
    live = review.elements.where("NOT is_deleted")
    made = review.operations.select("document_id", F.col("survivor_id").alias("element_id"))
    heads = live.join(made, ["document_id", "element_id"], "left_semi")
    behind = live.where(F.col("reading_order") % 4 == 2).join(heads.select("document_id", "page_id"), ["document_id", "page_id"], "left_semi")
    pages = behind.select("document_id", "page_id")
    groups = heads.join(pages, ["document_id", "page_id"], "left_semi").unionByName(behind).select("document_id", F.col("page_id").alias("step"), "element_id", "version")
    review = structure.merge_groups(review, groups, USER)[0].settled()
    last = review.operations.join(review.elements.where("NOT is_deleted").select("document_id", F.col("element_id").alias("survivor_id")), ["document_id", "survivor_id"])
    return structure.undo_to_originals(review, last.select("document_id", "operation_id"), USER)


_AGAIN = "text || CASE WHEN paired AND i % 4 = 1 THEN chr(10) WHEN tripled AND i % 4 = 2 THEN chr(10) || chr(10) ELSE '' END"
_UNDONE = "2 * (count(*) FILTER (paired AND i % 4 = 1) + count(*) FILTER (tripled AND i % 4 = 2))"


@query(f"""WITH {_M} SELECT {_DOCUMENT.format(error="NULL::VARCHAR", content=f"string_agg({_AGAIN}, chr(10) ORDER BY i)", chars="sum(n)", bumps=_UNDONE, requests=_UNDONE)} FROM t GROUP BY document_id""")
def review_merge_undo(v: Views) -> DataFrame:
    return _by_document(*_undone(v))


@query(f"""WITH {_M} SELECT document_id, i::BIGINT AS element_id, i::BIGINT AS reading_order, text, (version + 2 * (paired AND i % 4 < 2 OR tripled AND i % 4 = 2)::INT)::INT AS version, confidence,
      coalesce(sum(length({_AGAIN}) + 1) OVER w, 0)::BIGINT AS content_start, (coalesce(sum(length({_AGAIN}) + 1) OVER w, 0) + n)::BIGINT AS content_end
    FROM t WINDOW w AS (PARTITION BY document_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def review_merge_undo_elements(v: Views) -> DataFrame:
    live = _undone(v)[0].elements.where("NOT is_deleted")
    return live.select("document_id", "element_id", "reading_order", "text", "version", "confidence", "content_start", "content_end")


# Splits: the third element of each page, across or down; a stale version, a share that is too small


def _split(v: Views) -> tuple[structure.Review, DataFrame]:
    review = _opened(v)
    requests = review.elements.where(_i() % 4 == 2).select(
        "document_id",
        "element_id",
        (F.col("version") + (_kind() == 1).cast("int")).alias("version"),
        F.when(_kind() == 0, "VERTICAL").otherwise("HORIZONTAL").alias("orientation"),
        F.when(_kind() == 2, 0.05).otherwise(0.25).alias("ratio"),
        F.substring("text", 1, 5).alias("first_text"),
        F.expr("substring(text, 6)").alias("second_text"),
    )
    return structure.split_elements(review, requests, USER)


_S = f"{_E}, s AS (SELECT *, i % 4 = 2 AND kind NOT IN (1, 2) AS cut FROM e)"
_CUTS = "count(*) FILTER (cut)"
_SPLIT_ERROR = "CASE WHEN max(i) >= 2 THEN CASE any_value(kind) WHEN 1 THEN 'OCR_EDIT_CONFLICT' WHEN 2 THEN 'OCR_INVALID_STRUCTURE' END END"
_HALVED = "CASE WHEN cut THEN substr(text, 1, 5) || chr(10) || substr(text, 6) ELSE text END"


@query(f"""WITH {_S} SELECT {_DOCUMENT.format(error=_SPLIT_ERROR, content=f"string_agg({_HALVED}, chr(10) ORDER BY i)", chars="sum(n)", bumps=_CUTS, requests=_CUTS)} FROM s GROUP BY document_id""")
def review_split(v: Views) -> DataFrame:
    return _by_document(*_split(v))


@query(f"""WITH {_S}, p AS (SELECT *, coalesce(sum(length({_HALVED}) + 1) OVER w, 0)::BIGINT AS a, sum(cut::INT) OVER (PARTITION BY document_id ORDER BY i) AS nth,
        (CASE WHEN kind = 4 THEN 0.02 ELSE 0.1 END)::DOUBLE AS h, (i % 4) * 0.2::DOUBLE AS y FROM s WINDOW w AS (PARTITION BY document_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      q AS (SELECT *, unnest(CASE WHEN cut THEN [0, 1] ELSE [-1] END) AS half FROM p)
    SELECT document_id, (CASE WHEN half < 0 THEN i ELSE last_i + 2 * nth - 1 + half END)::BIGINT AS element_id, (i + (i % 4 = 3 AND kind NOT IN (1, 2) AND NOT cut)::INT + greatest(half, 0))::BIGINT AS reading_order,
      CASE half WHEN 0 THEN substr(text, 1, 5) WHEN 1 THEN substr(text, 6) ELSE text END AS text, (CASE WHEN half < 0 THEN version ELSE 1 END)::INT AS version,
      round(0.1::DOUBLE + CASE WHEN half = 1 AND kind = 0 THEN 0.2 ELSE 0 END, 9) AS x, round(y + CASE WHEN half = 1 AND kind <> 0 THEN h * 0.25 ELSE 0 END, 9) AS y,
      round(0.8::DOUBLE * CASE WHEN half >= 0 AND kind = 0 THEN CASE half WHEN 0 THEN 0.25 ELSE 0.75 END ELSE 1 END, 9) AS width,
      round(h * CASE WHEN half >= 0 AND kind <> 0 THEN CASE half WHEN 0 THEN 0.25 ELSE 0.75 END ELSE 1 END, 9) AS height,
      (a + CASE WHEN half = 1 THEN least(n, 5) + 1 ELSE 0 END)::BIGINT AS content_start,
      (a + CASE half WHEN 0 THEN least(n, 5) WHEN 1 THEN n + 1 ELSE n END)::BIGINT AS content_end FROM q""")
def element_split(v: Views) -> DataFrame:
    live = _split(v)[0].elements.where("NOT is_deleted")
    rounded = [F.round(c, 9).alias(c) for c in ("x", "y", "width", "height")]
    return live.select("document_id", "element_id", "reading_order", "text", "version", *rounded, "content_start", "content_end")
