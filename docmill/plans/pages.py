"""Queries of page structure at ingest, with the SQL that gives the same rows. Pages are eight lines of a text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import text as t
from docmill.operators import amounts, geometry, pages
from docmill.plans.registry import query
from docmill.plans.views import Views


def heading_sql(line: str) -> str:
    """``functions.text.is_heading`` of a line without white space at its ends, in SQL."""
    parts = [f"(regexp_matches({line}, '{p}') AND length({line}) - length(regexp_extract({line}, '{p}')) + 1 >= 2)" for p in (t.NUMBERED, t.HANGUL_ITEM, t.ROMAN)]
    bare = f"regexp_replace({line}, '{t.TRAILING_PARENTHESIS}', '')"
    tested = f"CASE WHEN {bare} = '' THEN {line} ELSE {bare} END"
    plain = f"NOT regexp_matches({line}, '{t.NUMERIC_ONLY}') AND NOT regexp_matches({tested}, '{t.SENTENCE_END}') AND (regexp_matches({line}, '{t.CLAUSE}') OR {' OR '.join(parts)})"
    return f"({line} <> '' AND length({line}) <= {t.HEADING_CHARS} AND (regexp_matches({line}, '{t.MARKDOWN}') OR {plain}))"


def _lines(v: Views) -> DataFrame:
    """Lines by page; on even documents each page begins with its number, and every eleventh line can't be found."""
    units = v.units.withColumn("n", F.row_number().over(Window.partitionBy("document_id").orderBy("line_no")) - 1)
    page, place = F.floor(F.col("n") / 8).cast("int"), (F.col("n") % 8).cast("int")
    text = F.when((F.col("document_id") % 2 == 0) & (place == 0), F.concat(F.lit("Page "), page.cast("string"))).otherwise(t.strip(F.col("line")))
    lines = units.select("document_id", page.alias("page_number"), place.alias("reading_order"), text.alias("shown"))
    return lines.withColumn("text", F.when((F.col("page_number") * 8 + F.col("reading_order")) % 11 == 10, F.concat(F.lit("lost "), "shown")).otherwise(F.col("shown")))


_L = """l AS MATERIALIZED (
  SELECT document_id, page_number, place, shown, CASE WHEN n % 11 = 10 THEN 'lost ' || shown ELSE shown END AS text FROM (
    SELECT document_id, n, (n // 8)::INT AS page_number, (n % 8)::INT AS place, CASE WHEN document_id % 2 = 0 AND n % 8 = 0 THEN 'Page ' || (n // 8) ELSE regexp_replace(line, '^\\s+|\\s+$', '', 'g') END AS shown
    FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY line_no) - 1 AS n FROM v_units))
)"""


def _page_texts(lines: DataFrame) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "shown", "text"))), lambda p: p)
    return lines.groupBy("document_id", "page_number").agg(parts.alias("p")).select(
        "document_id", "page_number", F.array_join(F.transform("p", lambda x: x["shown"]), "\n").alias("shown"), F.transform("p", lambda x: F.struct(x["text"].alias("text"))).alias("elements")
    )


def _resolved(v: Views) -> tuple[DataFrame, DataFrame]:
    """Every third page has no marks, every fifth no end."""
    found = _page_texts(_lines(v))
    page = F.col("page_number")
    both, start = pages.marked(F.col("shown"), page), F.concat(pages.marked(F.lit(""), page).substr(F.lit(1), F.length(pages._mark(pages.PAGE_START, page))), F.col("shown"))
    text = F.when(page % 3 == 2, F.col("shown")).when(page % 5 == 4, start).otherwise(both)
    parts = F.array_sort(F.collect_list(F.struct("page_number", text.alias("text"))))
    contents = found.groupBy("document_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("content"))
    return pages.resolved_pages(contents, found.select("document_id", "page_number", "elements"))


_P = f"""{_L}, p AS MATERIALIZED (
  SELECT *, coalesce(sum(length(shown) + 1) OVER (PARTITION BY document_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin,
    page_number % 3 <> 2 AND page_number % 5 <> 4 AS marked FROM (SELECT document_id, page_number, string_agg(shown, chr(10) ORDER BY place) AS shown FROM l GROUP BY document_id, page_number)
)"""


@query(f"WITH {_P} SELECT document_id, string_agg(shown, chr(10) ORDER BY page_number) AS content FROM p GROUP BY document_id")
def page_marks_removed(v: Views) -> DataFrame:
    return _resolved(v)[0]


@query(f"""WITH RECURSIVE {_P}, f AS (
      SELECT document_id, page_number, -1 AS place, 0::BIGINT AS pos, NULL::BIGINT AS a, NULL::BIGINT AS b FROM p
      UNION ALL
      SELECT document_id, page_number, l.place, CASE WHEN k > 0 THEN f.pos + k - 1 + length(text) ELSE f.pos END, CASE WHEN k > 0 THEN f.pos + k - 1 END, CASE WHEN k > 0 THEN f.pos + k - 1 + length(text) END
      FROM f JOIN p USING (document_id, page_number) JOIN l ON l.document_id = f.document_id AND l.page_number = f.page_number AND l.place = f.place + 1, LATERAL (SELECT strpos(substr(p.shown, f.pos + 1), l.text) AS k)
    )
    SELECT document_id, page_number, f.place::INT AS reading_order, text, CASE WHEN marked THEN (begin + a)::BIGINT END AS content_start, CASE WHEN marked THEN (begin + b)::BIGINT END AS content_end
    FROM f JOIN p USING (document_id, page_number) JOIN l USING (document_id, page_number, place)""")
def page_element_ranges(v: Views) -> DataFrame:
    return _resolved(v)[1]


@query(f"""WITH RECURSIVE {_L}, c AS MATERIALIZED (SELECT document_id, string_agg(shown, chr(10) ORDER BY page_number, place) AS content FROM l GROUP BY document_id),
    g AS MATERIALIZED (SELECT *, page_number * 8 + place AS n, place % 7 = 6 AS listed, place / 8 AS y FROM l),
    f AS (
      SELECT document_id, -1 AS n, 0::BIGINT AS pos, NULL::BIGINT AS a, NULL::BIGINT AS b FROM c
      UNION ALL
      SELECT document_id, g.n, CASE WHEN k > 0 THEN f.pos + k - 1 + length(text) ELSE f.pos END, CASE WHEN k > 0 THEN f.pos + k - 1 END, CASE WHEN k > 0 THEN f.pos + k - 1 + length(text) END
      FROM f JOIN c USING (document_id) JOIN g ON g.document_id = f.document_id AND g.n = f.n + 1, LATERAL (SELECT strpos(substr(content, f.pos + 1), g.text) AS k)
    ),
    key AS (SELECT *, regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '\\d+', '#', 'g') AS key FROM g),
    often AS (SELECT document_id, key FROM key WHERE y <= 0.12 OR y >= 0.88 GROUP BY document_id, key, HAVING count(DISTINCT page_number) >=
      greatest(3, floor((SELECT max(page_number) + 1 FROM g x WHERE x.document_id = key.document_id) * 0.5 + 0.5))),
    typed AS (SELECT key.*, NOT listed AND (y <= 0.12 OR y >= 0.88) AND often.key IS NOT NULL AS band FROM key LEFT JOIN often ON often.document_id = key.document_id AND often.key = key.key)
    SELECT document_id, page_number, place AS reading_order, text, CASE WHEN listed THEN 'TABLE_ROW' WHEN band THEN 'HEADER_FOOTER' WHEN {heading_sql('text')} THEN 'HEADING' ELSE 'TEXT_LINE' END AS element_type,
      CASE WHEN listed THEN 'DETECTED' ELSE 'AUTO' END AS element_type_source, NOT listed AND NOT band AND {heading_sql('text')} AS is_paragraph_start, a AS content_start, b AS content_end
    FROM f JOIN typed USING (document_id, n)""")
def initial_elements(v: Views) -> DataFrame:
    lines = _lines(v)
    place, listed = F.col("reading_order"), F.col("reading_order") % 7 == 6
    parts = F.array_sort(F.collect_list(F.struct("page_number", "reading_order", "shown")))
    contents = lines.groupBy("document_id").agg(F.array_join(F.transform(parts, lambda p: p["shown"]), "\n").alias("content"))
    none = F.lit(None).cast("long")
    elements = lines.select(
        "document_id", "page_number", "reading_order", "text", (place / 8).alias("y"), F.when(listed, "TABLE_ROW").otherwise(pages.LINE).alias("element_type"),
        F.lit("DETECTED").alias("element_type_source"), F.lit(False).alias("is_paragraph_start"), none.alias("content_start"), none.alias("content_end"),
    )
    return pages.initial_elements(elements, contents).drop("y")


# Amount payloads and the plan of an image's preparation

_WORDS = "CASE WHEN i % 7 = 0 THEN '미정' WHEN i % 7 = 1 THEN ' N/A ' WHEN i % 7 = 2 THEN '' ELSE 'note ' || i END"


def _payloads(v: Views) -> DataFrame:
    """Orders as answers of a model: amounts with marks of currency, quantities with units, marks of emptiness."""
    i = F.col("l_linenumber") + F.col("l_orderkey")
    word = F.when(i % 7 == 0, "미정").when(i % 7 == 1, " N/A ").when(i % 7 == 2, "").otherwise(F.concat(F.lit("note "), i.cast("string")))
    amount = F.concat(F.format_number(F.floor("l_extendedprice").cast("long"), 0), F.when(i % 3 == 0, "원").otherwise(" KRW"))
    price = F.when(i % 4 == 0, "-").when(i % 4 == 1, F.concat(F.floor("l_extendedprice").cast("string"), F.lit(".5"))).otherwise(F.floor("l_extendedprice").cast("string"))
    item = F.struct(
        F.col("l_linenumber").alias("n"), F.concat(F.lit("item "), F.col("l_linenumber").cast("string")).alias("item_name"), amount.alias("amount"), price.alias("unit_price"),
        F.concat(F.floor("l_quantity").cast("string"), F.lit("인월")).alias("quantity"), *[word.alias(c) for c in amounts.OPTIONAL],
    )
    listed = v.table("lineitem").groupBy(F.col("l_orderkey").alias("document_id")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return listed.withColumn("stated_total", F.when(F.col("document_id") % 5 == 0, "없음").otherwise(F.concat(F.lit("₩ "), (F.col("document_id") * 1000).cast("string"))))


@query(f"""WITH l AS (SELECT l_orderkey AS document_id, l_linenumber AS n, l_linenumber + l_orderkey AS i, floor(l_extendedprice)::BIGINT AS a, floor(l_quantity)::BIGINT AS q FROM lineitem)
    SELECT document_id, CASE WHEN document_id % 5 <> 0 THEN (document_id * 1000)::DECIMAL(38,0) END AS stated_total, n, 'item ' || n AS item_name, a::DECIMAL(38,0) AS amount,
      CASE WHEN i % 4 > 1 THEN a::DECIMAL(38,0) END AS unit_price, q::DECIMAL(18,4) AS quantity, CASE WHEN i % 7 > 2 THEN {_WORDS} END AS unit, CASE WHEN i % 7 > 2 THEN {_WORDS} END AS notes FROM l""")
def amount_payloads(v: Views) -> DataFrame:
    numbered = _payloads(v).withColumn("n", F.col("items.n"))
    each = amounts.normalized_payloads(numbered).select("document_id", "stated_total", F.explode(F.arrays_zip("n", "items")).alias("x"))
    return each.select("document_id", "stated_total", "x.n", *[F.col(f"x.items.{c}").alias(c) for c in ("item_name", "amount", "unit_price", "quantity", "unit", "notes")])


@query("""WITH d AS (SELECT o_orderkey AS document_id, c_nationkey AS project_id FROM orders JOIN customer ON o_custkey = c_custkey),
    i AS (SELECT project_id, document_id, sum(CASE WHEN category IS DISTINCT FROM 'VAT' THEN amount END) AS a, sum(CASE WHEN category = 'VAT' THEN amount END) AS b FROM v_amount_items WHERE decision = 'APPROVED' GROUP BY ALL)
    SELECT project_id, count(*) AS documents, 'KRW' AS currency, coalesce(sum(a), 0)::DECIMAL(38,2) AS item_total, coalesce(sum(b), 0)::DECIMAL(38,2) AS vat_total FROM d LEFT JOIN i USING (project_id, document_id) GROUP BY project_id""")
def amount_rollup_with_empty(v: Views) -> DataFrame:
    documents = v.table("orders").join(v.table("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("document_id"), F.col("c_nationkey").alias("project_id"))
    return amounts.project_rollup(v.amount_items.where("decision = 'APPROVED'"), documents)


@query("""SELECT o_orderkey AS document_id, o_orderkey IN (SELECT document_id FROM v_amount_items WHERE decision = 'APPROVED') AS has_amounts FROM orders""")
def amount_presence(v: Views) -> DataFrame:
    return amounts.has_amounts(v.table("orders").select(F.col("o_orderkey").alias("document_id")), v.amount_items.where("decision = 'APPROVED'"))


_IMAGES = """SELECT p_partkey AS id, (p_size * 40)::INT AS width, CASE WHEN p_partkey % 5 <> 0 THEN (p_size % 30)::INT END AS text_height, (p_partkey % 10) / 200::DOUBLE AS color_ratio, p_partkey % 100 AS contrast,
    p_partkey % 17 AS noise_score, p_partkey % 31 AS illumination_score, p_partkey % 90 AS blur_score, (p_partkey % 25) / 100::DOUBLE AS perspective_score, p_partkey % 7 = 0 AS dark, p_partkey % 11 = 0 AS turned FROM part"""


@query(f"""WITH i AS ({_IMAGES}), t AS (SELECT *, color_ratio < 0.02 AS gray, CASE WHEN text_height IS NOT NULL THEN width < {geometry.NARROW} AND text_height < 18 ELSE width < 700 END AS up,
      color_ratio < 0.02 AND contrast < 55 AS poor FROM i),
    u AS (SELECT *, NOT dark AND gray AND contrast < 70 AS lift, gray AND noise_score > 10 AS noisy, coalesce(text_height IS NOT NULL AND blur_score < 45 AND noise_score < 6 AND NOT poor, false) AS sharp FROM t)
    SELECT id, concat_ws(',', CASE WHEN dark OR lift OR noisy OR poor OR sharp THEN 'to_grayscale' END, CASE WHEN up THEN 'upscale' END, CASE WHEN lift THEN 'adjust_contrast' END, CASE WHEN noisy THEN 'denoise' END,
        CASE WHEN dark THEN 'invert' END, CASE WHEN poor AND illumination_score < 18 THEN 'binarize' END, CASE WHEN poor AND illumination_score >= 18 THEN 'adaptive_binarize' END, CASE WHEN sharp THEN 'sharpen' END) AS steps,
      greatest(1, up::INT + dark::INT + lift::INT + noisy::INT + poor::INT + sharp::INT) AS reasons, turned AS use_doc_orientation_classify, perspective_score >= 0.12 AS use_doc_unwarping FROM u""")
def preprocess_plans(v: Views) -> DataFrame:
    k = F.col("p_partkey")
    images = v.table("part").select(
        k.alias("id"), (F.col("p_size") * 40).cast("int").alias("width"), F.when(k % 5 != 0, (F.col("p_size") % 30).cast("int")).alias("text_height"), ((k % 10) / 200).alias("color_ratio"), (k % 100).alias("contrast"),
        (k % 17).alias("noise_score"), (k % 31).alias("illumination_score"), (k % 90).alias("blur_score"), ((k % 25) / 100).alias("perspective_score"), (k % 7 == 0).alias("dark_background"), (k % 11 == 0).alias("rotation_suspected"),
    )
    found = geometry.preprocess_plans(images)
    return found.select("id", F.array_join("steps", ",").alias("steps"), F.size("reasons").alias("reasons"), "use_doc_orientation_classify", "use_doc_unwarping")
