"""Text expressions: white space, headings, token estimates, snippets, money and quantities."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Characters per token, and what rounds a part of a token up.
CHARS_PER_TOKEN, ROUND_UP = 1.89, 0.999
#: Lengths of snippets.
SEMANTIC_SNIPPET, KEYWORD_SNIPPET, SNIPPET_KEEP = 220, 160, 0.7
HEADING_CHARS = 60

#: What (?U)\s matches; trimmed from the ends, as a pattern would look at each character of a long text.
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# Patterns of headings, and of what isn't one.
CLAUSE = r"^제\s*\d+\s*[조항목절장편]"
NUMBERED = r"^\d+(?:\.\d+)*\s*[.)]\s*\S"
HANGUL_ITEM = r"^[가-하]\s*[.)]\s*\S"
ROMAN = r"^(?:[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+|[IVX]{1,4})\s*[.)]\s*\S"
MARKDOWN = r"^#{1,6}\s+\S"
SENTENCE_END = r"[.。!?]$|(?:다|함|됨|음)$"
NUMERIC_ONLY = r"^[\d.,%()\-~\s]+$"
TRAILING_PARENTHESIS = r"\s*[(（][^)）]*[)）]\s*$"
# Marks of an empty amount, and what is written around one.
EMPTY_MARKS = ("", "-", "—", "–", "n/a", "na", "없음", "미정", "해당없음", "null", "none")
EMPTY = r"(?iU)\A\s*+(?:" + "|".join(EMPTY_MARKS) + r")\s*+\z"
CURRENCY = r"(?iU)[,\s원₩$¥€]|KRW|USD|JPY|EUR"


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def collapsed(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def like_pattern(term: str) -> str:
    """A pattern for LIKE that finds the term itself anywhere."""
    return "%" + term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def contains_ignoring_case(text: Column, term: str) -> Column:
    return F.ilike(text, F.lit(like_pattern(term)), F.lit("\\"))


def token_estimate(text: Column) -> Column:
    n = F.length(text)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / F.lit(CHARS_PER_TOKEN) + F.lit(ROUND_UP)))).cast("int")


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences, letter case aside."""
    lower = F.lower(text)
    return ((F.length(lower) - F.length(F.replace(lower, F.lit(term.lower()), F.lit("")))) / F.lit(len(term))).cast("int")


def running_offset(partition: str, order: str, text: str, separator: int = 1) -> Column:
    """Where a part starts if all parts are joined in order by a separator."""
    before = Window.partitionBy(partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(F.length(text) + separator).over(before), F.lit(0)).cast("long")


def semantic_snippet(text: Column) -> Column:
    flat = collapsed(text)
    head = F.substring(flat, 1, SEMANTIC_SNIPPET)
    blank = F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1
    cut = F.when(blank > int(SEMANTIC_SNIPPET * SNIPPET_KEEP), F.substring(head, F.lit(1), blank)).otherwise(head)
    return F.when(F.length(flat) <= SEMANTIC_SNIPPET, flat).otherwise(F.concat(cut, F.lit("…")))


def keyword_snippet(text: Column, term: str) -> tuple[Column, Column]:
    """A snippet around the first hit, and where the term stands in it (null without a hit)."""
    flat, size = collapsed(text), KEYWORD_SNIPPET
    at = F.instr(F.lower(flat), term.lower()) - 1
    n = F.length(flat)
    start = F.greatest(at - F.lit((size - len(term)) // 2), F.lit(0))
    end = F.least(start + size, n)
    start = F.greatest(end - size, F.lit(0))
    body = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(flat, start + 1, end - start), F.when(end < n, "…").otherwise(""))
    head = F.when(n > size, F.concat(F.substring(flat, 1, size), F.lit("…"))).otherwise(flat)
    snippet = F.when(at < 0, head).when(n <= size, flat).otherwise(body)
    offset = F.when(at >= 0, F.when(n <= size, at).otherwise(at - start + F.when(start > 0, 1).otherwise(0)))
    return snippet, offset.cast("int")


def is_heading(text: Column) -> Column:
    """Numbered, clause, item or markdown headings of one short line that doesn't end as a sentence."""
    line = strip(text)
    bare = F.regexp_replace(line, TRAILING_PARENTHESIS, "")
    tested = F.when(bare == "", line).otherwise(bare)
    body = F.lit(False)
    for pattern in (NUMBERED, HANGUL_ITEM, ROMAN):
        matched = F.regexp_extract(line, f"({pattern})", 1)
        body |= (matched != "") & (F.length(line) - F.length(matched) + 1 >= 2)
    found = F.regexp_like(line, F.lit(CLAUSE)) | body
    plain = ~F.regexp_like(line, F.lit(NUMERIC_ONLY)) & ~F.regexp_like(tested, F.lit(SENTENCE_END)) & found
    return (line != "") & (F.length(line) <= HEADING_CHARS) & (F.regexp_like(line, F.lit(MARKDOWN)) | plain)


def repeat_key(text: Column) -> Column:
    """A line with each white space one blank and each digit run one mark."""
    return F.regexp_replace(collapsed(text), r"\d+", "#")


def is_empty_mark(raw: Column) -> Column:
    return raw.isNull() | F.regexp_like(raw, F.lit(EMPTY))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once; in a lambda Spark would compute it wherever it is named."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def parse_money(raw: Column) -> Column:
    """Whole non-negative amounts; anything that isn't plainly one is null, marks of emptiness too, as they hold no digit."""
    numeric = lambda bare: F.when(F.regexp_like(bare, F.lit(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")), bare).try_cast("decimal(38,10)")
    whole = lambda x: F.when((x >= 0) & (x % 1 == 0), x.cast("decimal(38,0)"))
    plain = lambda bare: F.regexp_like(bare, F.lit(r"^\d{1,18}$"))  # noqa: E731  most are, and decimals of 38 digits are slow
    return _once(F.regexp_replace(raw, CURRENCY, ""), lambda bare: F.when(plain(bare), bare.cast("long").cast("decimal(38,0)")).otherwise(_once(numeric(bare), whole)))


def parse_quantity(raw: Column) -> Column:
    """The first number of a string; negative ones are null."""
    found = _once(F.regexp_extract(F.replace(raw, F.lit(","), F.lit("")), r"(-?\d+(?:\.\d+)?)", 1), lambda number: F.when(number != "", number).try_cast("decimal(18,4)"))
    return _once(found, lambda x: F.when(x >= 0, x))


# Fixed value: a list item begins with a Hangul syllable and a dot or a bracket.
LIST_ITEM = r"^[가-하]\s*[.)]\s*\S"


def is_list_item(text: Column) -> Column:
    return F.regexp_like(strip(text), F.lit(LIST_ITEM))


def is_strong_heading(text: Column) -> Column:
    """A heading that isn't a list item, so that items don't take the place of the heading above them."""
    return is_heading(text) & ~is_list_item(text)


def _normalized(form: str, text: Column) -> Column:
    @F.pandas_udf("string")
    def normalize(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize(form, x))

    return normalize(text)


def nfc(text: Column) -> Column:
    """Composed characters (Unicode NFC); most texts are so already."""
    return _normalized("NFC", text)


def plain_letters(text: Column) -> Column:
    """Letters without their accents."""
    return F.regexp_replace(_normalized("NFD", text), r"\p{Mn}+", "")
