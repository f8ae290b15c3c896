"""How values are shown: numbers, money, times, percentages, parts of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(value: Column) -> Column:
    """1,234, or a dash."""
    return F.coalesce(F.format_number(value.cast("decimal(38,0)"), 0), F.lit("-"))


def money(value: Column) -> Column:
    """A decimal with thousands parted; zeros at the end of the fraction go. No floats."""
    text = value.cast("string")
    whole = F.regexp_extract(text, r"^-?(\d+)", 1)
    parted = F.regexp_replace(whole, r"(?<=\d)(?=(?:\d{3})+$)", ",")
    rest = F.regexp_replace(F.regexp_extract(text, r"(\.\d+)$", 1), r"\.?0+$", "")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.when(F.startswith(text, F.lit("-")), "-").otherwise(""), parted, rest))


def latency(ms: Column) -> Column:
    """800ms, 1.2초, or a dash."""
    seconds = F.concat(F.format_string("%.1f", ms / F.lit(1000.0)), F.lit("초"))
    return F.when(ms.isNull(), "-").when(ms < 1000, F.concat(ms.cast("int").cast("string"), F.lit("ms"))).otherwise(seconds)


def minutes(value: Column) -> Column:
    return F.coalesce(F.date_format(value, "yyyy-MM-dd HH:mm"), F.lit("-"))


def minutes_short(value: Column) -> Column:
    return F.coalesce(F.date_format(value, "MM-dd HH:mm"), F.lit("-"))


def percent(part: Column, whole: Column) -> Column:
    """A share in whole percent, 0 of nothing."""
    return F.when(whole > 0, F.round(part / whole * 100)).otherwise(0).cast("int")


def truncated(text: Column, n: int) -> Column:
    """At most ``n`` characters, and a note that there was more."""
    return F.when((F.length(text) <= n) | F.lit(n <= 0), text).otherwise(F.concat(F.substring(text, 1, n), F.lit("\n...(이하 생략)")))


def name_key(value: Column) -> Column:
    """By what a login or an address is looked up."""
    return F.lower(F.trim(value))


def split_by(text: Column, term: str) -> Column:
    """Pieces of a text, struct(text, match): the term, whatever its case, and what lies between; no empty ones."""
    import re

    if not term.strip():
        return F.array(F.struct(text.alias("text"), F.lit(False).alias("match")))
    pattern = "(?i)" + re.escape(term)
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    piece = lambda t, match: F.struct(t.alias("text"), F.lit(match).alias("match"))
    # zipped, as a lambda would search the whole text again for each piece
    pairs = F.zip_with(between, found, lambda t, m: F.array(piece(t, False), piece(F.coalesce(m, F.lit("")), True)))
    return F.filter(F.flatten(pairs), lambda p: p["text"] != "")


def range_parts(text: Column, begin: Column, end: Column) -> Column:
    """What lies before, in and behind a range; null if the range isn't inside the text."""
    fits = (begin >= 0) & (end > begin) & (end <= F.length(text))
    cut = F.struct(
        F.substring(text, F.lit(1), begin.cast("int")).alias("before"),
        F.substring(text, begin.cast("int") + 1, (end - begin).cast("int")).alias("inside"),
        F.substring(text, end.cast("int") + 1, F.length(text)).alias("behind"),
    )
    return F.when(fits, cut)


def has_letters(text: Column, n: int = 2) -> Column:
    """Whether a text of an image holds ``n`` letters or digits at least."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")) >= n
