"""Structure-aware chunks of a document's units, and the context of a query under a token budget.

Units are lines or recognised elements in order. Windows over a document find its groups, from each unit and the one before
it alone; groups are packed to the budget, short drafts merge, later chunks begin with the end of the one before.
All of it runs on the JVM after one shuffle by document; only a tokenizer as counter needs Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import text as t

# Limits in tokens, kinds of units, and where sentences end or white space stands.
MAX_TOKENS, MIN_TOKENS, OVERLAP_TOKENS = 480, 30, 48
LINE, HEADING, HEADER_FOOTER, TABLE_HEADER, TABLE_KINDS = "TEXT_LINE", "HEADING", "HEADER_FOOTER", "TABLE_HEADER", ("TABLE_ROW", "TABLE_HEADER")
SENTENCE_BREAK, SOFT_BREAK = r"(?U)(?<=[.。!?다함됨음])\s+", r"(?U)\s+"
NOISE_RATIO, NOISE_CHARS, NOISE_LEAST = 0.9, 80, 3
#: After a full stop or a Korean sentence ending, at white space.
SENTENCE = re.compile(r"(?<=[.。!?다함됨음])\s+")


def tokens(text: str) -> int:
    return max(1, int(len(text) / t.CHARS_PER_TOKEN + t.ROUND_UP)) if text else 0


@dataclass(frozen=True)
class Counter:
    """How tokens are counted.

    ``sizes`` measures the texts of an array; sizes of joined texts add up, with ``joint`` for what joins them; ``tokens``
    are the tokens of a size. A token surely holds ``least_chars`` characters. Where a budget is filled, each text counts
    by itself, and what joins two counts ``between``.
    """

    sizes: Callable[[Column], Column]
    tokens: Callable[[Column], Column]
    joint: int
    least_chars: float
    between: int = 0

    def size(self, text: Column) -> Column:
        return self.sizes(F.array(text))[0]


def by_characters() -> Counter:
    """Tokens estimated from characters."""

    def estimate(n: Column) -> Column:
        return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / F.lit(t.CHARS_PER_TOKEN) + F.lit(t.ROUND_UP)))).cast("int")

    return Counter(lambda texts: F.transform(texts, F.length), estimate, 1, t.CHARS_PER_TOKEN)


def by_tokenizer(path: str) -> Counter:
    """Tokens of a tokenizer's file, which all executors can read; a byte at least stands in each token."""

    @F.pandas_udf("array<int>")
    def sizes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for lists in batches:
            flat = [x for texts in lists if texts is not None for x in texts]
            counts = iter([len(e.ids) for e in tokenizer.encode_batch(flat, add_special_tokens=False)])
            yield pd.Series([None if texts is None else [next(counts) for _ in texts] for texts in lists])

    # marked so that Spark doesn't move the calls into folds, where Python can't run
    return Counter(sizes.asNondeterministic(), lambda n: n.cast("int"), 1, 0.25, 1)


UNIT = ["document_id", "n", "text", "page_number", "element_type", "is_paragraph_start", "table_id", "content_start", "content_end"]


def units_of_lines(lines: DataFrame) -> DataFrame:
    """Units of lines (document_id, line_no, line, content_start): headings found, text in NFC, ranges of the line as it was.

    List items aren't headings; blank lines go.
    """
    bare = t.strip(F.col("line"))
    lead = F.length("line") - F.length(F.ltrim(F.col("line"), F.lit(t.WHITE_SPACE)))
    start = F.col("content_start") + lead
    rows = lines.where(bare != "").select("document_id", F.col("line_no").alias("n"), t.nfc(bare).alias("text"), start.alias("content_start"), (start + F.length(bare)).alias("content_end"))
    rows, title = rows.withColumn("title", t.is_strong_heading(F.col("text"))), F.col("title")  # found once
    none = F.lit(None).cast("int")
    return rows.withColumns({"page_number": none, "table_id": none, "element_type": F.when(title, HEADING).otherwise(LINE), "is_paragraph_start": title}).select(*UNIT)


def repaired(units: DataFrame) -> DataFrame:
    """Units of recognised elements with texts in NFC; documents without any structure get headings and paragraph starts."""
    document = Window.partitionBy("document_id")
    known = F.max((F.col("element_type") != LINE) | F.col("is_paragraph_start")).over(document)
    rows = units.withColumn("text", t.nfc(F.col("text"))).withColumn("known", known)
    strong, listed = t.is_strong_heading(F.col("text")), t.is_list_item(F.col("text"))
    kind = F.when(~F.col("known") & strong, HEADING).otherwise(F.col("element_type"))
    begins = F.when(F.col("known"), F.col("is_paragraph_start")).otherwise(strong | listed)
    return rows.withColumns({"element_type": kind, "is_paragraph_start": begins}).select(*UNIT)


def _repeats(units: DataFrame, scope: list[str], group: list[str], ratio: float, least: int, mask_digits: bool, max_chars: int | None) -> tuple[DataFrame, DataFrame]:
    """Units with their key, null where they can't be noise, and the keys that enough groups of a scope repeat."""
    key = t.repeat_key(F.col("text")) if mask_digits else t.collapsed(F.col("text"))
    short = F.lit(True) if max_chars is None else F.length(t.strip(F.col("text"))) <= max_chars
    keyed = units.withColumn("key", F.when((F.col("element_type") != HEADING) & short & (key != ""), key))
    # each group counts once, and what is counted are groups, not units
    once = keyed.where("key IS NOT NULL").select(*scope, *group, "key").distinct()
    on = once.groupBy(*scope, "key").agg(F.count("*").alias("groups"))
    every = units.select(*scope, *group).distinct()
    total = every.groupBy(*scope).agg(F.count("*").alias("total")) if scope else every.agg(F.count("*").alias("total"))
    joined = on.join(total, scope) if scope else on.join(F.broadcast(total))  # one row
    enough = F.greatest(F.lit(least), F.floor(F.col("total") * ratio + 0.5))
    return keyed, joined.where(F.col("groups") >= enough).select(*scope, "key", "groups")


def marked_noise(
    units: DataFrame, scope: list[str], group: list[str], ratio: float = NOISE_RATIO, least: int = NOISE_LEAST, mask_digits: bool = False, max_chars: int | None = NOISE_CHARS
) -> DataFrame:
    """Units that enough groups of their scope repeat become headers or footers; headings and long units never do.

    Scope and group are documents and pages, or nothing and documents.
    """
    keyed, often = _repeats(units, scope, group, ratio, least, mask_digits, max_chars)
    found = keyed.join(often.withColumn("noise", F.lit(True)), [*scope, "key"], "left")
    kind = F.when(F.col("noise"), HEADER_FOOTER).otherwise(F.col("element_type"))
    return found.withColumn("element_type", kind).drop("key", "noise", "groups")


def noise_report(
    units: DataFrame, scope: list[str], group: list[str], order: list[str], ratio: float = NOISE_RATIO, least: int = NOISE_LEAST, mask_digits: bool = False, max_chars: int | None = NOISE_CHARS
) -> DataFrame:
    """key, groups, sample: what ``marked_noise`` would mark, the most repeated first; the sample is the first unit by ``order``."""
    keyed, often = _repeats(units, scope, group, ratio, least, mask_digits, max_chars)
    first = keyed.where("key IS NOT NULL").groupBy(*scope, "key").agg(F.min_by("text", F.struct(*order)).alias("sample"))
    return often.join(first, [*scope, "key"]).orderBy(F.desc("groups"), "key")


def grouped(units: DataFrame) -> DataFrame:
    """Units with their group, its heading and the table they stand in; headers, footers and blank units go.

    A group begins at a heading, which the following groups keep, at a paragraph, where a table begins or ends, and where
    another table follows. Items of a list stay together and aren't headings.
    """
    kept = units.where(F.col("element_type") != HEADER_FOOTER).withColumn("text", t.strip(F.col("text"))).where("text <> ''")
    order = Window.partitionBy("document_id").orderBy("n")
    listed = t.is_list_item(F.col("text"))
    kept = kept.withColumns({"is_table": F.col("element_type").isin(*TABLE_KINDS), "is_title": (F.col("element_type") == HEADING) & ~listed})
    kept = kept.withColumn("in_table", F.when(F.col("is_table"), F.col("table_id")))
    was_table, was_in = F.lag("is_table").over(order), F.lag("in_table").over(order)
    other = F.when(was_in.isNotNull(), ~was_in.eqNullSafe(F.col("table_id"))).otherwise(~was_table)
    begins = F.col("is_title") | was_table.isNull() | F.when(F.col("is_table"), other).otherwise(was_in.isNotNull() | F.col("is_paragraph_start") & ~listed)
    kept = kept.withColumn("begins", begins.cast("int"))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    title = F.last(F.when(F.col("is_title"), F.col("text")), ignorenulls=True).over(so_far)
    return kept.withColumns({"group": F.sum("begins").over(so_far).cast("int"), "heading": title}).drop("begins", "is_table", "is_title")


def chunk_groups(units: DataFrame) -> DataFrame:
    """document_id, group, heading, table_id, first, last, units of each group; the table is that of its last unit."""
    return grouped(units).groupBy("document_id", "group").agg(
        F.first("heading").alias("heading"), F.max_by("in_table", "n").alias("table_id"), F.min("n").alias("first"), F.max("n").alias("last"), F.count("*").alias("units")
    )


def _joined_size(sizes: Column, joint: int) -> Column:
    """The size of texts that are joined."""
    return F.aggregate(sizes, F.lit(0), lambda a, b: a + b + joint) - F.when(F.size(sizes) > 0, joint).otherwise(0)


#: More than any budget: nothing joins what stands alone.
_FULL = 1 << 29


def packed(items: Column, kind: str, budget: Column, between: int) -> Column:
    """Runs of items (tokens, alone, ...; of the type ``kind``): each takes what still fits, an item alone is a run of its own.

    The fold holds the open run, whose length the budget bounds, and the closed ones.
    """
    many = lambda k: F.array().cast(f"array<{k}>")
    state = F.struct(F.lit(0).alias("held"), many(kind).alias("run"), many(f"array<{kind}>").alias("runs"))
    closed = lambda s: F.when(F.size(s["run"]) > 0, F.concat(s["runs"], F.array(s["run"]))).otherwise(s["runs"])

    def step(s: Column, x: Column) -> Column:
        new = x["alone"] | (s["held"] + between + x["tokens"] > budget)
        held = F.when(x["alone"], _FULL).when(new | (F.size(s["run"]) == 0), x["tokens"]).otherwise(s["held"] + between + x["tokens"])
        run = F.when(new, F.array(x)).otherwise(F.concat(s["run"], F.array(x)))
        return F.struct(held.alias("held"), run.alias("run"), F.when(new, closed(s)).otherwise(s["runs"]).alias("runs"))

    return F.aggregate(items, state, step, closed)


PART = "struct<text:string,size:int,alone:boolean,tokens:int>"
ITEM = "struct<text:string,size:int,tokens:int,alone:boolean,page_number:int,start:bigint,end:bigint>"


def _with_pieces(rows: DataFrame, counter: Counter) -> DataFrame:
    """Rows with ``pieces`` (text, size) of units over the budget: by sentences, else by white space, then by characters."""
    nonblank = lambda pattern: F.filter(F.split("text", pattern), lambda p: t.strip(p) != "")
    sentences = nonblank(SENTENCE_BREAK)
    long = counter.tokens(F.col("size")) > F.col("budget")
    rows = rows.withColumn("long", long).withColumn("parts", F.when(long, F.when(F.size(sentences) > 1, sentences).otherwise(nonblank(SOFT_BREAK))))
    rows = rows.withColumn("part_sizes", counter.sizes(F.col("parts")))
    step = F.greatest(F.lit(1), F.floor(F.col("budget") * F.lit(counter.least_chars)).cast("int"))
    over = lambda i: counter.tokens(F.get("part_sizes", i)) > F.col("budget")

    def cut(part: Column, i: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(part) - 1) / step)), lambda k: F.substring(part, (k * step).cast("int") + 1, step))
        return F.when(over(i), F.transform(pieces, lambda x: F.struct(x.alias("text"), F.lit(True).alias("alone")))).otherwise(F.array(F.struct(part.alias("text"), F.lit(False).alias("alone"))))

    rows = rows.withColumn("parts", F.flatten(F.transform("parts", cut)))
    rows = rows.withColumn("part_sizes", counter.sizes(F.transform("parts", lambda x: x["text"])))
    sized = F.transform("parts", lambda x, i: F.struct(x["text"].alias("text"), F.get("part_sizes", i).alias("size"), x["alone"].alias("alone"), counter.tokens(F.get("part_sizes", i)).alias("tokens")))
    rows = rows.withColumn("parts", sized.cast(f"array<{PART}>"))
    text = lambda run: F.array_join(F.transform(run, lambda x: x["text"]), " ")
    size = lambda run: _joined_size(F.transform(run, lambda x: x["size"]), counter.joint)
    runs = F.transform(packed(F.col("parts"), PART, F.col("budget"), counter.between), lambda run: F.struct(text(run).alias("text"), size(run).cast("int").alias("size")))
    return rows.withColumn("pieces", F.when(F.col("long"), runs)).drop("parts", "part_sizes")


def _drafts(units: DataFrame, counter: Counter, max_tokens: int, keep_heading: bool) -> DataFrame:
    """document_id, group and the drafts of each group; those after the first repeat its heading and its table's header."""
    group = Window.partitionBy("document_id", "group")
    rows = grouped(units).withColumn("size", counter.size(F.col("text")))
    order = Window.partitionBy("document_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_title = (F.col("element_type") == HEADING) & ~t.is_list_item(F.col("text"))
    rows = rows.withColumn("heading_size", F.last(F.when(is_title, F.col("size")), ignorenulls=True).over(order))
    heads = F.array_sort(F.collect_list(F.when(F.col("element_type") == TABLE_HEADER, F.struct("n", "text", "size"))).over(group))
    in_table = F.max_by("in_table", "n").over(group).isNotNull()
    rows = rows.withColumn("heads", F.when(in_table, heads).otherwise(F.array().cast("array<struct<n:int,text:string,size:int>>")))
    joint = counter.joint
    header_size = F.when(F.size("heads") > 0, _joined_size(F.transform("heads", lambda h: h["size"]), joint) + joint).otherwise(0)
    prefix_size = F.coalesce(F.col("heading_size") + joint, F.lit(0)) if keep_heading else F.lit(0)
    rows = rows.withColumns({"prefix_size": prefix_size, "header_size": header_size})
    prefix_tokens, header_tokens = (F.when(F.col(c) > 0, counter.tokens(F.col(c))).otherwise(0) for c in ("prefix_size", "header_size"))
    rows = rows.withColumns({"prefix_tokens": prefix_tokens, "header_tokens": header_tokens})
    repeats_prefix = (F.col("prefix_size") > 0) & (F.col("prefix_tokens") + F.col("header_tokens") < max_tokens)
    repeats_header = (F.col("header_size") > 0) & (F.col("header_tokens") < max_tokens)
    budget = max_tokens - F.when(repeats_prefix, F.col("prefix_tokens")).otherwise(0) - F.when(repeats_header, F.col("header_tokens")).otherwise(0)
    rows = _with_pieces(rows.withColumns({"repeats_prefix": repeats_prefix, "repeats_header": repeats_header, "budget": budget}), counter)
    none = F.lit(None).cast("bigint")
    item = lambda text, size, alone, a, b: F.struct(
        text.alias("text"), size.alias("size"), counter.tokens(size).alias("tokens"), F.lit(alone).alias("alone"), F.col("page_number"), a.cast("bigint").alias("start"), b.cast("bigint").alias("end")
    )
    own = F.array(item(F.col("text"), F.col("size"), False, F.col("content_start"), F.col("content_end")))
    rows = rows.withColumn("items", F.when(F.col("long"), F.transform("pieces", lambda p: item(p["text"], p["size"], True, none, none))).otherwise(own))
    each = rows.groupBy("document_id", "group").agg(
        F.array_sort(F.collect_list(F.struct("n", "items"))).alias("units"), *[F.first(c).alias(c) for c in ("heading", "heads", "prefix_size", "header_size", "repeats_prefix", "repeats_header", "budget")]
    )
    each = each.withColumn("items", F.flatten(F.transform("units", lambda u: u["items"])).cast(f"array<{ITEM}>"))
    prefix = F.when(F.col("repeats_prefix"), F.concat("heading", F.lit("\n"))).otherwise("")
    header = F.array_join(F.transform("heads", lambda h: h["text"]), "\n")

    def draft(run: Column, j: Column) -> Column:
        body = F.array_join(F.transform(run, lambda x: x["text"]), "\n")
        again = F.col("repeats_header") & (j > 0) & (run[0]["alone"] | (F.instr(body, header) == 0))
        lead = F.concat(F.when(j > 0, prefix).otherwise(""), F.when(again, F.concat(header, F.lit("\n"))).otherwise(""))
        size = _joined_size(F.transform(run, lambda x: x["size"]), joint)
        size += F.when((j > 0) & F.col("repeats_prefix"), F.col("prefix_size")).otherwise(0) + F.when(again, F.col("header_size")).otherwise(0)
        values = lambda c: F.array_compact(F.transform(run, lambda x: x[c]))
        fields = {"text": F.concat(lead, body), "size": size.cast("int"), "lead": lead, "page_number": F.get(values("page_number"), 0), "start": F.array_min(values("start")), "end": F.array_max(values("end")), "heading": F.col("heading")}
        return F.struct(*[x.alias(k) for k, x in fields.items()])

    return each.select("document_id", "group", F.transform(packed(F.col("items"), ITEM, F.col("budget"), counter.between), draft).alias("drafts"))


def _merged(drafts: Column, counter: Counter, min_tokens: int, max_tokens: int) -> Column:
    """Drafts after short ones were pushed forward and a last one was pulled back, never over the limit."""
    run = lambda a, b, c, size: F.array(F.struct(a.alias("a"), b.alias("b"), c.alias("c"), size.alias("size")))
    none = F.array().cast("array<struct<a:int,b:int,c:int,size:int>>")
    state = F.struct(F.lit(0).alias("i"), F.lit(-1).alias("open"), F.lit(0).alias("size"), none.alias("out"))

    def step(s: Column, d: Column) -> Column:
        both = s["size"] + counter.joint + d["size"]
        pending = s["open"] >= 0
        fits = pending & (counter.tokens(both) <= max_tokens)
        out = F.when(pending & ~fits, F.concat(s["out"], run(s["open"], s["i"] - 1, s["i"] - 1, s["size"]))).otherwise(s["out"])
        a, size = F.when(fits, s["open"]).otherwise(s["i"]), F.when(fits, both).otherwise(d["size"])
        short = counter.tokens(size) < min_tokens
        out = F.when(short, out).otherwise(F.concat(out, run(a, s["i"], s["i"], size)))
        return F.struct((s["i"] + 1).alias("i"), F.when(short, a).otherwise(-1).alias("open"), size.alias("size"), out.alias("out"))

    def finish(s: Column) -> Column:
        last = F.element_at(s["out"], -1)
        both = last["size"] + counter.joint + s["size"]
        back = (F.size(s["out"]) > 0) & (counter.tokens(both) <= max_tokens)
        pulled = F.concat(F.slice(s["out"], F.lit(1), F.size(s["out"]) - 1), run(last["a"], last["b"], s["i"] - 1, both))
        alone = F.concat(s["out"], run(s["open"], s["i"] - 1, s["i"] - 1, s["size"]))
        return F.when(s["open"] < 0, s["out"]).when(F.size(s["out"]) == 0, alone).when(back, pulled).otherwise(alone)

    def merged(r: Column) -> Column:
        part = lambda end: F.when(r["a"] == end, F.array(F.get(drafts, r["a"]))).otherwise(F.slice(drafts, r["a"] + 1, end - r["a"] + 1))
        every, own = part(r["c"]), part(r["b"])
        values = lambda rows, c: F.array_compact(F.transform(rows, lambda d: d[c]))
        fields = {
            "text": F.array_join(F.transform(every, lambda d: d["text"]), "\n"), "size": r["size"], "lead": own[0]["lead"], "page_number": F.get(values(own, "page_number"), 0), "start": F.get(values(own, "start"), 0),
            "end": F.try_element_at(values(every, "end"), F.lit(-1)), "heading": F.get(values(own, "heading"), 0),
        }
        return F.struct(*[x.alias(k) for k, x in fields.items()])

    return F.transform(F.aggregate(drafts, state, step, finish), merged)


def _tail(counter: Counter, limit: int) -> tuple[Column, Column]:
    """Whole sentences from the end of ``text``, one at least, up to about the limit, and their size; nothing if it is all of it.

    Columns ``sentences`` and ``sentence_sizes`` hold them.
    """
    items = F.reverse(F.arrays_zip("sentences", "sentence_sizes"))
    state = F.struct(F.lit(0).alias("total"), F.lit(False).alias("done"), F.array().cast("array<struct<sentences:string,sentence_sizes:int>>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        n = counter.tokens(x["sentence_sizes"])
        stop = s["done"] | (F.size(s["kept"]) > 0) & (s["total"] + n > limit)
        total = F.when(stop, s["total"]).otherwise(s["total"] + n)
        return F.struct(total.alias("total"), (stop | (total >= limit)).alias("done"), F.when(stop, s["kept"]).otherwise(F.concat(F.array(x), s["kept"])).alias("kept"))

    kept = F.aggregate(items, state, step, lambda s: s["kept"])
    tail = F.array_join(F.transform(kept, lambda x: x["sentences"]), " ")
    return F.when(tail == t.strip(F.col("text")), "").otherwise(tail), _joined_size(F.transform(kept, lambda x: x["sentence_sizes"]), counter.joint)


CHUNK = ["document_id", "seq", "text", "char_count", "token_count", "page_number", "content_start", "content_end", "heading"]


def chunk_units(
    units: DataFrame, counter: Counter | None = None, max_tokens: int = MAX_TOKENS, min_tokens: int = MIN_TOKENS, overlap_tokens: int = OVERLAP_TOKENS, keep_heading: bool = True
) -> DataFrame:
    """Chunks (``CHUNK``) of units (``UNIT``), in order and within the limit.

    A piece of a unit that is too long has no range; the end of the chunk before isn't in a chunk's range. What repeats
    at the start of a chunk counts. A document's units meet in one task, its numbers in one fold.
    """
    if max_tokens <= 0 or not 0 <= overlap_tokens < max_tokens:
        raise ValueError("the overlap lies between 0 and the limit")
    counter = counter or by_characters()
    each = _drafts(units, counter, max_tokens, keep_heading)
    whole = each.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("group", "drafts"))).alias("groups"))
    whole = whole.withColumn("drafts", F.flatten(F.transform("groups", lambda g: g["drafts"])))
    rows = whole.withColumn("merged", _merged(F.col("drafts"), counter, min_tokens, max_tokens)).select("document_id", F.posexplode("merged").alias("i", "m")).select("document_id", "i", "m.*")
    if overlap_tokens:
        rows = rows.withColumn("sentences", F.filter(F.split("text", SENTENCE_BREAK), lambda p: t.strip(p) != ""))
        rows = rows.withColumn("sentence_sizes", counter.sizes(F.col("sentences")))
        tail, size = _tail(counter, overlap_tokens)
        order = Window.partitionBy("document_id").orderBy("i")
        rows = rows.withColumns({"tail": tail, "tail_size": size}).withColumns({"tail": F.lag("tail").over(order), "tail_size": F.lag("tail_size").over(order)})
        newline = F.locate("\n", F.col("text"))
        first = F.when(newline > 0, F.substring(F.col("text"), F.lit(1), newline)).otherwise(F.col("text"))
        titled = F.col("heading").isNotNull() & (t.strip(first) == t.strip(F.col("heading")))
        lead = F.when((F.col("lead") != "") & F.startswith("text", F.col("lead")), F.col("lead")).when(titled, first).otherwise("")
        longer = F.concat(lead, F.col("tail"), F.lit("\n"), F.substring(F.col("text"), F.length(lead) + 1, F.length("text")))
        fits = (F.col("tail") != "") & (counter.tokens(F.col("size") + F.col("tail_size") + counter.joint) <= max_tokens)
        rows = rows.withColumn("text", F.when(fits, longer).otherwise(F.col("text")))
    rows = rows.withColumn("text", t.strip(F.col("text"))).where("text <> ''")
    seq = F.row_number().over(Window.partitionBy("document_id").orderBy("i")) - 1
    rows = rows.withColumns({"seq": seq.cast("long"), "char_count": F.length("text"), "token_count": counter.tokens(counter.size(F.col("text")))})
    return rows.withColumnsRenamed({"start": "content_start", "end": "content_end"}).select(*CHUNK)


def chunk_documents(lines: DataFrame, **options) -> DataFrame:
    """Chunks of documents given as lines (document_id, line_no, line, content_start)."""
    return chunk_units(units_of_lines(lines), **options)


def assemble_context(hits: DataFrame, budget: int) -> DataFrame:
    """Context of each query from its hits (query_id, rank, chunk_id, filename, seq, text), best first.

    A sentence that an accepted chunk has is left out; a chunk of such sentences alone costs nothing;
    one over the budget is skipped, but the first may be cut. Headers count. Returns query_id, index,
    chunk_id, evidence, tokens.
    """

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, seen, used, index = None, set(), 0, 0
        for batch in batches:
            rows = []
            for query_id, chunk_id, filename, seq, text in zip(*(c.to_pylist() for c in batch.columns)):
                if query_id != query:
                    query, seen, used, index = query_id, set(), 0, 0
                fresh = {}
                for sentence in (s.strip() for s in SENTENCE.split(text) if s.strip()):
                    key = " ".join(sentence.split())
                    if key not in seen:
                        fresh.setdefault(key, sentence)
                if not fresh:
                    continue
                header = f"[{index + 1}] {filename} #{seq + 1}\n"
                body = " ".join(fresh.values())
                if used + tokens(header + body) > budget:
                    room = int((budget - tokens(header)) * t.CHARS_PER_TOKEN) - 2
                    if index or room <= 0:
                        continue
                    body = body[:room]
                seen.update(fresh)
                used += tokens(header + body)
                index += 1
                rows.append((query_id, index, chunk_id, header + body, tokens(header + body)))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64()]
            names = ["query_id", "index", "chunk_id", "evidence", "tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    # A query's hits pass through one task in their order; only what it has accepted is held.
    dealt = hits.repartition("query_id").sortWithinPartitions("query_id", "rank")
    given = dealt.select("query_id", "chunk_id", "filename", "seq", "text")
    return given.mapInArrow(assemble, "query_id long, index long, chunk_id long, evidence string, tokens long")
