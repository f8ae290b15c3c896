"""How sources of one language diverge in their use of words: every pair of sources, and each source's telling terms.

The first pass finds exact document frequencies. The second one recounts occurrences: each block of texts gets
the kept terms that stand in it, as an automaton of terms between delimiters. Counts are kept sparse, as postings;
what an absent term adds to a pair of sources is summed from how often each count occurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.llm.common import discard, frugal, materialize, places, table, text_slices, utf8_buffers

#: A lang keeps the terms of at least so many of its documents; a group reports so many terms.
LEAST_DOCUMENTS, TOP_TERMS = 3, 200
#: Shares are counted in parts of this.
UNIT = 1_000_000_000
#: Bytes of text of a block.
BLOCK_BYTES = 32 << 20
#: Bytes of one text that are taken apart at a time, and terms or occurrences that are held at most.
PIECE_BYTES, HELD = 4 << 20, 4_000_000
#: Pairs of postings that are compared at a time.
PAIRS = 2_000_000
#: Rows of postings that are gathered before.
GATHERED = 50_000

#: Bytes of terms, A-Z in lower case; all others become the delimiter.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in lower case, cut at delimiters, with one before and behind each piece."""
    text, at = text.translate(_BYTES), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE_BYTES)
        end = len(text) if end < 0 else end
        yield b" " + text[at:end] + b" "
        at = end


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, lang, term, n: documents of the block that have the term."""
    held: list[pa.Table] = []
    own = None

    def summed() -> pa.Table:
        return pa.concat_tables(held).group_by("term").aggregate([("n", "sum")]).rename_columns(["term", "n"])

    for batch in text_slices(batches, "text"):
        own, texts = batch.slice(0, 1), batch.column("text")
        long = pc.greater(pc.binary_length(texts), PIECE_BYTES)
        for text in texts.filter(long).cast(pa.binary()).to_pylist():
            words: set[bytes] = set()
            for piece in pieces(text):
                words.update(piece.split())
            held.append(pa.table({"term": pa.array(list(words), pa.binary()).cast(pa.string()), "n": np.ones(len(words), np.int64)}))
        data, offsets = utf8_buffers(texts.filter(pc.invert(long)))
        lower = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data.tobytes().translate(_BYTES)))
        split = pc.split_pattern(lower, " ")
        coded = split.flatten().dictionary_encode()
        k = max(len(coded.dictionary), 1)
        once = np.unique(pc.list_parent_indices(split).to_numpy().astype(np.int64) * k + coded.indices.to_numpy())
        held.append(pa.table({"term": coded.dictionary.cast(pa.string()), "n": np.bincount(once % k, minlength=len(coded.dictionary))}))
        if sum(t.num_rows for t in held) >= HELD:
            held = [summed()]
    if held:
        for part in summed().filter(pc.field("term") != "").to_batches(max_chunksize=65536):
            same = pa.array(np.zeros(part.num_rows, np.int32))
            yield pa.RecordBatch.from_arrays([own.column("block").take(same), own.column("lang").take(same), *part.columns], names=["block", "lang", "term", "n"])


class _Recount:
    """The kept terms of one block, and what occurs of them in each source."""

    def __init__(self) -> None:
        import ahocorasick

        self.automaton, self.terms, self.found, self.held, self.ready = ahocorasick.Automaton(), [], {}, 0, False
        self.held_terms = 0

    def keep(self, terms: pa.Array) -> None:
        for number, term in enumerate(terms.cast(pa.binary()).to_pylist(), self.held_terms):
            self.automaton.add_word(f" {term.decode('latin-1')} ", number)  # a letter for each byte
        self.terms.append(terms)
        self.held_terms += len(terms)

    def count(self, source: str, text: bytes) -> None:
        if not self.ready:
            self.automaton.make_automaton()
            self.ready = True
        for piece in pieces(text) if self.held_terms else ():
            ids = np.fromiter(map(itemgetter(1), self.automaton.iter(piece.decode("latin-1"))), np.int32)
            self.found.setdefault(source, []).append(ids)
            self.held += len(ids)

    def counted(self) -> Iterator[pa.RecordBatch]:
        terms = pa.concat_arrays(self.terms) if self.terms else None
        for source, ids in self.found.items():
            counts = np.bincount(np.concatenate(ids), minlength=1)
            ids = np.flatnonzero(counts)
            same = pa.array([source], pa.string()).take(pa.array(np.zeros(len(ids), np.int32)))
            yield pa.RecordBatch.from_arrays([same, terms.take(pa.array(ids)), pa.array(counts[ids].astype(np.int64))], names=["source", "term", "n"])
        self.found, self.held = {}, 0


def _second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of kept terms by source in one block; its terms come first, then its texts."""
    state, lang = _Recount(), None

    def rows() -> Iterator[pa.RecordBatch]:
        for batch in state.counted():
            own = pa.array([lang], pa.string()).take(pa.array(np.zeros(batch.num_rows, np.int32)))
            yield pa.RecordBatch.from_arrays([own, *batch.columns], names=["lang", "source", "term", "n"])

    for batch in text_slices(batches, "content"):
        texts = int(np.searchsorted(batch.column("is_text").to_numpy(zero_copy_only=False), 1))
        state.keep(batch.column("content").slice(0, texts))
        rest = batch.slice(texts)
        if rest.num_rows:
            lang = rest.column("lang")[0].as_py()
        for source, text in zip(rest.column("source").to_pylist(), rest.column("content").cast(pa.binary()).to_pylist()):
            state.count(source, text)
            if state.held >= HELD:
                yield from rows()
    yield from rows()


def in_blocks(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` with their block, and the number of blocks.

    A block has about ``BLOCK_BYTES`` of text of one lang. Sources stand one behind the other, and a document goes to
    a place within its source's bytes by its hash, so that a large source has several blocks and small ones share one.
    """
    sizes = docs.groupBy("lang", "source").agg(F.sum(F.octet_length("text")).alias("size"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("size").over(before(Window.partitionBy("lang").orderBy("source"))), F.lit(0)))
    langs = sizes.groupBy("lang").agg((F.floor(F.sum("size") / BLOCK_BYTES) + 1).alias("blocks"))
    langs = langs.withColumn("first", F.coalesce(F.sum("blocks").over(before(Window.orderBy("lang"))), F.lit(0)))  # a row for each lang
    sizes = materialize(sizes.join(langs, "lang"), "source-sizes")
    blocks = sizes.agg(F.max(F.col("first") + F.col("blocks"))).first()[0] or 1
    place = F.col("before") + F.pmod(F.col("key"), F.greatest("size", F.lit(1)))
    dealt = docs.join(sizes, ["lang", "source"]).withColumn("block", (F.col("first") + F.floor(place / BLOCK_BYTES)).cast("int"))
    return dealt.select("block", "lang", "source", "text"), int(blocks)


def count_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """kept (lang, term), and postings (lang, source, term, n) of what occurs of it.

    ``docs`` has lang, source and text without nulls, and a key that deals documents out evenly.
    """
    texts, blocks = in_blocks(docs)
    dealt = texts.select("block", "lang", "text").repartitionById(blocks, "block")
    seen = materialize(dealt.mapInArrow(frugal(_first_pass), "block int, lang string, term string, n bigint"), "block-terms")
    kept = materialize(seen.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term"), "kept-terms")
    terms = seen.join(kept, ["lang", "term"]).select("block", F.lit(0).alias("is_text"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.col("term").alias("content"))
    texts = texts.select("block", F.lit(1).alias("is_text"), "lang", "source", F.col("text").alias("content"))
    dealt = terms.unionByName(texts).repartitionById(blocks, "block").sortWithinPartitions("is_text")
    counts = dealt.mapInArrow(frugal(_second_pass), "lang string, source string, term string, n bigint")
    postings = materialize(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")), "postings")
    discard(seen)
    return kept, postings


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + terms)), exact."""
    return F.expr(f"1 + CAST({UNIT} AS DECIMAL(10, 0)) * CAST({count} + 1 AS DECIMAL(19, 0)) div ({total} + {terms})")


def differs(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def summed(key: np.ndarray, value: np.ndarray, keys: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the exact sums of their values, without sums of 0; dense where there are few keys, else by sorting."""
    if keys <= PAIRS:
        sums = np.zeros(keys, np.int64)
        np.add.at(sums, key, value)
        key = np.flatnonzero(sums)
        return key, sums[key]
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(value, first) if len(first) else value[:0]


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What terms of both sources add beyond each source's own sums; rows come by lang and term.

    The rows of one term are as many as its sources, and the result has their square.
    """
    numbers: dict[tuple[str, str], int] = {}
    f = lambda p, q: (p - q) * (p - q) // q

    def pairs(rows: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        langs, sources = (rows.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
        k = len(sources.dictionary)
        seen, ids = np.unique(langs.indices.to_numpy().astype(np.int64) * k + sources.indices.to_numpy(), return_inverse=True)
        groups = [(langs.dictionary[g // k].as_py(), sources.dictionary[g % k].as_py()) for g in seen.tolist()]
        ids = np.array([numbers.setdefault(g, len(numbers)) for g in groups], np.int64)[ids]
        p, p0 = (rows.column(c).to_numpy() for c in ("p", "p0"))
        begins = np.r_[0, cuts]
        sizes = np.diff(np.r_[begins, len(ids)])
        begin, size = np.repeat(begins, sizes), np.repeat(sizes, sizes)
        names = list(numbers)
        at = 0
        while at < len(ids):
            end = max(at + 1, at + int(np.searchsorted(np.cumsum(size[at:]), PAIRS, side="right")))
            left, right = np.repeat(np.arange(at, end), size[at:end]), places(begin[at:end], size[at:end])
            left, right = left[other := left != right], right[other]
            value = f(p[left], p[right]) - f(p[left], p0[right]) - f(p0[left], p[right]) + f(p0[left], p0[right])
            key, sums = summed(ids[left] * len(names) + ids[right], value, len(names) ** 2)
            if len(key):
                of = [names[i] for i in (key // len(names)).tolist()]
                items = [names[i][1] for i in (key % len(names)).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in of], pa.string()), pa.array([x[1] for x in of], pa.string()), pa.array(items, pa.string()), pa.array(sums)], names=["lang", "source", "item", "value"])
            at = end

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= GATHERED:
            rows = pa.Table.from_batches(held)
            cuts = _changes(rows)
            last = int(cuts[-1]) if len(cuts) else 0  # the last term may go on
            if last:
                yield from pairs(rows.slice(0, last), cuts[:-1])
            held = rows.slice(last).to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        yield from pairs(rows, _changes(rows))


def _changes(rows: pa.Table) -> np.ndarray:
    """Places where another term begins."""
    found = np.zeros(max(rows.num_rows - 1, 0), bool)
    for c in ("lang", "term"):
        column = rows.column(c).combine_chunks()
        found |= pc.not_equal(column.slice(1), column.slice(0, max(rows.num_rows - 1, 0))).to_numpy(zero_copy_only=False)
    return np.flatnonzero(found) + 1


RESULT = ["lang", "source", "part", "item", "value", "rank"]


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: how each (lang, source) group diverges from others and by which terms.

    ``docs`` has text, lang, source, nulls count as '', and each row is a document, repeated ones too; other
    columns aren't read. Groups without terms have pairs, a lang without kept terms has pairs of value 0, a lang with
    one source has no pairs, an empty table gives no rows. Ties go to the smaller item by UTF-8. A sum beyond 64
    bits raises an error. Documents are dealt out by their text and doc_id, if there is one. Memory of a task follows ``BLOCK_BYTES``, the distinct terms of its longest text, and
    the number of sources.
    """
    key = F.xxhash64(*[F.col(c) for c in ("text", "doc_id") if c in docs.columns])
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")], key.alias("key"))
    kept, postings = count_terms(docs, least)
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("held"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").na.fill(0, ["held"])
    by_lang = groups.groupBy("lang").agg(F.sum("held").alias("lang_held"))
    by_lang = by_lang.join(kept.groupBy("lang").agg(F.count("*").alias("terms")), "lang", "left").na.fill(0, ["terms"])
    groups = groups.join(by_lang, "lang").withColumn("p0", F.when(F.col("terms") == 0, 1).otherwise(share("0", "held", "terms")))
    groups = materialize(groups, "source-groups")

    # rows of a term stand together, one for each source that has it
    each = postings.join(groups, ["lang", "source"]).withColumn("p", share("n", "held", "terms"))
    each = each.withColumn("lang_n", F.sum("n").over(Window.partitionBy("lang", "term")))
    each = each.withColumn("q", share("lang_n", "lang_held", "terms")).select("lang", "term", "source", "p", "p0", "q")
    each = materialize(each, "term-shares")
    telling = each.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(differs("p", "q")).alias("value"))

    # a term that one source lacks: from how often each share occurs
    exact = lambda x: F.expr(f"CAST({x} AS DECIMAL(38, 0))")
    often = each.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("m"))
    others = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("o0"))
    met = often.join(others, "lang").where("source <> other")
    mine = exact(f"CAST(m AS DECIMAL(18, 0)) * ({differs('p', 'o0')} - {differs('p0', 'o0')})")
    theirs = exact(f"CAST(m AS DECIMAL(18, 0)) * ({differs('o0', 'p')} - {differs('o0', 'p0')})")
    sides = F.array(F.struct(F.col("source").alias("source"), F.col("other").alias("item"), mine.alias("value")), F.struct(F.col("other").alias("source"), F.col("source").alias("item"), theirs.alias("value")))
    alone = met.select("lang", F.explode(sides).alias("x")).select("lang", "x.*")
    base = groups.join(others, "lang").where("source <> other")
    base = base.select("lang", "source", F.col("other").alias("item"), exact(f"CAST(terms AS DECIMAL(18, 0)) * {differs('p0', 'o0')}").alias("value"))
    dealt = each.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term")
    both = dealt.mapInArrow(frugal(_corrections), "lang string, source string, item string, value bigint")
    sums = base.unionByName(alone).unionByName(both.withColumn("value", exact("value"))).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    pair = sums.withColumn("part", F.lit("pair"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).select(*RESULT)
    return ranked(pair).unionByName(ranked(telling).where(F.col("rank") <= top))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
),
t AS MATERIALIZED (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
n AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS MATERIALIZED (
  SELECT lang, source, coalesce(held, 0) AS held, coalesce(terms, 0) AS terms
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS held FROM n GROUP BY lang, source) USING (lang, source)
  LEFT JOIN (SELECT lang, count(*) AS terms FROM kept GROUP BY lang) USING (lang)
),
p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 1)) // (held + terms) AS p
  FROM g JOIN kept k USING (lang) LEFT JOIN n USING (lang, source, term)
),
l AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(held) + any_value(terms)) AS q
  FROM n JOIN (SELECT lang, sum(held) AS held, any_value(terms) AS terms FROM g GROUP BY lang) USING (lang) GROUP BY lang, term
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(v, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS v
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source
  ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
),
found AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER w)::INT AS rank FROM found
WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item)
QUALIFY part = 'pair' OR row_number() OVER w <= 200
"""
