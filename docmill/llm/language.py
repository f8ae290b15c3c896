"""Language identification by interpolated Kneser-Ney character language models.

Spark counts character 4-grams by language over all rows to learn from, and from these the
continuation counts of the shorter orders: tables of hashed n-grams, without a bound on their number
or on the number of languages. Texts are dealt into blocks. The different n-grams of each block are
joined with the tables, which gives each block a sorted array of its own n-grams with their
log-probabilities by language, and the block's texts are scored with that. So what a task holds is
bounded by the text of its block, and nothing of the models is broadcast.

A text takes the language of the lowest cross-entropy per character. A text whose cross-entropy lies
far above what rows of the language show that were not learned from is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import discard, frugal, materialize, parts_for, table, text_slices

#: Order of the models; 16 bits of each character go into an n-gram of 64 bits, so that letters beyond
#: the first 65536 characters share symbols with others.
ORDER = 4
#: What Kneser-Ney takes from each count.
DISCOUNT = 0.75
#: One of so many rows with a language, by a hash of the text, calibrates the limit of rejection before it is counted.
CALIBRATION = 16
#: Bytes of input, as Spark estimates them, for a block of texts that are scored together.
BLOCK_BYTES = 12 << 20
#: Bytes of text that are taken apart at a time; each takes some 100 bytes meanwhile.
SLICE = 1 << 20
#: A text is rejected beyond this many deviations above its language's mean cross-entropy, if that is
#: also more than this many times the mean.
REJECT_DEVIATIONS, REJECT_TIMES = 8.0, 2.0
#: What is left to characters that no model knows, and the least log-probability.
UNKNOWN = 1e-6
FLOOR = float(np.log(UNKNOWN))

def _symbols(batch_text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """16-bit symbols of all texts, each after ORDER - 1 blanks and before one, and where each begins.

    So every letter of a text ends an n-gram, its first ones too. Letters are lower case; what isn't a letter is a blank, and a run of blanks is one.
    """
    text = pc.utf8_lower(pc.fill_null(batch_text, ""))
    joined = pc.binary_join_element_wise(pa.scalar(" "), text.cast(pa.string()), pa.scalar("\n"), pa.scalar(""))
    codes = np.frombuffer("".join(joined.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = pc.utf8_length(joined).to_numpy(zero_copy_only=False)
    last = np.cumsum(lengths) - 1
    letters = _is_letter(codes)
    blank = ~letters
    begin = np.zeros(len(codes), bool)
    begin[(last + 1)[:-1]] = True
    begin[:1] = True
    keep = letters | begin
    keep[1:] |= blank[1:] & ~blank[:-1]
    symbols = np.where(letters, (codes ^ (codes >> 16) * 40503) & 0xFFFF, 32).astype(np.uint16)[keep]
    starts = (np.cumsum(keep) - 1)[np.concatenate([[0], (last + 1)[:-1]])] if len(last) else np.zeros(0, np.int64)
    symbols = np.insert(symbols, np.repeat(starts, ORDER - 2), np.uint16(32))
    return symbols, starts.astype(np.int64) + (ORDER - 2) * np.arange(len(starts))


def _lettered(texts: pa.Array) -> np.ndarray:
    return np.array([any(map(str.isalpha, t)) for t in pc.fill_null(texts, "").to_pylist()], bool)


_LETTERS: np.ndarray | None = None


def _is_letter(codes: np.ndarray) -> np.ndarray:
    """Unicode letters, by a table made once in each process."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS[codes]


def _grams(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ORDER-gram that ends at each symbol but the blanks before a text, its place, and counts by text."""
    n = len(symbols) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    wide = symbols.astype(np.uint64)
    keys = wide[:n].copy()
    for j in range(1, ORDER):
        keys = keys << np.uint64(16) | wide[j : n + j]
    lengths = np.diff(np.append(starts, len(symbols)))
    counts = np.maximum(lengths - ORDER + 1, 0)
    first = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    places = first + np.arange(counts.sum())
    return keys[places], places, counts


def count_ngrams(rows: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of (lang, text). A task adds up what it has before it passes it on."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return keys, np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)

        for batch in text_slices(batches, limit=SLICE):
            langs = pc.dictionary_encode(batch.column("lang"))
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                own = batch.column("text").filter(pc.equal(langs.indices, code))
                keys, ns = np.unique(_grams(*_symbols(own))[0], return_counts=True)
                held.setdefault(lang, []).append((keys, ns))
                if len(held[lang]) >= 8:
                    held[lang] = [merged(held[lang])]
            if sum(len(k) for parts in held.values() for k, _ in parts) > 2_000_000:
                yield from _counted(held, merged)
                held = {}
        yield from _counted(held, merged)

    return rows.mapInArrow(frugal(count), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _counted(held: dict, merged) -> Iterator[pa.RecordBatch]:
    for lang, parts in held.items():
        keys, ns = merged(parts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(ns)], names=["lang", "gram", "n"]
        )


@dataclass
class Model:
    """Counts of each order (lang, gram, n) and of its contexts (lang, context, total, kinds), and how
    far cross-entropies of rows that weren't learned from lie, by language."""

    langs: list[str]
    counts: dict[int, DataFrame]
    contexts: dict[int, DataFrame]
    mean: np.ndarray | None = None
    deviation: np.ndarray | None = None


def _context(order: int) -> Column:
    return F.shiftrightunsigned("gram", 16) if order > 1 else F.lit(0).cast("long")


def _suffix(order: int) -> Column:
    return F.col("gram").bitwiseAND(F.lit((1 << 16 * order) - 1))


def fit(rows: DataFrame) -> Model | None:
    """Learn from rows of (lang, text); None if there are none.

    All rows are counted. How far cross-entropies lie is seen with a model that leaves out the rows that calibrate, so that
    these are scored as rows that it doesn't know; their counts are added afterwards.
    """
    own = F.pmod(F.xxhash64("text"), F.lit(CALIBRATION)) == 0
    part, beside = (materialize(count_ngrams(rows.where(which)), "language-grams") for which in (~own, own))
    added = part.unionByName(beside).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    model, without = _model(materialize(added, "language-grams")), _model(part, once=True)
    if not model.langs:
        return None
    found = _entropies_apart(rows.where(own & F.col("lang").isin(without.langs)), without) if without.langs else {}
    value = lambda lang, c, none: found[lang if lang in found else None][c] if found else none
    model.mean = np.array([value(x, "m", -FLOOR) for x in model.langs])
    model.deviation = np.array([max(value(x, "d", 1.0), 0.02) for x in model.langs])
    discard(beside, *without.counts.values())
    return model


def _model(current: DataFrame, once: bool = False) -> Model:
    """The model of counted ORDER-grams (lang, gram, n). What is read only ``once`` isn't written."""
    langs = sorted(r["lang"] for r in current.select("lang").distinct().collect())  # a row for each language
    counts, contexts = {ORDER: current}, {}
    for order in range(ORDER - 1, 0, -1):  # a shorter gram counts once for each symbol seen before it
        shorter = current.groupBy("lang", _suffix(order).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        counts[order] = current = materialize(shorter, "language-grams")
    for order, df in counts.items():
        totals = df.groupBy("lang", _context(order).alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        contexts[order] = totals if once else materialize(totals, "language-contexts")
    return Model(langs, counts, contexts)


def _interpolated(width: int, last: bool):
    """Batches of (gram, own, seen, below) to (gram, values): what each language gives, from the counts that it has."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            kept, passed, total = np.zeros((n, width)), np.ones((n, width)), np.ones((n, width))
            row, cells = _cells(batch.column("seen"))
            total[row, cells["place"]] = cells["total"]
            passed[row, cells["place"]] = DISCOUNT * cells["kinds"] / cells["total"]
            row, cells = _cells(batch.column("own"))
            kept[row, cells["place"]] = np.maximum(cells["n"] - DISCOUNT, 0) / total[row, cells["place"]]
            below = batch.column("below").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            p = kept + passed * below
            values = np.maximum(np.log(p), FLOOR).astype(np.float32) if last else p
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("gram"), lists], names=["gram", "values"])

    return work


def _cells(lists: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The rows and the fields of all structs in lists; a null list has none."""
    flat = lists.flatten()
    return pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}


def probabilities(model: Model, grams: DataFrame) -> DataFrame:
    """gram, logs for different ``grams``: the log-probability of the last symbol after the others in each language.

    An order gives what is left of its counts after the discount, and passes on the rest to the shorter
    one; a context that a language hasn't seen passes on all. Only what a language has counted is joined.
    """
    spark, width = grams.sparkSession, len(model.langs)
    known = spark.createDataFrame(list(zip(model.langs, range(width))), "lang string, place int")
    asked = {ORDER: grams.select("gram").distinct()}
    for order in range(ORDER - 1, 0, -1):
        asked[order] = asked[order + 1].select(_suffix(order).alias("gram")).distinct()
    shorter, done = None, []
    for order in range(1, ORDER + 1):
        cells = asked[order].withColumns({"context": _context(order), "suffix": _suffix(order - 1)})
        own = model.counts[order].join(known, "lang").groupBy("gram").agg(F.collect_list(F.struct("place", "n")).alias("own"))
        seen = model.contexts[order].join(known, "lang").groupBy("context").agg(F.collect_list(F.struct("place", "total", "kinds")).alias("seen"))
        cells = cells.join(own, "gram", "left").join(seen, "context", "left")
        if shorter is None:
            cells = cells.withColumn("below", F.array(F.lit(UNKNOWN)))
        else:
            cells = cells.join(shorter.select(F.col("gram").alias("suffix"), F.col("values").alias("below")), "suffix")
        last = order == ORDER
        values = cells.select("gram", "own", "seen", "below").mapInArrow(frugal(_interpolated(width, last)), f"gram bigint, values array<{'float' if last else 'double'}>")
        shorter = materialize(values, "language-logs" if last else "language-shorter")
        if not last:
            done.append(shorter)
    discard(*done)
    return shorter.withColumnRenamed("values", "logs")


def _distinct_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different grams of a block's texts."""
    held: list[np.ndarray] = []
    for batch in text_slices(batches, limit=SLICE):
        held.append(np.unique(_grams(*_symbols(batch.column("text")))[0]))
        if len(held) > 16:
            held = [np.unique(np.concatenate(held))]
    if held:
        found = np.unique(np.concatenate(held))
        for at in range(0, len(found), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(found[at : at + 100_000].view(np.int64))], names=["gram"])


def score(docs: DataFrame, model: Model, text_col: str, judge, schema: str) -> DataFrame:
    """``judge(rows, entropies, counts)`` over batches of the rows of ``docs``: cross-entropy per character
    of each text in each language, and characters scored. Rows come back in any order."""
    n = parts_for(docs, BLOCK_BYTES, least=1)  # by size alone: the more blocks, the more n-grams stand in several
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    text = F.coalesce(F.col("doc")[text_col], F.lit(""))
    plain = [F.col("doc")[f.name] for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]  # copies of a text part by their ids
    rows = rows.withColumn("block", F.pmod(F.xxhash64(*plain), F.lit(n)).cast("int"))

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId()
        for batch in _distinct_grams(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, block), pa.int32()), batch.column(0)], names=["block", "gram"])

    texts = rows.select("block", text.alias("text")).repartitionById(n, F.col("block")).select("text")
    grams = materialize(texts.mapInArrow(frugal(tagged), "block int, gram bigint"), "language-asked")
    known = grams.join(probabilities(model, grams), "gram").select("block", "gram", "logs")
    # a block's n-grams come before its rows
    first = known.select("block", F.lit(0).alias("kind"), "gram", "logs", F.lit(None).cast(rows.schema["doc"].dataType).alias("doc"))
    then = rows.select("block", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("gram"), F.lit(None).cast("array<float>").alias("logs"), "doc")
    dealt = first.unionByName(then).repartitionById(n, F.col("block")).sortWithinPartitions("kind").select("kind", "gram", "logs", "doc")
    width = len(model.langs)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        keys = logs = None
        for batch in batches:
            at = int(np.searchsorted(batch.column("kind").to_numpy(), 1))
            if at:
                own = batch.slice(0, at)
                parts.append((own.column("gram").to_numpy(zero_copy_only=False).view(np.uint64), own.column("logs").flatten().to_numpy(zero_copy_only=False).astype(np.float32)))
            if at == batch.num_rows:
                continue
            if keys is None:
                keys = np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in parts)])
                order = np.argsort(keys)
                keys = keys[order]
                logs = np.concatenate([np.zeros(0, np.float32), *(x for _, x in parts)]).reshape(-1, width)[order]
                parts = []
            doc = batch.slice(at).column("doc")
            rest = pa.RecordBatch.from_arrays(doc.flatten(), schema=pa.schema(list(doc.type)))
            for part in text_slices(iter([rest]), text_col, SLICE):
                yield judge(part, *_entropies(part.column(text_col), keys, logs))

    return dealt.mapInArrow(frugal(scored), schema)


def _entropies(texts: pa.Array, keys: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    symbols, starts = _symbols(texts)
    grams, _, counts = _grams(symbols, starts)
    total = np.zeros((len(texts), logs.shape[1]))
    if len(grams):
        text_of = np.repeat(np.arange(len(texts)), counts)
        place = np.searchsorted(keys, grams)
        for column in range(logs.shape[1]):
            total[:, column] = np.bincount(text_of, logs[place, column], len(texts))
    return -total / np.maximum(counts, 1)[:, None], counts


def _entropies_apart(rows: DataFrame, model: Model) -> dict[str | None, dict[str, float]]:
    """Mean ``m`` and deviation ``d`` of the cross-entropy of rows that weren't learned from, in their own language.

    Under None those of all languages together, for languages without such rows.
    """
    place = {lang: i for i, lang in enumerate(model.langs)}

    def own(rows: pa.RecordBatch, entropies: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        at = np.array([place[x] for x in rows.column("lang").to_pylist()], np.int64)
        return pa.RecordBatch.from_arrays([rows.column("lang"), pa.array(entropies[np.arange(len(at)), at]), pa.array(counts)], names=["lang", "h", "n"])

    values = score(rows, model, "text", own, "lang string, h double, n bigint").where("n > 0")
    found = values.rollup("lang").agg(F.avg("h").alias("m"), F.stddev_pop("h").alias("d"), F.count(F.lit(1)).alias("n")).collect()
    return {r["lang"]: {"m": r["m"], "d": r["d"]} for r in found if r["n"]}


SCHEMA = "doc_id bigint, lang_pred string, score double, cross_entropy double, rejected boolean"


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, rejected for each row; only the text is looked at.

    lang_pred is ``und`` and score 0 if the text is null or has no letter, or if there is no model;
    texts without a letter are rejected. score is the share of the language among all at the texts' likelihoods,
    with long texts counted as 50 characters. ``keep`` returns the rows of ``docs`` that aren't
    rejected, with their columns. Null ids stay null, repeated rows stay.
    """
    held = docs if keep else docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    text = text_col if keep else "text"
    if model is None:
        lettered = F.regexp_like(F.coalesce(F.col(text), F.lit("")), F.lit(r"\p{L}"))
        if keep:
            return docs.where(lettered)
        return held.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("cross_entropy"), (~lettered).alias("rejected"))
    langs, mean, deviation = list(model.langs), model.mean, model.deviation

    def judged(texts: pa.Array, entropies: np.ndarray, counts: np.ndarray):
        best = np.argmin(entropies, axis=1)
        lowest = entropies[np.arange(len(best)), best]
        weight = np.minimum(np.maximum(counts, 1), 50)[:, None]
        score = 1 / np.exp(-(entropies - lowest[:, None]) * weight).sum(axis=1)
        lettered = _lettered(texts)
        spread = deviation[best] * np.sqrt(1 + 200 / np.maximum(counts, 1))
        limit = np.maximum(mean[best] + REJECT_DEVIATIONS * spread, REJECT_TIMES * mean[best])
        far = (lowest > limit) & (counts > 0)
        names = [langs[b] if ok else "und" for b, ok in zip(best, lettered)]
        return names, np.where(lettered, score, 0.0), lowest, far | ~lettered

    def label(rows: pa.RecordBatch, entropies: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        names, score, lowest, out = judged(rows.column("text"), entropies, counts)
        columns = [rows.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(lowest), pa.array(out)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    def kept(rows: pa.RecordBatch, entropies: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return rows.filter(pa.array(~judged(rows.column(text), entropies, counts)[3]))

    return score(held, model, text, kept if keep else label, docs.schema if keep else SCHEMA)


def held_out(doc_id: Column) -> Column:
    """Rows that are not learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """The model of all rows that aren't held out and have a language; null texts add nothing."""
    rows = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    return fit(rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
