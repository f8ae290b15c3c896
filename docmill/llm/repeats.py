"""Suffix-array dedup by distributed prefix doubling over sampled positions.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier. Suffixes are ranked
by ever longer prefixes, and a position whose rank is unique drops out:

1. Rank by ``FIRST`` bytes. Only the positions that the content itself samples take part: the least
   hash of all ``FIRST``-byte strings in each window of ``LENGTH`` bytes. Equal windows sample equal
   places, so a window whose sample is unique is unique. Spark sorts the samples by rank.
2. Rank pairs (first rank, rank of the whole stretch of windows that chose the sample). In a run of
   equal pairs all but the earliest are repeats over their whole stretch. Of the rest, those go on
   that share ``FIRST + SIDE`` bytes to the left or to the right with another of the same first rank.
3. Rank by ``LENGTH`` bytes, each window of the stretches that are left. Spark sorts these windows;
   all but the earliest of a run are repeats.

Ranks are names: 64-bit hashes, compared in pairs, of which two independent ones name a string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm.common import LEAST_ID, at_partition_end, frugal, materialize, mix64, numbered_twins, random_words, table, text_slices, utf8_buffers, with_row_key

LENGTH, FIRST, SIDE = 100, 25, 37
#: Bytes that are hashed at a time; each takes some 100 bytes meanwhile.
SLICE = 2 << 20
_NONE = np.zeros(0, np.int64)


class Rolling:
    """Hashes of any stretches of a byte array, by sums of random words times powers modulo 2**64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int):
        base = int(random_words(1, seed + 77)[0]) | 1
        n = len(data) + 1
        if seed not in self._powers or len(self._powers[seed][0]) < n:
            size = max(n, 1 << 21)
            powers = np.full(size, base, np.uint64)
            inverse = np.full(size, pow(base, -1, 1 << 64), np.uint64)
            powers[0] = inverse[0] = 1
            Rolling._powers[seed] = np.cumprod(powers), np.cumprod(inverse)
        self.powers, self.inverse = self._powers[seed]
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(random_words(256, seed)[data] * self.powers[: n - 1], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[begin]) * self.inverse[begin])

    def every(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mix64((self.sums[length:] - self.sums[:n]) * self.inverse[:n])


at_partition_end(Rolling._powers.clear)


def samples(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """For each sampled position of each text: text, place, first and last window, and ranks.

    Places count from the text's start. ``rank`` names FIRST bytes, ``stretch`` all bytes of the
    windows, ``sides`` FIRST + SIDE bytes to the left and to the right, 32 bits each.
    """
    lengths = np.diff(offsets)
    windows = np.maximum(lengths - LENGTH + 1, 0)
    if not windows.sum():
        return {k: _NONE for k in ("text", "place", "low", "high", "rank", "stretch", "sides")}
    rolling = Rolling(data, 1)
    ranks = rolling.every(FIRST)
    span = LENGTH - FIRST + 1
    width = np.uint64(max(1, int(len(ranks)).bit_length()))
    least = (ranks >> width << width) | np.arange(len(ranks), dtype=np.uint64)  # leftmost of the least
    size = 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if span > size:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    starts = np.repeat(offsets[:-1] - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    text = np.repeat(np.arange(len(lengths)), windows)
    place = (least[starts] & ((np.uint64(1) << width) - np.uint64(1))).astype(np.int64)
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    place, text = place[first], text[first]
    low, high = starts[first], starts[last]
    begin, end = offsets[:-1][text], offsets[1:][text]
    stretch = mix64(rolling.of(low, high + LENGTH) + (high - low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    own = mix64(place.astype(np.uint64) + random_words(1, 5)[0])  # matches no other: too near an end
    left = np.where(place - SIDE >= begin, rolling.of(np.maximum(place - SIDE, begin), place + FIRST), own)
    right = np.where(place + FIRST + SIDE <= end, rolling.of(place, np.minimum(place + FIRST + SIDE, end)), own)
    return {
        "text": text,
        "place": place - begin,
        "low": low - begin,
        "high": high - begin,
        "rank": ranks[place],
        "stretch": stretch,
        "sides": (left >> np.uint64(32) << np.uint64(32)) | right >> np.uint64(32),
    }


def _part(ranks: np.ndarray, parts: int) -> np.ndarray:
    """Deal by the mixed rank: a sample is the least of many hashes, so its own leading bits are near zero."""
    return ((mix64(ranks) >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int32)


def _run_heads(same: np.ndarray) -> np.ndarray:
    """The first row of each row's run; ``same`` tells whether a row goes on with the run before."""
    return np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))


def _later(*keys: np.ndarray) -> np.ndarray:
    """Rows, in order of all keys, that equal earlier ones in all but the last three (id, place, row key).

    What has the id, place and row key of the first of its run is the same string, not a later one.
    """
    order = np.lexsort(keys[::-1])
    if not len(order):
        return np.zeros(0, bool)
    sorted_ = [key[order] for key in keys]
    same = np.concatenate([[False], np.all([k[1:] == k[:-1] for k in sorted_[:-3]], axis=0)])
    head = _run_heads(same)
    later = np.zeros(len(order), bool)
    later[order] = np.any([k != k[head] for k in sorted_[-3:]], axis=0)
    return later


SAMPLE_SCHEMA = "part int, settled boolean, rank bigint, stretch bigint, sides bigint, doc_id bigint, low int, row bigint, high int"


def _sampled(docs: DataFrame, parts: int) -> DataFrame:
    """Samples of all texts. What repeats an earlier one of the same batch is settled before the shuffle."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=SLICE):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            found = samples(*utf8_buffers(batch.column("text")))
            doc, row = ids[found["text"]], batch.column("row").to_numpy(zero_copy_only=False)[found["text"]]
            settled = _later(found["rank"], found["stretch"], doc, found["low"], row)
            part = np.where(settled, np.arange(len(doc)) % parts, _part(found["rank"].view(np.uint64), parts)).astype(np.int32)
            longs = [found[k].view(np.int64) for k in ("rank", "stretch", "sides")]
            columns = [part, settled, *longs, doc, found["low"].astype(np.int32), row, found["high"].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in SAMPLE_SCHEMA.split(", ")])

    return docs.mapInArrow(frugal(sample), SAMPLE_SCHEMA)


#: Rows of one first rank that are looked at together for the second; beyond it all go on to the third.
_HELD = 200_000


def _second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (settled, rank, stretch, id, place, row key): repeated stretches, and those to look into."""

    def judge(rows: list[np.ndarray], open_before: bool, open_after: bool, before: tuple | None) -> tuple[pa.RecordBatch, tuple]:
        """``before``: rank, stretch, id, place and row key of the head of the run that may go on in ``rows``."""
        settled, rank, stretch, sides, doc, low, row, high = rows
        n = len(rank)
        goes_on = before is not None and before[:2] == (rank[0], stretch[0]) and not settled[0]
        same = np.concatenate([[False], (rank[1:] == rank[:-1]) & (stretch[1:] == stretch[:-1]) & (settled[1:] == settled[:-1])])
        head = _run_heads(same)
        firsts = [key[head] for key in (doc, low, row)]
        if goes_on:
            for key, value in zip(firsts, before[2:]):
                key[head == 0] = value
        later = (doc != firsts[0]) | (low != firsts[1]) | (row != firsts[2])
        # Equal rows share id, place and row key; one stands for them all.
        twin = ~settled & ~later & ((head != np.arange(n)) | (goes_on & (head == 0)))
        repeated = settled | later
        rest = np.flatnonzero(~repeated & ~twin)
        onward = np.zeros(n, bool)
        for shift in (0, 32):  # the right sides, then the left ones
            side = (sides[rest].view(np.uint64) >> np.uint64(shift)) & np.uint64(0xFFFFFFFF)
            order = np.lexsort((side, rank[rest]))
            equal = (rank[rest][order][1:] == rank[rest][order][:-1]) & (side[order][1:] == side[order][:-1])
            onward[rest[order[1:][equal]]] = onward[rest[order[:-1][equal]]] = True
        if open_before and n:  # part of a very long run: all that isn't settled goes on
            onward |= (rank == rank[0]) & ~repeated & ~twin
        if open_after and n:
            onward |= (rank == rank[-1]) & ~repeated & ~twin
        out = repeated | onward
        columns = [doc[out], row[out], low[out], high[out], repeated[out]]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "row", "low", "high", "repeated"])
        return batch, (rank[-1], stretch[-1], *(key[-1] for key in firsts))

    held: list[np.ndarray] | None = None
    before, cut = None, False
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = rows if held is None else [np.concatenate([a, b]) for a, b in zip(held, rows)]
        rank = held[1]
        if not len(rank):
            continue
        changes = np.flatnonzero((rank[1:] != rank[:-1]) | (held[0][1:] != held[0][:-1]))
        end = int(changes[-1]) + 1 if len(changes) else 0
        if len(rank) - end > _HELD:
            out, before = judge(held, cut, True, before)
            yield out
            cut, held = True, None
        elif end and end >= 50_000:
            yield judge([c[:end] for c in held], cut, False, before)[0]
            before, cut, held = None, False, [c[end:] for c in held]
    if held is not None and len(held[1]):
        yield judge(held, cut, False, before)[0]


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id and the compressed text, as texts move through a shuffle; other columns stay."""
    others = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in text_slices(batches):
            data, offsets = utf8_buffers(batch.column("text"))
            raw = memoryview(data.tobytes())
            texts = [squeeze(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            columns = [batch.column("doc_id"), pa.array(texts, pa.binary()), *(batch.column(f.name) for f in others)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "packed", *(f.name for f in others)])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("packed", T.BinaryType()), *others])
    return docs.mapInArrow(frugal(pack), schema)


def _unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed) if packed else b""


def _third(pairs: DataFrame, parts: int) -> DataFrame:
    """Names of the windows of stretches: (part, settled, name, name2, doc_id, low, row)."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [_unpack(x) for x in part.column("packed").to_pylist()]
                lows, highs = part.column("lows").to_pylist(), part.column("highs").to_pylist()
                offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
                data = np.frombuffer(b"".join(texts), np.uint8)
                low = np.concatenate([np.array(x, np.int64) + o for x, o in zip(lows, offsets)])
                high = np.concatenate([np.array(x, np.int64) + o for x, o in zip(highs, offsets)])
                sizes = high - low + 1
                place = np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                text = np.searchsorted(offsets, place, side="right") - 1
                inside = place + LENGTH <= offsets[text + 1]
                place, text = place[inside], text[inside]
                names = [Rolling(data, seed).of(place, place + LENGTH) for seed in (1, 2)]
                doc, row = (part.column(c).to_numpy(zero_copy_only=False)[text] for c in ("doc_id", "row"))
                start = (place - offsets[text]).astype(np.int32)
                settled = _later(*names, doc, start, row)
                to = np.where(settled, np.arange(len(doc)) % parts, _part(names[0], parts)).astype(np.int32)
                columns = [to, settled, *(x.view(np.int64) for x in names), doc, start, row]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "settled", "name", "name2", "doc_id", "low", "row"])

    return pairs.mapInArrow(frugal(windows), "part int, settled boolean, name bigint, name2 bigint, doc_id bigint, low int, row bigint")


def _later_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (settled, name, name2, id, place, row key): all but the first string of a run."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        settled, name, name2, doc, low, row = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        same = (name[1:] == name[:-1]) & (name2[1:] == name2[:-1]) & (settled[1:] == settled[:-1])
        head = _run_heads(np.concatenate([[False], same]))
        firsts = [key[head] for key in (doc, low, row)]
        if last is not None and last[:2] == (name[0], name2[0]) and not settled[0]:
            for key, value in zip(firsts, last[2:]):
                key[head == 0] = value
        later = settled | (doc != firsts[0]) | (low != firsts[1]) | (row != firsts[2])
        unsettled = np.flatnonzero(~settled)
        if len(unsettled):
            at = unsettled[-1]
            last = (name[at], name2[at], *(key[at] for key in firsts))
        out = [pa.array(doc[later]), pa.array(row[later]), pa.array(low[later]), pa.array(low[later])]
        yield pa.RecordBatch.from_arrays(out, names=["doc_id", "row", "low", "high"])


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_id, row, low, high: the windows low .. high of a document start a string that starts earlier, too.

    ``docs`` has doc_id (no nulls), text and row, which tells rows of one id apart.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["settled", "rank", "stretch", "doc_id", "low", "row"]
    dealt = _sampled(docs, parts).repartitionById(parts, F.col("part")).sortWithinPartitions(*order)
    judged = dealt.select("settled", "rank", "stretch", "sides", "doc_id", "low", "row", "high")
    second = materialize(judged.mapInArrow(frugal(_second), "doc_id bigint, row bigint, low int, high int, repeated boolean"), "repeats-second")
    onward = second.where("NOT repeated").groupBy("doc_id", "row").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs"))
    pairs = onward.join(_packed(docs), ["doc_id", "row"])
    third = _third(pairs, parts).repartitionById(parts, F.col("part"))
    third = third.sortWithinPartitions("settled", "name", "name2", "doc_id", "low", "row")
    third = third.select("settled", "name", "name2", "doc_id", "low", "row")
    found = third.mapInArrow(frugal(_later_windows), "doc_id bigint, row bigint, low int, high int")
    return second.where("repeated").select("doc_id", "row", "low", "high").unionByName(found)


SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept for each row; ``kept`` are the bytes left.

    Texts are UTF-8 bytes; a null text is empty. Null ids come first. Of rows that share an id,
    the string at the lower place is earlier, at equal places that of the lower hash of the text; of
    equal rows one is first. Each row loses what it repeats itself. Other columns are left out. An empty table gives no rows.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_ID)).alias("doc_id")
    rows = with_row_key(docs.select(key, F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    found = repeated_windows(rows).groupBy("doc_id", "row").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, packed, twin, lows, highs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "packed", "twin", "lows", "highs"))):
                text = _unpack(packed)
                data = np.frombuffer(text, np.uint8)
                if twin and len(data) >= LENGTH:
                    lows, highs = [0], [len(data) - LENGTH]
                change = np.zeros(len(data) + 1, np.int32)
                if lows:
                    low = np.minimum(np.array(lows, np.int64), len(data))
                    high = np.minimum(np.array(highs, np.int64) + LENGTH, len(data))
                    np.add.at(change, low, 1)
                    np.add.at(change, high, -1)
                gone = np.cumsum(change[:-1]) > 0
                spans = int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]]))) if len(gone) else 0
                kept = data[~gone].tobytes() if lows else text
                own = None if doc_id == LEAST_ID else doc_id
                out.append((own, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    joined = numbered_twins(_packed(rows)).join(found, ["doc_id", "row"], "left")
    return joined.mapInArrow(frugal(cut), SCHEMA)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
