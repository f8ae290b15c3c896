"""Line dedup by MinHash: fuzzy copies of a line go, wherever they stand; the first one stays.

A line's set holds its distinct shingles of ``SHINGLE`` characters. Its signature takes, for each of
``HASHES`` hash functions, the least value of the set. Bands of ``BAND`` of them are keys; lines that share a key are candidates, which
the Jaccard similarity of the full sets confirms. Union-find makes components, of which one line is
kept. Equal lines meet by a key of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm.common import LEAST_ID, frugal, materialize, mix64, numbered_twins, parts_for, random_words, table, text_slices, with_row_key
from docmill.llm.components import connected_components
from docmill.llm.near import linked_across
from docmill.llm.repeats import _packed, _run_heads, _unpack

SHINGLE = 10
#: 14 bands of 2: lines at similarity 0.8 share none with probability 0.36 ** 14 = 6.1e-7.
BAND, BANDS, HASHES = 2, 14, 28
#: Of the 28 four-bit values of a sketch, two lines at 0.8 differ in 5.3, deviation 2.1; in more than
#: this with probability 3e-8.
SKETCH_DIFFERENCE = 18
#: Sets so small are linked only with equal ones, from 80 percent on; one band finds these.
ONE_BAND = 3
#: Bytes of text that are taken apart at a time.
SLICE = 1 << 20
#: Characters of lines that are hashed at a time; small arrays stay near the processor.
_BLOCK = 1 << 17
#: Shingles whose minimal hashes are taken at a time.
_CHUNK = 1 << 17
_TIMES = (random_words(HASHES, 5) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_C = np.uint64(0x9E3779B97F4A7C15)
_WORDS = random_words(1 << 16, 55)
_BASE = 0xD6E8FEB86659FD93


def line_hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))


class Shingles:
    """64-bit hashes of the character shingles of lines, in order: ``first`` and ``count`` tell each line's.

    A line of fewer than ``SHINGLE`` characters has one, of all of it.
    """

    def __init__(self, lines: list[str]):
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        # a shingle begins at each character, and an empty line has one
        text = "".join(lines if sizes.all() else [x or "\0" for x in lines]) + "\0" * (SHINGLE - 1)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        values = _WORDS[codes & 0xFFFF]
        high = np.flatnonzero(codes > 0xFFFF)
        values[high] = mix64(codes[high].astype(np.uint64))
        every, width = values, 1
        for bit in bin(SHINGLE)[3:]:  # twice as wide, or twice and one more, until all characters are in
            every = self._joined(every, every, width, width)
            width *= 2
            if bit == "1":
                every, width = self._joined(every, values, width, 1), width + 1
        width = np.maximum(sizes, 1)
        begins = np.cumsum(width) - width
        self.count = np.maximum(sizes - SHINGLE + 1, 1)
        self.first = np.cumsum(self.count) - self.count
        inside = np.ones(len(every), bool)
        long = np.flatnonzero(sizes >= SHINGLE)
        inside[(begins[long] + sizes[long])[:, None] - np.arange(1, SHINGLE)] = False
        short = np.flatnonzero(sizes < SHINGLE).tolist()
        for i in short:
            inside[begins[i] + 1 : begins[i] + width[i]] = False
        self.hash = every[inside]
        for i in short:
            self.hash[self.first[i]] = line_hash(lines[i])
        self.hash ^= self.hash >> np.uint64(32)
        self.hash *= _C

    @staticmethod
    def _joined(left: np.ndarray, right: np.ndarray, skip: int, width: int) -> np.ndarray:
        """Hashes of what ``left`` hashes, followed by what ``right`` hashes ``skip`` places on."""
        n = max(len(right) - skip, 0)
        return left[:n] * np.uint64(pow(_BASE, width, 1 << 64)) + right[skip : skip + n]

    def sets(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Line and upper bits of the hash of each distinct shingle, sorted; ``bits`` as far as there is room."""
        room = min(bits, 63 - len(self.count).bit_length())
        owner = np.repeat(np.arange(len(self.count), dtype=np.uint64), self.count)
        keys = np.sort(owner << np.uint64(room) | self.hash >> np.uint64(64 - room))
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]]
        return (keys >> np.uint64(room)).astype(np.int64), keys & np.uint64((1 << room) - 1)


def signatures(shingles: Shingles) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and sketch (two values) of each line."""
    picks = np.empty((len(shingles.count), HASHES), np.uint64)
    ends = shingles.first + shingles.count
    at = 0
    while at < len(ends):  # lines of about _CHUNK shingles
        to = max(at + 1, int(np.searchsorted(ends, shingles.first[at] + _CHUNK, side="right")))
        own = (shingles.hash[shingles.first[at] : ends[to - 1]] >> np.uint64(32)).astype(np.uint32)
        begin, turned = shingles.first[at:to] - shingles.first[at], np.empty_like(own)
        for i in range(HASHES):
            picks[at:to, i] = np.minimum.reduceat(np.multiply(own, _TIMES[i], out=turned), begin)
        at = to
    picks = mix64(picks + np.arange(HASHES, dtype=np.uint64) * _C)
    sketch = np.zeros((len(picks), 2), np.uint64)
    for i in range(HASHES):
        sketch[:, i // 16] |= (picks[:, i] & np.uint64(15)) << np.uint64(4 * (i % 16))
    bands = np.full((len(picks), BANDS), _C)
    for i in range(BAND):
        bands = mix64(bands * _C + picks[:, i * BANDS : (i + 1) * BANDS])
    return mix64(bands + np.arange(1, BANDS + 1, dtype=np.uint64)), sketch


def _signed(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of shingles, band keys and sketch of each line."""
    shingles = Shingles(lines)
    return shingles.count, *signatures(shingles)


def _blocks(lines: list[str]) -> Iterator[list[str]]:
    """``lines`` in runs of about ``_BLOCK`` characters, one line at least."""
    ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)))
    at = 0
    while at < len(lines):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _BLOCK, side="right")))
        yield lines[at:to]
        at = to


#: A line under a band's key.
_ENTRY = np.dtype([("key", "<u8"), ("hash", "<u8"), ("a", "<u8"), ("b", "<u8")])
#: Where a line stands; ``gone`` if an equal one stands earlier.
_PLACE = np.dtype([("hash", "<u8"), ("doc_id", "<i8"), ("row", "<i8"), ("line", "<i4"), ("gone", "<i4")])
#: Entries of a batch of them for each partition, about.
_ENTRIES = 1000
#: Hashes of lines that a task remembers, so that it sends an often repeated line once.
_SEEN = 300_000


def _sorted_places(found: np.ndarray) -> np.ndarray:
    """Of each hash the first place and, as ``gone``, all others; equal rows name the same place, which isn't later than itself."""
    found = found[np.lexsort((found["row"], found["line"], found["doc_id"], found["hash"]))]
    new = np.concatenate([[True], found["hash"][1:] != found["hash"][:-1]])[: len(found)]
    head = found[_run_heads(~new)] if len(found) else found
    found["gone"] = (found["doc_id"] != head["doc_id"]) | (found["line"] != head["line"]) | (found["row"] != head["row"])
    return found[new | (found["gone"] > 0)]


def _banded(docs: DataFrame, parts: int) -> DataFrame:
    """part, entries, places, many to a row: each different line of a task under the key of each of its bands, and where lines stand.

    Of equal lines the first place is dealt by their hash, and later ones, which are settled, by document.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, spots, count, seen = [], [], 0, set()
        for batch in text_slices(batches, limit=SLICE):
            new: dict[int, str] = {}
            hashes, text, number = [], [], []
            if len(seen) > _SEEN:
                seen = set()
            for i, lines in enumerate(batch.column("text").to_pylist()):
                for j, line in enumerate(lines.split("\n")):
                    if line and not line.isspace():
                        own = line_hash(line)
                        hashes.append(own)
                        text.append(i)
                        number.append(j)
                        if own not in seen:
                            new.setdefault(own, line)
            seen.update(new)
            spot = np.zeros(len(hashes), _PLACE)
            spot["hash"], spot["line"] = np.array(hashes, np.uint64), np.array(number, np.int32)
            for name in ("doc_id", "row"):
                spot[name] = batch.column(name).to_numpy(zero_copy_only=False)[np.array(text, np.int64)]
            spots.append(spot)
            count += len(spot)
            if new:
                counts, bands, sketch = (np.concatenate(x) for x in zip(*map(_signed, _blocks(list(new.values())))))
                made = np.where(counts > ONE_BAND, BANDS, 1)
                at = np.repeat(np.arange(len(made)), made)
                found = np.empty(len(at), _ENTRY)
                found["key"], found["hash"] = bands[np.arange(BANDS) < made[:, None]], np.fromiter(new, np.uint64, len(new))[at]
                found["a"], found["b"] = sketch[at, 0], sketch[at, 1]
                held.append(found)
                count += len(found)
            if count >= min(_ENTRIES * parts, 1 << 20):
                yield from emit(held, spots)
                held, spots, count = [], [], 0
        if count:
            yield from emit(held, spots)

    def emit(held: list[np.ndarray], spots: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if held:
            found = np.concatenate(held)
            part, cuts = dealt(found, found["key"])
            yield pa.RecordBatch.from_arrays([part, cuts, pa.nulls(len(part), pa.binary())], names=["part", "entries", "places"])
        found = _sorted_places(np.concatenate(spots))
        part, cuts = dealt(found, np.where(found["gone"] > 0, mix64(found["doc_id"].view(np.uint64)), found["hash"]))
        yield pa.RecordBatch.from_arrays([part, pa.nulls(len(part), pa.binary()), cuts], names=["part", "entries", "places"])

    def dealt(found: np.ndarray, key: np.ndarray) -> tuple[pa.Array, pa.Array]:
        part = ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")  # short values are counted, not compared
        found, part = found[order], part[order]
        begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])[: len(part)])
        cuts = [found[a:b].tobytes() for a, b in zip(begin, np.append(begin[1:], len(part)))]
        return pa.array(part[begin]), pa.array(cuts, pa.binary())

    return docs.mapInArrow(frugal(compute), "part int, entries binary, places binary")


#: Different lines under one key that are compared with each other; a longer run is searched as a region.
_RUN = 16
#: Entries that a task holds before it drops equal ones and lets go of the longest runs.
_HELD = 3_000_000


def _possible(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the sketches of entries allow a link."""
    count = np.zeros(np.broadcast(x["a"], y["a"]).shape, np.uint8)
    for half in ("a", "b"):
        differ = x[half] ^ y[half]
        differ |= differ >> np.uint64(1)
        differ |= differ >> np.uint64(2)
        count += np.bitwise_count(differ & np.uint64(0x1111111111111111))
    return count <= SKETCH_DIFFERENCE


FOUND = "key bigint, hash bigint, other bigint, long boolean, doc_id bigint, line int, row bigint, gone boolean"
#: Places that a task holds before it lets go of later ones of equal lines.
_PLACES = 1_000_000


def _shared():
    """Over rows of entries and places: lines that their sketches allow a link with another one of their key, and places.
    Rows of places have ``doc_id``; of each line one place is the first, others are ``gone``.

    In a short run, and in one where a line has few others, each such pair goes on as ``hash`` and ``other``.
    Of another run the lines go on as ``long`` that may be linked with any other of it; ``other`` is the
    run's first, if it is that one. A run that is too long to hold goes on as a whole.
    """

    def rows(key, hash_, other, named, long) -> pa.RecordBatch:
        longs = [np.asarray(x, np.uint64).view(np.int64) for x in (key, hash_, other)]
        columns = [pa.array(longs[0]), pa.array(longs[1]), pa.array(longs[2], mask=~np.asarray(named, bool)), pa.array(np.full(len(longs[0]), long))]
        columns += [pa.nulls(len(longs[0]), x) for x in (pa.int64(), pa.int32(), pa.int64(), pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    names = [c.split()[0] for c in FOUND.split(", ")]

    def stand(found: np.ndarray) -> pa.RecordBatch:
        column = lambda x: pa.array(np.ascontiguousarray(x))
        columns = [pa.nulls(len(found), pa.int64()), column(found["hash"].view("<i8")), pa.nulls(len(found), pa.int64()), pa.nulls(len(found), pa.bool_())]
        columns += [column(found["doc_id"]), column(found["line"]), column(found["row"]), column(found["gone"] > 0)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def distinct(parts: list[np.ndarray], needed: dict[int, np.ndarray] | None = None) -> np.ndarray:
        """Different entries by key and hash; with ``needed`` only those that share their key or have one of its keys."""
        found = np.concatenate(parts)
        key = np.ascontiguousarray(found["key"])
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        several = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        runs = order[several]  # the others are in place
        order[several] = runs[np.lexsort((found["hash"][runs], found["key"][runs]))]
        if needed is not None:
            if needed:
                several |= np.isin(key, np.fromiter(needed, np.uint64, len(needed)))
            order = order[several]
        found = found[order]
        return found[np.concatenate([[True], (found["key"][1:] != found["key"][:-1]) | (found["hash"][1:] != found["hash"][:-1])])[: len(found)]]

    def region(run: np.ndarray, lead: np.ndarray, whole: bool) -> pa.RecordBatch:
        """``lead``: the run's first entry, an array of one."""
        keep, first, second, count = np.full(len(run), whole), [], [], 0
        for at in range(0, 0 if whole else len(run), 256):
            part = run[at : at + 256]
            allowed = _possible(part[:, None], run[None, :])
            allowed[np.arange(len(part)), at + np.arange(len(part))] = False
            keep[at : at + 256] = allowed.any(axis=1)
            if count <= _RUN * len(run):
                x, y = np.nonzero(allowed)
                first.append(x[y > x + at] + at)
                second.append(y[y > x + at])
                count += len(first[-1])
        if not whole and count <= _RUN * len(run):
            x, y = (run[np.concatenate([*i, np.zeros(0, np.int64)]).astype(np.int64)] for i in (first, second))
            return rows(x["key"], x["hash"], y["hash"], np.ones(len(x), bool), False)
        named = _possible(run, lead) & (run["hash"] != lead["hash"])
        keep |= run["hash"] == lead["hash"][0]
        return rows(run["key"][keep], run["hash"][keep], np.full(keep.sum(), lead["hash"][0]), named[keep], True)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        spots, room = [np.zeros(0, _PLACE)], _PLACES
        leads: dict[int, np.ndarray] = {}  # of runs that were too long to hold
        for batch in batches:
            places = [np.frombuffer(x, _PLACE) for x in batch.column("places").drop_null().to_pylist()]
            if places:
                found = np.concatenate(places)
                yield stand(found[found["gone"] > 0])
                spots.append(found[found["gone"] == 0])
                if sum(map(len, spots)) > room:
                    found = _sorted_places(np.concatenate(spots))
                    yield stand(found[found["gone"] > 0])
                    spots = [found[found["gone"] == 0]]
                    room = max(_PLACES, 2 * len(spots[0]))
            for entries in batch.column("entries").drop_null().to_pylist():
                held.append(np.frombuffer(entries, _ENTRY))
                count += len(held[-1])
                if count > _HELD:
                    found = distinct(held)
                    if len(found) > _HELD // 2:
                        begin, length = bounds(found)
                        away = np.zeros(len(found), bool)
                        for i in np.flatnonzero(length > max(_RUN, _HELD // 64)):
                            run = found[begin[i] : begin[i] + length[i]]
                            lead = leads.setdefault(int(run["key"][0]), run[:1].copy())
                            yield region(run, lead, True)
                            away[begin[i] : begin[i] + length[i]] = True
                        found = found[~away]
                    held, count = [found], max(0, len(found) - _HELD // 2)
        if held:
            yield from last(distinct(held, leads), leads)
        yield stand(_sorted_places(np.concatenate(spots)))

    def bounds(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = np.flatnonzero(np.concatenate([[True], found["key"][1:] != found["key"][:-1]])[: len(found)])
        return begin, np.diff(np.append(begin, len(found)))

    def last(found: np.ndarray, leads: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        begin, length = bounds(found)
        long = length > _RUN
        if leads:
            long |= np.isin(found["key"][begin], np.fromiter(leads, np.uint64, len(leads)))
        for i in np.flatnonzero(long):
            run = found[begin[i] : begin[i] + length[i]]
            lead = leads.get(int(run["key"][0]))
            yield region(run, run[:1] if lead is None else lead, lead is not None)
        short = found[np.repeat(~long & (length > 1), length)]
        for step in range(1, min(_RUN, len(short))):
            x, y = short[:-step], short[step:]
            same = np.flatnonzero(x["key"] == y["key"])
            x, y = x[same], y[same]
            good = _possible(x, y)
            yield rows(x["key"][good], x["hash"][good], y["hash"][good], np.ones(good.sum(), bool), False)

    return shared


#: Words of 64 bits that tell which of their parts of the range of hashes a set has shingles in.
_WORDS_OF_SET = 16
_HELD_BITS = [f"bits{i}" for i in range(_WORDS_OF_SET)]


def _occupied(owner: np.ndarray, shingle: np.ndarray, count: int) -> np.ndarray:
    """The words of each of ``count`` sets, from hashes of 54 bits."""
    held = np.zeros((count, 64 * _WORDS_OF_SET), bool)
    held[owner, (shingle >> np.uint64(55 - (64 * _WORDS_OF_SET).bit_length())).astype(np.int64)] = True
    return np.packbits(held, axis=1).view(np.int64)


def _by_id(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, row, text) packed and dealt by id, with ``twin``; kept on the executors' disks, as two joins read it."""
    return numbered_twins(_packed(docs).repartition(parts_for(docs), "doc_id", "row")).persist(StorageLevel.DISK_ONLY)


def _line_texts(packed: DataFrame, wanted: DataFrame) -> DataFrame:
    """hash, doc_id, row, line, value, n (size of the set) and bits (see ``_occupied``) of wanted lines (hash, doc_id, line, row, long),
    and the coarse set (32 bits of each shingle) of long ones."""
    by_doc = wanted.groupBy("doc_id", "row").agg(F.collect_list(F.struct("line", "hash", "long")).alias("lines"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, values, long, number, at_row = [], [], [], [], []
            for i, (packed, wanted_lines) in enumerate(zip(batch.column("packed").to_pylist(), batch.column("lines").to_pylist())):
                parts = _unpack(packed).decode("utf-8", "surrogatepass").split("\n")
                for own in wanted_lines:
                    if own["line"] < len(parts):
                        hashes.append(own["hash"])
                        values.append(parts[own["line"]])
                        long.append(own["long"])
                        number.append(own["line"])
                        at_row.append(i)
            coarse, sizes, at = [None] * len(values), np.zeros(len(values), np.int32), 0
            bits = np.zeros((len(values), _WORDS_OF_SET), np.int64)
            for part in (block[i : i + 500] for block in _blocks(values) for i in range(0, len(block), 500)):
                owner, shingle = Shingles(part).sets(54)  # so few lines leave room for all 54 bits
                counts = np.bincount(owner, minlength=len(part))
                sizes[at : at + len(part)] = counts
                bits[at : at + len(part)] = _occupied(owner, shingle, len(part))
                cuts = np.cumsum(counts)
                for i in np.flatnonzero(long[at : at + len(part)]).tolist():
                    own = shingle[cuts[i] - counts[i] : cuts[i]] >> np.uint64(22)
                    coarse[at + i] = np.unique(own.astype("<u4")).tobytes()
                at += len(part)
            places = [batch.column(c).take(pa.array(at_row, pa.int64())) for c in ("doc_id", "row")] + [pa.array(number, pa.int32())]
            columns = [pa.array(hashes, pa.int64()), *places, pa.array(values, pa.string()), pa.array(sizes), pa.array(coarse, pa.binary())]
            columns += [pa.array(bits[:, i]) for i in range(_WORDS_OF_SET)]
            yield pa.RecordBatch.from_arrays(columns, names=["hash", "doc_id", "row", "line", "value", "n", "coarse", *_HELD_BITS])

    one = packed.where("twin = 0").select("doc_id", "row", "packed")  # equal rows hold the same lines
    schema = "hash bigint, doc_id bigint, row bigint, line int, value string, n int, coarse binary"
    return one.join(by_doc, ["doc_id", "row"]).select("doc_id", "row", "packed", "lines").mapInArrow(frugal(compute), ", ".join([schema, *(f"{b} bigint" for b in _HELD_BITS)]))


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of lines whose full sets of shingles are as similar as ``percent``.

    Each part of the range of hashes that only one set is in holds a shingle that the other lacks, so pairs that
    have too many of them aren't compared.
    """
    of = lambda end: texts.select(F.col("hash").alias(end), F.col("value").alias(f"of_{end}"), F.col("n").alias(f"n_{end}"), *[F.col(b).alias(f"{b}_{end}") for b in _HELD_BITS])
    lacks = lambda x, y: sum((F.bit_count(F.col(f"{b}_{x}").bitwiseAND(F.bitwise_not(f"{b}_{y}"))) for b in _HELD_BITS), F.lit(0))
    most = F.least(F.col("n_u") - lacks("u", "v"), F.col("n_v") - lacks("v", "u"))
    both = pairs.join(of("u"), "u").join(of("v"), "v").where(100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v"))
    both = both.where((100 + percent) * most >= percent * (F.col("n_u") + F.col("n_v"))).select("u", "v", "of_u", "of_v")
    both = both.sortWithinPartitions("v")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                # a line of several pairs is taken apart once
                named = pa.concat_arrays([part.column("of_u"), part.column("of_v")]).dictionary_encode()
                owner, shingle = Shingles(named.dictionary.to_pylist()).sets(54)
                sizes = np.bincount(owner, minlength=len(named.dictionary))
                begin = np.cumsum(sizes) - sizes
                lines = named.indices.to_numpy().astype(np.int64).reshape(2, -1)
                low, high = (f(sizes[lines[0]], sizes[lines[1]]) for f in (np.minimum, np.maximum))
                likely = np.flatnonzero(100 * low >= percent * high)
                ends = lines[:, likely].ravel()
                place = np.repeat(begin[ends] - (np.cumsum(sizes[ends]) - sizes[ends]), sizes[ends]) + np.arange(sizes[ends].sum())
                pair = np.repeat(np.tile(likely, 2), sizes[ends]).astype(np.uint64)
                keys = np.sort(pair << np.uint64(54) | shingle[place])
                shared = np.bincount((keys[1:][keys[1:] == keys[:-1]] >> np.uint64(54)).astype(np.int64), minlength=part.num_rows)
                keep = 100 * shared >= percent * (low + high - shared)
                yield part.select(["u", "v"]).filter(pa.array(keep))

    return both.mapInArrow(frugal(confirm), "u bigint, v bigint")


def repeated_lines(docs: DataFrame, percent: int = 80, packed: DataFrame | None = None) -> DataFrame:
    """doc_id, row, line: lines that are fuzzy copies of an earlier one; one may be named again.

    ``docs`` has doc_id (no nulls), text and row, which tells rows of one id apart; ``packed`` is ``_by_id`` of it.
    """
    parts = parts_for(docs)
    dealt = _banded(docs, parts).repartitionById(parts, F.col("part")).select("entries", "places")
    found = materialize(dealt.mapInArrow(frugal(_shared()), FOUND), "lines-runs")
    runs = found.where("doc_id IS NULL").select("key", "hash", "other", "long")
    firsts = found.where("NOT gone").select("hash", "doc_id", "line", "row")
    pairs = runs.where("other IS NOT NULL").select(F.least("hash", "other").alias("u"), F.greatest("hash", "other").alias("v")).distinct()
    pairs = materialize(pairs, "lines-pairs")
    ends = pairs.select(F.explode(F.array("u", "v")).alias("hash"), F.lit(False).alias("long")).unionByName(runs.where("long").select("hash", "long"))
    wanted = ends.groupBy("hash").agg(F.max("long").alias("long"))
    wanted = firsts.join(wanted.hint("shuffle_hash"), "hash")  # so that the many places needn't be sorted
    texts = materialize(_line_texts(_by_id(docs) if packed is None else packed, wanted), "lines-texts")

    links = materialize(_confirmed(pairs, texts, percent), "lines-links")
    components = materialize(connected_components(links, "lines-components"), "lines-components")
    # what links there are in long runs beside those with the run's first line
    labelled = runs.where("long").join(components.select(F.col("node").alias("hash"), "component"), "hash", "left")
    labelled = labelled.select(F.col("key").alias("region"), F.col("hash").alias("rep"), F.coalesce("component", "hash").alias("component"))
    in_long = texts.where("coarse IS NOT NULL")
    second = linked_across(labelled, in_long.select(F.col("hash").alias("doc_id"), "coarse"), percent)
    stars = components.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
    joined = connected_components(stars.unionByName(_confirmed(second, in_long, percent)), "lines-components")

    # of a line, all places but its first are gone; of a component, the first places of all lines but the earliest
    led = texts.select("hash", "doc_id", "line", "row").join(joined.withColumnRenamed("node", "hash"), "hash")
    earliest = led.groupBy("component").agg(F.min(F.struct("doc_id", "line", "row", "hash")).alias("at")).select("at.hash")
    later = led.join(earliest, "hash", "left_anti").select("doc_id", "row", "line")
    return found.where("gone").select("doc_id", "row", "line").unionByName(later)


SCHEMA = "doc_id bigint, n_lines bigint, n_removed bigint, text string"


def deduplicate_lines(
    docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, n_lines (parts between newlines), n_removed, text (what is left) for each row.

    Lines are alike if 100 * intersection >= percent * union of their sets of shingles; ``percent`` is
    80 or more. A shorter line is one shingle. The first line of a component by id and place is kept.
    Blank lines stay. A null text stays null and has no line, an empty one has one. Null ids come first.
    Of rows that share an id, the line of the lower number is earlier, at equal numbers that of the lower
    hash of the text; of equal rows one is first. Each row loses what it repeats itself. ``carry`` names other
    columns, which come along in a struct ``carried``; the rest is left out. An empty table gives no rows.
    """
    if percent < 80:
        raise ValueError("percent must be 80 or more")
    key, text = F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_ID)).alias("doc_id"), F.col(text_col).alias("text")
    rows = docs.select(key, text, text.isNull().alias("absent"), *([F.struct(*carry).alias("carried")] if carry else []))
    rows = with_row_key(rows)
    texts = rows.select("doc_id", "row", F.coalesce("text", F.lit("")).alias("text"))
    packed = _by_id(rows.withColumn("text", F.coalesce("text", F.lit(""))))
    later = repeated_lines(texts, percent, packed).groupBy("doc_id", "row").agg(F.collect_set("line").alias("lines"))
    carried = [f for f in rows.schema.fields if f.name == "carried"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, gone, texts = [], [], []
            for packed, absent, twin, numbers in zip(*(batch.column(c).to_pylist() for c in ("packed", "absent", "twin", "lines"))):
                lines = [] if absent else _unpack(packed).decode("utf-8", "surrogatepass").split("\n")
                out = {i for i, x in enumerate(lines) if x.strip()} if twin else set(numbers or ())
                counts.append(len(lines))
                gone.append(len(out))
                texts.append(None if absent else "\n".join(x for i, x in enumerate(lines) if i not in out))
            ids = batch.column("doc_id")
            ids = pc.if_else(pc.equal(ids, LEAST_ID), pa.scalar(None, pa.int64()), ids)
            columns = [ids, pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())]
            names = ["doc_id", "n_lines", "n_removed", "text", *(f.name for f in carried)]
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(f.name) for f in carried)], names=names)

    schema = T.StructType([*T._parse_datatype_string(SCHEMA).fields, *carried])
    return packed.join(later, ["doc_id", "row"], "left").mapInArrow(frugal(cut), schema)


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate_lines(table(spark, sf_dir, "documents"))
