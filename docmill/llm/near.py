"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document's set holds its distinct word shingles. Documents with equal sets form a class, and the
class's least id stands for it. Each of ``TREES`` trees sorts the classes by a signature of several
minimal hashes. Neighbours in these orders share the longest prefixes; they are confirmed on the full
sets and joined to components, in rounds of more trees that only look at neighbours in different
components. Then each region, of the classes that share a prefix in any tree, is searched for what
links are left between different components: at depth 3 where the region is small, deeper where it is
large. Links inside a component change nothing, so large groups of near copies cost few pairs, and no
number of partners is capped; a very large region is searched by pairs of its blocks. At similarity 0.8 two classes share no region of depth 4 in any tree
with probability below 1e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import frugal, materialize, mix64, parts_for, random_words, table, text_slices, utf8_buffers
from docmill.llm.components import connected_components
from docmill.llm.repeats import Rolling

#: Trees, and where the rounds that look at neighbours end.
TREES, ROUNDS = 32, (6, 32)
#: Minimal hashes of a region's key, and of what orders a region: the first tells a deeper region.
DEPTH, ORDER = 3, 4
#: Classes of a region of depth 3 up to which it isn't made deeper.
SMALL_REGION = 16
#: Classes of a region, about, that are searched in one task.
BLOCK = 600
#: Regions to search up to which their list is broadcast.
BROADCAST_REGIONS = 100_000
#: Copies of a class's name, between which the class's documents are dealt.
_SALTS = 8
#: Bits of the sketch that two sets at 0.8 never differ in: 12.8 of 128 are expected, 3.4 the deviation.
SKETCH_DIFFERENCE = 32

_HASHES = TREES * (DEPTH + ORDER)
_FACTORS = random_words(_HASHES, 9) | np.uint64(1)
_TREE_SALTS = random_words(TREES, 10)
_C = np.uint64(0x9E3779B97F4A7C15)


def _lower_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each word: ASCII lower case, between ASCII white space."""
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    inside = ~((lower == 32) | ((lower >= 9) & (lower <= 13)))
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    before = np.concatenate([[False], inside[:-1]]) & ~first[:-1]
    begin = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]]) & ~np.append(first[1:-1], True) if len(data) else inside
    end = np.flatnonzero(inside & ~after) + 1
    hashes = mix64(Rolling(lower, 3).of(begin, end) + (end - begin).astype(np.uint64) * _C)
    return hashes, np.searchsorted(offsets, begin, side="right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text in a row, and offsets. A text of fewer words has one."""
    hashes, text = _lower_words(data, offsets)
    n = len(offsets) - 1
    per_text = np.bincount(text, minlength=n)
    starts = np.cumsum(per_text) - per_text
    made = np.where(per_text >= words, per_text - words + 1, np.minimum(per_text, 1))
    owner = np.repeat(np.arange(n), made)
    place = np.repeat(starts - (np.cumsum(made) - made), made) + np.arange(made.sum())
    size = np.minimum(per_text, words)[owner]
    found = np.zeros(len(place), np.uint64)
    for j in range(words):
        use = size > j
        found[use] = mix64(found[use] * _C + hashes[place[use] + j] + np.uint64(1))
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.concatenate([[True], (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])])[: len(found)]
    found, owner = found[new], owner[new]
    return found, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int64)


def signatures(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Minimal hashes (hash, text) of texts that all have a shingle."""
    found = np.empty((_HASHES, len(offsets) - 1), np.uint64)
    for i, factor in enumerate(_FACTORS):
        found[i] = np.minimum.reduceat(sets * factor, offsets[:-1])
    return mix64(found)


FEATURES = "doc_id bigint, set_a bigint, set_b bigint, n int, keys array<bigint>, orders array<bigint>, sketch_a bigint, sketch_b bigint"


def features(docs: DataFrame, words: int) -> DataFrame:
    """Size and name of each document's set, its key and order in each tree, and a sketch of bits."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=1 << 18):
            sets, offsets = shingle_sets(*utf8_buffers(batch.column("text")), words)
            sizes = np.diff(offsets)
            full = np.flatnonzero(sizes)
            columns = [np.zeros(len(sizes), np.uint64) for _ in range(4)]
            keys, orders = (np.zeros((len(sizes), TREES), np.uint64) for _ in range(2))
            if len(full):
                at = offsets[:-1][full]
                columns[0][full] = np.add.reduceat(mix64(sets), at)
                columns[1][full] = np.add.reduceat(mix64(sets ^ _C), at)
                least = signatures(sets, np.append(at, len(sets)))
                for half in (0, 1):
                    for i in range(64):
                        columns[2 + half][full] |= (least[64 * half + i] & np.uint64(1)) << np.uint64(i)
                row = 0
                for tree in range(TREES):
                    key = np.full(len(full), _TREE_SALTS[tree])
                    for _ in range(DEPTH):
                        key = mix64(key * _C + least[row])
                        row += 1
                    order = np.zeros(len(full), np.uint64)
                    for i in range(ORDER):
                        order |= (least[row] >> np.uint64(48)) << np.uint64(48 - 16 * i)
                        row += 1
                    keys[full, tree], orders[full, tree] = key, order
            lists = [
                pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * TREES, pa.int32()), pa.array(x.ravel().view(np.int64)))
                for x in (keys, orders)
            ]
            longs = [pa.array(c.view(np.int64)) for c in columns]
            out = [batch.column("doc_id"), longs[0], longs[1], pa.array(sizes.astype(np.int32)), *lists, longs[2], longs[3]]
            yield pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in FEATURES.split(", ")])

    return docs.mapInArrow(frugal(compute), FEATURES)


def _sorted_trees(classes: DataFrame, percent: int) -> DataFrame:
    """One row for each class and tree, sorted by (tree's key, order); classes alone in a region go.

    ``next`` is the class that follows in the region, if sizes and sketches allow a link.
    """
    parts = parts_for(classes)
    trees = F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(TREES - 1)).alias("tree"), "keys", "orders"))
    rows = classes.select("rep", "n", "sketch_a", "sketch_b", trees.alias("t")).select(
        "rep", "n", "sketch_a", "sketch_b", F.col("t.tree").alias("tree"), F.col("t.keys").alias("key"), F.col("t.orders").alias("ord")
    )
    part = (F.shiftrightunsigned("key", 33) * F.lit(parts) / F.lit(float(1 << 31))).cast("int")
    dealt = rows.repartitionById(parts, part).sortWithinPartitions("key", "ord", "rep")

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last row, whose follower isn't known, and whether it has company
        company = False
        for batch in batches:
            here = pa.Table.from_batches([batch])
            rows = here if held is None else pa.concat_tables([held, here])
            if not rows.num_rows:
                continue
            yield from emit(rows, company, False)
            key = rows.column("key").to_numpy()
            company = len(key) > 1 and key[-1] == key[-2] or (len(key) == 1 and company)
            held = rows.slice(rows.num_rows - 1)
        if held is not None:
            yield from emit(held, company, True)

    def emit(rows: pa.Table, company: bool, end: bool) -> Iterator[pa.RecordBatch]:
        key, rep = rows.column("key").to_numpy(), rows.column("rep").to_numpy()
        after = np.append(key[1:] == key[:-1], False)
        before = np.concatenate([[company], after[:-1]])
        keep = after | before
        if not end:
            keep[-1] = False  # it comes again with the next batch
        following = np.append(rep[1:], 0)
        n, a, b = (rows.column(c).to_numpy() for c in ("n", "sketch_a", "sketch_b"))
        differ = np.bitwise_count((a[1:] ^ a[:-1]).view(np.uint64)) + np.bitwise_count((b[1:] ^ b[:-1]).view(np.uint64))
        sized = 100 * np.minimum(n[1:], n[:-1]).astype(np.int64) >= percent * np.maximum(n[1:], n[:-1]).astype(np.int64)
        valid = after & np.append(sized & (differ <= SKETCH_DIFFERENCE), False)
        out = rows.append_column("next", pa.array(following, mask=~valid)).filter(pa.array(keep))
        yield from out.combine_chunks().to_batches()

    schema = "rep bigint, n int, sketch_a bigint, sketch_b bigint, tree int, key bigint, ord bigint, next bigint"
    return dealt.mapInArrow(frugal(neighbours), schema)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, coarse (32 bits of each item) and items (64 bits) of each text's set."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=1 << 20):
            sets, offsets = shingle_sets(*utf8_buffers(batch.column("text")), words)
            cut = lambda x, w: [bytes(x[w * i : w * j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            coarse = cut(memoryview((sets >> np.uint64(32)).astype("<u4").tobytes()), 4)
            items = cut(memoryview(sets.astype("<u8").tobytes()), 8)
            columns = [batch.column("doc_id"), pa.array(coarse, pa.binary()), pa.array(items, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "coarse", "items"])

    return docs.mapInArrow(frugal(compute), "doc_id bigint, coarse binary, items binary")


def _similar(pairs: DataFrame, sets: DataFrame, column: str, kind: str, percent: int) -> DataFrame:
    """Pairs (u, v) whose sorted values in ``column`` are as similar as ``percent``."""
    with_u = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col(column).alias("of_u")), "u")
    both = with_u.join(sets.select(F.col("doc_id").alias("v"), F.col(column).alias("of_v")), "v").select("u", "v", "of_u", "of_v")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("of_u").to_pylist(), batch.column("of_v").to_pylist()):
                a, b = np.frombuffer(a, kind), np.frombuffer(b, kind)
                # a value that one of them has twice can only raise the count
                joined = np.sort(np.concatenate([a, b]))
                shared = min(int(np.count_nonzero(joined[1:] == joined[:-1])), len(a), len(b))
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(frugal(confirm), "u bigint, v bigint")


def confirm_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of sets (doc_id, coarse, items) with 100 * intersection >= percent * union.

    Most pairs fall to the coarse values, which never understate an intersection; the rest are
    confirmed on the full sets.
    """
    likely = materialize(_similar(pairs, sets, "coarse", "<u4", percent), "near-likely")
    return materialize(_similar(likely, sets, "items", "<u8", percent), "near-links")


#: Items by which a coarse set may overstate what two sets share; three such collisions don't happen.
_SLACK = 2
#: Sets that are compared one by one; for more the items' postings are counted.
_FEW = 12


def _links_in_region(reps: np.ndarray, components: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of one region in different components whose coarse sets allow a link.

    Each class but those of the largest component counts what it shares with others, item by item, unless the
    parts of the range of items rule a link out.
    Components that a link beyond doubt has joined need no other link between them.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    every = np.concatenate(sets)
    # parts of the range of items that a set has items in; each part that only one set is in holds an item that the other lacks
    level = min(max(int(sizes.max()) * 4, 64).bit_length(), 14)
    bits = np.zeros((len(sets), 1 << level), bool)
    bits[owner, every >> np.uint32(32 - level)] = True
    bits = np.packbits(bits, axis=1).view(np.uint64)
    parts = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    postings = None
    found, at = [], np.cumsum(sizes) - sizes
    names, index, counts = np.unique(components, return_inverse=True, return_counts=True)
    root = np.arange(len(names))
    for i in np.flatnonzero(index != np.argmax(counts)):
        alike = 100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])
        others = np.flatnonzero(alike & (root[index] != root[index[i]]))
        both = np.bitwise_count(bits[others] & bits[i]).sum(axis=1, dtype=np.int64)
        most = np.minimum(sizes[i] - parts[i], sizes[others] - parts[others]) + both
        others = others[100 * most >= percent * (sizes[others] + sizes[i] - most)]
        if not len(others):
            continue
        if len(others) <= _FEW:
            own, shared = np.sort(sets[i]), np.zeros(len(sets), np.int64)
            for j in others.tolist():
                shared[j] = np.count_nonzero(own[np.minimum(np.searchsorted(own, sets[j]), len(own) - 1)] == sets[j])
        else:
            if postings is None:
                values, item = np.unique(every, return_inverse=True)
                order = np.argsort(item, kind="stable")
                postings, begin = owner[order], np.searchsorted(item[order], np.arange(len(values) + 1))
            own = np.unique(item[at[i] : at[i] + sizes[i]])
            shared = np.bincount(np.concatenate([postings[begin[x] : begin[x + 1]] for x in own]), minlength=len(sets))
        shared = np.minimum(shared, np.minimum(sizes, sizes[i]))
        allowed = lambda n: 100 * n >= percent * (sizes + sizes[i] - n)
        apart = root[index] != root[index[i]]
        sure = np.flatnonzero(allowed(shared - _SLACK) & apart)
        joined, first = np.unique(root[index[sure]], return_index=True)
        links = sure[first].tolist()
        root[np.isin(root, joined)] = root[index[i]]
        links += np.flatnonzero(allowed(shared) & (root[index] != root[index[i]])).tolist()
        found += [(min(reps[i], reps[j]), max(reps[i], reps[j])) for j in links]
    return found


def _search_regions(percent: int):
    """Over rows (region, rep, component, coarse) sorted by region: candidate links (u, v)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            here = pa.Table.from_batches([batch])
            rows = here if held is None else pa.concat_tables([held, here])
            if not rows.num_rows:
                continue
            region = rows.column("region").to_numpy()
            last = int(np.searchsorted(region, region[-1])) if (np.diff(region) >= 0).all() else int(np.flatnonzero(region != region[-1])[-1]) + 1
            held = rows.slice(last)
            yield run(rows.slice(0, last))
        if held is not None:
            yield run(held)

    def run(rows: pa.Table) -> pa.RecordBatch:
        pairs: set[tuple[int, int]] = set()
        region, rep, component = (rows.column(c).to_numpy() for c in ("region", "rep", "component"))
        sets = [np.frombuffer(x, "<u4") for x in rows.column("coarse").to_pylist()]
        begins = np.concatenate([[0], np.flatnonzero(np.diff(region)) + 1, [len(region)]]) if len(region) else [0]
        for a, b in zip(begins[:-1], begins[1:]):
            if (component[a:b] != component[a]).any():
                pairs.update(_links_in_region(rep[a:b], component[a:b], sets[a:b], percent))
        u, v = ([int(p[i]) for p in pairs] for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return search


def join_components(stars: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """node, component after more links; ``stars`` are the components so far, if any."""
    if links.isEmpty():
        return stars
    if stars is not None:
        links = links.unionByName(stars.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v")))
    return materialize(connected_components(links), "components")


def labelled(rows: DataFrame, stars: DataFrame | None, column: str, label: str) -> DataFrame:
    """``rows`` with the component of a node; a node without links is its own."""
    if stars is None:
        return rows.withColumn(label, F.col(column))
    named = rows.join(stars.select(F.col("node").alias(column), F.col("component").alias(label)), column, "left")
    return named.withColumn(label, F.coalesce(label, column))


def linked_across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate links (u, v) between members (region, rep, component) of one region in different
    components, by their coarse sets (doc_id, coarse).

    Of a very large region, blocks of what isn't in its largest component meet blocks of all members,
    so members of the largest component are copied once for each block of the others only.
    """
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = members.groupBy("region", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = held.groupBy("region").agg(
        F.count(F.lit(1)).alias("components"), F.sum("n").alias("size"), F.max(F.struct("n", "component")).alias("top")
    )
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(BLOCK))).cast("int")
    sizes = sizes.where("components > 1").select(
        "region", F.col("top.component").alias("top"), blocks(F.col("size")).alias("blocks"), blocks(F.col("size") - F.col("top.n")).alias("rows")
    )
    sizes = materialize(sizes, "near-sizes")
    if sizes.limit(BROADCAST_REGIONS + 1).count() <= BROADCAST_REGIONS:  # else Spark splits what is skewed
        sizes = F.broadcast(sizes)
    mixed = members.join(sizes, "region").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    mixed = mixed.withColumn("row", F.when(F.col("component") != F.col("top"), F.pmod(F.xxhash64("rep"), F.col("rows")).cast("int")))
    cell = lambda row, block: F.struct(row.alias("row"), block.alias("block"))
    cells = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: cell(i, F.col("own")))
    across = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: cell(F.col("row"), i))
    cells = F.when(F.col("row").isNull(), cells).otherwise(F.array_union(cells, across))
    mixed = mixed.withColumn("cell", F.explode(cells)).withColumn("region", F.xxhash64("region", "cell.row", "cell.block"))
    held = mixed.select("region", "rep", "component").join(sets.select(F.col("doc_id").alias("rep"), "coarse"), "rep")
    part = (F.shiftrightunsigned("region", 33) * F.lit(parts) / F.lit(float(1 << 31))).cast("int")
    dealt = held.repartitionById(parts, part).sortWithinPartitions("region").select("region", "rep", "component", "coarse")
    return dealt.mapInArrow(frugal(_search_regions(percent)), "u bigint, v bigint").distinct()


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row.

    Links: 100 * intersection >= percent * union of the sets of distinct ``words``-word shingles;
    ``percent`` is 80 or more, which the sketch and the trees are laid out for. A text of fewer words
    has its whole sequence as one shingle. Without words, or with a null text, a row is linked with
    nothing. A null id takes no part: component_id is null, kept true. Rows that share an id are one
    document. Other columns are left out. An empty table gives no rows.
    """
    if percent < 80:
        raise ValueError("percent must be 80 or more")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = materialize(features(rows, words), "near-features")
    linked = found.where("n > 0 AND doc_id IS NOT NULL")
    classes = linked.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"))
    # by the id of the class's document, not by its set, which very many copies may share
    stands = linked.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "set_a", "set_b"]).withColumn("rep", F.col("doc_id"))
    stands = materialize(stands.select("rep", "n", "keys", "orders", "sketch_a", "sketch_b").dropDuplicates(["rep"]), "near-classes")
    regions = materialize(_sorted_trees(stands, percent), "near-regions")
    company = regions.select(F.col("rep").alias("doc_id")).distinct()
    texts = rows.where("doc_id IS NOT NULL AND text IS NOT NULL").join(company, "doc_id", "left_semi")
    sets = materialize(_sets(texts, words).dropDuplicates(["doc_id"]), "near-sets", compression="none")

    # rows of one id in two classes are one document, so both of its classes are
    several = linked.groupBy("doc_id").agg(F.min("set_a").alias("low"), F.max("set_a").alias("high")).where("low <> high")
    same = linked.join(several.select("doc_id"), "doc_id", "left_semi").join(classes, ["set_a", "set_b"]).where("doc_id <> rep")
    same = same.select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    components = join_components(None, same.join(stands.select(F.col("rep").alias("u")), "u", "left_semi"))
    done = 0
    for until in ROUNDS:
        pairs = regions.where(F.col("next").isNotNull() & F.col("tree").between(done, until - 1))
        pairs = pairs.select(F.least("rep", "next").alias("u"), F.greatest("rep", "next").alias("v")).distinct()
        pairs = labelled(labelled(pairs, components, "u", "of_u"), components, "v", "of_v").where("of_u <> of_v")
        components = join_components(components, confirm_pairs(pairs.select("u", "v"), sets, percent))
        done = until

    members = labelled(regions, components, "rep", "component")
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = members.join(sizes.where("low <> high").select("key", "size"), "key")
    deeper = F.when(F.col("size") <= SMALL_REGION, F.col("key")).otherwise(F.xxhash64("key", F.shiftrightunsigned("ord", 48)))
    left = linked_across(mixed.select(deeper.alias("region"), "rep", "component"), sets, percent)
    components = join_components(components, confirm_pairs(materialize(left, "near-left"), sets, percent))

    # documents that stand for their class, or belong to none, know their name; copies are dealt by salt
    sizes = found.select("doc_id", "set_a", "set_b", F.col("n").cast("long").alias("n_shingles"))
    held = linked.groupBy("set_a", "set_b").agg(F.count(F.lit(1)).alias("copies"))
    named = labelled(classes, components, "rep", "component_id").join(held, ["set_a", "set_b"])
    named = named.where("copies > 1 OR component_id <> rep").select("set_a", "set_b", "component_id")
    named = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)).cast("int")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.lit(1))  # null meets nothing
    out = sizes.withColumn("salt", F.when(own.isNotNull(), salt).otherwise(-1 - salt)).join(named, ["set_a", "set_b", "salt"], "left")
    component = F.when(own.isNotNull(), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def op9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)
