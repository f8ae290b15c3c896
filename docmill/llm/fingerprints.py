"""Document fingerprints by Order MinHash.

A text's k-mers are numbered by occurrence, so that each is different. Each of ``SIGNATURES`` orders,
a hash function of its own, selects the ``TUPLE`` minimal ones; they are put in the order of the text
and hashed as a tuple, so likeness falls when parts move, as edit distance grows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import LEAST_ID, frugal, id_buckets, mix64, parts_for, random_words, table

#: Characters of a k-mer, signatures of a fingerprint, k-mers of a tuple.
KMER, SIGNATURES, TUPLE = 8, 48, 2
#: Each order hashes the upper half x of a numbered k-mer to (x ^ salt) * odd, modulo 2**32; ties go to the earlier one.
_SALTS, _ODDS = ((random_words(SIGNATURES, seed) >> np.uint64(32)).astype(np.uint32) for seed in (8, 18))
_ODDS |= np.uint32(1)
#: Hashes that are held at a time.
_CELLS = 1 << 17
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str) -> np.ndarray:
    """``SIGNATURES`` 16-bit tuple hashes; none for an empty text. A short text is one k-mer."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(codes):
        return np.zeros(0, np.uint16)
    size = min(KMER, len(codes))
    kmers = codes[: len(codes) - size + 1].copy()
    for j in range(1, size):
        kmers *= _FACTOR
        kmers += codes[j : len(codes) - size + 1 + j]
    kmers = mix64(kmers)
    order = np.argsort(kmers, kind="stable")
    sorted_kmers = kmers[order]
    new = np.concatenate([[True], sorted_kmers[1:] != sorted_kmers[:-1]])
    at = np.arange(len(kmers))
    occurrence = np.empty(len(kmers), np.uint64)
    occurrence[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    numbered = mix64(kmers + occurrence * _FACTOR)
    numbered = (numbered >> np.uint64(32)).astype(np.uint32)
    chosen = np.empty((SIGNATURES, min(TUPLE, len(kmers))), np.int64)
    step = max(1, _CELLS // len(kmers))
    for at in range(0, SIGNATURES, step):
        values = (numbered[None, :] ^ _SALTS[at : at + step, None]) * _ODDS[at : at + step, None]
        rows = np.arange(len(values))
        for j in range(chosen.shape[1]):  # the least, the least of the others, and so on
            chosen[at : at + step, j] = values.argmin(axis=1)
            values[rows, chosen[at : at + step, j]] = np.uint32(0xFFFFFFFF)
    chosen.sort(axis=1)
    found = np.zeros(SIGNATURES, np.uint64)
    for column in chosen.T:
        found = mix64(found * _FACTOR + kmers[column])
    return (found >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal signatures; two empty texts are alike, an empty one is unlike any other."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float(np.mean(a == b))


def with_next(docs: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal rows so that each bucket's task meets its rows by descending id, and then the next row.

    Buckets are ranges of the id. The first row of a bucket is also sent to the bucket before it in
    that order as a guest, and the very first to the last, so no row is looked up by another task.
    Returns doc_id, text, bucket, guest, sorted within partitions, a bucket in each.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(LEAST_ID)))
    rows = rows.withColumn("bucket", id_buckets(rows, buckets)).withColumn("tie", F.xxhash64("text"))
    firsts = sorted(rows.groupBy("bucket").agg(F.max(F.struct("key", "tie"))).collect())  # a row for each bucket
    to = [b for b, _ in firsts[1:]] + [b for b, _ in firsts[:1]]
    spark = docs.sparkSession
    guests = spark.createDataFrame(
        [(b, first["key"], first["tie"], t) for (b, first), t in zip(firsts, to)], "bucket int, key long, tie long, to int"
    )
    guests = rows.join(F.broadcast(guests), ["bucket", "key", "tie"]).withColumn("bucket", F.col("to")).drop("to")
    both = rows.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)))
    dealt = both.repartitionById(buckets, F.col("bucket"))
    return dealt.sortWithinPartitions("bucket", "guest", F.desc("key"), F.desc("tie")).select("doc_id", "text", "guest")


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many first ones of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint, its likeness to an edited text's and to the next document's.

    The next document is the one before it in ids, after the smallest the largest. A null text is
    empty. A null id comes last. Rows with equal ids follow each other by a hash of their texts. One
    row alone is its own next. Other columns are left out. An empty table gives no rows.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, done = None, False
        for batch in batches:
            rows = []
            for doc_id, text, guest in zip(*(c.to_pylist() for c in batch.columns)):
                if done:  # copies of the guest
                    break
                own = fingerprint(text)
                if before is not None:
                    prior_id, prior, prior_print = before
                    changed = edited(prior, text)
                    changed_print = fingerprint(changed)
                    rows.append(
                        (
                            prior_id,
                            len(prior),
                            hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                            prior_print.tobytes().hex(),
                            changed_print.tobytes().hex(),
                            likeness(prior_print, changed_print),
                            likeness(prior_print, own),
                        )
                    )
                before, done = (doc_id, text, own), guest
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    n = parts_for(docs)
    return with_next(docs, n, id_col, text_col).mapInArrow(frugal(compare), SCHEMA)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))
