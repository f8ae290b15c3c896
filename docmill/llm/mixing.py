"""Mixing sources to target weights by Poisson replication.

A source with target weight w and n of N documents repeats each of its documents rate = w * N / n
times on average. A document's count comes from the inverse of the Poisson distribution at a number
hashed from a seed and its id; the document is exploded by its count, and the copies are sorted by
another hash, which shuffles them globally. A rate over ``STEP`` is a sum of smaller Poisson counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.llm.common import table

#: The largest mean that is inverted at once, and the counts beyond which it has no mass in doubles.
STEP, LARGEST = 16.0, 90
#: Rows of the table of sources up to which it is broadcast.
BROADCAST_SOURCES = 10_000


def unit_hash(*parts: Column | str) -> Column:
    """A number in [0, 1), a multiple of 2**-52, from the MD5 of the parts."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None, repetition: float, power: float) -> DataFrame:
    """source, n, rate: one row per source, of which a null source is one."""
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(power))
    else:
        known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.lit(None)
        weight = F.coalesce(F.element_at(known, F.col("source")).cast("double"), F.lit(0.0)) if weights else F.lit(0.0)
    weighed = counts.withColumn("weight", weight)
    every = Window.partitionBy()  # a row for each source
    all_weights, all_n = F.sum("weight").over(every), F.sum("n").over(every)
    share = F.when(all_weights > 0, F.col("weight") / all_weights).otherwise(F.lit(0.0))
    return weighed.select("source", "n", (share * all_n * F.lit(float(repetition)) / F.col("n")).alias("rate"))


def _distribution(mean: Column) -> Column:
    """P(count <= k) for k = 0 .. LARGEST."""
    first = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("sums"))

    def add(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + p)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(LARGEST)), first, add)["sums"]


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    repetition: float = 1.0,
    power: float = 0.5,
    seed: str = "mix",
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """Copies of documents in a global shuffle: all columns of ``docs``, with copy and shuffle_key.

    ``weights`` are target weights by source, a missing source has 0; without weights a source's
    weight is its document count to ``power``. ``repetition`` is the mean number of copies over all
    documents. Null sources are a source. A null id is hashed as a value. Rows with equal ids get
    equal counts. A column of ``docs`` named copy or shuffle_key is replaced. No rows give no rows.
    """
    own = docs.withColumns({"__source": F.col(source_col), "__id": F.col(id_col)})
    rates = source_rates(docs.select(F.col(source_col).alias("source")), weights, repetition, power)
    steps = F.greatest(F.lit(1.0), F.ceil(F.col("rate") / STEP)).cast("int")
    rates = rates.select(F.col("source").alias("__rated"), steps.alias("__steps"), _distribution(F.col("rate") / steps).alias("__sums"))
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    rated = own.join(rates, F.col("__source").eqNullSafe(F.col("__rated")))
    # a number for each step, bound before it is compared with the sums
    drawn = F.transform(F.sequence(F.lit(1), F.col("__steps")), lambda j: unit_hash(seed, F.col("__id"), j))
    one = F.array_position(F.transform(F.col("__sums"), lambda s: s > F.col("__u")), True) - 1
    rated = rated.withColumn("__u", unit_hash(seed, F.col("__id"), F.lit(1))).withColumn("__us", F.when(F.col("__steps") > 1, drawn))
    one = F.when(one >= 0, one).otherwise(F.size("__sums")).cast("int")
    more = F.aggregate("__us", F.lit(0), lambda acc, u: acc + F.size(F.filter(F.col("__sums"), lambda s: s <= u)))
    count = F.when(F.col("__steps") == 1, one).otherwise(more)
    copies = rated.withColumn("__count", count).where("__count > 0")
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__count") - 1)))
    copies = copies.withColumn("shuffle_key", unit_hash(seed, F.lit("order"), F.col("__id"), F.col("copy")))
    copies = copies.select(*[c for c in docs.columns if c not in ("copy", "shuffle_key")], "copy", "shuffle_key")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the key is uniform in [0, 1), so its ranges need no sample
    return copies.repartitionById(n, F.floor(F.col("shuffle_key") * n).cast("int")).sortWithinPartitions("shuffle_key", "copy")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (
  SELECT source, pow(n::DOUBLE, 0.5) / (SELECT sum(pow(n::DOUBLE, 0.5)) FROM counts) * (SELECT sum(n) FROM counts) / n AS rate
  FROM counts
),
steps AS (SELECT source, rate, greatest(1, ceil(rate / 16.0))::INT AS steps FROM rates),
terms AS (
  SELECT source, steps, k, exp(-rate / steps) * pow(rate / steps, k) / gamma(k + 1) AS p
  FROM steps, generate_series(0, 90) AS g(k)
),
sums AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS s FROM terms),
draws AS (
  SELECT d.doc_id, d.source, j,
    ('0x' || substr(md5('mix:' || d.doc_id || ':' || j), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN steps USING (source), LATERAL generate_series(1, steps.steps) AS g(j)
),
found AS (
  SELECT doc_id, count(*) AS copies FROM draws JOIN sums ON draws.source = sums.source AND sums.s <= draws.u GROUP BY doc_id
)
SELECT d.*, c::INT AS copy,
  ('0x' || substr(md5('mix:order:' || d.doc_id || ':' || c), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS shuffle_key
FROM documents d JOIN found USING (doc_id), LATERAL generate_series(0, found.copies - 1) AS g(c)
"""
