"""Personal data: base patterns, and bootstrapped contextual extraction.

Seed entities are found by regular expressions: the base kinds, and long mixed strings such as keys.
They seed a graph of lexical patterns and instances. A pattern is what stands beside an entity: the
word before it with the marks between, that word alone, the two words before it, the word after it,
or the words on both sides. An instance is a string of identifier shape. Spark scores the graph in
rounds: a pattern by the trusted instances among all that it extracts, an instance by its best trusted
pattern. A pattern is trusted in a round if enough different trusted instances support it, it extracts
mostly trusted ones, and its word mostly stands at identifiers in the whole corpus. Instances that one
round finds support new patterns in the next one, so patterns are reached that no seed stands beside.
Trusted patterns add identifiers that no expression describes, as spans of kind ``id``.

Only DataFrame functions are used: matches come from extracting by an expression, their places from
splitting by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import discard, materialize, table

#: Patterns are possessive and start only where a run starts or the last match ended, so that no text
#: takes quadratic time or deep recursion; they find what the plain patterns find.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
#: A run of digits with single separators is taken whole; only runs of 14 to 19 digits can be cards.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Keys and tokens: 20 characters or more with letters and digits, standing alone.
SECRET = r"(?<![\p{L}\p{N}_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{20,}+(?![\p{L}\p{N}])"
#: Strings of identifier shape: digits with separators after a few letters or none, or else any word of
#: four characters or more that holds a digit.
IDENTIFIER = (
    r"(?<![\p{L}\p{N}+])(?:(?:[A-Za-z]{1,4}-?)?[0-9](?:[\x20._/():-]{0,2}[0-9]){6,24}(?![\p{L}\p{N}])"
    r"|(?<![_-])(?=[\p{L}._/-]*+[0-9])[\p{L}\p{N}](?:[._/-]?[\p{L}\p{N}]){3,}+)"
)

#: Kinds that are counted, those that seed, and all.
BASE = ("email", "ip", "card", "phone")
SEEDS = (*BASE, "secret")
KINDS = (*SEEDS, "id")
#: Rounds of scoring; instances that must support a pattern; share of trusted instances among what a
#: pattern extracts; share of its word's occurrences that stand at identifiers; score of an instance.
ROUNDS, SUPPORT, PRECISION, SPECIFIC, TRUSTED = 4, 3, 0.3, 0.5, 0.3
#: Added to what a pattern extracts, so that rare patterns score low.
SMOOTHING = 1.0
#: Characters of a value from which all its occurrences are found, not only those at trusted patterns.
TELLING = 7
#: Characters beside an entity in which the words of its patterns end.
BESIDE = 200


def _cut(text: Column, pattern: str, here: Column) -> tuple[Column, Column]:
    """The matches in a text and the pieces between them; both null if there is none."""
    there = here & F.regexp_like(text, F.lit(pattern))
    return F.when(there, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), F.when(there, F.split(text, pattern, -1))


def _starts(values: Column, pieces: Column) -> Column:
    """Where each match starts, in code points."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def add(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.get(pieces, i))
        return F.struct((start + F.length(F.get(values, i))).alias("at"), F.concat(acc["starts"], F.array(start)).alias("starts"))

    return F.aggregate(F.sequence(F.lit(0), F.size(values) - 1), begin, add, lambda acc: acc["starts"])


def _spans(values: Column, pieces: Column, starts: Column) -> Column:
    """start, end (exclusive), value, left and right of each match."""

    def span(start: Column, i: Column) -> Column:
        return F.struct(
            start.alias("start"),
            (start + F.length(F.get(values, i))).alias("end"),
            F.get(values, i).alias("value"),
            F.substring(F.get(pieces, i), -BESIDE, BESIDE).alias("left"),
            F.substring(F.get(pieces, i + 1), 1, BESIDE).alias("right"),
        )

    kind = "array<struct<start:int,end:int,value:string,left:string,right:string>>"
    return F.coalesce(F.transform(starts, span), F.array().cast(kind))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.split(F.reverse(_digits(value)), "")
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda acc, x: acc + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def _ip_parts(value: Column) -> Column:
    bare = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(bare, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, and the spans of each kind that seeds, with candidates ``id`` that overlap none."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    digits = F.regexp_like(text, F.lit("[0-9]"))
    patterns = {
        "email": (EMAIL, F.contains(text, F.lit("@"))),
        "ip": (IP, digits),
        "card": (CARD, digits),
        "phone": (PHONE, F.contains(text, F.lit("+"))),
        "secret": (SECRET, digits),
        "id": (IDENTIFIER, digits),
    }
    parts = [c.alias(f"{name}_{k}") for k, (p, here) in patterns.items() for c, name in zip(_cut(text, p, here), ("values", "pieces"))]
    cut = rows.select("doc_id", *parts)
    each = lambda k: (F.col(f"values_{k}"), F.col(f"pieces_{k}"))
    cut = cut.withColumns({f"starts_{k}": _starts(*each(k)) for k in KINDS})
    found = cut.select("doc_id", *[_spans(*each(k), F.col(f"starts_{k}")).alias(k) for k in KINDS])
    count = lambda s: F.length(_digits(s["value"]))
    found = found.select(
        "doc_id",
        "email",
        F.filter("ip", lambda s: _ip_parts(s["value"])).alias("ip"),
        F.filter("card", lambda s: count(s).between(14, 19) & _luhn(s["value"])).alias("card"),
        F.filter("phone", lambda s: count(s).between(10, 15)).alias("phone"),
        "secret",
        "id",
    )
    apart = lambda kind, others: F.filter(kind, lambda c: ~F.exists(F.concat(*others), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    found = found.withColumn("secret", apart("secret", BASE))
    return found.withColumn("id", apart("id", SEEDS)).withColumn("row", F.monotonically_increasing_id())


def _edges(found: DataFrame) -> DataFrame:
    """row, start, end, seed, instance, side, words, word for each entity and each of its patterns."""
    tagged = lambda name: F.transform(name, lambda s: F.struct(F.lit(name != "id").alias("seed"), s.alias("s")))
    each = found.where(F.size(F.concat(*KINDS)) > 0).select("row", F.explode(F.concat(*[tagged(k) for k in KINDS])).alias("e"))
    each = each.select("row", "e.seed", "e.s.*")
    left, right = F.lower("left"), F.lower("right")
    near = F.regexp_replace(F.regexp_extract(left, r"(\p{L}++[^\p{L}\p{N}]{0,12})$", 1), r"\s+", " ")
    bare, after = F.regexp_extract(near, r"^(\p{L}+)", 1), F.regexp_extract(right, r"^[^\p{L}\p{N}]{0,12}(\p{L}+)", 1)
    two = F.regexp_extract(left, r"(\p{L}++)[^\p{L}\p{N}]{1,12}\p{L}++[^\p{L}\p{N}]{0,12}$", 1)
    pattern = lambda side, words, word, here: F.when(here, F.struct(F.lit(side).alias("side"), words.alias("words"), word.alias("word")))
    patterns = F.array(
        pattern("near", near, bare, bare != ""),
        pattern("bare", bare, bare, bare != ""),
        pattern("two", F.concat_ws(" ", two, bare), bare, (two != "") & (bare != "")),
        pattern("after", after, after, after != ""),
        pattern("around", F.concat_ws("|", bare, after), bare, (bare != "") & (after != "")),
    )
    # all digits, or without enough of them the value, name an instance
    name = F.when(F.length(_digits(F.col("value"))) >= TELLING, _digits(F.col("value"))).otherwise(F.lower("value"))
    named = each.select("row", "start", "end", "seed", name.alias("instance"), F.explode(F.array_compact(patterns)).alias("p"))
    return named.select("row", "start", "end", "seed", "instance", "p.side", "p.words", "p.word")


def _corpus_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """How often each word stands in the whole corpus; a task sums up its own words first."""
    words = docs.where(F.col(text_col).isNotNull()).select(F.explode(F.split(F.lower(F.col(text_col)), r"[^\p{L}]+")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("everywhere"))


def trusted_patterns(docs: DataFrame, edges: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Trusted patterns (side, words), and the instances (instance, score) that they give."""
    graph = edges.groupBy("side", "words", "word", "instance").agg(F.count(F.lit(1)).alias("weight"), F.max("seed").alias("seed"))
    sizes = graph.groupBy("side", "words", "word").agg(F.count(F.lit(1)).alias("kinds"), F.sum("weight").alias("extracted"))
    # a pattern of fewer instances can never be supported, one whose word mostly stands elsewhere is never trusted
    able = sizes.where(F.col("kinds") >= SUPPORT).join(_corpus_counts(docs, text_col), "word").where(F.col("extracted") >= SPECIFIC * F.col("everywhere"))
    graph = materialize(graph.join(able.select("side", "words", "extracted"), ["side", "words"]), "private-graph")
    scores = graph.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score"))
    trusted = (F.col("score") >= TRUSTED).cast("int")
    for _ in range(ROUNDS):
        rated = graph.join(scores, "instance").groupBy("side", "words").agg(
            F.sum(trusted).alias("support"), (F.sum(F.col("weight") * trusted) / (F.first("extracted") + SMOOTHING)).alias("precision")
        )
        good = materialize(rated.where((F.col("support") >= SUPPORT) & (F.col("precision") >= PRECISION)), "private-patterns")
        before = scores
        best = graph.join(good, ["side", "words"], "left").groupBy("instance").agg(F.max("precision").alias("best"), F.max("seed").alias("seed"))
        found = F.when(F.col("seed"), F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
        scores = materialize(best.select("instance", found.alias("score")), "private-instances")
        discard(before)
    return good.select("side", "words"), scores.where(F.col("score") >= TRUSTED)


def _written(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_added for each row.

    Counts are of base spans; ``spans`` has these, keys of kind ``secret``, and those of kind ``id`` that the
    patterns add. A null text is empty. Null ids stay null, repeated rows stay. Without seeds or patterns nothing is added.
    Other columns are left out. An empty table gives no rows.
    """
    found = materialize(extract(docs, id_col, text_col), "private-found")
    edges = materialize(_edges(found), "private-edges")
    patterns, instances = trusted_patterns(docs, edges, text_col)
    new = edges.where("NOT seed")
    at_patterns = new.join(patterns, ["side", "words"], "left_semi").join(instances, "instance", "left_semi")
    telling = at_patterns.where(F.length("instance") >= TELLING).select("instance").distinct()
    everywhere = new.join(telling, "instance", "left_semi").unionByName(at_patterns.select(*new.columns))
    spans = everywhere.select("row", "start", "end").distinct().groupBy("row").agg(
        F.collect_list(F.struct("start", F.lit(KINDS.index("id")).alias("order"), F.lit("id").alias("kind"), "end")).alias("added")
    )
    joined = found.join(spans, "row", "left")
    def ordered(kind: str) -> Column:
        order = F.lit(KINDS.index(kind)).alias("order")
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), order, F.lit(kind).alias("kind"), s["end"].alias("end")))

    base = F.concat(*[ordered(k) for k in BASE])
    own = F.concat(base, ordered("secret"))
    every = F.when(F.col("added").isNull(), own).otherwise(F.concat(own, F.col("added")))
    return joined.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_written(base), 256).alias("base_sha256"),
        _written(every).alias("spans"),
        F.size("secret").cast("long").alias("n_secret"),
        F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"),
    )


def op4_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private(table(spark, sf_dir, "documents"))
