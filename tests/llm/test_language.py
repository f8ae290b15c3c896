"""Kneser-Ney probabilities against a plain version that follows the formula, and held-out accuracy."""

import collections
import math
import random

from pyspark.sql import functions as F

from docmill.llm import language

TEXTS = {"xx": ["abab ba", "abc a", "b", "ab ab ab", "cab"], "yy": ["bcd dd", "dab", "dd dd", "abcd"], "zz": ["éa éé a", "aé"]}


def plain(texts):
    """Probability of a gram's last symbol after the others, by interpolated Kneser-Ney of order 4."""
    seen = [collections.Counter() for _ in range(5)]
    for text in texts:
        s = f"   {text} "
        seen[4].update(s[i : i + 4] for i in range(len(s) - 3))
    for k in (3, 2, 1):
        seen[k].update(g[1:] for g in seen[k + 1])

    def p(gram):
        k = len(gram)
        if not k:
            return language.UNKNOWN
        after = {g: n for g, n in seen[k].items() if g[:-1] == gram[:-1]}
        total = sum(after.values())
        if not total:
            return p(gram[1:])
        return max(after.get(gram, 0) - 0.75, 0) / total + 0.75 * len(after) / total * p(gram[1:])

    return p


def test_probabilities(spark, monkeypatch):
    monkeypatch.setattr(language, "CALIBRATION", 1 << 40)  # all rows are learned from
    rows = spark.createDataFrame([(lang, t) for lang, ts in TEXTS.items() for t in ts], "lang string, text string")
    model = language.fit(rows)
    grams = ["abab", " ab ", "bcd ", "zzzz", "cabd", "éa é", "dddd", " éé "]
    keys = [sum(ord(c) << 16 * (3 - i) for i, c in enumerate(g)) for g in grams]
    signed = [k - (1 << 64) if k >> 63 else k for k in keys]
    found = {r.gram: r.logs for r in language.probabilities(model, spark.createDataFrame([(k,) for k in signed], "gram long")).collect()}
    for g, k in zip(grams, signed):
        for i, lang in enumerate(sorted(TEXTS)):
            assert math.isclose(found[k][i], max(math.log(plain(TEXTS[lang])(g)), language.FLOOR), rel_tol=1e-6), (g, lang)


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.predict(docs, language.learn(docs)).withColumn("held_out", language.held_out(F.col("doc_id")))
    both = found.join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    right, rejected, n = both.agg(F.sum(F.expr("int(lang = lang_pred)")), F.sum(F.expr("int(rejected)")), F.count("*")).first()
    assert right >= 0.98 * n and rejected == 0


def test_many_languages(spark):
    r = random.Random(12)
    rows = []
    for k in range(90):  # each has letters of its own
        letters = [chr(0x4E00 + 20 * k + j) for j in range(12)]
        rows += [(100 * k + i, "".join(r.choice(letters) for _ in range(60)), f"l{k:02d}") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.predict(docs, language.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    learned = docs.where(~language.held_out(F.col("doc_id"))).select("lang").distinct()
    assert learned.count() > 80 and found.join(learned, "lang").where("lang <> lang_pred").count() == 0


def test_languages_of_few_rows(spark, monkeypatch):
    """No language is lost to calibration, be its only row one that calibrates; texts of one letter are told apart."""
    monkeypatch.setattr(language, "CALIBRATION", 2)
    rows, r = [], random.Random(3)
    for k in range(40):  # one or two rows each, letters of their own
        letters = [chr(0x4E00 + 20 * k + j) for j in range(6)]
        rows += [(f"l{k:02d}", "".join(r.choice(letters) for _ in range(8)) + letters[0]) for _ in range(1 + k % 2)]
    learned = spark.createDataFrame(rows, "lang string, text string")
    asked = spark.createDataFrame([(i, chr(0x4E00 + 20 * i)) for i in range(40)] + [(100, "7 !"), (101, None), (102, "")], "doc_id long, text string")
    found = {x.doc_id: x for x in language.predict(asked, language.fit(learned)).collect()}
    assert [found[i].lang_pred for i in range(40)] == [f"l{i:02d}" for i in range(40)]
    assert all(0 < found[i].score <= 1 and found[i].cross_entropy > 0 for i in range(40))
    assert all(found[i].lang_pred == "und" and found[i].score == 0 and found[i].rejected for i in (100, 101, 102))


def test_only_rows_that_calibrate(spark, monkeypatch):
    monkeypatch.setattr(language, "CALIBRATION", 1)
    learned = spark.createDataFrame([("aa", "abc abc"), ("bb", "xyz zyx")], "lang string, text string")
    asked = spark.createDataFrame([(1, "abc"), (2, "zzy")], "doc_id long, text string")
    assert {x.doc_id: x.lang_pred for x in language.predict(asked, language.fit(learned)).collect()} == {1: "aa", 2: "bb"}
