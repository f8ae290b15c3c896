"""The audit of sources against brute force."""

import collections
import random
import re

import pytest

from compare import of_duck, of_spark
from conftest import DATA
from docmill.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int"


def test_against_sql(spark, duck):
    assert of_spark(divergence.op12_divergence(spark, DATA)) == of_duck(duck, divergence.OP12_SQL)


def plain(rows, least, top):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    df, count, groups = collections.Counter(), collections.Counter(), set()
    for _, text, lang, source, *_ in rows:
        groups.add((lang or "", source or ""))
        for w in set(words(text)):
            df[lang or "", w] += 1
        for w in words(text):
            count[lang or "", source or "", w] += 1
    kept = collections.defaultdict(list)
    for (lang, w), n in df.items():
        if n >= least:
            kept[lang].append(w)
    share = lambda c, n, v: 1 + 10**9 * (c + 1) // (n + v)
    f = lambda p, q: (p - q) ** 2 // q
    p, out = {}, []
    for lang, source in groups:
        n, v = sum(count[lang, source, w] for w in kept[lang]), len(kept[lang])
        p[lang, source] = {w: share(count[lang, source, w], n, v) for w in kept[lang]}
    for lang, source in groups:
        all_n = sum(count[lang, s, w] for l, s in groups if l == lang for w in kept[lang])
        q = {w: share(sum(count[lang, s, w] for l, s in groups if l == lang), all_n, len(kept[lang])) for w in kept[lang]}
        pairs = [(-sum(f(p[lang, source][w], p[lang, s][w]) for w in kept[lang]), s) for l, s in groups if l == lang and s != source]
        terms = [(-f(x, q[w]), w) for w, x in p[lang, source].items() if x > q[w] and count[lang, source, w]]
        for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
            out += [(lang, source, part, item, -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def given():
    r = random.Random(5)
    words = ["".join(r.choice("abcdeÉéß") for _ in range(r.randint(1, 4))) for _ in range(120)] + ["A", "ǅ", "日本", "Z" * 5000]
    rows = []
    for i in range(300):
        lang = r.choice(["en", "de", None, "En"])
        source = r.choice(["s1", "s2", "s3", "", None, "é", "hot", "hot", "hot"])
        text = "".join(r.choice(words) + r.choice([" ", "  ", ", ", "\n", "1", "\0", "'", "_"]) for _ in range(r.randint(0, 60)))
        rows.append((i, text, lang, source))
    rows += [(400, None, "en", "bare"), (401, "", "xx", "a"), (402, "1 2", "xx", "b"), (403, "solo solo", "one", "a"), (404, "w " * 40_000, "en", "hot")]
    rows += [rows[3]] * 5 + [(None, "a b a", None, None)] * 3
    return [(*x, "clash", 1) for x in rows]


@pytest.mark.parametrize(("parts", "limits"), [(1, {}), (3, {"BLOCK_BYTES": 3000, "PIECE_BYTES": 50, "HELD": 100, "PAIRS": 50, "GATHERED": 40})])
def test_against_brute_force(spark, monkeypatch, parts, limits):
    for name, value in limits.items():
        monkeypatch.setattr(divergence, name, value)
    docs = spark.createDataFrame(given(), SCHEMA).repartition(parts)
    found = sorted(tuple(r) for r in divergence.audit(docs, top=7).collect())
    assert found == plain(given(), 3, 7)


def test_empty(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pieces_cut_at_delimiters(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE_BYTES", 3)
    text = "One, tWo  three-FOUR é".encode()
    assert b"".join(divergence.pieces(text)).split() == text.translate(divergence._BYTES).split() == [b"one", b"two", b"three", b"four", "é".encode()]
