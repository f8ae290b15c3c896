"""The training-data operators against brute force, on small tables with nulls, ties and odd texts."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from compare import of_duck, of_spark
from conftest import DATA
from docmill import llm
from docmill.llm import components, fingerprints, language, lines, mixing, near, packing, private, repeats, token_files, topk

ODD = [None, "", " ", "a", "  a  b\n\n c ", "it's. he'll, 3.5 a..", "é́a b", "x" * 3000, "word " * 900, "ẞ. İ, Σ.", "1.2.3.4 +1 (234) 555-0199 a@b.co"]
ODD += ["a<|endoftext|>b c", "<|endoftext|>", "x  <|startoftext|> <|ENDOFTEXT|>\n"]


def table(spark, texts, extra=True):
    """Rows with ids from 0; with a clashing and a foreign column."""
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, copy string, bucket int")


def texts(n=60, seed=1):
    """Random texts, some exact and some near copies of others, and passages that several share."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    sentence = lambda k: " ".join(r.choice(words) for _ in range(k))
    passages = [sentence(25) for _ in range(4)]
    made = []
    for _ in range(n):
        kind = r.random()
        if made and kind < 0.15:
            made.append(r.choice(made))
        elif made and kind < 0.4:
            w = r.choice(made).split(" ")
            for _ in range(r.randint(1, 4)):
                w[r.randrange(len(w))] = r.choice(words)
            made.append(" ".join(w))
        else:
            made.append("\n".join([sentence(r.randint(1, 60)), r.choice(passages), sentence(r.randint(1, 30))]))
    return made + ODD


def ids_of(name, texts_, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return [x.ids + [end] for x in tokenizer.encode_batch([t or "" for t in texts_], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(spark):
    given = texts()
    wanted = ids_of("word_bpe_49k.json", given, 1)
    found = packing.pack_documents(table(spark, given), public_tokenizers.path("word_bpe_49k.json")).collect()
    pieces = collections.defaultdict(list)
    for r in found:
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0
        pieces[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    assert sorted(r.sequence_id for r in found) == list(range(len(found)))
    batches = [r.length for r in sorted(found, key=lambda r: r.sequence_id)]
    assert batches == sorted(batches, reverse=True) and all(r.bucket == r.length for r in found)
    again = packing.pack_documents(table(spark, given).repartition(7), public_tokenizers.path("word_bpe_49k.json")).collect()
    where = lambda rows: {(r.doc_id, r.start, r.sequence_id) for r in rows}
    assert where(found) == where(again)
    for i, ids in enumerate(wanted):
        assert sum((p for _, p in sorted(pieces[i])), []) == ids
    assert packing.binary_lengths(5000, 2048) == [2048, 2048, 512, 256, 128, 8]


def test_token_files(spark):
    given = texts(seed=2)
    wanted = ids_of("byte_bpe_50k.json", given, 0)
    path = f"{token_files.shared_path(spark, 'test')}"
    token_files.write_tokens(token_files.encode_documents(table(spark, given), public_tokenizers.path("byte_bpe_50k.json")), path)
    found = token_files.digest(token_files.read_tokens(spark, path)).orderBy("doc_id").collect()
    starts = np.cumsum([0, *map(len, wanted)])
    assert [tuple(r) for r in found] == [(i, int(starts[i]), len(x), crc(x)) for i, x in enumerate(wanted)]


def test_language(spark):
    r = random.Random(3)
    speak = {"xx": "abcde ", "yy": "fghij ", "zz": "aeiou "}
    rows = [(i, "".join(r.choice(speak[l]) for _ in range(80)) + "a" * (l != "yy"), l) for i, l in enumerate(sorted(speak) * 30)]
    rows += [(100 + i, t, None) for i, t in enumerate([None, "", "123 !", "fghij hgf", "жщ ъь эю яы жщъ йцук"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs)
    found = {x.doc_id: x for x in language.predict(docs, model).collect()}
    assert all(found[i].lang_pred == l for i, _, l in rows[:90])
    assert [found[100 + i].lang_pred for i in range(3)] == ["und"] * 3 and found[103].lang_pred == "yy"
    assert found[104].rejected and not any(found[i].rejected for i in range(90))
    assert all(0 <= x.score <= 1 for x in found.values())
    assert {x.doc_id for x in language.predict(docs, model, keep=True).collect()} == set(found) - {100, 101, 102, 104}
    none = language.predict(docs, language.learn(docs.where("lang IS NULL")))
    assert none.where("lang_pred <> 'und'").count() == 0


def spans_of(text):
    def luhn(digits):
        total = 0
        for i, c in enumerate(reversed(digits)):
            d = int(c) * (1 + i % 2)
            total += d - 9 if d > 9 else d
        return total % 10 == 0

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v, d: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v, d: all(int(x) <= 255 for x in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v, d: 14 <= len(d) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v, d: 10 <= len(d) <= 15),
    }
    found = []
    for order, (kind, (pattern, good)) in enumerate(kinds.items()):
        for m in re.finditer(pattern, text):
            if good(m.group(), re.sub("[^0-9]", "", m.group())):
                found.append((m.start(), order, kind, m.end()))
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]


def test_private_base(spark):
    r = random.Random(4)
    parts = ["a", "b1", ".", "@", "-", "_", "1", "22", "+", "+1 ", " ", "(", "4242424242424242", "é", "192.168.0.1", "999.1.1.1", "a@b.c", "\n", "٣"]
    given = ["".join(r.choice(parts) for _ in range(r.randint(1, 30))) for _ in range(400)] + ODD + ["1" * 20000, "a@" * 5000, "a" * 50000]
    found = {x.doc_id: x for x in private.find_private(table(spark, given)).collect()}
    for i, text in enumerate(given):
        wanted = spans_of(text or "")
        assert found[i].base_sha256 == hashlib.sha256(",".join(wanted).encode()).hexdigest(), text
        assert found[i].n_email + found[i].n_ip + found[i].n_card + found[i].n_phone == len(wanted)
        assert [s for s in found[i].spans.split(",") if s.split(":")[0] in private.BASE] == wanted


def test_private_learns_patterns(spark):
    known = [f"note {i} customer phone: +1 (202) 555-01{i:02d} thanks" for i in range(10, 40)]
    unseen = ["our customer phone: 202-555-0177 thanks", "the year 2024 and sum 1,000"]
    clean = ["plain words only " * 5, "serial 99887766554 elsewhere"]
    found = [x.n_added for x in private.find_private(table(spark, known + unseen + clean)).orderBy("doc_id").collect()]
    assert found == [0] * len(known) + [1, 0, 0, 0]


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def test_lines(spark):
    given = texts(80, seed=5)
    where = collections.defaultdict(list)
    for d, text in enumerate(given):
        for i, line in enumerate((text or "").split("\n")):
            if line.strip():
                where[line].append((d, i))
    sets = {x: {x[i : i + 10] for i in range(max(1, len(x) - 9))} for x in where}
    parent = {x: x for x in where}
    for a in where:
        for b in where:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[find(parent, a)] = find(parent, b)
    groups = collections.defaultdict(list)
    for x in where:
        groups[find(parent, x)] += where[x]
    gone = {p for g in groups.values() for p in g if p != min(g)}
    found = {x.doc_id: x.text for x in lines.deduplicate_lines(table(spark, given)).collect()}
    for d, text in enumerate(given):
        wanted = text if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if (d, i) not in gone)
        assert found[d] == wanted


def test_near(spark):
    for words, seed in ((2, 6), (5, 7)):
        given = texts(90, seed=seed)
        sets = []
        for text in given:
            w = [x for x in re.split(r"[\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) if x]
            sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()})
        parent = {i: i for i in range(len(given))}
        for a in parent:
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    x, y = find(parent, a), find(parent, b)
                    parent[max(x, y)] = min(x, y)
        found = {r.doc_id: r for r in near.near_duplicates(table(spark, given), words).collect()}
        for i in parent:
            assert (found[i].n_shingles, found[i].component_id) == (len(sets[i]), find(parent, i))
            assert found[i].kept == (find(parent, i) == i)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}


def test_mixing(spark, duck):
    assert of_spark(mixing.op6_mixing(spark, DATA)) == of_duck(duck, mixing.OP6_SQL)
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 4 > 0, "big").alias("source"), F.lit(1).alias("copy"))
    found = mixing.mix_sources(docs, {"big": 1.0}, repetition=40.0)
    assert found.where("source IS NULL").count() == 0 and abs(found.count() / 80_000 - 1) < 0.02
    assert found.columns == ["doc_id", "text", "source", "copy", "shuffle_key"]


def test_topk(spark, duck):
    assert of_spark(topk.op7_topk(spark, DATA)) == of_duck(duck, topk.OP7_SQL)
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, None), (None, [1.0, 1.0]), (6, [-1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = topk.top_k(vectors, vectors.where("vec_id = 0"), k=2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(1, 1024 * 1024), (2, 1024 * 1024)]


def test_fingerprints(spark):
    given = texts(40, seed=8)
    found = {r.doc_id: r for r in fingerprints.compare_with_next(table(spark, given)).collect()}
    by_text = collections.defaultdict(set)
    for i, text in enumerate(given):
        text, following = text or "", given[i - 1] or ""
        changed = fingerprints.edited(text, following)
        assert found[i].n_chars == len(text) and found[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert found[i].fingerprint == fingerprints.fingerprint(text).tobytes().hex()
        assert found[i].near_next == fingerprints.likeness(fingerprints.fingerprint(text), fingerprints.fingerprint(following))
        by_text[text].add(found[i].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def plain_fingerprint(text):
    """Order MinHash one k-mer and one order at a time."""
    mask = (1 << 64) - 1

    def mixed(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    factor, size = int(fingerprints._FACTOR), min(fingerprints.KMER, len(text))
    seen, kmers, numbered = collections.Counter(), [], []
    for i in range(len(text) - size + 1 if text else 0):
        x = 0
        for c in text[i : i + size]:
            x = (x * factor + ord(c)) & mask
        kmers.append(mixed(x))
        numbered.append(mixed((kmers[-1] + seen[kmers[-1]] * factor) & mask))
        seen[kmers[-1]] += 1
    out = []
    for salt, odd in zip(fingerprints._SALTS.tolist(), fingerprints._ODDS.tolist()):
        least = sorted(range(len(numbered)), key=lambda i: ((numbered[i] >> 32) ^ salt) * odd & 0xFFFFFFFF)[: fingerprints.TUPLE]
        x = 0
        for i in sorted(least):
            x = mixed((x * factor + kmers[i]) & mask)
        out.append(x >> 48)
    return np.array(out if text else [], np.uint16).tobytes().hex()


def test_fingerprints_follow_the_definition():
    for text in ["", "a", "abcdefg", "aaaaaaaaaaaaaaaaaaaa", *[t for t in texts(8, seed=13) if t]]:
        assert fingerprints.fingerprint(text[:700]).tobytes().hex() == plain_fingerprint(text[:700])
    base = " ".join(str(i * 7919) for i in range(300))
    likes = [fingerprints.likeness(fingerprints.fingerprint(base), fingerprints.fingerprint(base[:k] + base[k:][::-1])) for k in (len(base), 1500, 1000, 500, 0)]
    assert likes[0] == 1 and likes == sorted(likes, reverse=True)


def test_repeats(spark):
    given = texts(60, seed=9) + ["a" * 1500, "ab" * 700, "a" * 99, "é" * 300]
    seen, found = set(), {r.doc_id: r for r in repeats.remove_repeats(table(spark, given)).collect()}
    for d, text in enumerate(given):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                gone[p : p + 100] = b"\x01" * 100
            seen.add(data[p : p + 100])
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        assert (found[d].n_bytes, found[d].n_removed, found[d].n_spans, bytes(found[d].kept)) == (len(data), sum(gone), runs, kept)


def operators():
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return {
        "packing": lambda d: packing.pack_documents(d, tokenizer),
        "token_files": lambda d: token_files.encode_documents(d, tokenizer, spaced=False),
        "language": lambda d: language.predict(d, language.learn(d)),
        "private": private.find_private,
        "lines": lines.deduplicate_lines,
        "mixing": mixing.mix_sources,
        "fingerprints": fingerprints.compare_with_next,
        "near": near.near_duplicates,
        "repeats": repeats.remove_repeats,
        "topk": lambda d: topk.top_k(d.select(F.col("doc_id").alias("vec_id"), F.array(F.length("text").cast("float")).alias("embedding"), "lang"), d.select(F.col("doc_id").alias("vec_id"), F.array(F.length("text").cast("float")).alias("embedding"))),
    }


@pytest.mark.parametrize("name", sorted(operators()))
def test_empty_and_null(spark, name):
    schema = "doc_id long, text string, lang string, source string"
    assert operators()[name](spark.createDataFrame([], schema)).count() == 0
    rows = [(None, None, None, None), (None, "some words here", "en", "a"), (1, "some words here", "en", None), (1, "some words here", "en", None)]
    found = operators()[name](spark.createDataFrame(rows, schema))
    assert found.count() >= {"mixing": 1, "topk": 0}.get(name, 4)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.materialize(stage(spark, docs, DATA), name)
        if name != "packing":
            assert docs.columns == before.columns
        if name in ("language", "lines", "near"):
            assert 0 < docs.count() <= before.count()
    assert docs.agg(F.sum("length")).first()[0] > 0
    assert set(llm.queries()) == {f"op{i}_{n}" for i, n in enumerate(
        ["packing", "token_files", "language", "private", "lines", "mixing", "topk", "fingerprints", "near", "repeats"], 1)}
