"""Identifiers that no expression describes, found by patterns that seeds induce."""

import random

from docmill.llm import private

WORDS = "harbour lantern meadow copper violet gentle thunder basket window marble silver garden".split()


def planted(seed=21):
    """Texts, and the strings in each that patterns should find. No seed stands beside "dossier"."""
    r = random.Random(seed)
    prose = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    rows = []
    for i in range(60):  # seeds: phones after "hotline", keys after "token"
        rows.append((f"{prose(20)} hotline: +1 (202) 555-{1000 + i} {prose(15)}", []))
        rows.append((f'{prose(20)} token = "{hexes(19)}4a" {prose(15)}', []))
    for i in range(40):  # short and lettered ones in the same places
        number, key = f"55{r.randint(100, 999)}", f"zk{r.randint(10, 99)}-q{r.randint(100, 999)}"
        rows.append((f"{prose(15)} hotline: {number} {prose(9)}", [number]))
        rows.append((f'{prose(15)} token = "{key}" {prose(9)}', [key]))
    for i in range(30):  # these stand in both places, and so make "dossier" known
        number = f"9{r.randint(10**6, 10**7 - 1)}"
        rows.append((f"{prose(9)} hotline: {number} {prose(9)} dossier {number} {prose(5)}", [number, number]))
    for i in range(30):  # a place that only the second round knows
        number = f"8{r.randint(10**6, 10**7 - 1)}"
        rows.append((f"{prose(9)} dossier {number} {prose(5)}", [number]))
    for i in range(100):  # numbers that are nobody's
        rows.append((f"{prose(10)} {r.choice(WORDS)} {r.randint(1000, 9999)} {prose(10)}", []))
    return rows


def test_recall_and_precision(spark):
    rows = planted()
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    found = {r.doc_id: r.spans for r in private.find_private(docs).collect()}
    right = wrong = 0
    for i, (text, wanted) in enumerate(rows):
        spans = [s.split(":") for s in found[i].split(",") if s.startswith("id:")]
        values = [text[int(a) : int(b)] for _, a, b in spans]
        right += sum(v in wanted for v in values)
        wrong += sum(v not in wanted for v in values)
    planned = sum(len(w) for _, w in rows)
    assert right >= 0.9 * planned and wrong <= 0.02 * max(right, 1), (right, wrong, planned)
