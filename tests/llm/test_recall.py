"""Short lines just alike enough share a band, and no sketch drops them."""

import random

import numpy as np

from docmill.llm import lines


def test_short_lines_meet():
    r = random.Random(11)
    n = 20000
    given = ["".join(r.choice("abcdefghijklmnop") for _ in range(lines.SHINGLE + 4)) for _ in range(n)]
    found = lines.Shingles([*given, *(x[:-1] for x in given)])  # 4 of 5 shingles
    bands, sketch = lines.signatures(found)
    assert (bands[:n] == bands[n:]).any(axis=1).all()
    entries = np.zeros(2 * n, lines._ENTRY)
    entries["a"], entries["b"] = sketch[:, 0], sketch[:, 1]
    assert lines._possible(entries[:n], entries[n:]).all()
