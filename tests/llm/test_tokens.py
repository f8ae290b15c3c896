"""Pieces of texts: each different core is looked up once, and ids are those of the whole text."""

import pyarrow as pa
import pytest
import public_tokenizers

from docmill.llm.tokens import PieceEncoder

TEXTS = ["Ab, ab. AB é. É, x1. -. . , a.. ²,  ٣. ª, é. \U00020000. 　, ß. İ. K. end", "", ".", "é", "a\n.b,\nc.", None]


@pytest.mark.parametrize("name, spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_ids_of_marked_pieces_are_those_of_whole_texts(name, spaced):
    encoder = PieceEncoder(public_tokenizers.path(name), spaced)
    for texts in (TEXTS, TEXTS[::-1]):  # the second time from what is kept
        ids, offsets = encoder.encode(pa.array(texts, pa.string()), 1)
        whole = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == whole


def test_pieces_with_the_same_core_share_its_number():
    encoder = PieceEncoder(public_tokenizers.path("word_bpe_49k.json"), False)
    cores, marks, new = encoder._numbers(pa.array(["Ab,", "ab.", "AB", "é.", "-.", "é"], pa.large_string()))
    assert cores[0] == cores[1] == cores[2] and cores[3] == cores[5] and list(new) == ["ab", "é", "-."]
    assert marks.tolist() == [encoder.marks[","], encoder.marks["."], -1, encoder.marks["."], -1, -1]
