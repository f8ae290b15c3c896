"""Token ids of whole texts by public tokenizers, for many texts at a time.

A text is cut where a word can end whatever follows, each different piece is encoded once by the
``tokenizers`` library, and the ids of the pieces are gathered. The ids are those that the library
gives for the whole text, as it is set up in its file: the string of a special token is that token. A
bounded number of bytes of pieces and ids is kept by each Python worker.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from docmill.llm.common import at_partition_end, utf8_buffers

#: Bytes of pieces and their ids that a worker keeps; a piece takes some 180 bytes beside its text.
KEPT_BYTES, PIECE_BYTES = 48 << 20, 180
#: Longest piece that is kept; scripts without spaces make whole lines into pieces.
KEPT_LENGTH = 64

#: Two white-space characters in a row, for which a cut before a space isn't safe.
_WIDE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]{2}|[\x00\x01]"
#: Bytes: 1 for white space, 4 for what else needs a closer look.
_BYTES = np.zeros(256, np.uint8)
_BYTES[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = 1
_BYTES[[0, 1, 0xC2, 0xE1, 0xE2, 0xE3]] = 4
#: Bytes of letters and digits.
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
#: Words that go to the library as one text.
_JOINED = 500


def _has_wide_space(texts: pa.Array) -> np.ndarray:
    """Texts that ``_WIDE`` matches; most are told by their bytes."""
    data, offsets = utf8_buffers(texts)
    kinds = _BYTES[data]
    near = np.flatnonzero((kinds[1:] & kinds[:-1] & 1) | (kinds[1:] & 4)) + 1
    near = np.append(near, [0] if len(kinds) and kinds[0] else [])
    found = np.zeros(len(texts), bool)
    likely = np.unique(np.searchsorted(offsets, near.astype(np.int64), side="right") - 1)
    found[likely] = pc.match_substring_regex(texts.take(pa.array(likely)), _WIDE).to_numpy(zero_copy_only=False)
    return found


class PieceEncoder:
    """Encodes batches of texts. ``spaced``: white space counts (byte-level BPE), else it is dropped.

    Ids of pieces lie in one array. ``where`` has each kept piece's number, ``begin`` and ``size`` its
    ids by number. What is beyond ``most`` bytes is forgotten after its batch, and so are the ids of
    texts that are encoded as they are.
    """

    def __init__(self, path: str, spaced: bool, most: int = KEPT_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced, self.most, self.kept = spaced, most, 0
        special = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.special = "|".join(re.escape(t) for t in special if t)  # a text that holds one goes whole
        vocabulary = self.tokenizer.get_vocab()
        self.bound = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that begin, or end, a word
        for token, i in vocabulary.items():
            self.bound[i] = token.startswith("\u0120") if spaced else token.endswith("</w>")
        self.where: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.begin, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.count = self.used = 0
        self.marks = {c: self._add([np.array(self._encode([c])[0], np.uint32)]) for c in ".,"}

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, found: list[np.ndarray]) -> int:
        """Append the ids of pieces; the number of the first one."""
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return self._append(np.concatenate([*found, np.zeros(0, np.uint32)]), sizes)

    def _append(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        grown = lambda x, n: x if n <= len(x) else np.concatenate([x, np.zeros(max(n, len(x)), x.dtype)])
        first, end, used = self.count, self.count + len(sizes), self.used + len(ids)
        self.ids, self.begin, self.size = grown(self.ids, used), grown(self.begin, end), grown(self.size, end)
        self.ids[self.used : used] = ids
        self.size[first:end] = sizes
        self.begin[first:end] = self.used + np.cumsum(sizes) - sizes
        self.count, self.used = end, used
        return first

    def _raw(self, piece: str) -> str:
        if not self.spaced:
            return piece
        return "\n" + piece[1:] if piece[:1] == "\x00" else piece[1:] if piece[:1] == "\x01" else " " + piece

    def _learn(self, pieces: list[str]) -> dict[str, int]:
        """Encode pieces and number them. Words of letters go many at a time, parted by their bounds."""
        words = [p for p in pieces if p.isalpha()]
        others = [p for p in pieces if not p.isalpha()]
        groups = [words[i : i + _JOINED] for i in range(0, len(words), _JOINED)]
        space = " " if self.spaced else ""
        numbers: dict[str, int] = {}
        for at in range(0, len(groups), 20):
            part = groups[at : at + 20]
            for group, ids in zip(part, self._encode([space + " ".join(g) for g in part])):
                ids = np.array(ids, np.uint32)
                bounds = np.flatnonzero(self.bound[ids])
                if len(bounds) != len(group):
                    others += group
                    continue
                ends = np.append(bounds[1:], len(ids)) if self.spaced else bounds + 1
                first = self._append(ids, np.diff(ends, prepend=0))
                numbers.update(zip(group, range(first, first + len(group))))
        for at in range(0, len(others), 5000):
            part = others[at : at + 5000]
            first = self._add([np.array(x, np.uint32) for x in self._encode([self._raw(p) for p in part])])
            numbers.update(zip(part, range(first, first + len(part))))
        return numbers

    def _numbers(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
        """Of each piece the number of its core, and that of the mark at its end or -1; new cores.

        A mark after a letter or digit is a word of its own. Each different core is looked up once.
        """
        data, offsets = utf8_buffers(pieces)
        ends = offsets[1:][np.diff(offsets) > 1]
        last, before = np.zeros(len(pieces), np.uint8), np.zeros(len(pieces), np.uint8)
        last[np.diff(offsets) > 1], before[np.diff(offsets) > 1] = data[ends - 1], data[ends - 2]
        marks = np.full(len(pieces), -1, np.int64)
        for mark, number in self.marks.items():
            own = last == ord(mark)
            marks[own & _ALNUM[before]] = number
            other = np.flatnonzero(own & (before > 127))  # which of these are letters, Python tells
            letters = [p[-2].lower()[-1:].isalnum() for p in pieces.take(pa.array(other)).to_pylist()]
            marks[other[np.array(letters, bool)]] = number
        cores = pc.if_else(pa.array(marks >= 0), pc.utf8_slice_codeunits(pieces, 0, -1), pieces)
        if not self.spaced:
            cores = pc.if_else(pc.string_is_ascii(cores), pc.ascii_lower(cores), cores)
        cores = cores.dictionary_encode()
        different = cores.dictionary.to_numpy(zero_copy_only=False).tolist()
        where = self.where
        new = self._learn([c for c in different if c not in where])
        where.update(new)
        found = np.fromiter(map(where.__getitem__, different), np.int64, len(different))
        return found[cores.indices.to_numpy(zero_copy_only=False)], marks, new

    def _forget(self, new: dict[str, int], count: int, used: int) -> None:
        """Keep the batch's new pieces if there is room for all of them, else none of it."""
        for piece in [p for p in new if len(p) > KEPT_LENGTH]:
            del new[piece], self.where[piece]
        grown = self.kept + sum(map(len, new)) + PIECE_BYTES * len(new)
        if grown <= self.most:
            end = max(new.values(), default=count - 1) + 1
            self.kept, self.count, self.used = grown, end, int(self.begin[end - 1] + self.size[end - 1])
        else:
            for piece in new:
                del self.where[piece]
            self.count, self.used = count, used
        if len(self.ids) > 4 * max(self.used, 1 << 16):  # a wide batch stretched the arrays
            self.ids = self.ids[: max(self.used, 1 << 16)].copy()

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each text closed by ``end_id``, and the offset of each text."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        wide = np.zeros(len(texts), bool)
        if self.special:
            wide = pc.match_substring_regex(texts, self.special).to_numpy(zero_copy_only=False)
        if self.spaced:
            wide = wide | _has_wide_space(texts)
            cut = pc.replace_substring(texts, "\n", " \x00")
            cut = pc.binary_join_element_wise(pa.scalar("\x01", pa.large_string()), cut, pa.scalar("", pa.large_string()))
        else:
            cut = pc.replace_substring(texts, "\n", " ")
        if wide.any():  # those are encoded as they are
            cut = pc.if_else(pa.array(wide), pa.scalar("\x01" if self.spaced else "", pa.large_string()), cut)
        words = pc.split_pattern(cut, " ")
        offsets = words.offsets.to_numpy().astype(np.int64)
        flat = pc.dictionary_encode(words.flatten())
        codes = flat.indices.to_numpy(zero_copy_only=False)
        count, used = self.count, self.used
        cores, marks, new = self._numbers(flat.dictionary)
        whole = np.flatnonzero(wide)
        cores = np.concatenate([cores, [self._add([np.array([end_id], np.uint32)])]])
        if len(whole):
            first = self._add([np.array(x, np.uint32) for x in self._encode([texts[int(i)].as_py() for i in whole])])
            codes = codes.copy()
            codes[offsets[whole]] = np.arange(len(cores), len(cores) + len(whole))
            cores = np.concatenate([cores, np.arange(first, first + len(whole))])
        marks = np.concatenate([marks, np.full(len(cores) - len(marks), -1)])
        numbers = np.stack([cores, marks], axis=1).ravel()
        sizes = np.where(numbers < 0, 0, self.size[numbers])
        ids = self.ids[_ranges(self.begin[numbers], sizes)]  # of each different piece
        sizes = sizes[::2] + sizes[1::2]
        begin = np.cumsum(sizes) - sizes
        self._forget(new, count, used)
        end = len(flat.dictionary)
        parts, ends = [], [np.zeros(1, np.int64)]
        for at in range(0, len(texts), _ROWS):  # small arrays stay in the processor's cache
            rows = offsets[at : at + _ROWS + 1]
            own = np.insert(codes[rows[0] : rows[-1]], rows[1:] - rows[0], end)
            size = sizes[own]
            parts.append(ids[_ranges(begin[own], size)])
            last = rows[1:] - rows[0] + np.arange(1, len(rows))
            ends.append(ends[-1][-1] + np.concatenate([[0], np.cumsum(size)])[last])
        return np.concatenate([*parts, np.zeros(0, np.uint32)]), np.concatenate(ends)


#: Texts whose ids are gathered at a time.
_ROWS = 200


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin .. begin + size - 1 of each range, in a row."""
    ends = np.cumsum(size)
    places = np.repeat(begin - (ends - size), size)
    places += np.arange(len(places))
    return places


_encoders: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, spaced: bool) -> PieceEncoder:
    """The encoder of a Python worker: one at a time, dropped by another vocabulary or ``drop_encoders``."""
    if (path, spaced) not in _encoders:
        _encoders.clear()
        _encoders[path, spaced] = PieceEncoder(path, spaced)
    return _encoders[path, spaced]


@at_partition_end
def drop_encoders() -> None:
    _encoders.clear()
