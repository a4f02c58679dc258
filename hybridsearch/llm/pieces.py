"""Tokenizers over batches of texts, word by word.

The pre-tokenizers used here always cut before a single blank between two visible characters, around
a single line feed, and between a letter and ASCII punctuation that goes on to the end of the word.  A text whose
white space consists of such single blanks and line feeds only ("regular") is thus the sequence of its words, each with
the blank or line feed before it, and of such ends of words.  A batch of texts is encoded by encoding its distinct
words: Arrow numbers them, a table that a worker keeps has the ids of those it has met, and the ids are gathered by
numpy.  Any other text goes to the tokenizer as a whole.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of words, and a hundred for each, that a worker's table holds before it is emptied; bounds memory, not results.
TABLE_CHARS = 64 << 20
#: Bytes of texts whose distinct words are looked up at a time; one text is not divided.
BATCH_BYTES = 4 << 20
#: White space other than blank and line feed, in any of the tokenizers' definitions.
_OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# what a byte says: 1 a blank or line feed, 2 other white space, 3 perhaps the first of a character of white space
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[10, 32]] = 1
_KIND[[ord(c) for c in _OTHER_SPACE if c < "\x80"]] = 2
_KIND[sorted({c.encode()[0] for c in _OTHER_SPACE if c >= "\x80"})] = 3
_LETTER = np.array([65 <= b < 91 or 97 <= b < 123 for b in range(256)])
# the second byte of a Latin-1 letter whose first is 0xC3: all but the signs of multiplication and division
_LATIN = np.array([0x80 <= b < 0xC0 and b not in (0x97, 0xB7) for b in range(256)])
_PUNCTUATION = np.array([32 < b < 127 and not chr(b).isalnum() for b in range(256)])


def byte_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 bytes stand for themselves, the others are numbered from 256."""
    visible = {b for lo, hi in (("!", "~"), ("\xa1", "\xac"), ("\xae", "\xff")) for b in range(ord(lo), ord(hi) + 1)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0, and the bytes, of a large_string array without nulls."""
    offsets = np.frombuffer(strings.buffers()[1], dtype=np.int64)[strings.offset : strings.offset + len(strings) + 1]
    if not len(strings) or offsets[-1] == offsets[0]:
        return np.zeros(len(strings) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    return offsets - offsets[0], np.frombuffer(strings.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]


def regular(texts: pa.Array) -> np.ndarray:
    """Whether all white space of each of ``texts`` is single blanks or line feeds between visible characters; not so if it is empty."""
    offsets, data = _buffers(texts)
    out = np.diff(offsets) > 0
    if not out.any():
        return out
    row_of = lambda at: np.searchsorted(offsets, at, side="right") - 1
    kind = _KIND[data]
    gap = kind == 1
    pairs = np.flatnonzero(gap[1:] & gap[:-1])
    out[row_of(pairs)] = False
    out[row_of(np.flatnonzero(kind == 2))] = False
    some = np.flatnonzero(out)
    out[some] = ~(gap[offsets[some]] | gap[offsets[some + 1] - 1])
    for row in np.unique(row_of(np.flatnonzero(kind == 3))):
        if out[row]:
            text = texts[int(row)].as_py()
            out[row] = not any(c in text for c in _OTHER_SPACE)
    return out


class WordTable:
    """Pieces (a word with the blank or line feed before it, if there is one, or the punctuation at a word's end) and their ids.

    ``encode`` gives (ids in a piece, ids of all) for a list of pieces.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = TABLE_CHARS):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.held = self.n = 0
        self.start, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.store = np.zeros(0, dtype=np.int32)

    def _learn(self, pieces: list[bytes]) -> None:
        size, ids = self.encode([p.decode() for p in pieces])
        if self.n + len(ids) > len(self.store):
            self.store = np.concatenate([self.store[: self.n], np.zeros(max(len(ids), self.n) + len(ids), dtype=np.int32)])
        self.store[self.n : self.n + len(ids)] = ids
        known = len(self.slots)
        self.start = np.concatenate([self.start, self.n + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.slots.update(zip(pieces, range(known, known + len(pieces)), strict=True))
        self.n += len(ids)
        self.held += sum(map(len, pieces)) + 100 * len(pieces)

    def _slots(self, pieces: list[bytes]) -> np.ndarray:
        if self.held > self.most:
            self.clear()
        found = list(map(self.slots.get, pieces))
        if new := [p for p, slot in zip(pieces, found, strict=True) if slot is None]:
            self._learn(new)
            found = list(map(self.slots.__getitem__, pieces))
        return np.array(found, dtype=np.int64)

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(first piece by text and the number of all, slot by piece) of regular texts, or parts of them that begin with a blank or line feed."""
        offsets, data = _buffers(texts)
        begin = _KIND[data] == 1
        begin[offsets[:-1]] = True
        end = np.append(begin[1:], True)
        # runs of punctuation, from the first to the last byte
        marks = _PUNCTUATION[data]
        within = marks[1:] & ~begin[1:]
        first = np.flatnonzero(marks & np.concatenate([[True], ~(within & marks[:-1])]))
        last = np.flatnonzero(marks & np.append(~(within & marks[:-1]), True))
        before = data[np.maximum(first - 1, 0)]
        after_letter = _LETTER[before] | (_LATIN[before] & (data[np.maximum(first - 2, 0)] == 0xC3))
        begin[first[end[last] & after_letter & ~begin[first]]] = True
        bounds = np.append(np.flatnonzero(begin), len(data))
        coded = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
        own, letters = (x.tobytes() if x.dtype == np.uint8 else x.tolist() for x in _buffers(coded.dictionary))
        distinct = [letters[a:b] for a, b in zip(own, own[1:])]
        return np.searchsorted(bounds, offsets), self._slots(distinct)[coded.indices.to_numpy()]

    def sizes(self, texts: pa.Array) -> np.ndarray:
        """Ids in each text."""
        first, slots = self._pieces(texts)
        total = np.concatenate([[0], np.cumsum(self.size[slots])])
        return total[first[1:]] - total[first[:-1]]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(first id by text and the number of all, ids of all)."""
        first, slots = self._pieces(texts)
        size = self.size[slots]
        total = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.start[slots] - total[:-1], size) + np.arange(total[-1])
        return total[first], self.store[at]


class Batches:
    """Ids or counts of whole texts: regular ones by a table of words, others, and those with one of ``special`` in them, by ``whole``.

    ``whole`` gives one text's ids; ``cut=False`` gives all texts to it.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], whole: Callable[[str], Iterable[int]], special: Iterable[str] = (), cut: bool = True):
        self.table, self.whole, self.special, self.cut = WordTable(encode), whole, tuple(special), cut

    def by_words(self, texts: pa.Array) -> np.ndarray:
        """Which texts the table serves."""
        if not self.cut:
            return np.zeros(len(texts), dtype=bool)
        out = regular(texts)
        for s in self.special:
            out &= ~pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        return out

    def sizes(self, texts: pa.Array) -> np.ndarray:
        """Ids in each of ``texts`` (large_string, no nulls)."""
        some = self.by_words(texts)
        out = np.zeros(len(texts), dtype=np.int64)
        if some.any():
            out[some] = self.table.sizes(texts.filter(pa.array(some)))
        for i in np.flatnonzero(~some):
            out[i] = len(self.whole(text)) if (text := texts[int(i)].as_py()) else 0
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(first id by text and the number of all, ids of all)."""
        some = self.by_words(texts)
        if some.all() and len(some):
            return self.table.ids(texts)
        first, ids = self.table.ids(texts.filter(pa.array(some))) if some.any() else (np.zeros(1, np.int64), np.zeros(0, np.int32))
        parts, k = [], 0
        for i, by_words in enumerate(some):
            if by_words:
                parts.append(ids[first[k] : first[k + 1]])
                k += 1
            else:
                text = texts[i].as_py()
                parts.append(np.array(self.whole(text) if text else [], dtype=np.int32))
        return np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64), np.concatenate(parts) if parts else ids


class Library:
    """The tokenizers library's ids, without added special tokens, truncation or padding.

    Latin words are given to the file's model directly, in the form that its normalizer and pre-tokenizer make of them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = tuple(t["content"] for t in spec["added_tokens"])
        norm, pre, model = spec["normalizer"], spec["pre_tokenizer"], spec["model"]
        keeps_space = norm is None and pre == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        steps = [p["type"] for p in pre.get("pretokenizers", [])]
        #: whether the normalizer makes runs of white space one blank, which the pre-tokenizer drops
        self.folds_space = norm is not None and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and steps == ["Split", "ByteLevel"]
        #: whether texts may be cut into words at all
        self.cut = keeps_space or self.folds_space
        sign = {b: c for c, b in byte_chars().items()}
        self.stand_ins = {b: sign[b] for b in range(128, 256)}
        self.model, self.blank = self.tok.model, sign[32]
        self.newline = model["vocab"].get(sign[10])

    def whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a piece, ids of all)."""
        found = [self._ids(p) for p in pieces]
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return size, np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(size.sum()))

    def _ids(self, piece: str) -> list[int]:
        before = piece[0] if piece[0] in " \n" else ""
        word = piece[len(before) :]
        if not (self.cut and word.isalpha() and (word.isascii() or max(word) < "\u0100")):
            return self.whole(piece)
        if self.folds_space:
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.stand_ins)
        if before == " " and not self.folds_space:
            word = self.blank + word
        ids = [t.id for t in self.model.tokenize(word)]
        return [self.newline, *ids] if before == "\n" and not self.folds_space else ids
