"""Byte-pair encoding as a transducer with bounded lookahead, and its inverse.

A merge list fixes how far to the right a token's fate can depend on its context.  Let ``reach(x)`` be the
bytes right of a token ``x`` that can decide whether ``x`` stands.  In merge order, for a rule
``x + y -> z``: ``x`` depends on ``y`` and on what ``y`` depended on so far, and ``z`` inherits what ``y``
depended on when it was formed.  Rules only depend on earlier rules, so one pass over the list gives
all reaches, and the largest is a sufficient lookahead: with that many bytes known behind a token's
end, no continuation can change it (:func:`sufficient_lookahead`).

:class:`TextStream` takes a text in portions and gives its ids in portions, as they settle.  What it holds is bounded
whatever the text: the end of a portion that the next one may change, and an open pre-token's pending bytes.
Every pre-token's ids come from a :class:`Transducer`, which takes the bytes in any portions, emits each token once it
is stable, and holds back ``lookahead`` plus one longest token.  Transitions over whole words are kept in a table, so that
a worker computes each of them once.  :class:`Decoder` turns tokens' bytes into text as they come, holding back an
unfinished character only.

Cases: a null text is an empty one (no ids); ids that the vocabulary lacks raise an error; each row gives one row, whatever
its ``doc_id``; a text of any length is worked on in portions; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import map_batches
from .pieces import BATCH_BYTES, Batches, byte_chars, regular
from .words import slices

# The pre-tokenizer's pattern, with its definition of white space written out.
_S = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_N = _S.replace("[", "[^", 1)
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?(?:(?!\p{{L}}|\p{{N}}){_N})+|{_S}+(?!{_N})|{_S}+"
# what a pre-token that does not end can go on with: letters, digits, other visible characters, white space
_RUNS = [regex.compile(p) for p in (r"\p{L}+", r"\p{N}+", rf"(?:(?!\p{{L}}|\p{{N}}){_N})+", rf"{_S}+")]
_SPACES = _RUNS[-1]
#: Bytes of a pre-token that are merged at a time, besides the lookahead.
WINDOW = 1024
#: Characters of a text that are taken at a time.
PORTION = 1 << 16
#: Characters of a pre-token whose end is not in sight that are waited for before it goes to the transducer in parts.
OPEN = 4096
#: Ids are packed in so many bits.
_BITS = 20
_MASK, _NONE = (1 << _BITS) - 1, 1 << 62


def sufficient_lookahead(rules: Iterable[tuple[bytes, bytes]]) -> int:
    """Bytes behind a token's end that settle it, whatever follows them; ``rules`` in merge order."""
    reach: dict[bytes, int] = {}
    most = 0
    for left, right in rules:
        beyond = reach.get(right, 0)
        reach[left] = max(reach.get(left, 0), len(right) + beyond)
        reach[left + right] = max(reach.get(left + right, 0), beyond)
        most = max(most, reach[left], beyond)
    return most


class Merges:
    """A merge list: ids, ranks and the lookahead derived from them.  ``vocab`` has the bytes and the rules' results."""

    def __init__(self, vocab: dict[bytes, int], rules: list[tuple[bytes, bytes]], special: dict[str, int]):
        self.special = special
        self.bytes_of = {i: t for t, i in vocab.items()} | {i: s.encode() for s, i in special.items()}
        self.byte_id = [vocab.get(bytes([b]), -1) for b in range(256)]
        # pair of ids -> rank and merged id, each packed into one integer
        self.rules = {vocab[a] << _BITS | vocab[b]: k << _BITS | vocab[a + b] for k, (a, b) in enumerate(rules)}
        self.lookahead = sufficient_lookahead(rules)
        self.longest = max(map(len, self.bytes_of.values()))

    @staticmethod
    def of(rules: list[tuple[bytes, bytes]]) -> Merges:
        """A list of its own, without a vocabulary file."""
        tokens = [bytes([b]) for b in range(256)] + [a + b for a, b in rules]
        return Merges({t: i for i, t in enumerate(tokens)}, rules, {})

    @staticmethod
    def read(path: str) -> Merges:
        """A vocabulary file's merge list."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        as_byte, special = byte_chars(), {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = lambda token: bytes(as_byte[c] for c in token)
        rules = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        return Merges({raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}, [(raw(a), raw(b)) for a, b in rules], special)

    def merge(self, data: bytes) -> list[int]:
        """Apply the rules, lowest rank first and leftmost among equals, to a bounded run of bytes."""
        ids = [self.byte_id[b] for b in data]
        if len(ids) > 48:
            return self._merge_long(ids)
        rule = self.rules.get
        found = [rule(a << _BITS | b, _NONE) for a, b in zip(ids, ids[1:])]
        while found and (best := min(found)) != _NONE:
            i, new = found.index(best), best & _MASK
            ids[i] = new
            del ids[i + 1], found[i]
            if i:
                found[i - 1] = rule(ids[i - 1] << _BITS | new, _NONE)
            if i < len(found):
                found[i] = rule(new << _BITS | ids[i + 1], _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and links."""
        rules, n = self.rules, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := rules.get(a << _BITS | b)) is not None]
        heapq.heapify(heap)
        while heap:
            rule, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            new = rule & _MASK
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rules.get(new << _BITS | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, new, ids[k]))
            if (h := before[i]) >= 0 and (r := rules.get(ids[h] << _BITS | new)) is not None:
                heapq.heappush(heap, (r, h, ids[h], new))
        return [i for i in ids if i >= 0]


class Transducer:
    """Tokens of one pre-token whose bytes come in portions."""

    def __init__(self, merges: Merges, window: int = WINDOW):
        self.merges, self.pending = merges, b""
        self.most = window + merges.lookahead + merges.longest

    def push(self, data: bytes) -> Iterator[int]:
        """Take more bytes; emit the tokens that have become stable."""
        for lo in range(0, len(data), self.most):
            self.pending += data[lo : lo + self.most]
            if len(self.pending) >= self.most:
                stable, done = len(self.pending) - self.merges.lookahead, 0
                for token in self.merges.merge(self.pending):
                    end = done + len(self.merges.bytes_of[token])
                    if end > stable:
                        break
                    yield token
                    done = end
                self.pending = self.pending[done:]

    def close(self) -> Iterator[int]:
        """The end of the pre-token: what is pending is final."""
        yield from self.merges.merge(self.pending)
        self.pending = b""

    def all(self, data: bytes) -> Iterator[int]:
        """A pre-token that is there as a whole."""
        yield from self.push(data)
        yield from self.close()


class Decoder:
    """Text of tokens' bytes, character by character as soon as it is complete; bad bytes become U+FFFD."""

    def __init__(self):
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, data: bytes) -> str:
        return self.state.decode(data)

    def close(self) -> str:
        return self.state.decode(b"", True)


class TextStream:
    """Ids of one text that comes in portions."""

    def __init__(self, coder: ByteBPE):
        self.coder, self.rest, self.run, self.kind, self.begun = coder, "", None, None, False

    def held(self) -> int:
        """Characters and bytes that wait for more text."""
        return len(self.rest) + (len(self.run.pending) if self.run else 0)

    def push(self, portion: str, last: bool = False) -> Iterator[np.ndarray]:
        """Take more text; ids that nothing to come can change."""
        self.rest += portion
        if not self.run and not last:
            # up to the last white space between words, where a pre-token ends in any case
            at = max(self.rest.rfind(" "), self.rest.rfind("\n"))
            if at > 0 and (ids := self.coder.by_words(self.rest[:at])) is not None:
                self.rest = self.rest[at:]
                yield ids
                return
        elif not self.run and (ids := self.coder.by_words(self.rest)) is not None:
            self.rest = ""
            yield ids
            return
        yield from self._push(last)

    def _push(self, last: bool) -> Iterator[np.ndarray]:
        text, at = self.rest, 0
        found: list[int] = []
        for special in self.coder.special.finditer(text) if self.coder.special else ():
            yield from self._segment(text[at : special.start()], True, found)
            found.append(self.coder.merges.special[special[0]])
            at = special.end()
        # the end may be the beginning of a special token
        keep = 0 if last else max((k for s in self.coder.merges.special for k in range(1, len(s)) if text.endswith(s[:k], at)), default=0)
        body = len(text) - keep
        rest = yield from self._segment(text[at:body], last, found)
        self.rest = rest + text[body:]
        if found:
            yield np.array(found, dtype=np.int32)

    def _segment(self, text: str, last: bool, found: list[int]) -> Iterator[np.ndarray]:
        """Pre-tokens of a part of the text without special tokens; returns what its continuation may change."""
        at = 0
        if self.run:
            matched = self.kind.match(text)
            end = matched.end() if matched else 0
            if end == len(text) and not last:
                return (yield from self._go_on(text))
            if self.kind is _SPACES and end < len(text):
                end -= 1  # the last blank belongs to the next word
            yield from self._tokens(self.run.push(text[:end].encode()))
            yield from self._tokens(self.run.close())
            self.run, at = None, end
        for matched in self.coder.pattern.finditer(text, at):
            begin, end = matched.span()
            if last or (end < len(text) and begin + 3 <= len(text)):
                if end - begin <= OPEN:
                    found += self.coder.pre_token(matched[0])
                else:
                    yield np.array(found, dtype=np.int32)
                    found.clear()
                    yield from self._tokens(Transducer(self.coder.merges).all(matched[0].encode()))
            elif end - begin <= OPEN:
                return text[begin:]
            else:
                yield np.array(found, dtype=np.int32)
                found.clear()
                self.run, self.kind = Transducer(self.coder.merges), next(k for k in _RUNS if k.match(text, end - 1))
                return (yield from self._go_on(text[begin:]))
        return ""

    def _go_on(self, text: str) -> Iterator[np.ndarray]:
        """All of ``text`` belongs to the open pre-token, but the last of several blanks may belong to the next."""
        held = text[-1:] if self.kind is _SPACES else ""
        yield from self._tokens(self.run.push(text[: len(text) - len(held)].encode()))
        return held

    def _tokens(self, tokens: Iterator[int]) -> Iterator[np.ndarray]:
        while len(some := np.fromiter(islice(tokens, PORTION), dtype=np.int32)):
            yield some


class ByteBPE:
    """Encoder and decoder of one vocabulary file; equal to the tokenizers library's results without added tokens."""

    def __init__(self, path: str):
        self.merges = Merges.read(path)
        self.pattern = regex.compile(PATTERN)
        found = "|".join(map(regex.escape, sorted(self.merges.special, key=len, reverse=True)))
        self.special = regex.compile(found) if found else None
        self.batches = Batches(self._pieces, self.whole, self.merges.special)
        n = 1 + max(self.merges.bytes_of)
        self.bytes_of = pa.array([self.merges.bytes_of.get(i) for i in range(n)], type=pa.large_binary())
        self.decimals = pa.array([f",{i}".encode() for i in range(n)], type=pa.large_binary())

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [[i for t in self.pattern.findall(p) for i in Transducer(self.merges).all(t.encode())] for p in pieces]
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return size, np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(size.sum()))

    def pre_token(self, text: str) -> list[int]:
        return list(Transducer(self.merges).all(text.encode()))

    def by_words(self, text: str) -> np.ndarray | None:
        """Ids of a part of a text that begins and ends where pre-tokens do, if it is regular and has no special token; else None."""
        if not text or any(s in text for s in self.merges.special):
            return None
        wide = lambda t: pa.array([t], type=pa.large_string())
        return self.batches.table.ids(wide(text))[1] if regular(wide(text[text[0] in " \n" :]))[0] else None

    def stream(self, portions: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids, in portions, of a text that comes in portions."""
        state = TextStream(self)
        for portion in portions:
            yield from state.push(portion)
        yield from state.push("", last=True)

    def whole(self, text: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, dtype=np.int32), *self.stream(text[lo : lo + PORTION] for lo in range(0, len(text), PORTION))])

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        first, ids = self.batches.ids(pa.array(texts, type=pa.large_string()))
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield ids[a:b].tolist()

    def _joined(self, table: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, memoryview]:
        """(first byte by id and the number of all, bytes of all)."""
        taken = table.take(pa.array(ids))
        if taken.null_count:
            raise ValueError("there is an id that the vocabulary lacks")
        offsets = np.frombuffer(taken.buffers()[1], dtype=np.int64)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, dtype=np.int64)
        return offsets, memoryview(taken.buffers()[2] or b"")

    def decode(self, ids: Iterable[int], step: int = 4096) -> Iterator[str]:
        """Portions of the text; their concatenation is the whole."""
        state, ids = Decoder(), np.asarray(ids, dtype=np.int32)
        for lo in range(0, len(ids), step):
            offsets, data = self._joined(self.bytes_of, ids[lo : lo + step])
            yield state.push(data[offsets[0] : offsets[-1]])
        yield state.close()

    def digests(self, texts: pa.Array) -> Iterator[tuple[int, str, str]]:
        """(number of ids, digest of the ids, digest of the decoded text) of each of ``texts`` (large_string, no nulls)."""
        short = self.batches.by_words(texts)
        short &= pc.utf8_length(texts).to_numpy(zero_copy_only=False) <= PORTION
        first, ids = self.batches.table.ids(texts.filter(pa.array(short))) if short.any() else (np.zeros(1, np.int64), np.zeros(0, np.int32))
        numbers, letters = self._joined(self.decimals, ids), self._joined(self.bytes_of, ids)
        k = 0
        for i, at_once in enumerate(short):
            state = Digest()
            if at_once:
                a, b = first[k], first[k + 1]
                state.add(b - a, *(data[offsets[a] : offsets[b]] for offsets, data in (numbers, letters)))
                k += 1
            else:
                text = texts[i].as_py()
                for some in self.stream(text[lo : lo + PORTION] for lo in range(0, len(text), PORTION)):
                    state.add(len(some), *(data[offsets[0] : offsets[-1]] for offsets, data in (self._joined(t, some) for t in (self.decimals, self.bytes_of))))
            yield state.close()


class Digest:
    """Number and digests of ids, and of the text decoded from them, that come in portions."""

    def __init__(self):
        self.n, self.ids, self.text, self.decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder()

    def add(self, n: int, numbers: memoryview, letters: memoryview) -> None:
        if n:
            self.ids.update(numbers if self.n else numbers[1:])  # no comma before the first
            self.text.update(self.decoder.push(letters).encode())
            self.n += int(n)

    def close(self) -> tuple[int, str, str]:
        self.text.update(self.decoder.close().encode())
        return self.n, self.ids.hexdigest(), self.text.hexdigest()


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    """One per worker."""
    return ByteBPE(path)


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, tokens array<int>`` for every row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, texts in slices(batch, most=BATCH_BYTES):
                first, ids = load(tokenizer_path).batches.ids(texts)
                yield pa.RecordBatch.from_pydict({"doc_id": some.column("doc_id"), "tokens": pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tokens array<int>")


def decode(tokens: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, text`` of rows ``doc_id, tokens``."""

    def run(batch: pa.RecordBatch) -> dict:
        coder = load(tokenizer_path)
        return {"doc_id": batch.column("doc_id"), "text": pa.array(["".join(coder.decode(ids or [])) for ids in batch.column("tokens").to_pylist()], type=pa.string())}

    return map_batches(tokens.select("doc_id", "tokens"), run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Encode every text, decode the ids again: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, texts in slices(batch, most=BATCH_BYTES):
                n, ids_sha, text_sha = zip(*load(tokenizer_path).digests(texts), strict=True)
                yield pa.RecordBatch.from_pydict({"doc_id": some.column("doc_id"), "n_tokens": pa.array(n, type=pa.int64()), "ids_sha256": pa.array(ids_sha), "decoded_sha256": pa.array(text_sha)})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
