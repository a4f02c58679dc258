"""Words of a batch of texts as numpy arrays, without a Python object a word.

A batch's bytes lie in one buffer; a polynomial over it, summed up, gives every word's hash from two look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time; one text is never divided.
SLICE_BYTES = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything but ASCII letters and digits and the bytes of other characters.
NOT_ALNUM = np.array([not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b > 127) for b in range(256)])
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2^64."""
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        with np.errstate(over="ignore"):
            known = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 16), base, dtype=np.uint64)]))
        _powers[int(base)] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of ``values[start:stop]`` for every run."""
    total = np.concatenate([[np.uint64(0)], np.cumsum((values + np.uint64(1)) * powers(_P, len(values)), dtype=np.uint64)])
    return mix((total[stops] - total[starts]) * powers(_P_INV, len(values) + 1)[starts] + (stops - starts).astype(np.uint64))


class Words:
    """All words of some texts, in order: ``hash``, ``row`` (of the text), ``index`` (in the text), ``line`` (of all)
    and ``begin``, ``end`` (bytes in the text).  A-Z are lower-cased; ``cuts`` marks the bytes between words."""

    def __init__(self, texts: pa.Array, cuts: np.ndarray = SPACE):
        wide = pa.large_string()
        ended = pc.binary_join_element_wise(texts.cast(wide), pa.scalar("", wide), pa.scalar("\n", wide))
        offsets = np.frombuffer(ended.buffers()[1], dtype=np.int64)[ended.offset : ended.offset + len(ended) + 1]
        data = np.frombuffer(ended.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if len(ended) else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        between = cuts[data]
        before = np.concatenate([[True], between[:-1]]) if len(data) else between
        begin = np.flatnonzero(before & ~between)
        end = np.flatnonzero(between & ~before)  # every text ends with a line feed
        self.hash = run_hashes(_LOWER[data].astype(np.uint64), begin, end)
        self.row = np.searchsorted(offsets, begin, side="right") - 1
        first = np.searchsorted(begin, offsets[:-1])
        self.index = np.arange(len(begin)) - first[self.row]
        self.line = np.cumsum(data == 10)[begin] if len(begin) else begin
        self.begin, self.end = begin - offsets[self.row], end - offsets[self.row]

    def __len__(self) -> int:
        return len(self.hash)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``width`` neighbouring words, at their first word; the last ``width - 1`` are missing."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = mix(out + hashes[k : k + n])
    return out


def slices(batch: pa.RecordBatch, name: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Portions of a batch of about ``most`` bytes of text, and their texts without nulls."""
    texts = batch.column(name).cast(pa.large_string()).fill_null("")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        base = sizes[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, base + most, side="right")))
        yield batch.slice(lo, hi - lo), texts.slice(lo, hi - lo)
        lo = hi
