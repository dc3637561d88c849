"""Words of many texts at once: numpy over the UTF-8 bytes of an Arrow column, without a Python object for each word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes hashed at once.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0-9, a-z and all bytes of characters beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))), dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, BLOCK), _powers(pow(_BASE, -1, 1 << 64), BLOCK)


@dataclass
class Words:
    """Words of consecutive texts: `data` holds the lower-cased bytes, word i is data[start[i]:end[i]], and text t has the
    words first[t] to first[t + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def text(self, i: int, j: int) -> bytes:
        """Words i to j - 1, joined by a blank."""
        data = self.data
        return b" ".join([data[s:e].tobytes() for s, e in zip(self.start[i:j].tolist(), self.end[i:j].tolist())])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = (column if pa.types.is_large_string(column.type) else column.cast(pa.large_string())).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(data: np.ndarray, offsets: np.ndarray, alphabet: np.ndarray = ALNUM) -> Words:
    """Maximal runs of bytes of `alphabet` in each text, after A-Z became a-z."""
    data = _LOWER[data]
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = alphabet[data]
    begins, stops = inside[1:] & ~inside[:-1], ~inside[1:] & inside[:-1]
    cuts = offsets[1:-1]  # a word ends where its text does
    cuts = cuts[inside[cuts] & inside[cuts + 1]]
    begins[cuts] = stops[cuts] = True
    start, end = np.flatnonzero(begins[:-1]), np.flatnonzero(stops)
    return Words(data, start, end, np.searchsorted(start, offsets))


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes. Equal words have equal hashes; who needs the converse compares the words."""
    out = np.empty(len(words.start), dtype=np.uint64)
    i = 0
    while i < len(out):
        s = int(words.start[i])
        j = max(i + 1, int(np.searchsorted(words.end, s + BLOCK, side="right")))
        if words.end[i] - s > BLOCK:  # a single word of over a block
            out[i] = _long_hash(words.data[s : words.end[i]])
        else:
            e = int(words.end[j - 1])
            sums = np.zeros(e - s + 1, dtype=np.uint64)
            np.cumsum((words.data[s:e].astype(np.uint64) + np.uint64(1)) * _UP[: e - s], out=sums[1:])
            a, b = words.start[i:j] - s, words.end[i:j] - s
            out[i:j] = (sums[b] - sums[a]) * _DOWN[a]
        i = j
    return out


def _long_hash(data: np.ndarray) -> np.uint64:
    total = np.uint64(0)
    with np.errstate(over="ignore"):
        for k in range(len(data) - len(data) % BLOCK, -1, -BLOCK):
            part = data[k : k + BLOCK].astype(np.uint64) + np.uint64(1)
            total = total * _UP[BLOCK] + (part * _UP[: len(part)]).sum(dtype=np.uint64)
    return total


def gram_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` words, by its first word; they may cross texts."""
    out = np.zeros(max(0, len(hashes) - width + 1), dtype=np.uint64)
    for k in range(width):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[k : len(out) + k]
    return out ^ (out >> np.uint64(31))
