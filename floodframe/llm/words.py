"""Words of a batch of texts as 64-bit hashes, with numpy over the Arrow buffers: no Python object per word."""

from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BLOCK = 1 << 19  # bytes hashed at once
_BASE, _A, _B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

_bytes = np.arange(256)
#: bytes of words split by ASCII white space
SPACED = ~((_bytes == 32) | ((_bytes >= 9) & (_bytes <= 13)))
#: bytes of words made of lower-case ASCII letters, digits and everything beyond ASCII
ALNUM = ((_bytes >= 0x30) & (_bytes <= 0x39)) | ((_bytes >= 0x61) & (_bytes <= 0x7A)) | (_bytes >= 0x80)
#: bytes of lines
LINES = _bytes != 10
LOWER = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint8)


class Words(NamedTuple):
    data: np.ndarray  # bytes, lower-cased if asked
    texts: np.ndarray  # where each text begins in data; one more entry than texts
    ids: np.ndarray  # hash of each word
    start: np.ndarray  # byte range of each word
    end: np.ndarray
    first: np.ndarray  # each text's first word; one more entry than texts

    def doc(self) -> np.ndarray:
        """Text number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def text(self, i: int, j: int) -> bytes:
        """Words i to j, both included, joined by single spaces."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[i:j + 1], self.end[i:j + 1]))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and each text's offset; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    texts = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[texts[0]:texts[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, texts - texts[0]


def scan(column: pa.Array, member: np.ndarray, lower: bool = False) -> Words:
    """Maximal runs of bytes in ``member``, never across texts."""
    data, texts = buffers(column)
    if lower:
        data = LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = member[data]
    before, after = inside[:-2].copy(), inside[2:].copy()
    cut = texts[:-1][texts[:-1] < texts[1:]]
    before[cut] = False
    after[cut[1:] - 1] = False
    start = np.flatnonzero(inside[1:-1] & ~before)
    end = np.flatnonzero(inside[1:-1] & ~after) + 1
    return Words(data, texts, _hashes(data, start, end), start, end, np.searchsorted(start, texts))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.full(n, _BASE, U64)
    base[0] = 1
    inverse = np.full(n, pow(_BASE, -1, 1 << 64), U64)
    inverse[0] = 1
    return np.cumprod(base), np.cumprod(inverse)


def _hashes(data, start, end):
    """Polynomial hash of each range, from running sums within blocks that end between words."""
    out, i = np.empty(len(start), U64), 0
    while i < len(start):
        low = start[i]
        j = int(np.searchsorted(start, low + _BLOCK))
        a, b = start[i:j] - low, end[i:j] - low
        n = int(b[-1])
        power, inverse = _powers(1 << max(19, n.bit_length()))
        total = np.zeros(n + 1, U64)
        np.cumsum((data[low:low + n].astype(U64) + U64(1)) * power[:n], out=total[1:])
        out[i:j] = (total[b] - total[a]) * inverse[a]
        i = j
    return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every bit."""
    x = (x ^ (x >> U64(30))) * U64(_A)
    x = (x ^ (x >> U64(27))) * U64(_B)
    return x ^ (x >> U64(31))


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the sequence a, b."""
    return mix(a * U64(_BASE) + b + U64(0x632BE59BD9B4E019))


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of n words within one text, and the word it starts at."""
    if len(w.ids) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    last = np.repeat(w.first[1:], np.diff(w.first))  # end of each word's text
    at = np.flatnonzero(np.arange(len(w.ids)) + n <= last)
    out = w.ids[at]
    for k in range(1, n):
        out = join(out, w.ids[at + k])
    return out, at


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n positions lie in any of the half-open ranges."""
    edge = np.bincount(start, minlength=n + 1)[:n + 1] - np.bincount(end, minlength=n + 1)[:n + 1]
    return np.cumsum(edge)[:n] > 0


def per_text(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each text's words."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]
