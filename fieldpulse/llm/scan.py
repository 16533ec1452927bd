"""Words of many texts at once: numpy arrays over the UTF-8 bytes of an Arrow string column.

Everything works on one batch inside a task.  ``pieces`` cuts a batch into slices of
bounded size first, so memory depends on the slice and not on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text makes a slice of its own.
PIECE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_U = np.uint64


def _breaks(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


#: Bytes between words: ASCII white space.
SPACE = _breaks(b" \t\n\v\f\r")
#: Bytes between words: every ASCII character that is no letter.
NO_LETTER = _breaks(bytes(b for b in range(128) if not chr(b).isalpha()))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (the finaliser of MurmurHash3)."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of the hash base (or of its inverse) modulo 2**64."""
    size = 1 << max(16, int(n).bit_length())
    return _powers(size, pow(_BASE, -1, 1 << 64) if inverse else _BASE)[:n]


@dataclass
class Words:
    """Words of consecutive texts: byte ranges, and the first word of each text (one more at the end)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    def text_of(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def sums(self) -> np.ndarray:
        """Running sums from which ``ranges`` takes the hash of any byte range."""
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + _U(1)) * powers(len(self.data)), out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges; equal bytes have equal hashes wherever they stand."""
        return mix((sums[end] - sums[start]) * powers(len(self.data) + 1, inverse=True)[start])

    def hashes(self) -> np.ndarray:
        return self.ranges(self.sums(), self.start, self.end)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the offset of each (one more at the end); null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(texts: pa.Array, between: np.ndarray) -> Words:
    """The words of ``texts``; ``between`` marks the byte values that separate words."""
    data, offsets = text_bytes(texts)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~between[data]
    opens = np.zeros(len(data) + 1, bool)  # borders of texts
    opens[offsets] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | opens[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | opens[1:])) + 1
    return Words(data, start, end, np.searchsorted(start, offsets), offsets)


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of ``texts`` with about ``limit`` bytes each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        done = total[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(total, done + limit, side="right")))
        yield at, upto
        at = upto


def column(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    """One column as a single array."""
    out = batch.column(name)
    return out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out


def windows(hashes: np.ndarray, size: int, base: int = _BASE) -> np.ndarray:
    """Hashes of ``size`` consecutive items, by start; the last ``size - 1`` starts are left out."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * _U(base) + hashes[j: j + n]
    return mix(out)
