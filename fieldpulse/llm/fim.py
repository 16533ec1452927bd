"""Fill-in-the-middle samples: a text is cut at two places and its parts are put into another order.

The two cuts are given in units: code points, words or lines.  Every byte of a text gets a class
(``CLASSES``), the classes of a batch form a wavelet matrix, and units up to a byte are counted by ranks of
the classes that begin one.  Bisection on that count finds the byte after any number of units, so a cut
needs no pass over the text and never splits a code point.

Forms: ``psm`` is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, ``spm`` is ``<S>`` suffix ``<P>`` prefix
``<M>`` middle, ``plain`` is the text as it is.  ``restore`` rebuilds the text: a sentinel holds ``<`` only at
its start, so none can arise where parts meet, and a text that holds one itself stays plain.

Edge cases: null counts as empty, an empty text is plain; a null key hashes as ``1:``; repeated rows come out
repeated with equal cuts; a text that takes a whole batch is cut like any other; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
#: Of 100 texts, those that are cut, and of 100 cut ones those in the order suffix, prefix, middle.
CUT_OF_100, SPM_OF_100 = 90, 20
#: Classes of bytes: inside a code point, line break, white space, first byte of a word, rest of it, any other mark.
INNER, BREAK, BLANK, FIRST, WORD, MARK = CLASSES = range(6)
LEVELS = 3
#: A unit begins with every byte of these classes; a line with the text and after every break.
UNITS = {"char": (BREAK, BLANK, FIRST, WORD, MARK), "word": (FIRST,), "line": (BREAK,)}

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The class of every byte; non-ASCII code points count as parts of words."""
    table = np.full(256, MARK, np.uint8)
    table[list(b" \t\v\f\r")] = BLANK
    table[ord("\n")] = BREAK
    table[[b for b in range(128) if chr(b).isalnum()]] = WORD
    table[0x80:0xC0] = INNER
    table[0xC0:] = WORD
    out = table[data]
    joined = (out == WORD) | (out == INNER)
    opens = np.zeros(len(data) + 1, bool)
    opens[offsets] = True
    first = (out == WORD) & (opens[:-1] | ~np.concatenate([[False], joined[:-1]]))
    out[first] = FIRST
    return out


class WaveletMatrix:
    """Ranks of small symbols: one bit vector per level, packed into words with running counts."""

    def __init__(self, symbols: np.ndarray, levels: int = LEVELS):
        self.size, self.levels = len(symbols), []
        for level in reversed(range(levels)):
            bit = (symbols >> level & 1).astype(bool)
            packed = np.zeros((len(bit) // 64 + 1) * 8, np.uint8)
            filled = np.packbits(bit, bitorder="little")
            packed[:len(filled)] = filled
            packed = packed.view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.levels.append((packed, before, self.size - int(bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    @staticmethod
    def _ones(packed: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        return before[word] + np.bitwise_count(packed[word] & ~(_ALL << rest)).astype(np.int64)

    def rank(self, symbol: int, upto: np.ndarray) -> np.ndarray:
        """Places of ``symbol`` before each position."""
        low, high = np.zeros_like(upto), upto
        for place, (packed, before, zeros) in enumerate(self.levels):
            ones = [self._ones(packed, before, at) for at in (low, high)]
            if symbol >> (len(self.levels) - 1 - place) & 1:
                low, high = zeros + ones[0], zeros + ones[1]
            else:
                low, high = low - ones[0], high - ones[1]
        return high - low


def units_before(matrix: WaveletMatrix, unit: str, begin: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Units that begin in ``[begin, at)``, texts beginning at ``begin``."""
    count = sum(matrix.rank(c, at) - matrix.rank(c, begin) for c in UNITS[unit])
    return count + (at > begin) if unit == "line" else count


def place_after(matrix: WaveletMatrix, unit: str, begin: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The byte after the first ``k`` units of each text: the largest place with at most ``k`` units before it."""
    low, high = begin.copy(), end.copy()
    while (low < high).any():
        mid = (low + high + 1) >> 1
        fits = units_before(matrix, unit, begin, mid) <= k
        low, high = np.where(fits, mid, low), np.where(fits, high, mid - 1)
    if unit != "line":
        return low
    return np.where(k > 0, low, begin)


def cut(texts: pa.Array, h: list[np.ndarray], unit: str = "char") -> dict[str, list | np.ndarray]:
    """Units, form, code points of the parts and output of every text; ``h`` are four draws per text."""
    data, offsets = scan.text_bytes(texts)
    begin, end = offsets[:-1], offsets[1:]
    matrix = WaveletMatrix(classes(data, offsets))
    n = units_before(matrix, unit, begin, end)
    first, second = h[0] % (n + 1), h[1] % (n + 1)
    places = [place_after(matrix, unit, begin, end, k) for k in (np.minimum(first, second), np.maximum(first, second))]
    chars = [units_before(matrix, "char", a, b) for a, b in ((begin, places[0]), (places[0], places[1]))]
    forms, outputs = [], []
    for i in range(len(n)):
        whole = data[begin[i]: end[i]].tobytes()
        if not whole or h[2][i] % 100 >= CUT_OF_100 or any(s.encode() in whole for s in SENTINELS):
            forms.append("plain")
            outputs.append(whole)
            continue
        a, b = int(places[0][i] - begin[i]), int(places[1][i] - begin[i])
        head, tail = PREFIX.encode() + whole[:a], SUFFIX.encode() + whole[b:]
        forms.append("spm" if h[3][i] % 100 < SPM_OF_100 else "psm")
        outputs.append((tail + head if forms[-1] == "spm" else head + tail) + MIDDLE.encode() + whole[a:b])
    return {"n": n, "form": forms, "prefix": chars[0], "middle": chars[1], "output": outputs}


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "char") -> DataFrame:
    """``(key, text, n, form, prefix_chars, middle_chars, output)`` of every row; cuts follow from the key alone."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(docs[key].cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i}") for i in range(4)]
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in scan.pieces(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                found = cut(part.column(1), [part.column(2 + i).to_numpy() for i in range(4)], unit)
                plain = np.array([f == "plain" for f in found["form"]])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(found["n"]), pa.array(found["form"], pa.string()),
                     pa.array(found["prefix"], mask=plain), pa.array(found["middle"], mask=plain),
                     pa.array(found["output"], pa.binary()).cast(pa.string())],
                    ["key", "text", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(docs[key].alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"), *draws)
    return rows.mapInArrow(
        run, f"key {kind}, text string, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` of this ``form`` was made from."""
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    first = lambda mark: F.substring_index(head, mark, 1)
    last = lambda mark: F.substring_index(head, mark, -1)
    psm = F.concat(F.substring_index(first(SUFFIX), PREFIX, -1), middle, last(SUFFIX))
    spm = F.concat(last(PREFIX), middle, F.substring_index(first(PREFIX), SUFFIX, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
