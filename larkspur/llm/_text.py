"""Vectorised text primitives over Arrow buffers.

A word is a maximal run of ASCII letters or digits or of any characters outside ASCII, after
lower-casing. Texts of a batch lie one behind another in a single byte buffer, so that word
boundaries, n-gram hashes and counts of a whole batch are a few NumPy passes over that buffer
instead of a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: The same words for the regular expressions of Spark and DuckDB, on lower-cased text.
WORD_JAVA = r"[a-z0-9\x{80}-\x{10FFFF}]+"
WORD_RE2 = r"[a-z0-9\x{80}-\x{10FFFF}]+"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 4096)
        both = []
        for base in (_BASE, _INVERSE):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            both.append(np.cumprod(table, dtype=np.uint64))
        _powers[:] = both
    return _powers[0], _powers[1]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets between them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `most` bytes of text; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def runs_at(sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.zeros(0, np.int64)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + lengths[0] - 1, starts[1] .., one behind another."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def parts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Numbers below parts from 64-bit hashes, in their order."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


class Words:
    """Word boundaries of a column of texts.

    first[d] : first[d + 1] are the words of text d; doc[i] is the text of word i and
    flat[starts[i] : ends[i]] its bytes.
    """

    def __init__(self, column: pa.Array):
        if column.null_count:
            column = pc.fill_null(column, "")
        data, offsets = raw(pc.utf8_lower(column))
        inside = _WORD[data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        cuts = offsets[(offsets > 0) & (offsets < len(data))]
        opens[cuts] = inside[cuts]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        closes[cuts - 1] = inside[cuts - 1]
        # Only bytes of words and one separator before each word are kept, so that what stands
        # between two words doesn't change the hash of an n-gram.
        begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        lengths = end - begin
        self.n = len(offsets) - 1
        self.starts = np.cumsum(lengths + 1) - lengths if len(lengths) else np.zeros(0, np.int64)
        self.ends = self.starts + lengths
        self.first = np.searchsorted(begin, offsets)
        self.first[-1] = len(begin)
        self.doc = np.repeat(np.arange(self.n), np.diff(self.first))
        total = int(self.ends[-1]) if len(lengths) else 0
        flat = np.full(total, 32, np.uint8)
        place = np.ones(total, bool)
        place[self.starts - 1] = False
        flat[place] = data[inside]
        self.flat = flat
        power, self._inverse = _power_tables(total + 1)
        self._prefix = np.zeros(total + 1, np.uint64)
        np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * power[:total], out=self._prefix[1:])

    def spans(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """64-bit hashes of the words first .. last, both included."""
        s, e = self.starts[first], self.ends[last]
        return mix((self._prefix[e] - self._prefix[s]) * self._inverse[s])

    def ngrams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all runs of k words within one text."""
        i = np.arange(max(0, len(self.doc) - k + 1))
        i = i[self.doc[i] == self.doc[i + k - 1]] if len(i) else i
        return i, self.spans(i, i + k - 1)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams: hashes sorted within each text, and the n + 1 offsets. A text with
        1 to k - 1 words has one n-gram, the whole; one without words has none."""
        i, h = self.ngrams(k)
        count = np.diff(self.first)
        short = np.flatnonzero((count > 0) & (count < k))
        doc = np.concatenate([self.doc[i], short])
        h = np.concatenate([h, self.spans(self.first[short], self.first[short + 1] - 1)])
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        if len(h):
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            doc, h = doc[fresh], h[fresh]
        return h, np.searchsorted(doc, np.arange(self.n + 1))


def pieces(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts cut before every single space that stands between two other characters.

    Byte-level BPE pre-tokenisers cut there as well, so that tokens of a text are those of its
    pieces in order, and each distinct piece is encoded only once a batch. Gives the distinct
    pieces, the index of each piece and n + 1 offsets of the texts in the latter.
    """
    data, offsets = raw(column)
    n = len(data)
    cut = data == 32
    if n:
        cut[0] = cut[-1] = False
        # a neighbour outside ASCII may be a Unicode space, so only ASCII or letters count: 0xC2,
        # 0xE1-0xE3 and their followers can be part of one, and are not cut at
        odd = np.isin(data, (0xC2, 0xE1, 0xE2, 0xE3))
        tail = np.zeros(n, bool)
        tail[3:] |= odd[:-3]
        tail[2:] |= odd[:-2]
        tail[1:] |= odd[:-1]
        soft = (data == 32) | ((data >= 9) & (data <= 13)) | ((data >= 28) & (data <= 31))
        cut[1:-1] &= ~soft[:-2] & ~soft[2:] & ~tail[1:-1] & ~odd[2:]
    cut[offsets[offsets < n]] = True
    bounds = np.append(np.flatnonzero(cut), n).astype(np.int64)
    array = pa.Array.from_buffers(
        pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]
    )
    coded = array.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), np.searchsorted(bounds[:-1], offsets)
