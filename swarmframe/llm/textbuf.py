"""Vectorised views of a column of texts.

The operators of this subpackage read texts as Arrow buffers: one UTF-8 byte
array with the offsets of each text.  Words, lines, their hashes and n-grams
come out of whole-buffer numpy passes, so no Python object is made per word.

A null text counts as an empty one everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time; one longer text makes its own slice.
SLICE_BYTES = 1 << 20

_U = np.uint64
#: An odd number and its inverse modulo 2**64, for prefix hashes.
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_rng = np.random.default_rng(20240229)
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BYTE_CODE_LOWER = _BYTE_CODE[_LOWER]

_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_BASE, _BASE_INV)):
            table = np.full(size, base, dtype=_U)
            table[0] = 1
            np.multiply.accumulate(table, out=table)
            _powers[k] = table
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(29))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of n texts; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, each of about ``limit`` bytes of text."""
    _, offs = text_buffer(batch.column(column))
    n, at = len(offs) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        yield batch.slice(at, min(to, n) - at)
        at = to


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of n texts.

    starts, ends: byte positions in ``data``; offsets: n + 1 places among the
    words where each text begins; doc: the text of each word.
    """

    def __init__(self, data: np.ndarray, text_offsets: np.ndarray):
        self.data, self.text_offsets = data, text_offsets
        solid = ~_IS_SPACE[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[text_offsets] = True
        before = np.empty_like(solid)
        before[:1] = False
        before[1:] = solid[:-1]
        self.solid = solid
        self.starts = np.flatnonzero(solid & (edge[:-1] | ~before))
        after = np.empty_like(solid)
        after[-1:] = False
        after[:-1] = solid[1:]
        self.ends = np.flatnonzero(solid & (edge[1:] | ~after)) + 1
        self.offsets = np.searchsorted(self.starts, text_offsets)
        self.counts = np.diff(self.offsets)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self._prefix: dict[bool, np.ndarray] = {}

    @classmethod
    def of(cls, column: pa.Array) -> Words:
        return cls(*text_buffer(column))

    def prefix(self, lower: bool) -> np.ndarray:
        if lower not in self._prefix:
            powers, _ = _power_tables(len(self.data) + 1)
            code = (_BYTE_CODE_LOWER if lower else _BYTE_CODE)[self.data]
            code *= powers[: len(self.data)]
            sums = np.zeros(len(self.data) + 1, dtype=_U)
            np.cumsum(code, out=sums[1:])
            self._prefix[lower] = sums
        return self._prefix[lower]

    def span_hash(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of the bytes of each span, the same wherever it stands."""
        sums = self.prefix(lower)
        _, inverse = _power_tables(len(self.data) + 1)
        return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U))

    def hashes(self, lower: bool = False) -> np.ndarray:
        return self.span_hash(self.starts, self.ends, lower)

    def ngrams(self, n: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word of every window of n words inside one text, and its hash."""
        total = len(hashes)
        if total < n:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        first = np.flatnonzero(self.doc[: total - n + 1] == self.doc[n - 1 :])
        out = np.zeros(len(first), _U)
        for k in range(n):
            out = out * _U(_BASE) + hashes[first + k]
        return first, mix(out)

    def per_doc(self, marked: np.ndarray) -> np.ndarray:
        """Number of marked bytes, by text."""
        return np.diff(np.searchsorted(np.flatnonzero(marked), self.text_offsets))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of every ``\\n``-split line, empty ones included."""
        breaks = np.flatnonzero(self.data == 0x0A)
        starts = np.concatenate([self.text_offsets[:-1], breaks + 1])
        owner = np.searchsorted(self.text_offsets, breaks, side="right") - 1
        doc = np.concatenate([np.arange(len(self.counts)), owner])
        order = np.lexsort((starts, doc))
        starts, doc = starts[order], doc[order]
        ends = np.empty_like(starts)
        ends[:-1] = np.where(doc[1:] == doc[:-1], starts[1:] - 1, self.text_offsets[doc[:-1] + 1])
        if len(ends):
            ends[-1] = self.text_offsets[-1]
        return starts, ends, doc


def sets_by_doc(doc: np.ndarray, values: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, ascending, with the n_docs + 1 offsets."""
    if len(values) == 0:
        return values, np.zeros(n_docs + 1, np.int64)
    order = np.lexsort((values, doc))
    d, v = doc[order], values[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    d, v = d[new], v[new]
    return v, np.searchsorted(d, np.arange(n_docs + 1))


def first_of_equals(doc: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: whether an equal item of its text stands before it, and how many equals there are."""
    n = len(values)
    if n == 0:
        return np.zeros(0, bool), np.zeros(0, np.int64)
    order = np.lexsort((values, doc))
    d, v = doc[order], values[order]
    new = np.ones(n, dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, n))
    repeated, count = np.empty(n, bool), np.empty(n, np.int64)
    repeated[order] = ~new  # lexsort is stable: the earliest of equals heads its run
    count[order] = np.repeat(sizes, sizes)
    return repeated, count
