"""Token ids in wavelet-matrix files: one compressed file for each shard.

A shard holds the ids of consecutive documents.  Its wavelet matrix (Claude,
Navarro and Ordonez 2015) keeps one bit-plane for each bit of the shard's own
alphabet.  Beside each plane stands a directory of the ones before every block of
512 bits (1/16 of the plane), so rank is one entry and at most eight popcounts, and
select a search in the directory and in one block.  They give access to a token,
counts of a token in any range and its occurrences, without a second copy of the
ids; planes stay packed.

File format, little-endian: magic ``SFWM``, version u16, planes u16, ids u64,
alphabet u32, documents u32; then, each as u64 length and zstd bytes: alphabet
(u32), first id of each document and the end (u64), doc_id (i64) and its
presence (u8), and for each plane its bits (from the lowest, in whole blocks) and
its directory (u32).
"""

from __future__ import annotations

import gc
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swarmframe.llm.store import materialize
from swarmframe.llm.textbuf import slices

MAGIC, VERSION = b"SFWM", 2
#: Words of 64 bits in a block of a plane.
BLOCK_WORDS = 8
#: A shard ends with the document that brings it to so many ids.
SHARD_IDS = 1 << 20
#: Documents for each sorted partition, and the most partitions.
PARTITION_ROWS = 4_096
MOST_PARTITIONS = 10_000
END_ID = 0
#: Pieces whose ids a worker keeps, 64 to 128 bytes each; beyond that it starts afresh.
PIECES_KEPT = 2_000_000
#: Words of 64 bits that hold a piece; longer pieces are kept by themselves.
KEY_WORDS = 3


class Plane:
    """Bits with rank and select: packed words, and the number of ones before each block."""

    def __init__(self, words: np.ndarray, n: int, before: np.ndarray | None = None):
        self.words, self.n = words, n
        if before is None:
            ones = np.bitwise_count(words).reshape(-1, BLOCK_WORDS).sum(axis=1, dtype=np.uint32)
            before = np.concatenate([[0], np.cumsum(ones, dtype=np.uint32)]).astype(np.uint32)
        self.before = before
        self.zeros = n - int(before[-1])

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        packed = np.packbits(bits, bitorder="little")
        whole = np.zeros(-(-len(packed) // (8 * BLOCK_WORDS)) * 8 * BLOCK_WORDS, np.uint8)
        whole[: len(packed)] = packed
        return cls(whole.view("<u8"), len(bits))

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.words.view(np.uint8), count=self.n, bitorder="little").view(bool)

    def bit(self, i: int) -> bool:
        return bool(int(self.words[i >> 6]) >> (i & 63) & 1)

    def rank(self, i: int) -> int:
        """Ones at places below i."""
        word, block = i >> 6, i >> 9
        found = int(self.before[block]) + int(np.bitwise_count(self.words[block * BLOCK_WORDS : word]).sum())
        return found + (int(self.words[word]) & ((1 << (i & 63)) - 1)).bit_count() if i & 63 else found

    def select(self, numbers: np.ndarray, one: bool) -> np.ndarray:
        """Places of the ones (or zeros) with the given numbers, from 0."""
        before = self.before.astype(np.int64) if one else np.arange(len(self.before)) * (64 * BLOCK_WORDS) - self.before
        block = np.searchsorted(before, numbers, side="right") - 1
        left, word = numbers - before[block], block * BLOCK_WORDS
        words = self.words if one else ~self.words
        for _ in range(BLOCK_WORDS - 1):
            count = np.bitwise_count(words[word])
            on = left >= count
            left, word = left - np.where(on, count, 0), word + on
        at, rest = np.zeros(len(numbers), np.int64), words[word]
        for half in (32, 16, 8, 4, 2, 1):
            low = rest & np.uint64((1 << half) - 1)
            count = np.bitwise_count(low)
            on = left >= count
            left, at = left - np.where(on, count, 0), at + on * half
            rest = np.where(on, rest >> np.uint64(half), low)
        return word * 64 + at


class WaveletMatrix:
    """ids of one shard; planes[k] are the bits of level k, the highest bit first."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, doc_ids: np.ndarray, known: np.ndarray):
        self.first, self.doc_ids, self.known = first, doc_ids, known
        self.n = len(ids)
        seen = np.zeros(int(ids.max(initial=0)) + 1, dtype=bool)
        seen[ids] = True
        self.alphabet = np.flatnonzero(seen).astype(np.uint32)
        code = np.zeros(len(seen), dtype=np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        code[self.alphabet] = np.arange(len(self.alphabet), dtype=code.dtype)
        level = code[ids]
        self.depth = max(1, int(max(len(self.alphabet) - 1, 1)).bit_length())
        self.planes = []
        for k in range(self.depth - 1, -1, -1):
            bit = ((level >> k) & 1).astype(bool)
            self.planes.append(Plane.of(bit))
            if k:
                level = np.concatenate([np.compress(~bit, level), np.compress(bit, level)])

    # ------------------------------------------------------------- the file

    def to_bytes(self) -> bytes:
        pack = zstandard.ZstdCompressor(level=1).compress
        parts = [self.alphabet, self.first.astype(np.uint64), self.doc_ids.astype(np.int64), self.known.astype(np.uint8)]
        parts += [x for p in self.planes for x in (p.words, p.before)]
        out = [MAGIC, struct.pack("<HHQII", VERSION, self.depth, self.n, len(self.alphabet), len(self.doc_ids))]
        for p in parts:
            body = pack(p.tobytes())
            out += [struct.pack("<Q", len(body)), body]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, blob: bytes) -> WaveletMatrix:
        if blob[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        self = cls.__new__(cls)
        version, self.depth, self.n, n_alphabet, n_docs = struct.unpack_from("<HHQII", blob, 4)
        if version != VERSION:
            raise ValueError(f"version {version}")
        at, unpack, parts = 4 + struct.calcsize("<HHQII"), zstandard.ZstdDecompressor().decompress, []
        for _ in range(4 + 2 * self.depth):
            (size,) = struct.unpack_from("<Q", blob, at)
            parts.append(unpack(blob[at + 8 : at + 8 + size]))
            at += 8 + size
        self.alphabet = np.frombuffer(parts[0], np.uint32)
        self.first = np.frombuffer(parts[1], np.uint64).astype(np.int64)
        self.doc_ids, self.known = np.frombuffer(parts[2], np.int64), np.frombuffer(parts[3], np.uint8).astype(bool)
        self.planes = [Plane(np.frombuffer(w, "<u8"), self.n, np.frombuffer(b, "<u4")) for w, b in zip(parts[4::2], parts[5::2], strict=True)]
        if len(self.alphabet) != n_alphabet or len(self.doc_ids) != n_docs:
            raise ValueError("damaged file")
        return self

    # -------------------------------------------------------------- queries

    def ids(self) -> np.ndarray:
        """All ids in order: the stable partitions are undone from the lowest plane up."""
        level = np.zeros(self.n, dtype=np.uint16 if self.depth <= 16 else np.uint32)
        for k, plane in enumerate(reversed(self.planes)):
            bit = plane.bits()
            back = np.empty_like(level)
            back[np.flatnonzero(~bit)] = level[: plane.zeros]
            back[np.flatnonzero(bit)] = level[plane.zeros :] | level.dtype.type(1 << k)
            level = back
        return self.alphabet[level]

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for plane in self.planes:
            b, ones = plane.bit(i), plane.rank(i)
            i = plane.zeros + ones if b else i - ones
            code = code << 1 | b
        return int(self.alphabet[code])

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        code = int(np.searchsorted(self.alphabet, token))
        if code >= len(self.alphabet) or self.alphabet[code] != token:
            return 0, 0
        for k, plane in enumerate(self.planes):
            if code >> (self.depth - 1 - k) & 1:
                lo, hi = plane.zeros + plane.rank(lo), plane.zeros + plane.rank(hi)
            else:
                lo, hi = lo - plane.rank(lo), hi - plane.rank(hi)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of token at places lo <= i < hi."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def occurrences(self, token: int) -> np.ndarray:
        """All places of token, ascending: select on every plane from the lowest up."""
        lo, hi = self._range(token, 0, self.n)
        places = np.arange(lo, hi)
        code = int(np.searchsorted(self.alphabet, token))
        for k in range(self.depth - 1, -1, -1):
            plane, one = self.planes[k], bool(code >> (self.depth - 1 - k) & 1)
            places = plane.select(places - plane.zeros if one else places, one)
        return places


# --------------------------------------------------------------- tokenizing

#: ASCII without the controls that regular expressions classify differently, and Latin letters.
_PLAIN = re.compile("[\x09-\x0d\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]*")
#: Bytes of text whose pieces are held at a time; few enough for a core's cache.
SLICE_BYTES = 1 << 18

_U = np.uint64
_BYTES = np.arange(256)
_IS_SPACE = (_BYTES == 0x20) | (_BYTES >= 0x09) & (_BYTES <= 0x0D)
#: Letters and digits; every byte from 0x80 is part of a letter.
_IS_WORD = (_BYTES >= 0x80) | (_BYTES >= 0x30) & (_BYTES <= 0x39) | ((_BYTES | 0x20) >= 0x61) & ((_BYTES | 0x20) <= 0x7A)
#: The first so many bytes of a word of 64 bits.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)
_ODD = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)]


def pieces_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces, or few of them in a row, begin in texts of _PLAIN's letters.

    These are ends of the library's pattern whatever stands around them: before white space
    after anything else, before the last of white space and after it, unless it is a space,
    which leads what follows; and before a sign after a letter or digit.  A piece never sees
    more of what follows it than whether that is white space, which counts as the text's end.
    """
    space, word = _IS_SPACE[data], _IS_WORD[data]
    begins = np.zeros(len(data), bool)
    lasts = space[:-1] & ~space[1:]
    lasts[offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))] - 1] = False  # the next text doesn't follow
    begins[:-1] = lasts
    begins[1:] |= (space[1:] & ~space[:-1]) | (lasts & (data[:-1] != 0x20)) | (word[:-1] & ~(word[1:] | space[1:]))
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(begins)


def keys_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """The bytes of each span in words of 64 bits, zeros behind them; data has whole words and KEY_WORDS more."""
    words, at, low = data.view("<u8"), starts >> 3, ((starts & 7) << 3).astype(_U)
    high, here, keys = _U(64) - low, data.view("<u8").take(starts >> 3), []
    for k in range(KEY_WORDS):
        after = words.take(at + (k + 1))
        keys.append((here >> low | after << high) & _FIRST.take(np.clip(lengths - 8 * k, 0, 8)))
        here = after
    return keys


class Table:
    """A value that isn't 0 for each key, by open addressing; whole arrays of keys at a time."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.rows, self.kept = np.zeros((1 << 12, KEY_WORDS + 1), _U), 0

    def _place(self, keys: list[np.ndarray]) -> np.ndarray:
        mixed = keys[0] * _ODD[0]
        for key, odd in zip(keys[1:], _ODD[1:], strict=True):
            mixed ^= (mixed >> _U(32)) + key * odd
            mixed *= _ODD[0]
        return (mixed >> _U(65 - len(self.rows).bit_length())).astype(np.int64)

    def find(self, keys: list[np.ndarray]) -> np.ndarray:
        """The value of each key, 0 if there is none."""
        at, left, values = self._place(keys), np.arange(len(keys[0])), np.zeros(len(keys[0]), _U)
        while len(left):
            rows = self.rows.take(at, axis=0)
            other = rows[:, 0] != keys[0]
            for k in range(1, KEY_WORDS):
                other |= rows[:, k] != keys[k]
            values[left] = np.where(other, 0, rows[:, KEY_WORDS])
            on = np.flatnonzero(other & (rows[:, KEY_WORDS] != 0))
            left, at, keys = left[on], (at[on] + 1) & (len(self.rows) - 1), [key[on] for key in keys]
        return values

    def add(self, keys: list[np.ndarray], values: np.ndarray) -> None:
        """Keys that differ and aren't there, with values that differ."""
        self.kept += len(values)
        if 2 * self.kept > len(self.rows):
            old = self.rows[self.rows[:, KEY_WORDS] != 0]
            self.rows = np.zeros((1 << (2 * self.kept).bit_length(), KEY_WORDS + 1), _U)
            keys, values = [np.concatenate([key, old[:, k]]) for k, key in enumerate(keys)], np.concatenate([values, old[:, KEY_WORDS]])
        at = self._place(keys)
        while len(values):
            free = np.flatnonzero(self.rows[at, KEY_WORDS] == 0)
            self.rows[at[free], KEY_WORDS] = values[free]
            own = free[self.rows[at[free], KEY_WORDS] == values[free]]  # of several at one place, one stays
            for k, key in enumerate(keys):
                self.rows[at[own], k] = key[own]
            left = np.ones(len(values), bool)
            left[own] = False
            at, keys, values = (at[left] + 1) & (len(self.rows) - 1), [key[left] for key in keys], values[left]


class IdEncoder:
    """Whole texts to ids with the tokenizers library; a piece that came before is looked up.

    The library splits a text by its pattern and encodes each piece by itself, so
    ids of pieces can be kept.  Texts with letters beyond Latin, controls or a
    special token's string go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if hasattr(self.library.model, "_resize_cache"):
            self.library.model._resize_cache(0)  # no piece is asked for twice here, so the library's own table would only fill
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        #: A special token with a space could be made of two joined pieces.
        self.joins = not any(" " in t for t in self.special)
        #: Ids of tokens that begin with the sign of a space: of the first one of a piece that a space leads.
        self.leads = np.zeros(self.library.get_vocab_size(), bool)
        self.leads[[i for t, i in self.library.get_vocab().items() if t[:1] == "\u0120"]] = True
        self.table = Table()
        self._forget()

    def _forget(self) -> None:
        self.table.clear()
        #: First id and number of ids of longer pieces; ids of all pieces, one after another.
        self.longer: dict[bytes, tuple[int, int]] = {}
        self.ids, self.n_ids = np.empty(1 << 16, self.dtype), 0

    def _keep(self, ids: np.ndarray) -> int:
        first, self.n_ids = self.n_ids, self.n_ids + len(ids)
        if self.n_ids > len(self.ids):
            more = np.empty(1 << self.n_ids.bit_length(), self.dtype)
            more[:first] = self.ids[:first]
            self.ids = more
        self.ids[first : self.n_ids] = ids
        return first

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Keep the ids of pieces, the first and the number of each; those that a space leads are cut apart again in one joined text."""
        led = np.array([self.joins and p[:1] == b" " and not p.isspace() for p in pieces], bool)
        first, number = np.zeros((2, len(pieces)), np.int64)
        joined = [p for p, on in zip(pieces, led.tolist(), strict=True) if on]
        if joined:
            (found,) = self.library.encode_batch_fast([b"".join(joined).decode()], add_special_tokens=False)
            ids = np.array(found.ids, self.dtype)
            at = np.flatnonzero(self.leads[ids])
            first[led], number[led] = self._keep(ids) + at, np.diff(at, append=len(ids))
        alone = [p.decode() for p, on in zip(pieces, led.tolist(), strict=True) if not on]
        each = [e.ids for e in self.library.encode_batch_fast(alone, add_special_tokens=False)]
        number[~led] = counts = np.array([len(ids) for ids in each], np.int64)
        first[~led] = self._keep(np.array([i for ids in each for i in ids], self.dtype)) + np.cumsum(counts) - counts
        return first, number

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """ids of each text.

        The many short-lived objects hold no cycles, so the collector of cycles rests meanwhile.
        """
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._many(texts)
        finally:
            if collecting:
                gc.enable()

    def _many(self, texts: list[str]) -> list[np.ndarray]:
        if self.table.kept + len(self.longer) >= PIECES_KEPT:
            self._forget()
        plain = [bool(_PLAIN.fullmatch(t)) and not any(s in t for s in self.special) for t in texts]
        known = iter(self._plain([t.encode() for t, on in zip(texts, plain, strict=True) if on]))
        other = iter(self.library.encode_batch_fast([t for t, on in zip(texts, plain, strict=True) if not on], add_special_tokens=False))
        return [next(known) if on else np.array(next(other).ids, self.dtype) for on in plain]

    def _plain(self, texts: list[bytes]) -> list[np.ndarray]:
        offsets = np.cumsum([0, *map(len, texts)])
        size = int(offsets[-1])
        if not size:
            return [self.ids[:0]] * len(texts)
        whole = b"".join([*texts, bytes(-size % 8 + 8 * (KEY_WORDS + 1))])
        data = np.frombuffer(whole, np.uint8)
        starts = pieces_of(data[:size], offsets)
        lengths = np.diff(starts, append=size)
        keys = keys_of(data, starts, lengths)
        values = self.table.find(keys)
        longer = np.flatnonzero(lengths > 8 * KEY_WORDS)
        values[longer] = 1
        missing = np.flatnonzero(values == 0)
        if len(missing):
            new = [key[missing] for key in keys]
            order = np.lexsort(new)
            ranked = [key[order] for key in new]
            differs = np.ones(len(order), bool)
            differs[1:] = np.logical_or.reduce([key[1:] != key[:-1] for key in ranked])
            at = missing[order[differs]]
            first, number = self._learn([whole[a:b] for a, b in zip(starts[at].tolist(), (starts[at] + lengths[at]).tolist(), strict=True)])
            got = (first.astype(_U) + _U(1)) << _U(8) | number.astype(_U)  # a piece has at most one id for each byte
            self.table.add([key[differs] for key in ranked], got)
            values[missing[order]] = got[np.cumsum(differs) - 1]
        first, number = (values >> _U(8)).astype(np.int64) - 1, (values & _U(255)).astype(np.int64)
        if len(longer):
            pieces = [whole[a:b] for a, b in zip(starts[longer].tolist(), (starts[longer] + lengths[longer]).tolist(), strict=True)]
            new = list({p for p in pieces if p not in self.longer})
            self.longer.update(zip(new, zip(*(x.tolist() for x in self._learn(new)), strict=True), strict=True))
            first[longer], number[longer] = np.array([self.longer[p] for p in pieces]).T
        ends = np.cumsum(number)
        ids = self.ids.take(np.repeat(first - ends + number, number) + np.arange(ends[-1]))
        bounds = np.append(0, ends)[np.searchsorted(starts, offsets)].tolist()
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


_encoders: dict[str, IdEncoder] = {}


def id_encoder(path: str | None) -> IdEncoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        _encoders[path] = IdEncoder(path)
    return _encoders[path]


# ------------------------------------------------------------------ shards


def write_shards(docs: DataFrame, path: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """(part, seq, n_ids, file) of all texts, in ascending order of doc_id over (part, seq).

    A null text is empty; each document ends with id 0.  Null ids come first, rows
    with equal ids in the order of their texts.  ``file`` is a whole file in the
    format above; Spark's writer puts it on shared storage, whatever that is.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = min(MOST_PARTITIONS, max(1, -(-rows.count() // PARTITION_ROWS)))
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = id_encoder(path).many
        end = np.array([END_ID], dtype=id_encoder(path).dtype)
        part, seq = TaskContext.get().partitionId(), 0
        ids, names, size = [], [], 0

        def shard() -> pa.RecordBatch:
            first = np.concatenate([[0], np.cumsum([len(x) + 1 for x in ids])])
            whole = np.concatenate([y for x in ids for y in (x, end)])
            known = np.array([d is not None for d in names])
            file = WaveletMatrix(whole, first, np.array([d or 0 for d in names], np.int64), known).to_bytes()
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "n_ids": [len(whole)], "file": [file]}, schema=schema)

        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("file", pa.binary())])
        for batch in batches:
            found = ((d, x) for p in slices(batch, limit=SLICE_BYTES) for d, x in zip(p.column(0).to_pylist(), encode(p.column(1).to_pylist()), strict=True))
            for doc_id, coded in found:
                ids.append(coded)
                names.append(doc_id)
                size += len(coded) + 1
                if size >= shard_ids:
                    yield shard()
                    ids, names, size, seq = [], [], 0, seq + 1
        if ids:
            yield shard()

    return materialize(ordered.mapInArrow(run, "part int, seq int, n_ids long, file binary"))


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files."""
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    at = shards.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inside"))
    at = at.join(totals, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, file in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                m = WaveletMatrix.from_bytes(file)
                ids = m.ids().astype("<u4")
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(m.first[:-1].tolist(), m.first[1:].tolist(), strict=True)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m.doc_ids, mask=~m.known), pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32)), pa.array(m.first[:-1]), pa.array(np.diff(m.first)), pa.array(crc, pa.int64())],
                    ["doc_id", "part", "seq", "inside", "n_tokens", "ids_crc32"],
                )

    read = shards.select("part", "seq", "file").mapInArrow(run, "doc_id long, part int, seq int, inside long, n_tokens long, ids_crc32 long")
    return read.join(at, ["part", "seq"]).select("doc_id", (F.col("at") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
