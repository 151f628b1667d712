"""Elias-Fano sequences over numpy arrays, searched for many values at once, and files of named arrays to map."""

from __future__ import annotations

import json
import tempfile
from urllib.parse import urlparse

import numpy as np

from postlab.llm import storage

U64 = np.uint64
BLOCK_WORDS = 2  # words of the upper bits between two entries of the rank directory
BYTES = U64(0x0101010101010101)  # one in every byte
#: Place of the k-th set bit of each byte, at 8 * byte + k.
BIT_IN_BYTE = np.array([([i for i in range(8) if byte >> i & 1] + [0] * 8)[k] for byte in range(256) for k in range(8)], np.uint8)


def _bit_in_word(bits: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Place of the set bit number ``which`` of each word: byte sums held side by side name the byte, a table the bit."""
    sums = bits - ((bits >> U64(1)) & (BYTES * U64(0x55)))
    sums = (sums & (BYTES * U64(0x33))) + ((sums >> U64(2)) & (BYTES * U64(0x33)))
    sums = ((sums + (sums >> U64(4))) & (BYTES * U64(0x0F))) * BYTES  # byte i: set bits up to byte i
    high = BYTES * U64(0x80)
    # a byte keeps its high bit where its sum reaches which + 1
    shift = (U64(8) - np.bitwise_count(((sums | high) - (which + U64(1)) * BYTES) & high)) * U64(8)
    left = which - (((sums << U64(8)) >> shift) & U64(0xFF))
    return shift + BIT_IN_BYTE[((((bits >> shift) & U64(0xFF)) << U64(3)) | left).astype(np.int64)]


def _get_bits(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Numbers of ``width`` bits at entry numbers ``at``."""
    if width == 0:
        return np.zeros(len(at), U64)
    bit = at.astype(U64) * U64(width)
    word, off = bit >> U64(6), bit & U64(63)
    low = words[word] >> off
    high = (words[word + U64(1)] << U64(1)) << (U64(63) - off)
    return (low | high) & U64((1 << width) - 1)


def _put_bits(values: np.ndarray, width: int) -> np.ndarray:
    words = np.zeros((len(values) * width >> 6) + 2, U64)
    if width and len(values):
        bit = np.arange(len(values), dtype=U64) * U64(width)
        word, off = (bit >> U64(6)).astype(np.int64), bit & U64(63)
        np.bitwise_or.at(words, word, values << off)
        np.bitwise_or.at(words, word + 1, (values >> U64(1)) >> (U64(63) - off))
    return words


class EliasFano:
    """A non-decreasing sequence of n numbers below 2**64 in about 2 + log2(range / n) bits each: the lower bits are
    packed, the upper ones written in unary with a sparse rank directory. n and the number of unary zeros are below 2**32."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, rank: np.ndarray):
        self.n, self.width, self.low, self.high, self.rank = n, width, low, high, rank
        self.rank0 = (np.arange(len(rank), dtype=np.int64) * (64 * BLOCK_WORDS) - rank).astype(np.uint32)

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.ascontiguousarray(values, U64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        upper = (values >> U64(width)).astype(np.int64)
        bits = n + (top >> width) + 1
        words = -(-bits // (64 * BLOCK_WORDS)) * BLOCK_WORDS
        ones = np.zeros(words * 64, np.uint8)
        ones[upper + np.arange(n)] = 1
        high = np.packbits(ones, bitorder="little").view("<u8").astype(U64)
        counts = np.bitwise_count(high).reshape(-1, BLOCK_WORDS).sum(axis=1, dtype=np.int64)
        rank = np.concatenate([[0], np.cumsum(counts)]).astype(np.uint32)
        return cls(n, width, _put_bits(values & U64((1 << width) - 1), width), high, rank)

    def parts(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.head": np.array([self.n, self.width], np.int64), f"{name}.low": self.low, f"{name}.high": self.high,
                f"{name}.rank": self.rank}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, width = map(int, arrays[f"{name}.head"])
        return cls(n, width, *(arrays[f"{name}.{x}"] for x in ("low", "high", "rank")))

    def _select(self, which: np.ndarray, ones: bool) -> np.ndarray:
        """Bit positions of the given ones (or zeros) of the upper bits."""
        rank = self.rank if ones else self.rank0
        block = np.searchsorted(rank, which.astype(np.uint32), side="right") - 1
        left, word = which - rank[block], block * BLOCK_WORDS
        for _ in range(BLOCK_WORDS - 1):
            here = np.bitwise_count(self.high[word]).astype(np.int64)
            here = here if ones else 64 - here
            go = left >= here
            left -= np.where(go, here, 0)
            word += go
        bits = self.high[word] if ones else ~self.high[word]
        return word * 64 + _bit_in_word(bits, left.astype(U64)).astype(np.int64)

    def _run(self, bit: np.ndarray) -> np.ndarray:
        """How many ones stand from each position of the upper bits on."""
        length, more = np.zeros(len(bit), np.int64), np.arange(len(bit))
        while len(more):
            at = bit[more] + length[more]
            zeros = ~(self.high[at >> 6] >> (at & 63).astype(U64))
            # above a word's end stand zeros, so a run of ones always ends
            here = np.bitwise_count((zeros & (~zeros + U64(1))) - U64(1)).astype(np.int64)
            length[more] += here
            more = more[(at & 63) + here == 64]
        return length

    def access(self, at: np.ndarray) -> np.ndarray:
        """The numbers at the given places."""
        at = np.asarray(at, np.int64)
        upper = (self._select(at, True) - at).astype(U64)
        return (upper << U64(self.width)) | _get_bits(self.low, at, self.width)

    def successor(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first number that is not below each value (n if none is), and whether it equals the value."""
        values = np.asarray(values, U64)
        place, equal = np.full(len(values), self.n, np.int64), np.zeros(len(values), bool)
        if not self.n:
            return place, equal
        top = int(self.access(np.array([self.n - 1]))[0]) >> self.width
        inside = np.flatnonzero((values >> U64(self.width)) <= U64(top))
        x = values[inside]
        upper, lower = (x >> U64(self.width)).astype(np.int64), x & U64((1 << self.width) - 1)
        bit = np.where(upper > 0, self._select(np.maximum(upper - 1, 0), False) + 1, 0)
        begin = bit - upper
        end = begin + self._run(bit)
        lo, hi, open_ = begin.copy(), end.copy(), np.flatnonzero(begin < end)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            below = _get_bits(self.low, mid, self.width) < lower[open_]
            lo[open_[below]], hi[open_[~below]] = mid[below] + 1, mid[~below]
            open_ = open_[lo[open_] < hi[open_]]
        hit = lo < end
        hit[hit] = _get_bits(self.low, lo[hit], self.width) == lower[hit]
        place[inside], equal[inside] = lo, hit
        return place, equal


def quantised(values: np.ndarray, levels: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """One byte per value and the code book: the means of equally wide bins, so no value moves by more than a bin."""
    if len(values) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.float32)
    low, high = float(values.min()), float(values.max())
    code = np.minimum((values - low) * (levels / (high - low) if high > low else 0.0), levels - 1).astype(np.uint8)
    count = np.bincount(code, minlength=levels)
    book = np.bincount(code, values, levels) / np.maximum(count, 1)
    return code, book.astype(np.float32)


def save(uri: str, arrays: dict[str, np.ndarray]) -> int:
    """Named arrays in one file, each at a multiple of eight bytes."""
    head, pieces, at = {}, [], 0
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        head[name] = [a.dtype.str, at, len(a)]
        pieces += [raw, bytes(-len(raw) % 8)]
        at += len(raw) + (-len(raw) % 8)
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return storage.put(uri, [len(text).to_bytes(8, "little"), text, *pieces])


def mapped(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped; a file in a remote store is fetched into a nameless local file first."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        data = np.memmap(parts.path, np.uint8, "r").view(np.ndarray)
    else:
        local = tempfile.TemporaryFile()  # noqa: SIM115 - lives as long as its map
        local.write(storage.get(uri))
        local.flush()
        data = np.memmap(local, np.uint8, "r").view(np.ndarray)
    size = int.from_bytes(data[:8].tobytes(), "little")
    head = json.loads(data[8:8 + size].tobytes())
    out = {}
    for name, (dtype, at, n) in head.items():
        begin = 8 + size + at
        out[name] = data[begin:begin + n * np.dtype(dtype).itemsize].view(dtype)
    return out
