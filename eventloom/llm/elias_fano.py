"""Elias-Fano coded monotone sequences in numpy: access, and search for the first element not below a value.

Each of n increasing numbers below u is split: the low floor(log2(u / n)) bits are packed, the high parts are coded in unary in
a bit vector of about 2n bits. All queries take arrays. The arrays may be slices of a memory-mapped file.
"""

from __future__ import annotations

import numpy as np

_U64 = np.uint64
_ones = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: _select[b, k]: place of the k-th one of byte b
_select = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _k, _p in enumerate(p for p in range(8) if _b >> p & 1):
        _select[_b, _k] = _p


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """``values`` of ``width`` bits each, end to end in 64-bit words, with a spare word behind."""
    out = np.zeros(len(values) * width // 64 + 2, _U64)
    if width:
        at = np.arange(len(values), dtype=np.int64) * width
        word, shift = at >> 6, (at & 63).astype(_U64)
        _or_into(out, word, values << shift)
        over = np.flatnonzero((at & 63) + width > 64)
        _or_into(out, word[over] + 1, values[over] >> (_U64(64) - shift[over]))
    return out


def _or_into(out: np.ndarray, word: np.ndarray, bits: np.ndarray) -> None:
    if len(word):  # words are in order: one step for each run of equal ones
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        out[word[first]] |= np.bitwise_or.reduceat(bits, first)


def unpack_bits(words: np.ndarray, width: int, index: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(index), _U64)
    at = index.astype(np.int64) * width
    word, shift = at >> 6, (at & 63).astype(_U64)
    low = words[word] >> shift
    # a shift by 64 is not defined: in two steps
    high = (words[word + 1] << _U64(1)) << (_U64(63) - shift)
    return (low | high) & _U64((1 << width) - 1)


class EliasFano:
    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.width, self.low, self.high = n, width, low, high
        self._before = np.concatenate(([0], np.cumsum(_ones[high], dtype=np.int64)))  # ones before each byte: the search directory
        self._zeros = np.arange(len(self._before), dtype=np.int64) * 8 - self._before

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """``values``: non-decreasing unsigned numbers."""
        values = np.asarray(values, _U64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1) if n else 0
        high = (values >> _U64(width)).astype(np.int64)
        bits = np.zeros(-(-(int(high[-1]) + n + 2) // 64) * 64 if n else 64, np.uint8)
        bits[high + np.arange(n)] = 1
        low = pack_bits(values & _U64((1 << width) - 1), width)
        return cls(n, width, low, np.packbits(bits, bitorder="little"))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.width, len(self.low), len(self.high)], np.int64)
        return head.tobytes() + np.ascontiguousarray(self.low).tobytes() + np.ascontiguousarray(self.high).tobytes()

    @classmethod
    def from_buffer(cls, data, at: int = 0) -> tuple[EliasFano, int]:
        """The sequence at byte ``at`` of bytes or of a mapped file, and where it ends."""
        n, width, lows, highs = (int(x) for x in np.frombuffer(data, np.int64, 4, at))
        low = np.frombuffer(data, _U64, lows, at + 32)
        high = np.frombuffer(data, np.uint8, highs, at + 32 + 8 * lows)
        return cls(n, width, low, high), at + 32 + 8 * lows + highs

    def _place(self, rank: np.ndarray, directory: np.ndarray, flip: int) -> np.ndarray:
        """Place of the rank-th one (``flip`` 0) or zero (255) of the bit vector."""
        byte = np.minimum(np.searchsorted(directory, rank, side="right") - 1, len(directory) - 2)
        left = np.clip(rank - directory[byte], 0, 7)
        return byte * 8 + _select[self.high[byte] ^ np.uint8(flip), left]

    def access(self, index: np.ndarray) -> np.ndarray:
        index = np.asarray(index, np.int64)
        high = self._place(index, self._before, 0) - index
        return high.astype(_U64) << _U64(self.width) | unpack_bits(self.low, self.width, index)

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        index = np.arange(self.n)
        return (places - index).astype(_U64) << _U64(self.width) | unpack_bits(self.low, self.width, index)

    def _below(self, high: np.ndarray) -> np.ndarray:
        """How many elements have a smaller high part."""
        out = np.zeros(len(high), np.int64)
        total = int(self._zeros[-1])
        inside = (high > 0) & (high <= total)
        rank = high[inside] - 1
        out[inside] = np.minimum(self._place(rank, self._zeros, 255) - rank, self.n)
        out[high > total] = self.n
        return out

    def successor(self, value: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first element not below each value, and whether it is equal; only within [low, high) where given."""
        value = np.asarray(value, _U64)
        top = value >> _U64(self.width)
        top = np.minimum(top, _U64(1 << 62)).astype(np.int64)
        start, end = self._below(top), self._below(top + 1)
        if low is not None:
            start, end = np.maximum(start, low), np.minimum(end, high)
            end = np.maximum(start, end)
        stop, rest = end.copy(), value & _U64((1 << self.width) - 1)
        live = np.flatnonzero(start < end)
        while len(live):
            middle = (start[live] + end[live]) >> 1
            less = unpack_bits(self.low, self.width, middle) < rest[live]
            start[live] = np.where(less, middle + 1, start[live])
            end[live] = np.where(less, end[live], middle)
            live = live[start[live] < end[live]]
        equal = start < stop
        at = np.flatnonzero(equal)
        equal[at] = unpack_bits(self.low, self.width, start[at]) == rest[at]
        return start, equal
