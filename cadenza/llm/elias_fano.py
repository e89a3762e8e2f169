"""Elias-Fano sequences over numpy arrays that may be memory-mapped."""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)


def pack_fields(values: np.ndarray, bits: int) -> np.ndarray:
    """Fields of `bits` bits, one after another, in 64-bit words (with one spare word)."""
    out = np.zeros(len(values) * bits // 64 + 2, np.uint64)
    if not bits or not len(values):
        return out
    at = np.arange(len(values), dtype=np.int64) * bits
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
    over = np.flatnonzero(shift.astype(np.int64) + bits > 64)  # one field at most runs over into each word
    out[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
    return out


def field(words: np.ndarray, bits: int, i: np.ndarray) -> np.ndarray:
    if not bits:
        return np.zeros(len(i), np.uint64)
    at = i * bits
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return (low | high) & np.uint64((1 << bits) - 1)


_L8, _H8 = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_IN_BYTE = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _k, _p in enumerate(p for p in range(8) if _b >> p & 1):
        _IN_BYTE[_b, _k] = _p
_IN_BYTE = _IN_BYTE.ravel()


def select_in_word(w: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th set bit (from 0) of each word: by byte sums in all bytes at once, then a table of bytes."""
    k = k.astype(np.uint64)
    s = w - ((w >> ONE) & np.uint64(0x5555555555555555))
    s = (s & np.uint64(0x3333333333333333)) + ((s >> np.uint64(2)) & np.uint64(0x3333333333333333))
    s = ((s + (s >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _L8  # bits in each byte and all below
    place = np.bitwise_count(((k * _L8 | _H8) - s) & _H8).astype(np.uint64) << np.uint64(3)  # bytes whose sums are not over k
    k -= ((s << np.uint64(8)) >> place) & np.uint64(0xFF)
    return (place + _IN_BYTE[(((w >> place) & np.uint64(0xFF)) << np.uint64(3)) + k]).astype(np.int64)


class EliasFano:
    """A non-decreasing sequence below a bound.  `low` holds the lower bits, `high` the upper ones in unary: for each
    value of the upper part a 1 an element, then a 0.  `zeros` and `ones` count bits before every 64-bit word."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        self.n, self.bits, self.low, self.high, self.zeros, self.ones = n, bits, low, high, zeros, ones

    @classmethod
    def build(cls, values: np.ndarray, bound: int) -> EliasFano:
        values, n = values.astype(np.uint64), len(values)
        bits = max(0, (bound // max(1, n)).bit_length() - 1)
        upper = (values >> np.uint64(bits)).astype(np.int64)
        size = n + (bound >> bits) + 1
        flags = np.zeros(-(-size // 64) * 64, bool)
        flags[upper + np.arange(n)] = True
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        ones = np.zeros(len(high) + 1, np.int64)
        np.cumsum(np.bitwise_count(high), out=ones[1:])
        zeros = np.arange(len(high) + 1, dtype=np.int64) * 64 - ones
        kind = np.uint32 if size < 1 << 32 else np.int64
        return cls(n, bits, pack_fields(values & np.uint64((1 << bits) - 1), bits), high, zeros.astype(kind), ones.astype(kind))

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.{k}": getattr(self, k) for k in ("low", "high", "zeros", "ones")} | {f"{name}.shape": np.array([self.n, self.bits], np.int64)}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, bits = arrays[f"{name}.shape"].tolist()
        return cls(n, bits, *(arrays[f"{name}.{k}"] for k in ("low", "high", "zeros", "ones")))

    def _select(self, ranks: np.ndarray, flip: bool, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(ranks, k, "right") - 1
        w = self.high[word]
        return word * 64 + select_in_word(~w if flip else w, k - ranks[word].astype(np.int64))

    def _next(self, place: np.ndarray, flip: bool, ranks: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The place of the k-th bit, given that of the one before: mostly in the same word."""
        word, bit = place >> 6, (place & 63).astype(np.uint64)
        w = self.high[word]
        w = (~w if flip else w) >> bit >> ONE  # two shifts: one by 64 is undefined
        out = place + 1 + np.bitwise_count((w & (~w + ONE)) - ONE).astype(np.int64)
        far = np.flatnonzero(w == 0)
        if len(far):
            out[far] = self._select(ranks, flip, k[far])
        return out

    def pair(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Elements i and i + 1."""
        a = self._select(self.ones, False, i)
        b = self._next(a, False, self.ones, i + 1)
        bits = np.uint64(self.bits)
        return ((a - i).astype(np.uint64) << bits) | field(self.low, self.bits, i), ((b - i - 1).astype(np.uint64) << bits) | field(self.low, self.bits, i + 1)

    def among(self, x: np.ndarray, first: np.ndarray, size: np.ndarray, before: np.ndarray, most: int) -> np.ndarray:
        """Index of the element that equals x among the `size` from `first` on, -1 without; before: the place of the bit of
        the element before first (-1 for the first of all).  Steps through the elements: for runs of at most `most`."""
        out, left = np.full(len(x), -1, np.int64), np.flatnonzero(size > 0)
        place, upper, low = before, x >> np.uint64(self.bits), x & np.uint64((1 << self.bits) - 1)
        for j in range(most):
            if not len(left):
                break
            at = first[left] + j
            place = self._after(place if j else place[left], self.ones, at)
            here = (place - at).astype(np.uint64)
            hit = here == upper[left]
            some = np.flatnonzero(hit)
            hit[some] = field(self.low, self.bits, at[some]) == low[left[some]]
            out[left[hit]] = at[hit]
            go = ~hit & (size[left] > j + 1) & (here <= upper[left])
            left, place = left[go], place[go]
        return out

    def _after(self, place: np.ndarray, ranks: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The place of the k-th 1, given that of the one before (-1 if there is none)."""
        new = np.flatnonzero(place < 0)
        if not len(new):
            return self._next(place, False, ranks, k)
        out = self._next(np.maximum(place, 0), False, ranks, k)
        out[new] = self._select(ranks, False, k[new])
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        """Elements by index."""
        return self.value(self.place(i), i)

    def place(self, i: np.ndarray) -> np.ndarray:
        """Where the upper parts of elements end."""
        return self._select(self.ones, False, i)

    def value(self, place: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Elements, given their places."""
        return ((place - i).astype(np.uint64) << np.uint64(self.bits)) | field(self.low, self.bits, i)

    def successor(self, x: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first element not below x, whether it equals x), in [first, last) if given; x must be below the bound."""
        upper = (x >> np.uint64(self.bits)).astype(np.int64)
        low = x & np.uint64((1 << self.bits) - 1)
        before = self._select(self.zeros, True, np.maximum(upper - 1, 0))  # the 0 that ends the bucket before
        start = np.where(upper > 0, before + 1 - upper, 0)
        end = np.where(upper > 0, self._next(before, True, self.zeros, upper), before) - upper
        if first is not None:
            start, end = np.maximum(start, first), np.minimum(end, last)
        lo, hi = start, np.maximum(end, start)
        end = hi.copy()
        while True:  # binary search in the bucket
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            less = field(self.low, self.bits, mid) < low[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        hit = lo < end
        at = np.flatnonzero(hit)
        hit[at] = field(self.low, self.bits, lo[at]) == low[at]
        return lo, hit
