"""Elias-Fano code of sorted 64-bit numbers, searched by vectors of queries, on arrays that may be memory-mapped.

The low bits of each number are packed side by side; of the high bits, ``one`` bits stand for the numbers and a ``zero`` bit
ends each value of the high part. The numbers with high part h follow the h-th zero, which the zeros before
each word of 64 bits and the counts of its bytes find. Every 32nd number is kept whole beside the code, so of the numbers
with one high part, which may be very many, at most 32 are left, among whose low bits the search finds its successor by halving.

Where the high part is the place of a parent, the high bits are pointers: each parent's children in unary, one after another.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_WORD = 64
_SKIP = 32
_AT_ONCE = 1 << 15
_ONES, _TOPS = _U(0x0101010101010101), _U(0x8080808080808080)  # the lowest and the highest bit of each byte
_PAIRS, _FOURS, _EIGHTS = _U(0x5555555555555555), _U(0x3333333333333333), _U(0x0F0F0F0F0F0F0F0F)
# Place of the k-th one (from 0) of a byte, at 8 * byte + k; 8 where there is none.
_PLACE = np.array([([i for i in range(8) if b >> i & 1] + [8] * 8)[:8] for b in range(256)], dtype=np.int64).ravel()


def encode(values: np.ndarray, low_bits: int | None = None) -> dict[str, np.ndarray]:
    """Arrays of the code of ``values``: sorted, distinct, uint64, one at least.

    With ``low_bits`` the high part of a number is all above them, for ``spans``; without, what takes least room."""
    n = len(values)
    base = values[0] if low_bits is None else _U(0)
    shifted = values - base
    if low_bits is None:
        low_bits = max(int(int(shifted[-1]) // n).bit_length() - 1, 0)
    high = (shifted >> _U(low_bits)).astype(np.int64)
    words = np.zeros(n * low_bits // 64 + 2, dtype=np.uint64)
    if low_bits:
        low = shifted & _U((1 << low_bits) - 1)
        bit = np.arange(n, dtype=np.int64) * low_bits
        word, off = bit >> 6, (bit & 63).astype(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[first]] = np.add.reduceat(low << off, first)  # the bits of different numbers never overlap
        spills = off > _U(64 - low_bits)
        words[word[spills] + 1] |= low[spills] >> (_U(64) - off[spills])
    length = n + int(high[-1]) + 1
    ones = np.zeros((length // _WORD + 1) * _WORD, dtype=np.uint8)
    ones[high + np.arange(n)] = 1
    packed = np.packbits(ones, bitorder="little").view(np.uint64)
    held = _WORD - np.bitwise_count(packed).astype(np.int64)
    return {
        "head": np.array([n, low_bits, int(high[-1])], dtype=np.int64),
        "base": np.array([base], dtype=np.uint64),
        "low": words,
        "high": packed,
        "zeros": np.cumsum(held) - held,
        "skip": values[::_SKIP],
    }


def _nth_one(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one (from 0) of each word, which has more than k."""
    counts = words - (words >> _U(1) & _PAIRS)
    counts = (counts & _FOURS) + (counts >> _U(2) & _FOURS)
    counts = (counts + (counts >> _U(4)) & _EIGHTS) * _ONES  # each byte: the ones up to its end
    # The k-th one is in the first byte up to whose end there are more than k.
    shift = np.bitwise_count((k * _ONES | _TOPS) - counts & _TOPS).astype(np.uint64) << _U(3)
    left = k - (counts << _U(8) >> shift & _U(0xFF))
    return shift.view(np.int64) + _PLACE[((words >> shift & _U(0xFF)) << _U(3) | left).view(np.int64)]


def _nth_zero(code: dict[str, np.ndarray], k: np.ndarray) -> np.ndarray:
    """Bit position of the k-th zero (from 0) of the high bits."""
    out = np.empty(len(k), dtype=np.int64)
    for at in range(0, len(k), _AT_ONCE):
        few = k[at : at + _AT_ONCE]
        word = np.searchsorted(code["zeros"], few, side="right") - 1
        left = (few - code["zeros"][word]).view(np.uint64)
        out[at : at + _AT_ONCE] = (word << 6) + _nth_one(~code["high"][word], left)
    return out


def spans(code: dict[str, np.ndarray], high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the numbers of each high part begin and end; an empty span where there are none."""
    first, end = np.zeros((2, len(high)), dtype=np.int64)
    near = np.flatnonzero(high <= _U(code["head"][2]))
    inside = high[near].astype(np.int64)
    start = np.zeros(len(near), dtype=np.int64)
    later = np.flatnonzero(inside)
    start[later] = _nth_zero(code, inside[later] - 1) + 1
    # The ones from there on are the span; few reach beyond their word.
    off = (start & 63).astype(np.uint64)
    zeros = ~code["high"][start >> 6] >> off
    ones = np.bitwise_count((zeros & (~zeros + _U(1))) - _U(1)).astype(np.int64)
    long = np.flatnonzero(zeros == 0)
    ones[long] = _nth_zero(code, inside[long]) - start[long]
    first[near] = start - inside
    end[near] = start - inside + ones
    return first, end


def _low_of(code: dict[str, np.ndarray], i: np.ndarray) -> np.ndarray:
    low_bits, words = int(code["head"][1]), code["low"]
    if not low_bits:
        return np.zeros(len(i), dtype=np.uint64)
    mask, bit = _U((1 << low_bits) - 1), i * low_bits
    if low_bits <= 57:  # then they lie in 8 bytes
        at_bytes = np.ndarray(words.nbytes - 7, dtype=np.uint64, buffer=words.view(np.uint8), strides=(1,))
        return at_bytes[bit >> 3] >> (bit & 7).view(np.uint64) & mask
    word, off = bit >> 6, (bit & 63).view(np.uint64)
    value = words[word] >> off
    spill = off > _U(64 - low_bits)
    return np.where(spill, value | (words[word + 1] << ((_U(64) - off) & _U(63))), value) & mask


def search(code: dict[str, np.ndarray], first: np.ndarray, end: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Index of each number, all of whose high part lie in its span, -1 where there is none."""
    out = np.full(len(numbers), -1, dtype=np.int64)
    for at in range(0, len(numbers), _AT_ONCE):
        part = slice(at, at + _AT_ONCE)
        out[part] = _search_few(code, first[part], end[part], numbers[part])
    return out


def _search_few(code: dict[str, np.ndarray], first: np.ndarray, end: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    low = numbers - code["base"][0] & _U((1 << int(code["head"][1])) - 1)
    near = (np.searchsorted(code["skip"], numbers, side="right") - 1) * _SKIP
    below, above = np.maximum(first, near), np.minimum(end, near + _SKIP)
    wide = np.flatnonzero(above - below > 1)
    if len(wide):
        few_below, few_above, few_low = below[wide], above[wide], low[wide]
        for _ in range(int((few_above - few_below).max() - 1).bit_length()):
            middle = few_below + few_above >> 1
            more = _low_of(code, middle) > few_low
            few_above = np.where(more, middle, few_above)
            few_below = np.where(more, few_below, middle)
        below[wide] = few_below
    out = np.full(len(numbers), -1, dtype=np.int64)
    held = np.flatnonzero(below < above)
    at = below[held]
    hit = _low_of(code, at) == low[held]
    out[held[hit]] = at[hit]
    return out


def find(code: dict[str, np.ndarray], queries: np.ndarray) -> np.ndarray:
    """Index of each query among the coded numbers, -1 where it is none of them."""
    out = np.full(len(queries), -1, dtype=np.int64)
    inside = np.flatnonzero(queries >= code["base"][0])
    if not len(inside):
        return out
    asked = queries[inside]
    high = asked - code["base"][0] >> _U(code["head"][1])
    # Sorted queries of one context follow each other: its span is looked up once.
    new = np.concatenate([[True], high[1:] != high[:-1]])
    first, end = spans(code, high[new])
    run = np.cumsum(new) - 1
    out[inside] = search(code, first[run], end[run], asked)
    return out
