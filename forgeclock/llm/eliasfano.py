"""Elias-Fano sequences in files that are mapped into memory, with whole arrays of queries at a time.

A sorted sequence of ``n`` numbers below ``u`` keeps the ``l = log2(u / n)`` low bits of each number as they are, and the rest as a
bit string in which every number sets one bit behind the zeros that count up to its high part.  That takes about ``l + 2`` bits a number,
and counts before each word of that string two more.  Ones give numbers by place; zeros give the places of all numbers with a high part, among which a search ends in a step or two.
"""

from __future__ import annotations

import itertools
import json
import mmap
import os
import uuid

import numpy as np

_ONE = np.uint64(1)


def _u(x) -> np.ndarray:
    return np.asarray(x).astype(np.uint64, copy=False)


def encode(values: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of a sorted sequence of numbers from 0 on."""
    values = _u(values)
    n = len(values)
    top = int(values[-1]) + 1 if n else 1
    low = max(0, (top // max(1, n)).bit_length() - 1)
    packed = np.zeros(n * low // 64 + 2, np.uint64)
    if low:
        part = values & np.uint64((1 << low) - 1)
        at = np.arange(n, dtype=np.uint64) * np.uint64(low)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.add.at(packed, word, part << shift)
        np.add.at(packed, word + 1, part >> _ONE >> (np.uint64(63) - shift))
    places = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    size = (int(places[-1]) if n else 0) + 2
    high = np.zeros(size // 64 + 2, np.uint64)
    np.add.at(high, places >> 6, _ONE << _u(places & 63))
    # how many ones, and how many zeros, stand before each word
    kind = np.uint32 if size < 1 << 32 else np.uint64
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high[:-1]), dtype=np.int64)])
    zeros = 64 * np.arange(len(high)) - ones
    head = np.array([n, low, size - n], np.int64)
    return {"head": head, "low": packed, "high": high, "ones": ones.astype(kind), "zeros": zeros.astype(kind)}


def _select(words: np.ndarray, before: np.ndarray, rank: np.ndarray, flip: np.uint64) -> np.ndarray:
    """Place of the bit number ``rank`` that is set (or, with ``flip`` all ones, not set); ``before`` counts them up to each word."""
    word = np.searchsorted(before, rank.astype(before.dtype), "right") - 1
    return (word << 6) + _within(words[word] ^ flip, _u(rank - before[word]))


def _repeated(byte: int) -> np.uint64:
    return np.uint64(int.from_bytes(bytes([byte] * 8), "little"))


#: Place of the bit number ``i`` that is set in byte ``b``, at ``i * 256 + b``.
_IN_BYTE = np.array([([j for j in range(8) if b >> j & 1] + [0] * 8)[i] for i in range(8) for b in range(256)], np.uint64)


def _within(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the set bit number ``rank`` in each word: counts of all bytes at once, then a table."""
    tops = _repeated(0x80)
    sums = words - (words >> _ONE & _repeated(0x55))
    sums = (sums & _repeated(0x33)) + (sums >> np.uint64(2) & _repeated(0x33))
    sums = (sums + (sums >> np.uint64(4)) & _repeated(0x0F)) * _repeated(1)
    byte = _u(np.bitwise_count((rank * _repeated(1) | tops) - sums & tops)) << np.uint64(3)
    before = sums << np.uint64(8) >> byte & np.uint64(255)
    inside = _IN_BYTE[((rank - before << np.uint64(8)) | (words >> byte & np.uint64(255))).astype(np.int64)]
    return (byte + inside).astype(np.int64)


def _window(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 64 bits from place ``at`` on."""
    word, shift = at >> 6, _u(at & 63)
    return words[word] >> shift | words[word + 1] << _ONE << (np.uint64(63) - shift)


def _zeros_before(words: np.ndarray) -> np.ndarray:
    """Zeros below the lowest set bit; 64 where none is set."""
    return np.bitwise_count((words & (~words + _ONE)) - _ONE).astype(np.int64)


class Sequence:
    """Read access to an encoded sequence."""

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.n, low, self.n_zeros = (int(x) for x in arrays["head"])
        self.bits, self.low, self.high, self.ones, self.zeros = low, arrays["low"], arrays["high"], arrays["ones"], arrays["zeros"]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.bits
        word, shift = at >> 6, _u(at & 63)
        return (self.low[word] >> shift | self.low[word + 1] << _ONE << (np.uint64(63) - shift)) & np.uint64((1 << self.bits) - 1)

    def at(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places ``i``."""
        high = _select(self.high, self.ones, i, np.uint64(0)) - i
        return _u(high) << np.uint64(self.bits) | self._low(i)

    def between(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers at places ``i`` and ``i + 1``; the second is none where ``i`` is the last place."""
        at = _select(self.high, self.ones, i, np.uint64(0))
        step = _zeros_before(_window(self.high, at + 1))
        after = at + 1 + step
        far = np.nonzero((step == 64) & (i + 1 < self.n))[0]
        after[far] = _select(self.high, self.ones, i[far] + 1, np.uint64(0))
        bits = np.uint64(self.bits)
        return _u(at - i) << bits | self._low(i), _u(after - i - 1) << bits | self._low(i + 1)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first number that is ``x`` or more, whether it is ``x``)."""
        x = _u(x)
        high = np.minimum(x >> np.uint64(self.bits), np.uint64(self.n_zeros)).astype(np.int64)
        zero = _select(self.high, self.zeros, np.maximum(high - 1, 0), ~np.uint64(0))
        at = np.where(high > 0, zero + 1, 0)  # where the bits of the high part begin
        begin, many = at - high, _zeros_before(~_window(self.high, at))
        long = np.nonzero((many == 64) & (high < self.n_zeros))[0]
        many[long] = _select(self.high, self.zeros, high[long], ~np.uint64(0)) - at[long]
        end = np.minimum(begin + many, self.n)
        want = x & np.uint64((1 << self.bits) - 1)
        met = np.zeros(len(high), bool)
        todo = np.nonzero(begin < end)[0]
        least, most = np.zeros(len(todo)), np.full(len(todo), float(1 << self.bits))  # what is known of the low bits there
        for step in itertools.count():
            if not len(todo):
                break
            low, high, sought = begin[todo], end[todo], want[todo]
            share = 0.5 if step % 3 == 2 else (sought - least) / np.maximum(most - least, 1)  # guess, and halve now and then
            middle = np.clip(low + (share * (high - low)).astype(np.int64), low, high - 1)
            found = self._low(middle)
            less = found < sought
            begin[todo], end[todo] = low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
            met[todo] |= found == sought
            stay = low < high
            todo, least, most = todo[stay], np.where(less, found, least)[stay], np.where(less, most, found)[stay]
        return begin, met


def store(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file with a header; it appears whole or not at all, so a task that runs twice does no harm."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    head, at = {}, 0
    for name, x in arrays.items():
        head[name] = (x.dtype.str, len(x), at)
        at += (x.nbytes + 7) // 8 * 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    with open(draft := f"{path}.{uuid.uuid4().hex}", "wb") as out:
        out.write(len(text).to_bytes(8, "little") + text)
        for x in arrays.values():
            out.write(x.tobytes() + bytes(-x.nbytes % 8))
    os.replace(draft, path)


def load(path: str) -> dict[str, np.ndarray] | None:
    """Arrays of a stored file, mapped; None if there is no such file."""
    try:
        with open(path, "rb") as file:
            data = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
    except FileNotFoundError:
        return None
    size = int.from_bytes(data[:8], "little")
    return {n: np.frombuffer(data, kind, many, 8 + size + at) for n, (kind, many, at) in json.loads(data[8 : 8 + size]).items()}


def named(prefix: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{prefix}.{k}": x for k, x in arrays.items()}


def sequence(arrays: dict[str, np.ndarray], prefix: str) -> Sequence:
    return Sequence({k.removeprefix(f"{prefix}."): x for k, x in arrays.items() if k.startswith(f"{prefix}.")})
