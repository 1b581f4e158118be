"""Elias-Fano sequences and an n-gram trie over them, in one memory-mapped block of bytes."""

from __future__ import annotations

import mmap

import numpy as np

BLOCK = 1 << 18  # values decoded at a time


class EliasFano:
    """A monotone sequence. Each value is cut into low bits, stored as they are, and a high part, stored as the distance
    to the one before in unary; the position of every BLOCK-th one in the unary bits is kept."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, marks: np.ndarray):
        self.n, self.bits, self.low, self.high, self.marks = n, bits, low, high, marks

    @staticmethod
    def encode(values: np.ndarray) -> "EliasFano":
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, int(np.floor(np.log2(max(1, top / max(1, n))))))
        low = np.empty((n, bits), np.uint8)
        for b in range(bits):
            low[:, b] = values >> b & 1
        at = (values >> bits) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        high[at] = 1
        return EliasFano(n, bits, np.packbits(low.ravel()), np.packbits(high), at[::BLOCK].astype(np.int64))

    def block(self, k: int) -> np.ndarray:
        """Values k * BLOCK up to the next block."""
        count = min(BLOCK, self.n - k * BLOCK)
        first = int(self.marks[k])
        last = int(self.marks[k + 1]) if k + 1 < len(self.marks) else 8 * len(self.high)
        unary = np.unpackbits(self.high[first // 8: -(-last // 8)])
        high = np.flatnonzero(unary[first % 8:])[:count] + first - k * BLOCK - np.arange(count)
        if not self.bits:
            return high
        start = k * BLOCK * self.bits // 8
        low = np.unpackbits(self.low[start: start + -(-count * self.bits // 8)], count=count * self.bits).reshape(count, self.bits)
        value = np.zeros(count, np.int64)
        for b in range(self.bits):
            value |= low[:, b].astype(np.int64) << b
        return high << self.bits | value

    def take(self, at: np.ndarray) -> np.ndarray:
        """Values at ascending positions."""
        out = np.empty(len(at), np.int64)
        for k in range(len(self.marks)):
            a, b = np.searchsorted(at, (k * BLOCK, (k + 1) * BLOCK))
            if b > a:
                out[a:b] = self.block(k)[at[a:b] - k * BLOCK]
        return out

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Positions of ascending values, -1 for those that are not there. Values must be distinct in the sequence."""
        out = np.full(len(wanted), -1, np.int64)
        for k in range(len(self.marks)):
            values = self.block(k)
            a, b = np.searchsorted(wanted, values[0]), np.searchsorted(wanted, values[-1], side="right")
            if b > a:
                at = np.searchsorted(values, wanted[a:b])
                out[a:b] = np.where(values[at] == wanted[a:b], at + k * BLOCK, -1)
        return out

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.bits], np.int64), self.low, self.high, self.marks]


def quantise(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of 8 bits and the value of each: the means of 256 bins of equally many values."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(256, np.float32)
    order = np.argsort(values, kind="stable")
    code = np.empty(len(values), np.uint8)
    code[order] = (np.arange(len(values)) * 256 // len(values)).astype(np.uint8)
    total, n = np.bincount(code, values, 256), np.bincount(code, minlength=256)
    return code, (total / np.maximum(n, 1)).astype(np.float32)


def packed(arrays: list[np.ndarray]) -> bytes:
    head = np.array([len(arrays)] + [x for a in arrays for x in (ord(a.dtype.char), len(a))], np.int64)
    return b"".join([head.tobytes(), *(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)])


def unpacked(view: bytes | mmap.mmap) -> list[np.ndarray]:
    count = int(np.frombuffer(view, np.int64, 1)[0])
    at, arrays = 8 + 16 * count, []
    for kind, n in np.frombuffer(view, np.int64, 2 * count, 8).reshape(-1, 2).tolist():
        a = np.frombuffer(view, np.dtype(chr(kind)), n, at)
        arrays.append(a)
        at += a.nbytes + -a.nbytes % 8
    return arrays


class Level:
    """Successors of contexts 0 .. n - 1, by context: pointers to the first of each, and the successors made monotone by
    adding, for each context, one more than the last value of the contexts before it."""

    def __init__(self, pointer: EliasFano, base: EliasFano, value: EliasFano, prob: np.ndarray, probs: np.ndarray, rest: np.ndarray, rests: np.ndarray):
        self.pointer, self.base, self.value, self.prob, self.probs, self.rest, self.rests = pointer, base, value, prob, probs, rest, rests

    @staticmethod
    def build(contexts: int, context: np.ndarray, successor: np.ndarray, prob: np.ndarray, rest: np.ndarray) -> "Level":
        """Entries ascending by (context, successor); ``prob`` of each entry and ``rest`` of each context in log10."""
        pointer = np.searchsorted(context, np.arange(contexts + 1))
        last = np.zeros(contexts, np.int64)
        last[context] = successor + 1  # ascending, so the largest stays
        base = np.append(0, np.cumsum(last))
        return Level(EliasFano.encode(pointer), EliasFano.encode(base), EliasFano.encode(base[context] + successor), *quantise(prob), *quantise(rest))

    def find(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Entry of each (context, successor), -1 if there is none. The successors of a context are those between its
        base and the next one's, which its pointers bound."""
        out = np.full(len(context), -1, np.int64)
        if not self.value.n or not len(context):
            return out
        base, limit, low, high = self._at(self.base, context), self._at(self.base, context + 1), self.first(context), self.first(context + 1)
        ok = np.flatnonzero((successor < limit - base) & (high > low))
        wanted, back = np.unique((base + successor)[ok], return_inverse=True)
        out[ok] = self.value.find(wanted)[back]
        return out

    @staticmethod
    def _at(sequence: EliasFano, places: np.ndarray) -> np.ndarray:
        only, back = np.unique(places, return_inverse=True)
        return sequence.take(only)[back]

    def first(self, context: np.ndarray) -> np.ndarray:
        return self._at(self.pointer, context)

    def arrays(self) -> list[np.ndarray]:
        return [*self.pointer.arrays(), *self.base.arrays(), *self.value.arrays(), self.prob, self.probs, self.rest, self.rests]


class Trie:
    """Levels of an n-gram trie. A level's contexts are places in an ascending list, its successors are numbers that tell
    the successors of one context apart."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def dump(self) -> bytes:
        return packed([a for level in self.levels for a in level.arrays()])

    @staticmethod
    def load(data: bytes) -> "Trie":
        """The levels over a memory map that holds all their arrays; no file of one machine is needed."""
        view = mmap.mmap(-1, len(data))
        view.write(data)
        arrays = unpacked(view)
        levels = []
        for k in range(0, len(arrays), 16):
            made = [EliasFano(int(arrays[i][0]), int(arrays[i][1]), *arrays[i + 1: i + 4]) for i in range(k, k + 12, 4)]
            levels.append(Level(*made, *arrays[k + 12: k + 16]))
        return Trie(levels)
