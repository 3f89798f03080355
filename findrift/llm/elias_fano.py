"""Elias-Fano sequences and an n-gram trie level in memory-mapped files."""

from __future__ import annotations

import tempfile

import numpy as np

U = np.uint64
_BLOCK = 1 << 16


def mapped(a: np.ndarray) -> np.ndarray:
    """A read-only memory map of the array; its file has no name and goes with it."""
    if not a.nbytes:
        return a
    with tempfile.TemporaryFile() as f:
        f.write(np.ascontiguousarray(a).data)
        f.flush()
        return np.memmap(f, a.dtype, "r", shape=a.shape)


class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit numbers.

    Low parts take whole bytes; high parts are a bit vector with a one for
    each element and a zero for each step of the high part, and a directory of
    the zeros before each 64 bits.
    """

    def __init__(self, values: np.ndarray):
        values = np.asarray(values, U)
        self.n = n = len(values)
        top = int(values[-1]) if n else 0
        self.bytes = -(-max(0, (top // max(n, 1)).bit_length() - 1) // 8)
        self.shift = U(8 * self.bytes)
        high = values >> self.shift if self.bytes < 8 else np.zeros(n, U)
        self.buckets = int(high[-1]) + 1 if n else 1
        bits = np.zeros(-(-(n + self.buckets) // 64) * 64, np.uint8)
        bits[high.astype(np.int64) + np.arange(n)] = 1
        zeros = np.cumsum(64 - bits.reshape(-1, 64).sum(axis=1, dtype=np.int64))
        self.zeros = mapped(np.concatenate([[0], zeros]))
        self.high = mapped(np.packbits(bits))
        low = values.astype("<u8").view(np.uint8).reshape(n, 8)[:, :self.bytes] if n else np.empty((0, 0), np.uint8)
        self.low = mapped(low)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros((len(i), 8), np.uint8)
        out[:, :self.bytes] = self.low[i]
        return out.view("<u8").reshape(-1)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Positions of the k-th zeros."""
        word = np.searchsorted(self.zeros, k, side="right") - 1
        bits = np.unpackbits(self.high.reshape(-1, 8)[word], axis=1) ^ 1
        rest = (k - self.zeros[word] + 1).astype(np.uint8)
        return word * 64 + (np.cumsum(bits, axis=1, dtype=np.uint8) < rest[:, None]).sum(axis=1)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each x, the index of the first element >= x (n if none), and whether it equals x."""
        x = np.asarray(x, U)
        at, same = np.empty(len(x), np.int64), np.empty(len(x), bool)
        for a in range(0, len(x), _BLOCK):
            at[a:a + _BLOCK], same[a:a + _BLOCK] = self._successor(x[a:a + _BLOCK])
        return at, same

    def _successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        high = x >> self.shift if self.bytes < 8 else np.zeros(len(x), U)
        past = high >= U(self.buckets)
        h = np.where(past, U(0), high).astype(np.int64)
        low = x & ((U(1) << self.shift) - U(1)) if 0 < self.bytes < 8 else x if self.bytes else np.zeros(len(x), U)
        # the elements of bucket h lie between the zeros before and after it
        first = np.where(h > 0, self._zero(np.maximum(h - 1, 0)) - (h - 1), 0)
        last = self._zero(h) - h
        stop = last.copy()
        if self.bytes:
            while (open_ := np.flatnonzero(first < last)).size:
                mid = (first[open_] + last[open_]) >> 1
                less = self._lows(mid) < low[open_]
                first[open_[less]] = mid[less] + 1
                last[open_[~less]] = mid[~less]
        hit = (first < stop) & ~past
        if self.bytes:
            hit[hit] = self._lows(first[hit]) == low[hit]
        return np.where(past, self.n, first), hit


class Trie:
    """Words, contexts, monotone pointers and successors with quantised values.

    ``context`` and ``word`` are 64-bit hashes, one pair for each n-gram, in any
    order without repetitions; ``code`` is the n-gram's value.
    """

    def __init__(self, context: np.ndarray, word: np.ndarray, code: np.ndarray):
        words, ids = np.unique(word, return_inverse=True)
        contexts, at = np.unique(context, return_inverse=True)
        order = np.lexsort((ids, at))
        self.width = U(max(1, len(words)))
        self.words, self.contexts = EliasFano(words), EliasFano(contexts)
        self.pointers = mapped(np.searchsorted(at[order], np.arange(len(contexts) + 1)).astype(np.uint32))
        # successors become one monotone sequence by their context's number
        self.successors = EliasFano(at[order].astype(U) * self.width + ids[order].astype(U))
        self.codes = mapped(code[order])

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, code) of each n-gram: the context is looked up once for a run
        of equal ones, then the word is searched among its successors."""
        head = np.ones(len(context), bool)
        head[1:] = context[1:] != context[:-1]
        c, known = (v[np.cumsum(head) - 1] for v in self.contexts.successor(context[head]))
        w, seen = self.words.successor(word)
        found, code = known & seen, np.zeros(len(context), self.codes.dtype)
        c, w = c[found], w[found]
        i, hit = self.successors.successor(c.astype(U) * self.width + w.astype(U))
        hit &= (i >= self.pointers[c]) & (i < self.pointers[c + 1])
        found[found] = hit
        code[found] = self.codes[i[hit]]
        return found, code
