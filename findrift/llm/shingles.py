"""Hashes of words and of word shingles for many texts at once, with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_rng = np.random.default_rng(20_011)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=U) * U(2) + U(1)
_SPAN = 4096
_POWER = np.cumprod(np.full(_SPAN, U(0x9E3779B97F4A7C15)), dtype=U)
_STEP = U(0xD6E8FEB86659FD93)

#: Letters, digits and _ of ASCII, and every byte of other characters.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
#: Anything but white space of ASCII.
SPACED_BYTES = np.ones(256, bool)
SPACED_BYTES[[32, *range(9, 14)]] = False

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(29))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(32))


def text_slices(texts: pa.Array, size: int = 3_000_000) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of about ``size`` bytes each (one row at least)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield at, texts.slice(at, stop - at)
        at = stop


def word_hashes(texts: pa.Array, is_word: np.ndarray = WORD_BYTES, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and the words of each text.

    Null texts have no words.  With ``fold`` every letter is lower-cased, else
    only A-Z.
    """
    texts = pc.cast(pc.fill_null(texts, ""), pa.large_string())
    if fold:
        texts = pc.utf8_lower(texts)
    n = len(texts)
    if not n:
        return np.empty(0, U), np.empty(0, np.int64)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + n + 1]
    raw = np.frombuffer(data or b"", np.uint8)[offs[0]:offs[-1]]
    if not fold:
        raw = _LOWER[raw]
    offs = offs - offs[0]
    inside = is_word[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offs[:-1][np.diff(offs) > 0]
    first[heads] = inside[heads]  # a word ends with its text
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, U), np.zeros(n, np.int64)
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw)))) if starts[0] == 0 else \
        np.concatenate([np.zeros(starts[0], np.int64), np.arange(starts[0], len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))])
    value = _BYTE[raw] * _POWER[place % _SPAN]
    value[~inside] = 0
    return mix(np.add.reduceat(value, starts)), np.diff(np.searchsorted(starts, offs))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and the text of each (its number)."""
    n = max(0, len(words) - size + 1)
    owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    whole = owner[:n] == owner[size - 1:size - 1 + n]
    h = np.zeros(n, U)
    for i in range(size):
        h = h * _STEP + words[i:i + n]
    return mix(h[whole]), owner[:n][whole]


def unique_in_text(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, owner, times) without repetitions inside a text; sorted by owner, then hash."""
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return h[at], owner[at], np.diff(np.append(at, len(h)))
