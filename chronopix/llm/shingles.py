"""Word shingles of whole texts, hashed in numpy over Arrow buffers.

Words are runs of bytes other than space and \\x09-\\x0D, with A-Z lower-cased. A word's hash is a polynomial over
randomised byte values modulo 2**64, taken from prefix sums of the batch, then mixed; a shingle's hash mixes its words'.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
BATCH_BYTES = 1 << 18

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_EMPTY = np.empty(0, dtype=np.uint8)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_FACTORS = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(BATCH_BYTES, 1 << (n - 1).bit_length())
        have = np.ones(size, dtype=np.uint64)
        k = 1
        while k < size:
            m = min(k, size - k)
            have[k : k + m] = have[:m] * np.uint64(pow(base, k, 2**64))
            k += m
        if size <= 4 * BATCH_BYTES:  # what a long word needs is not kept
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts data[bounds[i]:bounds[i+1]], and where each text's words begin (len(bounds))."""
    if len(bounds) == 2 and bounds[1] - bounds[0] > 2 * BATCH_BYTES:
        return _long_word_hashes(data[int(bounds[0]) : int(bounds[1])])
    base = int(bounds[0])
    buf = data[base : int(bounds[-1])]
    at = bounds - base
    n = len(buf)
    if not n:
        return np.empty(0, dtype=np.uint64), np.zeros(len(at), dtype=np.int64)
    word = ~_SPACE[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts = at[:-1][at[:-1] < n]
    first[starts] = word[starts]
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends = at[1:][at[1:] > 0] - 1
    last[ends] = word[ends]
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    sums = np.cumsum(_BYTE[buf] * _power_table(_BASE, n))
    h = sums[b].copy()
    inner = a > 0
    h[inner] -= sums[a[inner] - 1]
    h = mix(h * _power_table(_INVERSE, n)[a] + (b - a).astype(np.uint64))
    return h, np.searchsorted(a, at)


def _long_word_hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes() of one long text, in pieces that end at the last space of each BATCH_BYTES or, in a longer word, at its end."""
    parts, at = [], 0
    while at < len(text):
        end = min(at + BATCH_BYTES, len(text))
        if end < len(text):
            spaces = np.flatnonzero(_SPACE[text[at:end]])
            if len(spaces):
                end = at + int(spaces[-1]) + 1
            while end < len(text) and not _SPACE[text[end - 1]]:
                more = np.flatnonzero(_SPACE[text[end : end + BATCH_BYTES]])
                end = end + int(more[0]) + 1 if len(more) else min(end + BATCH_BYTES, len(text))
        piece = text[at:end]
        # a piece of one long word is longer than what is cut again
        parts.append(word_hashes(np.concatenate((piece, _EMPTY)), np.array([0, len(piece), len(piece)]))[0])
        at = end
    hashes = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)
    return hashes, np.array([0, len(hashes)])


def shingle_sets(words: np.ndarray, at: np.ndarray, size: int = WORDS) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes. Fewer than `size` words make one shingle, none an empty set."""
    rolled = np.empty(0, dtype=np.uint64)
    if len(words) >= size:
        m = len(words) - size + 1
        total = np.full(m, size, dtype=np.uint64)
        for j in range(size):
            total += words[j : j + m] * _FACTORS[j]
        rolled = mix(total)
    for i in range(len(at) - 1):
        a, b = int(at[i]), int(at[i + 1])
        if b - a >= size:
            yield np.unique(rolled[a : b - size + 1])
        elif b > a:
            with np.errstate(over="ignore"):
                yield mix(np.array([(words[a:b] * _FACTORS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], dtype=np.uint64))
        else:
            yield np.empty(0, dtype=np.uint64)


def binary_column(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of an Arrow binary or string column without nulls."""
    import pyarrow as pa

    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)), bounds


def slices(bounds: np.ndarray, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes; a longer row stands alone."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
