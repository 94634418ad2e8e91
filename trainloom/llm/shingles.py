"""Sets of word n-grams as hashes, many documents at a time.

Words are hashed in one sweep over the bytes: with S the running sum of (byte + 1) * B^place, a word from s to e
has (S[e] - S[s]) / B^s modulo 2^64, which does not depend on its place; a finaliser then scatters it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from trainloom.llm.common import BLANK_BYTES

WIDTH = 5
#: Bytes hashed at once, which bounds memory: running sums take some 30 bytes a byte.
SWEEP = 1 << 20
U = np.uint64
BASE, ODD = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[list(BLANK_BYTES)] = True
POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i for i below n."""
    if len(POWERS[0]) < n:
        with np.errstate(over="ignore"):
            for k, x in enumerate((BASE, INVERSE)):
                POWERS[k] = np.concatenate([np.ones(1, U), np.cumprod(np.full(max(n, SWEEP + 1) - 1, x), dtype=U)])
    return POWERS[0], POWERS[1]


def scatter(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(32))) * ODD
        x = (x ^ (x >> U(29))) * BASE
        return x ^ (x >> U(32))


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased) of the documents raw[offsets[i]:offsets[i + 1]], and where each document's begin among them."""
    n = len(raw)
    blank = SPACE[raw]
    inside = ~blank
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before, after = cut[:-1].copy(), cut[1:].copy()
    before[1:] |= blank[:-1]
    after[:-1] |= blank[1:]
    before[:1] = after[-1:] = True
    begin, end = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    up, down = powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, U), np.cumsum((LOWER[raw].astype(U) + U(1)) * up[:n], dtype=U)])
        hashes = scatter((sums[end] - sums[begin]) * down[begin])
    return hashes, np.searchsorted(begin, offsets)


def long_hashes(raw: np.ndarray) -> np.ndarray:
    """Hashes of the words of one long document, sweep by sweep, each cut at a blank."""
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + SWEEP)
        while end < len(raw):
            gap = np.flatnonzero(SPACE[raw[at:end]])
            if len(gap):
                end = at + int(gap[-1]) + 1
                break
            end = min(len(raw), end + SWEEP)  # a word longer than a sweep
        out.append(word_hashes(raw[at:end], np.array([0, end - at]))[0])
        at = end
    return np.concatenate([np.zeros(0, U), *out])


def combined(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of so many words."""
    n = len(hashes) - width + 1
    with np.errstate(over="ignore"):
        out = np.full(max(0, n), U(width))
        for k in range(width):
            out = out * BASE + hashes[k : k + n]
    return scatter(out)


def own_set(hashes: np.ndarray, windows: np.ndarray | None = None) -> np.ndarray:
    """The sorted set of a document with these words; with fewer than WIDTH, all words are its one shingle."""
    if not len(hashes):
        return np.zeros(0, U)
    if len(hashes) < WIDTH:
        return combined(hashes, len(hashes))
    return np.unique(combined(hashes, WIDTH) if windows is None else windows)


def sets_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The set of each text of a string or binary column; null is empty."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        k = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SWEEP, side="right")) - 1)
        k = min(k, len(column))
        raw = data[offsets[i] : offsets[k]]
        if k == i + 1 and len(raw) > SWEEP:
            yield own_set(long_hashes(raw))
        elif not len(raw):
            yield from (np.zeros(0, U) for _ in range(i, k))
        else:
            hashes, places = word_hashes(raw, offsets[i : k + 1] - offsets[i])
            windows = combined(hashes, WIDTH)
            for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True):
                yield own_set(hashes[a:b], windows[a : max(a, b - WIDTH + 1)])
        i = k
