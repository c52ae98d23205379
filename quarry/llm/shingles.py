"""Hashed word shingles of whole texts, many texts at a time.

Words are runs of bytes between the white space bytes 9-13 and 32, A-Z lower-cased. A word's
hash is a polynomial in its bytes modulo 2**64, got for all words of a slab by differences of
one running sum; a shingle's hash mixes those of its words. A text of fewer words than the
width is one shingle of all its words; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed at once: bounds the working arrays, not the texts.
SLAB = 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 2**64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate(([1], space.astype(np.int8), [1])))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), dtype=np.uint64)))
    return starts, _mix((running[ends] - running[starts]) * _powers(_UNBASE, len(data))[starts])


def _slab(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, one after the other, and where each text's end."""
    data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts, words = _word_hashes(data)
    owner = np.searchsorted(ends, starts, side="right")
    n_words = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(n_words) - n_words
    hashes = np.zeros(len(words), np.uint64)
    for k in range(width):
        hashes[: max(0, len(words) - k)] += words[k:] * np.uint64((2 * k + 1) * int(_BASE) % 2**64)
    whole = np.arange(len(words)) - first[owner] + width <= n_words[owner]
    shorts = np.flatnonzero((n_words > 0) & (n_words < width))
    for i in shorts:
        h = np.array([n_words[i]], np.uint64)
        for k in range(first[i], first[i] + n_words[i]):
            h = _mix(h * _BASE + words[k : k + 1])
        hashes[first[i]], whole[first[i]] = h[0], True
    hashes, owner = _mix(hashes[whole]), owner[whole]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.cumsum(np.bincount(owner[new], minlength=len(texts)))


def shingle_sets(texts, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slabs of texts: index of the first, hashes, ends. Null is empty."""
    held, size, at = [], 0, 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass").lower()
        held.append(raw)
        size += len(raw)
        if size >= SLAB:
            yield at, *_slab(held, width)
            held, size, at = [], 0, i + 1
    if held:
        yield at, *_slab(held, width)


def set_digests(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit digest of each set, from its sorted hashes; 0 only for the empty set."""
    sizes = np.diff(ends, prepend=0)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(hashes + _BASE), dtype=np.uint64)))
    xors = np.concatenate((np.zeros(1, np.uint64), np.bitwise_xor.accumulate(_mix(hashes ^ _UNBASE)) if len(hashes) else np.empty(0, np.uint64)))
    starts = ends - sizes
    digest = _mix((sums[ends] - sums[starts]) ^ _mix(xors[ends] ^ xors[starts]) + sizes.astype(np.uint64))
    return np.where(sizes == 0, np.uint64(0), np.where(digest == 0, np.uint64(1), digest))
