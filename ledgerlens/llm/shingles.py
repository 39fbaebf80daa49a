"""Word shingles, MinHash minima and exact similarities of texts in NumPy, over whole batches of bytes at a time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

SHINGLE = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_COUNT = np.arange(SHINGLE + 1, dtype=np.uint64) * _PLACE[SHINGLE]  # so that sets of fewer words differ from windows
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes hashed at a time: the working memory beside a text and its words.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64) -> np.ndarray:
    steps = np.full(CHUNK + 1, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)


def words_of(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' lower-cased (A-Z) bytes, each followed by a line end; each text's offset; each word's start, end, hash.

    A word's hash is a polynomial of its bytes, so it adds up over chunks, however long the word or the text is.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.cumsum([0, *(len(x) + 1 for x in raw)])
    data = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    del raw
    space = _SPACE[data]
    marks = np.flatnonzero(space[1:] != space[:-1]) + 1
    marks = marks if space[0] else np.concatenate([[0], marks])
    starts, ends = np.ascontiguousarray(marks[::2]), np.ascontiguousarray(marks[1::2])
    words = np.zeros(len(starts), np.uint64)
    for c in range(0, len(data), CHUNK):
        z = min(c + CHUNK, len(data))
        i, j = np.searchsorted(ends, c, "right"), np.searchsorted(starts, z)
        if i >= j:
            continue
        sums = np.zeros(z - c + 1, np.uint64)
        np.cumsum(_BYTE[data[c:z]] * _UP[: z - c], out=sums[1:])
        first = np.maximum(starts[i:j], c) - c
        part = (sums[np.minimum(ends[i:j], z) - c] - sums[first]) * _DOWN[first]
        if starts[i] < c:
            part[0] = int(part[0]) * pow(int(_BASE), c - int(starts[i]), 1 << 64) % (1 << 64)
        words[i:j] += part
    return data, offsets, starts, ends, mix(words)


def shingle_sets(texts: Sequence[str]) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes: windows of five lower-cased (A-Z) words, or all of fewer."""
    _, offsets, starts, _, words = words_of(texts)
    of = np.searchsorted(starts, offsets)  # each text's first word
    n = len(words)
    wide = sum(words[k : max(n - SHINGLE + 1 + k, k)] * _PLACE[k] for k in range(SHINGLE)) if n >= SHINGLE else np.zeros(0, np.uint64)
    hashes = mix(wide + _COUNT[SHINGLE])
    out = []
    for a, z in zip(of[:-1].tolist(), of[1:].tolist()):
        if z - a >= SHINGLE:
            out.append(np.unique(hashes[a : z - SHINGLE + 1]))
        elif z > a:
            out.append(mix((words[a:z] * _PLACE[: z - a]).sum(dtype=np.uint64, keepdims=True) + _COUNT[z - a]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(sets: Sequence[np.ndarray], k: int) -> np.ndarray:
    """The k MinHash minima of each (non-empty) set."""
    rng = np.random.Generator(np.random.PCG64(77))
    masks, factors = rng.integers(0, 1 << 63, k, dtype=np.uint64), rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    every = np.concatenate(sets)
    first = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), k), np.uint64)
    scratch = np.empty_like(every)
    for j in range(k):
        np.bitwise_xor(every, masks[j], out=scratch)
        np.multiply(scratch, factors[j], out=scratch)
        out[:, j] = np.minimum.reduceat(scratch, first)
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(a) and len(b) else 0
