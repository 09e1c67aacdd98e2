"""Words of whole Arrow batches as 64-bit hashes, in numpy: no Python object per word.

A word's hash is a polynomial of its bytes (A-Z lower-cased) modulo 2^64, read off as a difference of
running sums, then mixed. It does not depend on where the word stands, so a long text is hashed
in parts that end between words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; a longer part is only taken for a longer word.
PART_BYTES = 1 << 20
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
SPACES = b" \t\n\x0b\x0c\r"

_values = np.random.RandomState(42).randint(1, 1 << 62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_values[ord("A") : ord("Z") + 1] = _values[ord("a") : ord("z") + 1]
_powers = {True: np.ones(1, np.uint64), False: np.ones(1, np.uint64)}


def _powers_to(n: int, inverse: bool) -> np.ndarray:
    held = _powers[inverse]
    if len(held) < n:
        steps = np.full(max(n, 2 * len(held)), INVERSE if inverse else MULTIPLIER, np.uint64)
        steps[0] = 1
        held = _powers[inverse] = np.cumprod(steps, dtype=np.uint64)
    return held


def mix(x: np.ndarray) -> np.ndarray:
    """Murmur's finaliser."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a binary array; a null is empty."""
    if texts.null_count:
        texts = texts.fill_null(b"")
    kind = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _parts(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of the bytes at ends of texts, or between words where a text is long."""
    at = 0
    while at < len(data):
        end = min(len(data), at + PART_BYTES)
        if end < len(data):
            whole = offsets[np.searchsorted(offsets, end, "right") - 1]
            if whole > at:
                end = int(whole)
            else:
                spaces = np.flatnonzero(gap[data[at:end]])
                if len(spaces):
                    end = at + int(spaces[-1]) + 1
                else:
                    limit = offsets[np.searchsorted(offsets, at, "right")]
                    ahead = np.flatnonzero(gap[data[end:limit]])
                    end += int(ahead[0]) if len(ahead) else int(limit) - end
        yield at, end
        at = end


def spans(texts: pa.Array, gaps: bytes = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, first, data): words of all texts, ``first[i]:first[i+1]`` are those of text i; positions in data."""
    data, offsets = buffers(texts)
    gap = np.zeros(256, bool)
    gap[list(gaps)] = True
    hashes, starts, ends = [], [], []
    for lo, hi in _parts(data, offsets, gap):
        part = data[lo:hi]
        inside = ~gap[part]
        cut = np.zeros(len(part) + 1, bool)
        cut[0] = cut[-1] = True
        cut[1:-1] = ~(inside[:-1] & inside[1:])
        own = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, "right")]
        cut[own - lo] = True
        s, e = np.flatnonzero(inside & cut[:-1]), np.flatnonzero(inside & cut[1:]) + 1
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_values[part] * _powers_to(len(part), False)[: len(part)], dtype=np.uint64, out=sums[1:])
        hashes.append(mix((sums[e] - sums[s]) * _powers_to(len(part) + 1, True)[s]))
        starts.append(s + lo)
        ends.append(e + lo)
    none = np.zeros(0, np.int64)
    start = np.concatenate([none, *starts])
    return np.concatenate([np.zeros(0, np.uint64), *hashes]), start, np.concatenate([none, *ends]), np.searchsorted(start, offsets), data


def chained(x: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all ``k`` values in a row."""
    out = np.full(max(0, len(x) - k + 1), k, np.uint64)
    for i in range(k):
        out = (out ^ x[i : len(x) - k + 1 + i]) * np.uint64(MULTIPLIER)
        out ^= out >> np.uint64(29)
    return mix(out)


def shingle_bags(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted hashes of each text's shingles of ``k`` words, repeats included; fewer words: one, all of them; none: empty."""
    words, _, _, first, _ = spans(texts)
    grams, out = chained(words, k), []
    for lo, hi in zip(first[:-1], first[1:]):
        if hi - lo < k:
            out.append(chained(words[lo:hi], int(hi - lo)) if hi > lo else words[:0])
        else:
            out.append(np.sort(grams[lo : hi - k + 1]))
    return out


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles, as ``shingle_bags`` has them."""
    return [g[np.concatenate([[True], g[1:] != g[:-1]])] if len(g) else g for g in shingle_bags(texts, k)]
