"""Word shingles of whole texts as 64-bit hashes, for many texts at once (numpy)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Texts are hashed in slices of about this many bytes, so that a slice's arrays (some 70 bytes for each of a text) stay small.
SLICE_BYTES = 1 << 20
#: The same where words are hashed: an executor has a Python worker for each core, and keeps them while it does other work.
HASHED_BYTES = 1 << 18
#: Longest tables of powers a worker keeps; what a longer text needs goes with it.
KEPT_POWERS = 1 << 21
_SEED = 20240229
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, int, int]:
    rng = np.random.default_rng(_SEED)
    values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    base = int(rng.integers(1 << 61, 1 << 62)) * 4 + 1
    return values, space, base, pow(base, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _kept_powers(n) if n <= KEPT_POWERS else _made_powers(n)


def _made_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    _, _, base, inverse = _tables()
    out = []
    for b in (base, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


_kept_powers = lru_cache(maxsize=2)(_made_powers)


def word_hashes(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts (bytes), and the index of its text."""
    values, space, _, _ = _tables()
    joined = b"\n".join(bodies) + b"\n"
    size = 1 << max(19, (len(joined) + 1).bit_length())
    up, down = _powers(size)
    raw = np.frombuffer(joined, np.uint8)
    gap = space[raw]
    edge = np.flatnonzero(np.diff(gap.astype(np.int8), prepend=1))  # a word's first byte, then the space after it, in turn
    start, end = edge[0::2], edge[1::2]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[raw] * up[: len(raw)], dtype=np.uint64)])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    ends = np.cumsum([len(b) + 1 for b in bodies])
    return h, np.searchsorted(ends, start, side="right")


def shingle_sets(bodies: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The set of each text's ``width``-word shingles, as ascending distinct hashes.

    A text with fewer words has its whole sequence as one shingle, one without words the empty set.
    """
    h, doc = word_hashes(bodies)
    bounds = np.searchsorted(doc, np.arange(len(bodies) + 1))
    if len(h) >= width:
        s = h[: len(h) - width + 1]
        for k in range(1, width):
            s = mix(s * _U(0x9E3779B97F4A7C15) + h[k: len(h) - width + 1 + k])
    for i in range(len(bodies)):
        a, b = bounds[i], bounds[i + 1]
        if b - a >= width:
            yield np.unique(s[a: b - width + 1])
        elif b == a:
            yield np.empty(0, np.uint64)
        else:
            x = h[a: a + 1]
            for k in range(a + 1, b):
                x = mix(x * _U(0x9E3779B97F4A7C15) + h[k: k + 1])
            yield mix(x + _U(b - a))


def sliced(texts, limit: int = HASHED_BYTES) -> Iterator[list[bytes]]:
    """Lowered (A-Z) UTF-8 bytes of the texts, in slices of about ``limit`` bytes."""
    out, size = [], 0
    for t in texts:
        b = t.encode("utf-8", "surrogatepass").lower()
        out.append(b)
        size += len(b)
        if size >= limit:
            yield out
            out, size = [], 0
    if out:
        yield out


def digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()
