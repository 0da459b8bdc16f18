"""Word shingles of many texts at once, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


STEP = 1 << 20


@lru_cache(maxsize=1)
def _step_powers() -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(STEP, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i, modulo 2**64, for i below n."""
    if n <= STEP:
        return tuple(p[:n] for p in _step_powers())
    out = []
    for b, p in zip((BASE, pow(BASE, -1, 1 << 64)), _step_powers(), strict=True):
        tops = np.array([pow(b, k * STEP, 1 << 64) for k in range(-(-n // STEP))], np.uint64)
        out.append((tops[:, None] * p[None, :]).ravel()[:n])
    return out[0], out[1]


def prefix_hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cumulative polynomial hash of bytes and the inverse powers: of bytes i to j, ``(total[j] - total[i]) * inverse[i]``."""
    power, inverse = _powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], out=total[1:])
    return total, inverse


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def shingles(texts: list[str | None], width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in order, how often each occurs, and its text's place.

    Words are runs of letters and digits, lower-cased; a text of fewer words is one shingle; without words it has none.
    """
    encoded = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    lengths = np.fromiter(map(len, encoded), np.int64, len(encoded)) + 1
    b = np.frombuffer(b" ".join([*encoded, b""]), np.uint8)
    if not len(b):
        none = np.empty(0, np.uint64)
        return none, np.empty(0, np.int64), np.empty(0, np.int64)
    total, inverse = prefix_hashes(b)
    inside = _WORD_BYTE[b]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    word = mix((total[ends] - total[starts]) * inverse[starts])
    doc = np.searchsorted(np.cumsum(lengths), starts, side="right")
    n_words = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(n_words) - n_words
    n = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    limit = (first + n_words)[owner]
    padded = np.concatenate([word, np.zeros(width, np.uint64)])
    h = np.zeros(len(at), np.uint64)
    for k in range(width):
        h = h * np.uint64(0x100000001B3 * 2 + 1) + np.where(at + k < limit, padded[at + k], np.uint64(0x51ED270B))
    h = mix(h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]) if len(h) else np.empty(0, np.int64)
    count = np.diff(np.r_[new, len(h)])
    return h[new], count, owner[new]
