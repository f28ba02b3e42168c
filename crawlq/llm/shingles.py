"""Word shingles of whole texts as hashed sets (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
_K = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
_word = xxhash.xxh3_64_intdigest


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): every input bit reaches every output bit."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles of a whole text.

    A-Z are lower-cased; words are runs of bytes other than the six ASCII
    white-space bytes.  With fewer than five words the whole sequence is the
    one shingle; without words (or text) the set is empty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.array([_word(w) for w in words], np.uint64)
    if n < WIDTH:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=n)], np.uint64)
    m = n - WIDTH + 1
    x = h[:m].copy()
    for k in range(1, WIDTH):
        x = mix64(x * _K + h[k:k + m])
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])]
