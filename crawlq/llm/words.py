"""Words of many texts at once: places, hashes and numbers, by numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash

LANES = 8                       # words of up to 64 bytes are hashed 8 bytes at a time for all words at once
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hash of a sequence one longer, from that of the sequence and the new element."""
    x = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of a buffer by their places."""

    def __init__(self, buf: bytes, inside: np.ndarray):
        """``inside``: which bytes of the buffer belong to a word."""
        edges = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        starts = np.flatnonzero(edges == 1)
        self._set(buf, starts, np.flatnonzero(edges == -1) - starts)

    @classmethod
    def at(cls, buf: bytes, starts: np.ndarray, lengths: np.ndarray) -> Words:
        """Words of given places and lengths."""
        out = cls.__new__(cls)
        out._set(buf, starts, lengths)
        return out

    def _set(self, buf: bytes, starts: np.ndarray, lengths: np.ndarray) -> None:
        self.buf = buf + b" " * 8
        self.starts, self.lengths = starts, lengths
        # Eight bytes from any place on, as a number.
        self.eight = np.ndarray((len(buf) + 1,), "<u8", self.buf, strides=(1,))

    def only(self, on: np.ndarray) -> None:
        """Keep the words at ``on``."""
        self.starts, self.lengths = self.starts[on], self.lengths[on]

    def __len__(self) -> int:
        return len(self.starts)

    def word(self, i: int) -> bytes:
        return self.buf[self.starts[i]:self.starts[i] + self.lengths[i]]

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of every word, made from its bytes by eights and its length."""
        one = self.lengths.astype(np.uint64)
        two = one + np.uint64(0x5851F42D4C957F2D)
        on, n = slice(None), self.lengths
        for j in range(LANES):
            eight = self.eight[self.starts[on] + 8 * j] & _MASK[np.minimum(n - 8 * j, 8)]
            one[on] = mix(one[on], eight)
            two[on] = mix(two[on] * np.uint64(0xD6E8FEB86659FD93), eight)
            on = np.flatnonzero(self.lengths > 8 * (j + 1))
            n = self.lengths[on]
            if not len(on):
                break
        for i in np.flatnonzero(self.lengths > 8 * LANES):
            digest = xxhash.xxh128_digest(self.word(i))
            one[i], two[i] = int.from_bytes(digest[:8], "big"), int.from_bytes(digest[8:], "big")
        return one, two

    def numbered(self, at: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """A number for the word at each place of ``at``, and the words by number.

        Words are told apart by their first hash; where the second tells more
        words apart, by their bytes.
        """
        numbers, _ = pd.factorize(one[at])
        first = np.empty(numbers.max(initial=-1) + 1, np.int64)
        first[numbers[::-1]] = at[::-1]
        if not np.array_equal(two[at], two[first][numbers]):
            table: dict[bytes, int] = {}
            numbers = np.array([table.setdefault(self.word(i), len(table)) for i in at], np.int64)
            return numbers, list(table)
        return numbers, [self.word(i) for i in first]
