"""Suffix sorting by induced sorting with disk-backed bucket queues (numpy, inside tasks).

The order of the leftmost S-type (LMS) suffixes induces that of all others:
taken smallest first, each suffix puts the one that starts a character earlier
into the queue of its own first character.  As keys only ever grow, the
priority queue is one queue per character; whole queues are handled as arrays,
and beyond a memory bound they are kept in a file.

LMS suffixes themselves are ordered by one induced pass over LMS substrings,
which are named; if names repeat, the string of names - at most half as long -
is sorted the same way.  Below the bytes the alphabet is as large as the
string, so that level is sorted by doubling the compared length instead of one
queue per name.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

QUEUE_BYTES = 64 * 1024 * 1024


class BucketQueue:
    """First-in first-out arrays per character; the oldest go to a file beyond ``limit`` bytes."""

    def __init__(self, size: int, limit: int = QUEUE_BYTES):
        self.held: list[list[np.ndarray]] = [[] for _ in range(size)]
        self.spilled: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        self.limit, self.bytes, self.file = limit, 0, None

    def push(self, c: int, a: np.ndarray) -> None:
        self.held[c].append(a)
        self.bytes += a.nbytes
        if self.bytes > self.limit:
            if self.file is None:
                fd, name = tempfile.mkstemp(prefix="suffix-queue-")
                self.file = os.fdopen(fd, "w+b")
                os.unlink(name)            # the space is freed when the file is closed
            self.file.seek(0, 2)
            for k, arrays in enumerate(self.held):
                for x in arrays:
                    self.spilled[k].append((self.file.tell(), len(x)))
                    x.tofile(self.file)
                self.held[k] = []
            self.bytes = 0

    def pop(self, c: int) -> np.ndarray:
        parts = []
        for at, n in self.spilled[c]:
            self.file.flush()
            self.file.seek(at)
            parts.append(np.fromfile(self.file, np.int64, n))
        self.bytes -= sum(x.nbytes for x in self.held[c])
        parts += self.held[c]
        self.spilled[c], self.held[c] = [], []
        return np.concatenate(parts) if parts else np.empty(0, np.int64)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is S-type (smaller than the next one); the last character is unique and smallest."""
    n = len(s)
    rise = np.empty(n, np.int8)
    rise[:-1] = np.sign(s[1:].astype(np.int64) - s[:-1])
    rise[-1] = 1
    # Equal neighbours take the type of what follows.
    at = np.where(rise != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return rise[at] > 0


def _dispatch(queue: BucketQueue, chars: np.ndarray, places: np.ndarray) -> None:
    if not len(places):
        return
    order = np.argsort(chars, kind="stable")
    chars, places = chars[order], places[order]
    cut = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]]))
    for a, z in zip(cut, [*cut[1:], len(chars)]):
        queue.push(int(chars[a]), places[a:z])


def _induce(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, size: int, limit: int) -> list[np.ndarray]:
    """All suffixes in order, by first character, from the LMS suffixes in order."""
    by_char = BucketQueue(size, limit)
    _dispatch(by_char, s[lms], lms)
    queue, larger = BucketQueue(size, limit), []
    starts: list[np.ndarray] = []
    for c in range(size):
        own, cur = [], queue.pop(c)
        while len(cur):                       # L-type suffixes, the shorter runs of c first
            own.append(cur)
            before = cur[cur > 0] - 1
            before = before[~is_s[before]]
            chars = s[before]
            cur = before[chars == c]
            _dispatch(queue, chars[chars != c], before[chars != c])
        larger.append(np.concatenate(own) if own else np.empty(0, np.int64))
        stars = by_char.pop(c)
        starts.append(stars)
        before = stars[stars > 0] - 1
        _dispatch(queue, s[before], before)
    queue.close()
    by_char.close()
    queue = BucketQueue(size, limit)
    out: list[np.ndarray] = [larger[0]] * size
    for c in range(size - 1, -1, -1):
        # S-type suffixes from the largest down, then the L-type ones of this character, as sources.
        own, cur = [], queue.pop(c)
        while len(cur):
            own.append(cur)
            before = cur[cur > 0] - 1
            before = before[is_s[before]]
            chars = s[before]
            cur = before[chars == c]
            _dispatch(queue, chars[chars != c], before[chars != c])
        small = np.concatenate(own)[::-1] if own else np.empty(0, np.int64)
        if c == 0:
            small = starts[0]                 # the final character stands alone
            before = small[small > 0] - 1
            before = before[is_s[before]]
            _dispatch(queue, s[before], before)
        down = larger[c][::-1]
        before = down[down > 0] - 1
        before = before[is_s[before]]
        _dispatch(queue, s[before], before)
        out[c] = np.concatenate([larger[c], small])
    queue.close()
    return out


def _doubling(names: np.ndarray) -> np.ndarray:
    """Suffixes of a string of names in order, by doubling the compared length."""
    n, k = len(names), 1
    rank = names.astype(np.int64)
    while True:
        second = np.zeros(n, np.int64)
        second[:n - k] = rank[k:] + 1
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        rank, k = new, 2 * k
        if rank.max(initial=0) == n - 1 or k >= n:
            return np.argsort(rank, kind="stable")


def suffix_array(s: np.ndarray, size: int, limit: int = QUEUE_BYTES) -> np.ndarray:
    """Starts of all suffixes of ``s`` in order.

    ``s`` holds numbers below ``size`` and ends in the only 0.
    """
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    is_s = _types(s)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if len(lms) > 1:
        # One pass from LMS suffixes in any order sorts the LMS substrings.
        order = np.concatenate(_induce(s, is_s, lms, size, limit))
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = order[is_lms[order]]
        # Names: equal length and equal characters (the next LMS character included).
        nxt = np.empty(n, np.int64)
        nxt[lms] = np.concatenate([lms[1:], [n - 1]])
        length = nxt[order] - order
        same = _equal_pieces(s, order, length)
        name = np.cumsum(np.concatenate([[0], ~same]))
        names = np.empty(n, np.int64)
        names[order] = name
        names = names[lms]
        lms = lms[_doubling(names)] if name[-1] + 1 < len(lms) else order
    return np.concatenate(_induce(s, is_s, lms, size, limit))


def _equal_pieces(s: np.ndarray, order: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether each piece of the order equals the one before: s[p..p+length] (both ends included)."""
    same = length[1:] == length[:-1]
    left = np.flatnonzero(same)
    k = 0
    while len(left):
        live = length[left] >= k
        left = left[live]
        differ = s[order[left] + k] != s[order[left + 1] + k]
        same[left[differ]] = False
        left = left[~differ]
        k += 1
    return same
