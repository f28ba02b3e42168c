"""A bidirectional FM-index over a delimited vocabulary, for many queries at once.

The text is every word with a delimiter on each side.  The index holds the
Burrows-Wheeler transform of the text and of its mirror image, each as a
wavelet matrix.  A state is a range of suffix ranks in both at once, so a
pattern can grow by a character on either side; states are numpy columns, and
each step moves all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DELIMITER = 0


def ranks_of_suffixes(codes: np.ndarray, word_of: np.ndarray) -> np.ndarray:
    """Places of the suffixes in order; a suffix ends with its word's delimiter.

    Ranks by the first 1, 2, 4, ... characters; equal suffixes (ends of
    several words) stand in the order of their places.
    """
    n = len(codes)
    rank = codes.astype(np.int64) + 1
    step = 1
    while True:
        ahead = np.zeros(n, np.int64)
        if step < n:
            same = word_of[step:] == word_of[:-step]
            ahead[:-step][same] = rank[step:][same]
        if not ahead.any():
            return np.argsort(rank, kind="stable")
        key = rank * (int(rank.max()) + 1) + ahead
        _, rank = np.unique(key, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        step *= 2


class Wavelet:
    """Counts of characters in prefixes of a string, for all characters."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.bits = bits
        self.zeros, self.n_zeros = [], []
        now = codes
        for b in range(bits - 1, -1, -1):
            bit = (now >> b) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(bit == 0)]).astype(np.int32))
            self.n_zeros.append(int(self.zeros[-1][-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        counts = np.bincount(codes, minlength=1 << bits)
        self.before = np.concatenate([[0], np.cumsum(counts)])      # characters smaller than each
        # Where a character's block begins on the last level.
        self.block = np.full(1 << bits, -1, np.int64)
        seen, at = np.unique(now, return_index=True)
        self.block[seen] = at

    def step(self, lo: np.ndarray, hi: np.ndarray, code: np.ndarray):
        """(first rank, number, number of smaller characters) of ``code`` within [lo, hi)."""
        less = np.zeros(len(lo), np.int64)
        for level in range(self.bits):
            bit = (code >> (self.bits - 1 - level)) & 1 == 1
            zl, zh = self.zeros[level][lo], self.zeros[level][hi]
            less += np.where(bit, zh - zl, 0)
            lo = np.where(bit, self.n_zeros[level] + lo - zl, zl)
            hi = np.where(bit, self.n_zeros[level] + hi - zh, zh)
        return self.before[code] + lo - self.block[code], hi - lo, less

    def each(self, lo: np.ndarray, hi: np.ndarray):
        """As ``step`` for every character that occurs in a range: also (range number, character)."""
        of, code, less = np.arange(len(lo)), np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        for level in range(self.bits):
            zl, zh = self.zeros[level][lo].astype(np.int64), self.zeros[level][hi].astype(np.int64)
            ol, oh = self.n_zeros[level] + lo - zl, self.n_zeros[level] + hi - zh
            a, b = zh > zl, oh > ol
            of, code, less = (np.concatenate([of[a], of[b]]), np.concatenate([code[a] * 2, code[b] * 2 + 1]),
                              np.concatenate([less[a], (less + zh - zl)[b]]))
            lo, hi = np.concatenate([zl[a], ol[b]]), np.concatenate([zh[a], oh[b]])
        return of, code, self.before[code] + lo - self.block[code], hi - lo, less


@dataclass
class States:
    """Ranges of equal size in the index of the text and in that of its mirror image."""

    query: np.ndarray
    text: np.ndarray
    mirror: np.ndarray
    size: np.ndarray

    def take(self, at: np.ndarray) -> States:
        return States(self.query[at], self.text[at], self.mirror[at], self.size[at])


class BidirectionalIndex:
    """Index of distinct words, each given as a row of character codes from 1 on."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray):
        """``codes``: the words' characters one after the other."""
        self.n_words = len(lengths)
        ends = np.cumsum(lengths)
        self.bits = max(int(codes.max(initial=1)).bit_length(), 1)
        self.sides = {}
        for side in ("text", "mirror"):
            # Each word is followed by a delimiter; the one in front of it is
            # that of the word before, and a last row stands for the first word's.
            text = np.zeros(len(codes) + self.n_words, np.int64)
            word = np.repeat(np.arange(self.n_words), lengths + 1)
            place = np.arange(len(codes)) + np.repeat(np.arange(self.n_words), lengths)
            if side == "text":
                text[place] = codes
            else:
                starts = np.repeat(ends - lengths, lengths)
                within = np.arange(len(codes)) - starts
                text[place] = codes[starts + np.repeat(lengths, lengths) - 1 - within]
            order = ranks_of_suffixes(text, word)
            before = text[order - 1]                    # place 0 comes after the last delimiter
            self.sides[side] = (Wavelet(before, self.bits), np.flatnonzero(before == DELIMITER), word[order])

    def start(self, queries: np.ndarray) -> States:
        n = len(self.sides["text"][2])
        zero = np.zeros(len(queries), np.int64)
        return States(queries, zero, zero.copy(), zero + n)

    def extend(self, s: States, code: np.ndarray, left: bool) -> States:
        """All states grown by one character each; those without an occurrence go."""
        here, there = (s.text, s.mirror) if left else (s.mirror, s.text)
        at, size, less = self.sides["text" if left else "mirror"][0].step(here, here + s.size, code)
        on = np.flatnonzero(size)
        at, other = at[on], (there + less)[on]
        return States(s.query[on], *((at, other) if left else (other, at)), size[on])

    def extend_any(self, s: States, left: bool) -> tuple[np.ndarray, np.ndarray, States]:
        """(state number, character, new state) for every character that occurs beside a state."""
        here, there = (s.text, s.mirror) if left else (s.mirror, s.text)
        of, code, at, size, less = self.sides["text" if left else "mirror"][0].each(here, here + s.size)
        other = there[of] + less
        return of, code, States(s.query[of], *((at, other) if left else (other, at)), size)

    def at_word_end(self, s: States, left: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) of the states beside which a word ends; a state is one word's whole text."""
        _, delimiters, words = self.sides["text" if left else "mirror"]
        here = s.text if left else s.mirror
        i = np.searchsorted(delimiters, here)
        on = np.flatnonzero((i < len(delimiters)) & (delimiters[np.minimum(i, len(delimiters) - 1)] < here + s.size))
        return s.query[on], words[delimiters[i[on]]]


def one_error(index: BidirectionalIndex, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray,
              half: np.ndarray, forward: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) of the words that are one edit from a query, the edit lying in one half.

    ``codes`` holds the queries' characters, -1 where the index has no such
    character.  ``half`` is where the second half begins.  ``forward``: the
    first half is matched exactly, from its end to the word's beginning; then
    the range grows over the second half, one error allowed.  Otherwise the
    mirror image of this.
    """
    q = np.arange(len(lengths))
    s = index.start(q)

    def char(of: np.ndarray, i: np.ndarray) -> np.ndarray:
        return codes[starts[of] + i]

    def grow(s: States, code: np.ndarray, left: bool) -> States:
        on = code >= 0
        return index.extend(s if on.all() else s.take(on), code if on.all() else code[on], left)

    # The exact half, outwards from the middle, to the delimiter.
    exact = half if forward else lengths - half
    done: list[States] = []
    i = 0
    while len(s.query):
        full = exact[s.query] == i
        if full.any():
            done.append(s.take(full))
            s = s.take(~full)
        at = half[s.query] - 1 - i if forward else half[s.query] + i
        s = grow(s, char(s.query, at), left=forward)
        i += 1
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = States(*(np.concatenate([getattr(d, f) for d in done]) for f in ("query", "text", "mirror", "size")))
    s = index.extend(s, np.zeros(len(s.query), np.int64), left=forward)

    # The other half: ``j`` of its characters are matched, by states without
    # and with an error.  States with an error wait in ``late`` by how many
    # characters they have matched.
    rest = lengths - half if forward else half
    found = []

    def next_char(of: np.ndarray, j: int) -> np.ndarray:
        return char(of, half[of] + j if forward else half[of] - 1 - j)

    late: dict[int, list[States]] = {}
    j = 0
    while len(s.query) or late:
        wrong = late.pop(j, [])
        if len(s.query):
            last = rest[s.query] == j
            of, code, grown = index.extend_any(s, left=not forward)
            real = code != DELIMITER
            of, code, grown = of[real], code[real], grown.take(real)
            wrong.append(grown)                                             # a character more
            inner = ~last[of]
            of, code, grown = of[inner], code[inner], grown.take(inner)
            if len(of):
                match = code == next_char(grown.query, j)
                late.setdefault(j + 1, []).append(grown.take(~match))       # another character
            on = s.take(~last)
            late.setdefault(j + 1, []).append(on)                           # a character less
            s = grow(on, next_char(on.query, j), left=not forward)
        if wrong:
            w = States(*(np.concatenate([getattr(d, f) for d in wrong]) for f in ("query", "text", "mirror", "size")))
            last = rest[w.query] == j
            found.append(index.at_word_end(w.take(last), left=not forward))
            w = w.take(~last)
            w = grow(w, next_char(w.query, j), left=not forward)
            if len(w.query):
                late.setdefault(j + 1, []).append(w)
        late = {k: [x for x in v if len(x.query)] for k, v in late.items()}
        late = {k: v for k, v in late.items() if v}
        j += 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    query, word = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    pairs = np.unique(query * index.n_words + word)
    return pairs // index.n_words, pairs % index.n_words
