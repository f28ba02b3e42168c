"""Toxicity by a bidirectional GRU with attention pooling (operator 9).

Input of a word: its embedding (hashed vocabulary) beside the mean embedding
of its character 5-grams.  A GRU runs over a window of words in each
direction, attention pools the states, and a logistic unit gives the window's
score.  Every document is cut into all overlapping windows of ``WINDOW`` words
at steps of ``STEP``; its score is a calibrated logistic of its highest and
second highest window score and its number of windows.

The network, its gradients and Adam are plain numpy.  Only documents carry
labels, so training picks windows: of a toxic document the ones that score
highest so far, of a clean one the highest and some others; the first choice
comes from word log-odds, the next from the network itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlq.llm.sample import crc_mod, labelled_sample, prior_shift

WINDOW, STEP = 24, 16
WORD_BUCKETS, CHAR_BUCKETS = 1 << 14, 1 << 14
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_OUTER = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
EMBED, HIDDEN = 8, 8
GRAM = 5
PER_CLASS = 1200          # documents of each label in the training sample, at most
MOD, HELD_OUT = 5, 0
THRESHOLD = 0.5
CACHE_WORDS = 150_000     # words per Python worker whose inputs are kept
CACHE_LENGTH = 64         # longer words are worked out each time
BATCH_WINDOWS = 512
BATCH_DOCS = 512


# ---- words and windows -----------------------------------------------------

def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def word_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word; the buckets of all its character 5-grams, one word after the other; their number by word.

    Outer punctuation is cut off, end marks are added, and 5-grams are taken
    over UTF-8 bytes; a shorter word is padded to one 5-gram.
    """
    raw = [(b"^" + w.strip(_OUTER).encode("utf-8", "surrogatepass") + b"$").ljust(GRAM, b"\0") for w in words]
    n = np.array([len(x) for x in raw]) - (GRAM - 1)
    at = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    code = at[:len(at) - GRAM + 1].copy()
    for k in range(1, GRAM):
        code = (code << np.uint64(8)) | at[k:len(at) - GRAM + 1 + k]
    code = (code * _MULTIPLIER) >> np.uint64(64 - 14)
    # Places whose five bytes lie within one word.
    inside = np.arange(n.sum()) + np.repeat((GRAM - 1) * np.arange(len(n)), n)
    bucket = np.array([zlib.crc32(x) % WORD_BUCKETS for x in raw])
    return bucket, code[inside].astype(np.int64), n


def window_starts(n: int) -> np.ndarray:
    """First words of the windows of n words: steps of STEP until the end is covered, one window at least."""
    return np.arange(0, max(1, n - WINDOW + STEP), STEP) if n > WINDOW else np.zeros(1, np.int64)


# ---- network ---------------------------------------------------------------

def _sigmoid(x: np.ndarray) -> np.ndarray:
    y = 0.5 * x
    np.tanh(y, out=y)
    y *= 0.5
    y += 0.5
    return y


@dataclass
class Net:
    p: dict[str, np.ndarray]
    scale: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0, 0.0, 0.0]))

    def word_inputs(self, words: list[str]) -> np.ndarray:
        """(words, 2 * EMBED): word embedding beside the mean of its 5-gram embeddings."""
        bucket, grams, n = word_codes(words)
        chars = np.add.reduceat(self.p["chars"][grams], np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0)
        return np.concatenate([self.p["words"][bucket], chars / n[:, None].astype(np.float32)], axis=1)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Inputs of the gates of both directions: (words, 2, 3 * HIDDEN)."""
        return np.stack([x @ self.p["W"][0], x @ self.p["W"][1]], axis=1) + self.p["b"]


def new_net(seed: int = 7) -> Net:
    r = np.random.default_rng(seed)
    d, h = 2 * EMBED, HIDDEN
    f = lambda *s: r.normal(0, 1, s).astype(np.float32)
    return Net({
        "words": 0.1 * f(WORD_BUCKETS, EMBED), "chars": 0.1 * f(CHAR_BUCKETS, EMBED),
        "W": f(2, d, 3 * h) / np.sqrt(d), "U": f(2, h, 3 * h) / np.sqrt(h), "b": np.zeros((2, 3 * h), np.float32),
        "A": f(2 * h, h) / np.sqrt(2 * h), "v": f(h) / np.sqrt(h),
        "o": f(2 * h) / np.sqrt(2 * h), "c": np.zeros(1, np.float32)})


def forward(p: dict, g: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Window logits from gate inputs g (time, windows, 2, 3H) and mask (time, windows).

    Direction 1 reads the words backwards.  Padding leaves the state as it is
    and gets no attention; a window without words pools to zero.
    """
    T, B = mask.shape
    h = HIDDEN
    x = np.stack([g[:, :, 0], g[::-1, :, 1]], axis=1)            # (T, 2, B, 3H)
    m = np.stack([mask, mask[::-1]], axis=1)[..., None]          # (T, 2, B, 1)
    state = np.zeros((2, B, h), np.float32)
    states, tape = np.empty((T, 2, B, h), np.float32), []
    for t in range(T):
        u = np.matmul(state, p["U"])
        zr = _sigmoid(x[t, :, :, :2 * h] + u[:, :, :2 * h])
        z, r = zr[..., :h], zr[..., h:]
        n = np.tanh(x[t, :, :, 2 * h:] + r * u[:, :, 2 * h:])
        new = n + z * (state - n)
        if keep:
            tape.append((state, u, z, r, n))
        state = state + m[t] * (new - state)
        states[t] = state
    both = np.concatenate([states[:, 0], states[::-1, 1]], axis=-1)     # (T, B, 2H)
    a = np.tanh(both @ p["A"])
    e = np.where(mask > 0, a @ p["v"], np.float32(-30))
    w = np.exp(e - e.max(0)) * mask
    w = w / np.maximum(w.sum(0), 1e-9)
    pooled = (w[..., None] * both).sum(0)
    logit = pooled @ p["o"] + p["c"][0]
    return (logit, (x, m, tape, both, a, w, pooled)) if keep else logit


def backward(p: dict, g: np.ndarray, mask: np.ndarray, dlogit: np.ndarray, saved) -> tuple[dict, np.ndarray]:
    """Gradients of the shared weights and of the gate inputs, for d(loss)/d(logit)."""
    x, m, tape, both, a, w, pooled = saved
    T, B = mask.shape
    h = HIDDEN
    d = {"c": np.array([dlogit.sum()]), "o": pooled.T @ dlogit}
    dpool = dlogit[:, None] * p["o"]
    dboth = w[..., None] * dpool
    dw = (both * dpool).sum(-1)
    de = w * (dw - (w * dw).sum(0))
    d["v"] = np.einsum("tb,tbh->h", de, a)
    dpre = de[..., None] * p["v"] * (1 - a * a)
    d["A"] = np.einsum("tbi,tbh->ih", both, dpre)
    dboth += dpre @ p["A"].T
    dstates = np.stack([dboth[:, :, :h], dboth[::-1, :, h:]], axis=1)    # (T, 2, B, H)
    dU = np.zeros_like(p["U"])
    dx = np.empty_like(x)
    carry = np.zeros((2, B, h), np.float32)
    for t in range(T - 1, -1, -1):
        state, u, z, r, n = tape[t]
        total = carry + dstates[t]
        dnew = m[t] * total
        dn = dnew * (1 - z) * (1 - n * n)
        dz = dnew * (state - n) * z * (1 - z)
        dr = dn * u[..., 2 * h:] * r * (1 - r)
        du = np.concatenate([dz, dr, dn * r], axis=-1)
        dx[t] = np.concatenate([dz, dr, dn], axis=-1)
        dU += np.swapaxes(state, 1, 2) @ du
        carry = (1 - m[t]) * total + dnew * z + du @ np.swapaxes(p["U"], 1, 2)
    d["U"] = dU
    dg = np.stack([dx[:, 0], dx[::-1, 1]], axis=2)
    return d, dg


# ---- training --------------------------------------------------------------

class _Coded:
    """Training words, coded once: buckets, 5-grams and their number."""

    def __init__(self, docs: list[list[str]]):
        vocab = {w: i for i, w in enumerate(dict.fromkeys(w for d in docs for w in d))}
        self.docs = [np.array([vocab[w] for w in d], np.int64) for d in docs]
        self.bucket, self.flat, n = word_codes(list(vocab) or [""])
        self.n = n.astype(np.float32)
        self.first = np.concatenate([[0], np.cumsum(n)[:-1]])

    def grams(self, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """5-gram buckets of some words, where each word's begin, and their numbers."""
        n = self.n[used].astype(np.int64)
        cut = np.concatenate([[0], np.cumsum(n)[:-1]])
        return self.flat[np.arange(n.sum()) + np.repeat(self.first[used] - cut, n)], cut, n

    def windows(self, doc: int, starts: np.ndarray) -> np.ndarray:
        """Word numbers of windows, -1 where there is no word."""
        ids = np.full(int(starts.max()) + WINDOW, -1)
        d = self.docs[doc][:len(ids)]
        ids[:len(d)] = d
        return ids[starts[:, None] + np.arange(WINDOW)]


def _log_odds(rows: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """Shrunk log-odds of label 1 for each bucket, from the documents that hold it."""
    pos, neg = np.zeros(size), np.zeros(size)
    for r, lab in zip(rows, y):
        (pos if lab else neg)[np.unique(r)] += 1
    s = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((neg + 0.5) / ((1 - y).sum() + 1))
    return (s * np.minimum(1, (pos + neg) / 10)).clip(-3, 3)


def _all_logits(net: Net, docs: list[list[str]]) -> list[np.ndarray]:
    scorer = Scorer(net)
    return [v for k in range(0, len(docs), BATCH_DOCS) for v in scorer.window_logits(docs[k:k + BATCH_DOCS])]


def _inputs_of(net: Net, c: _Coded, used: np.ndarray) -> np.ndarray:
    flat, cut, _ = c.grams(used)
    chars = np.add.reduceat(net.p["chars"][flat], cut, axis=0) / c.n[used][:, None]
    return np.concatenate([net.p["words"][c.bucket[used]], chars], axis=1)


def fit(sample: list[tuple[str, int]], rounds: int = 2, epochs: int = 3, rate: float = 0.01, seed: int = 7) -> Net:
    """Train on (text, label) pairs.

    An empty sample, or one with a single label, gives a network that scores
    every document by the share of label 1 (0.5 for an empty one).
    """
    net = new_net(seed)
    y = np.array([lab for _, lab in sample], float)
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        s = min(max(share, 1e-4), 1 - 1e-4)
        net.scale = np.array([0.0, 0.0, 0.0, np.log(s / (1 - s))])
        return net
    words = [words_of(t) for t, _ in sample]
    c = _Coded(words)
    by_word = [c.bucket[d] for d in c.docs]
    by_char = [c.grams(np.unique(d))[0] if len(d) else np.zeros(0, int) for d in c.docs]
    odds_w, odds_c = _log_odds(by_word, y, WORD_BUCKETS), _log_odds(by_char, y, CHAR_BUCKETS)
    net.p["words"][:, 0] = odds_w
    net.p["chars"][:, 0] = odds_c
    word_score = odds_w[c.bucket].clip(0) + np.maximum.reduceat(odds_c[c.flat], c.first).clip(0)
    word_score = np.where(word_score > 1, word_score, 0)
    r = np.random.default_rng(seed)
    starts = [window_starts(len(d)) for d in c.docs]

    def pick(scores: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        win, lab = [], []
        for i, (st, s) in enumerate(zip(starts, scores)):
            order = np.argsort(-s, kind="stable")
            if y[i]:
                take = order[:3][s[order[:3]] >= 0.5 * s[order[0]]] if s[order[0]] > 0 else order[:1]
            else:
                take = np.unique(np.concatenate([order[:2], r.integers(0, len(st), 3)]))
            win.append(c.windows(i, st[take]))
            lab.append(np.full(len(take), y[i]))
        return np.concatenate(win), np.concatenate(lab)

    word_score = np.append(word_score, 0.0)      # the last one is for no word
    by_odds = [word_score[c.windows(i, st)].sum(1) for i, st in enumerate(starts)]
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    var = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for rnd in range(rounds):
        win, lab = pick([_sigmoid(v) for v in _all_logits(net, words)] if rnd else by_odds)
        weight = np.where(lab > 0, 0.5 / max(lab.mean(), 1e-6), 0.5 / max(1 - lab.mean(), 1e-6)).astype(np.float32)
        for _ in range(epochs):
            order = r.permutation(len(win))
            for k in range(0, len(order), 256):
                b = order[k:k + 256]
                used, inv = np.unique(win[b].clip(0), return_inverse=True)
                inv = inv.reshape(win[b].shape)
                x = _inputs_of(net, c, used)
                g = net.projected(x)[inv].swapaxes(0, 1)
                mask = (win[b].T >= 0).astype(np.float32)
                logit, saved = forward(net.p, g, mask, keep=True)
                dlogit = ((_sigmoid(logit) - lab[b]) * weight[b] / len(b)).astype(np.float32)
                grad, dg = backward(net.p, g, mask, dlogit, saved)
                dproj = np.zeros((len(used), 2, 3 * HIDDEN), np.float32)
                np.add.at(dproj, inv.T.ravel(), dg.reshape(-1, 2, 3 * HIDDEN))
                grad["b"] = dproj.sum(0)
                grad["W"] = np.stack([x.T @ dproj[:, 0], x.T @ dproj[:, 1]])
                dx = dproj[:, 0] @ net.p["W"][0].T + dproj[:, 1] @ net.p["W"][1].T
                grad["words"] = np.zeros_like(net.p["words"])
                np.add.at(grad["words"], c.bucket[used], dx[:, :EMBED])
                flat, _, n = c.grams(used)
                grad["chars"] = np.zeros_like(net.p["chars"])
                np.add.at(grad["chars"], flat, np.repeat(dx[:, EMBED:] / c.n[used][:, None], n, axis=0))
                step += 1
                for name, gr in grad.items():
                    u, v = mean[name], var[name]
                    u += 0.1 * (gr - u)
                    v += 0.001 * (gr * gr - v)
                    net.p[name] -= (rate * (u / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    X = np.stack([_doc_inputs(v) for v in _all_logits(net, words)])
    net.scale = _logistic(X, y)
    return net


def _doc_inputs(logits: np.ndarray) -> np.ndarray:
    """Highest and second highest window logit (the same, if there is one window), log of their number, 1."""
    top = np.sort(logits)[-2:]
    return np.array([top[-1], top[0], np.log(len(logits)), 1.0]).clip(-30, 30)


def _logistic(X: np.ndarray, y: np.ndarray, l2: float = 0.1) -> np.ndarray:
    w = np.zeros(X.shape[1])
    for _ in range(50):
        p = _sigmoid((X @ w).clip(-30, 30))
        h = (X * (p * (1 - p))[:, None]).T @ X + l2 * np.eye(len(w))
        w = w + np.linalg.solve(h, X.T @ (y - p) - l2 * w).clip(-1, 1)
    return w


# ---- scoring ---------------------------------------------------------------

class Scorer:
    """The network with the gate inputs of words kept between documents."""

    def __init__(self, net: Net):
        self.net = net
        self.reset()

    def reset(self) -> None:
        # Row 0 stands for padding.
        self.rows: dict[str, int] = {}
        self.table = np.zeros((4096, 2, 3 * HIDDEN), np.float32)
        self.used = 1

    def _add(self, words: list[str]) -> dict[str, int]:
        g = np.concatenate([self.net.projected(self.net.word_inputs(words[k:k + 20_000])) for k in range(0, len(words), 20_000)]).astype(np.float32)
        need = self.used + len(words)
        if need > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(need, 2 * len(self.table)) - len(self.table), 2, 3 * HIDDEN), np.float32)])
        self.table[self.used:need] = g
        rows = {w: self.used + k for k, w in enumerate(words)}
        self.used = need
        return rows

    def window_logits(self, docs: list[list[str]]) -> list[np.ndarray]:
        """Logits of all windows of each document."""
        words = set().union(*docs)
        new = [w for w in words if w not in self.rows]
        if len(self.rows) + len(new) > CACHE_WORDS:
            self.reset()
            new = list(words)
        own = self._add(new) if new else {}
        self.rows.update(own)
        ids, starts, counts, at = [], [], [], 0
        for d in docs:
            st = window_starts(len(d))
            ids.append(np.fromiter(map(self.rows.__getitem__, d), np.int64, len(d)))
            ids.append(np.zeros(WINDOW, np.int64))              # padding, and no window reaches the next document
            starts.append(at + st)
            counts.append(len(st))
            at += len(d) + WINDOW
        flat, start = np.concatenate(ids), np.concatenate(starts)
        logits = np.empty(len(start), np.float32)
        for k in range(0, len(start), BATCH_WINDOWS):
            win = flat[start[k:k + BATCH_WINDOWS] + np.arange(WINDOW)[:, None]]
            logits[k:k + BATCH_WINDOWS] = forward(self.net.p, self.table[win], (win > 0).astype(np.float32))
        for w in [w for w in own if len(w) > CACHE_LENGTH]:
            del self.rows[w]
        return np.split(logits, np.cumsum(counts)[:-1])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.stack([_doc_inputs(v) for v in self.window_logits([words_of(t) for t in texts])])
        return _sigmoid((x @ self.net.scale).clip(-30, 30))


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Net:
    """The network of the whole corpus: trained on a bounded sample outside the held-out fold."""
    sample, share = labelled_sample(docs, labels, "toxic", mod=MOD, held_out=HELD_OUT, per_class=per_class)
    net = fit(sample)
    net.scale = net.scale + np.array([0.0, 0.0, 0.0, prior_shift(sample, share)])
    return net


def score_toxicity(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id and score of every row; the text alone enters the score.

    Whole texts are scored, all their windows.  A null or empty text is one
    window without words; repeated rows score alike; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH_DOCS):
                b = batch.slice(k, BATCH_DOCS)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scorer.scores(b.column("text").to_pylist()), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (null id: held_out false)."""
    scored = score_toxicity(docs, fit_toxicity(docs, labels))
    return scored.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), MOD) == HELD_OUT, F.lit(False)).alias("held_out"),
                         "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
