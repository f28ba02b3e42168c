"""Document quality from a linear-chain CRF over lines (operator 5).

Every line gets one of two labels, bad (0) or good (1).  A line's score sums
weights of its own binned features and of those of the line before and after;
a 2x2 matrix scores neighbouring labels.  Forward-backward gives P(good) per
line; their mean weighted by line length, calibrated on the training sample,
is the document's score.

Training: only documents are labelled, so at first all lines of a document
carry its label; after each round the lines of bad documents that the model
holds to be good are relabelled (at least the worst line stays bad).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlq.llm.common import drop_worker_caches
from crawlq.llm.sample import crc_mod, labelled_sample, prior_shift

PER_CLASS = 2000        # documents of each label in the training sample, at most
BINS = 8
THRESHOLD = 0.7
MOD, HELD_OUT = 4, 2
BATCH = 512             # documents scored together


def _classes() -> bytes:
    out = bytearray(b"#" * 256)
    for c in range(256):
        ch = chr(c)
        if c >= 128 or "a" <= ch <= "z":
            out[c] = ord("a")
        elif "A" <= ch <= "Z":
            out[c] = ord("A")
        elif ch.isdigit():
            out[c] = ord("0")
        elif ch in " \t\n\r\x0b\x0c":
            out[c] = ord(" ")
        elif ch in ".,;:'\"?-()":
            out[c] = ord(".")
    return bytes(out)


_CLASS = _classes()
N_FEATURES = 12


def line_features(line: bytes, before: bytes | None) -> tuple[float, ...]:
    n = len(line)
    t = line.translate(_CLASS)
    words = line.split()
    k = len(words)
    upper, letters = t.count(b"A"), t.count(b"A") + t.count(b"a")
    m = max(n, 1)
    return (
        n, k, n / max(k, 1),
        upper / max(letters, 1),
        t.count(b"#") / m,
        t.count(b".") / m,
        t.count(b"0") / m,
        t.count(b"# ") / max(k, 1),
        t.count(b" # ") / max(k, 1),
        len(set(words)) / max(k, 1),
        sum(map(bytes.__eq__, words, words[1:])) / max(k, 1),
        float(line == before),
    )


def lines_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


@dataclass
class Crf:
    edges: np.ndarray        # (features, bins - 1) upper bounds of the bins
    weights: np.ndarray      # (3, features, bins + 1): own, line before, line after; last bin: no such line
    bias: float
    moves: np.ndarray        # (2, 2) score of label a followed by label b
    scale: np.ndarray        # calibration: slope and offset

    def binned(self, feats: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.edges[f], feats[:, f], side="left")
                         for f in range(feats.shape[1])], axis=1)


def neighbours(bins: np.ndarray, counts: np.ndarray, none: int) -> np.ndarray:
    """(3, lines, features): bins of each line, the one before, the one after, within its document."""
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    last = np.cumsum(counts) - 1
    prev, nxt = np.roll(bins, 1, axis=0), np.roll(bins, -1, axis=0)
    prev[first], nxt[last] = none, none
    return np.stack([bins, prev, nxt])


def line_scores(nb: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(nb.shape[1], bias)
    for where in range(3):
        for f in range(nb.shape[2]):
            out += weights[where, f, nb[where, :, f]]
    return out


def forward_backward(scores: np.ndarray, counts: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """P(good) of each line; with ``pairs`` also the expected label pairs (2, 2).

    Documents stand one after the other in ``scores``.  They are processed
    together, line number by line number, the longest first.
    """
    order = np.argsort(-counts, kind="stable")
    start = np.concatenate([[0], np.cumsum(counts)[:-1]])[order]
    length = counts[order]
    alive = np.searchsorted(-length, -np.arange(length[0]) - 1, side="right")    # documents with a line number t
    a, b = np.exp(moves[0] - moves.max()), np.exp(moves[1] - moves.max())
    emit = np.empty((len(scores), 2))
    emit[:, 1] = 1 / (1 + np.exp(-np.clip(scores, -30, 30)))
    emit[:, 0] = 1 - emit[:, 1] + 1e-14
    fwd = np.empty((len(scores), 2))
    for t in range(length[0]):
        at = start[:alive[t]] + t
        if t:
            p = fwd[at - 1]
            x = np.stack([p[:, 0] * a[0] + p[:, 1] * b[0], p[:, 0] * a[1] + p[:, 1] * b[1]], 1) * emit[at]
        else:
            x = emit[at].copy()
        fwd[at] = x / x.sum(1, keepdims=True)
    bwd = np.ones((len(scores), 2))
    expected = np.zeros((2, 2))
    trans = np.stack([a, b])
    for t in range(length[0] - 2, -1, -1):
        at = start[:alive[t + 1]] + t
        y = emit[at + 1] * bwd[at + 1]
        x = np.stack([y @ a, y @ b], 1)
        bwd[at] = x / x.sum(1, keepdims=True)
        if pairs:
            joint = fwd[at][:, :, None] * trans * y[:, None, :]
            expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    post = fwd * bwd
    good = post[:, 1] / post.sum(1)
    return (good, expected) if pairs else good


def _inputs(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    feats, counts = [], []
    for text in texts:
        lines = lines_of(text)
        counts.append(len(lines))
        before = None
        for line in lines:
            feats.append(line_features(line, before))
            before = line
    f = np.array(feats, np.float64)
    return f, np.array(counts), f[:, 0] + 1.0


def _doc_mean(good: np.ndarray, weight: np.ndarray, counts: np.ndarray) -> np.ndarray:
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(sample: list[tuple[str, int]], rounds: int = 3, steps: int = 60, l2: float = 1.0) -> Crf:
    """Fit on (text, label) pairs by Adam on the conditional likelihood.

    With an empty sample, or one with a single label, the model knows nothing
    and scores every document by the share of label 1 (0.5 for an empty one).
    """
    share = float(np.mean([y for _, y in sample])) if sample else 0.5
    blank = Crf(np.zeros((N_FEATURES, BINS - 1)), np.zeros((3, N_FEATURES, BINS + 1)), 0.0, np.zeros((2, 2)),
                np.array([0.0, _logit(np.array([share]))[0]]))
    if share in (0.0, 1.0) or not sample:
        return blank
    feats, counts, weight = _inputs([t for t, _ in sample])
    doc_y = np.array([y for _, y in sample])
    m = blank
    # Bins by rank among distinct values, so that rare values get bins of their own.
    m.edges = np.stack([np.quantile(np.unique(feats[:, f]), np.linspace(0, 1, BINS + 1)[1:-1]) for f in range(N_FEATURES)])
    nb = neighbours(m.binned(feats), counts, BINS)
    y = np.repeat(doc_y, counts).astype(float)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    inner = np.ones(len(y), bool)
    inner[first] = False
    balance = 1.0 / len(y)
    params = [m.weights, np.zeros(1), m.moves]
    for r in range(rounds):
        lab = y.astype(int)
        seen = np.zeros((2, 2))
        np.add.at(seen, (lab[:-1][inner[1:]], lab[1:][inner[1:]]), 1)
        mean, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            good, pair = forward_backward(line_scores(nb, params[0], params[1][0]), counts, params[2], pairs=True)
            d = y - good
            g = np.zeros_like(params[0])
            for where in range(3):
                for f in range(N_FEATURES):
                    g[where, f] = np.bincount(nb[where, :, f], d, BINS + 1)
            grads = [(g - l2 * params[0]) * balance, np.array([d.sum() * balance]), (seen - pair - l2 * params[2]) * balance]
            for p, gr, u, v in zip(params, grads, mean, var):
                u += 0.1 * (gr - u)
                v += 0.01 * (gr * gr - v)
                p += 0.1 * (u / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-10)
        good = forward_backward(line_scores(nb, params[0], params[1][0]), counts, params[2])
        if r < rounds - 1:
            y = np.repeat(doc_y, counts).astype(float)
            y[(y == 0) & (good > 0.5)] = 1.0
            worst = np.minimum.reduceat(good, first)
            y[(np.repeat(doc_y, counts) == 0) & (good <= np.repeat(worst, counts))] = 0.0
    m.bias = float(params[1][0])
    x = _logit(_doc_mean(good, weight, counts))
    ab = np.array([1.0, 0.0])
    X = np.stack([x, np.ones_like(x)], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(X @ ab, -30, 30)))
        h = (X * (p * (1 - p))[:, None]).T @ X + 1e-3 * np.eye(2)
        ab = ab + np.clip(np.linalg.solve(h, X.T @ (doc_y - p) - 1e-3 * ab), -2, 2)
    m.scale = ab
    return m


def score_texts(m: Crf, texts: list[str | None]) -> np.ndarray:
    feats, counts, weight = _inputs(texts)
    nb = neighbours(m.binned(feats), counts, BINS)
    good = forward_backward(line_scores(nb, m.weights, m.bias), counts, m.moves)
    z = m.scale[0] * _logit(_doc_mean(good, weight, counts)) + m.scale[1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Crf:
    """The model of the whole corpus: fitted on a bounded sample outside the held-out fold."""
    sample, share = labelled_sample(docs, labels, "quality", mod=MOD, held_out=HELD_OUT, per_class=per_class)
    model = fit(sample)
    model.scale = model.scale + np.array([0.0, prior_shift(sample, share)])
    return model


def score_quality(docs: DataFrame, model: Crf, keep: bool = False) -> DataFrame:
    """doc_id and score of every row; ``keep=True``: all rows of ``docs`` in ``doc`` beside the score.

    The text alone enters the score.  A null text scores like the empty one,
    which is a document of one empty line; repeated rows score alike.
    """
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")]
    if keep:
        cols.append(F.struct(*docs.columns).alias("doc"))
    rows = docs.select(*cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_caches()
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                b = batch.slice(k, BATCH)
                out = [b.column("doc_id"), pa.array(score_texts(model, b.column("text").to_pylist()))]
                names = ["doc_id", "score"]
                if keep:
                    out.append(b.column("doc"))
                    names.append("doc")
                yield pa.RecordBatch.from_arrays(out, names=names)

    extra = f", doc {rows.schema['doc'].dataType.simpleString()}" if keep else ""
    return rows.mapInArrow(run, "doc_id long, score double" + extra)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (null id: held_out false)."""
    scored = score_quality(docs, fit_quality(docs, labels))
    return scored.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), MOD) == HELD_OUT, F.lit(False)).alias("held_out"),
                         "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
