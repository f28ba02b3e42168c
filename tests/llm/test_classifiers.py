"""Operators 5 (whole table) and 9 (every fifth document, odd texts) against plain Python, one document and one window at a time."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pytest

pytest.importorskip("crawlq.llm")

from crawlq.llm import quality, toxicity  # noqa: E402
from crawlq.llm.sample import labelled_sample  # noqa: E402

SF = "/root/testdata/sf0.001"
ODD_TEXTS = [None, "", " \n\n ", "one", "x" * 40_000, "word " * 20_000, "é!\n" * 300]


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "no id")], table.schema)
    return table.unionByName(odd).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def _sigmoid(x):
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _plain_quality(m, text):
    lines = (text or "").encode().split(b"\n")
    rows = [quality.line_features(x, lines[i - 1] if i else None) for i, x in enumerate(lines)]
    bins = [[sum(1 for e in m.edges[f] if e < v) for f, v in enumerate(r)] for r in rows]
    nowhere = [quality.BINS] * quality.N_FEATURES
    score = []
    for i, own in enumerate(bins):
        around = (own, bins[i - 1] if i else nowhere, bins[i + 1] if i + 1 < len(bins) else nowhere)
        score.append(m.bias + sum(m.weights[w, f, b] for w, of in enumerate(around) for f, b in enumerate(of)))
    emit = [(1 - _sigmoid(s) + 1e-14, _sigmoid(s)) for s in score]
    move = [[math.exp(m.moves[a][b]) for b in (0, 1)] for a in (0, 1)]

    def unit(p):
        return p[0] / sum(p), p[1] / sum(p)

    fwd = [unit(emit[0])]
    for e in emit[1:]:
        p = fwd[-1]
        fwd.append(unit([(p[0] * move[0][b] + p[1] * move[1][b]) * e[b] for b in (0, 1)]))
    bwd = [(1.0, 1.0)]
    for e in emit[:0:-1]:
        p = bwd[-1]
        bwd.append(unit([sum(move[a][b] * e[b] * p[b] for b in (0, 1)) for a in (0, 1)]))
    bwd.reverse()
    good = [unit((f[0] * b[0], f[1] * b[1]))[1] for f, b in zip(fwd, bwd)]
    weight = [len(x) + 1 for x in lines]
    mean = min(max(sum(g * w for g, w in zip(good, weight)) / sum(weight), 1e-6), 1 - 1e-6)
    return _sigmoid(m.scale[0] * math.log(mean / (1 - mean)) + m.scale[1])


def test_quality_report_equals_plain_forward_backward(spark, docs, labels):
    model = quality.fit_quality(docs, labels)
    assert np.abs(model.weights).max() > 0
    got = quality.quality_report(docs, labels).collect()
    want = {r.doc_id: _plain_quality(model, r.text) for r in docs.collect()}
    assert len(got) == len(want) and {r.doc_id for r in got} == set(want)
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-6)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.predicted == int(r.score >= 0.7)


def _gate(x):
    return 1 / (1 + np.exp(-x))


def _plain_window(net, words):
    """Logit of one window, word by word."""
    p, h = net.p, toxicity.HIDDEN
    if not words:
        return float(p["c"][0])
    inputs = [net.word_inputs([w])[0].astype(float) for w in words]
    states = []
    for d, order in enumerate((inputs, inputs[::-1])):
        s, seen = np.zeros(h), []
        for x in order:
            g, u = x @ p["W"][d] + p["b"][d], s @ p["U"][d]
            z, r = _gate(g[:h] + u[:h]), _gate(g[h:2 * h] + u[h:2 * h])
            n = np.tanh(g[2 * h:] + r * u[2 * h:])
            s = (1 - z) * n + z * s
            seen.append(s)
        states.append(seen if d == 0 else seen[::-1])
    both = [np.concatenate(pair) for pair in zip(*states)]
    att = np.array([np.tanh(b @ p["A"]) @ p["v"] for b in both])
    w = np.exp(att - att.max())
    return float(sum(a * b for a, b in zip(w / w.sum(), both)) @ p["o"] + p["c"][0])


def _plain_toxicity(net, text):
    words = (text or "").lower().split()
    logits = [_plain_window(net, words[:toxicity.WINDOW])]
    at = toxicity.STEP
    while at - toxicity.STEP + toxicity.WINDOW < len(words):
        logits.append(_plain_window(net, words[at:at + toxicity.WINDOW]))
        at += toxicity.STEP
    top = sorted(logits)[-2:]
    x = [max(-30.0, min(30.0, v)) for v in (top[-1], top[0], math.log(len(logits)), 1.0)]
    return _sigmoid(sum(a * b for a, b in zip(net.scale, x)))


def test_toxicity_report_equals_a_loop_over_windows(spark, docs, labels):
    net = toxicity.fit_toxicity(docs, labels, per_class=60)
    some = docs.where("doc_id % 5 = 0 or doc_id >= 1000000000 or doc_id is null")
    got = toxicity.score_toxicity(some, net).collect()
    want = {r.doc_id: _plain_toxicity(net, r.text) for r in some.collect()}
    assert len(got) == len(want) and {r.doc_id for r in got} == set(want)
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-3), r.doc_id


def test_labelled_sample_of_odd_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)] + [(7, "again"), (8, None), (None, "x")], "doc_id long, text string")
    rows = [(i, i % 2) for i in range(40)] + [(4, 1), (None, 1), (9, None), (11, 5), (500, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    sample, share = labelled_sample(docs, labels, "toxic", mod=5, held_out=0, per_class=1000)
    fold = [i for i in (*range(40), 500) if zlib.crc32(str(i).encode()) % 5 != 0]
    # Of two labels the lower, of two texts the lesser; ids without a text only count for the share.
    want = sorted(("again" if i == 7 else f"text {i}", i % 2) for i in fold if i < 40)
    assert sorted(sample) == want
    assert share == pytest.approx(sum(i % 2 if i < 40 else 1 for i in fold) / len(fold))
    small, _ = labelled_sample(docs, labels, "toxic", mod=5, held_out=0, per_class=3)
    assert len(small) <= 6 and set(small) <= set(want)
    none, share = labelled_sample(docs, labels.limit(0), "toxic", mod=5, held_out=0, per_class=3)
    assert none == [] and share == 0.5


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, 1), (2, 1)], [(1, 0), (1, 1), (2, 7)]])
def test_reports_with_labels_that_teach_nothing(spark, rows):
    docs = spark.createDataFrame([(1, "one"), (2, None), (2, None), (None, "three")], "doc_id long, text string")
    for report, name in ((quality.quality_report, "quality"), (toxicity.toxicity_report, "toxic")):
        got = report(docs, spark.createDataFrame(rows, f"doc_id long, {name} int")).collect()
        assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
