"""Main text of HTML pages by minimum-cut labelling (operator 11).

A page is cut into blocks (see ``html_blocks``).  A logistic classifier gives
each block a probability of being article text; its costs are the capacities
to source and sink.  Blocks that follow each other, and blocks of one parent
element, are joined by edges whose capacity falls with their distance in the
document tree.  The minimum cut is the labelling of least cost.

The classifier is trained here.  Pages carry no labels, so the parts that
their markup names (article, main; nav, footer, sidebars, adverts, comments)
label the training blocks.  Each stands in the sample three times: as it is;
with all features of such marks hidden, so that the weights of text features
serve pages without marks; and, with the other label, under the marks of the
other kind of part, as a reader's comment may read like an article, and a list
of links may belong to one.  Weights are held near stated ones (a Gaussian
prior), which decide alone where a corpus has nothing to learn from.

Input rows: a null or empty page gives an empty text; repeated rows give
repeated results; null ids and urls pass through; an empty table gives an
empty result; extra columns are not read.  Broken markup never raises.  Pages of any length are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlq.llm.html_blocks import APART, HEADING, ITEM, MAIN, PARAGRAPH, SIDE, STRONG, Page, parse
from crawlq.llm.min_cut import content_side

FIT_PAGES = 1000            # pages of the training sample, at most (more only if rows are equal)
FIT_BLOCKS = 20_000         # blocks of the training sample, at most
BLOCKS_A_PAGE = 64
PRIOR_STRENGTH = 4.0
MASKED_WEIGHT = 0.5
LIMIT = 8.0                 # a block's log odds, at most
UNIT = 1000                 # capacities are whole numbers
NEXT_TO = 1.2               # smoothness of neighbours in page order, in log odds
SAME_PARENT = 0.8           # and of neighbours in one parent element
FADE = 0.6                  # per step between their elements in the tree
ACROSS = 0.1                # where a marked part begins or ends
FAR = 8                     # steps

FEATURES = {                # name: weight before training
    "bias": -0.6,
    "in a part that is no article": -4.0,
    "in a part that is one": 3.0,
    "in an article or main element": 2.0,
    "share of link text": -3.0,
    "log words": 1.2,
    "sentence end": 0.8,
    "heading": 0.6,
    "paragraph": 0.8,
    "item or cell": -0.4,
    "three words or less": -0.8,
    "copyright sign": -2.5,
    "share of words in small letters": 0.4,
}
MARKS = (1, 2, 3)           # the features that markup names
PRIOR = np.array(list(FEATURES.values()))
_LOWER = re.compile(r"(?:^| )[a-zß-ÿ]")
_ENDS = tuple(".!?…\"»”:;")


def features(page: Page) -> np.ndarray:
    rows = []
    for b in page.blocks:
        words = b.text.split(" ")
        n = len(words)
        rows.append((
            1.0, b.mark in (SIDE, APART), b.mark in (MAIN, STRONG), b.strong and b.mark not in (SIDE, APART),
            min(b.link_chars / len(b.text), 1.0), math.log1p(n) / 2, b.text.endswith(_ENDS), b.tag in HEADING,
            b.tag in PARAGRAPH, b.tag in ITEM, n <= 3, "©" in b.text, len(_LOWER.findall(b.text)) / n))
    return np.array(rows, float).reshape(len(rows), len(FEATURES))


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression with a Gaussian prior round ``PRIOR``, by Newton's method."""
    if not len(y):
        return PRIOR.copy()
    hidden, other = x.copy(), x.copy()
    hidden[:, MARKS] = 0
    other[:, MARKS] = np.where(y[:, None] == 1, (1, 0, 0), (0, 1, 1))
    # Both labels weigh the same, whatever their share.
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    weight = np.concatenate([weight, MASKED_WEIGHT * weight, weight])
    x, y = np.concatenate([x, hidden, other]), np.concatenate([y, y, 1 - y])
    w = PRIOR.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + PRIOR_STRENGTH * (w - PRIOR)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + PRIOR_STRENGTH * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _steps(page: Page, a: int, b: int) -> int:
    """Steps between two elements in the tree, ``FAR`` at most."""
    n = 0
    while a != b and n < FAR:
        if page.depth[a] >= page.depth[b]:
            a = page.parent[a]
        else:
            b = page.parent[b]
        n += 1
    return n


def smoothness(page: Page) -> list[tuple[int, int, int]]:
    """Edges between blocks next to each other, and between neighbours in one parent element."""
    edges = []
    last: dict[int, int] = {}
    blocks = page.blocks
    for j, b in enumerate(blocks):
        if j:
            a = blocks[j - 1]
            w = NEXT_TO * FADE ** _steps(page, a.node, b.node) * (1 if a.part == b.part else ACROSS)
            edges.append((j - 1, j, round(UNIT * w)))
        home = page.parent[b.node] if b.node else 0
        i = last.get(home)
        if i is not None:
            w = SAME_PARENT * (1 if blocks[i].part == b.part else ACROSS)
            edges.append((i, j, round(UNIT * w)))
        last[home] = j
    return edges


def main_text(html: str | None, weights: np.ndarray) -> str:
    """The blocks of a page on the article's side of the cut, a line each."""
    page = parse(html or "")
    if not page.blocks:
        return ""
    odds = np.clip(features(page) @ weights, -LIMIT, LIMIT)
    keep = content_side([round(UNIT * g) for g in odds.tolist()], smoothness(page))
    return "\n".join(b.text for b, on in zip(page.blocks, keep) if on)


def fit_blocks(pages: DataFrame) -> np.ndarray:
    """Classifier weights from the blocks of the pages with the smallest hashes of id and url.

    At most ``FIT_BLOCKS`` rows of features reach the driver, whatever the
    corpus; whole pages never do.
    """
    hashed = pages.select("html", F.xxhash64("page_id", "url").alias("h")).where(F.col("html").isNotNull())
    bound = hashed.select("h").orderBy("h").limit(FIT_PAGES).agg(F.max("h")).first()[0]
    if bound is None:
        return PRIOR.copy()

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, order, xs, ys = [], [], [], []
            for html, h in zip(batch.column(0), batch.column(1).to_pylist()):
                page = parse(html.as_py())
                known = [i for i, b in enumerate(page.blocks) if b.mark]
                known = known[::-(-len(known) // BLOCKS_A_PAGE) or 1]
                x = features(page)
                for i in known:
                    hs.append(h)
                    order.append(i)
                    xs.append(x[i].tolist())
                    ys.append(int(page.blocks[i].mark in (MAIN, STRONG)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hs, pa.int64()), pa.array(order, pa.int32()), pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.int32())],
                names=["h", "i", "x", "y"])

    rows = (hashed.where(F.col("h") <= bound).mapInArrow(marked, "h long, i int, x array<double>, y int")
            .orderBy("h", "i", "y", "x").limit(FIT_BLOCKS).collect())
    return fit(np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r["y"] for r in rows], float))


def extract(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    model = fit_blocks(pages) if weights is None else weights

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(h.as_py(), model) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(
        texts, "page_id long, url string, text string, n_chars long")
