"""Operator 10 against a brute force over a whole table, and the suffix sort's share of its result.

Usage: python tests/llm/brute_repeats.py DIR     (a folder with documents.parquet)

The brute force hashes the 400-byte string at every byte of every text, sorts
the hashes in memory, and shares no code with the operator.
"""

import hashlib
import os
import sys
import time

import numpy as np
import pyarrow.parquet as pq

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

LENGTH = 400


def brute_force(ids, texts):
    """{doc_id: (n_bytes, n_removed, n_spans, kept_sha256)} for unique ids."""
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    table = np.random.default_rng(77).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    base = 0x9E3779B97F4A7C15 | 1
    inverse = pow(base, -1, 1 << 64)

    def powers(b):
        p = np.full(n, b, np.uint64)
        p[:1] = 1
        return np.cumprod(p, out=p)

    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(table[data] * powers(base), out=sums[1:])
    h = sums[LENGTH:] - sums[:-LENGTH]
    del sums
    h *= powers(inverse)[:len(h)]
    ends = np.cumsum(sizes)
    inside = np.ones(len(h), bool)                       # windows that lie in one text
    for a, z in zip(ends - sizes, ends):
        inside[max(a, z - LENGTH + 1):z] = False
    start = np.flatnonzero(inside).astype(np.int64)
    h = h[start]
    ordered = np.sort(h)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    at = np.searchsorted(twice, h).clip(0, max(len(twice) - 1, 0))
    start = start[twice[at] == h] if len(twice) else start[:0]
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, start, 1)
    np.add.at(step, start + LENGTH, -1)
    gone = np.cumsum(step)[:n] > 0
    out = {}
    for i, a, z in zip(ids, ends - sizes, ends):
        g = gone[a:z]
        runs = int(g[:1].sum()) + int((g[1:] & ~g[:-1]).sum())
        out[i] = (int(z - a), int(g.sum()), runs, hashlib.sha256(data[a:z][~g].tobytes()).hexdigest())
    return out


def main(folder):
    from crawlq.llm import suffix_dedup
    from crawlq.session import local_session

    spark = local_session("*", shuffle_partitions=32, app="brute-repeats")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    t = time.time()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()}
    print(f"operator: {len(got)} rows, {time.time() - t:.0f} s", flush=True)
    whole = suffix_dedup._sorted_spans
    suffix_dedup._sorted_spans = lambda contexts: whole(contexts.limit(0))
    without = suffix_dedup.remove_repeats(docs).agg({"n_removed": "sum"}).first()[0]
    spark.stop()
    rows = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"])
    t = time.time()
    want = brute_force(rows.column("doc_id").to_pylist(), [(x or "").encode() for x in rows.column("text").to_pylist()])
    print(f"brute force: {len(want)} rows, {time.time() - t:.0f} s")
    differ = [i for i in want if got.get(i) != want[i]]
    removed = sum(x[1] for x in want.values())
    print(f"bytes {sum(x[0] for x in want.values())}, removed {removed}, rows that lose bytes {sum(x[1] > 0 for x in want.values())}")
    print(f"rows that differ: {len(differ) + len(set(got) - set(want))}", [(i, got.get(i), want[i]) for i in differ[:3]])
    print(f"removed by the sort alone: {removed - without} ({100 * (removed - without) / max(removed, 1):.1f} %)")


if __name__ == "__main__":
    main(sys.argv[1])
