"""Removal of long repeated strings by sharded suffix sorting (operator 10).

Every byte covered by a 400-byte string that also starts elsewhere goes.

* Each 400-byte window has an anchor: of its 32-byte grams the one with the
  least hash, the leftmost among equals.  Equal windows have their anchor at the
  same offset.  Consecutive windows with one anchor, and with offsets in one
  band, form a piece; all windows of a piece hold the same core of 278 bytes.
* So a window can only repeat where its piece's core repeats.  Pieces whose core
  occurs once are done with.  Pieces that are equal as a whole are repeats
  without further work.
* Of the others, one of each content goes with its core's group to a shard of
  bounded size, where the induced suffix sort orders all suffixes; windows that
  agree with a neighbour in that order over 400 bytes are repeats.
* A core with more than ``GROUP`` contents is not sorted in one place: its
  windows are compared by their 128-bit digests, shuffled one by one.

Nothing is dropped on the way: every window is decided.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlq.llm.common import stored
from crawlq.llm.shingles import mix64
from crawlq.llm.suffix_sort import suffix_array

LENGTH = 400
GRAM = 32
BAND = 123                               # offsets of an anchor in one piece at most
GROUP = 4_096                            # contents of one core that are sorted together at most
SHARD_BYTES = 4 * 1024 * 1024
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOW32 = np.uint64(0xFFFFFFFF)


def _rolling(b: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hashes (mod 2^64) of all strings of ``length`` in ``b``, by doubling."""
    out, done, power = None, 0, None
    cur, n = b.astype(np.uint64) + np.uint64(1), 1
    base = np.array([_BASE])        # arrays wrap around silently
    while True:
        if length & n:
            if out is None:
                out, done = cur, n
            else:
                m = len(b) - done - n + 1
                out = out[:m] * power + cur[done:done + m]
                done += n
        if done == length:
            return out[:len(b) - length + 1]
        m = len(b) - 2 * n + 1
        cur = cur[:m] * base + cur[n:n + m]
        base = base * base
        n *= 2
        rest = [k for k in (1 << j for j in range(32)) if k >= n and length & k]
        if done and rest:
            power = np.array([pow(int(_BASE), rest[0], 2 ** 64)], np.uint64)


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Least value of every w neighbours, from running minima of blocks in both directions."""
    n = len(v)
    if w > n:
        return v[:0]
    pad = -n % w
    full = np.concatenate([v, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, w)
    left = np.minimum.accumulate(full, axis=1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - w + 1], left[w - 1:n])


def pieces(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor, band) of the pieces of a text."""
    n = len(raw)
    if n < LENGTH:
        z = np.empty(0, np.int64)
        return z, z, z, z
    h = mix64(_rolling(np.frombuffer(raw, np.uint8), GRAM))
    tagged = (h & ~_LOW32) | np.arange(len(h), dtype=np.uint64)
    anchor = (_sliding_min(tagged, LENGTH - GRAM + 1) & _LOW32).astype(np.int64)
    band = (anchor - np.arange(len(anchor))) // BAND
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (band[1:] != band[:-1])]))
    last = np.concatenate([first[1:] - 1, [len(anchor) - 1]])
    return first, last, anchor[first], band[first]


def _utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _rows(docs: DataFrame, *more) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("h"),
                       F.col("text").alias("text"), *more)


_PIECE = "key long, full binary, doc_id long, h long, p1 int, p2 int"


def _all_pieces(docs: DataFrame) -> DataFrame:
    """key (hash of the core), full (digest of the piece's bytes and offset), doc_id, h, p1, p2."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                b = batch.slice(k, 256)
                keys, fulls, lows, highs, counts = [], [], [], [], []
                for text in b.column("text"):
                    raw = _utf8(text.as_py())
                    p1, p2, anchor, band = pieces(raw)
                    counts.append(len(p1))
                    lows.append(p1)
                    highs.append(p2)
                    lo = (anchor - BAND * band).tolist()
                    for s, x, y, a, g in zip(lo, p1.tolist(), p2.tolist(), anchor.tolist(), band.tolist()):
                        keys.append(xxhash.xxh3_64_intdigest(raw[s:s + LENGTH - BAND + 1], seed=g))
                        fulls.append(xxhash.xxh3_128_digest(raw[x:y + LENGTH], seed=a - x))
                at = np.repeat(np.arange(b.num_rows), counts)
                low, high = (np.concatenate(c).astype(np.int32) if c else np.empty(0, np.int32) for c in (lows, highs))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(fulls, pa.binary()), b.column("doc_id").take(pa.array(at)),
                     b.column("h").take(pa.array(at)), pa.array(low), pa.array(high)],
                    names=["key", "full", "doc_id", "h", "p1", "p2"])

    return _rows(docs).mapInArrow(run, _PIECE)


def _with_texts(docs: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """Texts of the documents in ``wanted``, each with the list of its rows there (no longer than the document)."""
    lists = stored(wanted.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g")).agg(F.collect_list(F.struct(*columns)).alias("want")), "rep-wanted")
    one = _rows(docs).join(lists, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")))
    return one.select("doc_id", "h", "text", "want")


def _contexts(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """key, alone, doc_id, h, p1, context for the pieces in ``reps``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for d, h, text, want in zip(*(batch.column(c) for c in ("doc_id", "h", "text", "want"))):
                raw = _utf8(text.as_py())
                out += [(w["key"], w["alone"], d.as_py(), h.as_py(), w["p1"], raw[w["p1"]:w["p2"] + LENGTH]) for w in want.as_py()]
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["key", "alone", "doc_id", "h", "p1", "context"])

    return _with_texts(docs, reps, ["key", "alone", "p1", "p2"]).mapInArrow(
        run, "key long, alone boolean, doc_id long, h long, p1 int, context binary").distinct()


def repeated_windows(contexts: list[bytes]) -> list[np.ndarray]:
    """Starts of the 400-byte strings of each context that also start elsewhere in one of them."""
    ends = np.cumsum([len(c) + 1 for c in contexts])
    begin = np.concatenate([[0], ends[:-1]])
    # Bytes become 1..256; 257 ends a context; the one 0 ends the whole.
    s = np.frombuffer(b"\0".join(contexts) + b"\0\0", np.uint8).astype(np.int32) + 1
    s[ends - 1] = 257
    s[-1] = 0
    order = suffix_array(s, 258)
    owner = np.searchsorted(ends, order, side="right").clip(0, len(contexts) - 1)
    order = order[(order + LENGTH < ends[owner]) & (order < ends[-1])]
    # Suffixes that agree over 400 bytes are neighbours in the order.
    h = _rolling_any(s, LENGTH)[order]
    same = h[1:] == h[:-1]
    hit = np.sort(order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]) if len(order) else order
    cut = np.searchsorted(hit, np.concatenate([begin, [ends[-1]]]))
    return [hit[a:z] - x for a, z, x in zip(cut[:-1], cut[1:], begin)]


def _rolling_any(s: np.ndarray, length: int) -> np.ndarray:
    return mix64(_rolling(s, length)) if len(s) >= length else np.empty(0, np.uint64)


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of runs of consecutive numbers."""
    if not len(starts):
        return starts, starts
    gap = np.flatnonzero(starts[1:] != starts[:-1] + 1)
    return starts[np.concatenate([[0], gap + 1])], starts[np.concatenate([gap, [len(starts) - 1]])]


def _sorted_spans(contexts: DataFrame) -> DataFrame:
    """doc_id, h, a, z (bytes covered) found in the shards' suffix orders."""
    total = contexts.agg(F.sum(F.length("context")).alias("b")).first()["b"] or 0
    shards = max(1, -(-total // SHARD_BYTES))

    def sort(key, table):
        texts = table.column("context").to_pylist()
        alone = table.column("alone").to_pylist()
        out = {"doc_id": [], "h": [], "a": [], "z": []}
        for k, found in enumerate(repeated_windows(texts)):
            if alone[k]:                 # others are covered as a whole already
                first, last = _runs(found)
                p = table.column("p1")[k].as_py()
                out["doc_id"] += [table.column("doc_id")[k].as_py()] * len(first)
                out["h"] += [table.column("h")[k].as_py()] * len(first)
                out["a"] += (first + p).tolist()
                out["z"] += (last + p + LENGTH).tolist()
        return pa.table(out, schema=pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("a", pa.int64()), ("z", pa.int64())]))

    return (contexts.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard")
            .applyInArrow(sort, "doc_id long, h long, a long, z long"))


def _digest_spans(docs: DataFrame, hot: DataFrame) -> DataFrame:
    """The same for pieces of cores with too many contents for one shard: window digests, counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, h, text, want in zip(*(batch.column(c) for c in ("doc_id", "h", "text", "want"))):
                raw = _utf8(text.as_py())
                at = [p for w in want.as_py() for p in range(w["p1"], w["p2"] + 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(raw[p:p + LENGTH]) for p in at], pa.binary()), pa.array([d.as_py()] * len(at), pa.int64()),
                     pa.array([h.as_py()] * len(at), pa.int64()), pa.array(at, pa.int64())], names=["digest", "doc_id", "h", "a"])

    windows = stored(_with_texts(docs, hot, ["p1", "p2"]).mapInArrow(run, "digest binary, doc_id long, h long, a long"), "rep-windows")
    twice = stored(windows.groupBy("digest").agg(F.count("*").alias("c")).where("c > 1").select(F.col("digest").alias("t")), "rep-twice")
    return windows.join(twice, F.col("digest") == F.col("t")).select("doc_id", "h", "a", (F.col("a") + LENGTH).alias("z"))


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row (and the kept bytes as ``kept``).

    A null text counts as empty; texts under 400 bytes keep all.  Repeated
    rows are documents each, so they repeat one another.  Null ids are ids
    like others.  Other columns are ignored.
    """
    shared = stored(_all_pieces(docs).select("key", "full").groupBy("key")
                    .agg(F.count("*").alias("n"), F.min("full").alias("lo"), F.max("full").alias("hi"))
                    .where("n > 1").select(F.col("key").alias("k"), (F.col("lo") != F.col("hi")).alias("mixed")), "rep-cores")
    found = stored(_all_pieces(docs).join(shared, F.col("key") == F.col("k")).drop("k"), "rep-pieces")
    whole = found.where("not mixed").select("doc_id", "h", "p1", "p2")

    # Cores with several contents: how often each content occurs, and one piece of each.
    mixed = found.where("mixed")
    rep = F.min(F.struct("doc_id", "h", "p1", "p2"))
    contents = stored(mixed.groupBy("key", "full").agg(F.count("*").alias("c"), rep.alias("r")), "rep-contents")
    again = stored(contents.where("c > 1").select(F.col("key").alias("k"), F.col("full").alias("f")), "rep-again")
    equal = mixed.join(again, (F.col("key") == F.col("k")) & (F.col("full") == F.col("f"))).select("doc_id", "h", "p1", "p2")
    sizes = stored(contents.groupBy("key").agg(F.count("*").alias("kinds")).where(f"kinds > {GROUP}").select(F.col("key").alias("k")), "rep-hot")
    reps = contents.select("key", (F.col("c") == 1).alias("alone"), "r.*")
    contexts = stored(_contexts(docs, reps.join(sizes, F.col("key") == F.col("k"), "left_anti")), "rep-contexts")
    spans = (whole.unionByName(equal).select("doc_id", "h", F.col("p1").cast("long").alias("a"), (F.col("p2") + LENGTH).cast("long").alias("z"))
             .unionByName(_sorted_spans(contexts)))
    if sizes.limit(1).count():
        hot = mixed.join(sizes, F.col("key") == F.col("k")).select("doc_id", "h", "p1", "p2").distinct()
        spans = spans.unionByName(_digest_spans(docs, hot))
    # Rows that repeat id and text share their spans, which are kept once.
    lists = stored(spans.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g")).agg(F.collect_set(F.struct("a", "z")).alias("spans")), "rep-spans")
    joined = _rows(docs).join(lists, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                b = batch.slice(k, 512)
                out = [cut(_utf8(t.as_py()), s.as_py()) for t, s in zip(b.column("text"), b.column("spans"))]
                cols = [b.column("doc_id"), *(pa.array([o[j] for o in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string())))]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if keep_text:
                    cols.append(pa.array([o[4] for o in out], pa.binary()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.select("doc_id", "text", "spans").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else ""))


def cut(raw: bytes, spans: list[dict] | None) -> tuple[int, int, int, str, bytes]:
    """Size, bytes removed, maximal removed runs, digest and bytes of what is left."""
    kept, at, n = [], 0, 0
    end = -1
    for s in sorted(spans or [], key=lambda x: x["a"]):
        if s["a"] > end:
            n += 1
            kept.append(raw[max(at, 0):s["a"]])
        end = max(end, s["z"])
        at = end
    kept.append(raw[at:])
    left = b"".join(kept)
    return len(raw), len(raw) - len(left), n, hashlib.sha256(left).hexdigest(), left
