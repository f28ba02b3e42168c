"""Spelling variants by a bidirectional FM-index (operator 12).

Words are counted over all documents (see ``word_counts`` for the rule that
drops a code point of some occurrences).  Two words are near if they are one
inserted, deleted or replaced code point apart.  One edit leaves the first or
the second half of a word as it is, so a search matches either half exactly
and extends over the other with one error.

The vocabulary is dealt to shards by halves: a word is indexed under each half
that a near word can share with it, and looked up under its own two halves.
So every search meets one shard for each half, whatever the vocabulary's size;
a half that very many words share is dealt to several shards, all of which are searched.

Input rows: a null text is empty, a null id stands as an empty text in the
hashed ``<doc_id>:<run>``; repeated rows count as often as they stand there;
empty tables give an empty result; ties go to the smaller word in code-point
order; extra columns are not read.  Texts and words of any length are handled whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlq.llm.common import maybe_broadcast, stored
from crawlq.llm.fm_index import BidirectionalIndex, one_error
from crawlq.llm.words import Words

MIN_POINTS = 6
MIN_COUNT = 5
DROP_MOD = 199
TIMES = 5                       # a form occurs at least so many times as often
CHUNK = 16 << 20                # bytes of text handled together
SHARD_CHARS = 600_000           # characters of the words of a shard, about
QUERIES = 20_000                # searches made together

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LEAD = 0xC3                    # U+00C0 to U+00FF are this byte and one of 0x80 to 0xBF in UTF-8
_LETTER = np.zeros(256, bool)
_LETTER[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)] = True
_SHORT = 64                     # bytes; longer runs are hashed one by one


def spelled(doc_id: str, run: str) -> str:
    """A lower-cased run as it is counted: one code point dropped if 199 divides its hash."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    return run if h % DROP_MOD else run[:h % len(run)] + run[h % len(run) + 1:]


# What a zero byte makes of each low byte of a crc32 (zlib inverts the state before and after).
_CRC_STEP = np.array([zlib.crc32(b"\0", i ^ 0xFFFFFFFF) ^ 0xFFFFFFFF for i in range(256)], np.uint32)


def _counts_of(docs: list[tuple[str, bytes]]) -> tuple[list[str], list[int]]:
    """Words of at least ``MIN_POINTS`` code points of some documents, with counts."""
    buf = b" ".join(text for _, text in docs).lower()
    text = np.frombuffer(buf, np.uint8)
    lead = text == _LEAD
    inside = _LETTER[text] | lead
    inside[1:] |= lead[:-1]
    words = Words(buf, inside)
    leads = np.concatenate([[0], np.cumsum(lead, dtype=np.int32)])
    points = words.lengths - (leads[words.starts + words.lengths] - leads[words.starts])
    words.only(np.flatnonzero(points >= MIN_POINTS))
    if not len(words):
        return [], []
    ends = np.cumsum([len(t) + 1 for _, t in docs])
    doc = np.searchsorted(ends, words.starts, side="right")
    one, two = words.hashes()
    number, texts = words.numbered(np.arange(len(words)), one, two)
    # crc32(a + b) is crc32(a) moved on by len(b) zero bytes, xor crc32(b).
    moved = np.empty((_SHORT + 1, len(docs)), np.uint32)
    moved[0] = [zlib.crc32(f"{doc_id}:".encode()) for doc_id, _ in docs]
    for n in range(1, _SHORT + 1):
        moved[n] = _CRC_STEP[moved[n - 1] & 0xFF] ^ (moved[n - 1] >> np.uint32(8))
    own = np.array([zlib.crc32(t) for t in texts], np.uint32)
    crc = moved[np.minimum(words.lengths, _SHORT), doc] ^ own[number]
    for i in np.flatnonzero(words.lengths > _SHORT):
        crc[i] = zlib.crc32(words.word(i), int(moved[0, doc[i]]))
    whole = crc % DROP_MOD != 0
    counts = np.bincount(number[whole], minlength=len(texts))
    extra: Counter[str] = Counter()
    for i in np.flatnonzero(~whole):
        run = texts[number[i]].decode()
        at = int(crc[i]) % len(run)
        run = run[:at] + run[at + 1:]
        if len(run) >= MIN_POINTS:
            extra[run] += 1
    names, ns = [t.decode() for t, n in zip(texts, counts) if n], [int(n) for n in counts if n]
    return names + list(extra), ns + list(extra.values())


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the runs ``[A-Za-z\\u00C0-\\u00FF]+`` of all texts, as they are counted.

    A run is lower-cased in A-Z; if 199 divides the crc32 of ``<doc_id>:<run>``,
    the code point at that crc32 modulo its length is dropped.  Words are the
    results of at least 6 code points that occur at least 5 times.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part):
            names, counts = _counts_of(part)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])

        part, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                part.append((doc_id, text.as_py()))
                size += len(part[-1][1])
                if size >= CHUNK:
                    yield out(part)
                    part, size = [], 0
        if part:
            yield out(part)

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"),
                        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _search(rows: pa.Table) -> pa.Table:
    """All searches of a shard: per looked-up word its near words' number and the most frequent one."""
    t = rows.to_pandas()
    t["word"] = t["word"].astype(object)
    known = t[t["kind"] == "index"].drop_duplicates("word")
    # Strings in Python are ordered by code points, so numbers are, too.
    known = known.sort_values("word")
    asked = t[t["kind"] != "index"].reset_index(drop=True)
    names, n = known["word"].to_numpy(), known["n"].to_numpy(np.int64)
    hashes = known["hash"].to_numpy(np.int64)
    out = {"word": asked["word"], "n": asked["n"].astype(np.int64), "near": np.zeros(len(asked), np.int64),
           "best_n": np.full(len(asked), -1, np.int64), "best": np.full(len(asked), None, object)}
    if len(known) and len(asked):
        points = np.array([ord(c) for w in names for c in w], np.int64)
        alphabet, codes = np.unique(points, return_inverse=True)
        index = BidirectionalIndex(codes.astype(np.int64) + 1, np.array([len(w) for w in names]))
        for kind in ("first", "second"):
            mine = asked.index[asked["kind"] == kind].to_numpy()
            for lo in range(0, len(mine), QUERIES):
                block = mine[lo:lo + QUERIES]
                words = asked["word"].to_numpy()[block]
                points = np.array([ord(c) for w in words for c in w], np.int64)
                at = np.searchsorted(alphabet, points).clip(max=len(alphabet) - 1)
                codes = np.where(alphabet[at] == points, at + 1, -1)
                lengths = np.array([len(w) for w in words])
                half = lengths // 2
                q, v = one_error(index, codes, np.cumsum(lengths) - lengths, lengths, half, forward=kind == "first")
                # A word in several parts of a hot half counts in its own; one
                # that shares the first half was found by the other search.
                on = hashes[v] % asked["parts"].to_numpy(np.int64)[block[q]] == asked["part"].to_numpy(np.int64)[block[q]]
                if kind == "second":
                    on &= np.fromiter((names[b][:half[a]] != words[a][:half[a]] for a, b in zip(q, v)), bool, len(q))
                q, v = q[on], v[on]
                order = np.lexsort((v, -n[v], q))
                q, v = q[order], v[order]
                best = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
                out["near"][block] += np.bincount(q, minlength=len(block))
                out["best_n"][block[q[best]]] = n[v[best]]
                out["best"][block[q[best]]] = names[v[best]]
    return pa.Table.from_arrays(
        [pa.array(out["word"], pa.string()), pa.array(out["n"]), pa.array(out["near"]), pa.array(out["best_n"]),
         pa.array(out["best"], pa.string())], names=["word", "n", "near", "best_n", "best"])


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n, n_near, best, best_n): near words of each word of a (word, n) table."""
    size = F.length("word")
    # Halves that words of one code point less, as many or one more look up.
    lengths = F.array_distinct(F.transform(F.array(size - 1, size, size + 1), lambda m: F.greatest(m, F.lit(2))))
    first = F.array_distinct(F.transform(lengths, lambda m: F.floor(m / 2).cast("int")))
    second = F.array_distinct(F.transform(lengths, lambda m: (m - F.floor(m / 2)).cast("int")))

    def key(side: str, h) -> F.Column:
        cut = F.substring("word", F.lit(1), h) if side == "first" else F.substring("word", F.greatest(size - h + 1, F.lit(1)), h)
        return F.xxhash64(F.lit(side), h, cut)

    base = vocabulary.select("word", "n", F.xxhash64("word").alias("hash"))
    index = None
    asked = None
    for side, halves, own in (("first", first, F.floor(size / 2).cast("int")), ("second", second, (size - F.floor(size / 2)).cast("int"))):
        one = base.select("*", F.explode(halves).alias("h")).select("word", "n", "hash", key(side, F.col("h")).alias("key"))
        ask = base.select("word", "n", F.lit(side).alias("kind"), key(side, own).alias("key"))
        index = one if index is None else index.unionByName(one)
        asked = ask if asked is None else asked.unionByName(ask)
    total = index.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD_CHARS))
    # Halves that fill a quarter of a shard or more: at most 4 for each shard.
    hot = (index.groupBy("key").agg(F.sum(F.length("word") + 1).alias("chars")).where(F.col("chars") > SHARD_CHARS // 4)
           .select("key", F.ceil(F.col("chars") / (SHARD_CHARS // 4)).cast("long").alias("parts")))
    hot = maybe_broadcast(stored(hot, "hot-halves"))
    parts = F.coalesce("parts", F.lit(1).cast("long")).alias("parts")
    index = (index.join(hot, "key", "left").select("key", "word", "n", "hash", parts)
             .select("key", "word", "n", "hash", F.lit("index").alias("kind"), F.pmod("hash", "parts").alias("part"), "parts"))
    asked = (asked.join(hot, "key", "left").select("key", "word", "n", "kind", parts)
             .select("key", "word", "n", F.lit(0).cast("long").alias("hash"), "kind",
                     F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "parts"))
    rows = index.unionByName(asked).withColumn("shard", F.pmod(F.xxhash64("key", "part"), F.lit(shards)))
    found = (rows.select("shard", "kind", "word", "n", "hash", "part", "parts").groupBy("shard")
             .applyInArrow(_search, "word string, n long, near long, best_n long, best string"))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))))
    return (found.groupBy("word", "n").agg(F.sum("near").alias("n_near"), best.alias("b"))
            .select("word", "n", "n_near", F.col("b.word").alias("best"), (-F.col("b.n")).alias("best_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each word with a form in a (word, form) table.

    Counts grow at least ``TIMES``-fold from a word to its form, so chains are
    short; each round doubles the steps that a row has made.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        nxt = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = now.join(nxt, "root", "left")
        ahead = stored(joined.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = ahead.select("word", "root")
        if ahead.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents."""
    vocabulary = stored(word_counts(docs), "words")
    near = near_words(vocabulary)
    is_form = F.col("best_n") >= TIMES * F.col("n")
    found = stored(near.select("word", F.when(is_form, F.col("best")).alias("form"), "n", "n_near",
                               F.when(is_form, F.col("best_n")).alias("form_n")), "near-words")
    root = roots(found.where(F.col("form").isNotNull()))
    return (found.join(root, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
