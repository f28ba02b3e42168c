"""Phrase collocations from merged stripes (operator 13).

A stripe is the counter of the words that follow one prefix.  Four levels of
stripes, for prefixes of 0 to 3 words, are built in the tasks, merged
elementwise by Spark, and give everything that follows: the entries are the
counts of the extensions, their sum is the count of the prefix itself (the
entry ``""`` holds what is cut off: ends of pieces and extensions that cannot
reach the threshold), and the largest entry is what a longer phrase subsumes.

A phrase that occurs ``MIN_COUNT`` times has parts that do so too.  So level k
counts only positions whose two k-word parts are frequent, which a Bloom
filter of their hashes tells.  The filter has a fixed largest size; beyond what it can
tell apart it lets more through and changes no result, as every count is of
the words themselves.

Input rows: null ids are never read; a null text is empty; a null language is
``und``.  Repeated rows count as often as they stand there.  Empty tables give
an empty result, ties go by rank order (score, a, phrase), extra columns are
not read.  Texts of any length are handled in chunks of whole documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlq.llm.common import stored
from crawlq.llm.words import Words, mix

MIN_COUNT = 30
MAX_WORDS = 4
TOP = 2000
SCALE = 2_000_000
COVERED = (80, 100)             # a candidate goes if a longer one has 80 of 100 of its occurrences
NO_LANG = "und"

SEPARATORS = b".,;:!?\n\x0b\x0c\r"
CHUNK = 4 << 20                 # bytes of text numbered together
MOST_BITS = 1 << 28             # the frequency bitmap has at most this many bits (32 MB)
BITS_PER_PHRASE = 32
PROBES = 3                      # bits set for a phrase
SALTS = 64                      # parts of the stripe of a hot prefix
HOT_SHARE = 2000                # hot: at least 1 in 2,000 of all words, so at most 2,000 prefixes a level
RANK_PARTS = 64

_FOLD = bytes.maketrans(SEPARATORS + b"\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"." * len(SEPARATORS) + b" abcdefghijklmnopqrstuvwxyz")
# The entries of a stripe are one text, as words hold no space and no tab:
# "word word<tab>count word"; a word without a count occurred once.
_STRIPE = "lang string, prefix string, salt int, entries string"


def fold(text: bytes) -> bytes:
    """A-Z lower-cased, separators as ``.``, tabs as spaces."""
    return text.translate(_FOLD)


def _words(buf: bytes) -> Words:
    text = np.frombuffer(buf, np.uint8)
    return Words(buf, (text != ord(".")) & (text != ord(" ")))


def hash_words(words: list[bytes]) -> np.ndarray:
    """The hashes that :class:`Words` gives folded words, none of them empty."""
    return _words(b" ".join(words)).hashes()[0]


def hash_names(names: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x) for x in names), np.uint64, len(names))


def hash_phrases(langs: list[str], phrases: list[str]) -> np.ndarray:
    """The same hashes as :func:`mix` gives word by word, for whole phrases."""
    split = [p.encode().split(b" ") for p in phrases]
    out = hash_names(langs)
    for k in range(max(map(len, split), default=0)):
        at = np.array([i for i, s in enumerate(split) if len(s) > k])
        out[at] = mix(out[at], hash_words([split[i][k] for i in at]))
    return out


def place(hashes: np.ndarray, probe: int, size: int) -> np.ndarray:
    """The bit of each hash in a bitmap of ``size`` bits (a power of two)."""
    return ((hashes * np.uint64(2 * probe + 1) >> np.uint64(17 * probe)) & np.uint64(size - 1)).astype(np.int64)


@dataclass
class Frequent:
    """Bloom filter of the hashes of frequent phrases, and the hashes of hot ones."""

    bits: np.ndarray
    hot: np.ndarray

    def has(self, hashes: np.ndarray) -> np.ndarray:
        on = np.arange(len(hashes))
        for probe in range(PROBES):
            at = place(hashes[on], probe, len(self.bits) * 8)
            on = on[(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
        return on


def _stripes_of(docs: list[tuple[str, bytes]], k: int, frequent: Frequent | None) -> pa.RecordBatch | None:
    """Stripes of the k-word prefixes of some documents."""
    buf = fold(b".".join(text for _, text in docs))
    words = _words(buf)
    if not len(words):
        return None
    cuts = np.flatnonzero(np.frombuffer(buf, np.uint8) == ord("."))
    pieces = np.searchsorted(cuts, words.starts).astype(np.int32)
    names = sorted({lang for lang, _ in docs})
    of = {lang: i for i, lang in enumerate(names)}
    ends = np.cumsum([len(text) + 1 for _, text in docs])
    lang = np.array([of[x] for x, _ in docs], np.int64)[np.searchsorted(ends, words.starts, side="right")]
    hashes, second = words.hashes()
    # Runs of k words of one piece that are frequent, and the word after each if it makes another such run.
    run = np.arange(len(words))
    h = hash_names(names)[lang]
    for j in range(k):
        if j:
            on = run + j < len(words)
            run, h = run[on], h[on]
            on = pieces[run + j] == pieces[run]
            run, h = run[on], h[on]
        h = mix(h, hashes[run + j])
    if k:
        on = frequent.has(h)
        run, h = run[on], h[on]
        if not len(run):
            return None
        hot = np.isin(h, frequent.hot)
        ok = np.zeros(len(words) + 1, bool)
        ok[run] = True
        after = np.minimum(run + k, len(words) - 1)
        more = ok[run + 1] & (run + k < len(words)) & (pieces[after] == pieces[run])
    else:
        hot, after, more = np.ones(len(run), bool), run, np.ones(len(run), bool)
    used = np.zeros(len(words), bool)
    for j in range(k):
        used[run + j] = True
    used[after[more]] = True
    used = np.flatnonzero(used)
    number = np.zeros(len(words), np.int64)
    number[used], texts = words.numbered(used, hashes, second)
    number[used] += 1                               # 0: none
    v = len(texts) + 1
    nxt = np.where(more, number[after], 0)
    prefix, kinds = lang[run], lang[run]
    for j in range(k):                              # distinct prefixes, one word more at a time
        prefix, kinds = pd.factorize(prefix * v + number[run + j])
    first = np.empty(len(kinds) if k else len(names), np.int64)
    first[prefix[::-1]] = run[::-1]
    # One entry per (prefix, next word); the salt is a function of both.
    entry, _ = pd.factorize(prefix * v + nxt)
    counts = np.bincount(entry)
    at = np.empty(len(counts), np.int64)
    at[entry[::-1]] = np.arange(len(entry))[::-1]
    salt = np.where(hot[at], (hashes[after[at]] >> np.uint64(40)).astype(np.int64) % SALTS, 0)
    salt[nxt[at] == 0] = 0
    group = prefix[at] * SALTS + salt
    order = np.argsort(group, kind="stable")
    group, nxt, counts = group[order], nxt[at][order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    offsets = pa.array(np.concatenate([at, [len(group)]]).astype(np.int32))
    first = first[group[at] // SALTS]
    prefixes = [b" ".join([texts[number[i + j] - 1] for j in range(k)]) for i in first]
    nexts = pa.array([b"", *texts], pa.binary()).cast(pa.string()).take(pa.array(nxt))
    counted = pc.binary_join_element_wise(nexts, pa.array(counts).cast(pa.string()), "\t")
    entries = pc.if_else(pa.array((counts == 1) & (nxt > 0)), nexts, counted)
    return pa.RecordBatch.from_arrays([
        pa.array([names[i] for i in lang[first]], pa.string()), pa.array(prefixes, pa.binary()).cast(pa.string()),
        pa.array((group[at] % SALTS).astype(np.int32)),
        pc.binary_join(pa.ListArray.from_arrays(offsets, entries), " "),
    ], names=["lang", "prefix", "salt", "entries"])


def merged_stripes(docs: DataFrame, k: int, frequent=None) -> DataFrame:
    """Stripes of the k-word prefixes over all documents, parted by ``salt``.

    ``docs`` has lang and text (binary).  A row is one entry: (lang, prefix,
    salt, next, n); extensions below ``MIN_COUNT`` are summed in the entry ``""``.
    The parts of a hot prefix are dealt to different tasks.
    """
    def stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value if frequent is not None else None
        docs, size = [], 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs.append((lang, text.as_py()))
                size += len(docs[-1][1])
                if size >= CHUNK:
                    if (out := _stripes_of(docs, k, known)) is not None:
                        yield out
                    docs, size = [], 0
        if docs and (out := _stripes_of(docs, k, known)) is not None:
            yield out

    one = (docs.mapInArrow(stripes, _STRIPE).repartition("lang", "prefix", "salt")
           .select("lang", "prefix", "salt", F.explode(F.split("entries", " ")).alias("e"))
           .select("lang", "prefix", "salt", F.substring_index("e", "\t", 1).alias("next"),
                   F.when(F.instr("e", "\t") > 0, F.substring_index("e", "\t", -1).cast("long")).otherwise(1).alias("n"))
           .groupBy("lang", "prefix", "salt", "next").agg(F.sum("n").alias("n")))
    often = (F.col("n") >= MIN_COUNT) & (F.col("next") != "")
    return one.groupBy("lang", "prefix", "salt", F.when(often, F.col("next")).otherwise("").alias("next")).agg(F.sum("n").alias("n"))


def extensions(stripes: DataFrame) -> DataFrame:
    """(lang, next, phrase, n) of the frequent entries of merged stripes."""
    return (stripes.where(F.col("next") != "")
            .withColumn("phrase", F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next")))
            .select("lang", "next", "phrase", "n"))


def prefixes(stripes: DataFrame) -> DataFrame:
    """(lang, phrase, n, most): count and largest right extension of each frequent prefix."""
    return (stripes.groupBy("lang", F.col("prefix").alias("phrase"))
            .agg(F.sum("n").alias("n"), F.max(F.when(F.col("next") != "", F.col("n"))).alias("most")).where(F.col("n") >= MIN_COUNT))


def frequent_of(phrases: DataFrame, words: int) -> Frequent:
    """Bloom filter of the hashes of ``phrases`` (lang, phrase, n); hot are those with 1 in ``HOT_SHARE`` of ``words``."""
    count = phrases.count()
    size = 1 << 15
    while size < min(MOST_BITS, BITS_PER_PHRASE * count):
        size *= 2

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = hash_phrases(b.column(0).to_pylist(), b.column(1).to_pylist())
            at = np.concatenate([place(h, probe, size) for probe in range(PROBES)])
            yield pa.RecordBatch.from_arrays([pa.array(at + 1)], names=["at"])

    rows = (phrases.select("lang", "phrase").mapInArrow(places, "at long")
            .groupBy(F.bitmap_bucket_number("at").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect())
    bits = np.zeros(size // 8, np.uint8)
    for r in rows:          # at most MOST_BITS / 32,768 rows of 4 KB
        part = np.frombuffer(r["bits"], np.uint8)
        bits[(r["bucket"] - 1) * 4096:][:4096] = part[:4096]
    # At most HOT_SHARE rows: each has that share of all words.
    hot = phrases.where(F.col("n").cast("decimal(20,0)") * HOT_SHARE >= F.lit(words)).select("lang", "phrase").collect()
    return Frequent(bits, hash_phrases([r["lang"] for r in hot], [r["phrase"] for r in hot]))


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """The best ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``docs`` has text and lang.  The counts are over all documents; see the
    module's text for odd rows.
    """
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"),
                        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    known, frequent, counted, longer = None, None, [], []
    for k in range(MAX_WORDS):
        level = stored(merged_stripes(texts, k, frequent), f"stripes-{k}")
        longer.append(extensions(level))
        if k == 0:
            totals = level.groupBy("lang").agg(F.sum("n").alias("words"))
            known = level.agg(F.sum("n")).first()[0] or 0
        else:
            counted.append(prefixes(level))
        if k < MAX_WORDS - 1:
            if frequent is not None:
                frequent.unpersist()
            frequent = spark.sparkContext.broadcast(frequent_of(longer[k], known))

    counts = counted[0]
    for part in counted[1:]:
        counts = counts.unionByName(part)
    counts = counts.unionByName(longer[-1].select("lang", "phrase", "n", F.lit(None).cast("long").alias("most")))
    counts = stored(counts, "phrases")

    words = F.split("phrase", " ")
    cuts = (counts.where(F.instr("phrase", " ") > 0)
            .select("lang", "phrase", F.col("n").alias("a"), "most", words.alias("w"))
            .select("lang", "phrase", "a", "most", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
            .select("lang", "phrase", "a", "most", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
                    F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest")))
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    big = "cast({} as decimal(20,0))".format
    scored = (cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
              .withColumn("score", F.expr(f"cast(({big('a')} * {SCALE}) div ({big('l')} + {big('r')}) as bigint)"))
              .groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("most").alias("most"),
                                             F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    # A phrase inside a longer one lies inside one that is a word longer, at its
    # start (the largest entry of its stripe) or at its end.
    ends = None
    for part in longer[2:]:
        one = part.select("lang", F.substring_index("phrase", " ", -1).alias("last"), "phrase", "n")
        one = one.select("lang", F.expr("substring(phrase, instr(phrase, ' ') + 1)").alias("phrase"), "n")
        ends = one if ends is None else ends.unionByName(one)
    ends = ends.groupBy("lang", "phrase").agg(F.max("n").alias("before"))
    part, whole = COVERED
    covered = F.expr(f"{whole} * {big('greatest(coalesce(most, 0), coalesce(before, 0))')} >= {part} * {big('a')}")
    left_over = (scored.join(ends, ["lang", "phrase"], "left").where(~covered)
                 .select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r"))
    # The best of each part of a language first, so that no task sorts a whole language.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).orderBy(*order)
    best = left_over.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return (best.join(totals, "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score"))


def _parts_sql() -> str:
    rows = []
    for size in range(2, MAX_WORDS + 1):
        for k in range(1, size):
            rows.append(f"select lang, phrase, a, {k} as k, array_to_string(w[1:{k}], ' ') as first, "
                        f"array_to_string(w[{k + 1}:{size}], ' ') as rest from cands where len(w) = {size}")
    return " union all ".join(rows)


_GRAMS = " union all ".join(
    f"select lang, w[i:i + {k - 1}] as w from pieces, unnest(generate_series(1, len(w) - {k - 1})) t(i)" for k in range(1, MAX_WORDS + 1))

ORACLE = f"""
with texts as (
  select coalesce(lang, '{NO_LANG}') as lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\\x0A-\\x0D]')) as piece
  from documents),
pieces as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from texts),
totals as (select lang, sum(len(w)) as n from pieces group by lang),
counts as (select lang, w, array_to_string(w, ' ') as phrase, count(*) as a from ({_GRAMS}) group by all having count(*) >= {MIN_COUNT}),
cands as (select * from counts where len(w) >= 2),
cut as ({_parts_sql()}),
scored as (
  select c.lang, c.phrase, c.a, c.k, f.a as l, r.a as r, ({SCALE}::hugeint * c.a) // (f.a::hugeint + r.a) as score
  from cut c join counts f on f.lang = c.lang and f.phrase = c.first join counts r on r.lang = c.lang and r.phrase = c.rest),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
longer as (select lang, array_to_string(w[1:len(w) - 1], ' ') as part, a from cands where len(w) > 2
           union all select lang, array_to_string(w[2:len(w)], ' '), a from cands where len(w) > 2),
most as (select lang, part, max(a) as a from longer group by all),
kept as (select b.* from best b left join most m on m.lang = b.lang and m.part = b.phrase
         where not coalesce({COVERED[1]}::hugeint * m.a >= {COVERED[0]}::hugeint * b.a, false)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n::bigint as n, r.score::bigint as score
from ranked r join totals t on t.lang = r.lang where r.rank <= {TOP}
"""
