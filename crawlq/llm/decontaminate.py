"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks (operator 4).

All of it is DataFrame expressions: no Python runs on the executors.

* A benchmark item of w words is compared with document windows of w words
  (the whole document, if that is shorter).  Similarity is the weighted Jaccard
  of the five-word shingles, a shingle weighing as often as it occurs:
  sum(min) / sum(max) over both bags, at least 0.75.
* A window that shares no shingle with any item has similarity 0 with all of
  them.  So windows are formed where a document has a shingle of the benchmark:
  around each place where the item would lie if the shingle were in place,
  every item-sized window that overlaps it.  No window of positive similarity
  is left out.
* Each window and item gets a 64-bit SimHash of its shingle bag.  The
  fingerprint is cut into 8 blocks of 8 bits; two fingerprints within
  ``RADIUS`` = 23 bits differ by at most 2 bits in one block at least, so the
  items are indexed under every value within 2 bits of each of their blocks and
  windows look up their blocks as they are.  That finds all fingerprints within
  the radius.  At similarity 0.75 the expected distance is 11 bits, with a
  deviation of 3.
* Candidates within the radius are verified by their exact weighted similarity.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlq.llm.common import maybe_broadcast, stored

WIDTH = 5
PERCENT = 75
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
# All changes of at most two of a block's eight bits.
_FLIPS = [sum(1 << b for b in bits) for n in range(BLOCK_RADIUS + 1) for bits in combinations(range(BLOCK_BITS), n)]
_LANES = 0x0001000100010001
PACKED = 32_767                 # shingles that four 16-bit counters of a signed long can count
BROADCAST_SHINGLES = 4_000_000  # in all bags of a table that may be broadcast
MAX_SLOTS = 1 << 20             # longs of a broadcast bitmap of shingles


def _words(text: Column) -> Column:
    """Lower-cased words: what lies between runs of the six ASCII white-space characters."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _shingles(words: str) -> Column:
    """Hashes of the five-word shingles of an array column, in order; none with fewer words."""
    return F.expr(
        f"if(size({words}) < {WIDTH}, cast(array() as array<bigint>), transform(sequence(0, size({words}) - {WIDTH}), "
        f"i -> xxhash64({', '.join(f'{words}[i + {k}]' for k in range(WIDTH))})))")


def _simhash(shingles: str) -> Column:
    """SimHash of an array of shingle hashes: bit b is set where most occurrences set it.

    Sixteen longs of four 16-bit counters each: counter ``lane`` of long j
    counts bit j + 16 * lane.  They hold up to 32,767 shingles; a longer bag is
    counted in 64 longs.
    """
    names = [f"c{j}" for j in range(16)]
    zero = ", ".join(f"'{c}', 0L" for c in names)
    add = ", ".join(f"'{c}', a.{c} + (shiftrightunsigned(s, {j}) & {_LANES}L)" for j, c in enumerate(names))
    bits = " | ".join(
        f"if((shiftrightunsigned(a.c{j}, {16 * lane}) & 65535L) * 2 > size({shingles}), {_bit(j + 16 * lane)}, 0L)"
        for j in range(16) for lane in range(4))
    packed = f"aggregate({shingles}, named_struct({zero}), (a, s) -> named_struct({add}), a -> {bits})"
    zero = ", ".join(f"'c{b}', 0L" for b in range(64))
    add = ", ".join(f"'c{b}', a.c{b} + (shiftrightunsigned(s, {b}) & 1L)" for b in range(64))
    bits = " | ".join(f"if(a.c{b} * 2 > size({shingles}), {_bit(b)}, 0L)" for b in range(64))
    wide = f"aggregate({shingles}, named_struct({zero}), (a, s) -> named_struct({add}), a -> {bits})"
    return F.expr(f"if(size({shingles}) <= {PACKED}, {packed}, {wide})")


def _bit(b: int) -> str:
    return f"{1 << b}L" if b < 63 else "(-9223372036854775807L - 1L)"


def _block(fp: str, k: int) -> Column:
    return F.expr(f"shiftrightunsigned({fp}, {BLOCK_BITS * k}) & {2 ** BLOCK_BITS - 1}L")


def _overlap(a: str, b: str) -> Column:
    """Sum of the smaller counts over the shingles of two bags given as arrays."""
    plain = f"size(array_distinct({a})) = size({a}) or size(array_distinct({b})) = size({b})"
    # If one bag has no repeats, the smaller count is 1 for each shared shingle.
    counted = (f"aggregate(array_intersect({a}, {b}), 0, (n, s) -> n + "
               f"least(size(filter({a}, x -> x = s)), size(filter({b}, x -> x = s))))")
    return F.expr(f"if({plain}, size(array_intersect({a}, {b})), {counted})")


def benchmark_index(items: DataFrame) -> DataFrame:
    """item_id, w (words), bag (shingle hashes in order) of the items of five words or more.

    Null texts, and items without a five-word shingle, match nothing.
    """
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), _words(F.col("text")).alias("words"))
    return (rows.select("item_id", F.size("words").alias("w"), _shingles("words").alias("bag"))
            .where(F.size("bag") > 0).distinct())


def _maybe_among(rows: DataFrame, keys: DataFrame, col: str) -> DataFrame:
    """The rows whose hash ``col`` may be among the same column of ``keys``: all that
    are, and few others.

    A bitmap of at least 16 bits a key, up to 2^20 longs (64 million bits), is
    broadcast as (slot, long) rows, so its size is bounded whatever the number
    of keys; beyond four million keys more of the others stay.
    """
    n = keys.select(col).distinct().count()
    slots = min(MAX_SLOTS, max(1024, 1 << (n // 4).bit_length()))
    bit = f"shiftleft(1L, cast(shiftrightunsigned({col}, 56) & 63 as int))"
    slot = F.col(col).bitwiseAND(F.lit(slots - 1))
    bitmap = (keys.select(slot.alias("_slot"), F.expr(bit).alias("_bit")).groupBy("_slot").agg(F.bit_or("_bit").alias("_bits")))
    met = rows.withColumn("_at", slot).join(F.broadcast(bitmap), F.col("_at") == F.col("_slot"))
    return met.where(F.expr(f"(_bits & {bit}) <> 0")).drop("_at", "_slot", "_bits")


def _close(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, row (text hash), item_id, similarity, start, words of the windows of similarity 0.75 or more."""
    index = benchmark_index(items).withColumn("fp", _simhash("bag")).withColumn("ih", F.xxhash64("bag"))
    index = stored(index, "bench-items")
    places = index.select("item_id", "w", F.posexplode("bag").alias("o", "h"))
    places = stored(places.select("h", "w", "o").distinct(), "bench-places")

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("row"), "text")
    bags = rows.select("doc_id", "row", _words(F.col("text")).alias("words"))
    bags = bags.select("doc_id", "row", F.size("words").alias("n"), _shingles("words").alias("bag"))
    # Numbers alone go through the joins on shingles and windows; texts are met again by id and hash.
    # The outer form keeps Spark from computing the array a second time for a filter on its size.
    each = bags.select("doc_id", "row", "n", F.posexplode_outer("bag").alias("p", "h"))
    each = _maybe_among(each, places, "h")
    hits = each.join(maybe_broadcast(places.withColumnRenamed("h", "k")), F.col("h") == F.col("k"))
    # Every window of w words that overlaps the place where the item would start; a shorter document is one window.
    hits = hits.select("doc_id", "row", "n", "w", (F.col("p") - F.col("o")).alias("s")).distinct()
    starts = F.expr(f"if(n <= w, array(0), sequence(least(greatest(0, s - w + {WIDTH}), n - w), "
                    f"greatest(least(greatest(0, s - w + {WIDTH}), n - w), least(s + w - {WIDTH}, n - w))))")
    places_of = hits.select("doc_id", "row", "n", "w", F.explode(starts).alias("start")).distinct()
    places_of = stored(places_of, "bench-places-of")
    # The shingles of the documents that have windows, each document once.
    ids = stored(places_of.select(F.col("doc_id").alias("i"), F.col("row").alias("r")).distinct(), "bench-ids")
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("row") == F.col("r"))
    texts = rows.join(maybe_broadcast(ids), same, "left_semi").dropDuplicates(["doc_id", "row"])
    texts = stored(texts.select(F.col("doc_id").alias("i"), F.col("row").alias("r"), _words(F.col("text")).alias("words"))
                   .select("i", "r", _shingles("words").alias("all")), "bench-texts")
    windows = places_of.join(texts, same)
    windows = windows.select("doc_id", "row", "start", "w", F.expr(f"slice(all, start + 1, least(n, w) - {WIDTH - 1})").alias("bag"))
    windows = stored(windows.withColumn("fp", _simhash("bag")), "bench-windows")

    # Multi-index lookup among the items of the window's size.
    keys = F.array(*[F.struct(F.lit(k).alias("k"), _block("fp", k).alias("v")) for k in range(BLOCKS)])
    # An item is looked up by numbers alone; its bag is joined back for candidates only.
    table = index.select("item_id", F.col("w").alias("iw"), "ih", F.col("fp").alias("ifp"), F.explode(keys).alias("e"))
    flips = F.explode(F.array(*[F.lit(x).cast("long") for x in _FLIPS]))
    table = table.withColumn("flip", flips).select("item_id", "iw", "ih", "ifp", F.col("e.k").alias("ik"),
                                                   F.expr("e.v ^ flip").alias("iv"))
    table = stored(table, "bench-blocks")
    probe = windows.select("doc_id", "row", "start", "w", "fp", F.explode(keys).alias("e")).select("doc_id", "row", "start", "w", "fp", "e.k", "e.v")
    near = (probe.join(maybe_broadcast(table), (F.col("w") == F.col("iw")) & (F.col("k") == F.col("ik")) & (F.col("v") == F.col("iv")))
            .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= RADIUS))
    # A pair found by several blocks counts once: by its first block within two bits.
    earlier = " or ".join(f"(k > {j} and bit_count((shiftrightunsigned(fp, {BLOCK_BITS * j}) ^ shiftrightunsigned(ifp, {BLOCK_BITS * j})) & 255L) <= {BLOCK_RADIUS})"
                          for j in range(BLOCKS - 1))
    near = near.where(~F.expr(earlier)).select("doc_id", "row", "start", "w", "item_id", "ih")
    near = stored(near, "bench-near")
    of = windows.select(F.col("doc_id").alias("i"), F.col("row").alias("r"), F.col("start").alias("at"), F.col("w").alias("v"), "bag")
    near = near.join(of, same & (F.col("start") == F.col("at")) & (F.col("w") == F.col("v")))
    bags = index.select(F.col("item_id").alias("b_id"), F.col("ih").alias("b_h"), F.col("bag").alias("ibag"))
    small = (bags.agg(F.sum(F.size("ibag").cast("long")).alias("n")).first()["n"] or 0) <= BROADCAST_SHINGLES
    near = near.join(maybe_broadcast(bags) if small else bags, F.col("item_id").eqNullSafe(F.col("b_id")) & (F.col("ih") == F.col("b_h")))
    near = near.withColumn("both", _overlap("bag", "ibag"))
    union = F.size("bag") + F.size("ibag") - F.col("both")
    return near.where(100 * F.col("both") >= PERCENT * union).select(
        "doc_id", "row", "item_id", (F.col("both") / union).alias("similarity"), F.col("start").cast("long").alias("start"), F.col("w").cast("long").alias("words"))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start, words: the best window of each document and item.

    One row for each pair with a window of similarity 0.75 or more; ``start``
    is the window's first word (from 0), the earliest among equals.  Null ids
    come back as null; rows that share an id are searched each by its own text
    and reported together.  Null and empty texts, and texts or items under
    five words, match nothing.  Other columns are ignored.
    """
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "words"))
    return (_close(docs, items).groupBy("doc_id", "item_id").agg(best.alias("b"))
            .select("doc_id", "item_id", "b.similarity", (-F.col("b.back")).alias("start"), "b.words"))


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that have no window near a benchmark item, columns unchanged.

    Each row is judged by its own text: a clean row stays where another row of
    its id (a null id is an id like others) goes.
    """
    dirty = stored(_close(docs, items).select(F.col("doc_id").alias("dirty"), F.col("row").alias("dirty_row")).distinct(), "bench-dirty")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("row"))
    same = F.col("id").eqNullSafe(F.col("dirty")) & (F.col("row") == F.col("dirty_row"))
    return rows.join(maybe_broadcast(dirty), same, "left_anti").select("doc.*")
