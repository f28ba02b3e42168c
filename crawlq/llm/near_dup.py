"""MinHash near-duplicates with fast similarity sketching (operator 3).

Sketch: ``BANDS * ROWS`` bins.  In round i < t every element of the set is
thrown into one hashed bin with a hashed value; in rounds t..2t-1 all elements
go to bin i - t.  A bin keeps the least value of the first round that reached
it, so every bin fills after 2t rounds at the latest, and the number of equal
bins of two sets concentrates around t times their Jaccard similarity as if
the bins were independent.  Expected work is O(n + t log t) per set, not n * t.

Banding: two sets of similarity 0.75 agree in at least one of 72 bands of 7
bins with probability 1 - (1 - 0.75^7)^72 > 0.99996 (0.8: > 0.9999999).  Long
bands keep documents apart that only share a common passage: at similarity
0.2 a band of 7 collides 25 times less often than one of 5.

Candidates are confirmed on the full sets.  Equal sets are one class from the
start.  Within a band's bucket each member is first compared with the bucket's
least member; then, only where a bucket still holds several components, its
pairs across components are compared.  Pairs within a component add nothing,
so a group of thousands of near copies costs about one comparison a member.

Pairs across components are found by a common shingle, not by the bucket alone
(``_across``), as a passage in thousands of unlike documents would fill its
buckets with pairs.  With the shingles of each set in one common order, rarest
first, two sets of similarity 0.75 share one among the first
n - ceil(0.75 n) + 1 of each, whatever the order.  Bitmaps then rule out pairs
whose sets differ in too many shingles: both tests are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlq.llm.common import drop_worker_caches, maybe_broadcast, stored
from crawlq.llm.components import components
from crawlq.llm.shingles import mix64, shingle_set

BANDS, ROWS = 72, 7
PERCENT = 75
WORDS = 16                  # 64-bit words of a set's bitmap
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0xD1342543DE82EF95)
_LOW = np.uint64(0xFFFFFFFF)
_S32 = np.uint64(32)


def sketch(items: np.ndarray, bins: int) -> np.ndarray:
    """Fast similarity sketch of a non-empty set of 64-bit hashes: one value per bin."""
    best = np.full(bins, _FULL)
    n, done = len(items), 0
    while done < bins:
        rounds = min(bins - done, max(1, -(-2 * bins // n)))
        i = np.arange(done, done + rounds, dtype=np.uint64)[:, None]
        x = mix64(items[None, :] + (i + np.uint64(1)) * _STEP)
        where = ((x >> _S32) * np.uint64(bins)) >> _S32
        np.minimum.at(best, where.ravel(), ((i << _S32) | (x & _LOW)).ravel())
        done += rounds
        if best.max() != _FULL:
            return best
    empty = np.flatnonzero(best == _FULL).astype(np.uint64)
    i = empty + np.uint64(bins)
    x = mix64(items[:, None] + (i + np.uint64(1)) * _STEP)
    best[empty] = (i << _S32) | (x & _LOW).min(axis=0)
    return best


def band_hashes(values: np.ndarray, bands: int = BANDS) -> np.ndarray:
    v = values.reshape(bands, -1)
    h = mix64(np.arange(bands, dtype=np.uint64) * _STEP)
    for k in range(v.shape[1]):
        h = mix64(h ^ v[:, k])
    return h


def bitmap(items: np.ndarray) -> np.ndarray:
    """A bit for each hash value class: whether an odd number of items falls into it.

    Bitmaps of two sets differ in at most as many bits as the sets in items.
    """
    out = np.zeros(WORDS, np.uint64)
    np.bitwise_xor.at(out, ((items >> _S32) * np.uint64(WORDS)) >> _S32, np.uint64(1) << (items & np.uint64(63)))
    return out


def _base(docs: DataFrame) -> DataFrame:
    """doc_id, h (text hash), n_shingles, sig (128-bit digest of the set, null if empty), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_caches()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                b = batch.slice(k, 512)
                n, sig, bands = [], [], []
                for text in b.column("text"):
                    s = shingle_set(text.as_py())
                    n.append(len(s))
                    sig.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    bands.append(band_hashes(sketch(s, BANDS * ROWS)).view(np.int64) if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("h"), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "h", "n_shingles", "sig", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").alias("text")).mapInArrow(
        run, "doc_id long, h long, n_shingles long, sig binary, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sig, items, bits) of the classes in ``wanted`` (sig, first): their sets, from whole texts again, and bitmaps.

    A class meets the rows of its first id and text only, not all rows of that id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_caches()
        for batch in batches:
            sig, items, bits = [], [], []
            for text, want in zip(batch.column("text"), batch.column("sig")):
                s = shingle_set(text.as_py())
                raw = s.tobytes()
                if xxhash.xxh3_128_digest(raw) == want.as_py():    # not another text of the same id and hash
                    sig.append(want.as_py())
                    items.append(raw)
                    bits.append(bitmap(s).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.binary()), pa.array(items, pa.binary()), pa.array(bits, pa.list_(pa.int64()))],
                                             names=["sig", "items", "bits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").alias("text"))
    wanted = wanted.select("sig", F.col("first.doc_id").alias("doc"), F.col("first.h").alias("doc_h"))
    found = rows.join(maybe_broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("h") == F.col("doc_h")))
    return (found.select("text", "sig").mapInArrow(run, "sig binary, items binary, bits array<long>")
            .groupBy("sig").agg(F.max("items").alias("items"), F.max("bits").alias("bits")))


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= 75 * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_caches()
        for batch in batches:
            a, b = [], []
            for p, q, x, y in zip(*(batch.column(c) for c in ("a", "b", "x", "y"))):
                s, t = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if 100 * min(len(s), len(t)) < PERCENT * max(len(s), len(t)):
                    continue
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= PERCENT * (len(s) + len(t) - both):
                    a.append(p.as_py())
                    b.append(q.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    with_x = pairs.join(sets.select(F.col("sig").alias("a_"), F.col("items").alias("x")), F.col("a") == F.col("a_")).select("a", "b", "x")
    with_y = with_x.join(sets.select(F.col("sig").alias("b_"), F.col("items").alias("y")), F.col("b") == F.col("b_"))
    return with_y.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def _fits(a: str, b: str):
    """Sizes alone can rule a pair out: intersection <= smaller, union >= larger."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("ta"), F.greatest("a", "b").alias("tb"))


def _untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    """The distinct pairs (a, b), a < b, that are not among ``tried`` in either order."""
    new = _ordered(pairs).select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct()
    return new.join(_ordered(tried), (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")), "left_anti")


def _split(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(band, sig, n, root) of the buckets that hold several components."""
    labelled = stored(rows.select("band", "sig", "n").join(nodes, F.col("sig") == F.col("node"), "left")
                      .select("band", "sig", "n", F.coalesce("root", "sig").alias("root")), "dup-labelled")
    split = stored(labelled.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
                   .select(F.col("band").alias("bucket")), "dup-split")
    return stored(labelled.join(split, F.col("band") == F.col("bucket")).select("band", "sig", "n", "root"), "dup-rest")


def _across(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components in one bucket that can be near duplicates.

    ``rest`` has the members (band, sig, n, root) of the buckets with several
    components.  Shingles found in one component only come first in the order,
    the others by how many sets have them.  Those of one component can't match
    another's, so only the others become rows: where a set has ``s`` of them,
    n - s places of its prefix are taken already.  As a pair has at most the
    lesser s in common, 175 * least(s) >= 75 * (n + n2) must hold, and as it
    differs in at most (n + n2) / 7 shingles, so do its bitmaps.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_caches()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                b = batch.slice(k, 256)
                items = [np.frombuffer(x.as_py(), np.int64) for x in b.column("items")]
                at = pa.array(np.repeat(np.arange(len(items)), [len(x) for x in items]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(items)), *(b.column(c).take(at) for c in ("sig", "n", "root"))],
                                                 names=["item", "sig", "n", "root"])

    bands = rest.groupBy(F.col("sig").alias("m"), "n", "root").agg(F.collect_list("band").alias("in_bands"))
    members = stored(bands.join(sets.select("sig", "bits"), F.col("m") == F.col("sig")).select("sig", "n", "root", "in_bands", "bits"), "dup-open")
    own = sets.select(F.col("sig").alias("s_"), "items")
    rows = members.join(own, F.col("sig") == F.col("s_")).select("sig", "n", "root", "items")
    rows = stored(rows.mapInArrow(run, "item long, sig binary, n long, root binary"), "dup-items")
    common = stored(rows.groupBy("item").agg(F.count("*").alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
                    .select(F.col("item").alias("i_"), "c"), "dup-common")
    of_set = Window.partitionBy("sig")
    ranked = (rows.join(common, F.col("item") == F.col("i_")).select("item", "c", "sig", "n", "root")
              .withColumn("s", F.count("*").over(of_set)).withColumn("at", F.row_number().over(of_set.orderBy("c", "item"))))
    prefix = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1 - (F.col("n") - F.col("s"))
    heads = stored(ranked.where((100 * F.col("s") >= PERCENT * F.col("n")) & (F.col("at") <= prefix))
                   .join(members.select(F.col("sig").alias("m_"), "in_bands", "bits"), F.col("sig") == F.col("m_"))
                   .select("item", "sig", "n", "root", "s", "in_bands", *(F.col("bits")[k].alias(f"w{k}") for k in range(WORDS))), "dup-heads")
    other = heads.select(F.col("item").alias("item2"), F.col("sig").alias("b"), F.col("n").alias("n2"), F.col("root").alias("root2"),
                         F.col("s").alias("s2"), F.col("in_bands").alias("in_bands2"), *(F.col(f"w{k}").alias(f"v{k}") for k in range(WORDS)))
    differ = sum((F.bit_count(F.col(f"w{k}").bitwiseXOR(F.col(f"v{k}"))) for k in range(WORDS)), F.lit(0))
    close = (100 + PERCENT) * differ <= (100 - PERCENT) * (F.col("n") + F.col("n2"))
    enough = (100 + PERCENT) * F.least("s", "s2") >= PERCENT * (F.col("n") + F.col("n2"))
    return (heads.join(other, (F.col("item") == F.col("item2")) & (F.col("root") < F.col("root2")) & _fits("n", "n2") & enough & close
                       & F.arrays_overlap("in_bands", "in_bands2"))
            .select(F.least("sig", "b").alias("a"), F.greatest("sig", "b").alias("b")).distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    ``component_id`` is the smallest doc_id of the component; ``kept`` says
    whether the row has it.  Null and empty texts have no shingles and link
    with nothing, not even each other.  A null id is larger than any other;
    rows that share an id are judged each by its own text.  Other columns are
    ignored, so their names cannot clash.
    """
    return _groups(docs).select("doc_id", "n_shingles", "component_id",
                                F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _groups(docs: DataFrame) -> DataFrame:
    """doc_id, h (text hash), n_shingles, component_id, group (digest naming the component; null without shingles)."""
    base = stored(_base(docs), "dup-base")
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("first")
    classes = stored(base.where("sig is not null").groupBy("sig", "n_shingles", "bands").agg(first_row)
                     .withColumn("doc", F.col("first.doc_id")), "dup-classes")
    rows = classes.select("sig", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    buckets = stored(rows.groupBy("band").agg(F.count("*").alias("c"), F.min(F.struct("sig", "n")).alias("lead")).where("c > 1")
                     .select(F.col("band").alias("bucket"), F.col("lead.sig").alias("lead"), F.col("lead.n").alias("lead_n")), "dup-buckets")
    members = stored(rows.join(buckets, F.col("band") == F.col("bucket")).select("band", "sig", "n", "lead", "lead_n"), "dup-members")
    first = stored(members.where(_fits("n", "lead_n") & (F.col("sig") != F.col("lead")))
                   .select(F.col("lead").alias("a"), F.col("sig").alias("b")).distinct(), "dup-pairs")
    # Every class of a bucket may take part in a comparison.
    used = members.select(F.col("sig").alias("s")).distinct()
    wanted = stored(classes.select("sig", "first").join(used, F.col("sig") == F.col("s")).select("sig", "first"), "dup-wanted")
    sets = stored(_sets(docs, wanted), "dup-sets")
    links = stored(_confirm(first, sets), "dup-links")
    nodes = stored(components(links), "dup-nodes")

    # Buckets that still hold several components: compare across them.
    across = _across(_split(members, nodes), sets)
    more = stored(_confirm(stored(_untried(across, first), "dup-across"), sets), "dup-links")
    if more.limit(1).count():
        nodes = stored(components(links.unionByName(more)), "dup-nodes")

    ids = nodes.join(classes.select("sig", "doc"), F.col("sig") == F.col("node"))
    roots = stored(ids.groupBy("root").agg(F.min("doc").alias("component")).select(F.col("root").alias("r"), "component"), "dup-roots")
    linked = stored(nodes.join(roots, F.col("root") == F.col("r")).select("node", "root", "component"), "dup-linked")
    owner = stored(classes.select("sig", "doc").join(linked, F.col("sig") == F.col("node"), "left")
                   .select(F.col("sig").alias("s"), F.when(F.col("node").isNotNull(), F.col("component")).otherwise(F.col("doc")).alias("component"),
                           F.coalesce("root", "sig").alias("group")), "dup-owner")
    out = base.select("doc_id", "h", "n_shingles", "sig").join(owner, F.col("sig") == F.col("s"), "left")
    component = F.when(F.col("s").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "h", "n_shingles", component.alias("component_id"), "group")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one row of each component, columns unchanged.

    The row with the component's smallest id stays; of rows that share it, the
    one with the least text hash; of rows equal in both, one.  Every row
    without shingles stays.  Decisions are made on ids and digests; the
    documents are then filtered against the keys to drop, the smaller side.
    """
    found = stored(_groups(docs).where("n_shingles > 0").select("doc_id", "h", "group"), "dup-found")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("w")
    winners = stored(found.groupBy("group").agg(first).select(F.col("group").alias("g"), "w"), "dup-winners")
    wins = F.col("doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("h") == F.col("w.h"))
    rows_of = found.join(winners, F.col("group") == F.col("g")).select("doc_id", "h", wins.alias("wins"))
    keys = stored(rows_of.groupBy("doc_id", "h", "wins").agg(F.count("*").alias("c")), "dup-keys")
    drop = keys.where("not wins").select(F.col("doc_id").alias("k_id"), F.col("h").alias("k_h"))
    twice = keys.where("wins and c > 1").select(F.col("doc_id").alias("k_id"), F.col("h").alias("k_h"))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"))
    same = F.col("id").eqNullSafe(F.col("k_id")) & (F.col("h") == F.col("k_h"))
    kept = rows.join(maybe_broadcast(drop), same, "left_anti")
    if twice.limit(1).count():
        repeated = kept.join(maybe_broadcast(twice), same, "left_semi").groupBy("id", "h").agg(F.first("doc").alias("doc"))
        kept = kept.join(maybe_broadcast(twice), same, "left_anti").select("doc").unionByName(repeated.select("doc"))
    return kept.select("doc.*")
