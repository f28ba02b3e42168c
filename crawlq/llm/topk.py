"""Exact top-k inner products with ball trees per shard (operator 2).

Vectors are sorted by the sides of random planes they lie on, so that like
vectors come together, and packed into shards of bounded size; each shard
holds a ball tree: its rows in leaf order, and for every node its centre,
radius and range of rows.  A query q scores at most <q, c> + |q| r in a ball
of centre c and radius r.  Queries are packed into blocks the same way.

Before any shard moves, each query is tested against the topmost balls of
every shard (a few kilobytes a shard); only the pairs of a block and a shard
in which a query's bound reaches its current kth score are searched.  They are
searched in rounds, best bound first: one shard for each block, then eight,
then the rest, and after each round the kth scores that all shards share are
raised and the pairs left are tested again.  A search goes through the tree
from the root, nodes with the highest bound first, and leaves out the nodes
that no query of the block can still use.

Scores are whole numbers; all of it is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlq.llm.common import maybe_broadcast, stored

SCALE = 256
SHARD_ROWS = 16_384
BLOCK_ROWS = 512
LEAF_ROWS = 512
# Planes that order the vectors.
PLANES = 16
# A shard is tested by its balls this many levels below the root.
TOP_LEVELS = 3
# Blocks and shards are tested against each other in groups of about these sizes.
SLICE_BLOCKS = 32
CHUNK_SHARDS = 1_024
# Shards that a block searches in the first rounds; a last round takes the rest.
ROUNDS = (1, 8)
_FLOAT_EXACT = 2 ** 53
_NONE = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max


def _scaled(values: np.ndarray) -> np.ndarray:
    """floor(256 * x) of doubles, as whole-numbered doubles."""
    return np.floor(SCALE * values.astype(np.float64))


def _usable(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) for each length among the usable vectors of the batch.

    Null vectors and vectors with null or non-finite components are left out,
    as are rows without an id.
    """
    held: dict[int, tuple[list, list]] = {}
    for i, v in zip(batch.column("id").to_pylist(), batch.column("v")):
        if i is None or not v.is_valid or v.values.null_count:
            continue
        x = _scaled(v.values.to_numpy(zero_copy_only=False))
        if np.isfinite(x).all():
            ids, rows = held.setdefault(len(x), ([], []))
            ids.append(i)
            rows.append(x)
    for ids, rows in held.values():
        yield np.array(ids, np.int64), np.stack(rows)


def _cells(m: np.ndarray) -> np.ndarray:
    """For each row, the sides of ``PLANES`` fixed planes through the origin, as bits of one number."""
    planes = np.random.default_rng(m.shape[1]).standard_normal((m.shape[1], PLANES))
    size = np.abs(m).max(axis=1, initial=1.0)[:, None]
    return ((m / size) @ planes > 0) @ (1 << np.arange(PLANES))


def _placed(df: DataFrame) -> DataFrame:
    """dim, cell, id, x: usable vectors, in ranges of (dim, cell, id); a cell of any size is split by its ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, m in _usable(batch):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), m.shape[1], np.int32)), pa.array(_cells(m).astype(np.int32)), pa.array(ids),
                     pa.array([x.tobytes() for x in m], pa.binary())], names=["dim", "cell", "id", "x"])

    order = ["dim", "cell", "id"]
    return df.mapInArrow(run, "dim int, cell int, id long, x binary").repartitionByRange(*order).sortWithinPartitions(*order)


def _packed(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of at most ``rows`` vectors of one length each, from placed rows."""
    dim, ids, xs = -1, [], []
    for batch in batches:
        for d, i, x in zip(*(batch.column(c).to_pylist() for c in ("dim", "id", "x"))):
            if ids and (d != dim or len(ids) == rows):
                yield np.array(ids, np.int64), np.frombuffer(b"".join(xs)).reshape(len(ids), dim)
                ids, xs = [], []
            dim = d
            ids.append(i)
            xs.append(x)
    if ids:
        yield np.array(ids, np.int64), np.frombuffer(b"".join(xs)).reshape(len(ids), dim)


def build_tree(ids: np.ndarray, m: np.ndarray, leaf: int = LEAF_ROWS):
    """(ids, matrix, nodes): rows in leaf order; nodes (first, end, left, right, radius) and centres.

    A ball is split at the median of the projection on the line between two
    far points, so the tree is balanced however the vectors lie.
    """
    order = np.argsort(ids, kind="stable")
    nodes: list[list[float]] = []
    centres: list[np.ndarray] = []
    todo = [(0, len(ids), -1, 0)]
    while todo:
        a, z, parent, side = todo.pop()
        rows = m[order[a:z]]
        c = rows.mean(axis=0)
        dist = np.sqrt(((rows - c) ** 2).sum(axis=1))
        nodes.append([a, z, -1, -1, dist.max()])
        centres.append(c)
        if parent >= 0:
            nodes[parent][2 + side] = len(nodes) - 1
        if z - a > leaf:
            far = rows[dist.argmax()]
            other = rows[((rows - far) ** 2).sum(axis=1).argmax()]
            cut = np.argsort(rows @ (other - far), kind="stable")
            order[a:z] = order[a:z][cut]
            half = (a + z) // 2
            todo += [(half, z, len(nodes) - 1, 1), (a, half, len(nodes) - 1, 0)]
    return ids[order], m[order], np.array(nodes), np.stack(centres)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products as int64, exact; beyond that range they are held at its ends."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    if q.shape[1] * np.abs(q).max() * np.abs(x).max() < _FLOAT_EXACT:
        return (q @ x.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    s = whole(q) @ whole(x).T
    return np.clip(s, _NONE + 1, np.iinfo(np.int64).max).astype(np.int64)


def _bounds(q: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """The most that each query can score in each ball, with room for rounding; what overflows bounds nothing."""
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt((q ** 2).sum(axis=1))[:, None]
        bound = q @ centres.T + norm * radii
        bound += 1e-9 * (np.abs(bound) + norm * (radii + np.sqrt((centres ** 2).sum(axis=1)))) + 1.0
        bound[np.isnan(bound)] = np.inf
    return bound


def search(tree, q_ids: np.ndarray, q: np.ndarray, k: int, floor_score: np.ndarray, floor_id: np.ndarray):
    """The k best rows of the tree for each query that beat its floor: (score, id) arrays of shape (queries, k).

    ``floor_score``/``floor_id``: the query's kth result so far; rows at or
    behind it are of no use.  Missing results have the least int64 as score.
    """
    ids, m, nodes, centres = tree
    n = len(q)
    top_s = np.full((n, k), _NONE, np.int64)
    top_i = np.full((n, k), _LAST, np.int64)
    low_s, low_i = floor_score.copy(), floor_id.copy()
    bound = _bounds(q, centres, nodes[:, 4])
    heap = [(-bound[:, 0].max(initial=-np.inf), 0)]
    while heap:
        _, node = heapq.heappop(heap)
        live = np.flatnonzero(bound[:, node] >= low_s)
        if not len(live):
            continue
        a, z, left, right, _ = nodes[node]
        if left >= 0:
            for child in (int(left), int(right)):
                heapq.heappush(heap, (-bound[live, child].max(), child))
            continue
        a, z = int(a), int(z)
        s, i = _scores(q[live], m[a:z]), ids[a:z]
        better = (s > low_s[live, None]) | ((s == low_s[live, None]) & (i[None, :] < low_i[live, None]))
        better &= i[None, :] != q_ids[live, None]
        r, c = np.nonzero(better)
        if not len(r):
            continue
        # The new rows and the old ones of the queries concerned, best first.
        hit = np.unique(r)
        owner = np.concatenate([live[r], np.repeat(live[hit], k)])
        score = np.concatenate([s[r, c], top_s[live[hit]].ravel()])
        ident = np.concatenate([i[c], top_i[live[hit]].ravel()])
        order = np.lexsort((ident, ~score, owner))       # ~score falls as the score rises and cannot overflow
        owner, score, ident = owner[order], score[order], ident[order]
        start = np.concatenate([[True], owner[1:] != owner[:-1]])
        rank = np.arange(len(owner)) - np.maximum.accumulate(np.where(start, np.arange(len(owner)), 0))
        keep = rank < k
        top_s[owner[keep], rank[keep]], top_i[owner[keep], rank[keep]] = score[keep], ident[keep]
        full = live[hit][top_s[live[hit], k - 1] != _NONE]
        low_s[full], low_i[full] = top_s[full, k - 1], top_i[full, k - 1]
    return top_s, top_i


def _top_balls(nodes: np.ndarray) -> list[int]:
    """The nodes ``TOP_LEVELS`` below the root (leaves above that too): they hold all rows."""
    level = [0]
    for _ in range(TOP_LEVELS):
        level = [int(c) for n in level for c in ((n,) if nodes[n, 2] < 0 else nodes[n, 2:4])]
    return level


def _shards(placed: DataFrame, size: int = SHARD_ROWS) -> DataFrame:
    """One row per ball tree of at most ``size`` vectors; ``top``: centre and radius of its topmost balls."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, m in _packed(batches, size):
            ids, m, nodes, centres = build_tree(ids, m)
            balls = _top_balls(nodes)
            top = np.hstack([centres[balls], nodes[balls, 4:]])
            yield pa.RecordBatch.from_arrays(
                [pa.array([m.shape[1]], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, m, nodes, centres, top))],
                names=["dim", "ids", "m", "nodes", "centres", "top"])

    rows = placed.mapInArrow(run, "dim int, ids binary, m binary, nodes binary, centres binary, top binary")
    return stored(rows.withColumn("shard", F.monotonically_increasing_id()), "topk-shards")


def _blocks(placed: DataFrame, size: int = BLOCK_ROWS) -> DataFrame:
    """One row per block of at most ``size`` queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, m in _packed(batches, size):
            yield pa.RecordBatch.from_arrays(
                [pa.array([m.shape[1]], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())],
                names=["dim", "q_ids", "q"])

    rows = placed.mapInArrow(run, "dim int, q_ids binary, q binary")
    return stored(rows.withColumn("block", F.monotonically_increasing_id()), "topk-blocks")


_FLOORS = "block long, low_s binary, low_i binary"


def _queries_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, matrix, floor scores, floor ids) of a block row; without floors yet, every score is of use."""
    q_ids = np.frombuffer(row["q_ids"], np.int64)
    q = np.frombuffer(row["q"]).reshape(len(q_ids), row["dim"])
    if row["low_s"] is None:
        return q_ids, q, np.full(len(q), _NONE), np.full(len(q), _LAST)
    return q_ids, q, np.frombuffer(row["low_s"], np.int64), np.frombuffer(row["low_i"], np.int64)


def _grouped(blocks: DataFrame, n: int) -> DataFrame:
    """Blocks with the number of the slice they are tested in."""
    return blocks.withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(-(-n // SLICE_BLOCKS))))


def live_pairs(blocks: DataFrame, shards: DataFrame, n_blocks: int, n_shards: int) -> DataFrame:
    """block, slice, shard, gain: the pairs in which some query's bound reaches its floor.

    ``gain`` is the greatest bound of those queries.  Groups of blocks meet
    groups of shards; of a shard only its topmost balls move.
    """
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"block": [], "slice": [], "shard": [], "gain": []}
        if left.num_rows and right.num_rows:
            names = right.column("shard").to_numpy()
            tops = [np.frombuffer(t.as_py()).reshape(-1, left.column("dim")[0].as_py() + 1) for t in right.column("top")]
            start = np.cumsum([0, *(len(t) for t in tops[:-1])])
            balls = np.vstack(tops)
            for batch in left.to_batches(max_chunksize=1):
                row = batch.to_pylist()[0]
                _, q, low, _ = _queries_of(row)
                bound = np.maximum.reduceat(_bounds(q, balls[:, :-1], balls[:, -1]), start, axis=1)
                gain = np.where(bound >= low[:, None], bound, -np.inf).max(axis=0)
                live = np.flatnonzero(gain > -np.inf)
                out["block"] += [row["block"]] * len(live)
                out["slice"] += [row["slice"]] * len(live)
                out["shard"] += names[live].tolist()
                out["gain"] += gain[live].tolist()
        return pa.table(out, schema=pa.schema([("block", pa.int64()), ("slice", pa.int64()), ("shard", pa.int64()), ("gain", pa.float64())]))

    slices, chunks = -(-n_blocks // SLICE_BLOCKS), -(-n_shards // CHUNK_SHARDS)
    left = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = (shards.select("dim", "shard", "top").withColumn("chunk", F.pmod(F.xxhash64("shard"), F.lit(chunks)).cast("int"))
             .withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long")))))
    keys = ["dim", "slice", "chunk"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "block long, slice long, shard long, gain double")


def _search_pairs(pairs: DataFrame, blocks: DataFrame, shards: DataFrame, k: int) -> DataFrame:
    """block, at, query_id, vec_id, score: what the pairs' searches find beyond the floors.

    A shard moves once for each slice of blocks that needs it, and meets the
    blocks of that slice one by one.
    """
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            g = right.slice(0, 1).to_pylist()[0]
            ids = np.frombuffer(g["ids"], np.int64)
            nodes = np.frombuffer(g["nodes"]).reshape(-1, 5)
            tree = (ids, np.frombuffer(g["m"]).reshape(len(ids), g["dim"]), nodes, np.frombuffer(g["centres"]).reshape(len(nodes), g["dim"]))
            for batch in left.to_batches(max_chunksize=1):
                row = batch.to_pylist()[0]
                q_ids, q, low_s, low_i = _queries_of(row)
                s, i = search(tree, q_ids, q, k, low_s, low_i)
                real = s != _NONE
                at = np.arange(len(q)).repeat(k).reshape(len(q), k)[real]
                parts.append(pa.table([pa.array(np.full(len(at), row["block"], np.int64)), pa.array(at.astype(np.int32)),
                                       pa.array(q_ids[at]), pa.array(i[real]), pa.array(s[real])], schema=schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    schema = pa.schema([("block", pa.int64()), ("at", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    keys = ["shard", "slice"]
    # Of the pairs only numbers, so that a list proven small goes to the shards.
    needed = maybe_broadcast(pairs.select(*keys).distinct())
    left = blocks.join(maybe_broadcast(pairs.select("block", "shard")), "block")
    right = shards.drop("top").join(needed, "shard")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "block long, at int, query_id long, vec_id long, score long")


def _floors(best: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """One row per block with a query that has k results: the kth of each, packed."""
    def pack(key, table):
        n = table.column("n")[0].as_py()
        s, i = np.full(n, _NONE), np.full(n, _LAST)
        at = table.column("at").to_numpy()
        s[at], i[at] = table.column("score").to_numpy(), table.column("vec_id").to_numpy()
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([s.tobytes()], pa.binary()), pa.array([i.tobytes()], pa.binary())],
                        names=["block", "low_s", "low_i"])

    kth = best.where(F.col("rank") == k).select("block", "at", "score", "vec_id")
    sized = kth.join(blocks.select("block", F.expr("octet_length(q_ids) div 8").alias("n")), "block")
    return stored(sized.groupBy("block").applyInArrow(pack, _FLOORS), "topk-floors")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best results of each query, with their rank."""
    order = Window.partitionBy("block", "at").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k best vectors by integer inner product.

    A query's own id is no candidate for it.  Components count as
    floor(256 * x).  Vectors that are null or hold null or non-finite
    components, rows without an id, and vectors of another length than the
    query's take no part.  Repeated rows of ``vectors`` are candidates each;
    repeated query rows are searched each and give the same results, which are
    returned once.  Ties go to the smaller id.  Other columns are ignored.
    """
    def pick(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score long"
    shards = _shards(_placed(pick(vectors)), shard_rows)
    # One query row per id and vector, so that repeats cost and return nothing more.
    blocks = _blocks(_placed(pick(queries).distinct()), block_rows)
    n_shards, n_blocks = shards.count(), blocks.count()
    if not n_shards or not n_blocks:
        return spark.createDataFrame([], result)
    blocks = _grouped(blocks, n_blocks)
    floors, searched, best = spark.createDataFrame([], _FLOORS), None, None
    for take in (*(t for t in ROUNDS if t < n_shards), None):
        ready = blocks.join(floors, "block", "left")
        pairs = live_pairs(ready, shards, n_blocks, n_shards)
        if searched is not None:
            pairs = pairs.join(searched.select("block", "shard"), ["block", "shard"], "left_anti")
        if take:
            order = Window.partitionBy("block").orderBy(F.col("gain").desc(), F.col("shard"))
            pairs = pairs.withColumn("no", F.row_number().over(order)).where(F.col("no") <= take).drop("no")
        pairs = stored(pairs, "topk-pairs")
        found = _search_pairs(pairs, ready, shards, k)
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = _best(found, k)
        if take:
            best = stored(best, "topk-best")
            floors = _floors(best, blocks, k)
            searched = pairs if searched is None else searched.unionByName(pairs)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, CAST(list_sum(list_transform(list_zip(qe, e), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM q, v
      WHERE query_id <> vec_id AND len(qe) = len(e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
