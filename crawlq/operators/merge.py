"""MERGE-style writes over plain DataFrames.

Spark has no ``MERGE INTO`` for plain parquet, so each merge is a join that
produces the *new table*: every target row, updated where the source
matched, plus the inserted rows.  A column ``_action`` tells what happened
to each row (``keep`` / ``update`` / ``insert`` / ``reject``); sinks drop
``reject`` rows and the column itself, and :func:`affected_rows` counts it.

Plan shape.  The source side is size-checked first with a bounded job
(``limit(max_rows + 1)``, rows and serialized bytes).  A small source is
broadcast: the target is read once for the left join and once (key column
only) for the semi join that finds which source keys exist, and is never
shuffled.  A larger source is materialised once into the checkpoint folder;
a bitmap of its keys (:mod:`key_filter`) lets target rows that cannot match
pass by, the others left-join it (target streamed, so a hot target key is
split by AQE rather than buffered); new keys come from an anti join whose
key sets are pre-aggregated.  Source de-duplication uses aggregates with
partial aggregation (``max_by`` / ``count``), never a window, so a key
holding a third of the rows does not land whole in one task before it is
reduced.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, BinaryType, DataType, DecimalType, MapType, StringType, StructType,
)

from crawlq.constants import ACTION_COL, BROADCAST_MAX_ROWS, PROCESSING, REASON_COL
from crawlq.operators.key_filter import with_key_filter

KEEP, UPDATE, INSERT, REJECT = "keep", "update", "insert", "reject"

# Serialized size under which a source counts as small, besides the row bound.
BROADCAST_MAX_BYTES = 64 * 1024 * 1024
CONF_MAX_ROWS = "crawlq.merge.broadcastMaxRows"
CONF_MAX_BYTES = "crawlq.merge.broadcastMaxBytes"

_S = "_s_"  # prefix of source columns inside a merge
_T_HIT, _S_HIT, _MAY = "_t_hit", "_s_hit", "_may_match"

# Landed patches carry their order of arrival in this column.
ORDER_COL = "_order"


# ------------------------------------------------------------------ helpers

def drop_null_keys(df: DataFrame, key: str) -> DataFrame:
    """M6: rows whose key is not NULL (count the rest with :func:`null_key_count`)."""
    return df.filter(F.col(key).isNotNull())


def null_key_count(df: DataFrame, key: str) -> DataFrame:
    """M6: one row, ``n`` = number of rows with a NULL key."""
    return df.agg(F.count_if(F.col(key).isNull()).alias("n"))


def align_columns(batch: DataFrame, columns: Iterable[str], key: str) -> DataFrame:
    """Batch columns that the table has (batch order kept); the key stays."""
    names = set(columns)
    return batch.select(*[c for c in batch.columns if c in names or c == key])


def dropped_columns(batch: DataFrame, columns: Iterable[str], key: str) -> list[str]:
    """Columns :func:`align_columns` would drop."""
    names = set(columns)
    return [c for c in batch.columns if c not in names and c != key]


def cast_like(df: DataFrame, schema: StructType) -> DataFrame:
    """Cast the columns of ``df`` that ``schema`` declares to the declared type."""
    types = {f.name: f.dataType for f in schema.fields}
    return df.select(*[
        F.col(c).cast(types[c]).alias(c) if c in types and df.schema[c].dataType != types[c]
        else F.col(c)
        for c in df.columns
    ])


def _orderable(t: DataType) -> bool:
    if isinstance(t, MapType):
        return False
    if isinstance(t, StructType):
        return all(_orderable(f.dataType) for f in t.fields)
    inner = getattr(t, "elementType", None)
    return True if inner is None else _orderable(inner)


def latest_per_key(df: DataFrame, key: str, order: str | Column,
                   latest: bool = True) -> DataFrame:
    """One row per key: the one with the greatest (``latest``) or smallest ``order``.

    A partial aggregate, so hot keys are reduced on the map side.  Ties on
    ``order`` are broken by the row's own values (when its columns are
    orderable), which keeps the pick deterministic across task retries.  Where
    all columns are orderable the row is carried once, behind its order.
    """
    order_c = F.col(order) if isinstance(order, str) else order
    others = [c for c in df.columns if c != key]
    if not others:
        return df.dropDuplicates([key])
    tie = [F.col(c) for c in others if _orderable(df.schema[c].dataType)]
    if len(tie) == len(others):
        ranked = F.struct(order_c.alias("_order"), F.struct(*tie).alias("_row"))
        pick = F.max(ranked) if latest else F.min(ranked)
        return df.groupBy(key).agg(pick.getField("_row").alias("_row")).select(key, "_row.*")
    row = F.struct(*[F.col(c) for c in others])
    ord_key = F.struct(order_c, *tie) if tie else order_c
    pick = F.max_by(row, ord_key) if latest else F.min_by(row, ord_key)
    return df.groupBy(key).agg(pick.alias("_row")).select(key, "_row.*")


def unique_or_raise(df: DataFrame, key: str) -> DataFrame:
    """One row per key; a key given twice fails the job when it is evaluated.

    A duplicate source key matching one target row is an error for MERGE.
    The check is an aggregate (partial, skew-safe), not a driver-side count.
    """
    others = [c for c in df.columns if c != key]
    if not others:
        return df.dropDuplicates([key])
    row = F.struct(*[F.col(c) for c in others])
    agg = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.any_value(row).alias("_row"))
    checked = F.when(F.col("_n") > 1, F.raise_error(
        F.concat(F.lit(f"duplicate source key for merge on {key}: "), F.col(key).cast("string"))
    )).otherwise(F.col("_row"))
    return agg.select(key, checked.alias("_row")).select(key, "_row.*")


def _width(c: str, t: DataType) -> Column:
    """Bytes a value takes, roughly: text and binary by length, nested values
    by their JSON text, fixed-width types by their size."""
    if isinstance(t, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(F.col(c)), F.lit(0))
    if isinstance(t, (StructType, ArrayType, MapType)):
        return F.coalesce(F.octet_length(F.to_json(F.col(c))), F.lit(0))
    return F.lit(16 if isinstance(t, DecimalType) else 8)


def broadcast_limits(spark) -> tuple[int, int]:
    """Row and byte bounds for broadcasting a merge source.

    Read from the session (``crawlq.merge.broadcastMaxRows`` /
    ``crawlq.merge.broadcastMaxBytes``) so a deployment can size them to its
    executors; the library defaults apply when unset.  0 rows disables
    broadcasting.
    """
    rows = int(spark.conf.get(CONF_MAX_ROWS, str(BROADCAST_MAX_ROWS)))
    nbytes = int(spark.conf.get(CONF_MAX_BYTES, str(BROADCAST_MAX_BYTES)))
    return rows, nbytes


def is_small(df: DataFrame, max_rows: int | None = None,
             max_bytes: int | None = None) -> bool:
    """Bounded size check: at most ``max_rows`` rows and ``max_bytes`` bytes.

    Runs one job over at most ``max_rows + 1`` rows; returns two scalars.
    Unset bounds come from :func:`broadcast_limits`.
    """
    conf_rows, conf_bytes = broadcast_limits(df.sparkSession)
    max_rows = conf_rows if max_rows is None else max_rows
    max_bytes = conf_bytes if max_bytes is None else max_bytes
    if max_rows <= 0:
        return False
    width = sum((_width(f.name, f.dataType) for f in df.schema.fields), F.lit(0))
    # The limit gathers up to that many rows of every partition: of widths only.
    probe = df.select(width.alias("_width")).limit(max_rows + 1).agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum("_width"), F.lit(0)).alias("bytes"),
    ).first()
    return probe["rows"] <= max_rows and probe["bytes"] <= max_bytes


def _prepare_source(source: DataFrame, target: DataFrame, key: str,
                    keep_null_keys: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """Drop NULL keys, drop columns the target lacks (``carry`` excepted), cast."""
    if key not in source.columns:
        raise ValueError(f"merge key {key!r} not found in source columns {source.columns}")
    if key not in target.columns:
        raise ValueError(f"merge key {key!r} not found in target columns {target.columns}")
    src = source if keep_null_keys else drop_null_keys(source, key)
    src = align_columns(src, list(target.columns) + list(carry), key)
    return cast_like(src, target.schema)


def _dedupe(src: DataFrame, key: str, on_duplicate: str, order: str | Column | None) -> DataFrame:
    if on_duplicate == "allow":
        return src
    if on_duplicate == "error":
        return unique_or_raise(src, key)
    if on_duplicate in ("latest", "first"):
        if order is None:
            raise ValueError(f"on_duplicate={on_duplicate!r} needs an order column")
        return latest_per_key(src, key, order, latest=on_duplicate == "latest")
    raise ValueError(f"unknown on_duplicate={on_duplicate!r}")


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into ``spark.checkpoint.dir`` (a reliable checkpoint).

    Later joins read it as a plain input, so their shuffle is an ordinary
    exchange that AQE may split when a key is hot, and a lost executor
    costs a re-read rather than a recomputation of the whole lineage.
    """
    return df.checkpoint(eager=True)


def join_side(df: DataFrame, small: bool | None = None) -> DataFrame:
    """The build side of a join: broadcast when its size is proven small
    (:func:`is_small`), otherwise materialised (:func:`materialize`)."""
    small = is_small(df) if small is None else small
    return F.broadcast(df) if small else materialize(df)


def stored_side(df: DataFrame) -> DataFrame:
    """The build side of a join for what is costly to compute: stored first, so
    that neither the size check nor the broadcast computes it again."""
    df = materialize(df)
    return F.broadcast(df) if is_small(df) else df


def matched_keys(target: DataFrame, source_keys: DataFrame, key: str, small: bool) -> DataFrame:
    """Distinct target keys that occur in ``source_keys`` (NULL never matches).

    Small source: the source keys are broadcast into a semi join over the
    target's key column, so the target is not shuffled.  Otherwise both key
    sets are reduced with a partial aggregate first, so a key repeated a
    third of the time costs one row per partition, then semi-joined.
    """
    if small:
        probe = F.broadcast(source_keys.select(key))
        return target.select(key).join(probe, key, "left_semi").dropDuplicates([key])
    return (target.select(key).dropDuplicates([key])
            .join(source_keys.select(key).dropDuplicates([key]), key, "left_semi"))


def anti_target(src: DataFrame, target: DataFrame, key: str, small: bool,
                unique: bool = False) -> DataFrame:
    """C4 for merges: source rows whose key is absent from the target.

    NULL keys never match and are kept.  The keys to drop are found as
    :func:`matched_keys` (at most one row per source key), then removed from
    the source with an anti join whose build side is broadcast (small
    source) or materialised (a large ``src`` is read several times: give it
    stored): hot keys on either side never meet unreduced,
    and both sides of the final anti join are plain shuffles AQE can split.
    """
    keys = src.select(key) if unique else src.select(key).dropDuplicates([key])
    if not small:
        target = with_key_filter(target.select(key), src.select(key), key, _MAY).filter(_MAY).drop(_MAY)
    hits = matched_keys(target, keys, key, small)
    # Small source: the hits are at most its distinct keys, so broadcast.
    # Otherwise materialise them without a probe, which would aggregate the
    # target's key column a second time.
    return src.join(join_side(hits, small), key, "left_anti")


# ------------------------------------------------------------------- merges

def upsert(target: DataFrame, source: DataFrame, key: str, *,
           keep_on_null: Sequence[str] = (), on_missing: str = "insert",
           on_duplicate: str = "error", order: str | Column | None = None,
           given: Mapping[str, str] | None = None,
           broadcast_max_rows: int | None = None,
           source_small: bool | None = None) -> DataFrame:
    """M1: update matched rows, insert the others.

    * NULL source keys are dropped (count them with :func:`null_key_count`).
    * Source columns the target lacks are dropped (:func:`align_columns`).
    * Matched: every source column except the key overwrites the target,
      an explicit NULL included; target columns absent from the source keep
      their value.  Columns in ``keep_on_null`` keep the target value when
      the source value is NULL.  ``given`` maps a column to a boolean source
      column; where that is not true, the target value stays.
    * Unmatched: inserted with the source columns, other columns NULL; with
      ``on_missing="reject"`` they are marked ``reject`` instead.
    * Duplicate source keys: ``error`` (default), ``latest``/``first`` by
      ``order``, or ``allow``.
    * A source with only the key column inserts new keys only (M2).
    * ``source_small`` skips the size probe when the caller knows the answer
      (the probe recomputes the source once, which matters when the source
      is itself an expensive derived DataFrame).
    """
    given = given or {}
    carry = [order] if isinstance(order, str) else []
    flags = sorted(set(given.values()))
    src = _dedupe(_prepare_source(source, target, key, carry=[*carry, *flags]), key, on_duplicate, order)
    src = src.drop(*[c for c in carry if c not in target.columns])
    updates = [c for c in src.columns if c != key and c not in flags]
    if not updates:
        return insert_key_only(target, src, key, broadcast_max_rows=broadcast_max_rows,
                               source_small=source_small)
    small = is_small(src, broadcast_max_rows) if source_small is None else source_small
    s = src.select(key, *[F.col(c).alias(_S + c) for c in [*updates, *flags]], F.lit(True).alias(_S_HIT))
    t = target.withColumn(_T_HIT, F.lit(True))
    # Small source: broadcast, the target is never shuffled.  Otherwise a
    # left join with the target streamed and the (de-duplicated,
    # materialised) source built: a hot target key is split by AQE and never
    # buffered, which a full outer join could not do.  Inserts come from an
    # anti join on pre-aggregated keys.
    if small:
        s = F.broadcast(s)
        kept = t.join(s, key, "left")
    else:
        # Target rows that cannot match pass by unshuffled.
        s = materialize(s)
        flagged = with_key_filter(t, s.select(key), key, _MAY)
        kept = flagged.filter(_MAY).drop(_MAY).join(s, key, "left").unionByName(
            flagged.filter(~F.col(_MAY)).drop(_MAY), allowMissingColumns=True)
    fresh = anti_target(s, target, key, small, unique=on_duplicate != "allow")
    fresh = fresh.select(
        key, *[F.lit(None).cast(target.schema[c].dataType).alias(c)
               for c in target.columns if c != key],
        *[c for c in fresh.columns if c != key], F.lit(None).cast("boolean").alias(_T_HIT))
    joined = kept.unionByName(fresh)

    s_hit = F.col(_S_HIT).isNotNull()
    t_hit = F.col(_T_HIT).isNotNull()
    cols = []
    for c in target.columns:
        if c == key or c not in updates:
            cols.append(F.col(c))
            continue
        new = F.col(_S + c)
        if c in keep_on_null:
            new = F.coalesce(new, F.col(c))
        if c in given:
            new = F.when(F.col(_S + given[c]), new).otherwise(F.col(c))
        cols.append(F.when(s_hit, new).otherwise(F.col(c)).alias(c))
    missing = REJECT if on_missing == "reject" else INSERT
    action = (F.when(t_hit & s_hit, F.lit(UPDATE))
              .when(s_hit, F.lit(missing)).otherwise(F.lit(KEEP)))
    return joined.select(*cols, action.alias(ACTION_COL))


def insert_key_only(target: DataFrame, source: DataFrame, key: str, *,
                    broadcast_max_rows: int | None = None,
                    source_small: bool | None = None) -> DataFrame:
    """M2: the source has only the key: insert unmatched keys, update nothing."""
    src = drop_null_keys(source.select(key), key).dropDuplicates([key])
    small = is_small(src, broadcast_max_rows) if source_small is None else source_small
    src = src if small else materialize(src)
    fresh = anti_target(src, target, key, small)
    return (target.withColumn(ACTION_COL, F.lit(KEEP))
            .unionByName(fresh.withColumn(ACTION_COL, F.lit(INSERT)), allowMissingColumns=True))


def insert_if_absent(target: DataFrame, source: DataFrame, key: str, *,
                     dedupe: bool = False, keep_null_keys: bool = False,
                     order: str | Column | None = None,
                     broadcast_max_rows: int | None = None,
                     source_small: bool | None = None) -> DataFrame:
    """M3-M5: insert source rows whose key is not in the target; skip the rest.

    * NULL keys are dropped, or with ``keep_null_keys`` always inserted (NULL
      never equals NULL).
    * Rows sharing a new key inside the batch are all inserted, unless
      ``dedupe`` keeps the first one by ``order`` (M4's sequential rule; NULL
      keys are never de-duplicated).
    """
    carry = [order] if isinstance(order, str) else []
    src = _prepare_source(source, target, key, keep_null_keys, carry=carry)
    if dedupe:
        if order is None:
            raise ValueError("dedupe=True needs an order column")
        keyed = _dedupe(src.filter(F.col(key).isNotNull()), key, "first", order)
        nulls = src.filter(F.col(key).isNull())
        src = keyed.unionByName(nulls) if keep_null_keys else keyed
    src = src.drop(*[c for c in carry if c not in target.columns])
    small = is_small(src, broadcast_max_rows) if source_small is None else source_small
    src = src if small else materialize(src)
    fresh = anti_target(src, target, key, small)
    return (target.withColumn(ACTION_COL, F.lit(KEEP))
            .unionByName(fresh.withColumn(ACTION_COL, F.lit(INSERT)), allowMissingColumns=True))


def inserted_rows(merged: DataFrame) -> DataFrame:
    """Only the rows a merge inserts (the ``keep`` branch is pruned by Catalyst)."""
    return merged.filter(F.col(ACTION_COL) == INSERT).drop(ACTION_COL)


def table_rows(merged: DataFrame) -> DataFrame:
    """The new table: rejected rows and the action column removed."""
    return merged.filter(F.col(ACTION_COL) != REJECT).drop(ACTION_COL)


def affected_rows(merged: DataFrame) -> DataFrame:
    """Rows per action (``_action``, ``n``)."""
    return merged.groupBy(ACTION_COL).agg(F.count(F.lit(1)).alias("n"))


def insert_counts(merged: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """D9 for insert-if-absent: one row with ``inserted`` (rows the merge
    inserted), ``skipped`` (source rows with a key that were not inserted:
    batch minus inserted) and ``null_keys`` (source rows dropped for a NULL
    key).  Each figure is an aggregate; the source counts enter as scalar
    subqueries."""
    batch = source.agg(F.count_if(F.col(key).isNotNull()).alias("b"),
                       F.count_if(F.col(key).isNull()).alias("z"))
    inserted = F.count_if(F.col(ACTION_COL) == INSERT)
    return merged.agg(inserted.alias("inserted")).select(
        "inserted",
        (batch.select("b").scalar() - F.col("inserted")).alias("skipped"),
        batch.select("z").scalar().alias("null_keys"))


# ------------------------------------------------------------------ patches

def split_required(patch: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Valid rows (every required column non-NULL and non-empty) and the rest."""
    ok = F.lit(True)
    for c in required:
        v = F.col(c)
        ok = ok & v.isNotNull() & (v.cast("string") != "")
    return patch.filter(ok), patch.filter(~ok)


def _with_rejects(merged: DataFrame, bad: DataFrame, reason: str) -> DataFrame:
    rejected = bad.withColumn(ACTION_COL, F.lit(REJECT)).drop(REASON_COL)
    return merged.unionByName(rejected, allowMissingColumns=True)


def _stamp(now: Column | None) -> Column:
    return F.current_timestamp() if now is None else now


def _patch_order(patch: DataFrame, order: str | None) -> str | None:
    """The column that orders the patches of one key: landed streams bring one."""
    return ORDER_COL if order is None and ORDER_COL in patch.columns else order


def _last_patch(good: DataFrame, key: str, order: str | None) -> DataFrame:
    """The last patch of each key by ``order``; without one the rows as they are."""
    return good if order is None else latest_per_key(good, key, order).drop(order)


def patch_status(target: DataFrame, patch: DataFrame, now: Column | None = None, *,
                 key: str = "id", extra: Sequence[str] = (), on_missing: str = "reject",
                 order: str | None = None,
                 broadcast_max_rows: int | None = None) -> DataFrame:
    """M7: set ``status`` (and allowed ``extra`` columns) by id.

    A patch without a ``status`` column changes the ``extra`` columns only.
    Rows moving to ``processing`` also get ``processed_at = now``; rows moving
    elsewhere keep their ``processed_at``.  ``updated_at = now`` always.
    Unknown ids are rejected (``on_missing="insert"`` inserts them).

    Several patches of one id count as applied one by one in the order of the
    column ``order``: the last one's values stay, and ``processed_at`` is
    stamped if any of them moved the row to ``processing``.  Patches equal in
    ``order`` count as ordered by their values.  ``order`` is ``_order`` by
    default where the patches have that column; without an order, repeats
    fail the job.
    """
    order = _patch_order(patch, order)
    good, bad = split_required(patch, [key])
    ts = _stamp(now)
    has_status = "status" in patch.columns
    given = [*(["status"] if has_status else []), *extra]
    if order is None:
        p = good.select(key, *given, *([(F.col("status") == PROCESSING).alias("_started")] if has_status else []))
    else:
        started = [F.max(F.col("status") == PROCESSING).alias("_started")] if has_status else []
        last = F.max_by(F.struct(*given), F.struct(order, *[
            F.col(c) for c in given if _orderable(good.schema[c].dataType)])).alias("_last")
        p = good.groupBy(key).agg(last, *started).select(key, "_last.*", *(["_started"] if has_status else []))
    stamp = [F.when(F.col("_started"), ts).alias("processed_at")] if has_status else []
    p = p.select(key, *given, *stamp, ts.alias("updated_at"))
    merged = upsert(target, p, key, keep_on_null=["processed_at"] if has_status else [],
                    on_missing=on_missing,
                    broadcast_max_rows=broadcast_max_rows)
    return _with_rejects(merged, bad.select(key, *given), "missing id")


def claim_owner(target: DataFrame, patch: DataFrame, now: Column | None = None, *,
                key: str = "id", on_missing: str = "reject", require_owner: bool = True,
                order: str | None = None,
                broadcast_max_rows: int | None = None) -> DataFrame:
    """M8: set ``extension_id`` and ``updated_at``.

    The id is required.  Keyword claims also require a non-empty owner;
    seed claims (``require_owner=False``) accept any owner value, an empty
    or NULL one included (which releases the seed).  Of several claims of one
    id the last by ``order`` stays (see :func:`patch_status`).
    """
    order = _patch_order(patch, order)
    required = [key, "extension_id"] if require_owner else [key]
    good, bad = split_required(patch.select(key, "extension_id", *([order] if order else [])), required)
    bad = bad.select(key, "extension_id")
    p = _last_patch(good, key, order).select(key, "extension_id", _stamp(now).alias("updated_at"))
    merged = upsert(target, p, key, on_missing=on_missing, broadcast_max_rows=broadcast_max_rows)
    return _with_rejects(merged, bad, "id and extension_id are required")


def claim_processing(target: DataFrame, patch: DataFrame, now: Column | None = None, *,
                     key: str = "id", on_missing: str = "reject",
                     order: str | None = None,
                     broadcast_max_rows: int | None = None) -> DataFrame:
    """M9: status ``processing``, owner, ``processed_at`` and ``updated_at`` at once.

    Of several claims of one id the last by ``order`` stays.
    """
    order = _patch_order(patch, order)
    good, bad = split_required(patch.select(key, "extension_id", *([order] if order else [])),
                               [key, "extension_id"])
    bad = bad.select(key, "extension_id")
    ts = _stamp(now)
    p = _last_patch(good, key, order).select(key, F.lit(PROCESSING).alias("status"), "extension_id",
                    ts.alias("processed_at"), ts.alias("updated_at"))
    merged = upsert(target, p, key, on_missing=on_missing, broadcast_max_rows=broadcast_max_rows)
    return _with_rejects(merged, bad, "id and extension_id are required")


def advance_cursor(target: DataFrame, patch: DataFrame, now: Column | None = None, *,
                   key: str = "id", cursor: str = "start", on_missing: str = "reject",
                   order: str | None = None,
                   broadcast_max_rows: int | None = None) -> DataFrame:
    """Set the integer paging cursor (0 allowed, NULL rejected) and ``updated_at``.

    Of several moves of one id the last valid one by ``order`` stays.
    """
    order = _patch_order(patch, order)
    pt = patch.select(key, F.col(cursor).alias("start"), *([order] if order else []))
    ok = F.col(key).isNotNull() & (F.col(key) != "") & F.col("start").isNotNull()
    good, bad = pt.filter(ok), pt.filter(~ok).select(key, "start")
    p = _last_patch(good, key, order).select(key, F.col("start").cast("long").alias("start"),
                    _stamp(now).alias("updated_at"))
    merged = upsert(target, p, key, on_missing=on_missing, broadcast_max_rows=broadcast_max_rows)
    return _with_rejects(merged, bad, "id and current_start are required")
