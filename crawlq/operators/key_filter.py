"""Which rows of a large table may match a set of keys, without moving them.

The keys set bits of a bitmap by their hash.  The bitmap is broadcast as
(slot, 64 bits) rows: 16 bits a key, at most 2^20 slots (64 million bits),
so its size is bounded whatever the number of keys.  A row whose bit is not
set cannot match and need not be shuffled; about one in 16 of the others
passes for nothing where the keys fill the bitmap, fewer below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_SLOTS = 1 << 20
# With fewer than 4 bits a key most rows would pass: then all do.
MAX_KEYS = MAX_SLOTS * 64 // 4

_SLOT, _BITS, _AT = "_kf_slot", "_kf_bits", "_kf_at"


def with_key_filter(df: DataFrame, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """``df`` with a boolean ``flag``: false only where ``key`` is not in ``keys``.

    ``keys`` is read twice (count and bitmap); give it stored.  A NULL key
    equals none and may pass.
    """
    n = keys.count()
    if n > MAX_KEYS:
        return df.withColumn(flag, F.lit(True))
    slots = min(MAX_SLOTS, max(1024, 1 << (n // 4).bit_length()))
    # The key's type in both tables is the same, so equal keys have equal hashes.
    h = F.xxhash64(F.col(key).cast(df.schema[key].dataType))
    slot = h.bitwiseAND(F.lit(slots - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"),
                          F.shiftrightunsigned(h, 58).cast("int"))
    bitmap = (keys.filter(F.col(key).isNotNull()).select(slot.alias(_SLOT), bit.alias(_BITS))
              .groupBy(_SLOT).agg(F.bit_or(_BITS).alias(_BITS)))
    met = df.withColumn(_AT, slot).join(F.broadcast(bitmap), F.col(_AT) == F.col(_SLOT), "left")
    may = F.coalesce(F.col(_BITS).bitwiseAND(bit) != 0, F.lit(False))
    return met.withColumn(flag, may).drop(_AT, _SLOT, _BITS)
