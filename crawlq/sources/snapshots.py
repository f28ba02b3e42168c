"""Tables in key buckets with a committed list of folders.

A table is a root folder: ``data/`` holds parquet folders, one per write and
bucket, and ``commits/`` one small JSON file per version, which names the
folders of every bucket.  Rows go to the bucket ``pmod(xxhash64(key), n)``.

* **Merge:** only the buckets that the source's keys fall into are read and
  written; of those, only buckets with an updated or inserted row enter the
  new version.  All other folders stay as they are.
* **Append:** adds folders, reads nothing.  A batch is named by its writer
  and a number that grows; one whose number was committed before writes
  nothing, so a repeated request or a retried job leaves one copy.
* **Commit:** the commit file of the next version is renamed into its place
  without overwriting, which is the one step that makes a write visible.  Of
  two writers of one version one fails there: an append (or a merge whose
  buckets nobody else changed) is rebased onto the version that won, another
  merge raises :class:`ConcurrentWrite`.  Needs a file system whose rename is
  atomic and refuses to overwrite (HDFS); elsewhere let one driver write.
* **Rejected rows** are written by the same job as the others, next to them,
  and read back from there: they are the rows left out, whatever the input
  gives when computed again.
* **Hot keys:** the write is rebalanced by bucket, so AQE splits a bucket that
  a frequent key fills into several files and joins small ones.

The driver holds the list of folders (buckets times writes since the last
merge or :func:`compact` of a bucket) and counts per bucket, never rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from crawlq.constants import ACTION_COL, REASON_COL
from crawlq.functions.columns import required_fields_ok
from crawlq.operators import merge
from crawlq.plans.normalize import split_valid

_BUCKET, _REJECTED = "_bucket", "_rejected"
_RETRIES = 20


class ConcurrentWrite(RuntimeError):
    """Another writer changed buckets that this merge read."""


@dataclass(frozen=True)
class Version:
    """One committed version: what its commit file says."""

    number: int
    key: str
    buckets: int
    schema: StructType
    folders: dict[int, list[str]]
    writers: dict[str, int]
    entry: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({
            "number": self.number, "key": self.key, "buckets": self.buckets,
            "schema": self.schema.jsonValue(), "writers": self.writers, "entry": self.entry,
            "folders": {str(b): f for b, f in sorted(self.folders.items())}}, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Version:
        d = json.loads(text)
        return Version(d["number"], d["key"], d["buckets"], StructType.fromJson(d["schema"]),
                       {int(b): f for b, f in d["folders"].items()}, d["writers"], d["entry"])


@dataclass(frozen=True)
class Written:
    """What a write did: the version that holds it, rows per action, the buckets
    that entered the version, and the folder of rejected rows (if any)."""

    version: int
    counts: dict[str, int]
    changed: list[int]
    rejects: str | None
    repeated: bool = False


# ----------------------------------------------------------- commit files

def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _commit_path(root: str, number: int) -> str:
    return f"{root}/commits/{number:012d}.json"


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the committed versions, ascending; empty without a table."""
    fs, p = _fs(spark, f"{root.rstrip('/')}/commits")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def version(spark: SparkSession, root: str, number: int | None = None) -> Version:
    """A committed version, by default the last."""
    root = root.rstrip("/")
    if number is None:
        have = versions(spark, root)
        if not have:
            raise FileNotFoundError(f"no table in {root}")
        number = have[-1]
    return Version.from_json(spark.read.text(_commit_path(root, number), wholetext=True).first()[0])


def _create(spark: SparkSession, root: str, v: Version) -> bool:
    """Create the commit file of ``v``; False if another writer made that version.

    The file is written under another name and renamed without overwriting, so
    a reader never sees a part of it and a writer that is lost leaves no version.
    """
    fs_names, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    path = fs_names.Path(_commit_path(root, v.number))
    tmp = fs_names.Path(f"{root}/commits/.{uuid.uuid4().hex}.tmp")
    fs = path.getFileSystem(conf)
    fs.mkdirs(path.getParent())
    out = fs.create(tmp, False)
    out.write(bytearray(v.to_json().encode()))
    out.close()
    rename = getattr(fs_names, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.NONE
    try:
        fs_names.FileContext.getFileContext(path.toUri(), conf).rename(
            fs.makeQualified(tmp), fs.makeQualified(path), how)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        fs.delete(tmp, False)
        return False
    return True


# ------------------------------------------------------------------- write

def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, root: str, schema: StructType, key: str,
           buckets: int) -> tuple[str, dict[tuple[int, str], int]]:
    """Write rows with their action in one job; the folder and the rows per
    (bucket, action), counted from the files that were committed."""
    spark = rows.sparkSession
    name = f"data/{uuid.uuid4().hex}"
    extra = [c for c in (REASON_COL,) if c in rows.columns]
    out = rows.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns
          else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields],
        ACTION_COL, *extra, (F.col(ACTION_COL) == merge.REJECT).cast("int").alias(_REJECTED),
        bucket_of(key, buckets).alias(_BUCKET))
    (out.hint("rebalance", F.col(_REJECTED), F.col(_BUCKET))
     .write.partitionBy(_REJECTED, _BUCKET).parquet(f"{root}/{name}"))
    seen = (spark.read.schema(StructType([
        StructField(ACTION_COL, StringType()), StructField(_REJECTED, IntegerType()),
        StructField(_BUCKET, IntegerType())])).parquet(f"{root}/{name}")
        .groupBy(_BUCKET, ACTION_COL).count().collect())
    return name, {(r[0], r[1]): r[2] for r in seen}


def _counts(by_bucket: dict[tuple[int, str], int]) -> dict[str, int]:
    out = dict.fromkeys((merge.KEEP, merge.UPDATE, merge.INSERT, merge.REJECT), 0)
    for (_, action), n in by_bucket.items():
        out[action] += n
    return out


def _folder(name: str, bucket: int) -> str:
    return f"{name}/{_REJECTED}=0/{_BUCKET}={bucket}"


def _rejects(name: str, counts: dict[str, int]) -> str | None:
    return f"{name}/{_REJECTED}=1" if counts[merge.REJECT] else None


def create(rows: DataFrame, root: str, key: str, buckets: int = 64,
           schema: StructType | None = None) -> Written:
    """Make a table from ``rows`` (its first version); fails if one is there."""
    spark, root, schema = rows.sparkSession, root.rstrip("/"), schema or rows.schema
    if versions(spark, root):
        raise FileExistsError(f"a table is in {root}")
    if key not in schema.fieldNames():
        raise ValueError(f"bucket key {key!r} is not a column of the table")
    name, by_bucket = _write(rows.withColumn(ACTION_COL, F.lit(merge.INSERT)), root, schema, key, buckets)
    folders = {b: [_folder(name, b)] for b, _ in by_bucket}
    counts = _counts(by_bucket)
    v = Version(1, key, buckets, schema, folders, {}, {"counts": counts})
    if not _create(spark, root, v):
        raise FileExistsError(f"a table is in {root}")
    return Written(1, counts, sorted(folders), None)


def read(spark: SparkSession, root: str, at: Version | int | None = None,
         buckets: Sequence[int] | None = None) -> DataFrame:
    """The rows of a version (default the last), of all or of some buckets."""
    root = root.rstrip("/")
    v = at if isinstance(at, Version) else version(spark, root, at)
    wanted = v.folders if buckets is None else {b: v.folders[b] for b in buckets if b in v.folders}
    paths = [f"{root}/{f}" for fs in wanted.values() for f in fs]
    if not paths:
        return spark.createDataFrame([], v.schema)
    return spark.read.schema(v.schema).parquet(*paths)


def read_rejects(spark: SparkSession, root: str, written: Written) -> DataFrame:
    """The rows a write left out, with their reason where the write gave one."""
    root = root.rstrip("/")
    schema = StructType([*version(spark, root, written.version).schema.fields,
                         StructField(REASON_COL, StringType())])
    if written.rejects is None:
        return spark.createDataFrame([], schema)
    # The bucket folders below are not a column of the rows.
    return spark.read.schema(schema).parquet(f"{root}/{written.rejects}").select(*schema.fieldNames())


# ------------------------------------------------------------ merge, append

def merge_into(spark: SparkSession, root: str, source: DataFrame,
               apply: Callable[[DataFrame, DataFrame], DataFrame]) -> Written:
    """A merge that rewrites only the buckets it changes.

    ``apply(target, source)`` is a merge of :mod:`crawlq.operators.merge` or
    :mod:`crawlq.operators.patch_log` on the table's key; ``target`` holds the
    buckets that the source's keys fall into.  The source is stored once.
    """
    root = root.rstrip("/")
    v = version(spark, root)
    source = merge.materialize(source)
    # At most one value per bucket.
    touched = sorted(r[0] for r in source.select(bucket_of(v.key, v.buckets)).distinct().collect())
    merged = apply(read(spark, root, v, touched), source)
    return _commit_merge(spark, root, v, merged, set(touched))


def compact(spark: SparkSession, root: str, max_folders: int = 8) -> Written | None:
    """Rewrite the buckets that appends left in more than ``max_folders`` folders."""
    root = root.rstrip("/")
    v = version(spark, root)
    many = sorted(b for b, f in v.folders.items() if len(f) > max_folders)
    if not many:
        return None
    rows = read(spark, root, v, many).withColumn(ACTION_COL, F.lit(merge.KEEP))
    return _commit_merge(spark, root, v, rows, set(many), every=True)


def _commit_merge(spark: SparkSession, root: str, v: Version, merged: DataFrame,
                  touched: set[int], every: bool = False) -> Written:
    name, by_bucket = _write(merged, root, v.schema, v.key, v.buckets)
    moved = (merge.UPDATE, merge.INSERT)
    written = {b for b, action in by_bucket if action != merge.REJECT}
    changed = sorted(b for b in written if every or any((b, a) in by_bucket for a in moved))
    stray = set(changed) - touched
    if stray:
        raise ValueError(f"the merge wrote keys outside the source's buckets: {sorted(stray)[:5]}")
    # Buckets written in vain are not part of any version.
    for b in sorted(written - set(changed)):
        fs, p = _fs(spark, f"{root}/{_folder(name, b)}")
        fs.delete(p, True)
    counts = _counts(by_bucket)
    rejects = _rejects(name, counts)
    base = v
    for _ in range(_RETRIES):
        if any(base.folders.get(b) != v.folders.get(b) for b in touched):
            raise ConcurrentWrite(f"version {base.number} of {root} changed buckets that this merge read")
        new = Version(base.number + 1, v.key, v.buckets, v.schema,
                      {**base.folders, **{b: [_folder(name, b)] for b in changed}}, base.writers,
                      {"counts": counts, "rejects": rejects})
        if _create(spark, root, new):
            return Written(new.number, counts, changed, rejects)
        base = version(spark, root)
    raise ConcurrentWrite(f"no free version of {root} after {_RETRIES} tries")


def append(spark: SparkSession, root: str, rows: DataFrame, writer: str, number: int,
           table_type: str | None = None) -> Written:
    """Append the valid rows of a batch exactly once.

    Columns the table lacks are dropped; rows without a required field are
    left out with their reason (:func:`read_rejects`).  Batches of a
    ``writer`` carry growing numbers; a batch whose number is not above the
    last committed one was appended before: nothing is written or computed,
    and what was written then is returned with ``repeated``.
    """
    root = root.rstrip("/")
    v = version(spark, root)
    if number <= v.writers.get(writer, -1):
        return _earlier(spark, root, writer, number)
    names = set(v.schema.fieldNames())
    aligned = merge.cast_like(rows.select(*[c for c in rows.columns if c in names]), v.schema)
    if v.key not in aligned.columns:
        raise ValueError(f"bucket key {v.key!r} not found in the batch's columns {rows.columns}")
    marked = split_valid(aligned, {"missing required fields":
                                   required_fields_ok(table_type or "", aligned.columns)})
    action = F.when(F.col(REASON_COL).isNull(), F.lit(merge.INSERT)).otherwise(F.lit(merge.REJECT))
    name, by_bucket = _write(marked.withColumn(ACTION_COL, action), root, v.schema, v.key, v.buckets)
    counts = _counts(by_bucket)
    rejects = _rejects(name, counts)
    fresh = sorted(b for b, a in by_bucket if a == merge.INSERT)
    for _ in range(_RETRIES):
        folders = {**v.folders, **{b: [*v.folders.get(b, []), _folder(name, b)] for b in fresh}}
        new = Version(v.number + 1, v.key, v.buckets, v.schema, folders, {**v.writers, writer: number},
                      {"counts": counts, "rejects": rejects, "writer": writer, "batch": number,
                       "changed": fresh})
        if _create(spark, root, new):
            return Written(new.number, counts, fresh, rejects)
        v = version(spark, root)
        if number <= v.writers.get(writer, -1):  # the same batch from another driver won
            return _earlier(spark, root, writer, number)
    raise ConcurrentWrite(f"no free version of {root} after {_RETRIES} tries")


def _earlier(spark: SparkSession, root: str, writer: str, number: int) -> Written:
    for n in reversed(versions(spark, root)):
        v = version(spark, root, n)
        if (v.entry.get("writer"), v.entry.get("batch")) == (writer, number):
            return Written(n, v.entry["counts"], v.entry["changed"], v.entry["rejects"], repeated=True)
    # Its commit file is vacuumed, or the number was skipped.
    return Written(0, {}, [], None, repeated=True)


def vacuum(spark: SparkSession, root: str, keep: int = 10) -> int:
    """Delete the versions before the last ``keep`` and the folders that only they
    name; the number of folders deleted.  Readers of those versions must be done."""
    root = root.rstrip("/")
    have = versions(spark, root)
    old, kept = have[:-keep] if keep else have[:-1], have[-keep:] if keep else have[-1:]
    if not old:
        return 0

    def named(numbers):
        vs = [version(spark, root, n) for n in numbers]
        return ({f for v in vs for fs in v.folders.values() for f in fs}
                | {v.entry["rejects"] for v in vs if v.entry.get("rejects")})

    gone = named(old) - named(kept)
    for f in sorted(gone):
        fs, p = _fs(spark, f"{root}/{f}")
        fs.delete(p, True)
    for n in old:
        fs, p = _fs(spark, _commit_path(root, n))
        fs.delete(p, False)
    return len(gone)
