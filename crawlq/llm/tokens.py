"""Token-id output: Parquet list columns with chosen encodings (operator 8).

Layout of a token table (one Parquet file per task, parts in ascending key
order):

* ``part`` / ``doc_id`` / ``start_in_part`` / ``n_tokens`` - metadata, written
  with DELTA_BINARY_PACKED (sorted or slowly changing integers);
* ``ids`` - ``array<int>``, dictionary encoded: the dictionary page of a row
  group holds each id once and the data pages bit-packed positions.

Row-group and page sizes are set, and the writer adds column and offset
indexes, so a reader of the metadata columns touches none of the id pages and
a reader of some documents only the pages that hold them.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlq.llm.common import maybe_broadcast, worker_cache
from crawlq.llm.words import Words

END_ID = 0
ROW_GROUP_BYTES = 16 * 1024 * 1024
PAGE_BYTES = 128 * 1024
CACHE_PIECES = 800_000      # cached pieces per Python worker; beyond, only those of the latest texts stay
JOINT = 64                  # pieces encoded as one text
OUT_BYTES = 4 << 20         # bytes of text per Arrow batch sent back

_LETTER = np.zeros(256, bool)
_LETTER[[c for c in range(128) if chr(c).isalpha()]] = True
# Bytes that begin a character which is no white space (C2, E1, E2 and E3 may begin one that is).
_VISIBLE = np.zeros(256, bool)
_VISIBLE[[*range(0x21, 0x7F), *range(0xC3, 0xE0), *range(0xE4, 0xF5)]] = True
_VISIBLE_SET = frozenset(np.flatnonzero(_VISIBLE).tolist())
_STOPS = b".,;:!?%*#$)&\"]}"

_WORKERS: dict[str, _Worker] = worker_cache()


class _Worker:
    """The tokenizer of this Python worker and the ids of the pieces it has met."""

    def __init__(self, path: str):
        # One thread for each task: Spark already runs a task on every core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.n_bytes = np.zeros(self.tok.get_vocab_size(), np.int64)
        for text, i in self.tok.get_vocab(with_added_tokens=False).items():
            self.n_bytes[i] = len(text)       # one character of a byte-level token for each byte
        added = b""
        for i, t in self.tok.get_added_tokens_decoder().items():
            self.n_bytes[i] = len(t.content.encode())
            added += t.content.encode()
        self.stop = np.zeros(256, bool)       # no cut may fall into an added token
        self.stop[[c for c in _STOPS if c not in added]] = True
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.ends = np.zeros(1, np.int64)           # the ids of piece k end at ends[k] and begin at ends[k - 1]

    def numbers(self, pieces: list[bytes]) -> np.ndarray:
        """The numbers of distinct pieces, from 1 on; new ones are encoded."""
        new = [x for x in pieces if x not in self.number]
        if len(self.number) + len(new) > CACHE_PIECES and self.number:
            held = [x for x in pieces if x in self.number]
            ids = [self.ids[self.ends[k - 1]:self.ends[k]] for k in map(self.number.__getitem__, held)]
            self.clear()
            self.add(held, np.concatenate(ids) if ids else np.zeros(0, np.int32), np.array([len(x) for x in ids], np.int64))
        if new:
            self.add(*_encode_pieces(new, self.tok, self.n_bytes))
        return np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))

    def add(self, pieces: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Number new pieces, given their ids one after the other."""
        k = len(self.number)
        self.number.update(zip(pieces, range(k + 1, k + 1 + len(pieces))))
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])


def pieces(buf: bytes, stop: np.ndarray) -> np.ndarray:
    """Marks of where pieces begin in a buffer: places that no pre-token of byte-level BPE reaches over.

    One is a space before a visible character: it opens the next pre-token,
    and the white space before it is a pre-token of its own.  The other is a
    punctuation mark (``stop``) after a letter, which ends a run of letters.
    Fewer cuts than possible are no harm: characters that are not surely
    letters or visible make none.
    """
    text = np.frombuffer(buf, np.uint8)
    cut = np.zeros(len(text), bool)
    cut[:-1] = (text[:-1] == 0x20) & _VISIBLE[text[1:]]
    letter = _LETTER[text]
    # U+00C0 to U+017F but the signs for times and divided by.
    lead = (text[:-1] >= 0xC3) & (text[:-1] <= 0xC5)
    sign = (text[:-1] == 0xC3) & ((text[1:] == 0x97) | (text[1:] == 0xB7))
    letter[1:] |= lead & ~sign
    cut[1:] |= stop[text[1:]] & letter[:-1]
    return cut


def encode(texts: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, end ids included, and each text's number of ids.

    Texts are cut into pieces; every distinct piece goes through the
    tokenizers library once per worker while it is cached.
    """
    if path not in _WORKERS:
        _WORKERS[path] = _Worker(path)
    worker = _WORKERS[path]
    buf = b"\n".join([*texts, b""])
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    cut = pieces(buf, worker.stop)
    cut[(ends - sizes)[sizes > 0]] = True
    starts = np.flatnonzero(cut)
    doc = np.searchsorted(ends, starts, side="right")
    lengths = np.minimum(np.append(starts[1:], len(buf)), ends[doc]) - starts if len(starts) else starts
    words = Words.at(buf, starts, lengths)
    number, distinct = words.numbered(np.arange(len(words)), *words.hashes())
    number = worker.numbers(distinct)[number] if len(distinct) else number
    begin, n = worker.ends[number - 1], np.diff(worker.ends)[number - 1]
    upto = np.cumsum(n)
    total = int(upto[-1]) if len(upto) else 0
    flat = worker.ids[np.repeat(begin - (upto - n), n) + np.arange(total)]
    counts = np.bincount(doc, weights=n, minlength=len(texts)).astype(np.int64) + 1
    out = np.full(total + len(texts), END_ID, np.int32)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(counts) - 1] = False
    out[inside] = flat
    return out, counts


def _encode_pieces(new: list[bytes], tok, n_bytes: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Pieces in a new order, their ids one after the other, and each piece's number of ids.

    Pieces that open with a space and a visible character are encoded
    together, as no pre-token reaches from one into the next; the bytes that
    the ids stand for tell where each piece ends."""
    joint, alone = [], []
    for x in new:
        (joint if x[0] == 0x20 and len(x) > 1 and x[1] in _VISIBLE_SET else alone).append(x)
    done: list[bytes] = []
    ids, lengths = [], []
    groups = [joint[i:i + JOINT] for i in range(0, len(joint), JOINT)]
    for group, e in zip(groups, tok.encode_batch_fast([b"".join(g).decode() for g in groups], add_special_tokens=False)):
        got = np.array(e.ids, np.int32)
        upto = np.cumsum(n_bytes[got])
        ends = np.cumsum([len(x) for x in group])
        at = np.searchsorted(upto, ends)
        if at[-1] >= len(upto) or (upto[at] != ends).any():    # ids that don't add up to their texts
            alone += group
            continue
        done += group
        ids.append(got)
        lengths.append(np.diff(at, prepend=-1))
    for x, e in zip(alone, tok.encode_batch_fast([x.decode() for x in alone], add_special_tokens=False)):
        done.append(x)
        ids.append(np.array(e.ids, np.int32))
        lengths.append(np.array([len(ids[-1])]))
    return done, np.concatenate(ids), np.concatenate(lengths)


def write_tokens(docs: DataFrame, out: str, tokenizer_path: str, *,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write the token table to ``out``.

    Rows go to range partitions of ``id_col`` (ties by a hash of the text, so
    an id that a third of the rows share spreads) and are sorted there; null
    ids come first.  A null text counts as empty.  Repeated rows are kept.
    Other columns of ``docs`` are ignored.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text")
                       ).withColumn("h", F.xxhash64("text"))
    ordered = (slim.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
               .select("doc_id", F.col("text").cast("binary").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            upto = np.cumsum([len(t) for t in texts])
            k = 0
            while k < len(texts):
                z = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + OUT_BYTES, side="right")))
                ids, n = encode(texts[k:z], tokenizer_path)
                ends = np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(n), part, np.int32)), batch.column("doc_id").slice(k, z - k),
                    pa.array(at + ends[:-1]), pa.array(n.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)),
                ], names=["part", "doc_id", "start_in_part", "n_tokens", "ids"])
                at += int(ends[-1])
                k = z

    w = (ordered.mapInArrow(run, "part int, doc_id long, start_in_part long, n_tokens int, ids array<int>")
         .write.option("compression", "zstd")
         .option("parquet.writer.version", "PARQUET_2_0")
         .option("parquet.block.size", ROW_GROUP_BYTES)
         .option("parquet.page.size", PAGE_BYTES))
    for c in ("part", "doc_id", "start_in_part", "n_tokens"):
        w = w.option(f"parquet.enable.dictionary#{c}", "false")
    w.option("parquet.enable.dictionary#ids.list.element", "true").parquet(out)


SCHEMA = "part int, doc_id long, start_in_part long, n_tokens int, ids array<int>"


def read_tokens(spark, path: str) -> DataFrame:
    """The token table with ``start``: ids of all documents before, over all parts.

    The totals of the parts come from the metadata columns alone; there is one
    row per part, so the window over them is small.
    """
    t = spark.read.schema(SCHEMA).parquet(path)
    totals = t.groupBy("part").agg(F.sum("n_tokens").alias("ids_here"))
    before = totals.select("part", F.coalesce(F.sum("ids_here").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return (t.join(maybe_broadcast(before), "part")
            .select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"),
                    F.col("n_tokens").cast("long").alias("n_tokens"), "ids"))


def token_digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of a table from :func:`read_tokens`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            ends = ids.offsets.to_numpy()
            crc = [zlib.crc32(raw[4 * a:4 * z]) for a, z in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
