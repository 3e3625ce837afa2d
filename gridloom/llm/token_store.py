"""Token ids in files of directly addressable codes.

Method: an id is split into chunks of ``WIDTHS`` bits.  Level 0 holds the lowest chunk of every token; a bitmap says
which tokens go on, and level n + 1 holds the next chunk of just those.  A rank directory counts the bitmap's ones
before every block of ``RANK_BITS`` bits, so the place of any token in the next level is one directory entry and the
count of a few bits: token i is read without decoding what stands before it.

A store is a Parquet table in the session's file system, one row a shard of whole documents in ascending doc_id order.
``write_tokens`` orders documents by range partitioning, ``read_tokens`` gives a row per document with its global start.

Edge cases: null ids store a document without ids; equal doc_ids keep both rows, ordered by ids; a null doc_id sorts
first; an empty table writes an empty store.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import ROWS_AT_ONCE, encoder

WIDTHS = (8, 8, 16)
RANK_BITS = 512
MAGIC = b"DAC1"
#: A shard is closed once it holds so many tokens.
SHARD_TOKENS = 1 << 20


def _chunk_type(bits: int) -> str:
    return "<u1" if bits <= 8 else "<u2"


def pack(ids: np.ndarray) -> bytes:
    """Header (magic, tokens of each level), then for each level: chunks, bitmap, rank directory."""
    rest, levels, shift = np.ascontiguousarray(ids, np.uint32), [], 0
    for k, bits in enumerate(WIDTHS):
        goes_on = (rest >> np.uint32(bits)) != 0 if k + 1 < len(WIDTHS) else np.zeros(len(rest), bool)
        ones = np.add.reduceat(goes_on, np.arange(0, len(rest), RANK_BITS), dtype=np.int64) if len(rest) else np.zeros(0, np.int64)
        directory = (np.cumsum(ones) - ones).astype("<u4")
        levels.append(((rest & np.uint32((1 << bits) - 1)).astype(_chunk_type(bits)), np.packbits(goes_on, bitorder="little"), directory))
        rest, shift = rest[goes_on] >> np.uint32(bits), shift + bits
    return b"".join([MAGIC, struct.pack(f"<{len(WIDTHS)}I", *(len(x[0]) for x in levels)), *(a.tobytes() for x in levels for a in x)])


class Packed:
    """Reads tokens at any place of a packed sequence."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a packed token sequence")
        counts, at = struct.unpack_from(f"<{len(WIDTHS)}I", data, 4), 4 + 4 * len(WIDTHS)
        self.levels = []
        for n, bits in zip(counts, WIDTHS, strict=True):
            level = []
            for kind, size in ((_chunk_type(bits), n), ("<u1", -(-n // 8)), ("<u4", -(-n // RANK_BITS))):
                level.append(np.frombuffer(data, kind, size, at))
                at += level[-1].nbytes
            self.levels.append(level)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def rank(self, level: int, at: int) -> int:
        """Ones of the level's bitmap before ``at``."""
        chunks, bitmap, directory = self.levels[level]
        if at >= len(chunks):
            block = len(directory) - 1
            if block < 0:
                return 0
        else:
            block = at // RANK_BITS
        begin = block * RANK_BITS
        return int(directory[block]) + int(np.unpackbits(bitmap[begin // 8 : -(-at // 8)], bitorder="little")[: at - begin].sum())

    def __getitem__(self, at: int) -> int:
        value, shift = 0, 0
        for level, bits in enumerate(WIDTHS):
            value |= int(self.levels[level][0][at]) << shift
            if not self.levels[level][1][at >> 3] >> (at & 7) & 1:
                return value
            at, shift = self.rank(level, at), shift + bits
        return value

    def slice(self, begin: int, end: int) -> np.ndarray:
        """Tokens from ``begin`` to ``end``: two ranks a level, then one stretch of each level."""
        spans = []
        for level in range(len(WIDTHS)):
            spans.append((begin, end))
            begin, end = self.rank(level, begin), self.rank(level, end)
        value = np.zeros(0, np.uint32)
        for level in reversed(range(len(WIDTHS))):
            a, b = spans[level]
            chunks, bitmap, _ = self.levels[level]
            goes_on = np.unpackbits(bitmap[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            higher = np.zeros(b - a, np.uint32)
            higher[goes_on] = value
            value = chunks[a:b].astype(np.uint32) | higher << np.uint32(WIDTHS[level])
        return value


STORE = "shard long, n_docs long, n_tokens long, doc_ids binary, known binary, ends binary, payload binary, part int"


def ordered(df: DataFrame, doc_id: str = "doc_id", *then: str) -> DataFrame:
    """Documents dealt over range partitions of doc_id and sorted within each; rows of one id by a hash of the columns ``then``.

    So rows without an id, or of an id that many have, are several partitions; the driver samples ids and hashes alone.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ties = [F.xxhash64(*then)] if then else []
    return df.repartitionByRange(n, doc_id, *ties).sortWithinPartitions(doc_id, *ties, *then)


def write_tokens(df: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids", end_id: int | None = None, shard_tokens: int = SHARD_TOKENS, tokenizer_path: str | None = None) -> None:
    """Writes the ids (little-endian 32-bit, binary) of each document, in the order of ``ordered()`` partitions.

    ``end_id`` is appended to every document.  With ``tokenizer_path`` the column ``ids`` holds texts, which are encoded
    where they are packed.
    """
    tail = b"" if end_id is None else struct.pack("<I", end_id)

    def coded(column: pa.Array) -> Iterator[bytes | None]:
        if tokenizer_path is None:
            yield from column.to_pylist()
            return
        e = encoder(tokenizer_path)
        for at in range(0, len(column), ROWS_AT_ONCE):
            yield from (x.astype("<u4").tobytes() for x in e.encode_all(column.slice(at, ROWS_AT_ONCE).cast(pa.binary()).to_pylist()))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, docs, held, total = 0, [], [], 0

        def close() -> pa.RecordBatch:
            known = np.array([d is not None for d in docs], "<u1")
            values = [len(docs)], [total], [np.array([d or 0 for d in docs], "<i8").tobytes()], [known.tobytes()], [np.cumsum([len(x) // 4 for x in held]).astype("<i8").tobytes()], [pack(np.frombuffer(b"".join(held), "<u4"))]
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *(pa.array(v, pa.int64() if isinstance(v[0], int) else pa.binary()) for v in values)], ["shard", "n_docs", "n_tokens", "doc_ids", "known", "ends", "payload"])

        for batch in batches:
            for d, x in zip(batch.column(0).to_pylist(), coded(batch.column(1)), strict=True):
                docs.append(d)
                held.append((x or b"") + tail)
                total += len(held[-1]) // 4
                if total >= shard_tokens:
                    yield close()
                    n, docs, held, total = n + 1, [], [], 0
        if docs:
            yield close()

    rows = df.select(F.col(doc_id).cast("long"), F.col(ids)).mapInArrow(shards, STORE.rpartition(",")[0])
    rows.withColumn("part", F.spark_partition_id()).write.parquet(f"{path}/shards")
    sizes = df.sparkSession.read.schema(STORE).parquet(f"{path}/shards").groupBy("part", "shard").agg(F.sum("n_tokens").alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    # a row per written partition, then a row per shard of a partition: never rows of documents
    part_start = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("shard")) - F.col("n")
    starts = sizes.select("part", "shard", inside.alias("shard_start")).join(part_start, "part")
    starts.select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("before")).write.parquet(f"{path}/starts")


def write_texts(df: DataFrame, path: str, tokenizer_path: str, end_id: int | None = None, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes the texts and writes their ids in ascending doc_id order.

    The texts are ordered, not their ids: range partitioning runs what stands before it twice.
    """
    docs = ordered(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text")
    write_tokens(docs, path, ids="text", end_id=end_id, tokenizer_path=tokenizer_path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (tokens of all documents before), n_tokens, ids (binary) of each stored document."""
    shards = spark.read.schema(STORE).parquet(f"{path}/shards").select("part", "shard", "doc_ids", "known", "ends", "payload")
    # as a written table, the starts have a size that Spark can hold against its limit for broadcasts
    starts = spark.read.schema("part int, shard long, before long").parquet(f"{path}/starts")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                packed, ends = Packed(row["payload"]), np.frombuffer(row["ends"], "<i8")
                docs, known, begins = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["known"], "<u1"), np.concatenate([[0], ends[:-1]])
                ids = [packed.slice(a, b).astype("<u4").tobytes() for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, mask=known == 0), pa.array(begins + row["before"]), pa.array(ends - begins), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return shards.join(starts, ["part", "shard"]).mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")
