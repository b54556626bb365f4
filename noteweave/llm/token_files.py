"""Token-id files whose blocks are bit-plane shuffled and compressed plane by plane.

The files are rows of Parquet, one row a block, so that any store that Spark can write
holds them and a lost task leaves nothing behind.  A shard is a range of ascending
document ids.  Its ids form one stream, cut freely into blocks of a fixed number of ids.
A block is transposed into planes: plane k of mode "byte" has byte k of every id, plane
k of mode "bit" has bit k of every id, eight to a byte.  Each plane is compressed with
zstandard by itself; high planes are constant and nearly vanish.  Beside its planes a
block has its place in the shard and the runs of documents in it: the chunk index.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import default_tokenizer, worker_bpe
from .common import give_back, shuffle_partitions, text_bytes

WIDTH = {"byte": 4, "bit": 32}
BLOCKS = (
    "shard int, block long, n_ids int, mode string, planes array<binary>, "
    "doc_id array<long>, doc_number array<long>, doc_from array<long>, doc_ids array<int>, ends array<boolean>"
)
_BLOCK_TYPES = pa.schema(
    [
        ("shard", pa.int32()),
        ("block", pa.int64()),
        ("n_ids", pa.int32()),
        ("mode", pa.string()),
        ("planes", pa.list_(pa.binary())),
        ("doc_id", pa.list_(pa.int64())),
        ("doc_number", pa.list_(pa.int64())),
        ("doc_from", pa.list_(pa.int64())),
        ("doc_ids", pa.list_(pa.int32())),
        ("ends", pa.list_(pa.bool_())),
    ]
)
PARTS = "shard int, doc_number long, doc_id long, doc_from long, n long, crc long"


def to_planes(ids: np.ndarray, mode: str = "byte", level: int = 3) -> list[bytes]:
    """Compressed planes of unsigned 32-bit ids, lowest first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if mode == "bit":
        raw = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
    else:
        raw = raw.T
    packer = zstandard.ZstdCompressor(level=level)
    return [packer.compress(np.ascontiguousarray(plane).tobytes()) for plane in raw]


def from_planes(planes: list[bytes], n: int, mode: str = "byte") -> np.ndarray:
    unpacker = zstandard.ZstdDecompressor()
    raw = [np.frombuffer(unpacker.decompress(p), np.uint8) for p in planes]
    if len(raw) != WIDTH[mode]:
        raise ValueError(f"{len(raw)} planes in a block of mode {mode}")
    if mode == "bit":
        bits = np.stack([np.unpackbits(p, count=n, bitorder="little") for p in raw], axis=1)
        return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")
    out = np.empty((n, 4), np.uint8)
    for k, plane in enumerate(raw):
        out[:, k] = plane
    return out.reshape(-1).view("<u4")


def crc32_combine(first: int, second: int, length: int) -> int:
    """crc32(a + b) from crc32(a), crc32(b) and len(b): `first` shifted past `length`
    zero bytes by repeated squaring of the polynomial step, as zlib defines it."""

    def times(matrix: list[int], vector: int) -> int:
        total, row = 0, 0
        while vector:
            if vector & 1:
                total ^= matrix[row]
            vector >>= 1
            row += 1
        return total

    step = [0xEDB88320] + [1 << k for k in range(31)]  # one zero bit
    for _ in range(3):
        step = [times(step, row) for row in step]  # one zero byte
    while length:
        if length & 1:
            first = times(step, first)
        step = [times(step, row) for row in step]
        length >>= 1
    return first ^ second


class _BlockWriter:
    """Cuts the stream of a shard into blocks."""

    def __init__(self, shard: int, block_ids: int, mode: str, level: int):
        self.shard, self.block_ids, self.mode, self.level = shard, block_ids, mode, level
        self.block = self.number = self.held = 0
        self.parts: list[np.ndarray] = []
        self.docs: list[tuple] = []
        self.rows: list[dict] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        done = 0
        while done < len(ids):
            n = min(len(ids) - done, self.block_ids - self.held)
            self.parts.append(ids[done : done + n])
            self.docs.append((doc_id, self.number, done, n, done + n == len(ids)))
            self.held += n
            done += n
            if self.held == self.block_ids:
                self.close()
        self.number += 1

    def close(self) -> None:
        if not self.held:
            return
        ids = np.concatenate(self.parts)
        names = ("doc_id", "doc_number", "doc_from", "doc_ids", "ends")
        row = {"shard": self.shard, "block": self.block, "n_ids": len(ids), "mode": self.mode}
        row |= {"planes": to_planes(ids, self.mode, self.level)}
        self.rows.append(row | dict(zip(names, map(list, zip(*self.docs, strict=True)), strict=True)))
        self.block += 1
        self.held, self.parts, self.docs = 0, [], []

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_pylist(self.rows, _BLOCK_TYPES)
        self.rows = []
        return out


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    end_id: int = 2,
    mode: str = "byte",
    block_ids: int = 1 << 17,
    level: int = 3,
    shards: int | None = None,
) -> None:
    """Encode every whole text, append end_id, and write the ids in ascending doc_id order.

    docs needs doc_id and text; other columns are ignored.  A null or empty text is the
    end id alone; null doc_ids come first; rows of one doc_id are documents of their own,
    ordered by a hash of their texts.  Shards are ranges of doc_id, so shard and then
    doc_number is the order of the whole corpus.  An empty table writes no blocks.
    """
    vocabulary = tokenizer or default_tokenizer()
    n_shards = shards or shuffle_partitions(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(vocabulary)
        writer = _BlockWriter(TaskContext.get().partitionId(), block_ids, mode, level)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            doc_ids, column = batch.column(0), batch.column(1)
            for a in range(0, batch.num_rows, 512):
                texts = [x.decode("utf-8", "replace") for x in column[a : a + 512].to_pylist()]
                for doc_id, ids in zip(doc_ids[a : a + 512].to_pylist(), bpe.encode(texts), strict=True):
                    writer.add(doc_id, np.concatenate((ids, end)))
                if len(writer.rows) >= 16:
                    yield writer.batch()
                    give_back()
        writer.close()
        yield writer.batch()
        give_back()

    order = ["doc_id", "tie"]
    rows = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(n_shards, *order).sortWithinPartitions(*order)
    blocks = ordered.select("doc_id", "text").mapInArrow(task, BLOCKS)
    blocks.write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold, one row for each run of a document in a block: shard, block,
    doc_number, doc_id, doc_from (ids of the document before the run) and ids (binary).
    Documents of one doc_id, or of none, differ in doc_number; files without blocks give
    no rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = from_planes(row["planes"], row["n_ids"], row["mode"]).tobytes()
                ends = np.cumsum(row["doc_ids"]).tolist()
                pieces = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends, row["doc_ids"], strict=True)]
                k = len(pieces)
                columns = [
                    pa.array([row["shard"]] * k, pa.int32()),
                    pa.array([row["block"]] * k, pa.int64()),
                    *(pa.array(row[c], pa.int64()) for c in ("doc_number", "doc_id", "doc_from")),
                    pa.array(pieces, pa.binary()),
                ]
                names = ["shard", "block", "doc_number", "doc_id", "doc_from", "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "shard int, block long, doc_number long, doc_id long, doc_from long, ids binary"
    return spark.read.parquet(path).mapInArrow(task, schema)


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone.

    Runs give partial checksums, which combine to those of whole documents; starts come
    from a running sum inside each shard on top of the totals of the shards before it.
    Repeated documents and null doc_ids have a row each; files of an empty table give none.
    """

    @F.arrow_udf("long")
    def combined(crcs: pa.Array, sizes: pa.Array) -> pa.Array:
        out = np.asarray(pc.list_element(crcs, 0)).copy()
        many = np.flatnonzero(np.asarray(crcs.value_lengths()) > 1)
        for i, own, n in zip(many.tolist(), crcs.take(many).to_pylist(), sizes.take(many).to_pylist(), strict=True):
            for crc, size in zip(own[1:], n[1:], strict=True):
                out[i] = crc32_combine(int(out[i]), crc, 4 * size)
        return pa.array(out, pa.int64())

    runs = read_token_files(spark, path).select(
        "shard", "doc_number", "doc_id", "doc_from", (F.octet_length("ids") / 4).cast("long").alias("n"), F.crc32("ids").alias("crc")
    )
    docs = runs.groupBy("shard", "doc_number").agg(
        F.first("doc_id").alias("doc_id"),
        F.sum("n").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("doc_from", "n", "crc"))).alias("parts"),
    )
    whole = docs.withColumn("ids_crc32", combined(F.col("parts.crc"), F.col("parts.n")))
    sizes = spark.read.parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # One row for each shard: as many as the writer had partitions.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard").orderBy("doc_number").rowsBetween(Window.unboundedPreceding, -1)
    return (
        whole.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(bases, "shard")
        .select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
    )
