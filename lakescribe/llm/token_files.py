"""Token ids in files: frequency-ranked ids in a byte-aligned variable-length coding with separate control bytes.

Each id is replaced by its rank in the corpus (0 for the most frequent), so common ids take one byte. A block holds
the ranks of consecutive documents: one control byte for every four ranks (two bits each: the number of
data bytes less one, the first rank in the lowest bits) and the data bytes, little-endian, without padding. Decoding looks
the four lengths up in a table by control byte, and is numpy throughout.

A file is a Parquet container (the one binary container that every Spark store can write and read) with a row per block:

    shard int, block int      ascending (shard, block) is ascending document id
    n_ids long                ids of all documents of the block
    ids array, counts array   document ids and the number of ids of each document
    control, data binary      the coded ranks

Beside it lies the rank table (rank, token, n), which has at most a row per vocabulary entry.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir, slices, text_of, written

#: Lengths of the four ranks of a control byte.
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.int64)
#: The ids of a block, at least (a document is never split).
BLOCK_IDS = 1 << 17


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(code) // 4) * 4, dtype=np.uint8)
    padded[: len(code)] = code
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    ends = np.cumsum(code, dtype=np.int64) + np.arange(1, len(code) + 1)
    data, places = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8), ends - code - 1
    data[places] = ranks.astype(np.uint8)
    for k in range(1, int(code.max(initial=0)) + 1):
        longer = np.flatnonzero(code >= k)
        data[places[longer] + k] = ranks[longer] >> 8 * k
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks that ``encode_ranks`` coded."""
    lengths = LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:n]
    values, places = np.frombuffer(data, dtype=np.uint8), np.cumsum(lengths) - lengths
    out = values[places].astype("<u4")
    for k in range(1, int(lengths.max(initial=0))):
        longer = np.flatnonzero(lengths > k)
        out[longer] |= values[places[longer] + k].astype("<u4") << 8 * k
    return out


def encoded(df: DataFrame, vocabulary: str, id_col: str, text_col: str, end_id: int | None) -> DataFrame:
    """(_id, _ids, _width, _counts), written once: the ids of each whole text as little-endian unsigned 32-bit or 16-bit integers, and a row more
    for each partition with nothing but the number of times that each id came there."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import SLICE_BYTES, SLICE_ROWS, encoder

        e = encoder(vocabulary)
        end = b"" if end_id is None else np.array([end_id], dtype=e.dtype).tobytes()
        total, kind = np.zeros(0, dtype=np.int64), None
        for batch in slices(batches, SLICE_ROWS, SLICE_BYTES):
            kind = batch.column("_id").type
            ids = e.encode_array(batch.column("_text"), end)
            n = np.bincount(e.ids(ids))
            if len(n) > len(total):
                n, total = total, n
            total[: len(n)] += n
            yield pa.RecordBatch.from_arrays([batch.column("_id"), ids, pa.array([e.width] * len(ids), pa.int8()), pa.nulls(len(ids), pa.binary())], names)
        # the worker lives on, beside those of later stages
        pa.default_memory_pool().release_unused()
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int8()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names)

    names = ["_id", "_ids", "_width", "_counts"]
    schema = T.StructType([T.StructField("_id", df.schema[id_col].dataType), T.StructField("_ids", T.BinaryType()), T.StructField("_width", T.ByteType()), T.StructField("_counts", T.BinaryType())])
    return written(df.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).mapInArrow(encode, schema), "ids")


def rank_table(ids: DataFrame) -> DataFrame:
    """(rank, token, n) of all ids of ``encoded``, most frequent first, ties by token. Only the partitions' counts are read."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("_counts").to_pylist():
                total = np.frombuffer(data, dtype="<i8")
                seen = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["token", "n"])

    counts = ids.select("_counts").filter("_counts IS NOT NULL").mapInArrow(spread, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return counts.select((F.row_number().over(Window.orderBy(F.desc("n"), "token")) - 1).alias("rank"), "token", "n")


def write_token_files(df: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = None) -> None:
    """Writes the ids of all whole texts to ``path``/blocks and the ranks to ``path``/ranks, in ascending id order.

    A null text is encoded as an empty one; ``end_id`` is appended to each document. A null id sorts first; rows that repeat an id
    stand next to each other in the order of their coded bytes, so that a rerun writes the same. An empty table writes empty tables.
    Documents are encoded once; what is sorted by id is the 16-bit ids, not the texts.
    """
    spark = df.sparkSession
    ids = encoded(df, vocabulary, id_col, text_col, end_id)
    rank_table(ids).write.parquet(f"{path}/ranks")
    # bounded by the vocabulary, whatever the corpus
    table = spark.read.parquet(f"{path}/ranks").select("token", "rank").toPandas()
    rank_of = np.zeros(int(table["token"].max()) + 1 if len(table) else 0, dtype=np.uint32)
    rank_of[table["token"].to_numpy()] = table["rank"].to_numpy()
    shared = spark.sparkContext.broadcast(rank_of)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block = TaskContext.get().partitionId(), 0
        docs, parts, size = [], [], 0
        ranks = shared.value

        def row():
            control, data = encode_ranks(ranks[np.concatenate(parts)])
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([size], pa.int64()), pa.array([docs], pa.list_(kind)), pa.array([[len(x) for x in parts]], pa.list_(pa.int64())),
                 pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                ["shard", "block", "n_ids", "ids", "counts", "control", "data"],
            )

        kind = None
        for batch in slices(batches):
            kind = batch.column("_id").type
            for doc, data, width in zip(batch.column("_id").to_pylist(), batch.column("_ids").to_pylist(), batch.column("_width").to_pylist()):
                docs.append(doc)
                parts.append(np.frombuffer(data, dtype=f"<u{width}"))
                size += len(parts[-1])
                if size >= BLOCK_IDS:
                    yield row()
                    docs, parts, size, block = [], [], 0, block + 1
        if docs:
            yield row()

    schema = T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("n_ids", T.LongType()), T.StructField("ids", T.ArrayType(ids.schema["_id"].dataType)),
        T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("control", T.BinaryType()), T.StructField("data", T.BinaryType()),
    ])
    by_id = ids.filter("_ids IS NOT NULL").select("_id", "_ids", "_width").repartitionByRange(F.col("_id").asc_nulls_first()).sortWithinPartitions(F.col("_id").asc_nulls_first(), "_ids")
    by_id.mapInArrow(blocks, schema).write.option("compression", "zstd").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Documents of the files: id, start (ids of all documents before it), n_tokens, ids_crc32 [, ids array<int>].

    ids_crc32 is the unsigned crc32 of the document's ids as little-endian unsigned 32-bit integers. Starts are summed
    within shards and over the shards' totals; only these numbers are shuffled, never coded bytes.
    """
    table = spark.read.parquet(f"{path}/ranks").select("token", "rank").toPandas()
    token_of = np.zeros(len(table), dtype="<u4")
    token_of[table["rank"].to_numpy()] = table["token"].to_numpy()
    shared = spark.sparkContext.broadcast(token_of)
    files = spark.read.parquet(f"{path}/blocks")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        for batch in slices(batches):
            for k in range(batch.num_rows):
                r = {name: batch.column(name)[k] for name in batch.schema.names}
                docs, counts = r["ids"].values, np.asarray(r["counts"].as_py(), dtype=np.int64)
                ids = tokens[decode_ranks(r["control"].as_py(), r["data"].as_py(), int(counts.sum()))]
                ends = np.cumsum(counts)
                own = [ids[e - c : e] for e, c in zip(ends.tolist(), counts.tolist())]
                n = len(counts)
                arrays = [docs, pa.array([r["shard"].as_py()] * n, pa.int32()), pa.array([r["block"].as_py()] * n, pa.int32()), pa.array(ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())]
                names = ["_id", "shard", "block", "_at", "n_tokens", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array([x.tolist() for x in own], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    kind = files.schema["ids"].dataType.elementType
    fields = [T.StructField("_id", kind), T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType())]
    fields += [T.StructField(x, T.LongType()) for x in ("_at", "n_tokens", "ids_crc32")] + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])
    docs = files.mapInArrow(decode, T.StructType(fields))

    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    before = shards.select("shard", F.coalesce(F.sum("_n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shard_start"))
    in_shard = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("shard", "block", F.coalesce(F.sum("n_ids").over(in_shard), F.lit(0)).alias("_block_start")).join(before, "shard")
    out = docs.join(starts, ["shard", "block"])
    return out.select(F.col("_id").alias(id_col), (F.col("_shard_start") + F.col("_block_start") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_files(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2) -> DataFrame:
    """``write_token_files`` to the shared folder, then ``read_token_files``."""
    path = f"{shared_dir(df.sparkSession)}/tables/tokens-{uuid.uuid4().hex}"
    write_token_files(df, path, vocabulary, id_col, text_col, end_id)
    return read_token_files(df.sparkSession, path, id_col)
