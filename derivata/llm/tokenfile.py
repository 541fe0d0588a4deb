"""Token files: ids as frequency ranks in byte-aligned variable-length code, with control bytes apart.

An id becomes its rank by frequency over the whole corpus (the commonest is 0; ties by id), written little-endian in
as few of 1 to 4 bytes as hold it. The lengths, less one, are two bits each, four to a control byte. So most tokens
take one byte and a quarter. Decoding looks each control byte up in a table of four lengths and gathers the bytes.

A dataset is a folder of three tables that Spark reads from any store:

- ``ranks``: rank, id. One row for each id in use, no more than the vocabulary has.
- ``ids``: blocks of documents in ascending order of document id (nulls first; equal ids by their tokens). Each row
  has part, place (the ids before it in its part), doc_ids, lengths (ids of each document), control and data (binary).
- ``parts``: part and n_ids, from which each part's first position follows.

Blocks hold whole documents, so each decodes by itself."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .cluster import cut, drop, new_path, write
from .words import released, slices

END_ID = 2
#: Ids in a block, about.
BLOCK_IDS = 1 << 18

_CODES = np.arange(256, dtype=np.uint8)
#: The four lengths of each control byte.
LENGTHS = np.stack([((_CODES >> (2 * i)) & 3) + 1 for i in range(4)], 1).astype(np.int64)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of an array of ranks."""
    x = ranks.astype("<u4")
    n = 1 + (x > 0xFF).astype(np.int64) + (x > 0xFFFF) + (x > 0xFFFFFF)
    padded = np.zeros(-(-len(x) // 4) * 4, np.uint8)
    padded[: len(x)] = n - 1
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    return control.tobytes(), x.view(np.uint8).reshape(-1, 4)[np.arange(4) < n[:, None]].tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    n = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    at = np.cumsum(n) - n
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    out = raw[at].astype(np.uint32)
    for i in range(1, 4):
        more = np.flatnonzero(n > i)
        if not len(more):
            break
        out[more] |= raw[at[more] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


def _width(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _encode(path: str, end_id: int):
    def rows(words, kind, batch):
        _, _, ids, cuts = bpe.encoded(words, batch.column(batch.schema.get_field_index("text")))
        ended = np.insert(ids, cuts[1:], end_id).astype(kind)
        stops = cuts + np.arange(len(cuts))
        binary = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((stops * ended.itemsize).astype(np.int32)), pa.py_buffer(ended.tobytes())])
        return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("k")), pa.array(np.diff(stops).astype(np.int64)), binary], names=["k", "n", "raw"])

    def run(batches):
        words = bpe.by_library(path)
        with released():
            kind = _width(max(len(words.lens), end_id + 1))
            for whole in batches:
                for batch in slices(whole, "text"):
                    yield rows(words, kind, batch)

    return run


def _tally(kind: str):
    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            column = batch.column(0)
            seen = np.bincount(np.frombuffer(b"".join(column.to_pylist()), kind))
            total = np.pad(total, (0, max(0, len(seen) - len(total))))
            total[: len(seen)] += seen
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(total[ids])], names=["id", "n"])

    return run


def _blocks(kind: str, rank_of: np.ndarray):
    def run(batches):
        held: list[tuple] = []
        size = place = 0
        own = pa.null()

        def block():
            nonlocal held, size, place
            ids = np.frombuffer(b"".join(x[2] for x in held), kind)
            control, data = pack(rank_of[ids])
            row = [[held[0][3]], [place], [[x[0] for x in held]], [[x[1] for x in held]], [control], [data]]
            held, size, place = [], 0, place + size
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int64(), pa.list_(own), pa.list_(pa.int64()), pa.binary(), pa.binary()), strict=True)], names=["part", "place", "doc_ids", "lengths", "control", "data"])

        for batch in batches:
            own = batch.schema.field("k").type
            for row in zip(*(batch.column(n).to_pylist() for n in ("k", "n", "raw", "part")), strict=True):
                held.append(row)
                size += row[1]
                if size >= BLOCK_IDS:
                    yield block()
        if held:
            yield block()

    return run


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID) -> None:
    """Encode every text (null: empty), end each with ``end_id``, and write the dataset to ``folder``.
    Ids of any type that has an order keep it; nulls come first, and repeated ids are in the order of their texts' lengths."""
    path = path or bpe.default_path()
    spark = docs.sparkSession
    size = max(bpe.library(path).get_vocab_size(with_added_tokens=True), end_id + 1)
    kind = _width(size)
    rows = docs.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").cast("string").alias("text"))
    own = rows.schema["k"].dataType.simpleString()
    coded, coded_path = cut(rows.mapInArrow(_encode(path, end_id), f"k {own}, n bigint, raw binary"), "coded")
    counts = coded.select("raw").mapInArrow(_tally(kind), "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    # No more rows than the vocabulary has ids.
    ranked = [r.id for r in counts.orderBy(F.desc("n"), "id").limit(size).collect()]
    write(spark.createDataFrame([(i, t) for i, t in enumerate(ranked)], "rank int, id int").coalesce(1), f"{folder}/ranks")
    rank_of = np.zeros(size, np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = coded.repartitionByRange(n, "k", "n", F.xxhash64("raw")).sortWithinPartitions("k", "n", F.xxhash64("raw")).withColumn("part", F.spark_partition_id())
    write(ordered.mapInArrow(_blocks(kind, rank_of), f"part int, place bigint, doc_ids array<{own}>, lengths array<bigint>, control binary, data binary"), f"{folder}/ids")
    blocks = spark.read.parquet(f"{folder}/ids")
    write(blocks.groupBy("part").agg(F.sum(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)")).alias("n_ids")).coalesce(1), f"{folder}/parts")
    drop(spark, coded_path)


def _decoded(id_of: np.ndarray, digests: bool):
    def run(batches):
        for batch in batches:
            own = batch.schema.field("doc_ids").type.value_type
            for start, docs, lengths, control, data in zip(*(batch.column(n).to_pylist() for n in ("start", "doc_ids", "lengths", "control", "data")), strict=True):
                ids = id_of[unpack(control, data, sum(lengths))]
                cuts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                columns = [pa.array(docs, own), pa.array(start + cuts[:-1]), pa.array(np.diff(cuts))]
                if digests:
                    raw = memoryview(ids.astype("<u4").tobytes())
                    columns.append(pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.int64()))
                else:
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32" if digests else "ids"])

    return run


def read_tokens(spark: SparkSession, folder: str, digests: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids), or ids_crc32 in place of ids, of a dataset that :func:`write_tokens` wrote.

    start counts the ids of all documents before. Only the ranks (one row an id) and the parts (one row a write task)
    come to the driver."""
    ranks = spark.read.parquet(f"{folder}/ranks").collect()
    id_of = np.zeros(len(ranks), np.uint32)
    for r in ranks:
        id_of[r["rank"]] = r.id
    # Positions of the parts by a running sum over one row a part.
    starts, total = [], 0
    for r in spark.read.parquet(f"{folder}/parts").orderBy("part").collect():
        starts.append((r.part, total))
        total += r.n_ids
    # One row a write task, so small enough to broadcast.
    first = F.broadcast(spark.createDataFrame(starts, "part int, first bigint"))
    blocks = spark.read.parquet(f"{folder}/ids")
    own = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    placed = blocks.join(first, "part").withColumn("start", F.col("first") + F.col("place"))
    last = "ids_crc32 bigint" if digests else "ids array<int>"
    return placed.select("start", "doc_ids", "lengths", "control", "data").mapInArrow(_decoded(id_of, digests), f"doc_id {own}, start bigint, n_tokens bigint, {last}")


def token_file_digests(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` and read them back: doc_id, start, n_tokens and ids_crc32 of each document."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-files")
    write_tokens(docs, folder)
    return read_tokens(spark, folder, digests=True)
