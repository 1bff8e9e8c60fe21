"""Training-order materialisation: a keyed permutation gives every sequence its slot, slots fill fixed-stride shards.

A Feistel network over the smallest even power of two that holds n, walked until it lands below
n, permutes 0..n-1 with no table: the order of any n follows from the key alone, a slot's place
in its shard is a multiplication, and reading can resume at any slot.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamis.llm import tokens
from tamis.llm._shared import save, sorted_runs, tidied
from tamis.session import ship

ROUNDS = 6
PART, MOST_PARTS = 8192, 50_000  # documents in a part of the numbering, and parts at most (larger ones then)


def _keys(key: str) -> list[np.uint64]:
    return [np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little")) for r in range(ROUNDS)]


def _mix(x: np.ndarray, key: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ key) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(29))


def permute(index: np.ndarray, n: int, key: str, back: bool = False) -> np.ndarray:
    """The slot of each index below ``n`` (or, ``back``, the index of each slot)."""
    half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = _keys(key)
    x = np.asarray(index, dtype=np.uint64).copy()
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> half, x[todo] & mask
        if back:
            for k in reversed(keys):
                left, right = right ^ (_mix(left, k) & mask), left
        else:
            for k in keys:
                left, right = right, left ^ (_mix(right, k) & mask)
        x[todo] = (left << half) | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def sequences(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, stride: int, end_id: int) -> DataFrame:
    """(id, piece, start, ids): each text's ids and the end id, cut every ``stride`` ids; ids little-endian, two bytes each.

    The documents are dealt and sorted by a hash of id and text, into a number of parts that
    follows from their count alone: so the order of the rows does not depend on how the input is split.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokens.load(tokenizer_path)
        if tokenizer.full.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary don't fit two bytes")
        for batch in batches:
            for lo, n in tokens.slices(batch.column(1)):
                ids, ends = tokens.encode(batch.column(1).slice(lo, n), tokenizer, end_id)
                begins = np.concatenate([[0], ends[:-1]])
                each = -(-(ends - begins) // stride)
                doc = np.repeat(np.arange(n), each)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
                first = begins[doc] + piece * stride
                last = np.minimum(first + stride, ends[doc])
                offsets = np.concatenate([2 * first, [2 * len(ids)]]).astype(np.int64)  # pieces follow one another without a gap
                data = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u2"))]).cast(pa.binary())
                assert len(doc) == 0 or int(last[-1]) == len(ids)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array((piece * stride).astype(np.int64)), data], names=["id", "piece", "start", "ids"])

    parts = min(MOST_PARTS, -(-docs.count() // PART) or 1)
    key = F.xxhash64("id", "text")
    dealt = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartition(parts, key).sortWithinPartitions(key, "id")
    return dealt.mapInArrow(tidied(run), f"id {kind}, piece int, start long, ids binary")


def in_training_order(made: DataFrame, key: str, per_shard: int) -> DataFrame:
    """A table written by ``save``, with the columns slot and shard: shards whole in a partition, sorted by slot.

    Rows are numbered by part (a file each) and place in it, which stay as they are once written; the
    parts' counts (a row a part) give where each begins. Only this numbering is windowed.
    """
    numbered = made.select("*", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long").alias("file"), F.col("_metadata.row_index").alias("nth"))
    files = numbered.groupBy("file").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    files = save(files.coalesce(1).select("file", F.coalesce(before, F.lit(0)).alias("base"), F.col("rows")))
    n = files.agg(F.sum("rows")).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = permute(batch.column("slot").to_numpy(), n, key)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(slot), pa.array(slot // per_shard)], names=[*batch.schema.names[:-1], "slot", "shard"])

    rows = numbered.join(files.drop("rows"), "file").select(*made.columns, (F.col("base") + F.col("nth")).alias("slot"))
    fields = ", ".join(f"{c} {t}" for c, t in made.dtypes)
    return rows.mapInArrow(tidied(run), f"{fields}, slot long, shard long").repartitionByRange("shard").sortWithinPartitions("shard", "slot")


def training_order(docs: DataFrame, tokenizer_path: str, key: str = "epoch-0", id_col: str = "doc_id", text_col: str = "text", stride: int = 2048, per_shard: int = 4096, end_id: int = 1) -> DataFrame:
    """(id, piece, start, ids, slot, shard) for every sequence, ready to be written shard by shard; the same for the same documents and key, however they are split into files.

    Null texts count as empty (the end id alone). Repeated and null ids keep all their rows, each
    in a slot of its own. Other columns aren't read; an empty table gives no rows. Slots are
    0..n-1 without a gap.
    """
    ship(docs.sparkSession)
    made = save(sequences(docs, tokenizer_path, id_col, text_col, stride, end_id), compression="zstd")
    return in_training_order(made, key, per_shard)


def write_shards(ordered: DataFrame, path: str, stride: int = 2048, per_shard: int = 4096, pad_id: int = 0) -> None:
    """Write (shard, first_slot, n, data): a row and a file a shard, its sequences padded to ``stride`` ids of two bytes, in slot order.

    Beside them stands what each record holds (id, piece, start, length; arrays in slot order).
    Parquet by Spark's own writer, so that any store will do and a lost task is written again.
    The shards are in ``path``/shards; ``path``/index says which file holds which shard, so that
    reading can begin at any slot without opening others.
    """
    kind = dict(ordered.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edges in sorted_runs(batches, ["shard"]):
            shard = rows.column("shard").to_numpy()
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                here = rows.slice(int(lo), int(hi - lo))
                data, length = np.full((hi - lo, stride), pad_id, dtype="<u2"), np.zeros(hi - lo, dtype=np.int64)
                for k, ids in enumerate(here.column("ids")):
                    x = np.frombuffer(ids.as_py(), "<u2")
                    data[k, : len(x)] = x
                    length[k] = len(x)
                about = [here.column(c).combine_chunks() for c in ("id", "piece", "start")] + [pa.array(length)]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x) for x in about]
                yield pa.RecordBatch.from_arrays([pa.array([int(shard[lo])]), pa.array([int(shard[lo]) * per_shard]), pa.array([int(hi - lo)]), pa.array([data.tobytes()]), *lists], names=["shard", "first_slot", "n", "data", "id", "piece", "start", "length"])

    made = ordered.select("shard", "slot", "ids", "id", "piece", "start").mapInArrow(tidied(run), f"shard long, first_slot long, n long, data binary, id array<{kind}>, piece array<int>, start array<long>, length array<long>")
    made.write.option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(f"{path}/shards")
    written = ordered.sparkSession.read.parquet(f"{path}/shards")
    written.select("shard", "first_slot", "n", F.col("_metadata.file_path").alias("file")).write.parquet(f"{path}/index")


def read_shards(spark: SparkSession, path: str, start: int = 0, stride: int = 2048, ahead: int = 64) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids with padding) from ``start`` on, a shard at a time; only the files of the shards that are needed are opened, in their order.

    The index is read ``ahead`` shards at a time.
    """
    index = spark.read.parquet(f"{path}/index")
    while True:
        some = index.where(F.col("first_slot") + F.col("n") > start).orderBy("first_slot").limit(ahead).collect()
        for told in some:
            row = spark.read.parquet(told.file).select("first_slot", "n", "data").first()
            data = np.frombuffer(row.data, "<u2").reshape(row.n, stride)
            for slot in range(max(start, row.first_slot), row.first_slot + row.n):
                yield slot, data[slot - row.first_slot]
            start = row.first_slot + row.n
        if len(some) < ahead:
            return


def digest(ordered: DataFrame, stride: int, per_shard: int, id_col: str = "doc_id") -> DataFrame:
    """What stands where: (id, piece, start, length, ids_crc32, slot, shard, byte_offset); the checksum is over 32-bit ids."""
    kind = dict(ordered.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.frombuffer(x, "<u2") for x in batch.column("ids").to_pylist()]
            slot = batch.column("slot").to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "piece", "start")), pa.array(list(map(len, raw)), pa.int64()), pa.array([zlib.crc32(x.astype("<u4")) for x in raw], pa.int64()), batch.column("slot"), batch.column("shard"), pa.array(slot % per_shard * stride * 2)], names=["id", "piece", "start", "length", "ids_crc32", "slot", "shard", "byte_offset"])

    return ordered.mapInArrow(tidied(run), f"id {kind}, piece int, start long, length long, ids_crc32 long, slot long, shard long, byte_offset long").withColumnRenamed("id", id_col)


def digest_shards(spark: SparkSession, path: str, stride: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """The columns of ``digest``, read off the records that ``write_shards`` wrote at ``path``."""
    shards = spark.read.parquet(f"{path}/shards")
    kind = shards.schema["id"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                about = [row.column(c).flatten() for c in ("id", "piece", "start", "length")]
                shard, first, n = (row.column(c)[0].as_py() for c in ("shard", "first_slot", "n"))
                data = np.frombuffer(row.column("data")[0].as_buffer(), "<u2").reshape(n, stride)
                crc = [zlib.crc32(data[i, :length].astype("<u4")) for i, length in enumerate(about[3].to_pylist())]
                place = np.arange(n, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([*about, pa.array(crc, pa.int64()), pa.array(first + place), pa.array(np.full(n, shard, dtype=np.int64)), pa.array(place * stride * 2)], names=["id", "piece", "start", "length", "ids_crc32", "slot", "shard", "byte_offset"])

    found = shards.select("shard", "first_slot", "n", "data", "id", "piece", "start", "length")
    return found.mapInArrow(tidied(run), f"id {kind}, piece int, start long, length long, ids_crc32 long, slot long, shard long, byte_offset long").withColumnRenamed("id", id_col)
