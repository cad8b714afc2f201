"""Token ids as binary shards in training order.

Documents become fixed windows of token ids. A keyed Feistel permutation with cycle-walking gives every window a
slot of the training order; ranges of slots are written as shards of records of one fixed stride, so slot s is
found at (s mod slots of a shard) times the stride, and a reader can go on from any slot. A broken run is resumed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, exists, few_rows, mix64, removed, shared_dir, small_batches
from .packing import END_ID, vocabulary

#: Ids of a window; two bytes each.
WINDOW = 1024
#: Byte that ends every record, the writer's line separator; readers skip it by the stride.
SEPARATOR = "\n"
#: A record: its slot (eight bytes, little-endian), by which a reader sees where it is, the ids and the separator.
HEAD = 8
STRIDE = HEAD + 2 * WINDOW + len(SEPARATOR)
#: Windows of a shard: 16 MB. At 100 TB a larger number keeps the folders fewer; a task holds one shard.
SHARD_SLOTS = 8192
#: Shards that a task writes where there are more shards than shuffle partitions, and shards whose numbers may be broadcast.
TASK_SHARDS, BROADCAST_SHARDS = 8, 1 << 22
ROUNDS = 4
#: Level at which windows are compressed where they are kept and shuffled, windows a task holds, and windows it compresses together.
BLOCK_LEVEL, HELD_WINDOWS, BLOCK_WINDOWS = 9, 8192, 64


def windows(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, vocabulary_name: str = "byte_bpe_50k.json", folder: str | None = None) -> DataFrame:
    """part, at, first_doc, start, n_ids and ids (16-bit little-endian) of the windows of each partition.

    The documents of a partition, each closed by ``end_id``, are one stream of ids that is cut every ``window``
    ids; the last window of a partition is filled with ``end_id``. first_doc is the document of the window's
    first id and start that id's place in it. Null and empty texts are ``end_id`` alone. No shuffle.
    """

    small_batches(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = vocabulary(vocabulary_name, folder), TaskContext.get().partitionId()
        held, n, at = [], 0, 0  # documents: id, ids left, ids before them

        def table(count: int, last: bool) -> pa.RecordBatch:
            nonlocal held, n, at
            ids = np.concatenate([x[1] for x in held])
            begun = np.concatenate([[0], np.cumsum([len(x[1]) for x in held])])
            full = ids[: count * window]
            if last and len(full) < count * window:
                full = np.append(full, np.full(count * window - len(full), end_id, dtype="<u2"))
            first = np.arange(count) * window
            owner = np.searchsorted(begun, first, side="right") - 1
            rows = {
                "part": np.full(count, part, dtype=np.int64),
                "at": np.arange(at, at + count, dtype=np.int64),
                "first_doc": pa.array([held[o][0] for o in owner], type=pa.int64()),
                "start": pa.array([int(f - begun[o]) + held[o][2] for f, o in zip(first.tolist(), owner.tolist())], type=pa.int64()),
                "n_ids": np.minimum(window, len(ids) - first).astype(np.int64),
                "ids": pa.array([full[f : f + window].tobytes() for f in first.tolist()], type=pa.binary()),
            }
            used = min(count * window, len(ids))
            k = int(np.searchsorted(begun, used, side="right")) - 1
            rest = held[k:]
            if rest and (gone := used - int(begun[k])):
                rest[0] = (rest[0][0], rest[0][1][gone:], rest[0][2] + gone)
            held, n, at = rest, len(ids) - used, at + count
            return pa.RecordBatch.from_arrays([pa.array(x) for x in rows.values()], names=list(rows))

        for batch in few_rows(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = words.encode(text) if text else []
                ids.append(end_id)
                held.append((doc_id, np.array(ids, dtype="<u2"), 0))
                n += len(ids)
                if n >= 256 * window:
                    yield table(n // window, False)
        if n:
            yield table(-(-n // window), True)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "part long, at long, first_doc long, start long, n_ids long, ids binary")


def half_bits(size: int) -> int:
    """Bits of half a block; a block holds ``size`` values, and less than four times as many."""
    return max(1, ((size - 1).bit_length() + 1) // 2)


def feistel(numbers: np.ndarray, size: int, key: int) -> np.ndarray:
    """The slots of ``numbers`` in a keyed permutation of 0..size-1.

    A value that leaves the range is permuted again until it is inside (cycle-walking); at most three of four
    values of a block are outside, so a walk ends after a few steps.
    """
    half = np.uint64(half_bits(size))
    low = (np.uint64(1) << half) - np.uint64(1)
    out = numbers.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        x = out[walking]
        left, right = x >> half, x & low
        for k in range(ROUNDS):
            left, right = right, left ^ (mix64(right * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key * 1_000_003 + k) & 0xFFFFFFFF)) & low)
        x = left << half | right
        out[walking] = x
        walking = walking[x >= np.uint64(size)]
    return out.astype(np.int64)


def permute(rows: DataFrame, number: str, size: int, key: int) -> DataFrame:
    """``rows`` with slot: the keyed permutation of the column ``number``, which counts from 0 to size-1."""

    @F.pandas_udf("long")
    def slot(numbers: pd.Series) -> pd.Series:
        return pd.Series(feistel(numbers.to_numpy(), size, key))

    return rows.withColumn("slot", slot(F.col(number)))


def _blocks(slots: DataFrame, shard_slots: int) -> DataFrame:
    """shard, slots and ids of the windows of one task and shard, compressed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=BLOCK_LEVEL).compress
        held: dict[int, list[tuple[int, bytes]]] = {}
        n = 0

        def table() -> pa.RecordBatch:
            parts = [(shard, x[k : k + BLOCK_WINDOWS]) for shard, x in sorted(held.items()) for k in range(0, len(x), BLOCK_WINDOWS)]
            rows = [(shard, np.array([s for s, _ in x], dtype="<i8").tobytes(), squeeze(b"".join(i for _, i in x))) for shard, x in parts]
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], names=["shard", "slots", "ids"])

        for batch in few_rows(batches):
            for slot, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(slot // shard_slots, []).append((slot, ids))
                n += 1
            if n >= HELD_WINDOWS:
                yield table()
                held, n = {}, 0
        if n:
            yield table()

    return slots.select("slot", "ids").mapInArrow(run, "shard long, slots binary, ids binary")


def _records(blocks: DataFrame) -> DataFrame:
    """value (slot and bytes of a window) and shard, by slot within each shard, of blocks that come shard by shard.

    A task holds one shard at a time, which has a fixed number of windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        held: list[tuple[bytes, bytes]] = []
        open_shard = None

        def shard_rows() -> Iterator[pa.RecordBatch]:
            slots = np.concatenate([np.frombuffer(x, dtype="<i8") for x, _ in held])
            ids = np.frombuffer(b"".join(expand(x) for _, x in held), dtype=np.uint8).reshape(len(slots), 2 * WINDOW)
            order = np.argsort(slots)
            for k in range(0, len(order), 1024):
                some = order[k : k + 1024]
                yield pa.RecordBatch.from_arrays([pa.array([slots[i].tobytes() + ids[i].tobytes() for i in some], type=pa.binary()), pa.array(np.full(len(some), open_shard, dtype=np.int64))], names=["value", "shard"])

        for batch in batches:
            for row in range(batch.num_rows):  # one by one: a batch of blocks is large
                shard, slots, ids = (batch.column(i)[row].as_py() for i in range(3))
                if held and shard != open_shard:
                    yield from shard_rows()
                    held = []
                open_shard = shard
                held.append((slots, ids))
        if held:
            yield from shard_rows()

    return blocks.select("shard", "slots", "ids").mapInArrow(run, "value binary, shard long")


def _files(spark: SparkSession, shards: str) -> DataFrame:
    """path, length, content and shard of the files of shards; shard is a partition column, so a filter on it prunes folders."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(shards)


def whole_shards(spark: SparkSession, shards: str, size: int, shard_slots: int) -> DataFrame | None:
    """shard of those that stand in full, found by their files' lengths; None without any. Broken ones are deleted."""
    if not exists(spark, shards) or "shard" not in _files(spark, shards).columns:
        return None
    wanted = F.least(F.lit(shard_slots), F.lit(size) - F.col("shard") * shard_slots) * STRIDE

    def listed() -> DataFrame:
        files = _files(spark, shards).select(F.col("shard").cast("long").alias("shard"), "path", "length")
        per = files.groupBy("shard").agg(F.sum("length").alias("bytes"), F.count("*").alias("files"), F.min("path").alias("path"))
        return per.withColumn("whole", (F.col("bytes") == wanted) & (F.col("files") == 1))

    broken = [r["path"].rsplit("/", 1)[0] for r in listed().where("not whole").select("path").toLocalIterator()]
    removed(spark, *broken)
    return listed().where("whole").select("shard")


def materialise(docs: DataFrame, path: str, key: int = 7, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Writes shards below ``path`` and returns slot, shard, byte_at, first_doc, start, n_ids, ids_crc32 of each window.

    Windows are made once and written below ``path``; their numbers in the corpus are offsets of the partitions. Shard
    k has the slots from k * shard_slots on, one file in the folder shard=k. Slots are a permutation of a known range,
    so ranges of shards are dealt to tasks directly, without a sample; windows are shuffled once, compressed.

    ``path`` is of one corpus. A run that broke is resumed by calling this again: windows that stand are used again, a
    task's shards stand once it is committed, and only shards that are missing or broken are written. What is returned
    of a window's ids is read back from the shards, so a record that isn't there has a null ids_crc32. An empty table
    gives no shard, and repeated rows are written as often as they come.
    """
    spark = docs.sparkSession
    target, shards = f"{path}/windows", f"{path}/shards-{key}-{shard_slots}"
    source = windows(docs)
    if not exists(spark, f"{target}/_SUCCESS"):
        source.write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(BLOCK_LEVEL)).parquet(target)
    made = spark.read.schema(source.schema).parquet(target)
    parts = sorted((r["part"], r["n"]) for r in made.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row a partition
    offsets = np.concatenate([[0], np.cumsum([n for _, n in parts])]).tolist()
    size = int(offsets[-1])
    if not size:
        return made.select(*[F.lit(0).cast("long").alias(c) for c in ("slot", "shard", "byte_at", "first_doc", "start", "n_ids", "ids_crc32")]).limit(0)
    begins = spark.createDataFrame([(p, o) for (p, _), o in zip(parts, offsets)], "part long, begin long")
    numbered = made.join(F.broadcast(begins), "part").withColumn("number", F.col("begin") + F.col("at"))
    slots = permute(numbered, "number", size, key)
    blocks = _blocks(slots, shard_slots)
    n_shards = -(-size // shard_slots)
    if (there := whole_shards(spark, shards, size, shard_slots)) is not None:
        blocks = blocks.join(F.broadcast(there) if n_shards <= BROADCAST_SHARDS else there, "shard", "left_anti")
    tasks = min(n_shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_shards // TASK_SHARDS)))
    dealt = blocks.repartitionById(tasks, F.floor(F.col("shard") * tasks / n_shards).cast("int")).sortWithinPartitions("shard")
    # Ids of 16 bits are no valid text; the text writer copies a string's bytes as they are.
    records = _records(dealt).select(F.col("value").cast("string").alias("value"), "shard")
    # Tasks' files are moved to their place one by one as tasks are committed, each shard being one file.
    records.write.mode("append").option("lineSep", SEPARATOR).option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("shard").text(shards)
    index = slots.select("slot", "first_doc", "start", "n_ids")
    return index.join(checked_shards(spark, shards), "slot", "left").select("slot", F.floor(F.col("slot") / shard_slots).cast("long").alias("shard"), ((F.col("slot") % shard_slots) * STRIDE).alias("byte_at"), "first_doc", "start", "n_ids", "ids_crc32")


def read_shards(spark: SparkSession, shards: str, from_slot: int = 0, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """slot and ids (array<int>) of the records from a slot on, read at their places by the fixed stride. Folders of shards before it aren't read."""
    files = _files(spark, shards).where(F.col("shard") >= from_slot // shard_slots).select(F.col("shard").cast("long").alias("shard"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                first = batch.column(0)[row].as_py() * shard_slots
                records = np.frombuffer(batch.column(1)[row].as_buffer(), dtype=np.uint8).reshape(-1, STRIDE)
                for k in range(max(0, from_slot - first), len(records), 1024):
                    ids = np.ascontiguousarray(records[k : k + 1024, HEAD : HEAD + 2 * WINDOW]).view("<u2").astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(ids) + 1) * WINDOW, WINDOW, dtype=np.int32)), pa.array(ids.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first + k, first + k + len(ids), dtype=np.int64)), lists], names=["slot", "ids"])

    return files.mapInArrow(run, "slot long, ids array<int>")


def checked_shards(spark: SparkSession, shards: str) -> DataFrame:
    """slot and ids_crc32 (of the bytes of its ids) of all records.

    Records are read one by one at the stride, by Spark's reader of fixed-length records, which has no DataFrame form;
    whole shards as values would need their size several times in memory.
    """

    def sums(records: Iterator[bytes]) -> Iterator[tuple[int, int]]:
        return ((int.from_bytes(r[:HEAD], "little"), zlib.crc32(r[HEAD : HEAD + 2 * WINDOW])) for r in records)

    found = spark.sparkContext.binaryRecords(f"{shards}/shard=*/part-*", STRIDE).mapPartitions(sums)
    return spark.createDataFrame(found, "slot long, ids_crc32 long", verifySchema=False)


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slots of all windows of documents, with the checksums of their ids as read back from the shards."""
    return materialise(documents(spark, sf_dir), f"{shared_dir(spark)}/token-output")
