"""Document fingerprints: bottom-k sketches of shingle hashes.

A fingerprint holds the k smallest distinct 64-bit hashes of a text's shingles of five words. Sketches of parts
merge to the sketch of the whole, and two sketches estimate resemblance, containment and distinct shingles.
"""

from __future__ import annotations

import base64
import collections
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, few_rows, shingles, small_batches

K = 128


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes, ascending."""
    if len(hashes) > 4 * k:
        # Copies of one hash can fill any fixed number of places, so the cut widens until k distinct ones are found.
        want = 2 * k
        while want < len(hashes):
            low = np.unique(np.partition(hashes, want)[:want])
            if len(low) >= k:
                return low[:k]
            want *= 4
    return np.unique(hashes)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of what two sketches were made from."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity: the share of the union's sketch that is in both. 1 for two empty sketches."""
    union = merge(a, b, k)
    if not len(union):
        return 1.0
    return float(np.isin(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True).sum() / len(union))


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that are in b: intersection over a's count."""
    n = distinct_count(a, k)
    return min(1.0, resemblance(a, b, k) * distinct_count(merge(a, b, k), k) / n) if n else 1.0


def fingerprint(text: str | None, k: int = K) -> np.ndarray:
    return sketch(shingles(text or ""), k)


def to_string(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8", copy=False).tobytes()).decode()


def from_string(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), dtype="<u8")


def fingerprint_documents(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, fingerprint and n_shingles (estimated distinct shingles) of every whole text.

    Null and empty texts have the fingerprint of the empty text, and equal texts equal ones. Repeated rows give
    repeated rows. Only doc_id and text are read; no shuffle.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            found = [fingerprint(t, k) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(to_string, found), type=pa.string()), pa.array([distinct_count(x, k) for x in found])], names=["doc_id", "fingerprint", "n_shingles"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string, n_shingles double")


#: Bytes of text of a block of consecutive documents, and the largest accuracy of the percentiles that limit blocks.
BLOCK_BYTES, ACCURACY = 256 << 20, 1 << 20


def with_next(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, ahead, doc_id, text: the documents by descending doc_id in blocks, each closed by the next one's head.

    Rows of one doc_id are ordered by a hash of their text, then by text; null ids come last. A block is a range of
    that order of about ``block_bytes`` bytes and one partition; an id whose rows fill several blocks is divided by the
    hash. A block's last row (ahead is true) is a copy of the first document of the following block, or of the first
    document of all after the last block. Texts are shuffled once; the block limits (percentiles of the ids) and heads
    are as many as there are blocks, so the driver holds no list of documents.
    """
    spark = docs.sparkSession
    least = -(1 << 63)
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.coalesce(doc_id, F.lit(least)).alias("place"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // block_bytes))
    limits = rows.agg(F.percentile_approx("place", [i / wanted for i in range(1, wanted)], min(20 * wanted, ACCURACY))).first()[0] if wanted > 1 else None
    # Blocks count from the largest ids down; a limit belongs to the block above it. A limit that comes several times
    # is an id of several blocks: its rows make as many blocks of their own.
    counts = collections.Counter(limits or [])
    edges = np.array(sorted(counts), dtype=np.int64)
    shares = np.array([counts[e] for e in edges.tolist()], dtype=np.int64)
    first = np.concatenate([np.cumsum(shares[::-1])[::-1], [0]])  # block of the ids from an edge on: as many as the limits above

    @F.pandas_udf("long")
    def block_of(places: pd.Series, hashes: pd.Series) -> pd.Series:
        x = places.to_numpy()
        k = np.searchsorted(edges, x, side="right")
        block = first[k]
        if len(edges):
            own = (k > 0) & (edges[np.maximum(k - 1, 0)] == x)
            share = np.where(own, shares[np.maximum(k - 1, 0)], 1)
            part = ((hashes.to_numpy() >> 1) + (1 << 62)).astype(np.float64) / 2.0**63 * share
            block = block + np.where(own, np.minimum(part.astype(np.int64), share - 1), 0)
        return pd.Series(block)

    rows = rows.withColumn("hash", F.xxhash64("text"))
    rows = rows.withColumn("block", block_of("place", "hash"))
    # The head of each block: its largest id, and of that id the row that comes first.
    heads = {r["block"]: r["head"] for r in rows.groupBy("block").agg(F.max("place").alias("head")).collect()}
    full = sorted(heads)
    held = [(int(b), int(heads[b]), int(full[i - 1])) for i, b in enumerate(full)]  # the block before full[0] is the last one
    out = rows.select("block", F.lit(False).alias("ahead"), "doc_id", "hash", "text")
    if held:
        head = spark.createDataFrame(held, "block long, place long, closes long")
        small = rows.join(F.broadcast(head), ["block", "place"])
        ends = small.groupBy("closes", "place").agg(F.min(F.struct("hash", "text")).alias("top"))
        out = out.unionByName(ends.select(F.col("closes").alias("block"), F.lit(True).alias("ahead"), F.col("place").alias("doc_id"), "top.hash", "top.text"))
    blocks = (full[-1] if full else 0) + 1
    dealt = out.repartitionById(int(blocks), F.col("block").cast("int"))
    return dealt.sortWithinPartitions("block", "ahead", F.desc_nulls_last("doc_id"), "hash", "text").select("block", "ahead", "doc_id", "text")


def edit(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def compare_edited(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited and near_next of every text.

    The next document is the one after it by descending doc_id; after the last comes the first, so a single
    document is its own next. Null texts are empty. Repeated rows give repeated rows: they follow each other.
    """
    small_batches(docs.sparkSession)
    names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # block, doc_id, text and sketch of the row before
        for batch in few_rows(batches):
            out = []
            for block, ahead, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                own = fingerprint(text, k)
                if held is not None and held[0] == block:
                    _, before, was, mine = held
                    changed = edit(was, text)
                    new = fingerprint(changed, k) if changed != was else mine
                    out.append((before, len(was), changed, to_string(mine), to_string(new), resemblance(mine, new, k), resemblance(mine, own, k)))
                held = None if ahead else (block, doc_id, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    schema = pa.schema([(names[0], pa.int64()), (names[1], pa.int64()), *((x, pa.string()) for x in names[2:5]), *((x, pa.float64()) for x in names[5:])])
    return with_next(docs).select("block", "ahead", "doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts of documents and of their edited texts, and their likeness."""
    found = compare_edited(documents(spark, sf_dir))
    return found.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
