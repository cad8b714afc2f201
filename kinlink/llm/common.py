"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch, and of what Python works on at once. Texts are far longer than usual cells.
BATCH_ROWS = 400


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Has Spark send few rows in a batch where the session has its default; a value of the caller's own stays.

    Spark reads the setting when a plan runs, so it can't be set for one lazy DataFrame alone.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of at most ``rows``, without empty ones."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only a session on one machine may lack the setting; it gets a temporary folder that goes when the driver ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext.getCheckpointDir()
        root = found.rsplit("/", 1)[0] if found else None
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="kinlink-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        root = f"file://{local}"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/kinlink-{uuid.uuid4().hex}"


def _file(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in any store that Spark reads."""
    store, found = _file(spark, path)
    return store.exists(found)


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes folders of intermediate tables that nothing reads any more."""
    for path in paths:
        store, found = _file(spark, path)
        store.delete(found, True)


def written(df: DataFrame, path: str, compression: str = "zstd") -> DataFrame:
    """The table written at ``path`` and read again: lineage ends there and outlives executors."""
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def arrow_map(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict | pa.RecordBatch | None]]) -> DataFrame:
    """``mapInArrow`` with state built once a task.

    ``make()`` runs on the executor and returns the function of one batch. It gives a dict of columns in
    the order of ``schema``, or a record batch, or None for no rows.
    """
    names_types = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(names_types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in few_rows(batches):
            out = step(batch)
            if out is None:
                continue
            if isinstance(out, dict):
                out = pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=target.field(k).type) for k, x in out.items()], schema=target)
            yield out

    return df.mapInArrow(run, schema)


# Bytes that are no part of a word: ASCII other than digits and letters.
_BREAKS = bytes(0x20 if (b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F) else b for b in range(256))


def ascii_words(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_BREAKS).split()


def folded_words(text: str) -> list[bytes]:
    """The same words after Unicode lower-casing."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_BREAKS).split()


_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingles(text: str, width: int = 5) -> np.ndarray:
    """64-bit hashes of all windows of ``width`` folded words, one for each place.

    A text with fewer words has one shingle of all its words; a text without words has one shingle of
    the text itself, so that only equal texts of that kind agree.
    """
    words = folded_words(text)
    if len(words) < width:
        data = b"\x01" + b" ".join(words) if words else b"\x02" + text.encode("utf-8", "surrogatepass")
        return np.array([xxhash.xxh3_64_intdigest(data)], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(words) - width + 1
    out = h[:n] * _MULT[0]
    for k in range(1, width):
        out += h[k : k + n] * _MULT[k % len(_MULT)]
    return mix64(out)


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """A vocabulary file of the installed public tokenizers, or of ``folder``."""
    if folder is not None:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
