"""Samples and splits that depend on ids alone, so every run and cluster gets the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def place(key: str, seed: int) -> Column:
    """A seeded hash of an id, as hexadecimal text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows by the order of a seeded hash; ties by the key. Every task keeps its first ``n``."""
    return df.orderBy(place(key, seed), key).limit(n)


def disjoint_sample(df: DataFrame, taken: DataFrame, key: str, n: int, seed: int = 1337) -> DataFrame:
    """A sample of the rows whose key isn't in ``taken``."""
    return sample(df.join(taken.select(key), key, "left_anti"), key, n, seed)


def split(df: DataFrame, key: str, share: float = 0.75, seed: int = 42) -> DataFrame:
    """``df`` with is_train: all rows of a key fall on the same side."""
    return df.withColumn("is_train", F.conv(F.substring(place(key, seed), 1, 5), 16, 10).cast("long") < int(share * (1 << 20)))
