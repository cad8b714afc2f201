"""Findings on output tables of entity and comma-joined candidate ids, as (rule, severity, n, examples)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_lines(lines: DataFrame, header: tuple[str, str]) -> DataFrame:
    """line, s1_id and ids of raw lines (column value); the header line is left out, a line without a tab has null ids."""
    at = F.locate("\t", F.col("value"))
    wanted = "\t".join(header)
    rows = lines.where(F.lower(F.trim("value")) != wanted.lower())
    return rows.select(F.col("value").alias("line"), F.when(at > 0, F.substring("value", F.lit(1), at - 1)).otherwise(F.col("value")).alias("s1_id"), F.when(at > 0, F.substring("value", at + 1, F.length("value"))).alias("joined"))


def header_finding(lines: DataFrame, header: tuple[str, str]) -> DataFrame:
    """One row if no line is the header: whether the table is empty, comma-separated or has another header."""
    wanted = "\t".join(header).lower()
    one = lines.agg(F.count("*").alias("all"), F.count(F.when(F.lower(F.trim("value")) == wanted, 1)).alias("good"), F.count(F.when(F.contains(F.lower("value"), F.lit(",".join(header).lower())), 1)).alias("csv"))
    kind = F.when(F.col("all") == 0, "empty").when(F.col("csv") > 0, "comma_separated").otherwise("wrong_header")
    return one.where(F.col("good") == 0).select(kind.alias("rule"), F.lit("error").alias("severity"), F.lit(1).cast("long").alias("n"), F.array().cast("array<string>").alias("examples"))


def _finding(rows: DataFrame, rule: str, example: Column, severity: str = "error") -> DataFrame:
    """A row if there are any: the number of distinct examples, and the first five."""
    found = rows.select(example.alias("e")).distinct()
    first = found.orderBy("e").limit(5).agg(F.array_sort(F.collect_list("e")).alias("examples"))
    return found.agg(F.count("*").alias("n")).where("n > 0").crossJoin(first).select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "n", "examples")


def validate(rows: DataFrame, required: DataFrame, known: DataFrame | None = None, superset: DataFrame | None = None) -> DataFrame:
    """rule, severity, n, examples of rows (line, s1_id, joined) against the entities that are required.

    Joined ids are split at commas; blanks are no id. ``known`` (cand_id) turns on the check of unknown ids, and
    ``superset`` (s1_id, cand_id) the warning on links that aren't among the candidates.
    """
    good = rows.where(F.col("joined").isNotNull())
    ids = good.select("s1_id", F.explode(F.filter(F.transform(F.split("joined", ","), lambda x: F.trim(x)), lambda x: x != "")).alias("cand_id"))
    pair = F.concat_ws(">", "s1_id", "cand_id")
    self_match = F.startswith(F.col("cand_id"), F.lit("S1-"))
    good_prefix = F.startswith(F.col("cand_id"), F.lit("S2-")) | F.startswith(F.col("cand_id"), F.lit("S3-"))
    out = [
        _finding(rows.where(F.col("joined").isNull()), "malformed_row", F.col("line")),
        _finding(good.groupBy("s1_id").agg(F.count("*").alias("n")).where("n > 1"), "repeated_entity", F.col("s1_id")),
        _finding(ids.groupBy("s1_id", "cand_id").agg(F.count("*").alias("n")).where("n > 1"), "repeated_id", pair),
        _finding(ids.where(self_match), "self_match", pair),
        _finding(ids.where(~self_match & ~good_prefix), "bad_prefix", pair),
        _finding(required.select("s1_id").join(good.select("s1_id"), "s1_id", "left_anti"), "missing_entity", F.col("s1_id")),
        _finding(good.select("s1_id").join(required.select("s1_id"), "s1_id", "left_anti"), "extra_entity", F.col("s1_id")),
    ]
    if known is not None:
        out.append(_finding(ids.where(good_prefix).join(known.select("cand_id"), "cand_id", "left_anti"), "unknown_id", pair))
    if superset is not None:
        out.append(_finding(ids.join(superset.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti"), "not_a_candidate", pair, "warning"))
    total = out[0]
    for x in out[1:]:
        total = total.unionByName(x)
    return total
