"""Metrics of predicted links, decision policies and threshold searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import POLICY_ABSOLUTE, POLICY_DEFAULT, POLICY_GUARD, POLICY_RELATIVE, THRESHOLDS


def _f(tp: str, n_pred: str, n_true: str, beta: float = 0.5) -> dict:
    p, r, b = F.col(tp) / F.col(n_pred), F.col(tp) / F.col(n_true), beta * beta
    some = (F.col(tp) > 0) & (F.col(n_pred) > 0) & (F.col(n_true) > 0)
    none = (F.col(n_true) == 0) & (F.col(n_pred) == 0)
    return {
        "f": F.when(none, 1.0).when(some, (1 + b) * p * r / (b * p + r)).otherwise(0.0),
        "p": F.when(none, 1.0).when(F.col(n_pred) > 0, p).otherwise(0.0),
        "r": F.when(F.col(n_true) == 0, 1.0).otherwise(r),
    }


def entity_scores(spine: DataFrame, truth: DataFrame, predicted: DataFrame, beta: float = 0.5) -> DataFrame:
    """n_true, n_pred, tp, f, p, r of every s1_id of the spine, entities without links included.

    An entity without true links scores 1 if nothing is predicted, else 0. ``beta`` weighs recall against precision.
    """
    known = truth.select("s1_id", "cand_id").distinct()
    n_true = known.groupBy("s1_id").agg(F.count("*").alias("n_true"))
    hits = predicted.select("s1_id", "cand_id").distinct().join(known.withColumn("hit", F.lit(1)), ["s1_id", "cand_id"], "left")
    got = hits.groupBy("s1_id").agg(F.count("*").alias("n_pred"), F.count("hit").alias("tp"))
    out = spine.join(n_true, "s1_id", "left").join(got, "s1_id", "left").fillna(0, ["n_true", "n_pred", "tp"])
    return out.withColumns(_f("tp", "n_pred", "n_true", beta))


def source_scores(spine: DataFrame, truth: DataFrame, predicted: DataFrame, beta: float = 0.5) -> DataFrame:
    """source, n, macro_f, macro_p, macro_r: the mean scores on one source's links alone.

    An entity counts for a source if it has a true or a predicted link there.
    """
    known = truth.select("s1_id", "cand_id").distinct().withColumn("t", F.lit(1))
    guess = predicted.select("s1_id", "cand_id").distinct().withColumn("g", F.lit(1))
    rows = known.join(guess, ["s1_id", "cand_id"], "full").join(spine.select("s1_id").distinct(), "s1_id", "left_semi").withColumn("source", F.substring("cand_id", 1, 2))
    per = rows.groupBy("source", "s1_id").agg(F.count("t").alias("n_true"), F.count("g").alias("n_pred"), F.count(F.when(F.col("t").isNotNull() & F.col("g").isNotNull(), 1)).alias("tp"))
    return macro(per.withColumns(_f("tp", "n_pred", "n_true", beta)), ["source"])


def stratum():
    """Entities without true links (singleton) and with some (matched)."""
    return F.when(F.col("n_true") == 0, "singleton").otherwise("matched")


def bucket():
    return F.when(F.col("n_true") >= 5, "5+").otherwise(F.col("n_true").cast("string"))


def macro(scores: DataFrame, by: list[str]) -> DataFrame:
    """n and the means of f, p and r by the given columns (country, bucket, stratum, source, or none).

    What the order of a sum leaves in the last digits of a mean goes first, or a mean of five after the fourth digit would be rounded either way.
    """
    rows = scores.withColumns({"bucket": bucket(), "stratum": stratum()})
    aggregates = [F.count("*").alias("n"), *[F.round(F.round(F.avg(x), 12), 4).alias(f"macro_{x}") for x in ("f", "p", "r")]]
    return rows.groupBy(*by).agg(*aggregates) if by else rows.agg(*aggregates)


def micro_by_source(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """source, tp, fp, fn, precision, recall, f05 over all links of a source."""
    known = truth.select("s1_id", "cand_id").distinct().withColumn("t", F.lit(1))
    guess = predicted.select("s1_id", "cand_id").distinct().withColumn("g", F.lit(1))
    rows = known.join(guess, ["s1_id", "cand_id"], "full").withColumn("source", F.substring("cand_id", 1, 2))
    n = lambda cond: F.count(F.when(cond, 1))
    out = rows.groupBy("source").agg(n(F.col("t").isNotNull() & F.col("g").isNotNull()).alias("tp"), n(F.col("t").isNull()).alias("fp"), n(F.col("g").isNull()).alias("fn"))
    p = F.when(F.col("tp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    f = F.when(F.col("tp") > 0, 1.25 * p * r / (0.25 * p + r)).otherwise(0.0)
    return out.select("source", "tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f, 4).alias("f05"))


def apply_policy(scored: DataFrame, absolute: float = POLICY_DEFAULT[0], guard: float = POLICY_DEFAULT[1], relative: float = POLICY_DEFAULT[2]) -> DataFrame:
    """The links of scored pairs (s1_id, cand_id, prob) that a policy accepts.

    An entity is answered if its best probability reaches ``guard``; then all pairs of at least ``absolute`` and of at
    least ``relative`` times the best.
    """
    best = F.max("prob").over(Window.partitionBy("s1_id"))
    return scored.withColumn("best", best).where((F.col("best") >= guard) & (F.col("prob") >= absolute) & (F.col("prob") >= F.col("best") * relative)).drop("best")


def policy_grid(spine: DataFrame, truth: DataFrame, scored: DataFrame) -> DataFrame:
    """t_abs, t_guard, r_rel, macro_f of all policies of the grid: one join with the grid and one aggregation.

    Entities on which a policy predicts nothing are counted as a remainder, not made as rows.
    """
    spark = scored.sparkSession
    grid = spark.createDataFrame([(i * 20 + j * 4 + k, a, g, r) for i, a in enumerate(POLICY_ABSOLUTE) for j, g in enumerate(POLICY_GUARD) for k, r in enumerate(POLICY_RELATIVE)], "config int, t_abs double, t_guard double, r_rel double")
    known = truth.select("s1_id", "cand_id").distinct().withColumn("hit", F.lit(1))
    marked = scored.join(known, ["s1_id", "cand_id"], "left").withColumn("best", F.max("prob").over(Window.partitionBy("s1_id")))
    n_true = known.groupBy("s1_id").agg(F.count("*").alias("n_true"))
    totals = spine.join(n_true, "s1_id", "left").agg(F.count("*").alias("n"), F.count(F.when(F.col("n_true").isNull(), 1)).alias("singles"))
    kept = marked.join(F.broadcast(grid), (F.col("best") >= F.col("t_guard")) & (F.col("prob") >= F.col("t_abs")) & (F.col("prob") >= F.col("best") * F.col("r_rel")))
    per = kept.groupBy("config", "s1_id").agg(F.count("*").alias("n_pred"), F.count("hit").alias("tp")).join(n_true, "s1_id", "left").fillna(0, ["n_true"])
    sums = per.withColumns(_f("tp", "n_pred", "n_true")).groupBy("config").agg(F.sum("f").alias("f"), F.count(F.when(F.col("n_true") == 0, 1)).alias("answered_singles"))
    out = grid.join(sums, "config", "left").fillna(0).crossJoin(totals)
    return out.select("config", "t_abs", "t_guard", "r_rel", F.round((F.col("f") + F.col("singles") - F.col("answered_singles")) / F.col("n"), 6).alias("macro_f"))


def best_policy(grid: DataFrame) -> DataFrame:
    """The row of the largest macro_f; the first of the grid on a tie."""
    return grid.orderBy(F.desc("macro_f"), "config").limit(1)


def threshold_sweep(spine: DataFrame, truth: DataFrame, scored: DataFrame) -> DataFrame:
    """threshold and macro_f of accepting all pairs from a threshold on."""
    limits = scored.sparkSession.createDataFrame([(t,) for t in THRESHOLDS], "threshold double")
    kept = scored.join(F.broadcast(limits), F.col("prob") >= F.col("threshold")).select("threshold", "s1_id", "cand_id")
    known = truth.select("s1_id", "cand_id").distinct().withColumn("hit", F.lit(1))
    n_true = known.groupBy("s1_id").agg(F.count("*").alias("n_true"))
    per = kept.join(known, ["s1_id", "cand_id"], "left").groupBy("threshold", "s1_id").agg(F.count("*").alias("n_pred"), F.count("hit").alias("tp")).join(n_true, "s1_id", "left").fillna(0, ["n_true"])
    sums = per.withColumns(_f("tp", "n_pred", "n_true")).groupBy("threshold").agg(F.sum("f").alias("f"), F.count(F.when(F.col("n_true") == 0, 1)).alias("answered"))
    totals = spine.join(n_true, "s1_id", "left").agg(F.count("*").alias("n"), F.count(F.when(F.col("n_true").isNull(), 1)).alias("singles"))
    return limits.join(sums, "threshold", "left").fillna(0).crossJoin(totals).select("threshold", F.round((F.col("f") + F.col("singles") - F.col("answered")) / F.col("n"), 6).alias("macro_f"))


def errors(spine: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """kind (false_positive, false_negative, false_singleton) and n."""
    known, guess = truth.select("s1_id", "cand_id").distinct(), predicted.select("s1_id", "cand_id").distinct()
    fp = guess.join(known, ["s1_id", "cand_id"], "left_anti").agg(F.lit("false_positive").alias("kind"), F.count("*").alias("n"))
    fn = known.join(guess, ["s1_id", "cand_id"], "left_anti").agg(F.lit("false_negative").alias("kind"), F.count("*").alias("n"))
    fs = known.select("s1_id").distinct().join(guess.select("s1_id").distinct(), "s1_id", "left_anti").agg(F.lit("false_singleton").alias("kind"), F.count("*").alias("n"))
    return fp.unionByName(fn).unionByName(fs)
