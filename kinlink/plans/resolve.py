"""Whole plans: exact names, votes, and the trained matcher."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocabulary import POLICY_DEFAULT
from ..operators import blocking, candidates, evaluation, features, model, similar
from ..sources import tables
from ..sources.shared import written


def resolve_exact(left: DataFrame, others: list[DataFrame], cap: int = 10, keep: int = 10, least: int = 3) -> DataFrame:
    """s1_id and matched_entity_ids (null without any) by equal cleaned names of one country.

    Names of fewer than ``least`` characters don't join; a name that joins more than ``cap`` pairs with a source is
    dropped for that source; an entity keeps its first ``keep`` candidates. Every entity has one row.
    """

    key = ["name", "country"]

    def cleaned(rows: DataFrame, as_: str) -> DataFrame:
        name = T.without_legal_forms(T.clean(F.col("business_name")))
        made = rows.select(F.col("entity_id").alias(as_), "country", name.alias("name")).where(F.length("name") >= least)
        return written(made)  # counted and then joined: names are cleaned once

    counted = lambda rows, n: rows.groupBy(*key).agg(F.count("*").alias(n))
    ours = cleaned(left, "s1_id")
    mine = counted(ours, "n_left")
    found = None
    for other in others:
        theirs = cleaned(other, "cand_id")
        # A name's pairs are counted from the counts of both sides, so those of a name that is too frequent are never made.
        pairs = mine.join(counted(theirs, "n_right"), key).withColumn("n", F.col("n_left") * F.col("n_right"))
        rare = pairs.groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") <= cap).select("name")
        some = ours.join(rare, "name", "left_semi").join(theirs.join(rare, "name", "left_semi"), key).select("s1_id", "cand_id")
        found = some if found is None else found.unionByName(some)
    per = found.groupBy("s1_id").agg(F.slice(F.array_sort(F.collect_set("cand_id")), 1, keep).alias("ids"))
    spine = left.select(F.col("entity_id").alias("s1_id"))
    return spine.join(per, "s1_id", "left").select("s1_id", F.when(F.size("ids") > 0, F.array_join("ids", ",")).alias("matched_entity_ids"))


def _posted(right: DataFrame, strategies: list[str] | None, cap: int | None, mode: str) -> DataFrame:
    """Postings of keyed records. Capped keys are written, as they are read three times."""
    keys = blocking.with_keys(right, strategies)
    return candidates.postings(keys if cap is None else written(keys), cap, mode)


def blocked(left: DataFrame, right: DataFrame, strategies: list[str] | None = None, cap: int | None = 15_000, mode: str = "truncate") -> DataFrame:
    """s1_id, cand_id, strategy of records of both sides that share a key."""
    return candidates.pairs(blocking.with_keys(left, strategies), _posted(right, strategies, cap, mode))


def voted(left: DataFrame, right: DataFrame, strategies: list[str] | None = None, cap: int | None = 15_000, mode: str = "truncate", top: int | None = None) -> DataFrame:
    """s1_id, cand_id, votes and strategies of records of both sides that share a key; with ``top`` the first of each s1_id with their rank."""
    names = blocking.strategy_names() if strategies is None else strategies
    if top is not None and cap is None:
        broad = [x for x in blocking.BROAD if x in names]
        narrow = [x for x in names if x not in broad]
        ours, theirs = (blocking.with_broad(x, broad) for x in (left, right))
        return candidates.first_counted(*(blocking.with_keys(x, narrow, broad, candidates.bits(names)) for x in (ours, theirs)), ours, theirs, names, broad, top)
    return candidates.counted(blocking.with_keys(left, strategies), _posted(right, strategies, cap, mode), names, top)


def first_alike(left: DataFrame, right: DataFrame, least: float, top: int = 40, ignored: list[str] = blocking.BROAD) -> DataFrame:
    """s1_id, cand_id and prob of the first ``top`` candidates of :func:`voted` (all strategies, no cap) whose prob reaches ``least``.

    prob is half the Jaccard similarity of the names' words, half that of the addresses'. Rows have a unique entity_id, country, name_tokens and
    addr_tokens (distinct words) and keys (``blocking.key_texts`` of all strategies). Pairs are found by their words and voted on by their keys. Most
    have so many votes that no ``top`` others can come before them; all candidates are ranked for the s1_ids of the rest.
    """
    names = sorted(blocking.strategy_names())
    words = ("name_tokens", "addr_tokens")
    side = lambda rows, id_, p: rows.select(F.col("entity_id").alias(id_), *[F.col(x).alias(f"{p}_{x}") for x in ("country", "keys", *words)])
    both = similar.alike(left, right, least, words).join(side(left, "s1_id", "l"), "s1_id").join(side(right, "cand_id", "r"), "cand_id").where("l_country = r_country")
    ratio = lambda x: T.set_ratio(F.col(f"l_{x}"), F.col(f"r_{x}"), "jaccard")
    scored = both.withColumn("prob", 0.5 * ratio(words[0]) + 0.5 * ratio(words[1])).where(F.col("prob") >= least)
    shared = F.array_distinct(F.transform(F.array_intersect("l_keys", "r_keys"), lambda x: F.substring(x, 1, 2)))
    found = written(scored.select("s1_id", "cand_id", "prob", F.size(shared).alias("votes")).where("votes > 0"))
    some = left.join(found.select(F.col("s1_id").alias("entity_id")).distinct(), "entity_id", "left_semi")
    keyed = similar.keyed_pairs(some, right, [f"{names.index(x):02d}" for x in ignored])
    told = written(found.join(keyed, "s1_id", "left").withColumn("sure", similar.surely_first(F.col("votes"), F.coalesce("n_keyed", F.lit(0)), len(ignored), top)))
    sure, rest = told.where("sure").select("s1_id", "cand_id", "prob"), told.where("not sure").select("s1_id", "cand_id", "prob")
    if rest.isEmpty():
        return sure
    asked = left.join(rest.select(F.col("s1_id").alias("entity_id")).distinct(), "entity_id", "left_semi")
    first = similar.first_by_keys(asked, right, top)
    return sure.unionByName(rest.join(first.select("s1_id", "cand_id"), ["s1_id", "cand_id"]))


def resolve_by_votes(left: DataFrame, right: DataFrame, strategies: list[str] | None = None, top: int = 40, sure: int = 3, least: int = 2, cap: int | None = 15_000) -> DataFrame:
    """s1_id, cand_id, votes that the vote rule accepts among the first ``top``."""
    first = voted(left, right, strategies, cap, top=top)
    return candidates.fallback(first, sure, least).select("s1_id", "cand_id", "votes")


def fit_matcher(left: DataFrame, right: DataFrame, truth: DataFrame, top: int = 50, negatives: int = 12, strategies: list[str] | None = None, preset: str = "matcher", **how) -> PipelineModel:
    """A matcher learned on retrieved true links and the hardest others of the entities of ``left`` (derived fields)."""
    found = voted(left, right, strategies)
    chosen = candidates.training_pairs(found, truth, top, negatives)
    pairs = chosen.join(found.select("s1_id", "cand_id", "strategies"), ["s1_id", "cand_id"])
    made = features.pair_features(features.paired(pairs, left, right)).join(chosen.select("s1_id", "cand_id", F.col("label").cast("double").alias("label")), ["s1_id", "cand_id"])
    return model.train(written(made), features.FEATURE_NAMES, **(model.PRESETS[preset] | how))


def run(left: DataFrame, right: DataFrame, matcher: PipelineModel, folder: str, policy: tuple[float, float, float] = POLICY_DEFAULT, top: int = 40, strategies: list[str] | None = None) -> DataFrame:
    """Candidates, scores and accepted links of all entities, written as the pair of output tables; the links with prob."""
    left, right = written(left), written(right)
    found = written(voted(left, right, strategies, top=top))
    scored = model.score(matcher, features.pair_features(features.paired(found, left, right))).select("s1_id", "cand_id", "prob")
    accepted = written(evaluation.apply_policy(scored, *policy).select("s1_id", "cand_id", "prob"))
    tables.write_outputs(left.select(F.col("entity_id").alias("s1_id")), accepted, found, folder)
    return accepted


def resolve(left: DataFrame, right: DataFrame, matcher: PipelineModel, policy: tuple[float, float, float], top: int = 40, strategies: list[str] | None = None) -> DataFrame:
    """s1_id, cand_id, prob that the policy accepts, of all countries in the data."""
    rows = features.pair_features(features.paired(voted(left, right, strategies, top=top), left, right))
    scored = model.score(matcher, rows).select("s1_id", "cand_id", "prob")
    return evaluation.apply_policy(scored, *policy)
