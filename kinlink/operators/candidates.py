"""Candidate pairs: capped postings, one equi-join over all strategies, votes and ranks."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["strategy", "country", "key"]
#: Parts of a key that has too many records.
HOT_PARTS = 64


def postings(keys: DataFrame, cap: int | None = 15_000, mode: str = "truncate") -> DataFrame:
    """strategy, country, key, cand_id of keyed candidate records.

    A key of over ``cap`` records keeps its first ``cap`` in the order of entity_id (``truncate``) or none
    (``drop``); without a cap every key keeps all. Sources are in their order, because ids begin with their source.
    """
    rows = keys.select(*KEY, F.col("entity_id").alias("cand_id"))
    if cap is None:
        return rows
    counts = rows.groupBy(*KEY).agg(F.count("*").alias("n"))  # combined before the shuffle, so hot keys cost little
    if mode == "drop":
        return rows.join(counts.where(F.col("n") <= cap), KEY, "left_semi")
    hot = counts.where(F.col("n") > cap).select(*KEY)
    cool = rows.join(counts.where(F.col("n") <= cap), KEY, "left_semi")
    # The first of a hot key are the first of the firsts of its parts, so no task sorts all of its records.
    part = F.pmod(F.xxhash64("cand_id"), F.lit(HOT_PARTS))
    first = lambda *by: F.row_number().over(Window.partitionBy(*KEY, *by).orderBy("cand_id"))
    some = rows.join(hot, KEY, "left_semi").withColumn("part", part).withColumn("r", first("part")).where(F.col("r") <= cap)
    return cool.unionByName(some.withColumn("r", first()).where(F.col("r") <= cap).drop("r", "part"))


def pairs(left_keys: DataFrame, posted: DataFrame) -> DataFrame:
    """s1_id, cand_id and strategy of records that share a key: one equi-join, never a condition with OR."""
    left = left_keys.select(*KEY, F.col("entity_id").alias("s1_id"))
    return left.join(posted, KEY).select("s1_id", "cand_id", "strategy").distinct()


def votes(found: DataFrame) -> DataFrame:
    """s1_id, cand_id, votes (strategies that found the pair) and their sorted names."""
    return found.groupBy("s1_id", "cand_id").agg(F.count("*").alias("votes"), F.array_sort(F.collect_set("strategy")).alias("strategies"))


def counted(left_keys: DataFrame, posted: DataFrame, strategies: list[str], top: int | None = None) -> DataFrame:
    """:func:`votes` of :func:`pairs` of the named strategies (63 at most), by one aggregation after one shuffle by s1_id; only the :func:`ranked` first ``top``, if given.

    A strategy is one bit, so a pair's strategies are a number: nothing is made distinct, no sets are collected, and
    what goes on by s1_id, as ranks do, needs no other shuffle.
    """
    names = sorted(strategies)
    tags = bits(names)
    bit = F.element_at(F.create_map(*[F.lit(x) for pair in tags.items() for x in pair]).cast("map<string,bigint>"), F.col("strategy")).alias("bit")
    left, right = left_keys.select(bit, "country", "key", F.col("entity_id").alias("s1_id")), posted.select(bit, "country", "key", "cand_id")
    found = left.join(right, ["bit", "country", "key"]).select("s1_id", "cand_id", F.col("bit").alias("mask"))
    return _voted(found, names, top)


def bits(strategies: list[str]) -> dict[str, int]:
    """The bit of each strategy (63 at most): its place in the sorted names."""
    if len(strategies) > 63:
        raise ValueError("more than 63 strategies")
    return {name: 1 << i for i, name in enumerate(sorted(strategies))}


def _voted(found: DataFrame, names: list[str], top: int | None) -> DataFrame:
    """Votes of s1_id, cand_id and mask, a number of the bits of strategies; only the first ``top``, if given."""
    masks = found.repartition("s1_id").groupBy("s1_id", "cand_id").agg(F.bit_or("mask").alias("mask")).withColumn("votes", F.bit_count("mask").cast("long"))
    kept = masks if top is None else ranked(masks, top)  # before the names are written out
    fired = F.filter(F.array(*[F.lit(x) for x in names]), lambda x, i: F.getbit("mask", i) == 1)
    return kept.withColumn("strategies", fired).drop("mask")


def first_counted(left_keys: DataFrame, right_keys: DataFrame, left: DataFrame, right: DataFrame, strategies: list[str], broad: list[str], top: int) -> DataFrame:
    """The :func:`ranked` first ``top`` of :func:`counted`, without the pairs of broad keys that can't be among them.

    ``left`` and ``right`` are records (unique entity_id, country) with a column for the one key of each ``broad`` strategy;
    the keyed records have the keys of all other strategies, written as their :func:`bits`, and those columns too. A pair that some other strategy finds
    is made there, and its broad strategies are told by comparing the columns. A pair that just the broad strategies of a set S
    find has as many votes as S has members; so have, at least, all records that share all keys of S with the s1_id, and if ``top`` of them
    come before it by cand_id, it isn't among the first. So of each combination of broad keys the first ``top`` records are enough,
    and every pair among the first has all its votes. Others may have fewer than they have, which moves them only further back.
    """
    names = sorted(strategies)
    tags = bits(names)
    as_ = lambda side: {name: f"{side}_{i}" for i, name in enumerate(broad)}

    def keyed(rows: DataFrame, id_: str) -> DataFrame:
        return rows.select(F.col("strategy").alias("bit"), "country", "key", F.col("entity_id").alias(id_), *[F.col(name).alias(x) for name, x in as_(id_[0]).items()])

    both = keyed(left_keys, "s1_id").join(keyed(right_keys, "cand_id"), ["bit", "country", "key"])
    shared = [F.when(F.col(as_("s")[name]) == F.col(as_("c")[name]), tags[name]).otherwise(0).cast("long") for name in broad]
    narrow = both.select("s1_id", "cand_id", sum(shared, F.col("bit")).alias("mask"))
    if not broad:
        return _voted(narrow, names, top)

    sets = [chosen for n in range(1, len(broad) + 1) for chosen in combinations(broad, n)]
    key = ["mask", "country", *as_("k").values()]

    def combined(rows: DataFrame, id_: str) -> DataFrame:
        """A row for each set of broad strategies of which the record has all keys; the others' are empty, which no key is."""
        entry = lambda chosen: F.when(F.concat(*[F.col(x) for x in chosen]).isNotNull(), F.struct(F.lit(sum(tags[x] for x in chosen)).cast("long").alias("mask"), *[(F.col(x) if x in chosen else F.lit("")).alias(k) for x, k in as_("k").items()]))
        entries = F.filter(F.array(*[entry(chosen) for chosen in sets]), lambda e: e.isNotNull())
        return rows.select(F.col("entity_id").alias(id_), "country", F.explode(entries).alias("e")).select(id_, "country", "e.*")

    place = F.dense_rank().over(Window.partitionBy(*key).orderBy("cand_id"))
    first = combined(right, "cand_id").withColumn("place", place).where(F.col("place") <= top).drop("place")
    return _voted(narrow.unionByName(combined(left, "s1_id").join(first, key).select("s1_id", "cand_id", "mask")), names, top)


#: Weights of the five indexes of the fast variant.
FAST_WEIGHTS = {"name": 4, "no_suffix": 3, "postal": 3, "token": 1, "prefix": 1}


def weighted_votes(found: DataFrame, weights: dict[str, int]) -> DataFrame:
    """s1_id, cand_id and score: the sum of the weights of the strategies that found the pair."""
    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return found.groupBy("s1_id", "cand_id").agg(F.sum(F.element_at(weight, F.col("strategy"))).alias("score"))


def fast_keys(rows: DataFrame, probe: bool = False) -> DataFrame:
    """entity_id, country, strategy, key of the five indexes over cleaned name and address columns.

    ``rows`` has entity_id, country (null: UNKNOWN), clean_name, no_suffix and postal. A record is indexed by its
    suffix-free name only where that differs from the name; the records that ``probe`` the index ask for it in any case.
    """
    name, length = F.col("clean_name"), F.length("clean_name")
    tok0 = F.get(F.split(name, " "), F.lit(0))
    keyed = {
        "name": name,
        "no_suffix": F.col("no_suffix") if probe else F.when(F.col("no_suffix") != name, F.col("no_suffix")),
        "token": F.when(F.length(tok0) >= 4, tok0),
        "postal": F.when(name != "", F.concat(F.col("postal"), F.lit("_"), F.substring(name, 1, 3))),
        "prefix": F.when(length >= 5, F.concat(F.substring(name, 1, 4), F.lit("_"), F.floor(length / 4).cast("string"))),
    }
    entries = F.array(*[F.struct(F.lit(k).alias("strategy"), v.alias("key")) for k, v in keyed.items()])
    country = F.coalesce("country", F.lit("UNKNOWN")).alias("country")
    return rows.select("entity_id", country, F.explode(F.filter(entries, lambda e: e["key"].isNotNull() & (e["key"] != ""))).alias("e")).select("entity_id", "country", "e.strategy", "e.key")


def ranked(scored: DataFrame, k: int, by: str = "votes") -> DataFrame:
    """The first ``k`` candidates of each s1_id, larger first, ties by cand_id, with rank."""
    order = Window.partitionBy("s1_id").orderBy(F.desc(by), "cand_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def default_rank(rank: Column, k: int = 50, default: int = 100) -> Column:
    return F.when(rank <= k, rank).otherwise(default)


def fallback(scored: DataFrame, sure: int = 3, least: int = 2) -> DataFrame:
    """All candidates of ``sure`` votes, else the first of an s1_id if it has ``least``."""
    one = Window.partitionBy("s1_id")
    out = scored.withColumn("top", F.max("votes").over(one)).withColumn("r", F.row_number().over(one.orderBy(F.desc("votes"), "cand_id")))
    return out.where((F.col("votes") >= sure) | ((F.col("top") < sure) & (F.col("r") == 1) & (F.col("votes") >= least))).drop("top", "r")


def training_pairs(scored: DataFrame, truth: DataFrame, top: int = 50, negatives: int = 12) -> DataFrame:
    """s1_id, cand_id, votes, rank, label: all retrieved true links, and the first ``negatives`` others of the top."""
    order = Window.partitionBy("s1_id").orderBy(F.desc("votes"), "cand_id")
    known = truth.select("s1_id", "cand_id").distinct().withColumn("label", F.lit(1))
    rows = scored.withColumn("place", F.row_number().over(order)).join(known, ["s1_id", "cand_id"], "left").fillna({"label": 0})
    rows = rows.where((F.col("label") == 1) | (F.col("place") <= top)).withColumn("n", F.row_number().over(Window.partitionBy("s1_id", "label").orderBy("place")))
    return rows.where((F.col("label") == 1) | (F.col("n") <= negatives)).select("s1_id", "cand_id", "votes", default_rank(F.col("place"), top).alias("rank"), "label")


def index_training_pairs(scored: DataFrame, truth: DataFrame, top: int = 20, recalled: int = 10) -> DataFrame:
    """s1_id, cand_id, score, rank, label: the first ``top``, then retrieved true links below them, at the score ``recalled``."""
    one = Window.partitionBy("s1_id")
    known = truth.select("s1_id", "cand_id").distinct().withColumn("label", F.lit(1))
    rows = scored.withColumn("place", F.row_number().over(one.orderBy(F.desc("score"), "cand_id"))).join(known, ["s1_id", "cand_id"], "left").fillna({"label": 0})
    kept = rows.where((F.col("place") <= top) | (F.col("label") == 1))
    score = F.when(F.col("place") <= top, F.col("score")).otherwise(recalled)
    return kept.withColumn("rank", F.row_number().over(one.orderBy("place"))).select("s1_id", "cand_id", score.alias("score"), "rank", "label")


def all_truth_training_pairs(scored: DataFrame, truth: DataFrame, top: int = 30) -> DataFrame:
    """s1_id, cand_id, votes, label: the first ``top`` and all true links, those that weren't retrieved with 0 votes."""
    known = truth.select("s1_id", "cand_id").distinct().withColumn("label", F.lit(1))
    return ranked(scored, top).select("s1_id", "cand_id", "votes").join(known, ["s1_id", "cand_id"], "full").fillna({"label": 0, "votes": 0})


# --- evaluation of strategies ---


def recall(truth: DataFrame, found: DataFrame) -> DataFrame:
    """source (S2, S3 or all), n_links, n_found and recall_pct of true links among the found pairs."""
    hits = truth.join(found.select("s1_id", "cand_id").distinct().withColumn("hit", F.lit(1)), ["s1_id", "cand_id"], "left")
    per = hits.withColumn("source", F.substring("cand_id", 1, 2)).rollup("source").agg(F.count("*").alias("n_links"), F.count("hit").alias("n_found"))
    return per.select(F.coalesce("source", F.lit("all")).alias("source"), "n_links", "n_found", F.round(100.0 * F.col("n_found") / F.col("n_links"), 4).alias("recall_pct"))


def by_strategy(truth: DataFrame, found: DataFrame) -> DataFrame:
    """strategy, n_pairs, n_links (true ones), n_unique (true links that no other strategy finds), links_per_1000."""
    alone = F.count("*").over(Window.partitionBy("s1_id", "cand_id"))
    marked = found.withColumn("finders", alone).join(truth.withColumn("hit", F.lit(1)), ["s1_id", "cand_id"], "left")
    out = marked.groupBy("strategy").agg(F.count("*").alias("n_pairs"), F.count("hit").alias("n_links"), F.count(F.when(F.col("finders") == 1, F.col("hit"))).alias("n_unique"))
    return out.withColumn("links_per_1000", F.round(1000.0 * F.col("n_links") / F.col("n_pairs"), 4))


def cumulative(truth: DataFrame, found: DataFrame, levels: dict[str, int]) -> DataFrame:
    """level, new_pairs, pairs_so_far, new_links, links_so_far: what each level of strategies adds to those before.

    A pair counts at its least level, so all levels come from one pass over the pairs.
    """
    level = F.element_at(F.create_map(*[F.lit(x) for p in levels.items() for x in p]), F.col("strategy"))
    first = found.groupBy("s1_id", "cand_id").agg(F.min(level).alias("level"))
    per = first.join(truth.withColumn("hit", F.lit(1)), ["s1_id", "cand_id"], "left").groupBy("level").agg(F.count("*").alias("new_pairs"), F.count("hit").alias("new_links"))
    so_far = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)  # a row a level
    return per.withColumns({"pairs_so_far": F.sum("new_pairs").over(so_far), "links_so_far": F.sum("new_links").over(so_far)})


def candidate_counts(spine: DataFrame, found: DataFrame) -> DataFrame:
    """Distribution of candidates an s1_id, those without any included."""
    per = spine.select("s1_id").join(found.select("s1_id", "cand_id").distinct().groupBy("s1_id").agg(F.count("*").alias("n")), "s1_id", "left").fillna({"n": 0})
    p = lambda q: F.percentile("n", F.lit(q))
    return per.agg(F.count("*").alias("n_entities"), F.avg("n").alias("mean"), p(0.5).alias("median"), p(0.9).alias("p90"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.max("n").alias("largest"))


def missed(truth: DataFrame, found: DataFrame) -> DataFrame:
    """True links that weren't found."""
    return truth.join(found.select("s1_id", "cand_id").distinct(), ["s1_id", "cand_id"], "left_anti")


def recovered(truth: DataFrame, found: DataFrame, baseline: list[str]) -> DataFrame:
    """strategy and n_recovered: true links that the baseline strategies miss."""
    base = found.where(F.col("strategy").isin(baseline))
    return missed(truth, base).join(found.where(~F.col("strategy").isin(baseline)), ["s1_id", "cand_id"]).groupBy("strategy").agg(F.count("*").alias("n_recovered"))
