"""Pairs of records that are alike, and which of them are among the first candidates, without making and ranking all candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .candidates import ranked
from .records import settled

#: Hash buckets in which words are counted, to tell rare ones.
BUCKETS = 1 << 14
#: What floating point may lack to a threshold.
SLACK = 1e-6


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _places(words: DataFrame) -> Column:
    """The place of each bucket by the words (w) in it, fewest first: an array that is folded to a literal."""
    seen = dict(words.groupBy(_bucket(F.col("w")).alias("b")).count().collect())  # one row a bucket at most
    place = {b: i for i, b in enumerate(sorted(range(BUCKETS), key=lambda b: (seen.get(b, 0), b)))}
    return F.split(F.lit(",".join(str(place[b]) for b in range(BUCKETS))), ",").cast("array<bigint>")


def _most(n: str, b: str) -> Column:
    """The largest Jaccard similarity of sets of these sizes (l and r, column ``n``) whose words are these bits (column ``b``)."""
    l, r, x, y = F.col(f"l_{n}"), F.col(f"r_{n}"), F.col(f"l_{b}"), F.col(f"r_{b}")
    both = F.least(l - F.bit_count(x.bitwiseAND(F.bitwise_not(y))), r - F.bit_count(y.bitwiseAND(F.bitwise_not(x))))
    return both / (l + r - both)


def alike(left: DataFrame, right: DataFrame, least: float, columns: tuple[str, str] = ("name_tokens", "addr_tokens"), lean: float = 0.1) -> DataFrame:
    """s1_id and cand_id of records of one country of which the mean of two Jaccard similarities may reach ``least``; no pair that does is left out.

    ``columns`` are arrays of distinct words, of tens at most. As ``least`` is above 0.5, neither may be empty, and the first similarity is
    at least ``least - lean`` or the second ``least + lean``. Two sets that are so alike share one of their rarest words, whatever
    order tells rare words, and how many words that are follows from both sizes: just those are keys, once for every size that a
    partner may have. Pairs that share a key go on unless their words, as 64 bits, rule the threshold out.
    """
    if not least > 0.5 or not 0 <= lean < min(least, 1 - least):
        raise ValueError("least must be above 0.5, lean below it and below what it lacks to 1")
    limits = (least - lean - SLACK, least + lean - SLACK)
    rows = left.select("entity_id", "country", F.lit(True).alias("ours"), *columns).unionByName(right.select("entity_id", "country", F.lit(False).alias("ours"), *columns))
    rows = rows.where((F.size(columns[0]) > 0) & (F.size(columns[1]) > 0))
    places = _places(rows.select(F.explode(F.concat(*columns)).alias("w")))
    code = lambda w: F.shiftleft(F.get(places, _bucket(w)), 44).bitwiseOR(F.xxhash64(w).bitwiseAND(F.lit((1 << 44) - 1)))
    bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), w.bitwiseAND(F.lit(63)).cast("int"))

    def keys(i: int, own_first: bool) -> Column:
        share, n = limits[i], F.col(f"n{i}")

        def of_size(other: Column) -> Column:
            common = F.ceil(F.lit(share / (1 + share)) * (n + other) - F.lit(SLACK)).cast("int")
            sizes = (n, other) if own_first else (other, n)
            return F.transform(F.slice(f"w{i}", F.lit(1), n - common + 1), lambda w: F.xxhash64(F.lit(i), "country", *sizes, w))

        others = F.sequence(F.greatest(F.ceil(n * share), F.lit(1)).cast("int"), F.floor(n / share).cast("int"))
        return F.flatten(F.transform(others, of_size))

    def keyed(own_first: bool, id_: str, p: str) -> DataFrame:
        some = rows.where(F.col("ours") if own_first else ~F.col("ours"))
        coded = some.select(F.col("entity_id").alias(id_), "country", *[F.sort_array(F.transform(c, code)).alias(f"w{i}") for i, c in enumerate(columns)])
        sized = settled(coded).withColumns({f"n{i}": F.size(f"w{i}") for i in (0, 1)} | {f"b{i}": F.aggregate(f"w{i}", F.lit(0).cast("long"), lambda a, w: a.bitwiseOR(bit(w))) for i in (0, 1)})
        return settled(sized).select(id_, *[F.col(x).alias(f"{p}_{x}") for x in ("n0", "n1", "b0", "b1")], F.explode(F.concat(keys(0, own_first), keys(1, own_first))).alias("k"))

    both = keyed(True, "s1_id", "l").join(keyed(False, "cand_id", "r"), "k")
    return both.where(_most("n0", "b0") + _most("n1", "b1") >= 2 * (least - SLACK)).select("s1_id", "cand_id").distinct()


def _hashed(rows: DataFrame, id_: str, ignored: list[str]) -> DataFrame:
    """``id_``, k (64 bits of country and key) and the strategy's bit of each key of rows entity_id, country and keys (``blocking.key_texts``), without those of the ``ignored`` places."""
    place = F.substring("e", 1, 2)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))
    return rows.select(F.col("entity_id").alias(id_), "country", F.explode("keys").alias("e")).where(~place.isin(ignored)).select(id_, F.xxhash64("country", "e").alias("k"), bit.alias("bit"))


def keyed_pairs(left: DataFrame, right: DataFrame, ignored: list[str]) -> DataFrame:
    """s1_id and n_keyed: how many keys it shares with how many records of ``right``, added up.

    Both sides have entity_id, country and keys (``blocking.key_texts``); those of strategies at the ``ignored`` places don't count. Equal
    hashes of unlike keys add to the number, never take from it.
    """
    n = _hashed(right, "cand_id", ignored).groupBy("k").agg(F.count("*").alias("n"))
    return _hashed(left, "s1_id", ignored).select("s1_id", "k").join(n, "k").groupBy("s1_id").agg(F.sum("n").alias("n_keyed"))


def first_by_keys(left: DataFrame, right: DataFrame, top: int) -> DataFrame:
    """s1_id, cand_id, votes and rank of the first ``top`` candidates of each record of ``left``, from all pairs that share a key (by 64 bits): for few of ``left``."""
    found = _hashed(left, "s1_id", []).join(_hashed(right, "cand_id", []).drop("bit"), "k").select("s1_id", "cand_id", "bit")
    votes = found.groupBy("s1_id", "cand_id").agg(F.bit_count(F.bit_or("bit")).cast("long").alias("votes"))
    return ranked(votes, top)


def surely_first(votes: Column, n_keyed: Column, ignored: int, top: int) -> Column:
    """Whether a pair of so many votes is among the first ``top`` of its s1_id, whatever the others are.

    Those that may come before it have as many votes, so at least ``votes - ignored`` from strategies that aren't ignored. With
    the pair itself more than ``top`` of them would share ``(top + 1) * (votes - ignored)`` keys, more than the s1_id shares with all records.
    """
    return n_keyed < (top + 1) * (votes - ignored)
