"""Profiles of tables and links, and classes of noise, misses and shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocabulary import ABBREVIATIONS, NULL_TOKENS, PROFILE_LEGAL_FORMS


def null_tokens(df: DataFrame, tokens: list[str] = NULL_TOKENS) -> DataFrame:
    """Strings that stand for null as null."""
    return df.select(*[F.when(~F.col(c).isin(tokens), F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def table_profile(df: DataFrame) -> DataFrame:
    """A row a column: column, n_rows, n_null, null_pct (3 decimals), n_distinct. One pass over the table."""
    cells = [F.struct(F.lit(c).alias("column"), F.count("*").alias("n_rows"), F.count(F.when(F.col(c).isNull(), 1)).alias("n_null"), F.countDistinct(c).alias("n_distinct")) for c in df.columns]
    return df.agg(F.array(*cells).alias("x")).select(F.inline("x")).withColumn("null_pct", F.when(F.col("n_rows") > 0, F.round(100.0 * F.col("n_null") / F.col("n_rows"), 3)).otherwise(0.0))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """n_rows, n_ids, n_distinct_rows: repeats of ids and of whole rows."""
    rows = df.groupBy(*df.columns).agg(F.count("*").alias("n"))
    return rows.agg(F.sum("n").alias("n_rows"), F.countDistinct(key).alias("n_ids"), F.count("*").alias("n_distinct_rows"))


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    out = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "value").limit(top) if top else out


def distribution(df: DataFrame, value: Column, by: list[str] = []) -> DataFrame:  # noqa: B006
    """count, min, percentiles, mean, population deviation and max; percentiles interpolate linearly."""
    rows = df.select(*by, value.cast("double").alias("v"))
    p = {f"p{int(100 * q)}": F.percentile("v", F.lit(q)) for q in (0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)}
    aggregates = [F.count("v").alias("n"), F.min("v").alias("least"), *[x.alias(k) for k, x in p.items()], F.round(F.avg("v"), 4).alias("mean"), F.round(F.stddev_pop("v"), 4).alias("std"), F.max("v").alias("largest")]
    return rows.groupBy(*by).agg(*aggregates) if by else rows.agg(*aggregates)


def suffix_counts(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    """suffix and n of the legal forms in a column, the most frequent first."""
    return df.select(F.explode(T.legal_forms_in(F.coalesce(F.col(column), F.lit("")))).alias("suffix")).groupBy("suffix").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "suffix").limit(top)


def digit_share(df: DataFrame, column: str) -> DataFrame:
    """n, pct_with_digits and mean_digit_groups of a column."""
    groups = F.regexp_count(F.coalesce(F.col(column), F.lit("")), F.lit(r"[0-9]+"))
    return df.agg(F.count("*").alias("n"), F.round(100.0 * F.avg((groups > 0).cast("double")), 4).alias("pct_with_digits"), F.round(F.avg(groups), 4).alias("mean_digit_groups"))


def link_integrity(spine: DataFrame, candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """rule and n: links without their entity or candidate, repeats, and links within and across countries.

    ``spine`` has s1_id and country, ``candidates`` cand_id and country, ``truth`` s1_id and cand_id.
    """
    s = spine.select("s1_id", F.col("country").alias("s_country"))
    k = candidates.select("cand_id", F.col("country").alias("k_country"))
    rows = truth.join(s, "s1_id", "left").join(k, "cand_id", "left")
    n = lambda cond: F.count(F.when(cond, 1))
    one = rows.agg(
        F.count("*").alias("links"),
        (F.count("*") - F.countDistinct("s1_id", "cand_id")).alias("repeated_links"),
        n(F.col("s_country").isNull()).alias("unknown_entity"),
        n(F.col("k_country").isNull()).alias("unknown_candidate"),
        n(F.col("s_country") == F.col("k_country")).alias("same_country"),
        n(F.col("s_country") != F.col("k_country")).alias("cross_country"),
    )
    return one.select(F.expr("stack(6, " + ", ".join(f"'{c}', {c}" for c in one.columns) + ") as (rule, n)"))


def link_integrity_by_source(spine: DataFrame, candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """source, links, same_country, cross_country and unknown of the links to each source."""
    s = spine.select("s1_id", F.col("country").alias("s_country"))
    k = candidates.select("cand_id", F.col("country").alias("k_country"), F.lit(1).alias("known"))
    n = lambda cond: F.count(F.when(cond, 1))
    rows = truth.join(s, "s1_id", "left").join(k, "cand_id", "left").withColumn("source", F.substring("cand_id", 1, 2))
    return rows.groupBy("source").agg(F.count("*").alias("links"), n(F.col("s_country") == F.col("k_country")).alias("same_country"), n(F.col("s_country") != F.col("k_country")).alias("cross_country"), n(F.col("known").isNull()).alias("unknown"))


def source_profile(df: DataFrame, text_columns: list[str], top: int = 10) -> DataFrame:
    """section, item, value of a source: its columns' nulls and distinct values, lengths of texts, most frequent values.

    One row a figure, as a report lists them. A null's length doesn't count.
    """
    row = lambda section, item, v: F.struct(F.lit(section).alias("section"), item.cast("string").alias("item"), v.cast("double").alias("value"))
    columns = table_profile(df).select(F.explode(F.array(*[row(x, F.col("column"), F.col(x)) for x in ("n_rows", "n_null", "n_distinct")])).alias("x")).select("x.*")
    out = columns
    for c in text_columns:
        shape = distribution(df.where(F.col(c).isNotNull()), F.length(c))
        figures = [x for x in shape.columns if x != "n"]
        out = out.unionByName(shape.select(F.explode(F.array(*[row(f"length of {c}", F.lit(x), F.col(x)) for x in figures])).alias("x")).select("x.*"))
        frequent = value_counts(df.where(F.col(c).isNotNull()), c, top)
        out = out.unionByName(frequent.select(row(f"frequent {c}", F.col("value"), F.col("n")).alias("x")).select("x.*"))
    return out


def truth_profile(spine: DataFrame, candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """section, item, value of the true links: histogram, breakdown by source, figures a entity, and validity."""
    per = spine.select("s1_id").join(truth.groupBy("s1_id").agg(F.count("*").alias("n")), "s1_id", "left").fillna({"n": 0})
    part = lambda df, section, item, v: df.select(F.lit(section).alias("section"), F.col(item).cast("string").alias("item"), F.col(v).cast("double").alias("value"))
    shape = distribution(per, F.col("n")).drop("n")
    figures = shape.select(F.expr(f"stack({len(shape.columns)}, " + ", ".join(f"'{c}', cast({c} as double)" for c in shape.columns) + ") as (item, value)"))
    return (
        part(match_histogram(spine, truth), "links an entity", "bucket", "n_entities")
        .unionByName(part(source_breakdown(spine, truth), "sources", "kind", "n_entities"))
        .unionByName(part(link_integrity(spine, candidates, truth), "validity", "rule", "n"))
        .unionByName(figures.select(F.lit("figures").alias("section"), "item", "value"))
    )


def value_shift(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """value, share_left, share_right (percent) and shift of a column's values in two tables."""
    one = lambda df, n: df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("null")).alias("value")).agg(F.count("*").alias(n))
    both = one(a, "l").join(one(b, "r"), "value", "full").fillna(0, ["l", "r"])
    totals = both.agg(F.sum("l").alias("all_l"), F.sum("r").alias("all_r"))  # one row
    x, y = (F.round(100.0 * F.col(c) / F.col(f"all_{c}"), 4) for c in "lr")
    return both.crossJoin(F.broadcast(totals)).select("value", x.alias("share_left"), y.alias("share_right"), F.round(x - y, 4).alias("shift"))


def match_histogram(spine: DataFrame, truth: DataFrame) -> DataFrame:
    """bucket (0 to 4, 5+) and n_entities by number of links."""
    per = spine.select("s1_id").join(truth.groupBy("s1_id").agg(F.count("*").alias("n")), "s1_id", "left").fillna({"n": 0})
    return per.groupBy(F.when(F.col("n") >= 5, "5+").otherwise(F.col("n").cast("string")).alias("bucket")).agg(F.count("*").alias("n_entities"))


def source_breakdown(spine: DataFrame, truth: DataFrame) -> DataFrame:
    """kind (s2_only, s3_only, both, neither) and n_entities."""
    n = lambda s: F.count(F.when(F.startswith(F.col("cand_id"), F.lit(s)), 1))
    per = spine.select("s1_id").join(truth.groupBy("s1_id").agg(n("S2-").alias("a"), n("S3-").alias("b")), "s1_id", "left").fillna(0, ["a", "b"])
    kind = F.when((F.col("a") > 0) & (F.col("b") > 0), "both").when(F.col("a") > 0, "s2_only").when(F.col("b") > 0, "s3_only").otherwise("neither")
    return per.groupBy(kind.alias("kind")).agg(F.count("*").alias("n_entities"))


def overlap(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """n_left, n_right, n_both of the distinct values of a column of two tables."""
    x, y = a.select(F.lower(column).alias("v")).distinct().withColumn("l", F.lit(1)), b.select(F.lower(column).alias("v")).distinct().withColumn("r", F.lit(1))
    return x.join(y, "v", "full").agg(F.count("l").alias("n_left"), F.count("r").alias("n_right"), F.count(F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), 1)).alias("n_both"))


def ambiguous(df: DataFrame, name: str, address: str, least: int = 3) -> DataFrame:
    """name (lower case), n_rows and n_addresses of names with at least ``least`` addresses."""
    return df.groupBy(F.lower(name).alias("name")).agg(F.count("*").alias("n_rows"), F.countDistinct(address).alias("n_addresses")).where(F.col("n_addresses") >= least)


def character_difference(a: Column, b: Column) -> Column:
    """Size of the symmetric difference of two texts' character multisets."""
    chars = lambda x: F.filter(F.split(x, ""), lambda t: t != "")
    every = F.array_distinct(F.concat(chars(a), chars(b)))
    count = lambda x, t: F.length(x) - F.length(F.replace(x, t, F.lit("")))
    return F.aggregate(every, F.lit(0), lambda acc, t: acc + F.abs(count(a, t) - count(b, t)))


def with_examples(rows: DataFrame, by: list[str], examples: int) -> DataFrame:
    """``by``, n and the first ``examples`` pairs as s1_id>cand_id of rows with s1_id and cand_id."""
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("s1_id", "cand_id"))).where(F.col("r") <= examples)
    shown = F.transform(F.array_sort(F.collect_list(F.struct("s1_id", "cand_id"))), lambda x: F.concat_ws(">", x["s1_id"], x["cand_id"]))
    return rows.groupBy(*by).agg(F.count("*").alias("n")).join(first.groupBy(*by).agg(F.array_join(shown, ",").alias("examples")), by)


def noise_patterns(pairs: DataFrame, ambiguous_names: DataFrame, examples: int = 5) -> DataFrame:
    """pattern, n and examples of true pairs (s1_id, cand_id, left_name, left_addr, right_name, right_addr).

    A pair can be of several of the nine patterns. ``ambiguous_names`` (ambiguous_name, lower case) are names of several addresses.
    """
    a, b, x, y = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("left_name", "right_name", "left_addr", "right_addr"))
    tokens = lambda c: F.array_sort(T.words(T.clean(c)))
    short = T.literals([k.lower() for k in ABBREVIATIONS])
    bare = lambda c: T.without_legal_forms(T.clean(c), [f.lower() for f in PROFILE_LEGAL_FORMS])
    flags = {
        "exact": (a == b) & (x == y),
        "reordered": (a != b) & (tokens(a) == tokens(b)),
        "legal_suffix": (a != b) & (bare(a) == bare(b)),
        "abbreviation": (x != y) & F.arrays_overlap(F.array_except(tokens(x), tokens(y)), short),
        "typo": (a != b) & (character_difference(a, b) <= 3),
        "missing_component": (x == "") != (y == ""),
        "address_variation": (x != y) & (F.contains(x, y) | F.contains(y, x)) & (x != "") & (y != ""),
        "transliteration": a.rlike("[\\u0900-\\u0D7F]") != b.rlike("[\\u0900-\\u0D7F]"),
        "ambiguous": F.col("ambiguous_name").isNotNull() & (b != ""),
    }
    marked = pairs.join(ambiguous_names, b == F.col("ambiguous_name"), "left")
    found = marked.select("s1_id", "cand_id", F.explode(F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in flags.items()]), lambda p: p.isNotNull())).alias("pattern"))
    return with_examples(found, ["pattern"], examples)


# Labels of missed links and what would recover them, by words of the label.
MISS_LABELS = {
    "normalization": "1. normalization failure", "typo": "2. name typo", "abbreviation": "3. name abbreviation", "suffix": "4. legal suffix difference", "reorder": "5. word reorder", "phonetic": "6. transliteration",
    "script": "6. transliteration / script gap", "address_typo": "7. address typo", "address_format": "7. address typo / digit-format", "truncation": "8. address truncation", "no_address": "9. missing address",
    "postal": "10. postal mismatch", "house": "11. house-number issue", "locality": "12. locality issue", "none": "17. no blocker fired",
}
REMEDIES = [
    ("abbrev", "Abbreviation Expansion Dictionary"), ("reorder", "Distinctive Token Pairs (Unordered)"), ("suffix", "Extended Legal Suffix Normalization"), ("postal|house|address", "Address Signature & Numeric Overlap Blocks"),
    ("transliteration", "Phonetic Consonant Skeleton & Soundex"), ("normalization", "Punctuation & Compound Word Unification"),
]
OTHER_REMEDY = "Character N-Grams & Rare Tokens"


#: Fields of a record that the categories and the audit of scripts need.
MISS_FIELDS = ["name_raw", "name_alnum", "name_tokens", "name_no_suffix", "name_initials", "name_script", "phonetic", "addr_raw", "postal_code", "house_number"]


def miss_category(version: str = "v1") -> Column:
    """Why a true pair was missed: the label of the first rule that holds, over fields l_* and r_* of both records.

    ``v1`` looks for common phonetic words, ``2B`` first for Devanagari and then for those, ``2C`` only for letters of
    any Brahmic block. Addresses of less than three characters come before all else.
    """
    lower = lambda x: F.lower(F.coalesce(F.col(x), F.lit("")))
    (na, nb), (aa, ab) = ((lower(f"l_{f}"), lower(f"r_{f}")) for f in ("name_raw", "addr_raw"))
    ta, tb = (F.array_distinct(f"{s}_name_tokens") for s in "lr")
    differ = lambda f: F.col(f"l_{f}").isNotNull() & F.col(f"r_{f}").isNotNull() & (F.col(f"l_{f}") != F.col(f"r_{f}"))
    short = lambda i, n: (F.length(i) >= 2) & F.contains(n, F.col(i))
    either = lambda pattern: na.rlike(pattern) | nb.rlike(pattern)
    phonetic = F.arrays_overlap("l_phonetic", "r_phonetic")
    scripts = {"2B": "[\\u0900-\\u097F]", "2C": "[\\u0900-\\u0D7F]"}
    rules = [("no_address", (F.length(aa) < 3) | (F.length(ab) < 3) | (aa == "nan") | (ab == "nan"))]
    if version in scripts:
        rules.append(("script", either(scripts[version])))
    rules += [
        ("suffix", (F.col("l_name_no_suffix") != "") & (F.col("l_name_no_suffix") == F.col("r_name_no_suffix")) & (na != nb)),
        ("reorder", (F.size(ta) > 0) & (F.array_sort(ta) == F.array_sort(tb)) & (F.col("l_name_alnum") != F.col("r_name_alnum"))),
        ("abbreviation", short("l_name_initials", nb) | short("r_name_initials", na)),
    ]
    if version != "2C":
        rules.append(("phonetic" if version == "v1" else "script", phonetic))
    rules += [
        ("typo", T.set_ratio(ta, tb, "jaccard") >= 0.5),
        ("postal", differ("postal_code")),
        ("house", differ("house_number")),
        ("truncation", F.contains(aa, ab) | F.contains(ab, aa)),
        ("address_typo" if version == "v1" else "address_format", (aa != "") & (ab != "")),
        ("normalization", either("[-_&/.]")),
        ("locality", aa.rlike("near|opp|behind")),
    ]
    out = F.when(F.coalesce(rules[0][1], F.lit(False)), MISS_LABELS[rules[0][0]])
    for label, holds in rules[1:]:
        out = out.when(F.coalesce(holds, F.lit(False)), MISS_LABELS[label])
    return out.otherwise(MISS_LABELS["none"])


def categorised(pairs: DataFrame, version: str = "v1", examples: int = 3) -> DataFrame:
    """category, n and the first ``examples`` pairs as s1_id>cand_id, of pairs with fields l_* and r_*."""
    return with_examples(pairs.withColumn("category", miss_category(version)).select("s1_id", "cand_id", "category"), ["category"], examples)


def remedy(category: Column) -> Column:
    """What would recover a category of misses."""
    out = F.when(category.rlike(REMEDIES[0][0]), REMEDIES[0][1])
    for words, name in REMEDIES[1:]:
        out = out.when(category.rlike(words), name)
    return out.otherwise(OTHER_REMEDY)


def script_audit(pairs: DataFrame, examples: int = 2) -> DataFrame:
    """script_left, script_right, n and examples of pairs with fields l_* and r_*."""
    rows = pairs.select("s1_id", "cand_id", F.col("l_name_script").alias("script_left"), F.col("r_name_script").alias("script_right"))
    return with_examples(rows, ["script_left", "script_right"], examples)
