"""The registry of blocking keys: each strategy gives an array of keys of a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


#: Strategies of each level, in order.
LEVELS: dict[str, list[str]] = {
    "V1": ["B01_exact_name", "B02_no_legal_suffix", "B03_sorted_tokens", "B04_initials_pfx", "B05_first_two_tokens", "B06_prefix4_len", "B07_house_tok0", "B08_postal_name_pfx", "B09_postal_house", "B10_token_numeric", "B11_addr_lead_tokens"],
    "V2": ["B12_name_abbrev_expanded", "B13_name_no_space", "B14_first_distinctive_token"],
    "V3": ["B15_prefix_suffix_4gram", "B16_skip_gram", "B17_distinctive_tok_ngrams"],
    "V4": ["B18_distinctive_token_pair", "B19_first_last_distinctive", "B20_tok1_house"],
    "V5": ["B21_postal_distinctive_tok", "B22_street_name_joint", "B23_numeric_sig_name"],
    "V6": ["B24_phonetic_tok0", "B25_phonetic_pair", "B26_soundex_postal", "B27_phonetic_house"],
    "2B": ["TB01_honorific_tok0", "TB02_honorific_name", "TB03_domain_concat", "TB04_indic_translit_tok0", "TB05_indic_translit_postal", "TB06_postal_sorted_numeric", "TB07_postal_slash_compound", "TB08_postal_house_token", "TB09_addr_tok0_slash_compound", "TB10_addr_tok0_house_token", "TB11_postal_addr_token_pair", "TB12_translit_house_sig"],
    "2C": ["SB01_multiscript_translit_tok0", "SB02_multiscript_translit_pair", "SB03_multiscript_translit_numeric", "SB04_lstrip_zeros_numeric_name", "SB05_pure_addr_postal_distinctive", "SB06_pure_addr_distinctive_pair", "SB07_pure_addr_tok0_numeric", "SB08_name_tok0_city_locality"],
}

#: Strategies that give a record one key at most and whose keys many unlike records share: three quarters of all keyed pairs of
#: business records are theirs alone. Which strategies are named here changes what the first votes cost, not what they are.
BROAD = ["B11_addr_lead_tokens", "B06_prefix4_len", "B15_prefix_suffix_4gram"]

#: Derived fields that the keys of all strategies are made of.
FIELDS = [
    "name_alnum", "name_tokens", "name_tokens_sorted", "name_no_suffix", "name_initials", "name_abbrev_expanded", "name_no_honorific", "name_concat_distinctive", "domain_clean", "distinctive", "honorific_distinctive", "translit_distinctive",
    "phonetic", "translit_phonetic", "soundex_tokens", "addr_tokens", "addr_distinctive", "postal_code", "house_number", "house_signature", "house_tokens", "slash_compounds", "numeric_atoms", "sorted_numeric_sig",
]


def strategy_names(levels: list[str] | None = None) -> list[str]:
    return [name for level, names in LEVELS.items() if levels is None or level in levels for name in names]


def strategy_levels() -> dict[str, str]:
    return {name: level for level, names in LEVELS.items() for name in names}


def _c(name: str) -> Column:
    return F.col(name)


def _at(name: str, i: int) -> Column:
    return F.get(F.col(name), F.lit(i))


def _present(c: Column) -> Column:
    return F.when(c != "", c)


def _join(*parts: Column) -> Column:
    """Parts joined by underscores; null if any is null."""
    out = parts[0]
    for p in parts[1:]:
        out = F.concat(out, F.lit("_"), p)
    return out


def _pair(a: Column, b: Column) -> Column:
    """Both in order; null if either is, which least and greatest pass over."""
    return F.when(a.isNotNull() & b.isNotNull(), _join(F.least(a, b), F.greatest(a, b)))


def _one(key: Column) -> tuple[Column]:
    """One key at most, which needs no array of its own."""
    return (key,)


def _strategies() -> dict[str, Column | tuple[Column]]:
    """Strategy to its keys, an array or a single one; null keys are dropped later."""
    alnum, n = _c("name_alnum"), F.length("name_alnum")
    t0, d0, d1, p0, p1 = _at("name_tokens", 0), _at("distinctive", 0), _at("distinctive", 1), _at("phonetic", 0), _at("phonetic", 1)
    tr0, a0, a1 = _at("translit_distinctive", 0), _at("addr_distinctive", 0), _at("addr_distinctive", 1)
    post, hn, sig, num0 = _c("postal_code"), _c("house_number"), _c("house_signature"), _at("numeric_atoms", 0)
    x0 = F.coalesce(tr0, d0)
    no_space = F.replace(alnum, F.lit(" "), F.lit(""))
    differs = lambda c: F.when((c != "") & (c != alnum), c)
    tail = lambda c, k: F.substring(c, -k, k)
    pairs = [F.when(F.size("distinctive") > j, _pair(_at("distinctive", i), _at("distinctive", j))) for i in range(3) for j in range(i + 1, 4)]
    lexical = F.array_sort("numeric_atoms")
    each = lambda name, head: F.transform(_c(name), lambda s: F.concat(head, F.lit("_"), s))
    concat_no_suffix = F.replace(_c("name_no_suffix"), F.lit(" "), F.lit(""))
    two_nums = F.transform(F.slice("numeric_atoms", 1, 2), T.strip_zeros)
    stripped = lambda head: F.transform(F.filter(two_nums, lambda s: s != ""), lambda s: F.concat(head, F.lit("_"), s))
    t_pair = F.when(F.size("translit_distinctive") >= 2, _pair(tr0, _at("translit_distinctive", 1))).when(F.size("distinctive") >= 2, _pair(d0, d1))
    out = {
        "B01_exact_name": _one(_present(alnum)),
        "B02_no_legal_suffix": _one(differs(_c("name_no_suffix"))),
        "B03_sorted_tokens": _one(differs(_c("name_tokens_sorted"))),
        "B04_initials_pfx": _one(F.when((F.size("name_tokens") >= 2) & (F.length("name_initials") >= 2), _join(F.substring("name_initials", 1, 4), F.substring(t0, 1, 4)))),
        "B05_first_two_tokens": _one(_join(t0, _at("name_tokens", 1))),
        "B06_prefix4_len": _one(F.when(n >= 4, _join(F.substring(alnum, 1, 4), F.floor(n / 4).cast("string")))),
        "B07_house_tok0": _one(_join(hn, t0)),
        "B08_postal_name_pfx": _one(F.when(n >= 3, _join(post, F.substring(alnum, 1, 3)))),
        "B09_postal_house": _one(_join(post, hn)),
        "B10_token_numeric": _one(_join(t0, num0)),
        "B11_addr_lead_tokens": _one(_join(_at("addr_tokens", 0), _at("addr_tokens", 1))),
        "B12_name_abbrev_expanded": _one(differs(_c("name_abbrev_expanded"))),
        "B13_name_no_space": _one(F.when(F.length(no_space) >= 5, differs(no_space))),
        "B14_first_distinctive_token": _one(d0),
        "B15_prefix_suffix_4gram": _one(F.when(n >= 8, _join(F.substring(alnum, 1, 4), tail(alnum, 4)))),
        "B16_skip_gram": _one(F.when(n >= 6, _join(F.substring(alnum, 1, 2), F.substring(alnum, (F.floor(n / 2) + 1).cast("int"), F.lit(2)), tail(alnum, 2)))),
        "B17_distinctive_tok_ngrams": _one(F.when(F.length(d0) >= 5, _join(F.substring(d0, 1, 3), tail(d0, 3)))),
        "B18_distinctive_token_pair": F.array(*pairs),
        "B19_first_last_distinctive": _one(F.when(F.size("distinctive") >= 2, _join(d0, F.try_element_at("distinctive", F.lit(-1))))),
        "B20_tok1_house": _one(_join(d1, hn)),
        "B21_postal_distinctive_tok": _one(_join(post, d0)),
        "B22_street_name_joint": _one(_join(a0, d0)),
        "B23_numeric_sig_name": _one(F.when(F.size("numeric_atoms") >= 2, _join(F.get(lexical, F.lit(0)), F.get(lexical, F.lit(1)), d0))),
        "B24_phonetic_tok0": _one(F.substring(p0, 1, 6)),
        "B25_phonetic_pair": _one(_pair(F.substring(p0, 1, 5), F.substring(p1, 1, 5))),
        "B26_soundex_postal": _one(_join(_at("soundex_tokens", 0), post)),
        "B27_phonetic_house": _one(_join(F.substring(p0, 1, 5), hn)),
        "TB01_honorific_tok0": _one(F.coalesce(_at("honorific_distinctive", 0), d0)),
        "TB02_honorific_name": _one(_present(F.coalesce(F.nullif(F.trim(F.regexp_replace(F.lower("name_no_honorific"), r"[^a-z0-9\s]", " ")), F.lit("")), alnum))),
        "TB03_domain_concat": F.array(_c("domain_clean"), F.when(F.length(concat_no_suffix) >= 5, concat_no_suffix), _present(_c("name_concat_distinctive"))),
        "TB04_indic_translit_tok0": _one(x0),
        "TB05_indic_translit_postal": _one(_join(x0, post)),
        "TB06_postal_sorted_numeric": _one(_join(post, _c("sorted_numeric_sig"))),
        "TB07_postal_slash_compound": each("slash_compounds", post),
        "TB08_postal_house_token": each("house_tokens", post),
        "TB09_addr_tok0_slash_compound": each("slash_compounds", a0),
        "TB10_addr_tok0_house_token": each("house_tokens", a0),
        "TB11_postal_addr_token_pair": _one(_join(post, _pair(a0, F.when(a1.isNotNull(), a1)))),
        "TB12_translit_house_sig": _one(_join(x0, sig)),
        "SB01_multiscript_translit_tok0": F.when(tr0.isNotNull(), F.array(tr0, _at("translit_phonetic", 0))).otherwise(F.array(d0, p0)),
        "SB02_multiscript_translit_pair": _one(t_pair),
        "SB03_multiscript_translit_numeric": _one(_join(x0, F.coalesce(sig, num0))),
        "SB04_lstrip_zeros_numeric_name": stripped(x0),
        "SB05_pure_addr_postal_distinctive": _one(_join(_c("country"), post, a0)),
        "SB06_pure_addr_distinctive_pair": _one(F.when(a1.isNotNull(), _join(_c("country"), _pair(a0, a1)))),
        "SB07_pure_addr_tok0_numeric": stripped(a0),
        "SB08_name_tok0_city_locality": _one(_join(x0, a0)),
    }
    return out


def with_keys(rows: DataFrame, strategies: list[str] | None = None, carried: list[str] | None = None, tags: dict[str, int] | None = None) -> DataFrame:
    """entity_id, country, strategy and key of records: distinct, without null and empty keys; with the ``carried`` columns of ``rows``.

    The keys of a record are made in one projection and exploded once. With ``tags`` a strategy is written as its number.
    """
    chosen = {k: keys for k, keys in _strategies().items() if strategies is None or k in strategies}
    none = F.array().cast(f"array<struct<strategy:{'bigint' if tags else 'string'},key:string>>")
    present = lambda x: x.isNotNull() & (x != "")

    def entry(name: str, key: Column) -> Column:
        return F.struct((F.lit(tags[name]).cast("long") if tags else F.lit(name)).alias("strategy"), key.alias("key"))

    def each(name: str, keys: Column) -> Column:
        found = F.array_distinct(F.filter(F.coalesce(keys, F.array().cast("array<string>")), present))
        return F.transform(found, lambda x: entry(name, x))

    # Single keys are filtered together, outside lambdas, so their common parts are worked out once.
    ones = [entry(name, keys[0]) for name, keys in chosen.items() if isinstance(keys, tuple)]
    entries = [none, *([F.filter(F.array(*ones), lambda e: present(e["key"]))] if ones else []), *[each(name, keys) for name, keys in chosen.items() if not isinstance(keys, tuple)]]
    kept = ["entity_id", "country", *(carried or [])]
    return rows.select(*kept, F.explode(F.concat(*entries)).alias("e")).select(*kept, "e.strategy", "e.key")


def key_texts(strategies: list[str]) -> Column:
    """The keys of a record as one array of distinct texts: the place of a strategy in the sorted names, in two digits, and the key."""
    made = _strategies()
    chosen = [(f"{i:02d}", made[name]) for i, name in enumerate(sorted(strategies))]
    ones = [F.concat(F.lit(tag), _present(keys[0])) for tag, keys in chosen if isinstance(keys, tuple)]  # null without a key
    each = lambda tag, keys: F.transform(F.array_distinct(F.filter(keys, lambda x: x != "")), lambda x: F.concat(F.lit(tag), x))
    many = [F.coalesce(each(tag, keys), F.array().cast("array<string>")) for tag, keys in chosen if not isinstance(keys, tuple)]
    return F.concat(F.array_compact(F.array(*ones)), *many)


def with_broad(rows: DataFrame, broad: list[str]) -> DataFrame:
    """``rows`` with the keys of strategies of one key at most, as columns of their names; null without a key."""
    made = _strategies()
    return rows.withColumns({name: _present(made[name][0]) for name in broad})
