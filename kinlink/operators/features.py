"""Similarity features of candidate pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.kernels import sequence_ratio
from ..functions.vocabulary import FAMILIES

#: Fields of a record that features need.
FIELDS = [
    "name_raw", "name_alnum", "name_tokens", "name_tokens_sorted", "name_no_suffix", "name_initials", "distinctive", "phonetic", "legal_suffixes", "name_transliterated", "name_script", "name_c3", "name_c4",
    "addr_raw", "addr_alnum", "addr_tokens", "addr_distinctive", "addr_c3", "addr_c4", "numeric_atoms", "house_number", "postal_code",
]


def _made() -> dict[str, Column]:
    """What features need of one record alone, by name: worked out once a record, not once a pair."""
    c = F.col
    sets = {f"{x}_set": F.array_distinct(c(x)) for x in ("name_tokens", "addr_tokens", "distinctive", "phonetic", "addr_distinctive")}
    atoms = F.array_distinct(F.filter(F.transform("numeric_atoms", T.strip_zeros), lambda d: d != ""))
    return {**sets, "numeric_set": atoms, "name_c2": _bigrams(c("name_alnum")), "name_numbers": F.regexp_extract_all("name_raw", F.lit(T.NUMBER), F.lit(1))}


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def _sides(name: str) -> tuple[Column, Column]:
    return F.col(f"l_{name}"), F.col(f"r_{name}")


def _set(name: str) -> tuple[Column, Column]:
    return _sides(f"{name}_set")


def _same(name: str) -> Column:
    a, b = _sides(name)
    return _flag((a == b) & (a != ""))


def _overlap(sets: tuple[Column, Column]) -> Column:
    return F.size(F.array_intersect(*sets)).cast("double")


def _bigrams(c: Column) -> Column:
    return F.when(F.length(c) < 2, F.array().cast("array<string>")).otherwise(T.ngrams(c, 2))


def _length_ratio(a: Column, b: Column) -> Column:
    x, y = (F.greatest(F.length(c), F.lit(1)) for c in (a, b))
    return F.least(x, y) / F.greatest(x, y)


def native_features(parity: bool = False) -> dict[str, Column]:
    """The features that need no UDF, over columns l_* and r_* of both records (of :func:`paired`) and votes, rank, strategies.

    With ``parity`` the agreement of legal forms is always 0.5 and the overlap of distinctive address words 0, as
    in data made by implementations that never fill those inputs.
    """
    c = F.col
    tokens, atokens, anum = _set("name_tokens"), _set("addr_tokens"), _sides("numeric_set")
    (na, nb), (aa, ab), (pa, pb), (ha, hb) = _sides("name_alnum"), _sides("addr_alnum"), _sides("postal_code"), _sides("house_number")
    la, lb = _sides("legal_suffixes")
    name_jac, addr_jac = T.set_ratio(*tokens, "jaccard"), T.set_ratio(*atokens, "jaccard")
    exact, addr_exact = _same("name_alnum"), _same("addr_alnum")
    both_postal = pa.isNotNull() & pb.isNotNull()
    suffix = F.when((F.size(la) == 0) & (F.size(lb) == 0), 0.5).otherwise(_flag((F.size(la) > 0) & (la == lb)))
    family = {k: F.arrays_overlap(c("strategies"), T.literals(v)).cast("double") for k, v in FAMILIES.items()}
    return {
        "name_exact": exact,
        "name_no_suffix_exact": _same("name_no_suffix"),
        "name_sorted_exact": _flag(c("l_name_tokens_sorted") == c("r_name_tokens_sorted")),
        "name_tok_jaccard": name_jac,
        "name_tok_containment": T.set_ratio(*tokens, "containment"),
        "name_tok_overlap": _overlap(tokens),
        "name_c2_jaccard": T.set_ratio(*_sides("name_c2"), "jaccard"),
        "name_c3_jaccard": T.set_ratio(*_sides("name_c3"), "jaccard"),
        "name_c3_cosine": T.set_ratio(*_sides("name_c3"), "cosine"),
        "name_c4_jaccard": T.set_ratio(*_sides("name_c4"), "jaccard"),
        "name_c4_cosine": T.set_ratio(*_sides("name_c4"), "cosine"),
        "name_len_diff": F.abs(F.length(na) - F.length(nb)).cast("double"),
        "name_len_ratio": _length_ratio(na, nb),
        "name_tok_diff": F.abs(F.size(tokens[0]) - F.size(tokens[1])).cast("double"),
        "name_distinctive_overlap": _overlap(_set("distinctive")),
        "initials_match": _same("name_initials"),
        "phonetic_tok0_match": _flag(F.get("l_phonetic", F.lit(0)) == F.get("r_phonetic", F.lit(0))),
        "phonetic_jaccard": T.set_ratio(*_set("phonetic"), "jaccard"),
        "legal_suffix_agree": F.lit(0.5) if parity else suffix,
        "domain_name_contain": _flag((F.get("l_name_tokens", F.lit(0)) != "") & F.contains(nb, F.get("l_name_tokens", F.lit(0)))),
        "addr_exact": addr_exact,
        "addr_tok_jaccard": addr_jac,
        "addr_tok_containment": T.set_ratio(*atokens, "containment"),
        "addr_tok_overlap": _overlap(atokens),
        "addr_c3_jaccard": T.set_ratio(*_sides("addr_c3"), "jaccard"),
        "addr_c4_jaccard": T.set_ratio(*_sides("addr_c4"), "jaccard"),
        "addr_len_diff": F.abs(F.length(aa) - F.length(ab)).cast("double"),
        "addr_len_ratio": _length_ratio(aa, ab),
        "addr_distinctive_overlap": F.lit(0.0) if parity else _overlap(_set("addr_distinctive")),
        "numeric_atom_overlap": F.size(F.array_intersect(*anum)).cast("double"),
        "numeric_atom_jaccard": T.set_ratio(*anum, "jaccard"),
        "house_num_exact": _flag(ha == hb),
        "house_num_norm_match": _flag(T.strip_zeros(ha) == T.strip_zeros(hb)),
        "postal_exact": _flag(pa == pb),
        "postal_prefix2_match": _flag(F.substring(pa, 1, 2) == F.substring(pb, 1, 2)),
        "postal_prefix3_match": _flag(F.substring(pa, 1, 3) == F.substring(pb, 1, 3)),
        "postal_present_both": _flag(both_postal),
        "postal_mismatch": _flag(both_postal & (pa != pb)),
        "cand_addr_missing": _flag(ab == ""),
        "name_x_addr": name_jac * addr_jac,
        "both_exact": exact * addr_exact,
        "both_strong": _flag((name_jac >= 0.6) & (addr_jac >= 0.4)),
        "exact_name_partial_addr": _flag((exact == 1) & (addr_jac >= 0.25)),
        "partial_name_exact_addr": _flag((name_jac >= 0.5) & (addr_exact == 1)),
        "name_addr_numeric_consistent": _flag(F.arrays_overlap("l_name_numbers", "r_numeric_atoms")),
        "source_is_s2": F.startswith(c("cand_id"), F.lit("S2-")).cast("double"),
        "blocker_votes_count": c("votes").cast("double"),
        "cand_rank_by_votes": c("rank").cast("double"),
        "blocker_families_count": sum(family.values(), F.lit(0.0)),
        **{f"fired_{k}_family": v for k, v in family.items()},
    }


#: The features of the sequence kernel.
SEQUENCE_FEATURES = ["name_edit_sim", "name_first_tok_sim", "translit_name_sim", "native_vs_translit_agree"]
#: The features of native_features, in order.
NATIVE_FEATURES = [
    "name_exact", "name_no_suffix_exact", "name_sorted_exact", "name_tok_jaccard", "name_tok_containment", "name_tok_overlap", "name_c2_jaccard",
    "name_c3_jaccard", "name_c3_cosine", "name_c4_jaccard", "name_c4_cosine", "name_len_diff", "name_len_ratio", "name_tok_diff",
    "name_distinctive_overlap", "initials_match", "phonetic_tok0_match", "phonetic_jaccard", "legal_suffix_agree", "domain_name_contain",
    "addr_exact", "addr_tok_jaccard", "addr_tok_containment", "addr_tok_overlap", "addr_c3_jaccard", "addr_c4_jaccard", "addr_len_diff",
    "addr_len_ratio", "addr_distinctive_overlap", "numeric_atom_overlap", "numeric_atom_jaccard", "house_num_exact", "house_num_norm_match",
    "postal_exact", "postal_prefix2_match", "postal_prefix3_match", "postal_present_both", "postal_mismatch", "cand_addr_missing", "name_x_addr",
    "both_exact", "both_strong", "exact_name_partial_addr", "partial_name_exact_addr", "name_addr_numeric_consistent", "source_is_s2",
    "blocker_votes_count", "cand_rank_by_votes", "blocker_families_count", "fired_exact_family", "fired_token_family", "fired_postal_family",
    "fired_numeric_family", "fired_phonetic_family", "fired_indic_family", "fired_pure_addr_family",
]
FEATURE_NAMES = NATIVE_FEATURES + SEQUENCE_FEATURES


def paired(candidates: DataFrame, left: DataFrame, right: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """Candidates (s1_id, cand_id, votes, rank, strategies) with the fields of both records as l_* and r_*, and what features make of all of them."""
    made = _made() if set(FIELDS) <= set(fields) else {}

    def side(rows: DataFrame, key: str, prefix: str) -> DataFrame:
        return rows.select(F.col("entity_id").alias(key), *[F.col(f).alias(f"{prefix}_{f}") for f in fields], *[x.alias(f"{prefix}_{name}") for name, x in made.items()])

    return candidates.join(side(left, "s1_id", "l"), "s1_id").join(side(right, "cand_id", "r"), "cand_id")


def pair_features(pairs: DataFrame, sequence: bool = True, parity: bool = False) -> DataFrame:
    """s1_id, cand_id and the features as doubles, to four decimals."""
    out = pairs.select("s1_id", "cand_id", *[F.bround(v, 4).alias(k) for k, v in native_features(parity).items()], *(["l_name_alnum", "r_name_alnum", "l_name_tokens", "r_name_tokens", "l_name_transliterated", "r_name_transliterated", "l_name_script", "r_name_script"] if sequence else []))
    if not sequence:
        return out
    c, first = F.col, lambda x: F.coalesce(F.get(x, F.lit(0)), F.lit(""))
    both = (c("l_name_transliterated") != "") & (c("r_name_transliterated") != "")
    out = out.withColumns(
        {
            "name_edit_sim": F.bround(sequence_ratio("l_name_alnum", "r_name_alnum"), 4),
            "name_first_tok_sim": F.bround(sequence_ratio(first("l_name_tokens"), first("r_name_tokens")), 4),
            "translit_name_sim": F.when(both, F.bround(sequence_ratio("l_name_transliterated", "r_name_transliterated"), 4)).otherwise(0.0),
        }
    )
    out = out.withColumn("native_vs_translit_agree", _flag((c("l_name_script") != c("r_name_script")) & (c("translit_name_sim") >= 0.7)))
    return out.select("s1_id", "cand_id", *FEATURE_NAMES)
