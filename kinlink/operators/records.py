"""Derived fields of names and addresses. Each step is a projection; the three kernels are Arrow UDFs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import text as T

_EMPTY = "array<string>"


def settled(df: DataFrame) -> DataFrame:
    """``df`` behind a generator of one row, which the optimiser doesn't join projections across.

    Functions with lambdas take part in no elimination of common parts, so a projection merged with those below it
    would clean a name again for every field that is made of its words.
    """
    return df.select("*", F.explode(F.array(F.lit(0))).alias("_one")).drop("_one")


def _strip(c):
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def name_fields(df: DataFrame, column: str = "business_name") -> DataFrame:
    """``df`` with the derived fields of a name, prefixed name_ and the like; null names count as empty."""
    c = F.col
    out = df.withColumn("name_raw", _strip(c(column)))
    out = out.withColumns({"name_ascii": K.fold_accents(c("name_raw")), "name_script": K.detect_script(c("name_raw")), "name_transliterated": K.transliterate(c("name_raw")), "name_no_honorific": T.strip_honorific(c("name_raw"))})
    out = out.withColumn("honorific_ascii", K.fold_accents(F.coalesce("name_no_honorific", F.lit(""))))
    out = out.withColumns({"name_alnum": T.alnum(c("name_ascii")), "translit_alnum": T.alnum(F.lower("name_transliterated")), "honorific_alnum": T.alnum(c("honorific_ascii"))})
    out = settled(out)
    out = out.withColumns({"name_tokens": T.words(c("name_alnum")), "translit_tokens": T.drop_legal_forms(T.words(c("translit_alnum"))), "honorific_tokens": T.drop_legal_forms(T.words(c("honorific_alnum")))})
    out = settled(out.withColumn("no_suffix_tokens", T.drop_legal_forms(c("name_tokens"))))
    out = out.withColumns({"distinctive": T.distinctive(c("no_suffix_tokens")), "translit_distinctive": T.distinctive(c("translit_tokens")), "honorific_distinctive": T.distinctive(c("honorific_tokens"))})
    out = settled(out)
    long = F.filter(c("distinctive"), lambda t: F.length(t) >= 3)
    return out.withColumns(
        {
            "name_tokens_sorted": T.sorted_join(c("name_tokens")),
            "name_no_suffix": F.array_join("no_suffix_tokens", " "),
            "name_no_suffix_sorted": T.sorted_join(c("no_suffix_tokens")),
            "name_initials": T.initials(c("name_tokens")),
            "name_acronym": F.upper(T.initials(c("name_tokens"))),
            "legal_suffixes": T.legal_forms_in(c("name_ascii")),
            "name_abbrev_expanded": F.array_join(T.expand(c("name_tokens")), " "),
            "phonetic": F.transform(long, T.skeleton),
            "soundex_tokens": F.filter(F.transform(long, T.soundex), lambda t: t != ""),
            "translit_phonetic": F.transform(c("translit_distinctive"), T.skeleton),
            "domain_clean": T.domain(c("name_raw")),
            "name_concat_distinctive": F.when(F.size("distinctive") >= 2, F.array_join("distinctive", "")).otherwise(""),
            "name_c3": T.ngrams(c("name_alnum"), 3),
            "name_c4": T.ngrams(c("name_alnum"), 4),
            "name_c5": T.ngrams(c("name_alnum"), 5),
        }
    ).drop("honorific_ascii", "honorific_alnum", "translit_alnum")


def address_fields(df: DataFrame, column: str = "business_address", country: str = "country") -> DataFrame:
    """``df`` with the derived fields of an address; null addresses count as empty."""
    c = F.col
    out = df.withColumn("addr_raw", _strip(c(column))).withColumn("addr_ascii", K.fold_accents(c("addr_raw"))).withColumn("addr_low", F.lower("addr_raw"))
    out = settled(out)
    spelled = F.array_join(T.expand(F.regexp_extract_all(c("addr_ascii"), F.lit(r"(?U)(\w+)"), F.lit(1))), " ")
    out = out.withColumn("addr_alnum", T.alnum(F.lower(spelled)))
    out = settled(settled(out).withColumn("addr_tokens", T.words(c("addr_alnum"))))
    out = out.withColumns({"numeric_atoms": T.by_length(T.numeric_atoms(c("addr_low"))), "slash_compounds": T.slash_compounds(c("addr_low")), "house_tokens": T.house_tokens(c("addr_low")), "addr_distinctive": F.filter(T.distinctive(c("addr_tokens"), 4), lambda t: ~t.rlike(r"^\d+$"))})
    out = settled(out)
    first = lambda x: F.get(c(x), F.lit(0))
    return out.withColumns(
        {
            "addr_tokens_sorted": T.sorted_join(c("addr_tokens")),
            "postal_code": T.postal_code(c("addr_raw"), c(country)),
            "house_number": T.house_number(c("addr_tokens")),
            "sorted_numeric_sig": F.nullif(F.array_join(F.slice("numeric_atoms", 1, 4), "_"), F.lit("")),
            "house_signature": F.coalesce(first("slash_compounds"), first("house_tokens"), first("numeric_atoms")),
            "street_name_tokens": F.slice("addr_distinctive", 1, 3),
            "addr_c3": T.ngrams(c("addr_alnum"), 3),
            "addr_c4": T.ngrams(c("addr_alnum"), 4),
            "addr_c5": T.ngrams(c("addr_alnum"), 5),
        }
    ).drop("addr_ascii", "addr_low")


def records(df: DataFrame) -> DataFrame:
    """entity_id, country (null: UNKNOWN) and all derived fields of rows entity_id, business_name, business_address, country."""
    known = df.withColumn("country", F.coalesce("country", F.lit("UNKNOWN")))
    return address_fields(name_fields(known))
