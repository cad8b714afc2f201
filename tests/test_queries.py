"""Registered queries against their SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from kinlink.operators import blocking, features
from kinlink.plans import catalogue, linkage_sql

DATA = "/root/testdata/sf0.001"
#: One query for each operator; ALL_QUERIES=1 runs those too that only differ in columns or strategies.
CHECKED = sorted(catalogue.SQL) if os.environ.get("ALL_QUERIES") else [
    "exact_name_resolution", "clean_text_projection", "char_ngrams_3", "accent_fold", "length_profile", "link_integrity_by_source", "source_profile", "truth_profile", "country_shift", "legal_form_counts",
    "audit_report", "name_fields", "address_fields", "name_scripts", "blocking_keys_all", "postings_capped", "fast_index_candidates", "index_training_pairs", "all_truth_training_pairs", "hard_negatives",
    "pair_features_native", "policy_grid", "threshold_sweep", "macro_f05_by_source", "noise_patterns", "miss_categories_2b", "script_audit", "name_similarity", "tsv_round_trip", "output_round_trip",
    "log_round_trip", "output_findings", "domain_from_url", "train_split", "pilot_sample",
]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return float(f"{float(v):.9g}") if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    frame = catalogue.QUERIES[name](spark, DATA)
    result = duck.execute(catalogue.SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    order = sorted(columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in frame.collect()), key=repr)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in result.fetchall()), key=repr)
    assert got == want and got  # an empty result would show nothing


def test_every_strategy_and_feature_has_sql():
    assert list(linkage_sql.STRATEGIES) == blocking.strategy_names() and list(linkage_sql.FEATURES) == features.NATIVE_FEATURES


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["s1_id", "matched_entity_ids"]
