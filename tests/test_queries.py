"""Registered queries against their SQL, on the smallest tables."""

import pytest
from oracle_check import connect, difference

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CHECKED = (
    "info_parse_kv", "csq_positional_split", "gencode_cascade", "extract_region_flags", "redundant_rule_table",
    "category_set_extract", "bed_merge", "interval_overlap_left0", "cooccur_variant", "adjusted_relative_risk",
    "category_key_codes", "bed_text_roundtrip", "family_label_swap", "gene_left_join", "sample_set_equality",
    "binomial_burden", "permutation_pvalue", "burden_shift", "neg_laplacian", "train_test_split", "bh_fdr",
)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, con, name):
    assert difference(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0
