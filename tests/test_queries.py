"""Every registered query beside its SQL oracle on the smallest tables."""

import os

import pytest

from compare import DATA, check
from gridledger import plans

plans.load_all()
SF = os.environ.get("GRIDLEDGER_TEST_SF", "0.001")
# too few rows at the smallest scale to find anything
MAY_BE_EMPTY = {"t8_identical_to_input", "a5_locate_fuzzy", "c73_row_heights", "c69_narrow_numbers", "p12_column_fit", "p17_dependents",
                "p8_rounding_claims", "t15_evict_oldest"}


@pytest.mark.parametrize("key", sorted(plans.QUERIES))
def test_query(spark, key):
    ok, note = check(spark, key, plans.QUERIES[key], plans.ORACLES.get(key), f"{DATA}/sf{SF}")
    assert ok or (key in MAY_BE_EMPTY and note == "no rows"), note


def test_oracles_belong_to_queries():
    assert set(plans.ORACLES) <= set(plans.QUERIES)


def test_a_key_registers_once():
    with pytest.raises(ValueError):
        plans.query(next(iter(plans.QUERIES)))(lambda v: None)
