"""Every query with an oracle gives the oracle's rows; every other one runs."""

import pytest

from emberwake.plans import ORACLES, QUERIES

from .conftest import rows

SLOW = {"select_k", "model_suite", "stability_bootstrap", "grid_search", "overlay_polygon"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
