"""Every registered query against its SQL twin, and the entry points."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.oracle import compare

SERIES = [n for n in entry.queries() if not (n.startswith("op") and n[2].isdigit()) and n != "pipeline"]


@pytest.mark.parametrize("name", SERIES)
def test_query(spark, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        compare(df, sql, sf_dir)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["g", "n", "m0", "c00", "ll"] and df.count() == 3


def test_golden_likelihoods(spark):
    got = {r.g: r.ll for r in entry.queries()["local_level_final_state"](spark, "/root/testdata/sf0.01").collect()}
    assert got == pytest.approx({"A": -13484.5325, "N": -13322.6645, "R": -17452.7845}, abs=1e-3)
