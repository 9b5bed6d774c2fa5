"""The queries as a whole."""

import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    core = {k for k in entry.queries() if k.startswith("q") or k[:2] in ("p1", "p3", "p5")}
    assert core <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.exists(SMALL), reason="no test data")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
