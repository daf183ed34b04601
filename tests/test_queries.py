"""Every registered query against its SQL, over whole tables."""

import os
import sys

import pytest
from conftest import ROOT

sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry_points  # noqa: E402
from compare import connect, expected, normalized  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="sample tables are not there")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


# The optional operators of `llm` have tests of their own.
OWN = [name for name in entry_points.queries() if name not in entry_points.LLM_QUERIES]


def test_every_query_has_its_sql():
    assert set(OWN) == set(entry_points.oracle_sql()) - set(entry_points.LLM_ORACLE)


@pytest.mark.parametrize("name", OWN)
def test_query_matches_sql(spark, duck, name):
    frame = entry_points.queries()[name](spark, SF_DIR)
    columns, rows = normalized(frame.columns, frame.collect())
    assert rows
    assert (columns, rows) == expected(duck, entry_points.oracle_sql()[name])


def test_entry(spark):
    frame = entry_points.entry(spark)
    assert frame.columns == ["category", "year", "month", "revenue"]
    assert frame.count() > 0
