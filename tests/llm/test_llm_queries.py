import os
import sys

import pytest
from llm_cases import HERE, SF

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(ROOT, "tools"))
sys.path.insert(0, ROOT)

import __spark_entry__ as entry_points  # noqa: E402
from compare import connect, expected, normalized  # noqa: E402

pytestmark = pytest.mark.skipif(not HERE, reason="sample tables are not there")

ROWS = {"op1_html": "pages", "op8_embeddings": "embeddings"}
# Not a row for each row of a table.
OTHERS = ("pipeline", "op5_packing", "op10_language_id", "op13_whitening")


def test_all_are_registered():
    names = list(entry_points.LLM_QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14))
    assert "pipeline" in names


@pytest.mark.parametrize("name", [n for n in entry_points.LLM_QUERIES if n not in OTHERS])
def test_a_row_for_every_row_and_the_sql(spark, name):
    frame = entry_points.queries()[name](spark, SF)
    columns, rows = normalized(frame.columns, frame.collect())
    assert len(rows) == spark.read.parquet(f"{SF}/{ROWS.get(name, 'documents')}.parquet").count()
    if name in entry_points.LLM_ORACLE:
        assert (columns, rows) == expected(connect(SF), entry_points.LLM_ORACLE[name])
