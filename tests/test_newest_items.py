"""Lines of the sample tables are ranked by numbers, in tasks whose sorts stay small."""

from datetime import datetime

from conftest import plan_of, rows_of

from saleslake.session import SORTED_BYTES, setting, sort_in_memory
from saleslake.sources.sample_tables import SampleTables

KEYS = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_only_numbers_are_shuffled_and_sorted(spark):
    plan = plan_of(SampleTables(spark, "/root/testdata/sf0.001").newest_items())
    before_ids, after = plan.split("Exchange")[0], plan.split("Exchange")[1]
    assert "concat(TXN" in before_ids and "decimal(27,9)" in before_ids
    assert "concat(TXN" not in after and "decimal(27,9)" not in after


def test_lines_without_an_id_are_one_line(spark, tmp_path):
    on = [datetime(2024, 1, n) for n in (1, 2, 3)]
    rows = [(1, 1, 5, 1, 2.0, 3.5, on[0]), (1, 1, 6, 1, 2.0, 4.5, on[1]), (None, 1, 7, 1, 1.0, 1.0, on[0]), (2, None, 8, 1, 1.0, 1.0, on[2])]
    shape = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp"
    spark.createDataFrame(rows, shape).write.parquet(str(tmp_path / "lineitem.parquet"))
    newest = SampleTables(spark, str(tmp_path)).newest_items()
    assert rows_of(newest, "transaction_item_id", "transaction_id", "product_id", "quantity") == sorted(
        [("TXN1-1", "TXN1", "PROD6", 2), (None, "TXN2", "PROD8", 1)], key=repr
    )


def test_larger_limits_are_lowered_and_smaller_ones_stay(spark):
    with setting(spark, KEYS[0], "134217728b"), setting(spark, KEYS[1], "8m"):
        sort_in_memory(spark)
        assert [spark.conf.get(key) for key in KEYS] == [SORTED_BYTES, "8m"]
