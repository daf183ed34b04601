from datetime import timedelta
from decimal import Decimal
from pathlib import Path

import pytest
from conftest import d, money, plan_of, rows_of, staged
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from saleslake import schemas, storage
from saleslake.functions.money import exact_money, line_amount
from saleslake.operators import checks
from saleslake.sinks.tables import (
    STAGING_RETENTION_DAYS,
    apply_retention,
    create_tables,
    drop_expired,
    replace_all,
    replace_day,
    retained,
)
from saleslake.sources.extracts import read_extract, read_history
from saleslake.sources.tables import (
    MissingRange,
    read_dimension,
    read_fact,
    read_staging,
    read_staging_day,
    read_window_counts,
    register_views,
)

DAY, NEXT = d("2024-03-01"), d("2024-03-02")
HEADER = "product_id,product_name,category,price"


def deliver(layout, table, on, *lines):
    path = Path(layout.daily_extract(table, on))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


def load(spark, layout, on):
    return replace_day(read_extract(spark, layout, "products", on), layout, "products", on)


@pytest.fixture
def products(spark, layout):
    create_tables(spark, layout)
    deliver(layout, "products", DAY, HEADER, 'P1,"Chair, oak",Home,10.5', "P2,,Books,")
    load(spark, layout, DAY)
    return layout


def test_extract_is_read_with_its_schema(spark, products):
    assert rows_of(read_staging(spark, products, "products")) == [
        ("P1", "Chair, oak", "Home", money("10.50"), DAY),
        ("P2", None, "Books", None, DAY),
    ]


def test_reloading_a_day_replaces_only_that_day(spark, products):
    deliver(products, "products", NEXT, HEADER, "P3,Lamp,Home,3")
    load(spark, products, NEXT)
    deliver(products, "products", DAY, HEADER, "P9,Desk,Home,9")
    assert load(spark, products, DAY) == 1
    assert rows_of(read_staging(spark, products, "products"), "product_id", "ingest_date") == [("P3", NEXT), ("P9", DAY)]
    assert rows_of(read_staging(spark, products, "products", upto=DAY), "product_id") == [("P9",)]


def test_empty_extract_empties_the_day_and_fails_the_check(spark, products):
    deliver(products, "products", DAY, HEADER)
    assert load(spark, products, DAY) == 0
    assert read_staging(spark, products, "products").isEmpty()
    with pytest.raises(checks.CheckFailed):
        checks.gate(checks.landed(read_staging_day(spark, products, "products", DAY), DAY), "landed")


def test_landed_check_counts_one_day(spark, products):
    check = checks.landed(read_staging_day(spark, products, "products", DAY), DAY)
    assert rows_of(check) == [(2, True)]
    checks.gate(check, "landed")
    assert rows_of(checks.landed(read_staging_day(spark, products, "products", NEXT), NEXT)) == [(0, False)]


@pytest.mark.parametrize(
    "lines",
    [
        (HEADER, "P1,Chair,Home,cheap"),
        (HEADER, "P1,Chair,Home,1", ",Nameless,Home,2"),
        ("product_name,product_id,category,price", "Chair,P1,Home,1"),
        (HEADER, "P1,Chair,Home,1,surplus"),
    ],
    ids=["bad decimal", "null key", "reordered header", "surplus value"],
)
def test_bad_extract_is_rejected_and_the_old_day_stays(spark, products, lines):
    deliver(products, "products", DAY, *lines)
    with pytest.raises((PySparkException, Py4JJavaError)):
        load(spark, products, DAY)
    assert rows_of(read_staging(spark, products, "products"), "product_id") == [("P1",), ("P2",)]


def test_bad_date_is_rejected(spark, layout):
    create_tables(spark, layout)
    deliver(layout, "customers", DAY, "customer_id,name,email,city,signup_date", "C1,n,e,c,2024-13-40")
    with pytest.raises((PySparkException, Py4JJavaError)):
        replace_day(read_extract(spark, layout, "customers", DAY), layout, "customers", DAY)


def test_history_replaces_the_whole_table(spark, products, tmp_path):
    (tmp_path / "products.csv").write_text(f"{HEADER}\nP7,Sofa,Home,70\n")
    replace_all(read_history(spark, str(tmp_path), "products"), products, "products", NEXT)
    assert rows_of(read_staging(spark, products, "products"), "product_id", "ingest_date") == [("P7", NEXT)]


def test_rejected_history_leaves_the_table(spark, products, tmp_path):
    (tmp_path / "products.csv").write_text(f"{HEADER}\nP7,Sofa,Home,70\n,Nameless,Home,1\n")
    with pytest.raises((PySparkException, Py4JJavaError)):
        replace_all(read_history(spark, str(tmp_path), "products"), products, "products", NEXT)
    assert rows_of(read_staging(spark, products, "products"), "product_id") == [("P1",), ("P2",)]


def test_one_day_read_prunes_partitions(spark, products):
    deliver(products, "products", NEXT, HEADER, "P3,Lamp,Home,3")
    load(spark, products, NEXT)
    one_day = read_staging_day(spark, products, "products", NEXT)
    assert "PartitionFilters: [isnotnull(ingest_date" in plan_of(one_day)
    assert all("2024-03-02" in f for f in one_day.inputFiles())


def test_created_tables_are_empty_and_have_their_schemas(spark, layout):
    create_tables(spark, layout)
    create_tables(spark, layout)
    for table in schemas.STAGING:
        frame = read_staging(spark, layout, table)
        assert frame.isEmpty() and frame.columns == schemas.staged(table).fieldNames()
    for name, schema in schemas.DIMENSIONS.items():
        frame = read_dimension(spark, layout, name)
        assert frame.isEmpty() and frame.columns == schema.fieldNames()
    assert read_fact(spark, layout, DAY, NEXT).columns == schemas.FACT_SALES.fieldNames()
    assert read_window_counts(spark, layout).isEmpty()


def test_fact_cannot_be_read_without_a_range(spark, layout):
    with pytest.raises(MissingRange):
        read_fact(spark, layout, None, None)


def test_views_can_be_queried_with_named_parameters(spark, products):
    register_views(spark, products, DAY, NEXT)
    found = spark.sql(
        "SELECT count(*) AS n FROM IDENTIFIER(:table) WHERE ingest_date = :on",
        args={"table": "stg_products", "on": DAY},
    )
    assert found.first()["n"] == 2
    assert spark.sql("SELECT * FROM fact_sales").isEmpty()


def test_retention(spark, layout):
    create_tables(spark, layout)
    today = d("2024-04-30")
    for age in (0, 29, 30, 31, 45):
        on = today - timedelta(days=age)
        rows = spark.createDataFrame([(f"P{age}", "n", "c", money("1"))], schemas.STAGING["products"])
        replace_day(rows, layout, "products", on)
    everything = read_staging(spark, layout, "products")
    kept = rows_of(retained(everything, "ingest_date", today, STAGING_RETENTION_DAYS), "product_id")
    assert kept == [("P0",), ("P29",), ("P30",)]
    apply_retention(spark, layout, today)
    assert rows_of(read_staging(spark, layout, "products"), "product_id") == kept
    assert drop_expired(spark, layout.staging("products"), "ingest_date", today, STAGING_RETENTION_DAYS) == []


def test_work_dir_lies_below_the_shared_folder(spark):
    folder = storage.work_dir(spark, "x")
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        assert folder.startswith(shared)
    assert folder.endswith("/x")


def test_staged_rows_helper(spark):
    rows = staged(spark, "products", [("P1", "n", "c", money("1"), DAY)])
    assert rows.columns[-1] == "ingest_date"


@pytest.mark.parametrize(("text", "value"), [("1.999", "1.999"), ("0.123456789", "0.123456789"), ("5", "5"), ("1e2", "100"), ("-3.50", "-3.5"), ("2.1000000000", "2.1")])
def test_money_keeps_its_digits(spark, text, value):
    got = spark.createDataFrame([(text,)], "t string").select(exact_money(F.col("t")).alias("m")).first()["m"]
    assert got == Decimal(value)


@pytest.mark.parametrize("text", ["1.1234567891", "0.0000000000000000000001", "1000000000000000000", "x", "", "NaN"])
def test_money_that_does_not_fit_is_rejected(spark, layout, text):
    assert spark.createDataFrame([(text,)], "t string").select(exact_money(F.col("t")).alias("m")).first()["m"] is None
    if text:
        path = Path(layout.daily_extract("products", DAY))
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"product_id,product_name,category,price\nP1,n,c,{text}\n")
        with pytest.raises(Exception, match="no exact amount"):
            read_extract(spark, layout, "products", DAY).collect()


@pytest.mark.parametrize("text", ["123456789012345678.123456789", "-0.5", "+7", "1.", "1.5e-12", "12.5\n", " 12.5", "1.1000000000", "007.10"])
def test_plain_money_is_what_a_wider_number_says(spark, text):
    """As the number with 18 decimals, if that has no more than money holds."""
    frame = spark.createDataFrame([(text,)], "t string").select(exact_money(F.col("t")).alias("m"), F.col("t").cast("decimal(38,18)").alias("wide"))
    row = frame.first()
    assert row["m"] == (row["wide"] if row["wide"] == round(row["wide"], 9) else None)


def test_amounts_are_exact(spark):
    row = spark.createDataFrame([(3, Decimal("0.123456789"))], "q long, p decimal(27,9)").select(line_amount(F.col("q"), F.col("p")).alias("a")).first()
    assert row["a"] == Decimal("0.370370367")
