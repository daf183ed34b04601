import glob
import os
from datetime import timedelta

import pytest
from conftest import d, final_plan_of, money, plan_of, rows_of, staged
from pyspark.sql import functions as F

from saleslake import schemas, storage
from saleslake.functions.dates import each_day
from saleslake.operators import checks
from saleslake.operators.attribution import attribute, campaign_by_day
from saleslake.operators.dedup import latest_per_key
from saleslake.plans.fact import build_sales, changed_days, dropped_of, load_fact, resolve_lines, stray_lines
from saleslake.sinks.tables import create_tables, write_fact
from saleslake.sources.tables import read_fact

JAN, JUN = d("2024-01-01"), d("2024-06-30")
DAY = d("2024-03-10")


@pytest.fixture(scope="module")
def dims(spark):
    customers = spark.createDataFrame(
        [
            (1, "c1", "N", "e", "Old town", JAN, JAN, d("2024-03-09"), False),
            (2, "c1", "N", "e", "New town", JAN, d("2024-03-10"), None, True),
            (3, "c2", "M", "e", "Old town", JAN, d("2024-02-01"), None, True),
        ],
        schemas.DIM_CUSTOMER,
    )
    products = spark.createDataFrame(
        [(10, "p1", "Chair", "Home", money("5"), None), (11, "p2", "Book", "Books", money("7"), None)],
        "product_key long, product_id string, product_name string, category string, price decimal(27,9), updated_at timestamp",
    )
    campaigns = spark.createDataFrame(
        [(-1, "UNKNOWN", "Organic"), (20, "k1", "Email")], "campaign_key long, campaign_id string, channel string"
    )
    return customers, products, campaigns


def headers(spark, *rows):
    return staged(spark, "transactions", [(t, c, on, money(total), k, on) for t, c, on, total, k in rows])


def lines(spark, *rows):
    return staged(spark, "transaction_items", [(i, t, p, q, money(price), on) for i, t, p, q, price, on in rows])


def build(spark, dims, items, txns, start=JAN, end=JUN, **options):
    customers, products, campaigns = dims
    return build_sales(
        latest_per_key(items, ["transaction_item_id"]),
        latest_per_key(txns, ["transaction_id"]),
        customers,
        products,
        campaigns,
        start,
        end,
        **options,
    )


def test_lookups(spark, dims):
    txns = headers(
        spark,
        ("t1", "c1", d("2024-03-09"), "10", "k1"),
        ("t2", "c1", d("2024-03-10"), "20", None),
        ("t3", "c2", d("2024-06-30"), "30", "gone"),
        ("t4", "c2", d("2024-05-01"), "40", ""),
        ("t5", "c2", d("2024-07-01"), "50", None),
    )
    items = lines(spark, *((f"i{n}", f"t{n}", "p1", 2, "1.25", DAY) for n in range(1, 6)))
    sales = build(spark, dims, items, txns)
    assert rows_of(sales, "transaction_item_id", "customer_key", "campaign_key", "date_key") == [
        ("i1", 1, 20, 20240309),
        ("i2", 2, -1, 20240310),
        ("i3", 3, -1, 20240630),
        ("i4", 3, -1, 20240501),
    ]
    first = sales.where("transaction_item_id = 'i1'").first()
    assert (first["line_amount"], first["transaction_total_amount"], first["product_key"]) == (money("2.5"), money("10"), 10)
    assert sales.columns == schemas.FACT_SALES.fieldNames()


def test_lines_without_customer_version_or_product_are_reported(spark, dims):
    customers, products, campaigns = dims
    txns = headers(
        spark,
        ("t1", "c1", DAY, "1", None),
        ("t2", "c2", d("2024-01-15"), "1", None),
        ("t3", "nobody", DAY, "1", None),
        ("t4", None, DAY, "1", None),
    )
    items = lines(
        spark,
        ("ok", "t1", "p1", 1, "1", DAY),
        ("no product", "t1", "p9", 1, "1", DAY),
        ("null product", "t1", None, 1, "1", DAY),
        ("before first version", "t2", "p1", 1, "1", DAY),
        ("no customer", "t3", "p9", 1, "1", DAY),
        ("null customer", "t4", "p1", 1, "1", DAY),
        ("no header", "t9", "p1", 1, "1", DAY),
    )
    for limit in (10**9, 0):
        resolved = resolve_lines(items, txns, customers, products, campaigns, JAN, JUN, broadcast_limit=limit)
        assert rows_of(dropped_of(resolved), "transaction_item_id", "missing") == [
            ("before first version", "customer"),
            ("no customer", "customer,product"),
            ("no product", "product"),
            ("null customer", "customer"),
            ("null product", "product"),
        ]
    assert rows_of(build(spark, dims, items, txns), "transaction_item_id") == [("ok",)]
    fact = build(spark, dims, items, txns)
    assert rows_of(checks.reconcile(items, txns, fact, JAN, JUN)) == [(6, 1, False)]


def test_newest_delivery_of_header_and_line_counts(spark, dims):
    txns = staged(
        spark,
        "transactions",
        [
            ("t1", "c1", DAY, money("10"), None, d("2024-03-10")),
            ("t1", "c1", DAY, money("12"), None, d("2024-03-12")),
            ("t1", "c1", DAY, money("11"), None, d("2024-03-11")),
        ],
    )
    items = lines(
        spark, ("i1", "t1", "p1", 1, "1", d("2024-03-10")), ("i1", "t1", "p1", 3, "1", d("2024-03-11")),
        ("i2", "t1", "p2", 1, "9", d("2024-03-10")),
    )
    sales = build(spark, dims, items, txns)
    assert rows_of(sales, "transaction_item_id", "quantity", "transaction_total_amount") == [
        ("i1", 3, money("12")),
        ("i2", 1, money("12")),
    ]
    # A raw count takes every copy of line and header for a line of its own.
    assert rows_of(checks.reconcile(items, txns, sales, JAN, JUN)) == [(2, 2, True)]
    assert rows_of(checks.reconcile(items, txns, sales, JAN, JUN, raw=True)) == [(9, 2, False)]


def test_shuffled_and_broadcast_lookups_agree_on_skewed_input(spark, dims):
    """A customer, a product, a transaction and the missing campaign hold a third of the rows or more."""
    customers, products, campaigns = dims
    many = spark.range(3000)
    txns = many.select(
        F.concat(F.lit("t"), F.col("id")).alias("transaction_id"),
        F.expr("if(id % 3 = 0, 'c1', if(id % 3 = 1, 'c2', 'nobody'))").alias("customer_id"),
        F.expr("date_add(date'2024-02-01', cast(id % 60 as int))").alias("transaction_date"),
        F.lit(1).cast(schemas.MONEY).alias("total_amount"),
        F.expr("if(id % 5 = 0, 'k1', null)").alias("campaign_id"),
    )
    items = spark.range(9000).select(
        F.concat(F.lit("i"), F.col("id")).alias("transaction_item_id"),
        F.expr("if(id % 3 = 0, 't0', concat('t', id % 3000))").alias("transaction_id"),
        F.expr("if(id % 2 = 0, 'p1', 'p2')").alias("product_id"),
        F.col("id").alias("quantity"),
        F.lit(2).cast(schemas.MONEY).alias("price"),
    )
    args = (items, txns, customers, products, campaigns, JAN, JUN)
    small = build_sales(*args)
    large = build_sales(*args, broadcast_limit=0)
    assert rows_of(small) == rows_of(large)
    expected = spark.sql(
        """SELECT i.transaction_item_id, c.customer_key, p.product_key, coalesce(k.campaign_key, -1) AS campaign_key
           FROM {i} i JOIN {t} t USING (transaction_id)
           JOIN {c} c ON c.customer_id = t.customer_id AND t.transaction_date >= c.effective_start_date
                AND (c.effective_end_date IS NULL OR t.transaction_date <= c.effective_end_date)
           JOIN {p} p USING (product_id) LEFT JOIN {k} k ON k.campaign_id = t.campaign_id""",
        i=items, t=txns, c=customers, p=products, k=campaigns,
    )
    keys = ("transaction_item_id", "customer_key", "product_key", "campaign_key")
    assert rows_of(large, *keys) == rows_of(expected, *keys)
    for plan in (plan_of(small), plan_of(large)):
        assert "NestedLoop" not in plan and "Cartesian" not in plan


TXNS = [
    ("t1", "c1", d("2024-03-08"), "10", "k1"),
    ("t2", "c1", d("2024-03-09"), "20", None),
    ("t3", "c2", d("2024-03-10"), "30", None),
    ("t4", "c2", d("2024-03-11"), "40", "k1"),
]
ITEMS = [(f"{t}-{n}", t, p, n + 1, "1.10", DAY) for t in ("t1", "t2", "t3", "t4") for n, p in enumerate(("p1", "p2"))]


def test_loading_twice_and_day_by_day_equals_one_load(spark, dims, layout):
    create_tables(spark, layout)
    items, txns = lines(spark, *ITEMS), headers(spark, *TXNS)
    first, last = d("2024-03-08"), d("2024-03-11")
    load_fact(spark, layout, build(spark, dims, items, txns, first, last), first, last)
    once = rows_of(read_fact(spark, layout, first, last))
    assert len(once) == 8
    load_fact(spark, layout, build(spark, dims, items, txns, first, last), first, last)
    assert rows_of(read_fact(spark, layout, first, last)) == once
    for offset in (2, 0, 3, 1, 0):
        on = first + timedelta(days=offset)
        load_fact(spark, layout, build(spark, dims, items, txns, on, on), on, on)
        assert rows_of(read_fact(spark, layout, first, last)) == once


def test_day_by_day_into_an_empty_table(spark, dims, layout):
    items, txns = lines(spark, *ITEMS), headers(spark, *TXNS)
    first, last = d("2024-03-08"), d("2024-03-11")
    for offset in range(4):
        on = first + timedelta(days=offset)
        load_fact(spark, layout, build(spark, dims, items, txns, on, on), on, on)
    assert rows_of(read_fact(spark, layout, first, last)) == rows_of(build(spark, dims, items, txns, first, last))


def test_lines_not_delivered_again_stay(spark, dims, layout):
    txns = headers(spark, *TXNS)
    first, last = d("2024-03-08"), d("2024-03-11")
    load_fact(spark, layout, build(spark, dims, lines(spark, *ITEMS), txns, first, last), first, last)
    changed = lines(spark, ("t2-0", "t2", "p1", 99, "1.10", DAY), ("t2-9", "t2", "p1", 5, "1.10", DAY))
    load_fact(spark, layout, build(spark, dims, changed, txns, first, last), first, last)
    quantities = dict(rows_of(read_fact(spark, layout, first, last), "transaction_item_id", "quantity"))
    assert len(quantities) == 9
    assert (quantities["t2-0"], quantities["t2-1"], quantities["t2-9"], quantities["t4-1"]) == (99, 2, 5, 2)


def test_days_that_do_not_change_keep_their_files(spark, dims, layout):
    create_tables(spark, layout)
    first, last = d("2024-03-08"), d("2024-03-11")
    items, txns = lines(spark, *ITEMS), headers(spark, *TXNS)
    load_fact(spark, layout, build(spark, dims, items, txns, first, last), first, last)

    def files():
        return {path: os.stat(path).st_mtime_ns for path in glob.glob(f"{layout.fact_sales}/sale_date=*/*.parquet")}

    before = files()
    load_fact(spark, layout, build(spark, dims, items, txns, first, last), first, last)
    assert files() == before
    stored = read_fact(spark, layout, first, last)
    assert changed_days(stored, stored) == []
    one = rows_of(stored, "transaction_item_id", "sale_date")[0]
    altered = stored.withColumn("quantity", F.when(F.col("transaction_item_id") == one[0], F.col("quantity") + 1).otherwise(F.col("quantity")))
    assert changed_days(stored, altered) == [one[1]]
    frozen = spark.createDataFrame(altered.collect(), altered.schema)
    load_fact(spark, layout, frozen, first, last)
    after = files()
    assert {p for p in before if after.get(p) != before[p]} == {p for p in before if f"sale_date={one[1]}" in p}
    assert rows_of(read_fact(spark, layout, first, last)) == rows_of(frozen)


def test_a_date_moved_within_the_range_leaves_nothing_behind(spark, dims, layout):
    first, last = d("2024-03-08"), d("2024-03-11")
    items = lines(spark, *ITEMS)
    load_fact(spark, layout, build(spark, dims, items, headers(spark, *TXNS), first, last), first, last)
    moved = headers(spark, ("t1", "c1", d("2024-03-11"), "10", "k1"), *TXNS[1:])
    load_fact(spark, layout, build(spark, dims, items, moved, first, last), first, last)
    stored = read_fact(spark, layout, first, last)
    assert stored.count() == 8
    assert rows_of(stored.where("transaction_id = 't1'").select("sale_date", "date_key").distinct()) == [(last, 20240311)]
    # All sales of the 8th moved away, so its partition is gone.
    assert storage.partition_days(spark, layout.fact_sales, "sale_date") == [first + timedelta(days=n) for n in (1, 2, 3)]


def test_a_date_moved_into_the_range_from_outside_is_reported(spark, dims, layout):
    first, last = d("2024-03-08"), d("2024-03-11")
    items = lines(spark, *ITEMS)
    load_fact(spark, layout, build(spark, dims, items, headers(spark, *TXNS), first, last), first, last)
    moved = headers(spark, ("t1", "c1", last, "10", "k1"), *TXNS[1:])
    load_fact(spark, layout, build(spark, dims, items, moved, last, last), last, last)
    assert rows_of(stray_lines(spark, layout, last, last, first, last)) == [("t1-0", first), ("t1-1", first)]
    load_fact(spark, layout, build(spark, dims, items, moved, first, last), first, last)
    assert stray_lines(spark, layout, last, last, first, last).isEmpty()


def test_loads_touch_only_their_range(spark, dims, layout):
    first, last = d("2024-03-08"), d("2024-03-11")
    load_fact(spark, layout, build(spark, dims, lines(spark, *ITEMS), headers(spark, *TXNS), first, last), first, last)
    before = set(read_fact(spark, layout, first, d("2024-03-10")).inputFiles())
    load_fact(spark, layout, build(spark, dims, lines(spark, *ITEMS), headers(spark, *TXNS), last, last), last, last)
    assert set(read_fact(spark, layout, first, d("2024-03-10")).inputFiles()) == before


def test_fact_reads_are_pruned_and_pushed_down(spark, dims, layout):
    first, last = d("2024-03-08"), d("2024-03-11")
    load_fact(spark, layout, build(spark, dims, lines(spark, *ITEMS), headers(spark, *TXNS), first, last), first, last)
    one = read_fact(spark, layout, DAY, DAY).where("product_key = 10").select("line_amount")
    plan = plan_of(one)
    assert "PartitionFilters: [isnotnull(sale_date" in plan
    assert "EqualTo(product_key,10)" in plan
    assert "ReadSchema: struct<product_key:bigint,line_amount:decimal(38,9)>" in plan
    assert all("sale_date=2024-03-10" in f for f in one.inputFiles())


def test_a_hot_day_is_written_by_several_tasks_and_sorted(spark, layout):
    rows = spark.range(60_000).select(
        F.concat(F.lit("i"), F.col("id")).alias("transaction_item_id"), F.lit("t").alias("transaction_id"),
        F.xxhash64("id").alias("customer_key"), F.col("id").alias("product_key"), F.lit(-1).cast("long").alias("campaign_key"),
        F.lit(20240310).cast("long").alias("date_key"),
        F.expr("if(id % 3 = 0, date'2024-03-10', date_add(date'2024-03-11', cast(id % 5 as int)))").alias("sale_date"),
        F.col("id").alias("quantity"), *(F.lit(1).cast(schemas.FACT_SALES[c].dataType).alias(c) for c in ("unit_price", "line_amount", "transaction_total_amount")),
    ).repartition(16)
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        write_fact(rows, layout, each_day(DAY, d("2024-03-20")))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    hot = read_fact(spark, layout, DAY, DAY)
    assert hot.count() == 20_000
    assert len(hot.inputFiles()) > 1
    for path in hot.inputFiles():
        keys = [r[0] for r in spark.read.parquet(path).select("customer_key").coalesce(1).collect()]
        assert keys == sorted(keys)


def test_days_of_a_large_load_are_one_file_each(spark, layout):
    """A partition of many days that exceeds the advisory size would be cut through all of its days."""
    days = each_day(DAY, DAY + timedelta(days=299))
    rows = spark.range(60_000).select(
        F.concat(F.lit("i"), F.col("id")).alias("transaction_item_id"), F.lit("t").alias("transaction_id"),
        F.xxhash64("id").alias("customer_key"), F.xxhash64("id").alias("product_key"), F.lit(-1).cast("long").alias("campaign_key"),
        F.lit(20240310).cast("long").alias("date_key"),
        F.expr("date_add(date'2024-03-10', cast(id % 300 as int))").alias("sale_date"),
        F.col("id").alias("quantity"), *(F.lit(1).cast(schemas.FACT_SALES[c].dataType).alias(c) for c in ("unit_price", "line_amount", "transaction_total_amount")),
    ).repartition(16)
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        write_fact(rows, layout, days)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    stored = read_fact(spark, layout, days[0], days[-1])
    assert stored.count() == 60_000
    assert len(stored.inputFiles()) == len(days)


def test_write_of_a_century(spark, layout):
    create_tables(spark, layout)
    write_fact(schemas.empty(spark, schemas.FACT_SALES), layout, each_day(d("1900-01-01"), d("2000-01-01")))
    assert read_fact(spark, layout, d("1900-01-01"), d("2000-01-01")).isEmpty()


def test_header_totals(spark):
    txns = headers(spark, ("t1", "c1", DAY, "3.30", None), ("t2", "c1", DAY, "5", None), ("t3", "c1", DAY, "0", None), ("t4", "c1", DAY, "1", None))
    items = lines(spark, ("a", "t1", "p1", 2, "1.10", DAY), ("b", "t1", "p1", 1, "1.10", DAY), ("c", "t2", "p1", 1, "4.99", DAY))
    assert rows_of(checks.header_total_mismatches(items, txns)) == [
        ("t2", money("5"), money("4.99")),
        ("t4", money("1"), money("0")),
    ]


def test_referential_gaps(spark, dims):
    customers, products, campaigns = dims
    txns = headers(
        spark, ("t1", "c1", DAY, "1", "k1"), ("t2", "x", DAY, "1", "gone"), ("t3", "x", DAY, "1", ""), ("t4", None, DAY, "1", None)
    )
    items = lines(spark, ("a", "t1", "p1", 1, "1", DAY), ("b", "t9", "p9", 1, "1", DAY), ("c", "t9", None, 1, "1", DAY))
    assert rows_of(checks.referential_gaps(items, txns, customers, products, campaigns)) == [
        ("transaction_items.product_id", 1, 1),
        ("transaction_items.transaction_id", 1, 2),
        ("transactions.campaign_id", 2, 2),
        ("transactions.customer_id", 1, 2),
    ]
    none = checks.referential_gaps(items.limit(0), txns.limit(0), customers, products, campaigns)
    assert {(r["missing_keys"], r["row_count"]) for r in none.collect()} == {(0, 0)} and none.count() == 4


CAMPAIGNS = [("k1", d("2024-01-05"), d("2024-01-10")), ("k2", d("2024-01-08"), d("2024-01-20")), ("k3", d("2024-01-08"), d("2024-01-08")), ("k4", d("2024-02-01"), d("2024-01-01")), ("k5", d("2023-01-01"), d("2030-01-01"))]


def test_campaign_of_a_day_matches_brute_force(spark):
    campaigns = spark.createDataFrame([(c, c, s, e, "Email") for c, s, e in CAMPAIGNS], schemas.STAGING["marketing_campaigns"])
    first, last = d("2024-01-01"), d("2024-01-25")
    days = [first + timedelta(days=n) for n in range(25)]
    orders = headers(spark, *((f"t{n}", "c1", on, "1", "old") for n, on in enumerate(days)))
    got = dict(rows_of(attribute(orders, campaigns, first, last), "transaction_date", "campaign_id"))
    for on in days:
        active = sorted((-s.toordinal(), c) for c, s, e in CAMPAIGNS if s <= on <= e)
        assert got[on] == (active[0][1] if active else None)
    assert campaign_by_day(campaigns, first, last).count() == 25
    plan = final_plan_of(attribute(orders, campaigns, first, last, eligible=F.col("transaction_id") != "t3"))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
