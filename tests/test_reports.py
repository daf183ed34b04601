"""Reports over skewed sales against plain joins, and the shape of their plans."""

import re

import pytest
from conftest import plan_of, rows_of
from pyspark.sql import functions as F

from saleslake import schemas
from saleslake.operators.calendar import build_dim_date
from saleslake.plans import reports
from conftest import d

START, END = d("2023-01-01"), d("2024-12-31")


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    """One customer and one product have half of the lines; one order has hundreds of them."""
    folder = str(tmp_path_factory.mktemp("star"))
    order = F.expr("if(id % 10 = 0, 0, id div 3)")
    fact = spark.range(6000).select(
        F.concat(F.lit("i"), F.col("id")).alias("transaction_item_id"),
        F.concat(F.lit("t"), order).alias("transaction_id"),
        F.when(order % 2 == 0, F.lit(0)).otherwise(order % 40).cast("long").alias("customer_key"),
        F.expr("if(id % 2 = 0, 0, id % 25)").alias("product_key"),
        F.when(order % 3 == 0, order % 4).otherwise(F.lit(-1)).cast("long").alias("campaign_key"),
        F.date_format(F.date_add(F.lit(START), (order % 700).cast("int")), "yyyyMMdd").cast("long").alias("date_key"),
        F.date_add(F.lit(START), (order % 700).cast("int")).alias("sale_date"),
        (F.col("id") % 7 + 1).alias("quantity"),
        F.lit(2).cast(schemas.MONEY).alias("unit_price"),
        ((F.col("id") % 7 + 1) * 2).cast(schemas.AMOUNT).alias("line_amount"),
        (order + 1).cast(schemas.MONEY).alias("transaction_total_amount"),
    )
    # Pairs of keys are versions of one customer; the second one lives elsewhere and is current.
    customers = spark.range(40).selectExpr(
        "id AS customer_key", "concat('c', id div 2) AS customer_id", "concat('city', id % 5) AS city",
        "date_add(date'2022-01-15', cast((id div 2) * 10 as int)) AS signup_date", "id % 2 = 1 AS is_current",
    )
    products = spark.range(25).selectExpr(
        "id AS product_key", "concat('p', id) AS product_id", "concat('name', id) AS product_name", "concat('cat', id % 4) AS category"
    )
    campaigns = spark.range(-1, 4).selectExpr(
        "id AS campaign_key", "concat('k', id) AS campaign_id", "concat('n', id) AS campaign_name", "concat('ch', id % 2) AS channel"
    )
    frames = {"fact": fact, "customers": customers, "products": products, "campaigns": campaigns}
    for name, frame in frames.items():
        frame.write.parquet(f"{folder}/{name}")
        frames[name] = spark.read.parquet(f"{folder}/{name}")
    build_dim_date(spark, START, END).write.parquet(f"{folder}/calendar")
    frames["calendar"] = spark.read.parquet(f"{folder}/calendar")
    return frames


def sql(star, text):
    return rows_of(next(iter(star.values())).sparkSession.sql(text, **star))


def test_revenue_by_category_month(star):
    got = reports.revenue_by_category_month(star["fact"], star["products"], star["calendar"])
    assert rows_of(got) == sql(
        star,
        """SELECT category, cast(year(sale_date) AS bigint), cast(month(sale_date) AS bigint), sum(line_amount)
           FROM {fact} JOIN {products} USING (product_key) GROUP BY ALL""",
    )


def test_campaign_performance(star):
    got = reports.campaign_performance(star["fact"], star["campaigns"])
    assert rows_of(got.drop("revenue_share")) == sql(
        star,
        """SELECT campaign_id, campaign_name, channel, sum(line_amount), count(DISTINCT transaction_id), count(*)
           FROM {fact} JOIN {campaigns} USING (campaign_key) GROUP BY ALL""",
    )
    assert sum(r["revenue_share"] for r in got.collect()) == pytest.approx(1)


def test_product_performance(star):
    got = reports.product_performance(star["fact"], star["products"])
    assert rows_of(got) == sql(
        star,
        """SELECT product_id, product_name, category, sum(quantity), sum(line_amount), count(DISTINCT transaction_id)
           FROM {fact} JOIN {products} USING (product_key) GROUP BY ALL""",
    )


def test_sales_by_city(star):
    got = reports.sales_by_city(star["fact"], star["customers"])
    assert rows_of(got) == sql(
        star,
        """WITH located AS (SELECT f.*, c.city AS city_then, n.city AS city_now FROM {fact} f
             JOIN {customers} c USING (customer_key) JOIN {customers} n ON n.customer_id = c.customer_id AND n.is_current)
           SELECT 'as_was', city_then, sum(line_amount), count(DISTINCT transaction_id) FROM located GROUP BY ALL
           UNION ALL
           SELECT 'as_is', city_now, sum(line_amount), count(DISTINCT transaction_id) FROM located GROUP BY ALL""",
    )


@pytest.mark.parametrize("by_signup", [False, True])
def test_cohort_retention(star, by_signup):
    got = reports.cohort_retention(star["fact"], star["customers"], by_signup)
    cohort = "signup" if by_signup else "first"
    assert rows_of(got.drop("retention")) == sql(
        star,
        f"""WITH months AS (SELECT DISTINCT customer_id, trunc(sale_date, 'month') AS m FROM {{fact}} JOIN {{customers}} USING (customer_key)),
            each AS (SELECT customer_id, min(m) AS first FROM months GROUP BY ALL),
            signups AS (SELECT customer_id, min(trunc(signup_date, 'month')) AS signup FROM {{customers}} GROUP BY ALL),
            cohorts AS (SELECT customer_id, m, {cohort} AS c FROM months JOIN each USING (customer_id) JOIN signups USING (customer_id)),
            sizes AS (SELECT c, count(DISTINCT customer_id) AS n FROM cohorts GROUP BY ALL)
            SELECT c, cast(months_between(m, c) AS bigint), count(*), n FROM cohorts JOIN sizes USING (c) GROUP BY ALL""",
    )


def test_order_metrics_count_each_total_once(star):
    got = reports.order_metrics(star["fact"]).select("year", "month", "orders", "lines", "units", "order_value")
    assert rows_of(got) == sql(
        star,
        """WITH orders AS (SELECT DISTINCT transaction_id, sale_date, transaction_total_amount AS total FROM {fact}),
            per_order AS (SELECT transaction_id, count(*) AS lines, sum(quantity) AS units FROM {fact} GROUP BY ALL)
           SELECT cast(year(sale_date) AS bigint), cast(month(sale_date) AS bigint), count(*), sum(lines), sum(units), sum(total)
           FROM orders JOIN per_order USING (transaction_id) GROUP BY ALL""",
    )


def test_calendar_sales(star):
    got = reports.calendar_sales(star["fact"], star["calendar"])
    assert rows_of(got) == sql(
        star,
        """SELECT year, quarter, day_name, is_weekend, sum(line_amount), sum(quantity), count(*)
           FROM {fact} JOIN {calendar} USING (date_key) GROUP BY ALL""",
    )


@pytest.mark.parametrize("name", ["product_performance", "sales_by_city", "cohort_retention", "campaign_performance"])
def test_fact_is_grouped_before_it_is_joined(spark, star, name):
    other = {"product_performance": "products", "campaign_performance": "campaigns"}.get(name, "customers")
    plan = plan_of(getattr(reports, name)(star["fact"], star[other]))
    lines = plan.splitlines()
    fact_scan = next(i for i, line in enumerate(lines) if "FileScan" in line and ("line_amount" in line or "sale_date" in line))
    depth = re.search(r"[A-Z*]", lines[fact_scan]).start()
    above = []
    for line in reversed(lines[:fact_scan]):
        at = re.search(r"[A-Z*]", line)
        if at and at.start() < depth:
            above.append(line)
            depth = at.start()
    operators = [re.search(r"(HashAggregate|\w*Join)\b", line) for line in above]
    kinds = [m.group(1) for m in operators if m]
    assert kinds[0] == "HashAggregate"
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scans_read_only_the_needed_columns(star):
    plan = plan_of(reports.calendar_sales(star["fact"], star["calendar"]))
    assert "ReadSchema: struct<date_key:bigint,quantity:bigint,line_amount:decimal(38,9)>" in plan
