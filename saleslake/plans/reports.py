"""Reports over the star schema.

Each report aggregates the fact on surrogate keys before it joins a dimension. After that step a key
occurs once (or once per month), so a product or customer with a third of all sales costs no more in
the join than any other, and the join input is far smaller than the fact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REVENUE = "decimal(38,9)"


def _revenue(column: str = "line_amount") -> Column:
    return F.sum(column).cast(REVENUE)


def _ratio(part: Column, whole: Column) -> Column:
    return part.cast("double") / whole.cast("double")


def revenue_by_category_month(fact: DataFrame, products: DataFrame, calendar: DataFrame) -> DataFrame:
    # The calendar has one row per day, whatever the sales volume.
    months = F.broadcast(calendar.select("date_key", "year", "month"))
    per_product = (
        fact.select("date_key", "product_key", "line_amount")
        .join(months, "date_key")
        .groupBy("product_key", "year", "month")
        .agg(_revenue().alias("revenue"))
    )
    return (
        per_product.join(products.select("product_key", "category"), "product_key")
        .groupBy("category", "year", "month")
        .agg(_revenue("revenue").alias("revenue"))
    )


def campaign_performance(fact: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Revenue side of campaign performance; there is no cost column to relate it to."""
    per_order = fact.groupBy("campaign_key", "transaction_id").agg(
        _revenue().alias("revenue"), F.count(F.lit(1)).alias("lines")
    )
    per_campaign = per_order.groupBy("campaign_key").agg(
        _revenue("revenue").alias("revenue"),
        F.count(F.lit(1)).alias("orders"),
        F.sum("lines").alias("lines"),
    )
    # Over the campaigns, of which there are few; the fact is scanned once.
    total = F.sum("revenue").over(Window.partitionBy(F.lit(0)))
    return per_campaign.withColumn("total", total).join(
        campaigns.select("campaign_key", "campaign_id", "campaign_name", "channel"), "campaign_key"
    ).select(
        "campaign_id",
        "campaign_name",
        "channel",
        "revenue",
        "orders",
        "lines",
        _ratio(F.col("revenue"), F.col("total")).alias("revenue_share"),
    )


def cohort_retention(fact: DataFrame, customers: DataFrame, by_signup: bool = False) -> DataFrame:
    """Active customers by months since the cohort's month (first purchase, or signup).

    A customer has several surrogate keys over time, so activity is counted on the natural id.
    """
    month = F.trunc("sale_date", "month")
    per_version = fact.select("customer_key", month.alias("active_month")).distinct()
    signup = F.trunc("signup_date", "month").alias("signup_month")
    active = (
        per_version.join(customers.select("customer_key", "customer_id", signup), "customer_key")
        .groupBy("customer_id", "active_month")
        .agg(F.min("signup_month").alias("signup_month"))
    )
    # At most one row per month and customer is left, so the window stays small for every customer.
    mine = Window.partitionBy("customer_id")
    first_month = F.min("active_month").over(mine)
    cohort = F.min("signup_month").over(mine) if by_signup else first_month
    per_customer = active.select(
        "active_month", cohort.alias("cohort_month"), first_month.alias("first_month")
    )
    since = F.months_between("active_month", "cohort_month").cast("long")
    counted = per_customer.groupBy("cohort_month", since.alias("months_since")).agg(
        F.count(F.lit(1)).alias("active_customers"),
        F.count_if(F.col("active_month") == F.col("first_month")).alias("first_purchases"),
    )
    cohort_size = F.sum("first_purchases").over(Window.partitionBy("cohort_month"))
    return counted.select(
        "cohort_month",
        "months_since",
        "active_customers",
        cohort_size.alias("cohort_size"),
        _ratio(F.col("active_customers"), cohort_size).alias("retention"),
    )


def order_metrics(fact: DataFrame) -> DataFrame:
    """Orders, basket size and order value by month.

    The order total is repeated on each of its lines, so it is taken once per order before summing.
    """
    per_order = fact.groupBy("transaction_id").agg(
        F.max("sale_date").alias("sale_date"),
        F.max("transaction_total_amount").alias("order_total"),
        F.count(F.lit(1)).alias("lines"),
        F.sum("quantity").alias("units"),
    )
    orders = F.count(F.lit(1))
    return per_order.groupBy(
        F.year("sale_date").cast("long").alias("year"), F.month("sale_date").cast("long").alias("month")
    ).agg(
        orders.alias("orders"),
        F.sum("lines").alias("lines"),
        F.sum("units").alias("units"),
        _revenue("order_total").alias("order_value"),
        _ratio(F.sum("lines"), orders).alias("lines_per_order"),
        _ratio(_revenue("order_total"), orders).alias("average_order_value"),
    )


def sales_by_city(fact: DataFrame, customers: DataFrame) -> DataFrame:
    """Revenue and orders by the city the customer had at the sale, and by the one they have now."""
    per_order = fact.groupBy("customer_key", "transaction_id").agg(_revenue().alias("revenue"))
    per_version = per_order.groupBy("customer_key").agg(
        _revenue("revenue").alias("revenue"), F.count(F.lit(1)).alias("orders")
    )
    now = customers.where("is_current").select("customer_id", F.col("city").alias("city_now"))
    located = per_version.join(
        customers.select("customer_key", "customer_id", F.col("city").alias("city_then")), "customer_key"
    ).join(now, "customer_id")
    views = F.explode(
        F.array(
            F.struct(F.lit("as_was").alias("view"), F.col("city_then").alias("city")),
            F.struct(F.lit("as_is").alias("view"), F.col("city_now").alias("city")),
        )
    )
    return (
        located.select(views.alias("v"), "revenue", "orders")
        .groupBy("v.view", "v.city")
        .agg(_revenue("revenue").alias("revenue"), F.sum("orders").alias("orders"))
    )


def product_performance(fact: DataFrame, products: DataFrame) -> DataFrame:
    per_order = fact.groupBy("product_key", "transaction_id").agg(
        F.sum("quantity").alias("units"), _revenue().alias("revenue")
    )
    per_product = per_order.groupBy("product_key").agg(
        F.sum("units").alias("units"),
        _revenue("revenue").alias("revenue"),
        F.count(F.lit(1)).alias("orders"),
    )
    return per_product.join(
        products.select("product_key", "product_id", "product_name", "category"), "product_key"
    ).select("product_id", "product_name", "category", "units", "revenue", "orders")


def calendar_sales(fact: DataFrame, calendar: DataFrame) -> DataFrame:
    """Revenue and units by quarter, weekday and weekend flag."""
    per_day = fact.groupBy("date_key").agg(
        _revenue().alias("revenue"), F.sum("quantity").alias("units"), F.count(F.lit(1)).alias("lines")
    )
    # Both sides have one row per day here.
    days = calendar.select("date_key", "year", "quarter", "day_name", "is_weekend")
    return (
        per_day.join(days, "date_key")
        .groupBy("year", "quarter", "day_name", "is_weekend")
        .agg(
            _revenue("revenue").alias("revenue"),
            F.sum("units").alias("units"),
            F.sum("lines").alias("lines"),
        )
    )
