"""The one place where every table's columns and types are declared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DataType,
    DateType,
    DecimalType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

# Prices and amounts with up to nine decimals; what has more is rejected, never rounded. A fixed decimal keeps sums
# exact; binary floats would not. A product of a whole 32-bit quantity and a price fits an amount exactly.
MONEY = DecimalType(27, 9)
AMOUNT = DecimalType(38, 9)


def _table(required: dict[str, DataType], optional: dict[str, DataType] | None = None) -> StructType:
    return StructType(
        [StructField(name, kind, nullable=False) for name, kind in required.items()]
        + [StructField(name, kind, nullable=True) for name, kind in (optional or {}).items()]
    )


# Column and table names below are fixed values: extracts and reports depend on them.
STAGING: dict[str, StructType] = {
    "customers": _table(
        {"customer_id": StringType()},
        {"name": StringType(), "email": StringType(), "city": StringType(), "signup_date": DateType()},
    ),
    "products": _table(
        {"product_id": StringType()},
        {"product_name": StringType(), "category": StringType(), "price": MONEY},
    ),
    "transactions": _table(
        {"transaction_id": StringType()},
        {
            "customer_id": StringType(),
            "transaction_date": DateType(),
            "total_amount": MONEY,
            "campaign_id": StringType(),
        },
    ),
    "transaction_items": _table(
        {"transaction_item_id": StringType()},
        {"transaction_id": StringType(), "product_id": StringType(), "quantity": LongType(), "price": MONEY},
    ),
    "marketing_campaigns": _table(
        {"campaign_id": StringType()},
        {
            "campaign_name": StringType(),
            "start_date": DateType(),
            "end_date": DateType(),
            "channel": StringType(),
        },
    ),
}

# The partition column every staged row carries: the day it was delivered.
INGEST_DATE = StructField("ingest_date", DateType(), nullable=False)

DIM_DATE = _table(
    {
        "date_key": LongType(),
        "full_date": DateType(),
        "day_of_week": LongType(),
        "day_name": StringType(),
        "day_of_month": LongType(),
        "month": LongType(),
        "month_name": StringType(),
        "quarter": LongType(),
        "year": LongType(),
        "is_weekend": BooleanType(),
    }
)

DIM_CUSTOMER = StructType(
    [
        StructField("customer_key", LongType(), False),
        StructField("customer_id", StringType(), False),
        StructField("name", StringType()),
        StructField("email", StringType()),
        StructField("city", StringType()),
        StructField("signup_date", DateType()),
        StructField("effective_start_date", DateType(), False),
        StructField("effective_end_date", DateType()),
        StructField("is_current", BooleanType(), False),
    ]
)

DIM_PRODUCT = StructType(
    [
        StructField("product_key", LongType(), False),
        StructField("product_id", StringType(), False),
        StructField("product_name", StringType()),
        StructField("category", StringType()),
        StructField("price", MONEY),
        StructField("updated_at", TimestampType(), False),
    ]
)

DIM_CAMPAIGN = StructType(
    [
        StructField("campaign_key", LongType(), False),
        StructField("campaign_id", StringType(), False),
        StructField("campaign_name", StringType()),
        StructField("channel", StringType()),
        StructField("start_date", DateType()),
        StructField("end_date", DateType()),
        StructField("duration_days", LongType()),
        StructField("updated_at", TimestampType(), False),
    ]
)

DIMENSIONS: dict[str, StructType] = {
    "dim_date": DIM_DATE,
    "dim_customer": DIM_CUSTOMER,
    "dim_product": DIM_PRODUCT,
    "dim_campaign": DIM_CAMPAIGN,
}

FACT_SALES = _table(
    {
        "transaction_item_id": StringType(),
        "transaction_id": StringType(),
        "customer_key": LongType(),
        "product_key": LongType(),
        "campaign_key": LongType(),
        "date_key": LongType(),
        "sale_date": DateType(),
        "quantity": LongType(),
        "unit_price": MONEY,
        "line_amount": AMOUNT,
        "transaction_total_amount": MONEY,
    }
)

# Value of one message on the transaction topic; the amount as text, since a parser would round it.
STREAM_EVENT = StructType(
    [
        StructField("transaction_id", StringType()),
        StructField("customer_id", StringType()),
        StructField("amount", StringType()),
        StructField("event_time", StringType()),
    ]
)

WINDOW_COUNTS = StructType(
    [
        StructField("window_start", TimestampType(), False),
        StructField("transaction_count", LongType(), False),
        StructField("total_amount", AMOUNT, False),
    ]
)


def staged(table: str) -> StructType:
    """Columns of a staging table as stored: the extract's columns plus its delivery day."""
    return StructType(list(STAGING[table].fields) + [INGEST_DATE])


def required_columns(schema: StructType) -> list[str]:
    return [field.name for field in schema.fields if not field.nullable]


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    """A frame without rows that Spark knows to be empty, so it drops the joins and unions it is in."""
    return spark.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields)).limit(0)
