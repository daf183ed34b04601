"""Dimension refreshes. Each takes the stored dimension and the newest staged rows and returns the new one."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslake import schemas
from saleslake.functions.dates import day, valid_on
from saleslake.functions.keys import UNKNOWN_KEY, surrogate_key
from saleslake.operators.unique_keys import Hashed, salted_key, with_unique_keys
from saleslake.operators.upsert import upsert

# The member that sales without a campaign point to.
UNKNOWN_CAMPAIGN = {"campaign_id": "UNKNOWN", "campaign_name": "No Campaign (Organic)", "channel": "Organic"}

_BEFORE_ALL = datetime(1900, 1, 1, tzinfo=timezone.utc)

# Customer attributes whose change opens a new version.
TRACKED = ("name", "email", "city")


def _instant(value: datetime) -> Column:
    return F.lit(value).cast("timestamp")


def refresh_products(dim: DataFrame, products: DataFrame, loaded_at: datetime, hashed: Hashed = salted_key) -> DataFrame:
    """Overwrite product attributes in place; a product keeps the key it got first, and gets one that no other has."""
    source = products.withColumns(
        {"product_key": hashed(F.col("product_id"), F.lit(0)), "updated_at": _instant(loaded_at)}
    )
    source = with_unique_keys(dim, source, "product_id", "product_key", hashed)
    return upsert(dim, source, "product_id", insert_only=["product_key"], version="updated_at")


def refresh_campaigns(dim: DataFrame, campaigns: DataFrame, loaded_at: datetime) -> DataFrame:
    """Overwrite campaign attributes in place and make sure the unknown member is there."""
    source = campaigns.withColumns(
        {
            "campaign_key": surrogate_key(F.col("campaign_id")),
            "duration_days": F.datediff("end_date", "start_date").cast("long"),
            "updated_at": _instant(loaded_at),
        }
    )
    return _with_member(dim, source.unionByName(_unknown_campaign(dim.sparkSession).select(*source.columns)), loaded_at)


def with_unknown_campaign(dim: DataFrame, loaded_at: datetime) -> DataFrame:
    """`dim` plus the unknown member if it is missing; an existing one is left as it is."""
    return _with_member(dim, _unknown_campaign(dim.sparkSession), loaded_at)


def _with_member(dim: DataFrame, source: DataFrame, loaded_at: datetime) -> DataFrame:
    """`dim` after merging campaigns, the unknown member among them.

    The member is older than any other row, so one that is stored stays as it is; `dim` is read once.
    """
    source = with_unique_keys(dim, source, "campaign_id", "campaign_key")
    merged = upsert(dim, source, "campaign_id", insert_only=["campaign_key"], version="updated_at")
    added = F.col("updated_at") == _instant(_BEFORE_ALL)
    return merged.withColumn("updated_at", F.when(added, _instant(loaded_at)).otherwise(F.col("updated_at")))


def _unknown_campaign(spark: SparkSession) -> DataFrame:
    values = {name: F.lit(value) for name, value in UNKNOWN_CAMPAIGN.items()}
    values["campaign_key"] = F.lit(UNKNOWN_KEY)
    values["updated_at"] = _instant(_BEFORE_ALL)
    return spark.range(1).select(
        *(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.DIM_CAMPAIGN.fields)
    )


def changed(tracked: Sequence[str], old: str, new: str, null_safe: bool = True) -> Column:
    """Some tracked attribute differs. With `null_safe=False` a null on either side never counts."""
    tests = []
    for c in tracked:
        a, b = F.col(f"{old}.{c}"), F.col(f"{new}.{c}")
        tests.append(~a.eqNullSafe(b) if null_safe else F.coalesce(a != b, F.lit(False)))
    result = tests[0]
    for test in tests[1:]:
        result = result | test
    return result


def _compared(dim: DataFrame, customers: DataFrame, as_of: date, tracked: Sequence[str], null_safe: bool, first_start: date | None) -> DataFrame:
    """(old, versions, differs) of each customer that has a version valid on `as_of` or is in the source.

    `old` is that version or null, `versions` what takes its place, `differs` whether that is something else.
    """
    columns = schemas.DIM_CUSTOMER.fieldNames()
    attributes = [c for c in customers.columns if c in columns and c != "customer_id"]
    on = day(as_of)
    covers = valid_on(on, F.col("effective_start_date"), F.col("effective_end_date"))

    covering = dim.where(covers).select("customer_id", F.struct(*columns).alias("old"))
    source = customers.select("customer_id", F.struct(*attributes).alias("new"))
    later = (
        dim.where(F.col("effective_start_date") > on)
        .groupBy("customer_id")
        .agg(F.min("effective_start_date").alias("next_start"))
    )
    joined = covering.join(source, "customer_id", "full_outer").join(later, "customer_id", "left")

    is_new = F.col("old").isNull()
    is_changed = F.col("new").isNotNull() & changed(tracked, "old", "new", null_safe)
    same_day = F.col("old.effective_start_date") == on

    opened_on = day(first_start or as_of)
    first_values = {
        "customer_key": surrogate_key(F.col("customer_id"), opened_on.cast("string")),
        "customer_id": F.col("customer_id"),
        "effective_start_date": opened_on,
        "effective_end_date": F.date_sub("next_start", 1),
        "is_current": F.col("next_start").isNull(),
    }
    first = F.struct(*(first_values.get(c, F.col(f"new.{c}")).alias(c) for c in columns))
    kept = F.col("old")
    closed = kept.withField("effective_end_date", F.date_sub(on, 1)).withField("is_current", F.lit(False))
    replaced_in_place = kept
    for c in attributes:
        replaced_in_place = replaced_in_place.withField(c, F.col(f"new.{c}"))
    replacement = replaced_in_place.withField("effective_start_date", on).withField(
        "customer_key", surrogate_key(F.col("customer_id"), on.cast("string"))
    )
    versions = (
        F.when(is_new, F.array(first))
        .when(is_changed & same_day, F.array(replaced_in_place))
        .when(is_changed, F.array(closed, replacement))
        .otherwise(F.array(kept))
    )
    return joined.select("old", versions.alias("versions"), (is_new | is_changed).alias("differs"))


def refresh_customers(
    dim: DataFrame,
    customers: DataFrame,
    as_of: date,
    tracked: Sequence[str] = TRACKED,
    null_safe: bool = True,
    first_start: date | None = None,
) -> DataFrame:
    """Customer versions after applying the rows known on `as_of` (unique per customer).

    The version valid on `as_of` is compared with the source row:

    * same attributes: nothing happens, so a repeated load changes nothing;
    * changed, and the version began earlier: it ends the day before and a new one takes over the rest
      of its interval;
    * changed, and it began on `as_of` itself: its attributes are replaced, since a second version of the
      same day would have an inverted interval and the same key;
    * no version valid on that day: a first version opens on `first_start` (default `as_of`) and reaches
      up to the customer's next version, if a later load already made one.

    Customers missing from the source keep their versions. Only versions valid on `as_of` take part in
    the join; the rest of the history passes through without a shuffle.
    """
    columns = schemas.DIM_CUSTOMER.fieldNames()
    covers = valid_on(day(as_of), F.col("effective_start_date"), F.col("effective_end_date"))
    rebuilt = _compared(dim, customers, as_of, tracked, null_safe, first_start).select(F.explode("versions").alias("v")).select("v.*")
    return dim.where(~covers).select(*columns).unionByName(rebuilt)


def customer_changes(
    dim: DataFrame,
    customers: DataFrame,
    as_of: date,
    tracked: Sequence[str] = TRACKED,
    null_safe: bool = True,
    first_start: date | None = None,
) -> DataFrame:
    """What `refresh_customers` changes: (old, versions), the version that goes (null: none) and those that come for it.

    Versions that ended before `as_of` play no part, so `dim` need not have them.
    """
    compared = _compared(dim, customers, as_of, tracked, null_safe, first_start)
    return compared.where(F.coalesce("differs", F.lit(False))).select("old", "versions")


def empty_dimension(spark: SparkSession, name: str) -> DataFrame:
    return schemas.empty(spark, schemas.DIMENSIONS[name])
