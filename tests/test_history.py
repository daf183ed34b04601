"""The stored customer history equals the rebuilt one, and a load touches only what it changes."""

import os
import random

import pytest
from conftest import d, rows_of

from saleslake.operators.dimensions import empty_dimension, refresh_customers
from saleslake.operators.upsert import DuplicateKeys
from saleslake.sinks.tables import create_tables, refresh_history, replace_history, write_dimension
from saleslake.sources.tables import customer_history, read_dimension, read_versions

SHAPE = "customer_id string, name string, email string, city string, signup_date date"


def customers(spark, cities):
    return spark.createDataFrame([(c, f"n{c}", None, city, d("2020-01-01")) for c, city in cities.items()], SHAPE)


def files(layout):
    """Each stored file's part and time of change."""
    found = {}
    for folder, _, names in os.walk(layout.dimension("dim_customer") + "/data"):
        found.update({f"{folder}/{n}": os.stat(f"{folder}/{n}").st_mtime_ns for n in names if n.endswith(".parquet")})
    return found


def of_part(found, name):
    return {path: t for path, t in found.items() if f"/part={name}/" in path}


@pytest.fixture
def stored(spark, layout):
    create_tables(spark, layout)
    return layout


def load(spark, layout, cities, on, **options):
    refresh_history(spark, layout, customers(spark, cities), d(on), **options)


def test_it_equals_the_rebuilt_dimension_whatever_the_order_of_loads(spark, stored):
    """Random extracts, late ones and repeated ones among them."""
    rng = random.Random(7)
    days = [f"2024-{m:02}-{dd:02}" for m in range(1, 7) for dd in (1, 14, 28)]
    dim = empty_dimension(spark, "dim_customer")
    for n, on in enumerate(["2024-03-14", *rng.sample(days, 7), "2024-03-14"]):
        extract = {c: rng.choice("XYZ") for c in "abcdefgh" if rng.random() < 0.8}
        load(spark, stored, extract, on)
        rows = [tuple(r) for r in refresh_customers(dim, customers(spark, extract), d(on)).collect()]
        dim = spark.createDataFrame(rows, dim.schema)
        found = read_dimension(spark, stored, "dim_customer")
        assert rows_of(found.select(*dim.columns)) == rows_of(dim), n
        assert {r["part"] for r in found.select(customer_history(spark, stored).part.alias("part")).distinct().collect()} == set(customer_history(spark, stored).state().parts)


def test_a_load_without_changes_writes_nothing(spark, stored):
    load(spark, stored, {"a": "X", "b": "X"}, "2024-01-01")
    before, number = files(stored), customer_history(spark, stored).state().number
    load(spark, stored, {"a": "X", "b": "X"}, "2024-01-02")
    load(spark, stored, {}, "2024-01-03")
    assert files(stored) == before and customer_history(spark, stored).state().number == number


def test_closed_files_keep_their_times(spark, stored):
    load(spark, stored, {"a": "X", "b": "X", "c": "X"}, "2024-01-01")
    load(spark, stored, {"a": "Y"}, "2024-02-10")
    load(spark, stored, {"b": "Y"}, "2024-02-20")
    closed = of_part(files(stored), "2024-02")
    assert len(closed) == 2  # the second load appended a file
    load(spark, stored, {"a": "Z", "new": "X"}, "2024-05-05")
    now = files(stored)
    assert closed.items() <= now.items()
    opened = customer_history(spark, stored).state().parts["open"]
    load(spark, stored, {"newer": "X"}, "2024-05-06")
    assert set(opened) < set(customer_history(spark, stored).state().parts["open"])  # nothing closed: only added to
    assert {(c, s.isoformat(), e and e.isoformat()) for c, s, e in rows_of(read_dimension(spark, stored, "dim_customer"), "customer_id", "effective_start_date", "effective_end_date")} >= {
        ("a", "2024-01-01", "2024-02-09"), ("a", "2024-02-10", "2024-05-04"), ("a", "2024-05-05", None), ("b", "2024-02-20", None),
    }


def test_a_late_replay_rewrites_the_months_it_splits(spark, stored):
    load(spark, stored, {"a": "X", "b": "X"}, "2024-01-01")
    load(spark, stored, {"a": "Y"}, "2024-03-15")
    load(spark, stored, {"b": "Y"}, "2024-04-15")
    march, april = of_part(files(stored), "2024-03"), of_part(files(stored), "2024-04")
    load(spark, stored, {"b": "L"}, "2024-02-10")  # splits the version of b that ends in April
    now = customer_history(spark, stored).state().parts
    assert set(now) == {"open", "2024-02", "2024-03", "2024-04"}
    assert march.items() <= files(stored).items()
    assert not any(f"{f}/" in path for path in april for f in now["2024-04"])
    versions = rows_of(read_dimension(spark, stored, "dim_customer").where("customer_id = 'b'"), "effective_start_date", "effective_end_date", "city")
    assert versions == [(d("2024-01-01"), d("2024-02-09"), "X"), (d("2024-02-10"), d("2024-04-14"), "L"), (d("2024-04-15"), None, "Y")]


def test_only_later_months_are_read_for_a_load(spark, stored):
    load(spark, stored, {"a": "X", "b": "X"}, "2024-01-01")
    load(spark, stored, {"a": "Y"}, "2024-02-10")
    load(spark, stored, {"a": "Z"}, "2024-04-10")
    names = {path.split("part=")[1].split("/")[0] for path in read_versions(spark, stored, d("2024-03-20")).inputFiles()}
    assert names == {"open", "2024-04"}
    assert {r["customer_id"] for r in read_versions(spark, stored, d("2030-01-01")).collect()} == {"a", "b"}


def test_keys_that_collide_are_not_published(spark, stored, monkeypatch):
    load(spark, stored, {"a": "X", "b": "X"}, "2024-01-01")
    before = rows_of(read_dimension(spark, stored, "dim_customer"))
    key = {r["customer_id"]: r["customer_key"] for r in read_dimension(spark, stored, "dim_customer").collect()}["b"]
    from pyspark.sql import functions as F

    from saleslake.operators import dimensions

    with monkeypatch.context() as patched:
        patched.setattr(dimensions, "surrogate_key", lambda *parts: F.lit(key))
        with pytest.raises(DuplicateKeys):
            load(spark, stored, {"c": "X"}, "2024-01-02")  # collides with a stored key
        patched.setattr(dimensions, "surrogate_key", lambda *parts: F.lit(5).cast("long"))
        with pytest.raises(DuplicateKeys):
            load(spark, stored, {"c": "X", "e": "X"}, "2024-01-02")  # with each other
    assert rows_of(read_dimension(spark, stored, "dim_customer")) == before
    load(spark, stored, {"c": "X"}, "2024-01-02")
    twice = read_dimension(spark, stored, "dim_customer")
    with pytest.raises(DuplicateKeys):
        replace_history(twice.unionByName(twice), stored)
    assert len(rows_of(read_dimension(spark, stored, "dim_customer"))) == 3


def test_replacing_the_whole_history(spark, stored):
    load(spark, stored, {"a": "X"}, "2024-01-01")
    load(spark, stored, {"a": "Y"}, "2024-02-10")
    only = refresh_customers(empty_dimension(spark, "dim_customer"), customers(spark, {"z": "X"}), d("2024-01-01"))
    write_dimension(only, stored, "dim_customer")
    assert set(customer_history(spark, stored).state().parts) == {"open"}
    assert [r["customer_id"] for r in read_dimension(spark, stored, "dim_customer").collect()] == ["z"]
