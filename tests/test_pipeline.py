import random
import shutil
from datetime import timedelta
from pathlib import Path

import pytest
from conftest import d, final_plan_of, money, rows_of, staged

from saleslake import schemas, storage
from saleslake.layout import Layout
from saleslake.operators.checks import CheckFailed, all_loaded
from saleslake.operators.upsert import DuplicateKeys
from saleslake.plans import pipeline, reports
from saleslake.plans.fact import days_of, touching
from saleslake.sinks.tables import write_dimension
from saleslake.sources.tables import read_dimension, read_fact, read_staging

MON, TUE = d("2024-03-04"), d("2024-03-05")

FILES = {
    "customers": ["C1,Ana,ana@example.com,Solo,2023-01-05", "C2,Budi,,Bandung,2023-02-01"],
    "products": ["P1,Chair,Home,100.00", "P2,Book,Books,20"],
    "transactions": [f"T1,C1,{MON},220.00,K1", f"T2,C2,{MON},20.00,"],
    "transaction_items": ["I1,T1,P1,2,100.00", "I2,T1,P2,1,20.00", "I3,T2,P2,1,20.00"],
    "marketing_campaigns": ["K1,Email - Mar,2024-03-01,2024-03-31,Email"],
}
TUESDAY = {
    "customers": ["C1,Ana,ana@example.com,Malang,2023-01-05"],
    "products": ["P2,Book,Comics,25"],
    "transactions": [f"T3,C1,{TUE},25.00,"],
    "transaction_items": ["I4,T3,P2,1,25.00"],
    "marketing_campaigns": ["K1,Email - Mar,2024-03-01,2024-04-15,Email"],
}


def deliver(layout, on, files):
    for table, rows in files.items():
        path = Path(layout.daily_extract(table, on))
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join([",".join(schemas.STAGING[table].fieldNames()), *rows]) + "\n")


def state(spark, layout):
    fact = read_fact(spark, layout, MON, TUE)
    dims = {n: rows_of(read_dimension(spark, layout, n)) for n in schemas.DIMENSIONS}
    return rows_of(fact), dims


@pytest.fixture(scope="module")
def loaded_once(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("two_days")
    layout = Layout(str(folder / "lake"), landing=str(folder / "landing"))
    deliver(layout, MON, FILES)
    deliver(layout, TUE, TUESDAY)
    pipeline.run_day(spark, layout, MON)
    pipeline.run_day(spark, layout, TUE)
    return folder


@pytest.fixture
def two_days(loaded_once, tmp_path):
    """An own copy of the tables after two daily runs."""
    shutil.copytree(loaded_once, tmp_path / "copy")
    return Layout(str(tmp_path / "copy" / "lake"), landing=str(tmp_path / "copy" / "landing"))


def test_two_days(spark, two_days):
    sold = {r["transaction_item_id"]: r for r in read_fact(spark, two_days, MON, TUE).collect()}
    assert set(sold) == {"I1", "I2", "I3", "I4"}
    assert sold["I1"]["line_amount"] == money("200")
    assert sold["I1"]["campaign_key"] > 0 and sold["I3"]["campaign_key"] == -1
    # The customer moved on Tuesday, the product got another category in place.
    assert sold["I4"]["customer_key"] != sold["I1"]["customer_key"]
    assert sold["I4"]["product_key"] == sold["I2"]["product_key"]
    customers = read_dimension(spark, two_days, "dim_customer")
    assert rows_of(customers, "customer_id", "city", "effective_start_date", "effective_end_date", "is_current") == [
        ("C1", "Malang", TUE, None, True),
        ("C1", "Solo", MON, MON, False),
        ("C2", "Bandung", MON, None, True),
    ]
    assert rows_of(read_dimension(spark, two_days, "dim_product"), "product_id", "category") == [("P1", "Home"), ("P2", "Comics")]
    assert read_dimension(spark, two_days, "dim_date").count() == 2
    assert rows_of(read_dimension(spark, two_days, "dim_campaign"), "campaign_id", "duration_days") == [("K1", 45), ("UNKNOWN", None)]


def test_running_a_day_again_changes_nothing(spark, two_days):
    before = state(spark, two_days)
    pipeline.run_day(spark, two_days, TUE)
    assert state(spark, two_days) == before


def test_replay_of_the_first_day_leaves_the_second(spark, two_days):
    before = state(spark, two_days)
    pipeline.run_day(spark, two_days, MON)
    assert state(spark, two_days) == before


def test_backfill_of_both_days_equals_the_daily_runs(spark, two_days):
    fact, _ = state(spark, two_days)
    pipeline.backfill(spark, two_days, MON, TUE)
    assert state(spark, two_days)[0] == fact


def test_corrections_of_an_earlier_day(spark, two_days):
    """A line that comes late, a corrected one and a moved order change the days they belong to, and a replay keeps that."""
    deliver(
        two_days,
        TUE,
        {
            "transactions": [*TUESDAY["transactions"], f"T2,C2,{TUE},20.00,"],
            "transaction_items": [*TUESDAY["transaction_items"], "I1,T1,P1,7,100.00", "I6,T1,P2,1,20.00"],
        },
    )
    pipeline.run_day(spark, two_days, TUE)
    want = [("I1", MON, 7), ("I2", MON, 1), ("I3", TUE, 1), ("I4", TUE, 1), ("I6", MON, 1)]
    sold = lambda: rows_of(read_fact(spark, two_days, MON, TUE), "transaction_item_id", "sale_date", "quantity")
    assert sold() == want
    pipeline.run_day(spark, two_days, MON)
    assert sold() == want
    pipeline.backfill(spark, two_days, MON, TUE)
    pipeline.run_day(spark, two_days, TUE)
    assert sold() == want


def test_lines_of_other_days_are_not_ranked(spark, two_days):
    lines, headers = (read_staging(spark, two_days, t) for t in ("transaction_items", "transactions"))
    kept_lines, kept_headers = touching(lines, headers, [TUE])
    assert rows_of(kept_lines, "transaction_item_id") == [("I4",)]
    assert rows_of(kept_headers, "transaction_id") == [("T3",)]
    assert days_of(lines, headers, MON) == [MON]


def test_colliding_keys_leave_the_old_snapshot(spark, two_days):
    before = rows_of(read_dimension(spark, two_days, "dim_product"))
    rows = read_dimension(spark, two_days, "dim_product")
    with pytest.raises(DuplicateKeys):
        write_dimension(rows.unionByName(rows), two_days, "dim_product")
    assert rows_of(read_dimension(spark, two_days, "dim_product")) == before
    write_dimension(rows, two_days, "dim_product")
    assert rows_of(read_dimension(spark, two_days, "dim_product")) == before


def test_lost_line_fails_reconciliation(spark, two_days):
    lines, headers = (read_staging(spark, two_days, t) for t in ("transaction_items", "transactions"))
    fact = read_fact(spark, two_days, MON, TUE)
    assert all_loaded(lines, headers, fact, [MON, TUE]).first()["passed"]
    assert not all_loaded(lines, headers, fact.where("transaction_item_id <> 'I2'"), [MON, TUE]).first()["passed"]
    assert not all_loaded(lines, headers, fact.unionByName(fact.limit(1)), [MON, TUE]).first()["passed"]


def test_the_final_check_follows_the_newest_deliveries(spark):
    rng = random.Random(3)
    headers = [(f"T{n}", "c", d(f"2024-01-{rng.randint(1, 9):02}"), money("1"), None, d(f"2024-02-{day:02}")) for n in range(40) for day in rng.sample(range(1, 20), 2)]
    lines = [(f"I{n}", f"T{rng.randint(0, 49)}", "p", 1, money("1"), d(f"2024-02-{day:02}")) for n in range(200) for day in rng.sample(range(1, 20), rng.randint(1, 3))]
    dated = {row[0]: row[2] for row in sorted(headers, key=lambda row: row[-1])}
    owner = {row[0]: row[1] for row in sorted(lines, key=lambda row: row[-1])}
    days = [d("2024-01-02"), d("2024-01-03"), d("2024-01-07")]
    want = {i for i, t in owner.items() if dated.get(t) in days}
    stored = spark.createDataFrame([(i,) for i in [*want, "other"]], "transaction_item_id string")
    kept = []

    def keep(rows, name):
        kept.append(name)
        return rows

    check = all_loaded(staged(spark, "transaction_items", lines), staged(spark, "transactions", headers), stored, days, keep)
    assert "SortAggregate" not in final_plan_of(check)
    assert tuple(check.first()) == (len(want), len(want), True)
    assert kept == ["headers-to-check"]  # line ids meet the fact in one shuffle


def test_only_a_merge_stores_the_resolved_lines(spark, two_days, monkeypatch):
    stored, delete = [], storage.delete

    def recorded(session, path):
        if "/sales-" in path and "to-merge" not in path:
            stored.append("resolved" in storage.names(session, path))
        delete(session, path)

    monkeypatch.setattr(storage, "delete", recorded)
    days = [MON, TUE]
    want = rows_of(read_fact(spark, two_days, MON, TUE))
    pipeline.load_sales(spark, two_days, days)
    delete(spark, two_days.fact_sales)
    pipeline.load_sales(spark, two_days, days)
    assert stored == [True, False]
    assert rows_of(read_fact(spark, two_days, MON, TUE)) == want


def test_corrected_extract_replaces_the_sales(spark, two_days):
    deliver(two_days, TUE, {"transaction_items": ["I4,T3,P2,3,25.00", "I5,T3,P1,1,100.00"]})
    pipeline.run_day(spark, two_days, TUE)
    assert rows_of(read_fact(spark, two_days, TUE, TUE), "transaction_item_id", "quantity") == [("I4", 3), ("I5", 1)]


def test_daily_run_drops_expired_staging(spark, two_days):
    later = MON + timedelta(days=31)
    deliver(two_days, later, {**FILES, "transactions": [f"T1,C1,{later},220.00,K1", f"T2,C2,{later},20.00,"]})
    pipeline.run_day(spark, two_days, later)
    kept = read_staging(spark, two_days, "transactions").select("ingest_date").distinct()
    assert rows_of(kept) == [(TUE,), (later,)]
    # Both orders were delivered again with another date: their lines move.
    assert read_fact(spark, two_days, MON, later).count() == 4


def test_empty_extract_stops_the_run(spark, layout):
    deliver(layout, MON, {**FILES, "products": []})
    with pytest.raises(CheckFailed, match="products landed"):
        pipeline.run_day(spark, layout, MON)
    assert read_fact(spark, layout, MON, MON).isEmpty()
    assert read_dimension(spark, layout, "dim_customer").isEmpty()


def test_unknown_product_fails_reconciliation(spark, layout):
    deliver(layout, MON, {**FILES, "products": FILES["products"][:1]})
    with pytest.raises(CheckFailed, match=r"agree.*dropped \{'product': 2\}"):
        pipeline.run_day(spark, layout, MON)


def test_bootstrap_of_a_history(spark, layout, tmp_path):
    history = tmp_path / "history"
    history.mkdir()
    for table, rows in FILES.items():
        header = ",".join(schemas.STAGING[table].fieldNames())
        (history / f"{table}.csv").write_text("\n".join([header, *rows]) + "\n")
    start, end = d("2024-01-01"), d("2024-12-31")
    pipeline.bootstrap(spark, layout, str(history), start, end)
    fact = read_fact(spark, layout, start, end)
    assert fact.count() == 3
    assert read_dimension(spark, layout, "dim_date").count() == 366
    assert rows_of(read_dimension(spark, layout, "dim_customer"), "effective_start_date") == [(start,), (start,)]
    assert rows_of(read_staging(spark, layout, "products").select("ingest_date").distinct()) == [(end,)]
    before = rows_of(fact)
    pipeline.bootstrap(spark, layout, str(history), start, end)
    assert rows_of(read_fact(spark, layout, start, end)) == before
    # A daily run goes on where the history ended.
    after = end + timedelta(days=1)
    deliver(layout, after, {**FILES, "transactions": [f"T9,C1,{after},100.00,"], "transaction_items": ["I9,T9,P1,1,100.00"]})
    pipeline.run_day(spark, layout, after)
    assert read_fact(spark, layout, start, after).count() == 4


def test_default_calendar(spark, layout):
    pipeline.extend_calendar(spark, layout)
    pipeline.extend_calendar(spark, layout)
    calendar = read_dimension(spark, layout, "dim_date")
    assert (calendar.count(), calendar.select("date_key").distinct().count()) == (3287, 3287)


def test_reports(spark, two_days):
    fact = read_fact(spark, two_days, MON, TUE)
    dim = {n: read_dimension(spark, two_days, n) for n in schemas.DIMENSIONS}
    assert rows_of(reports.revenue_by_category_month(fact, dim["dim_product"], dim["dim_date"])) == [
        ("Comics", 2024, 3, money("65")),
        ("Home", 2024, 3, money("200")),
    ]
    campaigns = reports.campaign_performance(fact, dim["dim_campaign"])
    assert rows_of(campaigns, "campaign_id", "revenue", "orders", "lines") == [
        ("K1", money("220"), 1, 2),
        ("UNKNOWN", money("45"), 2, 2),
    ]
    assert sum(r["revenue_share"] for r in campaigns.collect()) == pytest.approx(1)
    # The order total is on every line but counts once per order.
    assert rows_of(reports.order_metrics(fact)) == [(2024, 3, 3, 4, 5, money("265"), 4 / 3, pytest.approx(265 / 3))]
    assert rows_of(reports.sales_by_city(fact, dim["dim_customer"])) == [
        ("as_is", "Bandung", money("20"), 1),
        ("as_is", "Malang", money("245"), 2),
        ("as_was", "Bandung", money("20"), 1),
        ("as_was", "Malang", money("25"), 1),
        ("as_was", "Solo", money("220"), 1),
    ]
    assert rows_of(reports.cohort_retention(fact, dim["dim_customer"])) == [(d("2024-03-01"), 0, 2, 2, 1.0)]
    assert rows_of(reports.cohort_retention(fact, dim["dim_customer"], by_signup=True)) == [
        (d("2023-01-01"), 14, 1, 1, 1.0),
        (d("2023-02-01"), 13, 1, 1, 1.0),
    ]
    assert rows_of(reports.product_performance(fact, dim["dim_product"]), "product_id", "units", "orders") == [("P1", 2, 1), ("P2", 3, 3)]
    assert rows_of(reports.calendar_sales(fact, dim["dim_date"]), "day_name", "is_weekend", "revenue") == [
        ("Monday", False, money("240")),
        ("Tuesday", False, money("25")),
    ]
