import os
import sys
from datetime import date
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from saleslake import schemas  # noqa: E402
from saleslake.layout import Layout  # noqa: E402
from saleslake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def layout(tmp_path):
    return Layout(str(tmp_path / "lake"), landing=str(tmp_path / "landing"))


def staged(spark, table, rows):
    """Rows of a staging table, each a tuple of the extract's columns plus the delivery day."""
    return spark.createDataFrame(rows, schemas.staged(table))


def money(text):
    return Decimal(text).quantize(Decimal("0.01"))


def d(text):
    return date.fromisoformat(text)


def rows_of(frame, *columns):
    """Rows as a sorted list of tuples."""
    picked = frame.select(*columns) if columns else frame
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def plan_of(frame):
    """The physical plan as text, without the header that explain prints."""
    return frame._jdf.queryExecution().executedPlan().toString()


def final_plan_of(frame):
    """The plan as it was adapted at run time."""
    frame.collect()
    return plan_of(frame)
