"""Where each table lives below the warehouse root, and where extracts arrive."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


@dataclass(frozen=True)
class Layout:
    root: str
    landing: str | None = None

    def staging(self, table: str) -> str:
        return f"{self.root}/staging/stg_{table}"

    def dimension(self, name: str) -> str:
        return f"{self.root}/warehouse/{name}"

    @property
    def fact_sales(self) -> str:
        return f"{self.root}/warehouse/fact_sales"

    @property
    def window_counts(self) -> str:
        return f"{self.root}/streaming/transaction_window_counts"

    def daily_extract(self, table: str, day: date) -> str:
        """One CSV per table and day; the path format is fixed by whoever delivers the extracts."""
        return f"{self.landing}/{table}/{day:%Y%m%d}/{table}.csv"

    @staticmethod
    def history_extract(folder: str, table: str) -> str:
        return f"{folder}/{table}.csv"
