"""A table of parts (days, months) whose changes are published together.

Rows lie in folders that are never changed, `data/<commit>/part=<value>`. A small file per commit, `commits/<number>`, lists the folders
of each part and, for each source that feeds the table, its last batch in it. Readers follow the newest commit, so they see
all of a change or nothing, whatever failed in between; and a batch that is given again is known to be in already.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Collection, Mapping, Sequence
from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

from saleslake import schemas, storage

# Commits whose folders stay, so that a query that began before the newest one can end.
COMMITS_KEPT = 2


@dataclass(frozen=True)
class State:
    """What one commit says: the folders of each part, relative to the table, and each source's last batch."""

    number: int = -1
    parts: dict[str, list[str]] = field(default_factory=dict)
    applied: dict[str, int] = field(default_factory=dict)

    def folders(self) -> set[str]:
        return {folder for of_part in self.parts.values() for folder in of_part}


class PartTable:
    """One writer at a time; any number of readers. `part` is the part's name, as a string, computed from a row."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, part: Column, clustering: Sequence[str] = ()):
        self.spark, self.path, self.schema, self.part, self.clustering = spark, path, schema, part, tuple(clustering)

    def commits(self) -> list[int]:
        return sorted(int(name) for name in storage.names(self.spark, f"{self.path}/commits") if name.isdigit())

    def state(self, number: int | None = None) -> State:
        """The newest commit, or a certain one; an empty state before the first."""
        if number is None:
            numbers = self.commits()
            if not numbers:
                return State()
            number = numbers[-1]
        found = json.loads(storage.read_text(self.spark, f"{self.path}/commits/{number:010d}"))
        return State(number, found["parts"], found["applied"])

    def read(self, parts: Collection[str] | Callable[[str], bool] | None = None, state: State | None = None) -> DataFrame:
        """Rows of certain parts (by name, or by a test of it), or of all. Only their folders are listed."""
        state = self.state() if state is None else state
        wanted = parts if callable(parts) else (lambda name: parts is None or name in parts)
        folders = [f"{self.path}/{folder}" for name, of_part in sorted(state.parts.items()) if wanted(name) for folder in of_part]
        if not folders:
            return schemas.empty(self.spark, self.schema)
        # The folders belong to several commits, so their names are not taken for partition columns.
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*folders)

    def write(self, rows: DataFrame) -> dict[str, list[str]]:
        """Store rows by part in new folders, which nobody reads yet; returns the folder of each part that has rows.

        A small part is one sorted file; rebalancing cuts a large one into several.
        """
        folder = f"data/{len(self.commits()):010d}-{uuid4().hex}"
        (
            rows.select(*self.schema.fieldNames(), self.part.alias("part"))
            .hint("rebalance", "part")
            .sortWithinPartitions("part", *self.clustering)
            .write.partitionBy("part")
            .parquet(f"{self.path}/{folder}")
        )
        return {name: [f"{folder}/part={name}"] for name in storage.partition_values(self.spark, f"{self.path}/{folder}", "part")}

    def publish(self, before: State, parts: Mapping[str, Sequence[str]], applied: Mapping[str, int] | None = None) -> State:
        """Make a change the newest state: `parts` get other folders (none: the part goes), `applied` sources are further.

        Folders that only older commits than the last few name, or that a failed writer left, are deleted after it.
        """
        changed = {**before.parts, **{name: list(folders) for name, folders in parts.items()}}
        after = State(before.number + 1, {name: folders for name, folders in changed.items() if folders}, {**before.applied, **(applied or {})})
        text = json.dumps({"parts": after.parts, "applied": after.applied}, sort_keys=True)
        storage.publish_text(self.spark, f"{self.path}/commits/{after.number:010d}", text)
        self._clean_up()
        return after

    def _clean_up(self) -> None:
        numbers = self.commits()
        kept = set().union(*(self.state(number).folders() for number in numbers[-COMMITS_KEPT:]))
        for number in numbers[:-COMMITS_KEPT]:
            storage.delete(self.spark, f"{self.path}/commits/{number:010d}")
        for folder in storage.names(self.spark, f"{self.path}/data"):
            inside = [f"data/{folder}/{name}" for name in storage.names(self.spark, f"{self.path}/data/{folder}") if name.startswith("part=")]
            gone = [name for name in inside if name not in kept]
            if len(gone) == len(inside):
                storage.delete(self.spark, f"{self.path}/data/{folder}")
            else:
                for name in gone:
                    storage.delete(self.spark, f"{self.path}/{name}")

    def merge(self, rows: DataFrame, combine: Callable[[DataFrame], DataFrame], source: str, batch: int) -> bool:
        """Combine a batch of rows with the stored rows of the parts they belong to, once per batch number of the source.

        `combine` gets the stored and the new rows of these parts and returns their new content. A batch whose number is not greater
        than the source's last one changes nothing, and False is returned.
        """
        state = self.state()
        if state.applied.get(source, -1) >= batch:
            return False
        rows = rows.select(*self.schema.fieldNames()).persist()
        try:
            touched = {row[0] for row in rows.select(self.part).distinct().collect()}  # names of parts
            stored = self.read(touched, state)
            written = self.write(combine(stored.unionByName(rows))) if touched else {}
            self.publish(state, written, {source: batch})
        finally:
            rows.unpersist()
        return True

    def expire(self, gone: Callable[[str], bool]) -> list[str]:
        """Drop the parts for whose name `gone` is true; returns their names."""
        state = self.state()
        names = sorted(name for name in state.parts if gone(name))
        if names:
            self.publish(state, {name: [] for name in names})
        return names
