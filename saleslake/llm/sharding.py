"""Balanced label propagation: linked documents move towards their neighbours' shards under capacity quotas.

Documents with equal texts are linked. Of one group only the numbers in each shard matter, so the propagation runs on
rows (group, shard, documents), of which a group has at most as many as there are shards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saleslake.llm.common import free as free_tables
from saleslake.llm.common import ranked, stored

SHARDS = 24
# Rounds at most. Each decides all moves that the shards have places for, so most groups are whole after a few; a round that brings
# nothing more ends it earlier.
ROUNDS = 30
# A batch that takes more than this part of what a shard takes in a round is moved in part, a smaller one whole or not. A group of more
# than this part of a shard goes on to another when a shard has no places.
_LARGE = 0.02
# Small batches are drawn for places, so only this part of the quota is given away at a time.
_DRAWN = 0.9
# Of a shard that is nearly full of one group, no more of that group is taken.
_FILLED = 0.98
# How little a crowded shard can count for a small group, and rounds without fewer documents that want to move before it ends.
_LEAST_WELCOME = 0.2
_PATIENCE = 3
# Groups up to this size go elsewhere together when a shard holds too many.
_SMALL_GROUP = 64


def _by_shard(values: list, shard: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in values)), shard + 1)


def _chance(*parts: Column) -> Column:
    """A number from 0 to 1 that depends on the values alone, so that a task that is run again decides alike."""
    return F.pmod(F.xxhash64(*parts), F.lit(1_000_003)) / F.lit(1_000_003.0)


def _totals(batches: DataFrame, shard: str, shards: int) -> list[int]:
    """Documents in each shard; at most `shards` rows come to the driver."""
    found = {row["shard"]: row["n"] for row in batches.groupBy(F.col(shard).alias("shard")).agg(F.sum("docs").alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def grants(wanted: np.ndarray, free: np.ndarray) -> np.ndarray:
    """What part of `wanted` (documents from shard to shard) is moved, so that no shard gets more than it has free and sends out.

    Shards so exchange documents even when all of them are full. What comes to a shard is cut until that holds for all.
    """
    granted = wanted.astype(float)
    for turn in range(2000):
        room = np.maximum(granted.sum(1) + free, 0)
        coming = granted.sum(0)
        over = coming > room + 0.5
        if not over.any():
            break
        # What shrinks too slowly, as it does towards nothing, is nothing after a while.
        part = np.where(over, 0.0, 1.0) if turn >= 1000 else np.where(coming > room, room / np.maximum(coming, 1e-9), 1.0)
        granted = granted * part
    return granted


def propagate(batches: DataFrame, capacity: list[int], rounds: int = ROUNDS) -> DataFrame:
    """`batches` (grp, shard, docs) after moves towards the shard that has most of the group.

    A shard takes as many documents as it has free places and sends out in the same round. Places count against linked documents
    only, since documents without links go wherever there is room. It ends when no document wants to move, when some rounds brought
    nothing, or after `rounds`; a group larger than a shard fills one after the other.
    """
    shards = len(capacity)
    welcome = np.ones(shards)  # what part of the documents that wanted to come could, in the round before
    fewest, since = None, 0
    for turn in range(rounds):
        free = np.array(capacity) - _totals(batches, "shard", shards)
        filled = F.col("docs") >= _FILLED * _by_shard(capacity, F.col("shard"))
        # Where many want to come, other shards with nearly as much of the group are the better goal; of equal ones another is drawn
        # each time. Small groups do not give up most of what they have for that, those that take much of a shard may have to.
        draw = 0.75 + 0.5 * _chance(F.col("grp"), F.col("shard"), F.lit(turn))
        score = lambda least: F.col("docs") * draw * _by_shard([float(max(least, x)) for x in welcome], F.col("shard"))  # noqa: B023, E731
        goal = lambda least: F.max(F.when(~filled, F.struct(score(least).alias("score"), "docs", "shard")))  # noqa: B023, E731
        much = F.sum("docs") > _LARGE * max(capacity)
        targets = batches.groupBy("grp").agg(F.when(much, goal(0.0)).otherwise(goal(_LEAST_WELCOME)).alias("goal"), much.alias("much"))
        # Of a group that fills shards in turn, what already is together in one stays there.
        settled = F.col("much") & (F.col("goal.docs") < F.col("docs"))
        wants = (F.col("goal.shard") != F.col("shard")) & ~filled & ~settled
        wishes = stored(
            batches.join(targets, "grp", "left").select("grp", "shard", "docs", F.when(wants, F.col("goal.shard")).alias("to")),
            "wishes",
        )
        # At most a number for each two shards.
        wanted = np.zeros((shards, shards), np.int64)
        for row in wishes.where("to is not null").groupBy("shard", "to").agg(F.sum("docs").alias("n")).collect():
            wanted[row["shard"], row["to"]] = row["n"]
        if fewest is None or wanted.sum() < fewest:
            fewest, since = wanted.sum(), turn
        if not wanted.any() or turn - since > _PATIENCE:
            free_tables(wishes)
            break
        granted = grants(wanted, free)
        coming, taken = wanted.sum(0), granted.sum(0)
        welcome = np.where(coming > 0, taken / np.maximum(coming, 1), np.where(free > 0, 1.0, welcome))
        share = granted / np.maximum(wanted, 1)
        quota = F.element_at(F.array(*(F.lit(float(x)) for x in share.ravel())), F.col("shard") * shards + F.col("to") + 1)
        large = F.col("docs") > _LARGE * _by_shard([float(x) for x in taken], F.col("to"))
        moved = (
            F.when(F.col("to").isNull(), 0)
            .when(large, F.floor(F.col("docs") * quota + _chance(F.col("grp"), F.col("shard"), F.lit(turn))))
            .otherwise(F.when(_chance(F.col("grp"), F.lit(turn)) < _DRAWN * quota, F.col("docs")).otherwise(0))
        )
        decided = wishes.withColumn("moved", F.least(moved.cast("long"), F.col("docs")))
        ends = F.array(
            F.struct(F.col("shard"), (F.col("docs") - F.col("moved")).alias("docs")),
            F.struct(F.coalesce("to", "shard").alias("shard"), F.col("moved").alias("docs")),
        )
        after = decided.select("grp", F.explode(ends).alias("end")).where("end.docs > 0")
        moved_to = stored(
            after.groupBy("grp", F.col("end.shard").alias("shard")).agg(F.sum("end.docs").alias("docs")),
            "batches",
        )
        free_tables(wishes, batches)
        batches = moved_to
    return batches


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `rows`: the shards' counts differ by one at most. The size is the text's bytes plus 8, a null text has
    none and is linked to empty ones. Repeated rows are linked like other equal texts; a null doc_id stays null; an
    empty table gives no rows; columns other than doc_id and text are ignored. A group larger than a shard fills
    several. Slots are gapless from 0 in each shard; grown_shard is null, as only the law `key` has it.
    """
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = stored(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text, F.octet_length(text)).alias("grp"),
        ),
        "sized",
    )
    total = rows.count()
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    groups = stored(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "groups")
    # Two stored tables: the partition of a large group can be split at run time.
    counted = stored(rows.join(groups.hint("merge"), "grp"), "counted")
    linked = counted.where("n > 1")
    start = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    first = stored(linked.groupBy("grp", start.alias("shard")).agg(F.count(F.lit(1)).alias("docs")), "batches")
    batches = propagate(first, capacity, rounds)

    # Each linked document gets its group's shards in turn, by its rank in the group.
    running = Window.partitionBy("grp").orderBy("shard")
    ends = batches.withColumn("end", F.sum("docs").over(running)).groupBy("grp").agg(
        F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("ends")
    )
    in_group = stored(ranked(linked, "grp", "n", ["row"]), "in-group")
    dealt = in_group.join(stored(ends, "ends").hint("merge"), "grp").select(
        *rows.columns,
        (F.col("n") > max(capacity)).alias("large"),
        (F.col("n") <= _SMALL_GROUP).alias("small"),
        F.filter("ends", lambda x: F.col("rank") < x["end"])[0]["shard"].alias("shard"),
    )

    # What a shard has too many of, of large groups if it can be, joins the documents without links, which fill the shards up.
    # Small groups stay or go together, and those that go are side by side again where they go.
    held = _totals(batches, "shard", shards)
    together = F.when(F.col("small"), F.col("grp")).otherwise(F.xxhash64("row"))
    in_shard = stored(
        ranked(dealt.withColumn("n", _by_shard(held, F.col("shard"))), "shard", "n", ["grp", "row"], F.col("large"), together)
        .withColumn("stays", F.col("rank") < _by_shard(capacity, F.col("shard"))),
        "in-shard",
    )
    kept = [min(n, most) for n, most in zip(held, capacity, strict=True)]
    gaps = [most - n for n, most in zip(kept, capacity, strict=True)]
    pool = counted.where("n = 1").select(*rows.columns, F.lit(True).alias("small")).unionByName(in_shard.where(~F.col("stays")).select(*rows.columns, "small"))
    filled = ranked(pool.withColumns({"all": F.lit(0), "n": F.lit(sum(gaps))}), "all", "n", ["grp", "row"], together=together)
    shard, slot = F.lit(None), F.lit(None)
    before = 0
    for s, gap in enumerate(gaps):
        here = (F.col("rank") >= before) & (F.col("rank") < before + gap)
        shard = F.when(here, s).otherwise(shard)
        slot = F.when(here, F.col("rank") - before + kept[s]).otherwise(slot)
        before += gap
    columns = ["doc_id", "size", "text_crc32", "shard", "slot"]
    placed = in_shard.where("stays").withColumn("slot", F.col("rank")).select(*columns).unionByName(
        filled.withColumns({"shard": shard, "slot": slot}).select(*columns)
    )
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
