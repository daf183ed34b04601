"""Which deliveries a load ranks, with id lists small enough to broadcast and too long for it."""

from conftest import d, rows_of, staged

from saleslake.operators.joins import marked
from saleslake.plans import fact, queries
from saleslake.plans.fact import touching

DAY, LATER = d("2024-03-09"), d("2024-03-20")


def deliveries(spark):
    headers = staged(spark, "transactions", [("t1", "c1", DAY, None, None, DAY), ("t2", "c1", LATER, None, None, DAY), ("t3", "c1", LATER, None, None, DAY)])
    # i2 moved from t1 to t2 and i3 from t3 to t1, i5 lies elsewhere only.
    items = [("i1", "t1", 1), ("i2", "t1", 1), ("i2", "t2", 2), ("i3", "t3", 1), ("i3", "t1", 2), ("i4", None, 1), ("i5", "t3", 1)]
    lines = staged(spark, "transaction_items", [(i, t, "p", n, None, d(f"2024-03-1{n}")) for i, t, n in items])
    return lines, headers


def test_lines_that_moved_come_with_all_deliveries_whatever_fits(spark, monkeypatch):
    lines, headers = deliveries(spark)
    wanted = [("i1", "t1"), ("i2", "t1"), ("i2", "t2"), ("i3", "t1"), ("i3", "t3")]
    # The id of the one header takes 10 bytes, the ids of the three lines 30.
    for limit in (1000, 20):
        touched, of = touching(lines, headers, [DAY], broadcast_limit=limit)
        assert rows_of(touched, "transaction_item_id", "transaction_id") == wanted
        assert rows_of(of, "transaction_id") == [("t1",)]


def test_too_many_headers_are_not_looked_for(spark):
    lines, headers = deliveries(spark)
    assert touching(lines, headers, [DAY], broadcast_limit=9) == (lines, headers)


def test_long_lists_of_headers_are_looked_for_in_slices(spark):
    """Two headers take 20 bytes, more than a slice; all deliveries were returned before, and each slice read again."""
    _, headers = deliveries(spark)
    lines = staged(spark, "transaction_items", [("i1", "t1", "p", 1, None, DAY), ("i2", "t2", "p", 1, None, DAY), ("i3", "t4", "p", 1, None, DAY), ("i3", None, "p", 1, None, LATER)])
    more = headers.unionByName(staged(spark, "transactions", [("t4", "c1", d("2024-03-21"), None, None, DAY)]))
    kept = []

    def keep(rows, name):
        kept.append(name)
        return rows

    for limit in (1000, 35):
        touched, of = touching(lines, more, [DAY, LATER], keep, limit, 10)
        assert rows_of(touched, "transaction_item_id", "transaction_id") == [("i1", "t1"), ("i2", "t2")]
        assert rows_of(of, "transaction_id") == [("t1",), ("t2",), ("t3",)]
    assert {"touched-lines", "touched-headers"} < set(kept)


def test_queries_that_build_a_fact_of_their_own_load_the_dimensions_only(spark, monkeypatch):
    def whole(*_):
        raise AssertionError("the fact of the whole history is not read")

    monkeypatch.setattr(queries, "star", whole)
    assert queries.dimension(spark, "/root/testdata/sf0.001", "dim_product").count() == 200
    assert queries.fact_upsert_range(spark, "/root/testdata/sf0.001").count() > 0


def test_long_lists_of_ids_are_never_broadcast_whole(spark, monkeypatch):
    """The driver held a hash table of up to 256 MiB of ids for each list; a list that is long, and not most of all headers, is marked by bits."""
    lines, headers = deliveries(spark)
    lists = []

    def noted(rows, found, key):
        lists.append(key)
        return marked(rows, found, key)

    monkeypatch.setattr(fact, "marked", noted)
    wanted = [("i1", "t1"), ("i2", "t1"), ("i2", "t2"), ("i3", "t1"), ("i3", "t3")]
    touched, of = touching(lines, headers, [DAY], slice_bytes=5)
    assert rows_of(touched, "transaction_item_id", "transaction_id") == wanted and rows_of(of, "transaction_id") == [("t1",)]
    assert lists == ["transaction_id", "transaction_item_id", "transaction_id"]
    monkeypatch.setattr(fact, "MARKED_FROM", 5)
    assert rows_of(touching(lines, headers, [DAY], slice_bytes=5)[0], "transaction_item_id", "transaction_id") == wanted
    assert touching(lines, headers, [LATER]) == (lines, headers)
