"""Delivery on ranges equals delivery id by id."""

import random

import pytest
from pyspark.sql import functions as F

from fleetscope.operators import ranges, registry


@pytest.mark.parametrize("width", [4, 1 << 18])
def test_ranges_expand_to_the_ids(spark, width):
    rnd = random.Random(width)
    sent = [(rnd.choice("ab"), rnd.choice([None, *range(-3, 40)])) for _ in range(60)] + [("c", i) for i in range(100)]
    acks = [(rnd.choice("ab"), rnd.choice([None, *range(-3, 45)])) for _ in range(50)] + [("c", i) for i in range(100)]
    s, a = (spark.createDataFrame(x, "node_id string, sequence_no bigint").where("sequence_no is not null") for x in (sent, acks))
    got = ranges.reconcile_ranges(s, a, keys=["node_id"], width=width)
    assert got.where("node_id = 'c'").count() == 1
    flat = sorted((r.node_id, r.sequence_no, r.sent, r.acked, r.delivery) for r in ranges.expand(got).collect())
    want = []
    for node in "abc":
        one = registry.reconcile(s.where(F.col("node_id") == node), a.where(F.col("node_id") == node))
        want += [(node, r.sequence_no, r.sent, r.acked, r.delivery) for r in one.collect()]
    assert flat == sorted(want)
    nulls = ranges.reconcile_ranges(spark.createDataFrame(sent, "node_id string, sequence_no bigint"), a, keys=["node_id"], width=width)
    assert sorted(map(tuple, nulls.collect())) == sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("width", [4, 16])
def test_cumulative_acknowledgements(spark, width):
    sent = spark.createDataFrame([("a", i) for i in range(20) if i not in (7, 8)] + [("b", 3)], "node_id string, sequence_no bigint")
    acks = spark.createDataFrame([("a", 3), ("a", 15), ("a", 99)], "node_id string, sequence_no bigint")
    marks = spark.createDataFrame([("a", 4), ("a", 10), ("z", 5)], "node_id string, up_to bigint")
    got = sorted((r.node_id, r["first"], r["last"], r.delivery) for r in ranges.reconcile_ranges(sent, acks, keys=["node_id"], up_to=marks, width=width).collect())
    assert got == [("a", 0, 2, "delivered"), ("a", 3, 3, "duplicate"), ("a", 4, 6, "delivered"), ("a", 9, 10, "delivered"), ("a", 11, 14, "lost"),
                   ("a", 15, 15, "delivered"), ("a", 16, 19, "lost"), ("a", 99, 99, "unknown"), ("b", 3, 3, "lost")]


def test_nothing_sent(spark):
    none = spark.createDataFrame([], "sequence_no bigint")
    assert ranges.reconcile_ranges(none, none).collect() == []
