"""Slot-wise ordering against plain windows, with one node holding most rows."""

import random

import pytest
from pyspark.sql import Window, functions as F

from fleetscope.functions import ordered as O
from fleetscope.operators import topk


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(7)
    data = []
    for i in range(3000):
        node = 1 if rnd.random() < 0.6 else rnd.choice([2, 3, 4, None])
        data.append((node, None if rnd.random() < 0.02 else rnd.randrange(0, 40_000), i, rnd.randrange(50)))
    df = spark.createDataFrame(data, "node int, sec bigint, id bigint, v bigint")
    return df.select("node", F.timestamp_seconds("sec").cast("timestamp_ntz").alias("ts"), "id", "v").repartition(5).cache()


@pytest.mark.parametrize("seconds,width", [(1, 1), (600, 100), (10**7, 1 << 18)])
def test_lag(skewed, rows, monkeypatch, seconds, width):
    monkeypatch.setattr(O, "ID_WIDTH", width)
    got = O.lag_in_slots(skewed, ["node"], ["ts", "id"], O.time_slot(F.col("ts"), seconds, F.col("id")), {"pv": "v", "pt": "ts"})
    w = Window.partitionBy("node").orderBy("ts", "id")
    assert rows(got) == rows(skewed.select("*", F.lag("v").over(w).alias("pv"), F.lag("ts").over(w).alias("pt")))


@pytest.mark.parametrize("seconds,width", [(7, 1), (3600, 50), (60, 1 << 18)])
def test_numbering(skewed, rows, monkeypatch, seconds, width):
    monkeypatch.setattr(O, "ID_WIDTH", width)
    got = O.number_in_slots(skewed, ["node"], ["ts", "id"], O.time_slot(F.col("ts"), seconds, F.col("id")))
    w = Window.partitionBy("node").orderBy("ts", "id")
    assert rows(got) == rows(skewed.select("*", F.row_number().over(w).cast("bigint").alias("row_no")))


def test_no_job_while_the_plan_is_built(spark, skewed):
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "building only")
    O.lag_in_slots(skewed, ["node"], ["ts", "id"], O.time_slot(F.col("ts"), 60, F.col("id")), {"pv": "v"})
    O.number_in_slots(skewed, ["node"], ["id"], O.id_slot(F.col("id")))
    assert len(status.getJobIdsForGroup("plan")) == 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("n", [1, 10, 333, 5000])
def test_newest(skewed, rows, n):
    got = O.newest_in_slots(skewed, ["node"], ["ts", "id"], O.time_slot(F.col("ts"), 500), n)
    w = Window.partitionBy("node").orderBy(F.desc("ts"), F.desc("id"))
    assert rows(got) == rows(skewed.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).drop("rn"))


@pytest.mark.parametrize("n", [1, 25, 1200])
def test_top(skewed, rows, n):
    got = topk.top_n_per_node(skewed, "v", n, ["node"], "id")
    w = Window.partitionBy("node").orderBy(F.desc_nulls_last("v"), "id")
    assert rows(got) == rows(skewed.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).drop("rn"))


def test_top_limits_groups_before_the_shuffle(skewed):
    plan = topk.top_n_per_node(skewed, "v", 25, ["node"], "id")._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 4


def test_eviction_and_fifo(spark, rows):
    """Cap 3, push 4: the oldest is gone; draining 2 and then the rest keeps the order."""
    df = spark.createDataFrame([(1, i) for i in (1, 2, 3, 4)], "node_id int, event_id bigint")
    kept = topk.keep_newest(df, 3)
    assert [r.event_id for r in kept.orderBy("event_id").collect()] == [2, 3, 4]
    assert rows(topk.fifo_batches(kept, 2)) == [(1, 0, 2, 3, 2), (1, 1, 4, 4, 1)]


def test_page_and_latest(spark):
    df = spark.sql("select 1 as node_id, timestamp_ntz '2024-01-01' as ts, id as event_id from range(30)")
    assert [r.event_id for r in topk.page(df, 1, 10, 20).collect()] == list(range(20, 30))
    hb = spark.sql("select 1 as node_id, timestamp_ntz '2024-01-01' as recorded_at, id as event_id, concat('s', id) as status from range(5)")
    assert topk.latest_health(hb).first().status == "s4"
