"""De-duplication against stored ids."""

import datetime as dt
import random

import numpy as np
import pytest

from fleetscope.operators import registry
from fleetscope.sources import history, sinks

EVENT = "event_id bigint, sequence_id string, ts timestamp_ntz"


def event(i, ident, day=1):
    return (i, ident, dt.datetime(2024, 1, day) + dt.timedelta(seconds=i))


@pytest.fixture
def kept(spark, tmp_path):
    """Runs batches through a history and gives back what each wrote."""
    def run(batches, attempts=None, **options):
        held = history.IdHistory(spark, str(tmp_path / "h"), **options)
        for n in attempts or range(len(batches)):
            held.take(spark.createDataFrame(batches[n], EVENT), n, lambda df, b: sinks.write_logs(df, str(tmp_path / "out"), b))
        return {n: sorted(r.event_id for r in spark.read.schema(EVENT).parquet(str(tmp_path / f"out/batch_id={n}")).collect()) for n in set(attempts or range(len(batches)))}
    return run


def test_batches_equal_the_union(spark, kept):
    rnd = random.Random(3)
    batches = [[event(100 * n + i, rnd.choice([None, " ", f"s{rnd.randint(0, 60)}"]), 1 + n) for i in range(50)] for n in range(4)]
    got = kept(batches, shares=3, segment_ids=8)
    union = spark.createDataFrame([r for b in batches for r in b], EVENT)
    want = sorted(r.event_id for r in registry.dedup_events(union, order=("ts", "event_id")).collect())
    assert sorted(i for ids in got.values() for i in ids) == want


def test_a_batch_that_is_run_again_writes_the_same(kept):
    batches = [[event(1, "a"), event(2, "b")], [event(3, "a"), event(4, "c"), event(5, "c")]]
    assert kept(batches, [0, 0, 1, 1, 0]) == {0: [1, 2], 1: [4]}


def test_a_crash_between_the_steps(spark, tmp_path):
    held = history.IdHistory(spark, str(tmp_path / "h"))
    rows = spark.createDataFrame([event(1, "a")], EVENT)

    def fail(df, batch_id):
        raise OSError("gone")

    with pytest.raises(OSError):
        held.take(rows, 0, fail)
    seen = []
    held.take(rows, 0, lambda df, b: seen.extend(r.event_id for r in df.collect()))
    held.take(spark.createDataFrame([event(2, "a")], EVENT), 1, lambda df, b: seen.extend(r.event_id for r in df.collect()))
    assert seen == [1]


def test_a_new_session_finds_the_table(spark, tmp_path):
    history.IdHistory(spark, str(tmp_path / "h")).take(spark.createDataFrame([event(1, "a")], EVENT), 0, lambda df, b: None)
    other = spark.newSession()
    other.sql(f"drop table {history.IdHistory(other, str(tmp_path / 'h')).name}")
    held = history.IdHistory(other, str(tmp_path / "h"))
    assert held.fresh(other.createDataFrame([event(2, "a"), event(3, "b")], EVENT), 1).first().event_id == 3


def test_history_is_not_shuffled(spark, tmp_path):
    held = history.IdHistory(spark, str(tmp_path / "h"), shares=8)
    held.take(spark.createDataFrame([event(i, f"s{i}") for i in range(100)], EVENT), 0, lambda df, b: None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = held.known(spark.createDataFrame([event(200, "s5")], EVENT), 1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = text.index(f"{held.name}")
    above = text[:scan].rsplit("SortMergeJoin", 1)[1]
    assert "Bucketed: true" in text and "Exchange" not in above


def test_segments_never_miss():
    h = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000)
    bits = np.zeros(5000 * history.BITS_AN_ID // 8, np.uint8)
    at = history.places(h, len(bits) * 8).ravel()
    np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    assert history.has_all(bits, history.places(h, len(bits) * 8)).all()
    others = np.random.default_rng(2).integers(-(1 << 62), 1 << 62, 5000)
    assert history.has_all(bits, history.places(others, len(bits) * 8)).mean() < 0.03


def test_segments_of_a_day_stay_few(spark, kept, tmp_path):
    """Four batches of one day: the number of segments grows with the logarithm of the ids, and all ids stay known."""
    batches = [[event(1000 * n + i, f"s{n}-{i}", 1 + i % 2) for i in range(400)] for n in range(4)]
    kept(batches, shares=2, segment_ids=8)
    held = history.IdHistory(spark, str(tmp_path / "h"), shares=2, segment_ids=8)
    segments = held.segments.read().collect()
    assert sum(s.ids for s in segments) == 1600 and all(s.ids <= len(s.bits) * 8 / history.BITS_AN_ID for s in segments)
    assert len(segments) <= 4 * 4 and len({(s.share, s.day, s.part) for s in segments}) == len(segments)
    again = spark.createDataFrame([r for b in batches for r in b], EVENT)
    assert held.fresh(again, 9).count() == 0 and held.known(again, 9).count() == 1600


def test_small_batches_of_a_day(spark):
    """Ids that come one by one, as well as all at once, after segments of any size."""
    h, held = np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 600), []
    for i in range(0, 600, 3):
        held = history.filled(held, h[i:i + 3], 16)
    assert [n for _, n, _ in held][:1] == [16] and sum(n for _, n, _ in held) == 600 and len(held) <= 7
    for some in (held, history.filled(held[:2], h, 16), history.filled([], h[:16], 16), history.filled([], h, 1)):
        tables = history.stacked([np.frombuffer(bits, np.uint8) for _, _, bits in some])
        assert history.in_some(tables, h[:16]).all()
    assert history.filled([], h[:0], 16) == []


def test_segments_side_by_side_answer_as_alone(monkeypatch):
    """Segments of several sizes, more than stand in one table, too many places for one, and none."""
    rng = np.random.default_rng(4)
    segments = [rng.integers(0, 256, size).astype(np.uint8) | np.uint8(0x81) for size in [80] * 40 + [64] * 9 + [512, 1024, 7]]
    h = rng.integers(-(1 << 62), 1 << 62, 3000)
    want = np.any([history.has_all(s, history.places(h, len(s) * 8)) for s in segments], axis=0)
    alone = [np.any([history.has_all(s, history.places(h, len(s) * 8)) for s in some], axis=0) for some in (segments[:3], segments[-2:])]
    for few, many in ((1 << 22, 1 << 24), (600, 5000), (8, 16)):
        monkeypatch.setattr(history, "FEW_PLACES", few)
        monkeypatch.setattr(history, "MANY_PLACES", many)
        assert (history.in_some(history.stacked(segments), h) == want).all()
        assert all((history.in_some(history.stacked(some), h) == a).all() for some, a in zip((segments[:3], segments[-2:]), alone))
    assert not history.in_some(history.stacked([]), h).any() and 0 < alone[0].sum() < len(h)
