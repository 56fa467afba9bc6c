"""The plans we rely on: push-down, early group limits, no needless shuffle, and a way beyond broadcast."""

import datetime as dt

import pytest

from checks.standins import Fleet
from fleetscope.operators import detect, envelope, predicates as P, rates, registry
from fleetscope.plans import catalogue as C, packs

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def fleet(spark):
    return Fleet(spark, SF)


def test_filters_and_columns_reach_the_scan(spark, fleet, tmp_path):
    fleet.h_processes.write.parquet(str(tmp_path / "p"))
    procs = spark.read.parquet(str(tmp_path / "p"))
    q = next(q for q in C.DEPLOYED if q.name == "deleted_binaries")
    text = plan(packs.run_query({"processes": procs}, q))
    assert "EqualTo(on_disk,0)" in text and "start_time" not in text and "Exchange" not in text


def test_narrow_operators_do_not_shuffle(fleet):
    for df in (envelope.route_class(envelope.decode_envelope(fleet.envelopes, "raw")), P.fim_category(fleet.watched),
               envelope.split_malformed(fleet.telemetry)[1], registry.apply_retention(envelope.route_class(fleet.telemetry), dt.datetime(2024, 1, 28))):
        text = plan(df).split("Subquery")[0]
        assert "Exchange hashpartitioning" not in text and "Python" not in text


def test_envelopes_are_parsed_once(fleet):
    out = envelope.decode_envelope(fleet.envelopes, "raw").select("event_id", "event_type", "payload")
    assert plan(out).count("from_json(ArrayType(StructType(StructField(node_id") == 1 or plan(out).count("StructField(event_type,VariantType") == 1


def test_copies_are_limited_before_the_shuffle(fleet):
    text = plan(registry.dedup_events(fleet.telemetry, "sequence_no"))
    below = text[text.index("Exchange hashpartitioning(sequence_no"):]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_dedup_reads_its_input_once(fleet):
    decoded = envelope.decode_envelope(fleet.envelopes, "raw", payload=False)
    text = plan(registry.dedup_events(decoded, "sequence_id", ["event_time", "event_id"]))
    assert text.count("FileScan") == 1 and "Union" not in text


def test_plain_queries_of_a_table_share_a_scan(fleet):
    own = [q for q in C.DETECTION_PACK if set(q.reads) == {"processes"} and q.columns]
    assert len(own) > 1
    text = plan(packs.run_pack(fleet.host(), own))
    assert text.count("Scan parquet") == 1 and "Exchange" not in text
    assert "rangepartitioning" not in plan(packs.run_pack(fleet.host(), C.DETECTION_PACK, 1704067200))


def test_queries_on_the_clock_ask_for_it(fleet):
    timed = [q for p in C.PACKS.values() for q in p if q.timed]
    assert {q.name for q in timed} == {"tmp_file_activity", "etc_file_changes", "recent_logins"}
    for q in timed:
        with pytest.raises(ValueError):
            packs.run_query(fleet.host(), q)
    with pytest.raises(ValueError):
        packs.run_pack(fleet.host(), C.AGENT_DEFAULTS)


def test_counts_combine_before_the_shuffle(fleet):
    text = plan(rates.class_volume(envelope.route_class(fleet.telemetry)))
    assert text.index("Exchange hashpartitioning(topic#") < text.index("partial_count(1)", text.index("node_id"))


def test_events_are_not_shuffled_for_rules(fleet):
    text = plan(detect.match_rules(fleet.telemetry, detect.substring_rules(fleet.rules)))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("key", ["h1_match_rules", "d2_differential", "c1_port_owners", "b18_decorate", "g3_apply_heartbeats_nodes", "d4_suppress_removed"])
def test_same_results_without_broadcast(spark, key, rows):
    import __spark_entry__ as entry
    query = entry.queries()[key]
    expected = rows(query(spark, SF))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        df = query(spark, SF)
        assert rows(df) == expected and "BroadcastHashJoin" not in plan(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_no_plan_pairs_everything(spark):
    """No query needs a cartesian or nested-loop join, apart from one-row scalar subqueries."""
    import __spark_entry__ as entry
    from checks.cases import CASES
    streamed = ("a1", "a3", "a4", "a5", "a6", "a7", "d7", "s", "u", "q_", "qa_", "qh_", "qx_")
    for key, query in entry.queries().items():
        if key in CASES and not key.startswith(streamed):
            text = plan(query(spark, SF))
            assert "CartesianProduct" not in text and "NestedLoopJoin" not in text, key
