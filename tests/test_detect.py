import datetime as dt

import pytest

from fleetscope.operators import detect as H

RULE = "rule_id string, event_type string, field string, pattern string, mode string, severity string, confidence double, technique_id string, need string"


def rule(name, pattern, mode="contains", need="any", field="*", kind="process_start"):
    return (name, kind, field, pattern, mode, "high", 0.5, "T1", need)


def test_conditions(spark):
    events = spark.createDataFrame([(1, "process_start", '{"cmd": "curl x | sh"}'), (2, "process_start", '{"cmd": "ls"}'), (3, "file_modify", "curl"), (4, "process_start", None)],
                                   "event_id int, event_type string, payload string")
    rules = spark.createDataFrame([rule("any", "curl"), rule("any", "zzz"), rule("all", "curl", need="all"), rule("all", "zzz", need="all"),
                                   rule("two", "curl", need="2"), rule("two", r"\|\s*sh", "regex", "2", "cmd"), rule("two", "nope", need="2"), rule("re", "^ls$", "regex", field="cmd")], RULE)
    got = sorted((r.event_id, r.rule_id, r.hits) for r in H.match_rules(events, rules).collect())
    assert got == [(1, "any", 1), (1, "two", 2), (2, "re", 1)]


@pytest.mark.parametrize("wrong, reason", [
    ([("r", "k", "*", "x", "contains", "high", 0.5, "T", "some")], "need"), ([("r", "k", "*", "x", "glob", "high", 0.5, "T", "any")], "mode"),
    ([("r", "k", "*", "x", "regex", "urgent", 0.5, "T", "any")], "severity"),
    ([("r", "k", "*", "x", "regex", "high", 0.5, "T", "any"), ("r", "k", "*", "y", "regex", "low", 0.5, "T", "any")], "disagree")])
def test_a_rule_that_cannot_work_stops_the_scan(spark, wrong, reason):
    events = spark.createDataFrame([(1, "k", "x")], "event_id int, event_type string, payload string")
    rules = spark.createDataFrame(wrong, RULE)
    assert [reason in r.reason for r in H.rejected_rules(rules).collect()] == [True]
    with pytest.raises(Exception, match="rule r: "):
        H.match_rules(events, rules).collect()


def test_an_event_id_of_two_nodes_gives_two_alerts(spark):
    m = spark.createDataFrame([(1, n, "r", "low", 0.5, "T", dt.datetime(2024, 1, 1)) for n in ("a", "b", "b", None)],
                              "event_id int, node_id string, rule_id string, severity string, confidence double, technique_id string, ts timestamp_ntz")
    alerts = H.dedup_alerts(H.build_alerts(m.withColumns({"tactic": H.F.lit("x"), "technique_name": H.F.lit("y")})))
    assert sorted(r.node_id or "" for r in alerts.collect()) == ["", "a", "b"]


def test_alert_flow(spark):
    m = spark.createDataFrame([(1, "n", "r1", "critical", 0.9, "T1059.004", dt.datetime(2024, 1, 1)), (1, "n", "r1", "critical", 0.9, "T1059.004", dt.datetime(2024, 1, 1)),
                               (2, "n", "r2", "low", 5.0, "T0", dt.datetime(2024, 1, 2)), (3, "n", "r3", "odd", 0.5, "T0", dt.datetime(2024, 1, 3))],
                              "event_id int, node_id string, rule_id string, severity string, confidence double, technique_id string, ts timestamp_ntz")
    tech = spark.createDataFrame([("T1059.004", "Execution", "Command and Scripting Interpreter: Unix Shell")], "technique_id string, tactic string, technique_name string")
    alerts = H.dedup_alerts(H.build_alerts(H.with_technique(m, tech)))
    assert alerts.count() == 3 and set(H.__dict__["SEVERITIES"]) == {"critical", "high", "medium", "low"}
    from fleetscope.schemas import ALERT_COLUMNS
    assert tuple(alerts.columns) == ALERT_COLUMNS
    by = {r.triggering_event_id: r for r in alerts.collect()}
    assert by[1].threat_score == 90.0 and by[1].mitre_tactic == "Execution" and by[1].status == "open" and by[1].timestamp_ns == 1704067200 * 10**9
    assert by[2].threat_score == 100.0 and by[2].mitre_tactic is None and by[3].threat_score == 0.0
    ranked = {r.severity: r.severity_rank for r in H.severity_rank(alerts).collect()}
    assert ranked == {"critical": 4, "low": 1, "odd": 0}
    assert [r.triggering_event_id for r in H.query_alerts(alerts, status="open").collect()] == [3, 2, 1]
    assert H.query_alerts(alerts, severity="Critical").count() == 1

    acts = spark.createDataFrame([(1, by[1].id, "acknowledged", dt.datetime(2024, 2, 1)), (2, by[1].id, "dismissed", dt.datetime(2024, 2, 2)), (3, by[2].id, "open", dt.datetime(2024, 2, 2))],
                                 "action_id int, alert_id string, new_status string, acted_at timestamp_ntz")
    assert {r.triggering_event_id: r.status for r in H.alert_status(alerts, acts).collect()} == {1: "dismissed", 2: "open", 3: "open"}


def test_findings(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    up = spark.createDataFrame([("n", 1, t(1), 50), ("n", 2, t(2), 5), ("n", 3, t(3), 9)], "node_id string, event_id int, ts timestamp_ntz, total_seconds bigint")
    arp = spark.createDataFrame([("n", 1, t(1), "ip", "m1"), ("n", 2, t(2), "ip", "m2"), ("n", 3, t(3), "ip", "m2"), ("o", 4, t(4), "ip", "m9")],
                                "node_id string, event_id int, ts timestamp_ntz, address string, mac string")
    users = spark.createDataFrame([("n", 0, "root"), ("n", 0, "toor"), ("n", 1, "a")], "node_id string, uid int, username string")
    got = sorted((r.finding, r.subject, r.detail) for r in H.critical_findings({"uptime": up, "arp_cache": arp, "users": users}).collect())
    assert got == [("address_moved", "ip", "m2"), ("extra_root_account", "toor", None), ("reboot", "2", "5")]


def test_indexed_scan_gives_the_same(spark):
    """Overlapping needles, an empty one, NULL texts and types, fields, regular expressions, rules of no type, and a thousand rules."""
    from fleetscope.operators import rulescan
    texts = ['{"cmd": "curl x | sh", "u": "root"}', '{"cmd": "ls"}', "curlcurl abc", None, "", '{"cmd": null}', "bcd abcd"]
    events = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate((k, t) for k in ("process_start", "file_modify", None) for t in texts)],
                                   "event_id int, event_type string, payload string")
    rules = [rule("a", "abc"), rule("b", "bcd"), rule("b2", "abcd", kind="file_modify"), rule("empty", ""), rule("any", "curl", kind=None),
             rule("two", "curl", need="2"), rule("two", r"\\|\\s*sh", "regex", "2", "cmd"), rule("two", "nope", need="2"), rule("all", "root", need="all", field="u"),
             rule("all", "sh", need="all", field="cmd"), rule("re", "^ls$", "regex", field="cmd")]
    rules += [rule(f"n{i}", f"needle {i}") for i in range(1000)]
    table = spark.createDataFrame(rules, RULE)
    plain = H.match_rules(events, table).select("event_id", "rule_id", "severity", "confidence", "technique_id", "hits")
    ours = rulescan.match_rules_indexed(events, table).select(plain.columns)
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, plain.collect())) and plain.count() > 10
    text = ours._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in text and "Exchange" not in text
    assert rulescan.match_rules_indexed(events, table.where("rule_id = 'no'")).collect() == []
    with pytest.raises(ValueError, match="rule x"):
        rulescan.match_rules_indexed(events, spark.createDataFrame([rule("x", "y", "glob")], RULE))


def test_substrings_without_the_library(monkeypatch):
    import sys

    from fleetscope.operators import rulescan
    needles = {"ab": [0], "abc": [1, 2], "": [3], "z": [4]}
    found = rulescan.substring_finder(needles)("xxabcab")
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    assert found == rulescan.substring_finder(needles)("xxabcab") == {0, 1, 2, 3}
