import json

import pytest
from pyspark.sql import functions as F

from fleetscope.operators import envelope as E


def decoded(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw string")
    return {r.i: r for r in E.decode_envelope(df).collect()}


@pytest.mark.parametrize("kind,topic", [
    ("process_start", "process"), ("process_end", "process"), ("network_connect", "network"), ("network_listen", "network"),
    ("file_create", "file"), ("file_modify", "file"), ("file_delete", "file"), ("user_login", "auth"), ("user_logout", "auth"),
    ("osquery_result", "process"), ("osquery_snapshot", "process"), ("unknown", "raw"), ("Process_Start", "raw"), ("", "raw"), (None, "raw")])
def test_route(spark, kind, topic):
    df = spark.createDataFrame([(kind,)], "event_type string")
    assert E.route_class(df).first().topic == topic


def test_route_prefix_and_coarse_names(spark):
    df = spark.createDataFrame([("file",)], "event_type string")
    assert E.route_class(df).first().topic == "raw"
    assert E.route_class(df, coarse=True, prefix="events.").first().topic == "events.file"


@pytest.mark.parametrize("text,kind", [
    ('{"event_type": "file_create"}', "file_create"), ('{"event_type": 5}', "unknown"), ('{"a": 1}', "unknown"), ("[1]", "unknown"),
    ('"text"', "unknown"), ("{}", "unknown"), ("nope", None), ("", None), ('{"event_type": "x"} tail', None), (None, None)])
def test_peek(spark, text, kind):
    df = spark.createDataFrame([(text,)], "payload string")
    assert E.peek_type(df).first().event_type == kind


@pytest.mark.parametrize("value,name", [("0", "osquery"), ("1", "process"), ("2", "file"), ("3", "network"), ("9", "9"), ("-1", "-1"),
                                        ('"custom"', "custom"), ('"1"', "1"), ("true", ""), ("1.5", ""), ("null", "")])
def test_type_codes(spark, value, name):
    assert decoded(spark, '{"event_type": %s}' % value)[0].event_type == name


def test_decode_fills_missing_fields(spark):
    r = decoded(spark, "{}", '{"node_id": 5, "sequence_id": 7, "timestamp_ns": "9", "payload": null}')
    for row in r.values():
        assert (row.node_id, row.event_type, row.payload, row.timestamp_ns, row.sequence_id) == ("", "", "null", 0, "")
        assert row.event_time is None and row.time_missing


@pytest.mark.parametrize("value,text", [('"12"', "12"), ("12", ""), ("-1.5e3", ""), ("true", ""), ('"true"', "true"), ('{"a": 1}', ""), ('"{}"', "{}"), ("[1]", ""),
                                        ('"[x"', "[x"), ("null", ""), ('"550e8400-e29b"', "550e8400-e29b"), ('"a\\nb"', "a\nb"), ('""', "")])
def test_only_json_strings_are_ids(spark, value, text):
    row = decoded(spark, '{"node_id": %s, "sequence_id": %s}' % (value, value))[0]
    assert (row.node_id, row.sequence_id) == (text, text)


def test_decode_keeps_payload_and_time(spark):
    r = decoded(spark, json.dumps({"node_id": "n", "event_type": 0, "payload": {"rows": [{"a": "é"}], "x": 1},
                                   "timestamp_ns": 1704067200123456789, "sequence_id": "s"}))[0]
    assert json.loads(r.payload) == {"rows": [{"a": "é"}], "x": 1}
    assert r.timestamp_ns == 1704067200123456789 and r.event_time.microsecond == 123456 and not r.time_missing


def test_decode_drops_only_malformed(spark):
    got = decoded(spark, "not json", '{"node_id": "a"}', '{"node_id": "b"} {"node_id": "c"}', '{"node_id": "d"},{"node_id": "e"}',
                  '{"node_id": "f"}],[1', "null", None, '{"node_id": "x", "node_id": "y"}')
    assert {i: r.node_id for i, r in got.items()} == {1: "a", 4: "f", 5: "", 7: "y"}


@pytest.mark.parametrize("text,ok", [("{}", True), (" [1, 2] ", True), ("3", True), ('"a],[b"', True), ('{"a": [[1],[2]]}', True), ("", False),
                                     ("{", False), ("{} {}", False), ("1,2", False), ('1,"y":2', False), ("1],[2", False), ("{'a': 1}", False),
                                     ("NaN", False), (None, False), ('{"a":1}],[{"b":2}', False)])
def test_valid_json(spark, text, ok):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(E.valid_json(F.col("t")).alias("v")).first().v is ok


def test_split_malformed_is_complete(spark):
    df = spark.createDataFrame([(1, "{}"), (2, ""), (3, None), (4, "{bad"), (5, "[]")], "id int, payload string")
    good, bad = E.split_malformed(E.default_payload(df))
    assert {r.id for r in good.collect()} == {1, 2, 3, 5}
    assert [(r.id, r.reason) for r in bad.collect()] == [(4, "invalid_json")]


def test_status(spark):
    df = spark.createDataFrame([("healthy",), ("degraded",), ("isolated",), ("",), (None,)], "status string")
    assert [r.status for r in E.sanitise_status(df).collect()] == ["healthy", "degraded", "degraded", "degraded", "degraded"]


def test_ids(spark):
    u = "a1b2c3d4-0001-0000-0000-00000000000F"
    values = [u, u.replace("-", ""), "{%s}" % u, "urn:uuid:" + u, "bad-id", "", None, u + "0", "{" + u]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, node_id string")
    good, bad = E.split_valid_ids(df)
    assert sorted(r.i for r in good.collect()) == [0, 1, 2, 3] and sorted(r.i for r in bad.collect()) == [4, 5, 6, 7, 8]


def test_payload_as_it_was_sent(spark):
    """Repeated keys, key order and long whole numbers stay; a JSON string keeps its quotes."""
    sent = ['{"a":1,"a":2}', '{"b":1,"a":{"d":2,"c":3}}', '{"n":12345678901234567890123456789012345678901234}', '"te\\"x"', '"{\\"a\\":1}"', "null", "true", "[1,2]",
            '{"z":1,"payload":"x"}']
    df = spark.createDataFrame([(i, f'{{"payload": {p}, "sequence_id": "s"}}') for i, p in enumerate(sent)], "i int, raw string")
    got = E.decode_envelope(df, "raw").orderBy("i").collect()
    assert [r.payload for r in got] == sent
    assert "payload" not in E.decode_envelope(df, "raw", payload=False).columns
