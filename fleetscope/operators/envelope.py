"""Envelope decoding, quarantine, class routing and status normalisation.

Everything here is a narrow projection or filter: no shuffle, no Python worker.
Payloads stay text; they are parsed only by the branches that need the fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Event types and the class each one belongs to.
CLASS_OF = {
    "process_start": "process",
    "process_end": "process",
    "network_connect": "network",
    "network_listen": "network",
    "file_create": "file",
    "file_modify": "file",
    "file_delete": "file",
    "user_login": "auth",
    "user_logout": "auth",
    "osquery_result": "process",
    "osquery_snapshot": "process",
}
DEFAULT_CLASS = "raw"

# Coarse type names sent by agents; used only when asked for.
COARSE_CLASS_OF = {"osquery": "process", "process": "process", "file": "file", "network": "network"}

# Numeric event codes of the agent.
TYPE_CODES = {0: "osquery", 1: "process", 2: "file", 3: "network"}

UUID_FORMS = (
    r"^(?:(?:urn:uuid:)?[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
    r"|\{[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\}"
    r"|[0-9a-fA-F]{32})$"
)


def class_of(event_type: Column, coarse: bool = False, default: str = DEFAULT_CLASS) -> Column:
    """Class of an event type; unknown and missing types go to ``default``."""
    table = {**CLASS_OF, **(COARSE_CLASS_OF if coarse else {})}
    out = None
    for name in dict.fromkeys(table.values()):
        hit = event_type.isin([t for t, c in table.items() if c == name])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def route_class(df: DataFrame, col: str = "event_type", topic: str = "topic", prefix: str = "",
                coarse: bool = False) -> DataFrame:
    """Add the class (optionally with a topic prefix) that an event is routed to."""
    name = class_of(F.col(col), coarse)
    return df.withColumn(topic, F.concat(F.lit(prefix), name) if prefix else name)


STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def valid_json(text: Column) -> Column:
    """True for text that is exactly one JSON value.

    Spark's parsers stop after the first value, so the text is read as the one
    element of an array; text that could close that array early is read as an
    object member as well.
    """
    alone = F.size(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", STRICT)) == 1
    member = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v string, bad string",
                         {**STRICT, "columnNameOfCorruptRecord": "bad"})["bad"].isNull()
    return F.coalesce(alone & (~text.rlike(r"\]\s*,") | member), F.lit(False))


def _parsed(text: Column, names: tuple[str, ...]) -> Column:
    """Named members of a JSON object as variants, in an array of one; NULL for anything else."""
    shape = ",".join(f"{n}:variant" for n in names)
    return F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<struct<{shape}>>", STRICT)


def _text(v: Column) -> Column:
    """The value if it is a JSON string, else NULL; numbers are not strings here."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def peek_type(df: DataFrame, col: str = "payload", out: str = "event_type") -> DataFrame:
    """Read only ``event_type`` from JSON text: not a string gives ``unknown``, bad JSON gives NULL."""
    a = F.col("__a")
    return df.withColumn("__a", _parsed(F.col(col), ("event_type",))).withColumn(out, F.when(
        F.size(a) == 1, F.coalesce(_text(F.get(a, F.lit(0))["event_type"]), F.lit("unknown"))).when(
        valid_json(F.col(col)), "unknown")).drop("__a")


def type_name(v: Column) -> Column:
    """Name of an event type given as text or as a code; other codes keep their digits, missing is ''."""
    token = F.to_json(v)
    names = F.create_map(*[F.lit(x) for pair in TYPE_CODES.items() for x in (str(pair[0]), pair[1])])
    return F.when(token.startswith('"'), F.try_variant_get(v, "$", "string")).when(
        token.rlike("^-?[0-9]+$"), F.coalesce(names[token], token)).otherwise("")


def event_type_name(df: DataFrame, col: str = "raw", out: str = "event_type") -> DataFrame:
    """Event type name of JSON envelopes held as text."""
    member = F.get(_parsed(F.col(col), ("event_type",)), F.lit(0))["event_type"]
    return df.withColumn("__v", member).withColumn(out, type_name(F.col("__v"))).drop("__v")


def _text_or_blank(value: Column, raw: Column, name: str) -> Column:
    """A member read as text, blank unless it was a JSON string.

    Only a value that could also be a number, a flag or nested JSON is looked up
    again with its type; ids as a rule cannot.
    """
    typed = _text(F.get(_parsed(raw, (name,)), F.lit(0))[name])
    return F.coalesce(F.when(value.rlike(r"(?s)^(?:-?[0-9][0-9.eE+-]*|true|false|[\[{].*)\z"), typed).otherwise(value), F.lit(""))


ENVELOPE = {"node_id": "string", "event_type": "variant", "payload": "string", "timestamp_ns": "bigint", "sequence_id": "string"}


def _payload_text(value: Column, raw: Column) -> Column:
    """A member's JSON as it was sent: key order, repeated keys and long whole numbers stay.

    Only where a payload may be a JSON string is it read again with its type, to
    give it its quotes back.
    """
    typed = F.to_json(F.get(_parsed(raw, ("payload",)), F.lit(0))["payload"])
    return F.coalesce(F.when(raw.rlike(r'"payload"\s*:\s*"') & typed.startswith('"'), typed).otherwise(value), F.lit("null"))


def decode_envelope(df: DataFrame, col: str = "raw", payload: bool = True) -> DataFrame:
    """JSON text to envelope columns; missing fields become '' or 0.

    ``timestamp_ns`` 0 is the agents' sentinel for "clock unavailable": the row
    stays, its ``event_time`` is NULL and ``time_missing`` is set. Text that is
    not JSON yields no row; ``split_malformed`` gives the quarantine (and alone
    catches text such as ``{…}],[…``, which is read up to the bracket here). The
    text is parsed once, for these fields only; without ``payload`` that one is
    left out. A payload is the text that was sent, without its white space;
    numbers with a fraction or exponent keep their value, not their spelling.
    """
    shape = {n: t for n, t in ENVELOPE.items() if payload or n != "payload"}
    raw, a = F.col(col), F.col("__a")
    array = F.from_json(F.concat(F.lit("["), raw, F.lit("]")),
                        "array<struct<" + ",".join(f"{n}:{t}" for n, t in shape.items()) + ">>", STRICT)
    blank = F.array(F.struct(*[F.lit(None).cast(t).alias(n) for n, t in shape.items()]))
    kept = [c for c in df.columns if c != col]
    # An outer explode: Spark would copy the parse into a filter below an inner one.
    parsed = df.withColumn("__a", array).select(
        *kept, col, F.posexplode_outer(F.when(F.size(a) == 1, a).when(valid_json(raw), blank)).alias("__pos", "__e")).filter(
        F.col("__pos").isNotNull())
    v = {n: F.col("__e")[n] for n in shape}
    return with_event_time(parsed.select(
        *kept,
        _text_or_blank(v["node_id"], raw, "node_id").alias("node_id"),
        type_name(v["event_type"]).alias("event_type"),
        *([_payload_text(v["payload"], raw).alias("payload")] if payload else []),
        F.coalesce(v["timestamp_ns"], F.lit(0)).alias("timestamp_ns"),
        _text_or_blank(v["sequence_id"], raw, "sequence_id").alias("sequence_id"),
    ))


def with_event_time(df: DataFrame, ns: str = "timestamp_ns") -> DataFrame:
    """Event time from epoch nanoseconds (cut to microseconds); 0 is NULL and flagged."""
    micros = F.expr(f"cast(timestamp_micros({ns} div 1000) as timestamp_ntz)")
    return df.withColumn("event_time", F.when(F.col(ns) != 0, micros)).withColumn(
        "time_missing", F.coalesce(F.col(ns) == 0, F.lit(True)))


def default_payload(df: DataFrame, col: str = "payload") -> DataFrame:
    """Empty or missing payload text becomes an empty JSON object."""
    return df.withColumn(col, F.when(F.coalesce(F.length(col), F.lit(0)) == 0, "{}").otherwise(F.col(col)))


def with_reject_reason(df: DataFrame, col: str = "payload", reason: str = "reason") -> DataFrame:
    """Add why a record cannot be processed, NULL when it can."""
    return df.withColumn(reason, F.when(~valid_json(F.col(col)), "invalid_json"))


def split_malformed(df: DataFrame, col: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Records with valid JSON, and the quarantine of the others with a reason."""
    marked = with_reject_reason(df, col)
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def sanitise_status(df: DataFrame, col: str = "status") -> DataFrame:
    """Agents may report healthy or degraded; anything else counts as degraded."""
    return df.withColumn(col, F.when(F.col(col).isin("healthy", "degraded"), F.col(col)).otherwise("degraded"))


def valid_id(col: Column) -> Column:
    """True for text in one of the accepted UUID notations."""
    return F.coalesce(col.rlike(UUID_FORMS), F.lit(False))


def split_valid_ids(df: DataFrame, col: str = "node_id") -> tuple[DataFrame, DataFrame]:
    """Rows with a well-formed id, and the rejected rest."""
    return df.filter(valid_id(F.col(col))), df.filter(~valid_id(F.col(col)))
