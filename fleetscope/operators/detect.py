"""Rule scan, alerts and findings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fleetscope.functions.ordered import lag_in_slots, time_slot

# Order of severities, most severe first.
SEVERITIES = ("critical", "high", "medium", "low")

# Our own weights for the score; the planned product names only its inputs.
SEVERITY_WEIGHT = {"critical": 100, "high": 75, "medium": 50, "low": 25}


RULE_COLUMNS = ("rule_id", "severity", "confidence", "technique_id")


def compile_rules(conditions: DataFrame) -> DataFrame:
    """Rule conditions grouped to one row per event type, each holding its rules and their tests.

    ``conditions``: rule_id, event_type, field, pattern, mode (contains / regex),
    severity, confidence, technique_id, and need: ``any``, ``all`` or a number.
    A rule that can't work as written stops the job with its name;
    ``rejected_rules`` lists all of them beforehand.
    """
    agreed = F.lit(True)
    for c in ("severity", "confidence", "need"):
        agreed = agreed & F.min(c).eqNullSafe(F.max(c))
    rules = conditions.withColumn("__fault", condition_fault()).groupBy("event_type", "rule_id").agg(
        *[F.min(c).alias(c) for c in RULE_COLUMNS[1:]], F.min("need").alias("need"), F.count(F.lit(1)).alias("of"),
        F.coalesce(F.min("__fault"), F.when(~agreed, DISAGREE)).alias("wrong"),
        F.collect_list(F.struct("field", "pattern", "mode")).alias("tests"))
    need = F.when(F.col("need") == "all", F.col("of")).when(F.col("need") == "any", F.lit(1)).otherwise(
        F.expr("try_cast(need as bigint)"))
    wrong = F.concat(F.lit("rule "), F.coalesce("rule_id", F.lit("without an id")), F.lit(": "), F.col("wrong"))
    checked = F.when(F.col("wrong").isNotNull(), F.raise_error(wrong).cast("bigint")).otherwise(need)
    return rules.groupBy("event_type").agg(
        F.collect_list(F.struct(*RULE_COLUMNS, checked.alias("need"), "tests")).alias("__rules"))


def condition_fault() -> Column:
    """Why a condition can't work as written; NULL if it can."""
    number = F.expr("try_cast(need as bigint)")
    return F.when(F.col("need").isNull() | (~F.col("need").isin("any", "all") & F.coalesce(number < 1, F.lit(True))), "need is not any, all or a number from 1").when(
        F.col("mode").isNull() | ~F.col("mode").isin("contains", "regex"), "mode is not contains or regex").when(
        F.col("severity").isNull() | ~F.col("severity").isin(*SEVERITIES), "unknown severity")


DISAGREE = "conditions of the rule disagree"


def rejected_rules(conditions: DataFrame) -> DataFrame:
    """Rules that can't work as written, with the reason: (rule_id, reason). An empty result means all are sound."""
    checked = conditions.select("rule_id", "severity", "confidence", "need", condition_fault().alias("reason"))
    wrong = checked.filter(F.col("reason").isNotNull()).select("rule_id", "reason")
    same = checked.groupBy("rule_id").agg(*[F.count_distinct(c).alias(c) for c in ("severity", "confidence", "need")])
    return wrong.union(same.filter("severity > 1 or confidence > 1 or need > 1").select(
        "rule_id", F.lit(DISAGREE).alias("reason"))).distinct()


def _field_value(field: Column, text: str) -> Column:
    """The whole text for field ``*``, else the named JSON field."""
    return F.when(field == "*", F.col(text)).otherwise(
        F.call_function("get_json_object", F.col(text), F.concat(F.lit("$."), field)))


def match_rules(events: DataFrame, conditions: DataFrame, text: str = "payload") -> DataFrame:
    """Events with each rule that applies: enough of its conditions hold in the event's text.

    Each event meets the list of rules of its type, once, and only hits become
    rows: events are neither multiplied by rules nor, while Spark can broadcast
    the rule table, shuffled. Above that size AQE splits the busy types. Rules
    without an event type apply to all.
    """
    def holds(t: Column) -> Column:
        value = _field_value(t["field"], text)
        return F.coalesce(F.when(t["mode"] == "regex", F.rlike(value, t["pattern"])).otherwise(
            F.contains(value, t["pattern"])), F.lit(False))

    def hits(r: Column) -> Column:
        return F.size(F.filter(r["tests"], holds))

    compiled = compile_rules(conditions)
    anywhere = compiled.filter(F.col("event_type").isNull()).select("__rules").scalar()  # one row: the rules of no type
    none = F.array().cast(compiled.schema["__rules"].dataType)
    paired = events.join(compiled.filter(F.col("event_type").isNotNull()), "event_type", "left").withColumn(
        "__rules", F.concat(F.coalesce("__rules", none), F.coalesce(anywhere, none)))
    return paired.withColumn("__hit", F.explode(F.filter("__rules", lambda r: hits(r) >= r["need"]))).select(
        *events.columns, *[F.col(f"__hit.{c}").alias(c) for c in RULE_COLUMNS],
        hits(F.col("__hit")).cast("bigint").alias("hits"))


def substring_rules(rules: DataFrame) -> DataFrame:
    """One-condition rules (rule_id, event_type, needle, …) in the form ``match_rules`` takes."""
    return rules.select("rule_id", "event_type", F.lit("*").alias("field"), F.col("needle").alias("pattern"),
                        F.lit("contains").alias("mode"), "severity", "confidence", "technique_id", F.lit("any").alias("need"))


def with_technique(matches: DataFrame, techniques: DataFrame) -> DataFrame:
    """Tactic and name of the technique; a technique that is not listed leaves NULLs."""
    return matches.join(techniques, "technique_id", "left")


def severity_rank(df: DataFrame, col: str = "severity", out: str = "severity_rank") -> DataFrame:
    """4 for critical down to 1 for low, 0 for anything else."""
    rank = None
    for i, name in enumerate(SEVERITIES):
        value = F.lit(len(SEVERITIES) - i)
        rank = F.when(F.col(col) == name, value) if rank is None else rank.when(F.col(col) == name, value)
    return df.withColumn(out, rank.otherwise(0))


def threat_score(matches: DataFrame, out: str = "threat_score") -> DataFrame:
    """Severity weight times confidence, 0 to 100."""
    weight = None
    for name, value in SEVERITY_WEIGHT.items():
        weight = F.when(F.col("severity") == name, F.lit(value)) if weight is None else \
            weight.when(F.col("severity") == name, F.lit(value))
    raw = weight.otherwise(0) * F.col("confidence").cast("double")
    return matches.withColumn(out, F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw)), 2))


def alert_id() -> Column:
    """A hash of node, event and rule: event ids are a node's own, so the node belongs to it."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col("node_id").cast("string"), F.lit("")), F.col("event_id").cast("string"), "rule_id"))


def build_alerts(matches: DataFrame, source: str = "rule_engine") -> DataFrame:
    """Alerts from matches that carry event_id, node_id, rule_id, tactic and technique_name.

    The id is a hash of node, event and rule: a rerun gives the same alert.
    """
    scored = threat_score(matches)
    host = F.col("hostname") if "hostname" in matches.columns else F.lit(None).cast("string")
    ns = F.col("timestamp_ns") if "timestamp_ns" in matches.columns else \
        F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return scored.select(
        alert_id().alias("id"),
        "node_id", host.alias("hostname"), ns.alias("timestamp_ns"), "severity", F.lit(source).alias("source"),
        F.col("technique_id").alias("mitre_technique_id"), F.col("tactic").alias("mitre_tactic"),
        F.concat_ws(": ", "rule_id", "technique_name").alias("description"),
        F.col("event_id").alias("triggering_event_id"), "threat_score", F.lit("open").alias("status"))


def dedup_alerts(alerts: DataFrame) -> DataFrame:
    """One alert per node, event and rule (all are in the id)."""
    return alerts.dropDuplicates(["id"])


def query_alerts(alerts: DataFrame, severity: str | None = None, status: str | None = None,
                 technique: str | None = None) -> DataFrame:
    """Alerts by any of severity, status and technique, newest first; severity in any case."""
    if severity:
        alerts = alerts.filter(F.lower("severity") == severity.lower())
    if status:
        alerts = alerts.filter(F.col("status") == status)
    if technique:
        alerts = alerts.filter(F.col("mitre_technique_id") == technique)
    return alerts.orderBy(F.desc("timestamp_ns"), "id")


def alert_status(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Alerts with the state set by the last action on each; without one they stay as they are."""
    last = actions.filter(F.col("new_status").isin("acknowledged", "dismissed")).groupBy("alert_id").agg(
        F.max_by("new_status", F.struct("acted_at", "action_id")).alias("__s")).withColumnRenamed("alert_id", "id")
    return alerts.join(last, "id", "left").withColumn("status", F.coalesce("__s", "status")).drop("__s").select(*alerts.columns)


def changed_values(df: DataFrame, keys: Sequence[str], value: str, ts: str = "ts", ident: str = "event_id") -> DataFrame:
    """Rows whose value differs from the one before under the same key."""
    lagged = lag_in_slots(df, list(keys), [ts, ident], time_slot(F.col(ts), ident=F.col(ident)), {"previous": value})
    return lagged.filter(F.col("previous") != F.col(value))


def critical_findings(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Findings (node_id, finding, subject, detail) over the host tables that are given.

    Uses user_ssh_keys, shadow, users, hash, arp_cache and uptime; histories
    need ``ts`` and ``event_id``.
    """
    def finding(df: DataFrame, name: str, subject: Column, detail: Column) -> DataFrame:
        return df.select("node_id", F.lit(name).alias("finding"), subject.cast("string").alias("subject"),
                         detail.cast("string").alias("detail"))

    none = F.lit(None)
    parts = []
    if "user_ssh_keys" in tables:
        parts.append(finding(tables["user_ssh_keys"].filter(F.col("encrypted") == 0),
                             "unencrypted_private_key", F.col("path"), F.col("uid")))
    if "shadow" in tables:
        parts.append(finding(tables["shadow"].filter(F.col("password_status") == "NP"), "no_password", F.col("username"), none))
    if "users" in tables:
        parts.append(finding(tables["users"].filter((F.col("uid") == 0) & (F.col("username") != "root")),
                             "extra_root_account", F.col("username"), none))
    if "hash" in tables:
        parts.append(finding(changed_values(tables["hash"], ["node_id", "path"], "sha256"),
                             "watched_file_changed", F.col("path"), F.col("sha256")))
    if "arp_cache" in tables:
        parts.append(finding(changed_values(tables["arp_cache"], ["node_id", "address"], "mac"),
                             "address_moved", F.col("address"), F.col("mac")))
    if "uptime" in tables:
        up = lag_in_slots(tables["uptime"], ["node_id"], ["ts", "event_id"], time_slot(F.col("ts"), ident=F.col("event_id")), {"previous": "total_seconds"})
        parts.append(finding(up.filter(F.col("total_seconds") < F.col("previous")), "reboot",
                             F.col("event_id"), F.col("total_seconds")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
