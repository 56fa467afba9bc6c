"""Rule scan with a shared index of all patterns (H1), for rule sets of any size.

``detect.match_rules`` tests the rules of an event's type one by one; its cost grows
with them. Here all substrings of all rules are looked for at once: one
automaton a field goes over the text and says which of them it holds, and only
rules with a hit are looked at. Each JSON field is taken out of the text once.
Regular expressions stay Spark's own, as literals behind their event type.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from fleetscope.operators.detect import RULE_COLUMNS, rejected_rules

MATCHES = "array<struct<rule:int,hits:bigint>>"


def substring_finder(needles: dict[str, list[int]]) -> Callable[[str], set[int]]:
    """Which numbers belong to the substrings that a text holds. The automaton takes one pass; without its library each is looked for."""
    always = set(needles.get("", ()))
    rest = {n: ids for n, ids in needles.items() if n}
    try:
        import ahocorasick
    except ImportError:
        return lambda text: always.union(*(ids for n, ids in rest.items() if n in text))
    if not rest:
        return lambda text: always
    machine = ahocorasick.Automaton()
    for n, ids in rest.items():
        machine.add_word(n, ids)
    machine.make_automaton()
    return lambda text: always.union(*(ids for _, ids in machine.iter(text)))


def match_rules_indexed(events: DataFrame, conditions: DataFrame, text: str = "payload") -> DataFrame:
    """The rows of ``detect.match_rules``. Rules are settings: they are read and checked while the plan is made, and go to the workers."""
    wrong = rejected_rules(conditions).limit(3).collect()
    if wrong:
        raise ValueError("; ".join(f"rule {r.rule_id}: {r.reason}" for r in wrong))
    rows = conditions.orderBy("event_type", "rule_id").collect()
    rules: dict[tuple, dict] = {}
    tests = []  # of each condition: its rule, field, pattern and mode
    for r in rows:
        rule = rules.setdefault((r.event_type, r.rule_id), {"no": len(rules), "type": r.event_type, "need": r.need, "of": 0, "row": r})
        rule["of"] += 1
        tests.append((rule["no"], r.field, r.pattern, r["mode"]))
    every = list(rules.values())
    if not every:
        return events.select("*", *[F.lit(None).cast(conditions.schema[c].dataType).alias(c) for c in RULE_COLUMNS], F.lit(0).cast("bigint").alias("hits")).filter(F.lit(False))
    kinds = [r["type"] for r in every]
    needs = [r["of"] if r["need"] == "all" else 1 if r["need"] == "any" else int(r["need"]) for r in every]
    owner = [no for no, _, _, _ in tests]

    fields = sorted({f for _, f, _, _ in tests})
    value = {f: F.col(text) if f == "*" else F.get_json_object(F.col(text), f"$.{f}") for f in fields}
    passed = []
    for i, (no, field, pattern, mode) in enumerate(tests):
        if mode == "regex":
            of_type = F.lit(True) if kinds[no] is None else F.col("event_type") == kinds[no]
            passed.append(F.when(of_type & F.rlike(F.col(f"__v.f{fields.index(field)}"), F.lit(pattern)), F.lit(i)))
    found = F.array(*passed) if passed else F.array().cast("array<int>")  # NULL where a test has not passed
    needles: list[dict[str, list[int]]] = [{} for _ in fields]
    for i, (_, field, pattern, mode) in enumerate(tests):
        if mode == "contains" and pattern is not None:
            needles[fields.index(field)].setdefault(pattern, []).append(i)

    def scan(batch):
        import pyarrow as pa
        finders = [substring_finder(n) for n in needles]
        columns = [c.to_pylist() for c in batch.flatten()]
        out = []
        for kind, regex_hits, *values in zip(*columns):
            hits: dict[int, int] = {}
            for i in reduce(set.union, (find(v) for find, v in zip(finders, values) if v is not None), set(regex_hits) - {None}):
                no = owner[i]
                if kinds[no] is None or kinds[no] == kind:
                    hits[no] = hits.get(no, 0) + 1
            out.append([{"rule": no, "hits": n} for no, n in hits.items() if n >= needs[no]])
        return pa.array(out, pa.list_(pa.struct([("rule", pa.int32()), ("hits", pa.int64())])))

    import pyarrow as pa
    scan.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    ask = F.arrow_udf(scan, MATCHES)
    asked = events.withColumn("__v", F.struct(*[value[f].alias(f"f{i}") for i, f in enumerate(fields)]))
    given = F.struct(F.col("event_type"), found.alias("passed"), *[F.col(f"__v.f{i}").alias(f"f{i}") for i in range(len(fields))])
    hit = asked.withColumn("__hit", F.explode(ask(given)))
    said = [F.element_at(F.array(*[F.lit(r["row"][c]).cast(conditions.schema[c].dataType) for r in every]), F.col("__hit.rule") + 1).alias(c) for c in RULE_COLUMNS]
    return hit.select(*events.columns, *said, F.col("__hit.hits").alias("hits"))
