"""Row identity for string maps and deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def row_json(columns: Column) -> Column:
    """Canonical JSON text of a map: same entries in any order give the same text."""
    ordered = F.map_from_entries(F.sort_array(F.map_entries(columns)))
    return F.to_json(ordered, {"ignoreNullFields": "false"})


def entries_to_map(entries: Column) -> Column:
    """Name/value pairs to a map; a repeated name keeps its last value."""
    names = F.array_distinct(F.transform(entries, lambda e: e["name"]))
    return F.map_from_entries(F.transform(
        F.filter(names, lambda n: n.isNotNull()),
        lambda n: F.struct(
            n.alias("key"),
            F.element_at(F.filter(entries, lambda e: e["name"] == n), -1)["value"].alias("value"),
        ),
    ))


def merge_maps(base: Column, later: Column) -> Column:
    """Union of two maps in which ``later`` wins on a shared key; NULL counts as empty."""
    empty = F.expr("cast(map() as map<string,string>)")
    base, later = F.coalesce(base, empty), F.coalesce(later, empty)
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(later, k)), later)


def stable_uuid(text: Column) -> Column:
    """A UUID-shaped id that depends only on ``text``, so reruns give the same ids."""
    h = F.md5(text)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))
