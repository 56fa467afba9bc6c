"""Key=value text, wildcard path patterns and identifier fallbacks."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

UNKNOWN_MACHINE = "unknown-machine-id"
MISSING_RELEASE = "Unknown Linux (os-release not found)"


def kv_entries(text: Column, sep: str) -> Column:
    """``A=1<sep>B=2`` as an array of (name, value), cut at the first ``=``; other parts drop out."""
    parts = F.filter(F.split(text, re.escape(sep)), lambda p: F.instr(p, "=") > 0)
    return F.transform(parts, lambda p: F.struct(
        F.substring_index(p, "=", 1).alias("name"),
        p.substr(F.instr(p, "=") + 1, F.length(p)).alias("value"),
    ))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def release_value(text: Column, key: str) -> Column:
    """Last value of ``key`` in release-file text; comments skipped, outer quotes removed."""
    lines = F.transform(F.split(text, "\n"), _strip)
    hits = F.filter(lines, lambda l: ~l.startswith("#") & (_strip(F.substring_index(l, "=", 1)) == key)
                    & (F.instr(l, "=") > 0))
    value = F.transform(hits, lambda l: F.regexp_replace(
        _strip(l.substr(F.instr(l, "=") + 1, F.length(l))), '^"+|"+$', ""))
    return F.when(F.size(value) > 0, F.element_at(value, -1))


def os_label_of(text: Column) -> Column:
    """Printable OS name: PRETTY_NAME, else NAME and VERSION, else a fixed default."""
    pretty, name, version = (release_value(text, k) for k in ("PRETTY_NAME", "NAME", "VERSION"))
    composed = F.concat_ws(" ", F.coalesce(name, F.lit("Linux")), version)
    return F.when(text.isNull(), MISSING_RELEASE).otherwise(F.coalesce(pretty, composed))


def first_nonblank(*candidates: Column, default: str) -> Column:
    """First candidate that is not blank after trimming."""
    trimmed = [_strip(c) for c in candidates]
    return F.coalesce(*[F.when(t != "", t) for t in trimmed], F.lit(default))


def wildcard_regex(pattern: str) -> str:
    """Watched-path pattern as a regular expression: ``%%`` spans levels, ``%`` stays in one."""
    return "".join({"%%": ".*", "%": "[^/]*"}.get(tok) or re.escape(tok)
                   for tok in re.split(r"(%%|%)", pattern) if tok)


def matches_any(col: Column, patterns) -> Column:
    """True where the path matches one of the wildcard patterns.

    Most patterns are a folder and everything below it, or one file; those need
    no regular expression.
    """
    below = [p[:-2] for p in patterns if p.endswith("%%") and "%" not in p[:-2]]
    exact = [p for p in patterns if "%" not in p]
    other = [p for p in patterns if p not in exact and p[:-2] not in below]
    out = F.lit(False)
    for prefix in below:
        out = out | col.startswith(prefix)
    if exact:
        out = out | col.isin(exact)
    if other:
        out = out | col.rlike("(?s)^(?:" + "|".join(map(wildcard_regex, other)) + r")\z")
    return out
