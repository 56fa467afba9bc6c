"""Every registered query against its DuckDB twin."""

import pytest

import __spark_entry__ as entry
from checks.cases import CASES
from checks.compare import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


# Optional subpackages test their own queries. The plain projections of the smaller packs differ in column lists only; ``checks.compare`` runs them all.
KEYS = [k for k in sorted(CASES) if not k.startswith(("qa_", "qh_", "qx_"))]


@pytest.mark.parametrize("key", KEYS)
def test_matches_duckdb(spark, con, key):
    problem = compare(spark, con, QUERIES[key], ORACLE[key], SF)
    assert problem is None, problem


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["topic", "events", "nodes"] and out.count() == 5


def test_every_operator_is_registered():
    ids = {k.split("_")[0] for k in QUERIES}
    expected = {f"{p}{i}" for p, n in dict(a=10, b=23, c=9, d=9, e=9, f=8, g=10, h=10, s=7, u=3).items() for i in range(1, n + 1)}
    assert expected <= ids
