"""Exact and approximate vector search against brute force."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import compare, duck
from fleetscope.llm import ann, queries, topk, vectors

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, id string, vector string, cell string, score string"


def table(spark, seed=0, rows=400, dim=24):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, dim)).astype(np.float32)
    x[50:80] = x[50]  # ties
    data = [(i, [float(v) for v in x[i]], 0, "", "", "", "") for i in range(rows)]
    odd = [None, [], [None] * dim, [NAN] * dim, [INF] * dim, [1.0, 2.0], [0.0] * dim]
    data += [(1000 + i, v, 0, "", "", "", "") for i, v in enumerate(odd)] + [(None, data[0][1], 0, "", "", "", ""), (7, data[7][1], 0, "", "", "", "")]
    return data, spark.createDataFrame(data, SCHEMA).repartition(5)


def usable(data, zeros=True):
    return [(i, np.array(v, float)) for i, v, *_ in data if i is not None and v and None not in v and np.isfinite(v).all() and (zeros or any(v))]


def ranked(rows):
    out = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        out[r.query_id].append((r.score, r.vec_id))
    return out


@pytest.mark.parametrize("block", [2048, 7])
def test_exact_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
    data, df = table(spark)
    got = ranked(topk.exact_top_k(df, F.col("vec_id") % 20 == 0).collect())
    good = [(i, np.floor(v * 1024).astype(int)) for i, v in usable(data)]
    want = {}
    for i, q in good:
        if i % 20 == 0:
            scores = sorted((-int(q @ v), j) for j, v in good if j != i and len(v) == len(q))[:10]
            if scores:
                want[i] = [(-s, j) for s, j in scores]
    assert dict(got) == want
    assert topk.exact_top_k(df.where("false"), F.lit(True)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x, q = np.floor(rng.normal(size=(50, 19)) * 1024), np.floor(rng.normal(size=(9, 19)) * 1024)
    exact, last = q @ x.T, None
    for level in (1, 4, 16):
        bound = topk.statistics(q, level) @ topk.statistics(x, level).T
        assert (bound + 1e-6 >= exact).all() and (last is None or (bound <= last + 1e-6).all())
        last = bound


def test_large_components_stay_exact():
    q = x = np.array([[2.0**31, 3.0]])
    assert topk.inner(q, x, np.array([0]), np.array([0]))[0] == 2**62 + 9


def test_nearest(spark):
    data, df = table(spark, 3)
    got = ranked(ann.nearest(df, F.col("vec_id") % 20 == 0).collect())
    good, hits, total = usable(data, zeros=False), 0, 0
    for i, q in good:
        if i % 20 == 0:
            near = sorted((float(np.sqrt(((q - v) ** 2).sum())), j) for j, v in good if j != i and len(v) == len(q))[:10]
            assert len(got[i]) == len(near) and got[i] == sorted(got[i])
            exact = {j: d for d, j in near}
            hits += sum(j in {n for _, n in got[i]} for j in exact)
            total += len(near)
            assert all(abs(exact[j] - d) < 1e-12 for d, j in got[i] if j in exact)
    assert hits / total >= 0.9
    assert ann.nearest(df.where("false"), F.lit(True)).count() == 0


def test_walk_goes_by_summed_distance():
    rng = np.random.default_rng(2)
    a, b = rng.random(6), rng.random(5)
    sums = (a[:, None] + b[None, :]).ravel()
    assert ann.walk(a, b, np.ones(30, int), 30) == np.argsort(sums, kind="stable").tolist()


def test_recall_on_the_given_table(spark):
    path = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").orderBy("vec_id").collect()
    x, got, hits = np.array([r.embedding for r in rows], float), ranked(queries.op6_nearest_neighbours(spark, path).collect()), 0
    for i in range(0, len(x), 100):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        hits += len(set(np.argsort(d)[:10]) & {j for _, j in got[i]})
    assert hits / (10 * len(got)) >= 0.9


def test_top_k_matches_duckdb(spark):
    path = "/root/testdata/sf0.01"
    assert compare(spark, duck(path), queries.op1_exact_top_k, queries.ORACLE["op1_exact_top_k"], path) is None


def test_components_too_large_for_a_long_are_said_so(spark):
    df = spark.createDataFrame([(0, [1e18, 1.0]), (1, [1e18, 2.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit into a long"):
        topk.exact_top_k(df, F.col("vec_id") == 0).collect()
    assert topk.exact_top_k(df.where("vec_id = 2 or vec_id < 0"), F.col("vec_id") == 0).collect() == []
