"""Exact quantiles by brackets, and alignments in memory of a row, against plain versions."""

import random
import time
import tracemalloc

import duckdb
import numpy as np
import pytest

from seqloom.operators import metrics
from seqloom.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("q", [0.0, 0.5, 0.98, 1.0])
def test_quantiles_of_odd_groups(spark, q):
    r = np.random.default_rng(0)
    groups = {
        "plain": r.normal(size=3000), "few": r.normal(size=7), "ties": np.repeat([1.0, 2.0, 3.0], [500, 900, 300]), "same": np.full(800, 4.0),
        "wide": 10.0 ** r.uniform(-300, 300, 2000), "two": np.array([1.0, 2.0]), "far": np.concatenate([r.normal(size=900), [1e300, -1e300, np.inf]]), None: r.random(600),
    }
    rows = [(g, float(v), 1) for g, x in groups.items() for v in x] + [("plain", None, 1), ("plain", float("nan"), 1), ("empty", None, 1)]
    df = spark.createDataFrame(rows, "g string, t double, k int").repartition(6)
    got = {x.g: x["limit"] for x in exact_quantiles(df, ["g", "k"], "t", q, small=50).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        want = np.quantile(x, q) if g != "far" or q < 0.99 else np.inf
        assert got[g] == pytest.approx(want, rel=1e-12), (g, q)


def test_quantile_of_one_large_group(spark):
    df = spark.range(2_000_000).selectExpr("1 AS g", "pow(pmod(hash(id), 1000003) / 1000003.0, 3) AS t")
    rows = df.select("t").toArrow()
    want = duckdb.sql("SELECT quantile_cont(t, 0.98) FROM rows").fetchall()[0][0]
    assert exact_quantiles(df, ["g"], "t", 0.98).first()["limit"] == pytest.approx(want, rel=1e-12)
    with pytest.raises(ValueError):
        exact_quantiles(df, ["g"], "t", 1.5)


def plain(truth, pred, costs, order):
    """The whole table of costs, and the path from its end."""
    n, m = len(truth), len(pred)
    d = np.zeros((n + 1, m + 1), dtype=int)
    d[:, 0], d[0] = np.arange(n + 1) * costs[0], np.arange(m + 1) * costs[2]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i, j] = min(d[i - 1, j] + costs[0], d[i - 1, j - 1] + (0 if truth[i - 1] == pred[j - 1] else costs[1]), d[i, j - 1] + costs[2])
    pairs, i, j = [], n, m
    while i or j:
        ways = {}
        if i:
            ways[0] = d[i - 1, j] + costs[0]
        if i and j:
            ways[1] = d[i - 1, j - 1] + (0 if truth[i - 1] == pred[j - 1] else costs[1])
        if j:
            ways[2] = d[i, j - 1] + costs[2]
        action = 2 if i == 0 else 0 if j == 0 else next(a for a in order if ways[a] == d[i, j])
        pairs.append((truth[i - 1] if action != 2 else None, pred[j - 1] if action != 0 else None))
        i, j = i - (action != 2), j - (action != 0)
    return int(d[n, m]), pairs[::-1]


@pytest.mark.parametrize("steps", [1, 12, 10**6])
@pytest.mark.parametrize("costs,order", [((7, 10, 7), (1, 0, 2)), ((3, 4, 3), (0, 1, 2)), ((1, 1, 1), (2, 1, 0)), ((1, 2, 1), (0, 2, 1))])
def test_same_path_however_it_is_cut(monkeypatch, steps, costs, order):
    monkeypatch.setattr(metrics, "STEPS", steps)
    r = random.Random(1)
    for _ in range(120):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 14))] for _ in range(2))
        got = metrics._align(a, b, costs, order)
        assert (got["dist"], got["pairs"]) == plain(a, b, costs, order)


def test_long_sequences_in_little_memory():
    r = random.Random(2)
    a = [r.choice("abcdefgh") for _ in range(8000)]
    b = [c for c in a if r.random() > 0.1] + ["z"] * 50
    tracemalloc.start()
    began = time.time()
    got = metrics._align(a, b, (1, 1, 1), (1, 0, 2))
    assert tracemalloc.get_traced_memory()[1] < 60e6 and time.time() - began < 120
    tracemalloc.stop()
    assert got["hits"] >= 7000 and got["deletions"] + got["hits"] + got["substitutions"] == 8000
