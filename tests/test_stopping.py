"""Registered iterative queries run to their operators' own stopping rule, against brute force on the smallest tables."""

import os

import numpy as np
import pytest

import __spark_entry__ as entry
from loomgraph.sources import tables

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")


def ends(edges):
    """Sorted ids, and the edges' ends as places among them."""
    src, dst = np.array([(r["src"], r["dst"]) for r in edges]).T
    ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    return ids, at[: len(src)], at[len(src) :]


def column(df, *names):
    rows = sorted(df.collect(), key=lambda r: r["id"])
    return [np.array([r[n] for r in rows]) for n in names]


@pytest.fixture(scope="module")
def dense(spark):
    return ends(tables.part_chain(spark, SF).collect())


def test_pagerank_converge_settles(spark, dense):
    ids, s, t = dense
    n, out = len(ids), np.bincount(s, minlength=len(ids))
    r, rounds = np.full(n, 1 / n), 0
    while True:
        rounds += 1
        got = np.bincount(t, 0.85 / out[s] * r[s], n)
        new = got + (1 - got.sum()) / n
        step, r = np.abs(new - r).sum(), new / new.sum()
        if step <= 1e-7:
            break
    assert rounds > 6
    assert np.allclose(column(entry.queries()["pagerank_converge"](spark, SF), "rank")[0], r, rtol=0, atol=1e-9)


def test_pagerank_delta_settles(spark, dense):
    ids, s, t = dense
    n, out = len(ids), np.bincount(s, minlength=len(ids))
    p, delta, active, rounds = np.zeros(n), np.full(n, 1 / n), np.ones(n, bool), 0
    while True:
        rounds += 1
        on = active[s]
        got = np.bincount(t[on], delta[s[on]] / out[s[on]], n)
        first = 0.85 * (p + got) + 0.15 / n - p
        delta, p = (first - 1 / n, p + first) if rounds == 1 else (0.85 * got, p + 0.85 * got)
        active = np.abs(delta) > 0.01 * p
        if np.abs(delta).sum() < 1e-7:
            break
    assert rounds > 6
    assert np.allclose(column(entry.queries()["pagerank_delta"](spark, SF), "rank")[0], p, rtol=0, atol=1e-9)


def test_bp_runs_ten_rounds(spark):
    edges = tables.part_chain_sparse(spark, SF).collect()
    ids, s, t = ends(edges)
    a, b = (ids[s] + ids[t]) % 3 / 10, (3 * ids[s] + ids[t]) % 5 / 10
    e = ((0.5 + a, 0.5 - a), (0.3 + b, 0.7 - b))
    v = (0.9 + ids % 3 / 10, 1.1 - ids % 3 / 10)
    p = [np.ones(len(ids)), np.ones(len(ids))]
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        for _ in range(10):
            new = [np.ones(len(ids)), np.ones(len(ids))]
            for i in range(2):
                np.multiply.at(new[i], t, v[0][t] * e[i][0] * p[0][t] + v[1][t] * e[i][1] * p[1][t])
            p = new
    got = column(entry.queries()["bp"](spark, SF), "p0", "p1")
    # products aren't normalised: what overflows a double is infinite on both sides
    for x, y in zip(got, p, strict=True):
        assert np.allclose(x, y, rtol=1e-7, atol=1e-7, equal_nan=True)
