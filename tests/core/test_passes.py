"""Registered queries whose fits read no row to the driver, against their SQL; and passes against numpy."""

import numpy as np
import pytest

import tessera.core as core
from tessera.operators import compose, neighbors, trees
from tessera.sources.tables import from_numpy
from tests.core.test_entry import SQL, compared, duck  # noqa: F401

#: Column aggregates that build no ``Data``.
OTHER = ("metric_", "kfold", "repeated_", "stratified_", "group_", "time_series", "shuffle", "leave_", "predefined", "parameter_", "train_test", "streaming_windows")
FITS = sorted(k for k in SQL if not k.startswith(OTHER))


@pytest.mark.parametrize("name", FITS)
def test_distributed_fit_equals_sql(spark, duck, sf, monkeypatch, name):  # noqa: F811
    monkeypatch.setattr(core, "LOCAL_CELLS", 0)
    compared(spark, duck, sf, name)


def odd_rows(n=700):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.standard_normal(n), rng.integers(-3, 4, n) / 4.0, rng.choice([0.0, -0.0, 1e-300, -1e300, 5e-324, 7.0], n)])
    x[: n // 3] = x[0]  # a third of all rows is one row
    return x


@pytest.mark.parametrize("cells", [0, 10**9])
def test_ranks_and_quantiles_are_exact(spark, monkeypatch, cells):
    monkeypatch.setattr(core, "LOCAL_CELLS", cells)
    x = odd_rows()
    data = core.Data(from_numpy(spark, x).repartition(5), ["f0", "f1", "f2"])
    ranks = [0, 1, 17, 233, 350, 698, 699]
    assert np.array_equal(data.ranked(ranks), np.sort(x, axis=0)[ranks].T + 0.0)
    qs = [0, 0.1, 0.25, 0.5, 0.77, 1]
    assert np.allclose(data.quantiles(qs), np.quantile(x, qs, axis=0).T, rtol=1e-12)
    assert np.allclose(data.quantiles([0.5], lambda a, y, w: np.abs(a[:, :1]))[0, 0], np.median(np.abs(x[:, 0])))


def test_doubles_keep_their_order_as_whole_numbers():
    x = np.array([-np.inf, -1e308, -1.0, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1e308, np.inf])
    u = core.sortable(x)
    assert (np.diff(u.astype(object)) >= 0).all() and u[4] == u[5] and np.array_equal(core.unsortable(u), x + 0.0)


def test_tree_edges_are_the_same_on_both_paths(spark, monkeypatch):
    x = odd_rows()
    df = from_numpy(spark, x).repartition(4)
    found = []
    for cells in (0, 10**9):
        monkeypatch.setattr(core, "LOCAL_CELLS", cells)
        found.append([trees.edges_of(core.Data(df, ["f0", "f1", "f2"]), m) for m in (5, 100, 1000)])
    for a, b in zip(*found, strict=True):
        assert all(np.array_equal(u, v) for u, v in zip(a, b, strict=True))
    assert np.array_equal(found[0][2][1], np.unique(x[:, 1])[:-1])


def test_a_hot_row_is_drawn_as_often_as_it_is_there(spark):
    x = odd_rows(3000)
    rows = core.Data(from_numpy(spark, x).repartition(4), ["f0", "f1", "f2"]).first(600, 1)
    assert 0.25 < (rows == x[0]).all(1).mean() < 0.42


def test_isotonic_pools_in_ranges_equal_pooling_all(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 400, 2000) / 7.0
    y = np.sin(x / 9) * 3 + x / 10 + rng.standard_normal(2000)
    df = from_numpy(spark, x[:, None], y).repartition(6)
    for up in (True, False):
        m = compose.IsotonicRegression(increasing=up).fit(df, ["f0"], "y")
        u = np.unique(x)
        s, n = (np.array([v[x == k].sum() for k in u]) for v in (y * (1 if up else -1), np.ones(2000)))
        below, count = np.concatenate([[0], np.cumsum(s)]), np.concatenate([[0], np.cumsum(n)])
        want = [max(min((below[k] - below[j]) / (count[k] - count[j]) for k in range(i + 1, len(u) + 1)) for j in range(i + 1)) for i in range(len(u))]
        assert np.allclose(np.interp(u, m.x_, m.y_), np.array(want) * (1 if up else -1))


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_near_pairs_are_those_of_plain_distances(metric):
    """Equal rows are at 0 and ties go to the first, in blocks of any size and far from the origin."""
    rng = np.random.default_rng(1)
    r = rng.integers(0, 3, (900, 4)) + 1e6
    q = np.concatenate([r[:60], r[:40] + 0.5])
    d = neighbors.distances(q, r, metric)
    plain = np.abs(q[:, None] - r[None])
    assert np.array_equal(d, np.sqrt((plain**2).sum(2)) if metric == "euclidean" else plain.sum(2)) and (d[np.arange(60), np.arange(60)] == 0).all()
    rows, cols, dist = neighbors.near_pairs(q, r, metric, 2, 7, None)
    want = np.argsort(d, axis=1, kind="stable")[:, :7]
    assert np.array_equal(cols.reshape(-1, 7), want) and np.array_equal(dist, np.take_along_axis(d, want, 1).ravel())
    rows, cols, _ = neighbors.near_pairs(q, r, metric, 2, None, 1.0)
    assert set(zip(rows.tolist(), cols.tolist(), strict=True)) == set(zip(*(v.tolist() for v in np.nonzero(d <= 1.0)), strict=True))
