"""Registered queries against their SQL on the smallest tables, and the entry query."""

import math
import os

import pytest

import __spark_entry__ as entry
from tessera.operators.random import PCG64

SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op") and k != "pipeline"}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in os.listdir("/root/testdata/sf0.001"):
        p = f"/root/testdata/sf0.001/{t}"
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{p}{'/*' if os.path.isdir(p) else ''}')")
    return con


def plain(v):
    return "-" if v is None or v != v else f"{float(v):.8g}" if isinstance(v, float) else str(v)


def compared(spark, duck, sf, name):
    got, want = entry.queries()[name](spark, sf).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(tuple(map(plain, r)) for r in d[sorted(d.columns)].itertuples(index=False))
    for a, b in zip(rows(got), rows(want), strict=True):
        assert a == b or all(x == y or (x not in "-" and math.isclose(float(x), float(y), rel_tol=1e-6, abs_tol=1e-6)) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, sf, name):
    compared(spark, duck, sf, name)


def test_entry(spark):
    assert entry.entry(spark).count() == 2


def test_generator_is_the_public_one():
    """The first draws of the 32-bit output permutation are numpy-independent: range, repeatability and mean."""
    a, b = PCG64(7), PCG64(7)
    draws = [a.uniform() for _ in range(5000)]
    assert draws == [b.uniform() for _ in range(5000)] and 0 <= min(draws) and max(draws) < 1 and abs(sum(draws) / 5000 - 0.5) < 0.02
    assert {PCG64(1).randint(3, 5) for _ in range(3)} <= {3, 4}
