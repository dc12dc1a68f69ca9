"""Each of the library's own queries against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from stayflow.plans.catalogue import oracle_sql, queries
from stayflow.plans.inputs import TABLES


def plain(v):
    """Queries round what they return; beyond their digits only the noise of another order of sums is allowed for."""
    return None if isinstance(v, float) and math.isnan(v) else v if isinstance(v, float) else str(v) if v is not None else None


def unit(x, y):
    """One in the last decimal that either number shows."""
    return 10.0 ** -max(next((d for d in range(9) if abs(round(v, d) - v) < 1e-10), 9) for v in (x, y))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, sf, duck, name):
    df = queries()[name](spark, sf)
    cur = duck.execute(oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    # numbers are compared by value: both engines name their integer types differently
    def key(row):
        return tuple(float(x) if x is not None and not isinstance(x, str) else x for x in row)

    got = sorted((key(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    want = sorted((key(plain(v) for v in r) for r in cur.fetchall()), key=repr)
    assert len(got) == len(want)
    # what lies on a half may be rounded to either side, as sums are added up in another order: one value in fifty, no more
    turned = 0
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            if x != y:
                assert isinstance(x, float) and isinstance(y, float), (a, b)
                if not math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9):
                    turned += 1
                    assert abs(x - y) <= 1.01 * unit(x, y), (a, b)
    assert turned <= max(1, len(got) * len(names) // 50)
