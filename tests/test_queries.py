"""Every registered query with SQL against DuckDB on the small tables."""

import math
import os

import duckdb
import pytest

from tickloom.plans.queries import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return f"{v:.4f}" if isinstance(v, float) else str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(_plain(r[i]) for i in order) for r in found)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("events", "orders"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got.columns, got.collect()), rows(want.columns, want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or abs(float(u) - float(v)) < 2e-4


def test_model_rows_of_all_folds(spark):
    d = "/root/testdata/sf0.01"
    p = QUERIES["logistic_predictions"](spark, d).toPandas()
    want = {r.fold: r.test_rows for r in QUERIES["purged_split"](spark, d).collect() if r.test_rows}  # the embargo takes the last month whole
    assert p.groupby("fold").size().to_dict() == want and len(want) > 70 and p.model_probability.between(0, 1).all()
