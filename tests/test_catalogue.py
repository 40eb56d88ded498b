"""Every query of the core against its SQL, on the smallest data; those without SQL must run."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

from weftline.plans import catalogue

duckdb = pytest.importorskip("duckdb")


def plain(value):
    if isinstance(value, float):
        return round(value, 6) if math.isfinite(value) else str(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value if isinstance(value, (int, str, bool, type(None))) else str(value)


@pytest.fixture(scope="module")
def views(data):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in Path(data).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, data, views, name):
    found = catalogue.QUERIES[name](spark, data)
    columns = sorted(found.columns)
    wanted = views.sql(catalogue.SQL[name])
    assert sorted(wanted.columns) == columns
    places = [wanted.columns.index(c) for c in columns]
    expected = sorted((tuple(plain(row[i]) for i in places) for row in wanted.fetchall()), key=repr)
    assert sorted((tuple(plain(row[c]) for c in columns) for row in found.collect()), key=repr) == expected


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_runs(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).count() >= 0


def test_flagship_is_ordered_by_score(spark, data):
    scores = [row["score"] for row in catalogue.flagship(spark, data).collect()]
    assert scores == sorted(scores, reverse=True) and scores
