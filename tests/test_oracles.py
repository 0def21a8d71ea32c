"""Every registered query of the engine against its SQL, on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from loomcast.plans import catalogue, runs  # noqa: F401

SMALL = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return ("number", round(float(v), 9) + 0.0)
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for t in ("events", "documents", "embeddings", "labels", "conversations", "pages", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, tables, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalogue.ORACLES:
        assert got
        return
    said = tables.execute(catalogue.ORACLES[name])
    names = [d[0] for d in said.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in said.fetchall()), key=repr)
