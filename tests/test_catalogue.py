"""Every registered query of the library proper against its SQL, on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from millrace.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in catalogue.oracle_sql():  # no page of the tables has structured data: planted_jsonld covers it
        assert name == "page_jsonld" and rows == []
        return
    found = duck.sql(catalogue.oracle_sql()[name])
    order = [found.columns.index(c) for c in columns]
    assert sorted(found.columns) == columns
    assert rows == sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())


def test_every_oracle_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(catalogue.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0 and os.path.isdir(SF)
