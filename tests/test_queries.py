"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidewheel import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(names, rows):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        if isinstance(v, bool):
            return str(v)
        return str(round(v, 6)) if isinstance(v, float) else str(v)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, sf_dir, duck, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    found = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(names, found.fetchall())


def test_consistent_partition(spark, sf_dir):
    from tidewheel.operators.routing import consistent_partition_of

    for r in catalog.QUERIES["part_consistent"](spark, sf_dir).limit(200).collect():
        assert r["partition"] == consistent_partition_of(r["id"], 8)


def test_outbox_insert_on_more_rows(spark):
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    got = catalog.QUERIES["outbox_insert"](spark, "/root/testdata/sf0.01")
    found = con.execute(catalog.ORACLE_SQL["outbox_insert"])
    names = [d[0] for d in found.description]
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(names, found.fetchall())
