"""Every catalogue query against its SQL; those without SQL run and keep a stable schema."""

from __future__ import annotations

import os

import duckdb
import pytest

from evigraph.plans import catalog, catalog_contents, catalog_streams, catalog_tables, catalog_texts  # noqa: F401

SF = "/root/testdata/sf0.01"  # in the smaller tables some queries have no rows
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    found = duckdb.connect()
    for name in TABLES:
        path = f"{SF}/{name}.parquet"
        found.execute(f"create view {name} as select * from '{path}{'' if os.path.isfile(path) else '/*.parquet'}'")
    return found


def plain(value):
    return round(value, 5) if isinstance(value, float) else list(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    out = catalog.QUERIES[name](spark, SF)
    rows = out.collect()
    assert rows
    if name not in catalog.SQL:
        return
    want = db.execute(catalog.SQL[name]).fetchall()
    columns = [c[0] for c in db.description]
    assert sorted(columns) == sorted(out.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in rows]
    assert sorted(map(str, got)) == sorted(str(tuple(map(plain, r))) for r in want)


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_folders_are_written_by_several_tasks(spark):
    from evigraph.shared import settings

    with settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        files = catalog.QUERIES["folder_sources"](spark, "/root/testdata/sf0.001").inputFiles()
    assert len({f.rsplit("/part-", 1)[1][:5] for f in files}) > 1
