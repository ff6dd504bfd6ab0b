"""Every query of the array engine against its SQL, at two sizes; the smallest volume is thinner than the regions."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__
import gridloom as g
from gridloom import queries
from gridloom.sources import array_source

SF = ("/root/testdata/sf0.001", "/root/testdata/sf0.01")


def rows_of(table) -> list[tuple]:
    return sorted((tuple(r) for r in table), key=repr)


@pytest.fixture(scope="module", params=SF)
def tables(request):
    connection = duckdb.connect()
    for name in os.listdir(request.param):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{request.param}/{name}'")
    return request.param, connection


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_its_sql(spark, tables, name):
    folder, connection = tables
    got = queries.queries()[name](spark, folder)
    want = connection.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.select(*names).collect()) == rows_of(want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 4


def test_pushdown_read_prunes_before_it_opens_files(spark, monkeypatch):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    kept = {}
    stored = queries.stored
    monkeypatch.setattr(queries, "stored", lambda *a, **o: kept.setdefault("path", stored(*a, **o)))
    want = queries.queries()["pushdown_read"](spark, "/root/testdata/sf0.1").count()
    low, high = g.grid.touched(*queries.box_in(g.open_array(kept["path"]).shape), (16, 16, 16))
    broken = [b for b in g.grid.blocks((0, 0, 0), (2, 2, 16)) if not all(a <= x < z for a, x, z in zip(low, b, high, strict=True))]
    assert broken
    for block in broken:
        with open(g.grid.path(g.open_array(kept["path"]), kept["path"], block), "wb") as f:
            f.write(b"broken")
    assert queries.queries()["pushdown_read"](spark, "/root/testdata/sf0.1").count() == want


def test_a_rebased_read_is_narrowed_too():
    meta = g.meta.ArrayMeta(shape=(100, 100, 100), chunks=(10, 10, 10))
    reader = array_source.PushingReader(meta, {"path": "x", "start": "20 0 0", "end": "90 100 100", "rebase": "true"})
    list(reader.pushFilters([array_source.GreaterThanOrEqual(("d0",), 15), array_source.LessThan(("d0",), 20)]))
    assert (reader.start, reader.end, reader.shift) == ((35, 0, 0), (40, 100, 100), (20, 0, 0))
