"""Every query with SQL text gives the rows that DuckDB gives; the others run and repeat."""

import math
import os

import pytest

from tessera.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return None if isinstance(v, float) and math.isnan(v) else v


def rows(names, data):
    at = sorted(range(len(names)), key=names.__getitem__)
    return sorted(([plain(r[i]) for i in at] for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_duckdb(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    want = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_without_oracle(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["breakdown", "quantile_norm", "roc_interp", "length_batches", "chunk_shards", "pool_union"])
def test_partitions_do_not_matter(spark, sf, name):
    got = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            df = catalog.QUERIES[name](spark, sf)
            got.append(rows(df.columns, df.collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]
