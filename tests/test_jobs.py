"""Every registered job against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from fieldtopo import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list:
    return sorted(map(repr, df[sorted(df.columns)].astype(object).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_duckdb(spark, sf_dir, con, name):
    want, got = con.execute(registry.ORACLES[name]).fetchdf(), registry.QUERIES[name](spark, sf_dir).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.entry(spark).columns) == {"window_id", "node", "n_cells", "n_minima", "left_overlap", "next_overlap", "right_overlap", "chi", "cavities", "handles"}
    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
