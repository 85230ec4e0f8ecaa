"""Every query against its SQL in another engine, on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(entry.catalogue.SQL))
def test_same_rows_as_sql(spark, engine, name):
    mine, other = entry.queries()[name](spark, SF).toPandas(), engine.execute(entry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    columns = sorted(mine.columns)
    keys = sorted(columns, key=lambda c: mine[c].dtype.kind == "f")
    mine, other = (df[columns].sort_values(keys).reset_index(drop=True) for df in (mine, other))
    assert len(mine) == len(other) > 0
    for c in columns:
        if mine[c].dtype.kind == "f" or other[c].dtype.kind == "f":
            np.testing.assert_allclose(mine[c].astype(float), other[c].astype(float), atol=1.1e-6)
        else:
            assert (mine[c].astype(str) == other[c].astype(str)).all(), c


@pytest.mark.parametrize("name", ["point_lambda_knuth", "exchangeability_null_detrended", "boot_lambda", "boot_rho_seeded", "perfect_model_field", "lambda_m_definitions", "ksg_lambda", "largest_block"])
def test_the_others_give_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_the_flagship_is_lazy_and_reads_the_smallest_tables(spark):
    assert os.path.isdir(SF)
    assert entry.entry(spark).columns[:2] == ["cell", "alt"]
