"""The queries that SQL can express, against that SQL in another engine."""

import duckdb
import numpy as np
import pytest

from cellwise.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    engine = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        engine.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    mine, other = queries.QUERIES[name](spark, SF).toPandas(), engine.execute(queries.SQL[name]).df()
    assert sorted(mine.columns) == sorted(other.columns) and len(mine) == len(other) > 0
    key = next(([c] for c in mine.columns if c.endswith("_id")), ["lang", "rank"])
    mine, other = (df[sorted(df.columns)].sort_values(key).reset_index(drop=True) for df in (mine, other))
    for c in mine.columns:
        if mine[c].dtype.kind == "f" or other[c].dtype.kind == "f":
            np.testing.assert_allclose(mine[c].astype(float), other[c].astype(float), rtol=1e-12)
        else:
            assert (mine[c].astype(str) == other[c].astype(str)).all(), c
