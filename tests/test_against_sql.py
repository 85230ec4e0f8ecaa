"""Queries against their SQL on tables that the smallest ones don't resemble."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry


def both(spark, folder, name, table):
    """(query's rows, SQL's rows) over ``folder``, which holds that table alone."""
    engine = duckdb.connect()
    engine.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    mine, other = entry.queries()[name](spark, str(folder)).toPandas(), engine.execute(entry.oracle_sql()[name]).df()
    keys = [c for c in sorted(mine.columns) if mine[c].dtype.kind != "f"]
    return (df[sorted(mine.columns)].sort_values(keys).reset_index(drop=True) for df in (mine, other))


def test_a_last_time_with_few_members(spark, tmp_path):
    rng = np.random.default_rng(2)
    values = rng.normal(size=(125, 4)) + np.repeat(rng.normal(size=(13, 4)), 10, axis=0)[:125]
    for end in (123, 125):  # the last time has members 1 and 2, or 1 to 4
        (tmp_path / str(end)).mkdir()
        table = pa.table({"vec_id": np.arange(end), "label": ["a"] * end, "embedding": values[:end].tolist()})
        pq.write_table(table, tmp_path / str(end) / "embeddings.parquet")
        mine, other = both(spark, tmp_path / str(end), "perfect_model_leave_model_out", "embeddings")
        assert len(mine) == len(other) == 36 and mine["null"].notna().sum() > 10 and mine["ref"].notna().sum() > 10
        for c in mine.columns:
            np.testing.assert_allclose(mine[c].astype(float), other[c].astype(float), atol=1.1e-6)


def test_zeros_on_the_middle_edge_of_a_density(spark, tmp_path):
    """The outer percentiles lie between two values, and the last bit of what is between decides on which side of the middle edge the zeros are."""
    cases = [(21, 3.38, 3.45), (21, 3.87, 3.94), (28, 1.56, 1.63), (116, 3.81, 3.88), (117, 3.04, 3.11), (500, 2.0, 2.0)]
    values = [(f"kind {i}", v) for i, (n, low, high) in enumerate(cases) for v in [*[0.0] * (n // 2), *np.linspace(0.5, 1, n - n // 2 - 2).round(2), low, high]] + [("kind 0", None), ("none", None)]
    pq.write_table(pa.table({"event_type": [k for k, _ in values], "value": [v for _, v in values]}), tmp_path / "events.parquet")
    mine, other = both(spark, tmp_path, "pooled_density", "events")
    assert len(mine) == len(other) > len(cases) and (mine[["bin", "cell"]].to_numpy() == other[["bin", "cell"]].to_numpy()).all()
    np.testing.assert_allclose(mine["density"], other["density"], atol=1.1e-6)
    assert 19 in mine["bin"].tolist() and 20 in mine["bin"].tolist()
