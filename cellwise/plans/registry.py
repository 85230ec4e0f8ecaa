"""Named queries over a folder of Parquet tables, each with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DIGITS = 6


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name; its numbers come out as longs and as doubles of six digits."""

    def add(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(function(spark, sf_dir))

        run.__name__, run.__doc__ = function.__name__, function.__doc__
        QUERIES[function.__name__] = run
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


def plain(df: DataFrame) -> DataFrame:
    def column(name: str, kind: str):
        if kind in ("double", "float"):
            return (F.round(F.col(name).cast("double"), DIGITS) + 0.0).alias(name)  # + 0: no negative zero
        return F.col(name).cast("long").alias(name) if kind in ("int", "smallint", "tinyint") else F.col(name)

    return df.select(*[column(*c) for c in df.dtypes])


def select(ctes: str, source: str, keys: Sequence[str], doubles: Sequence[str] = (), longs: Sequence[str] = ()) -> str:
    """SQL: the columns of ``source`` in that plain form; keys as they are."""
    columns = [*keys, *[f"{c}::BIGINT AS {c}" for c in longs], *[f"round({c}::DOUBLE, {DIGITS}) + 0.0 AS {c}" for c in doubles]]
    return f"{ctes}\nSELECT {', '.join(columns)} FROM {source}"


#: The ensemble of the embeddings as common table expressions: members m, observations o, members with means ms, pairs p.
E = """WITH e AS (SELECT vec_id, UNNEST(embedding)::DOUBLE AS f, GENERATE_SUBSCRIPTS(embedding, 1) - 1 AS cell FROM embeddings),
m AS (SELECT cell::BIGINT AS cell, (vec_id % 10)::BIGINT AS member, (vec_id // 10)::BIGINT AS t, f FROM e WHERE vec_id % 10 <> 0),
o AS (SELECT cell::BIGINT AS cell, (vec_id // 10)::BIGINT AS t, f AS o FROM e WHERE vec_id % 10 = 0),
ms AS (SELECT *, avg(f) OVER (PARTITION BY cell, t) AS s,
  (sum(f) OVER (PARTITION BY cell, t) - f) / (count(f) OVER (PARTITION BY cell, t) - 1) AS loo FROM m),
p AS (SELECT ms.*, o.o FROM ms JOIN o USING (cell, t))"""

#: The ragged ensemble of the line items: l(cell, member, t, f); and the orders' series r(t, o).
L = """WITH l AS (SELECT l_returnflag || l_linestatus AS cell, (l_suppkey % 10)::BIGINT AS member,
  (year(l_shipdate) * 12 + month(l_shipdate) - 1)::BIGINT AS t, avg(l_extendedprice::DOUBLE) / 1000 AS f FROM lineitem GROUP BY ALL),
r AS (SELECT (year(o_orderdate) * 12 + month(o_orderdate) - 1)::BIGINT AS t, avg(o_totalprice::DOUBLE) AS o FROM orders GROUP BY ALL)"""

#: An 8 x 8 grid for the 64 cells.
GRID = "g AS (SELECT cell, -90 + (cell // 8 + 0.5) * 22.5 AS lat, (cell % 8) * 45.0 AS lon, cos(radians(-90 + (cell // 8 + 0.5) * 22.5)) AS w FROM (SELECT DISTINCT cell FROM m))"


def sql_bin(x: str, low: str, high: str, bins: str) -> str:
    a, b = f"(CASE WHEN {low} = {high} THEN {low} - 0.5 ELSE {low} END)", f"(CASE WHEN {low} = {high} THEN {high} + 0.5 ELSE {high} END)"
    step = f"(({b} - {a}) / {bins})"
    first = f"least(floor(({x} - {a}) / {step}), {bins} - 1)"
    lower = f"(CASE WHEN {first} > 0 AND {x} < {first} * {step} + {a} THEN {first} - 1 ELSE {first} END)"
    return f"(CASE WHEN {lower} < {bins} - 1 AND {x} >= ({lower} + 1) * {step} + {a} THEN {lower} + 1 ELSE {lower} END)"


def sql_information(codes: str, by: str) -> str:
    """A subquery (by, n, mi, h_x, h_y, h_xy) of a relation with cx and cy."""
    return f"""(SELECT {by}, max(n) AS n, sum(c / n * log2(c * n / (rx * ry))) AS mi, -sum(c / n * log2(rx / n)) AS h_x, -sum(c / n * log2(ry / n)) AS h_y, -sum(c / n * log2(c / n)) AS h_xy FROM (
  SELECT *, sum(c) OVER (PARTITION BY {by}, cx) AS rx, sum(c) OVER (PARTITION BY {by}, cy) AS ry, sum(c) OVER (PARTITION BY {by}) AS n
  FROM (SELECT {by}, cx, cy, count(*)::DOUBLE AS c FROM {codes} GROUP BY {by}, cx, cy)) GROUP BY {by})"""


def sql_fd(x: str) -> str:
    return f"CASE WHEN quantile_cont({x}, 0.75) > quantile_cont({x}, 0.25) THEN floor((max({x}) - min({x})) / (2 * (quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)) / pow(count({x}), 1.0 / 3))) END"


def sql_lambda(i: str) -> str:
    return f"(CASE WHEN {i} > 1e-12 THEN sqrt(1 - pow(2.0, -2 * {i})) ELSE 0 END)"
