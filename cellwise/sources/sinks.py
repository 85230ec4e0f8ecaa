"""Writing cases, results and summaries."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame

from cellwise.sources.catalog import uncovered


def write_case(rows: DataFrame, path: str, keys: Sequence[str] = ("var", "case")) -> None:
    """Write cases under their keys; a case that is there is replaced, others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_draws(rows: DataFrame, path: str, value: str = "value") -> None:
    """Write replicate values as floats."""
    rows.withColumn(value, rows[value].cast("float")).write.mode("overwrite").parquet(path)


def append_missing(rows: DataFrame, path: str, key: str) -> int:
    """Append the keys that a table does not have yet, so that a job that was cut off goes on; returns how many."""
    spark = rows.sparkSession
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path)
    new = rows.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti") if there else rows
    n = new.select(key).distinct().count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def require_coverage(expected: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``done``, or an error if a key lacks or comes twice."""
    wrong = uncovered(expected, done, keys).limit(5).collect()
    if wrong:
        raise ValueError(f"not every key is there once, such as {wrong}")
    return done


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def summary_json(summary: DataFrame) -> str:
    """A summary, a row per case, as JSON; rows in the order of all columns."""
    rows = [r.asDict(recursive=True) for r in summary.collect()]
    return json.dumps(sorted(rows, key=lambda r: json.dumps(r, sort_keys=True, default=str)), indent=1, default=str)


def summary_markdown(summary: DataFrame, digits: int = 3) -> str:
    """A summary as a table in Markdown."""
    show = lambda x: "" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)
    rows = [[show(x) for x in r] for r in summary.collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [summary.columns, ["---"] * len(summary.columns), *sorted(rows)]) + "\n"
