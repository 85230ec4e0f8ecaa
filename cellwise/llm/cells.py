"""Buckets split into cells of bounded size, in which every pair of a bucket still meets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_cells(df: DataFrame, spread: str, limit: int) -> DataFrame:
    """Add ``cell``, ``part`` and ``home`` to rows that have a long ``bucket``, dealt out and sorted by cell.

    A bucket of up to ``limit`` rows is one cell (part 0). A larger one is dealt by the hash of column
    ``spread`` into r parts, and there is a cell for every two parts (and each alone), so a row is copied r
    times, a cell holds some 2 x limit rows, and any two rows of a bucket share a cell; two rows of one part share
    several, but only one with ``home`` true. No row is dropped.
    """
    big = df.groupBy("bucket").count().where(F.col("count") > limit)
    big = big.select("bucket", F.ceil(F.col("count") / F.lit(limit)).cast("int").alias("parts"))
    own, other, parts = F.col("part"), F.col("other"), F.col("parts")
    alone = F.col("parts") == 1
    # a row meets its own part in one cell of two parts anyway, so there are no cells of one part
    others = F.when(alone, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), parts - 1), lambda x: x != own))
    every = (
        df.join(big, "bucket", "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("part", F.pmod(F.xxhash64(spread, F.lit(7)), parts).cast("int"))
        .withColumn("other", F.explode(others))
        .withColumn("home", alone | (other == F.pmod(own + 1, parts)))
        .withColumn("cell", F.when(alone, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least(own, other), F.greatest(own, other))))
        .drop("parts", "other")
    )
    return every.repartition("cell").sortWithinPartitions("cell")


def whole_cells(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """From batches sorted by cell: frames of whole cells, with the places at which cells begin (and the end)."""
    left: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        cell = batch["cell"].to_numpy()
        last = int(np.searchsorted(cell, cell[-1]))
        if last == 0 and left and left[-1]["cell"].iloc[-1] == cell[0]:
            left.append(batch)
            continue
        done = pd.concat([*left, batch.iloc[:last]], ignore_index=True) if left else batch.iloc[:last]
        left = [batch.iloc[last:]]
        if len(done):
            yield done, _bounds(done)
    if left:
        done = pd.concat(left, ignore_index=True)
        yield done, _bounds(done)


def _bounds(frame: pd.DataFrame) -> np.ndarray:
    cell = frame["cell"].to_numpy()
    return np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]])
