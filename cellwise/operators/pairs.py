"""Ensemble means, leave-one-out means and the pairing of members with observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ensemble_mean(members: DataFrame, by: Sequence[str] = ("cell",)) -> DataFrame:
    """(by, t, s): the mean over members, missing ones skipped."""
    return members.groupBy(*by, "t").agg(F.avg("f").alias("s"))


def with_means(members: DataFrame, by: Sequence[str] = ("cell",)) -> DataFrame:
    """Add s (the mean of all members) and loo (that of the others): total less own, so no member meets any other in a join."""
    w = Window.partitionBy(*by, "t")
    total, count = F.sum("f").over(w), F.count("f").over(w)
    own, there = F.coalesce("f", F.lit(0.0)), F.col("f").isNotNull().cast("int")
    return members.withColumns({"s": F.avg("f").over(w), "loo": F.try_divide(total - own, count - there)})


def with_other_models(members: DataFrame, by: Sequence[str] = ("cell",)) -> DataFrame:
    """Add lmo: the mean over members of all other models, from the total less the model's own."""
    every, own = Window.partitionBy(*by, "t"), Window.partitionBy(*by, "t", "model")
    total = F.coalesce(F.sum("f").over(every) - F.coalesce(F.sum("f").over(own), F.lit(0.0)), F.lit(0.0))
    return members.withColumn("lmo", F.try_divide(total, F.count("f").over(every) - F.count("f").over(own)))


def with_obs(members: DataFrame, obs: DataFrame, by: Sequence[str] = ("cell",)) -> DataFrame:
    """Each member's value beside the observed one of its time; times without either drop out."""
    return members.join(obs, [*by, "t"])


def require_complete(members: DataFrame, by: Sequence[str] = ("cell",)) -> DataFrame:
    """``members``, or an error if a value is missing or the members of a cell have unlike numbers of times."""
    counts = members.groupBy(*by, "member").agg(F.count("f").alias("known"), F.count("*").alias("n"))
    odd = counts.agg(F.count_if(F.col("known") < F.col("n")).alias("missing"), F.count_distinct("n").alias("lengths")).first()
    if odd["missing"] or odd["lengths"] > 1:
        raise ValueError("values are missing: drop or fill them first")
    return members
