"""Distributed connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwise.llm.store import drop, keep


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Rows ``(id, root)`` for every node of ``edges(a, b)``; root is the least id that links reach.

    Every round hooks each node and its smaller neighbours to the least of them, then lets each
    node jump to its neighbour's least neighbour. Both are equi-joins with a pre-aggregated table, so a
    star around one node stays a skewed join that adaptive execution can split. Path lengths shrink
    geometrically. Edges with a null end and loops link nothing; repeated edges count once; no edges give an
    empty table. The ends may be numbers, strings or structs, all of one type: of structs the root is the one that sorts first, so
    a value that decides may stand first in them.
    """
    now = keep(_oriented(edges.select("a", "b")), "edges")
    for _ in range(max_rounds):
        least = now.groupBy("hi").agg(F.min("lo").alias("least"), F.count("*").alias("n"))
        state = (
            now.join(least.select(F.col("hi").alias("lo"), F.lit(1).alias("deep")), "lo", "left")
            .agg(F.count("deep").alias("deep"), F.count("*").alias("edges"), F.count_distinct("hi").alias("nodes"))
            .first()
        )
        if not state["deep"] and state["edges"] == state["nodes"]:
            break
        hooked = now.join(least, "hi")
        hooked = hooked.select(F.col("hi").alias("a"), F.col("least").alias("b")).unionByName(
            hooked.where("n > 1").select(F.col("lo").alias("a"), F.col("least").alias("b"))
        )
        middle = keep(_oriented(hooked), "edges")
        up = middle.groupBy(F.col("hi").alias("lo")).agg(F.min("lo").alias("up"))
        jumped = middle.join(up, "lo", "left").select(F.col("hi").alias("a"), F.coalesce("up", "lo").alias("b"))
        # the skipped link lo -> up stays, as lo is itself an upper end of a row
        after = keep(_oriented(jumped), "edges")
        drop(now)
        drop(middle)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    ends = now.select(F.col("hi").alias("id"), F.col("lo").alias("root"))
    return ends.unionByName(now.select(F.col("lo").alias("id"), F.col("lo").alias("root")).distinct())


def _oriented(edges: DataFrame) -> DataFrame:
    return (
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
