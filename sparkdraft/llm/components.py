"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdraft.llm.common import stored


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Row count and an order-free digest of the edges."""
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], int(row["h"] or 0)


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``u, root`` for every node ``u`` of ``edges(u, v)`` that is not its component's smallest.

    Each round points every larger neighbour of a node to the smallest one (large
    star), then every smaller neighbour (small star), which keeps the components
    and at least halves the depth on the way.  The state is a stored table of at
    most as many rows as there are edges; a hub meets its edges through joins,
    which split skewed keys, and not in one task.
    """
    links = stored(
        edges.filter("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "links",
    )
    mark = _mark(links)
    for _ in range(max_rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = (
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
            .filter("u <> v")
            .distinct()
        )
        links = stored(small, "links")
        now = _mark(links)
        if now == mark:
            return links.select("u", F.col("v").alias("root"))
        mark = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
