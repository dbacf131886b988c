"""Dense positions and running totals without a single-partition window."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkdraft.session import stored

#: Positions per chunk when a group is cut along its own order.
CHUNK = 512


#: A number that Spark gives a row holds the partition above these bits and the place in it below.
_PLACE_BITS = 33


def with_row_index(df: DataFrame, key: str, order_by: list[Column] | None = None, name: str = "idx") -> DataFrame:
    """Number the rows 0, 1, 2, … in the order of a unique ``key``, or of ``order_by``; null keys come first.

    The rows are dealt into ranges of the key by bounds that Spark samples, sorted
    there and stored, each with its range and its place in it.  A row's number is its
    place plus the rows of the ranges before, of which the driver adds up one count per
    range.  The plan is the same for ten rows and for any number of them: there are
    as many ranges as shuffle partitions (less those that adaptive execution joins),
    and no task sees more than a range.
    """
    order = [F.col(key)] if order_by is None else order_by
    placed = stored(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()),
        "row-index",
    ).withColumn("_range", F.shiftright("_at", _PLACE_BITS))
    sizes = sorted(map(tuple, placed.groupBy("_range").agg(F.count("*")).collect()))
    starts = accumulate((n for _, n in sizes), initial=0)
    offsets = df.sparkSession.createDataFrame(
        [(number, start) for (number, _), start in zip(sizes, starts)], "_range bigint, _before bigint"
    )
    place = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    # One row per range.
    return (
        placed.join(F.broadcast(offsets), "_range")
        .withColumn(name, F.col("_before") + place)
        .drop("_range", "_at", "_before")
    )


def running_totals(
    df: DataFrame, key: str, position: str, values: dict[str, Column], size: int = CHUNK, levels: int = 2
) -> DataFrame:
    """Sums over the earlier positions of the same key, one column per value.

    The group is cut into chunks of ``size`` positions: totals run inside a
    chunk, and the chunk sums (one row each) run along the group, themselves cut
    into chunks while ``levels`` last.  A key with a third of all rows is thus
    spread over as many tasks as it has chunks, and its last window holds one row
    per ``size ** levels`` positions.  ``position`` is an integer, unique within
    the key.
    """
    chunk = f"_chunk{levels}"
    temp = {name: f"_v{levels}_{i}" for i, name in enumerate(values)}
    rows = df.withColumn(chunk, F.floor(F.col(position) / size))
    for name, value in values.items():
        rows = rows.withColumn(temp[name], value)
    inside = Window.partitionBy(key, chunk).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(key, chunk).agg(*[F.sum(t).alias(t) for t in temp.values()])
    if levels > 1:
        totals = running_totals(sums, key, chunk, {t + "b": F.col(t) for t in temp.values()}, size, levels - 1)
        before = totals.drop(*temp.values())
    else:
        along = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
        before = sums.select(
            key, chunk, *[F.coalesce(F.sum(t).over(along), F.lit(0)).alias(t + "b") for t in temp.values()]
        )
    local = rows.select(
        "*", *[F.coalesce(F.sum(t).over(inside), F.lit(0)).alias(t + "l") for t in temp.values()]
    )
    joined = local.join(before, [key, chunk])
    return joined.select(
        *df.columns,
        *[(F.col(t + "b") + F.col(t + "l")).cast("bigint").alias(name) for name, t in temp.items()],
    )
