"""Limits, seeded splits and shuffles, and row screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkdraft.functions.arrays import total
from sparkdraft.functions.hashing import seeded_fraction, seeded_hex
from sparkdraft.operators.rowindex import with_row_index


def head_sample(df: DataFrame, n: int, *order_by: Column | str) -> DataFrame:
    """The first ``n`` rows in the given order."""
    return df.orderBy(*order_by).limit(n)


def hash_shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows in a seeded random order, with that order as ``shuffle_key``."""
    return df.withColumn("shuffle_key", seeded_hex(seed, F.col(key))).orderBy("shuffle_key", key)


def shuffle_rank(df: DataFrame, key: str, seed: int = 42, name: str = "position") -> DataFrame:
    """The position of every row in the seeded order of :func:`hash_shuffle`."""
    hexed = df.withColumn("_hex", seeded_hex(seed, F.col(key)))
    return with_row_index(hexed, key, [F.col("_hex"), F.col(key)], name).drop("_hex")


def hash_split(
    df: DataFrame, key: str, fraction: float = 0.05, seed: int = 42, exact: bool = False
) -> DataFrame:
    """Add ``split``: ``test`` for a seeded share of the rows, else ``train``.

    By default a row is judged by its own hash, in place.  ``exact`` gives
    precisely ``ceil(fraction * n)`` test rows, for the price of a sort.
    """
    if not exact:
        inside = seeded_fraction(seed, F.col(key)) < fraction
        return df.withColumn("split", F.when(inside, "test").otherwise("train"))
    size = df.agg(F.ceil(F.count("*") * F.lit(fraction)).alias("n")).scalar()
    ranked = shuffle_rank(df, key, seed, "_rank")
    return ranked.withColumn("split", F.when(F.col("_rank") < size, "test").otherwise("train")).drop("_rank")


def cap_per_group(df: DataFrame, group: str, order_by: str, n: int) -> DataFrame:
    """The first ``n`` rows of every group.

    Spark keeps at most ``n`` rows per group and map task before the shuffle
    (WindowGroupLimit), so a dominant group costs no more than any other.
    """
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order_by))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def min_loss_filter(df: DataFrame, block_size: int, mask: str = "loss_mask") -> DataFrame:
    """Rows with at least two blocks' worth of loss tokens."""
    return df.filter(total(F.col(mask)) >= 2 * block_size)


def min_loss_report(df: DataFrame, block_size: int, mask: str = "loss_mask") -> DataFrame:
    """One row: rows before and after :func:`min_loss_filter`, and the share that stays."""
    enough = total(F.col(mask)) >= 2 * block_size
    counted = df.agg(F.count("*").alias("before"), F.count_if(enough).alias("after"))
    return counted.withColumn("share", F.try_divide(F.col("after"), F.col("before")))


def drop_empty(df: DataFrame, column: str = "conversations") -> DataFrame:
    """Rows whose conversation exists and is not empty."""
    return df.filter(F.size(column) > 0)


def has_nan(vector: Column) -> Column:
    return F.exists(vector, lambda x: F.isnan(x))


def drop_non_finite(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with no NaN in any of the vector or matrix columns; null is fine."""
    clean = F.lit(True)
    for name in columns:
        kind = df.schema[name].dataType
        nested = kind.elementType.typeName() == "array"
        bad = F.exists(name, has_nan) if nested else has_nan(F.col(name))
        clean = clean & ~F.coalesce(bad, F.lit(False))
    return df.filter(clean)


def skip_existing(df: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the stored ones."""
    return df.join(stored.select(key), key, "left_anti")


def skip_existing_bucketed(df: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """:func:`skip_existing` for two tables in equal buckets by key: bucket meets bucket, nothing is moved."""
    return df.join(stored.select(key).hint("merge"), key, "left_anti")
