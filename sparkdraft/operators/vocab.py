"""Target vocabulary to draft vocabulary.

A frequency table has at most one row per id of the target vocabulary, so all
that follows the count works on a table of known, small size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkdraft.functions.rows import explode_rows

#: Vocabularies up to this size may be broadcast; larger ones are joined.
BROADCAST_LIMIT = 1_000_000


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table known to hold at most ``rows`` rows, if that is few."""
    return F.broadcast(df) if rows <= BROADCAST_LIMIT else df


def token_frequency(df: DataFrame, ids: str = "input_ids", mask: str = "loss_mask") -> DataFrame:
    """``token_id, freq`` over positions whose mask is 1.

    Partial counts are at most one row per id and task, so common ids do not
    skew the shuffle.
    """
    places = F.arrays_zip(F.col(ids).alias("id"), F.col(mask).alias("m"))
    return (
        explode_rows(df, places, item="t")
        .filter("t.m = 1")
        .groupBy(F.col("t.id").alias("token_id"))
        .agg(F.count("*").alias("freq"))
    )


def _with_unused(freq: DataFrame, size: int) -> DataFrame:
    """The counted ids plus every id below ``size``, ``freq`` null where unused.

    A union and a regrouping rather than an anti-join, so that the counts over
    the corpus are computed once.
    """
    ids = freq.sparkSession.range(size).select(
        F.col("id").cast("int").alias("token_id"), F.lit(None).cast("bigint").alias("freq")
    )
    both = freq.select("token_id", "freq").unionByName(ids)
    return both.groupBy("token_id").agg(F.max("freq").alias("freq"))


def fill_vocab(freq: DataFrame, size: int) -> DataFrame:
    """Add unused ids below ``size`` with count 0 until there are ``size`` ids."""
    # The window holds one row per vocabulary id, a configured number.
    order = F.row_number().over(Window.orderBy(F.col("freq").isNull(), "token_id"))
    ranked = _with_unused(freq, size).withColumn("_p", order)
    return ranked.filter(F.col("freq").isNotNull() | (F.col("_p") <= size)).select(
        "token_id", F.coalesce("freq", F.lit(0).cast("bigint")).alias("freq")
    )


def keep_top(freq: DataFrame, size: int) -> DataFrame:
    """The ``size`` most frequent ids; equal counts go to the smaller id.

    Unused ids count 0 and come last, smallest first, which is the filling.
    """
    counted = _with_unused(freq, size).select(
        "token_id", F.coalesce("freq", F.lit(0).cast("bigint")).alias("freq")
    )
    return counted.orderBy(F.desc("freq"), F.asc("token_id")).limit(size)


def draft_vocab(freq: DataFrame, size: int) -> DataFrame:
    """``draft_id, token_id, offset, freq``: kept ids ascending, offset = token - draft."""
    top = keep_top(freq, size)
    draft = (F.row_number().over(Window.orderBy("token_id")) - 1).cast("int")
    return top.select(draft.alias("draft_id"), "token_id", "freq").select(
        "draft_id", "token_id", (F.col("token_id") - F.col("draft_id")).alias("offset"), "freq"
    )


def coverage(freq: DataFrame, size: int) -> DataFrame:
    """One row: kept and total counts, and their ratio (0 without tokens)."""
    rank = F.row_number().over(Window.orderBy(F.desc("freq"), F.asc("token_id")))
    sums = freq.withColumn("_r", rank).agg(
        F.coalesce(F.sum(F.when(F.col("_r") <= size, F.col("freq"))), F.lit(0)).cast("bigint").alias("kept"),
        F.coalesce(F.sum("freq"), F.lit(0)).cast("bigint").alias("total"),
    )
    return sums.withColumn("ratio", F.coalesce(F.try_divide("kept", "total"), F.lit(0.0)))


def target_flags(draft: DataFrame, target_size: int) -> DataFrame:
    """``token_id, in_draft`` for every id of the target vocabulary."""
    spark = draft.sparkSession
    ids = spark.range(target_size).select(F.col("id").cast("int").alias("token_id"))
    kept = draft.select("token_id", F.lit(True).alias("_kept"))
    return ids.join(_bounded(kept, target_size), "token_id", "left").select(
        "token_id", F.coalesce("_kept", F.lit(False)).alias("in_draft")
    )


def to_target(df: DataFrame, draft: DataFrame, size: int, draft_id: str = "draft_id") -> DataFrame:
    """Add ``token_id``: the target id of each draft id, through its offset."""
    maps = _bounded(draft.select(F.col("draft_id").alias(draft_id), "offset"), size)
    return df.join(maps, draft_id).withColumn("token_id", F.col(draft_id) + F.col("offset")).drop("offset")


def position_masks(df: DataFrame, flags: Column, ids: str = "input_ids", mask: str = "loss_mask") -> DataFrame:
    """Add ``position_masks``: the same for whole rows, looked up where they lie.

    ``flags`` is the array of the target vocabulary's flags, as long as that vocabulary.
    """
    staged = df.withColumn("_flags", flags)
    kept = F.zip_with(ids, mask, lambda i, m: F.coalesce(F.get("_flags", i), F.lit(False)).cast("int") * m)
    return staged.withColumn("position_masks", kept).drop("_flags")


def position_mask(df: DataFrame, flags: DataFrame, size: int, best: str = "best", mask: str = "loss_mask") -> DataFrame:
    """Add ``position_mask``: 1 where the best target id is kept and the mask is 1."""
    known = _bounded(flags.select(F.col("token_id").alias(best), "in_draft"), size)
    return df.join(known, best).withColumn(
        "position_mask", F.col("in_draft").cast("int") * F.col(mask)
    ).drop("in_draft")
