"""Losses, accuracies and logs of draft-model training, from stored values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Guards against empty denominators, and the step discount.
TINY = 1e-6
STEP_DISCOUNT = 0.8


def argmax(values: Column) -> Column:
    """0-based place of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def flag_list(flags: DataFrame) -> Column:
    """``token_id, in_draft`` rows as one array of booleans, for use in any row.

    As long as the target vocabulary, whatever the data.
    """
    ordered = F.array_sort(F.collect_list(F.struct("token_id", "in_draft")))
    return flags.agg(F.transform(ordered, lambda x: x["in_draft"]).alias("f")).scalar()


def target_distribution(df: DataFrame, flags: Column, logits: str = "target", mask: str = "loss_mask") -> DataFrame:
    """Add ``target_p`` over the kept ids, and ``position_mask``.

    The mask is the loss mask where the best of all ids is a kept one.
    """
    staged = df.withColumn("_flags", flags)
    kept = F.filter(
        F.arrays_zip(F.col(logits).alias("x"), F.col("_flags").alias("k")), lambda e: e["k"]
    )
    picked = staged.withColumn("_l", F.transform(kept, lambda e: e["x"].cast("double")))
    best_kept = F.get("_flags", argmax(F.col(logits)))
    return (
        picked.withColumn("target_p", softmax(F.col("_l")))
        .withColumn("position_mask", best_kept.cast("int") * F.col(mask))
        .drop("_flags", "_l")
    )


def _largest_and_sum(values: Column) -> Column:
    """``struct<top, sum>`` with ``sum = Σ exp(x - top)``, in one walk."""
    start = F.struct(F.lit(-math.inf).alias("top"), F.lit(0.0).alias("sum"))

    def add(acc, x):
        top = F.greatest(acc["top"], x)
        return F.struct(
            top.alias("top"), (acc["sum"] * F.exp(acc["top"] - top) + F.exp(x - top)).alias("sum")
        )

    return F.aggregate(values, start, add)


def softmax(values: Column) -> Column:
    """``exp(x - max) / Σ``; the norm is added to every element and read from there."""
    norm = _largest_and_sum(values)
    return F.transform(
        F.arrays_zip(values.alias("x"), F.array_repeat(norm, F.size(values)).alias("n")),
        lambda e: F.exp(e["x"] - e["n"]["top"]) / e["n"]["sum"],
    )


def log_softmax(values: Column) -> Column:
    """``x - max - log Σ``."""
    norm = _largest_and_sum(values)
    return F.transform(
        F.arrays_zip(values.alias("x"), F.array_repeat(norm, F.size(values)).alias("n")),
        lambda e: e["x"] - e["n"]["top"] - F.log(e["n"]["sum"]),
    )


def masked_accuracy(df: DataFrame, logits: str = "logits", target: str = "target_p", by: tuple[str, ...] = ()) -> DataFrame:
    """``correct, counted, accuracy``: equal best ids under the position mask."""
    hit = (argmax(F.col(logits)) == argmax(F.col(target))).cast("int") * F.col("position_mask")
    sums = df.groupBy(*by).agg(
        F.sum(hit).cast("bigint").alias("correct"), F.sum("loss_mask").cast("bigint").alias("counted")
    )
    return sums.withColumn("accuracy", F.col("correct") / F.greatest(F.col("counted"), F.lit(TINY)))


def soft_cross_entropy(df: DataFrame, logits: str = "logits", target: str = "target_p", by: tuple[str, ...] = ()) -> DataFrame:
    """``loss``: minus the mean over all positions of mask · Σ p · log softmax."""
    logp = log_softmax(F.transform(logits, lambda x: x.cast("double")))
    dot = F.aggregate(F.zip_with(target, logp, lambda p, l: p * l), F.lit(0.0), lambda a, x: a + x)
    return df.groupBy(*by).agg((-F.avg(F.col("position_mask") * dot)).alias("loss"))


def step_loss(df: DataFrame, by: tuple[str, ...], step: str = "position", loss: str = "loss", accumulation: int = 1) -> DataFrame:
    """``loss``: look-ahead losses, each step discounted, over the accumulation."""
    weight = F.pow(F.lit(STEP_DISCOUNT), F.col(step))
    return df.groupBy(*by).agg((F.sum(weight * F.col(loss)) / accumulation).alias("loss"))


def block_loss(df: DataFrame, by: tuple[str, ...] = (), loss: str = "loss", weight: str = "weight", decayed: str = "decayed", pred: str = "pred", label: str = "label") -> DataFrame:
    """``loss, accuracy`` of block predictions: decayed weights, undecayed hits."""
    counted = F.col(weight) > 0.5
    sums = df.groupBy(*by).agg(
        F.sum(F.col(loss) * F.col(decayed)).alias("_l"),
        F.sum(decayed).alias("_w"),
        F.count_if(counted & (F.col(pred) == F.col(label))).alias("_hits"),
        F.sum(weight).alias("_n"),
    )
    return sums.withColumn("loss", F.col("_l") / (F.col("_w") + TINY)).withColumn(
        "accuracy", F.col("_hits") / (F.col("_n") + TINY)
    ).drop("_l", "_w", "_hits", "_n")


def average_metrics(log: DataFrame, by: tuple[str, ...] = ("mode", "step", "name")) -> DataFrame:
    """Mean value of each metric over minibatches and workers."""
    return log.groupBy(*by).agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def thin_log(log: DataFrame, interval: int, accumulation: int = 1, step: str = "step") -> DataFrame:
    """Rows at multiples of the logging interval, steps counted per update."""
    kept = log.filter(F.col(step) % (interval * accumulation) == 0)
    return kept.withColumn(step, F.floor(F.col(step) / accumulation))


def metric_windows(log: DataFrame, width: str = "1 hour", time: str = "ts", by: tuple[str, ...] = ("name",)) -> DataFrame:
    """Count, least and greatest value per tumbling window; batch or stream."""
    return (
        log.groupBy(F.window(time, width).alias("_w"), *by)
        .agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        .select(F.col("_w.start").alias("window_start"), *by, "n", "low", "high")
    )


def accepted_prefix(draft: Column, target: Column) -> Column:
    """How many leading draft tokens the target confirms."""
    wrong = F.zip_with(draft, target, lambda d, t: ~d.eqNullSafe(t))
    first = F.array_position(wrong, F.lit(True)).cast("int")
    return F.when(first > 0, first - 1).otherwise(F.least(F.size(draft), F.size(target)))


def total_steps(batches: int, epochs: int, accumulation: int) -> int:
    """Optimizer steps of a run."""
    return epochs * math.ceil(batches / accumulation)
