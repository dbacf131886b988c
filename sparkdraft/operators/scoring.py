"""Accuracy, throughput and acceptance length of benchmark runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdraft.functions.answers import extract_answer
from sparkdraft.functions.text import strip
from sparkdraft.operators.prompts import BENCHMARKS

# Tolerance of numeric comparison, and what Python reads as a number.
TOLERANCE = 1e-6
FLOAT_TEXT = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)(e[+-]?[0-9]+)?$"
INT_TEXT = r"^[+-]?[0-9]+$"


def _number(text: Column) -> Column:
    """The value of a text Python's float() accepts in plain notation, else null."""
    plain = F.regexp_replace(text, r"(?<=[0-9])_(?=[0-9])", "")
    return F.when(plain.rlike(FLOAT_TEXT), plain.try_cast("double"))


def _integer(text: Column) -> Column:
    """The canonical digits of an integer text of any length, else null."""
    plain = F.regexp_replace(text, r"(?<=[0-9])_(?=[0-9])", "")
    digits = F.regexp_replace(plain, r"^[+-]?0*(?=[0-9])", "")
    sign = F.when(plain.startswith("-") & (digits != "0"), "-").otherwise("")
    return F.when(plain.rlike(INT_TEXT), F.concat(sign, digits))


def is_match(pred: Column, label: Column, kind: str) -> Column:
    """Whether a prediction meets its label under one of the rules."""
    if kind in ("exact", "valid_only"):
        return pred.eqNullSafe(label)
    if kind == "letter":
        hit = F.upper(strip(pred)) == F.upper(strip(label))
    elif kind == "numeric":
        p, l = F.lower(strip(pred)), F.lower(strip(label))
        hit = (p == l) | F.coalesce(F.abs(_number(p) - _number(l)) < TOLERANCE, F.lit(False))
    elif kind == "int":
        p, l = strip(pred), strip(label)
        hit = (p == l) | F.coalesce(_integer(p) == _integer(l), F.lit(False))
    else:
        raise ValueError(f"unknown accuracy rule {kind!r}")
    return F.coalesce(hit, F.lit(False))


def accuracy(
    df: DataFrame, kind: str, pred: str = "pred", label: str = "label", by: tuple[str, ...] = ()
) -> DataFrame:
    """``correct, judged, valid, accuracy`` per group.

    ``exact`` judges every row; ``valid_only`` rows with a prediction (0 if
    there are none); ``numeric``, ``int`` and ``letter`` rows with a label (null
    if there are none).  ``valid`` counts the predictions that were found.
    """
    p, l = F.col(pred), F.col(label)
    judged = {"exact": F.lit(True), "valid_only": p.isNotNull()}.get(kind, l.isNotNull())
    sums = df.groupBy(*by).agg(
        F.count_if(judged & is_match(p, l, kind)).alias("correct"),
        F.count_if(judged).alias("judged"),
        F.count(p).alias("valid"),
    )
    ratio = F.try_divide(F.col("correct"), F.col("judged"))
    return sums.withColumn("accuracy", F.coalesce(ratio, F.lit(0.0)) if kind == "valid_only" else ratio)


def run_metrics(
    df: DataFrame,
    by: tuple[str, ...],
    tokens: str = "completion_tokens",
    verify: str = "verify_ct",
    latency: str = "latency",
) -> DataFrame:
    """``latency, tokens, output_throughput, accept_length`` per run.

    Tokens are summed over all answer keys of a run.  Without any verify count,
    or with none verified, the acceptance length is 1.
    """
    sums = df.groupBy(*by).agg(
        F.max(latency).alias("latency"),
        F.sum(tokens).cast("bigint").alias("tokens"),
        F.sum(verify).cast("bigint").alias("_v"),
    )
    throughput = F.when(F.col("latency") > 0, F.col("tokens") / F.col("latency")).otherwise(0.0)
    accepted = F.when(F.coalesce("_v", F.lit(0)) == 0, F.lit(1.0)).otherwise(F.col("tokens") / F.col("_v"))
    return sums.withColumn("output_throughput", throughput).withColumn("accept_length", accepted).drop("_v")


def score_benchmark(questions: DataFrame, outputs: DataFrame, bench: str, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """One row per run: questions joined to outputs, answers extracted, judged and summed.

    ``questions`` come from ``build_prompts``; ``outputs`` have ``by``, ``q_idx``,
    ``answer_key``, ``output``, ``completion_tokens``, ``verify_ct`` and
    ``latency``, one row per question and answer key.  Extractor, rule and keys are
    those of the benchmark; ``accuracy`` is null where it has no rule.  Tokens are
    summed over all keys, answers judged under the first one.
    """
    if bench not in BENCHMARKS:
        raise ValueError(f"unknown benchmark {bench!r}; known: {sorted(BENCHMARKS)}")
    spec = BENCHMARKS[bench]
    keys = [c for c in ("subset", "q_idx") if c in questions.columns and c in outputs.columns]
    known = outputs.filter(F.col("answer_key").isin(*spec.answer_keys)).join(questions.select(*keys, "label"), keys)
    speed = run_metrics(known, by)
    pred = extract_answer(F.col("output"), spec.extractor)
    judged = known.filter(F.col("answer_key") == spec.answer_keys[0]).withColumn("pred", pred)
    counts = accuracy(judged, spec.accuracy or "exact", by=by)
    total = judged.groupBy(*by).agg(F.count("*").alias("num_questions"))
    ratio = F.col("accuracy").cast("double") if spec.accuracy else F.lit(None).cast("double")
    return (
        speed.join(counts.select(*by, "valid", ratio.alias("accuracy")), list(by))
        .join(total, list(by))
        .select(
            F.lit(bench).alias("bench"),
            *by,
            "latency",
            "output_throughput",
            "accept_length",
            "accuracy",
            "num_questions",
            F.col("valid").alias("num_valid_predictions"),
        )
    )


def average_runs(runs: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Mean of each metric over the runs; accuracy over those that have one."""
    names = ("latency", "output_throughput", "accept_length", "accuracy")
    return runs.groupBy(*by).agg(*[F.avg(n).alias(n) for n in names if n in runs.columns])


def parse_specs(df: DataFrame, spec: str = "spec") -> DataFrame:
    """``name[:samples[:subset,subset]]`` as ``bench, num_samples, subsets, error``."""
    parts = F.split(F.col(spec), ":")
    samples = F.get(parts, F.lit(1))
    number = strip(samples).try_cast("int")
    error = F.when(F.size(parts) > 3, "invalid benchmark format").when(
        samples.isNotNull() & number.isNull(), "invalid sample count"
    )
    return df.select(
        "*",
        F.get(parts, F.lit(0)).alias("bench"),
        number.alias("num_samples"),
        F.split(F.get(parts, F.lit(2)), ",").alias("subsets"),
        error.alias("error"),
    )


def config_grid(specs: DataFrame, configs: list[str]) -> DataFrame:
    """Every ``batch,steps,topk,tokens`` setting for every benchmark row.

    The settings are constants of the plan, so the grid is an explode.
    """
    rows = []
    for text in configs:
        batch, steps, topk, tokens = (int(x) for x in text.split(","))
        rows.append(
            F.struct(
                F.lit(batch).alias("batch_size"),
                F.lit(steps).alias("steps"),
                F.lit(topk).alias("topk"),
                F.lit(tokens).alias("num_draft_tokens"),
            )
        )
    return specs.select("*", F.inline(F.array(*rows)))


def nest_results(runs: DataFrame, by: tuple[str, ...] = ("bench",)) -> DataFrame:
    """Per benchmark, its settings with their metric lists, as JSON text.

    Holds one entry per setting and run, never one per question.
    """
    setting = ("batch_size", "steps", "topk", "num_draft_tokens")
    metrics = [c for c in runs.columns if c not in (*by, *setting)]
    inner = runs.groupBy(*by, *setting).agg(
        F.array_sort(F.collect_list(F.struct(*metrics))).alias("metrics")
    )
    return inner.groupBy(*by).agg(
        F.to_json(F.array_sort(F.collect_list(F.struct(*setting, "metrics")))).alias("results")
    )
