"""Analysis of nested benchmark result files: speed-ups, pivots, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdraft.functions.text import quote
from sparkdraft.schemas import BENCHMARK_RESULT

# Benchmark order of the dashboard, its domains, and class limits.
BENCHES = ("gsm8k", "math500", "mtbench", "humaneval", "livecodebench", "financeqa", "gpqa")
DOMAINS = {
    "mtbench": "Conversation",
    "gpqa": "General Knowledge",
    "financeqa": "General Knowledge",
    "gsm8k": "Math",
    "math500": "Math",
    "humaneval": "Coding",
    "livecodebench": "Coding",
}
SPEEDUP_CLASSES = ((2.0, "excellent"), (1.5, "good"), (1.1, "moderate"))
SERIES = ("target", "draft", "config")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """``target, key, benchmark_name, results`` from dashboard JSON files.

    A file is one object ``{target: {key: {benchmark_name, results}}}``, at most
    a few megabytes; one that does not parse gives no rows.
    """
    schema = f"map<string, map<string, {BENCHMARK_RESULT.simpleString()}>>"
    files = spark.read.text(path, wholetext=True)
    targets = files.select(F.explode(F.from_json("value", schema)).alias("target", "_b"))
    return targets.select("target", F.explode("_b").alias("key", "b")).select(
        "target", "key", "b.benchmark_name", "b.results"
    )


def flatten_results(df: DataFrame, baseline_label: str) -> DataFrame:
    """One row per target, draft, config and benchmark, with its baseline.

    The baseline of a result is its first metric under ``baseline_label``.  Where
    a draft and config meet a benchmark twice, the later one wins.
    """
    baseline = F.get(
        F.filter("metrics", lambda m: m["Name"] == baseline_label), F.lit(0)
    )
    result = df.select(
        "target", "key", "benchmark_name", F.posexplode("results").alias("_r", "r")
    ).select("target", "key", "benchmark_name", "_r", "r.*")
    metric = result.select(
        "*", baseline.alias("_b"), F.posexplode("metrics").alias("_m", "m")
    )
    is_base = F.col("m.Name") == baseline_label
    setting = F.concat_ws("-", *[F.col(c).cast("string") for c in ("batch_size", "steps", "topk", "num_draft_tokens")])
    rows = metric.select(
        "target",
        F.when(is_base, "None").otherwise(F.col("m.Name")).alias("draft"),
        F.when(is_base, "baseline").otherwise(setting).alias("config"),
        F.col("benchmark_name").alias("bench"),
        F.struct("key", "_r", "_m").alias("_at"),
        F.col("m.output_throughput").alias("throughput"),
        F.col("m.accept_length").alias("acc_len"),
        F.col("_b"),
    )
    last_base = F.max_by(
        F.struct(F.col("_b.output_throughput").alias("t"), F.col("_b.accept_length").alias("a")),
        F.when(F.col("_b").isNotNull(), F.col("_at")),
    )
    return (
        rows.groupBy(*SERIES, "bench")
        .agg(
            F.max_by(F.struct("throughput", "acc_len"), "_at").alias("_v"),
            last_base.alias("_last"),
        )
        .select(
            *SERIES,
            "bench",
            "_v.throughput",
            "_v.acc_len",
            F.col("_last.t").alias("base_throughput"),
            F.col("_last.a").alias("base_acc_len"),
        )
    )


def ratio(spec: Column, base: Column) -> Column:
    """Speed-up, or null where either side is missing or zero."""
    return F.when((spec != 0) & (base != 0), spec / base)


def speedup(flat: DataFrame) -> DataFrame:
    """Add ``speedup`` and ``speedup_text`` (two decimals, a dash for none)."""
    value = ratio(F.col("throughput"), F.col("base_throughput"))
    text = F.coalesce(F.round(value, 2).cast("decimal(38,2)").cast("string"), F.lit("-"))
    return flat.withColumn("speedup", value).withColumn("speedup_text", text)


def speedup_class(spec: Column, base: Column) -> Column:
    """The name of the highest class the speed-up reaches, empty for none."""
    value = ratio(spec, base)
    out = F.when(value.isNull(), "")
    for limit, name in SPEEDUP_CLASSES:
        out = out.when(value >= limit, name)
    return out.otherwise("neutral")


def average_speedup(flat: DataFrame, benches: tuple[str, ...] = BENCHES) -> DataFrame:
    """Mean speed-up of each series over the benchmarks that have both sides."""
    value = F.when(F.col("base_throughput") > 0, ratio(F.col("throughput"), F.col("base_throughput")))
    return (
        flat.filter(F.col("bench").isin(*benches))
        .groupBy(*SERIES)
        .agg(F.avg(value).alias("speedup"), F.count(value).alias("benches"))
    )


def distinct_models(flat: DataFrame, column: str = "target") -> DataFrame:
    """Non-empty model names, once each."""
    return flat.filter((F.col(column).isNotNull()) & (F.col(column) != "")).select(column).distinct()


def select_rows(
    flat: DataFrame, target: str | None = None, draft: str = "all", bench: str = "all"
) -> DataFrame:
    """Rows of a target, draft and benchmark; ``all`` passes everything."""
    out = flat if target is None else flat.filter(F.col("target") == target)
    out = out if draft == "all" else out.filter(F.col("draft") == draft)
    return out if bench == "all" else out.filter(F.col("bench") == bench)


def clean_model_name(name: Column, prefix: str) -> Column:
    """A model name without a vendor prefix and doubled slashes."""
    p = quote(prefix)
    out = F.regexp_replace(name, rf"(?i)(^|/){p}-", "$1")
    out = F.regexp_replace(out, rf"(?i)(^|/){p}/", "$1")
    out = F.regexp_replace(out, rf"(?i)^{p}(?![-/])", "")
    out = F.regexp_replace(out, "/+", "/")
    out = F.when(F.length(out) > 1, F.regexp_replace(out, "^/", "")).otherwise(out)
    return F.when(out == "", name).otherwise(out)


def model_label(name: Column, prefix: str) -> Column:
    """The last path part of a cleaned name; a dash for none, ``Baseline`` for no draft."""
    cleaned = clean_model_name(name, prefix)
    leaf = F.element_at(F.split(cleaned, "/"), -1)
    return (
        F.when(F.coalesce(name, F.lit("")) == "", "-")
        .when(name.isin("-", "None"), "Baseline")
        .otherwise(F.when(leaf == "", cleaned).otherwise(leaf))
    )


def config_label(batch: Column, steps: Column, topk: Column, tokens: Column, config: Column) -> Column:
    """A setting in words, from the parts that are known."""
    named = {"batch_size": batch, "steps": steps, "topk": topk, "num_draft_tokens": tokens}
    parts = [F.concat(F.lit(f"{n}: "), c.cast("string")) for n, c in named.items()]
    text = F.concat_ws(", ", *parts)
    return F.when(F.coalesce(config, F.lit("")).isin("baseline", ""), "Baseline Configuration").otherwise(
        F.when(text == "", config).otherwise(text)
    )


def pivot_results(flat: DataFrame, metric: str = "throughput", benches: tuple[str, ...] = BENCHES) -> DataFrame:
    """One row per series, one column per benchmark; missing values are 0.

    ``metric`` is ``throughput``, ``acc_len`` or ``speedup``.  The pivot values
    are given, so no extra pass looks them up.
    """
    known = flat.filter(F.col("bench").isin(*benches))
    if metric == "speedup":
        value = F.round(ratio(F.col("throughput"), F.col("base_throughput")), 2)
        known = known.filter("throughput is not null")
    else:
        value = F.round(F.col(metric), 2)
        known = known.filter(F.col(metric).isNotNull())
    return known.groupBy(*SERIES).pivot("bench", list(benches)).agg(F.first(value)).na.fill(0.0)


def domain_rollup(flat: DataFrame) -> DataFrame:
    """Rows and summed throughput by domain and benchmark, with subtotals."""
    pairs = [F.lit(x) for kv in DOMAINS.items() for x in kv]
    domain = F.try_element_at(F.create_map(*pairs), F.col("bench"))
    return (
        flat.withColumn("domain", domain)
        .rollup("domain", "bench")
        .agg(
            F.count("*").alias("n"),
            F.round(F.avg("throughput"), 6).alias("throughput"),
            F.grouping_id().cast("int").alias("level"),
        )
    )
