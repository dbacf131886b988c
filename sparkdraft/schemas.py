"""Record layouts shared by sources and operators."""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGE = T.StructType(
    [
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)

#: A message whose optional fields survived the JSON reader.
OPEN_MESSAGE = T.StructType(
    [
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("thinking", T.StringType()),
        T.StructField("tool_calls", T.StringType()),
    ]
)

CONVERSATION = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("conversations", T.ArrayType(MESSAGE)),
    ]
)

PREFORMATTED = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("text", T.StringType())]
)

SAMPLE = T.StructType(
    [
        T.StructField("sample_idx", T.LongType()),
        T.StructField("input_ids", T.ArrayType(T.IntegerType())),
        T.StructField("loss_mask", T.ArrayType(T.IntegerType())),
        T.StructField("hidden_state", T.ArrayType(T.ArrayType(T.FloatType()))),
        T.StructField("aux_hidden_state", T.ArrayType(T.ArrayType(T.FloatType()))),
    ]
)

METRIC = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField("step", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

#: The nested benchmark result file read by the dashboard operators.
RESULT_METRIC = T.StructType(
    [
        T.StructField("Name", T.StringType()),
        T.StructField("output_throughput", T.DoubleType()),
        T.StructField("accept_length", T.DoubleType()),
    ]
)
RESULT_ROW = T.StructType(
    [
        T.StructField("batch_size", T.IntegerType()),
        T.StructField("steps", T.IntegerType()),
        T.StructField("topk", T.IntegerType()),
        T.StructField("num_draft_tokens", T.IntegerType()),
        T.StructField("metrics", T.ArrayType(RESULT_METRIC)),
    ]
)
BENCHMARK_RESULT = T.StructType(
    [
        T.StructField("benchmark_name", T.StringType()),
        T.StructField("results", T.ArrayType(RESULT_ROW)),
    ]
)


def require_columns(df, *names: str):
    """``df`` itself, or an error that names the missing columns."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"expected columns {missing}, found {df.columns}")
    return df
