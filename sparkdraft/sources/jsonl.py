"""Conversation JSON Lines: tolerant reader and its rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdraft.functions.rows import evaluate_once
from sparkdraft.functions.text import strip

_ELEMENTS = T.ArrayType(T.StringType())
_FIELDS = T.MapType(T.StringType(), T.StringType())


def _messages(raw: Column) -> Column:
    """Objects of a JSON array as maps; nested values become JSON text."""
    items = F.from_json(raw, _ELEMENTS)
    objects = F.filter(items, lambda e: F.coalesce(strip(e).startswith("{"), F.lit(False)))
    return F.transform(objects, lambda e: F.from_json(e, _FIELDS))


def clean_lines(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """``(good, rejects)`` from one JSON text per row.

    Blank lines vanish.  Invalid JSON and a ``conversations`` value that is not
    a list go to the rejects with a reason.  A null or absent ``conversations``
    is an empty list, and elements that are not objects are dropped.  ``good``
    keeps all other columns of ``lines`` and adds ``conversations`` as an array
    of string maps: every field of a message survives under its own name.
    """
    text = strip(F.col(value))
    parsed = F.try_parse_json(text)
    raw = F.get_json_object(text, "$.conversations")
    shape = F.schema_of_variant(F.try_variant_get(parsed, "$.conversations", "variant"))
    keep = [c for c in lines.columns if c != value]
    # Reason and messages in one projection, so that a line is parsed once.
    judged = evaluate_once(lines.filter(text != "").select(
        *keep,
        F.col(value),
        F.when(parsed.isNull(), "invalid json")
        .when(~F.schema_of_variant(parsed).startswith("OBJECT"), "not an object")
        .when(raw.isNotNull() & ~shape.startswith("ARRAY"), "conversations is not a list")
        .alias("reason"),
        raw.alias("_raw"),
    ))
    good = judged.filter("reason is null").select(
        *keep,
        F.coalesce(_messages(F.col("_raw")), F.array().cast("array<map<string,string>>")).alias(
            "conversations"
        ),
    )
    rejects = judged.filter("reason is not null").select(*keep, value, "reason")
    return good, rejects


def as_messages(good: DataFrame) -> DataFrame:
    """String maps to ``struct<role, content, thinking, tool_calls>``."""
    return good.withColumn(
        "conversations",
        F.transform(
            "conversations",
            lambda m: F.struct(
                *[
                    F.try_element_at(m, F.lit(f)).alias(f)
                    for f in ("role", "content", "thinking", "tool_calls")
                ]
            ),
        ),
    )


def read_conversations(
    spark: SparkSession, path: str | list[str], streaming: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``(good, rejects)`` from one or many JSON Lines files."""
    if streaming:
        lines = spark.readStream.text(path)
    else:
        lines = spark.read.text(path)
    return clean_lines(lines)
