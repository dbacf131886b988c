"""Named corpora: where their rows come from and how they are normalised."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdraft.operators.rowindex import with_row_index
from sparkdraft.schemas import require_columns
from sparkdraft.sources import normalise as N
from sparkdraft.sources.files import check_subsets, merge_sources, read_any

Adapter = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class CorpusSpec:
    """One corpus: required columns, row adapter, known subsets.

    ``index_id`` numbers the rows where the corpus has no id of its own.
    """

    adapter: Adapter
    columns: tuple[str, ...]
    subsets: tuple[str, ...] = ()
    index_id: bool = False


def _qa(user: str, assistant: str) -> Adapter:
    return lambda df: N.qa_to_conversation(df, F.col(user), F.col(assistant))


def _with_optional_id(df: DataFrame) -> DataFrame:
    own = F.col("id") if "id" in df.columns else F.lit(None).cast("string")
    return N.qa_to_conversation(df, F.col("input"), F.col("output"), own)


def _math_qa(df: DataFrame) -> DataFrame:
    return N.qa_to_conversation(df, F.concat("Problem", F.lit("\n"), "options"), F.col("Rationale"))


def _sciq(df: DataFrame) -> DataFrame:
    wrong = [F.col("distractor3"), F.col("distractor1"), F.col("distractor2")]
    return N.mcq_to_conversation(
        df, F.col("question"), wrong, F.col("correct_answer"), F.col("support"), F.col("question")
    )


def _messages(df: DataFrame) -> DataFrame:
    return N.judged_messages(df)


def _speakers(df: DataFrame) -> DataFrame:
    return N.rolemap_conversation(df)


def _uuid_speakers(df: DataFrame) -> DataFrame:
    return _speakers(df.withColumnRenamed("uuid", "id"))


def _as_is(df: DataFrame) -> DataFrame:
    return df.withColumn("id", F.col("id").cast("string")).select("id", "conversations")


def _images(df: DataFrame) -> DataFrame:
    return N.judged_images(df, "images")


# Corpus names, their columns and their subsets.
CATALOG: dict[str, CorpusSpec] = {
    "ultrachat": CorpusSpec(_messages, ("prompt_id", "messages")),
    "sharegpt": CorpusSpec(_speakers, ("id", "conversations")),
    "eaglechat": CorpusSpec(_as_is, ("id", "conversations")),
    "perfectblend": CorpusSpec(_speakers, ("conversations",), index_id=True),
    "perfectblend-llama3.1-8b-instruct": CorpusSpec(_as_is, ("conversations",), index_id=True),
    "perfectblend-llama3.3-70b-instruct": CorpusSpec(_as_is, ("conversations",), index_id=True),
    "perfectblend-llama4-scout-instruct": CorpusSpec(_as_is, ("conversations",), index_id=True),
    "perfectblend-llama4-maverick-instruct": CorpusSpec(_as_is, ("conversations",), index_id=True),
    "magpie-qwen2.5-pro-1m-v0.1": CorpusSpec(_uuid_speakers, ("uuid", "conversations")),
    "sharegpt4v": CorpusSpec(_images, ("id", "image", "conversations")),
    "allava4v": CorpusSpec(_images, ("id", "image", "conversations")),
    "opc": CorpusSpec(
        _qa("instruction", "output"),
        ("instruction", "output"),
        ("largescale_diverse_instruct", "filtered_infinity_instruct", "realuser_instruct"),
    ),
    "gsm8k": CorpusSpec(_qa("question", "answer"), ("question", "answer")),
    "hendrycks_math": CorpusSpec(
        _qa("problem", "solution"),
        ("problem", "solution"),
        (
            "algebra",
            "counting_and_probability",
            "geometry",
            "intermediate_algebra",
            "number_theory",
            "prealgebra",
            "precalculus",
        ),
    ),
    "math_qa": CorpusSpec(_math_qa, ("Problem", "options", "Rationale")),
    "codealpaca-20k": CorpusSpec(_qa("instruction", "output"), ("instruction", "output")),
    "opencodeinstruct": CorpusSpec(_with_optional_id, ("input", "output")),
    "magicoder-evol-instruct": CorpusSpec(_qa("instruction", "response"), ("instruction", "response")),
    "sciq": CorpusSpec(
        _sciq, ("question", "correct_answer", "distractor1", "distractor2", "distractor3", "support")
    ),
    "camel": CorpusSpec(
        _qa("message_1", "message_2"), ("message_1", "message_2"), ("biology", "chemistry", "physics")
    ),
}


def register_corpus(name: str, spec: CorpusSpec, override: bool = False) -> None:
    if name in CATALOG and not override:
        raise ValueError(f"corpus {name!r} is already registered")
    CATALOG[name] = spec


def judge_corpus(
    name: str,
    raw: DataFrame,
    position: str | None = None,
    image_root: str = "images",
    present: DataFrame | None = None,
) -> DataFrame:
    """All raw rows of a named corpus: ``corpus, id, [image,] conversations, skipped, reason``.

    ``reason`` says why a row is rejected and is null for good rows; ``skipped``
    counts messages left out.  ``position`` names a unique numeric column that
    fixes the row order for corpora whose id is the row number.  ``present`` (one
    column ``path``) lists the images that exist.
    """
    if name not in CATALOG:
        raise ValueError(f"unknown corpus {name!r}; known: {sorted(CATALOG)}")
    spec = CATALOG[name]
    require_columns(raw, *spec.columns)
    if spec.index_id:
        if position is None:
            raise ValueError(f"corpus {name!r} numbers its rows and needs a position column")
        raw = with_row_index(raw, position, name="id")
    rows = N.judged_images(raw, image_root, present) if spec.adapter is _images else spec.adapter(raw)
    skipped = F.col("skipped") if "skipped" in rows.columns else F.lit(0)
    reason = F.col("reason") if "reason" in rows.columns else F.lit(None)
    image = ["image"] if "image" in rows.columns else []
    return rows.select(
        F.lit(name).alias("corpus"),
        "id",
        *image,
        "conversations",
        skipped.cast("bigint").alias("skipped"),
        reason.cast("string").alias("reason"),
    )


def normalise_corpus(name: str, raw: DataFrame, position: str | None = None, **images) -> DataFrame:
    """The good rows of :func:`judge_corpus` as conversations."""
    return judge_corpus(name, raw, position, **images).filter("reason is null").drop("corpus", "skipped", "reason")


def load_corpus(
    spark: SparkSession,
    name: str,
    path: str | dict[str, str],
    subset: str = "all",
    position: str | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Read and normalise a corpus; a mapping ``subset -> path`` is concatenated.

    With a ``schema`` text formats are read once, without a scan to infer it.
    """
    if isinstance(path, str):
        raw = read_any(spark, path, schema)
    else:
        wanted = list(path) if subset == "all" else check_subsets([subset], list(path))
        raw = merge_sources({s: read_any(spark, path[s], schema) for s in wanted})
    return normalise_corpus(name, raw, position)
