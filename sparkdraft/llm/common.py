"""What the corpus operators share: registry, stored tables, word rules."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdraft.session import importable, shared_folder


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, table: str = "documents", sql: str | None = None):
    """Register ``fn(df) -> DataFrame`` over one whole table."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = Query(lambda spark, folder: fn(read_table(spark, folder, table)), sql)
        return fn

    return register


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that all executors share."""
    return f"{shared_folder(spark)}/llm/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    This cuts the lineage: a lost executor costs its tasks, never the steps
    before.  The planner also knows the size of what was written, so that only
    tables under its broadcast threshold are broadcast.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows and bytes of texts that go to a Python worker at a time, where the session does not say.
TEXT_BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def text_workers(spark: SparkSession) -> None:
    """Prepare a session for Python workers that read whole texts.

    A batch lies in the executor's memory, in the worker's Arrow buffers and again as
    Python strings, once per core; Spark's default of 10,000 rows is meant for numbers.
    What the session sets itself is left alone.  Results do not depend on batches.
    """
    importable(spark)
    told = spark.conf.getAll
    for key, value in TEXT_BATCH.items():
        if key not in told:
            spark.conf.set(key, value)


def numbered(docs: DataFrame, label: str) -> DataFrame:
    """``row, whole``: the rows of ``docs`` as structs beside what names them in every scan.

    How a scan is split, and with it ``monotonically_increasing_id``, follows the
    cores that are there when it is planned.  Who decides about rows in one scan and
    picks them in another needs names that hold in both: for a table read from
    Parquet files the file and the place in it, else numbers stored with the rows.
    """
    if _is_file_scan(docs):
        place = F.struct("_metadata.file_path", "_metadata.row_index")
        return docs.select(place.alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("whole")), label)


def _is_file_scan(docs: DataFrame) -> bool:
    """Whether ``docs`` is a table of Parquet files as read, with no step above the scan."""
    plan = getattr(docs, "_jdf", None) and docs._jdf.queryExecution().analyzed()
    if not plan or plan.getClass().getSimpleName() != "LogicalRelation" or "_metadata" in docs.columns:
        return False
    try:
        return docs.select("_metadata.file_path", "_metadata.row_index").columns == ["file_path", "row_index"]
    except AnalysisException:
        return False  # other formats do not count rows


#: White space between words and inside texts that are compared: six ASCII characters.
SPACE = r"[\x20\x09-\x0D]"


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The runs of characters other than the six of :data:`SPACE`."""
    return F.array_remove(F.split(text, SPACE + "+"), "")
