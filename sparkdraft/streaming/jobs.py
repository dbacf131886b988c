"""The incremental forms: files in, tables out, exactly once per input.

Every job takes a streaming DataFrame and returns a started query; ``once``
makes it stop when the input present at the start has been processed.
Checkpoints and outputs belong in storage all executors share.  A retried
micro-batch overwrites its own output folder, so nothing is written twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from sparkdraft.operators.regen import Responder, regenerate, route
from sparkdraft.operators.training_metrics import metric_windows
from sparkdraft.operators.vocab import token_frequency
from sparkdraft.plans.dataset import build_dataset
from sparkdraft.sources.files import exists, folders, publish, remove
from sparkdraft.sources.jsonl import clean_lines


def _start(writer: DataStreamWriter, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def ingest(lines: DataFrame, good_path: str, rejects_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """JSON lines to a table of clean conversations and a table of rejects."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # Both outputs parse the batch; reading it twice is cheaper than keeping it.
        good, rejects = clean_lines(batch)
        _write_batch(good, good_path, batch_id)
        _write_batch(rejects, rejects_path, batch_id)

    return _start(lines.writeStream.foreachBatch(write), checkpoint, once)


def training_rows(
    conversations: DataFrame, template: str, path: str, checkpoint: str, once: bool = True, **options
) -> StreamingQuery:
    """Conversations to training rows, by the very plan of the batch form."""
    rows = build_dataset(conversations, template, **options)
    return _start(
        rows.writeStream.format("parquet").option("path", path).outputMode("append"), checkpoint, once
    )


def token_counts(rows: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Running loss-token counts; :func:`read_published` of ``path`` gives the latest ones.

    State and table have one row per id of the target vocabulary.  Each micro-batch
    publishes a version of its own, so that a reader never meets half a table.  The
    counts are shuffled into one file: merely coalesced, the task that writes would
    merge all partitions of the state itself, and hold the memory of each.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        publish(batch.repartition(1), path, batch_id)

    counts = token_frequency(rows)
    return _start(counts.writeStream.outputMode("complete").foreachBatch(write), checkpoint, once)


def first_of_each(rows: DataFrame, id: str, time: str | None = None, lateness: str = "1 day") -> DataFrame:
    """One row per id over the life of a stream, by keyed state.

    The state holds the ids seen, spread over the shuffle partitions; it is part of
    the checkpoint, so a replayed micro-batch finds it as it was.  With a ``time``
    column an id is kept until the watermark has passed the row by ``lateness``, which
    bounds the state; without one it is kept for good.  Null ids count as one id.
    """
    named = rows.withColumn(id, F.col(id).cast("string"))
    if time is None:
        return named.dropDuplicates([id])
    return named.withWatermark(time, lateness).dropDuplicatesWithinWatermark([id])


def regeneration(
    conversations: DataFrame,
    responder: Responder,
    params: Column,
    success_path: str,
    error_path: str,
    checkpoint: str,
    once: bool = True,
    id: str = "id",
    time: str | None = None,
    lateness: str = "1 day",
) -> StreamingQuery:
    """Answer new conversations; those already answered or failed are passed over.

    Ids seen in earlier micro-batches are in the stream's state
    (:func:`first_of_each`), so a micro-batch reads its own input only, whatever was
    stored before.  Its answers are first written to a folder of their own.  When the
    batch is replayed, that folder is used again if it was finished, so the model
    is asked once and the outputs come out the same.  A micro-batch begins after the one
    before it is done with: it removes the folders of earlier ones.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        answers = f"{checkpoint}/answers/batch={batch_id}"
        if exists(spark, f"{answers}/_SUCCESS"):
            batch.write.format("noop").mode("overwrite").save()  # the state takes the ids again
        else:
            regenerate(batch, responder, params).write.mode("overwrite").parquet(answers)
        success, errors = route(spark.read.parquet(answers))
        _write_batch(errors, error_path, batch_id)
        _write_batch(success, success_path, batch_id)
        for folder in folders(spark, f"{checkpoint}/answers"):
            if folder.startswith("batch=") and int(folder.removeprefix("batch=")) < batch_id:
                remove(spark, f"{checkpoint}/answers/{folder}")

    fresh = first_of_each(conversations, id, time, lateness)
    return _start(fresh.writeStream.foreachBatch(write), checkpoint, once)


def live_metrics(
    log: DataFrame,
    path: str,
    checkpoint: str,
    width: str = "1 hour",
    lateness: str = "10 minutes",
    time: str = "ts",
    once: bool = True,
) -> StreamingQuery:
    """Windowed metric values, appended when a window can no longer change.

    Rows later than the watermark are dropped, which is also what bounds the state.
    """
    windows = metric_windows(log.withWatermark(time, lateness), width, time)
    return _start(
        windows.writeStream.format("parquet").option("path", path).outputMode("append"), checkpoint, once
    )
