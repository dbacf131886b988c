"""Session settings the library relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that are safe on a laptop and on a cluster alike.  Sizes of the
#: cluster (cores, memory, shuffle partitions) stay with whoever submits the job.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # State of streams lies on the executors' disks, not in their heaps.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def get_spark(app: str = "sparkdraft", master: str | None = None, **extra: str) -> SparkSession:
    """A session with :data:`SETTINGS`; ``extra`` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    importable(spark)
    return spark


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    For local sessions and shared installations; on a cluster without either, ship
    the package with ``--py-files``.  A further place on the workers' path does no harm.
    """
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    places = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if here not in places:
        environment["PYTHONPATH"] = os.pathsep.join([*places, here])


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A local folder is made only where the setting is absent, which is the case
    in tests and never on a cluster that is set up for this library.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="sparkdraft-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip(os.sep)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a retry finds the same rows in the same places."""
    path = f"{shared_folder(df.sparkSession)}/stored/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
