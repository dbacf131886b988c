"""Readers by suffix, listings, merged inputs, keyed caches and sinks."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# File suffix -> Spark format.
SUFFIX_FORMAT = {
    "json": "json",
    "jsonl": "json",
    "parquet": "parquet",
    "csv": "csv",
    "orc": "orc",
    "txt": "text",
    "text": "text",
}

#: Samples per stored folder.
GROUP_SIZE = 2000


def read_any(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """Read by file suffix; several paths of one suffix are read as one table."""
    paths = [path] if isinstance(path, str) else list(path)
    suffixes = {re.sub(r"\.(gz|bz2|zst)$", "", p).rsplit(".", 1)[-1].lower() for p in paths}
    if len(suffixes) != 1:
        raise ValueError(f"paths mix formats: {sorted(suffixes)}")
    suffix = suffixes.pop()
    if suffix not in SUFFIX_FORMAT:
        raise ValueError(f"no reader for suffix {suffix!r}")
    reader = spark.read.format(SUFFIX_FORMAT[suffix])
    if suffix == "csv":
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(paths)


def merge_sources(sources: dict[str, DataFrame], name: str = "subset") -> DataFrame:
    """Concatenate tables, tagging every row with the source it came from."""
    if not sources:
        raise ValueError("nothing to merge")
    merged = None
    for tag, df in sources.items():
        tagged = df.withColumn(name, F.lit(tag))
        merged = tagged if merged is None else merged.unionByName(tagged, allowMissingColumns=True)
    return merged


def tag_subsets(df: DataFrame, column: str, wanted: list[str] | None = None, name: str = "subset") -> DataFrame:
    """The subsets that a column of one table tells apart, concatenated in one scan.

    ``column`` becomes the tag ``name``; rows without one are a subset of their own.
    ``wanted`` names the subsets to take (a filter that reaches the scan), all by default.
    """
    rows = df if wanted is None else df.filter(F.col(column).isin(wanted))
    return rows.select(F.col(column).alias(name), *[c for c in df.columns if c != column])


def check_subsets(wanted: list[str], known: list[str]) -> list[str]:
    """``wanted`` itself, or an error that names an unknown subset."""
    unknown = [s for s in wanted if s not in known]
    if unknown:
        raise ValueError(f"unknown subsets: {unknown}")
    return wanted


def list_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".ckpt", ".ckpt.gz")) -> DataFrame:
    """Paths below ``path`` with one of the suffixes, sorted.

    Only metadata is read: the content column is pruned from the scan.
    """
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    )
    keep = F.lit(False)
    for s in suffixes:
        keep = keep | F.col("path").endswith(s)
    return listing.filter(keep).orderBy("path")


def latest_epoch(paths: DataFrame, path: str = "path", prefix: str = "epoch", by: tuple[str, ...] = ()) -> DataFrame:
    """The path whose last part is ``<prefix>_<n>`` with the largest n."""
    leaf = F.element_at(F.split(F.col(path), "/"), -1)
    # \z, unlike $, refuses a trailing line break.
    number = F.regexp_extract(leaf, rf"\A{prefix}_([0-9]+)\z", 1)
    found = paths.select(*by, F.col(path), number.alias("_n")).filter("_n <> ''")
    epoch = F.col("_n").cast("bigint")
    return found.groupBy(*by).agg(
        F.max_by(F.col(path), F.struct(epoch, F.col(path))).alias(path), F.max(epoch).alias("epoch")
    )


def sample_bucket(idx: Column, group_size: int = GROUP_SIZE) -> Column:
    """The folder a sample belongs to: ``rows_<from>-<to>``."""
    start = idx - idx % group_size
    return F.concat(F.lit("rows_"), start.cast("string"), F.lit("-"), (start + group_size).cast("string"))


def sample_path(idx: Column, group_size: int = GROUP_SIZE, extension: str = ".ckpt") -> Column:
    """Folder and file name of a sample."""
    return F.concat(sample_bucket(idx, group_size), F.lit("/data_"), idx.cast("string"), F.lit(extension))


def write_samples(df: DataFrame, path: str, idx: str = "sample_idx", group_size: int = GROUP_SIZE, gzip: bool = False) -> None:
    """Append samples below ``path``, one partition folder per sample group.

    Rows are range-partitioned by index first, so that a task writes few
    folders and a folder gets few files.
    """
    out = (
        df.withColumn("bucket", sample_bucket(F.col(idx), group_size))
        .repartitionByRange(F.col(idx))
        .write.mode("append")
        .partitionBy("bucket")
    )
    out.option("compression", "gzip" if gzip else "zstd").parquet(path)


def read_samples(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Stored samples; unreadable files are left out, never replaced by others.

    With a ``schema`` none is inferred, so the first file may be damaged too.
    """
    reader = spark.read.option("ignoreCorruptFiles", True)
    return (reader if schema is None else reader.schema(schema)).parquet(path)


def unreadable_samples(spark: SparkSession, path: str, schema: T.StructType | str, suffix: str = ".parquet") -> DataFrame:
    """``path`` of the stored files that give :func:`read_samples` no row: damaged or empty ones."""
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    seen = read_samples(spark, path, schema).select(plain(F.col("_metadata.file_path")).alias("path")).distinct()
    listed = list_files(spark, path, (suffix,)).select(plain(F.col("path")).alias("path"))
    return listed.join(seen, "path", "left_anti")


def sample_files(
    spark: SparkSession, path: str, schema: T.StructType, suffixes: tuple[str, ...] = ("parquet",)
) -> DataFrame:
    """Stored samples with the state of their files, from one read: ``path, status, sample``.

    A file that can be read gives its rows with status ``ok``; one without rows, or one
    that cannot be read or lacks a column, gives one row without a sample, ``empty`` or
    ``damaged``.  A file is decoded whole by the task that reads it; sample folders keep
    files to one group of samples.
    """
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
    shape = to_arrow_schema(schema)
    row = T.StructType([T.StructField("path", T.StringType()), T.StructField("status", T.StringType()), T.StructField("sample", schema)])

    def decode(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        def rows(path, status, sample):
            columns = [pa.array([c] * len(sample), pa.string()) for c in (path, status)]
            return pa.RecordBatch.from_arrays([*columns, sample], names=["path", "status", "sample"])

        kind = pa.struct(list(shape))
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    table = pq.read_table(pa.BufferReader(content.as_buffer()), columns=shape.names)
                    table = table.select(shape.names).cast(shape)
                except (pa.ArrowException, OSError, KeyError):
                    yield rows(path, "damaged", pa.nulls(1, kind))
                    continue
                if not table.num_rows:
                    yield rows(path, "empty", pa.nulls(1, kind))
                for part in table.to_batches(max_chunksize=1000):
                    yield rows(path, "ok", pa.StructArray.from_arrays(part.columns, fields=list(shape)))

    stored = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}")
        .load(path)
    )
    return stored.select("path", "content").mapInArrow(decode, row)


def save_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> DataFrame:
    """``df`` as a table below ``path`` in ``buckets`` files by key, each sorted.

    Tables with one number of buckets are joined by key without a shuffle, however
    often; a resumed job pays for the layout once.
    """
    spread = df.repartition(buckets, key)
    spread.write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return df.sparkSession.table(table)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file lies at ``path``; resolving a reader checks just that."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException:
        return False
    return True


def save_conversations(df: DataFrame, path: str, test: DataFrame | None = None, format: str = "json") -> bool:
    """Write ``<path>_train`` and, if given, ``<path>_test``.

    Nothing happens, and False comes back, when the train output is there.
    """
    spark = df.sparkSession
    if exists(spark, f"{path}_train/_SUCCESS"):
        return False
    # The test part goes first: a present train part then means both are done.
    if test is not None:
        test.write.mode("overwrite").format(format).save(f"{path}_test")
    df.write.mode("overwrite").format(format).save(f"{path}_train")
    return True


def cache_key(**parameters) -> str:
    """A digest over *all* parameters, independent of their order."""
    text = "-".join(f"{k}={parameters[k]}" for k in sorted(parameters))
    return hashlib.md5(text.encode()).hexdigest()


def cache_key_column(*parts: Column) -> Column:
    """The digest of joined parameter columns."""
    return F.md5(F.concat_ws("-", *[p.cast("string") for p in parts]))


def _file_system(spark: SparkSession, path: str):
    """The file system of ``path``, and a maker of its paths."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly below ``path``, sorted, hidden ones left out."""
    files, at = _file_system(spark, path)
    if not files.exists(at(path)):
        return []
    return sorted(f.getPath().getName() for f in files.listStatus(at(path)) if f.getPath().getName()[0] not in "._")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    files, at = _file_system(spark, path)
    files.delete(at(path), True)


def publish(df: DataFrame, path: str, number: int = 0, keep: int = 2) -> None:
    """Make ``df`` the table at ``path``; readers see the old one whole or the new one whole.

    The rows go to a folder of their own.  Then one small file, the pointer of this
    ``number``, is renamed into place; it names the folder, and exists or does not.
    The highest number counts.  What only older pointers name is removed but for
    ``keep`` versions, so that a reader who has followed a pointer can finish; folders
    of writers that never got to publish go with the numbers below theirs.  Publishing a
    number again leaves what was published first.
    """
    spark = df.sparkSession
    name = f"{number:020d}"
    if name in folders(spark, f"{path}/pointers"):
        return
    folder = f"{name}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/versions/{folder}")
    files, at = _file_system(spark, path)
    waiting = at(f"{path}/pointers/.{folder}")
    out = files.create(waiting, True)
    out.write(bytearray(folder.encode()))
    out.close()
    if not files.rename(waiting, at(f"{path}/pointers/{name}")):
        files.delete(waiting, False)  # another writer published this number first
    # Pointers go before the folders they name.
    for old in folders(spark, f"{path}/pointers")[:-keep]:
        remove(spark, f"{path}/pointers/{old}")
    oldest = folders(spark, f"{path}/pointers")[0]
    for old in folders(spark, f"{path}/versions"):
        if old.split("-")[0] < oldest:
            remove(spark, f"{path}/versions/{old}")


def published(spark: SparkSession, path: str) -> str | None:
    """The folder that the highest pointer names; None before the first."""
    pointers = folders(spark, f"{path}/pointers")
    if not pointers:
        return None
    (line,) = spark.read.text(f"{path}/pointers/{pointers[-1]}").first()
    return f"{path}/versions/{line}"


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path`` as last published."""
    folder = published(spark, path)
    if folder is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.parquet(folder)


def cached(spark: SparkSession, root: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table stored under ``root/key``, built and published on first use.

    Two builders of one key write side by side; all readers see the one published first.
    """
    path = f"{root.rstrip('/')}/{key}"
    if published(spark, path) is None:
        publish(build(), path)
    return read_published(spark, path)


def result_name(name: str | None, stamp: Column) -> Column:
    """File name of a result set: optional name, then a time stamp."""
    head = f"{name}_" if name else ""
    return F.concat(F.lit(f"{head}results_"), F.date_format(stamp, "yyyyMMdd_HHmmss"))


def save_results(nested: DataFrame, root: str, name: str | None, stamp: datetime) -> str:
    """Write one JSON line per benchmark below a stamped folder and return its path."""
    head = f"{name}_" if name else ""
    path = f"{root.rstrip('/')}/{head}results_{stamp:%Y%m%d_%H%M%S}.jsonl"
    nested.coalesce(1).write.json(path)
    return path


def metric_rows(df: DataFrame, run: Column, mode: Column, step: Column, values: dict[str, Column]) -> DataFrame:
    """Wide metric columns to ``run, mode, step, name, value``; nulls are left out."""
    pairs = F.array(
        *[F.struct(F.lit(n).alias("name"), v.cast("double").alias("value")) for n, v in values.items()]
    )
    return (
        df.select(run.alias("run"), mode.alias("mode"), step.alias("step"), F.explode(pairs).alias("m"))
        .select("run", "mode", "step", F.concat("mode", F.lit("/"), "m.name").alias("name"), "m.value")
        .filter("value is not null")
    )
