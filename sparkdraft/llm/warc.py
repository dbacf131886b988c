"""A content-addressed web archive.

Payload bytes are stored once, under their SHA-256 digest; the exact header of
every record is stored apart.  A record is put together again by joining the two.
Both stores are Parquet tables in a folder that all executors share, so writers
and readers are ordinary Spark jobs.

A digest is never trusted alone.  When payloads are stored, all rows behind one
digest must agree in length and in a second hash, and when they are read back the
digest is computed anew from the stored bytes.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdraft.llm.common import new_folder, query

#: Payloads of fewer bytes are written in full every time.
REVISIT_BYTES = 100

# Names of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LINE = "\r\n"


class Archive(NamedTuple):
    """Folders of an archive's two stores."""

    payloads: str
    headers: str


def _field(name: str, value: Column) -> Column:
    """``Name: value`` and a line end; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(LINE)), F.lit(""))


def _escaped(key: Column) -> Column:
    """A key as the value of a field: line ends would end it."""
    text = F.regexp_replace(key.cast("string"), "%", "%25")
    return F.regexp_replace(F.regexp_replace(text, "\r", "%0D"), "\n", "%0A")


def key_field(name: str) -> Column:
    """The key in a field, as it was before it was written."""
    text = F.regexp_replace(F.regexp_replace(header_field(name), "%0A", "\n"), "%0D", "\r")
    return F.regexp_replace(text, "%25", "%")


def _record_id(key: Column, digest: Column) -> Column:
    """A record's own URI, the same whenever the same page is written."""
    h = F.md5(F.concat_ws("\x00", F.coalesce(key.cast("string"), F.lit("-")), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _header(first: Column) -> Column:
    """The record's header with its closing empty line, from the columns of a marked page."""
    revisit = F.col("revisit")
    # A null URL has no field; line ends cannot be part of a field.
    url = F.regexp_replace(F.col("url").cast("string"), r"[\r\n]+", "%0A")
    return F.concat(
        F.lit(VERSION + LINE),
        _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", _record_id(F.col("page"), F.col("digest"))),
        _field("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        _field("WARC-Target-URI", url),
        _field("X-Page-ID", _escaped(F.col("page"))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _field("X-Payload-Length", F.col("n_bytes")),
        _field("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _field("WARC-Refers-To", F.when(revisit, _record_id(first, F.col("digest")))),
        _field("X-Refers-To-Page-ID", F.when(revisit, _escaped(first))),
        _field("Content-Type", F.lit("text/html; charset=utf-8")),
        _field("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes"))),
        F.lit(LINE),
    )


def write_archive(
    pages: DataFrame,
    folder: str,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    revisit_bytes: int = REVISIT_BYTES,
) -> Archive:
    """Write one record per row below ``folder``.

    A null payload is an empty one.  Of records with equal payloads of at least
    ``revisit_bytes`` bytes, that with the smallest key is the response and the
    others revisit it; null keys come last.  Rows that repeat that key as well are
    the same record written again, and are responses too.  Other columns are not
    archived.
    """
    archive = Archive(f"{folder}/payloads", f"{folder}/headers")
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(key).alias("page"),
        F.col(url).alias("url"),
        body.alias("body"),
        F.sha2(body, 256).alias("digest"),
        F.octet_length(body).cast("bigint").alias("n_bytes"),
    )
    # A digest's rows combine before the shuffle, however many there are.
    firsts = rows.groupBy("digest").agg(
        F.min("page").alias("first"),
        F.min("n_bytes").alias("shortest"),
        F.max("n_bytes").alias("longest"),
        F.min(F.xxhash64("body")).alias("low"),
        F.max(F.xxhash64("body")).alias("high"),
    )
    differ = (F.col("shortest") != F.col("longest")) | (F.col("low") != F.col("high"))
    firsts = firsts.select(
        "digest",
        F.when(differ, F.raise_error(F.lit("two payloads with one SHA-256 digest"))).otherwise(F.col("first")).alias("first"),
    )
    later = ~F.col("page").eqNullSafe(F.col("first")) & (F.col("n_bytes") >= revisit_bytes)
    marked = rows.select("page", "url", "digest", "n_bytes").join(firsts, "digest").withColumn("revisit", later)
    marked.select("digest", _header(F.col("first")).alias("header")).write.parquet(archive.headers)
    _distinct_payloads(rows).write.parquet(archive.payloads)
    return archive


def _distinct_payloads(rows: DataFrame) -> DataFrame:
    """``digest, payload`` once per digest; copies in one task are dropped before the shuffle."""
    return rows.select("digest", "body").dropDuplicates(["digest", "body"]).select(
        "digest", F.encode("body", "UTF-8").alias("payload")
    )


def header_field(name: str, header: Column | None = None) -> Column:
    """The value of a field in an exact header; null where it is absent."""
    header = F.col("header") if header is None else header
    found = F.regexp_extract(header, rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
    return F.when(header.contains(f"{LINE}{name}: "), found)


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """``header, digest, payload, payload_bytes, payload_digest`` of every record.

    ``payload`` is the whole payload, of a revisit too; length and digest are
    computed from the stored bytes, and a payload that does not fit its digest
    stops the job.
    """
    headers = spark.read.parquet(archive.headers)
    payloads = spark.read.parquet(archive.payloads)
    anew = F.sha2("payload", 256)
    verified = payloads.select(
        "digest",
        "payload",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.when(anew == F.col("digest"), anew)
        .otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))))
        .alias("payload_digest"),
    )
    return headers.join(verified, "digest")


def record_bytes(records: DataFrame) -> DataFrame:
    """``record``: the bytes of each record as they stand in a WARC file.

    A revisit has an empty block; two line ends close a record.
    """
    block = F.when(header_field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records.select(
        F.concat(F.encode("header", "UTF-8"), block, F.lit((LINE + LINE).encode())).alias("record")
    )


@query(
    "op4_warc_archive",
    "pages",
    sql="""
with t as (
  select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes,
    sha256(coalesce(html, '')) as payload_digest
  from pages
), f as (
  select *, min(page_id) over (partition by payload_digest) as first_id from t
), r as (
  select *, payload_bytes >= 100 and page_id is distinct from first_id as revisit from f
)
select page_id, payload_bytes, payload_digest,
  case when revisit then 'revisit' else 'response' end as record_type,
  case when revisit then first_id end as refers_to
from r""",
)
def op4(pages: DataFrame) -> DataFrame:
    """Every page's record as it comes back from the archive."""
    spark = pages.sparkSession
    kind = dict(pages.dtypes)["page_id"]
    archive = write_archive(pages, new_folder(spark, "warc"))
    return read_records(spark, archive).select(
        key_field("X-Page-ID").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        header_field("WARC-Type").alias("record_type"),
        key_field("X-Refers-To-Page-ID").cast(kind).alias("refers_to"),
    )
