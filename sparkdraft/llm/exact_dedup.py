"""Exact duplicates through an extendible-hash index on shared files.

1. One pass over the texts writes the entries: key, digest, length and id of a
   row, some hundred bytes whatever the length of its text.
2. Entries with one key and digest are combined in segments of rows, so that a text
   that a third of all rows share counts as at most ``SEGMENTS`` entries from here on.
3. The directory is built from counts of key prefixes.  A bucket that holds more
   than its capacity is split by one more bit of the key, which doubles the
   directory where it needs the bit.  Levels of ``LEVEL_BITS`` bits are added where
   a bucket is still overfull, until all fit or the key has no bits left.
4. Owner tasks take ranges of keys that consist of whole buckets.  Inside a bucket
   the entries of one key are chained: each digest is a link, and the copies behind
   it are a group.  The index is written in key order, one range of keys per file.
5. Texts behind one digest are compared byte by byte: they are grouped by digest
   and bytes, copies combine before the shuffle, and a digest must keep one text.
   They do not travel with the buckets, as each copy of a text would have to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkdraft.llm.common import SPACE, numbered, query, stored, text_or_empty

#: Entries per bucket before it splits, and bits of the key per level of the directory.
BUCKET_ROWS = 100_000
LEVEL_BITS = 12
#: Bits of the key that buckets may use; what shares them all is one chain.
KEY_BITS = 60
#: Parts in which the copies of one text are combined before they meet in a bucket.
SEGMENTS = 64


def normalised(text: Column) -> Column:
    """The text without the six white space characters."""
    return F.regexp_replace(text, SPACE + "+", "")


def prefix(bits: int) -> Column:
    """The first ``bits`` bits of the key."""
    return F.expr(f"shiftrightunsigned(hash, {64 - bits})") if bits else F.lit(0).cast("bigint")


def directory(
    keys: DataFrame, bucket_rows: int = BUCKET_ROWS, level_bits: int = LEVEL_BITS, level: int = 1
) -> DataFrame:
    """One level of the directory: ``leaf, depth, bucket, held``.

    ``leaf`` is a prefix of ``level * level_bits`` bits of the column ``hash``.  It
    belongs to the shallowest prefix, of ``depth`` bits, that holds no more than
    ``bucket_rows`` entries; ``bucket`` is the first key of that prefix.  Where
    ``held`` is above, the next level splits on.  A level has at most
    ``2 ** level_bits`` rows for each bucket that it splits.
    """
    base, deepest = (level - 1) * level_bits, level * level_bits
    counts = keys.groupBy(prefix(deepest).alias("leaf")).agg(F.count("*").alias("n"))
    held = (
        counts.select("leaf", "n", F.explode(F.sequence(F.lit(base), F.lit(deepest))).alias("depth"))
        .groupBy("depth", F.expr(f"shiftright(leaf, {deepest} - depth)").alias("prefix"))
        .agg(F.sum("n").alias("held"))
    )
    fits = F.col("held") <= bucket_rows
    split = held.filter(~fits).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    # A bucket fits where its parent does not.
    buckets = (
        held.filter(fits | (F.col("depth") == deepest))
        .withColumn("parent", F.expr("shiftright(prefix, 1)"))
        .join(split, ["depth", "parent"], "left_semi")
        .select("depth", "prefix", "held")
        .union(held.filter(fits & (F.col("depth") == base)).select("depth", "prefix", "held"))
    )
    low, high = (F.expr(f"shiftleft({p}, {deepest} - depth)") for p in ("prefix", "prefix + 1"))
    return buckets.select(
        F.explode(F.sequence(low, high - 1)).alias("leaf"),
        "depth",
        F.expr("shiftleft(prefix, 64 - depth)").alias("bucket"),
        "held",
    )


def with_buckets(keys: DataFrame, bucket_rows: int = BUCKET_ROWS, level_bits: int = LEVEL_BITS) -> DataFrame:
    """``keys`` with ``bucket`` and ``depth``; their directory is stored level by level."""
    found, rest, level = keys.select("*", F.lit(None).cast("bigint").alias("bucket"), F.lit(0).alias("depth")), keys, 1
    while True:
        slots = stored(directory(rest, bucket_rows, level_bits, level), "directory")
        named = slots.select("leaf", F.col("bucket").alias("own"), F.col("depth").alias("own_depth"))
        found = (
            found.withColumn("leaf", prefix(level * level_bits))
            .join(named, "leaf", "left")
            .withColumn("bucket", F.coalesce("own", "bucket"))
            .withColumn("depth", F.coalesce("own_depth", "depth"))
            .drop("leaf", "own", "own_depth")
        )
        overfull = slots.filter(F.col("held") > bucket_rows).select("leaf")
        if (level + 1) * level_bits > KEY_BITS or overfull.isEmpty():
            return found
        rest = rest.withColumn("leaf", prefix(level * level_bits)).join(overfull, "leaf", "left_semi").drop("leaf")
        level += 1


def build_index(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    bucket_rows: int = BUCKET_ROWS,
    level_bits: int = LEVEL_BITS,
    row: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Stored tables ``(entries, index)``.

    ``entries``: one row per input row with its number ``row``.
    ``index``: one row per distinct text with its bucket, its link in the chain of
    its key, and the row that stays.
    """
    source = docs.select(
        (F.monotonically_increasing_id() if row is None else row).alias("row"),
        F.col(key).alias("doc_id"),
        F.length(text_or_empty(text)).cast("bigint").alias("n_chars"),
        normalised(text_or_empty(text)).alias("norm"),
    )
    entries = stored(
        source.select(
            "row",
            "doc_id",
            "n_chars",
            F.xxhash64("norm").alias("hash"),
            F.sha2("norm", 256).alias("digest"),
        ),
        "entries",
    )
    order = F.struct(
        (-F.col("n_chars")).alias("a"),
        F.col("doc_id").isNull().alias("b"),
        F.col("doc_id").alias("c"),
        F.col("row").alias("d"),
    )
    combined = stored(
        entries.groupBy(F.pmod(F.xxhash64("row"), F.lit(SEGMENTS)).alias("segment"), "hash", "digest")
        .agg(F.count("*").alias("n"), F.min(order).alias("first"))
        .drop("segment"),
        "combined",
    )
    # Ranges of whole buckets: what follows stays in the task that owns them.
    owned = with_buckets(combined, bucket_rows, level_bits).repartitionByRange("bucket")
    groups = owned.groupBy("bucket", "depth", "hash", "digest").agg(
        F.sum("n").alias("group_size"), F.min("first").alias("first")
    )
    chain = Window.partitionBy("bucket", "hash").orderBy("digest")
    index = stored(
        groups.select(
            "bucket",
            "depth",
            "hash",
            "digest",
            F.row_number().over(chain).alias("link"),
            "group_size",
            F.col("first.c").alias("keep_id"),
            F.col("first.d").alias("keep_row"),
        ),
        "index",
    )
    _compare_bytes(source)
    return entries, index


def _compare_bytes(source: DataFrame) -> None:
    """Stop if two different texts have one digest."""
    # Copies meet in the task that reads them; one text per task and digest is moved.
    chains = (
        source.select(F.sha2("norm", 256).alias("digest"), "norm")
        .groupBy("digest", "norm")
        .agg(F.count("*").alias("n"))
    )
    if not chains.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").isEmpty():
        raise ValueError("two different texts have the same SHA-256 digest")


def exact_dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", row: Column | None = None, **sizes: int
) -> DataFrame:
    """One row per input row: ``row, doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their characters other than white space are; a null
    text counts as empty.  Of equal texts the one with the most characters
    stays, then the smallest id (null ids come last), then the first row.  Other
    columns are not looked at.  Rows are numbered by ``row``; without it the
    numbers are of this scan and name no row of another one.
    """
    entries, index = build_index(docs, key, text, row=row, **sizes)
    copies = index.filter("group_size > 1").select("hash", "digest", "group_size", "keep_id", "keep_row")
    # Rows without a copy need no partner; a text with many copies is split by the skew join.
    return entries.join(copies, ["hash", "digest"], "left").select(
        "row",
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (F.col("group_size").isNull() | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows that :func:`exact_dedup` drops."""
    rows = numbered(docs, "exact-rows")
    found = exact_dedup(rows, f"whole.{key}", f"whole.{text}", F.col("row"))
    dropped = found.filter(~F.col("kept")).select("row")
    # The list grows with the corpus: merged at every size, never broadcast.
    return rows.join(stored(dropped, "dropped").hint("merge"), "row", "left_anti").select("whole.*")


@query(
    "op6_exact_dedup",
    sql=r"""
with t as (
  select doc_id, length(coalesce(text, '')) as n,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as text_sha256
  from documents
), g as (
  select *, first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id) as keep_id,
    count(*) over (partition by text_sha256) as group_size
  from t
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from g""",
)
def op6(documents: DataFrame) -> DataFrame:
    """The contract's columns of every document, dropped ones too."""
    return exact_dedup(documents).drop("row")
