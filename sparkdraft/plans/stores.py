"""Queries over what was stored and read back: by suffix, by listing, by key, by streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdraft.operators import turns as TN
from sparkdraft.plans.chat import DATASET_SQL, MAX_LENGTH, mask_summary, training_rows
from sparkdraft.plans.corpus import dirty_lines
from sparkdraft.plans.dataset import vocab_mapping
from sparkdraft.plans.registry import Tables, query
from sparkdraft.plans.vocabulary import DRAFT, FREQ_SQL, TARGET, kept_sql
from sparkdraft.session import shared_folder, stored
from sparkdraft.sources import files
from sparkdraft.streaming import jobs


def new_folder(t: Tables, label: str) -> str:
    return f"{shared_folder(t.spark)}/stored/{label}-{uuid.uuid4().hex}"


# Suffixes whose readers are given the table's columns.
STORED_AS = ("json", "csv", "orc", "parquet")


@query(
    "suffix_sources",
    f"""
    select subset, lang, count(*) as rows, cast(sum(n_chars) as bigint) as chars, min(doc_id) as first_id
    from documents, unnest([{', '.join(repr(s) for s in STORED_AS)}]) as u(subset) group by subset, lang
    """,
)
def suffix_sources(t: Tables) -> DataFrame:
    """One table stored in four formats, each read back by the suffix of its path."""
    rows = t.documents.select("doc_id", "lang", "n_chars")
    root = new_folder(t, "suffixes")
    for suffix in STORED_AS:
        writer = rows.write.option("header", True) if suffix == "csv" else rows.write
        writer.format(suffix).save(f"{root}/rows.{suffix}")
    read = {s: files.read_any(t.spark, f"{root}/rows.{s}", rows.schema) for s in STORED_AS}
    return files.merge_sources(read).groupBy("subset", "lang").agg(
        F.count("*").alias("rows"), F.sum("n_chars").cast("bigint").alias("chars"), F.min("doc_id").alias("first_id")
    )


@query(
    "sample_listing",
    f"""
    select distinct 'rows_' || (vec_id - vec_id % {files.GROUP_SIZE}) || '-'
                    || (vec_id - vec_id % {files.GROUP_SIZE} + {files.GROUP_SIZE}) as bucket
    from embeddings
    """,
)
def sample_listing(t: Tables) -> DataFrame:
    """The folders of stored samples, told from a listing of their files."""
    root = new_folder(t, "samples")
    files.write_samples(t.embeddings.select("vec_id", "label"), root, "vec_id")
    found = files.list_files(t.spark, root, (".parquet",))
    return found.select(F.regexp_extract("path", "/bucket=([^/]+)/[^/]+$", 1).alias("bucket")).distinct()


@query(
    "vocab_map_sink",
    f"""
    with {kept_sql(DRAFT)}
    select cast(id as int) as token_id, d.draft_id, d.token_id - d.draft_id as "offset"
    from range({TARGET}) as r(id) left join draft d on d.token_id = id
    """,
)
def vocab_map_sink(t: Tables) -> DataFrame:
    """Both id maps from a keyed store that is written once; the second call counts nothing."""
    rows = training_rows(t).select("input_ids", "loss_mask")
    root = new_folder(t, "vocab")
    vocab_mapping(rows, TARGET, DRAFT, root, template="qwen")
    draft, flags = vocab_mapping(rows.limit(0), TARGET, DRAFT, root, template="qwen")
    maps = flags.filter("in_draft").join(draft, "token_id").select("token_id", "draft_id", "offset")
    return flags.select("token_id").join(maps, "token_id", "left")


def streamed_rows(t: Tables) -> str:
    """The folder of the training rows that a stream made of the conversations."""
    nested = stored(TN.nest_turns(t.conversations, MAX_LENGTH), "nested")
    source = t.spark.readStream.schema(nested.schema).parquet(nested.inputFiles()[0].rsplit("/", 1)[0])
    root = new_folder(t, "stream-rows")
    jobs.training_rows(source, "qwen", f"{root}/rows", f"{root}/checkpoint", max_length=MAX_LENGTH).awaitTermination()
    return f"{root}/rows"


@query(
    "stream_rows",
    f"""
    with {DATASET_SQL}
    select conv_id, cast(len(toks) as int) as n_tokens, cast(length(replace(mask, '0', '')) as int) as n_loss,
           md5(mask) as mask_md5
    from dataset
    """,
)
def stream_rows(t: Tables) -> DataFrame:
    return mask_summary(t.spark.read.parquet(streamed_rows(t)), "conv_id")


@query("stream_counts", f"with {FREQ_SQL} select token_id, freq from freqs")
def stream_counts(t: Tables) -> DataFrame:
    """The running counts that a second stream published, fed by the rows of the first."""
    path = streamed_rows(t)
    root = new_folder(t, "stream-counts")
    rows = t.spark.readStream.schema(t.spark.read.parquet(path).schema).parquet(path)
    jobs.token_counts(rows, f"{root}/counts", f"{root}/checkpoint").awaitTermination()
    return files.read_published(t.spark, f"{root}/counts")


@query(
    "stream_ingest",
    """
    select doc_id, case doc_id % 8 when 1 then 'invalid json' when 3 then 'conversations is not a list' end as reason,
           cast(case when doc_id % 8 in (5, 7) then 1 when doc_id % 8 = 6 then 2 when doc_id % 8 in (2, 4) then 0 end
                as int) as messages
    from documents where doc_id % 8 <> 0
    """,
)
def stream_ingest(t: Tables) -> DataFrame:
    """Lines with defects through a stream: what it stored as good, and what as rejects."""
    root = new_folder(t, "stream-ingest")
    lines = dirty_lines(t.documents)
    lines.write.parquet(f"{root}/lines")
    source = t.spark.readStream.schema(lines.schema).parquet(f"{root}/lines")
    jobs.ingest(source, f"{root}/good", f"{root}/rejects", f"{root}/checkpoint").awaitTermination()
    good = t.spark.read.parquet(f"{root}/good")
    rejects = t.spark.read.parquet(f"{root}/rejects")
    return good.select("doc_id", F.lit(None).cast("string").alias("reason"), F.size("conversations").alias("messages")).unionByName(
        rejects.select("doc_id", "reason", F.lit(None).cast("int").alias("messages"))
    )
