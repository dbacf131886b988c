"""From raw documents to packed training sequences, one corpus operator per stage.

Every stage reads what its predecessor wrote and works on all of it:

1. ``language_id``: rows whose text no known language explains are left out;
2. ``exact_dedup``: of equal texts one row stays;
3. ``near_dedup``: of each group of near duplicates the row with the smallest id stays;
4. ``mix``: sources are brought to their target weights, rows taken twice come twice;
5. ``pack``: texts are tokenised and packed into sequences.

The first four return the columns of their input.  Nulls, empty texts, repeated
rows, empty tables and further columns are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdraft.llm.common import Query, new_folder, read_table
from sparkdraft.llm.exact_dedup import drop_copies
from sparkdraft.llm.language import keep_identified
from sparkdraft.llm.mixing import write_mix
from sparkdraft.llm.packing import default_tokenizer, pack_documents
from sparkdraft.llm.simhash import drop_near_copies


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose language is told; a null text or one without a letter goes."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, white space aside: the longest original, then the smallest id."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints: that with the smallest id."""
    return drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mix, repeats included; one row per source may be cut at its target."""
    return write_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences; ``ids`` are little-endian 32-bit numbers in base 64."""
    return pack_documents(docs, default_tokenizer()).select(
        "sequence_id", "offset", "doc_id", "start", "length", "doc_tokens", F.base64("ids").alias("ids")
    )


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("pack", pack),
]

#: Centroids, fingerprints, hashed draws and tokenizers are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERY = Query(run, ORACLE_SQL)
