"""Texts to token ids.

No tokenizer file ships with the library, so the default cuts text losslessly
with one regular expression and gives every piece an id from a fixed range by
hashing.  The id space is bounded by construction, needs no vocabulary table,
no join and no shuffle.  :func:`encode` gives ids from a vocabulary table instead,
and the mask policies take offsets of any other tokenizer as columns.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkdraft.functions.hashing import leading_number
from sparkdraft.functions.text import find_all

#: Marker tokens, runs of ASCII letters or digits, single characters.
TOKEN = r"<\|[a-z_]+\|>|[0-9A-Za-z]+|[^0-9A-Za-z]"

#: Default size of the target vocabulary.
VOCAB_SIZE = 32768


def pieces(text: Column) -> Column:
    """The token texts; joined again they give the text itself."""
    return find_all(text, TOKEN)


def token_id(piece: Column, vocab_size: int = VOCAB_SIZE) -> Column:
    """The id of a token text."""
    return (leading_number(F.md5(piece), 7) % vocab_size).cast("int")


def token_ids(token_texts: Column, vocab_size: int = VOCAB_SIZE) -> Column:
    return F.transform(token_texts, lambda p: token_id(p, vocab_size))


def tokenize(
    df: DataFrame, text: str = "text", max_length: int | None = None, vocab_size: int = VOCAB_SIZE
) -> DataFrame:
    """Add ``pieces`` and ``input_ids``, cut at ``max_length`` tokens if given."""
    found = pieces(F.col(text))
    if max_length is not None:
        found = F.slice(found, 1, max_length)
    return df.withColumn("pieces", found).withColumn("input_ids", token_ids(F.col("pieces"), vocab_size))


def encode(df: DataFrame, vocab: DataFrame, key: str, tokens: str = "pieces", unknown: int = 0) -> DataFrame:
    """Add ``input_ids`` from a table ``token, token_id``; other tokens get ``unknown``.

    ``key`` tells the rows apart.  Only distinct tokens meet the vocabulary: the
    tokens of a row are reduced to distinct ones, looked up, and come back as one
    map per row, so a common token costs a row one lookup however often it stands there.
    """
    distinct = df.select(key, F.explode(F.array_distinct(tokens)).alias("token"))
    found = (
        distinct.join(vocab.select("token", F.col("token_id").cast("int").alias("token_id")), "token")
        .groupBy(key)
        .agg(F.map_from_entries(F.collect_list(F.struct("token", "token_id"))).alias("_ids"))
    )
    joined = df.join(found, key, "left")
    ids = F.transform(tokens, lambda t: F.coalesce(F.try_element_at("_ids", t), F.lit(unknown)))
    return joined.withColumn("input_ids", ids).drop("_ids")


def token_vocab(df: DataFrame, token: str = "token", size: int = VOCAB_SIZE) -> DataFrame:
    """The ``size`` most frequent tokens with dense ids (count down, token up).

    Distinct tokens may be very many.  A histogram of the counts, one row per
    distinct count, tells how frequent a token must be; only those, and the ties
    at the edge, take part in the final sort.  Both read the same shuffle.
    """
    counts = df.groupBy(token).agg(F.count("*").alias("freq"))
    down = Window.orderBy(F.desc("freq")).rowsBetween(Window.unboundedPreceding, -1)
    histogram = counts.groupBy("freq").agg(F.count("*").alias("n"))
    above = histogram.select("freq", F.coalesce(F.sum("n").over(down), F.lit(0)).alias("above"))
    least = above.filter(F.col("above") < size).agg(F.min("freq").alias("f")).scalar()
    frequent = counts.filter(F.col("freq") >= least)
    top = frequent.orderBy(F.desc("freq"), F.asc(token)).limit(size)
    rank = F.row_number().over(Window.orderBy(F.desc("freq"), F.asc(token)))
    return top.select(F.col(token), "freq", (rank - 1).cast("bigint").alias("token_id"))
