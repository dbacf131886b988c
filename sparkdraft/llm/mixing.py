"""Mixing sources to target weights through a splitting tree of block quotas.

A source is cut into blocks by a hash of its rows, so the order inside a block is
already random.  The target of a source says how many passes over its blocks the
mix makes and how much of one more.  Every block of every pass is a ticket.  The
tree starts with all tickets at its root and halves the output shards at each
level: a node draws, without replacement, exactly its left half's share of
tickets, so the counts per source follow the multivariate hypergeometric
distribution and every shard gets its whole number of blocks.  Only then are
tickets exchanged for blocks: the quota of a shard from a source is a stretch of
that source's permuted blocks, disjoint from those of all other shards.

Blocks are at least ``block_words`` long and at most about ``max_blocks`` many,
and shards come with the words of the mix, up to a quarter of that number: the tables of the tree are bounded whatever the size of the corpus, and only they
are broadcast.  The rows themselves meet their block in a map-side join and are
shuffled once, to their shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkdraft.llm.common import numbered, query, stored, text_or_empty, words_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_PASSES = 2
BLOCK_WORDS = 32_768
MAX_BLOCKS = 65_536
#: Words in an output shard, about, and most shards; a shard is one task's work.
SHARD_WORDS = 4_000_000
MAX_SHARDS = 16_384
SEED = 42


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MAX_PASSES
) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row per source.

    Weights repeat along the sources by code point, null last.  The targets are
    ``share`` of all sizes in proportion to weight, cut off at ``most`` times a
    source's size; what is cut off goes to the others by weight, until none is
    above.  Sources reach their ceiling in the order of ceiling over weight, so
    one pass in that order settles which do.  One task sorts the sources, a
    table of labels; the rows behind them were counted before.
    """
    table = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weighed = sizes.withColumn("place", F.row_number().over(by_name) - 1).select(
        "source",
        "source_size",
        "place",
        F.get(table, F.col("place") % len(weights)).alias("weight"),
        (F.lit(most) * F.col("source_size")).cast("double").alias("ceiling"),
    )
    by_need = Window.orderBy(F.col("ceiling") / F.col("weight"), "place")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = weighed.select(
        "*",
        (
            F.lit(share) * F.sum("source_size").over(everything)
            - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))
        ).alias("rest"),
        F.sum("weight").over(onward).alias("open_weight"),
    ).withColumn("level", F.col("rest") / F.col("open_weight"))
    # The first source below its ceiling fixes the level for itself and all that follow.
    under = F.when(F.col("weight") * F.col("level") <= F.col("ceiling"), F.col("level"))
    level = F.first(under, ignorenulls=True).over(by_need.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return left.select(
        "source",
        "source_size",
        F.coalesce(F.least(F.col("weight") * level, F.col("ceiling")), F.col("ceiling")).alias("target"),
    )


def _split(tickets: DataFrame, shards: int, seed: int) -> DataFrame:
    """Adds ``shard``: the leaf of the splitting tree that each ticket ends in."""
    nodes = tickets.select("*", F.lit(0).alias("low"), F.lit(shards).alias("high"))
    for level in range(max(1, shards - 1).bit_length()):
        node = Window.partitionBy("low", "high")
        drawn = node.orderBy(F.xxhash64(F.lit(seed + level), "source", "ticket"), "place", "ticket")
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        quota = F.floor(
            F.count("*").over(node) * (F.col("middle") - F.col("low")) / (F.col("high") - F.col("low"))
        )
        split = nodes.withColumn("middle", middle).withColumn(
            "left", (F.col("high") - F.col("low") > 1) & (F.row_number().over(drawn) <= quota)
        )
        alone = F.col("high") - F.col("low") <= 1
        nodes = split.select(
            *tickets.columns,
            F.when(alone | F.col("left"), F.col("low")).otherwise(F.col("middle")).alias("low"),
            F.when(F.col("left"), F.col("middle")).otherwise(F.col("high")).alias("high"),
        )
    return nodes.select(*tickets.columns, F.col("low").alias("shard"))


def _quotas(blocks: DataFrame, targets: DataFrame, shards: int, seed: int) -> DataFrame:
    """``source, block, whole, words, shards``: passes, words of a last part, and the shard of each."""
    own = targets.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    # Null sources are a source of their own; joins and windows go by place.
    placed = blocks.join(
        F.broadcast(own.withColumnRenamed("source", "name")), F.col("source").eqNullSafe(F.col("name"))
    ).drop("name")
    permuted = Window.partitionBy("place").orderBy(F.xxhash64(F.lit(seed), "source", "block"), "block")
    before = permuted.rowsBetween(Window.unboundedPreceding, -1)
    taken = placed.select(
        "*",
        F.row_number().over(permuted).alias("rank"),
        F.coalesce(F.sum("words").over(before), F.lit(0)).alias("ahead"),
        F.floor(F.col("target") / F.greatest("source_size", F.lit(1))).cast("int").alias("passes"),
    ).withColumn("extra", F.round(F.col("target")).cast("bigint") - F.col("passes") * F.col("source_size"))
    cut = F.greatest(F.lit(0), F.least(F.col("words"), F.col("extra") - F.col("ahead")))
    plan = taken.withColumn("part", cut.cast("bigint")).withColumn(
        "uses", F.col("passes") + (F.col("part") > 0).cast("int")
    )
    # The n-th use of a source's permuted blocks is exchanged for its n-th ticket.
    uses = plan.select("place", "source", "block", "rank", F.explode(F.sequence(F.lit(0), F.col("uses"))).alias("use"))
    uses = uses.filter("use > 0").select(
        "place",
        "block",
        "source",
        F.row_number().over(Window.partitionBy("place").orderBy("use", "rank")).alias("ticket"),
        "use",
    )
    tickets = _split(uses.select("place", "source", "ticket"), shards, seed)
    by_shard = Window.partitionBy("place").orderBy("shard", "ticket")
    drawn = tickets.select("place", "shard", F.row_number().over(by_shard).alias("ticket"))
    seats = uses.join(drawn, ["place", "ticket"]).groupBy("place", "block").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("use", "shard"))), lambda x: x["shard"]).alias("shards")
    )
    return plan.join(seats, ["place", "block"], "left").select(
        "source", "block", "target", "source_size", "passes", "part", "words", "shards"
    )


def mix_sources(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MAX_PASSES,
    shards: int | None = None,
    block_words: int = BLOCK_WORDS,
    max_blocks: int = MAX_BLOCKS,
    seed: int = SEED,
    row: Column | None = None,
) -> DataFrame:
    """One row per input row: ``row, doc_id, size, source_size, target, taken, shards``.

    ``size`` counts words, none in a null text; rows without a word are never
    taken.  ``taken`` counts repeats: ``size`` for each pass and, for the row in
    which a source's last part ends, the words up to there.  ``shards`` has the
    output shard of every use, so the last one of a cut row is the cut one.  A
    null source is a source like any other, the last one.  Choices are functions
    of the seed, the key and the text, so reruns agree and repeated rows are
    treated alike but for the one in which a part ends.  Other columns are not
    looked at.  Rows are numbered by ``row``; without it the numbers are of this
    scan and name no row of another one.
    """
    sized = stored(
        docs.select(
            (F.monotonically_increasing_id() if row is None else row).alias("row"),
            F.col(key).alias("doc_id"),
            F.col(source).cast("string").alias("source"),
            word_count(text_or_empty(text)).alias("size"),
            F.xxhash64(F.lit(seed), F.col(key).cast("string"), text_or_empty(text)).alias("draw"),
        ),
        "sizes",
    )
    sums = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    targets = stored(source_targets(sums, weights, share, most), "targets")
    if shards is None:
        words = targets.agg(F.sum("target")).first()[0] or 0
        shards = max(1, min(MAX_SHARDS, math.ceil(words / SHARD_WORDS)))
    whole = Window.partitionBy()
    per_block = F.greatest(F.lit(block_words), F.sum("source_size").over(whole) / max_blocks)
    counts = targets.select(
        F.col("source").alias("name"),
        F.greatest(F.lit(1), F.ceil(F.col("source_size") / per_block)).cast("bigint").alias("n_blocks"),
    )
    cut = stored(
        sized.join(F.broadcast(counts), F.col("source").eqNullSafe(F.col("name")))
        .withColumn("block", F.pmod("draw", "n_blocks"))
        .drop("name", "n_blocks"),
        "blocks",
    )
    blocks = cut.groupBy("source", "block").agg(F.sum("size").alias("words"))
    quotas = stored(_quotas(blocks, targets, shards, seed), "quotas")
    named = quotas.select(
        F.col("source").alias("name"), F.col("block").alias("number"), "target", "source_size", "passes", "part",
        (F.col("part") < F.col("words")).alias("cuts"), "shards",
    )
    seated = cut.join(
        F.broadcast(named), F.col("source").eqNullSafe(F.col("name")) & (F.col("block") == F.col("number"))
    ).drop("name", "number")
    # One block per source is cut; only its rows need an order.
    is_cut = F.col("cuts") & (F.col("part") > 0)
    inside = Window.partitionBy("source", "block").orderBy("draw", "doc_id", "row")
    ahead = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    edge = seated.filter(is_cut).withColumn("ahead", F.coalesce(ahead, F.lit(0)))
    rest = seated.filter(~is_cut).withColumn("ahead", F.lit(0).cast("bigint"))

    def extra() -> Column:
        return F.greatest(F.lit(0), F.least(F.col("size"), F.col("part") - F.col("ahead")))

    return rest.union(edge.select(*rest.columns)).select(
        "row",
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("passes") * F.col("size") + F.when(F.col("part") > 0, extra()).otherwise(0)).cast("bigint").alias("taken"),
        "shards",
    )


def write_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: ``docs``, all columns, once per use, shuffled inside its shard.

    The text of the row in which a source's last part ends is cut after the words
    taken.  Rows come by shard and, in a shard, in random order.
    """
    seed = options.get("seed", SEED)
    rows = numbered(docs, "mix-rows")
    found = mix_sources(rows, f"whole.{key}", f"whole.{text}", f"whole.{source}", row=F.col("row"), **options)
    chosen = stored(found.filter("taken > 0").select("row", "size", "taken", "shards"), "chosen")
    uses = rows.join(chosen.hint("merge"), "row").select(
        "row",
        F.col("whole").alias("mixed"),
        "size",
        "taken",
        F.posexplode(F.slice("shards", 1, F.ceil(F.col("taken") / F.col("size")).cast("int"))).alias("use", "shard"),
    )
    words = F.least(F.col("size"), F.col("taken") - F.col("use") * F.col("size"))
    body = F.col(f"mixed.`{text}`")
    cut = F.array_join(F.slice(words_of(F.coalesce(body, F.lit(""))), 1, words.cast("int")), " ")
    return (
        uses.withColumn("mixed", F.col("mixed").withField(f"`{text}`", F.when(words < F.col("size"), cut).otherwise(body)))
        .repartition("shard")
        .sortWithinPartitions("shard", F.xxhash64(F.lit(seed), F.col(f"mixed.{key}").cast("string"), "use"), "row", "use")
        .select("mixed.*")
    )


@query("op3_mix_sources")
def op3(documents: DataFrame) -> DataFrame:
    """The contract's columns of every document, and the output shard of each of its uses."""
    shards = F.array_join("shards", ",").alias("shards")
    return mix_sources(documents).select("doc_id", "size", "source_size", "target", "taken", shards)
