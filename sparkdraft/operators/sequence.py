"""Shaping of token sequences for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkdraft.functions.arrays import pad_right, shift, window_of, zero_last
from sparkdraft.functions.hashing import leading_number, mix32, seeded_hex
from sparkdraft.functions.rows import evaluate_once, explode_rows



def truncate_and_close(df: DataFrame, max_len: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Cut all arrays at ``max_len``, close the loss mask, add ones as attention."""
    out = df
    for name in ("input_ids", *extra):
        out = out.withColumn(name, F.slice(name, 1, max_len))
    mask = zero_last(F.slice("loss_mask", 1, max_len), F.lit(0))
    return out.withColumn("loss_mask", mask).withColumn(
        "attention_mask", F.array_repeat(F.lit(1), F.size("loss_mask"))
    )


def overlap_shards(
    df: DataFrame, max_len: int, shards: int, overlap: int, extra: tuple[str, ...] = ()
) -> DataFrame:
    """Each sequence as ``shards`` equal pieces that overlap to the right.

    Piece ``r`` starts at ``r * chunk`` and holds ``chunk + overlap`` places,
    zero-padded past the end; attention is 1 on real tokens.
    """
    length = F.least(F.size("input_ids"), F.lit(max_len))
    chunk = F.ceil(length / shards).cast("int")
    start = F.col("shard") * F.col("chunk")
    width = F.col("chunk") + overlap
    out = df.select(
        "*", length.alias("_len"), chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    )
    valid = F.greatest(F.least(start + width, F.col("_len")) - start, F.lit(0))

    def piece(array: Column) -> Column:
        fill = F.lit(0)
        return pad_right(window_of(F.slice(array, F.lit(1), F.col("_len")), start, width), width, fill)

    mask = zero_last(F.slice("loss_mask", F.lit(1), F.col("_len")), F.lit(0))
    shaped = out.withColumn("_valid", valid)
    result = shaped.withColumn("loss_mask", piece(mask)).withColumn("input_ids", piece(F.col("input_ids")))
    for name in extra:
        result = result.withColumn(name, piece(F.col(name)))
    return result.withColumn(
        "attention_mask", pad_right(F.array_repeat(F.lit(1), F.col("_valid")), width, F.lit(0))
    ).drop("_len", "_valid")


def shard_positions(chunk: Column, ring_rank: Column, shards: int, ring_size: int) -> Column:
    """Position ids of a shard: its ring's slice of the whole sequence."""
    size = chunk * max(1, shards // ring_size)
    start = ring_rank * size
    return F.when(size > 0, F.sequence(start, start + size - 1)).otherwise(F.array().cast("array<int>"))


def pad_batches(
    df: DataFrame,
    batch_size: int,
    index: str = "idx",
    multiple: int = 1,
    arrays: tuple[str, ...] = ("input_ids", "attention_mask", "loss_mask"),
    drop_last: bool = True,
) -> DataFrame:
    """Add ``batch`` and zero-pad the arrays to the batch's longest sequence.

    The target length is rounded up to a multiple of ``multiple``.  Incomplete
    batches are left out unless ``drop_last`` is off.  Groups hold
    ``batch_size`` rows at most.
    """
    group = Window.partitionBy("batch")
    sized = (
        df.withColumn("batch", F.floor(F.col(index) / batch_size))
        .withColumn("_max", F.max(F.size("input_ids")).over(group))
        .withColumn("_rows", F.count("*").over(group))
    )
    if drop_last:
        sized = sized.filter(F.col("_rows") == batch_size)
    target = (F.ceil(F.col("_max") / multiple) * multiple).cast("int")
    padded = sized.withColumn("padded_length", target)
    for name in arrays:
        padded = padded.withColumn(name, pad_right(F.col(name), F.col("padded_length"), F.lit(0)))
    return padded.drop("_max", "_rows")


def assign_ranks(df: DataFrame, world: int, total: Column, how: str = "round_robin", index: str = "idx") -> DataFrame:
    """Add ``rank`` (and ``slot``): which of ``world`` workers reads a row.

    ``round_robin`` deals rows out in turn and repeats the first rows so that
    all workers get equally many.  ``ranges`` cuts the index range into
    contiguous pieces, the first ``n % world`` one row longer.
    """
    # The total may be a scalar subquery, which a lambda cannot hold.
    counted = df.withColumn("_n", total)
    n = F.col("_n")
    if how == "ranges":
        size, extra = F.floor(n / world), n % world
        long = extra * (size + 1)
        rank = F.when(F.col(index) < long, F.floor(F.col(index) / (size + 1))).otherwise(
            extra + F.floor((F.col(index) - long) / F.greatest(size, F.lit(1)))
        )
        start = rank * size + F.least(rank, extra)
        return counted.withColumn("rank", rank.cast("int")).withColumn("slot", F.col(index) - start).drop("_n")
    if how != "round_robin":
        raise ValueError(f"unknown assignment {how!r}")
    missing = F.pmod(-n, F.lit(world))
    # A dealt position beyond n wraps to the front; short tables wrap repeatedly.
    again = F.floor((missing - 1 - F.col(index)) / n) + 1
    turns = F.when(F.col(index) < missing, again).otherwise(0)
    return (
        counted.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), turns.cast("bigint"))))
        .withColumn("_at", F.col("_k") * n + F.col(index))
        .withColumn("rank", (F.col("_at") % world).cast("int"))
        .withColumn("slot", F.floor(F.col("_at") / world))
        .drop("_at", "_k", "_n")
    )


def lookahead_steps(
    df: DataFrame, steps: int, target: str | None = None, fill: Column | None = None
) -> DataFrame:
    """One row per look-ahead step: ids and mask moved left by the step.

    ``target`` names a per-position array; step ``i`` sees its places
    ``i .. i+n-1``, with ``fill`` (default null) past the end.
    """
    out = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    zero = F.lit(0)
    out = out.withColumn("input_ids", shift(F.col("input_ids"), F.col("step"), zero)).withColumn(
        "loss_mask", shift(F.col("loss_mask"), F.col("step"), zero)
    )
    if target:
        empty = F.lit(None) if fill is None else fill
        out = out.withColumn(target, shift(F.col(target), F.col("step"), empty))
    return out


def anchor_candidates(mask: Column, block: int) -> Column:
    """Positions with mask 1 that still have a whole block to their right."""
    room = F.slice(mask, F.lit(1), F.greatest(F.size(mask) - block, F.lit(0)) + 1)
    return F.filter(F.transform(room, lambda m, i: F.when(m == 1, i)), lambda i: i.isNotNull())


#: Positions of a row are below this; hashes above it make numbers of at most 63 bits.
PLACES = 1 << 31


def smallest(values: str, n: Column) -> Column:
    """The ``n`` smallest of an array of hashes times ``PLACES``, in order.

    Hashes are spread evenly over 32 bits, so the share of them that is wanted, with
    some room, gives a bound below which almost always enough lie: few are sorted.
    Where too few lie below it, all are.
    """
    room = n + 4 * F.sqrt(n) + 8
    bound = (room / F.size(values) * float(PLACES * 2**32)).cast("double")
    few = F.array(F.filter(values, lambda x: x <= bound))
    # Bound to a name, the filtered array is computed once.
    pool = F.get(F.transform(few, lambda f: F.when(F.size(f) >= n, f).otherwise(F.col(values))), F.lit(0))
    return F.slice(F.array_sort(pool), F.lit(1), n)


def sample_anchors(
    df: DataFrame, block: int, n: int, key: str, seed: int = 42, cap: str = "row", batch: str | None = None
) -> DataFrame:
    """Add ``anchors`` (ascending, 0-filled) and ``keep`` (0/1), in seeded choice.

    At most ``min(n, candidates - 1)`` anchors are chosen, where the candidates
    are the row's own (``cap="row"``) or the most any row of its batch has
    (``cap="batch"``).  Rows left without a choice are dropped; they carry too
    little loss to be trained on.
    """
    found = df.withColumn("_valid", anchor_candidates(F.col("loss_mask"), block))
    count = F.size("_valid")
    if cap == "batch":
        most = F.max(count).over(Window.partitionBy(batch))
    elif cap == "row":
        most = count
    else:
        raise ValueError(f"unknown cap {cap!r}")
    # One digest of seed and key per row, whatever the key's type; positions are mixed with it.
    start = leading_number(seeded_hex(seed, F.col(key)), 8)
    limited = evaluate_once(
        found.withColumn("_n", F.least(F.lit(n), most - 1)).withColumn("_start", start)
    ).filter("_n > 0")
    # Hash and position in one number, which sorts without a comparator.
    drawn = evaluate_once(
        limited.withColumn(
            "_valid",
            F.transform(
                "_valid",
                lambda p: mix32(((p.cast("bigint") + 1) * 40503).bitwiseXOR(F.col("_start"))) * PLACES + p,
            ),
        )
    )
    chosen = F.array_sort(F.transform(smallest("_valid", F.col("_n")), lambda x: (x % PLACES).cast("int")))
    picked = drawn.withColumn("_a", chosen)
    return (
        picked.withColumn("anchors", pad_right(F.col("_a"), F.col("_n"), F.lit(0)))
        .withColumn("keep", pad_right(F.array_repeat(F.lit(1), F.size("_a")), F.col("_n"), F.lit(0)))
        .drop("_valid", "_n", "_a", "_start")
    )


def block_noise(ids: Column, block: int, mask_id: int) -> Column:
    """Every block's first token, all other places the mask id."""
    return F.transform(ids, lambda t, i: F.when(i % block == 0, t).otherwise(F.lit(mask_id)))


def block_noise_by_id(ids: Column, block_ids: Column, mask_id: int) -> Column:
    """As :func:`block_noise`, blocks given by runs of equal block ids."""
    before = shift(block_ids, 1, F.lit(None), left=False)
    return F.transform(
        F.arrays_zip(ids.alias("t"), block_ids.alias("b"), before.alias("p")),
        lambda x: F.when(~x["b"].eqNullSafe(x["p"]), x["t"]).otherwise(F.lit(mask_id)),
    )


def anchor_noise(ids: Column, anchors: Column, keep: Column, block: int, mask_id: int) -> Column:
    """One block per anchor: the anchor's token, then mask ids."""
    return F.flatten(
        F.transform(
            F.arrays_zip(anchors.alias("a"), keep.alias("k")),
            lambda x: F.concat(
                F.array(F.when(x["k"] == 1, F.get(ids, x["a"])).otherwise(F.lit(mask_id))),
                F.array_repeat(F.lit(mask_id), block - 1),
            ),
        )
    )


def block_positions(anchors: Column, block: int) -> Column:
    """Absolute positions of all blocks, one after the other."""
    return F.flatten(F.transform(anchors, lambda a: F.sequence(a, a + (block - 1))))


def block_labels(df: DataFrame, key: str, block: int, gamma: float | None = None) -> DataFrame:
    """``key, anchor_no, k, label, weight, decayed``: what each block place predicts.

    The weight is 1 for kept anchors, in range, past the anchor itself, where
    the loss mask is 1.  With ``gamma`` later places fade exponentially.
    """
    k = F.col("k")
    at = F.col("a.a") + k
    size = F.size("input_ids")
    safe = F.least(at, size - 1)
    weight = F.when(
        (F.col("a.k") == 1) & (at < size) & (k > 0), F.get(F.col("loss_mask"), safe)
    ).otherwise(0)
    decay = F.lit(1.0) if not gamma else F.exp(-F.greatest(k - 1, F.lit(0)) / F.lit(float(gamma)))
    blocks = F.arrays_zip(F.col("anchors").alias("a"), F.col("keep").alias("k"))
    return (
        explode_rows(df, blocks, key, "input_ids", "loss_mask", pos="anchor_no", item="a")
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("k"))
        .select(
            key,
            "anchor_no",
            "k",
            F.get(F.col("input_ids"), safe).alias("label"),
            weight.alias("weight"),
            (weight * decay).alias("decayed"),
        )
    )


def concat_features(df: DataFrame, *vectors: str) -> DataFrame:
    """Captured layer vectors side by side, as ``feature``."""
    return df.withColumn("feature", F.concat(*vectors))
