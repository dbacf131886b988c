"""Sequence shaping and vocabulary reduction on small fixtures."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkdraft.functions.arrays import shift
from sparkdraft.operators import sequence as SQ
from sparkdraft.operators import vocab as V

SCHEMA = "id long, input_ids array<int>, loss_mask array<int>"


def random_rows(n, seed=0, longest=40):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = rng.randint(1, longest)
        rows.append((i, [rng.randint(0, 50) for _ in range(size)], [rng.randint(0, 1) for _ in range(size)]))
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(random_rows(60), SCHEMA).cache()


def test_truncate_and_close(rows):
    want = {i: (ids[:10], m[:10][:-1] + [0]) for i, ids, m in random_rows(60)}
    for r in SQ.truncate_and_close(rows, 10).collect():
        assert (r.input_ids, r.loss_mask) == want[r.id]
        assert r.attention_mask == [1] * len(r.input_ids)


@pytest.mark.parametrize("shards,overlap,limit", [(1, 0, 100), (4, 3, 100), (4, 1, 17), (3, 2, 1)])
def test_overlap_shards(rows, shards, overlap, limit):
    data = {i: (ids, m) for i, ids, m in random_rows(60)}
    for r in SQ.overlap_shards(rows, limit, shards, overlap).collect():
        ids, mask = data[r.id]
        n = min(limit, len(ids))
        chunk = math.ceil(n / shards)
        at, width = r["shard"] * chunk, chunk + overlap
        real = ids[:n][at : at + width]
        closed = (mask[:n][:-1] + [0])[at : at + width]
        pad = [0] * (width - len(real))
        assert r.input_ids == real + pad and r.loss_mask == closed + pad
        assert r.attention_mask == [1] * len(real) + pad


def test_shards_without_overlap_rejoin(rows):
    data = {i: ids for i, ids, _ in random_rows(60)}
    parts = {}
    for r in SQ.overlap_shards(rows, 1000, 3, 0).orderBy("id", "shard").collect():
        real = [x for x, a in zip(r.input_ids, r.attention_mask) if a]
        parts[r.id] = parts.get(r.id, []) + real
    assert parts == data


def test_shard_positions(spark):
    df = spark.range(1).select(SQ.shard_positions(F.lit(5), F.lit(1), shards=4, ring_size=2).alias("p"))
    assert df.first().p == list(range(10, 20))


def test_pad_batches(rows):
    data = {i: ids for i, ids, _ in random_rows(60)}
    out = SQ.pad_batches(rows, 8, "id", multiple=4, arrays=("input_ids", "loss_mask")).collect()
    assert len(out) == 56
    for r in out:
        members = [data[i] for i in range(r.batch * 8, r.batch * 8 + 8)]
        width = math.ceil(max(map(len, members)) / 4) * 4
        assert r.padded_length == width == len(r.input_ids) == len(r.loss_mask)
        assert r.input_ids[: len(data[r.id])] == data[r.id] and not any(r.input_ids[len(data[r.id]) :])
    assert SQ.pad_batches(rows, 8, "id", arrays=("input_ids",), drop_last=False).count() == 60


@pytest.mark.parametrize("n,world", [(10, 4), (12, 4), (3, 7), (1, 5), (20, 1)])
def test_round_robin_wraps_to_equal_shares(spark, n, world):
    each = math.ceil(n / world)
    order = list(range(n))
    while len(order) < each * world:
        order += order[: each * world - len(order)]
    want = sorted((r, s, order[r + s * world]) for r in range(world) for s in range(each))
    out = SQ.assign_ranks(spark.range(n).toDF("idx"), world, F.lit(n))
    assert sorted((r["rank"], r.slot, r.idx) for r in out.collect()) == want


@pytest.mark.parametrize("n,world", [(10, 4), (12, 4), (3, 7), (20, 1)])
def test_contiguous_ranges(spark, n, world):
    out = SQ.assign_ranks(spark.range(n).toDF("idx"), world, F.lit(n), "ranges").orderBy("idx").collect()
    sizes = Counter(r["rank"] for r in out)
    assert [sizes.get(r, 0) for r in range(world)] == [n // world + (r < n % world) for r in range(world)]
    assert [r["rank"] for r in out] == sorted(r["rank"] for r in out)
    for r in out:
        assert r.slot == r.idx - min(x.idx for x in out if x["rank"] == r["rank"])
    with pytest.raises(ValueError):
        SQ.assign_ranks(spark.range(1).toDF("idx"), 2, F.lit(1), "other")


def test_lookahead_and_shift(spark):
    df = spark.createDataFrame([(1, [1, 2, 3], [1, 1, 0])], SCHEMA).withColumn("t", F.array(F.lit(7), F.lit(8), F.lit(9)))
    got = {r.step: (r.input_ids, r.loss_mask, r.t) for r in SQ.lookahead_steps(df, 5, "t", F.lit(-1)).collect()}
    assert got[0] == ([1, 2, 3], [1, 1, 0], [7, 8, 9])
    assert got[1] == ([2, 3, 0], [1, 0, 0], [8, 9, -1])
    assert got[4] == ([0, 0, 0], [0, 0, 0], [-1, -1, -1])
    right = df.select(shift(F.col("input_ids"), 1, F.lit(0), left=False).alias("x")).first().x
    assert right == [0, 1, 2]


@pytest.mark.parametrize("cap", ["row", "batch"])
def test_anchors(rows, cap):
    data = {i: (ids, m) for i, ids, m in random_rows(60)}
    block, n = 4, 6
    valid = {i: [p for p in range(max(len(m) - block, 0) + 1) if m[p]] for i, (_, m) in data.items()}
    batched = rows.withColumn("batch", F.col("id") % 5)
    out = {r.id: r for r in SQ.sample_anchors(batched, block, n, "id", cap=cap, batch="batch").collect()}
    for i, places in valid.items():
        most = len(places) if cap == "row" else max(len(valid[j]) for j in valid if j % 5 == i % 5)
        size = min(n, most - 1)
        if size <= 0:
            assert i not in out
            continue
        r = out[i]
        kept = [a for a, k in zip(r.anchors, r.keep) if k]
        assert len(r.anchors) == len(r.keep) == size
        assert len(kept) == min(size, len(places)) and kept == sorted(set(kept)) and set(kept) <= set(places)
        assert r.keep == sorted(r.keep, reverse=True) and not any(r.anchors[len(kept) :])
    again = {r.id: r.anchors for r in SQ.sample_anchors(batched.repartition(3), block, n, "id", cap=cap, batch="batch").collect()}
    assert again == {i: r.anchors for i, r in out.items()}


def test_block_inputs(spark):
    df = spark.createDataFrame([(1, [10, 11, 12, 13, 14], [1, 1, 0, 1, 1])], SCHEMA)
    df = df.withColumn("b", F.array(*map(F.lit, [0, 0, 1, 1, 2]))).withColumn("a", F.array(F.lit(1), F.lit(3), F.lit(0)))
    df = df.withColumn("k", F.array(F.lit(1), F.lit(1), F.lit(0)))
    r = df.select(
        SQ.block_noise(F.col("input_ids"), 2, 99).alias("grid"),
        SQ.block_noise_by_id(F.col("input_ids"), F.col("b"), 99).alias("by_id"),
        SQ.anchor_noise(F.col("input_ids"), F.col("a"), F.col("k"), 2, 99).alias("anchored"),
        SQ.block_positions(F.col("a"), 2).alias("places"),
    ).first()
    assert r.grid == [10, 99, 12, 99, 14] and r.by_id == [10, 99, 12, 99, 14]
    assert r.anchored == [11, 99, 13, 99, 99, 99] and r.places == [1, 2, 3, 4, 0, 1]
    labels = SQ.block_labels(df.withColumnRenamed("a", "anchors").withColumnRenamed("k", "keep"), "id", 3, gamma=2.0)
    got = {(x.anchor_no, x.k): (x.label, x.weight, round(x.decayed, 6)) for x in labels.collect()}
    half = round(math.exp(-0.5), 6)
    assert got == {
        (0, 0): (11, 0, 0.0), (0, 1): (12, 0, 0.0), (0, 2): (13, 1, half),
        (1, 0): (13, 0, 0.0), (1, 1): (14, 1, 1.0), (1, 2): (14, 0, 0.0),
        (2, 0): (10, 0, 0.0), (2, 1): (11, 0, 0.0), (2, 2): (12, 0, 0.0),
    }


def plain_vocab(counts, size):
    """Kept ids: most frequent first, smaller id on ties, unused ids as filling."""
    filled = dict(counts)
    for i in range(size):
        if len(filled) >= size:
            break
        filled.setdefault(i, 0)
    return filled, sorted(sorted(filled, key=lambda t: (-filled[t], t))[:size])


@pytest.mark.parametrize("size", [1, 5, 20, 60])
def test_vocabulary_reduction(spark, rows, size):
    counts = Counter(t for _, ids, m in random_rows(60) for t, x in zip(ids, m) if x)
    freq = V.token_frequency(rows)
    assert {r.token_id: r.freq for r in freq.collect()} == counts
    filled, kept = plain_vocab(counts, size)
    assert {r.token_id: r.freq for r in V.fill_vocab(freq, size).collect()} == filled
    draft = V.draft_vocab(freq, size)
    got = sorted((r.draft_id, r.token_id, r.offset, r.freq) for r in draft.collect())
    assert got == [(d, t, t - d, filled[t]) for d, t in enumerate(kept)]
    flags = [r.in_draft for r in V.target_flags(draft, 64).orderBy("token_id").collect()]
    assert flags == [i in kept for i in range(64)] and sum(flags) == size
    c = V.coverage(freq, size).first()
    assert (c.kept, c.total) == (sum(filled[t] for t in kept), sum(counts.values()))
    assert c.ratio == pytest.approx(c.kept / c.total)


def test_vocab_mapping_is_stored_once(spark, rows, tmp_path):
    from sparkdraft.plans.dataset import vocab_mapping

    draft, flags = vocab_mapping(rows, 64, 10, str(tmp_path), data="d", template="qwen")
    kept = {r.token_id for r in draft.collect()}
    assert len(kept) == 10 and {r.token_id for r in flags.collect() if r.in_draft} == kept
    # Other rows under the same parameters: the stored maps are used.
    again, _ = vocab_mapping(rows.limit(0), 64, 10, str(tmp_path), data="d", template="qwen")
    assert {r.token_id for r in again.collect()} == kept
    other, _ = vocab_mapping(rows.limit(0), 64, 10, str(tmp_path), data="e", template="qwen")
    assert {r.token_id for r in other.collect()} == set(range(10))


def test_coverage_without_tokens(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert tuple(V.coverage(V.token_frequency(empty), 3).first()) == (0, 0, 0.0)
    assert V.draft_vocab(V.token_frequency(empty), 3).count() == 3


def test_anchor_seeds_are_independent(spark):
    rows = spark.createDataFrame([("a", [1] * 400, list(range(400)))], "id string, loss_mask array<int>, input_ids array<int>")
    picks = [set(SQ.sample_anchors(rows, 4, 60, "id", seed=s).first().anchors) for s in (42, 43, 44)]
    for first in picks:
        for second in picks:
            if first is not second:
                # Some 9 of 60 coincide by chance; a shifted copy would share nearly all.
                assert max(len({x + d for x in first} & second) for d in range(-20, 21)) < 35


@pytest.mark.parametrize("n", [1, 3, 40, 400])
def test_smallest_agrees_with_a_full_sort(spark, n):
    rng = random.Random(n)
    even = [rng.randrange(2**32) * SQ.PLACES + i for i in range(400)]
    crowded = [(2**32 - 1 - i) * SQ.PLACES + i for i in range(400)]
    df = spark.createDataFrame([(even,), (crowded,)], "v array<bigint>")
    got = [r.s for r in df.select(SQ.smallest("v", F.lit(n)).alias("s")).collect()]
    assert sorted(got) == sorted([sorted(even)[:n], sorted(crowded)[:n]])
