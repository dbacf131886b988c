"""Queries over sequence shaping and the sample store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdraft.functions.arrays import shift
from sparkdraft.functions.text import digest
from sparkdraft.operators import sequence as SQ
from sparkdraft.operators.sampling import skip_existing, skip_existing_bucketed
from sparkdraft.plans.corpus import SEQ_SQL, word_sequences
from sparkdraft.plans.registry import Tables, query
from sparkdraft.session import shared_folder
from sparkdraft.sources.files import save_bucketed

#: Buckets of the stored samples; a table of 100 TB would take some 100,000.
BUCKETS = 16


def md5_sql(items: str) -> str:
    return f"md5(array_to_string({items}, ','))"


@query(
    "truncate_close",
    f"""
    with {SEQ_SQL}, cut as (select sample, ids[:128] as ids, mask[:128] as mask from seqs)
    select sample, cast(len(ids) as int) as n, {md5_sql('ids')} as ids_md5,
           {md5_sql('list_concat(mask[:len(mask) - 1], [0])')} as mask_md5, cast(len(ids) as int) as attended
    from cut
    """,
)
def truncate_close(t: Tables) -> DataFrame:
    return SQ.truncate_and_close(word_sequences(t.spread_documents), 128).select(
        "sample",
        F.size("input_ids").alias("n"),
        digest(F.col("input_ids")).alias("ids_md5"),
        digest(F.col("loss_mask")).alias("mask_md5"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("attended"),
    )


SHARDS, OVERLAP, LIMIT = 4, 3, 512


@query(
    "overlap_shard",
    f"""
    with {SEQ_SQL},
    sized as (select *, least(len(ids), {LIMIT}) as n from seqs),
    chunks as (
        select *, cast((n + {SHARDS - 1}) // {SHARDS} as int) as chunk, ids[:n] as ids0,
               list_concat(mask[:n - 1], [0]) as mask0 from sized),
    parts as (
        select *, greatest(least(r * chunk + chunk + {OVERLAP}, n) - r * chunk, 0) as valid, chunk + {OVERLAP} as width
        from chunks, unnest(range(0, {SHARDS})) as u(r))
    select sample, cast(r as int) as shard, chunk,
           {md5_sql('list_concat(ids0[r * chunk + 1 : r * chunk + valid], repeat([0], width - valid))')} as ids_md5,
           {md5_sql('list_concat(mask0[r * chunk + 1 : r * chunk + valid], repeat([0], width - valid))')} as mask_md5,
           cast(valid as int) as attended
    from parts
    """,
)
def overlap_shard(t: Tables) -> DataFrame:
    return SQ.overlap_shards(word_sequences(t.spread_documents), LIMIT, SHARDS, OVERLAP).select(
        "sample",
        "shard",
        "chunk",
        digest(F.col("input_ids")).alias("ids_md5"),
        digest(F.col("loss_mask")).alias("mask_md5"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("attended"),
    )


@query(
    "shard_positions",
    f"""
    with {SEQ_SQL}, sized as (
        select sample, cast((least(len(ids), {LIMIT}) + {SHARDS - 1}) // {SHARDS} as int) * 2 as size from seqs)
    select sample, cast(ring as int) as ring, cast(ring * size as int) as first,
           cast(ring * size + size - 1 as int) as last, cast(size as int) as n
    from sized, unnest([0, 1]) as u(ring)
    """,
)
def shard_positions(t: Tables) -> DataFrame:
    length = F.least(F.size("input_ids"), F.lit(LIMIT))
    rings = word_sequences(t.spread_documents).select(
        "sample", F.ceil(length / SHARDS).cast("int").alias("chunk"), F.explode(F.array(F.lit(0), F.lit(1))).alias("ring")
    )
    places = rings.select(
        "sample", "ring", SQ.shard_positions(F.col("chunk"), F.col("ring"), SHARDS, ring_size=2).alias("p")
    )
    return places.select(
        "sample", "ring", F.get("p", F.lit(0)).alias("first"), F.try_element_at("p", F.lit(-1)).alias("last"), F.size("p").alias("n")
    )


BATCH = 8


@query(
    "batch_pad",
    f"""
    with {SEQ_SQL},
    sized as (
        select *, sample // {BATCH} as batch, max(len(ids)) over (partition by sample // {BATCH}) as longest,
               count(*) over (partition by sample // {BATCH}) as rows_in from seqs),
    full_batches as (select *, cast((longest + 3) // 4 * 4 as int) as width from sized where rows_in = {BATCH})
    select sample, batch, width as padded_length,
           {md5_sql('list_concat(ids, repeat([0], width - len(ids)))')} as ids_md5,
           {md5_sql('list_concat(mask, repeat([0], width - len(ids)))')} as mask_md5
    from full_batches
    """,
)
def batch_pad(t: Tables) -> DataFrame:
    padded = SQ.pad_batches(
        word_sequences(t.spread_documents), BATCH, index="sample", multiple=4, arrays=("input_ids", "loss_mask")
    )
    return padded.select(
        "sample",
        "batch",
        "padded_length",
        digest(F.col("input_ids")).alias("ids_md5"),
        digest(F.col("loss_mask")).alias("mask_md5"),
    )


@query(
    "batch_pad_rows",
    f"""
    with {SEQ_SQL},
    sized as (
        select *, sample // {BATCH} as batch, max(len(ids)) over (partition by sample // {BATCH}) as width from seqs)
    select sample, batch, cast(width as int) as padded_length,
           {md5_sql('list_concat(ids, repeat([0], width - len(ids)))')} as ids_md5
    from sized
    """,
)
def batch_pad_rows(t: Tables) -> DataFrame:
    """Padding of image rows: no rounding, and the last batch stays."""
    padded = SQ.pad_batches(
        word_sequences(t.spread_documents), BATCH, index="sample", arrays=("input_ids",), drop_last=False
    )
    return padded.select("sample", "batch", "padded_length", digest(F.col("input_ids")).alias("ids_md5"))


WORLD = 7


@query(
    "rank_round_robin",
    f"""
    with total as (select count(*) as n from documents),
    dealt as (
        select doc_id, doc_id as spot from documents
        union all
        select doc_id, doc_id + n from documents, total where doc_id < ({WORLD} - n % {WORLD}) % {WORLD})
    select doc_id, cast(spot % {WORLD} as int) as rank, spot // {WORLD} as slot from dealt
    """,
)
def rank_round_robin(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id")
    return SQ.assign_ranks(docs, WORLD, docs.agg(F.count("*")).scalar(), "round_robin", "doc_id")


@query(
    "rank_ranges",
    f"""
    with total as (select count(*) as n, count(*) // {WORLD} as size, count(*) % {WORLD} as extra from documents),
    starts as (select r, r * size + least(r, extra) as first, size + cast(r < extra as int) as len
               from total, unnest(range(0, {WORLD})) as u(r))
    select doc_id, cast(r as int) as rank, doc_id - first as slot
    from documents join starts on doc_id >= first and doc_id < first + len
    """,
)
def rank_ranges(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id")
    return SQ.assign_ranks(docs, WORLD, docs.agg(F.count("*")).scalar(), "ranges", "doc_id")


@query("resume_anti", "select vec_id, label from embeddings where vec_id not in (select doc_id from labels)")
def resume_anti(t: Tables) -> DataFrame:
    stored = t.labels.select(F.col("doc_id").alias("vec_id"))
    return skip_existing(t.embeddings.select("vec_id", "label"), stored, "vec_id")


@query("resume_anti_bucketed", "select vec_id, label from embeddings where vec_id not in (select doc_id from labels)")
def resume_anti_bucketed(t: Tables) -> DataFrame:
    """Wanted and stored samples, both kept in buckets by id."""
    name = f"resume_{uuid.uuid4().hex}"
    path = f"{shared_folder(t.spark)}/{name}"
    wanted = save_bucketed(t.embeddings.select("vec_id", "label"), f"{name}_wanted", f"{path}/wanted", "vec_id", BUCKETS)
    done = t.labels.select(F.col("doc_id").alias("vec_id"))
    stored = save_bucketed(done, f"{name}_stored", f"{path}/stored", "vec_id", BUCKETS)
    return skip_existing_bucketed(wanted, stored, "vec_id")


@query(
    "shift_left",
    f"with {SEQ_SQL} select sample, {md5_sql('list_concat(ids[2:], [0])')} as left_md5, "
    f"{md5_sql('list_concat([0], ids[:len(ids) - 1])')} as right_md5 from seqs",
)
def shift_left(t: Tables) -> DataFrame:
    zero = F.lit(0)
    return word_sequences(t.spread_documents).select(
        "sample",
        digest(shift(F.col("input_ids"), 1, zero)).alias("left_md5"),
        digest(shift(F.col("input_ids"), 1, zero, left=False)).alias("right_md5"),
    )


@query(
    "lookahead_steps",
    f"""
    with {SEQ_SQL}, steps as (select *, least(s, len(ids)) as k, s from seqs, unnest(range(0, 3)) as u(s))
    select sample, cast(s as int) as step, {md5_sql('list_concat(ids[k + 1:], repeat([0], k))')} as ids_md5,
           {md5_sql('list_concat(mask[k + 1:], repeat([0], k))')} as mask_md5,
           {md5_sql("list_concat(list_transform(ids[k + 1:], lambda x: x * 2), repeat([-1], k))")} as target_md5
    from steps
    """,
)
def lookahead_steps(t: Tables) -> DataFrame:
    rows = word_sequences(t.spread_documents).withColumn("target", F.transform("input_ids", lambda x: x * 2))
    return SQ.lookahead_steps(rows, 3, "target", F.lit(-1)).select(
        "sample",
        "step",
        digest(F.col("input_ids")).alias("ids_md5"),
        digest(F.col("loss_mask")).alias("mask_md5"),
        digest(F.col("target")).alias("target_md5"),
    )


BLOCK, ANCHORS, MASK_ID = 8, 16, 99
MIX_SQL = """
    hashed as (
        select *, (xor((p + 1) * 40503, start) & 2147483647) * 2654435761 & 4294967295 as h1 from candidates),
    mixed as (select *, (xor(h1 >> 16, h1) * 73244475) & 4294967295 as h2 from hashed),
    ranked as (select *, xor(h2 >> 16, h2) as h from mixed)
"""
ANCHOR_SQL = f"""
    {SEQ_SQL},
    candidates as (
        select sample, p, count(*) over (partition by sample) as n_valid,
               cast('0x' || substr(md5('42|' || sample), 1, 8) as bigint) as start
        from seqs, unnest(range(0, greatest(len(ids) - {BLOCK}, 0) + 1)) as u(p) where mask[p + 1] = 1),
    {MIX_SQL},
    picked as (
        select sample, p from ranked
        qualify row_number() over (partition by sample order by h, p) <= least({ANCHORS}, n_valid - 1)),
    anchored as (select sample, list(cast(p as int) order by p) as anchors from picked group by sample)
"""


def anchored(t: Tables) -> DataFrame:
    return SQ.sample_anchors(word_sequences(t.spread_documents), BLOCK, ANCHORS, "sample")


@query(
    "anchor_sample",
    f"""
    with {ANCHOR_SQL}
    select sample, array_to_string(anchors, ',') as anchors, cast(len(anchors) as int) as kept from anchored
    """,
)
def anchor_sample(t: Tables) -> DataFrame:
    return anchored(t).select(
        "sample",
        F.array_join("anchors", ",").alias("anchors"),
        F.aggregate("keep", F.lit(0), lambda a, x: a + x).alias("kept"),
    )


def _keyed_sql(key: str) -> str:
    """The same choice for another key of the rows."""
    return ANCHOR_SQL.replace("md5('42|' || sample)", f"md5('42|' || {key})")


@query(
    "anchor_text_key",
    f"""
    with {_keyed_sql("md5(cast(sample as varchar))")}
    select sample, array_to_string(anchors, ',') as anchors from anchored
    """,
)
def anchor_text_key(t: Tables) -> DataFrame:
    rows = word_sequences(t.spread_documents).withColumn("key", F.md5(F.col("sample").cast("string")))
    return SQ.sample_anchors(rows, BLOCK, ANCHORS, "key").select("sample", F.array_join("anchors", ",").alias("anchors"))


@query(
    "anchor_large_key",
    f"""
    with {_keyed_sql("(sample + 4000000000000000000)")}
    select sample, array_to_string(anchors, ',') as anchors from anchored
    """,
)
def anchor_large_key(t: Tables) -> DataFrame:
    rows = word_sequences(t.spread_documents).withColumn("key", F.col("sample") + 4_000_000_000_000_000_000)
    return SQ.sample_anchors(rows, BLOCK, ANCHORS, "key").select("sample", F.array_join("anchors", ",").alias("anchors"))


@query(
    "block_noise",
    f"""
    with {SEQ_SQL}
    select sample, {md5_sql(f"list_transform(ids, lambda x, i: case when (i - 1) % {BLOCK} = 0 then x else {MASK_ID} end)")}
           as noise_md5 from seqs
    """,
)
def block_noise(t: Tables) -> DataFrame:
    noise = SQ.block_noise(F.col("input_ids"), BLOCK, MASK_ID)
    return word_sequences(t.spread_documents).select("sample", digest(noise).alias("noise_md5"))


@query(
    "block_positions",
    f"""
    with {ANCHOR_SQL}
    select sample, array_to_string(flatten(list_transform(anchors, lambda a: range(a, a + {BLOCK}))), ',') as positions
    from anchored
    """,
)
def block_positions(t: Tables) -> DataFrame:
    places = SQ.block_positions(F.col("anchors"), BLOCK)
    return anchored(t).select("sample", F.array_join(places, ",").alias("positions"))


LABEL_SQL = f"""
    {ANCHOR_SQL},
    places as (
        select sample, cast(i - 1 as int) as anchor_no, cast(k as int) as k, anchors[i] + k as spot
        from anchored, unnest(range(1, len(anchors) + 1)) as u(i), unnest(range(0, {BLOCK})) as w(k)),
    labels_of as (
        select p.sample, anchor_no, k, ids[least(spot, len(ids) - 1) + 1] as label,
               cast(case when k > 0 and spot < len(ids) then mask[least(spot, len(ids) - 1) + 1] else 0 end as int) as weight
        from places p join seqs s on p.sample = s.sample)
"""


@query(
    "block_labels",
    f"""
    with {LABEL_SQL}
    select sample, anchor_no, k, cast(label as int) as label, weight,
           round(weight * exp(-greatest(k - 1, 0) / 4.0), 6) as decayed
    from labels_of
    """,
)
def block_labels(t: Tables) -> DataFrame:
    labelled = SQ.block_labels(anchored(t), "sample", BLOCK, gamma=4.0)
    return labelled.withColumn("decayed", F.round("decayed", 6))


@query(
    "feature_concat",
    """
    with joined as (select vec_id, list_concat(list_concat(embedding[43:], embedding[:21]), embedding[22:42]) as f
                    from embeddings)
    select vec_id, cast(i - 1 as int) as place, cast(f[i] as double) as value
    from joined, unnest(range(1, len(f) + 1)) as u(i)
    """,
)
def feature_concat(t: Tables) -> DataFrame:
    layers = t.embeddings.select(
        "vec_id",
        F.slice("embedding", 43, 22).alias("low"),
        F.slice("embedding", 1, 21).alias("middle"),
        F.slice("embedding", 22, 21).alias("high"),
    )
    joined = SQ.concat_features(layers, "low", "middle", "high")
    return joined.select("vec_id", F.posexplode("feature").alias("place", "value")).withColumn(
        "value", F.col("value").cast("double")
    )
