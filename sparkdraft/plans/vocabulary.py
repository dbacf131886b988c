"""Queries over the reduction of the target vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdraft.operators import vocab as V
from sparkdraft.operators.training_metrics import flag_list
from sparkdraft.plans.chat import DATASET_SQL, ID_SQL, training_rows
from sparkdraft.plans.registry import Tables, query

TARGET = 32768
DRAFT = 2048
#: A draft vocabulary larger than the ids in use, so that some are filled in.
WIDE = 32000

FREQ_SQL = f"""
    {DATASET_SQL},
    flat as (
        select conv_id, i, toks[i] as p, mask[i] = '1' as is_loss
        from dataset, unnest(range(1, len(toks) + 1)) as u(i)),
    freqs as (select {ID_SQL} as token_id, count(*) as freq from flat where is_loss group by 1)
"""


def kept_sql(size: int) -> str:
    return f"""
    {FREQ_SQL},
    missing as (
        select cast(id as int) as token_id from range({size}) as r(id)
        where id not in (select token_id from freqs) order by id
        limit greatest({size} - (select count(*) from freqs), 0)),
    filled as (select token_id, freq from freqs union all select token_id, 0 from missing),
    kept as (select token_id, freq from filled order by freq desc, token_id limit {size}),
    draft as (
        select cast(row_number() over (order by token_id) - 1 as int) as draft_id, token_id, freq from kept)
    """


def frequencies(t: Tables) -> DataFrame:
    return V.token_frequency(training_rows(t).select("input_ids", "loss_mask"))


@query("token_freq", f"with {FREQ_SQL} select token_id, freq from freqs")
def token_freq(t: Tables) -> DataFrame:
    return frequencies(t)


@query("topn_tokens", f"with {FREQ_SQL} select token_id, freq from freqs order by freq desc, token_id limit 100")
def topn_tokens(t: Tables) -> DataFrame:
    return frequencies(t).orderBy(F.desc("freq"), F.asc("token_id")).limit(100)


@query("vocab_fill", f"with {kept_sql(WIDE)} select token_id, freq from filled")
def vocab_fill(t: Tables) -> DataFrame:
    return V.fill_vocab(frequencies(t), WIDE)


@query(
    "draft_vocab",
    f'with {kept_sql(DRAFT)} select draft_id, token_id, token_id - draft_id as "offset", freq from draft',
)
def draft_vocab(t: Tables) -> DataFrame:
    return V.draft_vocab(frequencies(t), DRAFT)


@query(
    "vocab_coverage",
    f"""
    with {kept_sql(DRAFT)}
    select cast((select sum(freq) from kept) as bigint) as kept, cast(sum(freq) as bigint) as total,
           (select sum(freq) from kept) / sum(freq) as ratio from freqs
    """,
)
def vocab_coverage(t: Tables) -> DataFrame:
    return V.coverage(frequencies(t), DRAFT)


@query("d2t", f'with {kept_sql(DRAFT)} select draft_id, token_id - draft_id as "offset" from draft')
def d2t(t: Tables) -> DataFrame:
    return V.draft_vocab(frequencies(t), DRAFT).select("draft_id", "offset")


@query(
    "t2d",
    f"""
    with {kept_sql(DRAFT)}
    select cast(id as int) as token_id, id in (select token_id from draft) as in_draft from range({TARGET}) as r(id)
    """,
)
def t2d(t: Tables) -> DataFrame:
    return V.target_flags(V.draft_vocab(frequencies(t), DRAFT), TARGET)


@query(
    "apply_vocab",
    f"""
    with {kept_sql(DRAFT)}
    select conv_id, count(*) as positions, cast(count_if({ID_SQL} in (select token_id from draft) and is_loss) as bigint) as kept
    from flat group by conv_id
    """,
)
def apply_vocab(t: Tables) -> DataFrame:
    rows = training_rows(t).select("conv_id", "input_ids", "loss_mask")
    draft = V.draft_vocab(V.token_frequency(rows), DRAFT)
    masked = V.position_masks(rows, flag_list(V.target_flags(draft, TARGET)))
    return masked.select(
        "conv_id",
        F.size("input_ids").cast("bigint").alias("positions"),
        F.aggregate("position_masks", F.lit(0).cast("bigint"), lambda a, m: a + m).alias("kept"),
    )


@query(
    "draft_to_target",
    f"with {kept_sql(DRAFT)} select vec_id, vec_id * 31 % {DRAFT} as draft_id, d.token_id "
    f"from embeddings e join draft d on d.draft_id = e.vec_id * 31 % {DRAFT}",
)
def draft_to_target(t: Tables) -> DataFrame:
    drafted = t.embeddings.select("vec_id", (F.col("vec_id") * 31 % DRAFT).alias("draft_id"))
    maps = V.draft_vocab(frequencies(t), DRAFT)
    return V.to_target(drafted, maps, DRAFT).select("vec_id", "draft_id", F.col("token_id").cast("int").alias("token_id"))
