"""Queries over training metrics and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdraft.functions.rows import explode_rows
from sparkdraft.operators import sequence as SQ
from sparkdraft.operators import training_metrics as TM
from sparkdraft.plans.corpus import metric_long
from sparkdraft.plans.registry import QUERIES, Tables, query
from sparkdraft.plans.shaping import BLOCK, LABEL_SQL, anchored

TARGET_IDS = 64

# The whole embedding serves as target logits over 64 ids, of which 43 are kept; read
# backwards, its places at the kept ids serve as the draft's logits over these.
POSITIONS_SQL = """
    positions as (
        select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as target,
               list_transform(list_filter(list_reverse(embedding), lambda x, i: (i - 1) % 3 <> 1),
                              lambda x: cast(x as double)) as logits,
               cast(vec_id % 4 <> 0 as int) as loss_mask
        from embeddings),
    kept as (
        select *, list_filter(target, lambda x, i: (i - 1) % 3 <> 1) as kl,
               list_position(target, list_max(target)) - 1 as best from positions),
    masked as (
        select *, cast(best % 3 <> 1 as int) * loss_mask as position_mask,
               list_transform(kl, lambda x: exp(x - list_max(kl))) as ex from kept),
    dist as (select *, list_transform(ex, lambda x: x / list_sum(ex)) as p from masked)
"""


def positions(t: Tables) -> DataFrame:
    rows = t.embeddings.select(
        "vec_id",
        "label",
        F.col("embedding").alias("target"),
        F.filter(F.reverse("embedding"), lambda x, i: i % 3 != 1).alias("logits"),
        (F.col("vec_id") % 4 != 0).cast("int").alias("loss_mask"),
    )
    flags = t.spark.range(TARGET_IDS).select(
        F.col("id").alias("token_id"), (F.col("id") % 3 != 1).alias("in_draft")
    )
    return TM.target_distribution(rows, TM.flag_list(flags))


@query(
    "target_softmax",
    f"""
    with {POSITIONS_SQL}
    select vec_id, position_mask, cast(i - 1 as int) as place, round(p[i], 6) as p
    from dist, unnest(range(1, len(p) + 1)) as u(i)
    """,
)
def target_softmax(t: Tables) -> DataFrame:
    spread = explode_rows(
        positions(t), F.col("target_p"), "vec_id", "position_mask", pos="place", item="p"
    )
    return spread.withColumn("p", F.round("p", 6))


@query(
    "masked_accuracy",
    f"""
    with {POSITIONS_SQL},
    hits as (select label, loss_mask, cast(list_position(logits, list_max(logits)) = list_position(p, list_max(p)) as int)
                    * position_mask as hit from dist)
    select label, cast(sum(hit) as bigint) as correct, cast(sum(loss_mask) as bigint) as counted,
           sum(hit) / greatest(sum(loss_mask), 1e-6) as accuracy
    from hits group by label
    """,
)
def masked_accuracy(t: Tables) -> DataFrame:
    return TM.masked_accuracy(positions(t), by=("label",))


@query(
    "soft_ce",
    f"""
    with {POSITIONS_SQL},
    norms as (select *, list_max(logits) as top,
                     ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))))) as lse from dist),
    dots as (select label, position_mask * list_sum(list_transform(p, lambda x, i: x * (logits[i] - top - lse))) as d
             from norms)
    select label, round(-avg(d), 6) as loss from dots group by label
    """,
)
def soft_ce(t: Tables) -> DataFrame:
    return TM.soft_cross_entropy(positions(t), by=("label",)).withColumn("loss", F.round("loss", 6))


@query(
    "step_loss",
    """
    select event_id // 7 as step, round(sum(pow(0.8, event_id % 7) * value) / 4, 6) as loss
    from events group by 1
    """,
)
def step_loss(t: Tables) -> DataFrame:
    losses = t.events.select(
        F.floor(F.col("event_id") / 7).alias("step"),
        (F.col("event_id") % 7).alias("position"),
        F.col("value").alias("loss"),
    )
    return TM.step_loss(losses, ("step",), accumulation=4).withColumn("loss", F.round("loss", 6))


@query(
    "block_ce",
    f"""
    with {LABEL_SQL},
    scored as (
        select *, (label + k) / 10.0 as loss, weight * exp(-greatest(k - 1, 0) / 4.0) as decayed,
               (sample + k) % 2 = 0 as right_guess
        from labels_of)
    select anchor_no, round(sum(loss * decayed) / (sum(decayed) + 1e-6), 6) as loss,
           round(count(*) filter (where weight = 1 and right_guess) / (sum(weight) + 1e-6), 6) as accuracy
    from scored group by anchor_no
    """,
)
def block_ce(t: Tables) -> DataFrame:
    labels = SQ.block_labels(anchored(t), "sample", BLOCK, gamma=4.0)
    wrong = (F.col("sample") + F.col("k")) % 2
    scored = labels.withColumn("loss", (F.col("label") + F.col("k")) / 10).withColumn("pred", F.col("label") + wrong)
    out = TM.block_loss(scored, ("anchor_no",))
    return out.select("anchor_no", F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"))


LOG_SQL = f"log as ({QUERIES['metric_long'].sql})"


@query(
    "metric_avg",
    f"with {LOG_SQL} select mode, name, round(avg(value), 6) as value, count(*) as n from log group by mode, name",
)
def metric_avg(t: Tables) -> DataFrame:
    return TM.average_metrics(metric_long(t), ("mode", "name")).withColumn("value", F.round("value", 6))


@query(
    "log_interval",
    f"with {LOG_SQL} select run, mode, step // 2 as step, name, value from log where step % 10 = 0",
)
def log_interval(t: Tables) -> DataFrame:
    return TM.thin_log(metric_long(t), interval=5, accumulation=2)


@query(
    "metric_windows",
    """
    select cast(date_trunc('hour', ts) as varchar) as window_start, event_type as name, count(*) as n, min(value) as low, max(value) as high
    from events group by 1, 2
    """,
)
def metric_windows(t: Tables) -> DataFrame:
    windows = TM.metric_windows(t.events.withColumnRenamed("event_type", "name"))
    return windows.withColumn("window_start", F.col("window_start").cast("string"))


@query(
    "accept_prefix",
    """
    with pairs as (
        select conv_id, list_transform(range(1, 9), lambda i:
                   cast(('0x' || md5(cast(conv_id as varchar))[i]) as int) % 2
                   = cast(('0x' || md5(cast(conv_id + 1 as varchar))[i]) as int) % 2) as same
        from conversations where turn = 0)
    select conv_id, cast(coalesce(nullif(list_position(same, false), 0) - 1, 8) as int) as accepted,
           cast(coalesce(nullif(list_position(same, false), 0) - 1, 8) + 1 as int) as tokens
    from pairs
    """,
)
def accept_prefix(t: Tables) -> DataFrame:
    def parities(text):
        digits = F.split(F.substring(F.md5(text.cast("string")), 1, 8), "")
        return F.transform(digits, lambda d: F.conv(d, 16, 10).cast("int") % 2)

    accepted = TM.accepted_prefix(parities(F.col("conv_id")), parities(F.col("conv_id") + 1))
    heads = t.conversations.filter("turn = 0")
    return heads.select("conv_id", accepted.alias("accepted"), (accepted + 1).alias("tokens"))
