"""Queries over the regeneration of answers."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdraft.functions.text import WORD
from sparkdraft.operators import regen as RG
from sparkdraft.operators.rowindex import with_row_index
from sparkdraft.operators.sampling import skip_existing
from sparkdraft.plans.chat import MESSY_SQL, lit, messy_turns
from sparkdraft.plans.registry import Tables, query


@query(
    "regen_plan",
    """
    select conv_id, turn, count(*) filter (where role = 'user') over w - 1 as request,
           count(*) filter (where role in ('system', 'user')) over w
               + count(*) filter (where role = 'user') over w - 1 as messages,
           cast(sum(case when role in ('system', 'user') then length(text) else 0 end) over w as bigint) as chars
    from conversations window w as (partition by conv_id order by turn)
    qualify role = 'user'
    """,
)
def regen_plan(t: Tables) -> DataFrame:
    return RG.plan_requests(t.conversations)


MESSAGES_SQL = """
    told as (
        select conv_id, turn, role, text, count(*) filter (where role = 'user') over before as request,
               count(*) over before as said, count(*) filter (where role = 'user') over (partition by conv_id) as asked
        from conversations where role in ('system', 'user')
        window before as (partition by conv_id order by turn rows between unbounded preceding and 1 preceding)),
    messages as (
        select conv_id, request, case when request > 0 then request - 1 end as previous, said + request as place,
               turn, role, text
        from told where request < asked)
"""


@query(
    "regen_messages",
    f"with {MESSAGES_SQL} select conv_id, request, previous, place, turn, role, md5(text) as text_md5 from messages",
)
def regen_messages(t: Tables) -> DataFrame:
    return RG.request_messages(t.conversations).select(
        "conv_id", "request", "previous", "place", "turn", "role", F.md5("text").alias("text_md5")
    )


@query(
    "regen_context",
    f"""
    with {MESSAGES_SQL}, wanted as (select conv_id, max(request) as request from messages group by conv_id),
    replies as (
        select conv_id, request + 1 as request, place + 1 as place, 'assistant' as role, 'answer ' || request as text
        from messages where role = 'user')
    select w.conv_id, w.request, m.place, m.role, md5(m.text) as text_md5
    from wanted w join (select conv_id, request, place, role, text from messages union all select * from replies) m
    on m.conv_id = w.conv_id and m.request <= w.request
    """,
)
def regen_context(t: Tables) -> DataFrame:
    """The whole context of each conversation's last request, with an answer to each earlier one."""
    messages = RG.request_messages(t.conversations)
    wanted = messages.groupBy("conv_id").agg(F.max("request").alias("request"))
    asked = messages.filter("role = 'user'").select("conv_id", "request")
    answers = asked.withColumn("text", F.concat(F.lit("answer "), F.col("request").cast("string")))
    return RG.request_context(messages, wanted, answers).select(
        "conv_id", "request", "place", "role", F.md5("text").alias("text_md5")
    )


STATUS_SQL = f"""
    {MESSY_SQL},
    judged as (
        select conv_id, turn,
               case when turn = 0 and role = 'assistant' then 'Data starts with an assistant message'
                    when coalesce(role, '') not in ('system', 'user', 'assistant')
                         then 'Invalid message role: ' || coalesce(role, 'null')
                    when role = 'user' and conv_id % 17 = 0 then 'unreachable' end as error
        from messy),
    status as (
        select conv_id, case when count(error) = 0 then 'success' else 'error' end as status,
               arg_min(error, turn) filter (where error is not null) as error
        from judged group by conv_id)
"""


def status_rows(t: Tables) -> DataFrame:
    failed = F.when(F.col("conv_id") % 17 == 0, "unreachable")
    return RG.conversation_status(messy_turns(t.conversations), failed)


@query("regen_status", f"with {STATUS_SQL} select conv_id, status, error from status")
def regen_status(t: Tables) -> DataFrame:
    return status_rows(t)


@query(
    "regen_summary",
    f"""
    with {STATUS_SQL}, n as (
        select count(*) filter (where status = 'success') as success, count(*) filter (where status = 'error') as failed
        from status)
    select cast(5 as bigint) as earlier, success, failed, success + failed as processed, success + failed + 5 as total from n
    """,
)
def regen_summary(t: Tables) -> DataFrame:
    return RG.run_summary(status_rows(t), earlier=5)


def digest_responder() -> RG.Responder:
    """A stand-in model: answers with a digest of its context."""

    def respond(messages: list[dict], params: dict) -> dict:
        if params["model"] in messages[-1]["content"]:
            raise RuntimeError("unreachable")
        text = "".join(m["content"] for m in messages)
        return {"content": hashlib.md5(text.encode()).hexdigest()}

    return respond


@query(
    "regen_apply",
    """
    with recursive users as (
        select conv_id, text, row_number() over (partition by conv_id order by turn) as n
        from conversations where role = 'user'),
    heads as (select conv_id, coalesce(max(text) filter (where role = 'system'), '') as sys
              from conversations group by conv_id),
    bad as (select conv_id from users group by conv_id having bool_or(contains(text, 'zz'))),
    chain as (
        select u.conv_id, n, sys || text as context, md5(sys || text) as answer
        from users u join heads using (conv_id) where n = 1
        union all
        select u.conv_id, u.n, c.context || c.answer || u.text, md5(c.context || c.answer || u.text)
        from chain c join users u on u.conv_id = c.conv_id and u.n = c.n + 1)
    select cast(c.conv_id as varchar) as id, cast(c.n - 1 as int) as request, answer
    from chain c anti join bad using (conv_id)
    """,
)
def regen_apply(t: Tables) -> DataFrame:
    params = RG.request_parameters(model="zz")
    success, _ = RG.route_turns(RG.regenerate_turns(t.conversations, digest_responder(), params))
    # An answer's request number is that of the user turn it stands under.
    numbered = RG.plan_requests(t.conversations).select("conv_id", "turn", F.col("request").cast("int").alias("request"))
    return success.filter("role = 'assistant'").join(numbered, ["conv_id", "turn"]).select(
        F.col("conv_id").cast("string").alias("id"), "request", F.col("text").alias("answer")
    )


FRACTION_SQL = "cast(('0x' || substr(md5('42|' || conv_id), 1, 8)) as bigint) / 4294967296.0"


@query(
    "weighted_choice",
    f"""
    select conv_id, case when {FRACTION_SQL} < 0.4 then 'low' when {FRACTION_SQL} < 0.8 then 'medium' else 'high' end
           as effort
    from conversations where turn = 0
    """,
)
def weighted_choice(t: Tables) -> DataFrame:
    heads = t.conversations.filter("turn = 0")
    return heads.select("conv_id", RG.weighted_choice(F.col("conv_id")).alias("effort"))


@query(
    "endpoint_assign",
    """
    select conv_id, ['a:1', 'b:2', 'c:3'][cast((row_number() over (order by conv_id) - 1) % 3 + 1 as int)] as address
    from conversations where turn = 0
    """,
)
def endpoint_assign(t: Tables) -> DataFrame:
    indexed = with_row_index(t.conversations.filter("turn = 0").select("conv_id"), "conv_id")
    return indexed.select("conv_id", RG.assign_endpoint(F.col("idx"), ["a:1", "b:2", "c:3"]).alias("address"))


@query(
    "regen_resume",
    "select conv_id from conversations where turn = 0 and conv_id not in (select doc_id from labels)",
)
def regen_resume(t: Tables) -> DataFrame:
    done = t.labels.select(F.col("doc_id").alias("conv_id"))
    return skip_existing(t.conversations.filter("turn = 0").select("conv_id"), done, "conv_id")


LENGTH_SQL = f"""
    lengths as (select conv_id, cast(sum(len(regexp_extract_all(text, {lit(WORD)}))) as bigint) as context_length
                from conversations group by conv_id)
"""


@query("context_len", f"with {LENGTH_SQL} select conv_id, context_length from lengths")
def context_len(t: Tables) -> DataFrame:
    return RG.turn_context_length(t.spread_conversations)


@query(
    "context_stats",
    f"""
    with {LENGTH_SQL}
    select count(*) as n, min(context_length) as shortest, max(context_length) as longest,
           cast(sum(context_length) as bigint) as total,
           cast(sum(context_length) as double) / count(*) as mean from lengths
    """,
)
def context_stats(t: Tables) -> DataFrame:
    return RG.context_stats(RG.turn_context_length(t.spread_conversations))
