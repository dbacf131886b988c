"""Regenerating the assistant's side of conversations with a model."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdraft.functions.hashing import seeded_fraction
from sparkdraft.functions.text import word_count
from sparkdraft.operators.rowindex import running_totals
from sparkdraft.session import stored

# Messages of rejected rows and the weights of the effort choice.
STARTS_WITH_ASSISTANT = "Data starts with an assistant message"
INVALID_ROLE = "Invalid message role: "
EFFORT_WEIGHTS = {"low": 4, "medium": 4, "high": 2}

Responder = Callable[[list[dict], dict], dict]

# What a request may carry, its type and bounds (exclusive lower, inclusive upper).
PARAMETERS: dict[str, tuple[str, float | None, float | None]] = {
    "model": ("string", None, None),
    "temperature": ("double", None, 1.0),
    "max_tokens": ("bigint", 0, None),
    "top_p": ("double", None, None),
    "top_k": ("bigint", None, None),
    "presence_penalty": ("double", None, None),
    "reasoning_effort": ("string", None, None),
    "endpoint": ("string", None, None),
}
DEFAULTS = {"max_tokens": 4096, "temperature": 0.7}


def request_parameters(**given) -> Column:
    """The parameters of a row's requests as one struct; values are constants or columns.

    Constants are checked against :data:`PARAMETERS` when the plan is made.
    Parameters that are not given are null, and are not sent.
    """
    unknown = set(given) - set(PARAMETERS)
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    values = {**DEFAULTS, **given}
    if values.get("model") is None:
        raise ValueError("a request needs a model")
    fields = []
    for name, (kind, above, most) in PARAMETERS.items():
        value = values.get(name)
        if not isinstance(value, Column) and value is not None:
            if (above is not None and value <= above) or (most is not None and value > most):
                raise ValueError(f"{name} is out of bounds: {value!r}")
            if name == "temperature" and value < 0:
                raise ValueError(f"{name} is out of bounds: {value!r}")
        fields.append((value if isinstance(value, Column) else F.lit(value)).cast(kind).alias(name))
    return F.struct(*fields)


def turn_error(role: Column, turn: Column, failed: Column | None = None) -> Column:
    """Why a turn spoils its conversation, or null."""
    error = F.when((turn == 0) & (role == "assistant"), F.lit(STARTS_WITH_ASSISTANT)).when(
        ~F.coalesce(role, F.lit("")).isin("system", "user", "assistant"),
        F.concat(F.lit(INVALID_ROLE), F.coalesce(role, F.lit("null"))),
    )
    return error if failed is None else error.when((role == "user") & failed.isNotNull(), failed)


def conversation_status(turns: DataFrame, failed: Column | None = None) -> DataFrame:
    """``conv_id, status, error``: the earliest error of each conversation decides.

    A minimum per conversation, combined before the shuffle.
    """
    error = turn_error(F.col("role"), F.col("turn"), failed)
    first = F.min(F.when(error.isNotNull(), F.struct(F.col("turn"), error.alias("error"))))
    return (
        turns.groupBy("conv_id")
        .agg(first.alias("_e"))
        .select(
            "conv_id",
            F.when(F.col("_e").isNull(), "success").otherwise("error").alias("status"),
            F.col("_e.error").alias("error"),
        )
    )


def plan_requests(turns: DataFrame) -> DataFrame:
    """One row per request: ``conv_id, turn, request, messages, chars``.

    Every user turn is a request.  Its context holds the system and user turns
    so far and an answer for each earlier request; the data's own assistant
    turns are dropped.  ``chars`` counts the known part of the context.
    """
    said = F.col("role").isin("system", "user")
    counted = running_totals(
        turns.select("conv_id", "turn", "role", F.length("text").alias("_len")),
        "conv_id",
        "turn",
        {
            "request": (F.col("role") == "user").cast("bigint"),
            "_said": said.cast("bigint"),
            "_chars": F.when(said, F.col("_len")).otherwise(0).cast("bigint"),
        },
    )
    return counted.filter("role = 'user'").select(
        "conv_id",
        "turn",
        "request",
        (F.col("_said") + 1 + F.col("request")).alias("messages"),
        (F.col("_chars") + F.col("_len")).alias("chars"),
    )


def request_messages(turns: DataFrame) -> DataFrame:
    """The requests as a linked table: ``conv_id, request, previous, place, turn, role, text``.

    One row per system or user turn, filed under the request that sends it first: the
    next user turn, or its own.  ``place`` is its place among all messages of the
    request's context.  ``previous`` is the request whose context and answer come
    before (null for the first), so no row is copied from request to request.  System
    turns after the last user turn belong to no request.
    """
    counted = running_totals(
        turns.filter(F.col("role").isin("system", "user")).select("conv_id", "turn", "role", "text"),
        "conv_id",
        "turn",
        {"request": (F.col("role") == "user").cast("bigint"), "_said": F.lit(1).cast("bigint")},
    )
    asked = turns.filter("role = 'user'").groupBy("conv_id").agg(F.count("*").alias("_asked"))
    return counted.join(asked, "conv_id").filter("request < _asked").select(
        "conv_id",
        "request",
        F.when(F.col("request") > 0, F.col("request") - 1).alias("previous"),
        # Each earlier request has had its answer.
        (F.col("_said") + F.col("request")).alias("place"),
        "turn",
        "role",
        "text",
    )


def request_context(messages: DataFrame, wanted: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """All messages of the ``wanted(conv_id, request)``: ``conv_id, request, place, role, text``.

    The links of the linked table are followed by pointer doubling: in each round what is
    known of a request grows by what is known of the one it points to, so that the
    longest conversation takes the logarithm of its requests in rounds.  ``answers``
    (``conv_id, request, text``) are the replies to earlier requests; without them
    their places are left out.
    """
    links = messages.select("conv_id", "request", "previous").distinct()
    # A request reaches itself, and over its pointer the requests at ever greater distance.
    reach = wanted.select("conv_id", "request", F.col("request").alias("at"))
    jump = links.filter("previous is not null").select("conv_id", F.col("request").alias("at"), F.col("previous").alias("to"))
    while not jump.isEmpty():
        further = reach.join(jump, ["conv_id", "at"]).select("conv_id", "request", F.col("to").alias("at"))
        reach = stored(reach.unionByName(further), "reach")
        onward = jump.select("conv_id", F.col("at").alias("to"), F.col("to").alias("far"))
        jump = stored(jump.join(onward, ["conv_id", "to"]).select("conv_id", "at", F.col("far").alias("to")), "jumps")
    said = messages.select("conv_id", F.col("request").alias("at"), "place", "role", "text")
    if answers is not None:
        after = messages.filter("role = 'user'").select("conv_id", "request", (F.col("place") + 1).alias("place"))
        replies = answers.join(after, ["conv_id", "request"]).select(
            # A reply is part of the context of the requests after its own.
            "conv_id", (F.col("request") + 1).alias("at"), "place", F.lit("assistant").alias("role"), "text"
        )
        said = said.unionByName(replies)
    return reach.join(said, ["conv_id", "at"]).select("conv_id", "request", "place", "role", "text")


class _Talk:
    """One conversation under way: its context so far, and why it ended."""

    def __init__(self, responder: Responder, params: dict):
        self.responder, self.params = responder, params
        self.context: list[dict] = []
        self.error: str | None = None
        self.begun = False

    def hear(self, role: str | None, content: str | None) -> dict | None:
        """Take one message of the data; the model's reply if it is the user's."""
        if self.error is not None:
            return None
        first, self.begun = not self.begun, True
        if role == "assistant":
            self.error = STARTS_WITH_ASSISTANT if first else None
            return None
        if role not in ("system", "user"):
            self.error = f"{INVALID_ROLE}{'null' if role is None else role}"
            return None
        self.context.append({"role": role, "content": content})
        if role == "system":
            return None
        try:
            given = self.responder(list(self.context), self.params)
            reply = {"content": given["content"], "thinking": given.get("thinking")}
        except KeyError as e:
            self.error = f"the reply has no {e.args[0]}" if e.args else "the reply is incomplete"
            return None
        except Exception as e:  # any failure of the model ends the conversation as an error
            self.error = str(e)
            return None
        self.context.append({"role": "assistant", **reply})
        return reply


_REPLY = "struct<content:string,thinking:string>"


def regenerate(df: DataFrame, responder: Responder, params: Column, concurrency: int = 1) -> DataFrame:
    """Answer every user message of nested ``conversations`` anew.

    All columns and message fields are kept; ``status`` and ``error`` are added,
    and ``thinking`` to the messages.  ``responder(messages, params)`` returns
    ``{"content": ..., "thinking": ...}`` and may raise, which makes an error row
    with the messages as they were.  ``params`` is a struct as
    :func:`request_parameters` makes it; a task works on ``concurrency``
    conversations at a time, as waiting for a model costs no CPU.  Only roles,
    contents and parameters go to Python.  Conversations too long to be one row
    go through :func:`regenerate_turns`.
    """
    element = df.schema["conversations"].dataType.elementType
    names = [f.name for f in element.fields]

    def talk(roles, contents, own: str) -> tuple:
        talk = _Talk(responder, json.loads(own))
        replies = [talk.hear(r, c) for r, c in zip(roles, contents)]
        return [r and {"content": r["content"], "thinking": r["thinking"]} for r in replies], talk.error

    def run(roles: pd.Series, contents: pd.Series, own: pd.Series) -> pd.DataFrame:
        with ThreadPoolExecutor(concurrency) as pool:
            found = list(pool.map(talk, roles, contents, own))
        return pd.DataFrame(found, columns=["replies", "error"])

    def message(m: Column) -> Column:
        kept = [m[n].alias(n) for n in names if n != "thinking"]
        own = m["thinking"].cast("string") if "thinking" in names else F.lit(None).cast("string")
        return F.struct(*kept, own.alias("thinking"))

    def answer(r: Column) -> Column:
        given = {"role": F.lit("assistant"), "content": r["content"]}
        fields = [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in element.fields if f.name != "thinking"]
        return F.struct(*fields, r["thinking"].alias("thinking"))

    talked = F.pandas_udf(run, f"replies array<{_REPLY}>, error string").asNondeterministic()
    column = F.coalesce(F.col("conversations"), F.array().cast(df.schema["conversations"].dataType))
    # As JSON, which leaves out what is not given and keeps whole numbers whole.
    heard = [F.transform(column, lambda m: m["role"]), F.transform(column, lambda m: m["content"])]
    found = df.withColumn("_found", talked(*heard, F.to_json(params)))
    pairs = F.filter(
        F.arrays_zip(column.alias("m"), F.col("_found.replies").alias("r")), lambda x: x["m"]["role"] != "assistant"
    )
    anew = F.flatten(
        F.transform(
            pairs,
            lambda x: F.when(x["r"].isNull(), F.array(message(x["m"]))).otherwise(
                F.array(message(x["m"]), answer(x["r"]))
            ),
        )
    )
    failed = F.col("_found.error").isNotNull()
    return found.select(
        *[F.col(c) for c in df.columns if c not in ("conversations", "status", "error")],
        F.when(failed, F.transform(column, message)).otherwise(anew).alias("conversations"),
        F.when(failed, "error").otherwise("success").alias("status"),
        F.col("_found.error").alias("error"),
    )


def regenerate_turns(turns: DataFrame, responder: Responder, params: Column) -> DataFrame:
    """The same over exploded turns, for conversations of any length.

    ``conv_id, turn, role, text, thinking, error``: the system and user turns as
    they stand, each answer under the turn it answers, and at most one row with
    an ``error``, where its conversation ended.  The turns of a conversation
    follow each other through one task, which holds its context and no more.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select(
        F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text",
        F.to_json(params).alias("params"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, talk = object(), None
        for batch in batches:
            out = []
            for key, turn, role, text, own in batch.itertuples(index=False, name=None):
                if key != name:
                    name, talk = key, _Talk(responder, json.loads(own))
                if talk.error is not None:
                    continue
                reply = talk.hear(role, text)
                if talk.error is not None:
                    out.append((key, turn, role, text, None, talk.error))
                elif role != "assistant":
                    out.append((key, turn, role, text, None, None))
                if reply is not None:
                    out.append((key, turn, "assistant", reply["content"], reply["thinking"], None))
            yield pd.DataFrame(out, columns=["conv_id", "turn", "role", "text", "thinking", "error"])

    done = (
        rows.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn")
        .mapInPandas(run, "conv_id string, turn bigint, role string, text string, thinking string, error string")
    )
    return done.withColumn("conv_id", F.col("conv_id").cast(kind))


def route_turns(regenerated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(turns of conversations without an error, conv_id and error of the others)``."""
    failed = regenerated.filter("error is not null").select("conv_id", "error")
    return regenerated.join(failed, "conv_id", "left_anti").drop("error"), failed


def route(regenerated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(success, error)`` rows."""
    return regenerated.filter("status = 'success'"), regenerated.filter("status = 'error'")


def weighted_choice(key: Column, weights: dict[str, int] = EFFORT_WEIGHTS, seed: int = 42) -> Column:
    """One of the names, with probability in proportion to its weight."""
    total = sum(weights.values())
    share = seeded_fraction(seed, key)
    choice, below = None, 0
    names = list(weights)
    for name in names[:-1]:
        below += weights[name]
        hit = share < F.lit(below / total)
        choice = F.when(hit, name) if choice is None else choice.when(hit, name)
    return F.lit(names[-1]) if choice is None else choice.otherwise(names[-1])


def assign_endpoint(index: Column, addresses: list[str]) -> Column:
    """Addresses dealt out in turn."""
    if not addresses:
        raise ValueError("no address is available")
    return F.get(F.array(*[F.lit(a) for a in addresses]), F.pmod(index, F.lit(len(addresses))).cast("int"))


def context_length(conversation: Column) -> Column:
    """Words over all messages of a nested conversation.

    Content that is the JSON text of a list counts its ``text`` parts.
    """

    def words(m):
        content = m["content"]
        parts = F.from_json(content, "array<struct<text:string>>")
        listed = F.aggregate(
            F.coalesce(parts, F.array().cast("array<struct<text:string>>")),
            F.lit(0),
            lambda a, p: a + F.coalesce(word_count(p["text"]), F.lit(0)),
        )
        return F.when(content.rlike(r"^\s*\[") & parts.isNotNull(), listed).otherwise(
            F.coalesce(word_count(content), F.lit(0))
        )

    return F.aggregate(conversation, F.lit(0), lambda a, m: a + words(m))


def turn_context_length(turns: DataFrame) -> DataFrame:
    """``conv_id, context_length`` from exploded turns."""
    return turns.groupBy("conv_id").agg(
        F.sum(F.coalesce(word_count(F.col("text")), F.lit(0))).cast("bigint").alias("context_length")
    )


def context_stats(lengths: DataFrame, column: str = "context_length") -> DataFrame:
    """One row: count, shortest, longest, sum and mean."""
    x = F.col(column)
    return lengths.agg(
        F.count(x).alias("n"),
        F.min(x).alias("shortest"),
        F.max(x).alias("longest"),
        F.sum(x).cast("bigint").alias("total"),
        F.try_divide(F.sum(x).cast("double"), F.count(x).cast("double")).alias("mean"),
    )


def run_summary(status: DataFrame, earlier: int = 0) -> DataFrame:
    """One row: rows done earlier, now, successes, failures and the total."""
    now = status.agg(
        F.count_if(F.col("status") == "success").alias("success"),
        F.count_if(F.col("status") == "error").alias("failed"),
    )
    done = F.col("success") + F.col("failed")
    return now.select(
        F.lit(earlier).cast("bigint").alias("earlier"),
        "success",
        "failed",
        done.alias("processed"),
        (done + earlier).alias("total"),
    )
