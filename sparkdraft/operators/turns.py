"""Conversations as exploded turns: ``conv_id, turn, role, text``.

``turn`` is the 0-based position in the conversation.  Nothing here gathers a
whole conversation: work that looks at neighbours is cut into chunks of turns,
so one conversation holding a large part of the data is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkdraft.operators.rowindex import CHUNK


def chunk_of(turn: Column, size: int = CHUNK) -> Column:
    return F.floor(turn / size)


def with_previous_role(turns: DataFrame, size: int = CHUNK) -> DataFrame:
    """Add ``chunk`` and ``prev_role``, the role one turn earlier.

    The last turn of a chunk is also sent to the next chunk, as its left
    neighbour, and dropped there afterwards.  One shuffle, groups of at most
    ``size + 1`` rows.
    """
    own = chunk_of(F.col("turn"), size)
    homes = F.when((F.col("turn") + 1) % size == 0, F.array(own, own + 1)).otherwise(F.array(own))
    framed = turns.withColumn("chunk", F.explode(homes))
    before = Window.partitionBy("conv_id", "chunk").orderBy("turn")
    return framed.withColumn("prev_role", F.lag("role").over(before)).filter(F.col("chunk") == own)


def with_neighbours(turns: DataFrame, size: int = CHUNK) -> DataFrame:
    """Add ``prev_role``, ``next_role`` and ``is_last``, over chunks with one turn more at either end."""
    own = chunk_of(F.col("turn"), size)
    place = F.pmod(F.col("turn"), F.lit(size))
    homes = (
        F.when(place == size - 1, F.array(own, own + 1)).when(place == 0, F.array(own, own - 1)).otherwise(F.array(own))
    )
    order = Window.partitionBy("conv_id", "_chunk").orderBy("turn")
    framed = turns.withColumn("_chunk", F.explode(homes)).select(
        "*",
        F.lag("role").over(order).alias("prev_role"),
        F.lead("role").over(order).alias("next_role"),
        F.lead("turn").over(order).isNull().alias("is_last"),
    )
    return framed.filter(F.col("_chunk") == own).drop("_chunk")


def breaks_order(role: Column, turn: Column, prev_role: Column) -> Column:
    """Whether a turn is where its conversation goes out of order.

    The first turn after an optional leading system message must come from the
    user; a tool turn follows an assistant or tool turn; an assistant turn
    follows a user or tool turn.  Other roles go unchecked.
    """
    before = F.coalesce(prev_role, F.lit(""))
    opening = ((turn == 0) & ~role.eqNullSafe(F.lit("system"))) | ((turn == 1) & (before == "system"))
    tool = (role == "tool") & ~before.isin("assistant", "tool")
    reply = (role == "assistant") & ~before.isin("user", "tool")
    leading_system = (turn == 0) & (role == "system")
    # A role that is null is nobody's: it opens no conversation and is nobody's answer.
    return (
        F.when(leading_system, False).when(opening, ~role.eqNullSafe(F.lit("user"))).otherwise(tool | reply)
    )


def invalid_json(text: Column) -> Column:
    """A text that is present but does not parse as JSON."""
    return text.isNotNull() & F.try_parse_json(text).isNull()


def truncate_roles(turns: DataFrame, size: int = CHUNK, also: Column | None = None) -> DataFrame:
    """Keep each conversation up to its first out-of-order turn.

    ``also`` marks further turns to cut at, such as unreadable tool calls.  The
    cuts come from the roles alone; the texts meet them in one join, which Spark
    turns into a broadcast join where the broken conversations prove few.
    """
    flag = F.lit(False) if also is None else F.coalesce(also, F.lit(False))
    roles = turns.select("conv_id", "turn", "role", flag.alias("_also"))
    order = breaks_order(F.col("role"), F.col("turn"), F.col("prev_role"))
    bad = F.coalesce(order, F.lit(False)) | F.col("_also")
    # One row per broken conversation and chunk from the break on, so that a
    # long conversation is joined by as many tasks as it has chunks.
    cuts = (
        with_previous_role(roles, size)
        .groupBy("conv_id")
        .agg(F.min(F.when(bad, F.col("turn"))).alias("_cut"), F.max("turn").alias("_last"))
        .filter("_cut is not null")
        .select(
            "conv_id",
            "_cut",
            F.explode(F.sequence(chunk_of(F.col("_cut"), size), chunk_of(F.col("_last"), size))).alias("chunk"),
        )
    )
    return (
        turns.withColumn("chunk", chunk_of(F.col("turn"), size))
        .join(cuts, ["conv_id", "chunk"], "left")
        .filter(F.col("_cut").isNull() | (F.col("turn") < F.col("_cut")))
        .select(*turns.columns)
    )


def with_system_turn(turns: DataFrame, prompt: str | None, role: str = "system", unless: tuple[str, ...] = ("system",)) -> DataFrame:
    """Put the template's system prompt at turn -1 where the data has none.

    A conversation that opens with one of the roles in ``unless`` keeps its own
    opening, and an empty prompt adds nothing.  No shuffle.
    """
    if not prompt:
        return turns
    needs = (F.col("turn") == 0) & ~F.col("role").isin(*unless)
    rest = [c for c in turns.columns if c not in ("turn", "role", "text")]
    own = F.struct(F.col("turn").cast("bigint").alias("turn"), F.col("role"), F.col("text"))
    extra = F.struct(
        F.lit(-1).cast("bigint").alias("turn"), F.lit(role).alias("role"), F.lit(prompt).alias("text")
    )
    return turns.select(
        *rest, F.inline(F.when(needs, F.array(extra, own)).otherwise(F.array(own)))
    ).select(*turns.columns)


def ending_with(turns: DataFrame, role: str = "assistant", size: int = CHUNK) -> DataFrame:
    """Turns of the conversations whose last turn has the given role."""
    ends = (
        turns.groupBy("conv_id")
        .agg(F.max(F.struct("turn", "role")).alias("_end"), F.min("turn").alias("_first"))
        .filter(F.col("_end.role") == role)
        .select(
            "conv_id",
            F.explode(F.sequence(chunk_of(F.col("_first"), size), chunk_of(F.col("_end.turn"), size))).alias("chunk"),
        )
    )
    cut = turns.withColumn("chunk", chunk_of(F.col("turn"), size))
    return cut.join(ends, ["conv_id", "chunk"], "left_semi").select(*turns.columns)


def start_role_rejects(turns: DataFrame) -> DataFrame:
    """Conversations that open with an assistant turn, with the reason."""
    return turns.filter((F.col("turn") == 0) & (F.col("role") == "assistant")).select(
        "conv_id",
        F.lit("error").alias("status"),
        F.lit("Data starts with an assistant message").alias("error"),
    )


def alternation_breaks(turns: DataFrame) -> DataFrame:
    """Turns whose role is not user, assistant, user, … by position.

    A leading turn that is not the user's is skipped, and the rest counted from
    there; the flag of that turn reaches the others as a per-conversation value.
    """
    openers = turns.filter("turn = 0").select(
        "conv_id", (F.col("role") != "user").cast("int").alias("_skip")
    )
    # Spread the one-row-per-conversation flag over the conversation's chunks.
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    flags = (
        openers.join(last, "conv_id")
        .select("conv_id", "_skip", F.explode(F.sequence(F.lit(0).cast("bigint"), chunk_of(F.col("_last")))).alias("chunk"))
    )
    at = F.col("turn") - F.col("_skip")
    expected = F.when(at % 2 == 0, "user").otherwise("assistant")
    return (
        turns.withColumn("chunk", chunk_of(F.col("turn")))
        .join(flags, ["conv_id", "chunk"])
        .filter((at >= 0) & (F.col("role") != expected))
        .select("conv_id", "turn", "role", expected.alias("expected"))
    )


def explode_conversations(df: DataFrame, id: str = "id") -> DataFrame:
    """Nested conversations to turns, without a shuffle."""
    return df.select(
        F.col(id).alias("conv_id"), F.posexplode("conversations").alias("turn", "m")
    ).select("conv_id", F.col("turn").cast("bigint").alias("turn"), "m.role", F.col("m.content").alias("text"))


def nest_turns(turns: DataFrame, max_tokens: int | None = None, size: int = CHUNK) -> DataFrame:
    """``conv_id, conversations`` of exploded turns.

    A caller that cuts token sequences at ``max_tokens`` passes that number: a
    user's or an assistant's turn is rendered to one token at least, so turns after
    that many of them cannot reach the result, and are not gathered.  Turns of
    other roles are not counted, as some templates write nothing for them.  Turns are
    numbered from 0, so only a conversation with a turn of that number can be cut, and a
    scan that skips lower numbers by the files' statistics finds these.  Their
    cut is found from roles alone, per chunk and then per conversation.  Not for work that looks at a
    conversation's end (last turn only, thinking templates).
    """
    rows = turns
    if max_tokens is not None:
        own = chunk_of(F.col("turn"), size)
        far = turns.filter(F.col("turn") >= max_tokens).select("conv_id").distinct()
        chunks = turns.join(far, "conv_id", "left_semi").groupBy("conv_id", own.alias("_chunk")).agg(
            F.count_if(F.col("role").isin("user", "assistant")).alias("_n")
        )
        before = Window.partitionBy("conv_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        full = (
            chunks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
            .filter(F.col("_before") >= max_tokens)
            .groupBy("conv_id")
            .agg(F.min("_chunk").alias("_end"))
        )
        rows = turns.join(full, "conv_id", "left").filter(F.col("_end").isNull() | (own < F.col("_end"))).drop("_end")
    message = F.struct("turn", "role", F.col("text").alias("content"))
    # Rows are shuffled as they are: gathering before the shuffle saves nothing.
    return (
        rows.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(message)).alias("_m"))
        .select(
            "conv_id",
            F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias(
                "conversations"
            ),
        )
    )
