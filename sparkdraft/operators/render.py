"""Conversations written as text under a chat template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdraft.functions.arrays import shift
from sparkdraft.functions.rows import explode_rows
from sparkdraft.functions.text import find_all, quote, strip
from sparkdraft.operators.templates import CHATML_CALL, CHATML_TOOLS, Template, get_template
from sparkdraft.operators.turns import breaks_order, invalid_json, with_neighbours

# Markers and preamble of the channel format.
CHANNEL_PREAMBLE = (
    "<|start|>system<|message|>You are ChatGPT, a large language model trained by OpenAI.\n"
    "Knowledge cutoff: 2024-06\n"
    "Current date: 2025-06-28\n"
    "\n"
    "Reasoning: {effort}\n"
    "\n"
    "# Valid channels: analysis, commentary, final. Channel must be included for every message.<|end|>"
)
CHANNEL_OPEN = {
    "system": "<|start|>system<|message|>",
    "user": "<|start|>user<|message|>",
    "assistant_analysis": "<|start|>assistant<|channel|>analysis<|message|>",
    "assistant_commentary": "<|start|>assistant<|channel|>commentary<|message|>",
    "assistant_final": "<|start|>assistant<|channel|>final<|message|>",
}
CHANNEL_CLOSE = "<|end|>"
# Each part runs to the first next marker and is never given back.  Matches are
# tied together: where one opening has no end, no later one has.
CHANNEL_SEGMENT = (
    r"\G(?:[^<]++|<(?!\|channel\|>))*+<\|channel\|>((?:[^<]++|<(?!\|message\|>))*+)<\|message\|>"
    r"((?:[^<]++|<(?!\|end\|>))*+)<\|end\|>"
)
EFFORT_ROLE = "assistant_reasoning_effort"


def _template(template: str | Template) -> Template:
    return get_template(template) if isinstance(template, str) else template


#: A tool call as messages carry it: bare, or inside ``function``.
_CALL = "struct<name:string,arguments:string>"
CALLS = f"array<struct<name:string,arguments:string,function:{_CALL}>>"


def calls_text(template: str | Template, content: Column, calls: Column) -> Column:
    """The calls of a message after its content; empty where it has none.

    ``calls`` is JSON text: a list of calls with ``name`` and ``arguments``.
    """
    t = _template(template)
    if t.tool_call is None:
        return F.lit("")
    opening, closing = t.tool_call

    def one(call):
        name = F.coalesce(call["function"]["name"], call["name"], F.lit(""))
        given = F.coalesce(call["function"]["arguments"], call["arguments"], F.lit("null"))
        body = F.concat(F.lit('{"name": "'), name, F.lit('", "arguments": '), given, F.lit("}"))
        return F.concat(F.lit(opening), body, F.lit(closing))

    written = F.array_join(F.transform(F.from_json(calls, CALLS), one), "")
    # The line break that parts calls from each other also parts them from a content.
    start = F.when(content == "", F.expr("2")).otherwise(F.lit(1))
    return F.coalesce(F.substring(written, start, F.length(written)), F.lit(""))


def native_piece(
    template: str | Template,
    role: Column,
    content: Column,
    prev_role: Column | None = None,
    next_role: Column | None = None,
    last: Column | None = None,
    calls: Column | None = None,
) -> Column:
    """One message as the model's own template writes it; null for a role it lacks.

    ``last`` marks the conversation's last message.  Replies of tools look at the
    roles before and after, as they may share a turn.
    """
    t = _template(template)
    close = F.lit(t.end_of_turn or "")
    text = F.coalesce(content, F.lit(""))
    last = F.lit(False) if last is None else last
    none = F.lit(None).cast("string")
    prev_role, next_role = (none if r is None else r for r in (prev_role, next_role))
    thought = F.lit("")
    answer = text
    if t.thought_end:
        answer = F.regexp_replace(text, f"(?s)^.*{quote(t.thought_end)}\\n*", "")
        # What stands before the mark, without the opening one and line breaks around it.
        before = F.regexp_extract(text, f"(?s)^(.*?)(?:{quote(t.thought_end)}|$)", 1)
        thought = F.when(
            text.contains(t.thought_end), F.regexp_replace(before, r"(?s)^(?:.*<think>)?\n*|\n*$", "")
        ).otherwise(F.lit(""))
    history = F.concat(F.lit(t.history_assistant or t.assistant_header or ""), answer)
    if t.last_assistant is None:
        ending = F.concat(F.lit(t.assistant_header or ""), text)
    else:
        head, tail = t.last_assistant.split("\n\n", 1)
        ending = F.concat(F.lit(head + "\n"), thought, F.lit("\n" + tail), answer)
    said = F.when(last, ending).otherwise(history)
    if calls is not None:
        said = F.concat(said, calls_text(t, answer, calls))
    if t.tool_reply is None:
        reply = F.concat(F.lit(t.tool_header or ""), text, close)
    else:
        opening, closing = t.tool_reply
        first = F.when(prev_role.eqNullSafe(F.lit("tool")), "").otherwise((t.native_user or t.user_header).rstrip("\n"))
        final = F.when(next_role.eqNullSafe(F.lit("tool")), "").otherwise(t.end_of_turn or "")
        reply = F.concat(first, F.lit(opening), text, F.lit(closing), final)
    return (
        F.when(role == "user", F.concat(F.lit(t.native_user or t.user_header or ""), text, close))
        .when(role == "assistant", F.concat(said, close))
        .when(role == "system", F.concat(F.lit(t.system_header or ""), text, F.lit(t.system_suffix), close))
        .when(role == "tool", reply)
    )


def fallback_piece(template: str | Template, role: Column, content: Column) -> Column:
    """One message from the headers alone; tool and unknown roles write nothing."""
    t = _template(template)
    text = F.coalesce(content, F.lit(""))
    return (
        F.when(role == "system", text)
        .when(role == "user", F.concat(F.lit(t.user_header or ""), text))
        .when(
            role == "assistant",
            F.concat(F.lit(t.assistant_header or ""), text, F.lit(t.end_of_turn or "")),
        )
        .otherwise(F.lit(""))
    )


def channel_piece(role: Column, content: Column) -> Column:
    """One message of the channel format; null for a role it does not know."""
    head, tail = CHANNEL_PREAMBLE.split("{effort}")
    pairs = [F.lit(x) for kv in CHANNEL_OPEN.items() for x in kv]
    opening = F.try_element_at(F.create_map(*pairs), role)
    return F.when(
        role == EFFORT_ROLE, F.concat(F.lit(head), F.lower(content), F.lit(tail))
    ).otherwise(F.concat(opening, content, F.lit(CHANNEL_CLOSE)))


def resolve_system(conversation: Column, system_prompt: str | None) -> Column:
    """A conversation that opens with its own system message or the template's."""
    if not system_prompt:
        return conversation
    extra = F.array(
        F.struct(
            F.lit("system").alias("role"),
            F.lit(system_prompt).alias("content"),
            F.lit(None).cast("string").alias("tool_calls"),
        )
    )
    own = F.get(conversation, F.lit(0))["role"] == "system"
    return F.when(F.coalesce(own, F.lit(False)), conversation).otherwise(F.concat(extra, conversation))


def valid_prefix(conversation: Column, tool_calls: bool = False) -> Column:
    """Role, content and calls of the messages before the first one that is out of order.

    With ``tool_calls`` the messages have that field, and one whose calls do not
    parse as JSON also ends the conversation.
    """
    before = shift(F.transform(conversation, lambda m: m["role"]), 1, F.lit(None), left=False)

    def breaks(z, i):
        role, prev = z["m"]["role"], z["p"]
        bad = F.coalesce(breaks_order(role, i, prev), F.lit(False))
        # A leading system message is taken as it is, whatever it carries.
        first = (i == 0) & (role == "system")
        return bad | (~first & invalid_json(z["m"]["tool_calls"])) if tool_calls else bad

    flags = F.transform(F.arrays_zip(conversation.alias("m"), before.alias("p")), breaks)
    first = F.array_position(flags, F.lit(True)).cast("int")
    kept = F.when(first > 0, F.slice(conversation, F.lit(1), first - 1)).otherwise(conversation)

    def message(m):
        calls = m["tool_calls"] if tool_calls else F.lit(None)
        return F.struct(
            m["role"].alias("role"), m["content"].alias("content"), calls.cast("string").alias("tool_calls")
        )

    return F.transform(kept, message)


#: Columns that say how a row is rendered.
RENDER_OPTIONS = ("tools", "enable_thinking", "reasoning_effort")


def list_tools(messages: Column, tools: Column) -> Column:
    """The messages with the row's tools, JSON texts, listed in an opening system message."""
    opening, closing = CHATML_TOOLS
    lines = F.array_join(F.transform(tools, lambda x: F.concat(F.lit("\n"), x)), "")
    listed = F.when(F.size(tools) > 0, F.concat(F.lit(opening), lines, F.lit(closing)))

    def add(m, i):
        text = F.concat(F.coalesce(m["content"], F.lit("")), F.coalesce(listed, F.lit("")))
        return m.withField("content", F.when((i == 0) & (m["role"] == "system"), text).otherwise(m["content"]))

    return F.transform(messages, add)


def render(
    conversation: Column,
    template: str | Template,
    mode: str = "native",
    tool_calls: bool = False,
    options: dict[str, Column] | None = None,
) -> Column:
    """A message array as one text.

    Messages are cut at the first out-of-order turn and the system prompt is
    resolved first.  A ``thinking`` template ends in the last assistant message
    after a generation prompt and is null where the last message is another's.
    ``mode`` is ``native`` or ``fallback``; ``tool_calls`` as in :func:`valid_prefix`.

    ``options`` are columns that may differ from row to row: ``tools``, an array of JSON
    texts, is listed in the opening system message of native ChatML layouts;
    ``enable_thinking`` false closes the thought of a ``thinking`` template before the
    last answer, where the template has a mark for it; ``reasoning_effort`` goes into the
    preamble of the channel format.  A null option is the template's default, and one
    that the template has no place for changes nothing.
    """
    t = _template(template)
    options = options or {}
    if unknown := sorted(set(options) - set(RENDER_OPTIONS)):
        raise ValueError(f"unknown render options {unknown}; known: {list(RENDER_OPTIONS)}")
    if t.parser_type == "openai-harmony":
        return render_channels(conversation, options.get("reasoning_effort", "low"))
    use_fallback = mode == "fallback" or t.system_header is None
    messages = resolve_system(valid_prefix(conversation, tool_calls), t.system_prompt)
    if "tools" in options and not use_fallback and t.tool_call == CHATML_CALL:
        messages = list_tools(messages, options["tools"])
    thinking = t.parser_type == "thinking"
    thinks = F.coalesce(options.get("enable_thinking", F.lit(None)).cast("boolean"), F.lit(t.enable_thinking))
    prompt = F.lit(t.assistant_header or "")
    if t.thought_off is not None:
        prompt = F.concat(prompt, F.when(thinks, "").otherwise(t.thought_off))

    def write(part, ended):
        """All messages; ``ended`` says whether the last of them ends the conversation."""
        if use_fallback:
            pieces = F.transform(part, lambda m: fallback_piece(t, m["role"], m["content"]))
        else:
            roles = F.transform(part, lambda m: m["role"])
            framed = F.arrays_zip(
                part.alias("m"),
                shift(roles, 1, F.lit(None), left=False).alias("p"),
                shift(roles, 1, F.lit(None)).alias("n"),
                shift(F.transform(part, lambda m: F.lit(False)), 1, F.lit(ended)).alias("e"),
            )
            pieces = F.transform(
                framed,
                lambda x: native_piece(
                    t, x["m"]["role"], x["m"]["content"], x["p"], x["n"], x["e"],
                    x["m"]["tool_calls"] if tool_calls else None,
                ),
            )
        return F.concat(F.lit(t.bos), F.array_join(pieces, ""))

    def whole(messages):
        if not thinking:
            return write(messages, True)
        last = F.try_element_at(messages, F.lit(-1))
        history = F.slice(messages, F.lit(1), F.greatest(F.size(messages) - 1, F.lit(0)))
        return F.when(
            last["role"] == "assistant",
            F.concat(write(history, False), prompt, last["content"], F.lit(t.end_of_turn or "")),
        )

    # The messages are used several times: bound once, they are computed once.
    return F.get(F.transform(F.array(messages), whole), F.lit(0))


def render_channels(conversation: Column, effort: str | Column = "low", compat: bool = False) -> Column:
    """The channel format, with a preamble unless the data opens with its own.

    ``effort`` may be a column; a null one is low.

    With ``compat`` the preamble is always written and a system or effort
    message replaces all text before it, wherever it stands.  Null where a role
    is unknown.
    """
    head, tail = CHANNEL_PREAMBLE.split("{effort}")
    level = F.lit(effort) if isinstance(effort, str) else F.coalesce(F.lower(effort), F.lit("low"))
    preamble = F.concat(F.lit(head), level, F.lit(tail))
    resets = F.transform(conversation, lambda m: m["role"].isin("system", EFFORT_ROLE))
    pieces = F.transform(conversation, lambda m: channel_piece(m["role"], m["content"]))
    known = ~F.exists(pieces, lambda p: p.isNull())
    if not compat:
        own = F.coalesce(F.get(resets, F.lit(0)), F.lit(False))
        body = F.array_join(pieces, "")
        return F.when(known, F.when(own, body).otherwise(F.concat(preamble, body)))
    size = F.size(pieces)
    from_end = F.array_position(F.reverse(resets), F.lit(True)).cast("int")
    cut = F.when(from_end > 0, size - from_end + 1).otherwise(F.lit(1))
    body = F.array_join(F.slice(pieces, cut, F.greatest(size - cut + 1, F.lit(0))), "")
    return F.when(
        known, F.when(size == 0, F.lit("")).when(from_end > 0, body).otherwise(F.concat(preamble, body))
    )


def with_pieces(turns: DataFrame, template: str, mode: str = "native") -> DataFrame:
    """Exploded turns with ``piece``, their part of the rendered text.

    The rendered conversation is the pieces in turn order, so a conversation of
    any length is written without being gathered.  A ``tool_calls`` column, if
    there is one, holds JSON text.
    """
    if mode == "fallback":
        return turns.withColumn("piece", fallback_piece(template, F.col("role"), F.col("text")))
    calls = F.col("tool_calls") if "tool_calls" in turns.columns else None
    piece = native_piece(
        template, F.col("role"), F.col("text"), F.col("prev_role"), F.col("next_role"), F.col("is_last"), calls
    )
    return with_neighbours(turns).select(*turns.columns, piece.alias("piece"))


def channel_segments(content: Column) -> Column:
    """``array<struct<channel, content>>``; text without tags is channel ``text``."""
    names = find_all(content, CHANNEL_SEGMENT, 1)
    bodies = find_all(content, CHANNEL_SEGMENT, 2)
    tagged = F.transform(
        F.arrays_zip(names.alias("n"), bodies.alias("b")),
        lambda x: F.struct(strip(x["n"]).alias("channel"), strip(x["b"]).alias("content")),
    )
    plain = F.array(F.struct(F.lit("text").alias("channel"), content.alias("content")))
    return F.when(F.size(names) > 0, tagged).otherwise(plain)


def split_channels(df: DataFrame, content: str = "text") -> DataFrame:
    """One row per channel segment, with ``segment`` as its position."""
    rest = [c for c in df.columns if c != content]
    parts = explode_rows(df, channel_segments(F.col(content)), *rest, pos="segment", item="_s")
    return parts.select(*rest, "segment", "_s.channel", "_s.content")
