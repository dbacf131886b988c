"""Queries over turns, rendering, tokens, spans and loss masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdraft.functions.rows import explode_rows
from sparkdraft.functions.text import WHITESPACE, digest, quote
from sparkdraft.operators import render as R
from sparkdraft.operators import spans as SP
from sparkdraft.operators import tokens as TK
from sparkdraft.operators import turns as TN
from sparkdraft.operators.templates import Template, TEMPLATES, get_template
from sparkdraft.plans.corpus import HEAD_SQL, REST_SQL, head_rest
from sparkdraft.plans.dataset import build_dataset, image_texts
from sparkdraft.plans.registry import Tables, query

#: Longest training row, in tokens.
MAX_LENGTH = 2048


def lit(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


TOKEN_SQL = lit(TK.TOKEN)
QWEN = get_template("qwen")
PROMPT_SQL = lit(QWEN.system_prompt)

# ---------------------------------------------------------------- turn order

MESSY_SQL = """
    messy as (
        select conv_id, turn, text,
               case when (conv_id + 3 * turn) % 7 = 5 then 'tool'
                    when (conv_id + turn) % 13 = 11 then 'assistant' else role end as role,
               case when role <> 'assistant' then null
                    when (conv_id + turn) % 5 = 1 then '{bad'
                    when (conv_id + turn) % 5 = 2 then '[{"name":"f"}]' end as tool_calls
        from conversations)
"""


def cut_sql(source: str, extra: str = "false") -> str:
    return f"""
    ordered as (select *, lag(role) over (partition by conv_id order by turn) as prev from {source}),
    flagged as (
        select *, (case when turn = 0 and role = 'system' then false
                        when turn = 0 or (turn = 1 and prev = 'system') then role <> 'user'
                        else (role = 'tool' and prev not in ('assistant', 'tool'))
                          or (role = 'assistant' and prev not in ('user', 'tool')) end) or ({extra}) as bad
        from ordered),
    cuts as (select conv_id, min(turn) as cut from flagged where bad group by conv_id),
    valid as (
        select f.conv_id, f.turn, f.role, f.text from flagged f left join cuts c on f.conv_id = c.conv_id
        where c.cut is null or f.turn < c.cut)
    """


def messy_turns(turns: DataFrame) -> DataFrame:
    """Turns with disordered roles and some unreadable tool calls."""
    key = F.col("conv_id") + F.col("turn")
    role = (
        F.when((F.col("conv_id") + 3 * F.col("turn")) % 7 == 5, "tool")
        .when(key % 13 == 11, "assistant")
        .otherwise(F.col("role"))
    )
    calls = F.when(F.col("role") == "assistant", F.when(key % 5 == 1, "{bad").when(key % 5 == 2, '[{"name":"f"}]'))
    return turns.withColumn("tool_calls", calls).withColumn("role", role)


@query(
    "sys_prompt",
    f"""
    select conv_id, turn, role, text from conversations
    union all
    select conv_id, -1, 'system', {PROMPT_SQL} from conversations where turn = 0 and role <> 'system'
    """,
)
def sys_prompt(t: Tables) -> DataFrame:
    return TN.with_system_turn(t.conversations, QWEN.system_prompt)


@query("role_truncate", f"with {MESSY_SQL}, {cut_sql('messy')} select conv_id, turn, role from valid")
def role_truncate(t: Tables) -> DataFrame:
    turns = messy_turns(t.conversations).select("conv_id", "turn", "role")
    return TN.truncate_roles(turns, size=4)


@query(
    "tool_json",
    f"""
    with {MESSY_SQL}, {cut_sql('messy', "tool_calls is not null and not json_valid(tool_calls)")}
    select conv_id, turn, role from valid
    """,
)
def tool_json(t: Tables) -> DataFrame:
    turns = messy_turns(t.conversations).select("conv_id", "turn", "role", "tool_calls")
    cut = TN.truncate_roles(turns, also=TN.invalid_json(F.col("tool_calls")))
    return cut.select("conv_id", "turn", "role")


@query(
    "alternating_roles",
    """
    with skips as (select conv_id, cast(role <> 'user' as int) as skip from conversations where turn = 0),
    placed as (
        select c.conv_id, c.turn, c.role, c.turn - skip as spot,
               case when turn > 0 and (conv_id + 3 * turn) % 7 = 5 then 'tool' else c.role end as said
        from conversations c join skips using (conv_id))
    select conv_id, turn, said as role, case when spot % 2 = 0 then 'user' else 'assistant' end as expected
    from placed where spot >= 0 and said <> case when spot % 2 = 0 then 'user' else 'assistant' end
    """,
)
def alternating_roles(t: Tables) -> DataFrame:
    # Some turns after the first are given to the wrong speaker.
    wrong = ((F.col("conv_id") + 3 * F.col("turn")) % 7 == 5) & (F.col("turn") > 0)
    turns = t.conversations.withColumn("role", F.when(wrong, "tool").otherwise(F.col("role")))
    return TN.alternation_breaks(turns)


# ----------------------------------------------------------------- rendering


def chatml_sql(source: str, last: str = "<|im_start|>assistant\n") -> str:
    """Pieces of the ChatML layout, written out: replies of tools share a user turn."""
    return f"""
    select conv_id, turn, case role
             when 'user' then '<|im_start|>user\n' || text || '<|im_end|>\n'
             when 'assistant' then case when e then '{last}' else '<|im_start|>assistant\n' end || text || '<|im_end|>\n'
             when 'system' then '<|im_start|>system\n' || text || '<|im_end|>\n'
             when 'tool' then case when p is distinct from 'tool' then '<|im_start|>user' else '' end
                 || '\n<tool_response>\n' || text || '\n</tool_response>'
                 || case when n is distinct from 'tool' then '<|im_end|>\n' else '' end end as piece
    from (select *, lag(role) over w as p, lead(role) over w as n, lead(turn) over w is null as e
          from {source} window w as (partition by conv_id order by turn))
    """


def with_prompt_sql(prompt: str) -> str:
    return f"""
    full_turns as (
        select conv_id, turn, role, text from valid
        union all
        select conv_id, -1, 'system', {lit(prompt)} from conversations where turn = 0 and role <> 'system')
    """


def valid_turns(t: Tables, template: str) -> DataFrame:
    """In-order turns plus the template's system prompt."""
    kept = TN.truncate_roles(t.conversations)
    # The prompt is due even where the very first turn is cut off.
    first = TN.with_system_turn(t.conversations, get_template(template).system_prompt).filter("turn = -1")
    return kept.unionByName(first)


@query(
    "render_chatml",
    f"with {cut_sql('conversations')}, {with_prompt_sql('You are a helpful assistant.')} {chatml_sql('full_turns')}",
)
def render_chatml(t: Tables) -> DataFrame:
    return R.with_pieces(valid_turns(t, "qwen"), "qwen").select("conv_id", "turn", "piece")


@query(
    "render_tools",
    f"""
    with {MESSY_SQL}, said as (
        select conv_id, turn, text, case when role = 'assistant' and turn = 0 then 'user' else role end as role,
               case when role = 'assistant' and turn > 0 and (conv_id + turn) % 5 = 2 then true end as calls
        from messy)
    select conv_id, turn,
           case when calls then replace(piece, '<|im_end|>', '\n<tool_call>\n{{"name": "f", "arguments": null}}\n</tool_call><|im_end|>')
                else piece end as piece
    from ({chatml_sql('said')}) join said using (conv_id, turn)
    """,
)
def render_tools(t: Tables) -> DataFrame:
    """Turns of tools, some next to each other, and answers that call one."""
    turns = messy_turns(t.conversations)
    first = (F.col("role") == "assistant") & (F.col("turn") == 0)
    calls = F.when((F.col("role") == "assistant") & ((F.col("conv_id") + F.col("turn")) % 5 == 2), '[{"name":"f"}]')
    said = turns.withColumn("tool_calls", F.when(~first, calls)).withColumn(
        "role", F.when(first, "user").otherwise(F.col("role"))
    )
    return R.with_pieces(said, "qwen").select("conv_id", "turn", "piece")


PHI3 = get_template("phi3")


@query(
    "render_fallback",
    f"""
    with {MESSY_SQL}, {cut_sql('messy')}
    select conv_id, turn,
           case role when 'system' then text when 'user' then {lit(PHI3.user_header)} || text
                     when 'assistant' then {lit(PHI3.assistant_header)} || text || {lit(PHI3.end_of_turn)}
                     else '' end as piece
    from valid
    """,
)
def render_fallback(t: Tables) -> DataFrame:
    turns = messy_turns(t.conversations).drop("tool_calls")
    return R.with_pieces(TN.truncate_roles(turns), "phi3", "fallback").select("conv_id", "turn", "piece")


@query(
    "render_thinking",
    f"""
    with {cut_sql('conversations')}, {with_prompt_sql('You are a helpful assistant.')},
    ends as (select conv_id, arg_max(role, turn) as last_role from full_turns group by conv_id),
    ready as (select f.* from full_turns f join ends using (conv_id) where last_role = 'assistant')
    {chatml_sql('ready', '<|im_start|>assistant' + chr(10) + '<think>' + chr(10))}
    """,
)
def render_thinking(t: Tables) -> DataFrame:
    ready = TN.ending_with(valid_turns(t, "qwen3-next-thinking"))
    return R.with_pieces(ready, "qwen3-next-thinking").select("conv_id", "turn", "piece")


def channel_roles(turns: DataFrame) -> DataFrame:
    """Assistant turns dealt to the channels by turn number."""
    channel = (
        F.when(F.col("turn") % 3 == 0, "assistant_analysis")
        .when(F.col("turn") % 3 == 1, "assistant_final")
        .otherwise("assistant_commentary")
    )
    return turns.withColumn("role", F.when(F.col("role") == "assistant", channel).otherwise(F.col("role")))


@query(
    "render_channels",
    f"""
    select conv_id, turn,
           '<|start|>' || case role when 'assistant' then 'assistant<|channel|>' ||
               case turn % 3 when 0 then 'analysis' when 1 then 'final' else 'commentary' end else role end
           || '<|message|>' || text || '<|end|>' as piece
    from conversations
    union all
    select conv_id, -1, {lit(R.CHANNEL_PREAMBLE.replace('{effort}', 'low'))}
    from conversations where turn = 0 and role <> 'system'
    """,
)
def render_channels(t: Tables) -> DataFrame:
    opened = TN.with_system_turn(
        channel_roles(t.conversations), "low", R.EFFORT_ROLE, ("system", R.EFFORT_ROLE)
    )
    return opened.select("conv_id", "turn", R.channel_piece(F.col("role"), F.col("text")).alias("piece"))


@query(
    "render_channels_nested",
    """
    with pieces as (
        select conv_id, turn,
               '<|start|>' || case role when 'assistant' then 'assistant<|channel|>' ||
                   case turn % 3 when 0 then 'analysis' when 1 then 'final' else 'commentary' end else role end
               || '<|message|>' || text || '<|end|>' as piece, turn = 0 and role = 'system' as own
        from conversations)
    select conv_id, md5(case when bool_or(own) then '' else
               '<|start|>system<|message|>You are ChatGPT, a large language model trained by OpenAI.\nKnowledge cutoff: 2024-06\n'
               || 'Current date: 2025-06-28\n\nReasoning: low\n\n# Valid channels: analysis, commentary, final. '
               || 'Channel must be included for every message.<|end|>' end || string_agg(piece, '' order by turn)) as text_md5
    from pieces group by conv_id
    """,
)
def render_channels_nested(t: Tables) -> DataFrame:
    """Whole conversations through the operator that writes them."""
    nested = TN.nest_turns(channel_roles(t.conversations))
    return nested.select("conv_id", F.md5(R.render_channels(F.col("conversations"))).alias("text_md5"))


@query(
    "render_thinking_nested",
    f"""
    with {cut_sql('conversations')}, {with_prompt_sql('You are a helpful assistant.')},
    ends as (select conv_id, arg_max(role, turn) as last_role from full_turns group by conv_id),
    ready as (select f.* from full_turns f join ends using (conv_id) where last_role = 'assistant'),
    pieces as ({chatml_sql('ready', '<|im_start|>assistant' + chr(10) + '<think>' + chr(10))})
    select conv_id, md5(string_agg(piece, '' order by turn)) as text_md5 from pieces group by conv_id
    """,
)
def render_thinking_nested(t: Tables) -> DataFrame:
    nested = TN.nest_turns(t.conversations)
    text = R.render(F.col("conversations"), "qwen3-next-thinking")
    return nested.select("conv_id", F.md5(text).alias("text_md5")).filter("text_md5 is not null")


OPTIONS_SQL = f"""
    {cut_sql('conversations')}, {with_prompt_sql('You are a helpful assistant.')},
    tooled as (
        select conv_id, turn, role, text || case when role <> 'system' or turn > 0 or conv_id % 3 = 0 then '' else
            chr(10) || chr(10) || '# Tools' || chr(10) || chr(10)
            || 'You may call one or more functions to assist with the user query.' || chr(10) || chr(10)
            || 'You are provided with function signatures within <tools></tools> XML tags:' || chr(10) || '<tools>'
            || repeat(chr(10) || '{{"name": "f' || conv_id || '"}}', cast(conv_id % 3 as int)) || chr(10) || '</tools>'
            || chr(10) || chr(10) || 'For each function call, return a json object with function name and arguments '
            || 'within <tool_call></tool_call> XML tags:' || chr(10) || '<tool_call>' || chr(10)
            || '{{"name": <function-name>, "arguments": <args-json-object>}}' || chr(10) || '</tool_call>' end as text
        from full_turns),
    tool_pieces as ({chatml_sql('tooled')}),
    ends as (select conv_id, arg_max(role, turn) as last_role, max(turn) as last_turn from full_turns group by conv_id),
    thought_pieces as ({chatml_sql('full_turns')}),
    thought as (
        select p.conv_id, p.turn, case when p.turn < last_turn then piece else
            replace(piece, '<|im_start|>assistant' || chr(10), '<|im_start|>assistant' || chr(10) || '<think>' || chr(10)
                    || case when p.conv_id % 2 = 0 then chr(10) || '</think>' || chr(10) || chr(10) else '' end) end as piece
        from thought_pieces p join ends using (conv_id) where last_role = 'assistant'),
    spoken as (
        select conv_id, string_agg('<|start|>' || case role when 'assistant' then 'assistant<|channel|>' ||
                   case turn % 3 when 0 then 'analysis' when 1 then 'final' else 'commentary' end else role end
               || '<|message|>' || text || '<|end|>', '' order by turn) as body, bool_or(turn = 0 and role = 'system') as own
        from conversations group by conv_id),
    channels as (
        select conv_id, case when own then '' else replace({lit(R.CHANNEL_PREAMBLE)}, '{{effort}}',
            case conv_id % 3 when 0 then 'low' when 1 then 'medium' else 'high' end) end || body as txt
        from spoken)
"""


@query(
    "render_options",
    f"""
    with {OPTIONS_SQL}
    select 'tools' as option, conv_id, md5(string_agg(piece, '' order by turn)) as text_md5 from tool_pieces group by conv_id
    union all
    select 'enable_thinking', conv_id, md5(string_agg(piece, '' order by turn)) from thought group by conv_id
    union all
    select 'reasoning_effort', conv_id, md5(txt) from channels
    """,
)
def render_options(t: Tables) -> DataFrame:
    """Each conversation with options of its own; a third leaves tools and effort to the default."""
    conv = F.col("conv_id")
    tool = F.concat(F.lit('{"name": "f'), conv.cast("string"), F.lit('"}'))
    given = {
        "tools": F.when(conv % 3 > 0, F.array_repeat(tool, (conv % 3).cast("int"))),
        "enable_thinking": F.when(conv % 2 == 0, False),
        "reasoning_effort": F.get(F.array(F.lit(None), F.lit("medium"), F.lit("HIGH")), (conv % 3).cast("int")),
    }
    written = {"tools": "qwen", "enable_thinking": "qwen3-next-thinking", "reasoning_effort": "gpt-oss"}
    parts = []
    for option, template in written.items():
        turns = channel_roles(t.conversations) if option == "reasoning_effort" else t.conversations
        nested = TN.nest_turns(turns).withColumn(option, given[option])
        text = R.render(F.col("conversations"), template, options={option: F.col(option)})
        parts.append(nested.select(F.lit(option).alias("option"), "conv_id", F.md5(text).alias("text_md5")))
    return parts[0].union(parts[1]).union(parts[2]).filter("text_md5 is not null")


@query(
    "channel_split",
    f"""
    with base as (
        select doc_id, case doc_id % 3
                 when 0 then '<|channel|> analysis<|message|>' || {HEAD_SQL} || '<|end|> x <|channel|>final<|message|> '
                              || {REST_SQL} || chr(10) || '<|end|>'
                 when 1 then '<|channel|>final<|message|>' || text || '<|end|>'
                 else text end as text
        from documents),
    found as (
        select doc_id, text, regexp_extract_all(text, '(?s)<\\|channel\\|>(.*?)<\\|message\\|>(.*?)<\\|end\\|>', 1) as names,
               regexp_extract_all(text, '(?s)<\\|channel\\|>(.*?)<\\|message\\|>(.*?)<\\|end\\|>', 2) as bodies
        from base)
    select doc_id, cast(i - 1 as int) as segment, trim(names[i], {lit(WHITESPACE)}) as channel,
           trim(bodies[i], {lit(WHITESPACE)}) as content
    from found, unnest(range(1, len(names) + 1)) as u(i)
    union all
    select doc_id, 0, 'text', text from found where len(names) = 0
    """,
)
def channel_split(t: Tables) -> DataFrame:
    kind = F.col("doc_id") % 3
    two = F.concat(
        F.lit("<|channel|> analysis<|message|>"),
        "head",
        F.lit("<|end|> x <|channel|>final<|message|> "),
        "rest",
        F.lit("\n<|end|>"),
    )
    one = F.concat(F.lit("<|channel|>final<|message|>"), "text", F.lit("<|end|>"))
    text = F.when(kind == 0, two).when(kind == 1, one).otherwise(F.col("text"))
    return R.split_channels(head_rest(t.spread_documents).select("doc_id", text.alias("text")))


GENERAL = {n: x for n, x in TEMPLATES.items() if x.parser_type != "openai-harmony"}
# What stands before a user's and around an assistant's text, typed in apart from the registry.
WRITTEN_SQL = """
    ('llama3', '<|start_header_id|>user<|end_header_id|>', '<|start_header_id|>assistant<|end_header_id|>__<|eot_id|>'),
    ('llama4', '<|header_start|>user<|header_end|>', '<|header_start|>assistant<|header_end|>__<|eot|>'),
    ('qwen', '<|im_start|>user_', '<|im_start|>assistant_<|im_end|>_'),
    ('qwen2-vl', '<|im_start|>user_', '<|im_start|>assistant_<|im_end|>_'),
    ('phi3', '<|user|>_', '<|assistant|>_<|end|>_'),
    ('phi4', '<|im_start|>user<|im_sep|>', '<|im_start|>assistant<|im_sep|><|im_end|>'),
    ('phi4-mini', '<|user|>', '<|assistant|><|end|>'),
    ('gpt-oss-naive', '<|start|>user<|message|>', '<|start|>assistant<|channel|>analysis<|message|><|end|>'),
    ('deepseek-r1-distill', '<｜User｜>', '<｜Assistant｜>'),
    ('qwen3-thinking', '<|im_start|>user_', '<|im_start|>assistant_<|im_end|>_'),
    ('qwen3-instruct', '<|im_start|>user_', '<|im_start|>assistant_<think>__</think>_<|im_end|>_'),
    ('qwen3-next-thinking', '<|im_start|>user_', '<|im_start|>assistant_<think>_<|im_end|>_'),
    ('kimi-k2-thinking', '<|im_start|>user_', '<|im_assistant|>assistant<|im_middle|><|im_end|>'),
    ('kimi-k2-instruct', '<|im_start|>user_', '<|im_assistant|>assistant<|im_middle|><|im_end|>'),
    ('deepseek-v3', '<｜User｜>', '<｜Assistant｜><｜end▁of▁sentence｜>'),
    ('ling-flash-2.0', '<role>HUMAN</role>', '<role>ASSISTANT</role><|role_end|>'),
    ('deepseek-v32', '<｜User｜>', '<｜Assistant｜><｜end▁of▁sentence｜>'),
    ('gemma', '<start_of_turn>user_', '<start_of_turn>model_<end_of_turn>_'),
    ('longcat', ' USER:', ' ASSISTANT:</longcat_s>'),
    ('longcat_xml', '<longcat_user>', '<longcat_assistant></longcat_s>')
"""


@query(
    "templates",
    f"""
    with written(template, before_user, around_assistant) as (values {WRITTEN_SQL}),
    registry as (
        select template, length(before_user) as user_extra, length(around_assistant) as assistant_extra from written),
    said as (select role, count(*) as n, cast(sum(length(text)) as bigint) as chars from conversations group by role)
    select template, cast(sum(n) as bigint) as turns,
           cast(sum(chars + n * case role when 'user' then user_extra
                                          when 'assistant' then assistant_extra else 0 end) as bigint) as chars
    from said, registry group by template
    """,
)
def templates(t: Tables) -> DataFrame:
    sizes = [
        F.struct(
            F.lit(n).alias("template"),
            F.length(R.fallback_piece(x, F.col("role"), F.col("text"))).alias("chars"),
        )
        for n, x in GENERAL.items()
    ]
    written = t.spread_conversations.select(F.inline(F.array(*sizes)))
    return written.groupBy("template").agg(F.count("*").alias("turns"), F.sum("chars").alias("chars"))


# -------------------------------------------------------------------- tokens

ID_SQL = "cast(cast(('0x' || substr(md5(p), 1, 7)) as bigint) % 32768 as int)"


@query(
    "tokenize",
    f"""
    with found as (select conv_id, turn, regexp_extract_all(text, {TOKEN_SQL}) as toks from conversations)
    select conv_id, turn, cast(len(toks) as int) as n_tokens, md5(array_to_string(toks, ',')) as pieces_md5,
           md5(array_to_string(list_transform(toks, lambda p: {ID_SQL}), ',')) as ids_md5
    from found
    """,
)
def tokenize(t: Tables) -> DataFrame:
    return TK.tokenize(t.spread_conversations).select(
        "conv_id",
        "turn",
        F.size("pieces").alias("n_tokens"),
        digest(F.col("pieces")).alias("pieces_md5"),
        digest(F.col("input_ids")).alias("ids_md5"),
    )


@query(
    "token_vocab",
    f"""
    with toks as (select unnest(regexp_extract_all(text, {TOKEN_SQL})) as token from documents)
    select token, count(*) as freq,
           cast(row_number() over (order by count(*) desc, token) - 1 as bigint) as token_id
    from toks group by token order by freq desc, token limit 5000
    """,
)
def token_vocab(t: Tables) -> DataFrame:
    tokens = explode_rows(t.spread_documents, TK.pieces(F.col("text")), item="token").select("token")
    return TK.token_vocab(tokens, size=5000)


@query(
    "encode_vocab",
    f"""
    with toks as (select conv_id, turn, regexp_extract_all(text, {TOKEN_SQL}) as toks from conversations),
    flat as (select conv_id, turn, i, toks[i] as token from toks, unnest(range(1, len(toks) + 1)) as u(i)),
    vocab as (
        select token, row_number() over (order by n desc, token) - 1 as id
        from (select token, count(*) as n from flat group by token order by n desc, token limit 500))
    select conv_id, turn, md5(string_agg(coalesce(id, 500), ',' order by i)) as ids_md5
    from flat left join vocab using (token) group by conv_id, turn
    """,
)
def encode_vocab(t: Tables) -> DataFrame:
    turns = t.spread_conversations.select("conv_id", "turn", TK.pieces(F.col("text")).alias("pieces"))
    keyed = turns.filter(F.size("pieces") > 0).withColumn("key", F.struct("conv_id", "turn"))
    vocab = TK.token_vocab(explode_rows(keyed, F.col("pieces"), item="token").select("token"), size=500)
    ids = TK.encode(keyed, vocab, "key", unknown=500)
    return ids.select("conv_id", "turn", digest(F.col("input_ids")).alias("ids_md5"))


# --------------------------------------------------------------------- spans


def chatml_document(text: Column) -> Column:
    """A document as ready text: first line the user's, later ones the assistant's."""
    turn = F.replace(text, F.lit("\n"), F.lit("<|im_end|>\n<|im_start|>assistant\n"))
    return F.concat(F.lit("<|im_start|>user\n"), turn, F.lit("<|im_end|>\n"))


CHATML_SQL = """
    rendered as (
        select doc_id as id, '<|im_start|>user' || chr(10)
               || replace(text, chr(10), '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10))
               || '<|im_end|>' || chr(10) as txt
        from documents)
"""


def regex_spans_sql(header: str, end: str) -> str:
    """Spans of ``rendered(id, txt)``, from a pattern with gap and span groups."""
    pattern = lit(rf"([\s\S]*?){quote(header)}([\s\S]*?(?:{end}))")
    return f"""
    found as (
        select id, txt, regexp_extract_all(txt, {pattern}, 1) as gaps, regexp_extract_all(txt, {pattern}, 2) as bodies
        from rendered),
    spans as (
        select id, txt, i, bodies[i] as content,
               cast(sum(length(gaps[i]) + {len(header)} + length(bodies[i])) over (partition by id order by i)
                    as bigint) as stop
        from found, unnest(range(1, len(gaps) + 1)) as u(i))
    """


SPAN_COLUMNS_SQL = """
    select id as doc_id, cast(i - 1 as int) as n, cast(stop - length(content) as int) as start,
           cast(stop as int) as stop, md5(content) as content_md5 from spans
"""


def span_rows(df: DataFrame) -> DataFrame:
    return explode_rows(df, F.col("spans"), "doc_id", pos="n", item="s").select(
        "doc_id", "n", "s.start", F.col("s.end").alias("stop"), F.md5("s.content").alias("content_md5")
    )


def chatml_texts(t: Tables) -> DataFrame:
    return t.spread_documents.select("doc_id", chatml_document(F.col("text")).alias("text"))


QWEN_SPANS_SQL = regex_spans_sql(QWEN.assistant_header, quote(QWEN.end_of_turn))


@query("assistant_spans", f"with {CHATML_SQL}, {QWEN_SPANS_SQL} {SPAN_COLUMNS_SQL}")
def assistant_spans(t: Tables) -> DataFrame:
    return span_rows(SP.assistant_spans(chatml_texts(t), "text", "qwen"))


@query(
    "spans_last",
    f"""
    with {CHATML_SQL}, {QWEN_SPANS_SQL}, lasts as (select id, max(i) as last_i from spans group by id)
    select s.id as doc_id, cast(stop - length(content) as int) as start, cast(stop as int) as stop,
           md5(content) as content_md5
    from spans s join lasts on s.id = lasts.id and i = last_i
    """,
)
def spans_last(t: Tables) -> DataFrame:
    found = SP.assistant_spans(chatml_texts(t), "text", "qwen", last_only=True)
    return span_rows(found).drop("n")


LONGCAT = get_template("longcat")


@query(
    "spans_round",
    f"""
    with rendered as (
        select doc_id as id, array_to_string(list_transform(string_split(text, chr(10)),
                   lambda l, i: '[Round ' || (i - 1) || '] USER:' || l || ' ASSISTANT:' || l), '') as txt
        from documents),
    {regex_spans_sql(LONGCAT.assistant_header, r'\[Round [0-9]+\] USER:|$')} {SPAN_COLUMNS_SQL}
    """,
)
def spans_round(t: Tables) -> DataFrame:
    said = F.transform(
        F.split("text", "\n"),
        lambda l, i: F.concat(F.lit("[Round "), i.cast("string"), F.lit("] USER:"), l, F.lit(" ASSISTANT:"), l),
    )
    texts = t.spread_documents.select("doc_id", F.array_join(said, "").alias("text"))
    return span_rows(SP.assistant_spans(texts, "text", "longcat"))


def split_spans_sql(header: str, separator: str) -> str:
    """Spans that reach to just before a separator, by splitting at it."""
    return f"""
    parts as (
        select id, txt, p[i] as part, i, i = len(p) as is_last,
               cast(coalesce(sum(length(p[i]) + {len(separator)}) over (
                   partition by id order by i rows between unbounded preceding and 1 preceding), 0) as bigint) as spot
        from (select id, txt, string_split(txt, {lit(separator)}) as p from rendered),
             unnest(range(1, len(p) + 1)) as u(i)),
    heads as (select *, strpos(part, {lit(header)}) as h from parts),
    bodies as (
        select id, txt, i, spot + h - 1 + {len(header)} as start,
               case when is_last and part[-1] = chr(10) then part[:-2] else part end as body, h
        from heads where h > 0),
    spans as (
        select id, txt, row_number() over (partition by id order by i) as i, substr(body, h + {len(header)}) as content,
               start + length(substr(body, h + {len(header)})) as stop
        from bodies)
    """


PAIR_SQL = f"""
    rendered as (
        select doc_id as id, {lit(QWEN.system_header)} || 's' || {lit(QWEN.end_of_turn)}
               || array_to_string(list_transform(string_split(text, chr(10)),
                   lambda l, i: case when i % 2 = 1 then {lit(QWEN.user_header)} else {lit(QWEN.assistant_header)} end
                                || l || {lit(QWEN.end_of_turn)}), '') as txt
        from documents),
    {split_spans_sql(QWEN.end_of_turn + QWEN.assistant_header, QWEN.end_of_turn + QWEN.user_header)}
"""


def pair_texts(t: Tables) -> DataFrame:
    said = F.transform(
        F.split("text", "\n"),
        lambda l, i: F.concat(
            F.when(i % 2 == 0, F.lit(QWEN.user_header)).otherwise(F.lit(QWEN.assistant_header)),
            l,
            F.lit(QWEN.end_of_turn),
        ),
    )
    opening = F.lit(f"{QWEN.system_header}s{QWEN.end_of_turn}")
    return t.spread_documents.select("doc_id", F.concat(opening, F.array_join(said, "")).alias("text"))


@query("spans_pair", f"with {PAIR_SQL} {SPAN_COLUMNS_SQL}")
def spans_pair(t: Tables) -> DataFrame:
    return span_rows(SP.assistant_spans(pair_texts(t), "text", "qwen", kind="pair"))


CHANNEL_TEXT_SQL = f"""
    rendered as (
        select doc_id as id, array_to_string(list_transform(string_split(text, chr(10)),
                   lambda l, i: case i % 3 when 1 then '<|start|>user<|message|>'
                                           when 2 then '<|start|>assistant<|channel|>analysis<|message|>'
                                           else '<|start|>assistant' end || l || '<|end|>'), '') as txt
        from documents),
    {split_spans_sql(SP.CHANNEL_HEADER, SP.CHANNEL_USER)}
"""


def channel_texts(t: Tables) -> DataFrame:
    # Every third line follows its header directly, so that tokens may straddle the edge.
    said = F.transform(
        F.split("text", "\n"),
        lambda l, i: F.concat(
            F.when(i % 3 == 0, F.lit("<|start|>user<|message|>"))
            .when(i % 3 == 1, F.lit("<|start|>assistant<|channel|>analysis<|message|>"))
            .otherwise(F.lit("<|start|>assistant")),
            l,
            F.lit("<|end|>"),
        ),
    )
    return t.spread_documents.select("doc_id", F.array_join(said, "").alias("text"))


@query("spans_channels", f"with {CHANNEL_TEXT_SQL} {SPAN_COLUMNS_SQL}")
def spans_channels(t: Tables) -> DataFrame:
    return span_rows(SP.assistant_spans(channel_texts(t), "text", "gpt-oss"))


# --------------------------------------------------------------------- masks


def mask_summary(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(
        *keys,
        F.size("pieces").alias("n_tokens"),
        F.aggregate("loss_mask", F.lit(0), lambda a, x: a + x).alias("n_loss"),
        F.md5(F.array_join("loss_mask", "")).alias("mask_md5"),
    )


# The literal rule: count the tokens of the text up to a span's start and end.
PREFIX_MASK_SQL = f"""
    edges as (
        select id, i, len(regexp_extract_all(substr(txt, 1, stop - length(content)), {TOKEN_SQL})) as s,
               len(regexp_extract_all(substr(txt, 1, stop), {TOKEN_SQL})) as e
        from spans),
    runs as (
        select id, max(e) as last_e, string_agg(repeat('0', s - before) || repeat('1', e - s), '' order by i) as m
        from (select *, coalesce(lag(e) over (partition by id order by i), 0) as before from edges) group by id),
    masked as (
        select r.id, r.txt, regexp_extract_all(r.txt, {TOKEN_SQL}) as toks,
               coalesce(m, '') || repeat('0', len(regexp_extract_all(r.txt, {TOKEN_SQL})) - coalesce(last_e, 0)) as mask
        from rendered r left join runs using (id))
"""
MASK_COLUMNS_SQL = """
    select id as doc_id, cast(len(toks) as int) as n_tokens,
           cast(length(replace(mask, '0', '')) as int) as n_loss, md5(mask) as mask_md5 from masked
"""


@query("mask_prefix", f"with {CHATML_SQL}, {QWEN_SPANS_SQL}, {PREFIX_MASK_SQL} {MASK_COLUMNS_SQL}")
def mask_prefix(t: Tables) -> DataFrame:
    return mask_summary(SP.masked_tokens(chatml_texts(t), "text", "qwen"), "doc_id")


# Marks of letters, which run together with the words beside them.
PLAIN_MARKS = Template("BOT", "USR", None, "END")


@query(
    "mask_prefix_any_template",
    f"""
    with rendered as (
        select doc_id as id, 'USR' || replace(text, chr(10), 'ENDBOT') || 'END' as txt from documents),
    {regex_spans_sql("BOT", "END")}, {PREFIX_MASK_SQL} {MASK_COLUMNS_SQL}
    """,
)
def mask_prefix_any_template(t: Tables) -> DataFrame:
    text = F.concat(F.lit("USR"), F.replace("text", F.lit("\n"), F.lit("ENDBOT")), F.lit("END"))
    rows = t.spread_documents.select("doc_id", text.alias("text"))
    return mask_summary(SP.masked_tokens(rows, "text", PLAIN_MARKS), "doc_id")


def offset_mask_sql(candidate: str, inside: str) -> str:
    """Judge each token ``[s, e)`` by the last span ``[ss, se)`` that is a candidate."""
    return f"""
    toks as (
        select id, i, e - length(tk) as s, e
        from (select id, i, tk, cast(sum(length(tk)) over (partition by id order by i) as bigint) as e
              from (select id, unnest(tk) as tk, unnest(range(1, len(tk) + 1)) as i
                    from (select id, regexp_extract_all(txt, {TOKEN_SQL}) as tk from rendered)))),
    bounds as (select id, stop - length(content) as ss, stop as se from spans),
    judged as (
        select t.id, t.i, cast(coalesce({inside}, false) as int) as m
        from toks t asof left join bounds b on t.id = b.id and {candidate}),
    masked as (select id, list(i) as toks, string_agg(cast(m as varchar), '' order by i) as mask from judged group by id)
    """


@query(
    "mask_contained",
    f"""
    with {CHANNEL_TEXT_SQL}, {offset_mask_sql("t.s >= b.ss", "t.e <= b.se")} {MASK_COLUMNS_SQL}
    """,
)
def mask_contained(t: Tables) -> DataFrame:
    spanned = SP.assistant_spans(channel_texts(t), "text", "gpt-oss").withColumn("pieces", TK.pieces(F.col("text")))
    mask = SP.offset_mask(F.col("pieces"), F.col("spans"), "contained")
    return mask_summary(spanned.withColumn("loss_mask", mask), "doc_id")


@query(
    "mask_from_offsets",
    f"""
    with {CHANNEL_TEXT_SQL}, {offset_mask_sql("t.s >= b.ss", "t.e <= b.se")} {MASK_COLUMNS_SQL}
    """,
)
def mask_from_offsets(t: Tables) -> DataFrame:
    """Tokens that come as offsets, as any tokenizer gives them."""
    spanned = SP.assistant_spans(channel_texts(t), "text", "gpt-oss").withColumn("pieces", TK.pieces(F.col("text")))
    widths = F.transform("pieces", F.length)
    placed = spanned.withColumn("starts", SP.prefix_sums(widths)).withColumn(
        "ends", F.zip_with("starts", widths, lambda s, w: s + w)
    )
    mask = SP.offset_mask_at(F.col("starts"), F.col("ends"), F.col("spans"), "contained")
    return mask_summary(placed.withColumn("loss_mask", mask), "doc_id")


@query(
    "span_range_join",
    f"""
    with {CHANNEL_TEXT_SQL}, {offset_mask_sql("t.s >= b.ss", "t.e <= b.se")}
    select id as doc_id, cast(i - 1 as int) as place from judged where m = 1
    """,
)
def span_range_join(t: Tables) -> DataFrame:
    texts = channel_texts(t)
    tokens = SP.token_rows(texts.select("doc_id", TK.pieces(F.col("text")).alias("pieces")), "doc_id", stretch=SP.STRETCH)
    spans = span_rows(SP.assistant_spans(texts, "text", "gpt-oss")).select("doc_id", "start", "stop")
    return SP.tokens_in_spans(tokens, spans, "doc_id").select("doc_id", "place")


@query(
    "mask_overlap",
    f"""
    with {PAIR_SQL}, {offset_mask_sql("t.e > b.ss", "t.s <= b.se")} {MASK_COLUMNS_SQL}
    """,
)
def mask_overlap(t: Tables) -> DataFrame:
    spanned = SP.assistant_spans(pair_texts(t), "text", "qwen", kind="pair").withColumn(
        "pieces", TK.pieces(F.col("text"))
    )
    mask = SP.offset_mask(F.col("pieces"), F.col("spans"), "overlap")
    return mask_summary(spanned.withColumn("loss_mask", mask), "doc_id")


# ------------------------------------------------------------------- dataset


def training_rows(t: Tables, template: str = "qwen") -> DataFrame:
    """The conversations table as training rows."""
    # Not by conv_id: that is how the turns were gathered, in as few partitions as small tables get.
    nested = t.spread(TN.nest_turns(t.conversations, MAX_LENGTH))
    return build_dataset(nested, template, MAX_LENGTH)


# Rows of the data set: id, toks (list), mask (0/1 string), both cut to length.
DATASET_SQL = f"""
    {cut_sql('conversations')}, {with_prompt_sql('You are a helpful assistant.')},
    pieces as ({chatml_sql('full_turns')}),
    rendered as (select conv_id as id, string_agg(piece, '' order by turn) as txt from pieces group by conv_id),
    {QWEN_SPANS_SQL}, {PREFIX_MASK_SQL},
    dataset as (select id as conv_id, toks[:{MAX_LENGTH}] as toks, substr(mask, 1, {MAX_LENGTH}) as mask from masked)
"""


@query(
    "build_dataset",
    f"""
    with {DATASET_SQL}
    select conv_id, cast(len(toks) as int) as n_tokens, cast(length(replace(mask, '0', '')) as int) as n_loss,
           md5(mask) as mask_md5, md5(array_to_string(list_transform(toks, lambda p: {ID_SQL}), ',')) as ids_md5
    from dataset
    """,
)
def build_dataset_query(t: Tables) -> DataFrame:
    rows = training_rows(t).withColumn("ids_md5", digest(F.col("input_ids")))
    return mask_summary(rows, "conv_id", "ids_md5").select("conv_id", "n_tokens", "n_loss", "mask_md5", "ids_md5")


@query(
    "image_texts",
    """
    with heads as (select conv_id, cast(role <> 'user' as int) as skip from conversations where turn = 0),
    said as (
        select conv_id, turn - skip as spot, text,
               case when turn > 0 and (conv_id + turn) % 31 = 3 then 'tool' else role end as role
        from conversations join heads using (conv_id) where turn >= skip),
    judged as (
        select conv_id, bool_or(role <> case when spot % 2 = 0 then 'user' else 'assistant' end) as odd,
               '<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n' || string_agg(
                   '<|im_start|>' || role || '\n'
                   || case role when 'user' then '<|vision_start|><|image_pad|><|vision_end|>' else '' end
                   || text || '<|im_end|>\n', '' order by spot) as txt
        from said group by conv_id)
    select conv_id, case when not odd then md5(txt) end as text_md5,
           case when odd then 'user and assistant do not alternate' end as reason
    from judged
    """,
)
def image_texts_query(t: Tables) -> DataFrame:
    odd = ((F.col("conv_id") + F.col("turn")) % 31 == 3) & (F.col("turn") > 0)
    roles = F.when(odd, "tool").otherwise(F.col("role"))
    nested = TN.nest_turns(t.conversations.withColumn("role", roles))
    return image_texts(nested).select("conv_id", F.md5("text").alias("text_md5"), "reason")


@query(
    "attention_mask",
    f"""
    with {DATASET_SQL}
    select conv_id, cast(len(toks) as int) as n, cast(len(toks) as int) as attended from dataset
    """,
)
def attention_mask(t: Tables) -> DataFrame:
    return training_rows(t).select(
        "conv_id",
        F.size("attention_mask").alias("n"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("attended"),
    )


@query(
    "mask_runs",
    f"""
    with {DATASET_SQL},
    flat as (
        select conv_id, i, toks[i] as tok, cast(mask[i] as int) as m
        from dataset, unnest(range(1, len(toks) + 1)) as u(i)),
    islands as (
        select *, i - row_number() over (partition by conv_id, m order by i) as island from flat)
    select conv_id, m as mask, cast(min(i) - 1 as int) as start, cast(max(i) as int) as "end",
           string_agg(tok, '' order by i) as text
    from islands group by conv_id, m, island
    """,
)
def mask_runs(t: Tables) -> DataFrame:
    return SP.mask_runs(training_rows(t), "conv_id")
