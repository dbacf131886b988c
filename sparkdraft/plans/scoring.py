"""Queries over prompts, answer extraction, accuracy and run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdraft.functions import answers as A
from sparkdraft.functions.text import WHITESPACE
from sparkdraft.operators import prompts as P
from sparkdraft.operators import scoring as SC
from sparkdraft.plans.chat import lit
from sparkdraft.plans.corpus import HEAD_SQL, REST_SQL, head_rest
from sparkdraft.plans.registry import Tables, query

WS = lit(WHITESPACE)
BASE_SQL = f"base as (select *, {HEAD_SQL} as head, {REST_SQL} as rest from documents)"

# ------------------------------------------------------------------- prompts


@query(
    "fewshot_prompt",
    """
    with solved as (
        select string_agg('Question: ' || split_part(text, chr(10), 1) || chr(10) || 'Answer: q' || item_id
                          || chr(10) || chr(10), '' order by item_id) as block
        from (select * from benchmark order by item_id limit 5))
    select item_id, block || 'Question: ' || split_part(text, chr(10), 1) || chr(10) || 'Answer:' as prompt
    from benchmark, solved
    """,
)
def fewshot_prompt(t: Tables) -> DataFrame:
    asked = t.benchmark.select(
        "item_id",
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("question"),
        F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("answer"),
    )
    return P.fewshot_prompt(asked, "item_id").select("item_id", "prompt")


def choice_sql(question: str, choices: str) -> str:
    lines = " || chr(10) || ".join(f"'{x}) ' || trim({choices}[{i}], {WS})" for i, x in enumerate("ABCD", 1))
    return f"{lit(P.CHOICE_HEAD)} || trim({question}, {WS}) || chr(10) || chr(10) || {lines}"


PLACE_SQL = "cast(cast(('0x' || substr(md5('0|' || doc_id), 1, 8)) as bigint) % 4 as int)"


@query(
    "mcq_prompt_shuffled",
    f"""
    with {BASE_SQL},
    placed as (
        select *, {PLACE_SQL} as place, ['w ' || lang, source || ' ', cast(n_chars as varchar)] as wrong from base),
    filled as (
        select *, list_concat(list_concat(wrong[:place], [' right' || doc_id]), wrong[place + 1:]) as c from placed)
    select 'gpqa' as bench, doc_id as q_idx, {choice_sql('head', 'c')} as question, substr('ABCD', place + 1, 1) as label
    from filled
    """,
)
def mcq_prompt_shuffled(t: Tables) -> DataFrame:
    raw = head_rest(t.spread_documents).select(
        F.col("doc_id").alias("q_idx"),
        F.col("head").alias("Question"),
        F.concat(F.lit(" right"), F.col("doc_id").cast("string")).alias("Correct Answer"),
        F.concat(F.lit("w "), "lang").alias("Incorrect Answer 1"),
        F.concat("source", F.lit(" ")).alias("Incorrect Answer 2"),
        F.col("n_chars").cast("string").alias("Incorrect Answer 3"),
    )
    return P.build_prompts(raw, "gpqa")


@query(
    "mcq_prompt_fixed",
    f"""
    with {BASE_SQL}, listed as (
        select *, [lang, source || ' ', cast(n_chars as varchar), ' none'] as c from base)
    select 'mmlu' as bench, source as subset, doc_id as q_idx, {choice_sql('rest', 'c')} as question,
           substr('ABCD', cast(doc_id % 4 as int) + 1, 1) as label
    from listed
    """,
)
def mcq_prompt_fixed(t: Tables) -> DataFrame:
    raw = head_rest(t.spread_documents).select(
        F.col("source").alias("subset"),
        F.col("doc_id").alias("q_idx"),
        F.col("rest").alias("question"),
        F.array(F.col("lang"), F.concat("source", F.lit(" ")), F.col("n_chars").cast("string"), F.lit(" none")).alias(
            "choices"
        ),
        (F.col("doc_id") % 4).alias("answer"),
    )
    return P.build_prompts(raw, "mmlu")


@query(
    "exam_prompt",
    f"""
    with {BASE_SQL}, listed as (
        select doc_id, head, upper(substr('abcdex', cast(doc_id % 6 as int) + 1, 1)) as letter,
               list_transform(list_filter([lang, case when doc_id % 3 = 0 then '' else source end,
                   case when doc_id % 3 = 0 then null else ' ' || n_chars end,
                   case when doc_id % 9 = 0 then '' else 'last' end],
                   lambda o: coalesce(o, '') <> ''), lambda o: trim(o, {WS})) as o
        from base)
    select 'ceval' as bench, doc_id as q_idx,
           head || {lit(P.EXAM_OPTIONS)} || array_to_string(list_transform(o, lambda x, i:
               substr('ABCD', i, 1) || '. ' || x || chr(10)), '') || {lit(P.EXAM_TAIL)} as question, letter as label
    from listed where head <> '' and len(o) >= 2 and letter in ('A', 'B', 'C', 'D')
    """,
)
def exam_prompt(t: Tables) -> DataFrame:
    some = F.col("doc_id") % 3 == 0
    options = F.create_map(
        F.lit("A"), F.col("lang"),
        F.lit("B"), F.when(some, "").otherwise(F.col("source")),
        F.lit("C"), F.when(~some, F.concat(F.lit(" "), F.col("n_chars").cast("string"))),
        F.lit("D"), F.when(F.col("doc_id") % 9 == 0, "").otherwise("last"),
    )
    raw = head_rest(t.spread_documents).select(
        F.col("doc_id").alias("q_idx"),
        F.col("head").alias("question"),
        options.alias("options"),
        F.substring(F.lit("abcdex"), (F.col("doc_id") % 6 + 1).cast("int"), F.lit(1)).alias("answer"),
    )
    return P.build_prompts(raw, "ceval")


@query(
    "context_prompt",
    f"""
    with {BASE_SQL}
    select 'financeqa' as bench, doc_id as q_idx,
           case when doc_id % 3 = 0 then trim(head, {WS})
                else {lit(P.CONTEXT_HEAD)} || trim(rest, {WS}) || {lit(P.CONTEXT_TAIL)} || trim(head, {WS}) end as question,
           cast(null as varchar) as label
    from base
    """,
)
def context_prompt(t: Tables) -> DataFrame:
    raw = head_rest(t.spread_documents).select(
        F.col("doc_id").alias("q_idx"),
        F.col("head").alias("question"),
        F.when(F.col("doc_id") % 3 != 0, F.col("rest")).alias("context"),
    )
    return P.build_prompts(raw, "financeqa")


@query(
    "plain_prompts",
    f"""
    with {BASE_SQL}
    select 'simpleqa' as bench, doc_id as q_idx, trim(text, {WS}) as first_turn, cast(null as varchar) as second_turn from base
    union all
    select 'aime', doc_id, head || {lit(P.REASONING_SUFFIX)}, null from base
    union all
    select 'mtbench', doc_id, head, rest from base
    """,
)
def plain_prompts(t: Tables) -> DataFrame:
    raw = head_rest(t.spread_documents).withColumnRenamed("doc_id", "q_idx")
    plain = P.build_prompts(raw.withColumnRenamed("text", "problem"), "simpleqa")
    contest = P.build_prompts(
        raw.select("q_idx", F.col("head").alias("Problem"), F.col("lang").alias("Answer")), "aime"
    )
    one = plain.unionByName(contest).select(
        "bench", "q_idx", F.col("question").alias("first_turn"), F.lit(None).cast("string").alias("second_turn")
    )
    talk = P.build_prompts(raw.withColumn("turns", F.array("head", "rest")), "mtbench").select(
        "bench",
        "q_idx",
        F.col("question.question_1").alias("first_turn"),
        F.col("question.question_2").alias("second_turn"),
    )
    return one.unionByName(talk)


@query(
    "options_parse",
    f"""
    with {BASE_SQL}, answered as (
        select doc_id, head, lang, source, doc_id % 4 = 0 as bare,
               case doc_id % 5 when 0 then ' b' when 1 then 'C' when 2 then 'D' when 3 then 'AB' else 'a' end as answer
        from base)
    select 'mmstar' as bench, doc_id as q_idx, trim(head, {WS}) as question,
           case when length(trim(answer)) = 1 and (bare or trim(upper(answer)) <= 'C')
                then trim(upper(answer)) end as label
    from answered
    """,
)
def options_parse(t: Tables) -> DataFrame:
    listed = F.concat(
        "head", F.lit("\nOptions:\n A. "), "lang", F.lit("\nnot an option\nB.  "), "source", F.lit("\n  C.x\n")
    )
    answer = F.get(
        F.array(*[F.lit(a) for a in (" b", "C", "D", "AB", "a")]), (F.col("doc_id") % 5).cast("int")
    )
    raw = head_rest(t.spread_documents).select(
        F.col("doc_id").alias("q_idx"),
        F.when(F.col("doc_id") % 4 == 0, F.col("head")).otherwise(listed).alias("question"),
        answer.alias("answer"),
    )
    return P.build_prompts(raw, "mmstar")


# ---------------------------------------------------------------- extraction

# Model outputs made from the documents, in the forms the extractors look for.
OUTPUTS_SQL = """
    outputs as (
        select doc_id as q_idx, source, substr('ABCD', cast(doc_id % 4 as int) + 1, 1) as letter,
               case doc_id % 8
                 when 0 then text || ' Answer: ' || substr('ABCD', cast(doc_id % 5 % 4 as int) + 1, 1)
                 when 1 then 'so \\boxed{' || (doc_id % 1000) || '}'
                 when 2 then 'Answer: ' || doc_id || '.50'
                 when 3 then 'total 1,' || (100 + doc_id % 900)
                 when 4 then '(' || substr('ABCD', cast(doc_id % 4 as int) + 1, 1) || ') is right'
                 when 5 then 'none'
                 when 6 then 'it equals ' || doc_id
                 else text end as output
        from documents)
"""


def outputs(t: Tables) -> DataFrame:
    doc = F.col("doc_id")

    def letter(index: Column) -> Column:
        return F.substring(F.lit("ABCD"), (index + 1).cast("int"), F.lit(1))

    forms = [
        F.concat("text", F.lit(" Answer: "), letter(doc % 5 % 4)),
        F.concat(F.lit("so \\boxed{"), (doc % 1000).cast("string"), F.lit("}")),
        F.concat(F.lit("Answer: "), doc.cast("string"), F.lit(".50")),
        F.concat(F.lit("total 1,"), (100 + doc % 900).cast("string")),
        F.concat(F.lit("("), letter(doc % 4), F.lit(") is right")),
        F.lit("none"),
        F.concat(F.lit("it equals "), doc.cast("string")),
    ]
    output = F.when(doc % 8 == 0, forms[0])
    for i, form in enumerate(forms[1:], 1):
        output = output.when(doc % 8 == i, form)
    return t.spread_documents.select(
        doc.alias("q_idx"), "source", letter(doc % 4).alias("letter"), output.otherwise(F.col("text")).alias("output")
    )


LAST_INT_SQL = f"""
    ints as (
        select *, regexp_extract_all(replace(output, ',', ''), '[0-9]+')[-1] as d from outputs),
    last_int as (
        select *, case when d is null or regexp_matches(d, '^0+[1-9]') then '{A.INVALID}'
                       when regexp_matches(d, '^0+$') then '0' else d end as pred from ints)
"""


@query("ans_last_int", f"with {OUTPUTS_SQL}, {LAST_INT_SQL} select q_idx, pred from last_int")
def ans_last_int(t: Tables) -> DataFrame:
    return outputs(t).select("q_idx", A.extract_answer(F.col("output"), "last_integer").alias("pred"))


BOXED_SQL = rf"""
    boxed as (
        select *, case
            when regexp_matches(output, '\\boxed\{{([^}}]+)\}}') then trim(regexp_extract(output, '\\boxed\{{([^}}]+)\}}', 1), {WS})
            when regexp_matches(output, '\\boxed\s+([^\s]+)') then trim(regexp_extract(output, '\\boxed\s+([^\s]+)', 1), {WS})
            else coalesce(regexp_extract_all(output, '(?i)answer[\s:]+([-+]?\d*\.?\d+)', 1)[-1],
                          regexp_extract_all(output, '(?i)(?:is|equals?|=\s*)([-+]?\d*\.?\d+)\s*$', 1)[-1],
                          regexp_extract_all(output, '[-+]?\d*\.?\d+')[-1]) end as pred
        from outputs)
"""


@query("ans_boxed", f"with {OUTPUTS_SQL}, {BOXED_SQL} select q_idx, pred from boxed")
def ans_boxed(t: Tables) -> DataFrame:
    return outputs(t).select("q_idx", A.extract_answer(F.col("output"), "boxed").alias("pred"))


CONTEST_SQL = rf"""
    contest as (
        select *, case
            when regexp_matches(output, '\\boxed\{{([^}}]+)\}}')
              then coalesce(regexp_extract_all(regexp_extract(output, '\\boxed\{{([^}}]+)\}}', 1), '\d+')[-1],
                            trim(regexp_extract(output, '\\boxed\{{([^}}]+)\}}', 1), {WS}))
            else coalesce(nullif(regexp_extract(output, '\\boxed\s+(\d+)', 1), ''),
                          regexp_extract_all(output, '(?i)answer[\s:]+(\d+)', 1)[-1],
                          regexp_extract_all(output, '(?i)(?:is|equals?|=\s*)(\d+)\s*$', 1)[-1],
                          list_filter(regexp_extract_all(output, '[\p{{L}}\p{{N}}_]+'),
                                      lambda w: regexp_full_match(w, '0*\d{{1,3}}'))[-1]) end as pred
        from outputs)
"""


@query("ans_contest", f"with {OUTPUTS_SQL}, {CONTEST_SQL} select q_idx, pred from contest")
def ans_contest(t: Tables) -> DataFrame:
    return outputs(t).select("q_idx", A.extract_answer(F.col("output"), "contest").alias("pred"))


@query(
    "ans_marker",
    f"""
    with {OUTPUTS_SQL}
    select q_idx, case when contains(output, 'Answer: ') then trim(split_part(output, 'Answer: ', 2), {WS}) end as pred
    from outputs
    """,
)
def ans_marker(t: Tables) -> DataFrame:
    return outputs(t).select("q_idx", A.extract_answer(F.col("output"), "marker").alias("pred"))


LETTER_SQL = rf"""
    letters as (
        select *, coalesce(
            list_filter(regexp_extract_all(upper(output), '[\p{{L}}\p{{N}}_]+'), lambda w: w in ('A', 'B', 'C', 'D'))[1],
            nullif(regexp_extract(upper(output), '([ABCD])', 1), '')) as pred
        from outputs)
"""


@query("ans_letter", f"with {OUTPUTS_SQL}, {LETTER_SQL} select q_idx, pred from letters")
def ans_letter(t: Tables) -> DataFrame:
    return outputs(t).select("q_idx", A.extract_answer(F.col("output"), "letter").alias("pred"))


RANGED_SQL = rf"""
    firsts as (
        select *, case when q_idx % 6 = 0 then 4 else q_idx % 6 end as n,
               list_filter(regexp_extract_all(upper(output), '[\p{{L}}\p{{N}}_]+'),
                           lambda w: regexp_full_match(w, '[A-Z]'))[1] as alone,
               nullif(regexp_extract(upper(output), '\(([A-Z])\)', 1), '') as round_mark,
               nullif(regexp_extract(upper(output), '\[([A-Z])\]', 1), '') as square_mark,
               nullif(regexp_extract(upper(output), 'ANSWER[：:]\s*([A-Z])', 1), '') as word_mark
        from outputs),
    ranged as (
        select *, list_filter([alone, round_mark, square_mark, word_mark],
                              lambda l: l is not null and ascii(l) - 64 <= n)[1] as pred
        from firsts)
"""


@query("ans_letter_range", f"with {OUTPUTS_SQL}, {RANGED_SQL} select q_idx, pred from ranged")
def ans_letter_range(t: Tables) -> DataFrame:
    pred = A.ranged_letter(F.col("output"), (F.col("q_idx") % 6).cast("int"))
    return outputs(t).select("q_idx", pred.alias("pred"))


# Extracted code in SQL, over a table with the column ``output``.
CODED_SQL = (
    rf"""
    starts as (select *, regexp_extract(output, '(?s)(def\s+\w+\([^)]*\):.*)', 1) as tail from {{source}}),
    coded as (
        select *, case
            when regexp_matches(output, '(?s)```(?:python)?\n(.*?)```') then trim(regexp_extract(output, '(?s)```(?:python)?\n(.*?)```', 1), {WS})
            when tail <> '' then trim(string_split_regex(tail, '\n\ndef\s')[1], {WS})
            else nullif(trim(output, {WS}), '') end as pred
        from starts)
"""
)

CODE_SQL = rf"""
    {BASE_SQL},
    programs as (
        select doc_id, head, case doc_id % 3
            when 0 then head || chr(10) || '```python' || chr(10) || text || chr(10) || '```' || rest
            when 1 then 'Sure. def f(a, b):' || chr(10) || '  ' || head || chr(10) || chr(10) || 'def g():' || chr(10) || rest
            else text end as output
        from base),
    {CODED_SQL.format(source="programs")}
"""


def programs(t: Tables) -> DataFrame:
    kind = F.col("doc_id") % 3
    fenced = F.concat("head", F.lit("\n```python\n"), "text", F.lit("\n```"), "rest")
    defined = F.concat(F.lit("Sure. def f(a, b):\n  "), "head", F.lit("\n\ndef g():\n"), "rest")
    output = F.when(kind == 0, fenced).when(kind == 1, defined).otherwise(F.col("text"))
    return head_rest(t.spread_documents).select("doc_id", "head", output.alias("output"))


@query("ans_code", f"with {CODE_SQL} select doc_id, pred from coded")
def ans_code(t: Tables) -> DataFrame:
    return programs(t).select("doc_id", A.extract_answer(F.col("output"), "code").alias("pred"))


@query(
    "code_assemble",
    f"""
    with {CODE_SQL}
    select doc_id, case when starts_with(pred, 'def ') and (doc_id % 4 = 0 or regexp_extract(pred, '^def\\s+(\\w+)\\s*\\(', 1)
                             = case doc_id % 4 when 1 then 'f' else 'h' end)
                        then pred else 'def f(a, b):' || chr(10) || pred end as program
    from coded
    """,
)
def code_assemble(t: Tables) -> DataFrame:
    entry = F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 4 == 1, "f").otherwise("h")
    return programs(t).select(
        "doc_id", A.assemble_code(F.lit("def f(a, b):"), A.code(F.col("output")), entry).alias("program")
    )


# ------------------------------------------------------------------ accuracy


def labelled(t: Tables, kind: str, label: Column) -> DataFrame:
    """Extracted answers with a gold label where the labels table has the row."""
    found = outputs(t).select("q_idx", "source", "letter", A.extract_answer(F.col("output"), kind).alias("pred"))
    gold = t.labels.select(F.col("doc_id").alias("q_idx"), "quality")
    return found.join(gold, "q_idx", "left").withColumn(
        "label", F.when(F.col("quality").isNotNull(), label)
    )


def accuracy_sql(made: str, label: str, judged: str, hit: str, gold: bool = True) -> str:
    known = f"case when quality is not null then {label} end" if gold else label
    ratio = "count(*) filter (where judged and hit) / nullif(count(*) filter (where judged), 0)"
    return f"""
    , named as (select m.*, {known} as label from {made} m left join labels l on m.q_idx = l.doc_id),
    tested as (select *, {judged} as judged, coalesce({hit}, false) as hit from named)
    select source, count(*) filter (where judged and hit) as correct, count(*) filter (where judged) as judged,
           count(pred) as valid, {ratio} as accuracy
    from tested group by source
    """


@query(
    "acc_exact",
    f"with {OUTPUTS_SQL}, {LAST_INT_SQL} "
    + accuracy_sql("last_int", "'1' || (100 + q_idx % 900)", "true", "pred = label", gold=False),
)
def acc_exact(t: Tables) -> DataFrame:
    found = outputs(t).withColumn("pred", A.last_integer(F.col("output")))
    gold = F.concat(F.lit("1"), (100 + F.col("q_idx") % 900).cast("string"))
    return SC.accuracy(found.withColumn("label", gold), "exact", by=("source",))


NUMBER_SQL = lit(SC.FLOAT_TEXT)


@query(
    "acc_numeric",
    f"with {OUTPUTS_SQL}, {BOXED_SQL} "
    + accuracy_sql(
        "boxed",
        "(q_idx % 1000) || '.0'",
        "label is not null",
        f"lower(pred) = lower(label) or (regexp_matches(lower(pred), {NUMBER_SQL}) "
        "and abs(try_cast(pred as double) - try_cast(label as double)) < 1e-6)",
    ),
)
def acc_numeric(t: Tables) -> DataFrame:
    gold = F.concat((F.col("q_idx") % 1000).cast("string"), F.lit(".0"))
    return SC.accuracy(labelled(t, "boxed", gold), "numeric", by=("source",))


@query(
    "acc_int",
    f"with {OUTPUTS_SQL}, {CONTEST_SQL} "
    + accuracy_sql(
        "contest",
        "'0' || (q_idx % 1000)",
        "label is not null",
        "pred = label or (regexp_matches(pred, '^[0-9]+$') and try_cast(pred as hugeint) = try_cast(label as hugeint))",
    ),
)
def acc_int(t: Tables) -> DataFrame:
    gold = F.concat(F.lit("0"), (F.col("q_idx") % 1000).cast("string"))
    return SC.accuracy(labelled(t, "contest", gold), "int", by=("source",))


@query(
    "acc_valid_only",
    f"with {OUTPUTS_SQL}, {LETTER_SQL} "
    + accuracy_sql("letters", "letter", "pred is not null", "pred = label", gold=False),
)
def acc_valid_only(t: Tables) -> DataFrame:
    found = outputs(t).withColumn("pred", A.choice_letter(F.col("output"))).withColumn("label", F.col("letter"))
    return SC.accuracy(found, "valid_only", by=("source",))


@query(
    "acc_letter",
    f"with {OUTPUTS_SQL}, {RANGED_SQL.replace('q_idx % 6 = 0', 'true')} "
    + accuracy_sql("ranged", "' ' || lower(letter)", "label is not null", "pred = upper(trim(label))"),
)
def acc_letter(t: Tables) -> DataFrame:
    gold = F.concat(F.lit(" "), F.lower("letter"))
    return SC.accuracy(labelled(t, "ranged_letter", gold), "letter", by=("source",))


# --------------------------------------------------------------- run metrics

FACTS_SQL = """
    facts as (
        select event_type as bench, cast(user_id % 3 as int) as cfg, cast(event_id % 2 as int) as run, event_id as q_idx,
               value as latency, cast(floor(value) as bigint) + 1 as completion_tokens,
               case when user_id % 3 = 0 then 0 else cast(floor(value / 3) as bigint) + 1 end as verify_ct
        from events),
    runs as (
        select bench, cfg, run, max(latency) as latency, cast(sum(completion_tokens) as bigint) as tokens,
               cast(sum(verify_ct) as bigint) as verified, count(*) as n
        from facts group by bench, cfg, run)
"""


def facts(t: Tables) -> DataFrame:
    cfg = (F.col("user_id") % 3).cast("int")
    return t.events.select(
        F.col("event_type").alias("bench"),
        cfg.alias("cfg"),
        (F.col("event_id") % 2).cast("int").alias("run"),
        F.col("event_id").alias("q_idx"),
        F.col("value").alias("latency"),
        (F.floor("value") + 1).alias("completion_tokens"),
        F.when(cfg == 0, 0).otherwise(F.floor(F.col("value") / 3) + 1).alias("verify_ct"),
    )


@query("throughput", f"with {FACTS_SQL} select bench, cfg, run, latency, tokens, tokens / latency as output_throughput from runs")
def throughput(t: Tables) -> DataFrame:
    return SC.run_metrics(facts(t), ("bench", "cfg", "run")).drop("accept_length")


@query(
    "accept_len",
    f"""
    with {FACTS_SQL}
    select bench, cfg, run, tokens, case when verified = 0 then 1.0::double else tokens / verified end as accept_length
    from runs
    """,
)
def accept_len(t: Tables) -> DataFrame:
    return SC.run_metrics(facts(t), ("bench", "cfg", "run")).select("bench", "cfg", "run", "tokens", "accept_length")


@query(
    "run_avg",
    f"""
    with {FACTS_SQL}
    select bench, cfg, avg(latency) as latency, avg(tokens / latency) as output_throughput,
           avg(case when verified = 0 then 1.0::double else tokens / verified end) as accept_length
    from runs group by bench, cfg
    """,
)
def run_avg(t: Tables) -> DataFrame:
    return SC.average_runs(SC.run_metrics(facts(t), ("bench", "cfg", "run")), ("bench", "cfg"))


SPEC_SQL = """
    specs as (
        select source, case count(*) % 4 when 0 then source when 1 then source || ':' || count(*)
                            when 2 then source || ':' || count(*) || ':a,b' else source || ':x:y:z' end as spec
        from documents group by source)
"""


def specs(t: Tables) -> DataFrame:
    n = F.col("n").cast("string")
    spec = (
        F.when(F.col("n") % 4 == 0, F.col("source"))
        .when(F.col("n") % 4 == 1, F.concat("source", F.lit(":"), n))
        .when(F.col("n") % 4 == 2, F.concat("source", F.lit(":"), n, F.lit(":a,b")))
        .otherwise(F.concat("source", F.lit(":x:y:z")))
    )
    return t.documents.groupBy("source").agg(F.count("*").alias("n")).select(spec.alias("spec"))


@query(
    "bench_spec",
    f"""
    with {SPEC_SQL}, parts as (select spec, string_split(spec, ':') as p from specs)
    select spec, p[1] as bench, coalesce(try_cast(p[2] as int), -1) as num_samples,
           array_to_string(string_split(p[3], ','), '+') as subsets,
           case when len(p) > 3 then 'invalid benchmark format' end as error
    from parts
    """,
)
def bench_spec(t: Tables) -> DataFrame:
    parsed = SC.parse_specs(specs(t))
    # No sample limit is shown as -1.
    return parsed.withColumn("subsets", F.array_join("subsets", "+")).withColumn(
        "num_samples", F.coalesce("num_samples", F.lit(-1))
    )


@query(
    "config_grid",
    f"""
    with {SPEC_SQL}, configs(batch_size, steps, topk, num_draft_tokens) as (values (1, 0, 0, 0), (1, 3, 1, 4), (8, 5, 1, 6))
    select spec, batch_size, steps, topk, num_draft_tokens from specs, configs
    """,
)
def config_grid(t: Tables) -> DataFrame:
    return SC.config_grid(specs(t), ["1,0,0,0", "1,3,1,4", "8,5,1,6"])


@query(
    "bench_nest",
    f"""
    with {FACTS_SQL},
    lists as (
        select bench, cfg, string_agg('{{"run":' || run || ',"tokens":' || tokens || '}}', ',' order by run) as metrics
        from runs group by bench, cfg)
    select bench, '[' || string_agg('{{"batch_size":1,"steps":' || cfg || ',"topk":1,"num_draft_tokens":' || (cfg + 1)
               || ',"metrics":[' || metrics || ']}}', ',' order by cfg) || ']' as results
    from lists group by bench
    """,
)
def bench_nest(t: Tables) -> DataFrame:
    runs = SC.run_metrics(facts(t), ("bench", "cfg", "run")).select(
        "bench",
        F.lit(1).alias("batch_size"),
        F.col("cfg").alias("steps"),
        F.lit(1).alias("topk"),
        (F.col("cfg") + 1).alias("num_draft_tokens"),
        "run",
        "tokens",
    )
    return SC.nest_results(runs)


# ------------------------------------------------------------ whole benchmarks

# Predictions of each extractor in SQL: the tables before, and the one with ``pred``.
PREDICTIONS = {
    "last_integer": (f"{OUTPUTS_SQL}, {LAST_INT_SQL}", "last_int"),
    "contest": (f"{OUTPUTS_SQL}, {CONTEST_SQL}", "contest"),
    "boxed": (f"{OUTPUTS_SQL}, {BOXED_SQL}", "boxed"),
    "marker": (
        f"{OUTPUTS_SQL}, marked as (select *, case when contains(output, 'Answer: ') "
        f"then trim(split_part(output, 'Answer: ', 2), {WS}) end as pred from outputs)",
        "marked",
    ),
    "letter": (f"{OUTPUTS_SQL}, {LETTER_SQL}", "letters"),
    "ranged_letter": (
        rf"""{OUTPUTS_SQL}, ranged as (
            select *, list_filter([
                list_filter(regexp_extract_all(upper(output), '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z]'))[1],
                nullif(regexp_extract(upper(output), '\(([A-Z])\)', 1), ''),
                nullif(regexp_extract(upper(output), '\[([A-Z])\]', 1), ''),
                nullif(regexp_extract(upper(output), 'ANSWER[：:]\s*([A-Z])', 1), '')],
                lambda l: l is not null and l between 'A' and 'D')[1] as pred
            from outputs)""",
        "ranged",
    ),
    "code": (f"{OUTPUTS_SQL}, {CODED_SQL.format(source='outputs')}", "coded"),
    "as_is": (f"{OUTPUTS_SQL}, plain as (select *, output as pred from outputs)", "plain"),
}
LETTER_LABEL = "substr('ABCD', cast(q_idx % 4 as int) + 1, 1)"
NUMBER_LABEL = "cast(q_idx % 1000 as varchar)"
EXACT = "pred is not distinct from label"
# Benchmark: extractor, label, rule, rows the rule judges.
SCORED = {
    "gsm8k": ("last_integer", NUMBER_LABEL, EXACT, "true"),
    "aime": ("contest", NUMBER_LABEL, "trim(pred) = label or try_cast(trim(pred) as bigint) = cast(label as bigint)", "true"),
    "math500": ("boxed", NUMBER_LABEL, "lower(pred) = label or abs(try_cast(pred as double) - cast(label as double)) < 1e-6", "true"),
    "gpqa": ("marker", f"substr('ABCD', {PLACE_SQL.replace('doc_id', 'q_idx')} + 1, 1)", EXACT, "true"),
    "mmlu": ("marker", LETTER_LABEL, EXACT, "true"),
    "ceval": ("letter", LETTER_LABEL, EXACT, "pred is not null"),
    "mmstar": ("ranged_letter", LETTER_LABEL, "upper(trim(pred)) = label", "true"),
    "livecodebench": ("as_is", "null", None, "true"),
    "financeqa": ("as_is", "null", None, "true"),
    "simpleqa": ("as_is", "null", None, "true"),
    "mtbench": ("as_is", "null", None, "true"),
    "humaneval": ("code", "null", None, "true"),
}


ASKED = {
    "aime": "Problem",
    "gpqa": "Question",
    "math500": "problem",
    "simpleqa": "problem",
    "livecodebench": "question_content",
    "humaneval": "prompt",
}


def question_table(t: Tables, bench: str) -> DataFrame:
    """A table with the columns that the benchmark asks for."""
    doc = F.col("doc_id")
    letter = F.substring(F.lit("ABCD"), (doc % 4 + 1).cast("int"), F.lit(1))
    number = (doc % 1000).cast("string")
    return t.documents.select(
        doc.alias("q_idx"),
        F.lit("Which?").alias(ASKED.get(bench, "question")),
        F.lit("Since.").alias("context"),
        F.array(F.lit("one"), F.lit("two")).alias("turns"),
        F.array(*[F.lit(x) for x in ("k", "l", "m", "n")]).alias("choices"),
        *[F.lit(f"w{i}").alias(f"Incorrect Answer {i}") for i in (1, 2, 3)],
        F.lit("c").alias("Correct Answer"),
        letter.alias("letter"),
        number.alias("number"),
    )


def score_query(bench: str):
    extractor, label, rule, judged = SCORED[bench]
    tables, predicted = PREDICTIONS[extractor]
    ratio = f"sum(cast(coalesce({rule}, false) and {judged} as int)) / nullif(count(*) filter (where {judged}), 0)"
    if bench == "ceval":
        ratio = f"coalesce({ratio}, 0)"
    sql = f"""
        with {tables}, labelled as (select *, {label} as label from {predicted})
        select '{bench}' as bench, source as run, cast(1.5 as double) as latency,
               sum(q_idx % 50 + 1) / 1.5 as output_throughput,
               sum(q_idx % 50 + 1) / sum(q_idx % 7 + 1) as accept_length,
               {f'cast({ratio} as double)' if rule else 'cast(null as double)'} as accuracy,
               count(*) as num_questions, count(pred) as num_valid_predictions
        from labelled group by source
    """

    def run(t: Tables) -> DataFrame:
        raw = question_table(t, bench)
        answer = {"mmlu": (F.col("q_idx") % 4), "gsm8k": F.col("number"), "math500": F.col("number"), "aime": F.col("number")}
        raw = raw.withColumn("answer", answer.get(bench, F.col("letter")))
        given = outputs(t).select(
            "q_idx",
            F.col("source").alias("run"),
            "output",
            F.lit(P.BENCHMARKS[bench].answer_keys[0]).alias("answer_key"),
            (F.col("q_idx") % 50 + 1).alias("completion_tokens"),
            (F.col("q_idx") % 7 + 1).alias("verify_ct"),
            F.lit(1.5).cast("double").alias("latency"),
        )
        return SC.score_benchmark(P.build_prompts(raw, bench), given, bench)

    query(f"score_{bench}", sql)(run)


for _bench in SCORED:
    score_query(_bench)
