"""Queries over sources, normalisers, sampling and splitting."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdraft.functions.hashing import leading_number
from sparkdraft.functions.rows import evaluate_once, explode_rows
from sparkdraft.operators import sampling as S
from sparkdraft.operators.rowindex import with_row_index
from sparkdraft.operators.turns import start_role_rejects
from sparkdraft.plans.registry import Tables, query
from sparkdraft.schemas import require_columns
from sparkdraft.session import shared_folder
from sparkdraft.sources import files, jsonl
from sparkdraft.sources import normalise as N
from sparkdraft.sources.catalog import judge_corpus, normalise_corpus

# A document's first line serves as the question, the rest as the answer.
HEAD_SQL = "split_part(text, chr(10), 1)"
REST_SQL = f"substr(text, length({HEAD_SQL}) + 2)"


def head_rest(docs: DataFrame) -> DataFrame:
    head = F.substring_index("text", "\n", 1)
    return docs.withColumn("head", head).withColumn("rest", F.expr("substr(text, length(head) + 2)"))


def exploded(df: DataFrame, *keep: str) -> DataFrame:
    return explode_rows(df, F.col("conversations"), *keep, item="m").select(*keep, "pos", "m.role", "m.content")


def turns_sql(select_id: str, user: str, assistant: str, source: str = "documents", extra: str = "") -> str:
    """Two rows per document: its question and its answer."""
    return f"""
        with base as (select *, {HEAD_SQL} as head, {REST_SQL} as rest from {source})
        select {select_id} as id, 0 as pos, 'user' as role, {user} as content{extra} from base
        union all
        select {select_id} as id, 1 as pos, 'assistant' as role, {assistant} as content{extra} from base
    """


def dirty_lines(docs: DataFrame) -> DataFrame:
    """JSON lines with every defect the reader must survive, one kind per row."""
    user = F.to_json(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    nested = F.concat(
        F.lit('{"conversations": [{"role":"user","content":[{"type":"text","text":"x'),
        F.col("doc_id").cast("string"),
        F.lit('"}]},{"role":"assistant","content":"ok","tool_calls":{"f":1}}]}'),
    )
    kind = F.col("doc_id") % 8
    return docs.select(
        "doc_id",
        F.when(kind == 0, F.lit("   "))
        .when(kind == 1, F.concat(F.lit('{"conversations": ['), user))
        .when(kind == 2, F.lit('{"conversations": null}'))
        .when(kind == 3, F.lit('{"conversations": "none"}'))
        .when(kind == 4, F.lit('{"other": 1}'))
        .when(kind == 5, F.concat(F.lit('{"conversations": ["junk",'), user, F.lit(",7]}")))
        .when(kind == 6, nested)
        .otherwise(F.concat(F.lit('{"id": 1, "conversations": ['), user, F.lit("]}")))
        .alias("value"),
    )


@query(
    "src_jsonl_clean",
    """
    select doc_id, 0 as pos, 'user' as role,
           case when doc_id % 8 = 6 then '[{"type":"text","text":"x' || doc_id || '"}]' else text end as content,
           cast(null as varchar) as tool_calls
    from documents where doc_id % 8 in (5, 6, 7)
    union all
    select doc_id, 1, 'assistant', 'ok', '{"f":1}' from documents where doc_id % 8 = 6
    union all
    select doc_id, -1, null, null, null from documents where doc_id % 8 in (2, 4)
    """,
)
def src_jsonl_clean(t: Tables) -> DataFrame:
    good, _ = jsonl.clean_lines(dirty_lines(t.spread_documents))
    # An empty conversation is shown as place -1.
    spread = jsonl.as_messages(good).select("doc_id", F.posexplode_outer("conversations").alias("pos", "m"))
    return spread.select(
        "doc_id", F.coalesce("pos", F.lit(-1)).alias("pos"), "m.role", "m.content", "m.tool_calls"
    )


@query(
    "src_jsonl_rejects",
    """
    select case when doc_id % 8 = 1 then 'invalid json' else 'conversations is not a list' end as reason,
           count(*) as n
    from documents where doc_id % 8 in (1, 3) group by 1
    """,
)
def src_jsonl_rejects(t: Tables) -> DataFrame:
    _, rejects = jsonl.clean_lines(dirty_lines(t.spread_documents))
    return rejects.groupBy("reason").agg(F.count("*").alias("n"))


@query("union_subsets", "select lang as subset, doc_id, n_chars from documents")
def union_subsets(t: Tables) -> DataFrame:
    return files.tag_subsets(t.documents.select("lang", "doc_id", "n_chars"), "lang")


@query(
    "merge_files",
    """
    select 'documents' as subset, doc_id as id, text from documents
    union all select 'benchmark', item_id, text from benchmark
    """,
)
def merge_files(t: Tables) -> DataFrame:
    return files.merge_sources(
        {
            "documents": t.documents.select(F.col("doc_id").alias("id"), "text"),
            "benchmark": t.benchmark.select(F.col("item_id").alias("id"), "text"),
        }
    ).select("subset", "id", "text")


@query("preformatted_source", "select cast(doc_id as varchar) as id, text from documents where text <> ''")
def preformatted_source(t: Tables) -> DataFrame:
    rows = require_columns(t.documents, "text").select(F.col("doc_id").cast("string").alias("id"), "text")
    return rows.filter("text <> ''")


@query(
    "sample_bucket",
    """
    select vec_id, 'rows_' || (vec_id - vec_id % 100) || '-' || (vec_id - vec_id % 100 + 100) as bucket,
           'rows_' || (vec_id - vec_id % 100) || '-' || (vec_id - vec_id % 100 + 100)
               || '/data_' || vec_id || '.ckpt' as path
    from embeddings
    """,
)
def sample_bucket(t: Tables) -> DataFrame:
    idx = F.col("vec_id")
    return t.embeddings.select(
        "vec_id", files.sample_bucket(idx, 100).alias("bucket"), files.sample_path(idx, 100).alias("path")
    )


@query(
    "sample_status",
    """
    select 'rows_' || (vec_id - vec_id % 100) || '-' || (vec_id - vec_id % 100 + 100) as bucket, 'ok' as status,
           count(*) as rows, cast(sum(len(embedding)) as bigint) as numbers
    from embeddings group by all
    union all select 'rows_none', 'empty', 0, null
    union all select 'rows_torn', 'damaged', 0, null
    """,
)
def sample_status(t: Tables) -> DataFrame:
    """Samples and the state of their files from one read; one folder has no rows, one files of another kind."""
    path = f"{shared_folder(t.spark)}/samples-{uuid.uuid4().hex}"
    samples = t.embeddings.select(F.col("vec_id").alias("sample_idx"), "embedding")
    files.write_samples(samples, path, group_size=100)
    samples.filter("false").write.parquet(f"{path}/bucket=rows_none")
    samples.select(F.col("sample_idx").cast("string")).write.text(f"{path}/bucket=rows_torn")
    found = files.sample_files(t.spark, path, samples.schema, ("parquet", "txt"))
    return found.groupBy(F.regexp_extract("path", "bucket=([^/]+)", 1).alias("bucket"), "status").agg(
        F.count("sample").alias("rows"), F.sum(F.size("sample.embedding")).cast("bigint").alias("numbers")
    )


@query(
    "cache_key",
    """
    select source, lang, md5(source || '-' || lang || '-2048-qwen-' || count(*)) as cache_key
    from documents group by source, lang
    """,
)
def cache_key(t: Tables) -> DataFrame:
    groups = t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"))
    parts = [F.col("source"), F.col("lang"), F.lit(2048), F.lit("qwen"), F.col("n")]
    return groups.select("source", "lang", files.cache_key_column(*parts).alias("cache_key"))


@query(
    "metric_long",
    """
    select 'run' || (user_id % 5) as run, event_type as mode, event_id as step,
           event_type || '/loss' as name, value from events
    union all
    select 'run' || (user_id % 5), event_type, event_id, event_type || '/k',
           cast(json_extract_string(props, '$.k') as double)
    from events where json_extract_string(props, '$.k') is not null
    """,
)
def metric_long(t: Tables) -> DataFrame:
    run = F.concat(F.lit("run"), (F.col("user_id") % 5).cast("string"))
    return files.metric_rows(
        t.events,
        run,
        F.col("event_type"),
        F.col("event_id"),
        {"loss": F.col("value"), "k": F.get_json_object("props", "$.k")},
    )


@query(
    "latest_epoch",
    """
    select event_type, 'out/' || event_type || '/epoch_' || max(event_id) as path, max(event_id) as epoch
    from events where event_id % 4 <> 3 group by event_type
    """,
)
def latest_epoch(t: Tables) -> DataFrame:
    # Every fourth path is not an epoch folder and must be passed over.
    leaf = F.when(F.col("event_id") % 4 == 3, "epoch_x").otherwise("epoch_")
    paths = t.events.select(
        "event_type",
        F.concat(F.lit("out/"), "event_type", F.lit("/"), leaf, F.col("event_id").cast("string")).alias("path"),
    )
    return files.latest_epoch(paths, by=("event_type",))


@query(
    "norm_messages",
    f"""
    with base as (select *, {HEAD_SQL} as head, {REST_SQL} as rest from documents where doc_id % 5 <> 0)
    select cast(doc_id as varchar) as id, 0 as pos, 'user' as role, head as content from base
    union all select cast(doc_id as varchar), 1, 'assistant', rest from base
    """,
)
def norm_messages(t: Tables) -> DataFrame:
    # Every fifth row opens with a role the adapter must reject.
    role = F.when(F.col("doc_id") % 5 == 0, "system").otherwise("user")
    raw = head_rest(t.spread_documents).select(
        F.col("doc_id").alias("prompt_id"),
        F.array(
            F.struct(role.alias("role"), F.col("head").alias("content")),
            F.struct(F.lit("assistant").alias("role"), F.col("rest").alias("content")),
        ).alias("messages"),
    )
    good, _ = N.messages_to_conversation(raw)
    return exploded(good, "id")


def speakers(turns: DataFrame) -> DataFrame:
    renamed = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt")
    return turns.withColumn("from", renamed.otherwise(F.col("role"))).drop("role")


@query(
    "norm_rolemap",
    """
    select conv_id, turn, case when role in ('user', 'assistant') then role end as role, text
    from conversations
    """,
)
def norm_rolemap(t: Tables) -> DataFrame:
    return N.rolemap_turns(speakers(t.conversations)).select("conv_id", "turn", "role", "text")


@query(
    "norm_skip_stats",
    """
    select count(*) filter (where turn = 0) as rows, count(*) filter (where role <> 'system') as kept,
           count(*) filter (where role = 'system') as skipped
    from conversations
    """,
)
def norm_skip_stats(t: Tables) -> DataFrame:
    mapped = N.rolemap_turns(speakers(t.conversations))
    return mapped.agg(
        F.count_if(F.col("turn") == 0).alias("rows"),
        F.count("role").alias("kept"),
        F.count_if(F.col("role").isNull()).alias("skipped"),
    )


@query(
    "skip_statistics",
    """
    select count(distinct conv_id) as rows, count(*) filter (where role <> 'system') as kept,
           count(*) filter (where role = 'system') as skipped
    from conversations
    """,
)
def skip_statistics(t: Tables) -> DataFrame:
    """The nested form through the operator itself; system is a speaker outside the map."""
    turn = F.struct("turn", F.col("from"), F.col("text").alias("value"))
    nested = speakers(t.conversations).groupBy(F.col("conv_id").alias("id")).agg(
        F.array_sort(F.collect_list(turn)).alias("conversations")
    )
    return N.skip_statistics(N.rolemap_conversation(nested))


@query(
    "norm_image",
    f"""
    with base as (
        select d.*, {HEAD_SQL} as head, {REST_SQL} as rest from documents d semi join labels using (doc_id))
    select cast(doc_id as varchar) as id, 'cache/img_' || doc_id || '.jpg' as image, 0 as pos,
           'user' as role, head as content from base
    union all
    select cast(doc_id as varchar), 'cache/img_' || doc_id || '.jpg', 1, 'assistant', '<image>' || chr(10) || rest
    from base
    """,
)
def norm_image(t: Tables) -> DataFrame:
    def said(who: str, what: Column) -> Column:
        return F.struct(F.lit(who).alias("from"), what.alias("value"))

    def name(key: str) -> Column:
        return F.concat(F.lit("img_"), F.col(key).cast("string"), F.lit(".jpg"))

    raw = head_rest(t.spread_documents).select(
        F.col("doc_id").alias("id"),
        name("doc_id").alias("image"),
        F.array(
            said("human", F.concat(F.lit(N.IMAGE_MARK), "head")),
            said("gpt", F.concat(F.lit(N.IMAGE_MARK), "rest")),
            said("system", F.lit("dropped")),
        ).alias("conversations"),
    )
    present = t.labels.select(F.concat(F.lit("cache/"), name("doc_id")).alias("path"))
    return exploded(N.image_conversation(raw, "cache", present), "id", "image")


@query("norm_qa_md5", turns_sql("md5(head || rest)", "head", "rest"))
def norm_qa_md5(t: Tables) -> DataFrame:
    raw = head_rest(t.spread_documents)
    return exploded(N.qa_to_conversation(raw, F.col("head"), F.col("rest")), "id")


@query(
    "norm_qa_coalesce",
    turns_sql(
        "case when doc_id % 3 = 0 then md5(head || rest) else cast(doc_id as varchar) end", "head", "rest"
    ),
)
def norm_qa_coalesce(t: Tables) -> DataFrame:
    raw = head_rest(t.spread_documents)
    own = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id").cast("string"))
    return exploded(N.qa_to_conversation(raw, F.col("head"), F.col("rest"), own), "id")


@query(
    "norm_mcq_concat",
    turns_sql(
        "md5(head || chr(10) || 'a) ' || lang || ' b) ' || source || rest)",
        "head || chr(10) || 'a) ' || lang || ' b) ' || source",
        "rest",
    ),
)
def norm_mcq_concat(t: Tables) -> DataFrame:
    raw = head_rest(t.spread_documents).select(
        F.col("head").alias("Problem"),
        F.concat(F.lit("a) "), "lang", F.lit(" b) "), "source").alias("options"),
        F.col("rest").alias("Rationale"),
    )
    return exploded(normalise_corpus("math_qa", raw), "id")


@query(
    "norm_mcq_shuffle",
    f"""
    with base as (
        select doc_id, {HEAD_SQL} as head, {REST_SQL} as rest, source as correct,
               [lang, case when doc_id % 4 = 0 then source else 'none' end, cast(n_chars as varchar), source] as a
        from documents),
    ranked as (
        select doc_id, a[i] as answer,
               row_number() over (partition by doc_id
                                  order by md5('7|' || doc_id || '|' || (i - 1)), a[i]) as slot
        from base, unnest([1, 2, 3, 4]) as u(i)),
    listed as (
        select doc_id, string_agg(substr('abcd', cast(slot as int), 1) || ') ' || answer, chr(10) order by slot) as opts
        from ranked group by doc_id),
    marked as (
        select r.doc_id, substr('abcd', cast(min(slot) as int), 1) as label
        from ranked r join base b on r.doc_id = b.doc_id and r.answer = b.correct group by r.doc_id),
    made as (
        select head || chr(10) || opts as u, rest || chr(10) || 'answer: ' || label || ') ' || correct as v
        from base join listed using (doc_id) join marked using (doc_id))
    select md5(u || v) as id, 0 as pos, 'user' as role, u as content from made
    union all select md5(u || v), 1, 'assistant', v from made
    """,
)
def norm_mcq_shuffle(t: Tables) -> DataFrame:
    wrong = [
        F.col("lang"),
        F.when(F.col("doc_id") % 4 == 0, F.col("source")).otherwise("none"),
        F.col("n_chars").cast("string"),
    ]
    made = N.mcq_to_conversation(
        head_rest(t.spread_documents), F.col("head"), wrong, F.col("source"), F.col("rest"), F.col("doc_id"), seed=7
    )
    return exploded(made, "id")


# Column names of the question/answer corpora, in the order user, assistant.
QA_COLUMNS = {
    "opc": ("instruction", "output"),
    "gsm8k": ("question", "answer"),
    "hendrycks_math": ("problem", "solution"),
    "codealpaca-20k": ("instruction", "output"),
    "opencodeinstruct": ("input", "output"),
    "magicoder-evol-instruct": ("instruction", "response"),
    "camel": ("message_1", "message_2"),
}


# Names of the other corpora, by the shape of their rows.
MESSAGE_CORPORA = ("ultrachat", "eaglechat")
SPEAKER_CORPORA = ("sharegpt", "magpie-qwen2.5-pro-1m-v0.1", "sharegpt4v", "allava4v")
NUMBERED_CORPORA = (
    "perfectblend",
    "perfectblend-llama3.1-8b-instruct",
    "perfectblend-llama3.3-70b-instruct",
    "perfectblend-llama4-scout-instruct",
    "perfectblend-llama4-maverick-instruct",
)


def names_sql(names) -> str:
    return f"unnest([{', '.join(repr(n) for n in names)}]) as u(corpus)"


@query(
    "corpus_catalog",
    f"""
    with base as (
        select *, {HEAD_SQL} as head, {REST_SQL} as rest, row_number() over (order by doc_id) - 1 as idx,
               [lang, 'none', cast(n_chars as varchar), source] as a
        from documents),
    ranked as (
        select doc_id, a[i] as answer,
               row_number() over (partition by doc_id order by md5('0|' || head || '|' || (i - 1)), a[i]) as slot
        from base, unnest([1, 2, 3, 4]) as u(i)),
    listed as (
        select doc_id, string_agg(substr('abcd', cast(slot as int), 1) || ') ' || answer, chr(10) order by slot) as opts
        from ranked group by doc_id),
    marked as (
        select r.doc_id, substr('abcd', cast(min(slot) as int), 1) as letter
        from ranked r join base b on r.doc_id = b.doc_id and r.answer = b.source group by r.doc_id),
    chosen as (
        select head || chr(10) || opts as u, rest || chr(10) || 'answer: ' || letter || ') ' || source as v
        from base join listed using (doc_id) join marked using (doc_id)),
    said as (
        select corpus, cast(doc_id as varchar) as id, head as u, rest as v
        from base, {names_sql((*MESSAGE_CORPORA, *SPEAKER_CORPORA))}
        union all
        select corpus, cast(idx as varchar), head, rest from base, {names_sql(NUMBERED_CORPORA)}
        union all
        select corpus, md5(head || rest), head, rest from base, {names_sql(QA_COLUMNS)}
        union all
        select 'math_qa', md5(head || chr(10) || lang || rest), head || chr(10) || lang, rest from base
        union all
        select 'sciq', md5(u || v), u, v from chosen)
    select corpus, count(*) as n, count(distinct id) as ids, min(id) as first_id, cast(2 * count(*) as bigint) as turns,
           cast(sum(length(u) + length(v)) as bigint) as chars,
           cast(sum(cast('0x' || substr(md5(id || '|user:' || u || '|assistant:' || v), 1, 8) as bigint)) as bigint) as digest
    from said group by corpus
    """,
)
def corpus_catalog(t: Tables) -> DataFrame:
    """Every named corpus from rows of its own shape: ids, turns, and a digest of the conversations."""
    base = evaluate_once(head_rest(t.spread_documents))
    doc = F.col("doc_id")

    def turns(name: str, text: str, *who: str) -> Column:
        texts = ("head", "rest", "lang")
        return F.array(*[F.struct(F.lit(w).alias(name), F.col(x).alias(text)) for w, x in zip(who, texts)])

    messages = turns("role", "content", "user", "assistant")
    # The third speaker is none of the known ones and left out.
    speakers = turns("from", "value", "human", "gpt", "narrator").alias("conversations")
    image = F.lit("a.png").alias("image")
    raw = {
        "ultrachat": [doc.alias("prompt_id"), messages.alias("messages")],
        "eaglechat": [doc.alias("id"), messages.alias("conversations")],
        "sharegpt": [doc.alias("id"), speakers],
        "magpie-qwen2.5-pro-1m-v0.1": [doc.alias("uuid"), speakers],
        "sharegpt4v": [doc.alias("id"), image, speakers],
        "allava4v": [doc.alias("id"), image, speakers],
        "math_qa": [F.col("head").alias("Problem"), F.col("lang").alias("options"), F.col("rest").alias("Rationale")],
        "sciq": [
            F.col("head").alias("question"),
            F.col("source").alias("correct_answer"),
            F.lit("none").alias("distractor1"),
            F.col("n_chars").cast("string").alias("distractor2"),
            F.col("lang").alias("distractor3"),
            F.col("rest").alias("support"),
        ],
    }
    for corpus in NUMBERED_CORPORA:
        raw[corpus] = [doc, speakers if corpus == "perfectblend" else messages.alias("conversations")]
    for corpus, (user, assistant) in QA_COLUMNS.items():
        raw[corpus] = [F.col("head").alias(user), F.col("rest").alias(assistant)]

    def part(corpus: str) -> DataFrame:
        position = "doc_id" if corpus in NUMBERED_CORPORA else None
        # Bound here, the conversations are built once for all that looks at them.
        good = evaluate_once(normalise_corpus(corpus, base.select(*raw[corpus]), position))
        lines = F.transform("conversations", lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
        chars = F.aggregate("conversations", F.lit(0), lambda n, m: n + F.length(m["content"]))
        return good.select(
            "id",
            F.size("conversations").alias("turns"),
            chars.alias("chars"),
            leading_number(F.md5(F.concat("id", F.lit("|"), F.array_join(lines, "|"))), 8).alias("digest"),
        )

    # Numbering takes a few small jobs for each corpus, which need not wait for each other.
    with ThreadPoolExecutor(len(NUMBERED_CORPORA)) as pool:
        parts = dict(zip(raw, pool.map(part, raw)))
    # One row per corpus and id first, so that the distinct count needs no second expand.
    sums = [F.sum(c).cast("bigint").alias(c) for c in ("turns", "chars", "digest")]
    merged = files.merge_sources(parts, "corpus").groupBy("corpus", "id").agg(F.count("*").alias("c"), *sums)
    return merged.groupBy("corpus").agg(
        F.sum("c").cast("bigint").alias("n"), F.count("*").alias("ids"), F.min("id").alias("first_id"), *sums
    )


JUDGED_SQL = f"""
    base as (select *, {HEAD_SQL} as head, {REST_SQL} as rest from documents),
    judged as (
        select 'ultrachat' as corpus, cast(doc_id as varchar) as id, 2 as messages, 0 as skipped,
               case when doc_id % 5 = 0 then 'role other than user or assistant' end as reason from base
        union all
        select 'sharegpt', cast(doc_id as varchar), case when doc_id % 4 = 0 then 1 else 2 end,
               case when doc_id % 4 = 0 then 1 else 0 end, null from base
        union all
        select 'allava4v', cast(doc_id as varchar), 2, 0, case when doc_id % 3 = 0 then 'image is missing' end from base
        union all
        select 'gsm8k', md5(head || rest), 2, 0, null from base)
"""


def judged_corpora(t: Tables) -> DataFrame:
    """Four corpora with odd roles, unknown speakers and missing images among their rows."""
    base = head_rest(t.spread_documents)
    doc = F.col("doc_id")

    def pair(name: str, who: Column, text: str, other: Column, said: str) -> Column:
        return F.array(
            F.struct(who.alias(name), F.col("head").alias(text)), F.struct(other.alias(name), F.col("rest").alias(said))
        )

    chat = pair("role", F.lit("user"), "content", F.when(doc % 5 == 0, "critic").otherwise("assistant"), "content")
    said = pair("from", F.lit("human"), "value", F.when(doc % 4 == 0, "narrator").otherwise("gpt"), "value")
    seen = pair("from", F.lit("human"), "value", F.lit("gpt"), "value")
    image = F.concat(doc.cast("string"), F.lit(".png"))
    present = t.documents.filter(doc % 3 != 0).select(F.concat(F.lit("images/"), image).alias("path"))
    parts = [
        judge_corpus("ultrachat", base.select(doc.alias("prompt_id"), chat.alias("messages"))),
        judge_corpus("sharegpt", base.select(doc.alias("id"), said.alias("conversations"))),
        judge_corpus(
            "allava4v", base.select(doc.alias("id"), image.alias("image"), seen.alias("conversations")), present=present
        ).drop("image"),
        judge_corpus("gsm8k", base.select(F.col("head").alias("question"), F.col("rest").alias("answer"))),
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.union(part)
    return merged


@query("corpus_rejects", f"with {JUDGED_SQL} select corpus, id, reason from judged where reason is not null")
def corpus_rejects(t: Tables) -> DataFrame:
    return judged_corpora(t).filter("reason is not null").select("corpus", "id", "reason")


@query(
    "sink_summary",
    f"""
    with {JUDGED_SQL}
    select corpus, reason, count(*) as rows, cast(sum(messages) as bigint) as kept, cast(sum(skipped) as bigint) as skipped
    from judged group by corpus, reason
    """,
)
def sink_summary(t: Tables) -> DataFrame:
    return N.sink_summary(judged_corpora(t))


@query("row_index", "select doc_id, cast(row_number() over (order by doc_id) - 1 as bigint) as idx from documents")
def row_index(t: Tables) -> DataFrame:
    return with_row_index(t.documents.select("doc_id"), "doc_id")


@query("head_sample", "select doc_id, lang, n_chars from documents order by doc_id limit 100")
def head_sample(t: Tables) -> DataFrame:
    return S.head_sample(t.documents.select("doc_id", "lang", "n_chars"), 100, "doc_id")


@query(
    "split_hash",
    """
    select doc_id, case when cast(('0x' || substr(md5('42|' || doc_id), 1, 8)) as bigint) / 4294967296.0 < 0.05
                        then 'test' else 'train' end as split
    from documents
    """,
)
def split_hash(t: Tables) -> DataFrame:
    return S.hash_split(t.documents.select("doc_id"), "doc_id")


@query(
    "split_exact",
    """
    select doc_id, case when row_number() over (order by md5('42|' || doc_id), doc_id)
                             <= ceil(0.05 * (select count(*) from documents)) then 'test' else 'train' end as split
    from documents
    """,
)
def split_exact(t: Tables) -> DataFrame:
    return S.hash_split(t.documents.select("doc_id"), "doc_id", exact=True)


@query(
    "seeded_shuffle",
    """
    select doc_id, cast(row_number() over (order by md5('42|' || doc_id), doc_id) - 1 as bigint) as position
    from documents
    """,
)
def seeded_shuffle(t: Tables) -> DataFrame:
    return S.shuffle_rank(t.documents.select("doc_id"), "doc_id")


@query("hash_shuffle", "select doc_id, md5('42|' || doc_id) as shuffle_key from documents")
def hash_shuffle(t: Tables) -> DataFrame:
    return S.hash_shuffle(t.documents.select("doc_id"), "doc_id")


@query(
    "drop_empty",
    """
    with base as (select doc_id, list_filter(string_split(text, chr(10)), lambda l: length(l) > 400) as lines
                  from documents)
    select doc_id, cast(len(lines) as int) as messages from base where len(lines) > 0
    """,
)
def drop_empty(t: Tables) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda l: F.length(l) > 400)
    convs = t.documents.select("doc_id", lines.alias("conversations"))
    return S.drop_empty(convs).select("doc_id", F.size("conversations").alias("messages"))


@query(
    "nan_screen",
    "select vec_id, label from embeddings where vec_id % 7 <> 0 and vec_id % 11 <> 0",
)
def nan_screen(t: Tables) -> DataFrame:
    nan = F.lit(float("nan")).cast("float")

    def spoiled(every: int) -> Column:
        return F.when(
            F.col("vec_id") % every == 0,
            F.transform("embedding", lambda x, i: F.when(i == F.col("vec_id") % 64, nan).otherwise(x)),
        ).otherwise(F.col("embedding"))

    rows = t.embeddings.select(
        "vec_id",
        "label",
        F.array(F.col("embedding"), spoiled(7)).alias("hidden_state"),
        spoiled(11).alias("aux_hidden_state"),
    )
    return S.drop_non_finite(rows, "hidden_state", "aux_hidden_state").select("vec_id", "label")


@query(
    "start_role_reject",
    """
    select conv_id, 'error' as status, 'Data starts with an assistant message' as error
    from conversations where turn = 0 and conv_id % 3 = 0
    """,
)
def start_role_reject(t: Tables) -> DataFrame:
    # Every third conversation is given an assistant opening.
    opening = (F.col("turn") == 0) & (F.col("conv_id") % 3 == 0)
    role = F.when(opening, "assistant").otherwise(F.col("role"))
    return start_role_rejects(t.conversations.withColumn("role", role))


@query(
    "cap_per_group",
    """
    select source, doc_id, n_chars from documents
    qualify row_number() over (partition by source order by doc_id) <= 25
    """,
)
def cap_per_group(t: Tables) -> DataFrame:
    return S.cap_per_group(t.documents.select("source", "doc_id", "n_chars"), "source", "doc_id", 25)


def word_sequences(docs: DataFrame) -> DataFrame:
    """Documents as sequences: a word's length is its id, odd ids count as loss."""
    ids = F.transform(F.split("text", " "), lambda w: F.length(w))
    made = docs.select(F.col("doc_id").alias("sample"), ids.alias("input_ids")).withColumn(
        "loss_mask", F.transform("input_ids", lambda x: x % 2)
    )
    return evaluate_once(made)


SEQ_SQL = """
    seqs as (
        select doc_id as sample, list_transform(string_split(text, ' '), lambda w: length(w)) as ids,
               list_transform(string_split(text, ' '), lambda w: length(w) % 2) as mask
        from documents)
"""


@query(
    "min_loss_filter",
    f"""
    with {SEQ_SQL}
    select sample, cast(len(ids) as int) as n, cast(list_sum(mask) as bigint) as loss_tokens from seqs
    where list_sum(mask) >= 32
    """,
)
def min_loss_filter(t: Tables) -> DataFrame:
    kept = S.min_loss_filter(word_sequences(t.spread_documents), block_size=16)
    return kept.select("sample", F.size("input_ids").alias("n"), S.total(F.col("loss_mask")).alias("loss_tokens"))


@query(
    "min_loss_report",
    f"""
    with {SEQ_SQL}, n as (
        select count(*) as before, count(*) filter (where list_sum(mask) >= 32) as after from seqs)
    select before, after, cast(after as double) / before as share from n
    """,
)
def min_loss_report(t: Tables) -> DataFrame:
    return S.min_loss_report(word_sequences(t.spread_documents), block_size=16)
