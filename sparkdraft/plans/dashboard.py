"""Queries over nested result files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdraft.functions.text import quote
from sparkdraft.operators import results as RS
from sparkdraft.plans.chat import lit
from sparkdraft.plans.registry import Tables, query

BASELINE = "no draft"
PREFIX = "Vendor-Draft"
# Which benchmark an event type stands for.
EVENT_BENCH = {
    "click": "gsm8k",
    "view": "math500",
    "purchase": "mtbench",
    "signup": "humaneval",
    "error": "gpqa",
}
BENCH_SQL = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in EVENT_BENCH.items()) + " end"

# Measured cells, then the flat table the reader must give.
FLAT_SQL = f"""
    cells as (
        select 'model-' || (event_id % 2) as target, {BENCH_SQL} as bench, cast(user_id % 3 as int) as cfg,
               case event_id // 2 % 3 when 0 then '{BASELINE}' when 1 then 'org/{PREFIX}-alpha' else 'org/beta' end as name,
               cast(sum(cast(floor(value * 100) as bigint)) as bigint) / count(*) as throughput,
               count(*) / 10.0::double as acc_len
        from events group by all),
    flat as (
        select c.target, case when c.name = '{BASELINE}' then 'None' else c.name end as draft,
               case when c.name = '{BASELINE}' then 'baseline'
                    else '1-' || (c.cfg + 1) || '-1-' || (c.cfg + 2) end as config,
               c.bench, c.throughput, c.acc_len, b.throughput as base_throughput, b.acc_len as base_acc_len
        from cells c
        left join cells b on b.name = '{BASELINE}' and b.target = c.target and b.bench = c.bench and b.cfg = c.cfg
        qualify row_number() over (partition by c.target, c.bench, draft, config order by c.cfg desc) = 1)
"""


def nested_results(t: Tables) -> DataFrame:
    """Events as the nested result table of a dashboard file.

    The lists hold one entry per setting and per draft.
    """
    names = [F.lit(x) for kv in EVENT_BENCH.items() for x in kv]
    name = (
        F.when(F.floor(F.col("event_id") / 2) % 3 == 0, BASELINE)
        .when(F.floor(F.col("event_id") / 2) % 3 == 1, f"org/{PREFIX}-alpha")
        .otherwise("org/beta")
    )
    cells = (
        t.events.select(
            F.concat(F.lit("model-"), (F.col("event_id") % 2).cast("string")).alias("target"),
            F.try_element_at(F.create_map(*names), F.col("event_type")).alias("benchmark_name"),
            (F.col("user_id") % 3).cast("int").alias("cfg"),
            name.alias("Name"),
            F.floor(F.col("value") * 100).alias("cents"),
        )
        .groupBy("target", "benchmark_name", "cfg", "Name")
        .agg(
            (F.sum("cents") / F.count("*")).alias("output_throughput"),
            (F.count("*") / F.lit(10.0)).alias("accept_length"),
        )
    )
    metric = F.struct("Name", "output_throughput", "accept_length")
    rows = cells.groupBy("target", "benchmark_name", "cfg").agg(
        F.array_sort(F.collect_list(metric)).alias("metrics")
    )
    setting = F.struct(
        F.lit(1).alias("batch_size"),
        (F.col("cfg") + 1).alias("steps"),
        F.lit(1).alias("topk"),
        (F.col("cfg") + 2).alias("num_draft_tokens"),
        "metrics",
    )
    return rows.groupBy("target", "benchmark_name").agg(
        F.array_sort(F.collect_list(setting)).alias("results")
    ).withColumn("key", F.col("benchmark_name"))


def flat(t: Tables) -> DataFrame:
    return RS.flatten_results(nested_results(t), BASELINE)


@query("bench_flatten", f"with {FLAT_SQL} select target, draft, config, bench, throughput, acc_len from flat")
def bench_flatten(t: Tables) -> DataFrame:
    return flat(t).drop("base_throughput", "base_acc_len")


@query(
    "baseline_join",
    f"with {FLAT_SQL} select target, draft, config, bench, base_throughput, base_acc_len from flat",
)
def baseline_join(t: Tables) -> DataFrame:
    return flat(t).drop("throughput", "acc_len")


@query(
    "speedup",
    f"with {FLAT_SQL} select target, draft, config, bench, round(throughput / base_throughput, 6) as speedup from flat",
)
def speedup(t: Tables) -> DataFrame:
    return RS.speedup(flat(t)).select(
        "target", "draft", "config", "bench", F.round("speedup", 6).alias("speedup")
    )


@query(
    "avg_speedup",
    f"""
    with {FLAT_SQL}
    select target, draft, config, round(avg(throughput / base_throughput), 6) as speedup, count(*) as benches
    from flat where base_throughput > 0 group by target, draft, config
    """,
)
def avg_speedup(t: Tables) -> DataFrame:
    return RS.average_speedup(flat(t)).withColumn("speedup", F.round("speedup", 6))


@query(
    "speedup_class",
    f"""
    with {FLAT_SQL}
    select target, draft, config, bench,
           case when acc_len / base_acc_len >= 2.0 then 'excellent' when acc_len / base_acc_len >= 1.5 then 'good'
                when acc_len / base_acc_len >= 1.1 then 'moderate' else 'neutral' end as class
    from flat
    """,
)
def speedup_class(t: Tables) -> DataFrame:
    named = RS.speedup_class(F.col("acc_len"), F.col("base_acc_len"))
    return flat(t).select("target", "draft", "config", "bench", named.alias("class"))


@query("distinct_models", f"with {FLAT_SQL} select distinct draft from flat")
def distinct_models(t: Tables) -> DataFrame:
    return RS.distinct_models(flat(t), "draft")


@query(
    "select_models",
    f"""
    with {FLAT_SQL}
    select target, draft, config, bench, throughput from flat where target = 'model-1' and draft = 'org/beta'
    """,
)
def select_models(t: Tables) -> DataFrame:
    return RS.select_rows(flat(t), target="model-1", draft="org/beta").select(
        "target", "draft", "config", "bench", "throughput"
    )


@query(
    "bench_pivot",
    f"with {FLAT_SQL} select target, draft, config, "
    + ", ".join(f"coalesce(max(round(throughput, 2)) filter (where bench = '{b}'), 0) as {b}" for b in RS.BENCHES)
    + " from flat group by target, draft, config",
)
def bench_pivot(t: Tables) -> DataFrame:
    return RS.pivot_results(flat(t))


DOMAIN_SQL = "case bench " + " ".join(f"when '{k}' then '{v}'" for k, v in RS.DOMAINS.items()) + " end"


@query(
    "domain_rollup",
    f"""
    with {FLAT_SQL}, placed as (select *, {DOMAIN_SQL} as domain from flat)
    select domain, bench, count(*) as n, round(avg(throughput), 6) as throughput,
           cast(grouping(domain, bench) as int) as level
    from placed group by rollup (domain, bench)
    """,
)
def domain_rollup(t: Tables) -> DataFrame:
    return RS.domain_rollup(flat(t))


@query(
    "config_label",
    f"""
    with {FLAT_SQL}, parts as (select distinct draft, config, string_split(config, '-') as p from flat)
    select draft, config, case when config = 'baseline' then 'Baseline Configuration'
        else 'batch_size: ' || p[1] || ', steps: ' || p[2] || ', num_draft_tokens: ' || p[4] end as label
    from parts
    """,
)
def config_label(t: Tables) -> DataFrame:
    parts = F.split("config", "-")
    known = flat(t).select("draft", "config").distinct()
    # One part is left unknown, to be passed over.
    label = RS.config_label(
        F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.lit(None), F.get(parts, F.lit(3)), F.col("config")
    )
    return known.select("draft", "config", label.alias("label"))


P_SQL = quote(PREFIX)


@query(
    "clean_names",
    f"""
    with named as (
        select doc_id, case doc_id % 6
            when 0 then 'org/{PREFIX}-' || source when 1 then '{PREFIX.lower()}/' || source || '//' || lang
            when 2 then '{PREFIX}' || source when 3 then '/' || lang when 4 then '{PREFIX}' else source || '/x' end as name
        from documents),
    one as (select *, regexp_replace(name, '(?i)(^|/){P_SQL}-', '\\1', 'g') as a from named),
    two as (select *, regexp_replace(a, '(?i)(^|/){P_SQL}/', '\\1', 'g') as b from one),
    three as (select *, case when regexp_matches(b, '(?i)^{P_SQL}([^-/]|$)') then substr(b, {len(PREFIX) + 1}) else b end as c from two),
    four as (select *, regexp_replace(c, '/+', '/', 'g') as d from three),
    five as (select *, case when length(d) > 1 then ltrim(d, '/') else d end as e from four)
    select doc_id, case when e = '' then name else e end as cleaned,
           string_split(case when e = '' then name else e end, '/')[-1] as label
    from five
    """,
)
def clean_names(t: Tables) -> DataFrame:
    kind = F.col("doc_id") % 6
    name = (
        F.when(kind == 0, F.concat(F.lit(f"org/{PREFIX}-"), "source"))
        .when(kind == 1, F.concat(F.lit(f"{PREFIX.lower()}/"), "source", F.lit("//"), "lang"))
        .when(kind == 2, F.concat(F.lit(PREFIX), "source"))
        .when(kind == 3, F.concat(F.lit("/"), "lang"))
        .when(kind == 4, F.lit(PREFIX))
        .otherwise(F.concat("source", F.lit("/x")))
    )
    named = t.documents.select("doc_id", name.alias("name"))
    return named.select(
        "doc_id",
        RS.clean_model_name(F.col("name"), PREFIX).alias("cleaned"),
        RS.model_label(F.col("name"), PREFIX).alias("label"),
    )
