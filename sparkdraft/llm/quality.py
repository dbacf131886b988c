"""Quality rules: one threshold table, compiled into one projection.

Nothing here leaves the JVM and nothing is shuffled: every measure is an
expression over the row's own text, so a text costs what its length costs.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdraft.functions.rows import evaluate_once
from sparkdraft.llm.common import query, text_or_empty, words_of


class Rule(NamedTuple):
    """A measure must lie in ``[low, high]``; a missing bound does not bind."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


# Symbols that count, closed-class words of the four languages, thresholds.
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the of and to in is that it for on with as was be by are this from at or an not "
    "de la le et les des en un une du que est pour dans qui sur par au plus pas avec ce "
    "der die und das den von zu mit ist im dem nicht ein eine auf für als auch sich es "
    "el los las y se con por para su al lo como una del no si"
).split()
WINDOW = 5

#: Floors on words and ceilings on repeated words are the base rules.
BASE_RULES = (
    Rule("few_words", "n_words", low=10),
    Rule("repeated_words", "repeat_ratio", high=0.2),
)
RULES = (
    Rule("word_length", "mean_word_length", low=2.0, high=16.0),
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("stop_words", "stop_word_ratio", low=0.02),
    Rule("duplicate_lines", "duplicate_line_ratio", high=0.35),
)


def _repeated(windows: Column) -> Column:
    """How many words lie in a window that occurs twice or more.

    Texts without a repeated window, which is most of them, end at the
    comparison of two sizes.  Otherwise the windows are sorted with their
    places, and the places next to an equal window are summed as intervals.
    """

    def covered(pairs: Column) -> Column:
        def twin(pair: Column, i: Column) -> Column:
            h = pair["h"]
            return (F.get(pairs, i - 1)["h"].eqNullSafe(h)) | (F.get(pairs, i + 1)["h"].eqNullSafe(h))

        places = F.sort_array(
            F.filter(
                F.transform(pairs, lambda p, i: F.when(twin(p, i), p["i"])), lambda p: p.isNotNull()
            )
        )
        return F.aggregate(
            places,
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
            lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(windows) == F.size(F.array_distinct(windows)), F.lit(0)).otherwise(
        F.transform(F.array(pairs), covered)[0]
    )


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and all measures of every row's whole text.

    A null text counts as an empty one, all of whose counts and ratios are
    zero.  Null or repeated keys are kept as they are, one row for one row;
    other columns are not looked at.  Windows of five words are compared by a
    64-bit hash chained over the words.
    """
    source = docs.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("text"))
    worded = evaluate_once(source.select("*", words_of(F.col("text")).alias("words")))
    n = F.size("words")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stop = F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS)))
    windows = F.when(
        n >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), n - WINDOW),
            lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    counted = evaluate_once(
        worded.select(
            "doc_id",
            n.cast("bigint").alias("n_words"),
            F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
            F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("bigint").alias("n_symbols"),
            stop.cast("bigint").alias("n_stop_words"),
            lines.alias("lines"),
            windows.alias("windows"),
        )
    )
    whole = evaluate_once(
        counted.select(
            "doc_id",
            "n_words",
            "word_chars",
            "n_symbols",
            "n_stop_words",
            F.size("lines").cast("bigint").alias("n_lines"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
            _repeated(F.col("windows")).cast("bigint").alias("n_repeat_words"),
        )
    )

    def share(top: str, of: str) -> Column:
        return F.when(F.col(of) > 0, F.col(top) / F.col(of)).otherwise(F.lit(0.0))

    return whole.select(
        "*",
        share("word_chars", "n_words").alias("mean_word_length"),
        share("n_symbols", "n_words").alias("symbol_ratio"),
        # One word more, so that a text too short to tell passes.
        F.when(F.col("n_words") > 0, (F.col("n_stop_words") + 1) / F.col("n_words"))
        .otherwise(F.lit(0.0))
        .alias("stop_word_ratio"),
        share("n_dup_lines", "n_lines").alias("duplicate_line_ratio"),
        (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words")).alias("base_repeats"),
        share("n_repeat_words", "n_words").alias("repeat_ratio"),
    )


def fails(rule: Rule) -> Column:
    """Whether a row breaks the rule."""
    if rule == BASE_RULES[1]:  # in whole numbers, so that exactly a fifth is not lost to rounding
        return F.col("base_repeats")
    low = F.lit(False) if rule.low is None else F.col(rule.measure) < rule.low
    high = F.lit(False) if rule.high is None else F.col(rule.measure) > rule.high
    return low | high


def quality_rules(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    base: tuple[Rule, ...] = BASE_RULES,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Measures, the names of the broken rules, and whether the row is kept."""

    def broken(table) -> Column:
        return F.array_compact(F.array(*[F.when(fails(r), F.lit(r.name)) for r in table])) if table else F.array()

    def any_of(table) -> Column:
        return reduce(lambda a, b: a | b, [fails(r) for r in table], F.lit(False))

    return measures(docs, key, text).select(
        "*",
        F.array_join(broken((*base, *rules)), ",").alias("failed_rules"),
        any_of(base).alias("base_failed"),
        (~any_of((*base, *rules))).alias("kept"),
    )


def _sql() -> str:
    """The same in DuckDB, from lists of words unnested into windows."""
    bounds = " and ".join(
        f"not ({' or '.join(x for x in ((f'{r.measure} < {r.low}' if r.low is not None else ''), (f'{r.measure} > {r.high}' if r.high is not None else '')) if x)})"
        for r in RULES
    )
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
with t as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text from documents
), w as (
  select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from t
), g as (
  select r, i, array_to_string(words[i + 1 : i + {WINDOW}], ' ') as gram
  from (select r, words, unnest(range(0, len(words) - {WINDOW - 1})) as i from w)
), d as (
  select r, i from (select r, i, count(*) over (partition by r, gram) as n from g) where n > 1
), c as (
  select r, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) as n
  from (select r, i, lead(i) over (partition by r order by i) as nxt from d) group by r
), m as (
  select doc_id, len(words)::bigint as n_words,
    length(array_to_string(words, ''))::bigint as word_chars,
    length(regexp_replace(text, '[^{SYMBOLS}]+', '', 'g'))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(c.n, 0)::bigint as n_repeat_words,
    len(list_filter(words, lambda x: lower(x) in ({stops}))) as n_stop_words, len(lines) as n_lines
  from w left join c using (r)
), q as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
    case when n_words > 0 then word_chars / n_words else 0 end as mean_word_length,
    case when n_words > 0 then n_symbols / n_words else 0 end as symbol_ratio,
    case when n_words > 0 then (n_stop_words + 1) / n_words else 0 end as stop_word_ratio,
    case when n_lines > 0 then n_dup_lines / n_lines else 0 end as duplicate_line_ratio
  from m
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and {bounds} as kept
from q"""


@query("op9_quality_rules", sql=_sql())
def op9(documents: DataFrame) -> DataFrame:
    """The contract's columns of every document."""
    return quality_rules(documents).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
