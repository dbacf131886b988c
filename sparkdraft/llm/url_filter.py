"""URL filters whose rules are indexed by their rarest literal token.

A rule is a regular expression with the literal tokens that every URL it fits
must contain as whole tokens.  Token counts over all URLs say which of a rule's
tokens is the rarest; the rule is filed under that one alone.  The tokens of a
URL fetch the rules filed under them, and only those run their expression.

Rules are configuration.  Up to :data:`MAX_INDEXED` of them travel with the
tasks as one small index, and URLs are judged where they lie, without a shuffle.
A longer list stays a table, and URL tokens meet it in a join.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sparkdraft.llm.common import query, stored
from sparkdraft.session import importable

MAX_INDEXED = 100_000

_TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = str.maketrans({c: chr(ord(c) + 32) for c in map(chr, range(65, 91))})


def ascii_lower(text: str) -> str:
    return text.translate(_LOWER)


def lower_column(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Rule(NamedTuple):
    """``pattern`` is searched in ``host + '\\n' + path``; ``rank`` decides among rules that fit."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int


def tokens_of(text: str) -> tuple[str, ...]:
    return tuple(sorted(set(re.findall(_TOKEN, ascii_lower(text)))))


def address_rule(name: str, verdict: str) -> Rule:
    """``host/path``: the host and all its subdomains, paths that start with the rule's.

    The last token of a path that does not end in a separator may be the start of a
    longer one, so it is not a literal token.  Longer rules win over shorter ones.
    A host holds no slash and a path that is not empty starts with one: what comes before
    the first slash is the host, whatever line breaks either has.
    """
    host, slash, path = name.partition("/")
    path = slash + path
    rest = re.escape(path) or "(?![^/])"
    pattern = rf"\A(?:[^/]*\.)?{re.escape(ascii_lower(host))}\n{rest}"
    whole = re.sub(_TOKEN + r"\Z", "", ascii_lower(path))
    return Rule(name, verdict, pattern, tokens_of(host + whole), 1_000_000 + len(name))


def word_rule(word: str, verdict: str = "block") -> Rule:
    """A whole token of host or path; address rules win over it."""
    bare = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    either = "".join(f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else re.escape(c) for c in word)
    pattern = rf"(?<!{bare}){either}(?!{bare})"
    return Rule(word, verdict, pattern, tokens_of(word), len(word))


# The base rules, and words that mark hosts and paths nobody wants to train on.
BASE_RULES = (
    address_rule("net/", "block"),
    address_rule("example.net/en/", "allow"),
    address_rule("example.com/de/", "block"),
    address_rule("org/fr/", "allow"),
)
WORD_RULES = tuple(
    word_rule(w) for w in "spam-farm casino poker viagra porn xxx betting escort malware phishing warez".split()
)
#: The verdict where no rule fits.
OTHERWISE = "allow"


def address_columns(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null URL or one without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    parts = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    # A reluctant run from the start finds the first "://".
    return lower_column(F.regexp_extract(url, parts, 1)), F.regexp_extract(url, parts, 2)


def url_tokens(host: Column, path: Column) -> Column:
    both = lower_column(F.concat_ws("\n", host, path))
    return F.array_distinct(F.regexp_extract_all(both, F.lit(f"({_TOKEN})"), F.lit(1)))


def rule_index(addresses: DataFrame, rules: DataFrame, in_tasks: bool = False) -> DataFrame:
    """``rules`` with ``token``: the token of each that is rarest in all ``addresses``.

    Ties go to the token that sorts first; rules without a literal token keep null.
    Tokens are counted in the tasks first, so the shuffle moves only what occurs in a rule.
    ``in_tasks`` says that the rules are few enough to travel with the tasks; their tokens then do too.
    """
    literal = rules.select("rule", F.explode("tokens").alias("token"))
    wanted = literal.select("token").distinct()
    if in_tasks:
        wanted = F.broadcast(wanted)
    seen = addresses.select(F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
    counts = seen.join(wanted, "token").groupBy("token").agg(F.count("*").alias("n"))
    order = Window.partitionBy("rule").orderBy(F.coalesce("n", F.lit(0)), "token")
    rarest = (
        literal.join(counts, "token", "left")
        .withColumn("place", F.row_number().over(order))
        .filter("place = 1")
        .select("rule", "token")
    )
    return rules.join(rarest, "rule", "left").select("rule", "verdict", "pattern", "rank", "token")


_FOUND = T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])


def _judge_in_place(addresses: DataFrame, index: list) -> DataFrame:
    filed: dict[str, list] = {}
    for row in sorted(index, key=lambda r: (-r["rank"], r["rule"])):
        filed.setdefault(row["token"] or "", []).append(
            (-row["rank"], row["rule"], row["verdict"], row["pattern"])
        )

    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        compiled: dict[str, re.Pattern] = {}
        always = filed.get("", [])
        token = re.compile(_TOKEN)
        out = []
        for h, p in zip(host, path):
            text = f"{h}\n{p}"
            tokens = set(token.findall(ascii_lower(text)))
            candidates = sorted({c for t in tokens if t in filed for c in filed[t]} | set(always))
            for _, rule, verdict, pattern in candidates:
                if pattern not in compiled:
                    compiled[pattern] = re.compile(pattern)
                if compiled[pattern].search(text):
                    out.append((rule, verdict))
                    break
            else:
                out.append((None, None))
        return pd.DataFrame(out, columns=["rule", "verdict"])

    found = F.pandas_udf(judge, _FOUND)
    return addresses.withColumn("found", found("host", "path"))


def _judge_by_join(addresses: DataFrame, index: DataFrame) -> DataFrame:
    """The same for lists of any length: candidates by token, then one winner per address."""
    distinct = addresses.select("host", "path").distinct()
    # Rules without a token are filed under the empty one, which every address gets.
    with_empty = F.concat(F.array(F.lit("")), url_tokens(F.col("host"), F.col("path")))
    filed = index.withColumn("token", F.coalesce("token", F.lit("")))
    fits = (
        distinct.select("host", "path", F.explode(with_empty).alias("token"))
        .join(filed, "token")
        .filter(F.regexp_like(F.concat_ws("\n", "host", "path"), F.col("pattern")))
    )
    best = fits.groupBy("host", "path").agg(
        F.min(F.struct((-F.col("rank")).alias("a"), F.col("rule"), F.col("verdict"))).alias("found")
    )
    return addresses.join(best.select("host", "path", F.struct("found.rule", "found.verdict").alias("found")), ["host", "path"], "left")


def judge_urls(
    pages: DataFrame,
    rules: Iterable[Rule],
    key: str = "page_id",
    url: str = "url",
    otherwise: str = OTHERWISE,
    max_indexed: int = MAX_INDEXED,
) -> DataFrame:
    """``page_id, host, path, rule, verdict``, one row per input row.

    ``rule`` is the name of the rule that decided, of the highest rank and then by
    name; null where none fits.  Null URLs have an empty host and path.  Null or
    repeated keys are kept as they are; other columns are not looked at.
    """
    rules = list(rules)
    spark = pages.sparkSession
    importable(spark)
    host, path = address_columns(F.col(url))
    addresses = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    table = spark.createDataFrame(
        [(r.name, r.verdict, r.pattern, list(r.tokens), r.rank) for r in rules],
        "rule string, verdict string, pattern string, tokens array<string>, rank bigint",
    )
    index = rule_index(addresses, table, len(rules) <= max_indexed)
    if len(rules) <= max_indexed:
        judged = _judge_in_place(addresses, index.collect())
    else:
        judged = _judge_by_join(addresses, stored(index, "rules"))
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.lit(otherwise)).alias("verdict"),
    )


_WORDS_SQL = "|".join(re.escape(r.name) for r in WORD_RULES)


@query(
    "op1_url_filter",
    "pages",
    sql=rf"""
with a as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)([^?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)([^?#]*)', 2) as path
  from pages
), b as (
  select *, case
    when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule,
    regexp_matches(host || chr(10) || translate(path,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '(^|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])({_WORDS_SQL})([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]|$)') as word
  from a
)
select page_id, host, path, rule, case
  when rule in ('example.net/en/', 'org/fr/') then 'allow'
  when rule is not null or word then 'block' else 'allow' end as verdict
from b""",
)
def op1(pages: DataFrame) -> DataFrame:
    """The contract's columns of every page: only base rules are named."""
    named = [r.name for r in BASE_RULES]
    return judge_urls(pages, (*BASE_RULES, *WORD_RULES)).withColumn(
        "rule", F.when(F.col("rule").isin(named), F.col("rule"))
    )
