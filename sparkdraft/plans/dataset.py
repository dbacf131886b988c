"""Conversations or ready texts to training rows: one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdraft.functions.hashing import seeded_hex
from sparkdraft.functions.rows import evaluate_once
from sparkdraft.operators.render import RENDER_OPTIONS, native_piece, render
from sparkdraft.operators.sampling import drop_empty
from sparkdraft.operators.spans import assistant_spans, masked_tokens, offset_mask
from sparkdraft.operators.templates import get_template
from sparkdraft.operators.tokens import VOCAB_SIZE, pieces, token_ids
from sparkdraft.operators.vocab import draft_vocab, target_flags, token_frequency
from sparkdraft.schemas import require_columns
from sparkdraft.sources.files import cache_key, cached


def build_dataset(
    df: DataFrame,
    template: str,
    max_length: int = 2048,
    seed: int | None = None,
    preformatted: bool = False,
    last_only: bool = False,
    render_mode: str = "native",
    vocab_size: int = VOCAB_SIZE,
) -> DataFrame:
    """Training rows: ``pieces, input_ids, loss_mask, attention_mask``.

    Takes ``conversations`` (arrays of messages), or ``text`` if
    ``preformatted``; all other columns are kept.  Everything is a projection
    over the input rows; a ``seed`` adds the sort of a seeded shuffle.
    Conversations a thinking or channel template cannot render are left out.
    Columns named in ``RENDER_OPTIONS`` drive the rendering of their rows.
    """
    t = get_template(template)
    if preformatted:
        ready = require_columns(df, "text").filter(F.col("text") != "")
    else:
        nested = drop_empty(require_columns(df, "conversations"))
        fields = df.schema["conversations"].dataType.elementType.names
        options = {name: F.col(name) for name in RENDER_OPTIONS if name in nested.columns}
        text = render(F.col("conversations"), t, render_mode, "tool_calls" in fields, options)
        ready = nested.withColumn("text", text).drop("conversations")
        if t.parser_type != "general":
            ready = evaluate_once(ready).filter("text is not null")
    if t.parser_type == "openai-harmony":
        rows = _contained(ready, template, max_length, last_only, vocab_size)
    else:
        rows = masked_tokens(ready, "text", t, max_length, last_only, vocab_size=vocab_size)
    rows = rows.drop("text")
    if seed is None:
        return rows
    named = [F.col(c) for c in ("id", "conv_id", "doc_id") if c in rows.columns]
    key = named[0] if named else F.md5(F.array_join("pieces", ""))
    return rows.orderBy(seeded_hex(seed, key), key)


def vocab_mapping(
    rows: DataFrame, target_size: int, draft_size: int, root: str, **parameters
) -> tuple[DataFrame, DataFrame]:
    """``(draft_vocab, target_flags)``, stored below ``root`` under all parameters.

    The tokens are counted when nothing is stored yet; the flags come from the
    stored draft vocabulary, not from a second count.
    """
    spark = rows.sparkSession
    key = cache_key(target=target_size, draft=draft_size, **parameters)
    draft = cached(spark, root, f"{key}/draft", lambda: draft_vocab(token_frequency(rows), draft_size))
    flags = cached(spark, root, f"{key}/target", lambda: target_flags(draft, target_size))
    return draft, flags


def _contained(df: DataFrame, template: str, max_length: int, last_only: bool, vocab_size: int) -> DataFrame:
    """The channel format marks tokens that lie wholly inside a span."""
    spanned = assistant_spans(df, "text", template, last_only=last_only)
    cut = spanned.withColumn("pieces", F.slice(pieces(F.col("text")), 1, max_length))
    return (
        cut.withColumn("loss_mask", offset_mask(F.col("pieces"), F.col("spans"), "contained"))
        .withColumn("input_ids", token_ids(F.col("pieces"), vocab_size))
        .withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("pieces")))
        .drop("spans")
    )


# What a user's turn shows in place of its image, and why rows are rejected.
IMAGE_TEXT = "<|vision_start|><|image_pad|><|vision_end|>"
NO_TURNS = "no turns"
NOT_ALTERNATING = "user and assistant do not alternate"


def image_texts(df: DataFrame, template: str = "qwen2-vl") -> DataFrame:
    """Image conversations as ``text``, or a ``reason``; other columns are kept.

    A first message that is not the user's is left out, the others must alternate
    from the user on.  Every user turn shows the row's image before its words; the
    system prompt is always the template's.
    """
    t = get_template(template)
    turns = F.col("conversations")
    skip = F.when(F.get(turns, F.lit(0))["role"].eqNullSafe(F.lit("user")), 0).otherwise(1)
    rest = F.when(F.size(turns) > 0, F.slice(turns, skip + 1, F.size(turns))).otherwise(turns)
    staged = df.withColumn("_rest", rest)
    wrong = F.exists(
        F.transform(
            "_rest", lambda m, i: ~m["role"].eqNullSafe(F.when(i % 2 == 0, F.lit("user")).otherwise(F.lit("assistant")))
        ),
        lambda odd: odd,
    )

    def piece(m):
        shown = F.when(m["role"] == "user", F.concat(F.lit(IMAGE_TEXT), m["content"])).otherwise(m["content"])
        return native_piece(t, m["role"], shown)

    opening = f"{t.bos}{t.system_header}{t.system_prompt}{t.system_suffix}{t.end_of_turn}"
    reason = F.when(F.coalesce(F.size(turns), F.lit(0)) <= 0, NO_TURNS).when(wrong, NOT_ALTERNATING)
    text = F.concat(F.lit(opening), F.array_join(F.transform("_rest", piece), ""))
    return staged.select(
        *[c for c in df.columns if c != "conversations"],
        F.when(reason.isNull(), text).alias("text"),
        reason.alias("reason"),
    )


def image_dataset(df: DataFrame, template: str, max_length: int = 2048, vocab_size: int = VOCAB_SIZE) -> DataFrame:
    """Rows of ready texts of image conversations: strict spans, overlap rule."""
    spanned = assistant_spans(df, "text", template, kind="pair")
    cut = spanned.withColumn("pieces", F.slice(pieces(F.col("text")), 1, max_length))
    return (
        cut.withColumn("loss_mask", offset_mask(F.col("pieces"), F.col("spans"), "overlap"))
        .withColumn("input_ids", token_ids(F.col("pieces"), vocab_size))
        .withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("pieces")))
        .drop("spans", "text")
    )
