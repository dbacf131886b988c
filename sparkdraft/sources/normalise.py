"""Corpus rows of many shapes brought to ``id, conversations``.

Each adapter is one projection: no shuffle, no Python per row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdraft.functions.hashing import seeded_hex

# Corpus speaker name -> conversation role.
ROLE_MAP = {
    "human": "user",
    "gpt": "assistant",
    "chatgpt": "assistant",
    "bing": "assistant",
    "bard": "assistant",
}

# Answer labels and layout of shuffled multiple-choice rows.
CHOICE_LABELS = ("a", "b", "c", "d")
IMAGE_MARK = "<image>\n"


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def two_turns(user: Column, assistant: Column) -> Column:
    """A question and its answer as a conversation array."""
    return F.array(_message("user", user), _message("assistant", assistant))


def qa_to_conversation(
    df: DataFrame, user: Column, assistant: Column, id: Column | None = None
) -> DataFrame:
    """Two-turn conversation; the id defaults to the MD5 of both texts."""
    made = F.md5(F.concat(user, assistant))
    return df.select(
        (made if id is None else F.coalesce(id.cast("string"), made)).alias("id"),
        two_turns(user, assistant).alias("conversations"),
    )


# Why rows are rejected.
ODD_ROLE = "role other than user or assistant"
NO_IMAGE = "image is missing"


def judged_messages(df: DataFrame, id: str = "prompt_id", messages: str = "messages") -> DataFrame:
    """``id, conversations, skipped, reason``; the reason is null for good rows."""
    odd = F.exists(messages, lambda m: ~F.coalesce(m["role"].isin("user", "assistant"), F.lit(False)))
    return df.select(
        F.col(id).cast("string").alias("id"),
        F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias(
            "conversations"
        ),
        F.lit(0).alias("skipped"),
        F.when(odd, ODD_ROLE).alias("reason"),
    )


def messages_to_conversation(
    df: DataFrame, id: str = "prompt_id", messages: str = "messages"
) -> tuple[DataFrame, DataFrame]:
    """``(good, rejects)``: rejects hold a role other than user or assistant."""
    judged = judged_messages(df, id, messages)
    columns = ("id", "conversations")
    return judged.filter("reason is null").select(*columns), judged.filter("reason is not null").select(*columns)


def role_lookup(role: Column, mapping: Mapping[str, str] = ROLE_MAP) -> Column:
    """The mapped role, or null for a speaker outside the map."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), role)


def rolemap_conversation(
    df: DataFrame,
    role_map: Mapping[str, str] = ROLE_MAP,
    role_field: str = "from",
    text_field: str = "value",
    extra_roles: tuple[str, ...] = (),
) -> DataFrame:
    """``id, conversations, skipped``: unknown speakers are dropped and counted.

    ``extra_roles`` lets further roles pass through under their own name.
    """
    mapping = {**role_map, **{r: r for r in extra_roles}}
    mapped = F.transform(
        "conversations",
        lambda m: F.struct(
            role_lookup(m[role_field], mapping).alias("role"), m[text_field].alias("content")
        ),
    )
    kept = F.filter(mapped, lambda m: m["role"].isNotNull())
    return df.select(
        F.col("id").cast("string").alias("id"),
        kept.alias("conversations"),
        (F.size("conversations") - F.size(kept)).alias("skipped"),
    )


def rolemap_turns(
    turns: DataFrame, role_map: Mapping[str, str] = ROLE_MAP, role_field: str = "from"
) -> DataFrame:
    """The exploded form of :func:`rolemap_conversation`: one row per turn.

    ``role`` is null where the turn would be dropped.
    """
    return turns.withColumn("role", role_lookup(F.col(role_field), role_map))


def judged_images(df: DataFrame, root: str, present: DataFrame | None = None) -> DataFrame:
    """``id, image, conversations, skipped, reason`` with an image path below ``root``.

    ``present`` (one column ``path``) lists the files that exist; rows whose
    image is not among them have a reason.
    """
    path = F.concat(F.lit(root.rstrip("/") + "/"), F.col("image"))
    rows = df.withColumn("image", path)
    reason = F.lit(None).cast("string")
    if present is not None:
        known = present.select(F.col("path").alias("image"), F.lit(True).alias("_there")).dropDuplicates(["image"])
        rows = rows.join(known, "image", "left")
        reason = F.when(F.col("_there").isNull(), NO_IMAGE)
    mapped = F.transform(
        "conversations",
        lambda m: F.struct(role_lookup(m["from"]).alias("role"), m["value"].alias("content")),
    )
    kept = F.filter(mapped, lambda m: m["role"].isNotNull())
    cleaned = F.transform(
        kept,
        lambda m: F.struct(
            m["role"].alias("role"),
            F.when(m["role"] == "user", F.replace(m["content"], F.lit(IMAGE_MARK), F.lit("")))
            .otherwise(m["content"])
            .alias("content"),
        ),
    )
    return rows.select(
        F.col("id").cast("string").alias("id"),
        "image",
        cleaned.alias("conversations"),
        (F.size("conversations") - F.size(kept)).alias("skipped"),
        reason.alias("reason"),
    )


def image_conversation(df: DataFrame, root: str, present: DataFrame | None = None) -> DataFrame:
    """The good rows of :func:`judged_images`."""
    return judged_images(df, root, present).filter("reason is null").drop("reason")


def shuffled_choices(answers: list[Column], key: Column, seed: int = 0) -> Column:
    """The answers in an order that depends on the seed and the key alone."""
    ranked = F.array(
        *[
            F.struct(seeded_hex(seed, key, F.lit(i)).alias("h"), a.alias("answer"))
            for i, a in enumerate(answers)
        ]
    )
    return F.transform(F.array_sort(ranked), lambda x: x["answer"])


def mcq_to_conversation(
    df: DataFrame,
    question: Column,
    distractors: list[Column],
    correct: Column,
    support: Column,
    key: Column,
    seed: int = 0,
) -> DataFrame:
    """Shuffled four-choice question; the label names the first equal answer."""
    order = shuffled_choices([*distractors, correct], key, seed)
    letters = F.array(*[F.lit(x) for x in CHOICE_LABELS])
    lines = F.transform(order, lambda a, i: F.concat(F.get(letters, i), F.lit(") "), a))
    label = F.get(letters, (F.array_position(order, correct) - 1).cast("int"))
    user = F.concat(question, F.lit("\n"), F.array_join(lines, "\n"))
    reply = F.concat(support, F.lit("\nanswer: "), label, F.lit(") "), correct)
    staged = df.select("*", user.alias("_user"), reply.alias("_reply"))
    return qa_to_conversation(staged, F.col("_user"), F.col("_reply"))


def sink_summary(judged: DataFrame) -> DataFrame:
    """One row per corpus and reason: rows, messages kept and messages skipped.

    ``judged`` has ``corpus, conversations, skipped, reason``; the rows without a
    reason are those a sink writes.
    """
    return judged.groupBy("corpus", "reason").agg(
        F.count("*").alias("rows"),
        F.sum(F.size("conversations")).cast("bigint").alias("kept"),
        F.sum("skipped").cast("bigint").alias("skipped"),
    )


def skip_statistics(normalised: DataFrame) -> DataFrame:
    """One row: rows seen, messages kept and messages skipped."""
    return normalised.agg(
        F.count("*").alias("rows"),
        F.sum(F.size("conversations")).cast("bigint").alias("kept"),
        F.sum("skipped").cast("bigint").alias("skipped"),
    )
