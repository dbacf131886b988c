"""Span edges inside tokens, incomplete replies, dense numbers, publication and keyed state."""

import re

import pytest

from sparkdraft.operators import regen as RG
from sparkdraft.operators import spans as SP
from sparkdraft.operators.templates import TEMPLATES, Template
from sparkdraft.operators.tokens import TOKEN
from sparkdraft.sources import files

# --- prefix masks ------------------------------------------------------------

PLAIN = Template("BOT", "USR", None, "END")
CUT = Template("BOT<", "USR", None, "|>")
TEXTS = [
    "USRhiENDBOTyoEND", "USRhiBOTyo and moreENDmoreBOT", "BOT", "", "no marks at all", "USRaENDBOT END BOTbENDx",
    "BOT<|x|>tail BOT<|long_name|> BOT<b|>", "é日BOT本語END", "BOTaEND" * 50, None,
]


def literal_mask(text, spans, max_length):
    count = lambda t: len(re.findall(TOKEN, t)[:max_length])
    mask = [0] * count(text)
    for s in spans:
        for i in range(count(text[: s["start"]]), min(count(text[: s["end"]]), len(mask))):
            mask[i] = 1
    return mask


@pytest.mark.parametrize("template", [PLAIN, CUT, TEMPLATES["qwen"], TEMPLATES["longcat"], TEMPLATES["deepseek-v3"]], ids=str)
@pytest.mark.parametrize("max_length", [None, 7])
@pytest.mark.parametrize("last_only", [False, True])
def test_masks_count_prefixes_of_the_whole_text(spark, template, max_length, last_only):
    texts = [t and t.replace("USR", template.user_header).replace("BOT", template.assistant_header) for t in TEXTS]
    texts = TEXTS + [t and t.replace("END", template.end_of_turn or "") for t in texts]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    masked = SP.masked_tokens(SP.assistant_spans(rows, "text", template, last_only=last_only), "text", template, max_length, last_only)
    spanned = SP.assistant_spans(rows, "text", template, last_only=last_only)
    spans = {r["text"]: r["spans"] for r in spanned.collect()}
    for r in masked.select("text", "pieces", "loss_mask").collect():
        if r["text"] is not None:
            assert r["pieces"] == re.findall(TOKEN, r["text"])[:max_length]
            assert r["loss_mask"] == literal_mask(r["text"], spans[r["text"]], max_length), r["text"]


def test_known_templates_keep_tokens_apart():
    assert not SP.edges_part_tokens(PLAIN) and not SP.edges_part_tokens(CUT)
    apart = {name for name in TEMPLATES if SP.edges_part_tokens(name)}
    assert {"qwen", "llama3", "longcat"} <= apart


# --- replies -----------------------------------------------------------------


@pytest.mark.parametrize("reply", [{}, {"thinking": "x"}, None, "text", {"content": "fine"}])
def test_incomplete_replies_end_as_error_rows(spark, reply):
    kind = "id string, conversations array<struct<role:string,content:string>>"
    df = spark.createDataFrame([("a", [("user", "hi")])], kind)
    row = RG.regenerate(df, lambda messages, params: reply, RG.request_parameters(model="m")).first()
    assert row["status"] == ("success" if isinstance(reply, dict) and "content" in reply else "error")
    turns = spark.createDataFrame([(1, 0, "user", "hi")], "conv_id bigint, turn int, role string, text string")
    out = RG.regenerate_turns(turns, lambda messages, params: reply, RG.request_parameters(model="m")).collect()
    assert sum(r["error"] is not None for r in out) == (row["status"] == "error")


# --- publication -------------------------------------------------------------


def test_a_writer_that_stops_half_way_publishes_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    files.publish(spark.range(3), path, 0)

    def fail(batches):
        yield from batches
        raise RuntimeError("stopped")

    with pytest.raises(Exception, match="stopped"):
        files.publish(spark.range(100).mapInPandas(fail, "id long"), path, 1)
    assert files.read_published(spark, path).count() == 3
    files.publish(spark.range(5), path, 2)
    assert files.read_published(spark, path).count() == 5


def test_readers_finish_with_the_version_they_began_with(spark, tmp_path):
    path = str(tmp_path / "table")
    files.publish(spark.range(3), path, 0)
    begun = files.read_published(spark, path)
    files.publish(spark.range(50), path, 1)
    assert begun.count() == 3 and files.read_published(spark, path).count() == 50
    files.publish(spark.range(7), path, 1)  # a number is published once
    assert files.read_published(spark, path).count() == 50
    for number in range(2, 6):
        files.publish(spark.range(number), path, number)
    assert len(files.folders(spark, f"{path}/versions")) == 2
    assert files.read_published(spark, path).count() == 5


def test_two_builders_of_one_key_agree(spark, tmp_path):
    def build(n):
        def made():
            if n == 3:  # another builder is done first
                files.cached(spark, str(tmp_path), "k", build(9))
            return spark.range(n)

        return made

    assert files.cached(spark, str(tmp_path), "k", build(3)).count() == 9
    assert files.cached(spark, str(tmp_path), "k", build(1)).count() == 9


def test_nothing_published(spark, tmp_path):
    assert files.published(spark, str(tmp_path / "none")) is None
    with pytest.raises(FileNotFoundError):
        files.read_published(spark, str(tmp_path / "none"))


# --- requests ----------------------------------------------------------------


def test_requests_hold_new_messages_only_and_resolve_to_all(spark):
    talks = {
        1: [("system", "s"), ("user", "a"), ("assistant", "old"), ("user", "b"), ("system", "t"), ("user", "c")],
        2: [("user", "x")],
        3: [("system", "alone")],
        4: [m for i in range(70) for m in (("user", f"u{i}"), ("assistant", "old"))] + [("system", "late")],
    }
    rows = [(c, i, *m) for c, talk in talks.items() for i, m in enumerate(talk)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    linked = RG.request_messages(turns).collect()
    said = sum(1 for c, talk in talks.items() for i, m in enumerate(talk) if m[0] != "assistant" and any(r == "user" for r, _ in talk[i:]))
    assert len(linked) == said
    want = {}
    for c, talk in talks.items():
        context, request = [], 0
        for role, text in talk:
            if role == "assistant":
                continue
            context.append((role, text))
            if role == "user":
                want[c, request] = list(context)
                context.append(("assistant", f"answer {request}"))
                request += 1
    wanted = spark.createDataFrame(list(want), "conv_id bigint, request bigint")
    answers = spark.createDataFrame([(*k, f"answer {k[1]}") for k in want], "conv_id bigint, request bigint, text string")
    got = {}
    for r in sorted(RG.request_context(RG.request_messages(turns), wanted, answers).collect(), key=lambda r: r["place"]):
        found = got.setdefault((r["conv_id"], r["request"]), [])
        assert r["place"] == len(found)
        found.append((r["role"], r["text"]))
    assert got == want


# --- subsets -----------------------------------------------------------------


def test_subsets_of_one_table(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("a", 4)], "kind string, n int")
    tagged = files.tag_subsets(rows, "kind")
    assert sorted(map(tuple, tagged.collect()), key=repr) == [("a", 1), ("a", 4), ("b", 2), (None, 3)]
    assert tagged.columns == ["subset", "n"]
    assert files.tag_subsets(rows, "kind", ["b"]).collect() == [("b", 2)]
    assert files.tag_subsets(rows, "kind", []).count() == 0
