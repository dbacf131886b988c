"""Rendering, spans and masks against plain Python on hand-made conversations."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sparkdraft.functions.text import WHITESPACE, quote, strip, word_count
from sparkdraft.operators import render as R
from sparkdraft.operators import spans as SP
from sparkdraft.operators import tokens as TK
from sparkdraft.operators import turns as TN
from sparkdraft.operators.templates import (
    TEMPLATES,
    Template,
    get_template,
    register_template,
    template_names,
    template_table,
)
from sparkdraft.plans.dataset import build_dataset, image_dataset

QWEN = get_template("qwen")
SCHEMA = "id string, conversations array<struct<role:string, content:string>>"


def say(*turns):
    return [{"role": r, "content": c} for r, c in turns]


CONVERSATIONS = {
    "standard": say(
        ("user", "Who are you?"), ("assistant", "My name is Qwen2."), ("user", "How old are you?"), ("assistant", "11 years old.")
    ),
    "tool": say(
        ("user", "What's the weather?"),
        ("assistant", "I'll check."),
        ("tool", '{"temperature": 22}'),
        ("assistant", "Sunny, 22°C."),
        ("tool", "{}"),
        ("tool", "{}"),
        ("user", "Rain?"),
        ("assistant", "No rain—clear skies 🌞."),
    ),
    "system": say(("system", "Be brief."), ("user", "Hi"), ("assistant", "Hello!")),
    "assistant first": say(("assistant", "Hello!"), ("user", "Hi")),
    "two answers": say(("user", "a"), ("assistant", "b"), ("assistant", "c"), ("user", "d")),
    "tool after user": say(("user", "a"), ("tool", "b"), ("assistant", "c")),
    "late system": say(("user", "a"), ("system", "x"), ("user", "b"), ("assistant", "π ≈ 3.14159")),
    "empty content": say(("user", ""), ("assistant", "")),
    "ends with user": say(("user", "a"), ("assistant", "b"), ("user", "c")),
    "header inside": say(("user", "x"), ("assistant", "a<|im_start|>assistant\nb"), ("user", "y"), ("assistant", "z")),
}


def in_order(conv):
    """The messages before the first out-of-order one, with any system opening."""
    start = 1 if conv[0]["role"] == "system" else 0
    for i in range(start, len(conv)):
        role = conv[i]["role"]
        if i == start:
            if role != "user":
                return conv[:i]
        else:
            prev = conv[i - 1]["role"]
            if role == "tool" and prev not in ("assistant", "tool"):
                return conv[:i]
            if role == "assistant" and prev not in ("user", "tool"):
                return conv[:i]
    return conv


def chatml(conv, prompt):
    kept = in_order(conv)
    if conv[0]["role"] != "system":
        kept = say(("system", prompt)) + kept
    out = []
    for i, m in enumerate(kept):
        if m["role"] != "tool":
            out.append(f"<|im_start|>{m['role']}\n{m['content']}<|im_end|>\n")
            continue
        # Replies of tools next to each other share one turn of the user.
        if i == 0 or kept[i - 1]["role"] != "tool":
            out.append("<|im_start|>user")
        out.append(f"\n<tool_response>\n{m['content']}\n</tool_response>")
        if i + 1 == len(kept) or kept[i + 1]["role"] != "tool":
            out.append("<|im_end|>\n")
    return "".join(out)


def python_spans(text, header, end):
    return [m.span(1) for m in re.finditer(re.escape(header) + r"([\s\S]*?(?:" + end + "|$))", text, re.DOTALL)]


def python_mask(text, spans, limit):
    count = lambda s: min(len(re.findall(TK.TOKEN, s)), limit)
    mask = [0] * count(text)
    for s, e in spans:
        for i in range(count(text[:s]), count(text[:e])):
            mask[i] = 1
    return mask


@pytest.fixture(scope="module")
def convs(spark):
    return spark.createDataFrame([(k, v) for k, v in CONVERSATIONS.items()], SCHEMA)


def test_whitespace_is_pythons():
    assert set(WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_strip_and_word_count(spark):
    texts = ["  a b ", "\x1c x　y ", "", "\n\n", "no", "a\x85b\tc"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", strip(F.col("t")).alias("s"), word_count(F.col("t")).alias("n")).collect()
    assert {r.t: (r.s, r.n) for r in got} == {t: (t.strip(), len(t.split())) for t in texts}


def test_render_native_matches_python(convs):
    got = convs.select("id", R.render(F.col("conversations"), "qwen").alias("t")).collect()
    assert {r.id: r.t for r in got} == {k: chatml(v, QWEN.system_prompt) for k, v in CONVERSATIONS.items()}


SYSTEM = "You are a helpful assistant."
OPEN = f"<|im_start|>system\n{SYSTEM}<|im_end|>\n<|im_start|>user\nQ1<|im_end|>\n<|im_start|>assistant\n"
NEXT = "<|im_end|>\n<|im_start|>user\nQ2<|im_end|>\n<|im_start|>assistant\n"
KIMI = (
    f"<|im_system|>system<|im_middle|>{SYSTEM}<|im_end|><|im_user|>user<|im_middle|>Q1<|im_end|>"
    "<|im_assistant|>assistant<|im_middle|>{0}A1<|im_end|><|im_user|>user<|im_middle|>Q2<|im_end|>"
    "<|im_assistant|>assistant<|im_middle|>A2<|im_end|>"
)
DEEP = "<｜begin▁of▁sentence｜>{0}<｜User｜>Q1<｜Assistant｜>A1<｜end▁of▁sentence｜><｜User｜>Q2<｜Assistant｜>A2<｜end▁of▁sentence｜>"
# Per template: the whole text of two rounds, and the texts under the mask.
LAYOUTS = {
    "qwen": (f"{OPEN}A1{NEXT}A2<|im_end|>\n", ["A1<|im_end|>\n", "A2<|im_end|>\n"]),
    "qwen3-instruct": (f"{OPEN}A1{NEXT}<think>\n\n</think>\n\nA2<|im_end|>\n", ["\nA2<|im_end|>\n"]),
    "qwen3-thinking": (f"{OPEN}A1{NEXT}A2<|im_end|>\n", ["A1<|im_end|>\n", "A2<|im_end|>\n"]),
    "qwen3-next-thinking": (f"{OPEN}A1{NEXT}<think>\nA2<|im_end|>\n", ["A2<|im_end|>\n"]),
    "kimi-k2-instruct": (KIMI.format(""), ["A1<|im_end|>", "A2<|im_end|>"]),
    "kimi-k2-thinking": (KIMI.format("<think></think>"), ["<think></think>A1<|im_end|>", "A2<|im_end|>"]),
    "deepseek-v3": (DEEP.format(SYSTEM), ["A1<｜end▁of▁sentence｜>", "A2<｜end▁of▁sentence｜>"]),
    "deepseek-v32": (DEEP.format(""), ["A1<｜end▁of▁sentence｜>", "A2<｜end▁of▁sentence｜>"]),
    "ling-flash-2.0": (
        f"<role>SYSTEM</role>{SYSTEM}\ndetailed thinking off<|role_end|><role>HUMAN</role>Q1<|role_end|>"
        "<role>ASSISTANT</role>A1<|role_end|><role>HUMAN</role>Q2<|role_end|><role>ASSISTANT</role>A2<|role_end|>",
        ["A1<|role_end|>", "A2<|role_end|>"],
    ),
    "longcat": (f"{SYSTEM} USER:Q1 ASSISTANT:A1</longcat_s> USER:Q2 ASSISTANT:A2</longcat_s>", ["A1</longcat_s>", "A2</longcat_s>"]),
}


@pytest.mark.parametrize("template", list(LAYOUTS))
def test_layouts_as_models_write_them(spark, template):
    talk = say(("user", "Q1"), ("assistant", "A1"), ("user", "Q2"), ("assistant", "A2"))
    rows = spark.createDataFrame([("x", talk)], SCHEMA)
    text, masked = LAYOUTS[template]
    assert rows.select(R.render(F.col("conversations"), template)).first()[0] == text
    got = build_dataset(rows, template).first()
    runs, inside = [], False
    for piece, m in zip(got.pieces, got.loss_mask):
        if m and not inside:
            runs.append("")
        if m:
            runs[-1] += piece
        inside = m
    assert "".join(got.pieces) == text and runs == masked


def test_thoughts_and_calls(spark):
    kind = "id string, conversations array<struct<role:string, content:string, tool_calls:string>>"
    talk = [
        ("user", "Q1", None),
        ("assistant", "<think>\nhm\n</think>\n\nA1", '[{"function": {"name": "f", "arguments": {"a": 1}}}, {"name": "g", "arguments": "{}"}]'),
        ("tool", "T1", None),
        ("tool", "T2", None),
        ("assistant", "<think>\nso\n</think>\n\nA2", None),
    ]
    rows = spark.createDataFrame([("x", talk)], kind)
    assert rows.select(R.render(F.col("conversations"), "qwen3-instruct", tool_calls=True)).first()[0] == (
        f"{OPEN}A1\n<tool_call>\n"
        '{"name": "f", "arguments": {"a":1}}\n</tool_call>\n<tool_call>\n{"name": "g", "arguments": {}}\n</tool_call>'
        "<|im_end|>\n<|im_start|>user\n<tool_response>\nT1\n</tool_response>\n<tool_response>\nT2\n</tool_response>"
        "<|im_end|>\n<|im_start|>assistant\n<think>\nso\n</think>\n\nA2<|im_end|>\n"
    )


def test_render_fallback_skips_tool_turns(convs):
    t = get_template("phi3")
    got = {r.id: r.t for r in convs.select("id", R.render(F.col("conversations"), "phi3", "fallback").alias("t")).collect()}
    assert got["tool"] == (
        "You are a helpful assistant.<|user|>\nWhat's the weather?<|assistant|>\nI'll check.<|end|>\n"
        "<|assistant|>\nSunny, 22°C.<|end|>\n<|user|>\nRain?<|assistant|>\nNo rain—clear skies 🌞.<|end|>\n"
    )
    assert got["system"].startswith("Be brief.<|user|>")
    assert t.system_prompt not in got["system"]


def test_thinking_needs_a_last_answer(convs):
    text = R.render(F.col("conversations"), "qwen3-next-thinking")
    got = {r.id: r.t for r in convs.select("id", text.alias("t")).collect()}
    assert got["ends with user"] is None and got["assistant first"] is None
    assert got["system"] == (
        "<|im_start|>system\nBe brief.<|im_end|>\n<|im_start|>user\nHi<|im_end|>\n"
        "<|im_start|>assistant\n<think>\nHello!<|im_end|>\n"
    )


def test_channels(spark):
    head, tail = R.CHANNEL_PREAMBLE.split("{effort}")
    cases = {
        "plain": say(("user", "u"), ("assistant_analysis", "x"), ("assistant_final", "y")),
        "own system": say(("system", "s"), ("user", "u")),
        "effort": say((R.EFFORT_ROLE, "HIGH"), ("user", "u")),
        "late system": say(("user", "u"), ("system", "s"), ("user", "v")),
        "unknown": say(("user", "u"), ("assistant", "x")),
    }
    rows = spark.createDataFrame(list(cases.items()), SCHEMA)
    c = F.col("conversations")
    got = {
        r.id: (r.a, r.b)
        for r in rows.select(
            "id", R.render_channels(c).alias("a"), R.render_channels(c, compat=True).alias("b")
        ).collect()
    }
    u, s = "<|start|>user<|message|>u<|end|>", "<|start|>system<|message|>s<|end|>"
    v = "<|start|>user<|message|>v<|end|>"
    low = head + "low" + tail
    body = u + "<|start|>assistant<|channel|>analysis<|message|>x<|end|><|start|>assistant<|channel|>final<|message|>y<|end|>"
    assert got["plain"] == (low + body, low + body)
    assert got["own system"] == (s + u, s + u)
    assert got["effort"] == (head + "high" + tail + u,) * 2
    assert got["late system"] == (low + u + s + v, s + v)
    assert got["unknown"] == (None, None)


def test_pieces_join_to_the_nested_rendering(spark, convs):
    turns = TN.explode_conversations(convs)
    system = TN.with_system_turn(turns, QWEN.system_prompt).filter("turn = -1")
    kept = TN.truncate_roles(turns, size=2).unionByName(system)
    pieces = R.with_pieces(kept, "qwen").orderBy("conv_id", "turn").collect()
    joined = {}
    for r in pieces:
        joined[r.conv_id] = joined.get(r.conv_id, "") + r.piece
    assert joined == {k: chatml(v, QWEN.system_prompt) for k, v in CONVERSATIONS.items()}


@pytest.mark.parametrize("limit", [12, 2048])
def test_masks_follow_the_prefix_rule(convs, limit):
    rows = build_dataset(convs, "qwen", max_length=limit).collect()
    assert len(rows) == len(CONVERSATIONS)
    for r in rows:
        text = chatml(CONVERSATIONS[r.id], QWEN.system_prompt)
        spans = python_spans(text, QWEN.assistant_header, re.escape(QWEN.end_of_turn))
        assert list(r.pieces) == re.findall(TK.TOKEN, text)[:limit]
        assert list(r.loss_mask) == python_mask(text, spans, limit), r.id
        assert list(r.attention_mask) == [1] * len(r.pieces) == [1] * len(r.input_ids)


def test_last_turn_only(convs):
    rows = build_dataset(convs, "qwen", last_only=True).collect()
    for r in rows:
        text = chatml(CONVERSATIONS[r.id], QWEN.system_prompt)
        spans = python_spans(text, QWEN.assistant_header, re.escape(QWEN.end_of_turn))[-1:]
        assert list(r.loss_mask) == python_mask(text, spans, 2048), r.id


def test_preformatted_span_text(spark):
    text = (
        "<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n<|im_start|>user\nWhat is Python?<|im_end|>\n"
        "<|im_start|>assistant\nPython is a programming language.<|im_end|>\n"
    )
    rows = spark.createDataFrame([("a", text), ("b", "")], "id string, text string")
    (r,) = build_dataset(rows, "qwen", preformatted=True).collect()
    marked = "".join(p for p, m in zip(r.pieces, r.loss_mask) if m)
    assert marked == "Python is a programming language.<|im_end|>\n"
    with pytest.raises(ValueError, match="text"):
        build_dataset(rows.drop("text"), "qwen", preformatted=True)


@pytest.mark.parametrize("name", ["qwen", "llama3", "longcat", "deepseek-v3", "gemma", "qwen3-instruct"])
def test_spans_match_python_on_random_texts(spark, name):
    t = get_template(name)
    rng = random.Random(name)
    bits = [
        t.assistant_header, t.user_header, t.end_of_turn, t.assistant_header[:-1], t.end_of_turn[:3],
        "a", " b", "\n", "é", "🌞", "[Round 3] USER:", "[Round x] USER:", "<", "|", "$1",
    ]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(300)]
    end = re.escape(t.end_of_turn)
    if t.pattern_type == "round":
        end = rf"(?:\[Round \d+\] USER:|{end})"
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    spanned = SP.assistant_spans(rows, "text", name)
    parts = SP.segments(F.col("text"), SP.span_parts(F.col("text"), name), t.assistant_header)
    got = spanned.select("id", "spans", F.transform(parts, lambda p: p["part"]).alias("p")).collect()
    for r in got:
        text = texts[r.id]
        want = python_spans(text, t.assistant_header, end)
        assert [(s["start"], s["end"]) for s in r.spans] == want, text
        assert [s["content"] for s in r.spans] == [text[a:b] for a, b in want]
        assert "".join(r.p) == text


@pytest.mark.parametrize("kind", ["pair", "channels"])
def test_lookahead_spans_match_python(spark, kind):
    if kind == "pair":
        name, header, stop = "qwen", QWEN.end_of_turn + QWEN.assistant_header, QWEN.end_of_turn + QWEN.user_header
    else:
        name, header, stop = "gpt-oss", SP.CHANNEL_HEADER, SP.CHANNEL_USER
    rng = random.Random(kind)
    bits = [header, stop, header[:4], stop[:-2], "a", "\n", "é", "<|end|>", "🌞"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 20))) for _ in range(300)]
    pattern = re.compile(re.escape(header) + r"([\s\S]*?)(?=" + re.escape(stop) + "|$)")
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for r in SP.assistant_spans(rows, "text", name, kind=kind).collect():
        assert [(s["start"], s["end"]) for s in r.spans] == [m.span(1) for m in pattern.finditer(texts[r.id])]


def test_template_without_end_marker_ends_at_the_next_user(spark):
    rows = spark.createDataFrame([(1, "<｜User｜>a<｜Assistant｜>b<｜User｜>c<｜Assistant｜>d")], "id int, text string")
    (r,) = SP.assistant_spans(rows, "text", "deepseek-r1-distill").collect()
    assert [s["content"] for s in r.spans] == ["b", "d"]


def offsets_of(pieces):
    at, out = 0, []
    for p in pieces:
        out.append((at, at + len(p)))
        at += len(p)
    return out


@pytest.mark.parametrize("policy,closed", [("contained", True), ("overlap", True), ("overlap", False)])
def test_offset_policies(spark, policy, closed):
    rng = random.Random(5)
    data = []
    for i in range(60):
        text = "".join(rng.choices(["ab", " ", "x9", "<|end|>", "é", "🌞🌞"], k=12))
        cuts = sorted(rng.sample(range(len(text) + 1), 4))
        data.append((i, text, [{"start": cuts[0], "end": cuts[1]}, {"start": cuts[2], "end": cuts[3]}]))
    rows = spark.createDataFrame(data, "id int, text string, spans array<struct<start:int,end:int>>")
    with_pieces = rows.withColumn("pieces", TK.pieces(F.col("text")))
    mask = SP.offset_mask(F.col("pieces"), F.col("spans"), policy, closed)
    for r in with_pieces.withColumn("m", mask).collect():
        want = []
        for s, e in offsets_of(r.pieces):
            hits = []
            for sp in r.spans:
                if policy == "contained":
                    hits.append(s >= sp.start and e <= sp.end)
                else:
                    hits.append(e > sp.start and (s <= sp.end if closed else s < sp.end))
            want.append(int(any(hits)))
        assert list(r.m) == want
    with pytest.raises(ValueError):
        SP.offset_mask(F.col("a"), F.col("b"), "other")


def test_harmony_and_image_datasets(spark):
    convs = spark.createDataFrame(
        [("a", say(("user", "Explain."), ("assistant_analysis", "Think."), ("assistant_final", "Done."))), ("b", say(("user", "u"), ("odd", "x")))],
        SCHEMA,
    )
    (r,) = build_dataset(convs, "gpt-oss").collect()
    marked = "".join(p for p, m in zip(r.pieces, r.loss_mask) if m)
    assert marked == (
        "<|channel|>analysis<|message|>Think.<|end|><|start|>assistant<|channel|>final<|message|>Done.<|end|>"
    )
    text = "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n"
    (v,) = image_dataset(spark.createDataFrame([("i", text)], "id string, text string"), "qwen2-vl").collect()
    assert "".join(p for p, m in zip(v.pieces, v.loss_mask) if m) == "yes<|im_end|>\n"


def test_mask_runs_cover_the_tokens(convs):
    rows = build_dataset(convs, "qwen")
    runs = {}
    for r in SP.mask_runs(rows, "id").orderBy("id", "start").collect():
        runs.setdefault(r.id, []).append(r)
    for r in rows.collect():
        mine = runs[r.id]
        assert "".join(x.text for x in mine) == "".join(r.pieces)
        assert [x.start for x in mine] == [0] + [x.end for x in mine][:-1]
        assert all(a.mask != b.mask for a, b in zip(mine, mine[1:]))
        assert sum(x.end - x.start for x in mine if x.mask) == sum(r.loss_mask)


def test_tokens_rejoin_and_fit_the_vocabulary(spark):
    texts = ["", "abc" * 40, "a b\n<|im_end|>", "π≈🌞<|not a marker|>", "0" * 33]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in TK.tokenize(rows, vocab_size=100).collect():
        assert "".join(r.pieces) == r.text
        assert list(r.pieces) == re.findall(TK.TOKEN, r.text)
        assert all(0 <= i < 100 for i in r.input_ids)


def test_encode_by_vocabulary(spark):
    rows = TK.tokenize(spark.createDataFrame([(1, "a b a"), (2, ""), (3, "c")], "id int, text string")).drop("input_ids")
    vocab = spark.createDataFrame([("a", 5), (" ", 7), ("z", 9)], "token string, token_id bigint")
    got = {r.id: list(r.input_ids) for r in TK.encode(rows, vocab, "id").collect()}
    assert got == {1: [5, 7, 0, 7, 5], 2: [], 3: [0]}


def test_nesting_drops_only_what_cannot_be_reached(spark):
    """Turns of other roles are not counted against the limit."""
    roles = ["user", "assistant"]
    talk = [("a", i, "other" if i < 3000 else roles[i % 2], f"t{i}") for i in range(9000)]
    talk += [("b", i, roles[i % 2], f"t{i}") for i in range(10)]
    df = spark.createDataFrame(talk, "conv_id string, turn bigint, role string, text string")
    got = {r.conv_id: [m.content for m in r.conversations] for r in TN.nest_turns(df, 100).collect()}
    assert got["b"] == [f"t{i}" for i in range(10)]
    assert got["a"] == [f"t{i}" for i in range(len(got["a"]))]
    assert 3100 <= len(got["a"]) <= 3100 + 2 * 512
    whole = {r.conv_id: len(r.conversations) for r in TN.nest_turns(df).collect()}
    assert whole == {"a": 9000, "b": 10}


def test_template_registry(spark):
    assert len(template_names()) == 21
    assert template_table(spark).count() == len(TEMPLATES)
    custom = Template("A:", "U:", None, "\n")
    with pytest.raises(ValueError):
        register_template("qwen", custom)
    register_template("custom-test", custom)
    register_template("custom-test", custom, override=True)
    assert get_template("custom-test") is custom
    del TEMPLATES["custom-test"]
    with pytest.raises(KeyError):
        get_template("custom-test")


def test_quote_is_literal():
    for t in TEMPLATES.values():
        for text in (t.assistant_header, t.user_header, t.end_of_turn):
            if text:
                assert re.fullmatch(quote(text), text)


def test_channel_segments(spark):
    rows = spark.createDataFrame(
        [(1, "<|channel|> analysis <|message|> a > b <|end|>junk<|channel|>final<|message|>c<|end|>"), (2, "plain"), (3, "")],
        "id int, text string",
    )
    got = sorted(tuple(r) for r in R.split_channels(rows).collect())
    assert got == [(1, 0, "analysis", "a > b"), (1, 1, "final", "c"), (2, 0, "text", "plain"), (3, 0, "text", "")]


def test_hot_conversation_is_cut_into_chunks(spark):
    n = 5000
    turns = spark.range(n).select(
        F.lit(7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        # Turns alternate, but turn 4322 answers an answer.
        F.when((F.col("id") % 2 == 0) & (F.col("id") != 4322), "user").otherwise("assistant").alias("role"),
        F.lit("x").alias("text"),
    )
    kept = TN.truncate_roles(turns, size=100)
    assert kept.agg(F.count("*"), F.max("turn")).first() == (4322, 4321)
    sizes = TN.with_previous_role(turns, 100).groupBy("conv_id", "chunk").count()
    assert sizes.agg(F.max("count")).first()[0] == 100


def test_patterns_stay_linear_on_hostile_texts(spark):
    # Openings without closings: a pattern that retries from each place would need hours.
    from sparkdraft.functions.answers import EXTRACTORS

    n = 400_000
    bits = ["<", "<|im_start|>assistant\n", "<|channel|>a<|message|>", "def f(", "```\n", r"\boxed{a", "is 1 ", " ", "7"]
    rows = spark.createDataFrame([(b * (n // len(b)) + "x",) for b in bits], "text string").repartition(8)
    text = F.col("text")
    answers = [f(text).isNotNull().alias(k) for k, f in EXTRACTORS.items()]
    assert rows.select(*answers).collect()
    assert R.split_channels(rows).filter("channel = 'text'").count() == len(bits)
    masked = SP.masked_tokens(rows, "text", "qwen").select(F.size("pieces") == F.size("loss_mask"))
    assert {r[0] for r in masked.collect()} == {True}


def test_render_options_differ_by_row(spark):
    talk = say(("user", "q"), ("assistant", "a"))
    rows = [("1", talk, ['{"n":1}', '{"n":2}'], False, "High"), ("2", talk, None, None, None), ("3", talk, [], True, "low")]
    kind = f"{SCHEMA}, tools array<string>, enable_thinking boolean, reasoning_effort string"
    df = spark.createDataFrame(rows, kind)

    def texts(template, *options):
        text = R.render(F.col("conversations"), template, options={o: F.col(o) for o in options})
        return [r.t for r in df.select("id", text.alias("t")).orderBy("id").collect()]

    one, two, three = texts("qwen", "tools", "reasoning_effort")
    assert two == three and "# Tools" not in two
    assert '<tools>\n{"n":1}\n{"n":2}\n</tools>' in one.split("<|im_end|>")[0]
    off, default, on = texts("qwen3-thinking", "enable_thinking")
    assert default == on and off.endswith("assistant\n<think>\n\n</think>\n\na<|im_end|>\n") and "think" not in on
    channels = F.transform("conversations", lambda m: m.withField("role", F.replace(m["role"], F.lit("assistant"), F.lit("assistant_final"))))
    df = df.withColumn("conversations", channels)
    high, low, same = texts("gpt-oss", "reasoning_effort")
    assert "Reasoning: high" in high and low == same and "Reasoning: low" in low
    with pytest.raises(ValueError):
        texts("qwen", "id")
    built = build_dataset(df, "gpt-oss").select("id", F.array_join("pieces", "").alias("t")).orderBy("id").collect()
    assert [r.t for r in built] == [high, low, same]


def workers_of(monkeypatch, make):
    """The functions that ``make`` would send to Python workers."""
    found = []
    with monkeypatch.context() as m:
        m.setattr(SP.F, "arrow_udf", lambda kind: lambda f: found.append(f) or (lambda *columns: F.lit(None)))
        make()
    return found


def test_memory_of_masks_does_not_grow_with_the_batch(spark, monkeypatch):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    n, each = 4000, 500
    listed = lambda values, size: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * size, pa.int32()), pa.array(values, pa.int32()))
    widths = listed(np.full(n * each, 2), each)
    starts = listed(np.tile(np.arange(each) * 2, n), each)
    ends = listed(np.tile(np.arange(each) * 2 + 2, n), each)
    first, last = listed(np.tile([10, 100], n), 2), listed(np.tile([20, 200], n), 2)
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    (sums,) = workers_of(monkeypatch, lambda: SP.prefix_sums(a))
    (mask,) = workers_of(monkeypatch, lambda: SP.offset_mask(a, b, "contained"))
    (mask_at,) = workers_of(monkeypatch, lambda: SP.offset_mask_at(a, b, c, "contained"))
    for work, given in ((sums, [widths]), (mask, [widths, first, last]), (mask_at, [starts, ends, first, last])):
        tracemalloc.start()
        out = work(*given)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(out) == n and out[n - 1].values == out[0].values
        # One array of 64-bit numbers over the whole batch would be 16 MB.
        assert peak < 32e6


def test_slices_of_a_batch_give_what_the_batch_gives(spark, monkeypatch):
    import pyarrow as pa

    kind = pa.list_(pa.int32())
    widths = pa.array([[1, 2, 3], None, [], [4] * 9, [1], [2, 2]], kind)
    first = pa.array([[0, 3], None, [], [4, 16], [], [0]], kind)
    last = pa.array([[1, 6], None, [], [12, 36], [], [4]], kind)
    (sums,) = workers_of(monkeypatch, lambda: SP.prefix_sums(F.col("a")))
    (mask,) = workers_of(monkeypatch, lambda: SP.offset_mask(F.col("a"), F.col("b"), "contained"))
    (prefix,) = workers_of(monkeypatch, lambda: SP.prefix_mask(F.col("a"), F.col("b")))
    texts = pa.array([["a", "bc", "def"], None, [], ["wxyz"] * 9, ["a"], ["ab", "cd"]], pa.list_(pa.string()))
    whole = sums(widths), mask(widths, first, last), prefix(texts, first, last)
    assert whole[0].to_pylist() == [[0, 1, 3], None, [], [4 * i for i in range(9)], [0], [0, 2]]
    assert whole[1].to_pylist() == [[1, 0, 1], None, [], [0, 1, 1, 0, 1, 1, 1, 1, 1], [0], [1, 1]]
    for size in (1, 3, 4, 10):
        monkeypatch.setattr(SP, "SLICE", size)
        sliced = sums(widths), mask(widths, first, last), prefix(texts, first, last)
        assert [a.to_pylist() for a in sliced] == [a.to_pylist() for a in whole]


def test_range_join_shuffles_stretches_and_gives_tokens(spark, monkeypatch, tmp_path):
    rng = random.Random(7)
    data = [(1, "a" * 900 + " b"), (2, ""), (3, None), (None, "x y"), (5, "no"), (5, "no yes")]
    data += [(10 + i, "".join(rng.choices(["ab", " ", "x9", "<|end|>", "é", "🌞🌞", "w" * 300], k=200))) for i in range(12)]
    rows = spark.createDataFrame(data, "id int, text string")
    tokens = {r.id: offsets_of(r.p or []) for r in rows.select("id", TK.pieces(F.col("text")).alias("p")).collect() if r.id != 5}
    spans = [(1, 0, 900), (1, 900, 902), (3, 0, 4), (None, 0, 3), (5, 0, 2), (5, 3, 6)]
    for i in range(12):
        cuts = sorted(rng.sample(range(tokens[10 + i][-1][1] + 1), 6))
        spans += [(10 + i, a, b) for a, b in zip(cuts[::2], cuts[1::2])]
    reach = spark.createDataFrame(spans, "id int, start int, stop int")
    want = [(5, 0, 0, 2), (5, 0, 0, 2), (5, 2, 3, 6)]
    for key, start, stop in spans:
        if key not in (None, 5):
            want += [(key, i, s, e) for i, (s, e) in enumerate(tokens[key]) if start <= s and e <= stop]
    pieces = rows.select("id", TK.pieces(F.col("text")).alias("pieces"))
    for stretch, width in ((None, 256), (256, 256), (4, 8), (1, 2)):
        got = SP.tokens_in_spans(SP.token_rows(pieces, "id", stretch=stretch), reach, "id", width)
        assert got.columns == ["id", "place", "start", "stop"]
        assert sorted(map(tuple, got.collect())) == sorted(want)
    with pytest.raises(ValueError):
        SP.token_rows(pieces, "id", stretch=1 << 16)
    # The query sends a row per stretch to the join, not one per token.
    from sparkdraft.plans import chat
    from sparkdraft.plans.registry import Tables

    text = "one two three four\nfive six seven, eight\nnine ten"
    spark.createDataFrame([(i, text) for i in range(3)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sent = []
    join = SP.tokens_in_spans
    monkeypatch.setattr(SP, "tokens_in_spans", lambda tokens, *rest: sent.append(tokens) or join(tokens, *rest))
    found = chat.span_range_join(Tables(spark, str(tmp_path)))
    texts = chat.channel_texts(Tables(spark, str(tmp_path))).collect()
    assert sent[0].count() <= sum(-(-len(r.text) // 256) for r in texts)
    marked = chat.mask_contained(Tables(spark, str(tmp_path)))
    assert found.count() == marked.agg(F.sum("n_loss")).first()[0] > 0
