"""Regeneration, and the streaming jobs against their batch forms."""

import datetime

import pytest
from pyspark.sql import functions as F

from sparkdraft.operators import regen as RG
from sparkdraft.operators.training_metrics import metric_windows
from sparkdraft.operators.vocab import token_frequency
from sparkdraft.plans.dataset import build_dataset
from sparkdraft.sources.jsonl import as_messages, clean_lines, read_conversations
from sparkdraft.sources.files import read_published
from sparkdraft.streaming import jobs

SCHEMA = "id string, conversations array<struct<role:string, content:string>>"


def say(*turns):
    return [{"role": r, "content": c} for r, c in turns]


TALKS = [
    ("ok", say(("system", "s"), ("user", "a"), ("assistant", "old"), ("user", "b"))),
    ("starts wrong", say(("assistant", "x"), ("user", "a"))),
    ("bad role", say(("user", "a"), ("tool", "t"))),
    ("no role", say(("user", "a"), (None, "t"))),
    ("fails", say(("user", "boom"))),
    ("long", say(*[("user", "u")] * 9)),
]


def make_echo():
    def echo(messages, params):
        if messages[-1]["content"] == "boom":
            raise RuntimeError("model down")
        return {"content": params["model"] + ":" + "/".join(m["content"] for m in messages), "thinking": "hm"}

    return echo


echo = make_echo()


PARAMS = {"model": "m"}


def test_regenerate(spark):
    df = spark.createDataFrame(TALKS, SCHEMA).withColumn("kept", F.length("id"))
    got = {r.id: r for r in RG.regenerate(df, echo, RG.request_parameters(**PARAMS)).collect()}
    ok = got["ok"]
    assert ok.status == "success" and ok.error is None and ok.kept == 2
    assert [(m.role, m.content) for m in ok.conversations] == [
        ("system", "s"),
        ("user", "a"),
        ("assistant", "m:s/a"),
        ("user", "b"),
        ("assistant", "m:s/a/m:s/a/b"),
    ]
    assert ok.conversations[2].thinking == "hm"
    assert got["starts wrong"].error == RG.STARTS_WITH_ASSISTANT
    assert got["bad role"].error == "Invalid message role: tool"
    assert got["no role"].error == "Invalid message role: null"
    assert got["fails"].error == "model down" and [m.content for m in got["fails"].conversations] == ["boom"]
    assert got["long"].status == "success" and len(got["long"].conversations) == 18
    success, errors = RG.route(RG.regenerate(df, echo, RG.request_parameters(**PARAMS), concurrency=3))
    assert success.count() == 2 and errors.count() == 4


def test_regenerate_keeps_message_fields(spark):
    df = spark.createDataFrame(
        [(7, [{"role": "user", "content": "a", "name": "Ann", "n": 3}], None), (8, None, "x")],
        "id bigint, conversations array<struct<role:string, content:string, name:string, n:int>>, note string",
    )
    rows = {r.id: r for r in RG.regenerate(df, echo, RG.request_parameters(**PARAMS)).collect()}
    assert [tuple(m) for m in rows[7].conversations] == [("user", "a", "Ann", 3, None), ("assistant", "m:a", None, None, "hm")]
    assert rows[8].conversations == [] and rows[8].status == "success" and rows[8].note == "x"


def test_turns_of_any_length(spark):
    """Ten thousand turns go through one context, whatever the batches."""
    talk = [("long", i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(10_000)]
    talk += [("bad", 0, "user", "a"), ("bad", 1, None, "b"), ("bad", 2, "user", "c"), ("wrong", 0, "assistant", "x")]
    df = spark.createDataFrame(talk, "conv_id string, turn bigint, role string, text string")

    def count(messages, params):
        return {"content": str(len(messages))}

    done = RG.regenerate_turns(df, count, RG.request_parameters(**PARAMS))
    success, errors = RG.route_turns(done)
    answers = sorted((r.turn, int(r.text)) for r in success.filter("role = 'assistant'").collect())
    assert answers == [(2 * i, 2 * i + 1) for i in range(5000)]
    assert {r.conv_id: r.error for r in errors.collect()} == {
        "bad": "Invalid message role: null",
        "wrong": RG.STARTS_WITH_ASSISTANT,
    }


def test_parameters_reach_the_responder(spark):
    def say_all(messages, params):
        return {"content": "/".join(f"{k}={params[k]}" for k in sorted(params))}

    df = spark.createDataFrame([(str(i), say(("user", "u"))) for i in range(4)], SCHEMA)
    params = RG.request_parameters(
        model="m",
        top_k=3,
        endpoint=RG.assign_endpoint(F.col("id").cast("long"), ["a", "b"]),
        reasoning_effort=F.when(F.col("id") == "1", RG.weighted_choice(F.col("id"))),
    )
    got = {r.id: r.conversations[1].content for r in RG.regenerate(df, say_all, params).collect()}
    rest = "max_tokens=4096/model=m/temperature=0.7/top_k=3"
    assert got["0"] == f"endpoint=a/{rest}" and got["3"] == f"endpoint=b/{rest}"
    assert got["1"].startswith("endpoint=b/max_tokens=4096/model=m/reasoning_effort=")


def test_parameters(spark):
    row = spark.range(1).select(RG.request_parameters(model="m", max_tokens=5, temperature=0.0, top_p=0.9).alias("p")).first().p
    assert (row.model, row.max_tokens, row.temperature, row.top_p, row.top_k) == ("m", 5, 0.0, 0.9, None)
    for wrong in ({"temperature": 1.5}, {"temperature": -0.1}, {"max_tokens": 0}, {"model": None}, {"depth": 3}):
        with pytest.raises(ValueError):
            RG.request_parameters(**{"model": "m", **wrong})
    with pytest.raises(ValueError):
        RG.assign_endpoint(F.lit(1), [])


def test_weights_are_met(spark):
    picks = spark.range(20_000).select(RG.weighted_choice(F.col("id")).alias("e")).groupBy("e").count()
    share = {r.e: r["count"] / 20_000 for r in picks.collect()}
    assert share["low"] == pytest.approx(0.4, abs=0.02) and share["high"] == pytest.approx(0.2, abs=0.02)


def test_context_length_counts_list_parts(spark):
    talk = say(("user", "a b  c"), ("user", '[{"type":"text","text":"x y"},{"type":"image"}]'), ("user", "[not json"), ("user", ""))
    talk.append({"role": "user", "content": None})
    df = spark.createDataFrame([("1", talk)], SCHEMA)
    assert df.select(RG.context_length(F.col("conversations"))).first()[0] == 3 + 2 + 2


LINES = [
    '{"id": "1", "conversations": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo yo"}]}',
    "broken",
    "",
    '{"conversations": 3}',
    '{"conversations": null}',
]


def test_lines_to_training_rows(spark, tmp_path):
    lines = [
        '{"conversations": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo", "tool_calls": [{"name": "f", "arguments": {"n": 1}}]}]}',
        '{"conversations": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "bad call", "tool_calls": "{oops"}]}',
        '{"conversations": [{"role": "system", "content": "s", "tool_calls": "{oops"}, {"role": "user", "content": "q"}]}',
        "broken",
    ]
    path = tmp_path / "chats.jsonl"
    path.write_text("\n".join(lines))
    good, _ = read_conversations(spark, str(path))
    rows = build_dataset(as_messages(good), "qwen", seed=1)
    texts = sorted("".join(r.pieces) for r in rows.collect())
    head = "<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n"
    assert texts == sorted([
        head + "<|im_start|>assistant\nyo\n<tool_call>\n" + '{"name": "f", "arguments": {"n":1}}\n</tool_call><|im_end|>\n',
        head,
        "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nq<|im_end|>\n",
    ])


def test_stream_ingest_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.jsonl").write_text("\n".join(LINES))
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
    jobs.ingest(lines, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "ck")).awaitTermination()
    good, rejects = clean_lines(spark.read.text(str(tmp_path / "in")))
    assert spark.read.parquet(str(tmp_path / "good")).count() == good.count() == 6
    assert spark.read.parquet(str(tmp_path / "bad")).count() == rejects.count() == 6
    # A restart finds nothing new and adds nothing.
    jobs.ingest(lines, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "good")).count() == 6
    assert as_messages(spark.read.parquet(str(tmp_path / "good")).drop("batch")).filter("size(conversations) = 2").count() == 3


def test_stream_rows_and_counts_equal_batch(spark, tmp_path):
    talks = [(str(i), say(("user", f"q {i}"), ("assistant", f"answer {i % 3} yes"))) for i in range(30)]
    spark.createDataFrame(talks, SCHEMA).repartition(5).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    jobs.training_rows(source, "qwen", str(tmp_path / "rows"), str(tmp_path / "ck1"), max_length=64).awaitTermination()
    batch = build_dataset(spark.read.parquet(str(tmp_path / "in")), "qwen", max_length=64)
    streamed = spark.read.parquet(str(tmp_path / "rows"))
    assert sorted(map(tuple, streamed.select(batch.columns).collect())) == sorted(map(tuple, batch.collect()))
    rows = spark.readStream.schema(streamed.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "rows"))
    jobs.token_counts(rows, str(tmp_path / "counts"), str(tmp_path / "ck2")).awaitTermination()
    got = {r.token_id: r.freq for r in read_published(spark, str(tmp_path / "counts")).collect()}
    assert got == {r.token_id: r.freq for r in token_frequency(batch).collect()}


def test_stream_counts_merge_their_state_in_many_tasks(spark, tmp_path):
    talks = [(str(i), say(("user", f"q {i}"), ("assistant", f"answer {i} yes"))) for i in range(20)]
    batch = build_dataset(spark.createDataFrame(talks, SCHEMA), "qwen", max_length=64)
    batch.coalesce(1).write.parquet(str(tmp_path / "rows"))
    rows = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "rows"))
    query = jobs.token_counts(rows, str(tmp_path / "counts"), str(tmp_path / "ck"))
    query.awaitTermination()
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup(str(query.runId)) for s in tracker.getJobInfo(j).stageIds]
    tasks = [found.numTasks for s in stages if (found := tracker.getStageInfo(s))]
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) in tasks
    (version,) = [p for p in (tmp_path / "counts" / "versions").iterdir()]
    assert len(list(version.glob("*.parquet"))) == 1
    got = {r.token_id: r.freq for r in read_published(spark, str(tmp_path / "counts")).collect()}
    assert got == {r.token_id: r.freq for r in token_frequency(batch).collect()}


def test_stream_regeneration_resumes(spark, tmp_path):
    source_dir = str(tmp_path / "in")
    spark.createDataFrame(TALKS[:3], SCHEMA).coalesce(1).write.parquet(source_dir)
    args = (RG.request_parameters(**PARAMS), str(tmp_path / "ok"), str(tmp_path / "err"), str(tmp_path / "ck"))
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(source_dir)
    outcome = lambda: [
        sorted((r.id, r.status, r.error, r.batch) for r in spark.read.parquet(str(tmp_path / d)).collect())
        for d in ("ok", "err")
    ]
    jobs.regeneration(stream(), echo, *args).awaitTermination()
    # More input arrives, with two conversations that were handled before.
    spark.createDataFrame([TALKS[0], TALKS[2], TALKS[4], ("new", say(("user", "z")))], SCHEMA).coalesce(1).write.mode(
        "append"
    ).parquet(source_dir)
    jobs.regeneration(stream(), echo, *args).awaitTermination()
    done = outcome()
    assert [r[0] for r in done[0]] == ["new", "ok"]
    assert [r[0] for r in done[1]] == ["bad role", "fails", "starts wrong"]

    def never(messages, params):
        raise AssertionError("the model was asked again")

    # A crash before the last commit: the batch is replayed, from the answers it has.
    commits = sorted((tmp_path / "ck" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    jobs.regeneration(stream(), never, *args).awaitTermination()
    assert outcome() == done
    assert [p.name for p in (tmp_path / "ck" / "answers").glob("batch=*")] == [f"batch={commits[-1].name}"]


def test_stream_regeneration_reads_no_output_of_its_own(spark, tmp_path):
    """Each run writes elsewhere: what was handled is in the state, with and without a watermark."""
    for name, options in (("plain", {}), ("bounded", {"time": "at", "lateness": "1 hour"})):
        base = tmp_path / name
        kind = SCHEMA + ", at timestamp" if isinstance(SCHEMA, str) else SCHEMA.add("at", "timestamp")
        asked = spark.sparkContext.accumulator(0)

        def count(messages, params, asked=asked):
            asked.add(1)
            return {"content": "x"}

        def run(ids, part):
            at = datetime.datetime(2024, 1, 1)
            rows = [(str(i), say(("user", f"q {i}")), at) for i in ids]
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(base / "in"))
            source = spark.readStream.schema(kind).parquet(str(base / "in"))
            jobs.regeneration(
                source, count, RG.request_parameters(**PARAMS), str(base / part), str(base / "err"), str(base / "ck"), **options
            ).awaitTermination()
            return sorted(r.id for r in spark.read.parquet(str(base / part)).collect())

        assert run(range(5), "first") == list("01234")
        assert run([3, 4, 5, 5], "second") == ["5"]
        assert run([0, 6, 7], "third") == ["6", "7"]
        assert asked.value == 8


def test_live_windows_equal_batch_for_closed_windows(spark, tmp_path):
    rows = spark.range(500).select(
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("ts"),
        F.lit("loss").alias("name"),
        (F.col("id") % 13).cast("double").alias("value"),
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    jobs.live_metrics(source, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    whole = {tuple(r) for r in metric_windows(rows).collect()}
    assert got < whole and len(whole) - len(got) <= 2
