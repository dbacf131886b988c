"""Readers, normalisers, sinks, sampling and indexing on small fixtures."""

import re
import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from sparkdraft.operators import sampling as S
from sparkdraft.operators.rowindex import running_totals, with_row_index
from sparkdraft.operators.turns import alternation_breaks
from sparkdraft.sources import files, jsonl
from sparkdraft.sources import normalise as N
from sparkdraft.sources.catalog import CATALOG, load_corpus, normalise_corpus, register_corpus


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


DIRTY = [
    "",
    "   ",
    "{not json",
    '{"conversations": null}',
    '{"other": 1}',
    '{"conversations": "text"}',
    '{"conversations": {"role": "user"}}',
    "[1, 2]",
    '{"conversations": ["user", 1, null, {"role": "user", "content": "hi", "n": 3}]}',
    '{"conversations": [{"role": "user", "content": [{"type": "text", "text": "é"}], "tools": {"a": [1]}}]}',
    '{"id": 5, "conversations": [{"role": "assistant", "content": null, "thinking": "t"}]}',
]


def test_dirty_jsonl(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text("\n".join(DIRTY) + "\n", encoding="utf-8")
    good, rejects = jsonl.read_conversations(spark, str(path))
    got = sorted(json.dumps([dict(m) for m in r.conversations], sort_keys=True) for r in good.collect())
    want = [
        [],
        [],
        [{"role": "user", "content": "hi", "n": "3"}],
        [{"role": "user", "content": '[{"type":"text","text":"é"}]', "tools": '{"a":[1]}'}],
        [{"role": "assistant", "content": None, "thinking": "t"}],
    ]
    assert got == sorted(json.dumps(w, sort_keys=True) for w in want)
    reasons = sorted(r.reason for r in rejects.collect())
    assert reasons == ["conversations is not a list"] * 2 + ["invalid json", "not an object"]


def test_read_any_and_merge(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string")
    for suffix, fmt in (("parquet", "parquet"), ("json", "json")):
        rows.write.format(fmt).save(str(tmp_path / f"t.{suffix}"))
        assert files.read_any(spark, str(tmp_path / f"t.{suffix}")).count() == 2
    both = files.read_any(spark, [str(tmp_path / "t.json"), str(tmp_path / "t.json")])
    assert both.count() == 4
    with pytest.raises(ValueError):
        files.read_any(spark, "x.unknown")
    with pytest.raises(ValueError):
        files.read_any(spark, ["a.json", "b.parquet"])
    merged = files.merge_sources({"x": rows, "y": rows.drop("text")})
    assert sorted(map(tuple, merged.select("subset", "id", "text").collect()), key=str) == sorted(
        [("x", 1, "a"), ("x", 2, "b"), ("y", 1, None), ("y", 2, None)], key=str
    )
    with pytest.raises(ValueError):
        files.check_subsets(["a", "z"], ["a", "b"])


def test_listing_and_latest_epoch(spark, tmp_path):
    for name in ("a/data_2.ckpt", "a/data_1.ckpt.gz", "b/c/data_0.ckpt", "a/notes.txt"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x")
    paths = [r.path.split("/", 1)[1] for r in files.list_files(spark, str(tmp_path)).collect()]
    assert len(paths) == 3 and paths == sorted(paths)
    names = [("epoch_2",), ("epoch_10",), ("epoch_x",), ("my_epoch_99",), ("epoch_11\n",), ("epoch_9",)]
    (r,) = files.latest_epoch(spark.createDataFrame(names, "path string")).collect()
    assert (r.path, r.epoch) == ("epoch_10", 10)


def test_sample_store_round_trip(spark, tmp_path):
    rows = spark.range(25).select(F.col("id").alias("sample_idx"), F.array(F.col("id").cast("int")).alias("input_ids"))
    files.write_samples(rows, str(tmp_path / "s"), group_size=10)
    back = files.read_samples(spark, str(tmp_path / "s"))
    assert {(r.sample_idx, r.bucket) for r in back.collect()} == {
        (i, f"rows_{i // 10 * 10}-{i // 10 * 10 + 10}") for i in range(25)
    }
    assert S.skip_existing(spark.range(30).toDF("sample_idx"), back, "sample_idx").count() == 5
    # A broken file is left out and nothing takes its place.
    (tmp_path / "s" / "bucket=rows_0-10" / "part-broken.parquet").write_bytes(b"PAR1 not really")
    assert files.read_samples(spark, str(tmp_path / "s")).select("sample_idx").distinct().count() == 25


def test_save_is_a_no_op_when_present(spark, tmp_path):
    rows = spark.createDataFrame([("a", [{"role": "user", "content": "x"}])], "id string, conversations array<struct<role:string,content:string>>")
    assert files.save_conversations(rows, str(tmp_path / "o"), test=rows)
    assert not files.save_conversations(rows.union(rows), str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o_train")).count() == 1
    assert spark.read.json(str(tmp_path / "o_test")).count() == 1


def test_cache_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    key = files.cache_key(path="p", max_length=5, last_only=False)
    assert key == files.cache_key(last_only=False, max_length=5, path="p")
    assert key != files.cache_key(path="p", max_length=5, last_only=True)
    for _ in range(2):
        assert files.cached(spark, str(tmp_path), key, build).count() == 3
    assert calls == [1]


QA = {
    "opc": ("instruction", "output"),
    "gsm8k": ("question", "answer"),
    "hendrycks_math": ("problem", "solution"),
    "codealpaca-20k": ("instruction", "output"),
    "magicoder-evol-instruct": ("instruction", "response"),
    "camel": ("message_1", "message_2"),
}


@pytest.mark.parametrize("name", list(QA))
def test_question_answer_corpora(spark, name):
    user, assistant = QA[name]
    raw = spark.createDataFrame([("é 1", "b\n")], f"{user} string, {assistant} string")
    (r,) = normalise_corpus(name, raw).collect()
    assert r.id == md5("é 1b\n")
    assert [tuple(m) for m in r.conversations] == [("user", "é 1"), ("assistant", "b\n")]
    with pytest.raises(ValueError):
        normalise_corpus(name, raw.drop(user))


def test_other_corpora(spark):
    assert len(CATALOG) == 20
    speakers = "array<struct<from:string, value:string>>"
    talk = [{"from": f, "value": f} for f in ("human", "gpt", "system", "chatgpt", "bing", "bard", "user")]
    raw = spark.createDataFrame([("x", talk)], f"id string, conversations {speakers}")
    (r,) = N.rolemap_conversation(raw).collect()
    assert [m.content for m in r.conversations] == ["human", "gpt", "chatgpt", "bing", "bard"] and r.skipped == 2
    (r,) = N.rolemap_conversation(raw, extra_roles=("system",)).collect()
    assert r.skipped == 1
    stats = N.skip_statistics(N.rolemap_conversation(raw.union(raw))).first()
    assert tuple(stats) == (2, 10, 4)
    (r,) = normalise_corpus("magpie-qwen2.5-pro-1m-v0.1", raw.withColumnRenamed("id", "uuid")).collect()
    assert r.id == "x"
    numbered = raw.drop("id").withColumn("at", F.lit(9))
    (r,) = normalise_corpus("perfectblend", numbered, position="at").collect()
    assert r.id == "0"
    with pytest.raises(ValueError):
        normalise_corpus("perfectblend", numbered)
    (r,) = normalise_corpus("opencodeinstruct", spark.createDataFrame([("a", "b")], "input string, output string")).collect()
    assert r.id == md5("ab")
    options = spark.createDataFrame([("P", "a) 1", "why")], "Problem string, options string, Rationale string")
    (r,) = normalise_corpus("math_qa", options).collect()
    assert r.conversations[0].content == "P\na) 1" and r.id == md5("P\na) 1why")


def test_messages_reject_other_roles(spark):
    rows = [("p", [{"role": "user", "content": "x"}]), ("q", [{"role": "tool", "content": "x"}]), ("r", [{"role": None, "content": "x"}])]
    raw = spark.createDataFrame(rows, "prompt_id string, messages array<struct<role:string, content:string>>")
    good, rejects = N.messages_to_conversation(raw)
    assert [r.id for r in good.collect()] == ["p"] and sorted(r.id for r in rejects.collect()) == ["q", "r"]


def test_shuffled_choices_keep_the_answer(spark):
    columns = "question string, correct_answer string, distractor1 string, distractor2 string, distractor3 string, support string"
    rows = [(f"q{i}", "right", "w1", "right" if i % 3 == 0 else "w2", "w3", "because") for i in range(60)]
    places = set()
    for r in normalise_corpus("sciq", spark.createDataFrame(rows, columns)).collect():
        user, reply = r.conversations[0].content, r.conversations[1].content
        lines = user.split("\n")[1:]
        assert [x[0] for x in lines] == list("abcd")
        label = reply.split("answer: ")[1][0]
        first = next(x[0] for x in lines if x[3:] == "right")
        assert label == first and reply == f"because\nanswer: {label}) right" and r.id == md5(user + reply)
        places.add(label)
    assert places == set("abcd")


def test_image_rows(spark):
    talk = [{"from": "human", "value": "<image>\nWhat?"}, {"from": "gpt", "value": "<image>\nA cat."}]
    raw = spark.createDataFrame([("1", "a.jpg", talk), ("2", "b.jpg", talk)], "id string, image string, conversations array<struct<from:string, value:string>>")
    present = spark.createDataFrame([("root/a.jpg",)], "path string")
    (r,) = N.image_conversation(raw, "root/", present).collect()
    assert (r.id, r.image) == ("1", "root/a.jpg")
    assert [m.content for m in r.conversations] == ["What?", "<image>\nA cat."]


def test_load_corpus_subsets(spark, tmp_path):
    paths = {}
    for s in ("biology", "physics"):
        spark.createDataFrame([(s, "x")], "message_1 string, message_2 string").write.json(str(tmp_path / f"{s}.json"))
        paths[s] = str(tmp_path / f"{s}.json")
    assert load_corpus(spark, "camel", paths).count() == 2
    assert load_corpus(spark, "camel", paths, subset="physics").count() == 1
    with pytest.raises(ValueError):
        load_corpus(spark, "camel", paths, subset="law")
    with pytest.raises(ValueError):
        register_corpus("camel", CATALOG["camel"])


@pytest.mark.parametrize("coalesced", ["true", "false"])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_row_index_is_dense_and_ordered(spark, coalesced, kind):
    # Keys with wide gaps, so that equal-width buckets would be useless.
    keys = sorted({i**3 % 100_003 for i in range(1000)}) if kind == "long" else sorted({f"k{i}" for i in range(999)})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    try:
        rows = spark.createDataFrame([(None, "x"), *((k, "y") for k in keys)], f"k {kind}, v string").repartition(7)
        numbered = with_row_index(rows, "k")
        assert numbered.columns == ["k", "v", "idx"]
        got = {r.k: r.idx for r in numbered.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {k: i for i, k in enumerate([None, *keys])}


def test_row_index_has_one_plan_for_all_sizes(spark):
    plans = [
        with_row_index(spark.range(n).withColumnRenamed("id", "k"), "k")._jdf.queryExecution().optimizedPlan().toString()
        for n in (10, 100_000)
    ]
    shapes = [re.sub(r"#\d+L?|\d{2,}|parquet.*", "", p) for p in plans]
    assert shapes[0] == shapes[1] and "Window" not in shapes[0]


def test_row_index_of_nothing(spark):
    assert with_row_index(spark.range(0), "id").count() == 0


def test_running_totals_match_a_plain_sum(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("p"), (F.col("id") * 7 % 11).alias("v"))
    got = {r.p: r.before for r in running_totals(rows, "g", "p", {"before": F.col("v")}, size=16).collect()}
    sums = {0: 0, 1: 0, 2: 0}
    for i in range(1000):
        assert got[i] == sums[i % 3]
        sums[i % 3] += i * 7 % 11


def test_exact_split_and_shuffle(spark):
    rows = spark.range(333)
    exact = S.hash_split(rows, "id", 0.05, exact=True)
    assert exact.filter("split = 'test'").count() == math.ceil(0.05 * 333)
    loose = S.hash_split(rows, "id", 0.5, seed=1).filter("split = 'test'").count()
    assert 120 < loose < 210
    order = [r.id for r in S.hash_shuffle(rows, "id").collect()]
    assert order == sorted(range(333), key=lambda i: (md5(f"42|{i}"), i)) and order != list(range(333))
    ranks = {r.id: r.position for r in S.shuffle_rank(rows, "id").collect()}
    assert [ranks[i] for i in order] == list(range(333))


def test_non_finite_screen(spark):
    nan = float("nan")
    rows = [(1, [1.0], [[1.0, 2.0]]), (2, [nan], [[1.0]]), (3, [1.0], [[1.0], [2.0, nan]]), (4, None, None), (5, [float("inf")], [])]
    df = spark.createDataFrame(rows, "id int, v array<float>, m array<array<float>>")
    assert sorted(r.id for r in S.drop_non_finite(df, "v", "m").collect()) == [1, 4, 5]


def test_cap_limits_each_group_before_the_shuffle(spark):
    rows = spark.range(10_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("g"), "id")
    kept = S.cap_per_group(rows, "g", "id", 5)
    assert sorted(r.id for r in kept.collect()) == sorted([0, 3, 6, 9, 12] + [1, 2, 4, 5, 7])


def test_alternation_skips_an_opening_system_turn(spark):
    turns = [(1, i, r) for i, r in enumerate(["system", "user", "assistant", "assistant"])]
    turns += [(2, i, r) for i, r in enumerate(["user", "assistant"])]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string")
    assert [tuple(r) for r in alternation_breaks(rows).collect()] == [(1, 3, "assistant", "user")]


def test_metric_rows_leave_nulls_out(spark):
    rows = spark.createDataFrame([(1, 0.5, None), (2, 0.25, 1.0)], "step long, loss double, acc double")
    out = files.metric_rows(rows, F.lit("r"), F.lit("train"), F.col("step"), {"loss": F.col("loss"), "acc": F.col("acc")})
    assert sorted((r.step, r.name, r.value) for r in out.collect()) == [(1, "train/loss", 0.5), (2, "train/acc", 1.0), (2, "train/loss", 0.25)]
    stamp = spark.sql("select timestamp '2024-01-02 03:04:05' as t").select(files.result_name("x", F.col("t")))
    assert stamp.first()[0] == "x_results_20240102_030405"


def test_damaged_samples_are_listed(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("sample_idx"), F.array(F.lit(1)).alias("input_ids"))
    files.write_samples(rows, str(tmp_path / "s"), group_size=10)
    kind = "sample_idx bigint, input_ids array<int>"
    assert files.unreadable_samples(spark, str(tmp_path / "s"), kind).count() == 0
    (tmp_path / "s" / "bucket=rows_0-10" / "broken.parquet").write_bytes(b"PAR1 not really")
    (bad,) = files.unreadable_samples(spark, str(tmp_path / "s"), kind).collect()
    assert bad.path.endswith("broken.parquet") and files.read_samples(spark, str(tmp_path / "s"), kind).count() == 40


def test_running_totals_in_levels(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("k"), F.floor(F.col("id") / 3).cast("bigint").alias("at"))
    for levels in (1, 2, 3):
        got = running_totals(rows, "k", "at", {"n": F.lit(1), "s": F.col("at")}, size=7, levels=levels).collect()
        assert len(got) == 3000 and all(r.n == r["at"] and r.s == r["at"] * (r["at"] - 1) // 2 for r in got)


def test_samples_and_damage_come_from_one_read(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("sample_idx"), F.array(F.lit(1)).alias("input_ids"))
    files.write_samples(rows, str(tmp_path / "s"), group_size=10)
    (tmp_path / "s" / "bucket=rows_0-10" / "broken.parquet").write_bytes(b"PAR1 not really")
    rows.filter("false").write.parquet(str(tmp_path / "s" / "none"))
    rows.select("sample_idx").write.parquet(str(tmp_path / "s" / "short"))
    found = files.sample_files(spark, str(tmp_path / "s"), rows.schema).collect()
    good = [r for r in found if r.status == "ok"]
    assert sorted(r.sample.sample_idx for r in good) == list(range(40)) and {tuple(r.sample.input_ids) for r in good} == {(1,)}
    bad = {r.path.split("/")[-2] for r in found if r.status == "damaged"}
    assert bad == {"bucket=rows_0-10", "short"} and all(r.sample is None for r in found if r.status != "ok")
    assert {r.path.split("/")[-2] for r in found if r.status == "empty"} == {"none"}


def test_buckets_meet_without_a_shuffle(spark, tmp_path):
    wanted = files.save_bucketed(spark.range(50).toDF("k"), "wanted_k", str(tmp_path / "w"), "k", 4)
    done = files.save_bucketed(spark.range(0, 50, 3).toDF("k"), "done_k", str(tmp_path / "d"), "k", 4)
    rest = S.skip_existing_bucketed(wanted, done, "k")
    assert "Exchange" not in rest._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.k for r in rest.collect()) == [i for i in range(50) if i % 3]


def test_catalog_query_knows_all_names():
    from sparkdraft.plans import corpus as C

    asked = {*C.MESSAGE_CORPORA, *C.SPEAKER_CORPORA, *C.NUMBERED_CORPORA, *C.QA_COLUMNS, "math_qa", "sciq"}
    assert asked == set(CATALOG)
