"""Prompts, answers, accuracy, run metrics, dashboards and training metrics."""

import json
import math

import pytest
from pyspark.sql import functions as F

from sparkdraft.functions import answers as A
from sparkdraft.operators import prompts as P
from sparkdraft.operators import results as RS
from sparkdraft.operators import scoring as SC
from sparkdraft.operators import training_metrics as TM

CASES = {
    "last_integer": [
        ("total 1,234 and 5,678", "5678"), ("none", A.INVALID), ("", A.INVALID), ("x 007", A.INVALID), ("a 000", "0"),
        ("3.50", "50"), ("9" * 60, "9" * 60), ("10", "10"), ("-12", "12"),
    ],
    "boxed": [
        (r"so \boxed{ 3/4 } and \boxed{5}", "3/4"), (r"so \boxed x+1 then", "x+1"), ("The answer is 42", "42"),
        ("Answer: 3.14 or answer: -2", "-2"), ("it equals 7", "7"), ("x = 9\n", "9"), ("1 then +2.5 apples", "+2.5"), ("none", None),
        (r"\boxed{}", None), ("ANSWER :8", "8"), (r"\boxed{ }", ""),
    ],
    "contest": [
        (r"\boxed{12 or 034}", "034"), (r"\boxed{x}", "x"), (r"\boxed 77 88", "77"), ("Final answer: 123", "123"),
        ("The answer is 42.", None and "42" or "42"), ("it is 7", "7"), ("values 1000 and 0999 and 12345", "0999"), ("a1 b2", None),
    ],
    "marker": [("x Answer:  B \n", "B"), ("Answer: A Answer: B", "A"), ("answer: A", None), ("Answer: ", "")],
    "letter": [
        ("the answer is c", "C"), ("(B) yes", "B"), ("答案：D", "D"), ("xxbxx", "B"), ("zzz", None), ("a) b)", "A"), ("éB A", "A"), ("_B_ cab", "B"),
    ],
    "ranged_letter": [("Z then (B)", "B"), ("D", "D"), ("E", None), ("选择：C", "C"), ("[Q] (d)", "D"), ("", None)],
    "code": [
        ("Hi\n```python\ndef f():\n  pass\n```\nrest", "def f():\n  pass"), ("```\nx\n```", "x"),
        ("Sure def f(a,\n b): return 1\n\ndef g(): pass", "def f(a,\n b): return 1"), ("  just text ", "just text"), (" \n", None),
    ],
}


@pytest.mark.parametrize("kind", list(CASES))
def test_extractors(spark, kind):
    rows = spark.createDataFrame([(i, o) for i, (o, _) in enumerate(CASES[kind])], "i int, o string")
    got = {r.i: r.a for r in rows.select("i", A.extract_answer(F.col("o"), kind).alias("a")).collect()}
    for i, (output, want) in enumerate(CASES[kind]):
        assert got[i] == want, output
    with pytest.raises(ValueError):
        A.extract_answer(F.col("o"), "nothing")


def test_ranged_letter_respects_options(spark):
    rows = spark.createDataFrame([("C", 2), ("C", 3), ("F", 6), ("E", 0)], "o string, n int")
    got = [r[0] for r in rows.select(A.ranged_letter(F.col("o"), F.col("n"))).collect()]
    assert got == [None, "C", "F", None]


def test_code_assembly(spark):
    rows = spark.createDataFrame(
        [("def f(x): 1", "f"), ("def g(x): 1", "f"), ("def g(x): 1", ""), (" return 1 ", "f"), ("def g(x): 1", None)], "p string, e string"
    )
    got = [r[0] for r in rows.select(A.assemble_code(F.lit("P"), F.col("p"), F.col("e"))).collect()]
    assert got == ["def f(x): 1", "P\ndef g(x): 1", "def g(x): 1", "P\nreturn 1", "def g(x): 1"]


def test_matching_rules(spark):
    cases = [
        ("numeric", " 0.5 ", ".50", True), ("numeric", "1e3", "1000", True), ("numeric", "5d", "5", False), ("numeric", "X", "x", True),
        ("numeric", "1", "1.0000001", True), ("numeric", "1", "1.1", False), ("numeric", None, "1", False), ("numeric", "1_0", "10", True),
        ("int", "034", "34", True), ("int", "+7", "7", True), ("int", "-0", "0", True), ("int", "9" * 50, "0" + "9" * 50, True), ("int", "1.0", "1", False),
        ("letter", " b", "B ", True), ("letter", None, "B", False), ("exact", "A", "A", True), ("exact", None, None, True), ("valid_only", None, "A", False),
    ]
    for kind, pred, label, want in cases:
        df = spark.createDataFrame([(pred, label)], "p string, l string")
        assert df.select(SC.is_match(F.col("p"), F.col("l"), kind)).first()[0] is want, (kind, pred, label)


def test_accuracy_denominators(spark):
    rows = [("A", "A"), (None, "B"), ("C", None), ("D", "A")]
    df = spark.createDataFrame(rows, "pred string, label string")
    take = lambda kind, d=df: tuple(SC.accuracy(d, kind).first())
    assert take("exact") == (1, 4, 3, 0.25)
    assert take("valid_only") == (1, 3, 3, 1 / 3)
    assert take("letter") == (1, 3, 3, 1 / 3)
    unlabelled = spark.createDataFrame([("A", None)], "pred string, label string")
    assert take("letter", unlabelled) == (0, 0, 1, None)
    silent = spark.createDataFrame([(None, "A")], "pred string, label string")
    assert take("valid_only", silent) == (0, 0, 0, 0.0)


def test_run_metrics(spark):
    rows = [("a", 2.0, 10, 4), ("a", 2.0, 20, 6), ("b", 0.0, 5, None), ("c", 1.0, 5, 0)]
    df = spark.createDataFrame(rows, "run string, latency double, completion_tokens long, verify_ct long")
    got = {r["run"]: (r.tokens, r.output_throughput, r.accept_length) for r in SC.run_metrics(df, ("run",)).collect()}
    assert got == {"a": (30, 15.0, 3.0), "b": (5, 0.0, 1.0), "c": (5, 5.0, 1.0)}


def test_specs_and_grid(spark):
    df = spark.createDataFrame([("a",), ("a:5",), ("a:5:x,y",), ("a:5:x:y",), ("a:n",)], "spec string")
    got = [(r.bench, r.num_samples, r.subsets, r.error is None) for r in SC.parse_specs(df).collect()]
    assert got == [("a", None, None, True), ("a", 5, None, True), ("a", 5, ["x", "y"], True), ("a", 5, ["x"], False), ("a", None, None, False)]
    assert SC.config_grid(df, ["1,0,0,0", "1,3,1,4"]).count() == 10


def test_results_are_nested_and_saved(spark, tmp_path):
    from datetime import datetime

    from sparkdraft.sources.files import save_results

    runs = spark.createDataFrame([("b", 1, 3, 1, 4, 2.0), ("b", 1, 3, 1, 4, 1.0), ("b", 1, 0, 0, 0, 5.0)], "bench string, batch_size int, steps int, topk int, num_draft_tokens int, latency double")
    path = save_results(SC.nest_results(runs), str(tmp_path), "n", datetime(2024, 1, 2, 3, 4, 5))
    assert path.endswith("/n_results_20240102_030405.jsonl")
    (row,) = spark.read.json(path).collect()
    got = json.loads(row.results)
    assert [(r["steps"], [m["latency"] for m in r["metrics"]]) for r in got] == [(0, [5.0]), (3, [1.0, 2.0])]


def test_prompts(spark):
    mm = spark.createDataFrame([(0, "q ", ["a", " b", "c", "d "], 2)], "q_idx long, question string, choices array<string>, answer int")
    (r,) = P.build_prompts(mm, "mmlu").collect()
    assert r.label == "C" and r.question.endswith("\n\nq\n\nA) a\nB) b\nC) c\nD) d")
    more = mm.drop("q_idx").select(F.lit("s").alias("subset"), F.explode(F.array(*[F.lit(i).cast("long") for i in range(6)])).alias("q_idx"), "question", "choices", "answer")
    both = more.union(more.withColumn("subset", F.lit("t")))
    assert P.build_prompts(both, "mmlu", num_samples=2).count() == 4
    seen = set()
    gp = spark.createDataFrame([(i, "q", "right", "x", "y", "z") for i in range(40)], ["q_idx", "Question", "Correct Answer", "Incorrect Answer 1", "Incorrect Answer 2", "Incorrect Answer 3"])
    for r in P.build_prompts(gp, "gpqa").collect():
        assert f"\n{r.label}) right" in r.question
        seen.add(r.label)
    assert seen == set("ABCD")
    star = spark.createDataFrame([(0, "Q?\nOptions: A. x\n B.  y\nnoise\nC.z", "b"), (1, "Q Options:\nA. x", "B"), (2, "Q", "e"), (3, "Q", "ab")], "q_idx long, question string, answer string")
    got = [(r.question, r.label) for r in P.build_prompts(star, "mmstar").orderBy("q_idx").collect()]
    assert got == [("Q?", "B"), ("Q", None), ("Q", "E"), ("Q", None)]
    exam = spark.createDataFrame([(0, "q", "x", "", None, "y", "b"), (1, "q", "x", "", None, "", "a"), (2, "", "x", "y", "", "", "a"), (3, "q", "x", "y", "z", "w", "e")], "q_idx long, question string, A string, B string, C string, D string, answer string")
    (r,) = P.build_prompts(exam, "ceval").collect()
    assert (r.question, r.label) == ("q\n\n选项：\nA. x\nB. y\n\n请从A、B、C、D中选择一个答案。", "B")
    listed = exam.select("q_idx", "question", F.array("A", "B", "C", "D").alias("options"), "answer")
    assert P.build_prompts(listed, "ceval").collect() == [r]
    assert P.build_prompts(exam, "ceval", num_samples=0).count() == 0
    shots = spark.createDataFrame([(i, f"q{i}", f"w #### {i}") for i in range(7)], "q_idx long, question string, answer string")
    rows = P.build_prompts(shots, "gsm8k", num_samples=2).orderBy("q_idx").collect()
    assert [x.label for x in rows] == ["0", "1"]
    assert rows[1].question.startswith("Question: q0\nAnswer: w #### 0\n\nQuestion: q1") and rows[1].question.endswith("w #### 4\n\nQuestion: q1\nAnswer:")
    math500 = spark.createDataFrame([(0, "p", r"thus \boxed{7}")], "q_idx long, problem string, solution string")
    assert P.build_prompts(math500, "math500").first().label == "7"
    with pytest.raises(ValueError):
        P.build_prompts(math500, "unknown")
    with pytest.raises(ValueError):
        P.register_benchmark("gsm8k", P.BENCHMARKS["gsm8k"])
    P.register_benchmark("own", P.Benchmark(lambda df, idx: df.select("q_idx", F.col("problem").alias("question"), F.lit(None).cast("string").alias("label"))))
    assert P.build_prompts(math500, "own").first().bench == "own"
    del P.BENCHMARKS["own"]


RESULTS = {
    "T": {
        "k1": {
            "benchmark_name": "gsm8k",
            "results": [
                {"batch_size": 1, "steps": 3, "topk": 1, "num_draft_tokens": 4, "metrics": [{"Name": "base", "output_throughput": 10.0, "accept_length": 1.0}, {"Name": "D", "output_throughput": 25.0, "accept_length": 2.5}]},
                {"batch_size": 1, "steps": 5, "topk": 1, "num_draft_tokens": 6, "metrics": [{"Name": "D", "output_throughput": 30.0, "accept_length": 3.0}]},
                {"batch_size": 1, "steps": 3, "topk": 1, "num_draft_tokens": 4, "metrics": [{"Name": "D", "output_throughput": 20.0, "accept_length": 2.0}]},
            ],
        },
        "k2": {"benchmark_name": "mtbench", "results": [{"batch_size": 1, "steps": 3, "topk": 1, "num_draft_tokens": 4, "metrics": [{"Name": "D", "output_throughput": 0.0, "accept_length": 1.0}, {"Name": "base", "output_throughput": 8.0, "accept_length": 1.0}]}]},
    },
}


@pytest.fixture(scope="module")
def flat(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("results")
    (path / "r.json").write_text(json.dumps(RESULTS, indent=2))
    (path / "broken.json").write_text("{broken")
    return RS.flatten_results(RS.read_results(spark, str(path)), "base")


def test_flatten_keeps_the_last_and_its_baseline(flat):
    got = {(r.draft, r.config, r.bench): (r.throughput, r.base_throughput) for r in flat.collect()}
    assert got == {
        ("None", "baseline", "gsm8k"): (10.0, 10.0),
        ("D", "1-3-1-4", "gsm8k"): (20.0, 10.0),
        ("D", "1-5-1-6", "gsm8k"): (30.0, None),
        ("D", "1-3-1-4", "mtbench"): (0.0, 8.0),
        ("None", "baseline", "mtbench"): (8.0, 8.0),
    }


def test_speedups(flat):
    rows = {(r.draft, r.config, r.bench): r for r in RS.speedup(flat).collect()}
    assert rows[("D", "1-3-1-4", "gsm8k")].speedup_text == "2.00"
    assert rows[("D", "1-5-1-6", "gsm8k")].speedup is None and rows[("D", "1-3-1-4", "mtbench")].speedup_text == "-"
    avg = {(r.draft, r.config): (r.speedup, r.benches) for r in RS.average_speedup(flat).collect()}
    assert avg == {("None", "baseline"): (1.0, 2), ("D", "1-3-1-4"): (2.0, 1), ("D", "1-5-1-6"): (None, 0)}
    pivot = {(r.draft, r.config): (r.gsm8k, r.mtbench, r.gpqa) for r in RS.pivot_results(flat, "speedup").collect()}
    assert pivot[("D", "1-3-1-4")] == (2.0, 0.0, 0.0)
    assert {r.target for r in RS.distinct_models(flat).collect()} == {"T"}
    assert RS.select_rows(flat, "T", "D", "mtbench").count() == 1


def test_speedup_classes(flat):
    one = flat.limit(1)
    for ratio, name in ((2.0, "excellent"), (1.5, "good"), (1.1, "moderate"), (1.0, "neutral"), (0.0, "")):
        assert one.select(RS.speedup_class(F.lit(ratio), F.lit(1.0))).first()[0] == name


def test_model_names(spark):
    cases = {"org/V-D-x": "org/x", "V-D/y": "y", "v-d-z//w": "z/w", "V-Dq": "q", "V-D": "V-D", "/a": "a", "/": "/", "a/b": "a/b"}
    rows = spark.createDataFrame([(k,) for k in cases], "n string")
    got = {r.n: r.c for r in rows.select("n", RS.clean_model_name(F.col("n"), "V-D").alias("c")).collect()}
    assert got == cases
    labels = spark.createDataFrame([(None,), ("None",), ("org/V-D-x",)], "n string").select(RS.model_label(F.col("n"), "V-D"))
    assert [r[0] for r in labels.collect()] == ["-", "Baseline", "x"]


def test_losses_match_plain_math(spark):
    logits, target = [0.5, -1.0, 2.0], [1.0, 3.0, -2.0, 0.5]
    flags = spark.createDataFrame([(0, True), (1, False), (2, True), (3, True)], "token_id int, in_draft boolean")
    rows = spark.createDataFrame([(logits, target, 1), (logits, [1.0, 0.0, 4.0, 0.0], 1)], "logits array<double>, target array<double>, loss_mask int")
    made = TM.target_distribution(rows, TM.flag_list(flags))
    first, second = made.collect()
    kept = [1.0, -2.0, 0.5]
    norm = sum(math.exp(x) for x in kept)
    assert first.target_p == pytest.approx([math.exp(x) / norm for x in kept])
    assert (first.position_mask, second.position_mask) == (0, 1)
    acc = TM.masked_accuracy(made).first()
    assert (acc.correct, acc.counted, acc.accuracy) == (0, 2, 0.0)
    lse = math.log(sum(math.exp(x) for x in logits))
    p2 = [math.exp(x) / (math.exp(1) + math.exp(4) + 1) for x in (1.0, 4.0, 0.0)]
    want = -sum(p * (x - lse) for p, x in zip(p2, logits)) / 2
    assert TM.soft_cross_entropy(made).first().loss == pytest.approx(want)
    steps = spark.createDataFrame([(1, i, 2.0) for i in range(3)], "s int, position int, loss double")
    assert TM.step_loss(steps, ("s",), accumulation=2).first().loss == pytest.approx((1 + 0.8 + 0.64))
    assert TM.total_steps(10, 3, 4) == 9


def test_accepted_prefix(spark):
    cases = [([1, 2, 3], [1, 2, 3], 3), ([1, 2, 3], [1, 9, 3], 1), ([1], [2], 0), ([], [], 0)]
    rows = spark.createDataFrame([(d, t) for d, t, _ in cases], "d array<int>, t array<int>")
    got = [r[0] for r in rows.select(TM.accepted_prefix(F.col("d"), F.col("t"))).collect()]
    assert got == [n for *_, n in cases]
