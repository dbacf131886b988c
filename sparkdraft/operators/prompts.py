"""Benchmark questions as prompts, with their gold labels."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdraft.functions.hashing import leading_number, seeded_hex
from sparkdraft.functions.rows import evaluate_once
from sparkdraft.functions.text import strip
from sparkdraft.operators.sampling import cap_per_group, head_sample
from sparkdraft.sources.files import check_subsets

# Wording of the prompts.
LETTERS = ("A", "B", "C", "D")
CHOICE_HEAD = (
    "Answer the following multiple choice question. The last line of your response should be of the "
    "following format: 'Answer: $LETTER' (without quotes) where LETTER is one of ABCD. Think step by "
    "step before answering.\n\n"
)
EXAM_OPTIONS = "\n\n选项：\n"
EXAM_TAIL = "\n请从A、B、C、D中选择一个答案。"
CONTEXT_HEAD = "Given the following context:\n\n"
CONTEXT_TAIL = "\n\nCan you answer the following question?\n\n"
REASONING_SUFFIX = "\nPlease reason step by step, and put your final answer within \\boxed{}."
OPTIONS_MARK = "Options:"


def example(question: Column, answer: Column | None = None) -> Column:
    """``Question: …`` and ``Answer:``, with the answer where one is given."""
    head = F.concat(F.lit("Question: "), question, F.lit("\nAnswer:"))
    return head if answer is None else F.concat(head, F.lit(" "), answer)


def fewshot_prompt(df: DataFrame, order_by: str, shots: int = 5) -> DataFrame:
    """Add ``prompt``: the first ``shots`` solved examples, then the question.

    The examples are one small text, brought in as a scalar subquery.
    """
    first = head_sample(df.select(order_by, "question", "answer"), shots, order_by)
    solved = F.struct(F.col(order_by), F.concat(example(F.col("question"), F.col("answer")), F.lit("\n\n")).alias("e"))
    block = first.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(solved)), lambda x: x["e"]), "").alias("b")
    ).scalar()
    return df.withColumn("prompt", F.concat(F.coalesce(block, F.lit("")), example(F.col("question"))))


def choice_prompt(question: Column, choices: Column) -> Column:
    """The four-choice prompt over an array of four answers."""
    lines = [F.concat(F.lit(f"{x}) "), strip(F.get(choices, F.lit(i)))) for i, x in enumerate(LETTERS)]
    return F.concat(F.lit(CHOICE_HEAD), strip(question), F.lit("\n\n"), F.concat_ws("\n", *lines))


def letter_of(index: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in LETTERS]), index)


def shuffled_gold(wrong: list[Column], correct: Column, key: Column, seed: int = 0) -> tuple[Column, Column]:
    """``(choices, label)`` with the right answer at a seeded place among three wrong."""
    place = (leading_number(seeded_hex(seed, key), 8) % 4).cast("int")
    return F.array_insert(F.array(*wrong), place + 1, correct), letter_of(place)


def options_from_map(options: Column) -> Column:
    """An option map as a list in the order A, B, C, D."""
    return F.array(*[F.coalesce(F.try_element_at(options, F.lit(x)), F.lit("")) for x in LETTERS])


def exam_prompt(question: Column, options: Column) -> Column:
    """The exam prompt, or null without a question or with fewer than two options.

    Empty and null options are left out before the lettering.
    """
    real = F.transform(
        F.filter(options, lambda o: F.coalesce(o, F.lit("")) != ""), lambda o: strip(o)
    )
    lines = F.transform(real, lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o, F.lit("\n")))
    text = F.concat(question, F.lit(EXAM_OPTIONS), F.array_join(lines, ""), F.lit(EXAM_TAIL))
    return F.when((F.coalesce(question, F.lit("")) != "") & (F.size(real) >= 2), text)


def exam_label(answer: Column) -> Column:
    """The upper-cased answer if it is one of the letters."""
    letter = strip(F.upper(answer))
    return F.when(letter.isin(*LETTERS), letter)


def context_prompt(question: Column, context: Column) -> Column:
    """The question, under its context where there is one."""
    asked = strip(question)
    framed = F.concat(F.lit(CONTEXT_HEAD), strip(context), F.lit(CONTEXT_TAIL), asked)
    return F.when(context.isNull(), asked).otherwise(framed)


def split_options(question: Column) -> tuple[Column, Column]:
    """``(question, options)`` from a text with lettered lines after the options mark."""
    parts = F.split(question, OPTIONS_MARK, 2)
    lines = F.transform(F.split(strip(F.get(parts, F.lit(1))), "\n"), strip)
    lettered = F.filter(lines, lambda l: l.rlike(r"^[A-Z]\."))
    options = F.transform(lettered, lambda l: strip(F.substring(l, F.lit(3), F.length(l))))
    return strip(F.get(parts, F.lit(0))), F.coalesce(options, F.array().cast("array<string>"))


def option_label(answer: Column, options: Column) -> Column:
    """The upper-cased answer if it is one letter within the options."""
    letter = F.upper(strip(answer))
    single = (F.length(letter) == 1) & letter.between("A", "Z")
    return F.when(single & ((F.size(options) == 0) | (F.ascii(letter) - 64 <= F.size(options))), letter)


@dataclass(frozen=True)
class Benchmark:
    """How one question set becomes ``q_idx, question, label`` and is scored.

    ``build`` gets the raw table and the name of its position column.
    ``cap`` says what a sample limit counts: the first rows of the result
    (``rows``), of every subset (``subset``), or the first positions of the raw
    table, valid or not (``position``).
    """

    build: Callable[[DataFrame, str], DataFrame]
    extractor: str = "as_is"
    accuracy: str | None = None
    answer_keys: tuple[str, ...] = ("answer",)
    cap: str = "rows"


def _rows(df: DataFrame, idx: str, question: Column, label: Column | None = None) -> DataFrame:
    gold = F.lit(None).cast("string") if label is None else label
    keep = ["subset"] if "subset" in df.columns else []
    return df.select(*keep, F.col(idx).alias("q_idx"), question.alias("question"), gold.alias("label"))


def _first_column(df: DataFrame, *names: str) -> Column:
    """The first of the columns the table has."""
    for n in names:
        if n in df.columns:
            return F.col(n)
    raise ValueError(f"expected one of {names}, found {df.columns}")


def _gsm8k(df: DataFrame, idx: str) -> DataFrame:
    from sparkdraft.functions.answers import last_integer

    shots = fewshot_prompt(df, idx)
    return _rows(shots, idx, F.col("prompt"), last_integer(F.col("answer")))


def _gpqa(df: DataFrame, idx: str) -> DataFrame:
    wrong = [F.col(f"Incorrect Answer {i}") for i in (1, 2, 3)]
    choices, label = shuffled_gold(wrong, F.col("Correct Answer"), F.col(idx))
    staged = df.withColumn("_c", choices)
    return _rows(staged, idx, choice_prompt(F.col("Question"), F.col("_c")), label)


def _mmlu(df: DataFrame, idx: str) -> DataFrame:
    label = letter_of(F.col("answer").cast("int"))
    return _rows(df, idx, choice_prompt(F.col("question"), F.col("choices")), label)


def _ceval(df: DataFrame, idx: str) -> DataFrame:
    if "options" in df.columns or "choices" in df.columns:
        options = _first_column(df, "options", "choices")
        name = "options" if "options" in df.columns else "choices"
        if df.schema[name].dataType.typeName() == "map":
            options = options_from_map(options)
    else:
        options = F.array(*[_first_column(df, x, f"option_{x}") for x in LETTERS])
    question = _first_column(df, "question", "inputs", "problem", "content")
    label = exam_label(_first_column(df, "answer", "target", "label", "correct").cast("string"))
    rows = evaluate_once(_rows(df, idx, exam_prompt(question, options), label))
    return rows.filter("question is not null and label is not null")


def _mmstar(df: DataFrame, idx: str) -> DataFrame:
    question, options = split_options(F.col("question"))
    answer = _first_column(df, "answer", "correct_answer", "ground_truth").cast("string")
    return _rows(df, idx, question, option_label(answer, options))


def _turns(df: DataFrame, idx: str) -> DataFrame:
    both = F.struct(F.get("turns", F.lit(0)).alias("question_1"), F.get("turns", F.lit(1)).alias("question_2"))
    return _rows(df, idx, both)


def _labelled(question: str, label: tuple[str, ...], suffix: str = "") -> Callable:
    def build(df: DataFrame, idx: str) -> DataFrame:
        gold = strip(_first_column(df, *label).cast("string"))
        return _rows(df, idx, F.concat(F.col(question), F.lit(suffix)), gold)

    return build


def _plain(question: str) -> Callable:
    return lambda df, idx: _rows(df, idx, strip(F.col(question)))


def _math500(df: DataFrame, idx: str) -> DataFrame:
    from sparkdraft.functions.answers import boxed

    if "answer" in df.columns:
        return _rows(df, idx, F.col("problem"), strip(F.col("answer").cast("string")))
    return _rows(df, idx, F.col("problem"), boxed(F.col("solution")))


def _humaneval(df: DataFrame, idx: str) -> DataFrame:
    gold = [c for c in ("test", "entry_point", "canonical_solution") if c in df.columns]
    return _rows(df, idx, F.col("prompt"), F.to_json(F.struct(*gold)) if gold else None)


# Benchmark names and their columns.
BENCHMARKS: dict[str, Benchmark] = {
    "gsm8k": Benchmark(_gsm8k, "last_integer", "exact"),
    "mtbench": Benchmark(_turns, answer_keys=("answer_1", "answer_2")),
    "aime": Benchmark(_labelled("Problem", ("Answer", "answer"), REASONING_SUFFIX), "contest", "int"),
    "math500": Benchmark(_math500, "boxed", "numeric"),
    "gpqa": Benchmark(_gpqa, "marker", "exact"),
    "mmlu": Benchmark(_mmlu, "marker", "exact", cap="subset"),
    "ceval": Benchmark(_ceval, "letter", "valid_only", cap="position"),
    "mmstar": Benchmark(_mmstar, "ranged_letter", "letter"),
    "humaneval": Benchmark(_humaneval, "code"),
    "livecodebench": Benchmark(_plain("question_content")),
    "financeqa": Benchmark(
        lambda df, idx: _rows(df, idx, context_prompt(F.col("question"), F.col("context")))
    ),
    "simpleqa": Benchmark(_plain("problem")),
}


def register_benchmark(name: str, benchmark: Benchmark, override: bool = False) -> None:
    if name in BENCHMARKS and not override:
        raise ValueError(f"benchmark {name!r} is already registered")
    BENCHMARKS[name] = benchmark


def build_prompts(
    df: DataFrame,
    bench: str,
    idx: str = "q_idx",
    num_samples: int | None = None,
    subsets: list[str] | None = None,
    known: list[str] | None = None,
) -> DataFrame:
    """``bench, [subset,] q_idx, question, label`` of a named benchmark.

    ``subsets`` keeps the rows of these subsets; one that is not among ``known``
    is refused, as are subsets of a table that has none.
    ``num_samples`` keeps the first questions, per subset where the benchmark
    says so; the cut comes before the prompts are written.
    """
    if bench not in BENCHMARKS:
        raise ValueError(f"unknown benchmark {bench!r}; known: {sorted(BENCHMARKS)}")
    spec = BENCHMARKS[bench]
    if subsets is not None:
        if "subset" not in df.columns:
            raise ValueError(f"benchmark {bench!r} has no subsets here")
        if known is not None:
            check_subsets(subsets, known)
        df = df.filter(F.col("subset").isin(*subsets))
    rows = spec.build(df, idx)
    if num_samples is not None:
        if spec.cap == "position":
            rows = rows.filter(F.col("q_idx") < num_samples)
        elif spec.cap == "subset" and "subset" in rows.columns:
            rows = cap_per_group(rows, "subset", "q_idx", num_samples)
        else:
            rows = head_sample(rows, num_samples, "q_idx")
    return rows.select(F.lit(bench).alias("bench"), *rows.columns)
