"""Answers read off model outputs: one Column in, one Column out.

The patterns follow Python's ``re`` on text: white space, digits and letters of
any script, and case folding beyond ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkdraft.functions.text import find_all, last_match, strip

# The patterns and sentinel below define the benchmarks' answers.
INVALID = "-9999999"
MARKER = "Answer: "
# Patterns tied to the start skip what cannot match, so that a failed try is not
# repeated from every later place: where one opening has no closing, none has.
BOXED = r"\A(?:[^\\]++|\\(?!boxed\{[^}]))*+\\boxed\{([^}]++)\}"
BOXED_BARE = r"(?U)\\boxed\s+([^\s]+)"
BOXED_DIGITS = r"(?U)\\boxed\s+(\d+)"
# Possessive digits: a long run that leads nowhere is not tried at every length.
NUMBER = r"[-+]?(?:\d*+\.)?\d++"
ANSWER_NUMBER = rf"(?iuU)answer[\s:]+({NUMBER})"
EQUALS_NUMBER = rf"(?iuU)(?:is|equals?|=\s*)({NUMBER})\s*$"
ANSWER_DIGITS = r"(?iuU)answer[\s:]+(\d+)"
EQUALS_DIGITS = r"(?iuU)(?:is|equals?|=\s*)(\d++)\s*$"
# Python's word boundary around a letter: no letter, digit or underscore beside it.
NOT_AFTER = r"(?<![\p{L}\p{N}_])"
NOT_BEFORE = r"(?![\p{L}\p{N}_])"
LETTER_MARKS = (r"\((%s)\)", r"\[(%s)\]", r"答案[：:]\s*(%s)", r"Answer[：:]\s*(%s)")
CHOSEN_MARK = r"选择[：:]\s*(%s)"
CODE_BLOCK = r"\A(?:[^`]++|`(?!``(?:python)?\n))*+```(?:python)?\n((?:[^`]++|`(?!``))*+)```"
CODE_FUNCTION = (
    r"(?U)\A(?:[^d]++|d(?!ef\s+\w+\()|def\s+\w+\([^)]*+(?:\)(?!:)|\z))*+"
    r"(def\s+\w+\([^)]*+\):(?:[^\n]++|\n(?!\ndef\s))*+)"
)


def _first(col: Column, pattern: str) -> Column:
    """The first match of group 1, or null.  Groups here are never empty."""
    return F.nullif(F.regexp_extract(col, pattern, 1), F.lit(""))


def last_integer(output: Column) -> Column:
    """The last run of digits without commas, as its decimal text.

    None, or a leading zero before other digits, gives the sentinel.  The value
    stays a text, so that no length of number is lost.
    """
    digits = last_match(F.replace(output, F.lit(","), F.lit("")), r"(?U)\d+")
    bad = digits.isNull() | digits.rlike(r"^0+[1-9]") | ~digits.rlike(r"^[0-9]+$")
    return F.when(bad, F.lit(INVALID)).when(digits.rlike("^0+$"), F.lit("0")).otherwise(digits)


def boxed(output: Column) -> Column:
    """Boxed content, else a number after answer words, else the last number."""
    return F.coalesce(
        strip(_first(output, BOXED)),
        strip(_first(output, BOXED_BARE)),
        last_match(output, ANSWER_NUMBER, 1),
        last_match(output, EQUALS_NUMBER, 1),
        last_match(output, rf"(?U){NUMBER}"),
    )


def contest(output: Column) -> Column:
    """The last integer of the box, else after answer words, else up to 999."""
    inside = strip(_first(output, BOXED))
    loose = F.filter(
        find_all(output, rf"(?U){NOT_AFTER}\d+{NOT_BEFORE}"), lambda n: n.rlike(r"(?U)^0*\d{1,3}$")
    )
    return F.coalesce(
        last_match(inside, r"(?U)\d+"),
        inside,
        _first(output, BOXED_DIGITS),
        last_match(output, ANSWER_DIGITS, 1),
        last_match(output, EQUALS_DIGITS, 1),
        F.try_element_at(loose, F.lit(-1)),
    )


def after_marker(output: Column) -> Column:
    """The text between the first and the second marker, stripped."""
    found = F.instr(output, MARKER) > 0
    return F.when(found, strip(F.split_part(output, F.lit(MARKER), F.lit(2))))


def choice_letter(output: Column) -> Column:
    """A, B, C or D: standing alone, after a mark, or anywhere."""
    text = F.upper(strip(output))
    marked = [_first(text, "(?iu)" + m % "[ABCD]") for m in LETTER_MARKS]
    return F.coalesce(
        _first(text, f"{NOT_AFTER}([ABCD]){NOT_BEFORE}"),
        *[F.upper(m) for m in marked],
        _first(text, "([ABCD])"),
    )


def ranged_letter(output: Column, options: Column | None = None) -> Column:
    """A letter within the number of options (A–D without options).

    Of each pattern only the first match counts; if it is out of range the next
    pattern is tried.
    """
    text = F.upper(strip(output))
    n = F.lit(4) if options is None else F.when(options > 0, options).otherwise(4)
    patterns = [f"{NOT_AFTER}([A-Z]){NOT_BEFORE}"]
    patterns += ["(?iu)" + m % "[A-Z]" for m in (*LETTER_MARKS, CHOSEN_MARK)]
    tried = []
    for p in patterns:
        letter = F.upper(_first(text, p))
        tried.append(F.when(F.ascii(letter) - 64 <= n, letter))
    return F.coalesce(*tried)


def code(output: Column) -> Column:
    """A fenced block, else the first function, else the text itself."""
    whole = strip(output)
    return (
        F.when(output.rlike(CODE_BLOCK), strip(F.regexp_extract(output, CODE_BLOCK, 1)))
        .when(output.rlike(CODE_FUNCTION), strip(F.regexp_extract(output, CODE_FUNCTION, 1)))
        .otherwise(F.nullif(whole, F.lit("")))
    )


def assemble_code(prompt: Column, predicted: Column, entry_point: Column) -> Column:
    """A runnable program: the prediction, after its prompt unless complete.

    A prediction is complete when it defines the entry point, or defines any
    function while no entry point is known.
    """
    body = strip(predicted)
    defines = body.startswith("def ")
    name = F.regexp_extract(body, r"(?U)^def\s+(\w+)\s*\(", 1)
    known = F.coalesce(entry_point, F.lit("")) != ""
    complete = defines & (~known | (name == entry_point))
    return F.when(complete, body).otherwise(F.concat(prompt, F.lit("\n"), body))


EXTRACTORS = {
    "last_integer": last_integer,
    "boxed": boxed,
    "contest": contest,
    "marker": after_marker,
    "letter": choice_letter,
    "ranged_letter": ranged_letter,
    "code": code,
    "as_is": lambda output: output,
}


def extract_answer(output: Column, kind: str) -> Column:
    """The answer of an output under one of :data:`EXTRACTORS`."""
    if kind not in EXTRACTORS:
        raise ValueError(f"unknown extractor {kind!r}; known: {sorted(EXTRACTORS)}")
    return EXTRACTORS[kind](output)
