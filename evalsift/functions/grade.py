"""Rendering items and grading answers, as columns; registries for further renderers and graders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

RENDERERS: dict[str, Callable[[], Column]] = {}
GRADERS: dict[str, Callable[[Column, Column], Column]] = {}
NUMBER = r"-?\d[\d,]*\.?\d*"
#: A boxed answer with up to two levels of braces inside.
BOXED = r"\\boxed\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}"


def register_renderer(name: str, build: Callable[[], Column]) -> None:
    RENDERERS[name] = build


def register_grader(name: str, build: Callable[[Column, Column], Column]) -> None:
    GRADERS[name] = build


def last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def last_number(text: Column) -> Column:
    """The last number of a text, without thousands separators; null if none."""
    return F.replace(last(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))), F.lit(","), F.lit(""))


def gold_number(answer: Column) -> Column:
    """The first number after the last ``####``; empty if none."""
    tail = F.when(F.contains(answer, F.lit("####")), F.substring_index(answer, "####", -1)).otherwise(F.lit(""))
    return F.replace(F.regexp_extract(tail, NUMBER, 0), F.lit(","), F.lit(""))


def letter_match(pred: Column, gold: Column) -> Column:
    return F.coalesce((F.left(F.upper(F.trim(pred)), F.lit(1)) == F.left(gold, F.lit(1))).cast("int"), F.lit(0))


def prefix_match(pred: Column, gold: Column, n: int = 30, least: int = 5) -> Column:
    a, b = F.lower(F.left(F.trim(pred), F.lit(n))), F.lower(F.left(F.trim(gold), F.lit(n)))
    return F.coalesce(((a == b) & (F.length(b) > least)).cast("int"), F.lit(0))


def mc_options(choices: Column) -> Column:
    """``A. first`` and so on, a line each."""
    return F.array_join(F.transform(choices, lambda c, i: F.concat(F.char(F.lit(65) + i), F.lit(". "), c)), "\n")


def mc1_gold(labels: Column) -> Column:
    at = F.array_position(labels, 1).cast("int")
    return F.when(at > 0, F.char(F.lit(64) + at)).otherwise("?")


def boxed(text: Column) -> Column:
    """The content of the last boxed answer with at most two levels of braces; null if none."""
    return last(F.regexp_extract_all(text, F.lit(BOXED), F.lit(1)))


@F.pandas_udf(StringType())
def boxed_deep(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """As ``boxed``, for any depth of braces."""
    for texts in batches:
        out = []
        for t in texts:
            at = (t or "").rfind("\\boxed{")
            depth, got = 0, None
            for i in range(at + 6 if at >= 0 else 0, len(t or "") if at >= 0 else 0):
                depth += (t[i] == "{") - (t[i] == "}")
                if depth == 0:
                    got = t[at + 7 : i]
                    break
            out.append(got)
        yield pd.Series(out, dtype=object)


def as_number(answer: Column) -> Column:
    """A double from plain numbers and from simple fractions in TeX or with a slash; else null."""
    bare = F.regexp_replace(F.trim(answer), r"[$,\s]|\\[!,;]", "")
    part = lambda i: F.regexp_extract(bare, r"^(-?)\\d?t?frac\{(-?\d+\.?\d*)\}\{(-?\d+\.?\d*)\}$|^(-?\d+\.?\d*)/(\d+\.?\d*)$", i)
    up, down = F.coalesce(F.nullif(part(2), F.lit("")), F.nullif(part(4), F.lit(""))).try_cast("double"), F.coalesce(F.nullif(part(3), F.lit("")), F.nullif(part(5), F.lit(""))).try_cast("double")
    fraction = F.try_divide(up, down) * F.when(part(1) == "-", -1).otherwise(1)
    return F.coalesce(bare.try_cast("double"), fraction)


def grade_numeric(pred: Column, gold: Column) -> Column:
    """1 if the boxed (or else last) number agrees with the gold within 1e-4, or the bare strings are equal."""
    said = F.coalesce(boxed(pred), last_number(pred))
    a, b = as_number(said), as_number(gold)
    return F.when(a.isNotNull() & b.isNotNull(), (F.abs(a - b) <= 1e-4).cast("int")).otherwise(F.coalesce((F.trim(said) == F.trim(gold)).cast("int"), F.lit(0)))


def parse_rating(text: Column) -> tuple[Column, Column]:
    """(rating 1-5, reason): after RATING:, else the last lone digit; after REASON:."""
    said = F.nullif(F.regexp_extract(text, r"RATING:\s*([1-5])", 1), F.lit(""))
    lone = last(F.regexp_extract_all(text, F.lit(r"(?:^|[^0-9])([1-5])(?:$|[^0-9])"), F.lit(1)))
    return F.coalesce(said, lone).try_cast("int"), F.nullif(F.trim(F.regexp_extract(text, r"REASON:\s*([^\n]*)", 1)), F.lit(""))


def plausible_code(text: Column) -> Column:
    return F.when(text.startswith("ERR_"), 0).otherwise((F.contains(text, F.lit("return ")) | F.contains(text, F.lit("def "))).cast("int"))


def json_cases(text: Column, item: str, most: int = 5) -> Column:
    """The first ``most`` items of a JSON array in a string; none where it is missing or malformed."""
    return F.slice(F.coalesce(F.from_json(text, f"array<{item}>"), F.array().cast(f"array<{item}>")), F.lit(1), F.lit(most))


def render_item(benchmark: Column, fallback: Column) -> Column:
    """One text for an item: the registered renderer of its benchmark, else ``fallback``."""
    out = None
    for name, build in RENDERERS.items():
        out = F.when(benchmark == name, build()) if out is None else out.when(benchmark == name, build())
    return fallback if out is None else out.otherwise(fallback)


def grade(benchmark: Column, pred: Column, gold: Column) -> Column:
    out = None
    for name, build in GRADERS.items():
        out = F.when(benchmark == name, build(pred, gold)) if out is None else out.when(benchmark == name, build(pred, gold))
    return out.otherwise(0)


def _or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _lines(*parts: Column | str) -> Column:
    """Parts one below another; a string is the label of the part after it."""
    out, label = [], None
    for p in parts:
        if isinstance(p, str):
            label = p
        else:
            out.append(F.concat(F.lit(label), p) if label else p)
            label = None
    return F.array_join(F.array(*out), "\n")


def _letter(at: Column) -> Column:
    return F.char(F.lit(65) + at)


def listed(labels: Column, texts: Column) -> Column:
    """``label. text``, a line each."""
    return F.array_join(F.zip_with(labels, texts, lambda a, b: F.concat(a, F.lit(". "), b)), "\n")


def judged(texts: Column, labels: Column) -> Column:
    """``text (label)``, a line each."""
    return F.array_join(F.zip_with(texts, labels, lambda a, b: F.concat(a, F.lit(" ("), b, F.lit(")"))), "\n")


c = _or_empty
#: Templates by benchmark, over the columns question, answer, subject, choices, labels, label, context and solution:
#: fixed values, since overlap with a corpus is measured on these very texts.
for _name, _build in {
    "gsm8k_test": lambda: _lines("Question: ", c("question"), "Answer: ", c("answer")),
    "mmlu_test": lambda: _lines("Subject: ", c("subject"), "Question: ", c("question"), mc_options(F.col("choices")), "Answer: ", _letter(F.col("label"))),
    "hellaswag_val": lambda: _lines("Context: ", c("context"), "Continuation: ", F.get(F.col("choices"), F.col("label"))),
    "arc_challenge": lambda: _lines("Question: ", c("question"), listed(F.col("labels"), F.col("choices")), "Answer: ", c("answer")),
    "humaneval": lambda: F.concat(c("question"), c("solution")),
    "mbpp": lambda: _lines(c("question"), c("solution")),
    "math": lambda: _lines("Problem: ", c("question"), "Solution: ", c("solution")),
    "math500": lambda: _lines("Problem: ", c("question"), "Solution: ", c("solution")),
    "truthfulqa_mc": lambda: _lines("Question: ", c("question"), judged(F.col("choices"), F.col("labels"))),
    "bbh": lambda: _lines(c("question"), "Answer: ", c("answer")),
    "agieval": lambda: _lines(c("question"), "Answer: ", c("answer")),
    "aime2024": lambda: _lines("Problem: ", c("question"), "Answer: ", c("answer")),
    "livecodebench": lambda: _lines(c("question"), c("solution")),
}.items():
    register_renderer(_name, _build)
for _name, _grader in {"gsm8k_test": lambda p, g: (last_number(p) == gold_number(g)).cast("int"), "mmlu_test": letter_match, "hellaswag_val": letter_match, "arc_challenge": letter_match, "humaneval": prefix_match, "mbpp": prefix_match, "math": grade_numeric}.items():
    register_grader(_name, _grader)
