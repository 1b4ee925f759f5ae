"""Prompt templates compiled to column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lmprep.functions.text import py_strip

# The default instruction prompts.
DEFAULT_PROMPTS = {
    "prompt_input": (
        "Below is an instruction that describes a task, paired with an input that provides further context. "
        "Write a response that appropriately completes the request.\n\n"
        "### Instruction:\n{instruction}\n\n### Input:\n{input}\n\n### Response:\n"
    ),
    "prompt_no_input": (
        "Below is an instruction that describes a task. "
        "Write a response that appropriately completes the request.\n\n"
        "### Instruction:\n{instruction}\n\n### Response:\n"
    ),
}

# Evaluation prompts, answer choices and language names.
READING_PROMPT = (
    "P: {{flores_passage}}\nQ: {{question.strip()}}\nA: {{mc_answer1}}\nB: {{mc_answer2}}\n"
    "C: {{mc_answer3}}\nD: {{mc_answer4}}\nAnswer："
)
READING_CHOICES = ("A", "B", "C", "D")
READING_GOLD = ("1", "2", "3", "4")
TOPICS = ("science/technology", "travel", "politics", "sports", "health", "entertainment", "geography")
TOPIC_PROMPT = f"Topic Classification: {', '.join(TOPICS)}.\n\nThe label of [{{{{sentence.strip()}}}}] is"
LANGUAGE_NAMES = {
    "eng_Latn": "English",
    "vro_Latn": "Võro",
    "liv_Latn": "Livonian",
    "kpv_Cyrl": "Komi",
    "est_Latn": "Estonian",
    "fin_Latn": "Finnish",
    "rus_Cyrl": "Russian",
}

_SLOT = re.compile(r"\{\{\s*(\w+)(\.strip\(\))?\s*\}\}")


def _value(name: str, columns: Iterable[str], null_text: str) -> Column:
    if name not in columns:
        raise KeyError(f"template names the missing field {name!r}")
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(null_text))


def _join(parts: list[Column]) -> Column:
    return F.concat(*parts) if parts else F.lit("")


def render_template(template: str, df: DataFrame, null_text: str = "None") -> Column:
    """``{field}`` substitution; values are taken as they are and never re-read as templates."""
    parts: list[Column] = []
    for text, name, spec, conversion in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is None:
            continue
        if spec or conversion or not name.isidentifier():
            raise ValueError(f"only plain {{field}} slots are supported, not {name!r}")
        parts.append(_value(name, df.columns, null_text))
    return _join(parts)


def render_slots(template: str, df: DataFrame) -> Column:
    """``{{field}}`` and ``{{field.strip()}}`` substitution."""
    parts: list[Column] = []
    end = 0
    for match in _SLOT.finditer(template):
        if match.start() > end:
            parts.append(F.lit(template[end : match.start()]))
        value = _value(match.group(1), df.columns, "")
        parts.append(py_strip(value) if match.group(2) else value)
        end = match.end()
    if end < len(template):
        parts.append(F.lit(template[end:]))
    return _join(parts)


def has_input(df: DataFrame, field: str = "input", py_null: bool = False) -> Column:
    """True where the record takes the template with an input.

    A missing column or ``''`` means no input. A null does too, unless ``py_null`` asks for
    the dictionary behaviour, where a null is a value of its own and prints as ``None``.
    """
    if field not in df.columns:
        return F.lit(False)
    value = F.col(f"`{field}`")
    return F.coalesce(value != "", F.lit(py_null))


def instruction_prompt(df: DataFrame, prompts: Mapping[str, str] = DEFAULT_PROMPTS, py_null: bool = False) -> Column:
    plain = render_template(prompts["prompt_no_input"], df)
    if "input" not in df.columns:
        return plain
    return F.when(has_input(df, py_null=py_null), render_template(prompts["prompt_input"], df)).otherwise(plain)


def instruction_example(
    df: DataFrame, prompts: Mapping[str, str] = DEFAULT_PROMPTS, py_null: bool = False
) -> Column:
    return F.concat(instruction_prompt(df, prompts, py_null), F.col("output"))


def render_mc_prompt(df: DataFrame) -> Column:
    return render_slots(READING_PROMPT, df)


def render_topic_prompt(df: DataFrame) -> Column:
    return render_slots(TOPIC_PROMPT, df)


def language_name(code: Column, names: Mapping[str, str] = LANGUAGE_NAMES) -> Column:
    pairs = [F.lit(v) for item in names.items() for v in item]
    return F.try_element_at(F.create_map(*pairs), code)


def translation_template(src: str, tgt: str, names: Mapping[str, str] = LANGUAGE_NAMES) -> str:
    return f"{names[src]}: {{{{sentence_{src}}}}}\n{names[tgt]}:"


def render_translation_prompt(
    df: DataFrame, src: str, tgt: str, names: Mapping[str, str] = LANGUAGE_NAMES
) -> Column:
    return render_slots(translation_template(src, tgt, names), df)


def target_index(value: Column, choices: Iterable[str]) -> Column:
    """0-based position of the gold label; a label outside the choices fails the query."""
    position = F.array_position(F.array(*map(F.lit, choices)), value)
    shown = F.coalesce(value, F.lit("null"))
    return F.when(position > 0, (position - 1).cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("label is not a choice: "), shown)).cast("int")
    )


# The text each task family looks for in training data.
DECONTAMINATION_QUERY = {"reading": "{{question}}", "topic": "{{sentence}}"}


def translation_query_template(src: str, tgt: str) -> str:
    return f"{{{{sentence_{src}}}}}\t{{{{sentence_{tgt}}}}}"


def decontamination_query(df: DataFrame, family: str, src: str | None = None, tgt: str | None = None) -> Column:
    if family == "translation":
        if src is None or tgt is None:
            raise ValueError("a translation query needs both languages")
        return render_slots(translation_query_template(src, tgt), df)
    return render_slots(DECONTAMINATION_QUERY[family], df)
