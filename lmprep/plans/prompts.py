"""Inference prompts by input format, and the run from prompts to cleaned predictions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lmprep.functions.chat import CHAT_TEMPLATES, ChatTemplate, apply_chat_template, chat_generation_prompt
from lmprep.functions.templates import DEFAULT_PROMPTS, instruction_prompt
from lmprep.operators.inference import generate, keep_id, prediction_record
from lmprep.operators.validation import validate_nonempty
from lmprep.sources.readers import project_text
from lmprep.sources.schemas import require
from lmprep.sources.specs import load_prompt_format


def build_prompts(
    spark: SparkSession,
    df: DataFrame,
    input_format: str = "alpaca",
    task: str | None = None,
    prompt_format_path: str | None = None,
    template: ChatTemplate = CHAT_TEMPLATES["headers"],
    eos: str = "</s>",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Add ``prompts`` by format: ``alpaca``, ``chat``, ``hfchat`` or ``simple``. Columns in ``keep`` stay."""
    if input_format == "alpaca":
        return _instruction_prompts(spark, df, task, prompt_format_path, keep)
    if input_format == "simple":
        return project_text(df) if not keep else df.select(*keep, F.col("text").alias("prompts"))
    if input_format in ("chat", "hfchat"):
        checked = validate_nonempty(require(df, "messages"))
        m = F.col("messages")
        text = chat_generation_prompt(m, eos) if input_format == "chat" else apply_chat_template(m, template)
        return checked.select(*keep, text.alias("prompts"))
    raise ValueError(f"Invalid input format: {input_format}")


def _instruction_prompts(spark, df, task, prompt_format_path, keep) -> DataFrame:
    require(df, "instruction")
    if task is None:
        prompts = load_prompt_format(spark, prompt_format_path)
        return df.select(*keep, instruction_prompt(df, prompts).alias("prompts"))
    if task.lower() == "estqa":
        if prompt_format_path is not None:
            raise NotImplementedError("the QA task has no custom prompt format")
        return keep_id(require(df, "id"), instruction_prompt(df, DEFAULT_PROMPTS))
    raise ValueError(f"Unknown task: {task!r}")


def run_inference(prompts: DataFrame, predict: Callable[..., list[str]], batch_size: int = 8, **options) -> DataFrame:
    """Prompts to records ``{input, raw_output, output}``; other columns (ids, order keys) stay beside them."""
    return prediction_record(generate(prompts, predict, batch_size, **options))
