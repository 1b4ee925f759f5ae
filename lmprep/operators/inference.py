"""Batch inference over partitions and clean-up of the predictions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lmprep.functions.arrays import strip_prompt_tokens
from lmprep.functions.text import normalize_prediction
from lmprep.functions.tokenizers import Tokenizer

# Generation options a caller may leave out, with the values used then.
GENERATION_DEFAULTS = {
    "max_new_tokens": 100,
    "do_sample": True,
    "top_p": 1.0,
    "temperature": 1.0,
    "min_length": None,
    "use_cache": True,
    "top_k": 50,
    "repetition_penalty": 1.0,
    "length_penalty": 1,
    "num_beams": 1,
}


def generate(
    df: DataFrame,
    predict: Callable[..., list[str]],
    batch_size: int = 8,
    prompt: str = "prompts",
    output: str = "raw_output",
    **options,
) -> DataFrame:
    """Add ``output`` = ``predict(list_of_prompts, **options)``, ``batch_size`` prompts at a time.

    ``predict`` runs on the executors, one call per batch of a partition. A callable with a
    ``load()`` method gets it called once per task, to bring its model in.
    """
    settings = {**GENERATION_DEFAULTS, **options}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if hasattr(predict, "load"):
            predict.load()
        for frame in frames:
            prompts, outputs = iter(frame[prompt]), []
            while batch := list(islice(prompts, batch_size)):
                answered = predict(batch, **settings)
                if len(answered) != len(batch):
                    raise ValueError("predict must return one output per prompt")
                outputs.extend(answered)
            yield frame.assign(**{output: outputs})

    schema = T.StructType([*df.schema.fields, T.StructField(output, T.StringType())])
    return df.mapInPandas(run, schema)


def postprocess(
    df: DataFrame, tok: Tokenizer, generated: str = "generated", prompt_len: str | Column = "prompt_len", prompt: str = "prompts"
) -> DataFrame:
    """Generated ids to the prediction record ``input, raw_output, output``."""
    n = F.col(prompt_len) if isinstance(prompt_len, str) else prompt_len
    answered = df.withColumn("raw_output", tok.decode(strip_prompt_tokens(F.col(generated), n)))
    return prediction_record(answered, prompt)


def prediction_record(df: DataFrame, prompt: str = "prompts", raw: str = "raw_output") -> DataFrame:
    rest = [c for c in df.columns if c not in (prompt, raw)]
    return df.select(
        *rest,
        F.col(prompt).alias("input"),
        F.col(raw).alias("raw_output"),
        normalize_prediction(F.col(raw)).alias("output"),
    )


def attach_predictions(
    prompts: DataFrame, outputs: DataFrame, on: str | Sequence[str] = ("batch_id", "batch_pos")
) -> DataFrame:
    """Line up outputs with their prompts by batch and position."""
    return prompts.join(outputs, [on] if isinstance(on, str) else list(on))


def keep_id(df: DataFrame, prompt: Column, id_column: str = "id") -> DataFrame:
    """Prompt with its record id beside it."""
    return df.select(prompt.alias("prompts"), F.col(id_column).alias("ids"))
