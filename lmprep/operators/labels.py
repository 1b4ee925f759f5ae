"""Training labels: ids with the spans a model must not learn from set to -100."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lmprep.functions.arrays import IGNORE, append_eos, bind, mask_prefix, ones, pad_right, padded_mask
from lmprep.functions.chat import HEADER, chat_training_text, message_body, message_header, render_messages
from lmprep.functions.tokenizers import IDS, ModelTokenizer, Tokenizer


def mask_chat_labels(
    df: DataFrame, tok: Tokenizer, max_len: int, messages: str = "messages"
) -> DataFrame:
    """Add ``input_ids``, ``labels`` and ``attention_mask`` for conversations.

    Masked: every message that is not the assistant's, the header of an assistant message that
    follows one of those, and the leading special id unless the assistant speaks first.
    """
    if tok.prefix_stable:
        return _mask_by_segments(df, tok, max_len, messages)
    return _mask_by_prefixes(df, tok, max_len, messages)


def _mask_by_segments(df: DataFrame, tok: Tokenizer, max_len: int, messages: str) -> DataFrame:
    """Tokenize each header and body once: linear in the conversation."""
    m = F.col(messages)

    def segment(message: Column, i: Column) -> Column:
        role = message["role"]
        before = F.get(m, i - 1)["role"]
        learned = role == "assistant"
        opened_by_other = (i > 0) & (before != "assistant")
        return F.struct(
            tok.encode(message_header(role), specials=False).alias("head"),
            # a body cut at max_len fills the row by itself, so nothing after the cut is ever kept
            tok.encode(message_body(role, message["content"], tok.eos), max_len, specials=False).alias("body"),
            (~learned | opened_by_other).alias("head_masked"),
            (~learned).alias("body_masked"),
        )

    def hide(ids: Column, masked: Column) -> Column:
        return F.when(masked, F.array_repeat(F.lit(IGNORE), F.size(ids))).otherwise(ids)

    lead = tok.encode(F.lit(""))
    first_learned = F.get(m, F.lit(0))["role"] == "assistant"
    n_kept = tok.count(chat_training_text(m, tok.eos), max_len)
    parts = df.select("*", F.transform(m, segment).alias("_segments"), n_kept.alias("_n"))
    s = F.col("_segments")
    ids = F.flatten(F.transform(s, lambda x: F.concat(x["head"], x["body"])))
    labels = F.flatten(
        F.transform(s, lambda x: F.concat(hide(x["head"], x["head_masked"]), hide(x["body"], x["body_masked"])))
    )
    return (
        parts.select(
            *(F.col(f"`{c}`") for c in df.columns),
            F.slice(F.concat(lead, ids), F.lit(1), F.col("_n")).alias("input_ids"),
            F.slice(F.concat(hide(lead, ~first_learned), labels), F.lit(1), F.col("_n")).alias("labels"),
        )
        .withColumn("attention_mask", ones(F.col("input_ids")))
    )


def _mask_by_prefixes(df: DataFrame, tok: ModelTokenizer, max_len: int, messages: str) -> DataFrame:
    """Tokenizers that merge across message boundaries: count the tokens of each prefix."""
    load = tok.loader
    cue = HEADER["assistant"]

    def labelled(model, text: str, pieces: list[str], roles: list[str]) -> tuple[np.ndarray, np.ndarray]:
        heads = list(accumulate(pieces, initial=""))
        hidden = [i for i, role in enumerate(roles) if role != "assistant"]
        ends = [heads[i + 1] + (cue if roles[i + 1 : i + 2] == ["assistant"] else "") for i in hidden]
        # one call for a conversation; the end of a message is often the start of the next
        texts = list(dict.fromkeys([text, *(heads[i] for i in hidden), *ends]))
        encoded = dict(zip(texts, model.encode(texts)))
        counts = {t: len(x) for t, x in encoded.items()} | {"": 0}
        ids = np.asarray(encoded[text][:max_len], np.int32)
        labels = ids.copy()
        for i, end in zip(hidden, ends):
            labels[counts[heads[i]] : counts[end]] = IGNORE
        return ids, labels

    @F.pandas_udf(f"struct<input_ids:{IDS},labels:{IDS}>")
    def label_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for rows in batches:
            found = [
                labelled(model, text, list(pieces), list(roles))
                for text, pieces, roles in zip(rows["text"], rows["pieces"], rows["roles"])
            ]
            yield pd.DataFrame(found, columns=["input_ids", "labels"])

    m = F.col(messages)
    given = F.struct(
        chat_training_text(m, tok.eos).alias("text"),
        render_messages(m, tok.eos).alias("pieces"),
        F.transform(m, lambda x: x["role"]).alias("roles"),
    )
    labelled = df.select("*", label_batch(given).alias("_l"))
    return labelled.select(
        *(F.col(f"`{c}`") for c in df.columns), F.col("_l.input_ids"), F.col("_l.labels")
    ).withColumn("attention_mask", ones(F.col("input_ids")))


def mask_instruction_labels(
    df: DataFrame, tok: Tokenizer, max_len: int, prompt: str = "prompt", output: str = "output", padding: bool = True
) -> DataFrame:
    """Add the training triple of an instruction record; prompt and padding are not learned."""
    p = F.col(prompt)
    base = df.select(
        "*",
        bind(
            tok.encode(F.concat(p, F.col(output)), max_len), lambda ids: append_eos(ids, tok.eos_id, max_len)
        ).alias("_ids"),
        tok.count(p, max_len).alias("_n_prompt"),
    )
    ids = F.col("_ids")
    labels, width = mask_prefix(ids, F.col("_n_prompt")), F.size(ids)
    one, zero = F.lit(1.0).cast("float"), F.lit(0.0).cast("float")
    if padding:
        shown = pad_right(ids, max_len, tok.pad_id)
        labels, mask = pad_right(labels, max_len, IGNORE), padded_mask(width, max_len, one, zero)
    else:
        shown, mask = ids, F.array_repeat(one, width)
    return base.select(
        *(F.col(f"`{c}`") for c in df.columns),
        shown.alias("input_ids"), labels.alias("labels"), mask.alias("attention_mask"),
    )
