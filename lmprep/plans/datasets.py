"""Training datasets by kind: from a spec to rows a trainer can read."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lmprep.cluster import stored
from lmprep.functions.templates import instruction_prompt
from lmprep.functions.tokenizers import Tokenizer
from lmprep.operators.labels import mask_chat_labels, mask_instruction_labels
from lmprep.operators.mixing import combine_sources, mix_sources
from lmprep.operators.packing import chars_per_token, pack_sequences
from lmprep.operators.sampling import head
from lmprep.operators.validation import validate_nonempty, validate_roles
from lmprep.sources import schemas
from lmprep.sources.readers import read_pretokenized, read_source, scan_raw_text
from lmprep.sources.specs import load_prompt_format, parse_validation_spec
from lmprep.sources.writers import materialize


#: Rows of a corpus by which characters per token are estimated.
ESTIMATE_ROWS = 500


@dataclass(frozen=True)
class DatasetOptions:
    """Settings shared by the dataset kinds, with the trainer's defaults."""

    max_seq_length: int = 512
    use_dynamic_padding: bool = False
    disable_padding: bool = False
    prompt_format_path: str | None = None
    interleave_probs: str | None = None
    stopping_strategy: str = "all_exhausted"
    seed: int = 42
    shuffle_packed: bool = True
    order_key: str = "doc_id"
    shards: int = 1
    num_sequences: int = 1024
    materialize_to: str | None = None

    @property
    def constant_padding(self) -> bool:
        return not (self.use_dynamic_padding or self.disable_padding)


def build_dataset(
    spark: SparkSession, kind: str, spec: str, tok: Tokenizer, options: DatasetOptions = DatasetOptions(), split: str = "train"
) -> DataFrame:
    """``alpaca``, ``culturax`` (raw text), ``chat`` or ``pretokenized``."""
    builders = {"alpaca": _instructions, "culturax": _raw_text, "chat": _chat, "pretokenized": _stored}
    if kind not in builders:
        raise ValueError(f"Unknown dataset type: {kind}")
    built = builders[kind](spark, spec, tok, options, split)
    return materialize(built, options.materialize_to) if options.materialize_to else built


def _instructions(spark, spec, tok, options, split) -> DataFrame:
    records = schemas.require(read_source(spark, spec, split), "instruction", "output")
    prompts = load_prompt_format(spark, options.prompt_format_path)
    prompted = records.withColumn("prompt", instruction_prompt(records, prompts))
    return mask_instruction_labels(prompted, tok, options.max_seq_length, padding=options.constant_padding)


def _chat(spark, spec, tok, options, split) -> DataFrame:
    if options.constant_padding:
        raise ValueError("chat rows are padded per batch: use dynamic padding or none")
    records = schemas.require(read_source(spark, spec, split), "messages")
    checked = validate_roles(validate_nonempty(records))
    return mask_chat_labels(checked, tok, options.max_seq_length)


def _raw_text(spark, spec, tok, options, split) -> DataFrame:
    key = options.order_key
    corpora = scan_raw_text(spark, spec, split, key)
    if len(corpora) == 1:
        (raw,) = corpora.values()
        estimated, texts, text_key = raw, None, ()
    else:
        # texts are written once each, keys are mixed and written in step order; the estimate takes the texts of the first steps,
        # packing the lengths of all and then the texts, each of which moves once however often it is drawn
        keys = {name: rows.select(key) for name, rows in corpora.items()}
        mixed = mix_sources(keys, key, options.interleave_probs, options.seed, options.stopping_strategy)
        raw = stored(mixed.select("step", "source", key).sortWithinPartitions("step"))
        texts, text_key, key = stored(combine_sources(corpora), "zstd"), ["source", key], "step"
        estimated = texts.join(F.broadcast(head(raw, ESTIMATE_ROWS, key)), text_key)
    ratio = chars_per_token(estimated, tok, ESTIMATE_ROWS, order_key=key).first()["chars_per_token"]
    return pack_sequences(
        raw, tok, options.max_seq_length,
        shuffle_seed=options.seed if options.shuffle_packed else None,
        num_sequences=options.num_sequences, chars_per_token=ratio, order_key=key, shards=options.shards, texts=texts, text_key=text_key,
    )


def _stored(spark, spec, tok, options, split) -> DataFrame:
    return read_pretokenized(spark, spec)


def build_validation(
    spark: SparkSession, kind: str, spec: str, tok: Tokenizer, options: DatasetOptions = DatasetOptions()
) -> dict[str | None, DataFrame]:
    """Named validation sets; packed rows keep their order here."""
    kept = replace(options, shuffle_packed=False, materialize_to=None)
    return {
        name: build_dataset(spark, kind, path, tok, kept, "validation") for name, path in parse_validation_spec(spec)
    }


