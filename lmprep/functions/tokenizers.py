"""Tokenizer plug-ins: every operator takes one of these as an argument."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lmprep.functions.arrays import bind

IDS = "array<int>"


class Tokenizer(Protocol):
    """What operators need of a tokenizer.

    ``prefix_stable`` says that the ids of a text are the ids of its pieces put together
    when the text is cut at message boundaries.
    """

    eos: str
    eos_id: int | None
    bos_id: int | None
    pad_id: int
    prefix_stable: bool

    def encode(self, text: Column, max_len: int | None = None, specials: bool = True) -> Column: ...

    def count(self, text: Column, max_len: int | None = None, specials: bool = True) -> Column: ...

    def decode(self, ids: Column) -> Column: ...


def special_token_policy(
    eos_id: int | None, pad_id: int | None, vocab_size: int, new_pad: bool = False, default_concat: int = 0
) -> dict[str, int]:
    """Pad id: the tokenizer's own, else a new last id when asked for, else 0.
    Concat id: eos when it is set and not 0, else the given default."""
    if pad_id is None:
        pad_id = vocab_size if new_pad else 0
    return {"pad_id": pad_id, "concat_id": eos_id if eos_id else default_concat}


def concat_id(tok: Tokenizer, default: int = 0) -> int:
    return tok.eos_id if tok.eos_id else default


class CodepointTokenizer:
    """One id per code point, written only with built-in expressions.

    Ids: 0 pad, 1 ``<s>``, 2 ``</s>``, then code point + 3.
    """

    prefix_stable = True
    bos, eos = "<s>", "</s>"
    pad_id, bos_id, eos_id, shift = 0, 1, 2, 3

    def __init__(self, add_bos: bool = True):
        self.add_bos = add_bos

    def _leading(self, specials: bool) -> int:
        return 1 if specials and self.add_bos else 0

    def encode(self, text: Column, max_len: int | None = None, specials: bool = True) -> Column:
        if max_len is not None:
            # the longest token spans four characters, so this cut never reaches a kept token
            text = F.substring(text, 1, len(self.eos) * max_len)
        ids = bind(text, self._ids)
        if self._leading(specials):
            ids = F.concat(F.array(F.lit(self.bos_id)), ids)
        return ids if max_len is None else F.slice(ids, 1, max_len)

    def _ids(self, text: Column) -> Column:
        def char_id(c: Column) -> Column:
            return F.ascii(c) + F.lit(self.shift)

        def piece_id(c: Column) -> Column:
            return F.when(c == self.eos, self.eos_id).when(c == self.bos, self.bos_id).otherwise(char_id(c))

        pieces = F.regexp_extract_all(text, F.lit("(?s)</s>|<s>|."), F.lit(0))
        special = F.contains(text, F.lit(self.eos)) | F.contains(text, F.lit(self.bos))
        return (
            F.when(text == "", F.array().cast(IDS))
            .when(special, F.transform(pieces, piece_id))
            .otherwise(F.transform(F.split(text, ""), char_id))
        )

    def count(self, text: Column, max_len: int | None = None, specials: bool = True) -> Column:
        single = F.replace(F.replace(text, F.lit(self.eos), F.lit("x")), F.lit(self.bos), F.lit("x"))
        n = F.length(single) + F.lit(self._leading(specials))
        return n if max_len is None else F.least(n, F.lit(max_len))

    def decode(self, ids: Column) -> Column:
        chars = F.filter(ids, lambda x: x >= self.shift)
        hexes = F.transform(chars, lambda x: F.lpad(F.hex(x - F.lit(self.shift)), 8, "0"))
        # a leading byte-order mark is consumed by the decoder, so a mark in the text survives
        packed = F.unhex(F.concat(F.lit("0000FEFF"), F.array_join(hexes, "")))
        return F.when(ids.isNotNull(), F.decode(packed, "UTF-32"))


class ModelTokenizer:
    """A tokenizer model behind Arrow-batched functions, loaded once per Python worker.

    ``loader`` returns an object with ``encode(texts, specials) -> list[list[int]]`` and
    ``decode(ids) -> str``. It must be picklable and read its file from a place every
    executor sees (a shared path, or ``SparkFiles`` after ``addFile``).
    """

    prefix_stable = False

    def __init__(
        self,
        loader: Callable[[], object],
        eos: str,
        eos_id: int | None,
        bos_id: int | None = None,
        pad_id: int = 0,
    ):
        self.loader = loader
        self.eos, self.eos_id, self.bos_id, self.pad_id = eos, eos_id, bos_id, pad_id

    def encode(self, text: Column, max_len: int | None = None, specials: bool = True) -> Column:
        load = self.loader

        @F.pandas_udf(IDS)
        def encode_batch(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                known = texts.notna()
                ids = iter(model.encode(texts[known].tolist(), specials))
                yield pd.Series([next(ids)[:max_len] if k else None for k in known], index=texts.index, dtype=object)

        return encode_batch(text)

    def count(self, text: Column, max_len: int | None = None, specials: bool = True) -> Column:
        return F.size(self.encode(text, max_len, specials))

    def decode(self, ids: Column) -> Column:
        load = self.loader

        @F.pandas_udf("string")
        def decode_batch(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for rows in batches:
                yield pd.Series(
                    [None if row is None else model.decode([int(i) for i in row]) for row in rows],
                    index=rows.index,
                    dtype=object,
                )

        return decode_batch(ids)


class SentencePieceLoader:
    """Picklable loader of a sentencepiece model file, with the eos text mapped to its id."""

    def __init__(self, path: str, eos: str = "</s>"):
        self.path, self.eos = path, eos

    def __call__(self) -> "SentencePieceLoader":
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=self.path)
        return self

    def __getstate__(self) -> dict:
        return {"path": self.path, "eos": self.eos}

    def encode(self, texts: list[str], specials: bool = True) -> list[list[int]]:
        out = []
        for text in texts:
            ids = [self.model.bos_id()] if specials and self.model.bos_id() >= 0 else []
            for i, part in enumerate(text.split(self.eos)):
                if i:
                    ids.append(self.model.eos_id())
                ids.extend(self.model.encode(part) if part else [])
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        special = {self.model.bos_id(), self.model.eos_id(), self.model.pad_id()}
        return self.model.decode([i for i in ids if i not in special])


def tokenize(text: Column, tok: Tokenizer, max_len: int | None = None) -> Column:
    return tok.encode(text, max_len)


def token_count(text: Column, tok: Tokenizer, max_len: int | None = None) -> Column:
    return tok.count(text, max_len)


def decode(ids: Column, tok: Tokenizer) -> Column:
    return tok.decode(ids)
