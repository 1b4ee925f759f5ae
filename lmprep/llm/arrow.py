"""Small helpers between Spark's Arrow batches and NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text handled at once inside a task; one longer text is handled alone, whole.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets between them; a null text is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[pa.Array]:
    """Consecutive slices of about ``size`` bytes, at least one text each."""
    if len(texts) == 0:
        return
    _, offsets = text_buffer(texts)
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
        stop = min(len(texts), max(stop, start + 1))
        yield texts.slice(start, stop - start)
        start = stop


def text_list(texts: pa.Array) -> list[str]:
    return texts.fill_null("").to_pylist()


def byte_list(texts: pa.Array) -> list[bytes]:
    return texts.fill_null("").cast(pa.binary() if texts.type == pa.string() else pa.large_binary()).to_pylist()


def struct(columns: dict[str, pa.Array | list | np.ndarray], types: dict[str, pa.DataType]) -> pa.StructArray:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, types[n]) for n, c in columns.items()]
    return pa.StructArray.from_arrays(arrays, names=list(columns))
