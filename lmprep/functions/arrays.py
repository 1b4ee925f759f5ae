"""Token-array expressions: padding, masks, eos, prompt removal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE = -100  # fixed value: label that the loss skips


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once per row, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _fill(value: Column, count: Column) -> Column:
    return F.array_repeat(value, F.greatest(count.cast("int"), F.lit(0)))


def pad_right(ids: Column, length: Column | int, value: int) -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(ids, _fill(F.lit(value), length - F.size(ids)))


def pad_left(ids: Column, length: Column | int, value: int) -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(_fill(F.lit(value), length - F.size(ids)), ids)


def ones(ids: Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(ids))


def padded_mask(size: Column, length: Column | int, one: Column, zero: Column) -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(_fill(one, size), _fill(zero, length - size))


def append_eos(ids: Column, eos_id: int, max_len: int) -> Column:
    """Add eos only where the (already truncated) row is shorter than ``max_len``."""
    return F.when(F.size(ids) < max_len, F.concat(ids, F.array(F.lit(eos_id)))).otherwise(ids)


def mask_prefix(ids: Column, n: Column) -> Column:
    """Labels of ``ids`` with the first ``n`` set to the ignored value."""
    n = F.least(n.cast("int"), F.size(ids))
    return F.concat(_fill(F.lit(IGNORE), n), F.slice(ids, n + 1, F.greatest(F.size(ids) - n, F.lit(0))))


def strip_prompt_tokens(ids: Column, n: Column | int) -> Column:
    """Drop the first ``n`` ids of a generation."""
    n = F.lit(n) if isinstance(n, int) else n.cast("int")
    return F.slice(ids, n + 1, F.greatest(F.size(ids) - n, F.lit(0)))


def round_up(length: Column, multiple: int) -> Column:
    return (F.ceil(length / F.lit(multiple)) * F.lit(multiple)).cast("int")
