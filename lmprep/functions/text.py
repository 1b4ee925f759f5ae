"""String expressions: Unicode strip, prediction clean-up, seeded hashing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 code points that Python's str.strip() removes.
PY_WHITESPACE = "".join(
    map(
        chr,
        [
            *range(0x0009, 0x000E),
            *range(0x001C, 0x0021),
            0x0085,
            0x00A0,
            0x1680,
            *range(0x2000, 0x200B),
            0x2028,
            0x2029,
            0x202F,
            0x205F,
            0x3000,
        ],
    )
)

# The line boundaries of Python's str.splitlines().
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def py_strip(text: Column) -> Column:
    return F.btrim(text, F.lit(PY_WHITESPACE))


def normalize_prediction(text: Column) -> Column:
    """Strip every line and join the lines with single spaces."""
    lines = F.split(text, LINE_BREAKS)
    return py_strip(F.array_join(F.transform(lines, py_strip), " "))


def has_line_break(text: Column) -> Column:
    return F.contains(text, F.lit("\n"))


def seeded_hex(seed: int, *keys: Column) -> Column:
    """Eight hex digits drawn from (seed, keys): uniform, and free of partition layout."""
    parts = [F.lit(str(seed)), *(k.cast("string") for k in keys)]
    return F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8)


def seeded_order(seed: int, *keys: Column) -> Column:
    """Full-width seeded sort key."""
    parts = [F.lit(str(seed)), *(k.cast("string") for k in keys)]
    return F.md5(F.concat_ws(":", *parts))


def seeded_uniform(seed: int, *keys: Column) -> Column:
    """Uniform double in [0, 1)."""
    return F.conv(seeded_hex(seed, *keys), 16, 10).cast("long") / F.lit(2.0**32)


def hex_bounds(probabilities: Sequence[float]) -> list[str]:
    """Upper bounds of the cumulative probabilities, comparable with :func:`seeded_hex`.

    The last bound sorts after every hex string, so rounding never loses a draw.
    """
    total, bounds = 0.0, []
    for p in probabilities[:-1]:
        total += p
        bounds.append(format(min(round(total * 2**32), 2**32 - 1), "08x"))
    return [*bounds, "g"]


def hash_shard(key: Column, shards: int) -> Column:
    """Even split of rows by key, the same on every cluster layout."""
    if shards == 1:
        return F.lit(0)
    digits = F.substring(F.md5(key.cast("string")), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(shards)).cast("int")
