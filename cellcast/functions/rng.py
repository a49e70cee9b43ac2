"""Draws that depend only on their keys, never on partitioning or task order.

A lost and re-run task must produce the same numbers, so ``rand()`` is not used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = float(2**52)


def uniform(seed: int | str, *keys: Column, portable: bool = False) -> Column:
    """Uniform draw in [0, 1) from ``seed`` and the row's keys.

    ``portable`` uses md5 of the joined key text, which other SQL engines can repeat;
    the default is the cheaper xxhash64.
    """
    if portable:
        text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
        digits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10)
        return digits.cast("double") / F.lit(_SPAN)
    hashed = F.xxhash64(F.lit(str(seed)), *keys)
    return F.pmod(hashed, F.lit(2**52)).cast("double") / F.lit(_SPAN)


def normal(seed: int | str, *keys: Column, portable: bool = False) -> Column:
    """Standard normal draw (Box-Muller over two independent uniforms)."""
    u1 = uniform(f"{seed}a", *keys, portable=portable)
    u2 = uniform(f"{seed}b", *keys, portable=portable)
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1))
    return radius * F.cos(F.lit(2.0 * math.pi) * u2)


def pick(seed: int | str, size: Column, *keys: Column, portable: bool = False) -> Column:
    """Index in [0, size) drawn with replacement."""
    return F.floor(uniform(seed, *keys, portable=portable) * size).cast("long")
