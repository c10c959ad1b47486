"""Deterministic noise: the same key always draws the same number.

A retried task or a second action over the same plan sees identical values,
which a random generator cannot promise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX_DIGITS = 13  # 52 bits, the mantissa of a double


def uniform_pair(key: Column, salt: str) -> tuple[Column, Column]:
    """Two independent draws from [0, 1), taken from one digest of key and salt."""
    digest = F.md5(F.concat_ws("|", key, F.lit(salt)))

    def draw(start: int) -> Column:
        bits = F.conv(F.substring(digest, start, _HEX_DIGITS), 16, 10)
        return bits.cast("bigint") / F.lit(float(2**52))

    return draw(1), draw(1 + _HEX_DIGITS)


def centred(draw: Column, scale: float) -> Column:
    """Map a draw from [0, 1) to [-scale, scale)."""
    return (draw - 0.5) * 2 * scale
