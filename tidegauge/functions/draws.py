"""Random draws that are functions of an id and a seed.

The counter is the row's own id, not its place in a partition: a row has the
same draw however the table is cut, sorted or filtered, and when a lost task
is run again. The bits are those of an MD5 digest, which any engine can compute.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hexadecimal digits, and so bits, of a digest behind one uniform draw.
_HEX, _BITS = 13, 52


def _uniforms(ids: Column, seed: int, stream: str) -> tuple[Column, Column]:
    digest = F.md5(F.concat_ws(":", F.lit(stream), F.lit(str(seed)), ids.cast("string")).cast("binary"))

    def uniform(at: int) -> Column:
        bits = F.conv(F.substring(digest, at, _HEX), 16, 10).cast("bigint")
        # The middle of one of 2**52 equal parts of the interval: neither 0 nor 1.
        return F.when(ids.isNotNull(), (bits.cast("double") + 0.5) / float(1 << _BITS))

    return uniform(1), uniform(1 + _HEX)


def uniform_draw(ids: Column, seed: int = 0, stream: str = "uniform") -> Column:
    """Between 0 and 1, neither included. Draws of different streams are independent; a NULL id has none."""
    return _uniforms(ids, seed, stream)[0]


def normal_draw(ids: Column, seed: int = 0, stream: str = "normal") -> Column:
    """Standard normal, by the Box-Muller transform of two uniform draws. A NULL id has none."""
    first, second = _uniforms(ids, seed, stream)
    return F.sqrt(-2.0 * F.log(first)) * F.cos(2.0 * math.pi * second)
