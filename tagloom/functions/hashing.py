"""Engine-independent pseudo-random columns built on md5.

The same text hashes to the same value in every engine and on every retry of a task, so a sample drawn
with these functions survives lost executors and can be checked from plain SQL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.bind import let

TWO_32 = 4294967296.0


def _c(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def hash_key(seed, *parts) -> Column:
    """32 hex digits of ``md5('seed:part:part')``; sorting by it is a seeded shuffle."""
    return F.md5(F.concat_ws(":", _c(seed).cast("string"), *[_c(p).cast("string") for p in parts]))


def _hex_unit(hex8: Column) -> Column:
    return F.conv(hex8, 16, 10).cast("bigint") / F.lit(TWO_32)


def hash_uniform(*parts) -> Column:
    """Uniform double in [0, 1) from the first 32 bits of the md5 of ``part:part``."""
    return _hex_unit(F.substring(F.md5(F.concat_ws(":", *[_c(p).cast("string") for p in parts])), 1, 8))


def hash_normal(*parts) -> Column:
    """Standard normal double: Box-Muller over two 32-bit words of one md5."""
    digest = F.md5(F.concat_ws(":", *[_c(p).cast("string") for p in parts]))
    first = lambda d: (F.conv(F.substring(d, 1, 8), 16, 10).cast("bigint") + 1) / F.lit(TWO_32)
    second = lambda d: _hex_unit(F.substring(d, 9, 8))
    return let(lambda v: F.sqrt(F.lit(-2.0) * F.ln(first(v["d"]))) * F.cos(F.lit(2.0 * math.pi) * second(v["d"])), d=digest)
