"""Keyed hashing in place of random numbers: every draw depends on a key and a salt only.

The ``md5`` forms have an exact twin in ANSI SQL (see :mod:`weftline.plans.dialect`); the
``xxhash64`` forms are cheaper and serve operators that need no SQL twin.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_key(key: Column | str, salt: str) -> Column:
    """32 hex digits of ``key|salt``."""
    col = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(col.cast("string"), F.lit(f"|{salt}")))


def md5_int(key: Column | str, salt: str) -> Column:
    """A whole number in [0, 2^32) from ``key`` and ``salt``."""
    return F.conv(F.substring(md5_key(key, salt), 1, 8), 16, 10).cast("bigint")


def md5_unit(key: Column | str, salt: str) -> Column:
    """A number in [0, 1)."""
    return md5_int(key, salt) / F.lit(4294967296.0)


def md5_below(key: Column | str, salt: str, n: Column | int) -> Column:
    """A whole number in [0, n)."""
    return F.pmod(md5_int(key, salt), n if isinstance(n, Column) else F.lit(n))


def choose(options: Column, key: Column | str, salt: str) -> Column:
    """One element of an array; null for an empty array."""
    n = F.size(options)
    return F.when(n > 0, F.get(options, md5_below(key, salt, F.greatest(n, F.lit(1))).cast("int")))


def fast_unit(*cols: Column | str, salt: int = 0) -> Column:
    """A number in [0, 1) from ``xxhash64``."""
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit(salt)), 11) / F.lit(float(1 << 53))
