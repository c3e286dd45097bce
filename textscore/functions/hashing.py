"""Seeded, reproducible row keys.

Every random choice of the library is made by hashing a row key together with
a seed, never by ``rand()``: a task that is run again after a lost executor
then makes the same choice, and the choice can be repeated in another engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE_BITS = 32


def hash_key(id_col: Column, seed: int | str) -> Column:
    """Hexadecimal md5 of ``id-seed``; sorting by it shuffles the rows."""
    return F.md5(F.concat(id_col.cast("string"), F.lit(f"-{seed}")))


def key_to_int(key: Column) -> Column:
    """First 32 bits of a hash key as a long in ``[0, 2**32)``."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")


def hash_int(id_col: Column, seed: int | str) -> Column:
    return key_to_int(hash_key(id_col, seed))
