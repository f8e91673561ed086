"""Seeded hashing and random numbers that depend on the row's keys only.

The values do not depend on partitioning, task retries or row order, so a sample drawn twice, or
again after an executor was lost, is the same sample.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Modulus 2^31 - 1 (prime), a multiplier of full period for it.
PRIME = 2147483647
MULT = 48271


def hash_int(seed: int, *keys) -> Column:
    """Integer in [0, PRIME) from key columns. Whole numbers, also as text, count by value; any other key, fractions
    included, by the CRC-32 of its text; null as -1.

    Every step stays below 2^63 so that ANSI arithmetic never overflows. The closing square breaks
    the linear pattern of consecutive ids; it names the chain only twice, which keeps plans small.
    """
    h = F.lit(int(seed) % PRIME).cast("long")
    for key in keys:
        c = F.col(key) if isinstance(key, str) else key
        whole = c.try_cast("long")
        whole = F.when(whole.cast("double") == c.try_cast("double"), whole)  # fractions are cut by the cast
        number = F.coalesce(whole, F.crc32(c.cast("string").cast("binary")), F.lit(-1).cast("long"))
        h = ((h * 31 + F.pmod(number, F.lit(PRIME).cast("long"))) * MULT + 11) % PRIME
    return (h * (h + 7)) % PRIME


def uniform(seed: int, *keys) -> Column:
    """Uniform in [0, 1)."""
    return hash_int(seed, *keys).cast("double") / F.lit(float(PRIME))


def gaussian(seed: int, *keys) -> Column:
    """Standard normal by Box-Muller. The two hashes differ in their last key only, so generated
    code computes the common part once."""
    u1 = uniform(seed, *keys, F.lit(1))
    u2 = uniform(seed, *keys, F.lit(2))
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
