"""Randomness as a function of the row key.

``rand(seed)`` depends on partition and row order, so a retried task may see other values. These
expressions depend on the key only: the same row gets the same value on any layout.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS = 52
HASH_RANGE = 2**_BITS


def key_md5(key: str, seed: int | str) -> Column:
    """Hex digest that orders rows in a reproducible random order."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))


def key_bits(key: str, seed: int | str) -> Column:
    """The first 52 bits of :func:`key_md5` as a long; orders like the digest."""
    return F.conv(F.substring(key_md5(key, seed), 1, _BITS // 4), 16, 10).cast("long")


def uniform(key: str, seed: int | str) -> Column:
    """Uniform draw in the open interval (0, 1)."""
    return (key_bits(key, seed).cast("double") + F.lit(0.5)) / F.lit(float(HASH_RANGE))


def normal(key: str, seed: int | str) -> Column:
    """Standard normal draw (Box-Muller on two uniform draws)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(key, f"{seed}r")))
    return radius * F.cos(F.lit(2 * math.pi) * uniform(key, f"{seed}a"))


def integer_jitter(key: str, seed: int) -> Column:
    """Integer in [-6, 5] from one step of a linear congruential generator on the key."""
    # Fixed values of the generator: multiplier 1103515245, increment 12345, modulus 2**31.
    modulus = F.lit(2147483648)
    k = F.col(key).cast("long")
    state = (F.pmod(k, modulus) * F.lit(1103515245) + F.lit(12345 + seed)) % modulus
    return (F.floor(state / F.lit(65536)) % F.lit(12) - F.lit(6)).cast("int")
