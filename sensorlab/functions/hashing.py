"""Arithmetic hashes that other SQL engines can repeat exactly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Multiplier and increment of a common linear congruential
# generator, the Mersenne prime it is reduced by, and Knuth's 32-bit multiplier.
LCG_A, LCG_C, LCG_M = 1103515245, 12345, 2**31
MERSENNE = 2**31 - 1
KNUTH = 2654435761
HASH_RANGE = 2**32


def unit_hash(key: Column, seed: int = 0) -> Column:
    """Map a 64-bit integer key to an integer in [0, 2^32) without overflow.

    Keys below 2^31 give ``key * KNUTH mod 2^32``; the upper bits of larger
    keys are mixed in as a second term.
    """
    key = key.cast("bigint") + F.lit(seed).cast("bigint")
    low = F.pmod(F.pmod(key, F.lit(LCG_M)) * F.lit(KNUTH), F.lit(HASH_RANGE))
    high = F.pmod(F.pmod(F.shiftright(key, 31), F.lit(LCG_M)) * F.lit(LCG_A), F.lit(HASH_RANGE))
    return F.pmod(low + high, F.lit(HASH_RANGE))


def lattice(k: np.ndarray) -> np.ndarray:
    """Uniform-like numbers in [0, 1) from integers, by 64-bit integer arithmetic only."""
    a = (LCG_A * k.astype(np.int64) + LCG_C) % LCG_M
    return ((a * a) % MERSENNE) / float(MERSENNE)
