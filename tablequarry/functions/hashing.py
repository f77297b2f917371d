"""Hashes, permutations and sketches that other SQL engines can repeat."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A Mersenne prime: a * h + b stays below 2**62 for a, b, h below it.
PRIME = 2**31 - 1


def hash32(c: Column) -> Column:
    """The first 32 bits of MD5, as a number."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long")


def permutations(n: int, seed: int = 1) -> list[tuple[int, int]]:
    r = random.Random(seed)
    return [(r.randrange(1, PRIME), r.randrange(PRIME)) for _ in range(n)]


def sign_bits(vector: Column, planes: list[list[float]]) -> Column:
    """A string of 0 and 1: on which side of each plane the vector lies."""
    dot = lambda p: F.aggregate(F.zip_with(vector, F.array(*map(F.lit, p)), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return F.concat(*(F.when(dot(p) >= 0, "1").otherwise("0") for p in planes))


def planes(n: int, dim: int, seed: int = 7) -> list[list[float]]:
    r = random.Random(seed)
    return [[round(r.gauss(0, 1), 6) for _ in range(dim)] for _ in range(n)]
