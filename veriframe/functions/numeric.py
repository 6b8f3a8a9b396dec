"""Numeric and hash functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 97.5 % point of the normal distribution.
Z95 = 1.959963984540054


def hash_unit(key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of md5(key)."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def sha_unit(key: Column) -> Column:
    """A number in [0, 1) from the first 64 bits of sha256(key)."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(18446744073709551616.0)


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def pair_softmax(first: Column, second: Column) -> Column:
    """Share of the first of two logits; others are left out."""
    return 1 / (1 + F.exp(second - first))


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers; 0 for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """95 % interval of a share."""
    p = k / n
    middle = p + Z95 * Z95 / (2 * n)
    half = Z95 * F.sqrt(p * (1 - p) / n + Z95 * Z95 / (4 * n * n))
    whole = 1 + Z95 * Z95 / n
    return F.greatest((middle - half) / whole, F.lit(0.0)), F.least((middle + half) / whole, F.lit(1.0))


def unit_grid(steps: int = 100) -> Column:
    """0, 0.01, ... as multiples, and 1 itself."""
    return F.concat(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: i * F.lit(1.0 / steps)), F.array(F.lit(1.0)))


def case_id(dialog: Column, answer: Column, prefix: str = "case_") -> Column:
    """A content id from the raw fields."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat(dialog, F.char(F.lit(0)), answer)), 1, 12))


def two_sided_binomial(b: Column, c: Column) -> Column:
    """Exact two-sided p of b against c at one half; 1 where both are 0.

    The largest term of the tail is by logarithms: below 16 as a product, else by Stirling's series, of which what is left
    out is under 1e-13. The others follow as ratios, from there down; those further than six roots of n and 60
    are under e^-72 of it together, less than the last digit of the sum."""
    n, k = (b + c).cast("double"), F.least(b, c).cast("double")
    up_to = lambda m: F.when(m >= 1, F.sequence(F.lit(1).cast("bigint"), F.greatest(m, F.lit(1)).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    some = lambda m: F.greatest(m, F.lit(1.0))
    series = lambda m: 1 / (12 * some(m)) - 1 / (360 * some(m) ** 3) + 1 / (1260 * some(m) ** 5) - 1 / (1680 * some(m) ** 7)
    few = F.aggregate(up_to(F.least(k, F.lit(16.0))), F.lit(0.0), lambda s, j: s + F.log((n - j + 1) / j)) - n * F.log(F.lit(2.0))
    far = n - k
    many = -k * F.log(2 * some(k) / some(n)) - far * F.log(2 * some(far) / some(n)) + 0.5 * F.log(some(n) / (2 * F.pi() * some(k) * some(far))) + series(n) - series(k) - series(far)
    none = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(s: Column, j: Column) -> Column:
        term = s["term"] * (k - j + 1) / (far + j)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    ratios = F.aggregate(up_to(F.least(k, F.floor(6 * F.sqrt(n)) + 60)), none, add, lambda s: s["sum"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.exp(F.when(k < 16, few).otherwise(many)) * ratios))
