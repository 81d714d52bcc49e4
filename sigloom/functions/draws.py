"""Keyed random draws: a number depends on seed, operation, key and draw number alone, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, op: str, key: Column, n: Column | int = 0) -> Column:
    """In [0, 1): the first 52 bits of an MD5 digest of seed#op#key#n, so it tells apart more rows than any table has."""
    n = F.lit(n) if isinstance(n, int) else n
    text = F.concat_ws("#", F.lit(str(seed)), F.lit(op), key.cast("string"), n.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / 4503599627370496.0


def between(seed: int, op: str, key: Column, low: float, high: float, n: Column | int = 0) -> Column:
    return low + (high - low) * uniform(seed, op, key, n)


def normal(seed: int, op: str, key: Column) -> Column:
    """Standard normal by Box and Muller from two draws, the first kept off zero."""
    u = (uniform(seed, op, key, 0) * 4503599627370496.0 + 1) / 4503599627370497.0
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * uniform(seed, op, key, 1))


def beta(seed: int, op: str, key: Column, alpha: float, tries: int = 32) -> Column:
    """Beta(alpha, alpha) by Johnk: the first of ``tries`` candidate pairs whose powers sum to 1 at most; else 0.5."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda i: F.struct(F.pow(uniform(seed, op + ":a", key, i), F.lit(1 / alpha)).alias("a"), F.pow(uniform(seed, op + ":b", key, i), F.lit(1 / alpha)).alias("b")))
    good = F.filter(pairs, lambda p: (p["a"] + p["b"] <= 1) & (p["a"] + p["b"] > 0))
    return F.coalesce(F.get(F.transform(good, lambda p: p["a"] / (p["a"] + p["b"])), F.lit(0)), F.lit(0.5))


def uniform_sql(seed: int, op: str, key: str, n: str = "0") -> str:
    """The same draw in DuckDB SQL."""
    return f"(CAST(('0x' || substr(md5(concat_ws('#', '{seed}', '{op}', CAST({key} AS VARCHAR), CAST({n} AS VARCHAR))), 1, 13)) AS BIGINT) / 4503599627370496.0)"


def normal_sql(seed: int, op: str, key: str) -> str:
    u = f"(({uniform_sql(seed, op, key)} * 4503599627370496.0 + 1) / 4503599627370497.0)"
    return f"(sqrt(-2 * ln({u})) * cos(2 * pi() * {uniform_sql(seed, op, key, '1')}))"
