"""Scalar expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b as double, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def last_n(array: Column, n: int) -> Column:
    """The last `n` elements of an array, or all of a shorter one."""
    k = F.least(F.lit(n), F.size(array))
    return F.when(F.size(array) > 0, F.slice(array, F.size(array) - k + 1, k)).otherwise(array)


def uniform_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the first 8 hex digits of md5, the same in any SQL engine."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def rounded_number(x: Column, places: int = 6) -> Column:
    """The same as F.round of a double, which goes through decimal text; only numbers near a tie,
    large or not finite still do."""
    scaled = x * F.lit(10.0**places)
    whole = F.rint(scaled)
    clear = (F.abs(scaled) < 1e12) & (F.abs(F.abs(scaled - whole) - 0.5) > 1e-3)
    return F.when(clear, whole / F.lit(10.0**places) + 0.0).otherwise(F.round(x, places))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """All double columns rounded."""
    return df.select(*[F.round(F.col(f"`{n}`"), places).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])
