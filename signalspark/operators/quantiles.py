"""Exact quantiles of groups of any size.

Mergeable sketches give a bracket around each quantile.  A second pass counts what lies
below a bracket and keeps the distinct values within it; running counts over range
partitions then find the exact places.  No task holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .slabs import carried, ranged

#: Size of a sketch, and half the width of a bracket in ranks: three times the sketch's
#: error at 99 % confidence.
SKETCH, HALF = 800, 0.012


def _brackets(sketches: DataFrame, qs: tuple[float, ...], half: float) -> DataFrame:
    """Arrays lo and hi with the bracket of each quantile; null is no bound."""
    at = lambda rank: F.lit(None).cast("double") if not 0 < rank < 1 else F.kll_sketch_get_quantile_double("sketch", F.lit(rank))
    return sketches.withColumns({"lo": F.array(*[at(q - half) for q in qs]), "hi": F.array(*[at(q + half) for q in qs])}).drop("sketch")


def _picked(rows: DataFrame, keys: list[str], brackets: DataFrame, qs: tuple[float, ...]) -> DataFrame:
    """keys, n, and q0, q1, ...; null where a bracket missed its quantile."""
    same = [F.col(f"r.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys]
    both = rows.alias("r").join(brackets.alias("b"), same).select(*[F.col(f"r.`{k}`") for k in keys], "x", "n", "lo", "hi")
    below = lambda i: F.coalesce(F.col("x") < F.col("lo")[i], F.lit(False))
    above = lambda i: F.coalesce(F.col("x") > F.col("hi")[i], F.lit(False))
    counts = both.groupBy(*keys).agg(F.first("n").alias("n"), F.array(*[F.count_if(below(i)) for i in range(len(qs))]).alias("below"))
    inside = F.array_compact(F.array(*[F.when(~below(i) & ~above(i), F.lit(i)) for i in range(len(qs))]))
    kept = both.select(*keys, "x", F.explode(inside).alias("i")).groupBy(*keys, "i", "x").agg(F.count(F.lit(1)).alias("c"))
    own = lambda w: F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))
    running = carried(ranged(kept, *keys, "i", "x"), [*keys, "i"], ["x"], {"upto": (own, F.sum("c"), lambda w: F.sum("upto").over(w), lambda a, b: a + F.coalesce(b, F.lit(0)))})
    same = [F.col(f"k.`{k}`").eqNullSafe(F.col(f"c.`{k}`")) for k in keys]
    placed = running.alias("k").join(counts.alias("c"), same).select(*[F.col(f"c.`{k}`") for k in keys], "i", "x", "n", (F.col("below")[F.col("i")] + F.col("upto")).alias("end"), "c.below", F.col("k.c").alias("times"))
    place = F.array(*[F.lit(q) for q in qs])[F.col("i")] * (F.col("n") - 1)
    holds = lambda p: (F.col("end") - F.col("times") <= p) & (p < F.col("end"))
    low, high = F.floor(place), F.ceil(place)
    ends = placed.groupBy(*keys, "i").agg(F.max(F.when(holds(low), F.col("x"))).alias("a"), F.max(F.when(holds(high), F.col("x"))).alias("b"), F.first(place).alias("place"))
    share = F.col("place") - F.floor("place")
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - share) * F.col("a") + share * F.col("b"))
    return ends.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, value)).alias(f"q{i}") for i in range(len(qs))])


def exact_quantiles(df: DataFrame, keys: list[str], value: str | Column, qs: tuple[float, ...]) -> DataFrame:
    """keys and q0, q1, ...: the quantiles `qs` of each group, by linear interpolation between
    neighbours; groups without a value are left out, nulls do not count, and
    not-a-numbers are larger than all else.  A written table."""
    rows = df.select(*keys, (F.col(value) if isinstance(value, str) else value).cast("double").alias("x")).where("x is not null")
    sketches = rows.groupBy(*keys).agg(F.kll_sketch_agg_double("x", F.lit(SKETCH)).alias("sketch"), F.count(F.lit(1)).alias("n"))
    # A sketch leaves not-a-numbers out; of these alone it has no quantile.
    usable = F.kll_sketch_get_n_double("sketch") == F.col("n")
    sketches = materialize(sketches.select(*keys, "n", F.when(usable, F.col("sketch")).alias("sketch")), "quantile-sketches")
    found = materialize(_picked(rows, keys, _brackets(sketches, qs, HALF), qs), "quantiles")
    missed = found.where(" or ".join(f"q{i} is null" for i in range(len(qs))))
    if missed.isEmpty():
        return found
    # Once in a long while a bracket misses: these groups keep all their values.
    same = [F.col(f"s.`{k}`").eqNullSafe(F.col(f"m.`{k}`")) for k in keys]
    again = sketches.alias("s").join(missed.select(*keys).alias("m"), same, "left_semi")
    whole = found.alias("s").join(missed.select(*keys).alias("m"), same, "left_anti")
    return materialize(whole.unionByName(_picked(rows, keys, _brackets(again, qs, 2.0), qs)), "quantiles")
