"""Ordered scans of a key cut by time or position, so that a hot key is many tasks' work.

Trailing windows need only the rows shortly before: rows are dealt into slabs of time, and
those close enough to a slab's end are also copied, as its halo, into the next slab.  Windows
that plain aggregates describe (`windowed`) are an end of one slab and a start of the next.  Scans
without a bound take a summary of all earlier parts: rows are range-partitioned, each part
scans its own rows, and one row for each part and key carries the rest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize

#: Length of a slab as a multiple of the longest window: an eighth of the rows is copied.
SLAB_WINDOWS = 8


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a time, whatever the session's zone does to the clock."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts) if isinstance(ts, str) else ts)


def with_halo(df: DataFrame, ts: str, reach: int | Column, *, windows: int = SLAB_WINDOWS) -> DataFrame:
    """The rows of `df` with `slab` and `halo`: each stands in its own slab, and, with halo
    true, in the next one if it lies within `reach` microseconds of its start."""
    reach = F.lit(reach).cast("long")
    length = reach * F.lit(windows)
    at = micros(ts)
    own = F.floor(at / length).cast("long")
    near = (own + 1) * length - at <= reach
    slabs = F.when(near, F.array(own, own + 1)).otherwise(F.array(own))
    # A null time has a slab of its own, like the window it would have without slabs.
    rows = df.select("*", F.explode(F.coalesce(slabs, F.array(F.lit(None).cast("long")))).alias("slab"))
    return rows.withColumn("halo", F.coalesce(F.col("slab") != own, F.lit(False)))


def windowed(df: DataFrame, keys: list[str], ts: str, reach: int, values: dict[str, tuple[Callable[[Column], Column], Column, Callable[[Column, Column], Column]]], *, offset: int = 0) -> DataFrame:
    """Add for each name of `values` an aggregate over a key's rows from `reach` to `offset`
    microseconds ago, peers included: (fn, value, merge), where merge puts together the
    aggregates of two sets of rows, neither null.  Of no rows it is null.

    Slabs are as long as the window, which is so the end of one slab and the start of the
    next: two running aggregates, each row looked at once, nothing subtracted.  Rows of a
    null time are each other's window.
    """
    length = F.lit(reach - offset)
    names, own = list(values), F.col("__row.__at")
    start = Window.unboundedPreceding, Window.currentRow
    row = df.select(F.struct(*df.columns, micros(ts).alias("__at"), *[x.alias(f"__x{i}") for i, (_, x, _) in enumerate(values.values())]).alias("__row"))

    def running(rows: DataFrame, ago: int, backwards: bool, kept: list[str]) -> DataFrame:
        """`rows` with the aggregates from `ago` on to the end (or from the start) of the slab there."""
        at = F.struct(own.alias("at"), F.lit(False).alias("asks"))
        there = F.struct((own - F.lit(ago)).alias("at"), F.lit(True).alias("asks"))
        if ago:  # a row stands at its own time as a value, and at the other one as a question
            rows = rows.select(*kept, "__row", F.explode(F.array(at, there)).alias("__p"))
            value = lambda i: F.when(~F.col("__p.asks"), F.col(f"__row.__x{i}"))
        else:
            rows = rows.select(*kept, "__row", at.alias("__p"))
            value = lambda i: F.col(f"__row.__x{i}")
        rows = rows.select(
            *[F.when(F.col("__p.asks") | F.lit(not ago), F.col(c)).alias(c) for c in (*kept, "__row")], F.col("__p.asks").alias("__asks"), F.col("__p.at").alias("__t"),
            *[F.col(f"__row.`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], F.floor(F.col("__p.at") / length).cast("long").alias("slab"), *[value(i).alias(f"__v{i}") for i in range(len(names))],
        )
        order = Window.partitionBy(*[f"__k{i}" for i in range(len(keys))], "slab").orderBy(F.desc("__t") if backwards else F.asc("__t")).rangeBetween(*start)
        side = "end" if backwards else "start"
        rows = rows.select(*kept, "__row", "__asks", *[fn(F.col(f"__v{i}")).over(order).alias(f"__{side}{i}") for i, (fn, _, _) in enumerate(values.values())])
        return (rows.where("__asks") if ago else rows).drop("__asks")

    ends = running(row, reach, True, [])
    both = running(ends, offset, False, [f"__end{i}" for i in range(len(names))])
    merged = []
    for i, (name, (_, _, merge)) in enumerate(values.items()):
        a, b = F.col(f"__end{i}"), F.col(f"__start{i}")
        merged.append(F.when(own.isNull() | b.isNull(), a).when(a.isNull(), b).otherwise(merge(a, b)).alias(name))
    return both.select(*[F.col(f"__row.`{c}`").alias(c) for c in df.columns], *merged)


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """`df` with __part, range-partitioned by `order` and written once (bounds are sampled)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranged")


def carried(
    rows: DataFrame, keys: list[str], order: list[str], scans: dict[str, tuple[Callable[[Window], Column], Column, Callable[[Window], Column], Callable[[Column, Column], Column]]]
) -> DataFrame:
    """Add a running value for each name of `scans` to `rows` of `ranged(df, *keys, *order)`.

    A scan is (own, whole, before, merge): its value over the window of a part's own rows,
    its value over a whole part (an aggregate), the value over the parts before (from the
    aggregate's column, named alike, over a window of parts), and how both are put together.
    """
    own = Window.partitionBy("__part", *keys).orderBy(*order)
    # One row for each part and key.
    parts = rows.groupBy("__part", *keys).agg(*[whole.alias(name) for name, (_, whole, _, _) in scans.items()])
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__part", *keys, *[before(earlier).alias(f"__before_{name}") for name, (_, _, before, _) in scans.items()])
    known = rows.select("*", *[f(own).alias(f"__own_{name}") for name, (f, _, _, _) in scans.items()])
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("__part", *keys)]
    both = known.alias("l").join(parts.alias("r"), same, "left")
    merged = [merge(F.col(f"l.__own_{name}"), F.col(f"r.__before_{name}")).alias(name) for name, (_, _, _, merge) in scans.items()]
    return both.select(*[F.col(f"l.`{c}`") for c in rows.columns if c != "__part"], *merged)


def reset_steps(points: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """Add step: the growth of a counter since the last point of its key, in order of time and
    value; a fall is a reset and counts from 0, the first point counts 0.

    Range-partitioned: the last value of a key's earlier parts is carried over.
    """
    rows = ranged(points.withColumn("__value", F.col(value)), *keys, ts, "__value")
    newest = F.max_by(value, F.struct(ts, "__value"))
    scan = lambda w: F.lag(value).over(w)
    found = carried(rows, keys, [ts, "__value"], {"__last": (scan, newest, lambda w: F.last("__last", ignorenulls=True).over(w), F.coalesce)})
    step = F.when(F.col("__last").isNull(), F.lit(0)).when(F.col(value) < F.col("__last"), F.col(value)).otherwise(F.col(value) - F.col("__last"))
    return found.withColumn("step", step).drop("__last", "__value")
