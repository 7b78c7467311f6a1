"""Alert rules as expressions over raw metric points (I6).

A rule compares an expression with another at every tick of an evaluation grid.  Leaves of
an expression are the last value, rate or increase of a metric's series; arithmetic joins
series with the same labels; averages, sums and histogram quantiles merge series.  All
leaves of all rules come from one table of the points of each tick, computed once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .slabs import micros

COMPARISONS = {
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}
_ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: F.try_divide(a, b)}
#: Seconds for which a series keeps its last value.
STALE = 300
#: Ticks of a slab when runs of ticks are found.
_RUN_SLAB = 4096


def compare(op: str, left: Column, right: Column) -> Column:
    try:
        return COMPARISONS[op](left, right)
    except KeyError:
        raise ValueError(f"unknown comparison: {op}") from None


def compared(op: Column, left: Column, right: Column) -> Column:
    """`left op right` with the operator from a column; an unknown one is an error."""
    chain = reduce(lambda c, name: c.when(op == name, COMPARISONS[name](left, right)), COMPARISONS, F.when(op.isNull(), F.lit(None).cast("boolean")))
    return chain.otherwise(F.raise_error(F.concat(F.lit("unknown comparison: "), op)).cast("boolean"))


class Node:
    """An expression; + - * / build larger ones, with numbers too."""

    def _with(self, op: str, other: Node | float, swap: bool = False) -> Node:
        other = other if isinstance(other, Node) else Number(float(other))
        return Arithmetic(op, other, self) if swap else Arithmetic(op, self, other)

    def __add__(self, other):
        return self._with("+", other)

    def __radd__(self, other):
        return self._with("+", other, True)

    def __sub__(self, other):
        return self._with("-", other)

    def __rsub__(self, other):
        return self._with("-", other, True)

    def __mul__(self, other):
        return self._with("*", other)

    def __rmul__(self, other):
        return self._with("*", other, True)

    def __truediv__(self, other):
        return self._with("/", other)

    def __rtruediv__(self, other):
        return self._with("/", other, True)


@dataclass(frozen=True)
class Number(Node):
    value: float


@dataclass(frozen=True)
class Series(Node):
    """Of a metric's series whose labels equal `labels` (or match a pattern of `like`): the
    last value (`fn` last), or increase or rate over `seconds` that ended `offset` seconds ago."""

    metric: str
    fn: str = "last"
    seconds: int = STALE
    offset: int = 0
    labels: tuple[tuple[str, str], ...] = ()
    like: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Merge(Node):
    """`fn` (avg or sum) of all series with the same labels `by`."""

    fn: str
    of: Node
    by: tuple[str, ...] = ()


@dataclass(frozen=True)
class Quantile(Node):
    """Quantile of histogram buckets (label le, cumulative), interpolated inside its bucket."""

    q: float
    of: Node


@dataclass(frozen=True)
class Arithmetic(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Rule:
    """`expr op limit` at every tick for `hold` seconds raises an alert."""

    name: str
    expr: Node
    op: str
    limit: Node | float
    hold: int
    severity: str
    group: str = field(default="")


def rate(metric: str, seconds: int, *, offset: int = 0, like: dict[str, str] | None = None, **labels: str) -> Series:
    return Series(metric, "rate", seconds, offset, tuple(labels.items()), tuple((like or {}).items()))


def increase(metric: str, seconds: int, **labels: str) -> Series:
    return Series(metric, "increase", seconds, 0, tuple(labels.items()))


def last(metric: str, **labels: str) -> Series:
    return Series(metric, labels=tuple(labels.items()))


def _leaves(node: Node | float) -> list[Series]:
    if isinstance(node, Series):
        return [node]
    if isinstance(node, Arithmetic):
        return _leaves(node.left) + _leaves(node.right)
    return _leaves(node.of) if isinstance(node, (Merge, Quantile)) else []


def _spans(leaves: Sequence[Series], step: int) -> list[tuple[str, int, int]]:
    """Distinct (kind, seconds, offset) of the leaves; increase and rate share one."""
    for x in leaves:
        if x.fn not in ("last", "rate", "increase"):
            raise ValueError(f"unknown function of a series: {x.fn}")
        if x.seconds % step or x.offset % step:
            raise ValueError(f"windows and offsets are multiples of the step of {step} seconds")
    return sorted({("last" if x.fn == "last" else "increase", x.seconds, x.offset) for x in leaves})


def _grown(counters: DataFrame) -> DataFrame:
    """metric, labels, tick, value: the growth of each counter over the points of a tick (`slab`).

    A fall is a reset and counts from 0.  A tick's points are looked at together, and its first
    one then meets the last of the tick before, so that all points are shuffled once.
    """
    series = ["metric", "labels"]
    own = Window.partitionBy(*series, "slab").orderBy("ts", "value")
    growth = lambda last: F.when(F.col("value") < last, F.col("value")).otherwise(F.col("value") - last)
    steps = counters.withColumn("step", growth(F.lag("value").over(own)))
    at = F.struct("ts", "value")
    ticks = steps.groupBy(*series, "slab").agg(F.sum("step").alias("inside"), F.min(at)["value"].alias("value"), F.max(at)["value"].alias("newest"))
    # One row for each series and tick that has points.
    last = F.lag("newest").over(Window.partitionBy(*series).orderBy("slab"))
    first = F.when(last.isNull(), F.lit(0.0)).otherwise(growth(last))
    return ticks.select(*series, F.col("slab").alias("tick"), (F.coalesce("inside", F.lit(0.0)) + first).alias("value"))


def series_values(points: DataFrame, leaves: Sequence[Series], *, step: int = 60) -> DataFrame:
    """(kind, seconds, offset, metric, labels, tick, value) of every series that the leaves
    read, at every tick whose window holds a point.  A written table.

    `points`: ts, metric, labels (map<string,string>), value.  The points of a tick are
    summed up first; a sum then counts in all ticks whose window it falls into.
    """
    kinds: dict[str, set[str]] = {}
    for x in leaves:
        kinds.setdefault("last" if x.fn == "last" else "increase", set()).add(x.metric)
    names = sorted(set().union(*kinds.values()))
    rows = points.where(F.col("metric").isin(names) & F.col("value").isNotNull() & F.col("ts").isNotNull())
    # A map is no key: its entries in order are.
    rows = rows.select("ts", "metric", F.sort_array(F.map_entries(F.coalesce("labels", F.create_map().cast("map<string,string>")))).alias("labels"), F.col("value").cast("double").alias("value"))
    tick = F.ceil(micros("ts") / F.lit(step * 1_000_000)).cast("long").alias("tick")
    counters = rows.where(F.col("metric").isin(sorted(kinds.get("increase", ())))).withColumn("slab", tick)
    grown = _grown(counters).withColumn("kind", F.lit("increase"))
    gauges = rows.where(F.col("metric").isin(sorted(kinds.get("last", ()))))
    newest = gauges.groupBy("metric", "labels", tick).agg(F.max_by("value", F.struct("ts", "value")).alias("value")).withColumn("kind", F.lit("last"))
    held = grown.unionByName(newest)
    spans = _spans(leaves, step)
    parts = []
    for kind, seconds, offset in spans:
        users = sorted({x.metric for x in leaves if ("last" if x.fn == "last" else "increase", x.seconds, x.offset) == (kind, seconds, offset)})
        ticks = F.sequence(F.col("tick") + offset // step, F.col("tick") + (offset + seconds) // step - 1)
        parts.append(F.when((F.col("kind") == kind) & F.col("metric").isin(users), F.struct(F.lit(seconds).alias("seconds"), F.lit(offset).alias("offset"), ticks.alias("ticks"))))
    spread = held.select("kind", "metric", "labels", F.col("tick").alias("at"), "value", F.explode(F.array_compact(F.array(*parts))).alias("s"))
    spread = spread.select("kind", "s.seconds", "s.offset", "metric", "labels", "at", "value", F.explode("s.ticks").alias("tick"))
    value = F.when(F.col("kind") == "last", F.max_by("value", "at")).otherwise(F.sum("value")).alias("value")
    return materialize(spread.groupBy("kind", "seconds", "offset", "metric", "labels", "tick").agg(value), "series-values")


def _atoms(node: Node | float) -> list[Node]:
    """The series, merges and quantiles that arithmetic puts together."""
    if isinstance(node, Arithmetic):
        return _atoms(node.left) + _atoms(node.right)
    return [node] if isinstance(node, (Series, Merge, Quantile)) else []


def _label(name: str) -> Column:
    return F.coalesce(F.try_element_at(F.map_from_entries("labels"), F.lit(name)), F.lit(""))


def _series_rows(values: DataFrame, series: dict[Series, int]) -> DataFrame:
    """(no, labels, tick, value): the rows of the table that each series reads, in one scan."""
    found = []
    for x, no in series.items():
        fits = (F.col("kind") == ("last" if x.fn == "last" else "increase")) & (F.col("seconds") == x.seconds) & (F.col("offset") == x.offset) & (F.col("metric") == x.metric)
        for name, value in x.labels:
            fits = fits & (_label(name) == value)
        for name, pattern in x.like:
            fits = fits & _label(name).rlike(f"^(?:{pattern})$")
        found.append(F.when(fits, F.struct(F.lit(no).alias("no"), (F.col("value") / (x.seconds if x.fn == "rate" else 1)).alias("value"))))
    return values.select("labels", "tick", F.explode(F.array_compact(F.array(*found))).alias("s")).select("s.no", "labels", "tick", "s.value")


def _chosen(labels: dict[int, Column]) -> Column:
    """The labels of a row by its number."""
    return F.coalesce(*[F.when(F.col("no") == no, c) for no, c in labels.items()])


def _merge_rows(rows: DataFrame, merges: dict[int, Merge]) -> DataFrame:
    if any(m.fn not in ("avg", "sum") for m in merges.values()):
        raise ValueError(f"unknown merge of series: {[m.fn for m in merges.values()]}")
    by = lambda names: F.filter("labels", lambda e: e["key"].isin(*names))
    kept = _chosen({no: by(m.by) for no, m in merges.items()})
    mean = F.col("no").isin(*[no for no, m in merges.items() if m.fn == "avg"])
    return rows.withColumn("labels", kept).groupBy("no", "labels", "tick").agg(F.when(mean, F.avg("value")).otherwise(F.sum("value")).alias("value"))


def _quantile_rows(rows: DataFrame, quantiles: dict[int, Quantile]) -> DataFrame:
    """Quantiles of cumulative buckets; a histogram has some dozens of them."""
    rows = rows.withColumn("le", F.try_element_at(F.map_from_entries("labels"), F.lit("le")).cast("double")).where("le is not null")
    hist = rows.withColumn("labels", F.filter("labels", lambda e: e["key"] != "le")).groupBy("no", "labels", "tick").agg(F.array_sort(F.collect_list(F.struct("le", F.col("value").alias("n")))).alias("h"))
    total = F.element_at("h", -1)["n"]
    rank = _chosen({no: F.lit(x.q) for no, x in quantiles.items()}) * total
    hist = hist.where(total > 0).withColumn("rank", rank)
    hist = hist.withColumn("below", F.size(F.filter("h", lambda b: b["n"] < F.col("rank"))))
    first = F.element_at("h", F.col("below") + 1)
    before = F.when(F.col("below") > 0, F.element_at("h", F.greatest("below", F.lit(1)))).otherwise(F.struct(F.lit(0.0).alias("le"), F.lit(0.0).alias("n")))
    inside = before["le"] + (first["le"] - before["le"]) * F.coalesce(F.try_divide(F.col("rank") - before["n"], first["n"] - before["n"]), F.lit(0.0))
    return hist.select("no", "labels", "tick", F.when(first["le"] == float("inf"), before["le"]).otherwise(inside).alias("value"))


def _value(node: Node | float, held: Column, number: dict[Node, int]) -> Column:
    """An expression over a map of the values of its atoms; null where one is missing."""
    if isinstance(node, (int, float)):
        return F.lit(float(node))
    if isinstance(node, Number):
        return F.lit(node.value)
    if isinstance(node, Arithmetic):
        return _ARITHMETIC[node.op](_value(node.left, held, number), _value(node.right, held, number))
    return F.try_element_at(held, F.lit(number[node]))


def side_by_side(values: DataFrame, nodes: Sequence[Node | float]) -> tuple[DataFrame, list[Column]]:
    """(labels, tick, held) with the values of all atoms of `nodes` side by side, and a column
    over it for each node: series with the same labels meet on one row, without a join."""
    number = {x: k for k, x in enumerate(dict.fromkeys(x for n in nodes for x in _atoms(n)))}
    rows = [_series_rows(values, own)] if (own := {x: k for x, k in number.items() if isinstance(x, Series)}) else []
    inner = [x for x in number if not isinstance(x, Series)]
    if inner:  # one step further down for all of them
        below, columns = side_by_side(values, [x.of for x in inner])
        each = F.array(*[F.struct(F.lit(number[x]).alias("no"), c.alias("value")) for x, c in zip(inner, columns)])
        below = below.select("labels", "tick", F.explode(each).alias("s")).select("s.no", "labels", "tick", "s.value").where("value is not null")
        for kind, step in ((Merge, _merge_rows), (Quantile, _quantile_rows)):
            if own := {number[x]: x for x in inner if isinstance(x, kind)}:
                rows.append(step(below.where(F.col("no").isin(*own)), own))
    # An atom has one value for a label set and tick.
    wide = reduce(DataFrame.unionByName, rows).groupBy("labels", "tick").agg(F.map_from_entries(F.collect_list(F.struct("no", "value"))).alias("held"))
    return wide, [_value(n, F.col("held"), number) for n in nodes]


def runs_of_ticks(breaches: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, first, last, ticks of each run of successive ticks of a key.

    Runs are found within slabs of ticks; only those that touch a slab's edge are looked at
    once more to be joined.
    """
    rows = breaches.withColumn("slab", F.floor(F.col("tick") / _RUN_SLAB))
    nth = F.row_number().over(Window.partitionBy(*keys, "slab").orderBy("tick"))
    runs = rows.withColumn("run", F.col("tick") - nth).groupBy(*keys, "slab", "run").agg(F.min("tick").alias("first"), F.max("tick").alias("last"), F.count(F.lit(1)).alias("ticks")).drop("slab", "run")
    edge = (F.pmod("first", F.lit(_RUN_SLAB)) == 0) | (F.pmod("last", F.lit(_RUN_SLAB)) == _RUN_SLAB - 1)
    order = Window.partitionBy(*keys).orderBy("first")  # two runs of a slab at most
    new = (F.coalesce(F.lag("last").over(order), F.lit(-2)) != F.col("first") - 1).cast("int")
    joined = runs.where(edge).withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = joined.groupBy(*keys, "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("ticks").alias("ticks")).drop("run")
    return runs.where(~edge).unionByName(joined)


def firing_intervals(points: DataFrame, rules: Sequence[Rule], *, step: int = 60) -> DataFrame:
    """rule, group, severity, labels, started_at, fired_at, ended_at, ticks: what `rules` raise
    over `points` (ts, metric, labels, value).

    Rules are looked at every `step` seconds.  Ticks of a rule and label set at which it
    breaches without a gap form a run; it fires once it has lasted for the rule's hold time.
    A tick at which an operand is missing, null or not a number does not breach.
    """
    for rule in rules:
        if rule.op not in COMPARISONS:
            raise ValueError(f"unknown comparison: {rule.op}")
    values = series_values(points, [x for r in rules for side in (r.expr, r.limit) for x in _leaves(side)], step=step)
    wide, columns = side_by_side(values, [side for r in rules for side in (r.expr, r.limit)])
    known = [~F.isnan(c) for c in columns]
    breach = [F.when(known[2 * k] & known[2 * k + 1] & compare(r.op, columns[2 * k], columns[2 * k + 1]), F.lit(k)) for k, r in enumerate(rules)]
    breaches = wide.select("labels", "tick", F.explode(F.array_compact(F.array(*breach))).alias("no"))
    runs = runs_of_ticks(materialize(breaches, "rule-breaches"), ["no", "labels"])
    names = points.sparkSession.createDataFrame([(k, r.name, r.group, r.severity, r.hold) for k, r in enumerate(rules)], "no int, rule string, group string, severity string, hold int")
    at = lambda seconds: F.timestamp_add("SECOND", seconds, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    fired = runs.join(F.broadcast(names), "no").where((F.col("last") - F.col("first")) * step >= F.col("hold"))
    text = F.array_join(F.transform("labels", lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return fired.select(
        "rule", "group", "severity", text.alias("labels"), at(F.col("first") * step).alias("started_at"), at(F.col("first") * step + F.col("hold")).alias("fired_at"), at(F.col("last") * step).alias("ended_at"), "ticks"
    )
