"""Aggregates over trailing time windows in O(n log w) by sums of blocks and a wavelet matrix.

Rows arrive sorted by key and time and are worked on an Arrow batch at a time, all keys of
a batch together; of the batches before only the rows within the longest window are held.
Sums and spreads of a window are put together from blocks of 2^k rows, so that nothing is
subtracted; minima and maxima from two overlapping blocks; order statistics descend a
wavelet matrix over the ranks of the values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .slabs import micros, with_halo

FUNCTIONS = ("count", "sum", "mean", "std", "min", "max", "median")
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class Blocks:
    """Aggregates of the slices [lo, hi) of an array, for many slices at once."""

    def __init__(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.x, self.lo, self.n = x, lo, np.maximum(hi - lo, 0)
        self.levels = int(self.n.max()).bit_length() if len(lo) and len(x) else 0

    def sums(self, spread: bool) -> tuple[np.ndarray, np.ndarray]:
        """(sum, sum of squared distances from the mean)."""
        block, square = self.x, np.zeros(len(self.x))
        total, apart, held, at = np.zeros(len(self.lo), self.x.dtype), np.zeros(len(self.lo)), np.zeros(len(self.lo)), self.lo.copy()
        for k in range(self.levels):
            own = np.flatnonzero(self.n >> k & 1)
            start, size = at[own], float(1 << k)
            if spread:
                with np.errstate(invalid="ignore", divide="ignore"):
                    gap = np.where(held[own] > 0, block[start] / size - total[own] / np.maximum(held[own], 1), 0.0)
                    apart[own] += square[start] + gap * gap * held[own] * size / (held[own] + size)
            total[own] += block[start]
            held[own] += size
            at[own] += 1 << k
            if k + 1 < self.levels:
                left, right = block[: -(1 << k)], block[1 << k :]
                if spread:
                    with np.errstate(invalid="ignore"):
                        square = square[: -(1 << k)] + square[1 << k :] + (left / size - right / size) ** 2 * size / 2
                block = left + right
        return total, apart

    def extreme(self, of) -> np.ndarray:
        """`of` is np.fmin or np.fmax-like: two overlapping blocks cover a slice."""
        block, out = self.x, np.zeros(len(self.lo), self.x.dtype)
        for k in range(self.levels):
            own = np.flatnonzero((self.n >> k) == 1)
            out[own] = of(block[self.lo[own]], block[self.lo[own] + self.n[own] - (1 << k)])
            if k + 1 < self.levels:
                block = of(block[: -(1 << k)], block[1 << k :])
        return out

    def medians(self) -> np.ndarray:
        order = np.argsort(self.x, kind="stable")  # not-a-numbers last
        ranks = np.empty(len(order), np.int64)
        ranks[order] = np.arange(len(order))
        own = np.flatnonzero(self.n > 0)
        lo, n = self.lo[own], self.n[own]
        low = (n - 1) // 2
        places = wavelet_select(ranks, np.concatenate([lo, lo]), np.concatenate([lo + n, lo + n]), np.concatenate([low, n // 2]))
        values = self.x[order[places]].astype(np.float64)
        out = np.zeros(len(self.lo))
        out[own] = (values[: len(own)] + values[len(own) :]) / 2
        return out


def wavelet_select(ranks: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th smallest (from 0) of ranks[lo:hi] for each query; ranks are a permutation.

    A wavelet matrix: from the highest bit on, rows are dealt by the bit, and a count of
    zeros before each place tells a query where its slice goes on.
    """
    lo, hi, k, found = lo.copy(), hi.copy(), k.copy(), np.zeros(len(lo), np.int64)
    for bit in reversed(range(max(1, int(len(ranks)).bit_length()))):
        one = (ranks >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        below = zeros[hi] - zeros[lo]
        right = k >= below
        lo, hi = np.where(right, zeros[-1] + lo - zeros[lo], zeros[lo]), np.where(right, zeros[-1] + hi - zeros[hi], zeros[hi])
        k = np.where(right, k - below, k)
        found |= right.astype(np.int64) << bit
        ranks = np.concatenate([ranks[~one], ranks[one]])
    return found


def _least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smaller values, not-a-numbers being larger than all."""
    return np.fmin(a, b)


def window_columns(at: np.ndarray, values: np.ndarray, known: np.ndarray, asked: slice, windows: Sequence[int], fns: Sequence[str], max_events: int | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(values, missing) for each window and function of the rows `asked`: `at` are ordered
    times that never come within a window of another key's."""
    x, upto = values[known], np.concatenate([[0], np.cumsum(known)])
    hi = upto[np.searchsorted(at, at[asked], side="right")]
    out = []
    for w in windows:
        lo = upto[np.searchsorted(at, at[asked] - w, side="left")]
        if max_events is not None:
            lo = np.maximum(lo, hi - max_events)
        blocks, n = Blocks(x, lo, hi), hi - lo
        total, apart = blocks.sums("std" in fns) if {"sum", "mean", "std"} & set(fns) else (None, None)
        with np.errstate(invalid="ignore"):
            for fn in fns:
                if fn == "count":
                    out.append((n, np.zeros(len(n), bool)))
                    continue
                if fn == "sum":
                    found = total
                elif fn == "mean":
                    found = total / np.maximum(n, 1)
                elif fn == "std":
                    found = np.sqrt(apart / np.maximum(n, 1))
                elif fn == "median":
                    found = blocks.medians()
                else:
                    found = blocks.extreme(_least if fn == "min" else np.maximum)
                out.append((found, n == 0))
    return out


class _Stream:
    """Rows of a task on their way through: those that wait for their peers, and those within
    the longest window of the last time seen."""

    def __init__(self, key: str, ts: str, features: Sequence[str], windows: Sequence[int], fns: Sequence[str], max_events: int | None, kinds: Sequence[pa.DataType]):
        self.key, self.ts, self.features, self.fns, self.max_events, self.kinds = key, ts, features, fns, max_events, kinds
        self.windows = [w * 1_000_000 for w in windows]
        self.table: pa.Table | None = None
        self.done = 0

    def feed(self, table: pa.Table, last: bool) -> pa.Table | None:
        self.table = table if self.table is None else pa.concat_tables([self.table, table])
        if not len(self.table):
            return None
        rows = self.table.combine_chunks()
        column = lambda name: rows.column(name).chunk(0)
        codes = column(self.key).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        slabs, times = (pc.fill_null(column(name), none).to_numpy(zero_copy_only=False) for name, none in (("__slab", -(1 << 62)), ("__at", 0)))
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (codes[1:] != codes[:-1]) | (slabs[1:] != slabs[:-1])
        # Times since the start of the key, with more than a window between two keys.
        begin = np.flatnonzero(fresh)
        group = np.cumsum(fresh) - 1
        start, end = times[begin], times[np.append(begin[1:], len(rows)) - 1]
        shift = np.concatenate([[0], np.cumsum(end - start + 2 * max(self.windows) + 2)[:-1]])
        at = times - start[group] + shift[group]
        ready = len(rows) if last else int(np.searchsorted(at, at[-1], side="left"))
        asked = slice(self.done, ready)
        out = rows.slice(self.done, max(0, ready - self.done))
        if len(out):
            found, k = [], 0
            for name in self.features:
                x = column(name)
                known = pc.is_valid(x).to_numpy(zero_copy_only=False)
                for values, missing in window_columns(at, pc.fill_null(x, 0).to_numpy(zero_copy_only=False), known, asked, self.windows, self.fns, self.max_events):
                    found.append(pa.array(values, mask=missing).cast(self.kinds[k]))
                    k += 1
            own = [c for c in rows.column_names if not c.startswith("__")]
            out = pa.Table.from_arrays([*[out.column(c) for c in own], *found], [*own, *[f"r{i}" for i in range(k)]]).filter(pc.invert(out.column("__halo")))
        keep = int(np.searchsorted(at, at[ready - 1] - max(self.windows), side="left")) if ready else 0
        self.table, self.done = rows.slice(keep), ready - keep
        return out if len(out) else None


def trailing_windows(df: DataFrame, entity: str, ts: str, features: dict[str, str], *, windows: Sequence[int], fns: Sequence[str], max_events: int | None = None, as_double: bool = False) -> DataFrame:
    """Add `<name>_<fn>_<seconds>s` for each feature name, window and function: the aggregate
    of the feature's expression over the entity's rows of the last `seconds`, bounds and
    peers included; nulls are left out.  One shuffle, by entity and slab of time.

    Sums of integers are longs and their extremes keep the type; all else is double.
    """
    for fn in fns:
        if fn not in FUNCTIONS:
            raise ValueError(f"unknown aggregate: {fn}")
    if not features or not windows or not fns:
        return df
    names = list(features)
    rows = df.select("*", *[F.expr(e).alias(f"__x{i}") for i, e in enumerate(features.values())])
    whole = [isinstance(rows.schema[f"__x{i}"].dataType, _INTEGERS) and not as_double for i in range(len(names))]
    types = [rows.schema[f"__x{i}"].dataType for i in range(len(names))]
    rows = rows.withColumns({f"__x{i}": F.col(f"__x{i}").cast("long" if w else "double") for i, w in enumerate(whole)})
    rows = rows.withColumns({"__key": F.col(f"`{entity}`").cast("string"), "__at": micros(F.col(f"`{ts}`"))})
    rows = with_halo(rows, ts, max(windows) * 1_000_000).withColumnsRenamed({"slab": "__slab", "halo": "__halo"})
    fields, plan = list(df.schema.fields), []
    for name, kind, integer in zip(names, types, whole):
        for w in windows:
            for fn in fns:
                result = T.LongType() if fn == "count" or (integer and fn == "sum") else kind if integer and fn in ("min", "max") else T.DoubleType()
                plan.append((f"{name}_{fn}_{w}s", result))
    arrow = {T.DoubleType: pa.float64(), T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.ShortType: pa.int16(), T.ByteType: pa.int8()}
    kinds = [arrow[type(k)] for _, k in plan]
    schema = T.StructType([*fields, *[T.StructField(f"r{i}", k) for i, (_, k) in enumerate(plan)]])
    features_in = [f"__x{i}" for i in range(len(names))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, empty = _Stream("__key", ts, features_in, windows, fns, max_events, kinds), None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            empty = table.slice(0, 0)
            if (out := stream.feed(table, False)) is not None:
                yield from out.to_batches()
        if empty is not None and (out := stream.feed(empty, True)) is not None:
            yield from out.to_batches()

    dealt = rows.repartition("__key", "__slab").sortWithinPartitions("__key", "__slab", "__at")
    found = dealt.mapInArrow(run, schema)
    return found.select(*[F.col(f"`{f.name}`") for f in fields], *[F.col(f"r{i}").alias(name) for i, (name, _) in enumerate(plan)])
