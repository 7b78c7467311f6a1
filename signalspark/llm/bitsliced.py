"""Exact top-k by integer inner product over a bit-sliced index."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame

from .vector_blocks import VECTORS, Block, best_of, clean_vectors, each_block, numbered

def _slices(column: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (one per bit, over the rows) of non-negative integers."""
    bits = (column[None, :] >> np.arange(width)[:, None] & 1).astype(np.uint8)
    pad = -len(column) % 64
    return np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1, bitorder="little").view(np.uint64)


class _Planes:
    """Bit planes of a sum, by weight; three planes of a weight become a sum and a carry."""

    def __init__(self):
        self.held: list[list[np.ndarray]] = []

    def add(self, weight: int, plane: np.ndarray) -> None:
        while len(self.held) <= weight + 1:
            self.held.append([])
        own = self.held[weight]
        own.append(plane)
        if len(own) == 3:
            a, b, c = own
            either = a ^ b
            carry = (a & b) | (c & either)
            either ^= c
            self.held[weight] = [either]
            self.add(weight + 1, carry)

    def finish(self) -> list[np.ndarray | None]:
        """One plane for each weight, lowest first."""
        weight = 0
        while weight < len(self.held):
            if len(self.held[weight]) == 2:
                a, b = self.held[weight]
                self.held[weight] = [a ^ b]
                self.add(weight + 1, a & b)
            weight += 1
        return [x[0] if x else None for x in self.held]


def search_block(block: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, vector place, score) of the `k` largest scores of a block for each query.

    Components are stored as slices of value - minimum, as many as the attribute needs.  A
    negative query component takes the complement of the slices, which changes all scores of
    a query alike.  The products of query bits and slices are added as bitmaps, for all
    queries at once, without a bound on the sum.
    """
    rows, asked = _integers(block.vectors), _integers(block.queries)
    n, dim = rows.shape
    least = rows.min(axis=0)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    planes, words = _Planes(), -(-n // 64)
    for d in range(dim):
        width = int(rows[:, d].max() - least[d]).bit_length()
        slices = _slices(rows[:, d] - least[d], width)
        turned = np.where(asked[:, d] < 0, full, np.uint64(0))[:, None]
        size = np.abs(asked[:, d])
        for j in range(int(size.max()).bit_length()):
            chosen = np.where(size >> j & 1, full, np.uint64(0))[:, None]
            for i in range(width):
                planes.add(i + j, (slices[i] ^ turned) & chosen)
    total = planes.finish()

    inside = np.packbits(np.pad(np.ones(n, np.uint8), (0, words * 64 - n)), bitorder="little").view(np.uint64)
    open_, sure = np.tile(inside, (len(asked), 1)), np.zeros((len(asked), words), np.uint64)
    for q, row in enumerate(block.query_rows):
        for own in np.flatnonzero(block.rows == row):  # the query itself
            open_[q, own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
    for plane in reversed(total):  # from the most significant slice downward
        if plane is None:
            continue
        both = sure | (open_ & plane)
        count = np.bitwise_count(both).sum(axis=1, dtype=np.int64)[:, None]
        sure = np.where(count <= k, both, sure)
        open_ = np.where(count > k, open_ & plane, np.where(count < k, open_ & ~plane, np.uint64(0)))
    out = [], [], []
    unpack = lambda row: np.flatnonzero(np.unpackbits(row.view(np.uint8), bitorder="little"))
    for q in range(len(asked)):
        found = unpack(sure[q])
        if len(found) < k:  # boundary rows have equal scores: the smaller ids
            found = np.concatenate([found, unpack(open_[q])[: k - len(found)]])
        out[0].append(np.full(len(found), q))
        out[1].append(found)
        out[2].append(_scores(rows[found], asked[q]))
    return tuple(np.concatenate(x) for x in out)


def _integers(values: np.ndarray) -> np.ndarray:
    """Whole numbers as 64-bit integers; those beyond 2**62 raise an error."""
    if values.size and np.abs(values).max() >= 2.0**62:
        raise OverflowError("a quantised component is beyond 2**62")
    return values.astype(np.int64)


def _scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products; one that leaves 64 bits raises an error."""
    if len(query) * float(np.abs(query).max(initial=0)) * float(np.abs(rows).max(initial=0)) < 2.0**62:
        return rows @ query
    exact = [sum(map(int.__mul__, r, query.tolist())) for r in rows.tolist()]
    if any(not -(2**63) <= x < 2**63 for x in exact):
        raise OverflowError("an inner product leaves 64 bits")
    return np.array(exact, np.int64)


def exact_topk(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the `k` largest integer inner products of
    floor(scale * component) for each query, ties to the smaller id.

    `is_query` is a condition on the columns id, v, dim.  Defined cases: vectors that are
    null, empty or hold null or non-finite components take no part, nor do null ids; every
    row of a repeated id is a candidate, and a query of its own (then ranks of that id
    repeat); a quantised component beyond 2**62 or a returned score beyond 64 bits raises
    OverflowError; only vectors of the query's dimension are candidates; with fewer than
    `k` all are returned; an empty table gives an empty table.
    """
    rows = numbered(clean_vectors(vectors, id_col, vector_col, zero=True), is_query)

    def search(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return search_block(replace(block, vectors=np.floor(scale * block.vectors), queries=np.floor(scale * block.queries)), k)

    return best_of(each_block(rows, rows, VECTORS, search, "long"), k, largest=True)
