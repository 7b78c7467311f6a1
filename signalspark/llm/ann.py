"""Approximate nearest neighbours by collision counting over sorted projections."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialize
from .vector_blocks import VECTORS, Block, best_of, clean_vectors, each_block, numbered

#: Projections, half the window's width as a multiple of the radius, growth of the radius
#: per rehashing, rehashings before the shared radius is reached, and share of vectors at
#: the radius that may miss the collision threshold.
PROJECTIONS, HALF_WIDTH, GROWTH, LEVELS, MISSED = 192, 1.2, 1.1, 2, 0.05
#: Rows that are measured to set a query's radius.
SAMPLE = 4096


@lru_cache(maxsize=8)
def directions(dim: int, seed: int) -> tuple[np.ndarray, int]:
    """(directions as columns, collision threshold) for vectors of `dim` components.

    The directions are random rotations side by side, whose collision counts vary less
    than those of independent ones.  The threshold is the count that all but MISSED of
    2048 random vectors at the radius reach.
    """
    rng = np.random.default_rng(seed)
    turns = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] * np.sqrt(dim) for _ in range(-(-PROJECTIONS // dim))]
    chosen = np.concatenate(turns, axis=1)[:, :PROJECTIONS]
    at_radius = rng.standard_normal((2048, dim))
    at_radius /= np.linalg.norm(at_radius, axis=1, keepdims=True)
    counts = (np.abs(at_radius @ chosen) <= HALF_WIDTH).sum(axis=1)
    return chosen, int(np.quantile(counts, MISSED, method="lower"))


def search_block(block: Block, k: int, seed: int = 42, verified: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, vector place, distance) of the `k` nearest found of a block for each query.

    Each projection keeps its vectors sorted.  A window centred at the query's projection
    widens with the radius (virtual rehashing: wider windows hold the narrower ones, so
    only what newly falls in is counted).  A vector that collides in enough projections
    is verified by its distance.  The search of a block ends at the query's shared radius,
    or once `k` verified vectors lie within a smaller one.  `verified` takes the number
    of vectors verified for each query.
    """
    ids, vectors = block.ids, block.vectors
    n, dim = vectors.shape
    chosen, threshold = directions(dim, seed)
    projected, asked = (vectors @ chosen).T, block.queries @ chosen
    order = np.argsort(projected, axis=1, kind="stable").astype(np.int32)
    values = np.take_along_axis(projected, order, axis=1)
    half = HALF_WIDTH * block.radius[:, None] / GROWTH ** np.arange(LEVELS, -1, -1)  # inf: the whole block
    # A little wider than the radius, for the rounding of projections.
    low = np.stack([np.searchsorted(values[j], asked[:, j, None] - half * (1 + 1e-9) - 1e-12, side="left") for j in range(len(values))], axis=1)
    high = np.stack([np.searchsorted(values[j], asked[:, j, None] + half * (1 + 1e-9) + 1e-12, side="right") for j in range(len(values))], axis=1)
    out = [], [], []
    for q, query in enumerate(block.queries):
        counts, distance = np.zeros(n, np.int64), np.full(n, np.inf)
        others = block.rows != block.query_rows[q]
        inside = None
        for level in range(LEVELS + 1):
            lo, hi = low[q, :, level].tolist(), high[q, :, level].tolist()
            if inside is None:
                fresh = [order[j, a:b] for j, (a, b) in enumerate(zip(lo, hi))]
            else:
                fresh = [order[j, a:b] for j, (a, b) in enumerate(zip(lo, inside[0]))] + [order[j, a:b] for j, (a, b) in enumerate(zip(inside[1], hi))]
            inside = lo, hi
            counts += np.bincount(np.concatenate(fresh), minlength=n)
            new = np.flatnonzero((counts >= threshold) & np.isinf(distance) & others)
            if len(new):
                distance[new] = np.sqrt(((vectors[new] - query) ** 2).sum(axis=1))
            if (distance <= half[q, level] / HALF_WIDTH).sum() >= k:
                break
        found = np.flatnonzero(np.isfinite(distance))
        if verified is not None:
            verified.append(len(found))
        found = found[np.lexsort((ids[found], distance[found]))][:k]
        out[0].append(np.full(len(found), q))
        out[1].append(found)
        out[2].append(distance[found])
    return tuple(np.concatenate(x) for x in out)


def sample_radius(block: Block, k: int) -> np.ndarray:
    """For each query the distance of its k-th nearest sampled vector, infinity without so many.

    The sample is part of the table, so that no true neighbour lies beyond.
    """
    if len(block.vectors) < k:
        return np.full(len(block.queries), np.inf)
    out = []
    for row, query in zip(block.query_rows, block.queries):
        apart = np.sqrt(((block.vectors[block.rows != row] - query) ** 2).sum(axis=1))
        out.append(np.partition(apart, k - 1)[k - 1] if len(apart) >= k else np.inf)
    return np.array(out)


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 42) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the `k` nearest vectors found, by
    Euclidean distance in double precision, ties to the smaller id.

    `is_query` is a condition on the columns id, v, dim.  Every vector is indexed.  A
    query's radius comes from its distances to a sample of about SAMPLE vectors of its
    dimension and is shared by all blocks.
    Defined cases: vectors that are null, empty, zero or hold null or non-finite
    components take no part, nor do null ids; every row of a repeated id is a candidate,
    and a query of its own (then ranks of that id repeat); only vectors of the query's
    dimension are candidates; with fewer than `k` all are returned; an empty table gives an
    empty table.
    """
    rows = numbered(clean_vectors(vectors, id_col, vector_col, zero=False), is_query)
    size = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    share = F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(1 << 30)) < F.lit(float(SAMPLE << 30)) / F.col("n")
    sample = rows.join(size, "dim").where(share).select(*rows.columns)
    measured = each_block(sample, rows, None, lambda b: (np.arange(len(b.queries)), np.zeros(len(b.queries), np.int64), sample_radius(b, k)), "double")
    radius = materialize(measured.select(F.col("query_row").alias("row"), F.col("score").alias("radius")), "radius")
    # A query whose dimension the sample lacks has no radius and searches whole blocks.
    asked = rows.where("is_query").join(radius, "row", "left")
    return best_of(each_block(rows, asked, VECTORS, lambda b: search_block(b, k, seed), "double"), k, largest=False)
