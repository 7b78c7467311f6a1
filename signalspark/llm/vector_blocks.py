"""A stated query set against all vectors, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import arrow_batches, materialize

#: Vectors and queries of one block.
VECTORS, QUERIES = 2048, 1024


def clean_vectors(vectors: DataFrame, id_col: str, vector_col: str, *, zero: bool) -> DataFrame:
    """(id, v: array<double>, dim): a row for each whole and finite vector, repeated ids
    included; with `zero` false, vectors of zeros alone are left out; empty ones always are."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(whole & (F.size("v") > 0))
    if not zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows.withColumn("dim", F.size("v"))


@dataclass
class Block:
    """Vectors (sorted by id, then row) that meet queries; rows tell equal ids apart."""

    ids: np.ndarray
    rows: np.ndarray
    vectors: np.ndarray
    query_rows: np.ndarray
    queries: np.ndarray
    radius: np.ndarray


def numbered(vectors: DataFrame, is_query: Column) -> DataFrame:
    """The vectors with a row number each and the flag is_query, as a written table."""
    rows = vectors.withColumns({"row": F.monotonically_increasing_id(), "is_query": F.coalesce(is_query, F.lit(False))})
    return materialize(rows, "vectors")


def each_block(vectors: DataFrame, asked: DataFrame, size: int | None, search: Callable, score: str) -> DataFrame:
    """query_row, query_id, vec_id, score: what `search` finds in every block for every query.

    Vectors of one dimension are dealt into blocks of about `size` by hash of the row
    (None: one block), the queries among `asked` into blocks of their own, and each pair of
    blocks is one group of bounded size.  `search(block)` returns arrays (place of the
    query, place of the vector, score); `asked` may bring a column radius.
    """
    spark = vectors.sparkSession
    arrow_batches(spark)
    asked = asked.where("is_query")
    n, n_queries = vectors.count() if size else 0, asked.count()
    blocks, query_blocks = max(1, -(-n // size)) if size else 1, max(1, -(-n_queries // QUERIES))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    query_block = F.pmod(F.xxhash64(F.lit(1), F.col("row")), F.lit(query_blocks)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    radius = F.coalesce("radius", F.lit(float("inf"))) if "radius" in asked.columns else F.lit(0.0)
    keys, same = ["dim", "block", "query_block"], ["id", "row", "v"]
    left = vectors.select("dim", block.alias("block"), every(query_blocks).alias("query_block"), F.lit(False).alias("query"), F.lit(0.0).alias("radius"), *same)
    right = asked.select("dim", every(blocks).alias("block"), query_block.alias("query_block"), F.lit(True).alias("query"), radius.alias("radius"), *same)

    def run(table: pa.Table) -> pa.Table:
        query, ids, rows = (table.column(c).to_numpy() for c in ("query", "id", "row"))
        v = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        own, asked = np.flatnonzero(~query), np.flatnonzero(query)
        own = own[np.lexsort((rows[own], ids[own]))]
        found = search(Block(ids[own], rows[own], v[own], rows[asked], v[asked], table.column("radius").to_numpy()[asked])) if len(own) and len(asked) else [np.zeros(0, np.int64)] * 3
        return pa.table({"query_row": rows[asked][found[0]], "query_id": ids[asked][found[0]], "vec_id": ids[own][found[1]], "score": found[2].astype(np.int64 if score == "long" else np.float64)})

    groups = left.unionByName(right).repartition(max(2, blocks * query_blocks), *keys).groupBy(*keys)
    return groups.applyInArrow(run, f"query_row long, query_id long, vec_id long, score {score}")


def best_of(found: DataFrame, k: int, *, largest: bool) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` best of each query row, ties to the smaller id."""
    order = Window.partitionBy("query_row").orderBy(F.desc("score") if largest else F.asc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
