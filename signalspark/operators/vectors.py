"""Vector retrieval: exact and partitioned search, quantization, index upkeep (F)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import as_doubles, dot, unit
from ..sources.commits import commit_text, names_in, read_text, remove
from ..sources.scratch import materialize
from .quantiles import exact_quantiles
from .training import number_rows

#: Factor of an index's size over the raw vectors, by kind (fixed values).
SIZE_FACTORS = {"flat": 1.0, "ivf": 1.0, "hnsw": 1.5}
#: Rows that train a quantizer at most.
MAX_TRAINING = 100_000
#: Queries of a block and items of a part that meet in one group.
BLOCK_QUERIES, PART_ITEMS = 1024, 4096
#: Items that a part may hold where fewer parts are tasks enough, and only the best of a part leave it.
GROUP_ITEMS = 65_536
#: Items of a group that stand on one row.
CHUNK_ITEMS = 512
#: A cell may hold so many times the mean of a cell before it is split.
CELL_SIZE = 4
#: Rounds in which large cells are split.
SPLITS = 4


def l2_normalize(df: DataFrame, col: str = "embedding") -> DataFrame:
    """Unit vectors; a zero vector becomes null."""
    return df.withColumn(col, unit(as_doubles(F.col(col))))


def _top(scored: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "item_id", "score")


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _dealt(items: DataFrame, asked: DataFrame, key: str, least: int = 1, most: int = 0) -> tuple[DataFrame, DataFrame]:
    """Both with __block and __part, so that every item meets every row of `asked` (a stated
    query set) in one group: parts of about PART_ITEMS items, blocks of about BLOCK_QUERIES.
    With `most`, parts of up to so many items, if there are groups enough for all tasks.

    An item is copied once for each block, that is hardly ever; a query once for each part.
    """
    n = items.count()
    blocks, parts = max(least, -(-asked.count() // BLOCK_QUERIES)), max(1, -(-n // PART_ITEMS))
    if most:
        parts = max(-(-n // most), min(parts, -(-_tasks(items) // blocks)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = items.select("*", F.pmod(F.xxhash64(items.columns[0]), F.lit(parts)).cast("int").alias("__part")).select("*", every(blocks).alias("__block"))
    right = asked.select("*", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("__block")).select("*", every(parts).alias("__part"))
    return left, right


def meet(items: DataFrame, asked: DataFrame, key: str, *, least: int = 1) -> DataFrame:
    """Every row of `items` with every row of `asked`, as the struct `a`, in `least` blocks or more."""
    left, right = _dealt(items, asked, key, least)
    packed = right.groupBy("__block", "__part").agg(F.collect_list(F.struct(*asked.columns)).alias("__asked"))
    return left.join(packed, ["__block", "__part"]).select(*items.columns, F.explode("__asked").alias("a"))


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    """A column of (nested) lists of one length as a row each."""
    values = table.column(column).combine_chunks()
    while pa.types.is_list(values.type):
        values = values.flatten()
    return values.to_numpy(zero_copy_only=False).reshape(len(table), -1)


def _best_rows(x: np.ndarray, asked: np.ndarray, scores: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of `asked`, row of `x`, score) of the `k` best rows of `x`, ties to the earlier one,
    NaN above all as in Spark's own order.

    Items are scored PART_ITEMS at a time, and only what beats the `k` best so far is kept.
    """
    rows, places, values = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    least, full = np.full(len(asked), -np.inf), np.zeros(len(asked), bool)
    ranked = lambda v: np.where(np.isnan(v), np.inf, v)
    for first in range(0, len(x), PART_ITEMS):
        exact = scores(x[first : first + PART_ITEMS], asked)
        found = ranked(exact)
        better = found > least[:, None]
        better[~full] = True
        n = found.shape[1]
        if k < n and np.count_nonzero(better) > 2 * k * len(asked):
            better &= found >= np.partition(found, n - k, axis=1)[:, n - k, None]
        at, near = np.nonzero(better)
        rows, places, values = np.concatenate([rows, at]), np.concatenate([places, first + near]), np.concatenate([values, exact[at, near]])
        order = np.lexsort((places, -ranked(values), rows))
        begin = np.searchsorted(rows[order], np.arange(len(asked)))
        order = order[np.arange(len(order)) - begin[rows[order]] < k]
        rows, places, values = rows[order], places[order], values[order]
        full = np.bincount(rows, minlength=len(asked)) == k
        least[full] = ranked(values)[np.searchsorted(rows, np.flatnonzero(full)) + k - 1]
    return rows, places, values


def _best_of_groups(left: DataFrame, right: DataFrame, keys: list[str], scores: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int, prepared: Callable[[np.ndarray], np.ndarray] = lambda q: q) -> DataFrame:
    """The `k` best items (item_id, x) of each query (query_id, q) among those that share a group
    of `keys`: every group scores its pairs with numpy, and only its `k` best of a query leave it.
    `scores` gets the queries as `prepared`, which is called once for a block of them."""
    kinds = left.schema["item_id"].dataType.simpleString(), right.schema["query_id"].dataType.simpleString()

    def best(own: pa.Table, block: pa.Table) -> pa.Table:
        own = own.take(pc.sort_indices(own, sort_keys=[("item_id", "ascending")]))  # ties to the smaller id
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(own) and len(block):
            x, asked = _matrix(own, "x"), _matrix(block, "q")
            for first in range(0, len(block), BLOCK_QUERIES):
                rows, places, values = _best_rows(x, prepared(asked[first : first + BLOCK_QUERIES]), scores, k)
                found.append((first + rows, places, values))
        rows, places, values = (np.concatenate(c) for c in zip(*found))
        return pa.table({"query_id": block.column("query_id").take(pa.array(rows)), "item_id": own.column("item_id").take(pa.array(places)), "score": values})

    # A number is given, as pairs and not the shuffled rows are the work of a task.
    left, right = (x.repartition(_tasks(left), *keys).groupBy(*keys) for x in (left, right))
    return _top(left.cogroup(right).applyInArrow(best, f"query_id {kinds[1]}, item_id {kinds[0]}, score double"), k)


def _best_of_blocks(items: DataFrame, asked: DataFrame, scores: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int, prepared: Callable[[np.ndarray], np.ndarray] = lambda q: q) -> DataFrame:
    """The `k` best of all items (item_id, x) for each query (query_id, q), in blocks and parts."""
    return _best_of_groups(*_dealt(items, asked, "query_id", most=GROUP_ITEMS), ["__block", "__part"], scores, k, prepared)


def _products(items: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products; each pair is summed in the same order wherever it stands, so that equal
    vectors have equal scores."""
    return np.einsum("qd,nd->qn", queries, items)


def exact_topk(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The `k` items with the largest cosine for each query, ties by item id.

    Queries (query_id, embedding) are a stated set, which meets the items in blocks.
    """
    asked = l2_normalize(queries).where(F.col("embedding").isNotNull()).select("query_id", F.col("embedding").alias("q"))
    known = l2_normalize(items).where(F.col("embedding").isNotNull()).select("item_id", F.col("embedding").alias("x"))
    return _best_of_blocks(known, asked, _products, k)


def _sample(df: DataFrame, n: int, seed: int) -> DataFrame:
    """At most about `n` rows to train on."""
    total = df.count()
    return df if total <= n else df.sample(n / total, seed=seed)


def _centroid_rows(centres: list, first: int) -> list[tuple[int, list[float]]]:
    return [(first + i, [float(x) for x in c]) for i, c in enumerate(centres)]


def _spread(items: DataFrame) -> DataFrame:
    """Vectors over all tasks, as a file of some hundred thousand is read by one or two."""
    return items.repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), "item_id")


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, added from the first component to the last."""
    gaps = np.zeros((len(x), len(centres)))
    for d in range(x.shape[1]):
        gaps += (x[:, d, None] - centres[None, :, d]) ** 2
    return gaps


def assign_cells(items: DataFrame, centroids: DataFrame) -> DataFrame:
    """item_id, embedding (normalized) and the cell of the nearest centroid, ties to the smaller
    cell.  Centroids (cell, centroid) are some thousands at most."""
    rows = F.array_sort(F.collect_list(F.struct("cell", "centroid")))
    cells = centroids.agg(F.transform(rows, lambda c: c["cell"]).alias("cells"), F.transform(rows, lambda c: c["centroid"]).alias("centres"))
    known = l2_normalize(_spread(items)).where(F.col("embedding").isNotNull()).select("item_id", "embedding").join(F.broadcast(cells)).where(F.size("cells") > 0)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                names, centres = np.asarray(batch.column("cells")[0].as_py()), np.asarray(batch.column("centres")[0].as_py())
                found = names[_gaps(_matrix(pa.Table.from_batches([batch]), "embedding"), centres).argmin(1)]
                yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("embedding"), pa.array(found, pa.int32())], ["item_id", "embedding", "cell"])

    kind = items.schema["item_id"].dataType.simpleString()
    return known.mapInArrow(nearest, f"item_id {kind}, embedding array<double>, cell int")


def build_ivf(items: DataFrame, nlist: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(index, centroids): every item with its cell, and the centroid of each cell.

    k-means runs on a sample of at most 100,000 normalized vectors; nlist defaults to a
    tenth of the items, at most 1000.  A cell of more than CELL_SIZE times the mean is split
    by a k-means of its own, SPLITS times at most; all vectors of a cell may be one, so that
    the search deals large cells over several tasks.
    """
    known = materialize(l2_normalize(_spread(items)).where(F.col("embedding").isNotNull()).select("item_id", "embedding", array_to_vector("embedding").alias("features")), "normalized")
    n = known.count()
    cells = nlist or max(1, min(1000, n // 10))
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(_sample(known, MAX_TRAINING, seed))
    index = model.transform(known).select("item_id", "embedding", "features", F.col("prediction").alias("cell"))
    rows = _centroid_rows(model.clusterCenters(), 0)
    limit = max(1, CELL_SIZE * n // cells)
    whole: set[int] = set()  # cells of one vector, which k-means cannot split
    for _ in range(SPLITS):
        large = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > limit) & ~F.col("cell").isin(sorted(whole))).orderBy("cell").collect()
        if not large:  # else fewer than cells / CELL_SIZE
            break
        index = materialize(index, "cells")
        parts = [index.where(~F.col("cell").isin([r["cell"] for r in large]))]
        for r in large:
            own, first = index.where(F.col("cell") == r["cell"]), max(i for i, _ in rows) + 1
            inner = KMeans(k=-(-2 * r["n"] // limit), seed=seed, maxIter=10).fit(_sample(own, MAX_TRAINING, seed))
            children = _centroid_rows(inner.clusterCenters(), first)
            if len(children) == 1:
                whole.add(first)
            rows = [x for x in rows if x[0] != r["cell"]] + children
            parts.append(inner.transform(own).withColumn("cell", (F.col("prediction") + first).cast("int")).drop("prediction"))
        index = reduce(DataFrame.unionByName, parts)
    return index.select("item_id", "embedding", "cell"), items.sparkSession.createDataFrame(rows, "cell int, centroid array<double>")


def ivf_search(index: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, nprobe: int = 10) -> DataFrame:
    """Top `k` inside the `nprobe` cells nearest to each query, ties to the smaller cell.

    Centroids are broadcast (some thousands at most).  Large cells are dealt into parts of
    about PART_ITEMS, which a probe meets one by one.
    """
    asked = l2_normalize(queries).where(F.col("embedding").isNotNull()).select("query_id", F.col("embedding").alias("q"))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    apart = F.aggregate(F.zip_with("q", "centroid", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    near = Window.partitionBy("query_id").orderBy("apart", "cell")
    sizes = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", F.ceil(F.col("n") / PART_ITEMS).cast("int").alias("parts"))
    sizes = materialize(sizes, "cell-sizes")  # one row for each cell
    every = centroids.agg(F.collect_list(F.struct("cell", "centroid")).alias("cells"))
    probes = asked.join(F.broadcast(every)).select("query_id", "q", F.explode("cells").alias("c")).select("query_id", "q", "c.*").withColumn("apart", apart)
    probes = probes.withColumn("n", F.row_number().over(near)).where(F.col("n") <= nprobe).join(F.broadcast(sizes), "cell")
    # A cell's queries are dealt into blocks like those of an exact search.
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
    probes = probes.select("query_id", "q", "cell", block, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = index.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("item_id"), F.col("parts")).cast("int"))
    dealt = dealt.select("item_id", F.col("embedding").alias("x"), "cell", "part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    return _best_of_groups(dealt, probes, ["cell", "part", "block"], _products, k)


def train_pq(items: DataFrame, m: int = 8, nbits: int = 4, seed: int = 42) -> DataFrame:
    """Codebooks: (part, code, centre) by one k-means for each of `m` sub-vectors."""
    known = materialize(_sample(l2_normalize(_spread(items)).where(F.col("embedding").isNotNull()), MAX_TRAINING, seed).select("embedding"), "pq-training")
    first = known.select(F.size("embedding").alias("n")).first()
    if first is None:
        return items.sparkSession.createDataFrame([], "part int, code int, centre array<double>")
    if first["n"] % m:
        raise ValueError(f"{first['n']} dimensions do not divide into {m} parts")
    width, rows = first["n"] // m, []
    for part in range(m):
        cut = known.select(array_to_vector(F.slice("embedding", part * width + 1, width)).alias("features"))
        model = KMeans(k=2**nbits, seed=seed, maxIter=5).fit(cut)
        rows += [(part, code, [float(x) for x in c]) for code, c in enumerate(model.clusterCenters())]
    return items.sparkSession.createDataFrame(rows, "part int, code int, centre array<double>")


def _codebook(books: DataFrame) -> DataFrame:
    """One row: by part, the centres in order of their codes."""
    parts = books.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "centre"))), lambda x: x["centre"]).alias("centres"))
    return parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "centres"))), lambda x: x["centres"]).alias("book"))


def encode_pq(items: DataFrame, books: DataFrame) -> DataFrame:
    """item_id and its code in each part: the nearest centre, ties to the smaller code."""
    known = l2_normalize(_spread(items)).where(F.col("embedding").isNotNull()).join(F.broadcast(_codebook(books))).select("item_id", "embedding", "book")
    kind = items.schema["item_id"].dataType.simpleString()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if not len(rows):
                continue
            x, book = _matrix(rows, "embedding"), batch.column("book")[0].as_py()
            codes, width = np.empty((len(rows), len(book)), np.int16), x.shape[1] // len(book)
            for part, centres in enumerate(book):
                codes[:, part] = _gaps(x[:, part * width : (part + 1) * width], np.asarray(centres)).argmin(1)
            offsets = pa.array(np.arange(len(rows) + 1) * len(book), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.ListArray.from_arrays(offsets, pa.array(codes.ravel()))], ["item_id", "codes"])

    return known.mapInArrow(coded, f"item_id {kind}, codes array<smallint>")


def pq_search(codes: DataFrame, books: DataFrame, queries: DataFrame, n: int = 100) -> DataFrame:
    """The `n` best items for each query by the sum of looked-up inner products.

    Codes are written once, and queries move as vectors: the products of a query with all
    centres, some hundred times as long, are worked out where it meets the items.
    """
    asked = l2_normalize(queries).where(F.col("embedding").isNotNull()).select("query_id", F.col("embedding").alias("q"))
    book = [np.asarray(centres) for centres in _codebook(books).first()["book"] or []]  # 2^nbits vectors in all

    def tables(q: np.ndarray) -> np.ndarray:
        """query, part, code: inner products, added from the first component to the last."""
        width = q.shape[1] // max(1, len(book))
        found = np.zeros((len(q), len(book), max((len(c) for c in book), default=0)))
        for part, centres in enumerate(book):
            for d in range(width):
                found[:, part, : len(centres)] += q[:, part * width + d, None] * centres[None, :, d]
        return found

    def scores(own: np.ndarray, by_part: np.ndarray) -> np.ndarray:
        found = np.zeros((len(by_part), len(own)))
        for part in range(own.shape[1]):
            found += np.take(by_part[:, part], own[:, part], axis=1)
        return found

    known = materialize(codes.select("item_id", F.col("codes").alias("x")), "pq-codes")
    return _best_of_blocks(known, asked, scores, n, tables)


def rerank(cands: DataFrame, items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Candidates (query_id, item_id) by their exact cosine, the best `k`."""
    known = l2_normalize(items).select("item_id", "embedding")
    asked = l2_normalize(queries).select("query_id", F.col("embedding").alias("q"))
    rows = cands.select("query_id", "item_id").distinct().join(known, "item_id").join(asked, "query_id")
    return _top(rows.select("query_id", "item_id", dot("q", "embedding").alias("score")), k)


def rerank_groups(items: DataFrame, queries: DataFrame, group: str, k: int) -> DataFrame:
    """The best `k` by exact cosine where a query's candidates are all items of its `group`.

    Candidates are no rows: items of a group are packed CHUNK_ITEMS to a row, dealt into
    chunks by their id, and a query keeps the `k` best of each chunk.
    """
    sizes = items.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / CHUNK_ITEMS).cast("int").alias("__chunks"))
    known = l2_normalize(items).where(F.col("embedding").isNotNull()).join(sizes, group).withColumn("__chunk", F.pmod(F.xxhash64("item_id"), F.col("__chunks")).cast("int"))
    packed = known.groupBy(group, "__chunk").agg(F.collect_list(F.struct("item_id", "embedding")).alias("__items"))
    asked = l2_normalize(queries).where(F.col("embedding").isNotNull()).join(sizes, group).select(group, "query_id", F.col("embedding").alias("q"), F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1)).alias("__chunk"))
    scored = F.transform("__items", lambda x: F.struct((-dot("q", x["embedding"])).alias("less"), x["item_id"].alias("item_id")))
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked, packed = (x.repartition(tasks, group, "__chunk") for x in (asked, packed))  # pairs are the work, and rows few
    best = asked.join(packed.hint("shuffle_hash"), [group, "__chunk"]).select("query_id", F.explode(F.slice(F.array_sort(scored), 1, k)).alias("b"))
    return _top(best.select("query_id", F.col("b.item_id").alias("item_id"), (-F.col("b.less")).alias("score")), k)


def recall_at_k(truth: DataFrame, found: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 50, 100)) -> DataFrame:
    """k and the mean over queries of the share of the true `k` best that were found."""
    both = truth.select("query_id", "item_id", F.col("rank").alias("true_rank")).join(found.select("query_id", "item_id", "rank"), ["query_id", "item_id"], "left")
    shares = [(F.count_if((F.col("true_rank") <= k) & (F.col("rank") <= k)) / F.count_if(F.col("true_rank") <= k)).alias(f"k{k}") for k in ks]
    per_query = both.groupBy("query_id").agg(*shares)
    means = per_query.agg(*[F.avg(f"k{k}").alias(str(k)) for k in ks])
    return means.unpivot([], [str(k) for k in ks], "k", "recall").withColumn("k", F.col("k").cast("int"))


def index_stats(items: DataFrame, kind: str, *, m: int = 64, nbits: int = 8) -> DataFrame:
    """kind, items, dimensions and estimated megabytes of an index."""
    stats = items.agg(F.count(F.lit(1)).alias("n_items"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dim"))
    raw = F.col("n_items") * F.col("dim") * 4.0 / 2**20
    if kind == "pq":
        size = raw * (m * nbits / 256.0)
    elif kind in SIZE_FACTORS:
        size = raw * SIZE_FACTORS[kind]
    else:
        raise ValueError(f"unknown kind of index: {kind}")
    return stats.select(F.lit(kind).alias("kind"), "n_items", "dim", size.alias("size_mb"))


def pending_operations(ops: DataFrame, *, cap: int | None = None, batch: int = 100) -> DataFrame:
    """The newest operation per item, from the oldest on in batches of `batch`; of equal seq the
    smaller item_id is newer, of one item the smaller op.  All are kept, or the newest `cap`
    where a caller bounds the queue."""
    newest = Window.partitionBy("item_id").orderBy(F.desc("seq"), "op")
    kept = ops.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")
    if cap is not None:
        kept = kept.orderBy(F.desc("seq"), "item_id").limit(cap)
    return number_rows(kept, "seq", F.desc("item_id"), name="__n").withColumn("batch_id", F.floor(F.col("__n") / batch).cast("int")).drop("__n")


def apply_index_ops(items: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, change counts) after a batch with one operation per item.

    Removes come first, then updates (remove and add), then adds of what is absent.
    Counts: an update of a present item changes twice.
    """
    present = items.select("item_id", F.lit(True).alias("present"))
    known = ops.join(present, "item_id", "left").withColumn("present", F.coalesce("present", F.lit(False)))
    gone = known.where("op in ('remove', 'update')").select("item_id")
    new = known.where("op = 'update' or (op = 'add' and not present)").select("item_id", "embedding")
    rows = items.select("item_id", "embedding").join(gone, "item_id", "left_anti").unionByName(new)
    changes = F.when(F.col("op") == "update", 1 + F.col("present").cast("int")).when(F.col("op") == "remove", F.col("present").cast("int")).otherwise((~F.col("present")).cast("int"))
    return rows, known.groupBy("op").agg(F.count(F.lit(1)).alias("n_ops"), F.sum(changes).alias("n_changes"))


def should_rebuild(stats: DataFrame, *, share: float = 0.1, max_hours: float = 24.0, alert: float = 0.2) -> DataFrame:
    """Add change_share, rebuild and alert to rows with n_items, n_changes, age_hours (null: no index)."""
    changed = F.coalesce(F.try_divide(F.col("n_changes").cast("double"), F.col("n_items").cast("double")), F.lit(0.0))
    rebuild = F.col("age_hours").isNull() | (changed >= share) | (F.col("age_hours") >= max_hours)
    return stats.select("*", changed.alias("change_share"), rebuild.alias("rebuild"), (changed >= alert).alias("alert"))


def index_consistency(tracked: DataFrame, index: DataFrame) -> DataFrame:
    """Items on one side alone: problem (not_indexed, not_tracked) and item_id."""
    a, b = tracked.select("item_id").distinct(), index.select("item_id").distinct()
    return a.join(b, "item_id", "left_anti").select(F.lit("not_indexed").alias("problem"), "item_id").unionByName(b.join(a, "item_id", "left_anti").select(F.lit("not_tracked").alias("problem"), "item_id"))


def publish_index(index: DataFrame, root: str, version: int) -> str:
    """Write the index under a name of its own, then commit its version by rename; returns the
    table's path.  Of two writers of a version one gets a ValueError, and its table is removed."""
    path = f"{root}/index_{version}-{uuid.uuid4().hex}"
    index.write.partitionBy("cell").parquet(path) if "cell" in index.columns else index.write.parquet(path)
    spark = index.sparkSession
    n = spark.read.parquet(path).count()
    if not commit_text(spark, f"{root}/manifest/{version:020d}", json.dumps({"version": version, "path": path, "n_items": n})):
        remove(spark, path)
        raise ValueError(f"version {version} is published already")
    return path


def load_latest_index(spark: SparkSession, root: str) -> DataFrame:
    """The newest published index."""
    newest = names_in(spark, f"{root}/manifest")[-1]
    return spark.read.parquet(json.loads(read_text(spark, f"{root}/manifest/{newest}"))["path"])


def benchmark_report(results: DataFrame) -> DataFrame:
    """Latency percentiles per configuration with efficiency = recall@10 * qps / (p95 * MB)
    and flags of the best by latency, throughput, recall, size and efficiency.

    `results`: config, latency_ms per query, with recall_10 and size_mb of the configuration.
    """
    rows = results.groupBy("config").agg(F.count(F.lit(1)).alias("n_queries"), F.avg("latency_ms").alias("mean_ms"), F.max("recall_10").alias("recall_10"), F.max("size_mb").alias("size_mb"))
    quantiles = exact_quantiles(results, ["config"], "latency_ms", (0.5, 0.95, 0.99)).withColumnRenamed("config", "c")
    rows = rows.join(quantiles, F.col("config").eqNullSafe(F.col("c")), "left")
    rows = rows.select("config", "n_queries", F.col("q0").alias("p50_ms"), F.col("q1").alias("p95_ms"), F.col("q2").alias("p99_ms"), F.try_divide(F.lit(1000.0), "mean_ms").alias("qps"), "recall_10", "size_mb")
    rows = rows.withColumn("efficiency", F.try_divide(F.col("recall_10") * F.col("qps"), F.col("p95_ms") * F.col("size_mb")))
    best = rows.agg(
        F.min_by("config", "p95_ms").alias("best_latency"), F.max_by("config", "qps").alias("best_throughput"), F.max_by("config", "recall_10").alias("best_recall"),
        F.min_by("config", "size_mb").alias("best_size"), F.max_by("config", "efficiency").alias("best_efficiency"),
    )
    flags = [(F.col("config") == F.col(c)).alias(c) for c in ("best_latency", "best_throughput", "best_recall", "best_size", "best_efficiency")]
    return rows.join(F.broadcast(best)).select(*rows.columns, *flags)


def write_report(report: DataFrame, path: str) -> None:
    """The report as JSON and as CSV."""
    report.write.mode("overwrite").json(f"{path}/json")
    report.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
