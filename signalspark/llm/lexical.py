"""Ranked lexical search by norm buckets of impact vectors.

A document is the vector of its integer term impacts, a query the vector of its term
weights; the score is their inner product.  Documents are ordered by the length of their
vectors and cut into buckets.  By the inequality of Cauchy and Schwarz a bucket whose
longest vector is too short for a query's threshold is left out; within a bucket the
query's coordinates are added from the heaviest on, and a document goes as soon as its sum
so far and the bound on its other coordinates stay below the threshold.  Survivors are
scored again exactly in integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import arrow_batches, materialize
from .byte_words import Vocabulary, byte_words

#: Items and bytes of item texts that are searched at once and broadcast.
ITEMS, ITEM_BYTES = 1024, 16 << 20
#: Documents of a norm bucket at most, and of a part of the ordered table on average.
BUCKET, PART = 2048, 32768
#: Survivors that are scored at once instead of bounded further.
FEW = 32
#: Room for the rounding of bounds, which are taken in doubles.
_SLACK = 1 - 1e-9


@dataclass
class Queries:
    """Items as sparse vectors over a vocabulary, each with its terms from the heaviest on."""

    ids: list
    terms: list[np.ndarray]
    weights: list[np.ndarray]

    def lengths(self) -> np.ndarray:
        return np.array([np.sqrt((w.astype(float) ** 2).sum()) for w in self.weights])


class Bucket:
    """Impact vectors of documents, by document and by term."""

    def __init__(self, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray):
        self.lengths, self.n = lengths, len(lengths)
        self.edges = np.concatenate([[0], np.cumsum(sizes)])
        self.terms, self.impacts = terms, impacts.astype(np.int64)
        order = np.argsort(terms, kind="stable")
        docs = np.repeat(np.arange(self.n), sizes)
        self.by_term, self.docs, self.by_term_impacts = terms[order], docs[order], self.impacts[order]

    def scores(self, docs: np.ndarray, weight_of: np.ndarray) -> np.ndarray:
        """Exact scores of some documents; `weight_of` holds the query's weight of every term."""
        sizes = self.edges[docs + 1] - self.edges[docs]
        at = np.repeat(self.edges[docs] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        sums = np.concatenate([[0], np.cumsum(weight_of[self.terms[at]] * self.impacts[at])])
        ends = np.cumsum(sizes)
        return sums[ends] - sums[ends - sizes]

    def survivors(self, terms: np.ndarray, weights: np.ndarray, least: int) -> np.ndarray:
        """Documents that may reach the score `least` (above 0), by coordinate bounds."""
        square = self.lengths**2
        upto = np.sqrt(np.cumsum((weights.astype(float) ** 2)[::-1]))[::-1]  # length of each coordinate and the later ones
        rest = np.append(upto[1:], 0.0)
        low, high = np.searchsorted(self.by_term, terms, side="left"), np.searchsorted(self.by_term, terms, side="right")
        sums, left = np.zeros(self.n, np.int64), square.copy()
        alive = np.flatnonzero(self.lengths * upto[0] >= least * _SLACK) if len(terms) else np.zeros(0, np.int64)
        for k, (a, b) in enumerate(zip(low.tolist(), high.tolist())):
            if len(alive) <= FEW:
                return alive
            docs, impacts = self.docs[a:b], self.by_term_impacts[a:b]
            sums[docs] += weights[k] * impacts
            left[docs] -= impacts.astype(float) ** 2
            # Squares fall short of their true value by rounding at most.
            alive = alive[sums[alive] + rest[k] * np.sqrt(np.maximum(left[alive], 0) + 1e-9 * square[alive]) >= least * _SLACK]
        return alive


class _Best:
    """The k best rows so far of each query, and the score that a further one needs."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.least = k, least.copy()
        self.rows = [np.zeros((0, 3), np.int64) for _ in range(n)]  # score, id, row

    def add(self, q: int, found: np.ndarray) -> None:
        rows = np.concatenate([self.rows[q], found[found[:, 0] >= self.least[q]]])
        self.rows[q] = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))][: self.k]
        if len(self.rows[q]) == self.k:
            self.least[q] = max(self.least[q], self.rows[q][-1, 0])


_HIT = "item int, score long, key long, row long, no_id boolean"


def _search(queries, k: int, vocabulary: int, least: np.ndarray):
    """Of (key, row, no_id, length, terms, impacts), longest first: the task's k best rows of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = queries.value
        best, lengths = _Best(len(own.ids), k, least), own.lengths()
        weight_of, nameless = np.zeros(vocabulary, np.int64), set()
        for batch in batches:
            for at in range(0, batch.num_rows, BUCKET):
                part = batch.slice(at, BUCKET)
                keys, rows, no_id, size = (c.to_numpy(zero_copy_only=False) for c in part.columns[:4])
                terms, impacts = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in (4, 5))
                nameless.update(rows[no_id].tolist())
                bucket = Bucket(size, part.column(4).value_lengths().to_numpy(zero_copy_only=False), terms, impacts)
                for q in np.flatnonzero(lengths * size.max() >= best.least * _SLACK).tolist():
                    docs = bucket.survivors(own.terms[q], own.weights[q], int(best.least[q]))
                    if not len(docs):
                        continue
                    weight_of[own.terms[q]] = own.weights[q]
                    best.add(q, np.stack([bucket.scores(docs, weight_of), keys[docs], rows[docs]], axis=1))
                    weight_of[own.terms[q]] = 0
        found = np.concatenate([np.zeros((0, 3), np.int64), *best.rows])
        item = np.repeat(np.arange(len(own.ids), dtype=np.int32), [len(r) for r in best.rows])
        flags = np.array([r in nameless for r in found[:, 2].tolist()], bool)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (item, *np.ascontiguousarray(found.T), flags)], ["item", "score", "key", "row", "no_id"])

    return run


def _project(vocabulary):
    """Of (key, no_id, text): the number of terms, and the terms of the vocabulary with their occurrences."""
    ints = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            words = byte_words(batch.column(2))
            place = known.find(words)
            hit = place >= 0
            codes, times = np.unique(words.rows[hit] * max(1, known.size) + place[hit], return_counts=True)
            rows = codes // max(1, known.size)
            edges = pa.array(np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(x.astype(np.int32)), type=ints) for x in (codes % max(1, known.size), times)]
            n = pa.array(np.bincount(words.rows, minlength=batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, *lists], ["key", "no_id", "n", "terms", "times"])

    return run


def _item_blocks(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """The items as a written table with a block number each, so that a block is small enough to broadcast."""
    rows = items.select(F.col(id_col).alias("item_id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("item_row", F.monotonically_increasing_id())
    rows = materialize(rows, "items")
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // ITEMS), -(-size // ITEM_BYTES))
    return rows.withColumn("block", F.pmod(F.xxhash64("item_row"), F.lit(blocks)).cast("int")), blocks


def _terms(texts: list[str]) -> list[dict[bytes, int]]:
    """Terms of each text with their occurrences."""
    words = byte_words(pa.array(texts, pa.string()))
    found: list[dict[bytes, int]] = [{} for _ in texts]
    for k, row in enumerate(words.rows.tolist()):
        own, word = found[row], words.word(k)
        own[word] = own.get(word, 0) + 1
    return found


def _search_block(docs: DataFrame, block: list, k: int) -> DataFrame:
    """item_row, score, key, row, no_id: the k best rows and more for each item of a block."""
    spark = docs.sparkSession
    nothing = spark.createDataFrame([], "item_row long, score long, key long, row long, no_id boolean")
    if not block:
        return nothing
    terms = _terms([r["text"] for r in block])
    vocabulary = sorted(set().union(*terms))
    number = {w: i for i, w in enumerate(vocabulary)}
    known = spark.sparkContext.broadcast(Vocabulary(vocabulary))
    projected = materialize(docs.mapInArrow(_project(known), "key long, no_id boolean, n long, terms array<int>, times array<int>"), "document-terms")
    n_docs, length = projected.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return nothing
    # A document holds a term once; one row for each term of the block at most.
    held = projected.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).alias("w")
    weights = np.zeros(len(vocabulary), np.int64)
    for row in held.select("term", weight).collect():
        weights[row["term"]] = row["w"]
    by_item = []
    for own in terms:
        places = np.array([number[w] for w in own], np.int64)
        heavy = weights[places] * np.array(list(own.values()), np.int64)
        order = np.argsort(-heavy, kind="stable")
        by_item.append((places[order][heavy[order] > 0], heavy[order][heavy[order] > 0]))
    queries = spark.sparkContext.broadcast(Queries([r["item_row"] for r in block], *map(list, zip(*by_item))))

    m = F.lit(25) + F.expr(f"(75 * n * {n_docs}L) div {length}L")
    rows = projected.where(F.size("terms") > 0).withColumn("m", m)
    rows = rows.select("key", "no_id", F.monotonically_increasing_id().alias("row"), "terms", F.expr("transform(times, t -> cast((1000000000L * t) div (1000L * t + 8 * m) as int))").alias("impacts"))
    rows = rows.withColumn("length", F.sqrt(F.aggregate("impacts", F.lit(0.0), lambda s, x: s + x.cast("double") * x)))
    columns = ["key", "row", "no_id", "length", "terms", "impacts"]
    # Long vectors first; the hash deals equal lengths over several parts.
    parts = -(-n_docs // PART)
    ranged = rows.repartitionByRange(parts, F.desc("length"), F.xxhash64("row")).sortWithinPartitions(F.desc("length"))
    ordered = materialize(ranged.select(*columns, F.spark_partition_id().alias("part")), "norm-order")

    def found(some: DataFrame, least: np.ndarray) -> DataFrame:
        return some.select(*columns).mapInArrow(_search(queries, k, len(vocabulary), least), _HIT)

    # The longest vectors set the thresholds that all other parts start from.
    least = np.ones(len(block), np.int64)
    first = materialize(found(ordered.where("part = 0"), least), "first-hits")
    per_item = first.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    for row in per_item.where(F.col("n") >= k).collect():
        least[row["item"]] = row["least"]
    longest = queries.value.lengths()
    shortest = float((least * _SLACK / np.maximum(longest, 1e-9)).min())
    rest = found(ordered.where(F.col("part") > 0).where(F.col("length") >= shortest), least)
    names = spark.createDataFrame([(i, r["item_row"]) for i, r in enumerate(block)], "item int, item_row long")
    return first.unionByName(rest).join(F.broadcast(names), "item").drop("item")


def ranked_search(docs: DataFrame, items: DataFrame, *, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: for each item the `k` documents with the highest scores
    above 0, equal scores by ascending id.

    Items are searched in blocks of bounded size, each in one pass over the documents.
    Defined cases: null, empty and blank texts have no terms and are neither found nor
    counted; an item without terms finds nothing; rows that repeat an item id are items of
    their own (then ranks of that id repeat); rows that repeat a document id are documents
    of their own; null document ids come last among equal scores; very long texts are taken
    whole; an empty table on either side gives an empty table; other columns are ignored.
    """
    arrow_batches(docs.sparkSession)
    id_col, text_col = F.col(id_col), F.col(text_col)
    rows = docs.select(F.coalesce(id_col.cast("long"), F.lit((1 << 63) - 1)).alias("key"), id_col.isNull().alias("no_id"), text_col.alias("text"))
    asked, blocks = _item_blocks(items, item_id_col, item_text_col)
    hits = reduce(DataFrame.unionByName, [_search_block(rows, asked.where(F.col("block") == b).select("item_row", "text").collect(), k) for b in range(blocks)])
    order = Window.partitionBy("item_row").orderBy(F.desc("score"), "no_id", "key", "row")
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # Items are named again by their own table: at most k rows for each.
    return best.join(asked.select("item_row", "item_id"), "item_row").select("item_id", F.col("rank").cast("int").alias("rank"), F.when(~F.col("no_id"), F.col("key")).alias("doc_id"), "score")
