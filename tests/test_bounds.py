"""Room that pairs, candidates and queues take, and that nothing is left out for it."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalspark.operators import recommend, vectors


def _bytes(folder):
    return sum(os.path.getsize(f"{at}/{f}") for at, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))


def test_written_pairs_take_little_room(spark, tmp_path):
    """Items of a request come in an order that repeats itself within a page of a file."""
    catalog = spark.range(40_000).select(F.concat(F.lit("item_"), "id").alias("item_id"), F.lit("c").alias("item_category"), (900.0 + F.col("id") % 20).alias("price"), F.lit("b").alias("brand"), F.lit(True).alias("in_stock"))
    requests = spark.range(60).select(F.concat(F.lit("req_"), "id").alias("request_id"), F.lit(900.0).alias("price_min"), F.lit(950.0).alias("price_max"))
    recommend.filter_catalog(requests, catalog, parts=4).select("request_id", "item_id").write.parquet(f"{tmp_path}/pairs")
    pairs = spark.read.parquet(f"{tmp_path}/pairs")
    assert pairs.count() == pairs.distinct().count() == 2_400_000
    assert _bytes(f"{tmp_path}/pairs") < 0.6 * 2_400_000


def test_blocks_slices_and_chunks_lose_no_pair(spark, monkeypatch):
    """Repeated and null requests keep their pairs, whatever stands together on a row."""
    for name, size in (("SLICE_REQUESTS", 3), ("CHUNK_ITEMS", 4), ("BLOCK_REQUESTS", 7), ("PART_ITEMS", 50)):
        monkeypatch.setattr(recommend, name, size)
    items = [(f"i{k}", f"c{k % 3}" if k % 7 else None, float(k) if k % 11 else None, f"b{k % 4}", k % 5 != 0) for k in range(200)]
    asked = [(f"r{k}" if k % 9 else None, ["c1", "c1", "c2"] if k % 4 == 0 else None, ["b2"] if k % 3 == 0 else None, 20.0 if k % 5 else None, 150.0 if k % 2 else None, [None, True, False][k % 3]) for k in range(40)] * 2
    catalog = spark.createDataFrame(items, "item_id string, item_category string, price double, brand string, in_stock boolean")
    requests = spark.createDataFrame(asked, "request_id string, categories array<string>, brands array<string>, price_min double, price_max double, in_stock boolean")
    got = recommend.filter_catalog(requests, catalog, parts=2)
    assert got.columns == ["request_id", *catalog.columns]
    expected = [
        (r, i, c, p, b, s) for r, cs, bs, lo, hi, stock in asked for i, c, p, b, s in items
        if (cs is None or c in cs) and (bs is None or b in bs) and (lo is None or p is not None and p >= lo) and (hi is None or p is not None and p <= hi) and (not stock or s)
    ]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)


def _coded(spark, n=3000):
    """Vectors of 8 components with many copies, and codebooks of 4 parts by 16 codes."""
    rng = np.random.default_rng(4)
    rows = rng.standard_normal((n // 3, 8))[rng.integers(0, n // 3, n)]
    items = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "item_id long, embedding array<double>")
    centres = [(p, c, [float(x) for x in rng.standard_normal(2) / 2]) for p in range(4) for c in range(16)]
    books = spark.createDataFrame(centres, "part int, code int, centre array<double>")
    return rows / np.linalg.norm(rows, axis=1)[:, None], items, centres, books


def test_queries_move_without_their_products(spark, monkeypatch):
    """Shuffled are vectors and codes; the products with all centres are worked out in the groups."""
    monkeypatch.setattr(vectors, "PART_ITEMS", 100)
    unit, items, centres, books = _coded(spark)
    asked = items.where("item_id % 50 = 0").withColumnRenamed("item_id", "query_id")
    found = vectors.pq_search(vectors.encode_pq(items, books), books, asked, 20)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" not in plan and "book" not in plan
    book = np.array([c for *_, c in centres]).reshape(4, 16, 2)
    codes = np.stack([((unit[:, None, 2 * p : 2 * p + 2] - book[p]) ** 2).sum(2).argmin(1) for p in range(4)], 1)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.item_id, r.score))
    assert len(got) == 60
    for q, rows in got.items():
        score = sum((unit[q, 2 * p : 2 * p + 2] * book[p]).sum(1)[codes[:, p]] for p in range(4)).round(9)
        want = sorted(range(len(unit)), key=lambda i: (-score[i], i))[:20]
        assert [(i, round(s, 9)) for _, i, s in sorted(rows)] == [(i, score[i]) for i in want]


def test_reranked_candidates_carry_no_products(spark):
    """Neither the search before the re-ranking nor the join with the vectors."""
    unit, items, _, books = _coded(spark)
    asked = items.where("item_id % 50 = 0").withColumnRenamed("item_id", "query_id")
    best = vectors.rerank(vectors.pq_search(vectors.encode_pq(items, books), books, asked, len(unit)), items, asked, 5)
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" not in plan and "book" not in plan
    for r in best.collect():  # all are candidates: the exact order
        assert abs(np.sort(unit @ unit[r.query_id])[-r["rank"]] - r.score) < 1e-9


def test_few_parts_where_tasks_are_enough(spark):
    """Each part sends the best of each query: 4 parts for 4 tasks, not 49."""
    items, asked = spark.range(200_000).withColumnRenamed("id", "item_id"), spark.range(10).withColumnRenamed("id", "query_id")
    left, right = vectors._dealt(items, asked, "query_id", most=vectors.GROUP_ITEMS)
    assert left.count() == 200_000 and right.count() == 4 * 10


@pytest.mark.parametrize("k", [1, 7, 300])
def test_best_rows_in_chunks(monkeypatch, k):
    """As by sorting all: ties to the earlier row, NaN first."""
    monkeypatch.setattr(vectors, "PART_ITEMS", 16)
    rng = np.random.default_rng(k)
    table = rng.integers(0, 40, (200, 5)).astype(float)
    table[:, 1], table[:, 2], table[50:60, 3], table[:, 4] = np.arange(200), 1.0, np.nan, -np.inf
    rows, places, values = vectors._best_rows(table, np.arange(5), lambda x, q: x[:, q].T, k)
    for q in range(5):
        want = sorted(range(200), key=lambda i: (not np.isnan(table[i, q]), -np.nan_to_num(table[i, q]), i))[:k]
        assert list(places[rows == q]) == want and np.array_equal(values[rows == q], table[want, q], equal_nan=True)


def test_every_pending_operation_is_kept(spark):
    """A queue has no bound but the caller's, and batches are numbered by many tasks."""
    ops = spark.range(25_000).select(F.col("id").alias("seq"), F.lit("add").alias("op"), (F.col("id") * 7919 % 12_345).alias("item_id")).repartition(5)
    pending = vectors.pending_operations(ops)
    newest = {k * 7919 % 12_345: k for k in range(25_000)}
    order = sorted(newest, key=lambda i: (newest[i], -i))
    assert sorted((r.batch_id, r.seq, r.item_id) for r in pending.collect()) == [(k // 100, newest[i], i) for k, i in enumerate(order)]
    assert pending.columns == ["seq", "op", "item_id", "batch_id"] and "__part" in pending._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.seq for r in vectors.pending_operations(ops, cap=11).collect()) == list(range(24_989, 25_000))
