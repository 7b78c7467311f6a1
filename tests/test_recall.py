"""Recall of the index searches against exact search on their own query sets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalspark.operators import vectors
from signalspark.plans import QUERIES
from signalspark.plans.vectors import _queries
from signalspark.sources import fixtures

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, k", [("f4_ivf_search", 10), ("f6_pq_search", 100), ("f7_rerank_quantized", 10)])
def test_recall_against_brute_force(spark, name, k):
    items = fixtures.items(spark, FOLDER)
    truth = vectors.exact_topk(items, _queries(items), k)
    assert vectors.recall_at_k(truth, QUERIES[name](spark, FOLDER), (k,)).first().recall >= 0.9


def test_reported_recall_of_ivf(spark):
    assert {r.k: r.recall for r in QUERIES["f8_recall_of_ivf"](spark, FOLDER).collect()}[10] >= 0.9


def test_large_cells_are_split(spark):
    """A third of all vectors lies in one place and another third is one vector."""
    rng = np.random.default_rng(3)
    near = rng.standard_normal(16) + 0.05 * rng.standard_normal((2000, 16))
    rows = np.concatenate([near, np.repeat(rng.standard_normal((1, 16)), 2000, axis=0), rng.standard_normal((2000, 16))])
    items = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "item_id long, embedding array<double>")
    index, centroids = vectors.build_ivf(items, nlist=60)
    sizes = sorted((r.n for r in index.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    assert sum(sizes) == 6000 and sizes[0] == 2000 and sizes[1] <= vectors.CELL_SIZE * 6000 // 60  # copies cannot be told apart
    assert centroids.count() <= 120 and not index.join(centroids, "cell", "left_anti").count()
    asked = items.where("item_id % 300 = 7").select(F.col("item_id").alias("query_id"), "embedding")
    truth, found = vectors.exact_topk(items, asked, 10), vectors.ivf_search(index, centroids, asked, 10, nprobe=20)
    assert vectors.recall_at_k(truth, found, (10,)).first().recall >= 0.9
