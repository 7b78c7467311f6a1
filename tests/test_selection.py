"""Exact quantiles, digests of stores and committed versions."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalspark.operators import quantiles, recommend, sync, vectors
from signalspark.plans import QUERIES

FOLDER = "/root/testdata/sf0.001"
QS = (0.0, 0.25, 0.5, 0.95, 0.99, 1.0)


def _same(a, b):
    return (a is None and b is None) or (math.isnan(a) and math.isnan(b)) or a == b or math.isclose(a, b, rel_tol=1e-12)


@pytest.mark.parametrize("half", [quantiles.HALF, 0.0])
def test_exact_quantiles(spark, monkeypatch, half):
    """Also where brackets miss: half a bracket of 0 leaves single values."""
    monkeypatch.setattr(quantiles, "HALF", half)
    rng = random.Random(8)
    values = {"hot": [rng.lognormvariate(0, 2) for _ in range(20_000)], "ties": [float(rng.randint(0, 2)) for _ in range(3000)], "one": [4.0], "two": [1.0, 2.0], None: [3.0, -1.0, 0.5], "none": [], "inf": [math.inf, -math.inf, 1.0], "nan": [1.0, math.nan, 2.0, math.nan]}
    rows = [(k, 1, v) for k, own in values.items() for v in own] + [("hot", 1, None), ("none", 1, None)]
    got = quantiles.exact_quantiles(spark.createDataFrame(rows, "k string, i int, v double").repartition(6), ["k"], "v", QS).collect()
    assert {r.k for r in got} == set(values) - {"none"}
    for r in got:
        own = sorted(values[r.k], key=lambda v: (math.isnan(v), v))
        for i, q in enumerate(QS):
            place = q * (len(own) - 1)
            a, b = own[math.floor(place)], own[math.ceil(place)]
            assert _same(r[f"q{i}"], a if a == b else (1 - place + math.floor(place)) * a + (place - math.floor(place)) * b), (r, i)
    assert quantiles.exact_quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", QS).count() == 0


@pytest.mark.parametrize("name", ["c8_feature_statistics", "i8_request_metrics", "f15_benchmark_report"])
def test_no_group_is_held_in_a_buffer(spark, name):
    assert not re.search("percentile", QUERIES[name](spark, FOLDER)._jdf.queryExecution().toString())


def _store(spark, rows):
    return spark.createDataFrame([(e, f, v, t) for e, f, v, t in rows], "entity_id string, feature_name string, value string, feature_ts long").repartition(3)


def test_equal_stores_read_digests_only(spark, tmp_path):
    rows = [(f"u{k}", f"f{k % 3}", str(k), k) for k in range(3000)]
    other = list(reversed([(e, f, v, t + 1) for e, f, v, t in rows])) + [("u9", "none", None, 1)]
    for name, own in (("a", rows), ("b", other)):
        sync.write_store(_store(spark, own), str(tmp_path / name))
    assert sync.differing_leaves(spark, str(tmp_path / "a"), str(tmp_path / "b")) == []
    out = sync.diff_written_stores(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert out.count() == 0 and out.inputFiles() == []


def test_only_differing_buckets_are_read(spark, tmp_path):
    rows = {(f"u{k}", f"f{k % 3}"): (str(k), k) for k in range(5000)}
    other = dict(rows)
    other["u7", "f1"] = ("changed", 9)
    del other["u8", "f2"]
    other["new", None] = ("x", 1)
    frames = [_store(spark, [(*k, *v) for k, v in own.items()]) for own in (rows, other)]
    for name, df in zip("ab", frames):
        sync.write_store(df, str(tmp_path / name))
    differ = sync.differing_leaves(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert len(differ) == 3
    out = sync.diff_written_stores(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan
    got = {(r.entity_id, r.feature_name): (r.status, r.online_value, r.offline_value) for r in out.collect()}
    assert got == {("u7", "f1"): ("conflict", "7", "changed"), ("u8", "f2"): ("online_only", "8", None), ("new", None): ("offline_only", None, "x")}
    sync.write_store(frames[0].limit(0), str(tmp_path / "empty"))
    assert sync.diff_written_stores(spark, str(tmp_path / "a"), str(tmp_path / "empty")).count() == 5000


def test_a_version_is_published_once(spark, tmp_path):
    index = spark.createDataFrame([(1, 0), (2, 1)], "item_id long, cell int")
    root = str(tmp_path / "index")
    vectors.publish_index(index, root, 1)
    vectors.publish_index(index.limit(1), root, 10)
    with pytest.raises(ValueError):
        vectors.publish_index(index, root, 10)
    assert vectors.load_latest_index(spark, root).count() == 1
    assert len(list((tmp_path / "index").glob("index_10-*"))) == 1


def test_report_is_written_twice(spark, tmp_path):
    rows = spark.createDataFrame([("a", float(x), 0.9, 10.0) for x in range(100)] + [("b", 5.0, 0.8, 1.0)], "config string, latency_ms double, recall_10 double, size_mb double")
    report = vectors.benchmark_report(rows)
    vectors.write_report(report, str(tmp_path))
    a, b = (sorted(map(str, df.select("config", F.col("p50_ms").cast("double"), F.col("best_size").cast("boolean")).collect())) for df in (spark.read.json(str(tmp_path / "json")), spark.read.option("header", True).csv(str(tmp_path / "csv"))))
    assert a == b and len(a) == 2 and np.isclose(report.where("config = 'a'").first().p50_ms, 49.5)


def test_filtered_pairs_are_not_shuffled(spark):
    """One join, in parts of a category or brand; requests bring their filters along."""
    items = [(f"i{k}", f"c{k % 3}", float(k), f"b{k % 4}", k % 5 != 0) for k in range(300)]
    catalog = spark.createDataFrame(items, "item_id string, item_category string, price double, brand string, in_stock boolean")
    asked = [("a", ["c0", "c0", None], None, None, None, True), ("b", None, ["b1", "b2"], None, 50.0, None), ("c", None, None, 10.0, 90.0, False), ("d", None, None, 290.0, None, None), ("e", ["c1"], ["b1"], 5.0, 200.0, None), ("f", None, None, 9.0, 3.0, None)]
    requests = spark.createDataFrame(asked, "request_id string, categories array<string>, brands array<string>, price_min double, price_max double, in_stock boolean")
    out = recommend.filter_catalog(requests, catalog)
    expected = [
        (r, i) for r, cs, bs, lo, hi, stock in asked for i, c, p, b, s in items
        if (cs is None or c in cs) and (bs is None or b in bs) and (lo is None or p >= lo) and (hi is None or p <= hi) and (not stock or s)
    ]
    assert sorted((r.request_id, r.item_id) for r in out.collect()) == sorted(expected)
    plan = recommend.filter_catalog(requests.drop("categories", "price_min", "in_stock"), catalog)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join[^\n]*request_id", plan) and "__part" in plan


def test_pending_operations_of_one_seq(spark):
    """Two operations may bear one seq: the order of items decides, wherever the rows stand."""
    rows = [(k // 2, "add" if k % 2 else "remove", k) for k in range(400)]
    found = []
    for parts in (1, 7):
        ops = spark.createDataFrame(sorted(rows, key=lambda r: r[2] * 37 % 401 * (parts - 4)), "seq long, op string, item_id long").repartition(parts)
        found.append({(r.item_id, r.batch_id) for r in vectors.pending_operations(ops, cap=301, batch=25).collect()})
    kept = sorted(rows, key=lambda r: (-r[0], r[2]))[:301]
    assert found[0] == found[1] == {(r[2], k // 25) for k, r in enumerate(reversed(kept))}


def test_a_length_is_worked_out_once(spark):
    from signalspark.functions.vectors import unit

    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>").select(unit(F.col("v")).alias("u"))
    assert [r.u for r in df.collect()] == [[0.6, 0.8], None, None]
    assert df._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1


def test_candidates_of_a_group_are_no_rows(spark):
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 1) for _ in range(4)] if k % 97 else [0.0] * 4, k % 3 if k % 50 else None) for k in range(1500)]
    items = spark.createDataFrame(rows, "item_id long, embedding array<double>, label int")
    asked = items.where("item_id % 31 = 0").withColumnRenamed("item_id", "query_id")
    pairs = asked.select("query_id", "label").join(items.select("item_id", "label"), "label").select("query_id", "item_id")
    got, want = (sorted((r.query_id, r.rank, r.item_id) for r in x.collect()) for x in (vectors.rerank_groups(items, asked, "label", 7), vectors.rerank(pairs, items.where("item_id % 97 <> 0"), asked.where("query_id % 97 <> 0"), 7)))
    assert got == want and len(got) > 300
    plan = QUERIES["f7_rerank"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and "__chunk" in plan


def test_the_last_words_of_a_long_url_are_mined(spark):
    from signalspark.llm import url_filters

    rows = [("http://a.b/" + "/".join(f"w{k}x{i}" for i in range(90)) + ("/evil" if k % 2 else ""), bool(k % 2)) for k in range(60)]
    found, counts = url_filters.mine_rules(spark.createDataFrame(rows, "url string, bad boolean"))
    assert counts["p:evil"] == 30 and ["p:evil"] in [r.tokens for r in found.collect()]
