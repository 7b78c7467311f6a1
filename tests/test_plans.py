"""Shapes of the physical plans that matter at scale."""

import re

import pytest

from pyspark.sql import functions as F

from signalspark.operators import vectors
from signalspark.plans import QUERIES

FOLDER = "/root/testdata/sf0.001"
#: Trailing windows and products of vectors in Arrow, greedy folds, streams, models and what writes a table first.
NOT_PURE = re.compile(r"b[1239]_|f2_|f8_|b13|h10|h13|h14|_stream|^a1_|a10|^b1[67]|^d9|^f[3-6]_|f7_rerank_q|f8_recall_of|f14|g12|g2_|g9|g10|g11")


def _plan(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, shuffles", [("b1_trailing_aggregates", 1), ("b2_all_trailing_aggregates", 1), ("b3_capped_window", 1), ("b6_session_features", 1), ("b9_user_features", 2), ("c6_point_in_time_join", 1)])
def test_one_shuffle_per_entity(spark, name, shuffles):
    """By entity, or by entity and slab of time; sessions need the whole entity once more."""
    plan = _plan(spark, name)
    assert plan.count("Exchange hashpartitioning") == shuffles and "Join" not in plan


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not NOT_PURE.search(n)))
def test_no_python_and_no_cartesian_product(spark, name):
    plan = _plan(spark, name)
    assert not re.search("InPandas|InArrow|PythonUDF|ArrowEvalPython|CartesianProduct", plan)


def test_columns_and_filters_reach_the_scan(spark):
    plan = _plan(spark, "e1_diff_stores")
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in plan  # no ts, value or props
    assert "IsNotNull(user_id)" in plan


def test_top_k_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in _plan(spark, "c13_cap_versions")
    assert "TakeOrderedAndProject" in _plan(spark, "b10_popular_items")


def test_items_are_not_copied_for_few_queries(spark):
    items = spark.range(10_000).select(F.col("id").alias("item_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    left, right = vectors._dealt(items, items.limit(1000).select(F.col("item_id").alias("query_id")), "query_id")
    assert left.count() == 10_000 and right.count() == 3 * 1000
    assert left.groupBy("__part").count().agg(F.max("count")).first()[0] < 1.2 * vectors.PART_ITEMS


@pytest.mark.parametrize("name, contracts", [("a2_decode_events", 1), ("a4_validate_contracts", 4), ("a5_dead_letters", 1)])
def test_a_message_is_parsed_once(spark, name, contracts):
    """Not once for each field that a reason names."""
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == contracts
