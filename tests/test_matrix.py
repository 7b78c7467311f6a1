"""The similarity matrix: compiled products, odd vectors and rounding."""

import math
import random
import re

import pytest

from pyspark.sql import functions as F

from signalspark.functions.scalars import rounded_number
from signalspark.functions.vectors import dot
from signalspark.operators import training
from signalspark.plans import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_products_are_compiled_and_short_enough_for_the_jvm(spark):
    """Not by a lambda for each component of each pair; the JVM compiles methods of up to 8000 bytes."""
    plan = QUERIES["g14_similarity_matrix"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan and "zip_with(" not in plan
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        query = QUERIES["g14_similarity_matrix"](spark, FOLDER)._jdf.queryExecution()
        code = spark.sparkContext._jvm.PythonSQLUtils.explainString(query, "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    joined = [tree for tree in re.split(r"== Subtree", code) if re.search(r"^\S*\*\(\d+\) Project .*\n\S* *\+- \*\(\d+\) Project .*\n\s*\+- \*\(\d+\) ShuffledHashJoin", tree, re.M)]
    assert joined and all(int(n) < 8000 for n in re.findall(r"maxMethodCodeSize:(\d+)", code))


@pytest.mark.parametrize("width", [3, 46, 47, 64, 65])
def test_scores_are_those_of_dot(spark, width, monkeypatch):
    """For all numbers of columns, several blocks and parts, and vectors that are null, empty,
    shorter, or hold a null, NaN or infinity."""
    monkeypatch.setattr(training, "USERS_OF_BLOCK", 7)
    monkeypatch.setattr(training, "ITEMS_OF_PART", 2)
    rng = random.Random(width)
    vectors = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(30)]
    odd = [None, [], vectors[0][:-1], vectors[1][:-1], [None] + vectors[0][1:], vectors[0][:-1] + [None], [math.nan] + vectors[0][1:], vectors[0][:-1] + [math.inf], [-0.0] * width]
    items = spark.createDataFrame(list(enumerate(vectors + odd)) + [(0, vectors[5])], "item_id long, embedding array<double>")
    users = items.select(F.col("item_id").alias("user_id"), "embedding")
    made = training.similarity_matrix(users, items)
    plain = users.withColumnRenamed("embedding", "u").crossJoin(items).select("user_id", "item_id", (dot(F.col("u"), F.col("embedding")) / 0.1).alias("score"))
    rows = lambda df: sorted(tuple(map(repr, r)) for r in df.collect())
    assert rows(made) == rows(plain) and made.count() == 40 * 40


def test_matrix_of_no_rows(spark):
    none = spark.createDataFrame([], "item_id long, embedding array<double>")
    assert training.similarity_matrix(none.withColumnRenamed("item_id", "user_id"), none).collect() == []


def test_rounded_number_is_round(spark):
    rng = random.Random(7)
    some = [rng.gauss(0, 10 ** rng.randint(-8, 14)) for _ in range(3000)]
    ties = [(rng.randint(-10**7, 10**7) + 0.5) / 10**6 for _ in range(3000)]
    odd = [None, 0.0, -0.0, -1e-9, math.nan, math.inf, -math.inf, 5e-7, -5e-7, 1.0000005, 2.5e-6, 1e300, 4503599627.370497]
    rows = spark.createDataFrame([(x,) for x in some + ties + [math.nextafter(x, 9) for x in ties] + odd], "x double").select(rounded_number(F.col("x")).alias("a"), F.round("x", 6).alias("b"))
    assert [repr(r.a) for r in rows.collect()] == [repr(r.b) for r in rows.collect()]
