"""Views over the given tables that stand in for a recommender's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F


def mid():
    """The instant that parts reference from current rows."""
    return F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as user interactions with items, categories and daily sessions."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("user_no"), "ts", "event_type", "value", k.alias("k"))
    user = F.concat(F.lit("user_"), F.col("user_no").cast("string"))
    return e.select(
        "event_id", "user_no", "ts", "event_type", "value", "k", user.alias("user_id"),
        F.concat(F.lit("item_"), F.col("k").cast("string")).alias("item_id"),
        F.concat(F.lit("cat_"), (F.col("k") % 10).cast("string")).alias("item_category"),
        F.concat(user, F.lit("_"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("item_"), F.col("p_partkey").cast("string")).alias("item_id"),
        F.concat(F.lit("cat_"), (F.col("p_partkey") % 10).cast("string")).alias("item_category"),
        F.col("p_retailprice").cast("double").alias("price"), F.col("p_brand").alias("brand"), (F.col("p_size") % 5 != 0).alias("in_stock"),
    )


def feature_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long feature log; every eleventh row is written late."""
    return interactions(spark, sf_dir).select(
        F.when(F.col("event_id") % 11 == 0, F.col("event_id") + 100000000).otherwise(F.col("event_id")).alias("write_seq"),
        F.lit("user").alias("entity_type"), F.col("user_id").alias("entity_id"), F.concat(F.lit("last_"), "event_type").alias("feature_name"),
        F.col("value").cast("string").alias("value"), F.col("value").alias("num"), F.col("ts").alias("feature_ts"), F.col("event_id").alias("version"),
    )


def feature_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = feature_log(spark, sf_dir).where("feature_name <> 'last_error'").select(F.col("feature_name").alias("name")).distinct()
    return names.select("name", F.lit("user").alias("entity_type"), F.lit("numerical").alias("data_type"))


def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(spark, sf_dir).where("event_type = 'purchase'").select(F.col("event_id").alias("spine_id"), F.col("user_id").alias("entity_id"), F.col("ts").alias("as_of"))


def _state(spark: SparkSession, sf_dir: str, kept: str) -> DataFrame:
    newest = Window.partitionBy("user_id", "event_type").orderBy(F.desc("event_id"))
    rows = interactions(spark, sf_dir).where(kept).withColumn("rn", F.row_number().over(newest)).where("rn = 1")
    return rows.select(F.col("user_id").alias("entity_id"), F.concat(F.lit("last_"), "event_type").alias("feature_name"), F.col("event_id").alias("value"), F.col("ts").alias("feature_ts"))


def online_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir, "event_id % 3 <> 0 and user_no % 10 <> 0")


def offline_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir, "event_id % 4 <> 0 and user_no % 10 <> 1")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")


def index_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = items(spark, sf_dir).where("item_id % 7 = 0 or item_id % 11 = 0 or item_id % 13 = 0")
    op = F.when(F.col("item_id") % 7 == 0, "remove").when(F.col("item_id") % 11 == 0, "update").otherwise("add")
    return e.select(F.col("item_id").alias("seq"), op.alias("op"), F.when(op == "add", F.col("item_id") + 1000000).otherwise(F.col("item_id")).alias("item_id"), "embedding")


def train_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return l.join(o, l.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), F.col("o_orderdate").alias("event_ts"), F.col("l_quantity").cast("double").alias("rating")
    )


def item_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a category number; the few distinct types are ranked apart and joined."""
    part = table(spark, sf_dir, "part")
    types = part.select("p_type").distinct().withColumn("category_id", F.row_number().over(Window.orderBy("p_type")))
    return part.join(types, "p_type").select(F.col("p_partkey").alias("item_id"), "category_id", F.col("p_retailprice").cast("double").alias("price"), F.col("p_size").alias("size"))


def user_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").cast("double").alias("acctbal"), F.col("c_nationkey").alias("nation"))


def drift_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("ts") < mid(), "ref").otherwise("cur")
    i = interactions(spark, sf_dir).withColumn("side", side)
    shifted = F.when(F.col("side") == "ref", F.col("value")).otherwise(F.col("value") * F.lit(1.3))
    wide = i.select("side", "event_id", F.col("value"), F.col("k").cast("double").alias("k"), shifted.alias("value_shifted"))
    return wide.unpivot(["side", "event_id"], ["value", "k", "value_shifted"], "feature", "x").select("feature", "side", "event_id", "x")


def counter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of each event type, reset once."""
    w = Window.partitionBy("event_type", F.col("ts") < mid()).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return interactions(spark, sf_dir).select("ts", F.col("event_type").alias("metric"), F.count(F.lit(1)).over(w).alias("counter"))


def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    phase = F.when(F.col("ts") < at("2024-01-11 00:00:00"), "baseline").when(F.col("ts") < at("2024-01-21 00:00:00"), "incident").otherwise("recovery")
    return interactions(spark, sf_dir).select(phase.alias("phase"), "event_id", "event_type", "value")


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.when(F.col("event_type") == "error", 0.0).otherwise(1.0)
    return interactions(spark, sf_dir).groupBy((F.col("user_no") % 5).alias("rollout"), F.to_date("ts").alias("check_day")).agg(F.count(F.lit(1)).alias("n"), F.avg(ok).alias("success_rate"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = interactions(spark, sf_dir)
    r = i.groupBy("user_no", "user_id").agg(F.max(F.col("user_no") % 120).alias("num_recommendations"))
    return r.select(
        F.concat(F.lit("req_"), F.col("user_no").cast("string")).alias("request_id"), "user_id", "num_recommendations",
        F.concat(F.lit("cat_"), (F.col("user_no") % 10).cast("string")).alias("filter_category"), F.lit(900.0).alias("price_min"), F.lit(905.0).alias("price_max"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw JSON messages; every 97th is cut short."""
    i = interactions(spark, sf_dir)
    body = F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), "user_id", "session_id", "event_type", "item_id", "item_category"))
    return i.select(
        F.when(F.col("event_id") % 2 == 0, "rec.user-events").otherwise("rec.interaction-events").alias("topic"),
        (F.col("user_no") % 4).alias("partition_id"), F.col("event_id").alias("offset_id"), F.col("user_id").alias("msg_key"),
        F.when(F.col("event_id") % 97 == 0, '{"event_id":').otherwise(body).alias("msg_value"),
    )
