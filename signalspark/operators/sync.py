"""Reconciliation of an online and an offline feature store (E)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.commits import commit_text, read_text

STRATEGIES = ("online_wins", "offline_wins", "timestamp")


def diff_stores(online: DataFrame, offline: DataFrame, only: Column | None = None) -> DataFrame:
    """Per (entity, feature): online_only, offline_only, equal or conflict, with both values
    and times.  A null value counts as missing; `only` restricts both sides first."""
    if only is not None:
        online, offline = online.where(only), offline.where(only)
    side = lambda df, p: df.where(F.col("value").isNotNull()).select("entity_id", "feature_name", F.col("value").alias(f"{p}_value"), F.col("feature_ts").alias(f"{p}_ts"))
    both = side(online, "online").join(side(offline, "offline"), ["entity_id", "feature_name"], "full_outer")
    status = (
        F.when(F.col("offline_value").isNull(), "online_only").when(F.col("online_value").isNull(), "offline_only")
        .when(F.col("online_value") == F.col("offline_value"), "equal").otherwise("conflict")
    )
    return both.withColumn("status", status)


def resolve(diff: DataFrame, strategy: str = "timestamp") -> DataFrame:
    """Add winner, value, feature_ts: the side that holds the value, or wins the conflict.
    By timestamp the online side wins only if strictly newer."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    conflict = {"online_wins": F.lit("online"), "offline_wins": F.lit("offline"), "timestamp": F.when(F.col("online_ts") > F.col("offline_ts"), "online").otherwise("offline")}[strategy]
    winner = F.when(F.col("status") == "online_only", "online").when(F.col("status") == "offline_only", "offline").when(F.col("status") == "conflict", conflict)
    pick = lambda c: F.when(F.col("winner") == "online", F.col(f"online_{c}")).when(F.col("winner") == "offline", F.col(f"offline_{c}"))
    return diff.withColumn("winner", winner).select("*", pick("value").alias("value"), pick("ts").alias("feature_ts"))


def sync_writes(resolved: DataFrame, bidirectional: bool = True) -> DataFrame:
    """Writes that bring the stores together: target, entity_id, feature_name, value, feature_ts.
    Both stores are written if bidirectional, else the offline one; equal pairs need none."""
    targets = F.array(*[F.lit(t) for t in (("offline", "online") if bidirectional else ("offline",))])
    rows = resolved.where(F.col("winner").isNotNull()).select(F.explode(targets).alias("target"), "entity_id", "feature_name", "value", "feature_ts", "winner", "status")
    return rows.where(~((F.col("target") == F.col("winner")) & (F.col("status") != "conflict"))).drop("winner", "status")


def sync_metrics(diff: DataFrame, *, type_col: str = "entity_type") -> DataFrame:
    """Entities, features, synced features, conflicts and missing sides by entity type, and a total row."""
    measures = [
        F.count_distinct("entity_id").alias("entities"), F.count(F.lit(1)).alias("features"), F.count_if(F.col("status") != "equal").alias("synced"),
        F.count_if(F.col("status") == "conflict").alias("conflicts"), F.count_if(F.col("status").isin("online_only", "offline_only")).alias("missing"),
    ]
    return diff.groupBy(type_col).agg(*measures).unionByName(diff.agg(*measures).withColumn(type_col, F.lit("total")))


def write_store(store: DataFrame, path: str, *, buckets: int = 64, leaves: int = 64) -> None:
    """Write a store (entity_id, feature_name, value, feature_ts) in buckets of its key, with a
    hash tree of two levels: a digest for each bucket, and for each leaf of a bucket.

    Digests follow the set of keys and values, in any order; two stores are compared by
    those of equal `buckets` and `leaves`, which bound the tree whatever the store's size.
    """
    key = F.xxhash64("entity_id", "feature_name")
    rows = store.where(F.col("value").isNotNull()).select("entity_id", "feature_name", "value", "feature_ts")
    rows = rows.withColumns({"bucket": F.pmod(key, F.lit(buckets)).cast("int"), "leaf": F.pmod(F.shiftright(key, 32), F.lit(leaves)).cast("int")})
    rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "leaf").write.partitionBy("bucket").parquet(f"{path}/rows")
    each = F.xxhash64("entity_id", "feature_name", F.col("value").cast("string"))
    other = F.xxhash64(F.lit(1), "entity_id", "feature_name", F.col("value").cast("string"))
    spark = store.sparkSession
    commit_text(spark, f"{path}/schema", rows.schema.json())
    by_leaf = _rows(spark, path).groupBy("bucket", "leaf").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(each).alias("a"), F.bit_xor(other).alias("b"))
    by_leaf.coalesce(1).write.parquet(f"{path}/leaves")
    digest = F.xxhash64(F.array_sort(F.collect_list(F.struct("leaf", "n", "a", "b"))))
    spark.read.schema(_LEVELS["leaves"]).parquet(f"{path}/leaves").groupBy("bucket").agg(digest.alias("digest")).coalesce(1).write.parquet(f"{path}/buckets")


_LEVELS = {"leaves": "bucket int, leaf int, n long, a long, b long", "buckets": "bucket int, digest long"}


def _rows(spark: SparkSession, path: str) -> DataFrame:
    schema = StructType.fromJson(json.loads(read_text(spark, f"{path}/schema")))
    return spark.read.schema(schema).parquet(f"{path}/rows")


def differing_leaves(spark: SparkSession, online: str, offline: str) -> list[tuple[int, int]]:
    """(bucket, leaf) that differ between two written stores: leaves are read only of the
    buckets that do."""

    def unequal(level: str, keys: list[str], values: list[str], buckets: list[int] | None) -> list:
        sides = []
        for path, side in ((online, "x"), (offline, "y")):
            rows = spark.read.schema(_LEVELS[level]).parquet(f"{path}/{level}")
            if buckets is not None:
                rows = rows.where(F.col("bucket").isin(buckets))
            sides.append(rows.select(*keys, F.struct(*values).alias(side)))
        return sides[0].join(sides[1], keys, "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select(*keys).collect()

    buckets = sorted(r["bucket"] for r in unequal("buckets", ["bucket"], ["digest"], None))
    return sorted((r["bucket"], r["leaf"]) for r in unequal("leaves", ["bucket", "leaf"], ["n", "a", "b"], buckets)) if buckets else []


def diff_written_stores(spark: SparkSession, online: str, offline: str) -> DataFrame:
    """`diff_stores` of two written stores without their equal pairs: only buckets that hold a
    differing leaf are read, and only rows of such leaves are joined."""
    differ = differing_leaves(spark, online, offline)
    # No more leaves than the tree has.
    marked = spark.createDataFrame(differ, "bucket int, leaf int")

    def side(path: str) -> DataFrame:
        rows = _rows(spark, path).where(F.col("bucket").isin(sorted({b for b, _ in differ})) if differ else F.lit(False))
        return rows.join(F.broadcast(marked), ["bucket", "leaf"], "left_semi")

    return diff_stores(side(online), side(offline)).where(F.col("status") != "equal")
