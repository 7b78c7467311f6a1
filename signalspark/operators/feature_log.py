"""Versioned feature log: registry, writes, point-in-time reads, history, retention (C).

A log row has entity_type, entity_id, feature_name, value (string), feature_ts, version
and write_seq, the order of writing.  The active row of a key is the last written one;
point-in-time reads follow feature_ts instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles
from .slabs import with_halo

KEY = ["entity_type", "entity_id", "feature_name"]


def register_features(defs: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registry, refused): the first definition of a name wins.

    `new` may have a column seq that orders its rows.
    """
    order = F.col("seq") if "seq" in new.columns else F.lit(0)
    columns = defs.columns
    both = defs.select("*", F.lit(0).alias("__new"), F.lit(0).cast("long").alias("__seq")).unionByName(new.select(*columns, F.lit(1).alias("__new"), order.cast("long").alias("__seq")))
    first = Window.partitionBy("name").orderBy("__new", "__seq", *[c for c in columns if c != "name"])
    ranked = both.withColumn("__n", F.row_number().over(first))
    return ranked.where("__n = 1").select(*columns), ranked.where("__n > 1 and __new = 1").select(*columns)


def registered_only(log: DataFrame, defs: DataFrame) -> DataFrame:
    """Rows of registered features."""
    return log.join(defs.select(F.col("name").alias("feature_name")), "feature_name", "left_semi")


def with_active(log: DataFrame) -> DataFrame:
    """Add is_active: whether a row is the last written of its key."""
    last = Window.partitionBy(*KEY).orderBy(F.desc("write_seq"))
    return log.withColumn("is_active", F.row_number().over(last) == 1)


def write_features(log: DataFrame, batch: DataFrame, defs: DataFrame) -> DataFrame:
    """The log with the registered rows of `batch` appended, and is_active.

    Rows without a version get the epoch seconds of their time; without a write_seq they
    follow the log's last one in order of time.
    """
    rows = registered_only(batch, defs)
    version = F.unix_seconds(F.col("feature_ts").cast("timestamp"))
    rows = rows.withColumn("version", F.coalesce(F.col("version"), version) if "version" in rows.columns else version)
    if "write_seq" not in rows.columns:
        last = log.agg(F.coalesce(F.max("write_seq"), F.lit(0)).alias("last"))
        # Unique and ordered by time within a key, which is all that "last written" needs.
        nth = F.row_number().over(Window.partitionBy(*KEY).orderBy("feature_ts", "version"))
        rows = rows.withColumn("nth", nth.cast("long")).join(F.broadcast(last)).withColumn("write_seq", F.col("last") + F.col("nth")).drop("nth", "last")
    return with_active(log.select(*KEY, "value", "feature_ts", "version", "write_seq").unionByName(rows.select(*KEY, "value", "feature_ts", "version", "write_seq")))


def _last_written(log: DataFrame, *values: str) -> DataFrame:
    """One row per key with the values of the last written row."""
    return log.groupBy(*KEY).agg(F.max_by(F.struct(*values), "write_seq").alias("last")).select(*KEY, "last.*")


def current_features(log: DataFrame, entities: DataFrame | None = None, names: list[str] | None = None) -> DataFrame:
    """Active values of the given entities (column entity_id) and feature names."""
    rows = log.where(F.col("feature_name").isin(names)) if names is not None else log
    if entities is not None:
        rows = rows.join(entities.select("entity_id").distinct(), "entity_id", "left_semi")
    return _last_written(rows, "value", "feature_ts", "version")


def features_at(log: DataFrame, at: Column, *, mode: str = "active") -> DataFrame:
    """Values at an instant: the active row if it is not newer (mode active), or the
    newest row up to then (mode history)."""
    if mode == "active":
        return _last_written(log, "value", "feature_ts", "version").where(F.col("feature_ts") <= at)
    if mode != "history":
        raise ValueError(f"unknown mode: {mode}")
    best = F.max_by(F.struct("value", "feature_ts", "version"), F.struct("feature_ts", "write_seq")).alias("last")
    return log.where(F.col("feature_ts") <= at).groupBy(*KEY).agg(best).select(*KEY, "last.*")


def point_in_time_join(spine: DataFrame, log: DataFrame, names: list[str], *, lookback: str = "30 days") -> DataFrame:
    """For each spine row (spine_id, entity_id, as_of) the newest value of every feature
    with feature_ts <= as_of and no older than `lookback`; null if there is none.

    Spine and log are united and sorted once per entity and slab of time; a slab also holds
    the log rows within the lookback before it, so that a hot entity is many tasks.  Each
    feature's last value is carried forward.  Among equal times the last written row wins,
    and log rows come before the spine row.  No range join.
    """
    reach = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', timestamp_ntz'1970-01-01' + INTERVAL {lookback})")
    log = log.where(F.col("feature_name").isin(names))
    stamped = F.struct(F.col("value"), F.col("feature_ts"))
    rows = log.select("entity_id", F.col("feature_ts").alias("t"), F.lit(0).alias("side"), F.col("write_seq").alias("seq"), F.lit(None).cast("long").alias("spine_id"), *[F.when(F.col("feature_name") == n, stamped).alias(n) for n in names])
    empty = [F.lit(None).cast(rows.schema[n].dataType).alias(n) for n in names]
    asked = spine.select("entity_id", F.col("as_of").alias("t"), F.lit(1).alias("side"), F.lit(0).cast("long").alias("seq"), F.col("spine_id").cast("long").alias("spine_id"), *empty)
    order = Window.partitionBy("entity_id", "slab").orderBy("t", "side", "seq").rowsBetween(Window.unboundedPreceding, 0)
    dealt = with_halo(rows.unionByName(asked), "t", reach).where("side = 0 or not halo")
    carried = dealt.select("entity_id", "t", "side", "spine_id", *[F.last(n, ignorenulls=True).over(order).alias(n) for n in names])
    fresh = [F.when(F.col(n)["feature_ts"] >= F.col("t") - F.expr(f"INTERVAL {lookback}"), F.col(n)["value"]).alias(n) for n in names]
    return carried.where("side = 1").select("spine_id", "entity_id", F.col("t").alias("as_of"), *fresh)


def historical_features(log: DataFrame, names: list[str], start: Column, end: Column, entity_id: str | None = None) -> DataFrame:
    """All versions in [start, end] as columns, one row per entity and time."""
    rows = log.where(F.col("feature_name").isin(names) & F.col("feature_ts").between(start, end))
    if entity_id is not None:
        rows = rows.where(F.col("entity_id") == entity_id)
    firsts = [F.min_by("value", F.when(F.col("feature_name") == n, F.col("write_seq"))).alias(n) for n in names]
    return rows.groupBy("entity_type", "entity_id", "feature_ts").agg(*firsts)


def feature_statistics(log: DataFrame, names: list[str] | None = None, *, entity_type: str | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Statistics of the active values per feature; without a numeric value only the count.

    `entity_type` and the closed time range [start, end] choose among the active rows.
    """
    x = F.col("value").try_cast("double")
    rows = _last_written(log if names is None else log.where(F.col("feature_name").isin(names)), "value", "feature_ts").withColumn("x", x)
    if entity_type is not None:
        rows = rows.where(F.col("entity_type") == entity_type)
    if start is not None:
        rows = rows.where(F.col("feature_ts") >= start)
    if end is not None:
        rows = rows.where(F.col("feature_ts") <= end)
    stats = rows.groupBy("feature_name").agg(F.count(F.lit(1)).alias("n_rows"), F.count("x").alias("n_values"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    quantiles = exact_quantiles(rows, ["feature_name"], "x", (0.25, 0.5, 0.75)).withColumnRenamed("feature_name", "f")
    both = stats.join(quantiles, F.col("feature_name").eqNullSafe(F.col("f")), "left")
    return both.select("feature_name", "n_rows", "n_values", "mean", "std", "min", "max", F.col("q1").alias("median"), F.col("q0").alias("q25"), F.col("q2").alias("q75"))


def write_export(exported: DataFrame, path: str) -> DataFrame:
    """Write an export as Parquet to `path` and read it back."""
    exported.write.mode("overwrite").parquet(path)
    return exported.sparkSession.read.parquet(path)


def export_features(log: DataFrame, names: list[str], *, start: Column | None = None, end: Column | None = None, entity_type: str = "user") -> DataFrame:
    """Active rows of an entity type as a wide table: entity_id, feature_ts, a column per feature."""
    rows = _last_written(log.where((F.col("entity_type") == entity_type) & F.col("feature_name").isin(names)), "value", "feature_ts")
    if start is not None:
        rows = rows.where(F.col("feature_ts") >= start)
    if end is not None:
        rows = rows.where(F.col("feature_ts") <= end)
    return rows.groupBy("entity_id", "feature_ts").pivot("feature_name", names).agg(F.first("value", ignorenulls=True))


def import_features(wide: DataFrame, entity_type: str, id_col: str, ts_col: str) -> DataFrame:
    """A wide table as log rows; nulls are dropped, ids and values become strings."""
    names = [c for c in wide.columns if c not in (id_col, ts_col)]
    text = wide.select(F.col(id_col).cast("string").alias("entity_id"), F.col(ts_col).alias("feature_ts"), *[F.col(c).cast("string").alias(c) for c in names])
    long = text.unpivot(["entity_id", "feature_ts"], names, "feature_name", "value").where(F.col("value").isNotNull())
    return long.select(F.lit(entity_type).alias("entity_type"), "entity_id", "feature_name", "value", "feature_ts", F.unix_seconds(F.col("feature_ts").cast("timestamp")).alias("version"))


def retain(log: DataFrame, cutoff: Column) -> DataFrame:
    """The log without inactive rows older than `cutoff`."""
    return with_active(log).where(F.col("is_active") | (F.col("feature_ts") >= cutoff)).drop("is_active")


def retained_counts(log: DataFrame, cutoff: Column) -> DataFrame:
    """One row: rows that `retain` keeps and deletes."""
    gone = ~F.col("is_active") & (F.col("feature_ts") < cutoff)
    return with_active(log).agg(F.count_if(~gone).alias("kept"), F.count_if(gone).alias("deleted"))


def store_stats(log: DataFrame, defs: DataFrame) -> DataFrame:
    """Definitions, values, active values, entity types, first and last time."""
    one = log.agg(F.count(F.lit(1)).alias("n_values"), F.count_distinct("entity_type").alias("n_entity_types"), F.min("feature_ts").alias("first_ts"), F.max("feature_ts").alias("last_ts"))
    active = log.select(*KEY).distinct().agg(F.count(F.lit(1)).alias("n_active"))
    return one.join(active).join(defs.agg(F.count(F.lit(1)).alias("n_definitions")))


def cap_versions(log: DataFrame, n: int = 10) -> DataFrame:
    """The newest `n` versions of each key."""
    newest = Window.partitionBy(*KEY).orderBy(F.desc("version"), F.desc("write_seq"))
    return log.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= n).drop("__n")


def rollback_features(log: DataFrame, targets: DataFrame) -> DataFrame:
    """New log rows that make the newest version up to the target's `version` active again.

    `targets`: feature_name, version.  Keys without such a version get no row.
    """
    chosen = log.join(targets.select("feature_name", F.col("version").alias("to_version")), "feature_name").where("version <= to_version")
    best = chosen.groupBy(*KEY).agg(F.max_by(F.struct("value", "feature_ts", "version"), F.struct("version", "write_seq")).alias("last"))
    top = log.groupBy(*KEY).agg(F.max("write_seq").alias("top"))
    return best.join(top, KEY).select(*KEY, "last.*", (F.col("top") + 1).alias("write_seq"))
