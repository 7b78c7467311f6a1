"""Online view of the feature log: latest value per key with expiry (D)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["entity_type", "entity_id", "feature_name"]
#: Seconds to live by entity type (fixed values); 3600 for any other.
TTL = {"user": 3600, "item": 7200, "session": 1800, "recommendation": 300, "model": 1800}
DEFAULT_TTL = 3600


def with_ttl(df: DataFrame, ttl_col: str = "ttl_seconds") -> DataFrame:
    """Fill `ttl_col`: a null or 0 becomes the default of the entity type."""
    defaults = F.create_map(*[F.lit(x) for pair in TTL.items() for x in pair])
    own = F.nullif(F.col(ttl_col), F.lit(0)) if ttl_col in df.columns else F.lit(None).cast("int")
    return df.withColumn(ttl_col, F.coalesce(own, F.try_element_at(defaults, F.col("entity_type")), F.lit(DEFAULT_TTL)).cast("int"))


def _newest(log: DataFrame, *values: str) -> DataFrame:
    return log.groupBy(*KEY).agg(F.max_by(F.struct(*values), "write_seq").alias("last")).select(*KEY, "last.*")


def online_view(log: DataFrame, as_of: Column) -> DataFrame:
    """Last written value per key with expires_at = time of writing + TTL; what has expired by
    `as_of` is left out.  A log without a column written_at was written at feature_ts."""
    written = F.coalesce("written_at", "feature_ts") if "written_at" in log.columns else F.col("feature_ts")
    newest = _newest(with_ttl(log).withColumn("__written", written), "value", "feature_ts", "version", "ttl_seconds", "__written")
    expires = F.col("__written") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("ttl_seconds"))
    return newest.withColumn("expires_at", expires).drop("__written").where(F.col("expires_at") > as_of)


def lookup_features(view: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested features that exist: `requests` has request_id, entity_id and names, an
    array or one comma-separated string."""
    names = F.col("names") if requests.schema["names"].dataType.typeName() == "array" else F.split("names", ",")
    asked = requests.select("request_id", "entity_id", F.explode(names).alias("name")).select("request_id", "entity_id", F.trim("name").alias("feature_name")).distinct()
    return asked.join(view.select("entity_id", "feature_name", "value"), ["entity_id", "feature_name"])


def entity_feature_map(view: DataFrame) -> DataFrame:
    """All features of an entity as one map."""
    pairs = F.array_sort(F.collect_list(F.struct("feature_name", "value")))
    return view.groupBy("entity_type", "entity_id").agg(F.map_from_entries(pairs).alias("features"))


def apply_deletes(log: DataFrame, deletes: DataFrame) -> DataFrame:
    """Last values per key unless deleted after they were written.

    `deletes`: write_seq, entity_type, entity_id, feature_name (null for the whole entity).
    """
    newest = _newest(log, "value", "feature_ts", "version", "write_seq")
    one = deletes.where(F.col("feature_name").isNotNull()).groupBy(*KEY).agg(F.max("write_seq").alias("feature_gone"))
    whole = deletes.where(F.col("feature_name").isNull()).groupBy("entity_type", "entity_id").agg(F.max("write_seq").alias("entity_gone"))
    gone = F.greatest(F.coalesce("feature_gone", F.lit(-1)), F.coalesce("entity_gone", F.lit(-1)))
    rows = newest.join(one, KEY, "left").join(whole, ["entity_type", "entity_id"], "left")
    return rows.where(F.col("write_seq") > gone).select(*KEY, "value", "feature_ts", "version")


def feature_versions(log: DataFrame, deletes: DataFrame | None = None) -> DataFrame:
    """Version per key; it outlives the value's expiry and an entity's deletion, but not a feature's."""
    newest = _newest(log, "version", "write_seq")
    if deletes is None:
        return newest.select(*KEY, "version")
    one = deletes.where(F.col("feature_name").isNotNull()).groupBy(*KEY).agg(F.max("write_seq").alias("gone"))
    return newest.join(one, KEY, "left").where(F.col("gone").isNull() | (F.col("write_seq") > F.col("gone"))).select(*KEY, "version")


def entity_metadata(log: DataFrame, as_of: Column, *, ttl: int | None = None) -> DataFrame:
    """Last update and sorted feature names of each entity; its life restarts with every write."""
    meta = log.groupBy("entity_type", "entity_id").agg(F.max("feature_ts").alias("last_updated"), F.array_sort(F.collect_set("feature_name")).alias("features"))
    meta = meta.withColumn("ttl_seconds", F.lit(ttl).cast("int"))
    alive = F.col("last_updated") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("ttl_seconds")) > as_of
    return with_ttl(meta).where(alive).drop("ttl_seconds")


def typed_values(log: DataFrame, defs: DataFrame) -> DataFrame:
    """Values decoded by the registry's data_type: number, text, items; undecodable ones flagged."""
    kinds = defs.select(F.col("name").alias("feature_name"), "data_type")
    rows = log.join(kinds, "feature_name", "left")
    numeric, array = F.col("data_type") == "numerical", F.col("data_type") == "array"
    number = F.when(numeric, F.col("value").try_cast("double"))
    items = F.when(array, F.from_json("value", "array<string>"))
    json_text = F.when(F.col("value").startswith('"'), F.from_json(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "v string")["v"])
    text = F.when(~numeric & ~array, F.coalesce(json_text, F.col("value")))
    bad = F.col("value").isNotNull() & ((numeric & number.isNull()) | (array & items.isNull()))
    return rows.select(*log.columns, "data_type", number.alias("number"), text.alias("text"), items.alias("items"), F.coalesce(bad, F.lit(False)).alias("undecodable"))


def undecodable_counts(typed: DataFrame) -> DataFrame:
    return typed.groupBy("feature_name").agg(F.count(F.lit(1)).alias("n"), F.count_if("undecodable").alias("n_undecodable"))
