"""Event contracts: decode, route, validate, evolve, publish, apply updates, measure (A)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_ratio
from .slabs import carried, ranged

#: Domains of the wire contract (fixed values).
EVENT_TYPES = ("view", "click", "purchase", "like", "share", "add_to_cart", "remove_from_cart")
ENTITY_TYPES = ("user", "item", "category", "session")
UPDATE_TYPES = ("incremental", "full", "delete")
MODEL_UPDATE_TYPES = ("full_retrain", "incremental", "parameters_only", "architecture_change")
DEPLOYMENT_STATES = ("pending", "deploying", "active", "failed", "rolled_back")
EVENT_SCHEMA = "event_id string, user_id string, session_id string, event_type string, item_id string, item_category string"

#: By contract: fields as decoded, and those that must be there, with their domain if any.
SCHEMAS = {
    "user_event": EVENT_SCHEMA,
    "feature_update": "event_id string, entity_type string, entity_id string, features map<string,string>, timestamp long, version int, update_type string, ttl_seconds int",
    "model_update": "event_id string, model_name string, model_version string, update_type string, model_metadata map<string,string>, performance_metrics map<string,double>, timestamp long, deployment_status string",
    "recommendation_request": (
        "request_id string, user_id string, session_id string, request_context struct<page_type: string, num_recommendations: int, filters: map<string,string>, candidate_pool: array<string>>, "
        "timestamp long, ab_test_info struct<experiment_id: string, variant: string, traffic_split: double>"
    ),
}
REQUIRED: dict[str, dict[str, tuple[str, ...] | None]] = {
    "user_event": {"event_id": None, "user_id": None, "session_id": None, "event_type": EVENT_TYPES, "item_id": None},
    "feature_update": {"event_id": None, "entity_type": ENTITY_TYPES, "entity_id": None, "features": None, "timestamp": None, "version": None, "update_type": UPDATE_TYPES},
    "model_update": {
        "event_id": None, "model_name": None, "model_version": None, "update_type": MODEL_UPDATE_TYPES, "model_metadata": None, "performance_metrics": None, "timestamp": None, "deployment_status": DEPLOYMENT_STATES,
    },
    "recommendation_request": {"request_id": None, "user_id": None, "session_id": None, "request_context": None, "timestamp": None},
}
#: Values that an absent field takes.
DEFAULTS = {"feature_update": {"update_type": "incremental"}, "recommendation_request": {"request_context.num_recommendations": 10}}


def _parsed_once(df: DataFrame, name: str, parsed: Column) -> DataFrame:
    """Add `parsed` as a row's own value: a plain column of from_json is written into each
    expression that names one of its fields, and parses the text anew in each."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.explode(F.array(parsed)).alias(name))


def decode_events(df: DataFrame, *, value_col: str = "msg_value", schema: str = EVENT_SCHEMA) -> DataFrame:
    """Add `event` (struct) and `decode_ok`; an undecodable value gives null fields."""
    parsed = F.from_json(value_col, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return _parsed_once(df, "event", parsed).withColumn("decode_ok", F.col("event").isNotNull() & F.col("event._corrupt").isNull())


def decode_contracts(df: DataFrame, *, value_col: str = "msg_value", contract_col: str = "contract") -> DataFrame:
    """Add one struct for each contract, filled where `contract_col` names it, and
    decode_ok; absent fields take their defaults, an unknown contract is not decodable."""
    out, ok = df, F.lit(False)
    for name, schema in SCHEMAS.items():
        own = F.col(contract_col) == name
        out = _parsed_once(out, name, F.from_json(F.when(own, F.col(value_col)), f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
        for field, value in DEFAULTS.get(name, {}).items():
            parent = F.col(f"{name}.{field}".rpartition(".")[0])
            filled = F.col(name).withField(field, F.coalesce(F.col(f"{name}.{field}"), F.lit(value)))
            out = out.withColumn(name, F.when(F.col(f"{name}._corrupt").isNull() & parent.isNotNull(), filled).otherwise(F.col(name)))
        ok = F.when(own, F.col(name).isNotNull() & F.col(f"{name}._corrupt").isNull()).otherwise(ok)
    return out.withColumn("decode_ok", F.coalesce(ok, F.lit(False)))


def contract_reasons(df: DataFrame, *, contract_col: str = "contract") -> DataFrame:
    """Rows of decode_contracts with `reasons` why they break their contract, empty if they do not."""
    found = F.lit(None).cast("array<string>")
    for name, fields in REQUIRED.items():
        found = F.when(F.col(contract_col) == name, _reasons(fields, F.col(name))).otherwise(found)
    known = F.coalesce(F.col(contract_col).isin(*SCHEMAS), F.lit(False))
    return df.withColumn("reasons", F.when(~known, F.array(F.lit("unknown contract"))).when(~F.col("decode_ok"), F.array(F.lit("undecodable"))).otherwise(found))


def validate_contracts(df: DataFrame, *, contract_col: str = "contract") -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) rows of decode_contracts; the invalid carry `reasons`."""
    checked = contract_reasons(df, contract_col=contract_col)
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0)


def route_event_type(df: DataFrame, *, topic_col: str = "topic", headers_col: str | None = None) -> DataFrame:
    """Add `contract`: from the topic's name, else from the header event_type, else null."""
    topic = F.col(topic_col)
    named = F.when(topic.contains("user-events") | topic.contains("interaction-events"), "user_event").when(topic.contains("feature-updates"), "feature_update")
    header = F.try_element_at(F.col(headers_col), F.lit("event_type")) if headers_col else F.lit(None).cast("string")
    return df.withColumn("contract", F.coalesce(named, header))


def _reasons(fields: dict[str, tuple[str, ...] | None], struct: Column) -> Column:
    """Reasons why required fields (with a domain, or None) do not hold, as an array."""
    out = []
    for name, domain in fields.items():
        value = struct[name]
        # Ids and enumerations are texts, of which an empty one counts as missing.
        empty = value.cast("string") == "" if domain or name.endswith(("_id", "_name", "_version")) else F.lit(False)
        out.append(F.when(value.isNull() | empty, F.lit(f"missing {name}")))
        if domain:
            out.append(F.when(value.isNotNull() & (value != "") & ~value.isin(*domain), F.concat(F.lit(f"bad {name}: "), value)))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def validate_events(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) decoded events; the invalid carry `reasons`."""
    required = {"event_id": None, "user_id": None, "session_id": None, "event_type": EVENT_TYPES, "item_id": None}
    reasons = F.when(~F.col("decode_ok"), F.array(F.lit("undecodable"))).otherwise(_reasons(required, F.col("event")))
    checked = df.withColumn("reasons", reasons)
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0)


def dead_letters(invalid: DataFrame, *, failed_at: Column | None = None) -> DataFrame:
    """Failed messages in the dead-letter layout, none lost."""
    entity = F.concat_ws("_", "topic", F.col("partition_id").cast("string"), F.col("offset_id").cast("string"))
    undecodable = F.array_contains("reasons", "undecodable")
    return invalid.select(
        F.concat(F.lit("dlq_"), F.coalesce(F.col("event.event_id"), entity)).alias("dlq_id"), entity.alias("entity_id"),
        F.col("msg_value").alias("original_message"), F.concat_ws("; ", "reasons").alias("error"),
        F.when(undecodable, "DecodeError").otherwise("ContractError").alias("error_type"), "topic",
        F.col("partition_id").alias("partition"), F.col("offset_id").alias("offset"),
        (failed_at if failed_at is not None else F.current_timestamp()).alias("failed_at"),
    )


def evolve_events(df: DataFrame) -> DataFrame:
    """Version-1 events (string time, maps) to the latest contract (timestamp, structs, value)."""
    column = lambda name: F.col(name) if name in df.columns else F.lit(None)
    part = lambda name, keys: F.struct(*[F.try_element_at(column(name).cast("map<string,string>"), F.lit(k)).alias(k) for k in keys]).alias(name)
    return df.select(
        "event_id", "user_id", "session_id", "event_type", "item_id", "item_category",
        F.try_to_timestamp(F.col("timestamp")).alias("timestamp"),
        F.coalesce(column("properties").cast("map<string,string>"), F.create_map().cast("map<string,string>")).alias("properties"),
        part("device_info", ("type", "os", "version", "screen_resolution")), part("location", ("country", "region", "city", "timezone")),
        column("referrer").cast("string").alias("referrer"), column("value").cast("double").alias("value"),
        F.coalesce(column("update_type").cast("string"), F.lit("incremental")).alias("update_type"),
    )


def to_messages(df: DataFrame, kind: str, *, prefix: str = "rec") -> DataFrame:
    """topic, key, value (JSON) and headers of rows to publish; `kind` user_event or feature_update."""
    if kind == "user_event":
        topic, key = "user-events", F.col("user_id")
    elif kind == "feature_update":
        topic, key = "feature-updates", F.concat_ws(":", "entity_type", "entity_id")
    else:
        raise ValueError(f"unknown kind of message: {kind}")
    headers = F.create_map(F.lit("event_type"), F.lit(kind), F.lit("content_type"), F.lit("application/json"))
    return df.select(F.lit(f"{prefix}.{topic}").alias("topic"), key.cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"), headers.alias("headers"))


def pack_feature_updates(df: DataFrame, entity_type: str, id_col: str, cols: list[str], ts_col: str) -> DataFrame:
    """Feature columns as one update event: a map of strings (nulls left out), version = epoch seconds."""
    pairs = F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c).cast("string"))])
    return df.select(
        F.lit(entity_type).alias("entity_type"), F.col(id_col).cast("string").alias("entity_id"),
        F.map_filter(pairs, lambda k, v: v.isNotNull()).alias("features"), F.col(ts_col).alias("timestamp"),
        F.unix_seconds(F.col(ts_col).cast("timestamp")).alias("version"), F.lit("incremental").alias("update_type"),
    )


def apply_feature_updates(state: DataFrame, updates: DataFrame) -> DataFrame:
    """Feature rows after a change log.

    `state`: entity_id, feature_name, value; `updates`: seq, entity_id, update_type,
    features (map), with ttl_seconds if present.  full replaces, delete empties and
    incremental upserts; a later sequence number wins.
    """
    ttl = F.col("ttl_seconds").cast("long") if "ttl_seconds" in updates.columns else F.lit(None).cast("long")
    resets = updates.where("update_type in ('full', 'delete')").groupBy("entity_id").agg(F.max("seq").alias("reset_seq"))
    new = updates.where("update_type in ('incremental', 'full')").select("entity_id", "seq", F.explode("features").alias("feature_name", "value"), ttl.alias("ttl_seconds"))
    old = state.select("entity_id", F.lit(-1).cast("long").alias("seq"), "feature_name", "value", F.lit(None).cast("long").alias("ttl_seconds"))
    rows = old.unionByName(new).join(resets, "entity_id", "left").where(F.col("reset_seq").isNull() | (F.col("seq") >= F.col("reset_seq")))
    newest = Window.partitionBy("entity_id", "feature_name").orderBy(F.desc("seq"))
    return rows.withColumn("n", F.row_number().over(newest)).where("n = 1").select("entity_id", "feature_name", "value", "seq", "ttl_seconds")


def consumer_lag(offsets: DataFrame) -> DataFrame:
    """Lag per partition (high watermark - position, not below 0) and the topic's running maximum,
    which range partitions of topic and time carry on."""
    rows = offsets.withColumn("lag", F.greatest(F.col("high_watermark") - F.col("position"), F.lit(0)))
    own = lambda w: F.max("lag").over(w.rowsBetween(Window.unboundedPreceding, 0))
    scans = {"max_lag": (own, F.max("lag"), lambda w: F.max("max_lag").over(w), F.greatest)}
    return carried(ranged(rows, "topic", "checked_at", "partition_id"), ["topic"], ["checked_at", "partition_id"], scans)


def pipeline_metrics(df: DataFrame, *, ok_col: str = "ok", ms_col: str = "ms", by: tuple[str, ...] = ()) -> DataFrame:
    """Consumed, processed, failed, success rate (0 without rows), mean processing milliseconds."""
    ok = F.count_if(F.col(ok_col))
    n = F.count(F.lit(1))
    return df.groupBy(*by).agg(
        n.alias("consumed"), ok.alias("processed"), (n - ok).alias("failed"), safe_ratio(ok, n).alias("success_rate"), F.coalesce(F.avg(ms_col), F.lit(0.0)).alias("avg_ms")
    )
