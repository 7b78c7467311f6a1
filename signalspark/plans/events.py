"""Queries of the event contracts (A)."""

from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import events as op
from ..sources import fixtures as fx
from .registry import query

_FIELDS = ("event_id", "user_id", "session_id", "event_type", "item_id", "item_category")
_DECODED = """
decoded as (
  select *, json_valid(msg_value) as ok from messages
), fields as (
  select topic, partition_id, offset_id, msg_value, ok,
         case when ok then json_extract_string(msg_value, '$.event_id') end as event_id,
         case when ok then json_extract_string(msg_value, '$.user_id') end as user_id,
         case when ok then json_extract_string(msg_value, '$.event_type') end as event_type,
         case when ok then json_extract_string(msg_value, '$.item_id') end as item_id
  from decoded
), reasoned as (
  select *, case when not ok then 'undecodable'
                 when event_type not in ('view','click','purchase','like','share','add_to_cart','remove_from_cart') then 'bad event_type: ' || event_type end as reason
  from fields
)"""


@query("a2_decode_events", f"with {_DECODED} select offset_id, ok as decode_ok, event_id, user_id, event_type, item_id from reasoned")
def a2(spark, d):
    e = op.decode_events(fx.messages(spark, d))
    return e.select("offset_id", "decode_ok", *[f"event.{c}" for c in ("event_id", "user_id", "event_type", "item_id")])


@query(
    "a3_route_event_type",
    """with t as (select topic, event_id, event_type from (select case when event_id % 3 = 0 then 'x.feature-updates' when event_id % 3 = 1 then 'other' else 'rec.user-events' end as topic, event_id, event_type from events))
    select event_id, case when topic like '%user-events%' then 'user_event' when topic like '%feature-updates%' then 'feature_update' when event_type <> 'error' then event_type end as contract from t""",
)
def a3(spark, d):
    k = F.col("event_id") % 3
    headers = F.when(F.col("event_type") != "error", F.create_map(F.lit("event_type"), F.col("event_type")))
    rows = fx.table(spark, d, "events").select("event_id", F.when(k == 0, "x.feature-updates").when(k == 1, "other").otherwise("rec.user-events").alias("topic"), headers.alias("headers"))
    return op.route_event_type(rows, headers_col="headers").select("event_id", "contract")


@query("a4_validate_events", f"with {_DECODED} select offset_id, reason is null as valid, coalesce(reason, '') as reasons from reasoned")
def a4(spark, d):
    good, bad = op.validate_events(op.decode_events(fx.messages(spark, d)))
    good = good.select("offset_id", F.lit(True).alias("valid"), F.lit("").alias("reasons"))
    return good.unionByName(bad.select("offset_id", F.lit(False).alias("valid"), F.concat_ws("; ", "reasons").alias("reasons")))


_CONTRACTS = """m as (select event_id, user_no, k, value, event_type, ['user_event', 'feature_update', 'model_update', 'recommendation_request', 'other'][1 + event_id % 5] as contract from interactions),
r as (select *, event_id % 13 = 0 as broken, case contract
  when 'feature_update' then concat_ws('; ', case when k % 7 = 0 then 'missing entity_id' end, case when k % 5 = 0 then 'bad update_type: partial' end)
  when 'model_update' then concat_ws('; ', case when k % 6 = 0 then 'missing model_name' end, case when k % 4 = 0 then 'bad deployment_status: lost' end)
  when 'recommendation_request' then case when k % 3 = 0 then 'missing session_id' else '' end
  when 'user_event' then case when event_type in ('view', 'click', 'purchase') then '' else 'bad event_type: ' || event_type end end as why from m)"""


def _contract_messages(spark, d):
    i = fx.interactions(spark, d)
    names = F.array(*[F.lit(x) for x in (*op.SCHEMAS, "other")])
    text = F.col("event_id").cast("string")
    now = F.lit(1_700_000_000_000_000)
    bodies = {
        "user_event": F.struct(text.alias("event_id"), "user_id", "session_id", "event_type", "item_id", "item_category"),
        "feature_update": F.struct(
            text.alias("event_id"), F.lit("user").alias("entity_type"), F.when(F.col("k") % 7 != 0, F.col("user_id")).alias("entity_id"), F.create_map(F.lit("v"), F.col("value").cast("string")).alias("features"),
            now.alias("timestamp"), F.col("k").alias("version"), F.when(F.col("k") % 5 == 0, "partial").alias("update_type"),
        ),
        "model_update": F.struct(
            text.alias("event_id"), F.when(F.col("k") % 6 == 0, "").otherwise("m").alias("model_name"), F.lit("v1").alias("model_version"), F.lit("incremental").alias("update_type"), F.create_map(F.lit("a"), F.lit("b")).alias("model_metadata"),
            F.create_map(F.lit("auc"), F.lit(0.5)).alias("performance_metrics"), now.alias("timestamp"), F.when(F.col("k") % 4 == 0, "lost").otherwise("active").alias("deployment_status"),
        ),
        "recommendation_request": F.struct(
            text.alias("request_id"), "user_id", F.when(F.col("k") % 3 != 0, F.col("session_id")).alias("session_id"),
            F.struct(F.lit("home").alias("page_type"), F.when(F.col("k") % 2 == 0, F.col("k")).alias("num_recommendations")).alias("request_context"), now.alias("timestamp"),
        ),
    }
    rows = i.select("*", names[(F.col("event_id") % 5).cast("int")].alias("contract"))
    body = F.lit("{}")
    for name, fields in bodies.items():
        body = F.when(F.col("contract") == name, F.to_json(fields)).otherwise(body)
    return rows.select("event_id", "contract", F.when(F.col("event_id") % 13 == 0, '{"event_id":').otherwise(body).alias("msg_value"))


@query(
    "a2_decode_contracts",
    f"""with {_CONTRACTS} select event_id, contract, contract <> 'other' and not broken as decode_ok,
    case when not broken and contract = 'feature_update' then case when k % 5 = 0 then 'partial' else 'incremental' end end as update_type,
    case when not broken and contract = 'recommendation_request' then case when k % 2 = 0 then k else 10 end end as n_asked,
    case when not broken and contract = 'model_update' then 0.5::double end as auc from r""",
)
def a2_contracts(spark, d):
    e = op.decode_contracts(_contract_messages(spark, d))
    return e.select("event_id", "contract", "decode_ok", "feature_update.update_type", F.col("recommendation_request.request_context.num_recommendations").alias("n_asked"), F.try_element_at("model_update.performance_metrics", F.lit("auc")).alias("auc"))


@query("a4_validate_contracts", f"with {_CONTRACTS} select event_id, contract, case when contract = 'other' then 'unknown contract' when broken then 'undecodable' else coalesce(why, '') end as reasons from r")
def a4_contracts(spark, d):
    out = op.contract_reasons(op.decode_contracts(_contract_messages(spark, d)))
    return out.select("event_id", "contract", F.concat_ws("; ", "reasons").alias("reasons"))


@query(
    "a5_dead_letters",
    f"""with {_DECODED} select 'dlq_' || coalesce(event_id, topic || '_' || partition_id || '_' || offset_id) as dlq_id, topic || '_' || partition_id || '_' || offset_id as entity_id,
    msg_value as original_message, reason as error, case when reason = 'undecodable' then 'DecodeError' else 'ContractError' end as error_type, topic, partition_id as "partition", offset_id as "offset",
    timestamp '2024-02-01 00:00:00' as failed_at from reasoned where reason is not null""",
)
def a5(spark, d):
    _, bad = op.validate_events(op.decode_events(fx.messages(spark, d)))
    return op.dead_letters(bad, failed_at=F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))


@query(
    "a6_evolve_events",
    """select cast(event_id as varchar) as event_id, user_id, event_type, case when event_id % 5 = 0 then null else ts end as event_ts, case when event_id % 2 = 0 then 1 else 0 end as n_properties,
    case when event_id % 2 = 0 then 'mobile' end as device, null::varchar as country, null::double as value, 'incremental' as update_type from interactions""",
)
def a6(spark, d):
    even, i = F.col("event_id") % 2 == 0, fx.interactions(spark, d)
    old = i.select(
        F.col("event_id").cast("string").alias("event_id"), "user_id", "session_id", "event_type", "item_id", "item_category",
        F.when(F.col("event_id") % 5 == 0, "not a time").otherwise(F.col("ts").cast("string")).alias("timestamp"),
        F.when(even, F.create_map(F.lit("k"), F.col("k").cast("string"))).alias("properties"), F.when(even, F.create_map(F.lit("type"), F.lit("mobile"))).alias("device_info"),
    )
    new = op.evolve_events(old)
    return new.select("event_id", "user_id", "event_type", F.col("timestamp").cast("timestamp_ntz").alias("event_ts"), F.size("properties").alias("n_properties"), F.col("device_info.type").alias("device"), F.col("location.country").alias("country"), "value", "update_type")


@query("a7_to_messages", "select 'rec.user-events' as topic, user_id as key, 'user_event' as header, event_id, event_type, item_id from interactions")
def a7(spark, d):
    m = op.to_messages(fx.interactions(spark, d).select("event_id", "user_id", "event_type", "item_id"), "user_event")
    part = lambda n: F.get_json_object("value", f"$.{n}")
    return m.select("topic", "key", F.col("headers")["event_type"].alias("header"), part("event_id").cast("long").alias("event_id"), part("event_type").alias("event_type"), part("item_id").alias("item_id"))


@query("a8_pack_feature_updates", "select 'user:' || user_id as key, case when event_id % 4 = 0 then 1 else 2 end as n_features, cast(k as varchar) as k, case when event_id % 4 = 0 then null else item_id end as item_id, floor(epoch(ts))::bigint as version from interactions")
def a8(spark, d):
    i = fx.interactions(spark, d).withColumn("item_id", F.when(F.col("event_id") % 4 != 0, F.col("item_id")))
    p = op.pack_feature_updates(i, "user", "user_id", ["k", "item_id"], "ts")
    get = lambda k: F.try_element_at("features", F.lit(k))
    return p.select(F.concat_ws(":", "entity_type", "entity_id").alias("key"), F.size("features").alias("n_features"), get("k").alias("k"), get("item_id").alias("item_id"), "version")


@query(
    "a9_apply_feature_updates",
    """with log as (
      select event_id as seq, user_id as entity_id, case when event_id % 29 = 0 then 'delete' when event_id % 13 = 0 then 'full' else 'incremental' end as update_type,
             'last_' || event_type as feature_name, event_id as value from interactions
    ), resets as (select entity_id, max(seq) as reset_seq from log where update_type <> 'incremental' group by all
    ), rows_ as (
      select entity_id, -1 as seq, feature_name, value from offline_state
      union all select entity_id, seq, feature_name, value from log where update_type <> 'delete'
    )
    select r.entity_id, feature_name, cast(arg_max(value, seq) as varchar) as value, max(seq)::bigint as seq from rows_ r left join resets s using (entity_id)
    where reset_seq is null or seq >= reset_seq group by r.entity_id, feature_name""",
)
def a9(spark, d):
    kind = F.when(F.col("event_id") % 29 == 0, "delete").when(F.col("event_id") % 13 == 0, "full").otherwise("incremental")
    features = F.create_map(F.concat(F.lit("last_"), "event_type"), F.col("event_id").cast("string"))
    updates = fx.interactions(spark, d).select(F.col("event_id").alias("seq"), F.col("user_id").alias("entity_id"), kind.alias("update_type"), features.alias("features"))
    state = fx.offline_state(spark, d).select("entity_id", "feature_name", F.col("value").cast("string").alias("value"))
    return op.apply_feature_updates(state, updates).select("entity_id", "feature_name", "value", "seq")


@query(
    "a11_consumer_lag",
    """with o as (select topic, partition_id, offset_id as checked_at, offset_id + (offset_id * 7) % 50 as high_watermark, offset_id + 5 as position from messages)
    select topic, partition_id, checked_at, greatest(high_watermark - position, 0) as lag,
    max(greatest(high_watermark - position, 0)) over (partition by topic order by checked_at, partition_id rows unbounded preceding) as max_lag from o""",
)
def a11(spark, d):
    o = fx.messages(spark, d).select("topic", "partition_id", F.col("offset_id").alias("checked_at"), (F.col("offset_id") + F.col("offset_id") * 7 % 50).alias("high_watermark"), (F.col("offset_id") + 5).alias("position"))
    return op.consumer_lag(o).select("topic", "partition_id", "checked_at", "lag", "max_lag")


@query(
    "a12_pipeline_metrics",
    """select item_category, count(*) as consumed, count(*) filter (event_type <> 'error') as processed, count(*) filter (event_type = 'error') as failed,
    round(count(*) filter (event_type <> 'error') / count(*), 6) as success_rate, round(avg(value), 6) as avg_ms from interactions group by all""",
)
def a12(spark, d):
    i = fx.interactions(spark, d).withColumn("ok", F.col("event_type") != "error").withColumn("ms", F.col("value"))
    return rounded(op.pipeline_metrics(i, by=("item_category",)))
