"""Queries that run a stream over the given tables to its end (A1, A10, B4, B13, B16, B17, D9, H10)."""

import uuid

from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import features as feat
from ..sources import fixtures as fx
from ..sources.scratch import scratch_dir
from ..sources.streams import read_event_stream
from ..streaming import operators as op
from .features import _FEATURES, _WEIGHT
from .drift import _GATE
from .registry import query


def _places(spark):
    root = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    return f"{root}/table", f"{root}/checkpoint"


def _events(spark, d):
    """The events table as a stream, with the columns of interactions."""
    s = read_event_stream(spark, f"{d}/event[s].parquet", max_files=1)
    k = F.get_json_object("props", "$.k").cast("int")
    user = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    return s.select(
        "event_id", "ts", "event_type", "value", k.alias("k"), F.col("user_id").alias("user_no"), user.alias("user_id"), F.concat(F.lit("item_"), k.cast("string")).alias("item_id"),
        F.concat(F.lit("cat_"), (k % 10).cast("string")).alias("item_category"), F.concat(user, F.lit("_"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
    )


def _finish(stream, spark, mode="append"):
    table, checkpoint = _places(spark)
    op.append_to_table(stream, table, checkpoint, mode=mode).awaitTermination()
    return table


@query("a1_event_stream", "select event_id, event_type, ts from events")
def a1(spark, d):
    out = spark.read.parquet(_finish(read_event_stream(spark, f"{d}/event[s].parquet"), spark))
    return out.select("event_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("a10_event_pipeline", "select event_type, count(*) as n from interactions where event_type in ('view', 'purchase') and event_id % 97 <> 0 group by 1 union all select 'dead', count(*) from interactions where event_id % 97 = 0 or event_type in ('error', 'signup')")
def a10(spark, d):
    table, checkpoint = _places(spark)
    e = _events(spark, d)
    body = F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), "user_id", "session_id", "event_type", "item_id", "item_category"))
    messages = e.select(F.lit("rec.user-events").alias("topic"), F.lit(0).alias("partition_id"), F.col("event_id").alias("offset_id"), F.when(F.col("event_id") % 97 == 0, '{"event_id":').otherwise(body).alias("msg_value"))
    pipeline = op.EventPipeline()
    for kind in ("view", "purchase"):
        pipeline.on(kind, lambda df, b, kind=kind: df.write.mode("overwrite").parquet(f"{table}/handled/kind={kind}/batch={b}"))
    pipeline.start(messages, f"{table}/dead", checkpoint).awaitTermination()
    handled = spark.read.parquet(f"{table}/handled").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return handled.unionByName(spark.read.parquet(f"{table}/dead").agg(F.count(F.lit(1)).alias("n")).select(F.lit("dead").alias("event_type"), "n"))


@query(
    "b4_sliding_stream",
    "with w as (select user_id, value, unnest([time_bucket(interval 6 hours, ts) - i * interval 6 hours for i in range(4)]) as window_start from interactions) select window_start, window_start + interval 24 hours as window_end, user_id, count(value) as n, round(sum(value), 6) as total, round(avg(value), 6) as mean from w group by all",
)
def b4_stream(spark, d):
    stream = feat.sliding_aggregates(_events(spark, d), "user_id", "ts", "value", size="24 hours", slide="6 hours", watermark="1 day")
    out = op.latest_by_key(spark, _finish(stream, spark, "update"), "window_start", "window_end", "user_id")
    return rounded(out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}))


@query(
    "b13_debounce_stream",
    """with recursive e as (select user_id, ts, event_id, row_number() over (partition by user_id order by ts, event_id) as n from interactions where event_type in ('view', 'click')),
    f(user_id, n, event_id, ts, last_ts, fires) as (
      select user_id, n, event_id, ts, ts, true from e where n = 1
      union all select e.user_id, e.n, e.event_id, e.ts, case when e.ts - f.last_ts >= interval 172800 seconds then e.ts else f.last_ts end, e.ts - f.last_ts >= interval 172800 seconds
      from f join e on e.user_id = f.user_id and e.n = f.n + 1)
    select user_id, event_id from f where fires""",
)
def b13_stream(spark, d):
    return spark.read.parquet(_finish(op.stream_debounce(_events(spark, d), 172800), spark)).select("user_id", "event_id")


@query("b16_stream_popularity", f"select item_id, sum({_WEIGHT})::double as popularity from interactions group by 1")
def b16(spark, d):
    return op.latest_by_key(spark, _finish(op.stream_popularity(_events(spark, d)), spark, "update"), "item_id")


@query(
    "b17_stream_sessions",
    f"with {_FEATURES} select user_id, event_id, session_no, round(session_seconds, 6) as session_seconds, total_events, session_events, unique_items, unique_categories, round(total_events / greatest(session_seconds / 60, 1), 6) as events_per_minute from featured",
)
def b17(spark, d):
    out = spark.read.parquet(_finish(op.stream_sessions(_events(spark, d), ttl_seconds=None), spark))
    return rounded(out.drop("batch_id"))


@query(
    "b17_stream_sessions_expiring",
    """with gaps as (
      select *, coalesce(ts - lag(ts) over u > interval 43200 seconds, true) as forgotten, lag(session_id) over u is distinct from session_id as other
      from interactions window u as (partition by user_id order by ts, event_id)
    ), chains as (
      select *, sum(forgotten::int) over u as chain, sum((forgotten or other)::int) over u as visit from gaps window u as (partition by user_id order by ts, event_id rows unbounded preceding)
    ), counted as (
      select *, visit - min(visit) over (partition by user_id, chain) + 1 as session_no, count(*) over c as total_events, count(*) over v as session_events,
             (epoch_us(ts) - epoch_us(min(ts) over v)) / 1000000.0::double as session_seconds, len(list_distinct(list(item_id) over v))::bigint as unique_items, len(list_distinct(list(item_category) over v))::bigint as unique_categories
      from chains window c as (partition by user_id, chain order by ts, event_id rows unbounded preceding), v as (partition by user_id, visit order by ts, event_id rows unbounded preceding)
    )
    select user_id, event_id, session_no::bigint as session_no, round(session_seconds, 6) as session_seconds, total_events, session_events, unique_items, unique_categories,
           round(total_events / greatest(session_seconds / 60, 1), 6) as events_per_minute from counted""",
)
def b17_expiring(spark, d):
    out = spark.read.parquet(_finish(op.stream_sessions(_events(spark, d), ttl_seconds=43200), spark))
    return rounded(out.drop("batch_id"))


@query("d9_stream_online_view", "select entity_id, feature_name, version from feature_log qualify row_number() over (partition by entity_id, feature_name order by write_seq desc) = 1")
def d9(spark, d):
    e = _events(spark, d)
    log = e.select(
        F.when(F.col("event_id") % 11 == 0, F.col("event_id") + 100000000).otherwise(F.col("event_id")).alias("write_seq"), F.lit("user").alias("entity_type"), F.col("user_id").alias("entity_id"),
        F.concat(F.lit("last_"), "event_type").alias("feature_name"), F.col("value").cast("string").alias("value"), F.col("ts").alias("feature_ts"), F.col("event_id").alias("version"),
    )
    table, checkpoint = _places(spark)
    op.stream_online_view(log, table, checkpoint).awaitTermination()
    return op.read_online_view(spark, table).select("entity_id", "feature_name", "version")


@query("h10_alert_gate_stream", f"with recursive {_GATE} select model, checked_at, alert, run::int as run_length from gate")
def h10_stream(spark, d):
    checks = _events(spark, d).select(
        F.concat(F.lit("m"), (F.col("user_no") % 4).cast("string")).alias("model"), F.col("ts").alias("checked_at"), (F.col("value") > 60).alias("drift"), (F.col("value") / 400.0).alias("psi"), (F.col("k") / 110.0).alias("confidence")
    )
    out = spark.read.parquet(_finish(op.stream_alert_gate(checks, cooldown=43200), spark))
    return out.select("model", F.col("checked_at").cast("timestamp_ntz").alias("checked_at"), "alert", "run_length")
