"""The alert rules, raw metric points to try them on, and the query over all of them (I6)."""

from pyspark.sql import functions as F

from ..operators import rules as op
from ..operators.rules import Merge, Quantile, Rule, increase, last, rate
from ..sources import fixtures as fx
from .registry import VIEWS, query

_5XX = {"status": "5.."}

#: Name, expression, comparison, limit, hold seconds, severity, group.
RULES = (
    Rule("HighAPILatency", Quantile(0.95, rate("request_latency_seconds_bucket", 300)), ">", 0.1, 120, "warning", "api_performance"),
    Rule("CriticalAPILatency", Quantile(0.95, rate("request_latency_seconds_bucket", 120)), ">", 0.5, 60, "critical", "api_performance"),
    Rule("HighAPIErrorRate", rate("http_requests_total", 300, like=_5XX) / rate("http_requests_total", 300), ">", 0.01, 180, "warning", "api_performance"),
    Rule("CriticalAPIErrorRate", rate("http_requests_total", 120, like=_5XX) / rate("http_requests_total", 120), ">", 0.05, 60, "critical", "api_performance"),
    Rule("HighANNQueryLatency", Quantile(0.95, rate("ann_query_latency_seconds_bucket", 300)), ">", 0.05, 120, "warning", "ann_index_performance"),
    Rule("ANNIndexCorruption", last("ann_index_health_score"), "<", 0.95, 300, "critical", "ann_index_performance"),
    Rule("ANNIndexRebuildNeeded", last("ann_index_changes_since_rebuild") / last("ann_index_total_items"), ">", 0.2, 600, "info", "ann_index_performance"),
    Rule("LowCacheHitRate", rate("cache_hits_total", 300) / (rate("cache_hits_total", 300) + rate("cache_misses_total", 300)), "<", 0.8, 300, "warning", "cache_performance"),
    Rule("CriticalCacheHitRate", rate("cache_hits_total", 120) / (rate("cache_hits_total", 120) + rate("cache_misses_total", 120)), "<", 0.5, 120, "critical", "cache_performance"),
    Rule("RedisMemoryHigh", last("redis_memory_used_bytes") / last("redis_memory_max_bytes"), ">", 0.9, 300, "warning", "cache_performance"),
    Rule("RedisConnectionHigh", last("redis_connected_clients"), ">", 1000, 180, "warning", "cache_performance"),
    Rule("KafkaConsumerLagHigh", last("kafka_consumer_lag_sum"), ">", 10000, 120, "warning", "kafka_performance"),
    Rule("KafkaConsumerLagCritical", last("kafka_consumer_lag_sum"), ">", 50000, 60, "critical", "kafka_performance"),
    Rule("KafkaBrokerDown", last("up", job="kafka-cluster"), "==", 0, 60, "critical", "kafka_performance"),
    Rule("KafkaDiskSpaceHigh", last("kafka_log_Log_Size") / last("kafka_server_KafkaMetrics_Value", type="disk"), ">", 0.85, 300, "warning", "kafka_performance"),
    Rule("FeatureStoreSyncLagHigh", last("feature_store_sync_lag_seconds"), ">", 300, 300, "warning", "feature_store"),
    Rule("FeatureStoreSyncLagCritical", last("feature_store_sync_lag_seconds"), ">", 1800, 120, "critical", "feature_store"),
    Rule("FeatureStoreConnectionHigh", last("feature_store_active_connections"), ">", 500, 180, "warning", "feature_store"),
    Rule("GPUUtilizationLow", Merge("avg", rate("nvidia_gpu_utilization_gpu", 300), ("instance",)), "<", 0.3, 600, "warning", "training_infrastructure"),
    Rule("GPUMemoryHigh", last("nvidia_gpu_memory_used_bytes") / last("nvidia_gpu_memory_total_bytes"), ">", 0.95, 300, "warning", "training_infrastructure"),
    Rule("TrainingJobStalled", increase("training_loss_total", 600), "==", 0, 900, "warning", "training_infrastructure"),
    Rule("TrainingJobFailed", last("training_job_status"), "==", 2, 0, "critical", "training_infrastructure"),
    Rule("CTRDropSudden", rate("clicks_total", 300) / rate("impressions_total", 300), "<", 0.8 * (rate("clicks_total", 3600, offset=300) / rate("impressions_total", 3600, offset=300)), 180, "warning", "model_performance"),
    Rule("ModelDriftDetected", last("model_drift_psi_score"), ">", 0.1, 300, "warning", "model_performance"),
    Rule("CriticalModelDrift", last("model_drift_psi_score"), ">", 0.25, 120, "critical", "model_performance"),
    Rule("ModelPredictionLatencyHigh", Quantile(0.95, rate("model_prediction_latency_seconds_bucket", 300)), ">", 0.2, 180, "warning", "model_performance"),
    Rule("NodeCPUHigh", 100 - Merge("avg", rate("node_cpu_seconds_total", 300, mode="idle"), ("instance",)) * 100, ">", 85, 300, "warning", "infrastructure"),
    Rule("NodeMemoryHigh", (1 - last("node_memory_MemAvailable_bytes") / last("node_memory_MemTotal_bytes")) * 100, ">", 90, 300, "warning", "infrastructure"),
    Rule("PodCrashLooping", rate("kube_pod_container_status_restarts_total", 300), ">", 0, 300, "warning", "infrastructure"),
    Rule("PodNotReady", last("kube_pod_status_ready", condition="true"), "==", 0, 300, "warning", "infrastructure"),
    Rule("RecommendationQPSDrop", rate("recommendation_requests_total", 300), "<", 0.8 * rate("recommendation_requests_total", 3600, offset=300), 180, "warning", "business_metrics"),
    Rule("RecommendationQPSCritical", rate("recommendation_requests_total", 120), "<", 0.5 * rate("recommendation_requests_total", 3600, offset=120), 60, "critical", "business_metrics"),
    Rule("LowEngagementRate", rate("user_engagement_events_total", 300) / rate("recommendation_requests_total", 300), "<", 0.1, 600, "warning", "business_metrics"),
    Rule("APIErrorBudgetBurnRateFast", Merge("sum", rate("http_requests_total", 300, like=_5XX)) / Merge("sum", rate("http_requests_total", 300)), ">", (1 - 0.999) / (30 * 24 * 3600) * 14 * 3600, 120, "critical", "slo_alerts"),
    Rule("APILatencySLOBreached", Merge("sum", rate("request_latency_seconds_bucket", 300, le="0.1")) / Merge("sum", rate("request_latency_seconds_count", 300)), "<", 0.95, 300, "critical", "slo_alerts"),
)

#: Stand-in metrics: name, kind, factor, and the label besides the instance.  Counters grow by
#: the factor with each event and start again now and then; a gauge is the event's value times
#: the factor, a state the event's number modulo the factor, a constant the factor.
METRICS = (
    ("request_latency_seconds_bucket", "buckets", 3.0, None, None), ("ann_query_latency_seconds_bucket", "buckets", 2.0, None, None), ("model_prediction_latency_seconds_bucket", "buckets", 1.0, None, None),
    ("request_latency_seconds_count", "counter", 3.0, None, None), ("http_requests_total", "counter", 5.0, "status", None), ("cache_hits_total", "counter", 3.0, None, None), ("cache_misses_total", "counter", 1.0, None, None),
    ("nvidia_gpu_utilization_gpu", "counter", 1.0, "gpu", "0"), ("training_loss_total", "steps", 1.0, None, None), ("clicks_total", "counter", 1.0, None, None), ("impressions_total", "counter", 7.0, None, None),
    ("node_cpu_seconds_total", "counter", 0.5, "mode", "idle"), ("kube_pod_container_status_restarts_total", "steps", 1.0, "pod", "p"), ("recommendation_requests_total", "counter", 9.0, None, None), ("user_engagement_events_total", "counter", 1.0, None, None),
    ("ann_index_health_score", "gauge", 0.02, None, None), ("ann_index_changes_since_rebuild", "gauge", 5.0, None, None), ("ann_index_total_items", "constant", 1000.0, None, None), ("redis_memory_used_bytes", "gauge", 15.0, None, None),
    ("redis_memory_max_bytes", "constant", 1000.0, None, None), ("redis_connected_clients", "gauge", 20.0, None, None), ("kafka_consumer_lag_sum", "gauge", 400.0, None, None), ("up", "state", 2.0, "job", "kafka-cluster"),
    ("kafka_log_Log_Size", "gauge", 15.0, "type", "disk"), ("kafka_server_KafkaMetrics_Value", "constant", 1000.0, "type", "disk"), ("feature_store_sync_lag_seconds", "gauge", 15.0, None, None), ("feature_store_active_connections", "gauge", 10.0, None, None),
    ("nvidia_gpu_memory_used_bytes", "gauge", 15.0, None, None), ("nvidia_gpu_memory_total_bytes", "constant", 1000.0, None, None), ("training_job_status", "state", 3.0, None, None), ("model_drift_psi_score", "gauge", 0.002, None, None),
    ("node_memory_MemAvailable_bytes", "gauge", 3.0, None, None), ("node_memory_MemTotal_bytes", "constant", 1000.0, None, None), ("kube_pod_status_ready", "state", 2.0, "condition", "true"),
)
_BUCKETS = (("0.05", 0.2), ("0.1", 0.5), ("0.5", 0.96), ("+Inf", 1.0))


def metric_points(spark, d):
    """ts, metric, labels, value: each event yields a point of every fourth metric; time runs
    sixty times as fast, so that the windows of the rules hold several points."""
    i = fx.interactions(spark, d)
    rows = [(no, *m, le, share) for no, m in enumerate(METRICS) for le, share in (_BUCKETS if m[1] == "buckets" else ((None, 1.0),))]
    metrics = spark.createDataFrame(rows, "no int, metric string, kind string, factor double, label string, label_value string, le string, share double")
    both = i.join(F.broadcast(metrics), (F.col("event_id") + F.col("no")) % 4 == 0)
    begin = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    ts = F.timestamp_add("MICROSECOND", F.floor(F.timestamp_diff("MICROSECOND", begin, F.col("ts")) / 60).cast("long"), begin)
    count = F.expr("(event_id * factor) % 50000")
    value = F.when(F.col("kind").isin("counter", "buckets"), F.floor(count * F.col("share")).cast("double")).when(F.col("kind") == "steps", F.floor(F.col("event_id") / 400).cast("double"))
    value = value.when(F.col("kind") == "gauge", F.col("value") * F.col("factor")).when(F.col("kind") == "state", F.col("k") % F.col("factor")).otherwise(F.col("factor"))
    name = F.when(F.col("kind") == "buckets", "le").otherwise(F.col("label"))
    content = F.when(F.col("kind") == "buckets", F.col("le")).when(F.col("label") == "status", F.when(F.col("event_type") == "error", "500").otherwise("200")).otherwise(F.col("label_value"))
    instance = F.concat(F.lit("node_"), (F.col("user_no") % 3).cast("string"))
    labels = F.when(name.isNull(), F.create_map(F.lit("instance"), instance)).otherwise(F.create_map(F.lit("instance"), instance, F.coalesce(name, F.lit("")), content))
    return both.select(ts.alias("ts"), "metric", labels.alias("labels"), value.alias("value"))


def _text(x):
    return "null" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::double"


_ROWS = ", ".join(f"({no}, {', '.join(_text(x) for x in m)}, {_text(le)}, {_text(share)})" for no, m in enumerate(METRICS) for le, share in (_BUCKETS if m[1] == "buckets" else ((None, 1.0),)))
VIEWS["metric_points"] = f"""
select timestamp '2024-01-01 00:00:00' + to_microseconds((epoch_us(ts) - epoch_us(timestamp '2024-01-01 00:00:00')) // 60) as ts, metric,
       concat('node_', user_no % 3) as instance, case when kind = 'buckets' then 'le' else label end as label,
       case when kind = 'buckets' then le when label = 'status' then case when event_type = 'error' then '500' else '200' end else label_value end as content,
       case when kind in ('counter', 'buckets') then floor(((event_id * factor) % 50000) * share) when kind = 'steps' then floor(event_id / 400)
            when kind = 'gauge' then value * factor when kind = 'state' then k % factor else factor end as value
from interactions join (values {_ROWS}) v(no, metric, kind, factor, label, label_value, le, share) on (event_id + no) % 4 = 0"""


def _sql(node):
    """A DuckDB subquery (labels, instance, label, content, tick, v) or a number."""
    if isinstance(node, (int, float)):
        return f"{float(node)!r}::double"
    if isinstance(node, op.Number):
        return f"{node.value!r}::double"
    if isinstance(node, op.Series):
        what = "arg_max(newest, held.tick)" if node.fn == "last" else f"sum(grown) / {node.seconds}::double" if node.fn == "rate" else "sum(grown)"
        where = "".join(f" and label = '{a}' and content = '{b}'" for a, b in node.labels) + "".join(f" and label = '{a}' and regexp_full_match(content, '{b}')" for a, b in node.like)
        return f"(select labels, instance, label, content, held.tick + d as tick, {what} as v from held, range({node.offset // 60}, {(node.offset + node.seconds) // 60}) r(d) where metric = '{node.metric}'{where} group by all)"
    if isinstance(node, Merge):
        key = "concat('instance=', instance)" if node.by else "''"
        return f"(select {key} as labels, {'instance' if node.by else 'null'} as instance, null as label, null as content, tick, {node.fn}(v) as v from {_sql(node.of)} group by all)"
    if isinstance(node, Quantile):
        return f"""(select labels, instance, null as label, null as content, tick, case when le = 'inf'::double then lo else lo + (le - lo) * coalesce((rank - before) / nullif(v - before, 0), 0) end as v from (
          select *, {node.q} * max(v) over k as rank, coalesce(lag(le) over o, 0) as lo, coalesce(lag(v) over o, 0) as before, max(v) over k as total from (
            select concat('instance=', instance) as labels, instance, tick, (case when content = '+Inf' then 'inf' else content end)::double as le, v from {_sql(node.of)})
          window k as (partition by labels, tick), o as (partition by labels, tick order by le))
        where total > 0 and v >= rank qualify row_number() over (partition by labels, tick order by le) = 1)"""
    a, b = _sql(node.left), _sql(node.right)
    put = lambda x, y: f"{x} / nullif({y}, 0)" if node.op == "/" else f"{x} {node.op} {y}"
    if a.startswith("(") and b.startswith("("):
        return f"(select a.labels, a.instance, a.label, a.content, tick, {put('a.v', 'b.v')} as v from {a} a join {b} b using (labels, tick))".replace("a.labels, a.instance", "labels, a.instance")
    if a.startswith("("):
        return f"(select labels, instance, label, content, tick, {put('v', b)} as v from {a})"
    return f"(select labels, instance, label, content, tick, {put(a, 'v')} as v from {b})"


def _rule_sql(rule):
    left, right = _sql(rule.expr), _sql(rule.limit)
    limit, source = ("b.v", f"{left} a join {right} b using (labels, tick)") if right.startswith("(") else (right, f"{left} a")
    return f"select '{rule.name}' as rule, '{rule.group}' as \"group\", '{rule.severity}' as severity, {rule.hold} as hold, labels, tick from {source} where a.v {rule.op} {limit}"


@query(
    "i6_rule_expressions",
    f"""with named as (
  select ts, metric, instance, label, content, value,
         case when label is null then concat('instance=', instance) when label < 'instance' then concat(label, '=', content, ',instance=', instance) else concat('instance=', instance, ',', label, '=', content) end as labels
  from metric_points
), steps as (
  select *, lag(value) over (partition by metric, labels order by ts, value) as b from named
), held as materialized (
  select metric, labels, instance, label, content, ceil(epoch_us(ts) / 60000000)::bigint as tick, sum(case when b is null then 0 when value < b then value else value - b end) as grown, arg_max(value, ts) as newest
  from steps group by all
), breaches as (
  {" union all ".join(_rule_sql(r) for r in RULES)}
), islands as (
  select *, tick - row_number() over (partition by rule, labels order by tick) as run from breaches
), runs as (
  select rule, "group", severity, hold, labels, min(tick) as first, max(tick) as last, count(*) as ticks from islands group by rule, "group", severity, hold, labels, run
)
select rule, "group", severity, labels, timestamp '1970-01-01 00:00:00' + to_seconds(first * 60) as started_at, timestamp '1970-01-01 00:00:00' + to_seconds(first * 60 + hold) as fired_at,
       timestamp '1970-01-01 00:00:00' + to_seconds(last * 60) as ended_at, ticks
from runs where (last - first) * 60 >= hold""",
)
def i6_expressions(spark, d):
    return op.firing_intervals(metric_points(spark, d), RULES)
