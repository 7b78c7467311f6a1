"""Queries of metric tables, rules and rollouts (I)."""

from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import metrics as op
from ..sources import fixtures as fx
from .registry import query

_BOUNDS = ", ".join(f"({i}, {b}::double)" for i, b in enumerate(op.LATENCY_BOUNDS)) + ", (14, 'infinity'::double)"
_HIST = f"hist as (select endpoint, bucket, le, count(*) filter (seconds <= le) as n from (select item_category as endpoint, value / 50 as seconds from interactions), (values {_BOUNDS}) v(bucket, le) group by all)"


def _timed(spark, d):
    return fx.interactions(spark, d).select("event_id", "ts", F.col("item_category").alias("endpoint"), (F.col("value") / 50).alias("seconds"), (F.col("event_type") != "error").alias("ok"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"))


def _ntz(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@query(
    "i1_counter_rate",
    """with s as (select *, lag(counter) over (partition by metric order by ts, counter) as b from counter_points), t as (select ts, metric, counter, case when b is null then 0 when counter < b then counter else counter - b end as step from s)
    select ts, metric, counter, (sum(step) over w)::bigint as increase, round(sum(step) over w / 86400.0::double, 6) as rate from t window w as (partition by metric order by ts range between interval 86400 seconds preceding and current row)""",
)
def i1(spark, d):
    return rounded(op.counter_rate(fx.counter_points(spark, d), 86400))


@query("i2_latency_histogram", f"with {_HIST} select endpoint, bucket::int as bucket, n from hist")
def i2(spark, d):
    return op.latency_histogram(_timed(spark, d)).select("endpoint", "bucket", "n")


@query(
    "i3_histogram_quantile",
    f"""with {_HIST}, o as (select *, coalesce(lag(le) over w, 0) as lo, coalesce(lag(n) over w, 0) as before, max(n) over (partition by endpoint) as total from hist window w as (partition by endpoint order by bucket)),
    f as (select * from o where n >= 0.95 * total qualify row_number() over (partition by endpoint order by bucket) = 1)
    select endpoint, round(case when le = 'infinity'::double then lo else lo + (le - lo) * (0.95 * total - before) / (n - before) end, 6) as quantile from f""",
)
def i3(spark, d):
    return rounded(op.histogram_quantile(op.latency_histogram(_timed(spark, d)), 0.95))


@query(
    "i4_ratio_metrics",
    """with c as (select time_bucket(interval 1 day, ts) as window_start, count(*) as events, count(*) filter (event_type = 'error') as e, count(*) filter (event_type = 'click') as c, count(*) filter (event_type = 'view') as v, count(*) filter (event_type = 'purchase') as p, avg(value) as m from interactions group by all)
    select window_start, events, round(e / events, 6) as error_rate, round(coalesce(c / nullif(v, 0), 0), 6) as ctr, round(coalesce(p / nullif(c, 0), 0), 6) as conversion_rate, round((c + p) / events, 6) as engagement_rate, round(m, 6) as mean_value from c""",
)
def i4(spark, d):
    return rounded(_ntz(op.ratio_metrics(fx.interactions(spark, d), "1 day"), "window_start"))


@query(
    "i4_recent_ctr",
    "select event_id, round(coalesce(count(*) filter (event_type = 'click') over w / nullif(count(*) filter (event_type = 'view') over w, 0), 0), 6) as ctr from interactions window w as (partition by user_id order by ts, event_id rows between 19 preceding and current row)",
)
def i4_recent(spark, d):
    return rounded(op.recent_ctr(fx.interactions(spark, d), 20).select("event_id", "ctr"))


@query(
    "i5_baseline_drop",
    """with b as (select event_id, avg(value) over (partition by event_type order by ts range between interval 86400 seconds preceding and current row) as cur, avg(value) over (partition by event_type order by ts range between interval 691200 seconds preceding and interval 86400 seconds preceding) as base from interactions)
    select event_id, round(cur, 10) as current, round(base, 10) as baseline, coalesce(cur < 0.8 * base, false) as dropped from b""",
)
def i5(spark, d):
    rows = fx.interactions(spark, d).select("event_id", "ts", F.col("event_type").alias("metric"), F.col("value").alias("x"))
    return rounded(op.baseline_drop(rows, short=86400, long=604800, offset=86400, factor=0.8).select("event_id", "current", "baseline", "dropped"), 10)


_RULES = [("slow", "value", ">", 90.0, 600, "critical"), ("low", "value", "<", 40.0, 3600, "warning"), ("high_k", "k", ">", 70.0, 0, "info")]


@query(
    "i6_evaluate_rules",
    """with m as (select ts, 'value' as metric, event_type as label, value from interactions union all select ts, 'k', event_type, k from interactions),
    r(rule, metric, op, threshold, for_seconds, severity) as (values ('slow', 'value', '>', 90.0::double, 600, 'critical'), ('low', 'value', '<', 40.0::double, 3600, 'warning'), ('high_k', 'k', '>', 70.0::double, 0, 'info')),
    b as (select r.*, label, ts, case when op = '>' then value > threshold else value < threshold end as breach from m join r using (metric)),
    i as (select *, sum((not breach)::int) over (partition by rule, label order by ts rows unbounded preceding) as island from b),
    g as (select rule, severity, label, for_seconds, island, min(ts) as started_at, max(ts) as ended_at, count(*) as points from i where breach group by all)
    select rule, severity, label, started_at, started_at + to_seconds(for_seconds) as fired_at, ended_at, points from g where ended_at >= started_at + to_seconds(for_seconds)""",
)
def i6(spark, d):
    i = fx.interactions(spark, d)
    point = lambda name: i.select("ts", F.lit(name).alias("metric"), F.col("event_type").alias("label"), F.col(name).cast("double").alias("value"))
    rules = spark.createDataFrame(_RULES, "rule string, metric string, op string, threshold double, for_seconds int, severity string")
    return op.evaluate_rules(point("value").unionByName(point("k")), rules)


@query(
    "i7_slo_status",
    "select time_bucket(interval 1 day, ts) as window_start, round(avg((value / 50 <= 1.5)::int), 6) as fast_share, avg((value / 50 <= 1.5)::int) >= 0.78 as latency_met, round(avg((event_type = 'error')::int), 6) as error_share, avg((event_type = 'error')::int) > 0.2 as burning from interactions group by 1",
)
def i7(spark, d):
    out = op.slo_status(_timed(spark, d), latency=1.5, target=0.78, availability=1 - 0.2 * 30 * 24 / 14)
    return rounded(_ntz(out, "window_start"))


@query(
    "i8_request_metrics",
    "select time_bucket(interval 1 day, ts) as window_start, item_category as endpoint, count(*) as n, round(quantile_cont(value / 50, 0.5), 6) as p50, round(quantile_cont(value / 50, 0.95), 6) as p95, round(quantile_cont(value / 50, 0.99), 6) as p99, round(avg((event_type = 'error')::int), 6) as error_share, round(count(*) / 86400.0::double, 6) as qps from interactions group by all",
)
def i8(spark, d):
    return rounded(_ntz(op.request_metrics(_timed(spark, d)), "window_start"))


@query("i9_recommendation_metrics", "select event_type as experiment, count(*) as lists, round(avg(k), 6) as mean_items, round(avg(value), 6) as mean_latency_ms, round(avg((event_id % 3 = 0)::int), 6) as cache_hit_share from interactions group by 1")
def i9(spark, d):
    rows = fx.interactions(spark, d).select(F.col("event_type").alias("experiment"), F.col("k").alias("n_items"), F.col("value").alias("latency_ms"), (F.col("event_id") % 3 == 0).alias("cache_hit"))
    return rounded(op.recommendation_metrics(rows))


@query(
    "i10_relabel",
    "select event_id, 'user=' || user_id || ',zone=' || 'z' || (k % 10) || ',env=' || case when event_id % 2 = 0 then 'test' else 'prod' end || ',n=' || (case when event_id % 2 = 0 then 4 else 4 end) as labels from interactions where event_type <> 'error'",
)
def i10(spark, d):
    i = fx.interactions(spark, d)
    labels = F.create_map(F.lit("uid"), F.col("user_id"), F.lit("cat"), F.col("item_category"), F.lit("api_Token"), F.lit("x"))
    labels = F.when(F.col("event_id") % 2 == 0, F.map_concat(labels, F.create_map(F.lit("env"), F.lit("test")))).otherwise(labels)
    out = op.relabel(i.select("event_id", F.col("event_type").alias("metric"), labels.alias("labels")), drop="^err", keep="^[a-z]+$", rename={"uid": "user"}, rewrite=("cat", r"^cat_(\d+)$", "z$1", "zone"), defaults={"env": "prod"})
    get = lambda k: F.try_element_at("labels", F.lit(k))
    text = F.concat(F.lit("user="), get("user"), F.lit(",zone="), get("zone"), F.lit(",env="), get("env"), F.lit(",n="), F.size("labels").cast("string"))
    return out.select("event_id", text.alias("labels"))


@query(
    "i11_incident_impact",
    """with a as (select phase, count(*)::double as qps, avg(value) as latency, avg((event_type = 'error')::int) as error_rate, avg((event_type = 'view')::int) as hit_rate from phases group by 1), b as (select * from a where phase = 'baseline'), i as (select * from a where phase = 'incident')
    select round(1 - i.qps / b.qps, 6) as qps_drop, round(i.latency / b.latency, 6) as latency_ratio, round(i.error_rate - b.error_rate, 6) as error_increase, round(b.hit_rate - i.hit_rate, 6) as hit_rate_drop,
    case when i.error_rate - b.error_rate > 0.5 then 'failed' when 1 - i.qps / b.qps > 0.5 or i.latency / b.latency > 3 then 'degraded' else 'healthy' end as verdict from a cross join b cross join i limit 1""",
)
def i11(spark, d):
    p = fx.phases(spark, d).groupBy("phase").agg(
        F.count(F.lit(1)).cast("double").alias("qps"), F.avg("value").alias("latency"), F.avg((F.col("event_type") == "error").cast("double")).alias("error_rate"), F.avg((F.col("event_type") == "view").cast("double")).alias("hit_rate")
    )
    return rounded(op.incident_impact(p.unpivot("phase", ["qps", "latency", "error_rate", "hit_rate"], "metric", "value")))


_CANARY = "c as (select rollout, 'success' as metric, check_day, success_rate >= 0.75 as ok from checks union all select rollout, 'volume', check_day, n >= 60 from checks)"


def _canary(spark, d):
    c = fx.checks(spark, d)
    return c.select("rollout", F.lit("success").alias("metric"), F.col("check_day").alias("check_at"), (F.col("success_rate") >= 0.75).alias("ok")).unionByName(c.select("rollout", F.lit("volume").alias("metric"), F.col("check_day").alias("check_at"), (F.col("n") >= 60).alias("ok")))


@query(
    "i12_canary_verdict",
    f"""with {_CANARY}, e as (select rollout, metric, count(*) filter (not ok) as bad, count(*) as n from c group by all), r as (select rollout, max(bad) as worst, 100 * (1 - sum(bad) / sum(n)) as score from e group by 1)
    select rollout, worst, round(score, 6) as score, case when worst > 3 or score < 80 then 'fail' when score >= 95 then 'pass' else 'inconclusive' end as verdict from r""",
)
def i12(spark, d):
    return rounded(op.canary_verdict(_canary(spark, d)))


@query(
    "i12_canary_of_limits",
    """with m as (select user_no % 5 as rollout, day(ts) as check_no, avg((event_type <> 'error')::int) as s, quantile_cont(value / 500, 0.95) as p, avg((event_type = 'error')::int) as e from interactions group by all),
    c as (select rollout, 'success' as metric, s >= 0.75 as ok from m union all select rollout, 'p95', p <= 0.2 from m union all select rollout, 'error', e <= 0.3 from m),
    g as (select rollout, metric, count(*) filter (not ok) as bad, count(*) as n from c group by all), r as (select rollout, max(bad) as worst, 100 * (1 - sum(bad) / sum(n)) as score from g group by 1)
    select rollout, worst, round(score, 6) as score, case when worst > 3 or score < 80 then 'fail' when score >= 95 then 'pass' else 'inconclusive' end as verdict from r""",
)
def i12_limits(spark, d):
    error = (F.col("event_type") == "error").cast("double")
    rows = fx.interactions(spark, d).groupBy((F.col("user_no") % 5).alias("rollout"), F.day("ts").alias("check_no")).agg(F.avg(1 - error).alias("success_rate"), F.percentile(F.col("value") / 500, 0.95).alias("p95_seconds"), F.avg(error).alias("error_rate"))
    return rounded(op.canary_verdict(op.canary_checks(rows, success=0.75, p95=0.2, error=0.3)))


@query(
    "i6_rules_by_label",
    """with m as (select time_bucket(interval 6 hours, ts) as ts, item_category as label, avg(value) as value from interactions group by all),
    b as (select *, value > 52 as breach from m), i as (select *, sum((not breach)::int) over (partition by label order by ts rows unbounded preceding) as island from b),
    g as (select label, island, min(ts) as started_at, max(ts) as ended_at, count(*) as points from i where breach group by all)
    select 'busy' as rule, 'warning' as severity, label, started_at, started_at + interval 21600 seconds as fired_at, ended_at, points from g where ended_at >= started_at + interval 21600 seconds""",
)
def i6_label(spark, d):
    rows = fx.interactions(spark, d).select("ts", F.lit("load").alias("metric"), F.create_map(F.lit("category"), F.col("item_category"), F.lit("user"), F.col("user_id")).alias("labels"), "value")
    rules = spark.createDataFrame([("busy", "load", ">", 52.0, 21600, "warning")], "rule string, metric string, op string, threshold double, for_seconds int, severity string")
    return _ntz(op.evaluate_rules(op.label_means(rows, "category", window="6 hours"), rules), "started_at", "fired_at", "ended_at")


@query(
    "i13_rollback_triggers",
    """with c as (select rollout, check_day, success_rate >= 0.8 as ok from checks), i as (select *, sum(ok::int) over (partition by rollout order by check_day rows unbounded preceding) as island from c),
    n as (select *, row_number() over (partition by rollout, island order by check_day) as nth from i where not ok)
    select rollout, min(check_day) as started_at, count(*) as failures, max(check_day) filter (nth = 2) as triggered_at from n group by rollout, island having count(*) >= 2""",
)
def i13(spark, d):
    c = fx.checks(spark, d).select("rollout", F.col("check_day").alias("check_at"), (F.col("success_rate") >= 0.8).alias("ok"))
    return op.rollback_triggers(c, consecutive=2)


@query(
    "i13_relative_drops",
    """with b as (select rollout, avg(n) as base_n, avg(success_rate) as base_s from checks where check_day < date '2024-01-11' group by 1)
    select rollout, check_day, 'qps' as metric, round(1 - n / base_n, 6) as drop, 1 - n / base_n > 0.2 as rollback from checks join b using (rollout) union all select rollout, check_day, 'ctr', round(1 - success_rate / base_s, 6), 1 - success_rate / base_s > 0.1 from checks join b using (rollout)""",
)
def i13_drops(spark, d):
    c = fx.checks(spark, d)
    base = c.where("check_day < date '2024-01-11'").groupBy("rollout").agg(F.avg("n").alias("bn"), F.avg("success_rate").alias("bs"))
    rows = c.join(base, "rollout")
    each = rows.select("rollout", "check_day", F.lit("qps").alias("metric"), F.col("n").cast("double").alias("value"), F.col("bn").alias("baseline")).unionByName(rows.select("rollout", "check_day", F.lit("ctr").alias("metric"), F.col("success_rate").alias("value"), F.col("bs").alias("baseline")))
    return rounded(op.relative_drop_triggers(each, limits={"qps": 0.2, "ctr": 0.1}).select("rollout", "check_day", "metric", "drop", "rollback"))


@query(
    "i14_rate_limit_audit",
    """with r as (select event_id, ts, case when event_id % 4 = 0 then 'ip:10.0.0.' || (k % 8) else 'user:' || user_id end as key from interactions),
    w as (select *, count(*) over x as n, min(ts) over x as first_ts from r window x as (partition by key order by ts range between interval 86400 seconds preceding and current row))
    select event_id, key, n, n > 3 as limited, case when n > 3 then round(86400 - (epoch_us(ts) - epoch_us(first_ts)) / 1000000.0::double, 6) end as retry_after from w""",
)
def i14(spark, d):
    i = fx.interactions(spark, d)
    r = i.select("event_id", "ts", F.when(F.col("event_id") % 4 != 0, F.col("user_id")).alias("user_id"), F.concat(F.lit("10.0.0."), (F.col("k") % 8).cast("string")).alias("ip"))
    return rounded(op.rate_limit_audit(r, limit=3, seconds=86400).select("event_id", "key", "n", "limited", "retry_after"))
