"""Counters, histograms, rules, objectives and rollouts on metric tables (I)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_ratio
from .quantiles import exact_quantiles
from .rules import compared
from .slabs import carried, micros, ranged, reset_steps, windowed

#: Upper bounds of the latency histogram in seconds (fixed values).
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)
SECRET_NAMES = "password|secret|token"


def _plus(a: Column, b: Column) -> Column:
    return a + b


def counter_rate(df: DataFrame, seconds: int, *, keys: str = "metric", ts: str = "ts", value: str = "counter") -> DataFrame:
    """Add increase and rate over the trailing window; a fall is a reset and counts from 0.

    Steps carry the last value over range partitions and windows are cut by time, so that
    few metrics are still many tasks.
    """
    rows = windowed(reset_steps(df, [keys], ts, value), [keys], ts, seconds * 1_000_000, {"increase": (F.sum, F.col("step"), _plus)})
    return rows.withColumn("rate", F.col("increase") / float(seconds)).drop("step")


def latency_histogram(df: DataFrame, *, keys: tuple[str, ...] = ("endpoint",), value: str = "seconds", bounds: tuple[float, ...] = LATENCY_BOUNDS) -> DataFrame:
    """Cumulative counts per bound; the last bound is +Inf."""
    counts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)] + [F.count(value).alias(f"b{len(bounds)}")]
    wide = df.groupBy(*keys).agg(*counts)
    rows = F.array(*[F.struct(F.lit(i).alias("bucket"), F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate((*bounds, float("inf")))])
    return wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def histogram_quantile(hist: DataFrame, q: float, *, keys: tuple[str, ...] = ("endpoint",)) -> DataFrame:
    """Quantile by linear interpolation inside its bucket; in +Inf the top finite bound."""
    order = Window.partitionBy(*keys).orderBy("bucket")
    rows = hist.select("*", F.coalesce(F.lag("le").over(order), F.lit(0.0)).alias("lo"), F.coalesce(F.lag("n").over(order), F.lit(0)).alias("before"), F.max("n").over(Window.partitionBy(*keys)).alias("total"))
    hit = rows.where(F.col("n") >= q * F.col("total"))
    first = hit.groupBy(*keys).agg(F.min_by(F.struct("le", "lo", "n", "before", "total"), "bucket").alias("h")).select(*keys, "h.*")
    inside = F.col("lo") + (F.col("le") - F.col("lo")) * F.coalesce(F.try_divide(q * F.col("total") - F.col("before"), F.col("n") - F.col("before")), F.lit(0.0))
    return first.select(*keys, F.when(F.col("total") > 0, F.when(F.col("le") == float("inf"), F.col("lo")).otherwise(inside)).alias("quantile"))


def ratio_metrics(df: DataFrame, window: str, *, ts: str = "ts") -> DataFrame:
    """Per window: views, error rate, CTR, conversion, engagement and mean value, 0 without a base."""
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    rows = df.groupBy(F.window(ts, window).alias("w")).agg(
        F.count(F.lit(1)).alias("events"), safe_ratio(n("error"), F.count(F.lit(1))).alias("error_rate"), safe_ratio(n("click"), n("view")).alias("ctr"),
        safe_ratio(n("purchase"), n("click")).alias("conversion_rate"), safe_ratio(F.count_if(F.col("event_type").isin("click", "like", "share", "add_to_cart", "purchase")), F.count(F.lit(1))).alias("engagement_rate"),
        F.avg("value").alias("mean_value"),
    )
    return rows.select(F.col("w.start").alias("window_start"), *[c for c in rows.columns if c != "w"])


def recent_ctr(df: DataFrame, n: int = 10_000, *, ts: str = "ts", keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Add ctr over the last `n` interactions of a key."""
    w = Window.partitionBy(*keys).orderBy(ts, "event_id").rowsBetween(-(n - 1), 0)
    return df.withColumn("ctr", safe_ratio(F.count_if(F.col("event_type") == "click").over(w), F.count_if(F.col("event_type") == "view").over(w)))


def baseline_drop(df: DataFrame, *, short: int, long: int, offset: int, factor: float, keys: str = "metric", ts: str = "ts", value: str = "x") -> DataFrame:
    """Add current (short window mean), baseline (long window mean that ended `offset`
    seconds ago) and dropped = current < factor * baseline."""
    x = F.col(value).cast("double")
    sums = {"__sum": (F.sum, x, _plus), "__n": (F.count, x, _plus)}
    for name, reach, ago in (("current", short, 0), ("baseline", long + offset, offset)):
        df = windowed(df, [keys], ts, reach * 1_000_000, sums, offset=ago * 1_000_000)
        df = df.withColumn(name, F.try_divide("__sum", "__n")).drop("__sum", "__n")
    return df.withColumn("dropped", F.coalesce(F.col("current") < factor * F.col("baseline"), F.lit(False)))


def label_means(metrics: DataFrame, by: str, *, window: str = "1 minute") -> DataFrame:
    """Metric rows (ts, metric, label, value) averaged over the label `by` of their map
    `labels` and a window: what a rule of a grouped average looks at."""
    rows = metrics.groupBy(F.window("ts", window).alias("w"), "metric", F.try_element_at("labels", F.lit(by)).alias("label")).agg(F.avg("value").alias("value"))
    return rows.select(F.col("w.start").alias("ts"), "metric", "label", "value")


def evaluate_rules(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Firing intervals: rule, severity, label, started_at, fired_at, ended_at, points.

    `metrics`: ts, metric, label, value; `rules`: rule, metric, op (one of > >= < <= == !=,
    any other is an error), threshold, for_seconds, severity.  Points of a rule and label that
    breach without a break form a run; it fires once it lasts `for_seconds`.  Runs are counted
    over range partitions of rule, label and time.  `rules.firing_intervals` takes whole
    expressions.
    """
    rows = metrics.join(rules, "metric")
    rows = rows.withColumn("breach", F.coalesce(compared(F.col("op"), F.col("value"), F.col("threshold")), F.lit(False)))
    quiet = F.when(~F.col("breach"), 1).otherwise(0)
    own = lambda w: F.sum(quiet).over(w.rowsBetween(Window.unboundedPreceding, 0))
    scans = {"island": (own, F.sum(quiet), lambda w: F.sum("island").over(w), lambda a, b: a + F.coalesce(b, F.lit(0)))}
    counted = carried(ranged(rows, "rule", "label", "ts"), ["rule", "label"], ["ts"], scans)
    runs = counted.where("breach").groupBy("rule", "severity", "label", "for_seconds", "island").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count(F.lit(1)).alias("points"))
    fired = F.col("started_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("for_seconds"))
    return runs.withColumn("fired_at", fired).where(F.col("ended_at") >= F.col("fired_at")).select("rule", "severity", "label", "started_at", "fired_at", "ended_at", "points")


def slo_status(df: DataFrame, *, window: str = "1 day", ts: str = "ts", seconds: str = "seconds", ok: str = "ok", latency: float = 0.1, target: float = 0.95, availability: float = 0.999) -> DataFrame:
    """Per window: latency share and whether it meets `target`, error share, and whether errors
    burn the 30-day budget 14 times too fast."""
    rows = df.groupBy(F.window(ts, window).alias("w")).agg(F.avg((F.col(seconds) <= latency).cast("double")).alias("fast_share"), F.avg((~F.col(ok)).cast("double")).alias("error_share"))
    budget = (1 - availability) / (30 * 24 * 3600) * 14 * 3600
    return rows.select(F.col("w.start").alias("window_start"), "fast_share", (F.col("fast_share") >= target).alias("latency_met"), "error_share", (F.col("error_share") > budget).alias("burning"))


def request_metrics(df: DataFrame, *, window: str = "1 day", ts: str = "ts", seconds: float = 86400.0) -> DataFrame:
    """Per endpoint and window: requests, latency percentiles, error share, requests a second."""
    rows = df.withColumn("window_start", F.window(ts, window)["start"])
    counts = rows.groupBy("window_start", "endpoint").agg(F.count(F.lit(1)).alias("n"), safe_ratio(F.count_if(F.col("status") >= 500), F.count(F.lit(1))).alias("error_share"))
    quantiles = exact_quantiles(rows, ["window_start", "endpoint"], "seconds", (0.5, 0.95, 0.99)).withColumnsRenamed({"window_start": "w", "endpoint": "e"})
    both = counts.join(quantiles, F.col("window_start").eqNullSafe(F.col("w")) & F.col("endpoint").eqNullSafe(F.col("e")), "left")
    return both.select("window_start", "endpoint", "n", F.col("q0").alias("p50"), F.col("q1").alias("p95"), F.col("q2").alias("p99"), "error_share", (F.col("n") / seconds).alias("qps"))


def recommendation_metrics(df: DataFrame) -> DataFrame:
    """Per experiment: lists served, mean items, mean latency, cache-hit share."""
    return df.groupBy("experiment").agg(F.count(F.lit(1)).alias("lists"), F.avg("n_items").alias("mean_items"), F.avg("latency_ms").alias("mean_latency_ms"), F.avg(F.col("cache_hit").cast("double")).alias("cache_hit_share"))


def relabel(df: DataFrame, *, drop: str | None = None, keep: str | None = None, rewrite: tuple[str, str, str, str] | None = None, rename: dict[str, str] | None = None, defaults: dict[str, str] | None = None) -> DataFrame:
    """Metric rows (metric, labels map, value) after relabelling.

    `drop` and `keep` are patterns of the name; `rewrite` (source, pattern, replacement,
    target) sets a label from a capture group; `rename` maps label names; labels whose
    name holds password, secret or token go; `defaults` fill absent labels.
    """
    rows = df
    if drop:
        rows = rows.where(~F.col("metric").rlike(drop))
    if keep:
        rows = rows.where(F.col("metric").rlike(keep))
    labels = F.map_filter("labels", lambda k, v: ~F.lower(k).rlike(SECRET_NAMES))
    if rename:
        names = F.create_map(*[F.lit(x) for pair in rename.items() for x in pair])
        labels = F.transform_keys(labels, lambda k, v: F.coalesce(F.try_element_at(names, k), k))
    rows = rows.withColumn("labels", labels)
    if rewrite:
        source, pattern, replacement, target = rewrite
        value = F.try_element_at("labels", F.lit(source))
        new = F.when(value.rlike(pattern), F.regexp_replace(value, pattern, replacement))
        rows = rows.withColumn("labels", F.when(new.isNotNull(), F.map_concat(F.map_filter("labels", lambda k, v: k != target), F.create_map(F.lit(target), new))).otherwise(F.col("labels")))
    for name, value in (defaults or {}).items():
        rows = rows.withColumn("labels", F.when(F.map_contains_key("labels", name), F.col("labels")).otherwise(F.map_concat("labels", F.create_map(F.lit(name), F.lit(value)))))
    return rows


def incident_impact(metrics: DataFrame) -> DataFrame:
    """One row from (phase, metric, value) of qps, latency, error_rate and hit_rate: changes
    from baseline to incident, and the verdict."""
    wide = metrics.groupBy("metric").pivot("phase", ["baseline", "incident", "recovery"]).agg(F.avg("value"))
    pick = lambda m, p: F.max(F.when(F.col("metric") == m, F.col(p)))
    row = wide.agg(
        (1 - F.try_divide(pick("qps", "incident"), pick("qps", "baseline"))).alias("qps_drop"), F.try_divide(pick("latency", "incident"), pick("latency", "baseline")).alias("latency_ratio"),
        (pick("error_rate", "incident") - pick("error_rate", "baseline")).alias("error_increase"), (pick("hit_rate", "baseline") - pick("hit_rate", "incident")).alias("hit_rate_drop"),
    )
    verdict = F.when(F.col("error_increase") > 0.5, "failed").when((F.col("qps_drop") > 0.5) | (F.col("latency_ratio") > 3), "degraded").otherwise("healthy")
    return row.withColumn("verdict", verdict)


def canary_checks(rows: DataFrame, *, success: float = 0.95, p95: float = 0.1, error: float = 0.01) -> DataFrame:
    """(rollout, metric, check_no, ok) from (rollout, check_no, success_rate, p95_seconds,
    error_rate) by the limits of a canary; a null measurement fails."""
    limits = F.array(*[
        F.struct(F.lit(name).alias("metric"), F.coalesce(ok, F.lit(False)).alias("ok"))
        for name, ok in (("success", F.col("success_rate") >= success), ("p95", F.col("p95_seconds") <= p95), ("error", F.col("error_rate") <= error))
    ])
    return rows.select("rollout", "check_no", F.explode(limits).alias("c")).select("rollout", "c.metric", "check_no", "c.ok")


def canary_verdict(checks: DataFrame, *, max_failures: int = 3, pass_score: float = 95.0, fail_score: float = 80.0) -> DataFrame:
    """Per rollout over (rollout, metric, check_no, ok): failed checks of its worst metric,
    score = share of good checks in percent, verdict."""
    each = checks.groupBy("rollout", "metric").agg(F.count_if(~F.col("ok")).alias("bad"), F.count(F.lit(1)).alias("n"))
    rows = each.groupBy("rollout").agg(F.max("bad").alias("worst"), (100.0 * (1 - F.sum("bad") / F.sum("n"))).alias("score"))
    verdict = F.when((F.col("worst") > max_failures) | (F.col("score") < fail_score), "fail").when(F.col("score") >= pass_score, "pass").otherwise("inconclusive")
    return rows.withColumn("verdict", verdict)


def rollback_triggers(checks: DataFrame, *, consecutive: int = 3) -> DataFrame:
    """Runs of `consecutive` or more failing checks: rollout, started_at, failures, and
    triggered_at, the check that completes them."""
    order = Window.partitionBy("rollout").orderBy("check_at")
    run = F.row_number().over(order) - F.row_number().over(Window.partitionBy("rollout", "ok").orderBy("check_at"))
    rows = checks.withColumn("run", run).where(~F.col("ok"))
    nth = F.row_number().over(Window.partitionBy("rollout", "run").orderBy("check_at"))
    rows = rows.withColumn("nth", nth).groupBy("rollout", "run").agg(F.min("check_at").alias("started_at"), F.max("nth").cast("long").alias("failures"), F.max(F.when(F.col("nth") == consecutive, F.col("check_at"))).alias("triggered_at"))
    return rows.where(F.col("failures") >= consecutive).select("rollout", "started_at", "failures", "triggered_at")


def relative_drop_triggers(df: DataFrame, *, limits: dict[str, float]) -> DataFrame:
    """Rows of (rollout, metric, baseline, value) with drop and whether it exceeds the metric's limit."""
    limit = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])
    drop = F.coalesce(1 - F.try_divide("value", "baseline"), F.lit(0.0))
    return df.withColumn("drop", drop).withColumn("rollback", F.coalesce(F.col("drop") > F.try_element_at(limit, F.col("metric")), F.lit(False)))


def rate_limit_audit(requests: DataFrame, *, limit: int = 1000, seconds: int = 60) -> DataFrame:
    """Add key (user, else address), requests in the trailing window, limited, retry_after seconds."""
    key = F.when(F.col("user_id").isNotNull(), F.concat(F.lit("user:"), "user_id")).otherwise(F.concat(F.lit("ip:"), F.col("ip")))
    at = micros("ts")
    rows = windowed(requests.withColumn("key", key), ["key"], "ts", seconds * 1_000_000, {"n": (F.count, F.lit(1), _plus), "__first": (F.min, at, F.least)})
    rows = rows.withColumn("limited", F.col("n") > limit)
    left = seconds - (at - F.col("__first")) / F.lit(1e6)
    return rows.withColumn("retry_after", F.when(F.col("limited"), left)).drop("__first")
