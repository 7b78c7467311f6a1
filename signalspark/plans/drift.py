"""Queries of drift detection (H)."""

from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import drift as op
from ..sources import fixtures as fx
from .registry import query


def _sides(df):
    return df.where("side = 'ref'").select("feature", "x"), df.where("side = 'cur'").select("feature", "x")


def _samples(spark, d):
    return _sides(fx.drift_samples(spark, d))


def _psi_sql(edges, name="psi"):
    return f"""{name}_edges as ({edges}),
{name}_rows as (select s.feature, side, case when len(list_filter(edges, lambda e: e <= x)) > 0 and x <= edges[-1] then least(len(list_filter(edges, lambda e: e <= x)), len(edges) - 1) end as bucket from drift_samples s join {name}_edges using (feature)),
{name}_tot as (select feature, count(*) filter (side = 'ref') as t_ref, count(*) filter (side = 'cur') as t_cur from {name}_rows group by 1),
{name}_full as (select e.feature, b.bucket, edges, (select count(*) from {name}_rows r where r.feature = e.feature and r.bucket = b.bucket and side = 'ref') as n_ref, (select count(*) from {name}_rows r where r.feature = e.feature and r.bucket = b.bucket and side = 'cur') as n_cur, t_ref, t_cur
  from {name}_edges e join {name}_tot using (feature), lateral (select unnest(range(1, len(edges))) as bucket) b)"""


_QUANTILES = "select feature, list_sort(list_distinct(quantile_cont(x, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) as edges from drift_samples where side = 'ref' group by 1"
_WIDTH = "select feature, [min(x) + (max(x) - min(x)) * i / {n} for i in range({n} + 1)] as edges from drift_samples where {where} group by 1"
_SHARE = "case when n_ref = 0 then 0.0001 else n_ref / t_ref end as p, case when n_cur = 0 then 0.0001 else n_cur / t_cur end as q"
_PSI = _psi_sql(_QUANTILES)
_KL = _psi_sql("select feature, list_transform(range(51), lambda i: lo + (hi - lo) * i / 50) as edges from (select feature, min(x) as lo, max(x) as hi from drift_samples where side = 'ref' group by 1)", "kl")
_KL_ROWS = """kl_density as (select feature, n_ref / sum(n_ref) over w / (edges[bucket + 1] - edges[bucket]) + 1e-10 as p, n_cur / sum(n_cur) over w / (edges[bucket + 1] - edges[bucket]) + 1e-10 as q from kl_full window w as (partition by feature)),
kl_norm as (select feature, p / sum(p) over w as p, q / sum(q) over w as q from kl_density window w as (partition by feature)), kl_out as (select feature, sum(p * ln(p / q)) as kl from kl_norm group by 1)"""
_STEPS = """st_counts as (select feature, x, count(*) filter (side = 'ref') as a, count(*) filter (side = 'cur') as b from drift_samples group by all),
st as (select feature, x, sum(a) over o / sum(a) over w as f, sum(b) over o / sum(b) over w as g, sum(a) over w as n, sum(b) over w as m, lead(x) over (partition by feature order by x) as nx
  from st_counts window w as (partition by feature), o as (partition by feature order by x rows unbounded preceding)),
ks_stat as (select feature, max(abs(f - g)) as ks, sqrt(max(n) * max(m) / (max(n) + max(m))) * max(abs(f - g)) as t from st group by 1),
ks_out as (select feature, ks, case when t < 0.2 then 1 else greatest(0, least(1, list_sum(list_transform(range(1, 101), lambda j: (case when j % 2 = 1 then 2 else -2 end) * exp(-2.0::double * j * j * t * t))))) end as ks_p from ks_stat)"""
_PSI_OUT = f"psi_out as (select feature, sum((q - p) * ln(q / p)) as psi from (select feature, {_SHARE} from psi_full) group by 1)"
_METRICS = f"{_PSI}, {_PSI_OUT}, {_KL}, {_KL_ROWS}, {_STEPS}, metrics as (select feature, t_ref as n_ref, t_cur as n_cur, psi, kl, ks, ks_p, psi > 0.1 or kl > 0.1 or ks_p < 0.05 as drift, least(1, 0.4 * least(psi / 0.1, 1) + 0.3 * least(kl / 0.1, 1) + 0.3 * (1 - ks_p)) as confidence from psi_out join kl_out using (feature) join ks_out using (feature) join psi_tot using (feature))"


@query("h1_psi", f"with {_PSI}, {_PSI_OUT} select feature, round(psi, 6) as psi from psi_out")
def h1(spark, d):
    return rounded(op.psi(*_samples(spark, d)))


@query("h2_psi_width", f"with {_psi_sql('select feature, list_transform(range(11), lambda i: lo + (hi - lo) * i / 10) as edges from (select feature, min(x) as lo, max(x) as hi from drift_samples where side = ' + chr(39) + 'ref' + chr(39) + ' group by 1)')}, {_PSI_OUT} select feature, round(psi, 6) as psi from psi_out")
def h2(spark, d):
    return rounded(op.psi(*_samples(spark, d), kind="width"))


@query("h3_kl_divergence", f"with {_KL}, {_KL_ROWS} select feature, round(kl, 6) as kl from kl_out")
def h3(spark, d):
    return rounded(op.kl_divergence(*_samples(spark, d)))


@query("h4_ks_test", f"with {_STEPS} select feature, round(ks, 6) as ks, round(ks_p, 6) as ks_p from ks_out")
def h4(spark, d):
    return rounded(op.ks_test(*_samples(spark, d)))


_CHI = _psi_sql("select feature, list_transform(range(11), lambda i: lo + (hi - lo) * i / 10) as edges from (select feature, min(x) as lo, max(x) as hi from drift_samples group by 1)", "chi")


@query(
    "h5_chi_square",
    f"""with {_CHI}, c as (select *, (n_ref + n_cur) * t_ref / (t_ref + t_cur) as er, (n_ref + n_cur) * t_cur / (t_ref + t_cur) as ec from chi_full where n_ref + n_cur > 0)
    select feature, round(sum(pow(n_ref - er, 2) / er + pow(n_cur - ec, 2) / ec), 6) as chi2, (count(*) - 1)::int as dof from c group by 1""",
)
def h5(spark, d):
    return rounded(op.chi_square(*_samples(spark, d)).select("feature", "chi2", "dof"))


@query("h6_wasserstein", f"with {_STEPS} select feature, round(sum(coalesce(abs(f - g) * (nx - x), 0)), 6) as wasserstein from st group by 1")
def h6(spark, d):
    return rounded(op.wasserstein(*_samples(spark, d)))


@query("h7_feature_drift", f"with {_METRICS} select feature, n_ref, n_cur, round(psi, 6) as psi, round(kl, 6) as kl, round(ks, 6) as ks, round(ks_p, 6) as ks_p, drift, round(confidence, 6) as confidence from metrics")
def h7(spark, d):
    return rounded(op.feature_drift(*_samples(spark, d), min_n=100))


@query(
    "h8_model_drift",
    f"with {_METRICS} select 'm' as model, round(avg(psi), 6) as psi_mean, round(avg(kl), 6) as kl_mean, round(avg(ks_p), 6) as p_mean, round(avg(confidence), 6) as confidence_mean, avg(psi) > 0.1 or avg(kl) > 0.1 or avg(ks_p) < 0.05 as drift, count(*)::int as n_features from metrics",
)
def h8(spark, d):
    f = op.feature_drift(*_samples(spark, d), min_n=100).withColumn("model", F.lit("m"))
    return rounded(op.model_drift(f).select("model", "psi_mean", "kl_mean", "p_mean", "confidence_mean", "drift", F.size("feature_psi").alias("n_features")))


@query("h9_current_sample", "select feature, event_id from drift_samples where side = 'cur' qualify row_number() over (partition by feature order by event_id desc) <= 500")
def h9(spark, d):
    cur = fx.drift_samples(spark, d).where("side = 'cur'").select("feature", "event_id", "x")
    return op.current_sample(cur, 500, 100).select("feature", "event_id")


_CHECKS = "chk as (select concat('m', user_no % 4) as model, ts as checked_at, value > 60 as drift, value / 400 as psi, k / 110.0::double as confidence, row_number() over (partition by user_no % 4 order by ts) as n from interactions)"
_HIT = "c.drift and (g.run >= 3 or c.psi > 0.2 or c.confidence > 0.8)"
_RESTS = "g.last is not null and c.checked_at - g.last < interval 43200 seconds"
# Within the cool-down nothing changes; outside, a clean check resets the run.
_GATE = f"""{_CHECKS}, gate(model, n, checked_at, drift, psi, confidence, run, last, alert) as (
  select model, n, checked_at, drift, psi, confidence, case when drift and (psi > 0.2 or confidence > 0.8) then 1 else 0 end, case when drift and (psi > 0.2 or confidence > 0.8) then checked_at end, drift and (psi > 0.2 or confidence > 0.8) from chk where n = 1
  union all
  select c.model, c.n, c.checked_at, c.drift, c.psi, c.confidence,
    case when {_RESTS} then g.run when not c.drift then 0 when {_HIT} then g.run + 1 else g.run end,
    case when {_RESTS} then g.last when {_HIT} then c.checked_at else g.last end,
    case when {_RESTS} then false else {_HIT} end
  from gate g join chk c on c.model = g.model and c.n = g.n + 1)"""


def _checks(spark, d):
    return fx.interactions(spark, d).select(
        F.concat(F.lit("m"), (F.col("user_no") % 4).cast("string")).alias("model"), F.col("ts").alias("checked_at"), (F.col("value") > 60).alias("drift"), (F.col("value") / 400.0).alias("psi"), (F.col("k") / 110.0).alias("confidence")
    )


@query("h10_alert_gate", f"with recursive {_GATE} select model, checked_at, alert, run::int as run_length from gate")
def h10(spark, d):
    return op.alert_gate(_checks(spark, d), cooldown=43200).select("model", "checked_at", "alert", "run_length")


_LEVEL = "case when psi > 0.5 or confidence > 0.8 then 'critical' when psi > 0.25 or confidence > 0.6 then 'high' when psi > 0.1 or confidence > 0.4 then 'medium' else 'low' end"


@query("h11_severity_action", f"with {_CHECKS}, s as (select model, checked_at, {_LEVEL} as severity from chk) select *, case severity when 'critical' then 'immediate_retraining' when 'high' then 'scheduled_retraining' when 'medium' then 'monitor_closely' else 'continue_monitoring' end as action from s")
def h11(spark, d):
    return op.severity_action(_checks(spark, d)).select("model", "checked_at", "severity", "action")


@query("h11_affected_features", f"with {_METRICS} select 'm' as model, coalesce(string_agg(feature, ',' order by feature) filter (drift), '') as affected from metrics")
def h11_affected(spark, d):
    f = op.feature_drift(*_samples(spark, d), min_n=100).withColumn("model", F.lit("m"))
    return op.affected_features(f).select("model", F.array_join("affected", ",").alias("affected"))


@query("h12_drift_impact", f"with {_CHECKS} select model, checked_at, case when model in ('m1', 'm2') then round(psi * 0.1, 10) end as ctr_drop, case when model in ('m1', 'm2') then round(psi * 0.08, 10) end as engagement_drop from chk")
def h12(spark, d):
    checks = _checks(spark, d)
    return rounded(op.drift_impact(checks, checks.where("model in ('m1', 'm2')")).select("model", "checked_at", "ctr_drop", "engagement_drop"), 10)


def _alerts(spark, d):
    a = op.severity_action(op.alert_gate(_checks(spark, d), cooldown=43200).where("alert"))
    return a.select("model", F.col("checked_at").alias("alerted_at"), "action", "run_length")


@query(
    "h13_drift_summary",
    f"""with recursive {_GATE}, a as (select * from gate where alert and model <> 'm3'), r as (select model, count(*) filter (checked_at >= timestamp '2024-01-27 00:00:00') as recent, max(checked_at) as last_alert from a group by 1)
    select s.model, (select count(*) from a) as total_alerts, coalesce(recent, 0) as recent_alerts, last_alert, s.run_length, case when s.run_length is null then 'no_data' when recent >= 3 then 'critical_drift' when recent = 2 then 'moderate_drift' when recent = 1 then 'minor_drift' else 'stable' end as status
    from (select distinct model, case when model = 'm2' then null else 1 end as run_length from chk) s left join r using (model)""",
)
def h13(spark, d):
    state = _checks(spark, d).select("model").distinct().withColumn("run_length", F.when(F.col("model") != "m2", 1))
    return op.drift_summary(_alerts(spark, d).where("model <> 'm3'"), state, F.lit("2024-02-03 00:00:00").cast("timestamp_ntz"))


@query("h14_retraining_queue", f"with recursive {_GATE}, a as (select model, checked_at as alerted_at, {_LEVEL} as severity from gate where alert), l as (select * from a order by alerted_at desc, model limit 10) select model, alerted_at from l where severity = 'critical'")
def h14(spark, d):
    return op.retraining_queue(_alerts(spark, d)).select("model", "alerted_at")
