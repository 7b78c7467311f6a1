"""Drift between a reference and a current sample, and what follows from it (H).

Samples are long: (feature, x).  Every test runs for all features in one pass; edges and
totals have one row per feature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize

#: Thresholds (fixed values): drift, severity by PSI and confidence, and actions.
PSI_LIMIT, KL_LIMIT, P_LIMIT = 0.1, 0.1, 0.05
SEVERITY = (("critical", 0.5, 0.8), ("high", 0.25, 0.6), ("medium", 0.1, 0.4))
ACTIONS = {"critical": "immediate_retraining", "high": "scheduled_retraining", "medium": "monitor_closely", "low": "continue_monitoring"}


def value_steps(ref: DataFrame, cur: DataFrame) -> DataFrame:
    """Every distinct value of a feature in order: feature, x, how often it stands on both
    sides (a, b), the running sums (f_n, g_n) and totals (n, m) of these, and the next value.

    All tests read this written table.  It is range-partitioned by (feature, x); each
    part sums its own rows and adds what the parts before it hold, so that one feature is
    spread over many tasks.  Null values take no part.
    """
    both = ref.select("feature", "x", F.lit(1).alias("r")).unionByName(cur.select("feature", "x", F.lit(0).alias("r"))).where(F.col("x").isNotNull())
    counts = both.groupBy("feature", "x").agg(F.sum("r").alias("a"), F.sum(1 - F.col("r")).alias("b"))
    parts = int(ref.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(counts.repartitionByRange(parts, "feature", "x").withColumn("part", F.spark_partition_id()), "value-counts")
    held = ranged.groupBy("part", "feature").agg(F.sum("a").alias("pa"), F.sum("b").alias("pb"), F.min("x").alias("first"))
    # One row for each part of a feature.
    order, whole = Window.partitionBy("feature").orderBy("part"), Window.partitionBy("feature")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    carried = held.select(
        "part", "feature", F.coalesce(F.sum("pa").over(before), F.lit(0)).alias("a0"), F.coalesce(F.sum("pb").over(before), F.lit(0)).alias("b0"),
        F.sum("pa").over(whole).alias("n"), F.sum("pb").over(whole).alias("m"), F.lead("first").over(order).alias("following"),
    )
    own = Window.partitionBy("part", "feature").orderBy("x")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.select("part", "feature", "x", "a", "b", F.sum("a").over(upto).alias("ra"), F.sum("b").over(upto).alias("rb"), F.lead("x").over(own).alias("nx")).join(carried, ["part", "feature"])
    rows = rows.select("feature", "x", "a", "b", (F.col("ra") + F.col("a0")).alias("f_n"), (F.col("rb") + F.col("b0")).alias("g_n"), "n", "m", F.coalesce("nx", "following").alias("next"))
    return materialize(rows, "value-steps")


def _edges(steps: DataFrame, buckets: int, kind: str, *, pooled: bool = False) -> DataFrame:
    """feature and the distinct, ordered bucket edges of the reference (or of both sides)."""
    known = steps if pooled else steps.where("a > 0")
    if kind == "quantiles":
        first = F.col("f_n") - F.col("a")
        at = lambda k: F.max(F.when((first <= k) & (k < F.col("f_n")), F.col("x")))
        places = [F.lit(i) * (F.col("n") - 1) / F.lit(buckets) for i in range(buckets + 1)]
        rows = known.groupBy("feature").agg(*[at(F.floor(h)).alias(f"lo{i}") for i, h in enumerate(places)], *[at(F.ceil(h)).alias(f"hi{i}") for i, h in enumerate(places)], F.max("n").alias("n"))
        between = lambda i, h: F.when(F.col(f"lo{i}") == F.col(f"hi{i}"), F.col(f"lo{i}")).otherwise(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (h - F.floor(h)))
        return rows.select("feature", F.array_distinct(F.array(*[between(i, h) for i, h in enumerate(places)])).alias("edges"))
    if kind == "width":
        rows = known.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
        return rows.select("feature", F.array_distinct(F.array(*[F.col("lo") + (F.col("hi") - F.col("lo")) * F.lit(i) / F.lit(buckets) for i in range(buckets + 1)])).alias("edges"))
    raise ValueError(f"unknown kind of buckets: {kind}")


def _bucket(x: Column, edges: Column) -> Column:
    """1-based bucket; the last one is closed; null outside the edges."""
    below = F.size(F.filter(edges, lambda e: e <= x))
    last = F.size(edges) - 1
    return F.when((below > 0) & (x <= F.element_at(edges, -1)), F.least(below, last))


def _shares(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """feature, bucket, n_ref, n_cur and the totals (values outside the edges included)."""
    # One row of edges for each feature.
    rows = steps.join(F.broadcast(edges), "feature").select("feature", "a", "b", _bucket(F.col("x"), F.col("edges")).alias("bucket"))
    counts = rows.groupBy("feature", "bucket").agg(F.sum("a").alias("n_ref"), F.sum("b").alias("n_cur"))
    totals = counts.groupBy("feature").agg(F.sum("n_ref").alias("t_ref"), F.sum("n_cur").alias("t_cur"))
    spine = edges.where(F.size("edges") > 1).select("feature", "edges", F.explode(F.sequence(F.lit(1), F.size("edges") - 1)).alias("bucket"))
    full = spine.join(counts, ["feature", "bucket"], "left").join(totals, "feature")
    return full.withColumns({"n_ref": F.coalesce("n_ref", F.lit(0)), "n_cur": F.coalesce("n_cur", F.lit(0))})


def psi(ref: DataFrame, cur: DataFrame, buckets: int = 10, kind: str = "quantiles") -> DataFrame:
    """feature and its population stability index; 0 for a constant reference."""
    return _psi(value_steps(ref, cur), buckets, kind)


def _psi(steps: DataFrame, buckets: int = 10, kind: str = "quantiles") -> DataFrame:
    edges = _edges(steps, buckets, kind)
    share = lambda n, t: F.when(F.col(n) == 0, F.lit(0.0001)).otherwise(F.col(n) / F.col(t))
    rows = _shares(steps, edges).select("feature", share("n_ref", "t_ref").alias("p"), share("n_cur", "t_cur").alias("q"))
    found = rows.groupBy("feature").agg(F.sum((F.col("q") - F.col("p")) * F.ln(F.col("q") / F.col("p"))).alias("psi"))
    return edges.select("feature").join(found, "feature", "left").select("feature", F.coalesce("psi", F.lit(0.0)).alias("psi"))


def kl_divergence(ref: DataFrame, cur: DataFrame, bins: int = 50) -> DataFrame:
    """feature and KL(ref || cur) over equal-width bins; 0 for 10 distinct values or fewer."""
    return _kl(value_steps(ref, cur), bins)


def _kl(steps: DataFrame, bins: int = 50) -> DataFrame:
    many = steps.where("a > 0").groupBy("feature").agg(F.count(F.lit(1)).alias("n_distinct"))
    rows = _shares(steps, _edges(steps, bins, "width"))
    own = Window.partitionBy("feature")  # over the bins of a feature
    width = F.get("edges", F.col("bucket")) - F.get("edges", F.col("bucket") - 1)
    density = lambda n: F.coalesce(F.try_divide(F.try_divide(F.col(n), F.sum(n).over(own)), width), F.lit(0.0)) + 1e-10
    rows = rows.select("feature", density("n_ref").alias("p"), density("n_cur").alias("q"))
    rows = rows.select("feature", (F.col("p") / F.sum("p").over(own)).alias("p"), (F.col("q") / F.sum("q").over(own)).alias("q"))
    found = rows.groupBy("feature").agg(F.sum(F.col("p") * F.ln(F.col("p") / F.col("q"))).alias("kl"))
    kl = F.when(F.col("n_distinct") > 10, F.coalesce("kl", F.lit(0.0))).otherwise(F.lit(0.0))
    return many.join(found, "feature", "left").select("feature", kl.alias("kl"))


def ks_test(ref: DataFrame, cur: DataFrame) -> DataFrame:
    """feature, Kolmogorov-Smirnov statistic and the p-value of its limiting series."""
    return _ks(value_steps(ref, cur))


def _gap() -> Column:
    """Distance of both distribution functions at a value."""
    return F.abs(F.try_divide("f_n", "n") - F.try_divide("g_n", "m"))


def _ks(steps: DataFrame) -> DataFrame:
    rows = steps.groupBy("feature").agg(F.max(_gap()).alias("ks"), F.max("n").alias("n"), F.max("m").alias("m"))
    t = F.sqrt(F.col("n") * F.col("m") / (F.col("n") + F.col("m"))) * F.col("ks")
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda a, j: a + F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(F.lit(-2.0) * j * j * F.col("t") * F.col("t")))
    p = F.when(F.col("t") < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), terms)))
    return rows.withColumn("t", t).select("feature", "ks", p.alias("ks_p"))


def wasserstein(ref: DataFrame, cur: DataFrame) -> DataFrame:
    """feature and the area between the distribution functions."""
    return value_steps(ref, cur).groupBy("feature").agg(F.sum(F.coalesce(_gap() * (F.col("next") - F.col("x")), F.lit(0.0))).alias("wasserstein"))


def chi_square_p(statistic: Column, dof: Column) -> Column:
    """Upper tail of the chi-square law by the series of the incomplete gamma function."""
    a, x = dof / 2.0, statistic / 2.0
    whole = F.aggregate(F.sequence(F.lit(1), F.greatest(F.floor(a).cast("int"), F.lit(1))), F.lit(0.0), lambda s, i: s + F.ln(i.cast("double")))
    half = F.aggregate(F.sequence(F.lit(0), F.greatest(F.floor(a).cast("int"), F.lit(0))), F.lit(0.5723649429247001), lambda s, i: s + F.ln(i + F.lit(0.5)))
    log_gamma = F.when(dof % 2 == 0, whole).otherwise(half)  # of a + 1
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(400)), start, lambda s, i: F.struct((s["term"] * x / (a + i)).alias("term"), (s["sum"] + s["term"] * x / (a + i)).alias("sum")))["sum"]
    lower = F.exp(a * F.ln(x) - x - log_gamma) * series
    return F.when(dof <= 0, F.lit(1.0)).when(statistic <= 0, F.lit(1.0)).when(x > 300, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - lower)))


def chi_square(ref: DataFrame, cur: DataFrame, bins: int = 10) -> DataFrame:
    """feature, chi-square statistic over pooled equal-width bins, degrees of freedom, p-value."""
    steps = value_steps(ref, cur)
    rows = _shares(steps, _edges(steps, bins, "width", pooled=True)).where("n_ref + n_cur > 0")
    total = F.col("t_ref") + F.col("t_cur")
    column = F.col("n_ref") + F.col("n_cur")
    part = lambda n, t: F.pow(F.col(n) - column * F.col(t) / total, F.lit(2.0)) / (column * F.col(t) / total)
    found = rows.groupBy("feature").agg(F.sum(part("n_ref", "t_ref") + part("n_cur", "t_cur")).alias("chi2"), (F.count(F.lit(1)) - 1).cast("int").alias("dof"))
    return found.withColumn("chi2_p", chi_square_p(F.col("chi2"), F.col("dof")))


def feature_drift(ref: DataFrame, cur: DataFrame, *, min_n: int = 1000) -> DataFrame:
    """Per feature with `min_n` values or more on both sides: PSI, KL, KS p, drift, confidence."""
    steps = value_steps(ref, cur)
    enough = steps.groupBy("feature").agg(F.max("n").alias("n_ref"), F.max("m").alias("n_cur"))
    enough = enough.where((F.col("n_ref") >= min_n) & (F.col("n_cur") >= min_n))
    rows = enough.join(_psi(steps), "feature").join(_kl(steps), "feature").join(_ks(steps), "feature")
    drift = (F.col("psi") > PSI_LIMIT) | (F.col("kl") > KL_LIMIT) | (F.col("ks_p") < P_LIMIT)
    confidence = 0.4 * F.least(F.col("psi") / PSI_LIMIT, F.lit(1.0)) + 0.3 * F.least(F.col("kl") / KL_LIMIT, F.lit(1.0)) + 0.3 * (1.0 - F.col("ks_p"))
    return rows.select("feature", "n_ref", "n_cur", "psi", "kl", "ks", "ks_p", drift.alias("drift"), F.least(F.lit(1.0), confidence).alias("confidence"))


def model_drift(feature_metrics: DataFrame, model_col: str = "model") -> DataFrame:
    """Per model: means over its features, drift by the same rule, and PSI by feature as a map."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "psi"))))
    rows = feature_metrics.groupBy(model_col).agg(
        F.avg("psi").alias("psi_mean"), F.avg("kl").alias("kl_mean"), F.avg("ks_p").alias("p_mean"), F.avg("confidence").alias("confidence_mean"), pairs.alias("feature_psi")
    )
    drift = (F.col("psi_mean") > PSI_LIMIT) | (F.col("kl_mean") > KL_LIMIT) | (F.col("p_mean") < P_LIMIT)
    return rows.withColumn("drift", drift)


def current_sample(df: DataFrame, n: int = 10_000, min_n: int = 1000, *, order: str = "event_id") -> DataFrame:
    """The newest `n` values of each feature that has `min_n` or more."""
    newest = Window.partitionBy("feature").orderBy(F.desc(order))
    counts = df.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_n).select("feature")
    return df.join(counts, "feature", "left_semi").withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= n).drop("__n")


class Gate:
    """State of one model's alert gate: run of confirmed checks and time of the last alert.

    Within `cooldown` seconds of an alert checks are not looked at: they neither alert nor
    reset the run.  Outside, a clean check resets the run; a drifted one alerts once the
    run has reached `persistence`, or by itself by its PSI or confidence.
    """

    def __init__(self, run: int = 0, last: np.datetime64 | None = None, *, persistence: int = 3, cooldown: int = 1800, count_unconfirmed: bool = False):
        self.run, self.last = run, last
        self.persistence, self.cooldown, self.count_unconfirmed = persistence, np.timedelta64(cooldown, "s"), count_unconfirmed

    def fold(self, at: np.ndarray, drift: np.ndarray, psi_value: np.ndarray, confidence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(alert, run length) of checks in order of time, from one alert to the next."""
        n = len(at)
        alert, runs = np.zeros(n, bool), np.zeros(n, np.int32)
        clean = np.append(np.flatnonzero(~drift), n)
        strong = np.append(np.flatnonzero(drift & ((psi_value > 2 * PSI_LIMIT) | (confidence > 0.8))), n)
        since = np.arange(n) - np.maximum.accumulate(np.where(drift, -1, np.arange(n))) if n else np.zeros(0, np.int64)
        long = np.append(np.flatnonzero(drift & (since > self.persistence)), n)
        after = lambda places, k: int(places[np.searchsorted(places, k)])
        k = 0
        while k < n:
            if self.last is not None and (stop := max(k, int(np.searchsorted(at, self.last + self.cooldown)))) > k:
                runs[k:stop], k = self.run, stop
                continue
            reset = after(clean, k)
            hit = after(strong, k)
            if self.count_unconfirmed:
                hit = min(hit, k + max(0, self.persistence - self.run) if k + max(0, self.persistence - self.run) < reset else after(long, reset))
            elif self.run >= self.persistence and reset > k:
                hit = k
            reset = min(reset, hit)
            runs[k:reset] = self.run + (np.arange(1, reset - k + 1) if self.count_unconfirmed else 0)
            runs[reset:hit] = np.where(drift[reset:hit], since[reset:hit], 0) if self.count_unconfirmed else 0
            self.run = int(runs[hit - 1]) if hit > k else self.run
            if hit < n:
                self.run += 1
                alert[hit], runs[hit], self.last = True, self.run, at[hit]
            k = hit + 1
        return alert, runs


def alert_gate(checks: DataFrame, *, persistence: int = 3, cooldown: int = 1800, count_unconfirmed: bool = False) -> DataFrame:
    """checks (model, checked_at, drift, psi, confidence) with alert and run_length.

    An ordered fold per model over two numbers of state, streamed over sorted partitions.
    Nulls: a null drift is a clean check; a null PSI or confidence confirms nothing.
    """
    rows = checks.repartition("model").sortWithinPartitions("model", "checked_at")
    new = lambda: Gate(persistence=persistence, cooldown=cooldown, count_unconfirmed=count_unconfirmed)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, gate = None, new()
        for batch in batches:
            model = batch["model"].to_numpy()
            cuts = [0, *(np.flatnonzero(model[1:] != model[:-1]) + 1).tolist(), len(batch)]
            alerts, runs = np.zeros(len(batch), bool), np.zeros(len(batch), np.int32)
            columns = gate_columns(batch)
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    if model[a] != current:
                        current, gate = model[a], new()
                    alerts[a:b], runs[a:b] = gate.fold(*(c[a:b] for c in columns))
            yield batch.assign(alert=alerts, run_length=runs)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in checks.schema)
    return rows.mapInPandas(fold, f"{fields}, alert boolean, run_length int")


def gate_columns(batch: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """The arrays that Gate.fold takes."""
    return batch["checked_at"].to_numpy(), batch["drift"].fillna(False).to_numpy(bool), *(batch[c].fillna(0.0).to_numpy(float) for c in ("psi", "confidence"))


def severity_action(df: DataFrame) -> DataFrame:
    """Add severity and action by PSI or confidence."""
    level = F.lit("low")
    for name, by_psi, by_confidence in reversed(SEVERITY):
        level = F.when((F.col("psi") > by_psi) | (F.col("confidence") > by_confidence), name).otherwise(level)
    actions = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    return df.withColumn("severity", level).withColumn("action", F.element_at(actions, F.col("severity")))


def affected_features(feature_metrics: DataFrame, model_col: str = "model") -> DataFrame:
    """Per model the sorted features that drift by their own test (PSI, KL or p-value)."""
    return feature_metrics.groupBy(model_col).agg(F.array_sort(F.collect_set(F.when(F.col("drift"), F.col("feature")))).alias("affected"))


def drift_impact(df: DataFrame, performance: DataFrame, model_col: str = "model") -> DataFrame:
    """Add estimated drops in CTR and engagement; null for models without a history."""
    known = performance.select(model_col).distinct().withColumn("__known", F.lit(True))
    rows = df.join(known, model_col, "left")
    return rows.select(*df.columns, F.when(F.col("__known"), F.col("psi") * 0.1).alias("ctr_drop"), F.when(F.col("__known"), F.col("psi") * 0.08).alias("engagement_drop"))


def drift_summary(alerts: DataFrame, state: DataFrame, now: Column) -> DataFrame:
    """Per model of `state` (model, run_length): alerts of all models, own alerts in the
    last 7 days, last alert, status."""
    total = alerts.agg(F.count(F.lit(1)).alias("total_alerts"))
    own = alerts.groupBy("model").agg(F.count_if(F.col("alerted_at") >= now - F.expr("INTERVAL 7 DAYS")).alias("recent_alerts"), F.max("alerted_at").alias("last_alert"), F.lit(True).alias("any"))
    rows = state.join(own, "model", "left").join(F.broadcast(total))
    recent = F.coalesce("recent_alerts", F.lit(0))
    status = F.when(F.col("run_length").isNull(), "no_data").when(recent >= 3, "critical_drift").when(recent == 2, "moderate_drift").when(recent == 1, "minor_drift").otherwise("stable")
    return rows.select("model", "total_alerts", recent.alias("recent_alerts"), "last_alert", "run_length", status.alias("status"))


def retraining_queue(alerts: DataFrame, n: int = 10) -> DataFrame:
    """Of the last `n` alerts, those that ask for immediate retraining."""
    return alerts.orderBy(F.desc("alerted_at"), "model").limit(n).where(F.col("action") == "immediate_retraining")
