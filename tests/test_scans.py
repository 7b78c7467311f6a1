"""Ordered scans that are cut by time or range, and rules as expressions."""

import datetime as dt
import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from signalspark.operators import events, feature_log, features, metrics, rules, slabs, training
from signalspark.operators.rules import Merge, Number, Quantile, Rule, increase, last, rate
from signalspark.plans import QUERIES
from signalspark.plans.alert_rules import RULES

FOLDER = "/root/testdata/sf0.001"
DAY0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return DAY0 + dt.timedelta(seconds=seconds)


@pytest.mark.parametrize("name", ["a11_consumer_lag", "i1_counter_rate", "i5_baseline_drop", "i6_evaluate_rules", "i6_rule_expressions", "c6_point_in_time_join"])
def test_no_window_over_a_whole_key(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for keys, order in re.findall(r"Window \[.*\], \[([^\]]*)\], \[([^\]]*)\]", plan):
        # By part or slab, or over one row for each part or the runs at the edges of slabs.
        assert re.search(r"__part|slab", keys) or re.match(r"__part|first", order), (keys, order)


def _hot(n=6000, seed=2):
    """Events of three users; one has half of all, its times repeat, values may be null or integers' strings."""
    rng = random.Random(seed)
    rows, t = [], 0
    for k in range(n):
        t += rng.choice([0, 1, 1, 20, 400])
        rows.append((k, rng.choice(["hot", "hot", "a", "b", None]), at(t), rng.choice([None, rng.gauss(0, 50), float(rng.randint(0, 5))]), rng.randint(-9, 9)))
    return rows + [(n, "hot", None, 1.0, 1), (n + 1, "hot", None, 5.0, 2), (n + 2, None, None, 7.0, 3)]


@pytest.mark.parametrize("max_events", [None, 7])
def test_trailing_windows_of_a_hot_user(spark, max_events):
    rows = _hot()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        df = spark.createDataFrame(rows, "event_id long, user string, ts timestamp_ntz, x double, k int").repartition(7)
        out = features.trailing_aggregates(df, "user", "ts", "x", windows=(60, 3600), max_events=max_events).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.event_id for r in out) == list(range(len(rows)))
    of = {}
    for i, u, t, x, _ in sorted(rows, key=lambda r: (r[2] is not None, r[2] or DAY0)):
        of.setdefault(u, []).append((t, x, i))
    for r in random.Random(1).sample(out, 400) + [r for r in out if r.ts is None]:
        for w in (60, 3600):
            near = [x for t, x, _ in of[r.user] if (t is None) == (r.ts is None) and (t is None or r.ts - dt.timedelta(seconds=w) <= t <= r.ts) and x is not None]
            if max_events and len(near) > max_events:
                continue  # which of equal times are newest is not defined
            got = [r[f"x_{fn}_{w}s"] for fn in features.FUNCTIONS]
            if not near:
                assert got == [0] + [None] * 6
                continue
            expected = [len(near), sum(near), sum(near) / len(near), statistics.pstdev(near), min(near), max(near), statistics.median(near)]
            assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(got, expected)), (r, expected)


def test_slabs_cut_a_hot_user(spark):
    df = spark.createDataFrame([(k, "hot", at(k * 60), 1.0) for k in range(5000)], "event_id long, user string, ts timestamp_ntz, x double")
    dealt = slabs.with_halo(df, "ts", 3_600_000_000).groupBy("slab").agg(F.count(F.lit(1)).alias("n"), F.count_if("halo").alias("halo")).collect()
    assert len(dealt) >= 10 and max(r.n for r in dealt) <= 9 * 60 + 1 and sum(r.halo for r in dealt) <= 5000 / 8 + 61


def test_point_in_time_join_over_slabs(spark):
    rng = random.Random(4)
    names = ["f", "g"]
    log = [(k, "hot", rng.choice(names), f"v{k}", at(rng.randint(0, 4_000_000))) for k in range(4000)] + [(4000, "b", "f", "b", at(5))]
    spine = [(k, "hot", at(rng.randint(0, 4_200_000))) for k in range(500)] + [(900, "b", at(5)), (901, "b", at(5 + 86400)), (902, "b", at(6 + 86400)), (903, "none", at(9)), (904, "hot", log[7][4])]
    frame = spark.createDataFrame(log, "write_seq long, entity_id string, feature_name string, value string, feature_ts timestamp_ntz")
    asked = spark.createDataFrame(spine, "spine_id long, entity_id string, as_of timestamp_ntz")
    got = {r.spine_id: r for r in feature_log.point_in_time_join(asked, frame, names, lookback="1 day").collect()}
    assert set(got) == {s[0] for s in spine}
    for i, entity, as_of in spine:
        for name in names:
            known = [(t, seq, v) for seq, e, f, v, t in log if e == entity and f == name and as_of - dt.timedelta(days=1) <= t <= as_of]
            assert got[i][name] == (max(known)[2] if known else None)
    assert got[901]["f"] == "b" and got[902]["f"] is None


def test_counters_and_maxima_are_carried(spark):
    points = [(m, at(k), (k * 3) % 700) for k in range(2000) for m in ("hot", "b") if m == "hot" or k % 50 == 0]
    df = spark.createDataFrame(points, "metric string, ts timestamp_ntz, counter long").repartition(5)
    got = {(r.metric, r.ts): r.increase for r in metrics.counter_rate(df, 10).collect()}
    for name in ("hot", "b"):
        own = [(t, c) for m, t, c in points if m == name]
        steps = [(own[0][0], 0)] + [(t, c if c < b else c - b) for (_, b), (t, c) in zip(own, own[1:])]
        for t, _ in own:
            assert got[name, t] == sum(s for u, s in steps if t - dt.timedelta(seconds=10) <= u <= t)
    offsets = spark.createDataFrame([("t", k % 3, k, (k * 37) % 101, 50) for k in range(500)], "topic string, partition_id int, checked_at long, high_watermark long, position long").repartition(4)
    seen = 0
    for r in sorted(events.consumer_lag(offsets).collect(), key=lambda r: r.checked_at):
        seen = max(seen, r.lag)
        assert r.max_lag == seen


def test_runs_of_a_rule_over_many_parts(spark):
    points = [(at(60 * k), "m", "l", float(k % 500 != 0)) for k in range(3000)]
    df = spark.createDataFrame(points, "ts timestamp_ntz, metric string, label string, value double").repartition(4)
    table = [("one", "m", "==", 1.0, 60, "x"), ("not", "m", "!=", 1.0, 0, "x"), ("least", "m", ">=", 0.0, 60, "x"), ("most", "m", "<=", 0.5, 0, "x"), ("none", "m", "<", 0.0, 0, "x")]
    schema = "rule string, metric string, op string, threshold double, for_seconds int, severity string"
    got = metrics.evaluate_rules(df, spark.createDataFrame(table, schema)).collect()
    assert sorted((r.rule, r.points) for r in got) == sorted([("one", 499)] * 6 + [("not", 1)] * 6 + [("least", 3000)] + [("most", 1)] * 6)
    with pytest.raises(Exception, match="unknown comparison"):
        metrics.evaluate_rules(df, spark.createDataFrame([("r", "m", "=", 1.0, 0, "x")], schema)).collect()


POINTS = "ts timestamp_ntz, metric string, labels map<string,string>, value double"


def _ticks(spark, points, rule_list, step=60):
    return {(r.rule, r.labels, r.started_at, r.ended_at): r.ticks for r in rules.firing_intervals(spark.createDataFrame(points, POINTS), rule_list, step=step).collect()}


def test_values_are_held_until_they_are_stale(spark):
    points = [(at(30), "g", {"i": "a"}, 5.0), (at(90), "g", {"i": "a"}, None), (at(31), "g", {"i": "b"}, float("nan")), (None, "g", {"i": "a"}, 9.0), (at(60), "g", None, 1.0)]
    found = _ticks(spark, points, [Rule("high", last("g"), ">", 2, 0, "x"), Rule("low", last("g"), "<=", 1, 240, "x"), Rule("long", last("g"), "<=", 1, 300, "x")])
    assert found == {("high", "i=a", at(60), at(300)): 5, ("low", "", at(60), at(300)): 5}


def test_rates_offsets_and_arithmetic(spark):
    points = [(at(60 * k), m, {"i": "a"}, float(v)) for k in range(1, 11) for m, v in (("c", 60 * k if k < 6 else 60 * (k - 5)), ("d", 120 * k))]
    spec = [
        Rule("increase", increase("c", 120), "==", 120, 0, "x"),
        Rule("rate", rate("d", 60), "==", 2, 0, "x"),
        Rule("ratio", rate("c", 60) / rate("d", 60), "==", 0.5, 0, "x"),
        Rule("earlier", rate("c", 60, offset=60), ">", 0, 0, "x"),
        Rule("number", 100 - rate("d", 60) * 50, "==", Number(0.0), 0, "x"),
        Rule("two", rate("c", 60), "<", 0.9 * rate("d", 60), 0, "x"),
        Rule("zero", last("c") / (last("d") - last("d")), ">", 0, 0, "x"),
    ]
    found = _ticks(spark, points, spec)
    assert {k[0]: (k[2], k[3], n) for k, n in found.items()} == {
        "increase": (at(180), at(600), 8), "rate": (at(120), at(600), 9), "ratio": (at(120), at(600), 9), "earlier": (at(180), at(660), 9), "number": (at(120), at(600), 9), "two": (at(120), at(600), 9),
    }
    with pytest.raises(ValueError):
        _ticks(spark, points, [Rule("r", rate("c", 90), ">", 0, 0, "x")])
    with pytest.raises(ValueError, match="unknown comparison"):
        _ticks(spark, points, [Rule("r", rate("c", 60), "=", 0, 0, "x")])
    with pytest.raises(ValueError, match="unknown merge"):
        _ticks(spark, points, [Rule("r", Merge("median", rate("c", 60)), ">", 0, 0, "x")])


def test_merges_and_quantiles(spark):
    points = [(at(60), "g", {"i": i, "z": z}, v) for i, z, v in (("a", "1", 1.0), ("a", "2", 3.0), ("b", "1", 10.0))]
    points += [(at(t), "h", {"le": le, "i": "a"}, n * t / 60) for t in (60, 120) for le, n in (("0.1", 10.0), ("0.5", 15.0), ("+Inf", 20.0))]
    spec = [
        Rule("mean", Merge("avg", last("g"), ("i",)), "==", 2, 0, "x"), Rule("sum", Merge("sum", last("g")), "==", 14, 0, "x"), Rule("nested", Merge("sum", Merge("avg", last("g"), ("i",)) * 2), "==", 24, 0, "x"),
        Rule("half", Quantile(0.5, rate("h", 60)), "==", 0.1, 0, "x"), Rule("inside", Quantile(0.625, rate("h", 60)), ">", 0.2999, 0, "x"), Rule("beyond", Quantile(0.625, rate("h", 60)), ">", 0.3001, 0, "x"), Rule("top", Quantile(0.9, rate("h", 60)), "==", 0.5, 0, "x"), Rule("none", Quantile(0.9, last("g")), ">", 0, 0, "x"),
        Rule("one", last("g", i="a", z="2"), "==", 3, 0, "x"), Rule("like", Merge("sum", rules.Series("g", like=(("i", "a|c"),))), "==", 4, 0, "x"),
    ]
    found = _ticks(spark, points, spec)
    assert {(k[0], k[1]) for k in found} == {("mean", "i=a"), ("sum", ""), ("nested", ""), ("half", "i=a"), ("inside", "i=a"), ("top", "i=a"), ("one", "i=a,z=2"), ("like", "")}


def test_runs_join_over_slabs(spark, monkeypatch):
    monkeypatch.setattr(rules, "_RUN_SLAB", 4)
    ticks = [k for k in range(-9, 40) if k not in (3, 4, 12, 20, 21, 22, 23, 30)]
    got = rules.runs_of_ticks(spark.createDataFrame([("r", k) for k in ticks] + [("q", 7)], "no string, tick long"), ["no"]).collect()
    assert sorted((r.no, r["first"], r["last"], r.ticks) for r in got) == [("q", 7, 7, 1), ("r", -9, 2, 12), ("r", 5, 11, 7), ("r", 13, 19, 7), ("r", 24, 29, 6), ("r", 31, 39, 9)]


def test_all_alert_rules(spark):
    assert len(RULES) == 35 and len({r.name for r in RULES}) == 35 and len({r.group for r in RULES}) == 10
    fired = {r.rule for r in QUERIES["i6_rule_expressions"](spark, "/root/testdata/sf0.01").select("rule").distinct().collect()}
    assert len(fired) > 20 and {"KafkaBrokerDown", "HighAPILatency", "CTRDropSudden", "NodeCPUHigh", "TrainingJobStalled"} <= fired


@pytest.mark.parametrize("causal", [True, False])
def test_history_of_a_hot_user(spark, causal):
    """Also where a sample's own item fills the rows before it, and where times and items are null."""
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "b"]), rng.choice([1, 1, 1, 1, 1, 1, 1, 1, 2, 3, 4, 5]), at(rng.randint(0, 900))) for _ in range(1500)]
    rows += [("b", 7, None), ("b", None, at(3)), (None, 1, at(4)), ("new", 2, at(5))]
    df = spark.createDataFrame(rows[:-1], "user_id string, item_id long, event_ts timestamp_ntz").repartition(3)
    samples = spark.createDataFrame(rows, "user_id string, item_id long, event_ts timestamp_ntz").repartition(3)
    got = training.history_sequence(samples, training.user_history(df), 5, causal=causal).collect()
    found = {}
    for r in got:
        found.setdefault((r.user_id, r.item_id, r.event_ts), []).append((r["items"], r.mask, r.history_length))
    assert len(got) == len(rows)
    order = lambda r: (r[2] is not None, r[2] or DAY0, r[1] is not None, r[1] or 0)
    for user, item, t in rows:
        own = [i for u, i, s in sorted(rows[:-1], key=order) if u == user and u is not None and i is not None and item is not None and i != item and (not causal or (s is not None and t is not None and s < t))][-5:]
        assert found[user, item, t][0] == (own + [0] * (5 - len(own)), [1] * len(own) + [0] * (5 - len(own)), len(own))


def test_metric_windows_take_no_sliding_frame(spark):
    """Spark's sliding range frames start anew at each row, which is quadratic in a window's rows."""
    for name in ("i1_counter_rate", "i5_baseline_drop", "i14_rate_limit_audit"):
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"RangeFrame, (?!unboundedpreceding\$\(\))", plan), name


def test_windows_of_two_slabs(spark):
    rng = random.Random(8)
    rows = [(k, rng.choice(["a", "b", None]), at(rng.randint(-200, 900)), rng.choice([None, rng.gauss(0, 9)])) for k in range(3000)] + [(3000, "a", None, 1.0), (3001, "a", None, 5.0), (3002, "c", at(7), math.inf), (3003, "c", at(60), 2.0), (3004, "c", at(68), 3.0)]
    df = spark.createDataFrame(rows, "event_id long, metric string, ts timestamp_ntz, x double").repartition(5)
    got = {r.event_id: r for r in metrics.baseline_drop(df, short=60, long=100, offset=45, factor=0.8).collect()}
    assert len(got) == len(rows)

    def mean(metric, t, reach, offset):
        end = lambda s: t - dt.timedelta(seconds=s)
        near = [x for _, m, u, x in rows if m == metric and x is not None and ((t is None and u is None) or (t is not None and u is not None and end(reach) <= u <= end(offset)))]
        return sum(near) / len(near) if near else None

    for i, m, t, _ in rng.sample(rows, 300) + rows[-5:]:
        for found, expected in ((got[i].current, mean(m, t, 60, 0)), (got[i].baseline, mean(m, t, 145, 45))):
            assert found is expected is None or math.isclose(found, expected, abs_tol=1e-9), i
    asked = df.select("event_id", "ts", F.col("metric").alias("user_id"), F.lit("1.1.1.1").alias("ip"))
    for r in metrics.rate_limit_audit(asked, limit=3, seconds=60).where("event_id % 10 = 0 or ts is null").collect():
        near = [u for _, m, u, _ in rows if m == r.user_id and ((r.ts is None and u is None) or (r.ts is not None and u is not None and r.ts - dt.timedelta(seconds=60) <= u <= r.ts))]
        assert r.n == len(near) and (r.retry_after is None or math.isclose(r.retry_after, 60 - (r.ts - min(near)).total_seconds()))


def test_points_of_rules_are_read_once_for_each_kind(spark):
    """Counters across ticks, with resets, ties and gaps; their points are not read to sample a range besides."""
    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row

    series = [(0, 5.0), (30, 7.0), (30, 7.0), (60, 9.0), (61, 2.0), (61, 4.0), (200, 1.0), (240, 6.0)]
    rows = [(at(t), "c", {"b": "2", "a": "1"}, v) for t, v in series] + [(at(7), "c", None, 3.0), (at(8), "g", None, 4.0)]
    points = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(seen), "ts timestamp_ntz, metric string, labels map<string,string>, value double")
    got = rules.series_values(points, [increase("c", 60), last("g")])
    assert read.value == 2 * len(rows)
    start = min(r.tick for r in got.collect())
    found = sorted((r.metric, len(r.labels), r.tick - start, r.value) for r in got.where("kind = 'increase'").collect())
    assert found == [("c", 0, 1, 0.0), ("c", 2, 0, 0.0), ("c", 2, 1, 4.0), ("c", 2, 2, 4.0), ("c", 2, 4, 6.0)]
