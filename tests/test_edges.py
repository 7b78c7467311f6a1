"""Hand-made frames: ties, nulls, boundaries, empty inputs and unknown options."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalspark.operators import drift, events, feature_log, features, metrics, online, recommend, sync, training, vectors

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def lit_at(seconds):
    return F.lit(at(seconds).isoformat(sep=" ")).cast("timestamp_ntz")


@pytest.fixture(scope="module")
def stream_rows(spark):
    rows = [
        (1, "u1", at(0), "s1", "view", "i1", "c1", 1.0), (2, "u1", at(300), "s1", "like", "i2", "c1", 3.0), (3, "u1", at(601), "s2", "share", "i1", None, None),
        (4, "u1", at(602), "s1", "add_to_cart", None, "c2", 5.0), (5, "u2", at(0), "s9", "purchase", "i3", "c3", 7.0), (6, "u1", at(900), "s1", "click", "i1", "c1", 2.0),
    ]
    return spark.createDataFrame(rows, "event_id long, user_id string, ts timestamp_ntz, session_id string, event_type string, item_id string, item_category string, value double")


def test_window_bounds_are_inclusive(stream_rows):
    out = features.trailing_aggregates(stream_rows, "user_id", "ts", "value", windows=(300,), fns=("count", "sum"))
    got = {r.event_id: (r.value_count_300s, r.value_sum_300s) for r in out.collect()}
    assert got[2] == (2, 4.0)  # the event exactly 300 s earlier counts
    assert got[3] == (0, None)  # null value; the one at 300 s is 301 s away
    assert got[6] == (2, 7.0)


def test_window_cap_and_unknown_function(stream_rows):
    out = features.trailing_aggregates(stream_rows, "user_id", "ts", "value", windows=(3600,), fns=("count", "median", "std"), max_events=2)
    last = {r.event_id: r for r in out.collect()}[6]
    assert (last.value_count_3600s, last.value_median_3600s, last.value_std_3600s) == (2, 3.5, 1.5)
    with pytest.raises(ValueError):
        features.trailing_aggregates(stream_rows, "user_id", "ts", "value", fns=("mode",))


def test_all_aggregates_skip_text(spark):
    df = spark.createDataFrame([("u", at(0), "1.5", "x"), ("u", at(1), "abc", "y")], "user_id string, ts timestamp_ntz, a string, item_id string")
    out = features.all_trailing_aggregates(df, "user_id", "ts", windows=(60,), fns=("count", "sum"))
    assert out.columns[-2:] == ["a_count_60s", "a_sum_60s"]
    assert [(r.a_count_60s, r.a_sum_60s) for r in out.orderBy("ts").collect()] == [(1, 1.5), (1, 1.5)]


def test_return_to_an_earlier_session_is_new(stream_rows):
    out = {r.event_id: r for r in features.session_features(stream_rows).collect()}
    assert [out[i].session_no for i in (1, 2, 3, 4, 6)] == [1, 1, 2, 3, 3]
    assert (out[6].total_events, out[6].session_events, out[6].unique_items, out[6].session_seconds) == (5, 2, 1, 298.0)
    assert out[6].events_per_minute == pytest.approx(5 / (298 / 60))


def test_weights(stream_rows):
    got = {r.item_id: r.popularity for r in features.popularity(stream_rows).collect()}
    assert got == {"i1": 1 + 4 + 2, "i2": 3.0, "i3": 10.0}


def test_popular_ties_by_item(spark):
    pop = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "item_id string, popularity double")
    assert [r.item_id for r in features.popular_items(pop, 2).collect()] == ["c", "a"]


def test_debounce_is_greedy(spark):
    rows = [(i, "u", at(s), "view") for i, s in enumerate([0, 299, 300, 599, 600, 601])]
    df = spark.createDataFrame(rows, "event_id long, user_id string, ts timestamp_ntz, event_type string")
    assert sorted(r.event_id for r in features.debounce(df).collect()) == [0, 2, 4]
    assert features.debounce(df.limit(0)).count() == 0


def test_contracts(spark):
    good = '{"event_id":"1","user_id":"u","session_id":"s","event_type":"view","item_id":"i","item_category":"c"}'
    rows = [("t", 0, 1, good), ("t", 0, 2, good.replace("view", "fly").replace('"u"', '""')), ("t", 0, 3, None), ("t", 0, 4, "{")]
    df = events.decode_events(spark.createDataFrame(rows, "topic string, partition_id int, offset_id long, msg_value string"))
    valid, invalid = events.validate_events(df)
    assert [r.offset_id for r in valid.collect()] == [1]
    reasons = {r.offset_id: r.reasons for r in invalid.collect()}
    assert reasons == {2: ["missing user_id", "bad event_type: fly"], 3: ["undecodable"], 4: ["undecodable"]}
    assert {r.dlq_id for r in events.dead_letters(invalid).collect()} == {"dlq_1", "dlq_t_0_3", "dlq_t_0_4"}


def test_full_then_incremental_then_delete(spark):
    state = spark.createDataFrame([("e", "a", "0"), ("e", "b", "0"), ("f", "a", "0")], "entity_id string, feature_name string, value string")
    updates = spark.createDataFrame(
        [(1, "e", "full", {"a": "1"}, None), (2, "e", "incremental", {"c": "2"}, 60), (3, "f", "delete", {}, None), (4, "f", "incremental", {"z": "9"}, None)],
        "seq long, entity_id string, update_type string, features map<string,string>, ttl_seconds int",
    )
    got = sorted(tuple(r) for r in events.apply_feature_updates(state, updates).collect())
    assert got == [("e", "a", "1", 1, None), ("e", "c", "2", 2, 60), ("f", "z", "9", 4, None)]


def test_unknown_message_kind(stream_rows):
    with pytest.raises(ValueError):
        events.to_messages(stream_rows, "other")


LOG = "entity_type string, entity_id string, feature_name string, value string, feature_ts timestamp_ntz, version long, write_seq long"


@pytest.fixture(scope="module")
def log(spark):
    rows = [("user", "e", "a", "1", at(0), 1, 1), ("user", "e", "a", "2", at(100), 2, 3), ("user", "e", "a", "3", at(50), 3, 4), ("user", "e", "b", "x", at(100), 1, 2)]
    return spark.createDataFrame(rows, LOG)


def test_point_in_time_and_active_differ(spark, log):
    spine = spark.createDataFrame([(1, "e", at(100)), (2, "e", at(99)), (3, "e", at(-1)), (4, "e", at(100 + 86400)), (5, "e", at(101 + 86400)), (6, "nobody", at(0))], "spine_id long, entity_id string, as_of timestamp_ntz")
    got = {r.spine_id: (r.a, r.b) for r in feature_log.point_in_time_join(spine, log, ["a", "b"], lookback="1 day").collect()}
    assert got == {1: ("2", "x"), 2: ("3", None), 3: (None, None), 4: ("2", "x"), 5: (None, None), 6: (None, None)}
    assert [r.value for r in feature_log.current_features(log, names=["a"]).collect()] == ["3"]
    assert [r.value for r in feature_log.features_at(log, lit_at(49)).collect()] == []
    assert [r.value for r in feature_log.features_at(log, lit_at(49), mode="history").collect()] == ["1"]
    with pytest.raises(ValueError):
        feature_log.features_at(log, lit_at(0), mode="x")


def test_statistics_of_text(log):
    rows = {r.feature_name: r for r in feature_log.feature_statistics(log).collect()}
    assert (rows["b"].n_rows, rows["b"].n_values, rows["b"].mean) == (1, 0, None)


def test_write_without_sequence(spark, log):
    defs = spark.createDataFrame([("a", "user", "numerical")], "name string, entity_type string, data_type string")
    batch = spark.createDataFrame([("user", "e", "a", "9", at(7)), ("user", "e", "zz", "9", at(7))], "entity_type string, entity_id string, feature_name string, value string, feature_ts timestamp_ntz")
    rows = feature_log.write_features(log, batch, defs).where("is_active and feature_name = 'a'").collect()
    assert [(r.value, r.version) for r in rows] == [("9", int((at(7) - dt.datetime(1970, 1, 1)).total_seconds()))]


def test_ttl_on_the_boundary_and_delete_then_rewrite(spark, log):
    assert online.online_view(log, lit_at(50 + 3600)).where("feature_name = 'a'").count() == 0
    assert online.online_view(log, lit_at(49 + 3600)).where("feature_name = 'a'").count() == 1
    deletes = spark.createDataFrame([(3, "user", "e", "b"), (3, "user", "e", None)], "write_seq long, entity_type string, entity_id string, feature_name string")
    assert [r.feature_name for r in online.apply_deletes(log, deletes).collect()] == ["a"]
    assert [r.feature_name for r in online.feature_versions(log, deletes).collect()] == ["a"]


def test_resolve_ties_go_offline(spark):
    schema = "entity_id string, feature_name string, value string, feature_ts timestamp_ntz"
    on = spark.createDataFrame([("e", "a", "1", at(5)), ("e", "b", "1", at(5)), ("e", "c", None, at(5))], schema)
    off = spark.createDataFrame([("e", "a", "2", at(5)), ("e", "b", "1", at(0)), ("e", "c", "3", at(0))], schema)
    diff = sync.diff_stores(on, off)
    got = {r.feature_name: (r.status, r.winner, r.value) for r in sync.resolve(diff).collect()}
    assert got == {"a": ("conflict", "offline", "2"), "b": ("equal", None, None), "c": ("offline_only", "offline", "3")}
    with pytest.raises(ValueError):
        sync.resolve(diff, "coin")


def test_vectors(spark):
    rows = [(i, [float(i % 3), 1.0, 0.5 * i]) for i in range(1, 30)] + [(99, [0.0, 0.0, 0.0])]
    items = spark.createDataFrame(rows, "item_id long, embedding array<double>")
    assert vectors.l2_normalize(items).where("embedding is null").count() == 1
    asked = items.where("item_id in (3, 99)").withColumnRenamed("item_id", "query_id")
    exact = vectors.exact_topk(items, asked, 5)
    assert exact.count() == 5  # the zero query has no neighbours
    index, centroids = vectors.build_ivf(items, nlist=4)
    every = vectors.ivf_search(index, centroids, asked, 5, nprobe=4)
    assert [tuple(r)[:3] for r in every.orderBy("rank").collect()] == [tuple(r)[:3] for r in exact.orderBy("rank").collect()]
    assert {r.recall for r in vectors.recall_at_k(exact, exact, (1, 5)).collect()} == {1.0}
    with pytest.raises(ValueError):
        vectors.index_stats(items, "tree")
    books = vectors.train_pq(items, m=3, nbits=2)
    assert {len(r.codes) for r in vectors.encode_pq(items, books).collect()} == {3}
    with pytest.raises(ValueError):
        vectors.train_pq(items, m=2)


def test_rebuild_decision(spark):
    rows = [(1, 100, 10, 1.0), (2, 100, 9, 24.0), (3, 100, 9, 23.9), (4, 0, 0, None), (5, 100, 20, 1.0)]
    got = {r.i: (r.rebuild, r.alert) for r in vectors.should_rebuild(spark.createDataFrame(rows, "i int, n_items long, n_changes long, age_hours double")).collect()}
    assert got == {1: (True, False), 2: (True, False), 3: (False, False), 4: (True, False), 5: (True, True)}


def test_training_edges(spark):
    rows = [("u", 1, at(0)), ("u", 2, at(1)), ("u", 1, at(2)), ("v", 2, at(0))]
    df = spark.createDataFrame(rows, "user_id string, item_id long, event_ts timestamp_ntz")
    seq = {(r.user_id, r.event_ts): r for r in training.history_sequence(df, training.user_history(df), 3).collect()}
    assert seq[("u", at(2))].items == [2, 0, 0] and seq[("u", at(2))].mask == [1, 0, 0]
    assert seq[("v", at(0))].items == [0, 0, 0]
    leaky = training.history_sequence(df, training.user_history(df), 3, causal=False)
    assert {(r.user_id, r.event_ts): r.items for r in leaky.collect()}[("u", at(0))] == [2, 0, 0]
    items = spark.createDataFrame([(1,), (2,), (3,)], "item_id long")
    probs = training.negative_probs(items, training.item_counts(df), "uniform")
    samples = df.withColumn("sample_id", F.monotonically_increasing_id())
    drawn = training.sample_negatives(samples, training.user_history(df), probs, 5)
    found = drawn.join(samples.select("sample_id", "user_id"), "sample_id").groupBy("user_id").agg(F.collect_set("item_id").alias("s")).collect()
    assert {r.user_id: sorted(r.s) for r in found} == {"u": [3], "v": [1, 3]}  # history covers the rest: short rows
    assert training.sample_negatives(samples, training.user_history(df), training.negative_probs(items, training.item_counts(df), "popular"), 5).where("item_id = 3").count() == 0
    with pytest.raises(ValueError):
        training.negative_probs(items, training.item_counts(df), "other")
    with pytest.raises(ValueError):
        training.split(df, "item_id", mode="other")
    assert training.number_rows(df.limit(0), "item_id").count() == 0


def test_ranking_metrics_of_short_lists(spark):
    rows = [(1, 2.0, True), (1, 1.0, False), (2, 1.0, True), (2, 3.0, False)]
    r = training.ranking_metrics(spark.createDataFrame(rows, "sample_id int, score double, is_positive boolean")).first()
    assert (r.n, r.accuracy, r.recall_1, r.recall_5) == (2, 0.5, 0.5, None)


def test_drift_of_equal_and_constant_samples(spark):
    x = spark.createDataFrame([("a", float(i % 40)) for i in range(200)] + [("c", 5.0)] * 200, "feature string, x double")
    got = {r.feature: r for r in drift.feature_drift(x, x, min_n=100).collect()}
    assert got["a"].psi == 0 and got["a"].kl == pytest.approx(0, abs=1e-9) and not got["a"].drift
    assert (got["c"].psi, got["c"].kl, got["c"].drift) == (0.0, 0.0, False)
    assert drift.feature_drift(x, x).count() == 0  # below the gate of 1000
    with pytest.raises(ValueError):
        drift.psi(x, x, kind="log")


def test_bucket_edges(spark):
    ref = spark.createDataFrame([("a", float(i)) for i in range(11)], "feature string, x double")
    cur = spark.createDataFrame([("a", 10.0), ("a", 10.5), ("a", -1.0), ("a", 0.0)], "feature string, x double")
    steps = drift.value_steps(ref, cur)
    rows = drift._shares(steps, drift._edges(steps, 10, "quantiles")).orderBy("bucket").collect()
    assert [r.n_cur for r in rows] == [1, 0, 0, 0, 0, 0, 0, 0, 0, 1] and rows[0].t_cur == 4
    assert [r.n_ref for r in rows] == [1] * 9 + [2]


def test_value_steps_run_over_parts(spark):
    rng = np.random.default_rng(2)
    sides = [[(f, float(x)) for f in "ab" for x in rng.integers(0, 40, n)] + [("c", None)] for n in (500, 300)]
    ref, cur = (spark.createDataFrame(rows, "feature string, x double") for rows in sides)
    got = {(r.feature, r.x): r for r in drift.value_steps(ref, cur).collect()}
    for f in "ab":
        own = [sorted(x for g, x in rows if g == f) for rows in sides]
        xs = sorted({*own[0], *own[1]})
        assert sorted(x for g, x in got if g == f) == xs
        for x, nx in zip(xs, [*xs[1:], None]):
            r = got[f, x]
            assert (r.f_n, r.g_n, r.n, r.m, r.next) == (sum(y <= x for y in own[0]), sum(y <= x for y in own[1]), len(own[0]), len(own[1]), nx)
    assert drift.ks_test(ref, cur.limit(0)).collect()[0].ks is None


def test_chi_square_p(spark):
    got = spark.range(1).select(*[drift.chi_square_p(F.lit(float(x)), F.lit(d)).alias(f"c{k}") for k, (x, d) in enumerate([(3.841459, 1), (16.918978, 9), (18.307038, 10), (0.0, 3)])]).first()
    assert [round(v, 5) for v in got] == [0.05, 0.05, 0.05, 1.0]


@pytest.mark.parametrize("count", [False, True])
def test_gate_equals_a_fold_by_rows(count):
    rng = np.random.default_rng(5)
    for cooldown in (0, 70, 400):
        n = 300
        times = np.datetime64("2024-01-01", "us") + np.cumsum(rng.integers(0, 60, n)).astype("timedelta64[s]")
        flags, psi, sure = rng.random(n) < 0.8, rng.random(n) * 0.22, rng.random(n) * 0.83
        run, last, want = 0, None, []
        for t, d, p, c in zip(times, flags, psi, sure):
            hit = False
            if last is None or (t - last) / np.timedelta64(1, "s") >= cooldown:
                hit = d and (run >= 3 or p > 0.2 or c > 0.8)
                run = 0 if not d else run + 1 if hit or count else run
                last = t if hit else last
            want.append((bool(hit), run))
        gate = drift.Gate(cooldown=cooldown, count_unconfirmed=count)
        halves = [gate.fold(times[a:b], flags[a:b], psi[a:b], sure[a:b]) for a, b in ((0, 130), (130, 130), (130, n))]
        assert [(bool(a), int(r)) for part in halves for a, r in zip(*part)] == want


def test_gate(spark):
    rows = [("m", at(60 * i), d, p, c) for i, (d, p, c) in enumerate([(True, 0.15, 0.1), (True, 0.3, 0.1), (True, 0.3, 0.1), (False, 0.9, 0.9), (True, 0.1, 0.9)])]
    df = spark.createDataFrame(rows, "model string, checked_at timestamp_ntz, drift boolean, psi double, confidence double")
    assert [r.alert for r in drift.alert_gate(df).orderBy("checked_at").collect()] == [False, True, False, False, False]
    assert [r.alert for r in drift.alert_gate(df, cooldown=0).orderBy("checked_at").collect()] == [False, True, True, False, True]
    quiet = [("m", at(60 * i), d, p, 0.1) for i, (d, p) in enumerate([(True, 0.3), (False, 0.0), (True, 0.15)])]
    kept = drift.alert_gate(spark.createDataFrame(quiet, df.schema), cooldown=90).orderBy("checked_at").collect()
    assert [r.run_length for r in kept] == [1, 1, 1]  # the clean check fell into the cool-down
    weak = [("m", at(i), True, 0.15, 0.1) for i in range(5)]
    weak = spark.createDataFrame(weak, df.schema)
    assert not any(r.alert for r in drift.alert_gate(weak).collect())
    assert sum(r.alert for r in drift.alert_gate(weak, count_unconfirmed=True, cooldown=0).collect()) == 2


def test_counter_reset_at_the_first_point(spark):
    df = spark.createDataFrame([("m", at(0), 5), ("m", at(10), 7), ("m", at(20), 3)], "metric string, ts timestamp_ntz, counter long")
    assert [r.increase for r in metrics.counter_rate(df, 60).orderBy("ts").collect()] == [0, 2, 5]


def test_histogram_quantile_in_the_last_bucket(spark):
    df = spark.createDataFrame([("e", 100.0), ("e", 200.0)], "endpoint string, seconds double")
    assert metrics.histogram_quantile(metrics.latency_histogram(df), 0.5).first().quantile == 10.0


def test_rule_fires_after_its_hold_time(spark):
    points = spark.createDataFrame([(at(s), "m", "l", v) for s, v in [(0, 2.0), (60, 2.0), (120, 0.0), (180, 2.0)]], "ts timestamp_ntz, metric string, label string, value double")
    rules = spark.createDataFrame([("r", "m", ">", 1.0, 60, "x"), ("q", "m", ">", 1.0, 61, "x")], "rule string, metric string, op string, threshold double, for_seconds int, severity string")
    got = metrics.evaluate_rules(points, rules).collect()
    assert [(r.rule, r.fired_at, r.points) for r in got] == [("r", at(60), 2)]


def test_relabel_drops_secret_names(spark):
    df = spark.createDataFrame([("m", {"Password": "x", "a": "1"}, 1.0)], "metric string, labels map<string,string>, value double")
    assert metrics.relabel(df).first().labels == {"a": "1"}


def test_recommend_edges(spark):
    req = spark.createDataFrame([("a", None, 3), ("b", 0, None), ("c", 101, None), ("d", 100, 6)], "request_id string, num_recommendations int, rating int")
    good, bad = recommend.validate_requests(req)
    assert [(r.request_id, r.num_recommendations) for r in good.collect()] == [("a", 10)]
    assert {r.request_id for r in bad.collect()} == {"b", "c", "d"}
    with pytest.raises(ValueError):
        recommend.recommend(req.withColumn("user_id", F.lit("u")), req, req.select(F.lit("i").alias("item_id"), F.lit("view").alias("event_type"), F.lit("u").alias("user_id"), F.lit("s").alias("session_id"), F.lit("c").alias("item_category"), lit_at(0).alias("ts"), F.lit(1).alias("event_id")), pool="magic")


def test_significance_of_equal_groups(spark):
    m = spark.createDataFrame([("control", 100, 2000), ("treatment", 100, 2000)], "variant string, clicks long, views long")
    r = recommend.experiment_significance(m).first()
    assert (r.z, r.p_value, r.significant, r.lift) == (0.0, pytest.approx(1.0, abs=1e-6), False, 0.0)


def test_list_quality_of_one_item(spark):
    recs = spark.createDataFrame([("r", "i"), ("s", "i"), ("s", "j")], "request_id string, item_id string")
    vecs = spark.createDataFrame([("i", [1.0, 0.0]), ("j", [0.0, 2.0])], "item_id string, embedding array<double>")
    pop = spark.createDataFrame([("i", 3.0), ("j", 1.0)], "item_id string, popularity double")
    got = {r.request_id: (r.diversity, round(r.novelty, 3)) for r in recommend.list_quality(recs, vecs, pop).collect()}
    assert got == {"r": (None, 0.415), "s": (1.0, 1.208)}


def test_negatives_are_whole_and_follow_the_weights(spark):
    samples = spark.createDataFrame([(s, f"u{s % 3}", 0) for s in range(400)], "sample_id long, user_id string, item_id long")
    history = spark.createDataFrame([("u0", [(at(0), i) for i in range(1, 18)]), ("u1", [(at(0), 1)])], "user_id string, history array<struct<event_ts: timestamp_ntz, item_id: long>>")
    probs = spark.createDataFrame([(i, 0.5 if i == 1 else 0.5 / 19) for i in range(20)], "item_id long, p double")
    for attempts in (1, 40):  # the exact way alone, or almost never
        got = {}
        for r in training.sample_negatives(samples, history, probs, 5, attempts=attempts).collect():
            got.setdefault(r.sample_id, []).append((r.draw, r.item_id))
        for s in range(400):
            left = {18, 19} if s % 3 == 0 else set(range(2, 20)) if s % 3 == 1 else set(range(1, 20))
            draws = sorted(got[s])
            assert [d for d, _ in draws] == list(range(1, min(5, len(left)) + 1))
            assert len({i for _, i in draws}) == len(draws) and {i for _, i in draws} <= left
        first = [sorted(got[s])[0][1] == 1 for s in range(2, 400, 3)]
        assert 0.4 < np.mean(first) < 0.65  # u2: half of the weight is on item 1


def test_factors_of_ids_of_any_type(spark):
    rows = [(f"u{k % 5}", 10_000_000_000 + k % 7) for k in range(70)] + [(None, 1)]
    users, items = training.train_factors(spark.createDataFrame(rows, "user_id string, item_id long"), 4)
    assert {r.user_id for r in users.collect()} == {f"u{k}" for k in range(5)}
    assert {r.item_id for r in items.collect()} == {10_000_000_000 + k for k in range(7)}


def test_late_writes_expire_by_their_time_of_writing(spark):
    rows = [(1, "user", "u", "a", "1", at(0), 1, at(5000)), (1, "user", "v", "a", "1", at(0), 1, None)]
    log = spark.createDataFrame(rows, "write_seq long, entity_type string, entity_id string, feature_name string, value string, feature_ts timestamp_ntz, version long, written_at timestamp_ntz")
    assert [r.entity_id for r in online.online_view(log, lit_at(4000)).collect()] == ["u"]
    assert online.online_view(log.drop("written_at"), lit_at(4000)).count() == 0


def test_every_query_meets_every_item(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(vectors, "PART_ITEMS", 7)
    items = spark.range(40).select(F.col("id").alias("item_id"))
    asked = spark.range(25).select(F.col("id").alias("query_id"))
    got = [(r.item_id, r.a.query_id) for r in vectors.meet(items, asked, "query_id", least=1).collect()]
    assert sorted(got) == [(i, q) for i in range(40) for q in range(25)]
    assert vectors.meet(items, asked.limit(0), "query_id").count() == 0


def test_factors_read_the_interactions_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row

    rows = spark.sparkContext.parallelize([(k % 5, k % 7) for k in range(70)], 2).map(seen)
    users, items = training.train_factors(spark.createDataFrame(rows, "user_id long, item_id long"), 4)
    assert users.count() == 5 and items.count() == 7 and read.value == 70
