"""Streams over files: restart from the checkpoint, many batches, late rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from signalspark.operators import drift, features
from signalspark.sources import commits, fixtures
from signalspark.sources.streams import read_event_stream
from signalspark.streaming import operators as op
from signalspark.streaming import view_table

FOLDER = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture()
def halves(spark, tmp_path):
    """The interactions cut into an earlier and a later file."""
    rows = fixtures.interactions(spark, FOLDER)
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return tmp_path / "in", rows.where(F.col("ts") < cut), rows.where(F.col("ts") >= cut), rows


def _add(df, path):
    df.coalesce(1).write.mode("append").parquet(str(path))


def test_sessions_restart_from_the_checkpoint(spark, halves, tmp_path):
    path, first, second, every = halves
    for part in (first, second):
        _add(part, path)
        stream = op.stream_sessions(read_event_stream(spark, str(path), max_files=1), ttl_seconds=None)
        op.append_to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    cols = ("event_id", "session_no", "total_events", "session_events", "unique_items", "unique_categories")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("batch_id").distinct().count() == 2
    want = features.session_features(every).select(*cols)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.collect()))


def _parts(rows, n):
    """The rows in order of time, cut into `n` frames."""
    every = rows.orderBy("ts", "event_id").collect()
    size = -(-len(every) // n)
    return [rows.sparkSession.createDataFrame(every[k * size : (k + 1) * size], rows.schema) for k in range(n)]


def test_idle_users_leave_the_state(spark, halves, tmp_path):
    """Four micro-batches with a restart each give what one gives, and the state holds few users."""
    *_, every = halves
    cols = ("user_id", "event_id", "session_no", "total_events", "session_events", "unique_items", "unique_categories", "session_seconds")
    for name, parts in (("one", [every]), ("many", _parts(every, 4))):
        for part in parts:
            _add(part, tmp_path / name / "in")
            stream = op.stream_sessions(read_event_stream(spark, str(tmp_path / name / "in"), max_files=1), ttl_seconds=43200)
            op.append_to_table(stream, str(tmp_path / name / "out"), str(tmp_path / name / "cp")).awaitTermination()
    one, many = ({tuple(r) for r in spark.read.parquet(str(tmp_path / n / "out")).select(*cols).collect()} for n in ("one", "many"))
    assert one == many and len(one) == every.count()
    held = lambda name: spark.read.format("statestore").option("path", str(tmp_path / "many" / "cp")).option("stateVarName", name).load().count()
    newest = every.agg(F.max("ts")).first()[0]
    awake = every.where(F.col("ts") >= F.lit(newest - dt.timedelta(seconds=43200 + 3600)).cast("timestamp_ntz"))
    assert 0 < held("session") <= awake.select("user_id").distinct().count() < every.select("user_id").distinct().count()
    open_sessions = every.join(awake.select("session_id").distinct(), "session_id").count()
    assert held("seen") <= 2 * open_sessions < every.count() / 2


def test_sessions_with_nulls_and_ties(spark, tmp_path):
    rows = [(1, "u", 0, None, "a", "c"), (2, "u", 0, None, None, "c"), (3, "u", 10, "s", "a", None), (4, "u", 10, "s", "a", "c"), (5, "u", 2000, "s", "b", "c"), (6, None, 5, "s", "b", "c")]
    frame = spark.createDataFrame([(i, u, T0 + dt.timedelta(seconds=t), s, x, c) for i, u, t, s, x, c in rows], "event_id long, user_id string, ts timestamp, session_id string, item_id string, item_category string")
    _add(frame, tmp_path / "in")
    op.append_to_table(op.stream_sessions(read_event_stream(spark, str(tmp_path / "in"), max_files=1), ttl_seconds=1000), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.event_id: (r.session_no, r.total_events, r.session_events, r.unique_items, r.unique_categories, r.session_seconds) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: (1, 1, 1, 1, 1, 0.0), 2: (1, 2, 2, 1, 1, 0.0), 3: (2, 3, 1, 1, 0, 0.0), 4: (2, 4, 2, 1, 1, 0.0), 5: (1, 1, 1, 1, 1, 0.0), 6: (1, 1, 1, 1, 1, 0.0)}


def test_debounce_and_gate_restart_from_the_checkpoint(spark, halves, tmp_path):
    *_, every = halves
    checks = lambda df: df.select(F.concat(F.lit("m"), (F.col("user_no") % 4).cast("string")).alias("model"), F.col("ts").alias("checked_at"), (F.col("value") > 60).alias("drift"), (F.col("value") / 400.0).alias("psi"), (F.col("k") / 110.0).alias("confidence"))
    for part in _parts(every, 3):
        _add(part, tmp_path / "in")
        stream = read_event_stream(spark, str(tmp_path / "in"), max_files=1)
        op.append_to_table(op.stream_debounce(stream, 172800), str(tmp_path / "d"), str(tmp_path / "cp1")).awaitTermination()
        op.append_to_table(op.stream_alert_gate(checks(stream), cooldown=43200), str(tmp_path / "g"), str(tmp_path / "cp2")).awaitTermination()
    fired = {(r.user_id, r.event_id) for r in spark.read.parquet(str(tmp_path / "d")).collect()}
    rows = every.where(F.col("event_type").isin("view", "click"))
    assert fired == {(r.user_id, r.event_id) for r in features.debounce(rows, seconds=172800).collect()} and spark.read.parquet(str(tmp_path / "d")).select("batch_id").distinct().count() == 3
    gated = {(r.model, r.checked_at, r.alert, r.run_length) for r in spark.read.parquet(str(tmp_path / "g")).collect()}
    assert gated == {(r.model, r.checked_at, r.alert, r.run_length) for r in drift.alert_gate(checks(every), cooldown=43200).collect()}


def _view_rows(spark, rows):
    return spark.createDataFrame([("user", f"u{u}", "f", str(v), T0, v, v) for u, v in rows], "entity_type string, entity_id string, feature_name string, value string, feature_ts timestamp, version long, write_seq long")


def test_view_writes_only_changed_buckets(spark, tmp_path):
    path, want, data = str(tmp_path / "view"), {}, tmp_path / "view" / "data"
    for batch in range(12):
        rows = [(u, batch * 1000 + u) for u in (range(400) if batch == 0 else [batch, batch + 1])]
        view_table.merge_batch(_view_rows(spark, rows), batch, path)
        want |= {f"u{u}": v for u, v in rows}
        written = [p for p in (data / f"{batch:020d}").glob("bucket=*")]
        assert len(written) == (view_table.BUCKETS if batch == 0 else len(written)) and (batch == 0 or len(written) <= 2)
        if batch in (3, 7):  # repeated after the commit, and before it
            view_table.merge_batch(_view_rows(spark, rows), batch, path)
            (tmp_path / "view" / "manifests" / f"{batch:020d}").unlink()
            view_table.merge_batch(_view_rows(spark, rows), batch, path)
        got = {r.entity_id: r.version for r in view_table.read_view(spark, path).collect()}
        assert got == want
    assert len(list((tmp_path / "view" / "manifests").glob("0*"))) == 2
    folders = view_table._manifest(spark, path, 11)
    assert max(map(len, folders.values())) <= view_table.FOLDERS
    assert len(list(data.glob("*/bucket=*"))) <= 2 * sum(map(len, folders.values()))
    view_table.merge_batch(_view_rows(spark, [(1, 5)]), 12, path)  # written late: older than what is known
    view_table.merge_batch(_view_rows(spark, [(1, 5)]).limit(0), 13, path)
    assert {r.entity_id: r.version for r in view_table.read_view(spark, path).collect()} == want


def test_a_name_is_committed_once(spark, tmp_path):
    path = str(tmp_path / "x")
    assert commits.commit_text(spark, path, "one") and not commits.commit_text(spark, path, "two")
    assert commits.read_text(spark, path) == "one" and commits.names_in(spark, str(tmp_path)) == ["x"] and commits.names_in(spark, path + "/none") == []


def test_popularity_and_view_over_two_batches(spark, halves, tmp_path):
    path, first, second, every = halves
    for part in (first, second):
        _add(part, path)
        stream = read_event_stream(spark, str(path), max_files=1)
        op.append_to_table(op.stream_popularity(stream), str(tmp_path / "pop"), str(tmp_path / "cp1"), mode="update").awaitTermination()
        log = stream.select(F.lit("user").alias("entity_type"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("feature_name"), F.col("value").cast("string").alias("value"), F.col("ts").alias("feature_ts"), F.col("event_id").alias("version"), F.col("event_id").alias("write_seq"))
        op.stream_online_view(log, str(tmp_path / "view"), str(tmp_path / "cp2")).awaitTermination()
    got = {tuple(r) for r in op.latest_by_key(spark, str(tmp_path / "pop"), "item_id").collect()}
    assert got == {tuple(r) for r in features.popularity(every).collect()}
    view = {(r.entity_id, r.feature_name): r.version for r in op.read_online_view(spark, str(tmp_path / "view")).collect()}
    want = every.groupBy("user_id", "event_type").agg(F.max("event_id").alias("m")).collect()
    assert view == {(r.user_id, r.event_type): r.m for r in want}


def test_late_rows_beyond_the_watermark_are_dropped(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    schema = "user_id string, ts timestamp, value double"
    for batch in ([("u", at(1), 1.0), ("u", at(50), 1.0)], [("u", at(2), 5.0), ("u", at(49), 2.0)]):
        _add(spark.createDataFrame(batch, schema), tmp_path / "in")
        stream = features.sliding_aggregates(read_event_stream(spark, str(tmp_path / "in"), max_files=1), "user_id", "ts", "value", size="2 hours", slide="2 hours", watermark="3 hours")
        op.append_to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp"), mode="update").awaitTermination()
    got = {(r.window_start, r.n, r.total) for r in op.latest_by_key(spark, str(tmp_path / "out"), "window_start", "user_id").collect()}
    assert got == {(at(0), 1, 1.0), (at(48), 1, 2.0), (at(50), 1, 1.0)}


def test_pipeline_keeps_every_failed_message(spark, tmp_path):
    good = '{"event_id":"1","user_id":"u","session_id":"s","event_type":"view","item_id":"i","item_category":"c"}'
    rows = [("a.user-events", 0, 1, good), ("a.user-events", 0, 2, "{"), ("a.user-events", 0, 3, good.replace("view", "no"))]
    _add(spark.createDataFrame(rows, "topic string, partition_id int, offset_id long, msg_value string"), tmp_path / "in")
    seen = []
    pipeline = op.EventPipeline().on("view", lambda df, b: seen.append(("x", df.count()))).on("view", lambda df, b: seen.append(("y", df.first().contract)))
    pipeline.start(read_event_stream(spark, str(tmp_path / "in")), str(tmp_path / "dead"), str(tmp_path / "cp")).awaitTermination()
    assert seen == [("x", 1), ("y", "user_event")]
    assert sorted(r.offset for r in spark.read.parquet(str(tmp_path / "dead")).collect()) == [2, 3]


def test_a_new_user_costs_few_calls_of_the_state():
    """Each call is a message to the executor; a new user's map needs no clearing, and one call tells whether there is a state."""
    calls = []

    class Handle:
        def __getattr__(self, name):
            return lambda *a: self if name.startswith("getV") or name.startswith("getM") else calls.append(name)

    sessions = op._Sessions(None)
    sessions.init(Handle())
    rows = [("u", t, n, s, i, c) for n, (t, s, i, c) in enumerate([(5, "s", "i", "c"), (1, "r", "i", "c"), (None, "s", None, None), (7, "s", "j", "c")])]
    got = {r.event_id: tuple(r)[2:] for r in sessions.handleInputRows(("u",), iter(rows), None)}
    assert got == {1: (1, 0, 1, 1, 1, 1), 0: (2, 0, 2, 1, 1, 1), 3: (2, 2, 3, 2, 2, 1), 2: (2, None, 4, 3, 2, 1)}
    assert calls == ["get", "updateValue", "updateValue", "updateValue", "update"]
