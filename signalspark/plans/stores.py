"""Queries of the feature log, the online view and their reconciliation (C, D, E)."""

import uuid

from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import feature_log as log_op
from ..operators import online as on_op
from ..operators import sync as sync_op
from ..sources import fixtures as fx
from ..sources.scratch import scratch_dir
from .registry import query

NAMES = ["last_view", "last_click", "last_purchase", "last_signup"]
_ACTIVE = "active as (select * from feature_log qualify row_number() over (partition by entity_id, feature_name order by write_seq desc) = 1)"


def _at(text):
    return F.lit(text).cast("timestamp_ntz")


@query(
    "c1_register_features",
    "select name, 'accepted' as outcome, data_type from feature_defs union all select 'extra', 'accepted', 'text' union all select name, 'refused', 'array' from feature_defs",
)
def c1(spark, d):
    defs = fx.feature_defs(spark, d)
    new = defs.withColumn("data_type", F.lit("array")).unionByName(spark.range(1).select(F.lit("extra").alias("name"), F.lit("user").alias("entity_type"), F.lit("text").alias("data_type")))
    kept, refused = log_op.register_features(defs, new)
    return kept.select("name", F.lit("accepted").alias("outcome"), "data_type").unionByName(refused.select("name", F.lit("refused").alias("outcome"), "data_type"))


@query("c2_registered_only", "select write_seq, feature_name from feature_log where feature_name in (select name from feature_defs)")
def c2(spark, d):
    return log_op.registered_only(fx.feature_log(spark, d), fx.feature_defs(spark, d)).select("write_seq", "feature_name")


@query(
    "c3_write_features",
    "select write_seq, entity_id, feature_name, version, row_number() over (partition by entity_id, feature_name order by write_seq desc) = 1 as is_active from feature_log where feature_name in (select name from feature_defs)",
)
def c3(spark, d):
    log, defs = fx.feature_log(spark, d), fx.feature_defs(spark, d)
    old = log_op.registered_only(log.where("version % 2 = 0"), defs)
    return log_op.write_features(old, log.where("version % 2 = 1"), defs).select("write_seq", "entity_id", "feature_name", "version", "is_active")


@query("c4_current_features", f"with {_ACTIVE} select entity_id, feature_name, round(num, 6) as value, version from active where feature_name in ('last_view', 'last_click')")
def c4(spark, d):
    log = fx.feature_log(spark, d)
    out = log_op.current_features(log, log.select("entity_id"), ["last_view", "last_click"])
    return rounded(out.select("entity_id", "feature_name", F.col("value").cast("double").alias("value"), "version"))


@query("c5_features_at_active", f"with {_ACTIVE} select entity_id, feature_name, version from active where feature_ts <= timestamp '2024-01-30 00:00:00'")
def c5(spark, d):
    return log_op.features_at(fx.feature_log(spark, d), _at("2024-01-30 00:00:00")).select("entity_id", "feature_name", "version")


@query("c5_features_at_history", "select entity_id, feature_name, version from feature_log where feature_ts <= timestamp '2024-01-20 00:00:00' qualify row_number() over (partition by entity_id, feature_name order by feature_ts desc, write_seq desc) = 1")
def c5_history(spark, d):
    return log_op.features_at(fx.feature_log(spark, d), _at("2024-01-20 00:00:00"), mode="history").select("entity_id", "feature_name", "version")


@query(
    "c6_point_in_time_join",
    "select s.spine_id, s.entity_id, s.as_of, "
    + ", ".join(f"case when {n}.feature_ts >= s.as_of - interval 7 days then {n}.num end as {n}" for n in NAMES)
    + " from spine s "
    + " ".join(f"asof left join (select entity_id, feature_ts, num from feature_log where feature_name = '{n}') {n} on s.entity_id = {n}.entity_id and s.as_of >= {n}.feature_ts" for n in NAMES),
)
def c6(spark, d):
    out = log_op.point_in_time_join(fx.spine(spark, d), fx.feature_log(spark, d), NAMES, lookback="7 days")
    return out.select("spine_id", "entity_id", "as_of", *[F.col(n).cast("double").alias(n) for n in NAMES])


@query(
    "c7_historical_features",
    "select entity_id, feature_ts, "
    + ", ".join(f"max(num) filter (feature_name = '{n}') as {n}" for n in NAMES)
    + " from feature_log where feature_name in ('last_view', 'last_click', 'last_purchase', 'last_signup') and feature_ts between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-12 00:00:00' group by all",
)
def c7(spark, d):
    out = log_op.historical_features(fx.feature_log(spark, d), NAMES, _at("2024-01-05 00:00:00"), _at("2024-01-12 00:00:00"))
    return out.select("entity_id", "feature_ts", *[F.col(n).cast("double").alias(n) for n in NAMES])


@query(
    "c8_feature_statistics",
    f"with {_ACTIVE} select feature_name, count(*) as n_rows, count(num) as n_values, round(avg(num), 6) as mean, round(stddev_pop(num), 6) as std, min(num) as min, max(num) as max, round(median(num), 6) as median, round(quantile_cont(num, 0.25), 6) as q25, round(quantile_cont(num, 0.75), 6) as q75 from active group by all",
)
def c8(spark, d):
    return rounded(log_op.feature_statistics(fx.feature_log(spark, d)))


@query(
    "c8_feature_statistics_of_range",
    f"with {_ACTIVE} select feature_name, count(*) as n_rows, round(avg(num), 6) as mean, round(median(num), 6) as median from active where entity_type = 'user' and feature_ts between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-25 00:00:00' group by all",
)
def c8_range(spark, d):
    log = fx.feature_log(spark, d)
    other = log.withColumn("entity_type", F.lit("item"))
    out = log_op.feature_statistics(log.unionByName(other), entity_type="user", start=_at("2024-01-05 00:00:00"), end=_at("2024-01-25 00:00:00"))
    return rounded(out.select("feature_name", "n_rows", "mean", "median"))


@query("c9_export_to_path", f"with {_ACTIVE} select entity_id, feature_ts, max(num) filter (feature_name = 'last_purchase') as last_purchase from active where feature_name = 'last_purchase' group by all")
def c9_path(spark, d):
    out = log_op.export_features(fx.feature_log(spark, d), ["last_purchase"])
    back = log_op.write_export(out, f"{scratch_dir(spark)}/export-{uuid.uuid4().hex}")
    return back.select("entity_id", "feature_ts", F.col("last_purchase").cast("double").alias("last_purchase"))


@query("c11_retained_counts", f"with {_ACTIVE}, kept as (select write_seq from feature_log where feature_ts >= timestamp '2024-01-20 00:00:00' union select write_seq from active) select (select count(*) from kept) as kept, (select count(*) from feature_log) - (select count(*) from kept) as deleted")
def c11_counts(spark, d):
    return log_op.retained_counts(fx.feature_log(spark, d), _at("2024-01-20 00:00:00"))


@query("c9_export_features", f"with {_ACTIVE} select entity_id, feature_ts, max(num) filter (feature_name = 'last_view') as last_view, max(num) filter (feature_name = 'last_click') as last_click from active where feature_name in ('last_view', 'last_click') group by all")
def c9(spark, d):
    out = log_op.export_features(fx.feature_log(spark, d), ["last_view", "last_click"])
    return out.select("entity_id", "feature_ts", F.col("last_view").cast("double").alias("last_view"), F.col("last_click").cast("double").alias("last_click"))


@query(
    "c10_import_features",
    "select entity_id, feature_name, feature_ts, val as value, floor(epoch(feature_ts))::bigint as version from (select user_id as entity_id, ts as feature_ts, 'k' as feature_name, cast(k as varchar) as val from interactions union all select user_id, ts, 'item_id', item_id from interactions where event_id % 3 <> 0)",
)
def c10(spark, d):
    wide = fx.interactions(spark, d).select("user_id", "ts", "k", F.when(F.col("event_id") % 3 != 0, F.col("item_id")).alias("item_id"))
    return log_op.import_features(wide, "user", "user_id", "ts").select("entity_id", "feature_name", "feature_ts", "value", "version")


@query("c11_retain", f"with {_ACTIVE} select write_seq from feature_log where feature_ts >= timestamp '2024-01-20 00:00:00' union select write_seq from active")
def c11(spark, d):
    return log_op.retain(fx.feature_log(spark, d), _at("2024-01-20 00:00:00")).select("write_seq")


@query("c12_store_stats", f"with {_ACTIVE} select count(*) as n_values, count(distinct entity_type) as n_entity_types, min(feature_ts) as first_ts, max(feature_ts) as last_ts, (select count(*) from active) as n_active, (select count(*) from feature_defs) as n_definitions from feature_log")
def c12(spark, d):
    return log_op.store_stats(fx.feature_log(spark, d), fx.feature_defs(spark, d))


@query("c13_cap_versions", "select entity_id, feature_name, version from feature_log qualify row_number() over (partition by entity_id, feature_name order by version desc) <= 5")
def c13(spark, d):
    return log_op.cap_versions(fx.feature_log(spark, d), 5).select("entity_id", "feature_name", "version")


@query(
    "c14_rollback_features",
    "select entity_id, feature_name, max(version) filter (version <= case feature_name when 'last_view' then 5000 else 2000 end) as version, max(write_seq) + 1 as write_seq from feature_log where feature_name in ('last_view', 'last_click') group by all having count(*) filter (version <= case feature_name when 'last_view' then 5000 else 2000 end) > 0",
)
def c14(spark, d):
    log = fx.feature_log(spark, d)
    targets = fx.feature_defs(spark, d).where("name in ('last_view', 'last_click')").select(F.col("name").alias("feature_name"), F.when(F.col("name") == "last_view", 5000).otherwise(2000).alias("version"))
    return log_op.rollback_features(log, targets).select("entity_id", "feature_name", "version", "write_seq")


# -- online view -------------------------------------------------------------------------

_TTL = "case when write_seq % 7 = 0 then 1000000 when entity_id like '%5' then 7200 else 400000 end"
_AS_OF = "timestamp '2024-01-30 00:00:00'"
_VIEW = f"view_ as (select entity_type, entity_id, feature_name, num, version, feature_ts + to_seconds({_TTL}) as expires_at from feature_log qualify row_number() over (partition by entity_id, feature_name order by write_seq desc) = 1), alive as (select * from view_ where expires_at > {_AS_OF})"


def _timed(spark, d):
    ttl = F.when(F.col("write_seq") % 7 == 0, 1000000).when(F.col("entity_id").endswith("5"), 7200).otherwise(400000)
    return fx.feature_log(spark, d).withColumn("ttl_seconds", ttl)


def _view(spark, d):
    return on_op.online_view(_timed(spark, d), _at("2024-01-30 00:00:00"))


@query("d1_online_view", f"with {_VIEW} select entity_id, feature_name, num as value, version, expires_at from alive")
def d1(spark, d):
    return _view(spark, d).select("entity_id", "feature_name", F.col("value").cast("double").alias("value"), "version", "expires_at")


@query("d2_with_ttl", "select event_id, case when event_id % 5 = 2 then 77 else case event_type when 'view' then 3600 when 'click' then 7200 when 'purchase' then 1800 else 3600 end end as ttl_seconds from events")
def d2(spark, d):
    kinds = F.create_map(F.lit("view"), F.lit("user"), F.lit("click"), F.lit("item"), F.lit("purchase"), F.lit("session"))
    own = F.when(F.col("event_id") % 5 == 2, 77).when(F.col("event_id") % 5 == 1, 0)
    rows = fx.table(spark, d, "events").select("event_id", F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.lit("other")).alias("entity_type"), own.alias("ttl_seconds"))
    return on_op.with_ttl(rows).select("event_id", "ttl_seconds")


@query("d3_lookup_features", f"with {_VIEW} select 'r_' || entity_id as request_id, entity_id, feature_name, num as value from alive where feature_name in ('last_view', 'last_error')")
def d3(spark, d):
    asked = fx.interactions(spark, d).select(F.concat(F.lit("r_"), "user_id").alias("request_id"), F.col("user_id").alias("entity_id")).distinct().withColumn("names", F.lit("last_view, last_error,nothing"))
    return on_op.lookup_features(_view(spark, d), asked).select("request_id", "entity_id", "feature_name", F.col("value").cast("double").alias("value"))


@query("d4_entity_feature_map", f"with {_VIEW} select entity_id, count(*)::int as n, string_agg(feature_name || '=' || version, ',' order by feature_name) as features from alive group by all")
def d4(spark, d):
    view = _view(spark, d).withColumn("value", F.col("version").cast("string"))
    text = F.array_join(F.transform(F.map_entries("features"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return on_op.entity_feature_map(view).select("entity_id", F.size("features").alias("n"), text.alias("features"))


_DELETES = "gone as (select write_seq + 20 as write_seq, entity_id, case when write_seq % 2 = 0 then feature_name end as feature_name from feature_log where version % 50 = 0)"


def _deletes(spark, d):
    rows = fx.feature_log(spark, d).where("version % 50 = 0")
    return rows.select((F.col("write_seq") + 20).alias("write_seq"), "entity_type", "entity_id", F.when(F.col("write_seq") % 2 == 0, F.col("feature_name")).alias("feature_name"))


@query(
    "d5_apply_deletes",
    f"with {_DELETES}, {_ACTIVE} select entity_id, feature_name, version from active a where not exists (select 1 from gone g where g.entity_id = a.entity_id and (g.feature_name is null or g.feature_name = a.feature_name) and g.write_seq >= a.write_seq)",
)
def d5(spark, d):
    return on_op.apply_deletes(fx.feature_log(spark, d), _deletes(spark, d)).select("entity_id", "feature_name", "version")


@query("d6_feature_versions", f"with {_DELETES}, {_ACTIVE} select entity_id, feature_name, version from active a where not exists (select 1 from gone g where g.entity_id = a.entity_id and g.feature_name = a.feature_name and g.write_seq >= a.write_seq)")
def d6(spark, d):
    return on_op.feature_versions(fx.feature_log(spark, d), _deletes(spark, d)).select("entity_id", "feature_name", "version")


@query("d7_entity_metadata", "select entity_id, max(feature_ts) as last_updated, string_agg(distinct feature_name, ',' order by feature_name) as features from feature_log group by entity_id having max(feature_ts) + interval 86400 seconds > timestamp '2024-01-30 12:00:00'")
def d7(spark, d):
    out = on_op.entity_metadata(fx.feature_log(spark, d), _at("2024-01-30 12:00:00"), ttl=86400)
    return out.select("entity_id", "last_updated", F.array_join("features", ",").alias("features"))


@query(
    "d8_typed_values",
    "select case event_type when 'view' then 'num' when 'click' then 'tags' else 'note' end as feature_name, count(*) as n, count(*) filter (event_type = 'view' and event_id % 3 = 0 or event_type = 'click' and event_id % 4 = 0) as n_undecodable, sum(case when event_type = 'view' and event_id % 3 <> 0 then k end)::double as total, coalesce(sum(case when event_type = 'click' and event_id % 4 <> 0 then 2 end), 0)::bigint as n_items, max(case when event_type not in ('view', 'click') then item_id end) as top_text from interactions group by all",
)
def d8(spark, d):
    i = fx.interactions(spark, d)
    name = F.when(F.col("event_type") == "view", "num").when(F.col("event_type") == "click", "tags").otherwise("note")
    value = (
        F.when(F.col("event_type") == "view", F.when(F.col("event_id") % 3 == 0, "x").otherwise(F.col("k").cast("string")))
        .when(F.col("event_type") == "click", F.when(F.col("event_id") % 4 == 0, "[broken").otherwise('["a","b"]'))
        .otherwise(F.concat(F.lit('"'), "item_id", F.lit('"')))
    )
    defs = spark.range(1).select(F.explode(F.expr("array(struct('num' as name, 'numerical' as data_type), struct('tags' as name, 'array' as data_type), struct('note' as name, 'text' as data_type))")).alias("d")).select("d.*")
    typed = on_op.typed_values(i.select(name.alias("feature_name"), value.alias("value")), defs)
    more = typed.groupBy("feature_name").agg(F.sum("number").alias("total"), F.coalesce(F.sum(F.when(F.col("items").isNotNull(), F.size("items"))), F.lit(0)).alias("n_items"), F.max("text").alias("top_text"))
    return rounded(on_op.undecodable_counts(typed).join(more, "feature_name"))


# -- reconciliation ----------------------------------------------------------------------

_DIFF = """diff as (
  select coalesce(a.entity_id, b.entity_id) as entity_id, coalesce(a.feature_name, b.feature_name) as feature_name, a.value as online_value, b.value as offline_value, a.feature_ts as online_ts, b.feature_ts as offline_ts,
         case when b.value is null then 'online_only' when a.value is null then 'offline_only' when a.value = b.value then 'equal' else 'conflict' end as status
  from online_state a full join offline_state b on a.entity_id = b.entity_id and a.feature_name = b.feature_name
), won as (
  select *, case status when 'online_only' then 'online' when 'offline_only' then 'offline' when 'conflict' then case when online_ts > offline_ts then 'online' else 'offline' end end as winner from diff
)"""


def _diff(spark, d):
    return sync_op.diff_stores(fx.online_state(spark, d), fx.offline_state(spark, d))


@query("e1_diff_stores", f"with {_DIFF} select entity_id, feature_name, online_value, offline_value, status from diff")
def e1(spark, d):
    return _diff(spark, d).select("entity_id", "feature_name", "online_value", "offline_value", "status")


@query("e2_resolve", f"with {_DIFF} select entity_id, feature_name, winner, case winner when 'online' then online_value when 'offline' then offline_value end as value from won")
def e2(spark, d):
    return sync_op.resolve(_diff(spark, d)).select("entity_id", "feature_name", "winner", "value")


@query(
    "e3_sync_writes",
    f"with {_DIFF} select target, entity_id, feature_name, case winner when 'online' then online_value else offline_value end as value from won, (values ('online'), ('offline')) t(target) where winner is not null and (status = 'conflict' or target <> winner)",
)
def e3(spark, d):
    return sync_op.sync_writes(sync_op.resolve(_diff(spark, d))).select("target", "entity_id", "feature_name", "value")


def _written_diff(spark, d):
    """The differences of both stores by their digests."""
    root = f"{scratch_dir(spark)}/stores-{uuid.uuid4().hex}"
    sync_op.write_store(fx.online_state(spark, d), f"{root}/online")
    sync_op.write_store(fx.offline_state(spark, d), f"{root}/offline")
    return sync_op.diff_written_stores(spark, f"{root}/online", f"{root}/offline")


@query("e1_diff_by_digests", f"with {_DIFF} select entity_id, feature_name, online_value, offline_value, status from diff where status <> 'equal'")
def e1_digests(spark, d):
    return _written_diff(spark, d).select("entity_id", "feature_name", "online_value", "offline_value", "status")


@query(
    "e3_sync_writes_by_digests",
    f"with {_DIFF} select target, entity_id, feature_name, case winner when 'online' then online_value else offline_value end as value from won, (values ('online'), ('offline')) t(target) where winner is not null and (status = 'conflict' or target <> winner)",
)
def e3_digests(spark, d):
    return sync_op.sync_writes(sync_op.resolve(_written_diff(spark, d))).select("target", "entity_id", "feature_name", "value")


@query(
    "e4_sync_metrics",
    f"""with {_DIFF}, m as (select feature_name as entity_type, entity_id, status from diff)
    select entity_type, count(distinct entity_id) as entities, count(*) as features, count(*) filter (status <> 'equal') as synced, count(*) filter (status = 'conflict') as conflicts, count(*) filter (status in ('online_only', 'offline_only')) as missing from m group by all
    union all select 'total', count(distinct entity_id), count(*), count(*) filter (status <> 'equal'), count(*) filter (status = 'conflict'), count(*) filter (status in ('online_only', 'offline_only')) from m""",
)
def e4(spark, d):
    return sync_op.sync_metrics(_diff(spark, d).withColumn("entity_type", F.col("feature_name")))
