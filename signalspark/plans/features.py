"""Queries of real-time features, sessions and ranked lists (B)."""

from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import features as op
from ..sources import fixtures as fx
from .registry import query

_FNS = {"count": "count", "sum": "sum", "mean": "avg", "std": "stddev_pop", "min": "min", "max": "max", "median": "median"}


def _trailing(feature, windows, fns=op.FUNCTIONS):
    """Framed aggregates; the integer k keeps integer sums."""
    out = []
    for w in windows:
        for f in fns:
            e = f"{_FNS[f]}({feature}) over (partition by user_id order by ts range between interval {w} seconds preceding and current row)"
            e = f"({e})::bigint" if feature == "k" and f == "sum" else f"round({e}, 6)" if f in ("sum", "mean", "std", "median") else e
            out.append(f"{e} as {feature}_{f}_{w}s")
    return ", ".join(out)


_WEIGHT = "case event_type when 'view' then 1 when 'click' then 2 when 'like' then 3 when 'share' then 4 when 'add_to_cart' then 5 when 'purchase' then 10 else 1 end"
_SESSIONS = """
flagged as (
  select *, case when lag(session_id) over u is null or lag(session_id) over u <> session_id then 1 else 0 end as is_new
  from interactions window u as (partition by user_id order by ts, event_id)
), sessions as (
  select *, sum(is_new) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as session_no from flagged
)"""
_FEATURES = f"""{_SESSIONS}, featured as (
  select *, (epoch_us(ts) - epoch_us(min(ts) over s)) / 1000000.0::double as session_seconds, count(*) over u as total_events, count(*) over s as session_events,
         len(list_distinct(list(item_id) over s))::bigint as unique_items, len(list_distinct(list(item_category) over s))::bigint as unique_categories
  from sessions window u as (partition by user_id order by ts, event_id rows unbounded preceding), s as (partition by user_id, session_no order by ts, event_id rows unbounded preceding)
)"""
_CANDIDATES = f"""{_SESSIONS}, pop as (
  select item_id, sum({_WEIGHT})::double as popularity from interactions group by item_id
), popular as (
  select item_id from pop order by popularity desc, item_id limit 100
), seen as (
  select distinct user_id, item_category from (select *, max(session_no) over (partition by user_id) as last_no from sessions) where session_no = last_no
), few as (
  select item_id, item_category from catalog qualify row_number() over (partition by item_category order by item_id) <= 20
), by_category as (
  select distinct user_id, item_id from seen join few using (item_category)
), cands as (
  select user_id, item_id from (select distinct user_id from interactions) cross join popular union select user_id, item_id from by_category
), scored as (
  select c.user_id, c.item_id, least(0.5::double + 0.3::double * least(coalesce(popularity, 0) / 1000.0::double, 1) + case when s.user_id is not null then 0.2::double else 0 end, 1) as score
  from cands c left join pop using (item_id) left join catalog k using (item_id) left join seen s on s.user_id = c.user_id and s.item_category = k.item_category
), ranked as (
  select *, row_number() over (partition by user_id order by score desc, item_id)::int as rank from scored
)"""


def _inputs(spark, d):
    i, catalog = fx.interactions(spark, d), fx.catalog(spark, d)
    return i, catalog, op.popularity(i), op.session_categories(i)


@query("b1_trailing_aggregates", f"select event_id, {_trailing('value', (300, 3600, 86400, 604800))} from interactions")
def b1(spark, d):
    out = op.trailing_aggregates(fx.interactions(spark, d), "user_id", "ts", "value", windows=(300, 3600, 86400, 604800))
    return rounded(out.select("event_id", *[c for c in out.columns if c.startswith("value_")]))


@query("b2_all_trailing_aggregates", f"select event_id, {_trailing('value', (86400, 604800))}, {_trailing('k', (86400, 604800))} from interactions")
def b2(spark, d):
    i = fx.interactions(spark, d).select("event_id", "user_id", "ts", "value", "k")
    out = op.all_trailing_aggregates(i, "user_id", "ts", windows=(86400, 604800), features=["value", "k"])
    return rounded(out.select("event_id", *[c for c in out.columns if c.endswith("s") and c[:2] in ("va", "k_")]))


@query(
    "b3_capped_window",
    """with l as (select event_id, list(value) over (partition by user_id order by ts range between interval 604800 seconds preceding and current row) as v from interactions),
    m as (select event_id, list_slice(v, -5, len(v)) as v from l)
    select event_id, len(v)::bigint as value_count_604800s, round(list_sum(v), 6) as value_sum_604800s, round(list_avg(v), 6) as value_mean_604800s, list_min(v) as value_min_604800s, list_max(v) as value_max_604800s, round(list_median(v), 6) as value_median_604800s from m""",
)
def b3(spark, d):
    fns = ("count", "sum", "mean", "min", "max", "median")
    out = op.trailing_aggregates(fx.interactions(spark, d), "user_id", "ts", "value", windows=(604800,), fns=fns, max_events=5)
    return rounded(out.select("event_id", *[f"value_{f}_604800s" for f in fns]))


@query(
    "b4_sliding_aggregates",
    """with w as (select user_id, value, unnest([time_bucket(interval 6 hours, ts) - i * interval 6 hours for i in range(4)]) as window_start from interactions)
    select window_start, window_start + interval 24 hours as window_end, user_id, count(value) as n, round(sum(value), 6) as total, round(avg(value), 6) as mean from w group by all""",
)
def b4(spark, d):
    out = op.sliding_aggregates(fx.interactions(spark, d), "user_id", "ts", "value", size="24 hours", slide="6 hours")
    return rounded(out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}))


@query("b5_sessionize", f"with {_SESSIONS} select event_id, user_id, session_no from sessions")
def b5(spark, d):
    return op.sessionize(fx.interactions(spark, d)).select("event_id", "user_id", "session_no")


@query(
    "b6_session_features",
    f"with {_FEATURES} select event_id, session_no, round(session_seconds, 6) as session_seconds, total_events, session_events, unique_items, unique_categories, round(total_events / greatest(session_seconds / 60, 1), 6) as events_per_minute from featured",
)
def b6(spark, d):
    cols = ("event_id", "session_no", "session_seconds", "total_events", "session_events", "unique_items", "unique_categories", "events_per_minute")
    return rounded(op.session_features(fx.interactions(spark, d)).select(*cols))


@query("b7_time_features", "select event_id, hour(ts)::int as hour, (isodow(ts) - 1)::int as weekday, isodow(ts) >= 6 as is_weekend, hour(ts) < 6 or hour(ts) > 22 as is_night from events")
def b7(spark, d):
    return op.time_features(fx.table(spark, d, "events")).select("event_id", "hour", "weekday", "is_weekend", "is_night")


@query(
    "b8_popularity",
    f"select 'item' as kind, item_id as id, sum({_WEIGHT})::double as popularity from interactions group by all union all select 'category', item_category, sum({_WEIGHT})::double from interactions group by all",
)
def b8(spark, d):
    i = fx.interactions(spark, d)
    by = lambda kind, c: op.popularity(i, c).select(F.lit(kind).alias("kind"), F.col(c).alias("id"), "popularity")
    return by("item", "item_id").unionByName(by("category", "item_category"))


@query(
    "b9_user_features",
    f"with {_FEATURES} select event_id, round(session_seconds, 6) as session_seconds, total_events, unique_items, {_trailing('value', op.WINDOWS)}, {_trailing('k', op.WINDOWS)}, hour(ts)::int as hour, isodow(ts) >= 6 as is_weekend from featured",
)
def b9(spark, d):
    out = op.user_features(fx.interactions(spark, d), features=["value", "k"])
    return rounded(out.select("event_id", "session_seconds", "total_events", "unique_items", *[f"{x}_{f}_{w}s" for x in ("value", "k") for w in op.WINDOWS for f in op.FUNCTIONS], "hour", "is_weekend"))


@query("b10_popular_items", f"select item_id, sum({_WEIGHT})::double as popularity from interactions group by all order by 2 desc, 1 limit 100")
def b10(spark, d):
    return op.popular_items(op.popularity(fx.interactions(spark, d)))


@query("b11_candidates", f"with {_CANDIDATES} select user_id, item_id from cands")
def b11(spark, d):
    i, catalog, pop, sess = _inputs(spark, d)
    return op.all_candidates(i, op.popular_items(pop), op.category_candidates(sess, catalog))


@query("b12_score_items", f"with {_CANDIDATES} select user_id, item_id, round(score, 6) as score from scored")
def b12(spark, d):
    i, catalog, pop, sess = _inputs(spark, d)
    cands = op.known_candidates(i, pop, sess, catalog)
    return rounded(op.score_items(cands, pop, sess, catalog))


@query(
    "b13_debounce",
    """with recursive e as (select user_id, ts, event_id, row_number() over (partition by user_id order by ts, event_id) as n from interactions where event_type in ('view', 'click')),
    f(user_id, n, event_id, ts, last_ts, fires) as (
      select user_id, n, event_id, ts, ts, true from e where n = 1
      union all select e.user_id, e.n, e.event_id, e.ts, case when e.ts - f.last_ts >= interval 172800 seconds then e.ts else f.last_ts end, e.ts - f.last_ts >= interval 172800 seconds
      from f join e on e.user_id = f.user_id and e.n = f.n + 1)
    select user_id, ts, event_id from f where fires""",
)
def b13(spark, d):
    return op.debounce(fx.interactions(spark, d), seconds=172800)


@query("b14_rank_per_user", f"with {_CANDIDATES} select user_id, string_agg(rank || ':' || item_id, ',' order by rank) as items, round(sum(score), 6) as total from ranked where rank <= 10 group by user_id")
def b14(spark, d):
    i, catalog, _, _ = _inputs(spark, d)
    out = op.flagship(i, catalog)
    text = F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["rank"].cast("string"), x["item_id"])), ",")
    return rounded(out.select("user_id", text.alias("items"), F.aggregate("items", F.lit(0.0), lambda a, x: a + x["score"]).alias("total")))


@query(
    "b15_processor_stats",
    "select count(distinct user_id) as active_users, count(distinct case when event_type in ('view', 'click') then user_id end) as scored_users, count(distinct item_id) as items, count(distinct item_category) as categories, count(distinct session_id) as sessions from interactions",
)
def b15(spark, d):
    return op.processor_stats(fx.interactions(spark, d))
