"""Trailing windows, sessions, popularity, candidates and ranked lists (B)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .trailing import FUNCTIONS, trailing_windows

#: Weights of the interaction types (fixed values); any other type weighs 1.
WEIGHTS = {"view": 1.0, "click": 2.0, "like": 3.0, "share": 4.0, "add_to_cart": 5.0, "purchase": 10.0}
WINDOWS = (300, 3600, 86400)
_KEYS = ("user_id", "item_id", "timestamp", "event_type")


def trailing_aggregates(
    df: DataFrame, entity: str, ts: str, feature: str, *, windows: tuple[int, ...] = WINDOWS, fns: tuple[str, ...] = FUNCTIONS, max_events: int | None = None
) -> DataFrame:
    """Add `<feature>_<fn>_<seconds>s` over the entity's events of the last `seconds`,
    bounds included; with `max_events` only the newest so many of a window count."""
    return trailing_windows(df, entity, ts, {feature: f"`{feature}`"}, windows=windows, fns=fns, max_events=max_events, as_double=max_events is not None)


def all_trailing_aggregates(df: DataFrame, entity: str, ts: str, *, windows: tuple[int, ...] = WINDOWS, fns: tuple[str, ...] = FUNCTIONS, features: list[str] | None = None) -> DataFrame:
    """Trailing aggregates of every feature column; strings count where they are numbers."""
    kinds = dict(df.dtypes)
    names = features if features is not None else [c for c in df.columns if c not in (*_KEYS, entity, ts)]
    numbers = [c for c in names if kinds[c] in ("string", "int", "bigint", "double", "float", "smallint", "tinyint") or kinds[c].startswith("decimal")]
    return trailing_windows(df, entity, ts, {c: f"try_cast(`{c}` as double)" if kinds[c] == "string" else f"`{c}`" for c in numbers}, windows=windows, fns=fns)


def sliding_aggregates(df: DataFrame, entity: str, ts: str, feature: str, *, size: str = "5 minutes", slide: str = "1 minute", watermark: str | None = None) -> DataFrame:
    """Count, sum and mean per entity and sliding window; `watermark` bounds late data of a stream."""
    rows = df.withWatermark(ts, watermark) if watermark else df
    return rows.groupBy(F.window(ts, size, slide).alias("w"), entity).agg(F.count(feature).alias("n"), F.sum(feature).alias("total"), F.avg(feature).alias("mean")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), entity, "n", "total", "mean"
    )


def sessionize(df: DataFrame, *, user: str = "user_id", ts: str = "ts", session: str = "session_id", tie: str = "event_id") -> DataFrame:
    """Add session_no: a session begins when the session id differs from the user's last event."""
    order = Window.partitionBy(user).orderBy(ts, tie)
    before = F.lag(session).over(order)
    changed = F.when(before.isNull() | (before != F.col(session)), 1).otherwise(0)
    return df.withColumn("__new", changed).withColumn("session_no", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def session_features(df: DataFrame, *, user: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Features of the running session at each event.

    total_events counts all events of the user (it is not reset with the session);
    session_events counts those of the session.
    """
    own = Window.partitionBy(user).orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    session = Window.partitionBy(user, "session_no").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    seconds = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.min(ts).over(session).cast("timestamp"))) / F.lit(1e6)

    def first_seen(c: str) -> Column:
        nth = F.row_number().over(Window.partitionBy(user, "session_no", c).orderBy(ts, tie))
        return F.when(F.col(c).isNotNull() & (nth == 1), 1).otherwise(0)

    # Running distinct counts as sums of first sightings: linear in a session's length, and
    # all of these windows share the partitioning by user.
    rows = sessionize(df, user=user, ts=ts, tie=tie).withColumns({"__item": first_seen("item_id"), "__category": first_seen("item_category")})
    rows = rows.select(
        "*", seconds.alias("session_seconds"), F.count(F.lit(1)).over(own).alias("total_events"), F.count(F.lit(1)).over(session).alias("session_events"),
        F.sum("__item").over(session).alias("unique_items"), F.sum("__category").over(session).alias("unique_categories"),
    ).drop("__item", "__category")
    return rows.withColumn("events_per_minute", F.col("total_events") / F.greatest(F.col("session_seconds") / 60.0, F.lit(1.0)))


def time_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Add hour, weekday (Monday 0), is_weekend, is_night (before 6 or after 22)."""
    hour, day = F.hour(ts), F.weekday(ts)
    return df.select("*", hour.alias("hour"), day.alias("weekday"), (day >= 5).alias("is_weekend"), ((hour < 6) | (hour > 22)).alias("is_night"))


def event_weight(event_type: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    return F.coalesce(F.try_element_at(weights, event_type), F.lit(1.0))


def popularity(df: DataFrame, by: str = "item_id") -> DataFrame:
    """Weighted interactions per item or category; rows without one are left out."""
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(F.sum(event_weight(F.col("event_type"))).alias("popularity"))


def user_features(df: DataFrame, *, windows: tuple[int, ...] = WINDOWS, fns: tuple[str, ...] = FUNCTIONS, features: list[str] | None = None) -> DataFrame:
    """Session, trailing and time features at each event, on one partitioning by user."""
    rows = all_trailing_aggregates(df, "user_id", "ts", windows=windows, fns=fns, features=features or ["value"])
    return time_features(session_features(rows), "ts")


def popular_items(pop: DataFrame, n: int = 100) -> DataFrame:
    """The `n` most popular items, ties by item id."""
    return pop.orderBy(F.desc("popularity"), "item_id").limit(n)


def session_categories(df: DataFrame) -> DataFrame:
    """Distinct (user_id, item_category) of each user's latest session."""
    last = sessionize(df).withColumn("last_no", F.max("session_no").over(Window.partitionBy("user_id"))).where("session_no = last_no")
    return last.where("item_category is not null").select("user_id", "item_category").distinct()


def category_items(catalog: DataFrame, n: int = 20) -> DataFrame:
    """The first `n` items (by id) of each category; a task keeps `n` of a category before the shuffle."""
    first = Window.partitionBy("item_category").orderBy("item_id")
    return catalog.withColumn("n", F.row_number().over(first)).where(F.col("n") <= n).select("item_id", "item_category")


def category_candidates(sess: DataFrame, catalog: DataFrame, n: int = 20) -> DataFrame:
    """Up to `n` catalog items (by id) for each category seen by a user: user_id, item_id."""
    return sess.join(category_items(catalog, n), "item_category").select("user_id", "item_id").distinct()


def item_facts(items: DataFrame, pop: DataFrame, catalog: DataFrame) -> DataFrame:
    """item_id, popularity and item_category of `items`, null where unknown."""
    return items.select("item_id").join(pop.select("item_id", "popularity"), "item_id", "left").join(catalog.select("item_id", "item_category"), "item_id", "left")


def all_candidates(users: DataFrame, popular: DataFrame, by_category: DataFrame) -> DataFrame:
    """Popular items for every user united with those of the user's categories.

    `popular` is bounded by its limit (100 rows), and so it is broadcast.
    """
    every = users.select("user_id").distinct().join(F.broadcast(popular.select("item_id")))
    return every.unionByName(by_category.select("user_id", "item_id")).distinct()


def known_candidates(users: DataFrame, pop: DataFrame, sess: DataFrame, catalog: DataFrame, n: int = 100) -> DataFrame:
    """all_candidates with popularity and item_category, as score_items takes them.

    The facts are joined to the `n` popular items and to the few items of each category
    before these meet the users: no popular item becomes a key that all users share.
    """
    popular = item_facts(popular_items(pop, n), pop, catalog)
    few = category_items(catalog)
    own = sess.join(few.join(pop.select("item_id", "popularity"), "item_id", "left"), "item_category")
    every = users.select("user_id").distinct().join(F.broadcast(popular))
    return every.unionByName(own.select("user_id", *popular.columns)).dropDuplicates(["user_id", "item_id"])


def score_items(cands: DataFrame, pop: DataFrame, sess: DataFrame, catalog: DataFrame) -> DataFrame:
    """Score = min(0.5 + 0.3 min(popularity / 1000, 1) + 0.2 if the category was viewed, 1).

    Candidates that bring popularity and item_category are not joined to these again.
    """
    rows = cands
    if not {"popularity", "item_category"} <= set(cands.columns):
        rows = cands.select("user_id", "item_id").join(pop.select("item_id", "popularity"), "item_id", "left").join(catalog.select("item_id", "item_category"), "item_id", "left")
    rows = rows.join(sess.select("user_id", "item_category", F.lit(True).alias("viewed")), ["user_id", "item_category"], "left")
    popular = 0.3 * F.least(F.coalesce("popularity", F.lit(0.0)) / 1000.0, F.lit(1.0))
    score = F.least(0.5 + popular + F.when(F.col("viewed"), 0.2).otherwise(0.0), F.lit(1.0))
    return rows.select("user_id", "item_id", score.alias("score"))


def firings(times: np.ndarray, seconds: int, last: np.datetime64 | None) -> tuple[list[int], np.datetime64 | None]:
    """(places that fire, last firing) of ordered times: each the first `seconds` or more
    after the one before, found by a search instead of a step per row."""
    gap, fires, k = np.timedelta64(seconds, "s"), [], 0
    while k < len(times):
        if last is not None:
            k = max(k, int(np.searchsorted(times, last + gap)))
            if k >= len(times):
                break
        fires.append(k)
        last = times[k]
        k += 1
    return fires, last


def debounce(df: DataFrame, key: str = "user_id", ts: str = "ts", seconds: int = 300, *, types: tuple[str, ...] = ("view", "click"), tie: str = "event_id") -> DataFrame:
    """Events that fire: the first view or click of a key, then the first that is `seconds`
    or more after the last firing.  Greedy, so that each key is folded in order; the fold
    streams over the sorted rows and keeps one time per key."""
    rows = df.where(F.col("event_type").isin(*types)).select(key, ts, tie)
    rows = rows.repartition(key).sortWithinPartitions(key, ts, tie)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, None
        for batch in batches:
            keys, times, kept = batch[key].to_numpy(), batch[ts].to_numpy(), []
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(batch)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    last = last if keys[a] == current else None
                    current = keys[a]
                    fires, last = firings(times[a:b], seconds, last)
                    kept += [a + k for k in fires]
            yield batch.iloc[kept]

    return rows.mapInPandas(fold, rows.schema)


def rank_per_user(scored: DataFrame, k: int = 10) -> DataFrame:
    """user_id and its `k` best items as an array of (rank, item_id, score)."""
    best = Window.partitionBy("user_id").orderBy(F.desc("score"), "item_id")
    top = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id", "score"))).alias("items"))


def processor_stats(df: DataFrame, *, approximate: bool = False) -> DataFrame:
    """Distinct users, scored users (with a view or click), items, categories, sessions."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    scored = F.when(F.col("event_type").isin("view", "click"), F.col("user_id"))
    return df.agg(
        count("user_id").alias("active_users"), count(scored).alias("scored_users"), count("item_id").alias("items"),
        count("item_category").alias("categories"), count("session_id").alias("sessions"),
    )


def flagship(df: DataFrame, catalog: DataFrame, k: int = 10) -> DataFrame:
    """Ten ranked items for each user: sessions, popularity, candidates, scores, packing."""
    pop, sess = popularity(df), session_categories(df)
    cands = known_candidates(df, pop, sess, catalog)
    return rank_per_user(score_items(cands, pop, sess, catalog), k)
