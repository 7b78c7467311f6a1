"""Registered queries and the DuckDB statement that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Views over the given tables, as DuckDB states them; each may use those above it.
VIEWS = {
    "interactions": """
select event_id, user_id as user_no, ts, event_type, value, k,
       concat('user_', user_id) as user_id, concat('item_', k) as item_id, concat('cat_', k % 10) as item_category,
       concat('user_', user_id, '_', day) as session_id
from (select *, cast(json_extract_string(props, '$.k') as int) as k, strftime(ts, '%Y%m%d') as day from events) e""",
    "catalog": """
select concat('item_', p_partkey) as item_id, concat('cat_', p_partkey % 10) as item_category,
       p_retailprice::double as price, p_brand as brand, p_size % 5 <> 0 as in_stock
from part""",
    "feature_log": """
select case when event_id % 11 = 0 then event_id + 100000000 else event_id end as write_seq, 'user' as entity_type,
       user_id as entity_id, concat('last_', event_type) as feature_name, cast(value as varchar) as value, value as num, ts as feature_ts, event_id as version
from interactions""",
    "feature_defs": """
select distinct feature_name as name, 'user' as entity_type, 'numerical' as data_type from feature_log where feature_name <> 'last_error'""",
    "spine": "select event_id as spine_id, user_id as entity_id, ts as as_of from interactions where event_type = 'purchase'",
    "online_state": """
select entity_id, feature_name, value, feature_ts from (
  select user_id as entity_id, concat('last_', event_type) as feature_name, event_id as value, ts as feature_ts,
         row_number() over (partition by user_id, event_type order by event_id desc) as rn
  from interactions where event_id % 3 <> 0 and user_no % 10 <> 0) t where rn = 1""",
    "offline_state": """
select entity_id, feature_name, value, feature_ts from (
  select user_id as entity_id, concat('last_', event_type) as feature_name, event_id as value, ts as feature_ts,
         row_number() over (partition by user_id, event_type order by event_id desc) as rn
  from interactions where event_id % 4 <> 0 and user_no % 10 <> 1) t where rn = 1""",
    "index_ops": """
select vec_id as seq, case when vec_id % 7 = 0 then 'remove' when vec_id % 11 = 0 then 'update' else 'add' end as op,
       case when vec_id % 7 = 0 or vec_id % 11 = 0 then vec_id else vec_id + 1000000 end as item_id, embedding
from embeddings where vec_id % 7 = 0 or vec_id % 11 = 0 or vec_id % 13 = 0""",
    "train_interactions": """
select o_custkey as user_id, l_partkey as item_id, o_orderdate as event_ts, l_quantity::double as rating
from lineitem join orders on l_orderkey = o_orderkey""",
    "item_features": """
select p_partkey as item_id, dense_rank() over (order by p_type)::int as category_id, p_retailprice::double as price, p_size as size from part""",
    "user_features": "select c_custkey as user_id, c_acctbal::double as acctbal, c_nationkey as nation from customer",
    "drift_samples": """
select 'value' as feature, case when ts < timestamp '2024-01-16 00:00:00' then 'ref' else 'cur' end as side, event_id, value as x from interactions
union all
select 'k', case when ts < timestamp '2024-01-16 00:00:00' then 'ref' else 'cur' end, event_id, cast(k as double) from interactions
union all
select 'value_shifted', case when ts < timestamp '2024-01-16 00:00:00' then 'ref' else 'cur' end, event_id,
       case when ts < timestamp '2024-01-16 00:00:00' then value else value * cast(1.3 as double) end from interactions""",
    "counter_points": """
select ts, event_type as metric, count(*) over (partition by event_type, ts < timestamp '2024-01-16 00:00:00'
       order by ts, event_id rows between unbounded preceding and current row) as counter from interactions""",
    "phases": """
select case when ts < timestamp '2024-01-11 00:00:00' then 'baseline' when ts < timestamp '2024-01-21 00:00:00' then 'incident' else 'recovery' end as phase,
       event_id, event_type, value from interactions""",
    "checks": """
select user_no % 5 as rollout, cast(ts as date) as check_day, count(*) as n,
       avg(cast(case when event_type = 'error' then 0 else 1 end as double)) as success_rate from interactions group by all""",
    "requests": """
select concat('req_', user_no) as request_id, user_id, max(user_no % 120) as num_recommendations,
       concat('cat_', user_no % 10) as filter_category, cast(900 as double) as price_min, cast(905 as double) as price_max
from interactions group by user_no, user_id""",
    "messages": """
select case when event_id % 2 = 0 then 'rec.user-events' else 'rec.interaction-events' end as topic, user_no % 4 as partition_id,
       event_id as offset_id, user_id as msg_key,
       case when event_id % 97 = 0 then '{"event_id":' else concat('{"event_id":"', event_id, '","user_id":"', user_id, '","session_id":"', session_id,
         '","event_type":"', event_type, '","item_id":"', item_id, '","item_category":"', item_category, '"}') end as msg_value
from interactions""",
}


def statement(sql: str) -> str:
    """`sql` (starting with "with" or "select") with the views that it uses put before it."""
    used: set[str] = set()

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                need(VIEWS[name])

    need(sql)
    body = sql.strip()
    own = body[len("with") :].strip() if body.lower().startswith("with") and not body.lower().startswith("with recursive") else None
    recursive = body[len("with recursive") :].strip() if body.lower().startswith("with recursive") else None
    head = ", ".join(f"{n} as ({VIEWS[n].strip()})" for n in VIEWS if n in used)
    if recursive is not None:
        return f"with recursive {head}{', ' if head else ''}{recursive}"
    if own is not None:
        return f"with {head}{', ' if head else ''}{own}"
    return f"with {head} {body}" if head else body


def query(name: str, sql: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame, with its DuckDB statement if it has one."""

    def wrap(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = statement(sql)
        return f

    return wrap
