"""Registered queries: cost attribution (a), query origin (o), right-sizing (h)."""

from functools import partial

from pyspark.sql import functions as F

from meterlens.operators import allocate as A
from meterlens.operators import timeline as T
from meterlens.plans import health as H
from meterlens.plans import kpis as K
from meterlens.plans import marts as L
from meterlens.plans import origin as O
from meterlens.plans import utilized as U
from meterlens.plans import warehouse as R
from meterlens.registered import query as Q
from meterlens.registered.inputs_sql import AFTER, FIRST
from meterlens.registered.query import scratch, stamp, whole
from meterlens.sources.values import DAY_AFTER, FIRST_DAY, LAST_DAY

Query, num = partial(Q.Query, digits=6), partial(Q.num, digits=6)
W = (FIRST_DAY, LAST_DAY)
E = (FIRST_DAY, DAY_AFTER)
NOW = "2024-01-30 23:00:00"


def share_mart(t):
    """A2 over the whole fixture."""
    return A.cost_per_query(t.usage, t.list_prices, t.query_history, *W)


def utilized_mart(t, **options):
    """A4 over the whole fixture."""
    return T.utilized_cost_per_query(t.usage, t.price_history, t.query_history, t.warehouse_events, DAY_AFTER, **options)


_WRITTEN: dict[tuple, str] = {}


def written(t) -> str:
    """Root of both per-query marts, written once per session and input: A2 in full, A4 in two runs that follow each other."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _WRITTEN:
        root = scratch(t)
        L.write_mart(share_mart(t).withColumn("usage_date", F.to_date("start_time")), root, "cost_per_query")
        bounds = T.read_bounds(t.usage, t.query_history, t.warehouse_events)
        middle = bounds.start + (bounds.end - bounds.start) // 2
        U.extend(t, root, middle.replace(minute=0, second=0, microsecond=0), DAY_AFTER, bounds.start)
        U.extend(t, root, bounds.end, DAY_AFTER)
        _WRITTEN[key] = root
    return _WRITTEN[key]


def _both(t):
    root = written(t)
    return L.open_mart(t.spark, root, "cost_per_query"), U.costs(U.store_of(t, root))


def _timeline(t):
    bounds = T.read_bounds(t.usage, t.query_history, t.warehouse_events)
    return t.warehouse_events, T.work_queries(t.query_history, bounds), bounds


def _steps(t):
    _, queries, bounds = _timeline(t)
    return T.concurrency_steps(queries, bounds)


_A2_SHOWN = f"""statement_id, nullif(query_source_id, '') AS query_source_id, query_source_type, client AS client_application, executed_by, warehouse_id, statement_text, workspace_id,
  {stamp('start_time', 'start_time')}, {stamp('end_time', 'end_time')}, {whole('duration_seconds', 'duration_seconds')},
  {num('dollars', 'query_attributed_dollars_estimation')}, {num('dbus', 'query_attributed_dbus_estimation')}, query_profile_url, url_helper"""
_MART_SUMS = f"{whole('count(*)', 'query_count')}, {num('sum(dollars)', 'total_spend')}, {num('sum(dbus)', 'total_dbus')}"
_TOP = f"""SELECT statement_id, query_source_type, query_source_id, executed_by, warehouse_id, workspace_id, substr(statement_text, 1, 200) AS statement_preview,
  {whole('duration_seconds', 'duration_seconds')}, {num('dollars', 'cost')}, {num('dbus', 'dbus')}, query_profile_url, url_helper AS source_url,
  {stamp('start_time', 'start_time')}, {stamp('end_time', 'end_time')} FROM a2r WHERE {{where}} ORDER BY dollars DESC NULLS LAST, statement_id LIMIT {{n}}"""
_BY_USER = "SELECT executed_by, query_source_type, count(*) AS n, sum(dollars) AS s, sum(dbus) AS d FROM a2r GROUP BY 1, 2"
_BY_WH = f"""SELECT warehouse_id, {whole('count(*)', 'query_count')}, {whole('count(DISTINCT executed_by)', 'unique_users')}, sum(dollars) AS s, sum(dbus) AS d
FROM a2r GROUP BY 1"""
_FACTS = """SELECT warehouse_id, warehouse_name, coalesce(warehouse_type, 'CLASSIC') AS warehouse_type, warehouse_size,
  CAST(l.workspace_id AS VARCHAR) AS workspace_id, workspace_name FROM wh_now l LEFT JOIN ws ON l.workspace_id = ws.workspace_id"""
_TYPE_SERIES = """SELECT c.usage_date AS date, coalesce(k.warehouse_type, 'CLASSIC') AS warehouse_type, sum(c.spend) AS s FROM sql_cost c
LEFT JOIN wh_now k ON c.warehouse_id = k.warehouse_id GROUP BY 1, 2"""


def _pivot(columns, value, source, names):
    return "SELECT date, " + ", ".join(num(f"sum(CASE WHEN {names} = '{c}' THEN {value} ELSE 0 END)", f'"{c}"') for c in columns) + f" FROM ({source}) s GROUP BY 1"


_SECONDS = whole("sum(datediff('second', a, b))", "seconds")
_SOURCES = ["AI/BI DASHBOARD", "GENIE SPACE", "SQL QUERY"]
_TYPES = ["PRO", "SERVERLESS", "CLASSIC"]
_A4R = f"(SELECT * FROM a4 WHERE start_time >= {FIRST} AND start_time < {AFTER})"
_GRADE = "CASE WHEN {u} >= 80 THEN 'A' WHEN {u} >= 60 THEN 'B' WHEN {u} >= 40 THEN 'C' WHEN {u} >= 20 THEN 'D' ELSE 'F' END"
_STATUS = "CASE WHEN {u} > 60 THEN 'good' WHEN {u} > 30 THEN 'warning' ELSE 'critical' END"
_COMPARE = f"""SELECT *, o_spend - u_spend AS idle_cost, CASE WHEN o_spend > 0 THEN u_spend / o_spend * 100 ELSE 0 END AS used FROM
 (SELECT count(*) AS o_n, coalesce(sum(dollars), 0) AS o_spend, coalesce(sum(dbus), 0) AS o_dbus, coalesce(avg(dollars), 0) AS o_avg FROM a2r) a,
 (SELECT count(*) AS u_n, coalesce(sum(dollars), 0) AS u_spend, coalesce(sum(dbus), 0) AS u_dbus, coalesce(avg(dollars), 0) AS u_avg FROM {_A4R} z) b"""
_EFFICIENCY = f"""SELECT coalesce(o.warehouse_id, p.warehouse_id) AS warehouse_id, coalesce(o.n, 0) AS total_queries, coalesce(p.n, 0) AS utilized_queries,
  coalesce(o.s, 0) AS cost, coalesce(p.s, 0) AS ucost, coalesce(o.d, 0) AS d, coalesce(p.d, 0) AS ud
FROM (SELECT warehouse_id, count(*) AS n, sum(dollars) AS s, sum(dbus) AS d FROM a2r GROUP BY 1) o
FULL OUTER JOIN (SELECT warehouse_id, count(*) AS n, sum(dollars) AS s, sum(dbus) AS d FROM {_A4R} z GROUP BY 1) p ON o.warehouse_id = p.warehouse_id"""


def _comparison(t):
    return R.method_comparison(*_both(t), *E)


def _efficiency(t):
    return R.warehouse_efficiency(*_both(t), *E, min_cost=10.0)


def _warehouses(t, limit=None):
    return R.by_warehouse_enriched(share_mart(t), t.warehouses, t.workspaces, *E, limit=limit)


_ORIGIN_SUMS = f"{whole('count(*)', 'query_count')}, {num('sum(cost)', 'total_spend')}, {num('sum(dbus)', 'total_dbus')}"
_NO_COST = f"{whole('count(*)', 'query_count')}, CAST(0 AS DOUBLE) AS total_spend, CAST(0 AS DOUBLE) AS total_dbus"
_TAGS = "CASE WHEN tag_tool IS NOT NULL THEN 'authoring_tool=' || tag_tool WHEN tag_origin IS NOT NULL THEN 'origin=' || tag_origin ELSE '' END AS query_tags"
_ORIGIN_TOP = f"""SELECT statement_id, executed_by, client AS client_application, {_TAGS}, warehouse_id, {stamp('start_time', 'start_time')},
  {whole('duration_seconds', 'duration_seconds')}, {{cost}}, origin AS query_origin, tag_tool AS authoring_tool
FROM orig WHERE origin = '{{origin}}' ORDER BY {{key}} DESC, statement_id LIMIT 20"""
_COSTED = f"{num('cost', 'cost')}, {num('dbus', 'dbus')}, query_profile_url"
_UNCOSTED = "CAST(0 AS DOUBLE) AS cost, CAST(0 AS DOUBLE) AS dbus, CAST(NULL AS VARCHAR) AS query_profile_url"


def _nested_flat(t):
    rows = O.by_warehouse_nested(O.by_warehouse(t.query_history, share_mart(t), *E))
    cells = F.explode("origins").alias("origin", "o")
    return rows.select("warehouse_id", "total_spend", "total_dbus", cells).select(
        "warehouse_id", "total_spend", "total_dbus", "origin", F.col("o.query_count").alias("origin_queries"),
        F.col("o.total_spend").alias("origin_spend"))


_NOW = f"TIMESTAMP '{NOW}'"
_IDLE = f"""SELECT e.warehouse_id, w.warehouse_name, w.warehouse_size, w.workspace_id, w.warehouse_type, {stamp('max(e.event_time)', 'last_event_time')}
FROM wev e JOIN wh_now w ON e.warehouse_id = w.warehouse_id
WHERE e.warehouse_id IN (SELECT warehouse_id FROM wev WHERE event_time >= {_NOW} - INTERVAL 72 HOUR AND cluster_count > 0)
  AND e.warehouse_id NOT IN (SELECT warehouse_id FROM qh WHERE start_time >= {_NOW} - INTERVAL 24 HOUR AND warehouse_id IS NOT NULL)
  AND coalesce(w.warehouse_type, 'CLASSIC') <> 'SERVERLESS' GROUP BY 1, 2, 3, 4, 5"""
_SCALED = f"""SELECT s.warehouse_id, w.warehouse_name, w.warehouse_size, w.workspace_id, {whole('s.m', 'max_clusters_observed')}, {whole('coalesce(c.peak, 0)', 'max_concurrent')}
FROM (SELECT warehouse_id, max(cluster_count) AS m FROM wev WHERE event_time >= {_NOW} - INTERVAL 30 DAY GROUP BY 1 HAVING max(cluster_count) >= 2) s
JOIN wh_now w ON s.warehouse_id = w.warehouse_id
LEFT JOIN (SELECT warehouse_id, max(n) AS peak FROM (SELECT warehouse_id, date_trunc('minute', start_time) AS m, count(*) AS n FROM qh
  WHERE start_time >= {_NOW} - INTERVAL 30 DAY AND warehouse_id IS NOT NULL GROUP BY 1, 2) x GROUP BY 1) c ON s.warehouse_id = c.warehouse_id
WHERE coalesce(c.peak, 0) < s.m * 10"""
_LARGE = f"""SELECT w.warehouse_id, w.warehouse_name, w.warehouse_size, w.workspace_id, {whole('q.n', 'query_count')}, {num('q.queue', 'avg_queue_ms')}, {whole('q.med', 'median_duration_seconds')}
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY warehouse_id ORDER BY change_time DESC) AS rn FROM wh_log WHERE warehouse_size IN ('Large', 'X-Large', '2X-Large')) x WHERE rn = 1) w
JOIN (SELECT warehouse_id, count(*) AS n, avg(coalesce(capacity_ms, 0) + coalesce(compute_ms, 0)) AS queue,
    quantile_disc(epoch_us(end_time) // 1000000 - epoch_us(start_time) // 1000000, 0.5) AS med FROM qh
  WHERE start_time >= {_NOW} - INTERVAL 30 DAY AND warehouse_id IS NOT NULL AND task_ms > 0 GROUP BY 1 HAVING count(*) >= 10) q ON w.warehouse_id = q.warehouse_id
WHERE q.queue < 5000 AND q.med < 60"""
_FINDINGS = f"""SELECT warehouse_id, warehouse_name, warehouse_size, CAST(workspace_id AS VARCHAR) AS workspace_id, last_event_time, 'IDLE_RUNNING' AS recommendation_type,
  'Warehouse has been running for 72+ hours with no queries in the last 24h. Consider reducing auto_stop_minutes.' AS recommendation_text,
  CAST(NULL AS BIGINT) AS max_clusters_observed, CAST(NULL AS BIGINT) AS max_concurrent, CAST(NULL AS BIGINT) AS query_count, CAST(NULL AS DOUBLE) AS avg_queue_ms, CAST(NULL AS BIGINT) AS median_duration_seconds
FROM ({_IDLE}) a
UNION ALL SELECT warehouse_id, warehouse_name, warehouse_size, CAST(workspace_id AS VARCHAR), NULL, 'OVER_SCALED',
  'Warehouse scaled to ' || max_clusters_observed || ' clusters but peak concurrency was only ' || max_concurrent || ' queries. Consider reducing max_num_clusters.', max_clusters_observed, max_concurrent, NULL, NULL, NULL
FROM ({_SCALED}) b
UNION ALL SELECT warehouse_id, warehouse_name, warehouse_size, CAST(workspace_id AS VARCHAR), NULL, 'OVERSIZED',
  warehouse_size || ' warehouse with avg queue time ' || printf('%.1f', avg_queue_ms / 1000) || 's and median query duration ' || printf('%.1f', median_duration_seconds::DOUBLE) || 's. Consider downsizing one tier.',
  NULL, NULL, query_count, avg_queue_ms, median_duration_seconds FROM ({_LARGE}) c"""


_FOUND = f"""SELECT * REPLACE (CAST(max_clusters_observed AS DOUBLE) AS max_clusters_observed, CAST(max_concurrent AS DOUBLE) AS max_concurrent,
  CAST(query_count AS DOUBLE) AS query_count, CAST(median_duration_seconds AS DOUBLE) AS median_duration_seconds) FROM ({_FINDINGS}) f"""


def _found(t, **options):
    """Findings with their metrics as doubles: each metric is null for the other kinds of finding."""
    found = H.recommendations(t.warehouses, t.warehouse_events, t.query_history, NOW, 72, max_median_seconds=60, **options)
    metrics = ("max_clusters_observed", "max_concurrent", "query_count", "median_duration_seconds")
    return found.withColumns({m: F.col(m).cast("double") for m in metrics})


_A4_SQL = f"""SELECT statement_id, query_source_id, query_source_type, client_application, executed_by, warehouse_id, statement_text, {whole('workspace_id', 'workspace_id')},
  {stamp('start_time', 'start_time')}, {stamp('end_time', 'end_time')}, {stamp('ws', 'query_work_start_time')}, {stamp('we', 'query_work_end_time')},
  {num('(epoch_us(end_time) - epoch_us(start_time)) // 1000 / 1000.0', 'duration_seconds')}, {num('(epoch_us(we) - epoch_us(ws)) // 1000 / 1000.0', 'query_work_duration_seconds')},
  {num('work_s', 'query_work_task_time_seconds')}, {num('dollars', 'query_attributed_dollars_estimation')}, {num('dbus', 'query_attributed_dbus_estimation')},
  coalesce(url, '') AS url_helper, '/sql/history?queryId=' || statement_id || '&queryStartTimeMs=' || (epoch_us(start_time) // 1000000 * 1000) AS query_profile_url,
  (SELECT {stamp('max(hour)', 'h')} FROM bills) AS most_recent_billing_hour,
  CASE WHEN billed THEN 'Has Billing Record' ELSE 'No Billing Record for this hour and warehouse yet available' END AS billing_record_check,
  {stamp("date_trunc('hour', start_time)", 'query_start_hour')}, {whole('hours', 'hour_count')} FROM a4"""

#: The mart keeps the hours of its range; here those with a cost are counted.
_A4_MART_SQL = f"""SELECT * REPLACE ((SELECT count(*) FROM a4h z WHERE z.statement_id = x.statement_id AND z.cost IS NOT NULL) AS hour_count) FROM ({_A4_SQL}) x"""

QUERIES = [
    Query("a01_tool_attribution", lambda t: A.tool_attribution(t.usage, t.list_prices, t.query_history, *W).drop("attributed_effective_list_spend"),
          f"SELECT sql_product, usage_date, warehouse_id, {num('dbus', 'attributed_dbus')}, {num('spend', 'attributed_spend')} FROM a1"),
    Query("a02_cost_per_query", lambda t: share_mart(t).withColumn("query_source_id", F.nullif("query_source_id", F.lit(""))), f"SELECT {_A2_SHOWN} FROM a2"),
    Query("a03_source_links", lambda t: share_mart(t).groupBy("query_source_type", "url_helper").agg(F.count("*").alias("n")),
          f"SELECT query_source_type, url_helper, {whole('count(*)', 'n')} FROM a2 GROUP BY 1, 2"),
    Query("a04_utilized_cost_per_query", lambda t: utilized_mart(t).withColumn("hour_count", F.size("statement_hour_bucket_costs")).drop("statement_hour_bucket_costs"), _A4_SQL),
    Query("a04_cost_by_hour", lambda t: utilized_mart(t).select("statement_id", F.explode("statement_hour_bucket_costs").alias("h")).select(
        "statement_id", "h.hour_bucket", "h.hour_attributed_cost", "h.hour_attributed_dbus"),
        f"SELECT statement_id, {stamp('hour', 'hour_bucket')}, {num('cost', 'hour_attributed_cost')}, {num('dbus', 'hour_attributed_dbus')} FROM a4h"),
    Query("a04_mart_cost_per_query", lambda t: U.cost_per_query(U.store_of(t, written(t))).withColumn("hour_count", F.coalesce(F.size(F.filter(
        "statement_hour_bucket_costs", lambda h: h["hour_attributed_cost"].isNotNull())), F.lit(0))).drop("statement_hour_bucket_costs"),
        _A4_MART_SQL),
    Query("a04_mart_by_hour", lambda t: U.hourly_costs(U.store_of(t, written(t))).select("usage_date", "statement_id", "hour_bucket", "hour_cost", "hour_dbus", "billed"), f"""
SELECT CAST(hour AS DATE) AS usage_date, statement_id, {stamp('hour', 'hour_bucket')}, {num('cost', 'hour_cost')}, {num('dbus', 'hour_dbus')}, billed FROM a4h
WHERE hour >= (SELECT t0 FROM bounds) AND hour < (SELECT t1 FROM bounds)"""),
    Query("a04a_time_bounds", lambda t: T.time_bounds(t.usage, t.query_history, t.warehouse_events),
          f"SELECT {stamp('t0', 'selected_start_time')}, {stamp('t1', 'selected_end_time')} FROM bounds"),
    Query("a04b_work_queries", lambda t: _timeline(t)[1].select("statement_id", "warehouse_id", "query_work_start_time", "query_work_end_time", "query_work_task_time", "query_source_type", "query_source_id"),
          f"SELECT statement_id, warehouse_id, {stamp('ws', 'query_work_start_time')}, {stamp('we', 'query_work_end_time')}, {num('work_s', 'query_work_task_time')}, query_source_type, query_source_id FROM wq"),
    Query("a04c_on_off_windows", lambda t: T.on_off_windows(*_timeline(t)),
          f"SELECT warehouse_id, state AS window_state, {stamp('start_at', 'event_window_start')}, {stamp('end_at', 'event_window_end')} FROM on_off"),
    Query("a04d_concurrency_steps", _steps,
          f"SELECT warehouse_id, {stamp('start_at', 'query_start')}, {stamp('end_at', 'query_end')}, active AS queries_active FROM steps"),
    Query("a04e_steps_by_day", lambda t: T.steps_by_day(_steps(t)), f"""
SELECT warehouse_id, CAST(d AS DATE) AS query_start_dt, {stamp('greatest(start_at, d)', 'query_start')}, {stamp('least(end_at, d + INTERVAL 1 DAY)', 'query_end')}, active AS queries_active
FROM (SELECT *, unnest(generate_series(date_trunc('day', start_at), date_trunc('day', end_at), INTERVAL 1 DAY)) AS d FROM steps WHERE end_at >= start_at) s
WHERE greatest(start_at, d) < least(end_at, d + INTERVAL 1 DAY)"""),
    Query("a04f_periods", lambda t: T.periods(*_timeline(t)).groupBy("warehouse_id", "ts_hour", "utilization_flag").agg(
        F.sum(F.unix_timestamp("ts_end") - F.unix_timestamp("ts_start")).alias("seconds"), F.max("queries_active").alias("peak_active")),
        f"SELECT warehouse_id, {stamp('hour', 'ts_hour')}, flag AS utilization_flag, {_SECONDS}, {whole('max(active)', 'peak_active')} FROM spans WHERE hour < (SELECT t1 FROM bounds) GROUP BY ALL"),
    Query("a04g_utilization", lambda t: T.utilization(*_timeline(t)),
          f"SELECT warehouse_id, {stamp('hour', 'warehouse_hour')}, used AS utilized_seconds, idle AS idle_seconds, off AS off_seconds, used + idle + off AS total_seconds, {num('proportion', 'utilization_proportion')} FROM util2 WHERE hour < (SELECT t1 FROM bounds)"),
    Query("a05_data_range", lambda t: R.data_range(share_mart(t)),
          f"SELECT CAST(min(start_time) AS DATE) AS earliest_date, CAST(max(start_time) AS DATE) AS latest_date, {whole('count(*)', 'total_rows')} FROM a2"),
    Query("a06_by_source", lambda t: R.by_source(share_mart(t), *E),
          f"SELECT query_source_type, {_MART_SUMS}, {num('avg(dollars)', 'avg_cost_per_query')} FROM a2r GROUP BY 1"),
    Query("a07_by_user", lambda t: R.by_user(share_mart(t), *E),
          f"SELECT executed_by, query_source_type, {whole('n', 'query_count')}, {num('s', 'total_spend')}, {num('d', 'total_dbus')} FROM ({_BY_USER} ORDER BY s DESC NULLS LAST, 1, 2 LIMIT 100) u"),
    Query("a07b_top_users", lambda t: R.top_users(R.by_user(share_mart(t), *E, limit=None)),
          f"SELECT executed_by AS \"user\", {num('sum(s)', 'total_spend')}, {whole('sum(n)', 'query_count')} FROM ({_BY_USER}) u GROUP BY 1 ORDER BY sum(s) DESC, 1 LIMIT 10"),
    Query("a08_top_queries", lambda t: R.top_queries(share_mart(t), *E, limit=50), _TOP.format(where="TRUE", n=50)),
    Query("a09_top_queries_by_source", lambda t: R.top_queries_by_source(share_mart(t), *E, "AI/BI DASHBOARD", 20),
          _TOP.format(where="query_source_type = 'AI/BI DASHBOARD'", n=20)),
    Query("a10_summary", lambda t: R.summary(share_mart(t), *E), f"""
SELECT {whole('count(*)', 'total_queries')}, {whole('count(DISTINCT executed_by)', 'unique_users')}, {whole('count(DISTINCT warehouse_id)', 'unique_warehouses')},
  {num('sum(dollars)', 'total_spend')}, {num('sum(dbus)', 'total_dbus')}, {num('avg(dollars)', 'avg_cost_per_query')}, {num('avg(duration_seconds)', 'avg_duration_seconds')} FROM a2r"""),
    Query("a11_by_warehouse", lambda t: R.by_warehouse(share_mart(t), *E),
          f"SELECT warehouse_id, query_count, unique_users, {num('s', 'total_spend')}, {num('d', 'total_dbus')} FROM ({_BY_WH} ORDER BY s DESC, 1 LIMIT 50) w"),
    Query("a12_by_warehouse_enriched", _warehouses, f"""
SELECT w.warehouse_id, query_count, unique_users, {num('s', 'total_spend')}, {num('d', 'total_dbus')}, warehouse_name, warehouse_type, warehouse_size, workspace_id, workspace_name,
  {num('coalesce(100 * s / sum(s) OVER (), 0)', 'percentage')} FROM ({_BY_WH}) w LEFT JOIN ({_FACTS}) f ON w.warehouse_id = f.warehouse_id"""),
    Query("a13_timeseries", lambda t: R.timeseries(share_mart(t), *E),
          f"SELECT CAST(start_time AS DATE) AS date, query_source_type, {whole('count(*)', 'query_count')}, {num('sum(dollars)', 'daily_spend')}, {num('sum(dbus)', 'daily_dbus')} FROM a2r GROUP BY 1, 2"),
    Query("a13_timeseries_wide", lambda t: R.series_wide(R.timeseries(share_mart(t), *E), "query_source_type", _SOURCES),
          _pivot(_SOURCES, "coalesce(dollars, 0)", "SELECT CAST(start_time AS DATE) AS date, * FROM a2r", "query_source_type")),
    Query("a14_warehouse_type_series", lambda t: R.warehouse_type_timeseries(t.usage, t.list_prices, t.warehouses, *W),
          f"SELECT date, warehouse_type, {num('s', 'daily_spend')} FROM ({_TYPE_SERIES}) s"),
    Query("a14_warehouse_type_wide", lambda t: R.series_wide(R.warehouse_type_timeseries(t.usage, t.list_prices, t.warehouses, *W), "warehouse_type", _TYPES),
          _pivot(_TYPES, "s", _TYPE_SERIES, "warehouse_type")),
    Query("a15_method_comparison", _comparison, f"""
SELECT {whole('o_n', 'original_total_queries')}, {num('o_spend', 'original_total_spend')}, {num('o_dbus', 'original_total_dbus')}, {num('o_avg', 'original_avg_cost_per_query')},
  {whole('u_n', 'utilized_total_queries')}, {num('u_spend', 'utilized_total_spend')}, {num('u_dbus', 'utilized_total_dbus')}, {num('u_avg', 'utilized_avg_cost_per_query')},
  {num('idle_cost', 'total_idle_cost')}, {num('used', 'utilization_percentage')}, {num('100 - used', 'idle_percentage')},
  CASE WHEN 100 - used > 70 THEN 'critical' WHEN 100 - used > 40 THEN 'warning' ELSE 'good' END AS idle_status, {_STATUS.format(u='used')} AS status, {_GRADE.format(u='used')} AS grade
FROM ({_COMPARE}) c"""),
    Query("a16_warehouse_efficiency", _efficiency, f"""
SELECT warehouse_id, {whole('total_queries', 'total_queries')}, {whole('utilized_queries', 'utilized_queries')}, {num('cost', 'total_cost')}, {num('ucost', 'utilized_cost')}, {num('cost - ucost', 'idle_cost')},
  {num('d', 'total_dbus')}, {num('ud', 'utilized_dbus')}, {num('used', 'utilization_percentage')}, {num('100 - used', 'idle_percentage')}, {_GRADE.format(u='used')} AS efficiency_grade, {_STATUS.format(u='used')} AS status,
  CASE WHEN 100 - used > 80 THEN 'CRITICAL: Enable auto-stop or migrate to serverless' WHEN 100 - used > 60 THEN 'Reduce auto-stop timeout to 5 minutes'
    WHEN 100 - used > 40 THEN 'Review usage patterns and consider consolidation' ELSE 'Good utilization - monitor for optimization opportunities' END AS recommendation
FROM (SELECT *, CASE WHEN cost > 0 THEN ucost / cost * 100 ELSE 0 END AS used FROM ({_EFFICIENCY}) e WHERE cost >= 10) x"""),
    Query("a17_efficiency_grades", lambda t: _efficiency(t).groupBy("efficiency_grade").agg(F.count("*").alias("warehouses")),
          f"SELECT {_GRADE.format(u='used')} AS efficiency_grade, {whole('count(*)', 'warehouses')} FROM (SELECT CASE WHEN cost > 0 THEN ucost / cost * 100 ELSE 0 END AS used FROM ({_EFFICIENCY}) e WHERE cost >= 10) x GROUP BY 1"),
    # savings are shares of a cost with four decimals, so they are shown with two
    Query("a18_recommendations", lambda t: R.recommendations(_comparison(t)).withColumn("potential_savings", F.round("potential_savings", 2)), f"""
SELECT r.priority, r.title, {Q.num('c.idle_cost * r.f + c.idle_cost * c.used / 100 * r.g', 'potential_savings', 2)}, r.effort
FROM (SELECT *, 100 - used AS idle FROM ({_COMPARE}) k) c JOIN (VALUES
  ('critical', 'Reduce Auto-Stop Timeout', 0.6, 0, 'low', 70, 1000), ('critical', 'Enable Serverless SQL Warehouses', 0.95, 0, 'medium', 70, 1000),
  ('high', 'Consolidate Underutilized Warehouses', 0.4, 0, 'high', 70, 1000), ('high', 'Optimize Auto-Stop Settings', 0.3, 0, 'low', 40, 70),
  ('medium', 'Right-Size Warehouse Clusters', 0.25, 0, 'medium', 40, 70), ('low', 'Maintain Good Efficiency', 0.1, 0, 'low', -1000, 40),
  ('medium', 'Implement Warehouse Usage Policies', 0.2, 0, 'low', 50, 1000),
  ('medium', 'Optimize Slow Queries', 0.15, 0.2, 'medium', 60, 1000), ('low', 'Optimize Slow Queries', 0.15, 0.2, 'medium', -1000, 60)) AS r(priority, title, f, g, effort, low, high)
  ON c.idle > r.low AND c.idle <= r.high"""),
    Query("a19_count_by_size", lambda t: R.count_by_size(_warehouses(t)),
          f"SELECT warehouse_size, {whole('count(*)', 'count')} FROM ({_BY_WH}) w JOIN ({_FACTS}) f ON w.warehouse_id = f.warehouse_id GROUP BY 1"),
    Query("p03_distinct_query_users", lambda t: K.distinct_query_users(share_mart(t), *W),
          f"SELECT {whole('count(DISTINCT executed_by)', 'unique_query_users')} FROM a2r"),
    Query("o01_origin_summary", lambda t: O.origin_summary(t.query_history, share_mart(t), *E),
          f"SELECT origin AS query_origin, {_ORIGIN_SUMS}, round(100 * sum(cost) / (SELECT sum(cost) FROM orig), 2) AS percentage FROM orig GROUP BY 1"),
    Query("o02_origin_summary_no_cost", lambda t: O.origin_summary(t.query_history, None, *E),
          f"SELECT origin AS query_origin, {_NO_COST}, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM orig), 2) AS percentage FROM orig GROUP BY 1"),
    Query("o04_origin_series", lambda t: O.origin_series(t.query_history, share_mart(t), *E),
          f"SELECT CAST(start_time AS DATE) AS usage_date, origin AS query_origin, {whole('count(*)', 'query_count')}, {num('sum(cost)', 'daily_spend')} FROM orig GROUP BY 1, 2"),
    Query("o04_origin_series_wide", lambda t: O.origin_series_wide(O.origin_series(t.query_history, share_mart(t), *E)),
          _pivot(O.ORIGINS, "cost", "SELECT CAST(start_time AS DATE) AS date, * FROM orig", "origin")),
    Query("o05_by_warehouse", lambda t: O.by_warehouse(t.query_history, share_mart(t), *E), f"SELECT warehouse_id, origin AS query_origin, {_ORIGIN_SUMS} FROM orig GROUP BY 1, 2"),
    Query("o05_by_warehouse_no_cost", lambda t: O.by_warehouse(t.query_history, None, *E), f"SELECT warehouse_id, origin AS query_origin, {_NO_COST} FROM orig GROUP BY 1, 2"),
    Query("o05_by_warehouse_nested", _nested_flat, f"""
SELECT o.warehouse_id, t.total_spend, t.total_dbus, o.origin, {whole('count(*)', 'origin_queries')}, {num('sum(o.cost)', 'origin_spend')}
FROM orig o JOIN (SELECT warehouse_id, {num('sum(cost)', 'total_spend')}, {num('sum(dbus)', 'total_dbus')} FROM orig GROUP BY 1) t ON o.warehouse_id = t.warehouse_id GROUP BY ALL"""),
    Query("o06_top_queries", lambda t: O.top_queries(t.query_history, share_mart(t), *E, "MCP_TOOL"), _ORIGIN_TOP.format(cost=_COSTED, origin="MCP_TOOL", key="cost")),
    Query("o06_top_queries_no_cost", lambda t: O.top_queries(t.query_history, None, *E, "HUMAN"), _ORIGIN_TOP.format(cost=_UNCOSTED, origin="HUMAN", key="duration_seconds")),
    Query("h01_idle_running", lambda t: H.idle_running(t.warehouses, t.warehouse_events, t.query_history, NOW, 72), _IDLE),
    Query("h02_over_scaled", lambda t: H.over_scaled(t.warehouses, t.warehouse_events, t.query_history, NOW), _SCALED),
    Query("h03_oversized", lambda t: H.oversized(t.warehouses, t.query_history, NOW, max_median_seconds=60), _LARGE),
    Query("h04_recommendations", _found, _FOUND),
    Query("h04_warehouses_analyzed", lambda t: H.warehouses_analyzed(_found(t)), f"SELECT {whole('count(DISTINCT warehouse_id)', 'warehouses_analyzed')} FROM ({_FOUND}) f"),
    Query("h05_recommendations_of_one", lambda t: _found(t, warehouse_id="wh-1"), f"SELECT * FROM ({_FOUND}) f WHERE warehouse_id = 'wh-1'"),
]
