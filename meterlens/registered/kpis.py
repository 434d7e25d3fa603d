"""Registered queries: KPIs and series (p), anomalies and alerts (n)."""

from meterlens.operators import trend as T
from meterlens.plans import alerts as N
from meterlens.plans import kpis as K
from meterlens.plans import marts
from meterlens.registered import labels_sql as L
from meterlens.registered.inputs_sql import AFTER, FIRST, LAST
from meterlens.registered.query import Query, num, whole
from meterlens.sources.values import FIRST_DAY, LAST_DAY

W = (FIRST_DAY, LAST_DAY)
CONTRACT = ("2023-08-04", "2024-08-03", 1_500_000.0)
AS_OF = "2024-01-15"

_QUERIES = f"""
SELECT {whole('count(*)', 'total_queries')}, {whole('count(DISTINCT coalesce(executed_by, as_user))', 'unique_query_users')},
  {whole('sum(coalesce(read_rows, 0))', 'total_rows_read')}, {whole('sum(coalesce(read_bytes, 0))', 'total_bytes_read')},
  {num('sum(coalesce(task_ms, 0)) / 1000.0', 'total_compute_seconds')} FROM qh WHERE start_time >= {FIRST} AND start_time < {AFTER}"""
_ZEROS = ", ".join(f"CAST(0 AS BIGINT) AS {c}" for c in K.KPI_COLUMNS[:5])
_SERVED = f"CASE WHEN {L.INFERENCE} THEN {{}} END"
_USAGE = f"""
SELECT {whole('count(DISTINCT job_id)', 'total_jobs')}, {whole('count(job_id)', 'total_job_runs')},
  (SELECT {whole("count(CASE WHEN result_state = 'SUCCEEDED' THEN 1 END)", 'n')} FROM runs) AS successful_runs,
  {whole('count(DISTINCT CASE WHEN job_id IS NOT NULL THEN run_as END)', 'unique_job_owners')}, {whole('count(DISTINCT workspace_id)', 'active_workspaces')},
  {whole('count(DISTINCT cluster_id)', 'active_notebooks')}, {whole('count(DISTINCT ' + _SERVED.format('endpoint_name') + ')', 'models_served')},
  {num('sum(' + _SERVED.format('qty') + ')', 'total_serving_dbus')}"""
_FAST = f"""{_USAGE}, {whole('count(DISTINCT warehouse_id)', 'sql_warehouses')}, {num("sum(CASE WHEN product = 'SQL' THEN qty END)", 'sql_dbus')}"""

_TRUNC = {"daily": "{}", "weekly": "CAST(date_trunc('week', {}) AS DATE)", "monthly": "CAST(date_trunc('month', {}) AS DATE)"}


def _series(value: str, where: str = "TRUE", granularity: str = "daily", source: str = "pu", day: str = "usage_date") -> str:
    return f"SELECT {_TRUNC[granularity].format(day)} AS date, {value} FROM {source} WHERE {where} GROUP BY 1"


def _n(expression: str) -> str:
    return whole(expression, "value")


def _s(expression: str) -> str:
    return num(expression, "value")


_ENDPOINTS = "count(DISTINCT endpoint_name)"
USAGE_SQL = {
    "total_spend": (_s("sum(spend)"), "TRUE"), "total_dbus": (_s("sum(qty)"), "TRUE"),
    "workspace_count": (_n("count(DISTINCT workspace_id)"), "TRUE"),
    "aiml_spend": (_s("sum(spend)"), L.IS_SERVING), "aiml_dbus": (_s("sum(qty)"), L.IS_SERVING),
    "aiml_endpoints": (_n(_ENDPOINTS), f"{L.IS_SERVING} AND endpoint_name IS NOT NULL"),
    "tagged_spend": (_s("sum(CASE WHEN tagged THEN spend ELSE 0 END)"), "TRUE"),
    "untagged_spend": (_s("sum(CASE WHEN NOT tagged THEN spend ELSE 0 END)"), "TRUE"),
    "infra_cost": (_s("sum(spend)"), L.IS_INFRA_OR_SQL), "infra_clusters": (_n("count(DISTINCT cluster_id)"), "cluster_id IS NOT NULL"),
    "infra_dbu_hours": (_s("sum(qty)"), L.IS_INFRA),
    "apps_spend": (_s("sum(spend)"), "product = 'APPS'"), "apps_dbus": (_s("sum(qty)"), "product = 'APPS'"),
    "apps_count": (_n("count(DISTINCT coalesce(app_id, 'unknown'))"), "product = 'APPS'"),
    "total_jobs": (_n("count(DISTINCT job_id)"), "job_id IS NOT NULL"), "total_job_runs": (_n("count(*)"), "job_id IS NOT NULL"),
    "active_notebooks": (_n("count(DISTINCT cluster_id)"), "cluster_id IS NOT NULL"),
    "active_workspaces": (_n("count(DISTINCT workspace_id)"), "TRUE"), "models_served": (_n(_ENDPOINTS), L.INFERENCE),
}
QUERY_SQL = {
    "total_queries": (_n("count(*)"), "TRUE"), "total_rows_read": (_n("sum(coalesce(read_rows, 0))"), "TRUE"),
    "total_bytes_read": (_n("sum(coalesce(read_bytes, 0))"), "TRUE"),
    "total_compute_seconds": (_s("sum(coalesce(task_ms, 0)) / 1000.0"), "TRUE"),
    "total_users": (_n("count(DISTINCT coalesce(executed_by, as_user))"), "(executed_by IS NOT NULL OR as_user IS NOT NULL)"),
    "avg_query_duration": (_s("avg(coalesce(task_ms, 0)) / 1000.0"), "TRUE"),
    "unique_warehouses": (_n("count(DISTINCT warehouse_id)"), "warehouse_id IS NOT NULL"),
}
# KPI -> registered id, following the order of the KPI families
USAGE_IDS = {
    "total_spend": "p04", "total_dbus": "p05", "workspace_count": "p06", "aiml_spend": "p07", "aiml_dbus": "p07",
    "aiml_endpoints": "p08", "tagged_spend": "p09", "untagged_spend": "p09", "infra_cost": "p10", "infra_clusters": "p11",
    "infra_dbu_hours": "p11", "apps_spend": "p13", "apps_dbus": "p13", "apps_count": "p13", "total_jobs": "p17",
    "total_job_runs": "p17", "active_notebooks": "p17", "active_workspaces": "p17", "models_served": "p17",
}
QUERY_IDS = {"total_queries": "p16", "total_rows_read": "p16", "total_bytes_read": "p16", "total_compute_seconds": "p16",
             "total_users": "p19", "avg_query_duration": "p19", "unique_warehouses": "p19"}
DISTINCT_KPIS = ("active_workspaces", "total_jobs", "models_served")
_DAY = "CAST(start_time AS DATE)"
_IN_RANGE = f"start_time >= {FIRST} AND start_time < {AFTER} AND "


def _usage(kpi, granularity="daily"):
    return lambda t: K.usage_kpi(t.usage, t.list_prices, *W, kpi, granularity)


def _query(kpi, granularity="daily"):
    return lambda t: K.query_kpi(t.query_history, *W, kpi, granularity)


def _summary_sql(series: str, positive: bool = False) -> str:
    keep = "WHERE value > 0" if positive else ""
    return f"""
SELECT round(a, 2) AS period_start_value, round(z, 2) AS period_end_value, round(z - a, 2) AS change_amount,
  round(CASE WHEN a > 0 THEN (z - a) / a * 100 ELSE 0 END, 2) AS change_percent, round(lo, 2) AS min_value, round(hi, 2) AS max_value, round(mean, 2) AS avg_value,
  CASE WHEN a > 0 AND abs((z - a) / a * 100) >= 5 THEN CASE WHEN z > a THEN 'increasing' ELSE 'decreasing' END ELSE 'flat' END AS trend
FROM (SELECT min_by(value, date) AS a, max_by(value, date) AS z, min(value) AS lo, max(value) AS hi, avg(value) AS mean FROM ({series}) s {keep}) x"""


_PER_CLUSTER = _series(num("CAST(sum(spend) AS DOUBLE) / count(DISTINCT cluster_id)", "value", 7), f"{L.IS_INFRA} AND cluster_id IS NOT NULL")
_RAW_PER_CLUSTER = _series("CAST(sum(spend) AS DOUBLE) / count(DISTINCT cluster_id) AS value", f"{L.IS_INFRA} AND cluster_id IS NOT NULL")
_RAW_SPEND = _series("CAST(sum(spend) AS DOUBLE) AS value")
_RAW_RUN = _series("avg(coalesce(task_ms, 0)) / 1000.0 AS value", _IN_RANGE + "TRUE", source="qh", day=_DAY)


def _average(raw: str, granularity: str) -> str:
    return f"SELECT {_TRUNC[granularity].format('date')} AS date, {num('avg(value)', 'value')} FROM ({raw}) s GROUP BY 1"


def _daily(t):
    return marts.daily_usage_summary(t.usage, t.list_prices, *W)


_SPINE = f"""
SELECT d.date, CASE WHEN d.date <= DATE '{AS_OF}' THEN sum(coalesce(s.spend, 0)) OVER (ORDER BY d.date) END AS actual,
  datediff('day', DATE '{CONTRACT[0]}', d.date) / datediff('day', DATE '{CONTRACT[0]}', DATE '{CONTRACT[1]}')::DOUBLE * {CONTRACT[2]} AS ideal
FROM (SELECT CAST(unnest(generate_series(DATE '{CONTRACT[0]}', DATE '{CONTRACT[1]}', INTERVAL 1 DAY)) AS DATE) AS date) d
LEFT JOIN (SELECT usage_date, CAST(sum(spend) AS DOUBLE) AS spend FROM pu WHERE usage_date <= DATE '{AS_OF}' GROUP BY 1) s ON d.date = s.usage_date"""
_SPENT = f"(SELECT CAST(sum(spend) AS DOUBLE) FROM pu WHERE usage_date <= DATE '{AS_OF}')"
_BURN = f"""
SELECT {CONTRACT[2]}::DOUBLE AS total_commit_usd, round(spent, 2) AS spent_to_date, round({CONTRACT[2]} - spent, 2) AS remaining, CAST(elapsed AS BIGINT) AS days_elapsed,
  {whole(f"datediff('day', DATE '{AS_OF}', DATE '{CONTRACT[1]}')", 'days_remaining')},
  CAST(DATE '{AS_OF}' + CAST(trunc(({CONTRACT[2]} - spent) / (spent / elapsed)) AS INTEGER) AS DATE) AS projected_end_date,
  CASE WHEN spent / (elapsed / 365.0 * {CONTRACT[2]}) < 0.95 THEN 'under' WHEN spent / (elapsed / 365.0 * {CONTRACT[2]}) <= 1.10 THEN 'on_pace' ELSE 'over' END AS pace_status
FROM (SELECT {_SPENT} AS spent, datediff('day', DATE '{CONTRACT[0]}', DATE '{AS_OF}') AS elapsed) x"""
_CHANGES = """SELECT usage_date, spend AS daily_spend, prev AS prev_day_spend, spend - prev AS change_amount, CAST(100.0 AS DOUBLE) * CAST(spend - prev AS DOUBLE) / CAST(prev AS DOUBLE) AS pct
FROM (SELECT *, lag(spend) OVER (ORDER BY usage_date) AS prev FROM {days}) l WHERE prev IS NOT NULL"""
_SHOWN = f"usage_date, {num('daily_spend', 'daily_spend')}, {num('prev_day_spend', 'prev_day_spend')}, {num('change_amount', 'change_amount')}"
SPIKE_DAY = "2024-01-21"


def _top_day(date: str, column: str) -> str:
    return f"""SELECT * FROM (SELECT {column} AS key, {num('sum(qty)', 'dbus')}, {num('sum(spend)', 'spend')} FROM pu WHERE usage_date = DATE '{date}' AND {column} IS NOT NULL
 GROUP BY 1 ORDER BY sum(spend) DESC, 1 LIMIT 10) d"""


_DETAILS = " UNION ALL ".join(
    f"SELECT '{p}' AS period, '{c}' AS dimension, CAST(key AS VARCHAR) AS key, dbus, spend FROM ({_top_day(d, c)}) x"
    for p, d in (("current", "2024-01-20"), ("previous", "2024-01-19")) for c in ("sku_name", "cluster_id", "workspace_id"))

QUERIES = [
    Query("p01_platform_kpis", lambda t: K.platform_kpis(t.usage, t.query_history, t.job_run_timeline, *W),
          f"SELECT * FROM ({_QUERIES}) q, ({_USAGE} FROM pu) u"),
    Query("p02_platform_kpis_fast", lambda t: K.platform_kpis_fast(t.usage, t.job_run_timeline, *W), f"SELECT {_ZEROS}, u.* FROM ({_FAST} FROM pu) u"),
    *[Query(f"{USAGE_IDS[k]}_{k}", _usage(k), _series(*USAGE_SQL[k])) for k in USAGE_SQL],
    Query("p04_avg_daily_spend_monthly", _usage("avg_daily_spend", "monthly"), _average(_RAW_SPEND, "monthly")),
    Query("p12_avg_cost_per_cluster", _usage("avg_cost_per_cluster"), _PER_CLUSTER, digits=7),
    Query("p14_total_spend_weekly", _usage("total_spend", "weekly"), _series(*USAGE_SQL["total_spend"], "weekly")),
    Query("p14_total_spend_rolled_monthly", lambda t: T.roll_up(_usage("total_spend")(t), "monthly"), _series(*USAGE_SQL["total_spend"], "monthly")),
    Query("p14_avg_cost_per_cluster_weekly", _usage("avg_cost_per_cluster", "weekly"), _average(_RAW_PER_CLUSTER, "weekly")),
    Query("p14_apps_count_monthly", _usage("apps_count", "monthly"), _series(*USAGE_SQL["apps_count"], "monthly")),
    Query("p14_aiml_endpoints_weekly", _usage("aiml_endpoints", "weekly"), _series(*USAGE_SQL["aiml_endpoints"], "weekly")),
    Query("p15_total_spend_summary", lambda t: T.summarize(_usage("total_spend")(t)), _summary_sql(_RAW_SPEND)),
    Query("p15_cost_per_cluster_summary", lambda t: T.summarize(_usage("avg_cost_per_cluster", "monthly")(t)),
          _summary_sql("SELECT CAST(date_trunc('month', date) AS DATE) AS date, avg(value) AS value FROM (" + _RAW_PER_CLUSTER + ") s GROUP BY 1")),
    *[Query(f"{QUERY_IDS[k]}_{k}", _query(k), _series(v, _IN_RANGE + w, source="qh", day=_DAY)) for k, (v, w) in QUERY_SQL.items()],
    Query("p18_successful_runs", lambda t: K.successful_runs(t.job_run_timeline, *W),
          _series(_n("count(CASE WHEN result_state = 'SUCCEEDED' THEN 1 END)"), source="runs", day="day")),
    Query("p19_avg_query_duration_weekly", _query("avg_query_duration", "weekly"), _average(_RAW_RUN, "weekly")),
    *[Query(f"p20_{k}_{g}", _usage(k, g), _series(*USAGE_SQL[k], g)) for k in DISTINCT_KPIS for g in ("weekly", "monthly")],
    *[Query(f"p20_{k}_{g}", _query(k, g), _series(QUERY_SQL[k][0], _IN_RANGE + QUERY_SQL[k][1], g, "qh", _DAY))
      for k in ("total_users", "unique_warehouses") for g in ("weekly", "monthly")],
    Query("p21_models_served_summary", lambda t: T.summarize(_usage("models_served")(t), positive_only=True),
          _summary_sql(_series("CAST(count(DISTINCT endpoint_name) AS DOUBLE) AS value", L.INFERENCE), True)),
    Query("p22_contract_burndown", lambda t: T.burndown(_daily(t), *CONTRACT, AS_OF),
          f"SELECT date, round(actual, 2) AS actual_cumulative, round(ideal, 2) AS ideal_cumulative FROM ({_SPINE}) s"),
    Query("p23_contract_kpis", lambda t: T.burndown_kpis(_daily(t), *CONTRACT, AS_OF), _BURN),
    Query("p24_contract_projection", lambda t: T.burndown_projection(_daily(t), *CONTRACT, AS_OF), f"""
SELECT date, round(actual, 2) AS actual_cumulative, round(ideal, 2) AS ideal_cumulative,
  CASE WHEN date >= DATE '{AS_OF}' THEN CAST(least(round(CAST(round(k.spent, 2) + ({CONTRACT[2]} - round(k.spent, 2)) / datediff('day', DATE '{AS_OF}', k.finish) * datediff('day', DATE '{AS_OF}', date) AS DECIMAL(20,6)), 2), {CONTRACT[2]}) AS DOUBLE) END AS projected_cumulative
FROM ({_SPINE}) s, (SELECT {_SPENT} AS spent, (SELECT projected_end_date FROM ({_BURN}) b) AS finish) k"""),
    Query("n01_spend_anomalies", lambda t: N.spend_anomalies(t.usage, t.list_prices, *W),
          f"SELECT {_SHOWN}, round(pct, 2) AS change_percent FROM ({_CHANGES.format(days='days')}) c WHERE prev_day_spend > 0 ORDER BY abs(round(pct, 2)) DESC, usage_date LIMIT 20"),
    Query("n02_spend_spikes", lambda t: N.spend_spikes(t.usage, t.list_prices, LAST_DAY, 20.0, 179), f"""
SELECT {_SHOWN}, {num('pct', 'change_percent')}, 'spike' AS alert_type, CASE WHEN abs(pct) > 50 THEN 'high' ELSE 'medium' END AS severity
FROM ({_CHANGES.format(days='days')}) c WHERE abs(pct) >= 20"""),
    Query("n03_threshold_breaches", lambda t: N.threshold_breaches(t.usage, t.list_prices, LAST_DAY, 5000.0, 179), f"""
SELECT usage_date, {num('spend', 'daily_spend')}, CAST(5000 AS DOUBLE) AS threshold, {num('spend - 5000', 'excess_amount')}, 'threshold' AS alert_type, 'high' AS severity
FROM days WHERE spend > 5000"""),
    *[Query(f"n04_day_by_{c}", lambda t, c=c: N.day_breakdown(t.usage, t.list_prices, "2024-01-20", c),
            f"SELECT key AS {c}, dbus, spend FROM ({_top_day('2024-01-20', c)}) x") for c in ("sku_name", "cluster_id", "workspace_id")],
    Query("n05_alert_details", lambda t: N.alert_details(t.usage, t.list_prices, "2024-01-20", "2024-01-19"), _DETAILS),
    Query("n06_spike_alert", lambda t: N.spike_alert(t.usage, t.list_prices, SPIKE_DAY, 1.0), f"""
SELECT max(usage_date) AS alert_date, {num('max(daily_spend)', 'current_spend')}, {num('max(prev_day_spend)', 'previous_spend')}, {num('max(pct)', 'percent_change')}
FROM ({_CHANGES.format(days='days')}) c WHERE usage_date = DATE '{SPIKE_DAY}' - 1 AND abs(pct) >= 1"""),
    Query("n07_daily_threshold_alert", lambda t: N.daily_threshold_alert(t.usage, t.list_prices, SPIKE_DAY, 100.0), f"""
SELECT usage_date AS alert_date, {num('spend', 'daily_spend')}, CAST(100 AS DOUBLE) AS threshold, {num('spend - 100', 'excess_amount')}
FROM days WHERE usage_date = DATE '{SPIKE_DAY}' - 1 AND spend > 100"""),
    Query("n08_workspace_alert", lambda t: N.workspace_threshold_alert(t.usage, t.list_prices, LAST_DAY, 50.0, 179), f"""
SELECT workspace_id, {num('sum(spend)', 'workspace_spend')}, CAST(50 AS DOUBLE) AS threshold, {whole('count(DISTINCT usage_date)', 'days_active')}
FROM pu WHERE usage_date >= {LAST} - 179 GROUP BY 1 HAVING sum(spend) > 50 ORDER BY sum(spend) DESC, 1 LIMIT 10"""),
]
