"""Registered queries: AI and ML (m), apps (r)."""

from meterlens.operators import trend as T
from meterlens.plans import aiml as M
from meterlens.plans import apps as R
from meterlens.registered import labels_sql as L
from meterlens.registered.inputs_sql import LAST
from meterlens.registered.query import SUMS, Query, num, whole
from meterlens.sources.values import FIRST_DAY, LAST_DAY

W = (FIRST_DAY, LAST_DAY)
_WORKSPACES = whole("count(DISTINCT workspace_id)", "workspace_count")
_DAYS = whole("count(DISTINCT usage_date)", "days_active")
_RANGE = f"{whole('count(DISTINCT usage_date)', 'days_in_range')}, min(usage_date) AS first_date, max(usage_date) AS last_date"
_ENDPOINTS = f"""SELECT coalesce(endpoint_name, 'UNKNOWN') AS endpoint_name, sku_name, CASE WHEN sku_name LIKE '%LAUNCH' THEN 'Launch (Scale-from-Zero)' ELSE 'Steady State' END AS cost_type,
  sum(qty) AS d, sum(spend) AS s, {_WORKSPACES}, {_DAYS} FROM pu WHERE {L.INFERENCE} GROUP BY 1, 2, 3"""
_ML = "(SELECT DISTINCT cluster_id FROM cl_log WHERE lower(dbr_version) LIKE '%-ml-%' OR lower(dbr_version) LIKE '%-gpu-%')"


def _agents_sql(name: str, join: str) -> str:
    kind = L.AGENT.format(name=f"coalesce({name}, '')")
    return f"""SELECT coalesce({name}, u.endpoint_id, 'Unknown') AS agent_name, max(u.endpoint_id) AS endpoint_id, max(workspace_id) AS workspace_id, max({kind}) AS agent_type,
  {SUMS}, {_DAYS}, {_WORKSPACES}, min(usage_date) AS first_seen, max(usage_date) AS last_seen, {num('CAST(sum(spend) AS DOUBLE) / count(DISTINCT usage_date)', 'avg_daily_spend')}
FROM pu u {join} WHERE {L.IS_AGENT} GROUP BY 1"""


_SERVED = """LEFT JOIN (SELECT 'ep-' || (p_partkey % 9) AS endpoint_id, max(n) AS served FROM (SELECT *, ['ka-support', 'kie-invoices', 'sales-genie', 'Team-Supervisor', 'churn-model',
  'multi-agent-desk', 'fraud-model', 'Knowledge-Base-Assistant', 'rank-model'][CAST(p_partkey % 9 AS INTEGER) + 1] AS n FROM part) x WHERE p_partkey % 9 <> 4 GROUP BY 1) e ON u.endpoint_id = e.endpoint_id"""

_APP = "coalesce(app_id, 'Unknown')"
_APP_COUNT = whole(f"count(DISTINCT {_APP})", "app_count")
_BY_APP = f"""SELECT {_APP} AS app_id, sum(qty) AS d, sum(spend) AS s, {_WORKSPACES}, {_DAYS}, max(usage_date) AS last_usage_date FROM appu GROUP BY 1"""
_REGISTERED = "app_id IN (SELECT app_id FROM apps_reg)"
# a day on which some apps have been out of use for more than a week
AS_OF = "2024-02-05"
_STATE = f"""SELECT coalesce(b.app_id, g.app_id) AS app_id, coalesce(g.name, b.app_id) AS app_name, coalesce(g.url, '') AS app_url, {num('coalesce(b.d, 0)', 'total_dbus')}, {num('coalesce(b.s, 0)', 'total_spend')},
  coalesce(b.workspace_count, 0) AS workspace_count, coalesce(b.days_active, 0) AS days_active, b.last_usage_date, {num('coalesce(100 * CAST(b.s AS DOUBLE) / CAST(t.w AS DOUBLE), 0)', 'percentage')},
  g.app_id IS NOT NULL AS is_registered, CASE WHEN b.last_usage_date >= DATE '{AS_OF}' - 7 THEN 'active' ELSE 'inactive' END AS status"""


def _by_app(t):
    return R.by_app(t.usage, t.list_prices, *W)


def _kpi(kpi, granularity="daily"):
    return lambda t: R.app_kpi(t.usage, t.list_prices, t.app_registry, *W, kpi, granularity)


_KPI = {"apps_spend": num("sum(spend)", "value"), "apps_dbus": num("sum(qty)", "value"), "apps_count": whole("count(DISTINCT app_id)", "value")}

QUERIES = [
    Query("m01_summary", lambda t: M.summary(t.usage, t.list_prices, *W), f"""
SELECT {SUMS}, {_WORKSPACES}, {whole('count(DISTINCT endpoint_name)', 'endpoint_count')}, {_RANGE},
  (SELECT {num('avg(n)', 'v')} FROM (SELECT usage_date, count(DISTINCT endpoint_name) AS n FROM pu WHERE {L.IS_AIML} GROUP BY 1) d) AS avg_endpoints_per_day
FROM pu WHERE {L.IS_AIML}"""),
    Query("m02_by_provider", lambda t: M.by_provider(t.usage, t.list_prices, *W),
          f"SELECT {L.PROVIDER} AS provider, sku_name, {SUMS}, {_WORKSPACES} FROM pu WHERE {L.PROVIDER} IS NOT NULL GROUP BY 1, 2"),
    Query("m03_serverless_endpoints", lambda t: M.serverless_endpoints(t.usage, t.list_prices, *W),
          f"SELECT * EXCLUDE (d, s), {num('d', 'total_dbus')}, {num('s', 'total_spend')} FROM ({_ENDPOINTS} ORDER BY s DESC, 1, 2 LIMIT 100) e"),
    Query("m03b_endpoint_totals", lambda t: M.endpoint_totals(M.serverless_endpoints(t.usage, t.list_prices, *W, limit=None)),
          f"SELECT endpoint_name, {num('sum(s)', 'total_spend')}, {num('sum(d)', 'total_dbus')}, arg_max(days_active, s) AS days_active FROM ({_ENDPOINTS}) e GROUP BY 1"),
    Query("m04_by_category", lambda t: M.by_category(t.usage, t.list_prices, *W),
          f"SELECT {L.AIML} AS category, {SUMS}, {_WORKSPACES} FROM pu WHERE {L.IS_AIML} GROUP BY 1"),
    Query("m05_timeseries", lambda t: M.timeseries(t.usage, t.list_prices, *W),
          f"SELECT usage_date, {L.AIML_SERIES} AS category, {SUMS} FROM pu WHERE {L.IS_AIML} GROUP BY 1, 2"),
    Query("m06_top_models", lambda t: M.top_models(t.usage, t.list_prices, *W), f"""
SELECT coalesce(endpoint_name, 'Unknown') AS model_name, {L.MODEL_TYPE} AS model_type, {SUMS}, {_DAYS}, {_WORKSPACES} FROM pu WHERE {L.MODEL_TYPE} IS NOT NULL
GROUP BY 1, 2 ORDER BY sum(spend) DESC, 1, 2 LIMIT 20"""),
    Query("m07_ml_clusters", lambda t: M.ml_clusters(t.usage, t.list_prices, t.clusters, *W), f"""
SELECT c.cluster_name, c.cluster_id, c.v AS runtime_version, c.o AS owner, max(u.workspace_id) AS workspace_id, {SUMS}, {_DAYS}
FROM pu u JOIN (SELECT cluster_id, max(cluster_name) AS cluster_name, max(dbr_version) AS v, max(owned_by) AS o FROM cl_log WHERE cluster_id IN {_ML} GROUP BY 1) c ON u.cluster_id = c.cluster_id GROUP BY 1, 2, 3, 4"""),
    Query("m07b_ml_clusters_without_table", lambda t: M.ml_clusters(t.usage, t.list_prices, None, *W), f"""
SELECT CAST('' AS VARCHAR) AS cluster_name, CAST('' AS VARCHAR) AS cluster_id, CAST('' AS VARCHAR) AS runtime_version, CAST('' AS VARCHAR) AS owner, max(workspace_id) AS workspace_id,
  {SUMS}, {_DAYS} FROM pu WHERE false GROUP BY usage_date"""),
    Query("m08_agents", lambda t: M.agents(t.usage, t.list_prices, t.served_entities, *W), _agents_sql("coalesce(e.served, u.endpoint_name)", _SERVED)),
    Query("m08b_agents_bills_only", lambda t: M.agents(t.usage, t.list_prices, None, *W), _agents_sql("u.endpoint_name", "")),
    Query("m09_sku_catalogue", lambda t: M.sku_catalogue(t.usage, t.list_prices, *W),
          f"SELECT sku_name, product AS billing_origin_product, usage_type, {whole('count(*)', 'usage_records')}, {SUMS} FROM pu WHERE {L.IS_SERVING} GROUP BY 1, 2, 3"),
    Query("m10_runtime_versions", lambda t: M.runtime_versions(t.clusters), f"""
SELECT dbr_version AS spark_version, {whole('count(*)', 'cluster_count')}, CASE WHEN dbr_version IN ('14.3.x-cpu-ml-scala2.12', '15.1.x-GPU-ML-x') THEN 'ML/GPU' ELSE 'Standard' END AS runtime_type
FROM cl_log WHERE dbr_version IS NOT NULL GROUP BY 1"""),
    Query("m10_runtime_coverage", lambda t: M.runtime_coverage(t.usage, t.clusters, LAST_DAY, 180),
          f"SELECT {whole('count(DISTINCT cluster_id)', 'ml_clusters_with_billing')}, {whole('count(*)', 'billing_rows')}, {num('sum(qty)', 'total_dbus')} FROM pu WHERE cluster_id IN {_ML} AND usage_date >= {LAST} - 180"),
    Query("r01_summary", lambda t: R.summary(t.usage, t.list_prices, *W),
          f"SELECT {SUMS}, {_WORKSPACES}, {_APP_COUNT}, {_RANGE} FROM appu"),
    Query("r02_by_app", _by_app, f"SELECT * EXCLUDE (d, s), {num('d', 'total_dbus')}, {num('s', 'total_spend')} FROM ({_BY_APP}) a"),
    Query("r03_app_workspaces", lambda t: R.app_workspaces(t.usage, t.workspaces, *W),
          f"SELECT DISTINCT {_APP} AS app_id, u.workspace_id, coalesce(w.workspace_name, CAST(u.workspace_id AS VARCHAR)) AS workspace_name FROM appu u LEFT JOIN ws w ON u.workspace_id = w.workspace_id"),
    Query("r03_app_workspace_ids", lambda t: R.app_workspaces(t.usage, None, *W),
          f"SELECT DISTINCT {_APP} AS app_id, workspace_id, CAST(workspace_id AS VARCHAR) AS workspace_name FROM appu"),
    Query("r04_app_identities", lambda t: R.app_identities(t.usage, *W), f"SELECT DISTINCT {_APP} AS app_id, run_as FROM appu WHERE run_as IS NOT NULL"),
    Query("r05_timeseries", lambda t: R.timeseries(t.usage, t.list_prices, *W), f"SELECT usage_date, {SUMS} FROM appu GROUP BY 1"),
    Query("r05b_timeseries_registered", lambda t: R.timeseries(t.usage, t.list_prices, *W, registry=t.app_registry),
          f"SELECT usage_date, {SUMS} FROM appu WHERE {_REGISTERED} GROUP BY 1"),
    Query("r06_by_app_and_sku", lambda t: R.by_app_and_sku(t.usage, t.list_prices, *W), f"""
SELECT app_id, sku_name, {num('d', 'total_dbus')}, {num('s', 'total_spend')}, {num('100 * CAST(s AS DOUBLE) / sum(CAST(s AS DOUBLE)) OVER (PARTITION BY app_id)', 'percentage')}
FROM (SELECT {_APP} AS app_id, sku_name, sum(qty) AS d, sum(spend) AS s FROM appu GROUP BY 1, 2) x"""),
    Query("r07_app_status", lambda t: R.app_status(_by_app(t), t.app_registry, AS_OF), f"""
{_STATE} FROM ({_BY_APP}) b FULL OUTER JOIN apps_reg g ON b.app_id = g.app_id, (SELECT sum(s) AS w FROM ({_BY_APP}) z) t
WHERE g.app_id IS NOT NULL OR b.last_usage_date < DATE '{AS_OF}' - 7"""),
    Query("r07_app_status_active_only", lambda t: R.app_status(_by_app(t), t.app_registry, AS_OF, active_only=True), f"""
{_STATE} FROM (SELECT * FROM ({_BY_APP}) y WHERE last_usage_date >= DATE '{AS_OF}' - 7) b JOIN apps_reg g ON b.app_id = g.app_id,
  (SELECT sum(s) AS w FROM ({_BY_APP}) z WHERE last_usage_date >= DATE '{AS_OF}' - 7) t"""),
    Query("r07_app_status_summary", lambda t: R.app_status_summary(_by_app(t), t.app_registry, AS_OF), f"""
SELECT 'inactive' AS part, {whole('count(*)', 'count')}, {num('coalesce(sum(s), 0)', 'total_spend')}, {num('coalesce(sum(d), 0)', 'total_dbus')},
  {num(f'100 * coalesce(CAST(sum(s) AS DOUBLE), 0) / ((SELECT CAST(sum(s) AS DOUBLE) FROM ({_BY_APP}) w) + coalesce(CAST(sum(s) AS DOUBLE), 0))', 'percentage')} FROM ({_BY_APP}) a WHERE last_usage_date < DATE '{AS_OF}' - 7
UNION ALL SELECT 'unregistered', count(*), {num('coalesce(sum(s), 0)', 's')}, {num('coalesce(sum(d), 0)', 'd')}, {num(f'100 * coalesce(CAST(sum(s) AS DOUBLE), 0) / (SELECT CAST(sum(s) AS DOUBLE) FROM ({_BY_APP}) w)', 'p')}
FROM ({_BY_APP}) a WHERE NOT {_REGISTERED}"""),
    *[Query(f"r08_{k}", _kpi(k), f"SELECT usage_date AS date, {v} FROM appu WHERE {_REGISTERED} GROUP BY 1") for k, v in _KPI.items()],
    Query("r08_apps_count_weekly", _kpi("apps_count", "weekly"),
          f"SELECT CAST(date_trunc('week', usage_date) AS DATE) AS date, {_KPI['apps_count']} FROM appu WHERE {_REGISTERED} GROUP BY 1"),
    Query("r08_apps_spend_summary", lambda t: T.summarize(_kpi("apps_spend")(t)), f"""
SELECT round(a, 2) AS period_start_value, round(z, 2) AS period_end_value, round(z - a, 2) AS change_amount, round((z - a) / a * 100, 2) AS change_percent, round(lo, 2) AS min_value,
  round(hi, 2) AS max_value, round(mean, 2) AS avg_value, CASE WHEN abs((z - a) / a * 100) < 5 THEN 'flat' WHEN z > a THEN 'increasing' ELSE 'decreasing' END AS trend
FROM (SELECT arg_min(v, usage_date) AS a, arg_max(v, usage_date) AS z, min(v) AS lo, max(v) AS hi, avg(v) AS mean FROM (SELECT usage_date, CAST(sum(spend) AS DOUBLE) AS v FROM appu WHERE {_REGISTERED} GROUP BY 1) s) x"""),
    Query("r09_hosting_comparison", lambda t: R.hosting_comparison(_by_app(t), 180), f"""
SELECT app_id, {num('y', 'annual_spend')}, CAST(35740 AS DOUBLE) AS diy_low, CAST(71640 AS DOUBLE) AS diy_high, {num('35740 - y', 'savings_low')}, {num('71640 - y', 'savings_high')}, {num('(53690 - y) / 53690 * 100', 'savings_percent')}
FROM (SELECT app_id, CAST(s AS DOUBLE) / 180 * 365 AS y FROM ({_BY_APP}) a) b"""),
]
