"""Registered queries: tags (t)."""

from meterlens.plans import tags as T
from meterlens.registered.inputs_sql import LAST
from meterlens.registered.query import SUMS, Query, num, whole
from meterlens.sources.values import FIRST_DAY, LAST_DAY

W = (FIRST_DAY, LAST_DAY)
_WORKSPACES = whole("count(DISTINCT workspace_id)", "workspace_count")
_DAYS = whole("count(DISTINCT usage_date)", "days_active")
_TAIL = "GROUP BY 1 ORDER BY sum(spend) DESC, 1 LIMIT 500"


def _untagged(key, name, join="", alias=None, extra=""):
    """Untagged usage per object, joined to at most one row of facts per object."""
    return f"""SELECT u.{key} AS {alias or key}, {name}, {extra} max(u.workspace_id) AS workspace_id, {SUMS}, {_DAYS}
FROM pu u {join} WHERE u.{key} IS NOT NULL AND NOT u.tagged {_TAIL}"""


_NULL = "CAST(NULL AS VARCHAR)"
_CL = "LEFT JOIN (SELECT cluster_id, max(cluster_name) AS n, max(cluster_source) AS src, max(owned_by) AS own FROM cl_log WHERE NOT deleted GROUP BY 1) c ON u.cluster_id = c.cluster_id"
_WH = "LEFT JOIN (SELECT warehouse_id, max(warehouse_name) AS n FROM wh_log WHERE NOT deleted GROUP BY 1) w ON u.warehouse_id = w.warehouse_id"
_BY_TAG = f"SELECT tag_key, tag_value, sum(qty) AS d, sum(spend) AS s, {_WORKSPACES}, {_DAYS} FROM tagrows GROUP BY 1, 2"


def _by_tag(t, limit=None):
    return T.cost_by_tag(t.usage, t.list_prices, *W, limit=limit)


QUERIES = [
    Query("t01_coverage", lambda t: T.coverage(t.usage, t.list_prices, *W), f"""
SELECT {num('sum(CASE WHEN tagged THEN spend ELSE 0 END)', 'tagged_spend')}, {num('sum(CASE WHEN NOT tagged THEN spend ELSE 0 END)', 'untagged_spend')}, {num('sum(spend)', 'total_spend')},
  {whole('count(DISTINCT CASE WHEN tagged THEN workspace_id END)', 'tagged_workspaces')}, {whole('count(DISTINCT CASE WHEN NOT tagged THEN workspace_id END)', 'untagged_workspaces')} FROM pu"""),
    Query("t02_untagged_clusters", lambda t: T.untagged_clusters(t.usage, t.list_prices, None, *W),
          _untagged("cluster_id", f"{_NULL} AS cluster_name", extra=f"{_NULL} AS cluster_source, {_NULL} AS owner,")),
    Query("t02_untagged_clusters_enriched", lambda t: T.untagged_clusters(t.usage, t.list_prices, t.clusters, *W),
          _untagged("cluster_id", "coalesce(max(c.n), u.cluster_id) AS cluster_name", _CL, extra="max(c.src) AS cluster_source, max(c.own) AS owner,")),
    Query("t03_untagged_jobs", lambda t: T.untagged_jobs(t.usage, t.list_prices, None, *W), _untagged("job_id", "coalesce(max(job_name), u.job_id) AS job_name")),
    Query("t03_untagged_jobs_enriched", lambda t: T.untagged_jobs(t.usage, t.list_prices, t.jobs, *W),
          _untagged("job_id", "coalesce(max(j.name), u.job_id) AS job_name", "JOIN job_now j ON u.job_id = j.job_id")),
    Query("t04_untagged_pipelines", lambda t: T.untagged_pipelines(t.usage, t.list_prices, None, *W), _untagged("pipeline_id", f"{_NULL} AS pipeline_name")),
    Query("t04_untagged_pipelines_enriched", lambda t: T.untagged_pipelines(t.usage, t.list_prices, t.pipelines, *W),
          _untagged("pipeline_id", "max(n.name) AS pipeline_name", "JOIN pl_now n ON u.pipeline_id = n.pipeline_id")),
    Query("t05_untagged_warehouses", lambda t: T.untagged_warehouses(t.usage, t.list_prices, None, *W), _untagged("warehouse_id", f"{_NULL} AS warehouse_name")),
    Query("t05_untagged_warehouses_enriched", lambda t: T.untagged_warehouses(t.usage, t.list_prices, t.warehouses, *W),
          _untagged("warehouse_id", "coalesce(max(w.n), u.warehouse_id) AS warehouse_name", _WH)),
    Query("t06_untagged_endpoints", lambda t: T.untagged_endpoints(t.usage, t.list_prices, *W),
          f"SELECT endpoint_name, max(workspace_id) AS workspace_id, {SUMS}, {_DAYS} FROM pu WHERE endpoint_name IS NOT NULL AND NOT tagged {_TAIL}"),
    Query("t07_cost_by_tag", lambda t: _by_tag(t, 500),
          f"SELECT * EXCLUDE (d, s), {num('d', 'total_dbus')}, {num('s', 'total_spend')} FROM ({_BY_TAG} ORDER BY s DESC, 1, 2 LIMIT 500) b"),
    Query("t08_cost_by_tag_key", lambda t: T.cost_by_tag_key(t.usage, t.list_prices, *W),
          f"SELECT tag_key, {SUMS}, {_WORKSPACES} FROM tagrows GROUP BY 1 ORDER BY sum(spend) DESC, 1 LIMIT 50"),
    Query("t08b_keys_of_tags", lambda t: T.keys_of_tags(_by_tag(t)), f"SELECT tag_key, {num('sum(s)', 'total_spend')} FROM ({_BY_TAG}) b GROUP BY 1 ORDER BY sum(s) DESC, 1 LIMIT 8"),
    Query("t09_top_objects_of_tag", lambda t: T.top_objects_of_tag(t.usage, t.list_prices, *W, "team", "BUILDING"), f"""
SELECT coalesce(cluster_id, warehouse_id, endpoint_name, pipeline_id, job_id, sku_name) AS object_id,
  CASE WHEN cluster_id IS NOT NULL THEN 'Cluster' WHEN warehouse_id IS NOT NULL THEN 'SQL Warehouse' WHEN endpoint_name IS NOT NULL THEN 'Serving Endpoint'
    WHEN pipeline_id IS NOT NULL THEN 'Pipeline' WHEN job_id IS NOT NULL THEN 'Job' ELSE 'Other' END AS object_type,
  coalesce(cluster_id, warehouse_id, endpoint_name, pipeline_id, job_name, sku_name) AS object_name, max(workspace_id) AS workspace_id, {SUMS}, {_DAYS}
FROM pu WHERE tag_team = 'BUILDING' GROUP BY 1, 2, 3 ORDER BY sum(spend) DESC, 2, 1, 3 LIMIT 5"""),
    Query("t10_tag_catalogue", lambda t: T.tag_catalogue(t.usage, LAST_DAY, 90), f"""
SELECT tag_key, CAST(0 AS BIGINT) AS part, string_agg(tag_value, '|' ORDER BY tag_value) AS tag_values FROM (
  SELECT DISTINCT 'team' AS tag_key, tag_team AS tag_value FROM usage WHERE tag_team IS NOT NULL AND usage_date >= {LAST} - 90
  UNION ALL SELECT DISTINCT 'env', tag_env FROM usage WHERE tag_env IS NOT NULL AND usage_date >= {LAST} - 90) x GROUP BY 1"""),
    Query("t11_coverage_series", lambda t: T.coverage_series(t.usage, t.list_prices, *W),
          f"SELECT usage_date, {num('sum(CASE WHEN tagged THEN spend ELSE 0 END)', 'tagged_spend')}, {num('sum(CASE WHEN NOT tagged THEN spend ELSE 0 END)', 'untagged_spend')} FROM pu GROUP BY 1"),
    Query("t12_suggested_tags", lambda t: T.suggested_tags(_by_tag(t)), f"""
SELECT tag_key AS key, {whole('sum(greatest(workspace_count, 1))', 'usage_count')}, string_agg(CASE WHEN rn <= 3 THEN tag_value END, '|' ORDER BY rn) AS examples
FROM (SELECT *, row_number() OVER (PARTITION BY tag_key ORDER BY s DESC, tag_value) AS rn FROM ({_BY_TAG}) b) x GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""),
]
