"""Registered queries: users and groups (g), use cases (c)."""

from pyspark.sql import functions as F

from meterlens.plans import usecases as C
from meterlens.plans import users as G
from meterlens.registered import labels_sql as L
from meterlens.registered.inputs_sql import FIRST, LAST
from meterlens.registered.query import DBUS, Query, num, stamp, whole
from meterlens.sources.values import FIRST_DAY, LAST_DAY

W = (FIRST_DAY, LAST_DAY)
_USERS = "(SELECT * FROM pu WHERE run_as IS NOT NULL)"
_BY_CATEGORY = f"SELECT run_as AS user_email, {L.CATEGORY} AS product_category, sum(spend) AS s FROM {_USERS} u GROUP BY 1, 2"
_DETAIL = f"SELECT workspace_id, run_as AS user_email, {L.GROUP_REPORT} AS product_category, sum(spend) AS s FROM {_USERS} u GROUP BY 1, 2, 3"
_TOP6 = f"(SELECT run_as FROM {_USERS} u GROUP BY 1 ORDER BY sum(spend) DESC, 1 LIMIT 6)"
_DAILY6 = f"SELECT usage_date AS date, run_as AS user_email, sum(spend) AS s FROM pu WHERE run_as IN {_TOP6} GROUP BY 1, 2"
_HALF = f"({FIRST} + 89)"


def _categories(t, limit=None):
    return G.by_category(t.usage, t.list_prices, *W, limit=limit)


def _detail(t, limit=None):
    return G.workspace_detail(t.usage, t.list_prices, *W, limit=limit)


def _group_rows(t):
    rows = G.group_rollup(_detail(t), t.user_groups)
    spaces = rows.select("*", F.explode("workspaces").alias("w")).select("*", F.explode("w.products").alias("p"))
    return spaces.select("group_name", "total_spend", "member_count", "primary_product", "percentage", "distinct_spend",
                         F.col("w.workspace_id").alias("workspace_id"), F.col("w.spend").alias("workspace_spend"),
                         F.col("p.product").alias("product"), F.col("p.spend").alias("product_spend"))


_GROUP_SQL = f"""
SELECT c.group_name, {num('g.s', 'total_spend')}, g.n AS member_count, b.product_category AS primary_product, {num('100 * CAST(g.s AS DOUBLE) / (SELECT CAST(sum(s) AS DOUBLE) FROM gm)', 'percentage')},
  {num("(SELECT sum(s) FROM det WHERE user_email IN (SELECT user_email FROM ug))", 'distinct_spend')}, c.workspace_id, {num('w.s', 'workspace_spend')}, c.product_category AS product, {num('c.s', 'product_spend')}
FROM (SELECT group_name, workspace_id, product_category, sum(s) AS s FROM gm GROUP BY 1, 2, 3) c
JOIN (SELECT group_name, sum(s) AS s, {whole('count(DISTINCT user_email)', 'n')} FROM gm GROUP BY 1) g ON c.group_name = g.group_name
JOIN (SELECT group_name, workspace_id, sum(s) AS s FROM gm GROUP BY 1, 2) w ON c.group_name = w.group_name AND c.workspace_id = w.workspace_id
JOIN (SELECT group_name, arg_max(product_category, s) AS product_category FROM (SELECT group_name, product_category, sum(s) AS s FROM gm GROUP BY 1, 2) p GROUP BY 1) b ON c.group_name = b.group_name"""


def _with_members(body: str) -> str:
    return f"SELECT * FROM (WITH det AS ({_DETAIL}), gm AS (SELECT d.*, g.group_name FROM det d JOIN ug g ON d.user_email = g.user_email) {body}) r"


UC = "uc-4"
#: uc-24 maps a cluster, a warehouse, a job, an endpoint and a pipeline, each with dates of its own
UC_DATED = "uc-24"
_TYPED = """SELECT usage_date, qty, spend, cluster_id, job_id, coalesce(cluster_id, warehouse_id, job_id, endpoint_id, pipeline_id) AS shown,
  unnest([{'r': 1, 't': 'cluster', 'i': cluster_id}, {'r': 2, 't': 'warehouse', 'i': warehouse_id}, {'r': 3, 't': 'job', 'i': job_id}, {'r': 4, 't': 'endpoint', 'i': endpoint_id}, {'r': 5, 't': 'pipeline', 'i': pipeline_id}]) AS e,
  row_number() OVER () AS rid FROM pu WHERE coalesce(cluster_id, warehouse_id, job_id, endpoint_id, pipeline_id) IS NOT NULL"""


def _mapped(where: str, extra: str = "TRUE") -> str:
    return f"""SELECT use_case_id, usage_date, object_type, shown AS object_id, sum(qty) AS d, sum(spend) AS s FROM (
  SELECT m.use_case_id, x.usage_date, x.shown, x.qty, x.spend, m.object_type, row_number() OVER (PARTITION BY m.use_case_id, x.rid ORDER BY x.e.r) AS rn
  FROM ({_TYPED}) x JOIN uco m ON x.e.t = m.object_type AND x.e.i = m.object_id WHERE {where} AND {extra}) y WHERE rn = 1 GROUP BY 1, 2, 3, 4"""


_ONE = _mapped(f"m.use_case_id = '{UC}'")
_DATED = _mapped(f"m.use_case_id = '{UC_DATED}'", "(m.custom_start IS NULL OR x.usage_date >= m.custom_start) AND (m.custom_end IS NULL OR x.usage_date <= m.custom_end)")
# usage is folded per object combination before use cases are attached, to keep the check small
_OBJ = "SELECT cluster_id AS c, warehouse_id AS w, job_id AS j, endpoint_id AS e, pipeline_id AS p, sum(qty) AS d, sum(spend) AS s FROM pu WHERE coalesce(cluster_id, warehouse_id, job_id, endpoint_id, pipeline_id) IS NOT NULL GROUP BY 1, 2, 3, 4, 5"
_EVERY = f"""SELECT use_case_id, object_type, shown, sum(d) AS d, sum(s) AS s FROM (
  SELECT m.use_case_id, m.object_type, coalesce(c, w, j, e, p) AS shown, d, s, row_number() OVER (PARTITION BY m.use_case_id, rid ORDER BY CASE m.object_type WHEN 'cluster' THEN 1 WHEN 'warehouse' THEN 2 WHEN 'job' THEN 3 WHEN 'endpoint' THEN 4 ELSE 5 END) AS rn
  FROM (SELECT *, row_number() OVER () AS rid FROM ({_OBJ}) o) x JOIN uco m ON m.object_id = CASE m.object_type WHEN 'cluster' THEN c WHEN 'warehouse' THEN w WHEN 'job' THEN j WHEN 'endpoint' THEN e ELSE p END) y
WHERE rn = 1 GROUP BY 1, 2, 3"""


def _rows(t):
    return C.analytics(t.usage, t.list_prices, t.use_case_objects, UC, *W)


_CATALOGUE = """SELECT DISTINCT {i} AS object_id, {n} AS object_name, workspace_id, '{t}' AS object_type FROM usage WHERE {i} IS NOT NULL AND qty > 0 AND usage_date >= {since}
ORDER BY 1, 2, 3 LIMIT 100"""
_IDS = {"cluster": ("cluster_id", "cluster_id"), "warehouse": ("warehouse_id", "warehouse_id"), "pipeline": ("pipeline_id", "pipeline_id"),
        "endpoint": ("endpoint_id", "coalesce(endpoint_name, endpoint_id)"), "job": ("job_id", "job_id")}
_LIST = f"""SELECT use_case_id, name, description, owner, {stamp('created_at', 'created_at')}, {stamp('created_at', 'updated_at')}, status,
  coalesce('region=' || tag_region || '|segment=' || tag_segment, NULL) AS tags, stage, start_date, end_date, live_date FROM uc"""


def _tags_as_text(df):
    entries = F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return df.withColumn("tags", F.when(F.col("tags").isNotNull(), F.array_join(entries, "|")))


def _next_statements(t):
    """The second page, behind the last row of the first."""
    last = C.query_catalogue(t.query_history, LAST_DAY, with_start=True).collect()[-1]
    return C.query_catalogue(t.query_history, LAST_DAY, after=(last.start_time, last.object_id, last.workspace_id))


QUERIES = [
    Query("g01_summary", lambda t: G.summary(t.usage, t.list_prices, *W), f"""
SELECT {whole('count(DISTINCT run_as)', 'user_count')}, {num('sum(spend)', 'total_spend')}, {DBUS}, {num('CAST(sum(spend) AS DOUBLE) / count(DISTINCT run_as)', 'avg_spend_per_user')} FROM {_USERS} u"""),
    Query("g02_by_spend", lambda t: G.by_spend(t.usage, t.list_prices, *W), f"""
SELECT run_as AS user_email, {num('sum(spend)', 'total_spend')}, {DBUS}, {whole('count(DISTINCT usage_date)', 'active_days')}, {whole('count(DISTINCT workspace_id)', 'workspace_count')} FROM {_USERS} u GROUP BY 1"""),
    Query("g03_by_category", lambda t: _categories(t, 5000),
          f"SELECT user_email, product_category, {num('s', 'spend')} FROM ({_BY_CATEGORY} ORDER BY s DESC, 1, 2 LIMIT 5000) c"),
    Query("g04_primary_product", lambda t: G.primary_product(_categories(t)), f"""
SELECT user_email, product_category AS primary_product FROM (SELECT *, row_number() OVER (PARTITION BY user_email ORDER BY s DESC, product_category DESC) AS rn FROM ({_BY_CATEGORY}) c) x WHERE rn = 1"""),
    Query("g05_daily_of_top_users", lambda t: G.daily_of_top_users(t.usage, t.list_prices, *W), f"SELECT date, user_email, {num('s', 'daily_spend')} FROM ({_DAILY6}) d"),
    Query("g06_by_workspace", lambda t: G.by_workspace(t.usage, t.list_prices, *W),
          f"SELECT workspace_id, {whole('count(DISTINCT run_as)', 'user_count')}, {num('sum(spend)', 'total_spend')} FROM {_USERS} u GROUP BY 1 ORDER BY sum(spend) DESC, 1 LIMIT 20"),
    Query("g07_workspace_detail", lambda t: _detail(t, 2000),
          f"SELECT workspace_id, user_email, product_category, {num('s', 'spend')} FROM ({_DETAIL} ORDER BY s DESC, 1, 2, 3 LIMIT 2000) d"),
    Query("g08_group_rollup", _group_rows, _with_members(_GROUP_SQL)),
    Query("g08_ungrouped", lambda t: G.ungrouped(_detail(t), t.user_groups),
          f"SELECT workspace_id, {num('sum(s)', 'spend')} FROM ({_DETAIL}) d WHERE user_email NOT IN (SELECT user_email FROM ug) GROUP BY 1"),
    Query("g09_spend_growth", lambda t: G.spend_growth(t.usage, t.list_prices, *W), f"""
SELECT {num('a', 'first_half')}, {num('b', 'second_half')}, round((b - a) / a * 100, 1) AS spend_growth_pct FROM (
  SELECT CAST(sum(CASE WHEN usage_date <= {_HALF} THEN spend END) AS DOUBLE) AS a, CAST(sum(CASE WHEN usage_date > {_HALF} THEN spend END) AS DOUBLE) AS b FROM {_USERS} u) x"""),
    Query("g10_user_growth", lambda t: G.user_growth(t.usage, *W), f"""
SELECT strftime(m, '%Y-%m') AS month, {whole('count(DISTINCT p.run_as)', 'active_users')}, {whole('count(DISTINCT CASE WHEN m = f THEN p.run_as END)', 'new_users')}
FROM (SELECT date_trunc('month', usage_date) AS m, run_as FROM {_USERS} u) p JOIN (SELECT run_as, min(date_trunc('month', usage_date)) AS f FROM {_USERS} u GROUP BY 1) q ON p.run_as = q.run_as GROUP BY m"""),
    Query("g11_weekly_report", lambda t: G.weekly_report(G.by_spend(t.usage, t.list_prices, "2024-01-23", "2024-01-30")), f"""
SELECT run_as AS user_email, {num('sum(spend)', 'total_spend')}, {whole('count(DISTINCT usage_date)', 'active_days')} FROM {_USERS} u WHERE usage_date BETWEEN DATE '2024-01-23' AND DATE '2024-01-30'
GROUP BY 1 ORDER BY sum(spend) DESC, 1 LIMIT 10"""),
    Query("g12_product_totals", lambda t: G.product_totals(_categories(t)), f"SELECT product_category AS product, {num('sum(s)', 'spend')} FROM ({_BY_CATEGORY}) c GROUP BY 1"),
    Query("g12_top_users_of_product", lambda t: G.top_users_of_product(_categories(t), "Model Serving"),
          f"SELECT user_email, {num('s', 'spend')} FROM ({_BY_CATEGORY}) c WHERE product_category = 'Model Serving' AND s > 0 ORDER BY s DESC, 1 LIMIT 5"),
    Query("c01_use_case_usage", _rows, f"SELECT usage_date, object_type, object_id, {num('d', 'total_dbus')}, {num('s', 'total_spend')} FROM ({_ONE}) o"),
    Query("c01_use_case_usage_custom_dates", lambda t: C.analytics(t.usage, t.list_prices, t.use_case_objects, UC_DATED, *W, custom_dates=True),
          f"SELECT usage_date, object_type, object_id, {num('d', 'total_dbus')}, {num('s', 'total_spend')} FROM ({_DATED}) o"),
    Query("c02_daily", lambda t: C.daily(_rows(t)), f"SELECT usage_date AS date, {num('sum(s)', 'spend')}, {num('sum(d)', 'dbus')} FROM ({_ONE}) o GROUP BY 1"),
    Query("c02_by_component", lambda t: C.by_component(_rows(t)), f"SELECT object_type, object_id, {num('sum(s)', 'spend')}, {num('sum(d)', 'dbus')} FROM ({_ONE}) o GROUP BY 1, 2"),
    Query("c02_by_object_type", lambda t: C.by_object_type(_rows(t)),
          f"SELECT object_type, {num('sum(s)', 'spend')}, {num('sum(d)', 'dbus')}, {whole('count(DISTINCT object_id)', 'count')} FROM ({_ONE}) o GROUP BY 1"),
    Query("c03_all_use_cases", lambda t: C.all_use_cases(t.usage, t.list_prices, t.use_cases, t.use_case_objects, *W), f"""
SELECT use_case_id, name, owner, stage, total_spend, total_dbus, object_count, {num('100 * total_spend / sum(total_spend) OVER ()', 'percentage')} FROM (
  SELECT u.use_case_id, u.name, u.owner, coalesce(u.stage, 'Development') AS stage, round(CAST(coalesce(e.s, 0) AS DOUBLE), 2) AS total_spend, round(CAST(coalesce(e.d, 0) AS DOUBLE), 2) AS total_dbus,
    {whole('coalesce(e.n, 0)', 'object_count')} FROM uc u LEFT JOIN (SELECT use_case_id, sum(d) AS d, sum(s) AS s, count(*) AS n FROM ({_EVERY}) z GROUP BY 1) e ON u.use_case_id = e.use_case_id WHERE u.status = 'active') x"""),
    *[Query(f"c04_catalogue_{k}", lambda t, k=k: C.object_catalogue(t.usage, k, LAST_DAY), _CATALOGUE.format(i=i, n=n, t=k, since=f"{LAST} - 90")) for k, (i, n) in _IDS.items()],
    Query("c05_query_catalogue", lambda t: C.query_catalogue(t.query_history, LAST_DAY), f"""
SELECT statement_id AS object_id, substr(statement_text, 1, 100) AS object_name, workspace_id, 'query' AS object_type FROM qh WHERE as_user IS NOT NULL AND start_time >= {LAST} - 30
ORDER BY start_time DESC, statement_id LIMIT 100"""),
    Query("c05_query_catalogue_next_page", _next_statements, f"""
SELECT statement_id AS object_id, substr(statement_text, 1, 100) AS object_name, workspace_id, 'query' AS object_type FROM qh WHERE as_user IS NOT NULL AND start_time >= {LAST} - 30
ORDER BY start_time DESC, statement_id LIMIT 100 OFFSET 100"""),
    Query("c05_dashboard_catalogue", lambda t: C.dashboard_catalogue(t.dashboards),
          f"SELECT 'dash-' || s_suppkey AS object_id, s_name AS object_name, {whole('s_nationkey', 'workspace_id')}, 'dashboard' AS object_type FROM supplier ORDER BY s_name, 1 LIMIT 100"),
    Query("c06_use_case_list", lambda t: _tags_as_text(C.use_case_list(t.use_cases, status="active")), _LIST + " WHERE status = 'active'"),
    Query("c06_use_case_list_by_stage", lambda t: _tags_as_text(C.use_case_list(t.use_cases, status="active", stage="Production")), _LIST + " WHERE status = 'active' AND stage = 'Production'"),
    Query("c07_use_case_tags", lambda t: C.use_case_tags(t.use_cases), """
SELECT tag_key, CAST(0 AS BIGINT) AS part, string_agg(v, '|' ORDER BY v) AS tag_values FROM (SELECT DISTINCT 'segment' AS tag_key, tag_segment AS v FROM uc WHERE status = 'active' AND tag_segment IS NOT NULL
  UNION ALL SELECT DISTINCT 'region', tag_region FROM uc WHERE status = 'active' AND tag_region IS NOT NULL) x GROUP BY 1"""),
    Query("c08_use_case", lambda t: _tags_as_text(C.use_case(t.use_cases, UC)), _LIST + f" WHERE use_case_id = '{UC}'"),
    Query("c08_use_case_objects", lambda t: C.use_case_objects(t.use_case_objects, UC), f"""
SELECT mapping_id, object_type, object_id, object_id AS object_name, CAST(NULL AS VARCHAR) AS workspace_id, {stamp('assigned_at', 'assigned_at')}, 'admin' AS assigned_by, CAST(NULL AS VARCHAR) AS notes,
  custom_start AS custom_start_date, custom_end AS custom_end_date FROM uco WHERE use_case_id = '{UC}'"""),
]
