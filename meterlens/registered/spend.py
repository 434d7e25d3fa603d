"""Registered queries: kernels (k) and spend overview (s)."""

from pyspark.sql import functions as F

from meterlens.functions import classify as C
from meterlens.functions import machines as M
from meterlens.functions.shape import share_of_total
from meterlens.operators import pricing as P
from meterlens.plans import spend as S
from meterlens.registered import labels_sql as L
from meterlens.registered.inputs_sql import AFTER, FIRST, LAST
from meterlens.registered.query import SUMS, Query, num, stamp, whole
from meterlens.sources.values import DAY_AFTER, FIRST_DAY, LAST_DAY

W = (FIRST_DAY, LAST_DAY)


def _collapsed(t):
    offering = F.col("product_features.model_serving.offering_type").alias("offering_type")
    return P.metered(t.usage, t.list_prices, *W, ["billing_origin_product", "sku_name", P.has_pipeline(), offering])


def _labels(t, **labels):
    return _collapsed(t).groupBy("billing_origin_product", "sku_name", *[c.alias(n) for n, c in labels.items()]).agg(
        F.sum("records").alias("records"))


def _label_sql(where="TRUE", **labels):
    shown = ", ".join(f"{e} AS {n}" for n, e in labels.items())
    return f"SELECT product AS billing_origin_product, sku_name, {shown}, {whole('count(*)', 'records')} FROM pu WHERE {where} GROUP BY ALL"


def _as_of(t):
    rows = P.with_price_as_of(P.in_window(t.usage, *W), t.price_history, DAY_AFTER)
    return rows.groupBy("sku_name").agg(
        F.count("*").alias("matches"), F.count("as_of_price").alias("priced"),
        F.sum(F.col("usage_quantity") * F.col("as_of_price")).alias("spend"))


def _machines(t):
    priced = [t.clusters.select("cluster_id", F.lit(c).alias("cloud"), F.col("driver_node_type").alias("machine"))
              for c in ("AWS", "AZURE", "GCP", "OTHER")]
    rows = priced[0].unionByName(priced[1]).unionByName(priced[2]).unionByName(priced[3])
    counted = rows.groupBy("cloud", "machine", C.instance_family(F.col("machine"), F.col("cloud")).alias("instance_family")).agg(
        F.count("*").alias("n"))
    return M.with_hourly_price(counted, t.machine_prices, "machine", F.col("cloud"), "hourly_cost")


_MACHINES_SQL = f"""
SELECT cloud, machine, CASE WHEN cloud = 'AWS' AND machine = 'i3.xlarge' THEN 0.312 WHEN cloud = 'AWS' AND machine = 'm5.2xlarge' THEN 0.384
    WHEN cloud = 'AWS' AND machine = 'r7i.4xlarge' THEN 1.0584 WHEN cloud = 'AZURE' AND machine = 'Standard_D8s_v3' THEN 0.384
    WHEN cloud = 'GCP' AND machine = 'n2-standard-8' THEN 0.3885 WHEN cloud = 'OTHER' AND machine = 'i3.xlarge' THEN 0.312
    WHEN cloud = 'OTHER' AND machine = 'm5.2xlarge' THEN 0.384 WHEN cloud = 'OTHER' AND machine = 'r7i.4xlarge' THEN 1.0584
    WHEN cloud = 'OTHER' AND machine = 'Standard_D8s_v3' THEN 0.384 ELSE 0.5 END::DOUBLE AS hourly_cost,
  CASE WHEN machine IS NULL THEN 'unknown' WHEN cloud = 'AZURE' THEN CASE WHEN machine = 'Standard_D8s_v3' THEN 'Standard_D' ELSE 'unknown' END
    WHEN cloud = 'GCP' THEN split_part(machine, '-', 1) ELSE split_part(machine, '.', 1) END AS instance_family,
  {whole('count(*)', 'n')}
FROM (SELECT driver AS machine, unnest(['AWS', 'AZURE', 'GCP', 'OTHER']) AS cloud FROM cl_log) x GROUP BY ALL"""

_SPLIT = f"""
SELECT {{shown}} FROM (
  SELECT {{cat}} AS product_category, {{key}} qty AS dbus, spend, workspace_id FROM pu WHERE product <> 'SQL'
  UNION ALL SELECT 'SQL - ' || sql_product, {{key}} dbus, spend, NULL FROM a1) x GROUP BY ALL"""

_BY_PRODUCT = f"""
SELECT c.product_category, {num('sum(qty)', 'total_dbus')}, {num('sum(spend)', 'total_spend')}, {whole('count(DISTINCT workspace_id)', 'workspace_count')}
FROM (SELECT {L.CATEGORY} AS product_category, qty, spend, workspace_id FROM pu WHERE product <> 'SQL') c GROUP BY 1
UNION ALL
SELECT 'SQL - ' || a.sql_product, {num('sum(dbus)', 'd')}, {num('sum(spend)', 's')}, max(n) FROM a1 a
JOIN (SELECT a1.sql_product, {whole('count(DISTINCT s.workspace_id)', 'n')} FROM a1 JOIN (SELECT DISTINCT usage_date, warehouse_id, workspace_id FROM pu WHERE product = 'SQL') s
  ON a1.usage_date = s.usage_date AND a1.warehouse_id = s.warehouse_id GROUP BY 1) w ON a.sql_product = w.sql_product GROUP BY a.sql_product"""

_WS = "3"
_BY_PRODUCT_WS = f"""
SELECT product_category, {num('sum(dbus)', 'total_dbus')}, {num('sum(spend)', 'total_spend')}, {whole('max(n)', 'workspace_count')} FROM (
  SELECT {L.CATEGORY} AS product_category, sum(qty) AS dbus, sum(spend) AS spend, count(DISTINCT workspace_id) AS n FROM pu
  WHERE product <> 'SQL' AND workspace_id = {_WS} GROUP BY 1
  UNION ALL
  SELECT 'SQL - ' || w.sql_product, sum(CAST(w.work_ms AS DOUBLE) / t.total * CAST(c.dbus AS DOUBLE)), sum(CAST(w.work_ms AS DOUBLE) / t.total * CAST(c.spend AS DOUBLE)), count(DISTINCT c.workspace_id)
  FROM work w JOIN (SELECT usage_date, warehouse_id, sum(work_ms) AS total FROM work GROUP BY 1, 2) t ON w.usage_date = t.usage_date AND w.warehouse_id = t.warehouse_id
  LEFT JOIN (SELECT usage_date, warehouse_id, workspace_id, sum(qty) AS dbus, sum(spend) AS spend FROM pu WHERE product = 'SQL' AND workspace_id = {_WS} GROUP BY 1, 2, 3) c
    ON w.usage_date = c.usage_date AND w.warehouse_id = c.warehouse_id GROUP BY 1) x GROUP BY 1"""

_TOP3 = """(SELECT workspace_id, string_agg({name}, '|' ORDER BY rn) AS {alias} FROM (
    SELECT workspace_id, {name}, row_number() OVER (PARTITION BY workspace_id ORDER BY s DESC, {name}) AS rn
    FROM (SELECT workspace_id, {name}, sum(spend) AS s FROM pu WHERE {name} IS NOT NULL GROUP BY 1, 2) a) b WHERE rn <= 3 GROUP BY 1)"""

_OBJECTS = """
SELECT {kind} AS object_type, {oid} AS object_id, {name} AS object_name, max(workspace_id) AS workspace_id, CAST(NULL AS VARCHAR) AS object_state,
  {owner} AS owner, {sums}, {runs}, ({name} = {oid}) AS is_historical
FROM {source} WHERE product IN ('JOBS', 'DLT') GROUP BY ALL ORDER BY sum(spend) DESC, 1, 2, 3 LIMIT 100"""
_KIND = "CASE WHEN u.pipeline_id IS NOT NULL THEN 'SDP Pipeline' ELSE 'Job' END"
_OID = "coalesce(u.pipeline_id, job_id)"
_RUNS = whole("count(DISTINCT job_run_id)", "total_runs")

_INTERACTIVE = f"""
SELECT p.cluster_id, c.cluster_name, p.notebook_path, p.run_as AS run_as_user, max(p.workspace_id) AS workspace_id, CAST(NULL AS VARCHAR) AS cluster_state,
  sum(qty) AS d, sum(spend) AS s, {whole('count(DISTINCT usage_date)', 'days_active')}, {whole('count(DISTINCT notebook_id)', 'notebook_count')}
FROM pu p LEFT JOIN cl_now c ON p.cluster_id = c.cluster_id
WHERE product = 'ALL_PURPOSE' GROUP BY 1, 2, 3, 4"""


def _interactive(t, limit=None):
    return S.interactive_breakdown(t.usage, t.list_prices, t.clusters, *W, limit=limit)


def _view_sql(column, missing):
    best = "(SELECT {c} FROM i x WHERE coalesce(x." + column + f", '{missing}') = k.key AND x.{{c}} IS NOT NULL ORDER BY s DESC, cluster_id DESC, notebook_path DESC, run_as_user DESC NULLS LAST LIMIT 1)"
    return f"""SELECT key, {best.format(c='workspace_id')} AS workspace_id, {best.format(c='cluster_name')} AS cluster_name,
  {best.format(c='run_as_user')} AS "user", {num('d', 'total_dbus')}, {num('s', 'total_spend')}, days_active, "count",
  {num('100.0 * CAST(s AS DOUBLE) / (SELECT CAST(sum(s) AS DOUBLE) FROM i)', 'percentage')}
FROM (SELECT coalesce({column}, '{missing}') AS key, sum(d) AS d, sum(s) AS s, max(days_active) AS days_active, {whole('count(*)', '"count"')} FROM i GROUP BY 1) k"""


_SKUS = """
SELECT sku_name AS product, {n}, {sums}, round(100.0 * CAST(sum(spend) AS DOUBLE) / (SELECT CAST(sum(spend) AS DOUBLE) FROM pu WHERE {where}), 2) AS percentage
FROM pu WHERE {where} GROUP BY 1 ORDER BY sum(spend) DESC, 1 LIMIT 100"""
_GROUPS = f"""
SELECT *, coalesce(round(100.0 * total_spend / sum(total_spend) OVER (), 1), 0) AS percentage FROM (
  SELECT coalesce(g.group_name, 'No Group') AS group_name, {num('sum(s)', 'total_spend')}, {num('sum(d)', 'total_dbus')}, {whole('count(DISTINCT u.run_as)', 'user_count')}
  FROM (SELECT run_as, sum(qty) AS d, sum(spend) AS s FROM pu WHERE run_as IS NOT NULL GROUP BY 1 HAVING sum(spend) > 0) u
  LEFT JOIN ug g ON u.run_as = g.user_email GROUP BY 1) x ORDER BY total_spend DESC, group_name LIMIT 15"""
_WIDE = ["SQL", "ETL - Streaming", "ETL - Batch", "Interactive", "Serverless", "Model Serving", "Other"]

QUERIES = [
    Query("k01_priced_usage", lambda t: P.priced_usage(t.usage, t.list_prices, *W).select(
        "usage_date", "workspace_id", "sku_name", "cloud", "usage_quantity", "price", "spend"),
        f"SELECT usage_date, workspace_id, sku_name, cloud, {num('qty', 'usage_quantity')}, {num('unit_price', 'price')}, {num('spend', 'spend')} FROM pu"),
    Query("k02_effective_price", lambda t: t.price_history.select(
        "sku_name", "cloud", P.effective_price().alias("effective_price"), "price_start_time"),
        f"SELECT sku_name, cloud, {num('effective', 'effective_price')}, {stamp('start_time', 'price_start_time')} FROM price_history"),
    Query("k03_price_as_of", _as_of, f"""
SELECT u.sku_name, {whole('count(*)', 'matches')}, {whole('count(p.price)', 'priced')}, {num('sum(u.qty * p.price)', 'spend')}
FROM pu u LEFT JOIN price_history p ON u.sku_name = p.sku_name AND u.cloud = p.cloud AND u.usage_unit = p.usage_unit
 AND u.usage_end_time >= p.start_time AND (p.end_time IS NULL AND u.usage_end_time <= CAST({AFTER} + 1 AS TIMESTAMP) OR u.usage_end_time <= p.end_time) GROUP BY 1"""),
    Query("k04_product_category", lambda t: _labels(t, category=C.product_category()), _label_sql(category=L.CATEGORY)),
    Query("k05_series_category", lambda t: _labels(t, category=C.series_category()), _label_sql(category=L.SERIES)),
    Query("k06_non_sql_category", lambda t: _labels(t, category=C.non_sql_category()).filter(F.col("billing_origin_product") != "SQL"),
          _label_sql("product <> 'SQL'", category=L.CATEGORY)),
    Query("k07_group_report_category", lambda t: _labels(t, category=C.group_report_category()), _label_sql(category=L.GROUP_REPORT)),
    Query("k08_etl_type", lambda t: _labels(t, etl_type=C.etl_type()), _label_sql(etl_type=L.ETL)),
    Query("k09_aiml_category", lambda t: _labels(t, category=F.when(C.is_aiml(), C.aiml_category())),
          _label_sql(category=f"CASE WHEN {L.IS_AIML} THEN {L.AIML} END")),
    Query("k10_aiml_series_category", lambda t: _labels(t, category=F.when(C.is_aiml(), C.aiml_series_category())),
          _label_sql(category=f"CASE WHEN {L.IS_AIML} THEN {L.AIML_SERIES} END")),
    Query("k11_model_type", lambda t: _labels(t, model_type=C.model_type()), _label_sql(model_type=L.MODEL_TYPE)),
    Query("k12_agent_type", lambda t: t.usage.groupBy(P.meta("endpoint_name")).agg(F.count("*").alias("records")).withColumn(
        "agent_type", C.agent_type(F.col("endpoint_name"))),
        f"SELECT endpoint_name, {whole('count(*)', 'records')}, {L.AGENT.format(name='endpoint_name')} AS agent_type FROM usage GROUP BY ALL"),
    Query("k13_client_source", lambda t: t.query_history.groupBy(
        "client_application", C.client_source_type(F.col("client_application"), F.col("statement_type")).alias("source_type"),
        C.client_source_id(F.col("client_application")).alias("source_id")).agg(F.count("*").alias("n")),
        f"""SELECT client AS client_application, CASE client WHEN 'Genie Space' THEN 'GENIE SPACE' WHEN 'dashboard/aibi-12' THEN 'AI/BI DASHBOARD' ELSE 'SQL QUERY' END AS source_type,
CASE client WHEN 'dashboard/aibi-12' THEN 'aibi-12' END AS source_id, {whole('count(*)', 'n')} FROM qh GROUP BY ALL"""),
    Query("k14_recorded_source", lambda t: t.query_history.groupBy(
        C.recorded_source_type().alias("source_type"), C.recorded_source_id().alias("source_id")).agg(F.count("*").alias("n")),
        f"""SELECT CASE source_no WHEN 0 THEN 'JOB' WHEN 1 THEN 'LEGACY DASHBOARD' WHEN 2 THEN 'AI/BI DASHBOARD' WHEN 3 THEN 'ALERT' WHEN 4 THEN 'NOTEBOOK'
  WHEN 5 THEN 'SQL QUERY' WHEN 6 THEN 'GENIE SPACE' ELSE coalesce(client, 'UNKNOWN') END AS source_type, coalesce(source_id, 'UNKNOWN') AS source_id, {whole('count(*)', 'n')} FROM qh GROUP BY ALL"""),
    Query("k17_has_tags", lambda t: t.usage.groupBy(C.has_tags().alias("tagged"), F.col("custom_tags").isNull().alias("no_map")).agg(F.count("*").alias("n")),
          """SELECT tagged, (NOT tagged AND odd) AS no_map, CAST(count(*) AS BIGINT) AS n FROM
(SELECT (l_returnflag = 'A' OR l_linestatus = 'F') AS tagged, l_linenumber % 2 = 1 AS odd FROM lineitem) x GROUP BY ALL"""),
    Query("k18_object_fields", lambda t: t.usage.groupBy(
        *[c.alias(n) for c, n in zip(C.object_fields(), ("object_id", "object_type", "object_name"))]).agg(F.count("*").alias("n")),
        f"""SELECT coalesce(cluster_id, warehouse_id, endpoint_name, pipeline_id, job_id, sku_name) AS object_id,
  CASE WHEN cluster_id IS NOT NULL THEN 'Cluster' WHEN warehouse_id IS NOT NULL THEN 'SQL Warehouse' WHEN endpoint_name IS NOT NULL THEN 'Serving Endpoint'
    WHEN pipeline_id IS NOT NULL THEN 'Pipeline' WHEN job_id IS NOT NULL THEN 'Job' ELSE 'Other' END AS object_type,
  coalesce(cluster_id, warehouse_id, endpoint_name, pipeline_id, job_name, sku_name) AS object_name, {whole('count(*)', 'n')} FROM usage GROUP BY ALL"""),
    Query("k19_machine_price_and_family", _machines, _MACHINES_SQL),
    Query("k23_share_of_total", lambda t: share_of_total(_collapsed(t).groupBy("billing_origin_product").agg(F.sum("spend").alias("s")), "s"),
          f"SELECT product AS billing_origin_product, {num('sum(spend)', 's')}, {num('100 * CAST(sum(spend) AS DOUBLE) / (SELECT CAST(sum(spend) AS DOUBLE) FROM pu)', 'percentage')} FROM pu GROUP BY 1"),
    Query("k25_historical_workspaces", lambda t: S.by_workspace(t.usage, t.list_prices, t.workspaces, *W).filter("is_historical").select("workspace_id", "total_spend"),
          f"SELECT p.workspace_id, {num('sum(spend)', 'total_spend')} FROM pu p LEFT JOIN ws w ON p.workspace_id = w.workspace_id WHERE w.workspace_name IS NULL GROUP BY 1"),
    Query("s01_account_info", lambda t: S.account_info(t.usage, LAST_DAY, 180),
          "SELECT account_id, min(cloud) AS cloud FROM usage GROUP BY 1"),
    Query("s02_billing_summary", lambda t: S.billing_summary(t.usage, t.list_prices, *W), f"""
SELECT {SUMS}, {whole('count(DISTINCT workspace_id)', 'workspace_count')}, {whole('count(DISTINCT usage_date)', 'days_in_range')},
  min(usage_date) AS first_date, max(usage_date) AS last_date, {num('CAST(sum(spend) AS DOUBLE) / count(DISTINCT usage_date)', 'avg_daily_spend')} FROM pu"""),
    Query("s03_by_product", lambda t: S.by_product(t.usage, t.list_prices, t.query_history, *W), _BY_PRODUCT),
    Query("s04_by_product_workspace", lambda t: S.by_product(t.usage, t.list_prices, t.query_history, *W, workspace_id=_WS), _BY_PRODUCT_WS),
    Query("s05_by_product_fast", lambda t: S.by_product_fast(t.usage, t.list_prices, *W),
          f"SELECT {L.CATEGORY} AS product_category, {SUMS}, {whole('count(DISTINCT workspace_id)', 'workspace_count')} FROM pu GROUP BY 1"),
    Query("s06_by_workspace", lambda t: S.by_workspace(t.usage, t.list_prices, t.workspaces, *W), f"""
SELECT t.workspace_id, w.workspace_name, t.total_dbus, t.total_spend, a.top_products, b.top_users, w.workspace_name IS NULL AS is_historical
FROM (SELECT workspace_id, {SUMS} FROM pu GROUP BY 1) t LEFT JOIN ws w ON t.workspace_id = w.workspace_id
LEFT JOIN {_TOP3.format(name='product', alias='top_products')} a ON t.workspace_id = a.workspace_id
LEFT JOIN {_TOP3.format(name='run_as', alias='top_users')} b ON t.workspace_id = b.workspace_id"""),
    Query("s07_timeseries", lambda t: S.timeseries(t.usage, t.list_prices, t.query_history, *W), _SPLIT.format(
        cat=L.SERIES, key="usage_date,", shown=f"usage_date, product_category, {num('sum(dbus)', 'total_dbus')}, {num('sum(spend)', 'total_spend')}")),
    Query("s08_timeseries_fast", lambda t: S.timeseries_fast(t.usage, t.list_prices, *W),
          f"SELECT usage_date, {L.SERIES} AS product_category, {SUMS} FROM pu GROUP BY 1, 2"),
    Query("s09_timeseries_wide", lambda t: S.timeseries_wide(S.timeseries_fast(t.usage, t.list_prices, *W)),
          "SELECT usage_date AS date, " + ", ".join(num(f"sum(CASE WHEN {L.SERIES} = '{c}' THEN spend ELSE 0 END)", f'"{c}"') for c in _WIDE) + " FROM pu GROUP BY 1"),
    Query("s10_sql_tool_totals", lambda t: S.sql_tool_totals(t.usage, t.list_prices, t.query_history, *W),
          f"SELECT sql_product, {num('sum(dbus)', 'total_dbus')}, {num('sum(spend)', 'total_spend')} FROM a1 GROUP BY 1"),
    Query("s11_pipeline_objects", lambda t: S.pipeline_objects(t.usage, t.list_prices, *W), _OBJECTS.format(
        kind=_KIND, oid=_OID, name="coalesce(job_name, u.pipeline_id, job_id)", owner="max(run_as)", sums=SUMS, runs=_RUNS, source="pu u")),
    Query("s12_pipeline_objects_enriched", lambda t: S.pipeline_objects(t.usage, t.list_prices, *W, pipelines=t.pipelines), _OBJECTS.format(
        kind=_KIND, oid=_OID, name="coalesce(n.name, u.pipeline_id, job_name, job_id)", owner="coalesce(max(n.creator), max(run_as))", sums=SUMS, runs=_RUNS,
        source="pu u LEFT JOIN pl_now n ON u.pipeline_id = n.pipeline_id")),
    Query("s12b_fill_pipeline_names", lambda t: S.fill_pipeline_names(S.pipeline_objects(t.usage, t.list_prices, *W), t.pipelines), _OBJECTS.format(
        kind=_KIND, oid=_OID, name="coalesce(n.name, u.pipeline_id, job_name, job_id)", owner="max(run_as)", sums=SUMS, runs=_RUNS,
        source="pu u LEFT JOIN pl_now n ON u.pipeline_id = n.pipeline_id")),
    Query("s13_etl_breakdown", lambda t: S.etl_breakdown(t.usage, t.list_prices, *W),
          f"SELECT {L.ETL} AS etl_type, {SUMS} FROM pu WHERE {L.IS_ETL} GROUP BY 1"),
    Query("s14_interactive_breakdown", lambda t: _interactive(t, 100),
          f"SELECT * EXCLUDE (d, s), {num('d', 'total_dbus')}, {num('s', 'total_spend')} FROM ({_INTERACTIVE} ORDER BY s DESC, p.cluster_id, p.notebook_path, p.run_as NULLS LAST LIMIT 100) i"),
    *[Query(f"s15_interactive_by_{v}", lambda t, v=v: S.interactive_by(_interactive(t), v),
            f"SELECT * FROM (WITH i AS ({_INTERACTIVE}) {_view_sql(*S.INTERACTIVE_VIEWS[v])}) r") for v in S.INTERACTIVE_VIEWS],
    Query("s16_sku_breakdown", lambda t: S.sku_breakdown(t.usage, t.list_prices, *W),
          _SKUS.format(n=whole("count(DISTINCT workspace_id)", "workspaces_using"), sums=SUMS, where="TRUE")),
    Query("s16_sku_breakdown_workspace", lambda t: S.sku_breakdown(t.usage, t.list_prices, *W, workspace_id=_WS),
          _SKUS.format(n=whole("count(DISTINCT workspace_id)", "workspaces_using"), sums=SUMS, where=f"workspace_id = {_WS}")),
    Query("s17_spend_by_user", lambda t: S.spend_by_user(t.usage, t.list_prices, *W), f"""
SELECT run_as AS group_name, {SUMS}, CAST(1 AS BIGINT) AS user_count FROM pu WHERE run_as IS NOT NULL GROUP BY 1 HAVING sum(spend) > 0
ORDER BY sum(spend) DESC, 1 LIMIT 15"""),
    Query("s18_spend_by_group", lambda t: S.spend_by_group(t.usage, t.list_prices, t.user_groups, *W), _GROUPS),
    Query("s19_latest_day_workspaces", lambda t: S.latest_day_workspace_count(t.usage, *W),
          f"SELECT {whole('count(DISTINCT workspace_id)', 'workspace_count')} FROM pu WHERE usage_date = (SELECT max(usage_date) FROM pu)"),
    Query("s20_monthly_consumption", lambda t: S.monthly_consumption(t.usage, t.list_prices, *W),
          f"SELECT CAST(date_trunc('month', usage_date) AS DATE) AS month, {SUMS} FROM pu GROUP BY 1"),
    Query("s20_go_live_markers", lambda t: S.go_live_markers(t.use_cases, *W),
          f"SELECT use_case_id, name, live_date FROM uc WHERE status = 'active' AND live_date BETWEEN {FIRST} AND {LAST}"),
]
