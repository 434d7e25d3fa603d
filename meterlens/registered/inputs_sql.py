"""The inputs as ANSI SQL over the test tables, for checking the Spark results in another engine.

Flat columns here where the Spark inputs are nested.  ``with_inputs`` puts the
common table expressions a statement mentions in front of it.
"""

from __future__ import annotations

import re

from meterlens.sources import values as V

FIRST, LAST, AFTER = (f"DATE '{d}'" for d in (V.FIRST_DAY, V.LAST_DAY, V.DAY_AFTER))


def _list(items) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]"


SKU_NAMES, SKU_PRODUCTS = _list(s for s, _ in V.SKUS), _list(p for _, p in V.SKUS)
CLOUDS, ENDPOINTS, NODES = _list(V.CLOUDS), _list(V.ENDPOINTS), _list(V.NODE_TYPES)


def fold(column: str) -> str:
    return f"CAST({FIRST} + CAST(datediff('day', DATE '1995-01-01', {column}) % 180 AS INTEGER) AS DATE)"


CTES = {
    "usage": f"""
SELECT 'acct-1' AS account_id,
  CAST(CASE WHEN product = 'SQL' THEN l_partkey % 8 ELSE c_nationkey END AS BIGINT) AS workspace_id,
  {CLOUDS}[CAST(l_suppkey % 3 AS INTEGER) + 1] AS cloud, {SKU_NAMES}[k + 1] AS sku_name, product, usage_date,
  CAST(usage_date AS TIMESTAMP) + to_hours(CAST((l_linenumber * 3 + l_suppkey) % 24 AS INTEGER)) AS usage_start_time,
  CAST(usage_date AS TIMESTAMP) + to_hours(CAST((l_linenumber * 3 + l_suppkey) % 24 AS INTEGER) + 1) AS usage_end_time,
  CAST(l_quantity - 1 AS DECIMAL(18,4)) AS qty, 'DBU' AS usage_unit,
  CASE WHEN k IN (13, 21) THEN 'STORAGE_SPACE' ELSE 'COMPUTE_TIME' END AS usage_type,
  CASE WHEN l_returnflag = 'A' THEN c_mktsegment END AS tag_team,
  CASE WHEN l_linestatus = 'F' THEN o_orderpriority END AS tag_env,
  (l_returnflag = 'A' OR l_linestatus = 'F') AS tagged,
  CASE WHEN l_tax <> 0 THEN 'user' || o_custkey || '@example.com' END AS run_as,
  CASE WHEN product IN ('MODEL_SERVING', 'VECTOR_SEARCH') AND l_partkey % 5 = 0 THEN 'BATCH_INFERENCE' END AS offering,
  CASE WHEN product IN ('ALL_PURPOSE', 'JOBS') THEN 'cl-' || ((l_partkey * 3 + l_suppkey) % 40) END AS cluster_id,
  CASE WHEN product = 'SQL' THEN 'wh-' || (l_partkey % 8) END AS warehouse_id,
  CASE WHEN product = 'JOBS' THEN 'job-' || (l_partkey % 30) END AS job_id,
  CASE WHEN product = 'JOBS' THEN CAST(l_orderkey AS VARCHAR) END AS job_run_id,
  CASE WHEN product = 'JOBS' AND l_partkey % 30 < 25 THEN 'Job ' || (l_partkey % 30) END AS job_name,
  CASE WHEN product = 'DLT' THEN 'pl-' || (l_partkey % 12) END AS pipeline_id,
  CASE WHEN product = 'ALL_PURPOSE' THEN '/nb/' || (l_partkey % 25) END AS notebook_path,
  CASE WHEN product = 'ALL_PURPOSE' THEN 'nb-' || (l_partkey % 25) END AS notebook_id,
  CASE WHEN product IN ('MODEL_SERVING', 'AGENT_BRICKS') AND l_partkey % 10 <> 9
       THEN {ENDPOINTS}[CAST(l_partkey % 9 AS INTEGER) + 1] END AS endpoint_name,
  CASE WHEN product IN ('MODEL_SERVING', 'AGENT_BRICKS') THEN 'ep-' || (l_partkey % 9) END AS endpoint_id,
  CASE WHEN product = 'APPS' AND l_partkey % 11 <> 10 THEN 'app-' || (l_partkey % 10) END AS app_id
FROM (SELECT *, {SKU_PRODUCTS}[CAST((l_partkey + l_linenumber) % 24 AS INTEGER) + 1] AS product,
        CAST((l_partkey + l_linenumber) % 24 AS INTEGER) AS k, {fold('l_shipdate')} AS usage_date
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey) b""",
    "prices": f"""
SELECT {SKU_NAMES}[CAST(k AS INTEGER) + 1] AS sku_name, c AS cloud,
  CAST((k + 1) * CAST(0.05 AS DECIMAL(4,2)) AS DECIMAL(12,6)) AS price,
  CAST((k + 1) * CAST(0.04 AS DECIMAL(4,2)) AS DECIMAL(12,6)) AS effective
FROM (SELECT CAST(unnest(range(24)) AS INTEGER) AS k) a CROSS JOIN (SELECT unnest({CLOUDS}) AS c) b
WHERE k <> {V.UNPRICED_SKU}""",
    "pu": f"""
SELECT u.*, p.price IS NOT NULL AS has_price, CAST(coalesce(p.price, 0) AS DECIMAL(12,6)) AS unit_price,
  u.qty * CAST(coalesce(p.price, 0) AS DECIMAL(12,6)) AS spend,
  u.qty * CAST(coalesce(p.effective, p.price, 0) AS DECIMAL(12,6)) AS eff_spend
FROM usage u LEFT JOIN prices p ON u.sku_name = p.sku_name AND u.cloud = p.cloud
WHERE u.usage_date BETWEEN {FIRST} AND {LAST} AND u.qty > 0""",
    "price_history": f"""
SELECT {SKU_NAMES}[CAST(k AS INTEGER) + 1] AS sku_name, c AS cloud, 'USD' AS currency_code, 'DBU' AS usage_unit,
  CAST((k + 1) * CAST(0.05 AS DECIMAL(4,2)) + v * CAST(0.01 AS DECIMAL(4,2)) AS DECIMAL(12,6)) AS price,
  CAST((k + 1) * CAST(0.04 AS DECIMAL(4,2)) + v * CAST(0.01 AS DECIMAL(4,2)) AS DECIMAL(12,6)) AS effective,
  CAST({FIRST} + CAST(v * 45 AS INTEGER) AS TIMESTAMP) AS start_time,
  CASE WHEN NOT (v = 3 OR (v = 2 AND k % 12 = 5)) THEN CAST({FIRST} + CAST((v + 1) * 45 AS INTEGER) AS TIMESTAMP) END AS end_time
FROM (SELECT DISTINCT CAST(p_partkey % 24 AS INTEGER) AS k, CAST((p_partkey // 24) % 4 AS INTEGER) AS v FROM part) a
CROSS JOIN (SELECT unnest({CLOUDS}) AS c) b WHERE k <> {V.UNPRICED_SKU}""",
    "account_prices": f"""
SELECT {SKU_NAMES}[k + 1] AS sku_name, c AS cloud, 'USD' AS currency_code, 'DBU' AS usage_unit,
  CAST((k + 1) * CAST(0.04 AS DECIMAL(4,2)) AS DECIMAL(12,6)) AS price,
  CAST((k + 1) * CAST(0.03 AS DECIMAL(4,2)) AS DECIMAL(12,6)) AS effective,
  TIMESTAMP '2023-01-01 00:00:00' AS start_time, CAST(NULL AS TIMESTAMP) AS end_time
FROM (SELECT DISTINCT CAST(p_partkey % 24 AS INTEGER) AS k FROM part) a
CROSS JOIN (SELECT unnest({CLOUDS}) AS c) b WHERE k % 2 = 0""",
    "qh": """
SELECT CAST(user_id % 8 AS BIGINT) AS workspace_id, 'st-' || event_id AS statement_id,
  'SELECT * FROM t' || (event_id % 100) || ' WHERE kind = ''' || event_type || ''' --' || repeat('x', CAST(event_id % 250 AS INTEGER)) AS statement_text,
  CASE WHEN event_id % 53 = 0 THEN 'CANCEL' WHEN event_id % 59 <> 0 THEN 'SELECT' END AS statement_type,
  CASE WHEN event_id % 31 <> 0 THEN CASE WHEN user_id % 3 = 0 THEN 'sp-' || user_id ELSE 'user' || user_id || '@example.com' END END AS executed_by,
  CASE WHEN event_id % 67 <> 0 THEN 'id-' || user_id END AS as_user,
  CASE event_type WHEN 'view' THEN 'Genie Space' WHEN 'click' THEN 'SQL Editor' WHEN 'purchase' THEN 'dashboard/aibi-12'
    WHEN 'error' THEN 'mcp-client' END AS client,
  CASE WHEN event_id % 61 <> 0 THEN 'wh-' || (user_id % 8) END AS warehouse_id,
  ts AS start_time,
  make_timestamp(epoch_us(ts) + (CAST(round(value * 1000) AS BIGINT) + CASE WHEN event_id % 37 = 0 THEN 10800000 ELSE 0 END) * 1000) AS end_time,
  CASE WHEN event_id % 43 = 0 THEN 0 WHEN event_id % 41 <> 0 THEN CAST(round(value * 1000) AS BIGINT) END AS task_ms,
  CASE WHEN event_id % 5 <> 0 THEN event_id % 13 * 20 END AS fetch_ms,
  CASE WHEN event_id % 6 <> 0 THEN event_id % 7 * 100 END AS compile_ms,
  event_id % 11 * 50 AS capacity_ms,
  CASE WHEN event_id % 4 <> 0 THEN event_id % 3 * 400 END AS compute_ms,
  CASE WHEN event_id % 19 <> 0 THEN event_id * 7 % 100000 END AS read_rows,
  CASE WHEN event_id % 19 <> 0 THEN event_id * 7 % 100000 * 128 END AS read_bytes,
  event_id % 8 AS source_no,
  CASE WHEN event_id % 8 = 0 THEN 'job-' || (event_id % 30)
       WHEN event_id % 8 < 7 THEN ['legacy_dashboard_id-', 'dashboard_id-', 'alert_id-', 'notebook_id-', 'sql_query_id-', 'genie_space_id-'][CAST(event_id % 8 AS INTEGER)] || (event_id % 100) END AS source_id,
  CASE WHEN (event_type = 'error' AND event_id % 3 = 0) OR event_id % 29 = 0 THEN 'ide' END AS tag_tool,
  CASE WHEN NOT ((event_type = 'error' AND event_id % 3 = 0) OR event_id % 29 = 0) AND event_type = 'error' AND event_id % 3 = 1 THEN 'MCP' END AS tag_origin
FROM events""",
    "wev": """
SELECT 'wh-' || ((event_id // 4) % 9) AS warehouse_id, ts AS event_time,
  CAST(CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 + event_id % 3 END AS INTEGER) AS cluster_count
FROM events""",
    "wh_log": f"""
SELECT 'wh-' || (s_suppkey % 9) AS warehouse_id,
  CASE WHEN s_suppkey % 9 <> 7 THEN 'Warehouse ' || (s_suppkey % 9) || ' rev ' || s_suppkey END AS warehouse_name,
  {_list(V.WAREHOUSE_SIZES)}[CAST(s_suppkey % 5 AS INTEGER) + 1] AS warehouse_size,
  CAST((s_suppkey % 9) % 8 AS BIGINT) AS workspace_id,
  CASE WHEN s_suppkey % 9 <> 6 THEN {_list(V.WAREHOUSE_TYPES)}[CAST((s_suppkey + 1) % 3 AS INTEGER) + 1] END AS warehouse_type,
  s_suppkey % 9 = 5 AS deleted, 1690000000 + s_suppkey * 60 AS change_time
FROM supplier""",
    "cl_log": f"""
SELECT 'cl-' || (p_partkey % 37) AS cluster_id,
  CASE WHEN p_partkey % 37 <> 30 THEN 'Cluster ' || (p_partkey % 37) || ' rev ' || ((p_partkey // 37) % 3) END AS cluster_name,
  CASE WHEN p_partkey % 37 <> 31 THEN {NODES}[CAST(p_partkey % 7 AS INTEGER) + 1] END AS driver,
  CASE WHEN p_partkey % 37 <> 32 THEN {NODES}[CAST((p_partkey // 7) % 7 AS INTEGER) + 1] END AS worker,
  CASE WHEN (p_partkey % 37) % 2 = 0 THEN 'UI' ELSE 'JOB' END AS cluster_source,
  'user' || (p_partkey % 37) || '@example.com' AS owned_by, p_partkey % 37 = 33 AS deleted,
  CASE (p_partkey % 37) % 5 WHEN 0 THEN '14.3.x-cpu-ml-scala2.12' WHEN 1 THEN '15.1.x-GPU-ML-x' WHEN 4 THEN NULL ELSE '14.3.x-scala2.12' END AS dbr_version,
  1690000000 + p_partkey * 60 AS change_time
FROM part""",
    "cl_now": """
SELECT cluster_id, cluster_name, driver, worker, cluster_source
FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY change_time DESC) AS rn FROM cl_log) x WHERE rn = 1""",
    "wh_now": """
SELECT warehouse_id, warehouse_name, warehouse_size, workspace_id, warehouse_type
FROM (SELECT *, row_number() OVER (PARTITION BY warehouse_id ORDER BY change_time DESC) AS rn FROM wh_log) x WHERE rn = 1""",
    "pl_table": """
SELECT CASE WHEN p_partkey % 12 = 11 THEN 'pl-gone' ELSE 'pl-' || (p_partkey % 12) END AS pipeline_id,
  'Pipeline ' || (p_partkey % 12) AS name, 'owner' || (p_partkey % 12) || '@example.com' AS creator,
  p_partkey % 12 IN (3, 7) AS deleted FROM part""",
    "pl_now": "SELECT pipeline_id, max(name) AS name, max(creator) AS creator FROM pl_table WHERE NOT deleted GROUP BY 1",
    "job_now": """
SELECT CASE WHEN p_partkey % 30 = 29 THEN 'job-gone' ELSE 'job-' || (p_partkey % 30) END AS job_id,
  max('Nightly ' || (p_partkey % 30)) AS name FROM part WHERE p_partkey % 30 NOT IN (4, 9) GROUP BY 1""",
    "runs": f"""
SELECT {fold('o_orderdate')} AS day, CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'O' THEN 'FAILED' ELSE 'CANCELLED' END AS result_state
FROM orders""",
    "ws": "SELECT CAST(n_nationkey AS BIGINT) AS workspace_id, n_name AS workspace_name FROM nation WHERE n_nationkey < 22",
    "ug": """
SELECT 'user' || c_custkey || '@example.com' AS user_email, unnest(CASE WHEN c_custkey % 10 = 0 THEN [c_mktsegment, 'ADMINS'] ELSE [c_mktsegment] END) AS group_name
FROM customer WHERE c_custkey % 7 <> 0""",
    "apps_reg": """
SELECT DISTINCT CASE WHEN s_suppkey % 8 = 7 THEN 'app-unused' ELSE 'app-' || (s_suppkey % 8) END AS app_id,
  'App ' || (s_suppkey % 8) AS name, 'https://apps.example.com/' || (s_suppkey % 8) AS url FROM supplier""",
    "uc": f"""
SELECT 'uc-' || c_custkey AS use_case_id, 'Use case ' || c_custkey AS name, 'For ' || c_name AS description,
  'owner' || c_nationkey || '@example.com' AS owner, make_timestamp((1690000000 + c_custkey * 3600) * 1000000) AS created_at,
  CASE WHEN c_acctbal >= 0 THEN 'active' ELSE 'archived' END AS status,
  CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS tag_segment,
  CASE WHEN c_custkey % 4 <> 0 THEN 'n' || (c_nationkey % 5) END AS tag_region,
  CASE WHEN c_custkey % 5 <> 0 THEN {_list(V.STAGES)}[CAST(c_custkey % 3 AS INTEGER) + 1] END AS stage,
  {FIRST} AS start_date, CAST(NULL AS DATE) AS end_date,
  CASE WHEN c_custkey % 3 = 0 THEN CAST({FIRST} + CAST(c_custkey % 200 AS INTEGER) AS DATE) END AS live_date
FROM customer""",
    "uco": f"""
SELECT 'map-' || c || '-' || t AS mapping_id, 'uc-' || c AS use_case_id, t AS object_type, o AS object_id,
  make_timestamp((1690000000 + c * 60) * 1000000) AS assigned_at,
  CASE WHEN c % 6 = 0 THEN CAST({FIRST} + CAST(c % 90 AS INTEGER) AS DATE) END AS custom_start,
  CASE WHEN c % 6 = 0 THEN CAST({FIRST} + CAST(90 + c % 179 AS INTEGER) AS DATE) END AS custom_end
FROM (SELECT c_custkey AS c, 1 AS n, 'cluster' AS t, 'cl-' || (c_custkey % 40) AS o FROM customer
  UNION ALL SELECT c_custkey, 2, 'warehouse', 'wh-' || (c_custkey % 8) FROM customer
  UNION ALL SELECT c_custkey, 3, 'job', 'job-' || (c_custkey % 30) FROM customer
  UNION ALL SELECT c_custkey, 4, 'endpoint', 'ep-' || (c_custkey % 9) FROM customer
  UNION ALL SELECT c_custkey, 5, 'pipeline', 'pl-' || (c_custkey % 12) FROM customer) x
WHERE n <= 1 + c % 5""",
    "invoice": f"""
SELECT l.*, p_type, p_brand, {fold('l_shipdate')} AS day, CAST(l_extendedprice AS DECIMAL(18,2)) AS cost,
  CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS net
FROM lineitem l JOIN part ON l_partkey = p_partkey""",
    "aws": f"""
SELECT day, CAST(day AS TIMESTAMP) + to_hours(CAST((l_linenumber * 3 + l_suppkey) % 24 AS INTEGER)) AS usage_hour,
  'acc-' || (l_suppkey % 5) AS account, 'region-' || (l_suppkey % 3) AS region, {NODES}[CAST(l_partkey % 7 AS INTEGER) + 1] AS instance_type,
  split_part({NODES}[CAST(l_partkey % 7 AS INTEGER) + 1], '.', 1) AS instance_family,
  CASE p_type WHEN 'ECONOMY' THEN 'Compute Instance' WHEN 'LARGE' THEN 'Storage Snapshot' WHEN 'MEDIUM' THEN 'Data Transfer'
    WHEN 'PROMO' THEN 'Network Gateway' WHEN 'SMALL' THEN 'Support' END AS family,
  CASE WHEN l_linenumber = 1 THEN 'Tax' WHEN l_linenumber = 2 AND l_partkey % 7 = 0 THEN NULL
    WHEN l_linenumber = 6 AND l_partkey % 3 = 0 THEN 'Fee' WHEN l_linenumber = 7 AND l_partkey % 3 = 0 THEN 'Credit'
    WHEN l_linenumber = 7 AND l_partkey % 3 = 1 THEN 'Refund' WHEN l_returnflag = 'A' THEN 'Usage'
    WHEN l_returnflag = 'N' THEN 'SavingsPlanCoveredUsage' ELSE 'DiscountedUsage' END AS line_type,
  CASE WHEN l_linenumber % 3 = 0 THEN 'cl-' || (l_partkey % 40) END AS cluster_id,
  CASE WHEN l_linenumber % 3 = 0 THEN 'Cluster ' || (l_partkey % 40) END AS cluster_name,
  CASE WHEN l_linenumber % 3 = 1 THEN 'wh-' || (l_partkey % 8) END AS warehouse_id,
  CASE WHEN l_linenumber % 3 = 2 THEN 'job-' || (l_partkey % 30) END AS job_id,
  'cc-' || (l_suppkey % 4) AS cost_center, CASE WHEN l_returnflag = 'A' THEN 'prod' END AS environment,
  CASE WHEN l_returnflag = 'R' THEN 'Reserved' ELSE 'OnDemand' END AS pricing_term,
  CAST(l_quantity AS DECIMAL(18,4)) AS usage_amount, l_orderkey, p_type,
  CASE WHEN l_partkey % 17 <> 0 THEN cost ELSE 0 END AS unblended,
  CASE WHEN l_partkey % 5 <> 0 THEN net WHEN l_partkey % 17 <> 0 THEN cost ELSE 0 END AS net_unblended, cost AS blended,
  CASE WHEN l_returnflag = 'R' THEN 1.25 WHEN l_returnflag = 'N' THEN 0.75 ELSE 0 END AS upfront,
  CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_partkey % 2 = 0 THEN 1.10 ELSE 1.25 END
       WHEN l_returnflag = 'N' THEN CASE WHEN l_partkey % 2 = 0 THEN 0.70 ELSE 0.75 END ELSE 0 END AS net_upfront,
  CASE WHEN l_returnflag = 'R' THEN net END AS ri_cost, CASE WHEN l_returnflag = 'N' THEN net END AS sp_cost
FROM invoice""",
    "silver": """
SELECT *, unblended + upfront AS amortized, net_unblended + net_upfront AS net_amortized,
  CASE WHEN line_type = 'Usage' THEN CASE WHEN family LIKE '%Compute%' THEN 'Compute' WHEN family LIKE '%Storage%' THEN 'Storage'
      WHEN family LIKE '%Data Transfer%' THEN 'Networking' WHEN family LIKE '%Network%' THEN 'Networking' ELSE 'Other' END
    WHEN line_type LIKE 'SavingsPlan%' THEN 'SavingsPlan' WHEN line_type = 'DiscountedUsage' THEN 'ReservedInstance'
    ELSE line_type END AS charge_type
FROM aws WHERE line_type <> 'Tax'""",
    "azure": f"""
SELECT day, 'sub-' || (l_suppkey % 3) AS subscription_id, 'rg-' || (l_suppkey % 4) AS resource_group,
  CASE p_type WHEN 'ECONOMY' THEN 'Virtual Machines' WHEN 'LARGE' THEN 'Storage' WHEN 'MEDIUM' THEN 'Bandwidth'
    WHEN 'PROMO' THEN 'Virtual Network' ELSE 'Functions' END AS meter_category,
  CASE p_type WHEN 'ECONOMY' THEN 'Compute' WHEN 'LARGE' THEN 'Storage' WHEN 'MEDIUM' THEN 'Networking'
    WHEN 'PROMO' THEN 'Networking' ELSE 'Other' END AS charge_type, p_type AS meter_subcategory,
  CASE WHEN l_returnflag = 'R' THEN 'Reservation' ELSE 'OnDemand' END AS pricing_model,
  CASE WHEN l_partkey % 4 <> 3 THEN {NODES}[CAST(l_partkey % 7 AS INTEGER) + 1] ELSE '' END AS vm_size,
  'cc-' || (l_suppkey % 4) AS cost_center,
  CASE WHEN l_linenumber % 3 = 0 THEN 'cl-' || (l_partkey % 40) END AS cluster_id,
  CASE WHEN l_linenumber % 3 = 1 THEN 'wh-' || (l_partkey % 8) END AS warehouse_id,
  CASE WHEN l_linenumber % 3 = 2 THEN 'job-' || (l_partkey % 30) END AS job_id,
  net AS cost_billing, cost AS cost_usd, CAST(l_quantity / 10 AS DECIMAL(18,4)) AS effective_price,
  CAST(l_quantity / 5 AS DECIMAL(18,4)) AS unit_price, CAST(l_quantity AS DECIMAL(18,4)) AS quantity
FROM invoice""",
    "gcp": f"""
SELECT day, p_type AS service, p_brand AS sku, 'prj-' || (l_suppkey % 6) AS project_id, 'Project ' || (l_suppkey % 6) AS project_name,
  net AS cost, ['USD', 'EUR', 'JPY'][CAST(l_suppkey % 3 AS INTEGER) + 1] AS currency
FROM invoice WHERE l_linenumber % 7 <> 3 AND net > 0 AND day >= {FIRST} AND day < {AFTER}""",
    # -- shared intermediate results, written as the sweep the Spark side avoids -----------------
    "work": f"""
SELECT CASE WHEN client LIKE '%Genie%' THEN 'Genie' ELSE 'DBSQL' END AS sql_product, CAST(start_time AS DATE) AS usage_date,
  warehouse_id, CAST(sum(task_ms) AS BIGINT) AS work_ms
FROM qh WHERE as_user IS NOT NULL AND warehouse_id IS NOT NULL AND start_time >= {FIRST} AND start_time < {AFTER} GROUP BY 1, 2, 3""",
    "sql_cost": """
SELECT usage_date, warehouse_id, sum(qty) AS dbus, sum(spend) AS spend, sum(eff_spend) AS eff FROM pu WHERE product = 'SQL' GROUP BY 1, 2""",
    "a1": """
SELECT w.sql_product, w.usage_date, w.warehouse_id,
  CASE WHEN t.total > 0 THEN CAST(w.work_ms AS DOUBLE) / t.total * CAST(c.dbus AS DOUBLE) ELSE 0 END AS dbus,
  CASE WHEN t.total > 0 THEN CAST(w.work_ms AS DOUBLE) / t.total * CAST(c.spend AS DOUBLE) ELSE 0 END AS spend,
  CASE WHEN t.total > 0 THEN CAST(w.work_ms AS DOUBLE) / t.total * CAST(c.eff AS DOUBLE) ELSE 0 END AS eff
FROM work w JOIN (SELECT usage_date, warehouse_id, sum(work_ms) AS total FROM work GROUP BY 1, 2) t
  ON w.usage_date = t.usage_date AND w.warehouse_id = t.warehouse_id
LEFT JOIN sql_cost c ON w.usage_date = c.usage_date AND w.warehouse_id = c.warehouse_id""",
    "a2": f"""
SELECT statement_id, query_source_id, query_source_type, client, executed_by, warehouse_id, statement_text, workspace_id,
  start_time, end_time, duration_seconds, dollars, dbus,
  'https://HOST/sql/history?o=' || workspace_id || '&queryId=' || statement_id || '&queryStartTimeMs=' || (epoch_s * 1000) AS query_profile_url,
  CASE WHEN query_source_type = 'GENIE SPACE' THEN 'https://HOST/genie/rooms/' || query_source_id
    WHEN query_source_type = 'AI/BI DASHBOARD' THEN 'https://HOST/sql/dashboardsv3/' || query_source_id
    WHEN query_source_type = 'LEGACY DASHBOARD' THEN 'https://HOST/sql/dashboards/' || query_source_id
    WHEN query_source_type = 'SQL QUERY' THEN 'https://HOST/editor/queries/' || query_source_id END AS url_helper
FROM (SELECT q.*, CASE WHEN total > 0 THEN work / total * h.dollars ELSE 0 END AS dollars, CASE WHEN total > 0 THEN work / total * h.dbus ELSE 0 END AS dbus
  FROM (SELECT *, sum(work) OVER (PARTITION BY hour, warehouse_id) AS total FROM (
    SELECT statement_id, client, coalesce(executed_by, as_user) AS executed_by, warehouse_id, statement_text, CAST(workspace_id AS VARCHAR) AS workspace_id,
      start_time, end_time, date_trunc('hour', start_time) AS hour, epoch_us(start_time) // 1000000 AS epoch_s,
      epoch_us(end_time) // 1000000 - epoch_us(start_time) // 1000000 AS duration_seconds,
      CAST(coalesce(task_ms, (epoch_us(end_time) // 1000000 - epoch_us(start_time) // 1000000) * 1000) AS DOUBLE) AS work,
      CASE WHEN client LIKE '%enie%' THEN 'GENIE SPACE' WHEN client LIKE '%dashboard%' THEN 'AI/BI DASHBOARD' ELSE 'SQL QUERY' END AS query_source_type,
      CASE WHEN client LIKE '%genie%' THEN regexp_extract(client, 'genie[/-]([a-zA-Z0-9-]+)', 1)
           WHEN client LIKE '%dashboard%' THEN regexp_extract(client, 'dashboard[/-]([a-zA-Z0-9-]+)', 1) END AS query_source_id
    FROM qh WHERE warehouse_id IS NOT NULL AND statement_type <> 'CANCEL' AND (executed_by IS NOT NULL OR as_user IS NOT NULL)
      AND start_time >= {FIRST} AND start_time < {AFTER}) a) q
  LEFT JOIN (SELECT date_trunc('hour', u.usage_start_time) AS hour, u.warehouse_id, CAST(sum(u.qty) AS DOUBLE) AS dbus,
      CAST(sum(u.qty * coalesce(p.price, 0)) AS DOUBLE) AS dollars
    FROM usage u LEFT JOIN prices p ON u.sku_name = p.sku_name AND u.cloud = p.cloud
    WHERE u.product = 'SQL' AND u.usage_date BETWEEN {FIRST} AND {LAST} GROUP BY 1, 2) h ON q.hour = h.hour AND q.warehouse_id = h.warehouse_id) r
WHERE dollars > 0 OR dbus > 0 OR duration_seconds > 0""",
    "a2r": f"SELECT * FROM a2 WHERE start_time >= {FIRST} AND start_time < {AFTER}",
    "bounds": """
SELECT date_trunc('hour', greatest((SELECT min(event_time) FROM wev), (SELECT min(start_time) FROM qh), (SELECT min(usage_end_time) FROM usage))) + INTERVAL 1 HOUR AS t0,
  date_trunc('hour', least((SELECT max(event_time) FROM wev), (SELECT max(end_time) FROM qh), (SELECT max(usage_end_time) FROM usage))) AS t1""",
    "wq": """
SELECT statement_id, coalesce(client, 'Unknown') AS client_application, coalesce(executed_by, as_user) AS executed_by, warehouse_id, statement_text,
  workspace_id, start_time, end_time,
  CASE WHEN source_no < 7 THEN ['JOB', 'LEGACY DASHBOARD', 'AI/BI DASHBOARD', 'ALERT', 'NOTEBOOK', 'SQL QUERY', 'GENIE SPACE'][CAST(source_no AS INTEGER) + 1]
       ELSE coalesce(client, 'UNKNOWN') END AS query_source_type,
  coalesce(source_id, 'UNKNOWN') AS query_source_id,
  make_timestamp(epoch_us(start_time) + (capacity_ms + coalesce(compute_ms, 0) + coalesce(compile_ms, 0)) * 1000) AS ws,
  make_timestamp(epoch_us(end_time) + coalesce(fetch_ms, 0) * 1000) AS we,
  (task_ms + coalesce(fetch_ms, 0) + coalesce(compile_ms, 0)) / 1000.0::DOUBLE AS work_s
FROM qh, bounds WHERE statement_type IS NOT NULL AND start_time < t1 AND end_time > t0 AND task_ms > 0 AND warehouse_id IS NOT NULL""",
    "state_sec": """
SELECT warehouse_id, date_trunc('second', event_time) AS sec, max_by(CASE WHEN cluster_count = 0 THEN 'OFF' ELSE 'ON' END, event_time) AS state
FROM wev, bounds WHERE event_time >= t0 AND event_time <= t1 AND warehouse_id IN (SELECT warehouse_id FROM wq) GROUP BY 1, 2
UNION ALL SELECT warehouse_id, date_trunc('second', max(event_time)), max_by(CASE WHEN cluster_count = 0 THEN 'OFF' ELSE 'ON' END, event_time)
FROM wev, bounds WHERE event_time < t0 AND warehouse_id IN (SELECT warehouse_id FROM wq) GROUP BY 1""",
    "on_off": """
SELECT warehouse_id, state, start_at, end_at FROM (
  SELECT warehouse_id, state, start_at, coalesce(lead(start_at) OVER (PARTITION BY warehouse_id ORDER BY start_at), (SELECT t1 FROM bounds)) AS end_at
  FROM (SELECT warehouse_id, state, min(sec) AS start_at FROM (
      SELECT *, row_number() OVER (PARTITION BY warehouse_id ORDER BY sec) - row_number() OVER (PARTITION BY warehouse_id, state ORDER BY sec) AS grp FROM state_sec) g
    GROUP BY warehouse_id, state, grp) i) w WHERE start_at < end_at""",
    "steps": """
SELECT warehouse_id, mark AS start_at, coalesce(lead(mark) OVER w, (SELECT t1 FROM bounds)) AS end_at, CAST(sum(num) OVER w AS BIGINT) AS active
FROM (SELECT warehouse_id, mark, sum(n) AS num FROM (
    SELECT warehouse_id, date_trunc('second', ws) AS mark, 1 AS n FROM wq
    UNION ALL SELECT warehouse_id, CASE WHEN date_trunc('second', ws) = date_trunc('second', we) THEN date_trunc('second', we) + INTERVAL 1 SECOND
      ELSE date_trunc('second', we) END, -1 FROM wq) e GROUP BY 1, 2) d
WINDOW w AS (PARTITION BY warehouse_id ORDER BY mark)""",
    "cuts": """
SELECT warehouse_id, mark FROM (SELECT warehouse_id, start_at AS mark FROM on_off UNION SELECT warehouse_id, end_at FROM on_off
  UNION SELECT warehouse_id, start_at FROM steps UNION SELECT warehouse_id, end_at FROM steps
  UNION SELECT w.warehouse_id, h.mark FROM (SELECT DISTINCT warehouse_id FROM wq) w, (SELECT unnest(generate_series(t0, t1, INTERVAL 1 HOUR)) AS mark FROM bounds) h) u, bounds
WHERE mark >= t0 AND mark <= t1""",
    "spans": """
SELECT p.warehouse_id, date_trunc('hour', p.a) AS hour, p.a, p.b, e.state, coalesce(r.active, 0) AS active,
  CASE WHEN e.state IS NULL OR e.state = 'OFF' THEN 'OFF' WHEN r.active > 0 THEN 'UTILIZED' ELSE 'ON_IDLE' END AS flag
FROM (SELECT warehouse_id, mark AS a, lead(mark) OVER (PARTITION BY warehouse_id ORDER BY mark) AS b FROM cuts) p
LEFT JOIN on_off e ON e.warehouse_id = p.warehouse_id AND e.start_at < p.b AND e.end_at > p.a
LEFT JOIN steps r ON r.warehouse_id = p.warehouse_id AND r.start_at < p.b AND r.end_at > p.a
WHERE p.a < p.b""",
    "util": """
SELECT warehouse_id, hour, CAST(sum(CASE WHEN flag = 'UTILIZED' THEN s ELSE 0 END) AS BIGINT) AS used, CAST(sum(CASE WHEN flag = 'ON_IDLE' THEN s ELSE 0 END) AS BIGINT) AS idle,
  CAST(sum(CASE WHEN flag = 'OFF' THEN s ELSE 0 END) AS BIGINT) AS off
FROM (SELECT *, datediff('second', a, b) AS s FROM spans) x GROUP BY 1, 2""",
    "util2": """
SELECT *, CASE WHEN used + idle > 0 THEN floor((used * 200 + used + idle) / (2.0 * (used + idle))) / 100 END AS proportion FROM util""",
    "pieces": """
SELECT statement_id, warehouse_id, hour, CASE WHEN we <= ws THEN 0 ELSE work_s * (greatest(0, epoch_us(least(we, hour + INTERVAL 1 HOUR)) // 1000000
    - epoch_us(greatest(ws, hour)) // 1000000) / ((epoch_us(we) - epoch_us(ws)) / 1000000.0::DOUBLE)) END AS work
FROM (SELECT *, unnest(generate_series(date_trunc('hour', ws), greatest(date_trunc('hour', ws), date_trunc('hour', we)), INTERVAL 1 HOUR)) AS hour FROM wq) q""",
    "bills": f"""
SELECT u.warehouse_id, date_trunc('hour', u.usage_start_time) AS hour, CAST(sum(u.qty) AS DOUBLE) AS dbus, CAST(sum(u.qty * p.price) AS DOUBLE) AS dollars
FROM (SELECT u.* FROM usage u, bounds WHERE warehouse_id IS NOT NULL AND usage_start_time >= t0 AND usage_end_time <= t1) u
LEFT JOIN price_history p ON u.sku_name = p.sku_name AND u.cloud = p.cloud AND u.usage_unit = p.usage_unit
  AND u.usage_end_time BETWEEN p.start_time AND coalesce(p.end_time, CAST({AFTER} AS TIMESTAMP)) GROUP BY 1, 2""",
    "a4h": """
SELECT w.statement_id, w.warehouse_id, w.hour, b.hour IS NOT NULL AS billed,
  u.proportion * b.dollars * CASE WHEN t.total <> 0 THEN w.work / t.total END AS cost,
  u.proportion * b.dbus * CASE WHEN t.total <> 0 THEN w.work / t.total END AS dbus
FROM pieces w JOIN (SELECT warehouse_id, hour, sum(work) AS total FROM pieces GROUP BY 1, 2) t ON w.warehouse_id = t.warehouse_id AND w.hour = t.hour
LEFT JOIN bills b ON w.warehouse_id = b.warehouse_id AND w.hour = b.hour
LEFT JOIN util2 u ON w.warehouse_id = u.warehouse_id AND w.hour = u.hour""",
    "a4": """
SELECT q.*, c.cost AS dollars, c.dbus AS dbus, c.billed, c.hours,
  CASE WHEN query_source_type = 'JOB' THEN '/jobs/' WHEN query_source_type = 'SQL QUERY' THEN '/editor/queries/'
    WHEN query_source_type = 'AI/BI DASHBOARD' THEN '/sql/dashboardsv3/' WHEN query_source_type = 'LEGACY DASHBOARD' THEN '/sql/dashboards/'
    WHEN query_source_type = 'ALERT' THEN '/sql/alerts/' WHEN query_source_type = 'GENIE SPACE' THEN '/genie/rooms/'
    WHEN query_source_type = 'NOTEBOOK' THEN '/editor/notebooks/' END || query_source_id AS url
FROM wq q JOIN (SELECT statement_id, sum(cost) AS cost, sum(dbus) AS dbus, bool_or(billed) AS billed, count(*) AS hours FROM a4h GROUP BY 1) c
  ON q.statement_id = c.statement_id""",
    "orig": f"""
SELECT q.statement_id, coalesce(q.executed_by, q.as_user) AS executed_by, q.client, q.tag_tool, q.tag_origin, q.warehouse_id, q.start_time,
  epoch_us(q.end_time) // 1000000 - epoch_us(q.start_time) // 1000000 AS duration_seconds, coalesce(c.dollars, 0) AS cost, coalesce(c.dbus, 0) AS dbus,
  c.query_profile_url,
  CASE WHEN tag_tool IS NOT NULL OR lower(coalesce(tag_origin, '')) = 'mcp' OR lower(coalesce(q.client, '')) LIKE '%mcp%' THEN 'MCP_TOOL'
    WHEN source_no = 6 OR lower(coalesce(q.client, '')) LIKE '%genie%' THEN 'GENIE'
    WHEN q.executed_by IS NOT NULL AND q.executed_by NOT LIKE '%@%' THEN 'SERVICE_PRINCIPAL' ELSE 'HUMAN' END AS origin
FROM qh q LEFT JOIN a2 c ON q.statement_id = c.statement_id
WHERE q.start_time >= {FIRST} AND q.start_time < {AFTER} AND q.warehouse_id IS NOT NULL AND q.task_ms > 0""",
    "days": "SELECT usage_date, sum(spend) AS spend FROM pu GROUP BY 1",
    "tagrows": """
SELECT *, 'team' AS tag_key, tag_team AS tag_value FROM pu WHERE tag_team IS NOT NULL
UNION ALL SELECT *, 'env', tag_env FROM pu WHERE tag_env IS NOT NULL""",
    "ch": f"""
SELECT cluster_id, usage_date, sum(qty) AS hours, max(workspace_id) AS workspace_id, max(cloud) AS cloud FROM usage
WHERE cluster_id IS NOT NULL AND product NOT IN ('SQL', 'DLT') AND qty > 0 AND usage_date BETWEEN {FIRST} AND {LAST} GROUP BY 1, 2""",
    "appu": "SELECT * FROM pu WHERE product = 'APPS'",
}
_WORD = re.compile(r"\b(" + "|".join(CTES) + r")\b")


def with_inputs(statement: str) -> str:
    """The statement with every input it mentions, directly or through another input."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(_WORD.findall(text)):
            if name not in ordered and name not in pending:
                pending.add(name)
                visit(CTES[name])
                ordered.append(name)
    pending: set[str] = set()
    visit(statement)
    if not ordered:
        return statement.strip()
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n].strip()}\n)" for n in ordered) + "\n" + statement.strip()


# fixed values: columns of the test tables the statements read
TABLES = {
    "nation": "n_nationkey INTEGER, n_name VARCHAR, n_regionkey INTEGER",
    "customer": "c_custkey BIGINT, c_name VARCHAR, c_nationkey INTEGER, c_acctbal DOUBLE, c_mktsegment VARCHAR",
    "supplier": "s_suppkey BIGINT, s_name VARCHAR, s_nationkey INTEGER, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name VARCHAR, p_brand VARCHAR, p_type VARCHAR, p_size INTEGER, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority VARCHAR",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE, l_extendedprice DOUBLE, "
                "l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR, l_shipdate TIMESTAMP",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR",
}


def dates_as_text(statements: dict[str, str]) -> dict[str, str]:
    """The statements with date columns as ISO text, like the exported Spark results.

    Drivers turn a date into different Python types; text is the same everywhere.
    """
    import duckdb
    con = duckdb.connect()
    for name, columns in TABLES.items():
        con.execute(f"CREATE TABLE {name} ({columns})")
    wrapped = {}
    for name, statement in statements.items():
        described = con.execute(f"DESCRIBE {statement}").fetchall()
        dates = [row[0] for row in described if row[1] == "DATE"]
        texts = ", ".join(f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in dates)
        wrapped[name] = f"SELECT * REPLACE ({texts}) FROM (\n{statement}\n) result" if dates else statement
    con.close()
    return wrapped
