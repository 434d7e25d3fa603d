"""Registered queries: invoice tables and marts (l), cloud actuals (x), reconciliation (d)."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlens.plans import cloud as X
from meterlens.plans import distinct as DC
from meterlens.plans import marts as L
from meterlens.plans import quality as D
from meterlens.plans import spend as S
from meterlens.registered import labels_sql as LB
from meterlens.registered.inputs_sql import AFTER, FIRST, LAST
from meterlens.registered.query import SUMS, Query, num, scratch, stamp, whole
from meterlens.sources.catalog import input_status
from meterlens.sources.values import DAY_AFTER, FIRST_DAY, LAST_DAY
from meterlens.streaming.ingest import load_new_files

W = (FIRST_DAY, LAST_DAY)
E = (FIRST_DAY, DAY_AFTER)
_EFF = num("sum(eff_spend)", "effective_list_spend")
_SPACES = whole("count(DISTINCT workspace_id)", "workspace_count")
_NULLS = "CAST(NULL AS VARCHAR)"


def _aws(t):
    return X.aws_gold(X.aws_silver(t.aws_bronze))


def _azure(t):
    return X.azure_gold(t.azure_bronze)


_IN = f"day >= {FIRST} AND day < {AFTER}"
_SILVER_SQL = f"""SELECT day AS usage_date, {stamp('usage_hour', 'usage_hour')}, {stamp("date_trunc('month', CAST(day AS TIMESTAMP))", 'billing_period_start')},
  {stamp("date_trunc('month', CAST(day AS TIMESTAMP)) + INTERVAL 1 MONTH", 'billing_period_end')}, 'payer-1' AS payer_account_id, account AS usage_account_id, 'i-' || l_orderkey AS resource_id,
  'EC2' AS product_code, 'Elastic Compute' AS product_name, p_type AS usage_type, 'RunInstances' AS operation, 'us-east-1a' AS availability_zone, region, instance_type, instance_family,
  'Linux' AS operating_system, 'Shared' AS tenancy, cluster_id, cluster_name, warehouse_id, job_id, {_NULLS} AS instance_pool_id, {_NULLS} AS cluster_creator, cost_center, environment,
  {_NULLS} AS project, {_NULLS} AS team, charge_type, pricing_term, 'USD' AS currency_code, {num('usage_amount', 'usage_amount')}, {num('usage_amount * 2', 'normalized_usage_amount')},
  {num('unblended', 'unblended_cost')}, {num('net_unblended', 'net_unblended_cost')}, {num('blended', 'blended_cost')}, {num('amortized', 'amortized_cost')}, {num('net_amortized', 'net_amortized_cost')},
  {num('ri_cost', 'ri_effective_cost')}, {num('sp_cost', 'sp_effective_cost')}, '2024-02-01 00:00:00.000000' AS _loaded_at FROM silver"""
_LINKS = "cluster_id AS usage_metadata_cluster_id, {name} AS usage_metadata_cluster_name, warehouse_id AS usage_metadata_warehouse_id, job_id AS usage_metadata_job_id"
_LINK_NULLS = f"{_NULLS} AS usage_metadata_instance_pool_id, {_NULLS} AS usage_metadata_cluster_creator"
_GOLD_SQL = f"""SELECT day AS usage_date, account AS usage_account_id, region, charge_type, pricing_term, instance_type, instance_family, {_LINKS.format(name='cluster_name')}, {_LINK_NULLS},
  cost_center, environment, {_NULLS} AS project, {_NULLS} AS team, {num('sum(unblended)', 'unblended_cost')}, {num('sum(net_unblended)', 'net_unblended_cost')}, {num('sum(blended)', 'blended_cost')},
  {num('sum(amortized)', 'amortized_cost')}, {num('sum(net_amortized)', 'net_amortized_cost')}, {num('sum(usage_amount)', 'total_usage_amount')}, {whole('count(*)', 'line_item_count')}, 'USD' AS currency_code
FROM silver GROUP BY ALL"""
_AZURE_SQL = f"""SELECT day AS usage_date, subscription_id, replace(subscription_id, 'sub-', 'Subscription ') AS subscription_name, resource_group, 'eastus' AS location, charge_type, pricing_model, meter_category,
  meter_subcategory, 'Compute' AS consumed_service, vm_size, CASE WHEN vm_size = 'Standard_D8s_v3' THEN 'Standard_D' ELSE '' END AS instance_family,
  {_LINKS.format(name="replace(cluster_id, 'cl-', 'Cluster ')")}, {_LINK_NULLS}, cost_center, {_NULLS} AS environment, {_NULLS} AS project, {_NULLS} AS team,
  {num('sum(cost_billing)', 'cost_in_billing_currency')}, {num('sum(cost_usd)', 'cost_in_usd')}, {num('avg(effective_price)', 'effective_price')}, {num('avg(unit_price)', 'unit_price')},
  {num('sum(quantity)', 'total_quantity')}, {whole('count(*)', 'line_item_count')}, 'EUR' AS currency_code FROM azure GROUP BY ALL"""


def _by_cluster(source, cost):
    def part(kind, name):
        return num(f"sum(CASE WHEN charge_type = '{kind}' THEN {cost} ELSE 0 END)", name)
    return f"""SELECT cluster_id, {part('Compute', 'compute_cost')}, {part('Storage', 'storage_cost')}, {part('Networking', 'network_cost')}, {num(f'sum({cost})', 'total_cost')},
  {whole('count(DISTINCT day)', 'days_active')} FROM {source} WHERE cluster_id IS NOT NULL AND {_IN} GROUP BY 1 ORDER BY sum({cost}) DESC, 1 LIMIT 100"""


def _by_warehouse(source, cost):
    return f"""SELECT warehouse_id, {num(f'sum({cost})', 'total_cost')}, {whole('count(DISTINCT day)', 'days_active')} FROM {source} WHERE warehouse_id IS NOT NULL AND {_IN}
GROUP BY 1 ORDER BY sum({cost}) DESC, 1 LIMIT 50"""


def _wide(columns, names, value, source, where="TRUE"):
    return "SELECT day AS date, " + ", ".join(num(f"sum(CASE WHEN {names} = '{c}' THEN {value} ELSE 0 END)", f'"{c}"') for c in columns) + f" FROM {source} WHERE {where} GROUP BY 1"


_AWS_TYPES = ["Compute", "Credit", "Fee", "Networking", "Other", "Refund", "ReservedInstance", "SavingsPlan", "Storage"]
_AZURE_TYPES = ["Compute", "Networking", "Other", "Storage"]
_GCP_SERVICES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
_X_COUNTS = f"{whole('count(DISTINCT cluster_id)', 'cluster_count')}, {whole('count(DISTINCT warehouse_id)', 'warehouse_count')}, {whole('count(DISTINCT day)', 'days_in_range')}"


def _summary_mart(t):
    return L.daily_usage_summary(t.usage, t.list_prices, *W)


def _product_mart(t):
    return L.daily_product_breakdown(t.usage, t.list_prices, *W)


def _space_mart(t):
    return L.daily_workspace_breakdown(t.usage, t.list_prices, t.workspaces, *W)


def _tool_mart(t):
    return L.sql_tool_attribution(t.usage, t.list_prices, t.query_history, *W)


def _ingested(t):
    """L1 end to end: two deliveries of invoice files, the second with a new column, each loaded once."""
    root = scratch(t) + "/ingest"
    lines = t.azure_bronze.select("Date", "MeterCategory", "CostInUsd", "CostCenter")
    early = F.col("Date") < F.lit("2023-11-01")
    lines.filter(early).drop("CostCenter").write.mode("overwrite").parquet(f"{root}/inbox/first")
    load_new_files(t.spark, f"{root}/inbox", f"{root}/bronze", f"{root}/progress")
    lines.filter(~early).write.mode("overwrite").parquet(f"{root}/inbox/second")
    load_new_files(t.spark, f"{root}/inbox", f"{root}/bronze", f"{root}/progress")
    bronze = load_new_files(t.spark, f"{root}/inbox", f"{root}/bronze", f"{root}/progress")
    return bronze.groupBy("MeterCategory", "CostCenter").agg(F.count("*").alias("lines"), F.sum("CostInUsd").alias("cost"))


def _ingested_csv(t):
    """L1 for CSV: the second delivery has other columns in another order, and every file is loaded once."""
    root = scratch(t) + "/ingest"
    schema = "Date date, MeterCategory string, CostInUsd decimal(18,6), CostCenter string"
    lines = t.azure_bronze.select("Date", "MeterCategory", F.col("CostInUsd").cast("decimal(18,6)").alias("CostInUsd"), "CostCenter")
    early = F.col("Date") < F.lit("2023-11-01")
    lines.filter(early).drop("CostCenter").write.option("header", "true").csv(f"{root}/inbox/first")
    for last in (False, True):
        bronze = load_new_files(t.spark, f"{root}/inbox", f"{root}/bronze", f"{root}/progress", "csv", T.StructType.fromDDL(schema))
        if not last:
            lines.filter(~early).select("CostCenter", "CostInUsd", "Date", "MeterCategory").write.option("header", "true").csv(f"{root}/inbox/second")
    return bronze.groupBy("MeterCategory", "CostCenter").agg(F.count("*").alias("lines"), F.sum("CostInUsd").alias("cost"))


def _distinct(t, start, end):
    """Sets written in two runs; what each kind counts over days of both."""
    root = scratch(t)
    DC.add_days(root, DC.members_of(t, FIRST_DAY, "2023-12-31"))
    DC.add_days(root, DC.members_of(t, "2024-01-01", LAST_DAY))
    counted = [DC.count_distinct(t.spark, root, k, start, end).select(F.lit(k).alias("kind"), "distinct_values") for k in ("workspace", "sku", "query_user")]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


def _written(t):
    """L5 and L6 end to end: write the mart, upsert its second half again with doubled dbus, read it back."""
    root = scratch(t)
    mart = _product_mart(t)
    L.write_mart(mart, root, "daily_product_breakdown")
    late = mart.filter((F.col("usage_date") > F.lit("2023-12-31")) & (F.col("product_category") != "SQL"))
    L.upsert_mart(late.withColumn("total_dbus", F.col("total_dbus") * 2), root, "daily_product_breakdown")
    return L.open_mart(t.spark, root, "daily_product_breakdown").select("usage_date", "product_category", "total_dbus", "total_spend", "workspace_count")


def _written_root(t):
    root = scratch(t)
    L.write_mart(_product_mart(t), root, "daily_product_breakdown")
    return root


def _routed(t, start, end):
    """The mart of some days, if they have a total, or else the live report of the whole range."""
    root, name = _written_root(t), "daily_product_breakdown"
    mart = L.read_by_product(L.open_mart(t.spark, root, name, start, end), start, end)
    mart = mart.withColumnRenamed("peak_daily_workspace_count", "workspaces").withColumn("source", F.lit("mart"))
    return L.mart_or_live(mart, lambda: S.by_product_fast(t.usage, t.list_prices, *W).withColumnRenamed("workspace_count", "workspaces")
                          .withColumn("source", F.lit("live")), L.mart_total(t.spark, root, name, start, end))


_DAILY_SQL = f"SELECT usage_date, {SUMS}, {_EFF}, {_SPACES} FROM pu GROUP BY 1"
_PRODUCT_SQL = f"SELECT usage_date, {LB.CATEGORY} AS product_category, {SUMS}, {_EFF}, {_SPACES} FROM pu GROUP BY 1, 2"
_QUERY_SQL = f"""SELECT CAST(start_time AS DATE) AS usage_date, {whole('count(*)', 'total_queries')}, {whole('count(DISTINCT coalesce(executed_by, as_user))', 'unique_query_users')},
  {whole('sum(coalesce(read_rows, 0))', 'total_rows_read')}, {whole('sum(coalesce(read_bytes, 0))', 'total_bytes_read')}, {num('sum(coalesce(task_ms, 0)) / 1000.0', 'total_compute_seconds')}
FROM qh WHERE start_time >= {FIRST} AND start_time < {AFTER} GROUP BY 1"""
_TOTAL = "(SELECT CAST(sum(spend) AS DOUBLE) FROM pu)"
_KNOWN = "coalesce(cluster_id, warehouse_id, job_id, pipeline_id, endpoint_name) IS NOT NULL"


def _completeness(check, name, count, keys):
    """``keys`` gives (key, spend) of every record; those without a key are missing from the parts."""
    return f"""SELECT '{check}' AS "check", CASE WHEN coalesce(100 * abs(w - s) / w, 0) <= 0.01 THEN 'pass' ELSE 'fail' END AS status, {num('w', 'ground_truth_spend')}, {num('s', name)},
  {whole('n', count)}, {num('w - s', 'difference')}, {num('coalesce(100 * abs(w - s) / w, 0)', 'difference_pct')}
FROM (SELECT CAST(sum(s) AS DOUBLE) AS s, count(*) AS n FROM (SELECT k, sum(spend) AS s FROM ({keys}) r WHERE k IS NOT NULL GROUP BY 1) g) parts,
  (SELECT CAST(sum(spend) AS DOUBLE) AS w FROM pu) whole"""


def _without_some_workspaces(t):
    """A bill whose records of two workspaces have lost their workspace."""
    return t.usage.withColumn("workspace_id", F.when(~F.col("workspace_id").isin(1, 4), F.col("workspace_id")))


def _stale_mart(t):
    """A mart that misses the last day and has one wrong day."""
    wrong = F.when(F.col("usage_date") == F.lit("2023-12-25"), F.col("total_spend") + 5).otherwise(F.col("total_spend"))
    return _summary_mart(t).filter(F.col("usage_date") < F.lit(LAST_DAY)).withColumn("total_spend", wrong)


_MART_VS_LIVE = f"""SELECT 'mv_vs_live' AS "check", CASE WHEN count(*) FILTER (abs(live - mart) > 0.01) = 0 THEN 'pass' ELSE 'fail' END AS status, {whole('count(*)', 'total_dates_compared')},
  {whole('count(*) FILTER (abs(live - mart) > 0.01)', 'mismatched_dates')} FROM (SELECT CAST(spend AS DOUBLE) AS live, {{mart}} AS mart FROM days) x"""

QUERIES = [
    Query("l01_incremental_load", _ingested, f"""
SELECT meter_category AS "MeterCategory", CASE WHEN day >= DATE '2023-11-01' THEN cost_center END AS "CostCenter", {whole('count(*)', 'lines')}, {num('sum(cost_usd)', 'cost')} FROM azure GROUP BY 1, 2"""),
    Query("l01_incremental_csv_load", _ingested_csv, f"""
SELECT meter_category AS "MeterCategory", CASE WHEN day >= DATE '2023-11-01' THEN cost_center END AS "CostCenter", {whole('count(*)', 'lines')}, {num('sum(cost_usd)', 'cost')} FROM azure GROUP BY 1, 2"""),
    Query("l07_exact_distinct_counts", lambda t: _distinct(t, "2023-12-10", "2024-01-20"), f"""
SELECT 'workspace' AS kind, {whole('count(DISTINCT workspace_id)', 'distinct_values')} FROM pu WHERE usage_date BETWEEN DATE '2023-12-10' AND DATE '2024-01-20'
UNION ALL SELECT 'sku', count(DISTINCT sku_name) FROM pu WHERE usage_date BETWEEN DATE '2023-12-10' AND DATE '2024-01-20'
UNION ALL SELECT 'query_user', count(DISTINCT coalesce(executed_by, as_user)) FROM qh WHERE start_time >= DATE '2023-12-10' AND start_time < DATE '2024-01-21'"""),
    Query("l10_input_status", lambda t: input_status(t.spark, {n: f"{t.sf_dir}/{n}.parquet" for n in ("lineitem", "orders", "events", "not_there")})
          .withColumn("row_count", F.col("row_count").cast("double")), f"""
SELECT 'lineitem' AS name, true AS "exists", {num('count(*)', 'row_count')} FROM lineitem UNION ALL SELECT 'orders', true, {num('count(*)', 'n')} FROM orders
UNION ALL SELECT 'events', true, {num('count(*)', 'n')} FROM events UNION ALL SELECT 'not_there', false, CAST(NULL AS DOUBLE)"""),
    Query("l02_aws_silver", lambda t: X.aws_silver(t.aws_bronze), _SILVER_SQL),
    Query("l03_aws_gold", _aws, _GOLD_SQL),
    Query("l04_azure_gold", _azure, _AZURE_SQL),
    Query("l05_daily_usage_summary", _summary_mart, _DAILY_SQL),
    Query("l05_daily_product_breakdown", _product_mart, _PRODUCT_SQL),
    Query("l05_daily_workspace_breakdown", _space_mart,
          f"SELECT usage_date, p.workspace_id, w.workspace_name, {SUMS}, {_EFF} FROM pu p LEFT JOIN ws w ON p.workspace_id = w.workspace_id GROUP BY 1, 2, 3"),
    Query("l05_daily_query_stats", lambda t: L.daily_query_stats(t.query_history, *W), _QUERY_SQL),
    Query("l05b_sql_tool_attribution", _tool_mart,
          f"SELECT sql_product, usage_date, warehouse_id, {num('dbus', 'attributed_dbus')}, {num('spend', 'attributed_spend')}, {num('eff', 'attributed_effective_list_spend')} FROM a1"),
    Query("l06_written_and_upserted", _written, f"""
SELECT usage_date, product_category, {num("sum(qty) * CASE WHEN usage_date > DATE '2023-12-31' AND product_category <> 'SQL' THEN 2 ELSE 1 END", 'total_dbus')}, {num('sum(spend)', 'total_spend')}, {_SPACES}
FROM (SELECT *, {LB.CATEGORY} AS product_category FROM pu) x GROUP BY 1, 2"""),
    Query("l07_read_summary", lambda t: L.read_summary(_summary_mart(t), *W), f"""
SELECT {SUMS}, (SELECT {whole('max(n)', 'n')} FROM (SELECT usage_date, count(DISTINCT workspace_id) AS n FROM pu GROUP BY 1) d) AS peak_daily_workspace_count,
  {whole('count(DISTINCT usage_date)', 'days_in_range')}, min(usage_date) AS first_date, max(usage_date) AS last_date FROM pu"""),
    Query("l07_read_by_product", lambda t: L.read_by_product(_product_mart(t), *W), f"""
SELECT product_category, {num('sum(d)', 'total_dbus')}, {num('sum(s)', 'total_spend')}, {whole('max(n)', 'peak_daily_workspace_count')}
FROM (SELECT usage_date, {LB.CATEGORY} AS product_category, sum(qty) AS d, sum(spend) AS s, count(DISTINCT workspace_id) AS n FROM pu GROUP BY 1, 2) x GROUP BY 1"""),
    Query("l07_read_timeseries", lambda t: L.read_timeseries(_product_mart(t), *W), f"SELECT usage_date, {LB.CATEGORY} AS product_category, {SUMS} FROM pu GROUP BY 1, 2"),
    Query("l07_read_by_workspace", lambda t: L.read_by_workspace(_space_mart(t), *W),
          f"SELECT p.workspace_id, max(w.workspace_name) AS workspace_name, {SUMS} FROM pu p LEFT JOIN ws w ON p.workspace_id = w.workspace_id GROUP BY 1"),
    Query("l07_read_tool_split", lambda t: L.read_tool_split(_tool_mart(t), *W), f"SELECT sql_product, {num('sum(dbus)', 'total_dbus')}, {num('sum(spend)', 'total_spend')} FROM a1 GROUP BY 1"),
    Query("l07_read_etl", lambda t: L.read_etl(_product_mart(t), *W), f"SELECT {LB.ETL} AS etl_type, {SUMS} FROM pu WHERE {LB.IS_ETL} GROUP BY 1"),
    Query("l07_read_query_kpis", lambda t: L.read_query_kpis(L.daily_query_stats(t.query_history, *W), *W), f"""
SELECT {whole('sum(total_queries)', 'total_queries')}, {whole('sum(total_rows_read)', 'total_rows_read')}, {whole('sum(total_bytes_read)', 'total_bytes_read')}, {num('sum(total_compute_seconds)', 'total_compute_seconds')},
  {whole('max(unique_query_users)', 'peak_daily_query_users')} FROM ({_QUERY_SQL}) q"""),
    Query("l08_mart_or_live", lambda t: _routed(t, FIRST_DAY, LAST_DAY),
          f"""SELECT product_category, {num('sum(d)', 'total_dbus')}, {num('sum(s)', 'total_spend')}, {whole('max(n)', 'workspaces')}, 'mart' AS source
FROM (SELECT usage_date, {LB.CATEGORY} AS product_category, sum(qty) AS d, sum(spend) AS s, count(DISTINCT workspace_id) AS n FROM pu GROUP BY 1, 2) x GROUP BY 1"""),
    Query("l08_mart_or_live_falls_back", lambda t: _routed(t, "2020-01-01", "2020-01-31"),
          f"SELECT {LB.CATEGORY} AS product_category, {SUMS}, {whole('count(DISTINCT workspace_id)', 'workspaces')}, 'live' AS source FROM pu GROUP BY 1"),
    Query("l09_freshness_of_versions", lambda t: L.freshness_of(t.spark, _written_root(t), ["daily_product_breakdown"], "2024-02-10"), f"""
SELECT 'daily_product_breakdown' AS name, {whole(f'(SELECT count(*) FROM (SELECT DISTINCT usage_date, {LB.CATEGORY} AS c FROM pu) x)', 'row_count')}, min(usage_date) AS min_date, max(usage_date) AS max_date,
  {whole("datediff('day', max(usage_date), DATE '2024-02-10')", 'days_behind')} FROM pu"""),
    Query("l09_freshness", lambda t: L.freshness(_summary_mart(t), "daily_usage_summary", "2024-02-10"), f"""
SELECT 'daily_usage_summary' AS name, {whole('count(DISTINCT usage_date)', 'row_count')}, min(usage_date) AS min_date, max(usage_date) AS max_date,
  {whole("datediff('day', max(usage_date), DATE '2024-02-10')", 'days_behind')} FROM pu"""),
    Query("x01_aws_summary", lambda t: X.aws_summary(_aws(t), *E), f"""
SELECT {num('sum(unblended)', 'total_unblended')}, {num('sum(net_unblended)', 'total_net_unblended')}, {num('sum(amortized)', 'total_amortized')}, {num('sum(net_amortized)', 'total_net_amortized')}, {_X_COUNTS} FROM silver WHERE {_IN}"""),
    Query("x02_aws_by_cluster", lambda t: X.by_cluster(_aws(t), *E), _by_cluster("silver", "net_unblended")),
    Query("x03_aws_by_warehouse", lambda t: X.by_warehouse(_aws(t), *E), _by_warehouse("silver", "net_unblended")),
    Query("x04_aws_by_charge_type", lambda t: X.aws_by_charge_type(_aws(t), *E), f"""
SELECT charge_type, {num('sum(unblended)', 'unblended_cost')}, {num('sum(net_unblended)', 'net_unblended_cost')}, {num('sum(amortized)', 'amortized_cost')}, {num('sum(net_amortized)', 'net_amortized_cost')} FROM silver WHERE {_IN} GROUP BY 1"""),
    Query("x05_aws_charge_series", lambda t: X.charge_series(_aws(t), *E), f"SELECT day AS date, charge_type, {num('sum(net_unblended)', 'daily_cost')} FROM silver WHERE {_IN} GROUP BY 1, 2"),
    Query("x05_aws_charge_series_wide", lambda t: X.series_wide(X.charge_series(_aws(t), *E), "charge_type", _AWS_TYPES), _wide(_AWS_TYPES, "charge_type", "net_unblended", "silver", _IN)),
    Query("x06_aws_daily", lambda t: X.aws_daily(_aws(t), *E), f"""
SELECT day AS date, {num('sum(unblended)', 'unblended')}, {num('sum(net_unblended)', 'net_unblended')}, {num('sum(amortized)', 'amortized')}, {num('sum(net_amortized)', 'net_amortized')} FROM silver WHERE {_IN} GROUP BY 1"""),
    Query("x07_azure_summary", lambda t: X.azure_summary(_azure(t), *E), f"SELECT {num('sum(cost_billing)', 'total_cost')}, {num('sum(cost_usd)', 'total_cost_usd')}, {_X_COUNTS} FROM azure WHERE {_IN}"),
    Query("x08_azure_by_cluster", lambda t: X.by_cluster(_azure(t), *E, cost="cost_in_billing_currency"), _by_cluster("azure", "cost_billing")),
    Query("x08_azure_by_warehouse", lambda t: X.by_warehouse(_azure(t), *E, cost="cost_in_billing_currency"), _by_warehouse("azure", "cost_billing")),
    Query("x09_azure_by_charge_type", lambda t: X.azure_by_charge_type(_azure(t), *E), f"SELECT charge_type, {num('sum(cost_billing)', 'total_cost')}, {num('sum(cost_usd)', 'total_cost_usd')} FROM azure WHERE {_IN} GROUP BY 1"),
    Query("x09_azure_by_pricing_model", lambda t: X.azure_by_pricing_model(_azure(t), *E), f"SELECT pricing_model, {num('sum(cost_billing)', 'total_cost')} FROM azure WHERE {_IN} GROUP BY 1"),
    Query("x10_azure_charge_series", lambda t: X.charge_series(_azure(t), *E, cost="cost_in_billing_currency"), f"SELECT day AS date, charge_type, {num('sum(cost_billing)', 'daily_cost')} FROM azure WHERE {_IN} GROUP BY 1, 2"),
    Query("x10_azure_charge_series_wide", lambda t: X.series_wide(X.charge_series(_azure(t), *E, cost="cost_in_billing_currency"), "charge_type", _AZURE_TYPES), _wide(_AZURE_TYPES, "charge_type", "cost_billing", "azure", _IN)),
    Query("x11_gcp_summary", lambda t: X.gcp_summary(t.gcp_export, *E), f"""
SELECT {num('sum(cost)', 'total_cost')}, currency, {whole('count(DISTINCT project_id)', 'project_count')}, {whole('count(DISTINCT service)', 'service_count')}, {whole('count(DISTINCT day)', 'days_in_range')}
FROM gcp GROUP BY currency ORDER BY sum(cost) DESC LIMIT 1"""),
    Query("x12_gcp_by_service", lambda t: X.gcp_by_service(t.gcp_export, *E), f"SELECT service, {num('sum(cost)', 'total_cost')}, {whole('count(DISTINCT day)', 'days_active')} FROM gcp GROUP BY 1 ORDER BY sum(cost) DESC LIMIT 50"),
    Query("x12_gcp_by_project", lambda t: X.gcp_by_project(t.gcp_export, *E), f"SELECT project_id, project_name, {num('sum(cost)', 'total_cost')}, {whole('count(DISTINCT service)', 'service_count')} FROM gcp GROUP BY 1, 2"),
    Query("x12_gcp_by_sku", lambda t: X.gcp_by_sku(t.gcp_export, *E), f"SELECT service, sku, {num('sum(cost)', 'total_cost')} FROM gcp GROUP BY 1, 2 ORDER BY sum(cost) DESC, 1, 2 LIMIT 100"),
    Query("x13_gcp_series", lambda t: X.gcp_series(t.gcp_export, *E), f"SELECT day AS date, service, {num('sum(cost)', 'daily_cost')} FROM gcp GROUP BY 1, 2"),
    Query("x13_gcp_series_wide", lambda t: X.series_wide(X.gcp_series(t.gcp_export, *E), "service", _GCP_SERVICES), _wide(_GCP_SERVICES, "service", "cost", "gcp")),
    Query("d01_ground_truth", lambda t: D.ground_truth(t.usage, t.list_prices, *W), f"""
SELECT 'ground_truth' AS "check", CASE WHEN count(*) > 0 THEN 'pass' ELSE 'fail' END AS status, {SUMS}, {whole('count(*)', 'total_rows')}, {_SPACES}, {whole('count(DISTINCT usage_date)', 'days_in_range')} FROM pu"""),
    Query("d02_product_completeness", lambda t: D.product_completeness(t.usage, t.list_prices, *W),
          _completeness("product_completeness", "product_sum_spend", "category_count", f"SELECT {LB.CATEGORY} AS k, spend FROM pu")),
    Query("d03_workspace_completeness", lambda t: D.workspace_completeness(t.usage, t.list_prices, *W),
          _completeness("workspace_completeness", "workspace_sum_spend", "workspace_count", "SELECT workspace_id AS k, spend FROM pu")),
    Query("d03_workspace_completeness_fails", lambda t: D.workspace_completeness(_without_some_workspaces(t), t.list_prices, *W),
          _completeness("workspace_completeness", "workspace_sum_spend", "workspace_count", "SELECT CASE WHEN workspace_id NOT IN (1, 4) THEN workspace_id END AS k, spend FROM pu")),
    Query("d01_ground_truth_of_nothing", lambda t: D.ground_truth(t.usage, t.list_prices, "2020-01-01", "2020-01-31"), f"""
SELECT 'ground_truth' AS "check", CASE WHEN count(*) > 0 THEN 'pass' ELSE 'fail' END AS status, {SUMS}, {whole('count(*)', 'total_rows')}, {_SPACES}, {whole('count(DISTINCT usage_date)', 'days_in_range')}
FROM pu WHERE usage_date < DATE '2020-02-01'"""),
    Query("d04_price_coverage", lambda t: D.price_coverage(t.usage, t.list_prices, *W), f"""
SELECT 'price_coverage' AS "check", CASE WHEN 100 * CAST(u AS DOUBLE) / CAST(q AS DOUBLE) <= 5 THEN 'pass' ELSE 'fail' END AS status, {whole('n', 'total_rows')}, {whole('p', 'priced_rows')}, {whole('n - p', 'unpriced_rows')},
  {num('q', 'total_dbus')}, {num('u', 'unpriced_dbus')}, {num('100.0 * (n - p) / n', 'unpriced_row_pct')}, {num('100 * CAST(u AS DOUBLE) / CAST(q AS DOUBLE)', 'unpriced_dbu_pct')}
FROM (SELECT count(*) AS n, count(CASE WHEN has_price THEN 1 END) AS p, sum(qty) AS q, sum(CASE WHEN NOT has_price THEN qty ELSE 0 END) AS u FROM pu) x"""),
    Query("d05_null_attribution", lambda t: D.null_attribution(t.usage, t.list_prices, *W), f"""
SELECT 'null_attribution' AS "check", 'info' AS status, {whole('count(*)', 'total_rows')}, {num('sum(spend)', 'total_spend')}, {whole(f'count(CASE WHEN NOT ({_KNOWN}) THEN 1 END)', 'fully_unattributed_rows')},
  {num(f'sum(CASE WHEN NOT ({_KNOWN}) THEN spend ELSE 0 END)', 'unattributed_spend')}, {num(f'100 * CAST(sum(CASE WHEN NOT ({_KNOWN}) THEN spend ELSE 0 END) AS DOUBLE) / CAST(sum(spend) AS DOUBLE)', 'unattributed_pct')} FROM pu"""),
    Query("d06_duplicate_prices", lambda t: D.duplicate_prices(t.price_history), f"""
SELECT sku_name, cloud, {whole('count(*)', 'active_prices')}, {num('min(price)', 'min_price')}, {num('max(price)', 'max_price')} FROM price_history WHERE end_time IS NULL GROUP BY 1, 2 HAVING count(*) > 1"""),
    Query("d06_price_uniqueness", lambda t: D.price_uniqueness(t.price_history), f"""
SELECT 'price_uniqueness' AS "check", CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END AS status, {whole('count(DISTINCT sku_name)', 'duplicate_price_skus')}, {whole('count(*)', 'duplicate_pairs')}
FROM (SELECT sku_name, cloud FROM price_history WHERE end_time IS NULL GROUP BY 1, 2 HAVING count(*) > 1) d"""),
    Query("d07_sql_attribution", lambda t: D.sql_attribution(t.usage, t.list_prices, t.query_history, *W), f"""
SELECT 'sql_attribution' AS "check", 'info' AS status, {num('b', 'billing_spend')}, {num('q', 'billing_dbus')}, {num('s', 'attributed_spend')}, {num('d', 'attributed_dbus')}, {num('b - s', 'difference')}, {num('100 * (b - s) / b', 'difference_pct')}
FROM (SELECT CAST(sum(spend) AS DOUBLE) AS b, CAST(sum(dbus) AS DOUBLE) AS q FROM sql_cost) x, (SELECT sum(spend) AS s, sum(dbus) AS d FROM a1) y"""),
    Query("d08_history_duplicates", lambda t: D.history_duplicates(t.query_history), f"""
SELECT 'query_history_duplicates' AS "check", CASE WHEN 100.0 * (n - u) / n <= 1 THEN 'pass' ELSE 'fail' END AS status, {whole('n', 'total_rows')}, {whole('u', 'unique_statements')}, {whole('n - u', 'duplicate_rows')},
  {num('100.0 * (n - u) / n', 'duplicate_pct')} FROM (SELECT count(*) AS n, count(DISTINCT statement_id) AS u FROM qh) x"""),
    Query("d09_mart_mismatches", lambda t: D.mart_mismatches(_stale_mart(t), _summary_mart(t)).filter(~F.col("matches")).drop("matches"), f"""
SELECT usage_date, {num('live', 'live_spend')}, {num('mart', 'mv_spend')}, {num('live - mart', 'difference')} FROM (
  SELECT usage_date, CAST(spend AS DOUBLE) AS live, CASE WHEN usage_date = {LAST} THEN 0 WHEN usage_date = DATE '2023-12-25' THEN CAST(spend + 5 AS DOUBLE) ELSE CAST(spend AS DOUBLE) END AS mart FROM days) x
WHERE abs(live - mart) > 0.01"""),
    Query("d09_mart_vs_live", lambda t: D.mart_vs_live(_summary_mart(t), _summary_mart(t)),
          _MART_VS_LIVE.format(mart="CAST(spend AS DOUBLE)")),
    Query("d09_mart_vs_live_fails", lambda t: D.mart_vs_live(_stale_mart(t), _summary_mart(t)),
          _MART_VS_LIVE.format(mart=f"CASE WHEN usage_date = {LAST} THEN 0 WHEN usage_date = DATE '2023-12-25' THEN CAST(spend + 5 AS DOUBLE) ELSE CAST(spend AS DOUBLE) END")),
]
