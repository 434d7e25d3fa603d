"""Registered queries: infrastructure estimate (i), prices (v)."""

from pyspark.sql import functions as F

from meterlens.operators import pricing as P
from meterlens.plans import infra as I
from meterlens.plans import spend as S
from meterlens.registered import labels_sql as L
from meterlens.registered.inputs_sql import LAST
from meterlens.registered.query import DBUS, Query, num, stamp, whole
from meterlens.sources.values import FIRST_DAY, LAST_DAY

W = (FIRST_DAY, LAST_DAY)
NOW = "2024-01-01 00:00:00"

# prices of the machine types of the test mapping, all others cost 0.50
_ESTIMATE = "CASE {m} WHEN 'i3.xlarge' THEN 0.312 WHEN 'm5.2xlarge' THEN 0.384 ELSE 0.5 END::DOUBLE"
_ON_CLOUD = {"AWS": "CASE {m} WHEN 'i3.xlarge' THEN 0.312 WHEN 'm5.2xlarge' THEN 0.384 WHEN 'r7i.4xlarge' THEN 1.0584 ELSE 0.5 END::DOUBLE",
             "AZURE": "CASE {m} WHEN 'Standard_D8s_v3' THEN 0.384 ELSE 0.5 END::DOUBLE"}


def _cost(price: str, hours: str) -> str:
    return f"CAST({hours} AS DOUBLE) * (({price.format(m='c.driver')}) + ({price.format(m='c.worker')}) * 2) / 2"


_FAMILY = "CASE WHEN c.worker IS NULL THEN 'unknown' WHEN c.worker IN ('i3.xlarge', 'm5.2xlarge', 'r7i.4xlarge', 'zz9.huge') THEN split_part(c.worker, '.', 1) ELSE '' END"
_CLUSTERS = f"""SELECT h.cluster_id, c.cluster_name, c.driver, c.worker, c.cluster_source, h.workspace_id, h.cloud, h.hours, h.days, {_cost(_ESTIMATE, 'h.hours')} AS cost
FROM (SELECT cluster_id, max(workspace_id) AS workspace_id, max(cloud) AS cloud, sum(hours) AS hours, count(*) AS days FROM ch GROUP BY 1) h LEFT JOIN cl_now c ON h.cluster_id = c.cluster_id"""
_SERIES = f"SELECT h.usage_date, {_FAMILY} AS instance_family, sum({_cost(_ESTIMATE, 'h.hours')}) AS cost FROM ch h LEFT JOIN cl_now c ON h.cluster_id = c.cluster_id GROUP BY 1, 2"
_TOP = "ORDER BY hours DESC, cluster_id LIMIT 100"
_SHOWN = f"cluster_id, cluster_name, driver AS driver_instance_type, worker AS worker_instance_type, cluster_source, workspace_id, {num('hours', 'total_dbu_hours')}, {whole('days', 'days_active')}"
FAMILIES = ["i3", "m5", "r7i", "unknown", "zz9"]
_SUMMARY = f"""SELECT sum(c) AS cost, avg(n) AS per_day, CASE WHEN avg(n) > 0 THEN avg(c / n) ELSE 0 END AS per_cluster, count(*) AS days
FROM (SELECT usage_date, CAST(sum(spend) AS DOUBLE) AS c, count(DISTINCT cluster_id) AS n FROM pu WHERE cluster_id IS NOT NULL AND {L.IS_INFRA} GROUP BY 1) d"""


def _usage(t, limit=None):
    return I.cluster_usage(t.usage, t.clusters, *W, limit=limit)


def _series(t, **options):
    return I.aws_cost_series(t.usage, t.clusters, t.estimate_prices, *W, **options)


def _fallback(t):
    """A bill with no priced usage: the summary falls back on the estimate."""
    nothing = t.list_prices.filter(F.col("sku_name") == "")
    return I.infra_summary_or_estimate(I.infra_summary(t.usage, nothing, *W), I.aws_cost_estimate(t.usage, t.clusters, t.estimate_prices, *W, limit=None),
                                       I.infra_series(t.usage, *W))


def _costed_sql(cloud: str) -> str:
    return f"""SELECT {_SHOWN}, cloud, {num('est', 'estimated_cost')}, {num('100 * est / sum(est) OVER ()', 'percentage')}, (driver IS NULL AND worker IS NULL) AS is_historical
FROM (SELECT c.*, {_cost(_ON_CLOUD[cloud], 'c.hours')} AS est FROM ({_CLUSTERS}) c) x {_TOP}"""


def _price_sql(source: str) -> str:
    return f"""SELECT sku_name, cloud, currency_code, usage_unit, {num('price', 'list_price')}, {num('effective', 'effective_list_price')}, {stamp('start_time', 'start_time')}, {stamp('end_time', 'end_time')}
FROM {source} WHERE end_time IS NULL OR end_time > TIMESTAMP '{NOW}'"""


_MULTIPLIER = f"""SELECT CAST(sum(q * ap) AS DOUBLE) / CAST(sum(q * lp) AS DOUBLE) AS m, count(DISTINCT sku_name) AS n, sum(q * lp) AS l, sum(q * ap) AS a
FROM (SELECT u.sku_name, u.q, p.price AS lp, a.price AS ap FROM (SELECT sku_name, cloud, sum(qty) AS q FROM usage WHERE qty > 0 AND usage_date >= {LAST} - 180 AND usage_date <= {LAST} GROUP BY 1, 2) u
  JOIN prices p ON u.sku_name = p.sku_name AND u.cloud = p.cloud JOIN account_prices a ON u.sku_name = a.sku_name AND u.cloud = a.cloud) x"""


def _multiplier(t):
    return P.price_multiplier(t.usage, t.list_prices, t.account_prices, LAST_DAY, 180)


QUERIES = [
    Query("i01_aws_cost_estimate", lambda t: I.aws_cost_estimate(t.usage, t.clusters, t.estimate_prices, *W),
          f"SELECT {_SHOWN}, CAST(NULL AS VARCHAR) AS state, {num('cost', 'estimated_aws_cost')} FROM ({_CLUSTERS}) x ORDER BY cost DESC, cluster_id LIMIT 100"),
    Query("i02_hours_by_family", lambda t: I.hours_by_worker_family(t.usage, t.clusters, *W),
          f"SELECT {_FAMILY} AS instance_family, {num('sum(h.hours)', 'total_dbu_hours')}, {whole('count(DISTINCT h.usage_date)', 'days_active')} FROM ch h LEFT JOIN cl_now c ON h.cluster_id = c.cluster_id GROUP BY 1"),
    Query("i03_aws_cost_series", _series, f"SELECT usage_date, instance_family, {num('cost', 'estimated_aws_cost')} FROM ({_SERIES}) s"),
    Query("i03b_cost_series_wide", lambda t: I.aws_cost_series_wide(_series(t), FAMILIES),
          "SELECT usage_date AS date, round(sum(cost), 2) AS total, " + ", ".join(
              f"round(sum(CASE WHEN coalesce(nullif(instance_family, ''), 'unknown') = '{f}' THEN cost ELSE 0 END), 2) AS {f}" for f in FAMILIES) + f" FROM ({_SERIES}) s GROUP BY 1"),
    Query("i03b_families_by_spend", lambda t: I.families_by_spend(_series(t)), f"SELECT instance_family, {num('sum(cost)', 'total')} FROM ({_SERIES}) s GROUP BY 1"),
    Query("i03c_cost_series_of_families", lambda t: _series(t, families=["i3", "m5"]),
          f"SELECT usage_date, instance_family, {num('cost', 'estimated_aws_cost')} FROM ({_SERIES}) s WHERE instance_family IN ('i3', 'm5')"),
    Query("i04_cluster_usage", lambda t: _usage(t, 100), f"SELECT {_SHOWN}, cloud FROM ({_CLUSTERS}) x {_TOP}"),
    Query("i05_cluster_cost_aws", lambda t: I.cluster_cost(_usage(t), t.machine_prices, "AWS"), _costed_sql("AWS")),
    Query("i05_cluster_cost_azure", lambda t: I.cluster_cost(_usage(t), t.machine_prices, "AZURE"), _costed_sql("AZURE")),
    Query("i06_family_hours", lambda t: I.family_hours(_usage(t), "AWS"), f"""
SELECT split_part(m, '.', 1) AS instance_family, {num('sum(hours)', 'total_dbu_hours')}, {whole('max(days)', 'days_active')}
FROM (SELECT driver AS m, hours, days FROM ({_CLUSTERS}) a UNION ALL SELECT worker, hours, days FROM ({_CLUSTERS}) b) x WHERE m IS NOT NULL GROUP BY 1"""),
    Query("i07_infra_series", lambda t: I.infra_series(t.usage, *W),
          f"SELECT usage_date AS date, max(cloud) AS cloud, {num('CAST(sum(hours) AS DOUBLE) * 0.5', 'estimated_cost')}, {num('sum(hours)', 'total_dbu_hours')} FROM ch GROUP BY 1"),
    Query("i08_infra_summary", lambda t: I.infra_summary(t.usage, t.list_prices, *W),
          f"SELECT {num('cost', 'total_cost')}, {num('per_day', 'avg_clusters_per_day')}, {num('per_cluster', 'avg_cost_per_cluster')}, {whole('days', 'days_in_range')} FROM ({_SUMMARY}) s"),
    Query("i08b_infra_summary_fallback", _fallback, f"""
SELECT (SELECT {num('sum(CASE WHEN driver IS NOT NULL OR worker IS NOT NULL THEN cost END)', 'v')} FROM ({_CLUSTERS}) a) AS total_cost, (SELECT {num('sum(hours)', 'v')} FROM ({_CLUSTERS}) b) AS total_dbu_hours,
  (SELECT {num('count(CASE WHEN driver IS NOT NULL OR worker IS NOT NULL THEN 1 END)', 'v')} FROM ({_CLUSTERS}) c) AS avg_clusters_per_day,
  (SELECT {num('avg(c)', 'v')} FROM (SELECT usage_date, CAST(sum(hours) AS DOUBLE) * 0.5 AS c FROM ch GROUP BY 1) d WHERE c > 0) AS avg_cost_per_cluster"""),
    Query("v01_price_list", lambda t: P.price_list(t.price_history, NOW), _price_sql("price_history")),
    Query("v02_negotiated_price_list", lambda t: P.negotiated_price_list(t.account_prices, t.price_history, NOW), _price_sql("account_prices")),
    Query("v02_negotiated_fallback", lambda t: P.negotiated_price_list(None, t.price_history, NOW), _price_sql("price_history")),
    Query("v03_price_multiplier", _multiplier,
          f"SELECT {num('m', 'multiplier')}, {whole('n', 'sku_count')}, {num('l', 'weighted_list_spend')}, {num('a', 'weighted_account_spend')}, round((1 - m) * 100, 2) AS discount_percent FROM ({_MULTIPLIER}) x"),
    Query("v05_summary_at_account_prices", lambda t: P.apply_multiplier(S.billing_summary(t.usage, t.list_prices, *W).select("total_dbus", "total_spend"), _multiplier(t), ["total_spend"]),
          f"SELECT {DBUS}, {num(f'CAST(sum(spend) AS DOUBLE) * (SELECT m FROM ({_MULTIPLIER}) x)', 'total_spend')} FROM pu"),
    Query("v05_products_at_account_prices", lambda t: P.apply_multiplier(S.by_product_fast(t.usage, t.list_prices, *W), _multiplier(t), ["total_spend"]),
          f"SELECT {L.CATEGORY} AS product_category, {DBUS}, {num(f'CAST(sum(spend) AS DOUBLE) * (SELECT m FROM ({_MULTIPLIER}) x)', 'total_spend')}, {whole('count(DISTINCT workspace_id)', 'workspace_count')} FROM pu GROUP BY 1"),
    Query("v05_series_at_account_prices", lambda t: P.apply_multiplier(S.timeseries_fast(t.usage, t.list_prices, *W), _multiplier(t), ["total_spend"]),
          f"SELECT usage_date, {L.SERIES} AS product_category, {DBUS}, {num(f'CAST(sum(spend) AS DOUBLE) * (SELECT m FROM ({_MULTIPLIER}) x)', 'total_spend')} FROM pu GROUP BY 1, 2"),
    Query("v05_workspaces_at_account_prices", lambda t: P.apply_multiplier(
        S.by_workspace(t.usage, t.list_prices, t.workspaces, *W).select("workspace_id", "workspace_name", "total_dbus", "total_spend"), _multiplier(t), ["total_spend"]),
          f"""SELECT t.*, w.workspace_name FROM (SELECT workspace_id, {DBUS}, {num(f'CAST(sum(spend) AS DOUBLE) * (SELECT m FROM ({_MULTIPLIER}) x)', 'total_spend')} FROM pu GROUP BY 1) t
LEFT JOIN ws w ON t.workspace_id = w.workspace_id"""),
]
