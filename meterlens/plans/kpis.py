"""Platform KPIs and KPI series (P)."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlens.functions import classify as C
from meterlens.functions.shape import one_row
from meterlens.operators.allocate import started_in
from meterlens.operators.pricing import QUANTITY, day, in_window, meta, metered, run_as
from meterlens.operators.trend import bucket, roll_up

KPI_COLUMNS = ["total_queries", "unique_query_users", "total_rows_read", "total_bytes_read", "total_compute_seconds",
               "total_jobs", "total_job_runs", "successful_runs", "unique_job_owners", "active_workspaces",
               "active_notebooks", "models_served", "total_serving_dbus"]


def who() -> Column:
    return F.coalesce("executed_by", "executed_as_user_id")


def query_measures() -> list[Column]:
    """Work figures of the query history."""
    def total(name: str) -> Column:
        return F.sum(F.coalesce(F.col(name), F.lit(0)))
    return [F.count("*").alias("total_queries"), F.countDistinct(who()).alias("unique_query_users"),
            total("read_rows").alias("total_rows_read"), total("read_bytes").alias("total_bytes_read"),
            (total("total_task_duration_ms") / 1000.0).alias("total_compute_seconds")]


def _usage_facts(usage: DataFrame, start: str, end: str) -> DataFrame:
    """All usage figures of the KPI row from one scan.

    Records are collapsed per combination of identifiers first.  Each collapsed
    row is then turned into (kind, id) rows for the identifiers it has, and
    these are grouped again: the work of one distinct count per kind, on far
    fewer rows than the bill has.
    """
    served, sql = F.col("sku_name").contains("INFERENCE"), F.col("billing_origin_product") == "SQL"
    combinations = in_window(usage, start, end).groupBy(
        "workspace_id", meta("job_id"), run_as(), meta("cluster_id"), served.alias("served"), sql.alias("sql"),
        F.when(served, F.col("usage_metadata.endpoint_name")).alias("endpoint"),
        F.when(sql, F.col("usage_metadata.warehouse_id")).alias("warehouse")
    ).agg(F.sum("usage_quantity").cast(QUANTITY).alias("dbus"), F.count("*").alias("records"))
    job, owner, cluster = F.col("job_id"), F.col("run_as"), F.col("cluster_id")

    def entry(kind: str, ident: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), ident.cast("string").alias("id")))
    entries = F.array(
        entry("workspace", F.col("workspace_id"), F.col("workspace_id").isNotNull()), entry("job", job, job.isNotNull()),
        entry("owner", owner, job.isNotNull() & owner.isNotNull()), entry("cluster", cluster, cluster.isNotNull()),
        entry("served", F.col("endpoint"), F.col("served")), entry("sql", F.col("warehouse"), F.col("sql")))
    ids = (combinations.select("dbus", "records", F.explode(entries).alias("e"))
           .filter(F.col("e").isNotNull()).groupBy("e.kind", "e.id")
           .agg(F.sum("dbus").alias("dbus"), F.sum("records").alias("records")))

    def of(kind: str, column: str) -> Column:
        return F.when(F.col("kind") == kind, F.col(column))

    def total(kind: str, column: str) -> Column:
        return F.coalesce(F.sum(of(kind, column)), F.lit(0))
    return ids.agg(
        F.count(of("workspace", "id")).alias("active_workspaces"), F.count(of("job", "id")).alias("total_jobs"),
        total("job", "records").alias("total_job_runs"), F.count(of("owner", "id")).alias("unique_job_owners"),
        F.count(of("cluster", "id")).alias("active_notebooks"), F.count(of("served", "id")).alias("models_served"),
        total("served", "dbus").alias("total_serving_dbus"), F.count(of("sql", "id")).alias("sql_warehouses"),
        total("sql", "dbus").alias("sql_dbus"))


def _run_facts(job_runs: DataFrame, start: str, end: str) -> DataFrame:
    begun = F.col("period_start_time")
    ok = F.count(F.when(F.col("result_state") == "SUCCEEDED", 1))
    return (job_runs.filter((begun >= day(start).cast("timestamp")) & (begun < F.date_add(day(end), 1).cast("timestamp")))
            .agg(ok.alias("successful_runs")))


def platform_kpis(usage: DataFrame, history: DataFrame, job_runs: DataFrame, start: str, end: str) -> DataFrame:
    """One row; each input is scanned once and the one-row results are stacked, not joined."""
    queries = started_in(history, start, end).agg(*query_measures())
    facts = one_row(queries, _usage_facts(usage, start, end).drop("sql_warehouses", "sql_dbus"),
                    _run_facts(job_runs, start, end))
    return facts.select(*KPI_COLUMNS)


def platform_kpis_fast(usage: DataFrame, job_runs: DataFrame, start: str, end: str) -> DataFrame:
    """Without the query history, whose figures read 0."""
    facts = one_row(_usage_facts(usage, start, end), _run_facts(job_runs, start, end))
    zeros = {c: F.lit(0).cast("long") for c in KPI_COLUMNS[:5]}
    return facts.withColumns(zeros).select(*KPI_COLUMNS, "sql_warehouses", "sql_dbus")


def distinct_query_users(cost_mart: DataFrame, start: str, end: str) -> DataFrame:
    """Exact distinct users of the range, from the per-query mart."""
    return started_in(cost_mart, start, end).agg(F.countDistinct("executed_by").alias("unique_query_users"))


@dataclass(frozen=True)
class Kpi:
    """A daily figure of the usage table: what is kept and how it is measured."""
    measure: str                                   # spend, dbus, records or a column to count distinct
    where: Callable[[], Column] | None = None
    only_if: Callable[[], Column] | None = None    # conditional sum: the other rows count 0, their days stay
    average: bool = False                          # averaged, not summed, over weeks and months


def _apps() -> Column:
    return F.col("billing_origin_product") == "APPS"


def _has(name: str) -> Callable[[], Column]:
    return lambda: F.col(f"usage_metadata.{name}").isNotNull()


USAGE_KPIS: dict[str, Kpi] = {
    "total_spend": Kpi("spend"),
    "avg_daily_spend": Kpi("spend", average=True),
    "total_dbus": Kpi("dbus"),
    "workspace_count": Kpi("workspace_id"),
    "aiml_spend": Kpi("spend", C.is_model_serving),
    "aiml_dbus": Kpi("dbus", C.is_model_serving),
    "aiml_endpoints": Kpi("usage_metadata.endpoint_name",
                          lambda: C.is_serving_endpoint() & F.col("usage_metadata.endpoint_name").isNotNull()),
    "tagged_spend": Kpi("spend", only_if=C.has_tags),
    "untagged_spend": Kpi("spend", only_if=lambda: ~C.has_tags()),
    "infra_cost": Kpi("spend", C.is_infra_or_sql_sku),
    "infra_clusters": Kpi("usage_metadata.cluster_id", _has("cluster_id")),
    "infra_dbu_hours": Kpi("dbus", C.is_infra_sku),
    "avg_cost_per_cluster": Kpi("spend per cluster", lambda: C.is_infra_sku() & _has("cluster_id")(), average=True),
    "apps_spend": Kpi("spend", _apps),
    "apps_dbus": Kpi("dbus", _apps),
    "apps_count": Kpi("app", _apps),
    "total_jobs": Kpi("usage_metadata.job_id", _has("job_id")),
    "total_job_runs": Kpi("records", _has("job_id")),
    "active_notebooks": Kpi("usage_metadata.cluster_id", _has("cluster_id")),
    "active_workspaces": Kpi("workspace_id"),
    "models_served": Kpi("usage_metadata.endpoint_name", lambda: F.col("sku_name").contains("INFERENCE")),
}


def usage_kpi(usage: DataFrame, prices: DataFrame, start: str, end: str, kpi: str, granularity: str = "daily") -> DataFrame:
    """A KPI as (date, value).

    Sums and distinct counts are aggregated straight into the asked bucket, so a
    weekly distinct is a true one and not a sum of days; rates are averaged over
    their daily values.
    """
    spec = USAGE_KPIS[kpi]
    unit = "daily" if spec.average else granularity
    date = bucket("usage_date", unit).alias("date")
    where = spec.where() if spec.where else None
    if spec.measure in ("spend", "dbus", "records"):
        flag = (spec.only_if() if spec.only_if else F.lit(True)).alias("counted")
        rows = metered(usage, prices, start, end, [date, flag], where)
        value = F.sum(F.when(F.col("counted"), F.col(spec.measure)).otherwise(0))
    elif spec.measure == "spend per cluster":
        rows = metered(usage, prices, start, end, [date, meta("cluster_id")], where)
        value = F.sum("spend").cast("double") / F.countDistinct("cluster_id")
    else:
        counted = (F.coalesce(F.col("usage_metadata.app_id"), F.lit("unknown")) if spec.measure == "app"
                   else F.col(spec.measure))
        rows = in_window(usage, start, end)
        rows = (rows if where is None else rows.filter(where)).select(date, counted.alias("counted"))
        value = F.countDistinct("counted")
    series = rows.groupBy("date").agg(value.alias("value")).orderBy("date")
    return roll_up(series, granularity, average=True) if spec.average and granularity != "daily" else series


def _sum0(name: str) -> Column:
    return F.sum(F.coalesce(F.col(name), F.lit(0)))


QUERY_KPIS: dict[str, Callable[[], Column]] = {
    "total_queries": lambda: F.count("*"),
    "total_rows_read": lambda: _sum0("read_rows"),
    "total_bytes_read": lambda: _sum0("read_bytes"),
    "total_compute_seconds": lambda: _sum0("total_task_duration_ms") / 1000.0,
    "total_users": lambda: F.countDistinct(who()),
    "avg_query_duration": lambda: F.avg(F.coalesce(F.col("total_task_duration_ms"), F.lit(0))) / 1000.0,
    "unique_warehouses": lambda: F.countDistinct("compute.warehouse_id"),
}
#: Rows a KPI leaves out before grouping, so a day with none of them has no point.
QUERY_KPI_NEEDS = {"total_users": lambda: who().isNotNull(),
                   "unique_warehouses": lambda: F.col("compute.warehouse_id").isNotNull()}


def query_kpi(history: DataFrame, start: str, end: str, kpi: str, granularity: str = "daily") -> DataFrame:
    """A KPI of the query history as (date, value)."""
    rows = started_in(history, start, end)
    if kpi in QUERY_KPI_NEEDS:
        rows = rows.filter(QUERY_KPI_NEEDS[kpi]())
    averaged = kpi == "avg_query_duration"
    date = bucket(F.to_date("start_time"), "daily" if averaged else granularity)
    series = rows.groupBy(date.alias("date")).agg(QUERY_KPIS[kpi]().alias("value")).orderBy("date")
    return roll_up(series, granularity, average=True) if averaged and granularity != "daily" else series


def successful_runs(job_runs: DataFrame, start: str, end: str, granularity: str = "daily") -> DataFrame:
    """P18."""
    begun = F.col("period_start_time")
    rows = job_runs.filter((begun >= day(start).cast("timestamp")) & (begun < F.date_add(day(end), 1).cast("timestamp")))
    return (rows.groupBy(bucket(F.to_date(begun), granularity).alias("date"))
            .agg(F.count(F.when(F.col("result_state") == "SUCCEEDED", 1)).alias("value")).orderBy("date"))
