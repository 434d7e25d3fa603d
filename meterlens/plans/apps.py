"""App hosting cost (R)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from meterlens.functions.shape import grand_total
from meterlens.operators.pricing import day, in_window, meta, metered, run_as, totals
from meterlens.operators.trend import bucket

#: An app is active when it was used in the last days of the window.
ACTIVE_DAYS = 7


def _is_app() -> Column:
    return F.col("billing_origin_product") == "APPS"


def app_id(missing: str = "Unknown") -> Column:
    return F.coalesce("app_id", F.lit(missing)).alias("app_id")


def _rows(usage: DataFrame, prices: DataFrame, start: str, end: str, registry: DataFrame | None = None,
          dims: tuple[str, ...] = ("usage_date", "workspace_id")) -> DataFrame:
    rows = metered(usage, prices, start, end, [*dims, meta("app_id")], _is_app())
    return rows if registry is None else rows.join(registry.select("app_id"), "app_id", "left_semi")


def summary(usage: DataFrame, prices: DataFrame, start: str, end: str) -> DataFrame:
    """R1; usage without an app id counts as one unknown app."""
    return _rows(usage, prices, start, end).agg(
        *totals(), F.countDistinct("workspace_id").alias("workspace_count"),
        F.countDistinct(app_id("unknown")).alias("app_count"), F.countDistinct("usage_date").alias("days_in_range"),
        F.min("usage_date").alias("first_date"), F.max("usage_date").alias("last_date"))


def by_app(usage: DataFrame, prices: DataFrame, start: str, end: str) -> DataFrame:
    """R2."""
    return (_rows(usage, prices, start, end).groupBy(app_id())
            .agg(*totals(), F.countDistinct("workspace_id").alias("workspace_count"),
                 F.countDistinct("usage_date").alias("days_active"), F.max("usage_date").alias("last_usage_date"))
            .orderBy(F.desc("total_spend"), "app_id"))


def _app_usage(usage: DataFrame, start: str, end: str) -> DataFrame:
    return in_window(usage, start, end).filter(_is_app()).withColumn("app_id", F.col("usage_metadata.app_id"))


def app_workspaces(usage: DataFrame, workspaces: DataFrame | None, start: str, end: str) -> DataFrame:
    """Workspace names per app, the id standing in for a missing name or a missing table."""
    pairs = _app_usage(usage, start, end).select(app_id(), "workspace_id").distinct()
    ident = F.col("workspace_id").cast("string")
    if workspaces is None:
        return pairs.withColumn("workspace_name", ident)
    return (pairs.join(workspaces.select("workspace_id", F.col("workspace_name").alias("_name")), "workspace_id", "left")
            .select("app_id", "workspace_id", F.coalesce("_name", ident).alias("workspace_name")))


def app_identities(usage: DataFrame, start: str, end: str) -> DataFrame:
    """R4."""
    return (_app_usage(usage, start, end).select(app_id(), run_as()).filter(F.col("run_as").isNotNull()).distinct())


def timeseries(usage: DataFrame, prices: DataFrame, start: str, end: str, registry: DataFrame | None = None) -> DataFrame:
    """R5; R5b with a registry, for registered apps only."""
    return _rows(usage, prices, start, end, registry, ("usage_date",)).groupBy("usage_date").agg(*totals()).orderBy("usage_date")


def by_app_and_sku(usage: DataFrame, prices: DataFrame, start: str, end: str) -> DataFrame:
    """R6, with the percent within each app; the window runs over the few SKUs of an app."""
    grouped = _rows(usage, prices, start, end, dims=("sku_name",)).groupBy(app_id(), "sku_name").agg(*totals())
    whole = F.sum(F.col("total_spend").cast("double")).over(W.partitionBy("app_id"))
    percent = F.coalesce(F.try_divide(100 * F.col("total_spend").cast("double"), whole), F.lit(0.0))
    return grouped.withColumn("percentage", percent).orderBy("app_id", F.desc("total_spend"), "sku_name")


def app_status(by_app_report: DataFrame, registry: DataFrame, as_of: str, active_only: bool = False) -> DataFrame:
    """Registered apps and their state.

    Active means used within the last seven days of the window.  The full list
    also has registered apps without usage and inactive apps that are no longer
    registered; apps that are active but unregistered show only in the summary.
    """
    names = registry.select("app_id", F.col("name").alias("_name"), F.col("url").alias("_url")).withColumn("_known", F.lit(True))
    used = by_app_report.withColumn("_active", F.col("last_usage_date") >= F.date_sub(day(as_of), ACTIVE_DAYS))
    source = used.filter("_active") if active_only else used
    whole = grand_total(source, "total_spend")
    rows = source.join(names, "app_id", "full_outer" if not active_only else "left")
    known, active = F.coalesce("_known", F.lit(False)), F.coalesce("_active", F.lit(False))
    spend = F.coalesce(F.col("total_spend").cast("double"), F.lit(0.0))
    return (rows.filter(known | (~active & F.lit(not active_only)))
            .select("app_id", F.coalesce("_name", "app_id").alias("app_name"), F.coalesce("_url", F.lit("")).alias("app_url"),
                    F.coalesce(F.col("total_dbus").cast("double"), F.lit(0.0)).alias("total_dbus"), spend.alias("total_spend"),
                    F.coalesce("workspace_count", F.lit(0)).alias("workspace_count"),
                    F.coalesce("days_active", F.lit(0)).alias("days_active"), "last_usage_date",
                    F.coalesce(F.try_divide(100 * spend, whole), F.lit(0.0)).alias("percentage"),
                    known.alias("is_registered"), F.when(active, "active").otherwise("inactive").alias("status"))
            .orderBy(F.desc("total_spend"), "app_id"))


def app_status_summary(by_app_report: DataFrame, registry: DataFrame, as_of: str) -> DataFrame:
    """Count, spend and percent of inactive and of unregistered apps.

    The inactive percent is of all spend plus inactive spend, as the list total
    it is shown against leaves inactive apps out.
    """
    rows = (by_app_report.withColumn("_active", F.col("last_usage_date") >= F.date_sub(day(as_of), ACTIVE_DAYS))
            .join(registry.select("app_id").withColumn("_known", F.lit(True)), "app_id", "left"))
    whole = grand_total(by_app_report, "total_spend")

    def part(label: str, keep: Column, add_own: bool) -> DataFrame:
        mine = rows.filter(keep).agg(F.count("*").alias("count"),
                                     F.coalesce(F.sum(F.col("total_spend").cast("double")), F.lit(0.0)).alias("total_spend"),
                                     F.coalesce(F.sum(F.col("total_dbus").cast("double")), F.lit(0.0)).alias("total_dbus"))
        base = whole + F.col("total_spend") if add_own else whole
        return mine.select(F.lit(label).alias("part"), "count", "total_spend", "total_dbus",
                           F.coalesce(F.try_divide(100 * F.col("total_spend"), base), F.lit(0.0)).alias("percentage"))
    return part("inactive", ~F.col("_active"), True).unionByName(part("unregistered", F.col("_known").isNull(), False))


def app_kpi(usage: DataFrame, prices: DataFrame, registry: DataFrame, start: str, end: str, kpi: str,
            granularity: str = "daily") -> DataFrame:
    """apps_spend, apps_dbus or apps_count of registered apps as (date, value).

    Counts are distinct within the asked bucket, not summed over its days.
    """
    measure = {"apps_spend": F.sum("spend"), "apps_dbus": F.sum("dbus"), "apps_count": F.countDistinct("app_id")}[kpi]
    return (_rows(usage, prices, start, end, registry).groupBy(bucket("usage_date", granularity).alias("date"))
            .agg(measure.alias("value")).orderBy("date"))


# fixed values: yearly cost of hosting one app oneself (item, low, high)
HOSTING_COSTS = [
    ("Compute", 840, 840), ("Load balancer", 200, 400), ("NAT gateway", 200, 400), ("DevOps and CI/CD setup", 8000, 15000),
    ("Ongoing maintenance", 12000, 25000), ("Security and compliance", 5000, 10000), ("Observability stack", 2500, 5000),
    ("Data access layer", 7000, 15000),
]


def hosting_comparison(by_app_report: DataFrame, days: int) -> DataFrame:
    """An R2 report annualised and compared with hosting each app oneself."""
    low, high = (float(sum(c[i] for c in HOSTING_COSTS)) for i in (1, 2))
    spend = F.col("total_spend").cast("double")
    annual = spend / days * 365 if days > 0 else spend * 12
    middle = (low + high) / 2
    return by_app_report.select(
        "app_id", annual.alias("annual_spend"), F.lit(low).alias("diy_low"), F.lit(high).alias("diy_high"),
        (low - annual).alias("savings_low"), (high - annual).alias("savings_high"),
        ((middle - annual) / middle * 100).alias("savings_percent"))
