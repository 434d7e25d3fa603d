"""Reports on a per-query cost mart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlens.functions.shape import latest_rows, names_of, one_row, share_of_total, top, wide
from meterlens.operators.allocate import started_in, warehouse_cost

COST, DBUS = "query_attributed_dollars_estimation", "query_attributed_dbus_estimation"


def _range(mart: DataFrame, start: str, end: str) -> DataFrame:
    """These reports leave the end day out."""
    return started_in(mart, start, end, include_end_day=False)


def _sums() -> list[Column]:
    return [F.count("*").alias("query_count"), F.sum(COST).alias("total_spend"), F.sum(DBUS).alias("total_dbus")]


def data_range(mart: DataFrame) -> DataFrame:
    """A5."""
    return mart.agg(F.to_date(F.min("start_time")).alias("earliest_date"),
                    F.to_date(F.max("start_time")).alias("latest_date"), F.count("*").alias("total_rows"))


def by_source(mart: DataFrame, start: str, end: str) -> DataFrame:
    """A6."""
    return (_range(mart, start, end).groupBy("query_source_type")
            .agg(*_sums(), F.avg(COST).alias("avg_cost_per_query")).orderBy(F.desc_nulls_last("total_spend")))


def by_user(mart: DataFrame, start: str, end: str, limit: int | None = 100) -> DataFrame:
    """A7; a roll-up (A7b) needs every row, ``limit=None``."""
    users = _range(mart, start, end).groupBy("executed_by", "query_source_type").agg(*_sums())
    return top(users, "total_spend", limit, "executed_by", "query_source_type")


def top_users(by_user_report: DataFrame, limit: int = 10) -> DataFrame:
    """An A7 report per user."""
    users = by_user_report.groupBy(F.col("executed_by").alias("user")).agg(
        F.sum("total_spend").alias("total_spend"), F.sum("query_count").alias("query_count"))
    return top(users, "total_spend", limit, "user")


def top_queries(mart: DataFrame, start: str, end: str, limit: int = 20, source_type: str | None = None) -> DataFrame:
    """A8, and A9 with a source type.

    The preview is cut when the row is shown; ordering and ties use the id, so
    long statement texts are only read for the listed rows' stage.
    """
    rows = _range(mart, start, end)
    if source_type is not None:
        rows = rows.filter(F.col("query_source_type") == source_type)
    shown = rows.select("statement_id", "query_source_type", "query_source_id", "executed_by", "warehouse_id",
                        "workspace_id", F.substring("statement_text", 1, 200).alias("statement_preview"),
                        "duration_seconds", F.col(COST).alias("cost"), F.col(DBUS).alias("dbus"), "query_profile_url",
                        F.col("url_helper").alias("source_url"), "start_time", "end_time")
    return top(shown, "cost", limit, "statement_id")


def top_queries_by_source(mart: DataFrame, start: str, end: str, source_type: str, limit: int = 10) -> DataFrame:
    """A list of at most 20 rows; asking for more is an error."""
    if limit > 20:
        raise ValueError("this report lists at most 20 queries; use top_queries")
    return top_queries(mart, start, end, limit, source_type)


def summary(mart: DataFrame, start: str, end: str) -> DataFrame:
    """A10."""
    return _range(mart, start, end).agg(
        F.count("*").alias("total_queries"), F.countDistinct("executed_by").alias("unique_users"),
        F.countDistinct("warehouse_id").alias("unique_warehouses"), F.sum(COST).alias("total_spend"),
        F.sum(DBUS).alias("total_dbus"), F.avg(COST).alias("avg_cost_per_query"),
        F.avg("duration_seconds").alias("avg_duration_seconds"))


def by_warehouse(mart: DataFrame, start: str, end: str, limit: int | None = 50) -> DataFrame:
    """A11; totals over it (A12, A19) need every row, ``limit=None``."""
    rows = _range(mart, start, end).groupBy("warehouse_id").agg(*_sums(), F.countDistinct("executed_by").alias("unique_users"))
    return top(rows.select("warehouse_id", "query_count", "unique_users", "total_spend", "total_dbus"), "total_spend",
               limit, "warehouse_id")


def warehouse_facts(warehouses: DataFrame, workspaces: DataFrame) -> DataFrame:
    """The latest row of each warehouse in the change log, missing type CLASSIC and missing size UNKNOWN."""
    latest = latest_rows(warehouses, "warehouse_id", ["warehouse_name", "warehouse_type", "warehouse_size", "workspace_id"])
    return (latest.join(workspaces.select("workspace_id", "workspace_name"), "workspace_id", "left")
            .select("warehouse_id", "warehouse_name", F.coalesce("warehouse_type", F.lit("CLASSIC")).alias("warehouse_type"),
                    F.coalesce("warehouse_size", F.lit("UNKNOWN")).alias("warehouse_size"),
                    F.col("workspace_id").cast("string").alias("workspace_id"), "workspace_name"))


def by_warehouse_enriched(mart: DataFrame, warehouses: DataFrame, workspaces: DataFrame, start: str, end: str,
                          limit: int | None = 50) -> DataFrame:
    """Names join the grouped warehouses; percentages are of all of them, and the list is cut last."""
    rows = by_warehouse(mart, start, end, None).join(warehouse_facts(warehouses, workspaces), "warehouse_id", "left")
    return top(share_of_total(rows, "total_spend"), "total_spend", limit, "warehouse_id")


def timeseries(mart: DataFrame, start: str, end: str) -> DataFrame:
    """Day x source."""
    return (_range(mart, start, end).groupBy(F.to_date("start_time").alias("date"), "query_source_type")
            .agg(F.count("*").alias("query_count"), F.sum(COST).alias("daily_spend"), F.sum(DBUS).alias("daily_dbus"))
            .orderBy("date", "query_source_type"))


def series_wide(series: DataFrame, names: str, labels: list[str] | None = None) -> DataFrame:
    """One column per label that occurs, 0 filled.

    Without a label list one is read first, a small set of names.
    """
    return wide(series, "date", names, "daily_spend", labels or names_of(series, names))


def warehouse_type_timeseries(usage: DataFrame, prices: DataFrame, warehouses: DataFrame, start: str, end: str) -> DataFrame:
    """SQL cost per day and warehouse type; a warehouse without one is CLASSIC."""
    types = latest_rows(warehouses, "warehouse_id", ["warehouse_type"]).withColumnRenamed("warehouse_type", "_type")
    kind = F.coalesce("_type", F.lit("CLASSIC"))
    return (warehouse_cost(usage, prices, start, end).join(types, "warehouse_id", "left")
            .groupBy(F.col("usage_date").alias("date"), kind.alias("warehouse_type"))
            .agg(F.sum("spend").alias("daily_spend")).orderBy("date", "warehouse_type"))


# fixed values: lower bound of utilisation for each grade
GRADES = [(80, "A"), (60, "B"), (40, "C"), (20, "D")]


def grade(utilization: Column) -> Column:
    """A17."""
    return F.coalesce(*[F.when(utilization >= bound, letter) for bound, letter in GRADES], F.lit("F"))


def use_status(utilization: Column) -> Column:
    return F.when(utilization > 60, "good").when(utilization > 30, "warning").otherwise("critical")


def idle_status(idle: Column) -> Column:
    return F.when(idle > 70, "critical").when(idle > 40, "warning").otherwise("good")


def _method(mart: DataFrame, start: str, end: str, prefix: str) -> DataFrame:
    return _range(mart, start, end).agg(
        F.count("*").alias(f"{prefix}_total_queries"), F.coalesce(F.sum(COST), F.lit(0.0)).alias(f"{prefix}_total_spend"),
        F.coalesce(F.sum(DBUS), F.lit(0.0)).alias(f"{prefix}_total_dbus"),
        F.coalesce(F.avg(COST), F.lit(0.0)).alias(f"{prefix}_avg_cost_per_query"))


def method_comparison(share_mart: DataFrame, utilized_mart: DataFrame, start: str, end: str) -> DataFrame:
    """Whole-bill allocation against utilised-time allocation; the difference is idle cost."""
    both = one_row(_method(share_mart, start, end, "original"), _method(utilized_mart, start, end, "utilized"))
    used = F.when(F.col("original_total_spend") > 0,
                  F.col("utilized_total_spend") / F.col("original_total_spend") * 100).otherwise(F.lit(0.0))
    return (both.withColumn("total_idle_cost", F.col("original_total_spend") - F.col("utilized_total_spend"))
            .withColumn("utilization_percentage", used).withColumn("idle_percentage", 100 - used)
            .withColumn("idle_status", idle_status(F.col("idle_percentage")))
            .withColumn("status", use_status(used)).withColumn("grade", grade(used)))


def warehouse_efficiency(share_mart: DataFrame, utilized_mart: DataFrame, start: str, end: str,
                         min_cost: float = 10.0) -> DataFrame:
    """Per warehouse, for warehouses that cost at least ``min_cost``."""
    def side(mart: DataFrame, queries: str, cost: str, dbus: str) -> DataFrame:
        return _range(mart, start, end).groupBy("warehouse_id").agg(
            F.count("*").alias(queries), F.sum(COST).alias(cost), F.sum(DBUS).alias(dbus))
    both = (side(share_mart, "total_queries", "total_cost", "total_dbus")
            .join(side(utilized_mart, "utilized_queries", "utilized_cost", "utilized_dbus"), "warehouse_id", "full_outer")
            .na.fill(0).filter(F.col("total_cost") >= min_cost))
    used = F.when(F.col("total_cost") > 0, F.col("utilized_cost") / F.col("total_cost") * 100).otherwise(F.lit(0.0))
    idle = F.col("idle_percentage")
    advice = (F.when(idle > 80, "CRITICAL: Enable auto-stop or migrate to serverless")
               .when(idle > 60, "Reduce auto-stop timeout to 5 minutes")
               .when(idle > 40, "Review usage patterns and consider consolidation")
               .otherwise("Good utilization - monitor for optimization opportunities"))
    return (both.withColumn("idle_cost", F.col("total_cost") - F.col("utilized_cost"))
            .withColumn("utilization_percentage", used).withColumn("idle_percentage", 100 - used)
            .select("warehouse_id", "total_queries", "utilized_queries", "total_cost", "utilized_cost", "idle_cost",
                    "total_dbus", "utilized_dbus", "utilization_percentage", "idle_percentage",
                    grade(F.col("utilization_percentage")).alias("efficiency_grade"),
                    use_status(F.col("utilization_percentage")).alias("status"), advice.alias("recommendation"))
            .orderBy(F.desc("idle_cost"), "warehouse_id"))


# fixed values: idle band (above, up to), priority, title, share of idle cost saved, effort
ADVICE = [
    (70, 1000, "critical", "Reduce Auto-Stop Timeout", 0.6, "low"),
    (70, 1000, "critical", "Enable Serverless SQL Warehouses", 0.95, "medium"),
    (70, 1000, "high", "Consolidate Underutilized Warehouses", 0.4, "high"),
    (40, 70, "high", "Optimize Auto-Stop Settings", 0.3, "low"),
    (40, 70, "medium", "Right-Size Warehouse Clusters", 0.25, "medium"),
    (-1000, 40, "low", "Maintain Good Efficiency", 0.1, "low"),
    (50, 1000, "medium", "Implement Warehouse Usage Policies", 0.2, "low"),
]


def recommendations(comparison: DataFrame) -> DataFrame:
    """Advice for an A15 row, from the rule table above.

    Tuning slow queries is always advised; what it saves grows with utilisation.
    """
    idle, used, cost = F.col("idle_percentage"), F.col("utilization_percentage"), F.col("total_idle_cost")

    def entry(when: Column, priority: Column, title: str, saved: Column, effort: str) -> Column:
        return F.when(when, F.struct(priority.alias("priority"), F.lit(title).alias("title"),
                                     saved.cast("double").alias("potential_savings"), F.lit(effort).alias("effort")))
    entries = [entry((idle > low) & (idle <= high), F.lit(priority), title, cost * share, effort)
               for low, high, priority, title, share, effort in ADVICE]
    entries.append(entry(F.lit(True), F.when(used < 40, "medium").otherwise("low"), "Optimize Slow Queries",
                         cost * 0.15 + cost * used / 100 * 0.2, "medium"))
    return comparison.select(F.explode(F.array_compact(F.array(*entries))).alias("r")).select("r.*")


def count_by_size(warehouse_report: DataFrame, workspace_id: str | None = None) -> DataFrame:
    """Warehouses of an uncut A12 report by size; unknown sizes are dropped."""
    rows = warehouse_report if workspace_id is None else warehouse_report.filter(F.col("workspace_id") == workspace_id)
    known = rows.filter(F.col("warehouse_size").isNotNull() & (F.col("warehouse_size") != "UNKNOWN"))
    return known.groupBy("warehouse_size").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "warehouse_size")
