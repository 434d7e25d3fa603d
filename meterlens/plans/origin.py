"""Who or what writes queries (O)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlens.functions import classify as C
from meterlens.functions.shape import share_of_total, top, wide
from meterlens.operators.allocate import meta_warehouse, started_in

ORIGINS = ["GENIE", "HUMAN", "MCP_TOOL", "SERVICE_PRINCIPAL"]


def classified(history: DataFrame, cost_mart: DataFrame | None, start: str, end: str) -> DataFrame:
    """Working queries of the range (end day excluded) with origin and cost.

    The cost join is on the statement id, unique per query, so no key is hot.
    Without a cost mart every query costs 0 (K24).
    """
    rows = (started_in(history, start, end, include_end_day=False)
            .filter(F.col("compute.warehouse_id").isNotNull() & (F.col("total_task_duration_ms") > 0)))
    duration = F.unix_timestamp("end_time") - F.unix_timestamp("start_time")
    rows = rows.select("statement_id", F.coalesce("executed_by", "executed_as_user_id").alias("executed_by"),
                       "client_application", "query_tags", meta_warehouse(), "start_time",
                       duration.alias("duration_seconds"), C.query_origin().alias("query_origin"),
                       F.col("query_tags").getItem("authoring_tool").alias("authoring_tool"))
    if cost_mart is None:
        return rows.withColumns({"cost": F.lit(0.0), "dbus": F.lit(0.0), "query_profile_url": F.lit(None).cast("string")})
    mart = started_in(cost_mart, start, end, include_end_day=False).select("statement_id", F.col("query_attributed_dollars_estimation").alias("_cost"),
                            F.col("query_attributed_dbus_estimation").alias("_dbus"), "query_profile_url")
    zero = F.lit(0.0)
    return (rows.join(mart, "statement_id", "left").withColumn("cost", F.coalesce("_cost", zero))
            .withColumn("dbus", F.coalesce("_dbus", zero)).drop("_cost", "_dbus"))


def _measures() -> list[Column]:
    return [F.count("*").alias("query_count"), F.sum("cost").alias("total_spend"), F.sum("dbus").alias("total_dbus")]


def origin_summary(history: DataFrame, cost_mart: DataFrame | None, start: str, end: str) -> DataFrame:
    """O1 with a cost mart, O2 without; O3: percent by cost, or by count when there is no cost."""
    rows = classified(history, cost_mart, start, end).groupBy("query_origin").agg(*_measures())
    basis = "query_count" if cost_mart is None else "total_spend"
    return share_of_total(rows, basis, digits=2).orderBy(F.desc(basis), "query_origin")


def origin_series(history: DataFrame, cost_mart: DataFrame | None, start: str, end: str) -> DataFrame:
    """O4."""
    return (classified(history, cost_mart, start, end)
            .groupBy(F.to_date("start_time").alias("usage_date"), "query_origin")
            .agg(F.count("*").alias("query_count"), F.sum("cost").alias("daily_spend"))
            .orderBy("usage_date", "query_origin"))


def origin_series_wide(series: DataFrame) -> DataFrame:
    """O4, one column per origin; the four origins are fixed."""
    return wide(series.withColumnRenamed("usage_date", "date"), "date", "query_origin", "daily_spend", ORIGINS)


def by_warehouse(history: DataFrame, cost_mart: DataFrame | None, start: str, end: str) -> DataFrame:
    """O5."""
    rows = classified(history, cost_mart, start, end).groupBy("warehouse_id", "query_origin").agg(*_measures())
    return rows.orderBy(F.desc("query_count" if cost_mart is None else "total_spend"), "warehouse_id", "query_origin")


def by_warehouse_nested(rows: DataFrame) -> DataFrame:
    """O5, one row per warehouse with a map of its (at most four) origins."""
    entry = F.struct("query_origin", F.struct("query_count", "total_spend"))
    return (rows.groupBy("warehouse_id")
            .agg(F.sum("total_spend").alias("total_spend"), F.sum("total_dbus").alias("total_dbus"),
                 F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("origins"))
            .orderBy(F.desc("total_spend"), "warehouse_id"))


def top_queries(history: DataFrame, cost_mart: DataFrame | None, start: str, end: str, origin: str, limit: int = 20) -> DataFrame:
    """Dearest queries of one origin, or longest ones when there is no cost."""
    rows = classified(history, cost_mart, start, end).filter(F.col("query_origin") == origin)
    shown = rows.select("statement_id", "executed_by", "client_application", "query_tags", "warehouse_id", "start_time",
                        "duration_seconds", "cost", "dbus", "query_profile_url", "query_origin", "authoring_tool")
    return top(shown, "duration_seconds" if cost_mart is None else "cost", limit, "statement_id")
