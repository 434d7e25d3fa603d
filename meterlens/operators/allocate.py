"""Splitting warehouse cost over the work done on it (A1, A2, A3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlens.functions import classify as C
from meterlens.operators.joins import join_spread
from meterlens.operators.pricing import day, meta, metered

HOST = "https://HOST"
#: Columns that hold the day of ``start_time`` in tables stored by day.
DAY_COLUMNS = ("start_date", "usage_date")


def started_in(history: DataFrame, start: str, end: str, include_end_day: bool = True) -> DataFrame:
    """Queries, or rows of a cost mart, by start time.

    A table stored by day has that day as a column: filtering it too skips whole folders.
    """
    for stored_by in DAY_COLUMNS:
        if stored_by in history.columns:
            history = history.filter(F.col(stored_by).between(day(start), day(end)))
    last = F.date_add(day(end), 1) if include_end_day else day(end)
    return history.filter((F.col("start_time") >= day(start).cast("timestamp"))
                          & (F.col("start_time") < last.cast("timestamp")))


def warehouse_cost(usage: DataFrame, prices: DataFrame, start: str, end: str) -> DataFrame:
    """SQL cost per (day, warehouse)."""
    rows = metered(usage, prices, start, end, ["usage_date", meta("warehouse_id")],
                   F.col("billing_origin_product") == "SQL")
    return rows.groupBy("usage_date", "warehouse_id").agg(
        F.sum("dbus").alias("dbus"), F.sum("spend").alias("spend"), F.sum("effective_spend").alias("effective_spend"))


def tool_work(history: DataFrame, start: str, end: str, label: Column) -> DataFrame:
    """Work per (tool, day, warehouse)."""
    return (started_in(history, start, end)
            .filter(F.col("executed_as_user_id").isNotNull() & F.col("compute.warehouse_id").isNotNull())
            .groupBy(label.alias("sql_product"), F.to_date("start_time").alias("usage_date"),
                     F.col("compute.warehouse_id").alias("warehouse_id"))
            .agg(F.sum("total_task_duration_ms").alias("work_ms")))


def work_shares(work: DataFrame, keys: list[str]) -> DataFrame:
    """Share of each row of ``work`` in the ``work_ms`` of its key: 0 for a key without any work, null for null work.

    Aggregate and join, not a window: both sides are grouped already, so a
    warehouse with a third of all queries is one row per bucket here.
    """
    total = work.groupBy(*keys).agg(F.sum("work_ms").alias("total_work_ms"))
    share = F.when(F.col("total_work_ms") > 0, F.col("work_ms") / F.col("total_work_ms")).otherwise(F.lit(0.0))
    return work.join(total, keys).withColumn("share", share).drop("total_work_ms")


def share_cost(work: DataFrame, cost: DataFrame, keys: list[str], measures: dict[str, str]) -> DataFrame:
    """Split each measure of ``cost`` over the rows of ``work`` by their share per key.

    Cost without work is dropped (the check on SQL attribution reports it), work
    without cost stays with a null cost, and a key without work costs 0.
    """
    joined = work_shares(work, keys).join(cost, keys, "left")
    return joined.withColumns({
        new: F.when(F.col("share") == 0, F.lit(0.0)).otherwise(F.col("share") * F.col(old).cast("double"))
        for new, old in measures.items()})


def tool_attribution(usage: DataFrame, prices: DataFrame, history: DataFrame, start: str, end: str,
                     label: Column | None = None) -> DataFrame:
    """A1: SQL cost per (tool, day, warehouse), by share of task time."""
    work = tool_work(history, start, end, C.sql_tool() if label is None else label)
    shared = share_cost(work, warehouse_cost(usage, prices, start, end), ["usage_date", "warehouse_id"],
                        {"attributed_dbus": "dbus", "attributed_spend": "spend",
                         "attributed_effective_list_spend": "effective_spend"})
    return shared.select("sql_product", "usage_date", "warehouse_id", "attributed_dbus", "attributed_spend",
                         "attributed_effective_list_spend")


def profile_url(host: str, workspace: Column) -> Column:
    """A3: link to the query profile."""
    millis = (F.unix_timestamp("start_time") * 1000).cast("string")
    return F.concat(F.lit(f"{host}/sql/history?o="), workspace, F.lit("&queryId="), F.col("statement_id"),
                    F.lit("&queryStartTimeMs="), millis)


# fixed values: path of each kind of query source
SOURCE_PATHS = {
    "GENIE SPACE": "/genie/rooms/",
    "AI/BI DASHBOARD": "/sql/dashboardsv3/",
    "LEGACY DASHBOARD": "/sql/dashboards/",
    "SQL QUERY": "/editor/queries/",
    "JOB": "/jobs/",
    "ALERT": "/sql/alerts/",
    "NOTEBOOK": "/editor/notebooks/",
}
HOURLY_MART_SOURCES = ("GENIE SPACE", "AI/BI DASHBOARD", "LEGACY DASHBOARD", "SQL QUERY")


def source_url(host: str, kinds: tuple[str, ...] = tuple(SOURCE_PATHS)) -> Column:
    """A3: link to the object a query came from; null when its kind has no link or no id."""
    links = [F.when(F.col("query_source_type") == k, F.concat(F.lit(host + SOURCE_PATHS[k]), F.col("query_source_id")))
             for k in kinds]
    return F.coalesce(*links)


def cost_per_query(usage: DataFrame, prices: DataFrame, history: DataFrame, start: str, end: str,
                   host: str = HOST) -> DataFrame:
    """A2: each query's share of its warehouse's cost in the hour it started.

    Work is task time, or the duration where task time is missing, and all of it
    goes to the start hour.  Corrections with negative quantities are kept, so
    they net out.  The hourly cost and the hourly work are grouped first; the
    queries then meet one row per (hour, warehouse) in a join that spreads hot cells.
    """
    hour = F.date_trunc("hour", "usage_start_time").alias("hour_bucket")
    billed = (F.col("billing_origin_product") == "SQL") & F.col("usage_metadata.warehouse_id").isNotNull()
    hourly = (metered(usage, prices, start, end, [hour, meta("warehouse_id")], billed, positive=False)
              .groupBy("hour_bucket", "warehouse_id")
              .agg(F.sum("dbus").cast("double").alias("hourly_dbus"), F.sum("spend").cast("double").alias("hourly_dollars")))
    who = F.coalesce("executed_by", "executed_as_user_id")
    client = F.col("client_application")
    duration = F.unix_timestamp("end_time") - F.unix_timestamp("start_time")
    queries = (started_in(history, start, end)
               .filter(F.col("compute.warehouse_id").isNotNull() & (F.col("statement_type") != "CANCEL") & who.isNotNull())
               .select("statement_id", C.client_source_id(client).alias("query_source_id"),
                       C.client_source_type(client, F.col("statement_type")).alias("query_source_type"),
                       "client_application", who.alias("executed_by"), meta_warehouse(), "statement_text",
                       F.col("workspace_id").cast("string").alias("workspace_id"), "start_time", "end_time",
                       duration.alias("duration_seconds"), F.date_trunc("hour", "start_time").alias("hour_bucket"),
                       F.coalesce(F.col("total_task_duration_ms"), duration * 1000).alias("work_ms")))
    cell = ["hour_bucket", "warehouse_id"]
    counts = queries.groupBy(*cell).agg(F.sum("work_ms").alias("total_work_ms"), F.count("*").alias("rows"))
    cells = counts.join(hourly, cell, "left")
    share = F.col("work_ms") / F.col("total_work_ms")

    def attributed(measure: str) -> Column:
        return F.when(F.col("total_work_ms") > 0, share * F.col(measure)).otherwise(F.lit(0.0))
    dollars, dbus = F.col("query_attributed_dollars_estimation"), F.col("query_attributed_dbus_estimation")
    return (join_spread(queries, cells, cell, F.col("statement_id"), counts=counts)
            .withColumn("query_attributed_dollars_estimation", attributed("hourly_dollars"))
            .withColumn("query_attributed_dbus_estimation", attributed("hourly_dbus"))
            .filter((dollars > 0) | (dbus > 0) | (F.col("duration_seconds") > 0))
            .select("statement_id", "query_source_id", "query_source_type", "client_application", "executed_by",
                    "warehouse_id", "statement_text", "workspace_id", "start_time", "end_time", "duration_seconds",
                    dollars, dbus, profile_url(host, F.col("workspace_id")).alias("query_profile_url"),
                    source_url(host, HOURLY_MART_SOURCES).alias("url_helper")))


def meta_warehouse() -> Column:
    return F.col("compute.warehouse_id").alias("warehouse_id")
