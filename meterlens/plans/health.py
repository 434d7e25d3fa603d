"""Warehouse right-sizing (H).  All windows end at ``as_of``, a timestamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# fixed values: thresholds of the three findings
IDLE_LOOKBACK_HOURS = 2
IDLE_NO_QUERY_HOURS = 24
HISTORY_DAYS = 30
CONCURRENCY_PER_CLUSTER = 10
MAX_QUEUE_MS = 5000
MAX_MEDIAN_SECONDS = 30
MIN_QUERIES = 10
LARGE_SIZES = ("Large", "X-Large", "2X-Large", "3X-Large", "4X-Large")


def _since(as_of: str, hours: int) -> Column:
    return F.lit(as_of).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours))


def current_warehouses(warehouses: DataFrame) -> DataFrame:
    """Latest row of the change log per warehouse, as an aggregate and not a sorted window."""
    row = F.struct("warehouse_name", "warehouse_size", "workspace_id", "warehouse_type")
    return (warehouses.groupBy("warehouse_id").agg(F.max_by(row, "change_time").alias("w")).select("warehouse_id", "w.*"))


def idle_running(warehouses: DataFrame, events: DataFrame, history: DataFrame, as_of: str,
                 lookback_hours: int = IDLE_LOOKBACK_HOURS, no_query_hours: int = IDLE_NO_QUERY_HOURS) -> DataFrame:
    """H1: up recently, no query for a day, not serverless.

    Only the look-back is read: a warehouse that was up in it has its last event in it.
    """
    up = F.max(F.when(F.col("cluster_count") > 0, True))
    running = (events.filter(F.col("event_time") >= _since(as_of, lookback_hours)).groupBy("warehouse_id")
               .agg(up.alias("up"), F.max("event_time").alias("last_event_time"))
               .filter(F.col("up")).drop("up"))
    queried = (history.filter((F.col("start_time") >= _since(as_of, no_query_hours)) & F.col("compute.warehouse_id").isNotNull())
               .select(F.col("compute.warehouse_id").alias("warehouse_id")).distinct())
    return (running.join(current_warehouses(warehouses), "warehouse_id").join(queried, "warehouse_id", "left_anti")
            .filter(F.coalesce("warehouse_type", F.lit("CLASSIC")) != "SERVERLESS")
            .select("warehouse_id", "warehouse_name", "warehouse_size", "workspace_id", "warehouse_type", "last_event_time"))


def over_scaled(warehouses: DataFrame, events: DataFrame, history: DataFrame, as_of: str, days: int = HISTORY_DAYS) -> DataFrame:
    """H2: scaled to two clusters or more with few query starts per minute."""
    since = _since(as_of, 24 * days)
    scaled = (events.filter(F.col("event_time") >= since).groupBy("warehouse_id")
              .agg(F.max("cluster_count").alias("max_clusters_observed")).filter(F.col("max_clusters_observed") >= 2))
    peak = (history.filter((F.col("start_time") >= since) & F.col("compute.warehouse_id").isNotNull())
            .groupBy(F.col("compute.warehouse_id").alias("warehouse_id"), F.date_trunc("minute", "start_time").alias("m"))
            .agg(F.count("*").alias("started")).groupBy("warehouse_id").agg(F.max("started").alias("peak")))
    concurrent = F.coalesce("peak", F.lit(0))
    return (scaled.join(current_warehouses(warehouses), "warehouse_id").join(peak, "warehouse_id", "left")
            .filter(concurrent < F.col("max_clusters_observed") * CONCURRENCY_PER_CLUSTER)
            .select("warehouse_id", "warehouse_name", "warehouse_size", "workspace_id", "max_clusters_observed",
                    concurrent.alias("max_concurrent")))


def oversized(warehouses: DataFrame, history: DataFrame, as_of: str, days: int = HISTORY_DAYS,
              max_median_seconds: int = MAX_MEDIAN_SECONDS) -> DataFrame:
    """H3: a large size with short queues and short queries.

    The latest *large* row of each warehouse counts.  The median is exact: the
    queries of a warehouse are folded to a count per whole second of duration,
    and the window runs over those seconds, not over queries.
    """
    queue = F.coalesce("waiting_at_capacity_duration_ms", F.lit(0)) + F.coalesce("waiting_for_compute_duration_ms", F.lit(0))
    seconds = F.unix_timestamp("end_time") - F.unix_timestamp("start_time")
    counts = (history.filter((F.col("start_time") >= _since(as_of, 24 * days)) & F.col("compute.warehouse_id").isNotNull()
                             & (F.col("total_task_duration_ms") > 0) & F.col("end_time").isNotNull())
              .groupBy(F.col("compute.warehouse_id").alias("warehouse_id"), seconds.alias("seconds"))
              .agg(F.count("*").alias("n"), F.sum(queue).alias("queue")))
    of_warehouse = W.partitionBy("warehouse_id")
    below = F.sum("n").over(of_warehouse.orderBy("seconds").rowsBetween(W.unboundedPreceding, 0))
    ranked = counts.withColumn("below", below).withColumn("all", F.sum("n").over(of_warehouse))
    stats = (ranked.groupBy("warehouse_id")
             .agg(F.sum("n").alias("query_count"), (F.sum("queue") / F.sum("n")).alias("avg_queue_ms"),
                  F.min(F.when(F.col("below") * 2 >= F.col("all"), F.col("seconds"))).alias("median_duration_seconds"))
             .filter((F.col("query_count") >= MIN_QUERIES) & (F.col("avg_queue_ms") < MAX_QUEUE_MS)
                     & (F.col("median_duration_seconds") < max_median_seconds)))
    large = current_warehouses(warehouses.filter(F.col("warehouse_size").isin(*LARGE_SIZES)))
    return large.join(stats, "warehouse_id").select("warehouse_id", "warehouse_name", "warehouse_size", "workspace_id",
                                                     "query_count", "avg_queue_ms", "median_duration_seconds")


def recommendations(warehouses: DataFrame, events: DataFrame, history: DataFrame, as_of: str,
                    lookback_hours: int = IDLE_LOOKBACK_HOURS, warehouse_id: str | None = None,
                    max_median_seconds: int = MAX_MEDIAN_SECONDS) -> DataFrame:
    """H4: all findings with a text, most actionable first.  H5: those of one warehouse."""
    idle = (idle_running(warehouses, events, history, as_of, lookback_hours)
            .withColumn("recommendation_type", F.lit("IDLE_RUNNING")).withColumn("_rank", F.lit(0))
            .withColumn("recommendation_text", F.lit(
                f"Warehouse has been running for {lookback_hours}+ hours with no queries in the last "
                f"{IDLE_NO_QUERY_HOURS}h. Consider reducing auto_stop_minutes.")))
    scaled = (over_scaled(warehouses, events, history, as_of)
              .withColumn("recommendation_type", F.lit("OVER_SCALED")).withColumn("_rank", F.lit(1))
              .withColumn("recommendation_text", F.format_string(
                  "Warehouse scaled to %d clusters but peak concurrency was only %d queries. "
                  "Consider reducing max_num_clusters.", F.col("max_clusters_observed"), F.col("max_concurrent"))))
    large = (oversized(warehouses, history, as_of, max_median_seconds=max_median_seconds)
             .withColumn("recommendation_type", F.lit("OVERSIZED")).withColumn("_rank", F.lit(2))
             .withColumn("recommendation_text", F.format_string(
                 "%s warehouse with avg queue time %.1fs and median query duration %.1fs. Consider downsizing one tier.",
                 F.col("warehouse_size"), F.col("avg_queue_ms") / 1000, F.col("median_duration_seconds").cast("double"))))
    found = (idle.drop("warehouse_type").unionByName(scaled, allowMissingColumns=True)
             .unionByName(large, allowMissingColumns=True)
             .withColumn("workspace_id", F.coalesce(F.col("workspace_id").cast("string"), F.lit(""))))
    if warehouse_id is not None:
        found = found.filter(F.col("warehouse_id") == warehouse_id)
    return found.orderBy("_rank", "warehouse_id").drop("_rank")


def warehouses_analyzed(found: DataFrame) -> DataFrame:
    """H4: how many warehouses have a finding."""
    return found.agg(F.countDistinct("warehouse_id").alias("warehouses_analyzed"))
