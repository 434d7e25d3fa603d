"""Infrastructure cost estimates from cluster usage (I)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlens.functions import classify as C
from meterlens.functions import machines as M
from meterlens.functions.shape import names_of, share_of_total, top, wide
from meterlens.operators.pricing import QUANTITY, in_window, meta, metered


def cluster_hours(usage: DataFrame, start: str, end: str) -> DataFrame:
    """Usage with a cluster, outside SQL and DLT, per (cluster, day, cloud); a DBU is read as an hour."""
    rows = in_window(usage, start, end).filter(
        F.col("usage_metadata.cluster_id").isNotNull() & ~F.col("billing_origin_product").isin("SQL", "DLT"))
    return rows.groupBy(meta("cluster_id"), "usage_date", "cloud").agg(
        F.sum("usage_quantity").cast(QUANTITY).alias("dbu_hours"), F.max("workspace_id").alias("workspace_id"))


def latest_clusters(clusters: DataFrame) -> DataFrame:
    """Latest configuration of each cluster.

    The cluster table is a change log; joining it raw would repeat usage once
    per change, so every report takes the last row by change time.
    """
    row = F.struct("cluster_name", F.col("driver_node_type").alias("driver_instance_type"),
                   F.col("worker_node_type").alias("worker_instance_type"), "cluster_source")
    return clusters.groupBy("cluster_id").agg(F.max_by(row, "change_time").alias("c")).select("cluster_id", "c.*")


def _per_cluster(usage: DataFrame, start: str, end: str) -> DataFrame:
    return cluster_hours(usage, start, end).groupBy("cluster_id").agg(
        F.max("workspace_id").alias("workspace_id"), F.max("cloud").alias("cloud"),
        F.sum("dbu_hours").alias("total_dbu_hours"), F.countDistinct("usage_date").alias("days_active"))


def _estimated(rows: DataFrame, machine_prices: DataFrame, cloud: str, hours: str, name: str) -> DataFrame:
    """Cost of a driver and two workers, run time taken as half the DBU hours."""
    for kind in ("driver", "worker"):
        rows = M.with_hourly_price(rows, machine_prices, f"{kind}_instance_type", F.lit(cloud), f"_{kind}_price")
    cost = F.col(hours).cast("double") * (F.col("_driver_price") + F.col("_worker_price") * 2) / 2
    return rows.withColumn(name, cost).drop("_driver_price", "_worker_price")


def aws_cost_estimate(usage: DataFrame, clusters: DataFrame, machine_prices: DataFrame, start: str, end: str,
                      limit: int | None = 100) -> DataFrame:
    """Usage is grouped per cluster, then configuration and prices are added to those rows.

    Totals over it (I8b) need every row, ``limit=None``.
    """
    rows = _per_cluster(usage, start, end).join(latest_clusters(clusters), "cluster_id", "left")
    rows = _estimated(rows, machine_prices, "AWS", "total_dbu_hours", "estimated_aws_cost")
    shown = rows.select("cluster_id", "cluster_name", "driver_instance_type", "worker_instance_type", "cluster_source",
                        "workspace_id", F.lit(None).cast("string").alias("state"), "total_dbu_hours",
                        "estimated_aws_cost", "days_active")
    return top(shown, "estimated_aws_cost", limit, "cluster_id")


def hours_by_worker_family(usage: DataFrame, clusters: DataFrame, start: str, end: str) -> DataFrame:
    """I2."""
    rows = cluster_hours(usage, start, end).join(latest_clusters(clusters), "cluster_id", "left")
    return (rows.groupBy(C.worker_family(F.col("worker_instance_type")).alias("instance_family"))
            .agg(F.sum("dbu_hours").alias("total_dbu_hours"), F.countDistinct("usage_date").alias("days_active"))
            .orderBy(F.desc("total_dbu_hours")))


def aws_cost_series(usage: DataFrame, clusters: DataFrame, machine_prices: DataFrame, start: str, end: str,
                    families: list[str] | None = None) -> DataFrame:
    """Day x worker family; I3c: only the chosen families."""
    rows = (cluster_hours(usage, start, end).join(latest_clusters(clusters), "cluster_id", "left")
            .withColumn("instance_family", C.worker_family(F.col("worker_instance_type"))))
    if families is not None:
        rows = rows.filter(F.col("instance_family").isin(*families))
    rows = _estimated(rows, machine_prices, "AWS", "dbu_hours", "_cost")
    return (rows.groupBy("usage_date", "instance_family").agg(F.sum("_cost").alias("estimated_aws_cost"))
            .orderBy("usage_date", "instance_family"))


def aws_cost_series_wide(series: DataFrame, families: list[str] | None = None) -> DataFrame:
    """One column per family and the day's total, rounded to 2 decimals."""
    labelled = series.select(F.col("usage_date").alias("date"), "estimated_aws_cost",
                             F.coalesce(F.nullif("instance_family", F.lit("")), F.lit("unknown")).alias("family"))
    families = families or names_of(labelled, "family")
    table = wide(labelled, "date", "family", "estimated_aws_cost", families)
    total = labelled.groupBy("date").agg(F.sum("estimated_aws_cost").alias("total"))
    return (table.join(total, "date").select("date", *[F.round(F.col(f"`{c}`"), 2).alias(c) for c in ["total", *families]])
            .orderBy("date"))


def families_by_spend(series: DataFrame) -> DataFrame:
    """The column order, by spend."""
    return (series.groupBy("instance_family").agg(F.sum("estimated_aws_cost").alias("total"))
            .orderBy(F.desc("total"), "instance_family"))


def cluster_usage(usage: DataFrame, clusters: DataFrame, start: str, end: str, limit: int | None = 100) -> DataFrame:
    """I4: all clouds, one row per cluster; totals over it (I5, I6) need every row, ``limit=None``."""
    rows = _per_cluster(usage, start, end).join(latest_clusters(clusters), "cluster_id", "left")
    shown = rows.select("cluster_id", "cluster_name", "driver_instance_type", "worker_instance_type", "cluster_source",
                        "workspace_id", "cloud", "total_dbu_hours", "days_active")
    return top(shown, "total_dbu_hours", limit, "cluster_id")


def cluster_cost(cluster_report: DataFrame, machine_prices: DataFrame, cloud: str, limit: int | None = 100) -> DataFrame:
    """An uncut I4 report with cost at one cloud's prices and each cluster's percent of all; cut last."""
    rows = share_of_total(_estimated(cluster_report, machine_prices, cloud, "total_dbu_hours", "estimated_cost"), "estimated_cost")
    return top(rows, "total_dbu_hours", limit, "cluster_id").withColumn("is_historical", F.col("driver_instance_type").isNull() & F.col("worker_instance_type").isNull())


def family_hours(cluster_report: DataFrame, cloud: str) -> DataFrame:
    """Hours per family; a cluster's hours count once for its driver and once for its worker."""
    machine = F.explode(F.array_compact(F.array("driver_instance_type", "worker_instance_type"))).alias("machine")
    rows = cluster_report.select("total_dbu_hours", "days_active", machine)
    return (rows.groupBy(C.instance_family(F.col("machine"), F.lit(cloud)).alias("instance_family"))
            .agg(F.sum("total_dbu_hours").alias("total_dbu_hours"), F.max("days_active").alias("days_active"))
            .orderBy(F.desc("total_dbu_hours"), "instance_family"))


def infra_series(usage: DataFrame, start: str, end: str) -> DataFrame:
    """Daily hours at the flat average price."""
    return (cluster_hours(usage, start, end).groupBy(F.col("usage_date").alias("date"))
            .agg(F.sum("dbu_hours").alias("total_dbu_hours"), F.max("cloud").alias("cloud"))
            .select("date", "cloud", (F.col("total_dbu_hours").cast("double") * M.DEFAULT_HOURLY_COST).alias("estimated_cost"),
                    "total_dbu_hours")
            .orderBy("date"))


def infra_summary(usage: DataFrame, prices: DataFrame, start: str, end: str) -> DataFrame:
    """I8: billed compute cost; needs a cluster and leaves SQL SKUs out, unlike the cost series."""
    where = F.col("usage_metadata.cluster_id").isNotNull() & C.is_infra_sku()
    daily = (metered(usage, prices, start, end, ["usage_date", meta("cluster_id")], where)
             .groupBy("usage_date").agg(F.sum("spend").cast("double").alias("cost"), F.countDistinct("cluster_id").alias("clusters")))
    average = F.avg("clusters")
    return daily.agg(F.sum("cost").alias("total_cost"), average.alias("avg_clusters_per_day"),
                     F.when(average > 0, F.avg(F.col("cost") / F.col("clusters"))).otherwise(F.lit(0.0)).alias("avg_cost_per_cluster"),
                     F.count("*").alias("days_in_range"))


def infra_summary_or_estimate(summary: DataFrame, estimate: DataFrame, series: DataFrame) -> DataFrame:
    """The billed summary, or the cluster estimate when nothing was billed.

    ``estimate`` is an I1 report, ``series`` an I7 one.  A missing cost per
    cluster is the mean of the series' days with a cost.
    """
    typed = F.col("driver_instance_type").isNotNull() | F.col("worker_instance_type").isNotNull()
    e = estimate.agg(F.sum(F.when(typed, F.col("estimated_aws_cost"))).alias("total"), F.count(F.when(typed, 1)).alias("clusters"),
                     F.sum("total_dbu_hours").alias("hours"))
    mean = series.filter(F.col("estimated_cost") > 0).select(F.avg("estimated_cost")).scalar()
    billed = F.col("total_cost") > 0

    def fallback(name: str) -> Column:
        return F.coalesce(e.select(name).scalar().cast("double"), F.lit(0.0))
    return summary.select(
        F.when(billed, F.col("total_cost")).otherwise(fallback("total")).alias("total_cost"),
        fallback("hours").alias("total_dbu_hours"),
        F.when(billed, F.col("avg_clusters_per_day")).otherwise(fallback("clusters")).alias("avg_clusters_per_day"),
        F.coalesce(F.when(F.col("avg_cost_per_cluster") != 0, F.col("avg_cost_per_cluster")), mean, F.lit(0.0))
         .alias("avg_cost_per_cluster"))
