"""AI and ML cost (M)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlens.functions import classify as C
from meterlens.functions.shape import top
from meterlens.operators.pricing import day, in_window, meta, metered, totals

def _rows(usage: DataFrame, prices: DataFrame, start: str, end: str, dims: list[str | Column], where: Column) -> DataFrame:
    offering = F.col("product_features.model_serving.offering_type").alias("offering_type")
    return metered(usage, prices, start, end, ["billing_origin_product", "sku_name", offering, *dims], where)


def _workspaces() -> Column:
    return F.countDistinct("workspace_id").alias("workspace_count")


def summary(usage: DataFrame, prices: DataFrame, start: str, end: str) -> DataFrame:
    """M1.  The mean of distinct endpoints per day is the number of (day, endpoint) pairs over the number of days."""
    rows = _rows(usage, prices, start, end, ["usage_date", "workspace_id", meta("endpoint_name")], C.is_aiml())
    pairs, days = F.countDistinct("usage_date", "endpoint_name"), F.countDistinct("usage_date")
    return rows.agg(*totals(), _workspaces(), F.countDistinct("endpoint_name").alias("endpoint_count"),
                    days.alias("days_in_range"), F.min("usage_date").alias("first_date"), F.max("usage_date").alias("last_date"),
                    F.coalesce(F.try_divide(pairs, days), F.lit(0.0)).alias("avg_endpoints_per_day"))


def by_provider(usage: DataFrame, prices: DataFrame, start: str, end: str) -> DataFrame:
    """M2."""
    rows = _rows(usage, prices, start, end, ["workspace_id"], C.is_provider())
    return (rows.groupBy(C.provider().alias("provider"), "sku_name").agg(*totals(), _workspaces())
            .orderBy(F.desc("total_spend"), "sku_name"))


def serverless_endpoints(usage: DataFrame, prices: DataFrame, start: str, end: str, limit: int | None = 100) -> DataFrame:
    """M3; a roll-up (M3b) needs every row, ``limit=None``."""
    rows = metered(usage, prices, start, end, ["sku_name", "usage_date", "workspace_id", meta("endpoint_name")],
                   F.col("sku_name").contains("SERVERLESS_REAL_TIME_INFERENCE"))
    launch = F.when(F.col("sku_name").contains("LAUNCH"), "Launch (Scale-from-Zero)").otherwise("Steady State")
    grouped = (rows.groupBy(F.coalesce("endpoint_name", F.lit("UNKNOWN")).alias("endpoint_name"), "sku_name",
                            launch.alias("cost_type"))
               .agg(*totals(), _workspaces(), F.countDistinct("usage_date").alias("days_active")))
    return top(grouped, "total_spend", limit, "endpoint_name", "sku_name")


def endpoint_totals(endpoints: DataFrame) -> DataFrame:
    """An M3 report per endpoint; the days shown are those of its largest row."""
    largest = F.struct("total_spend", "sku_name")
    return (endpoints.groupBy("endpoint_name").agg(F.sum("total_spend").alias("total_spend"),
                                                   F.sum("total_dbus").alias("total_dbus"),
                                                   F.max_by("days_active", largest).alias("days_active"))
            .orderBy(F.desc("total_spend"), "endpoint_name"))


def by_category(usage: DataFrame, prices: DataFrame, start: str, end: str) -> DataFrame:
    """M4."""
    rows = _rows(usage, prices, start, end, ["workspace_id"], C.is_aiml())
    return rows.groupBy(C.aiml_category().alias("category")).agg(*totals(), _workspaces()).orderBy(F.desc("total_spend"))


def timeseries(usage: DataFrame, prices: DataFrame, start: str, end: str) -> DataFrame:
    """M5."""
    rows = _rows(usage, prices, start, end, ["usage_date"], C.is_aiml())
    return (rows.groupBy("usage_date", C.aiml_series_category().alias("category")).agg(*totals())
            .orderBy("usage_date", "category"))


def top_models(usage: DataFrame, prices: DataFrame, start: str, end: str, limit: int = 20) -> DataFrame:
    """M6: models and feature stores."""
    where = (C.contains_any(F.col("sku_name"), ("FEATURE", "TRAINING", *C.MODEL_MARKS))
             | (F.col("billing_origin_product") == "FOUNDATION_MODEL_SERVING"))
    rows = _rows(usage, prices, start, end, ["usage_date", "workspace_id", meta("endpoint_name")], where)
    grouped = (rows.withColumn("model_type", C.model_type()).filter(F.col("model_type").isNotNull())
               .groupBy(F.coalesce("endpoint_name", F.lit("Unknown")).alias("model_name"), "model_type")
               .agg(*totals(), F.countDistinct("usage_date").alias("days_active"), _workspaces()))
    return top(grouped, "total_spend", limit, "model_name", "model_type")


# fixed values: columns of the ML cluster report
ML_CLUSTER_SCHEMA = ("cluster_name string, cluster_id string, runtime_version string, owner string, workspace_id bigint, "
                     "total_dbus decimal(34,4), total_spend decimal(38,10), days_active bigint")


def ml_clusters(usage: DataFrame, prices: DataFrame, clusters: DataFrame | None, start: str, end: str) -> DataFrame:
    """M7: clusters that ever had an ML or GPU runtime.  M7b: no rows without the cluster table.

    Bills do not show the runtime, so the cluster table decides; usage is
    grouped per cluster before it meets that table.
    """
    if clusters is None:
        return usage.sparkSession.createDataFrame([], ML_CLUSTER_SCHEMA)
    facts = (clusters.groupBy("cluster_id")
             .agg(F.max(C.is_ml_runtime(F.col("dbr_version"))).alias("ml"), F.max("cluster_name").alias("cluster_name"),
                  F.max("dbr_version").alias("runtime_version"), F.max("owned_by").alias("owner"))
             .filter(F.col("ml")).drop("ml"))
    rows = (metered(usage, prices, start, end, ["usage_date", "workspace_id", meta("cluster_id")],
                    F.col("usage_metadata.cluster_id").isNotNull())
            .groupBy("cluster_id").agg(F.max("workspace_id").alias("workspace_id"), *totals(),
                                       F.countDistinct("usage_date").alias("days_active")))
    return (facts.join(rows, "cluster_id")
            .select("cluster_name", "cluster_id", "runtime_version", "owner", "workspace_id", "total_dbus", "total_spend",
                    "days_active").orderBy(F.desc("total_spend"), "cluster_id"))


def agents(usage: DataFrame, prices: DataFrame, served_entities: DataFrame | None, start: str, end: str) -> DataFrame:
    """M8 with endpoint names, M8b from bills alone."""
    rows = metered(usage, prices, start, end, ["usage_date", "workspace_id", "billing_origin_product",
                                               meta("endpoint_name"), meta("endpoint_id")], C.is_agent())
    if served_entities is None:
        known = F.col("endpoint_name")
    else:
        names = (served_entities.filter(F.col("endpoint_id").isNotNull()).groupBy("endpoint_id")
                 .agg(F.max("endpoint_name").alias("_served")))
        rows = rows.join(names, "endpoint_id", "left")
        known = F.coalesce("_served", "endpoint_name")
    grouped = (rows.groupBy(F.coalesce(known, "endpoint_id", F.lit("Unknown")).alias("agent_name"))
               .agg(F.max("endpoint_id").alias("endpoint_id"), F.max("workspace_id").alias("workspace_id"),
                    F.max(C.agent_type(known)).alias("agent_type"), *totals(),
                    F.countDistinct("usage_date").alias("days_active"), _workspaces(),
                    F.min("usage_date").alias("first_seen"), F.max("usage_date").alias("last_seen")))
    return (grouped.withColumn("avg_daily_spend", F.try_divide(F.col("total_spend").cast("double"), F.col("days_active")))
            .orderBy(F.desc("total_spend"), "agent_name"))


def sku_catalogue(usage: DataFrame, prices: DataFrame, start: str, end: str) -> DataFrame:
    """M9."""
    rows = metered(usage, prices, start, end, ["sku_name", "billing_origin_product", "usage_type"], C.is_model_serving())
    return (rows.groupBy("sku_name", "billing_origin_product", "usage_type")
            .agg(F.sum("records").alias("usage_records"), *totals()).orderBy(F.desc("total_spend"), "sku_name"))


def runtime_versions(clusters: DataFrame, limit: int = 50) -> DataFrame:
    """Runtime versions of the cluster log by how often they appear."""
    kind = F.when(C.is_ml_runtime(F.col("dbr_version")), "ML/GPU").otherwise("Standard")
    counts = (clusters.filter(F.col("dbr_version").isNotNull())
              .groupBy(F.col("dbr_version").alias("spark_version"), kind.alias("runtime_type"))
              .agg(F.count("*").alias("cluster_count")))
    return top(counts.select("spark_version", "cluster_count", "runtime_type"), "cluster_count", limit, "spark_version")


def runtime_coverage(usage: DataFrame, clusters: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """M10, second result: how much of the ML clusters shows in the bills."""
    ml = clusters.filter(C.is_ml_runtime(F.col("dbr_version"))).select("cluster_id").distinct()
    rows = (in_window(usage, F.date_sub(day(as_of), days), as_of).groupBy(meta("cluster_id"))
            .agg(F.count("*").alias("records"), F.sum("usage_quantity").alias("dbus")).join(ml, "cluster_id", "left_semi"))
    return rows.agg(F.count("cluster_id").alias("ml_clusters_with_billing"),
                    F.coalesce(F.sum("records"), F.lit(0)).alias("billing_rows"), F.sum("dbus").alias("total_dbus"))
